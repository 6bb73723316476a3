"""Whole-text byte-pair ids, assembled from the ids of distinct pieces.

The public byte-level vocabulary splits a text into pieces by character class and merges only
inside a piece, so a text's ids are the concatenated ids of its pieces.  The split runs in
numpy over a batch's code points; pieces are looked up by a 64-bit hash, and the tokenizer is
asked once per distinct piece.  A string with an id of its own, as <|endoftext|>, is one piece
and splits the text around it, as the plain tokenizer does.  A worker remembers a bounded number of pieces and starts
afresh past it, with equal results.  Character classes are asked of the tokenizer as well.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from quaymark.llm.text import Rolling, mixed, runs_of

#: Distinct pieces a worker remembers.
REMEMBERED = 1_000_000
VOCABULARY = "byte_bpe_50k.json"
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Fixed values of the public split pattern: endings that stay with their apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


class HashIndex:
    """Open addressing from 64-bit hashes to numbers."""

    def __init__(self, capacity: int):
        bits = max(10, (2 * capacity - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        slot, left = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(left):
            key = self.keys[slot]
            hit = key == h
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (key != 0)
            left, h, slot = left[go], h[go], (slot[go] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        slot = (h >> self.shift).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = free & (self.keys[slot] == h)
            self.values[slot[won]] = values[won]
            h, values, slot = h[~won], values[~won], (slot[~won] + 1) & self.mask


class Pieces:
    """Ids of texts, piece by piece."""

    def __init__(self, path: str, spans: bool = False):
        from tokenizers import Tokenizer

        self.spans = spans

        self.tokenizer = Tokenizer.from_file(path)
        # strings that the vocabulary has ids of its own for, wherever a text holds them
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex(REMEMBERED * 5 // 4)
        self.known = self.size = 0
        self.start = np.zeros(1024, np.int32)  # of a piece's ids in flat
        self.count = np.zeros(1024, np.int32)
        self.ends = np.zeros(1024, bool)  # whether a sentence can end after the piece
        self.flat = np.zeros(4096, np.int32)
        self.flat_at = np.zeros(4096, np.int32)  # with spans: the characters of each id within its piece
        self.flat_to = np.zeros(4096, np.int32)

    def _room(self, pieces: int, ids: int) -> None:
        for name, need in (("start", pieces), ("count", pieces), ("ends", pieces), ("flat", ids), *((("flat_at", ids), ("flat_to", ids)) if self.spans else ())):
            have = getattr(self, name)
            if len(have) < need:
                setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have) // 2), have.dtype)]))

    def _learn(self, hashes: np.ndarray, new: list[str]) -> None:
        self.index.add(hashes, np.arange(self.known, self.known + len(new), dtype=np.int32))
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            coded = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded.ids, np.int64)
            counts = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(part))
            n, m = self.known + len(part), self.size + len(ids)
            self._room(n, m)
            self.start[self.known : n] = self.size + np.cumsum(counts) - counts
            self.count[self.known : n] = counts
            self.ends[self.known : n] = ["\n" in p or p.strip(" *#$%&\"')")[-1:] in (".", "!", "?", "…", "。") and not p[-1:].isalnum() for p in part]
            self.flat[self.size : m] = ids
            if self.spans:
                self.flat_at[self.size : m], self.flat_to[self.size : m] = np.array(coded.offsets, np.int32).reshape(-1, 2).T
            self.known, self.size = n, m

    def _classes(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (unknown := kinds == UNKNOWN).any():
            alone = lambda x: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(x)) == 1
            for p in np.unique(points[unknown]).tolist():
                c = chr(p)
                self.kinds[p] = LETTER if alone("a" + c) else NUMBER if alone("1" + c) else OTHER if alone("!" + c) else SPACE
            kinds = self.kinds[points]
        return kinds

    def split(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Whether a piece starts at each character; firsts are the first characters of texts."""
        kinds = self._classes(points)
        edge = np.ones(len(points), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
        edge[firsts] = True
        run = np.flatnonzero(edge)
        if not len(run):
            return edge
        stop = np.append(run[1:], len(points))
        space = kinds[run] == SPACE
        opens = np.zeros(len(run) + 1, bool)  # the run begins a text
        opens[-1] = True
        opens[np.searchsorted(run, firsts)] = True
        followed = ~opens[1:]
        blank = points[stop - 1] == 32
        lent = space & followed & blank  # its last blank goes to the next run
        begins = edge
        begins[run[lent & (stop - run == 1)]] = False  # the blank alone: set again as the start of the next piece
        after = np.flatnonzero(lent) + 1
        begins[run[after]] = False
        begins[run[after] - 1] = True
        split = space & followed & ~blank & (stop - run > 1)
        begins[stop[split] - 1] = True
        # an apostrophe alone, not after a blank, with one of the endings
        quote = np.flatnonzero((points[run] == 39) & (stop - run == 1) & followed & ~np.concatenate([[False], lent[:-1]]))
        quote = quote[kinds[run[quote + 1]] == LETTER] if len(quote) else quote
        for ending in SUFFIXES if len(quote) else ():
            at = run[quote + 1]
            size = stop[quote + 1] - at
            fits = size >= len(ending)
            for k, c in enumerate(ending):
                fits &= points[np.minimum(at + k, len(points) - 1)] == ord(c)
            begins[at[fits]] = False
            more = fits & (size > len(ending))
            begins[at[more] + len(ending)] = True
            quote = quote[~fits]
        return begins

    def _added(self, joined: str, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the strings that have ids of their own; none crosses texts."""
        found = []
        if self.added and self.added.search(joined):
            for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(joined)], strict=True):
                found.extend(m.span() for m in self.added.finditer(joined, a, b))
        spans = np.array(found, np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]

    def codes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For UTF-8 texts: piece numbers one after the other, pieces per text, first character of each piece."""
        if self.known > REMEMBERED:
            self._forget()
        joined = data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # characters before each text
        firsts = np.unique(chars[:-1][np.diff(chars) > 0])
        at, to = self._added(joined, firsts)
        edge = self.split(points, np.union1d(firsts, np.concatenate([at, to[to < len(points)]])))
        for a, b in zip(at.tolist(), to.tolist(), strict=True):
            edge[a + 1 : b] = False
        begin = np.flatnonzero(edge)
        hashes = Rolling(mixed_points(points)).of(begin, np.append(begin[1:], len(points)))
        hashes[hashes == 0] = 1
        found = self.index.find(hashes)
        if len(missing := np.flatnonzero(found < 0)):
            new, first = np.unique(hashes[missing], return_index=True)
            at = missing[first]
            stop = np.append(begin[1:], len(points))[at]
            if len(new) + self.known > REMEMBERED * 5 // 4:
                self._forget()
                new, at = np.unique(hashes, return_index=True)
                stop = np.append(begin[1:], len(points))[at]
                if len(new) > REMEMBERED:
                    self.index = HashIndex(2 * len(new))
            self._learn(new, [joined[a:b] for a, b in zip(begin[at].tolist(), stop.tolist(), strict=True)])
            found = self.index.find(hashes)
        upto = np.searchsorted(begin, chars)
        return found, np.diff(upto), begin

    def ids(self, codes: np.ndarray) -> np.ndarray:
        row, within = runs_of(self.count[codes])
        return self.flat[self.start[codes][row] + within]


def mixed_points(points: np.ndarray) -> np.ndarray:
    return mixed(points.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))


@functools.lru_cache(maxsize=2)
def pieces(vocabulary: str = VOCABULARY, spans: bool = False) -> Pieces:
    """The worker's pieces for a vocabulary: a path, or the name of a public file; with spans, each id's characters."""
    import public_tokenizers

    return Pieces(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary), spans)
