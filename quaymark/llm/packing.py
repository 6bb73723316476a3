"""Packing: order-preserving dynamic programming over window cuts.

The token stream of a partition (its documents in their order, each closed by an end id) is
cut into windows of at most `length` tokens.  A window costs its padding plus a penalty for
where it ends: nothing at a document's end, little after a sentence, more inside one.  With
candidates c_0 < c_1 < ... the least cost is

    best[j] = penalty[j] + min over c_j - c_i <= length of best[i] + length - (c_j - c_i)

whose minimum slides over the candidates, so a monotone queue finds it in constant time
per candidate.  Candidates are document ends, sentence ends, and every `stride` tokens
where neither comes sooner, so that a window can always be closed.

The stream is solved in stretches of about `horizon` tokens; the last window of a stretch
stays open and begins the next, so a worker holds a stretch and one document.  What is left
at the end of a partition is split at powers of two, which need no padding.  There is no
shuffle; a lost task packs its own partition again.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm import tokens
from quaymark.llm.text import runs_of, small_batches, utf8

LENGTH, END_ID, STRIDE, HORIZON = 2048, 1, 64, 1 << 19
SENTENCE_PENALTY, INSIDE_PENALTY = 4, 48

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary string"


def cuts(candidates: np.ndarray, penalties: np.ndarray, length: int, whole: bool) -> list[int]:
    """Positions where windows end, cheapest in padding plus penalties.

    candidates ascend from 0 in steps of at most `length`.  With `whole`, the last candidate
    is an end; else the stretch goes on, and the cuts stop at the cheapest open end.
    """
    at, fine = candidates.tolist(), penalties.tolist()
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # indices whose best + position ascends
    value = [0] * len(at)
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        best[j] = cost = fine[j] + length - here + value[i]
        value[j] = v = cost + here
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    if whole:
        j = len(at) - 1
    else:
        j = min((k for k in range(len(at) - 1, -1, -1) if at[-1] - at[k] < length), key=lambda k: (value[k], -k))
    out = []
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


#: Kinds of candidates: where a window may end, and what that costs.
INSIDE, SENTENCE, DOCUMENT = 1, 2, 3
PENALTIES = np.array([0, INSIDE_PENALTY, SENTENCE_PENALTY, 0])
NAMES = ("", "inside", "sentence", "document")


def candidates_of(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, stride: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate positions, and the kind of every position: ends of documents and sentences, and strides between."""
    kind = np.zeros(total + 1, np.int8)
    kind[sentence_ends], kind[doc_ends], kind[0] = SENTENCE, DOCUMENT, DOCUMENT
    good = np.flatnonzero(kind)
    gaps = np.diff(np.append(good, total + 1))
    wide = gaps > stride
    row, k = runs_of((gaps[wide] - 1) // stride)
    kind[good[wide][row] + (k + 1) * stride] = INSIDE
    if whole and not kind[total]:
        kind[total] = INSIDE
    return np.flatnonzero(kind), kind


class Packer:
    """State of one partition's stream."""

    def __init__(self, length: int, stride: int, horizon: int, partition: int, keep_ids: bool):
        self.length, self.stride, self.horizon, self.keep_ids = length, stride, horizon, keep_ids
        self.sequence = partition << 33
        self.docs: list[tuple] = []  # (doc_id, ids, sentence ends, tokens before the open part)
        self.waiting = 0

    def add(self, doc_id, ids: np.ndarray, sentences: np.ndarray) -> Iterator[list]:
        self.docs.append((doc_id, ids, sentences, 0))
        self.waiting += len(ids)
        if self.waiting >= self.horizon:
            yield from self.solve(False)

    def solve(self, last: bool) -> Iterator[list]:
        if not self.docs:
            return
        lengths = np.array([len(d[1]) - d[3] for d in self.docs])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        inner = np.concatenate([s[s > gone] - gone + b for (_, _, s, gone), b in zip(self.docs, starts, strict=True)])
        total = int(ends[-1])
        at, kinds = candidates_of(ends, inner, total, min(self.stride, self.length), last)
        found = cuts(at, PENALTIES[kinds[at]], self.length, last)
        if last:  # the rest: largest power of two first
            begin = found[-2] if len(found) > 1 else 0
            rest = total - begin
            found = found[:-1]
            while rest and rest < self.length:
                step = 1 << (rest.bit_length() - 1)
                begin, rest = begin + step, rest - step
                found.append(begin)
            if rest:
                found.append(total)
        doc, begin = 0, 0
        for cut in found:
            offset, kind = 0, NAMES[max(kinds[cut], INSIDE)]
            while begin < cut:
                name, ids, _, gone = self.docs[doc]
                a = gone + begin - int(starts[doc])
                n = min(cut, int(ends[doc])) - begin
                part = ids[a : a + n]
                row = [name, a, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), self.sequence, offset, kind]
                yield [*row, part] if self.keep_ids else row
                begin, offset = begin + n, offset + n
                if begin == ends[doc]:
                    doc += 1
            self.sequence += 1
        left = self.docs[doc:]
        if left:
            name, ids, sentences, gone = left[0]
            left[0] = (name, ids, sentences, gone + begin - int(starts[doc]))
        self.docs, self.waiting = left, total - begin


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    vocabulary: str = tokens.VOCABULARY,
    end_id: int = END_ID,
    stride: int = STRIDE,
    horizon: int = HORIZON,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: its tokens, and the sequence and offset where they lie.

    boundary tells where the piece's sequence ends: at a document's end, a sentence's or inside
    one.  With with_ids the token ids come along.  Null text counts as empty (the end id alone);
    a null or repeated id is carried as it is, each row being a document; other columns are
    ignored.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] + [pa.list_(pa.int32())] * with_ids

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = tokens.pieces(vocabulary)
        packer = Packer(length, stride, horizon, TaskContext.get().partitionId(), with_ids)
        out: list = []
        for rows in batches:
            codes, counts, _ = coder.codes(*utf8(rows.column(1)))
            ids, sizes, ends = coder.ids(codes), coder.count[codes], coder.ends[codes]
            upto = np.cumsum(sizes)
            doc_upto = np.concatenate([[0], np.cumsum(counts)])
            for k, name in enumerate(rows.column(0).to_pylist()):
                a, b = doc_upto[k], doc_upto[k + 1]
                first = int(upto[a - 1]) if a else 0
                final = int(upto[b - 1]) if b > a else first
                own = np.append(ids[first:final], np.int32(end_id))
                out.extend(packer.add(name, own, upto[a:b][ends[a:b]] - first))
                if len(out) > 2000:
                    yield batch(out)
                    out = []
        out.extend(packer.solve(True))
        if out:
            yield batch(out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
