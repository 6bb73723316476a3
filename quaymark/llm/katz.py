"""Katz backoff scoring with Good-Turing discounts.

P(w | h) = d(c) c(h, w) / (c(h) + e) where the pair was seen in training, else alpha(h) P(w); P(w)
likewise falls back from discounted counts to one unknown word.  d is Katz's Good-Turing discount
for counts up to 5, e a fixed part of a count that every history reserves, and alpha makes the
probabilities of a history add up to one exactly, from sums over all its seen pairs.

The tables are hash partitions, and texts are scored where their entries lie, by the recursion
above for each token: the tokens of all texts, training texts among them, are dealt to the table
partitions once, which then hold the counts of their pairs as well as the questions.  The
`FREQUENT` most frequent words, a fixed number, are known to every task with their counts; they
make up most tokens and take two bytes each; held-out texts count for that too, so no word that
any text repeats often is rare.  A pair

- of frequent words is dealt by both; where it makes more than one in `SHARE` tokens of a group of
  texts, the group sends its count in one row, keeps the places and gets the score back, so no pair
  brings a partition more than a fixed part of the tokens,
- with a rare word is dealt by that word, so the word's count is complete where the pair is,
- of two rare words by the second and then, with that one's probability, by the first.

Histories' sums are aggregated over partitions; texts get back one partial sum per partition.
Discounts enter as counts of counts, so one pass over the pairs is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.text import LOWER, SPACES, Rolling, mixed, runs_of, small_batches, stored, utf8, words
from quaymark.llm.tokens import HashIndex

FREQUENT, K, RESERVED = 65_000, 5, 0.5
FOLDS, ADDED = 10, 0.1
#: Tokens of a group of texts that is dealt out together, and of one table partition on average.
GROUP_TOKENS, PART_TOKENS = 500_000, 1_200_000
#: A pair of frequent words that makes more than one in so many tokens of a group is sent once, with its count.
SHARE = 8192
_END, _BEGIN = np.uint64(0x9AE16A3B2F90404F), 65_535

_ROWS = "part int, kind string, block long, a binary, b binary, c binary, d binary, e binary"
#: A pair of rare words on its way to its history: text within its group, flags (training, first of its type), count.
_RARE = np.dtype([("doc", "<u2"), ("flags", "u1"), ("seen", "<u4")])
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_KINDS = [pa.int32(), pa.string(), pa.int64()] + [pa.binary()] * 5


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def _bytes(*arrays: np.ndarray) -> tuple:
    return tuple(x.tobytes() for x in arrays) + (b"",) * (5 - len(arrays))


def discounts(seen: np.ndarray, k: int = K) -> np.ndarray:
    """d(0), ..., d(k) from the numbers of types seen once, twice, ..., k + 1 times.

    Where Good-Turing gives no proper discounts (few or odd counts), an absolute one takes its place.
    """
    n = np.concatenate([[0.0], seen.astype(float)])
    r = np.arange(1, k + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = (k + 1) * n[k + 1] / n[1]
        d = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut)
    if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
        less = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = (r - min(max(less, 0.1), 0.9)) / r
    return np.concatenate([[1.0], d])


class Words:
    """What every task knows: the frequent words with their counts, and the words' distribution."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, types: int, seen: np.ndarray, texts: int, k: int, tokens: int):
        if _END not in hashes:
            hashes, counts = np.append(hashes, _END), np.append(counts, 0)
        self.hashes, self.counts = hashes.astype(np.uint64), counts.astype(np.int64)
        self.total, self.types, self.k, self.tokens = total, types, k, tokens
        self.d = discounts(seen, k)
        # mass that discounts take from words seen up to k times; half a count where there is none
        small = sum(r * seen[r - 1] * (1 - self.d[r]) for r in range(1, k + 1))
        self.unknown = (small + RESERVED) / (total + RESERVED)
        self.history = np.zeros(1 << 16)
        self.history[: len(counts)] = self.counts
        self.history[_BEGIN] = texts

    def index(self) -> HashIndex:
        index = HashIndex(len(self.hashes))
        index.add(self.hashes, np.arange(len(self.hashes), dtype=np.int32))
        return index

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.where(c <= self.k, c, 0)] * c / (self.total + RESERVED), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADDED) / (self.total + ADDED * (self.types + 1)))


def is_training(id_col: str = "doc_id", folds: int = FOLDS) -> F.Column:
    """Checksum of the id as text not divisible by `folds`; rows without id are held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds != 0, F.lit(False))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words and its end, and the tokens per text."""
    data, offsets = utf8(column)
    data = LOWER[data]
    start, end, owner = words(data, offsets, SPACES)
    n = np.bincount(owner, minlength=len(offsets) - 1)
    out = np.full(len(start) + len(n), _END, np.uint64)
    out[np.arange(len(start)) + owner] = Rolling(data).of(start, end)
    return out, n + 1


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n over the training texts and times over all; docs: doc_id, text, training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0

        def merged() -> pa.RecordBatch:
            word, at = np.unique(np.concatenate(held), return_inverse=True)
            n, times = (np.bincount(at, np.concatenate(c), len(word)).astype(np.int64) for c in zip(*counts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n), pa.array(times)], ["word", "n", "times"])

        for batch in batches:
            tokens, lengths = _tokens(batch.column(0))
            if len(tokens):
                training = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), lengths)
                word, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
                held.append(word)
                counts.append((np.bincount(at, training, len(word)), times))
                size += len(word)
            if size > 3_000_000:
                yield merged()
                held, counts, size = [], [], 0
        if held:
            yield merged()

    rows = docs.select("text", "training").mapInArrow(run, "word long, n long, times long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def known_words(counts: DataFrame, texts: int, frequent: int, k: int) -> Words:
    """Collects a fixed number of words: those at least as frequent, over all texts, as a bound that few enough reach."""
    step = F.when(F.col("times") < 1024, F.col("times")).otherwise(1024 + F.floor(64 * F.log2(F.col("times") / 1024))).cast("long")
    few = F.least("n", F.lit(k + 2))
    histogram = counts.groupBy(step.alias("step"), few.alias("few")).agg(F.count("*").alias("types"), F.sum("n").alias("n"), F.sum("times").alias("times")).collect()
    total, types, tokens = (sum(h) for h in zip(*((r.n, r.types if r.few else 0, r.times) for r in histogram), strict=True)) if histogram else (0, 0, 0)
    seen = np.zeros(k + 1, np.int64)
    reach: dict[int, int] = {}
    for r in histogram:
        reach[r.step] = reach.get(r.step, 0) + r.types
        if 1 <= r.few <= k + 1:
            seen[r.few - 1] += r.types
    room, bound = frequent, 1 << 40
    for s in sorted(reach, reverse=True):
        if reach[s] > room:
            break
        room, bound = room - reach[s], s
    table = counts.filter(step >= bound).toArrow()
    return Words(table["word"].to_numpy().view(np.uint64), table["n"].to_numpy(), total, types, seen, texts, k, tokens)


def dealt(docs: DataFrame, known, parts: int, group_tokens: int, share: int = SHARE) -> DataFrame:
    """Pairs of all texts by table partition, and per group of texts what is known at once and where its own frequent pairs are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own: Words = known.value
        index = own.index()
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = texts = 0

        def group() -> Iterator[pa.RecordBatch]:
            ids, training, tokens, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            code = index.find(tokens)
            rare = code < 0
            doc = np.repeat(np.arange(len(lengths)), lengths)
            first = np.cumsum(lengths) - lengths
            h_code, h = np.empty_like(code), np.empty_like(tokens)
            h_code[1:], h[1:] = code[:-1], tokens[:-1]
            h_code[first] = _BEGIN
            # frequent words' share of the base score is known here
            c = own.counts[code[~rare]]
            known_here = np.bincount(doc[~rare], c > 0, len(lengths))
            base = np.bincount(doc[~rare], own.base(c), len(lengths))
            yield _batch([(int(block % parts), "text", block, *_bytes(ids, training, lengths, known_here.astype(np.int64), base))])
            h_rare = h_code < 0
            one_by_one = ~h_rare & ~rare
            at = np.flatnonzero(one_by_one)
            pair, number, times = np.unique(h_code[at].astype(np.uint32) << np.uint32(16) | code[at].astype(np.uint32), return_inverse=True, return_counts=True)
            hot = times > len(tokens) // share + 1
            if hot.any():
                among = hot[number]
                one_by_one[at[among]] = False
                pair, number, at = pair[hot], (np.cumsum(hot) - 1)[number[among]], at[among]
                # a text is one entry of a pair however often it repeats it
                entry, repeats = np.unique(number << 16 | doc[at], return_counts=True)
                left, right = (pair >> np.uint32(16)).astype(np.uint16), (pair & np.uint32(65535)).astype(np.uint16)
                yield _batch([(int(block % parts), "places", block, *_bytes(left, (entry >> 16).astype(np.uint16), (entry & 65535).astype(np.uint16), repeats.astype(np.uint32)))])
                learnt = np.bincount(number, training[doc[at]] & 1, len(pair)).astype(np.uint32)
                part = (mixed(pair.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edge = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
                rows = [(int(part[o[0]]), "hot", block, *_bytes(left[o], right[o], o.astype(np.uint16), learnt[o])) for o in (order[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True))]
                for k in range(0, len(rows), 64):
                    yield _batch(rows[k : k + 64])
            for kind, pick, key in (
                ("ff", one_by_one, lambda p: mixed(h_code[p].astype(np.uint64) << np.uint64(16) | code[p].astype(np.uint64))),
                ("fr", ~h_rare & rare, lambda p: mixed(tokens[p])),
                ("rf", h_rare & ~rare, lambda p: mixed(h[p])),
                ("rr", h_rare & rare, lambda p: mixed(tokens[p])),
            ):
                at = np.flatnonzero(pick)
                if not len(at):
                    continue
                part = (key(at) % np.uint64(parts)).astype(np.int64)
                left, right = (h[at] if kind[0] == "r" else h_code[at].astype(np.uint16)), (tokens[at] if kind[1] == "r" else code[at].astype(np.uint16))
                order = np.lexsort((left, right, part) if kind in ("fr", "rr") else (right, left, part))
                at, part, left, right = at[order], part[order], left[order], right[order]
                edge = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
                rows = [(int(part[a]), kind, block, *_bytes(left[a:b], right[a:b], doc[at[a:b]].astype(np.uint16), training[doc[at[a:b]]])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                for k in range(0, len(rows), 64):
                    yield _batch(rows[k : k + 64])

        for batch in batches:
            tokens, lengths = _tokens(batch.column(1))
            ids, training = batch.column(0).fill_null(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            # null ids are told by a second bit
            held.append((ids, training | (batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << 1), tokens, lengths))
            size, texts = size + len(tokens), texts + len(lengths)
            if size >= group_tokens or texts > 50_000:
                yield from group()
                held, size, texts, block = [], 0, 0, block + 1
        if held:
            yield from group()

    return docs.select("doc_id", "text", "training").mapInArrow(run, _ROWS)


class Pairs:
    """The pairs of one kind in one partition, from the groups' rows; `hot` rows have counts instead of places."""

    def __init__(self, rows: list[tuple], left, right, hot: list[tuple] = ()):
        self.blocks = [r[2] for r in rows]
        self.left, self.right, self.doc, flags = (np.concatenate([np.frombuffer(r[k], t) for r in rows] or [np.zeros(0, t)]) for k, t in ((3, left), (4, right), (5, np.uint16), (6, np.uint8)))
        self.training = (flags & 1).astype(bool)
        sizes = [len(r[5]) // 2 for r in rows]
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.placed, learnt = len(self.left), self.training
        if hot:
            self.left, self.right, learnt = (np.concatenate([x, *(np.frombuffer(r[k], t) for r in hot)]) for x, k, t in ((self.left, 3, left), (self.right, 4, right), (learnt, 6, np.uint32)))
        if left == right == np.uint16:
            key = self.left.astype(np.uint32) << np.uint32(16) | self.right
        else:
            key = mixed(self.left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + mixed(self.right.astype(np.uint64))
        _, self.first, self.pair = np.unique(key, return_index=True, return_inverse=True)
        self.types = np.bincount(self.pair, learnt, len(self.first)).astype(np.int64)
        self.seen = self.types[self.pair] if len(self.pair) else np.zeros(0, np.int64)

    def partial(self, kind: str, score: np.ndarray, k: int, base: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple]:
        """Per group of texts: sums of scores, of pairs by small count, and of what rare words add to the base."""
        places, where = np.unique(self.row * 65536 + self.doc, return_inverse=True)
        n, seen = len(places), self.seen[: self.placed]
        sums = np.bincount(where, score[: self.placed], n)
        small = np.stack([np.bincount(where, seen == r, n) for r in range(1, k + 1)], axis=1).astype(np.uint16) if k else np.zeros((n, 0), np.uint16)
        extra = (np.bincount(where, base, n), np.bincount(where, known, n).astype(np.uint32)) if base is not None else ()
        edge = np.searchsorted(places, np.arange(len(self.blocks) + 1) * 65536)
        return [
            (0, kind, block, *_bytes((places[a:b] % 65536).astype(np.uint16), sums[a:b].astype(np.float32), small[a:b], *(x[a:b] for x in extra)))
            for block, a, b in zip(self.blocks, edge[:-1], edge[1:], strict=True)
            if b > a
        ]


def history_sums(history: np.ndarray, types: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Per history (numbered from 0), over its seen pairs: counts above k, pairs by count up to k, lower-order mass."""
    use = types > 0
    history, types, p = history[use], types[use], p[use]
    n = int(history.max()) + 1 if len(history) else 0
    return np.bincount(history, types * (types > k), n), np.stack([np.bincount(history, types == r, n) for r in range(1, k + 1)], axis=1), np.bincount(history, p, n)


def counted(rows: DataFrame, known, parts: int) -> DataFrame:
    """First visit of the table partitions: every pair's count, and what follows without histories' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Words = known.value
        k = own.k
        waiting: dict[str, list[tuple]] = {}
        current = None

        def closed() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            histories = []
            once = np.zeros(k + 1, np.int64)
            rare = {kind: Pairs(waiting.get(kind, []), t, np.uint64) for kind, t in (("fr", np.uint16), ("rr", np.uint64))}
            # counts of rare words are complete here: every occurrence ends one pair
            word, at = np.unique(np.concatenate([rare["fr"].right, rare["rr"].right]), return_inverse=True)
            count = np.bincount(at, np.concatenate([rare["fr"].training, rare["rr"].training]), len(word)).astype(np.int64)
            c_of = {"fr": count[at[: len(rare["fr"].right)]], "rr": count[at[len(rare["fr"].right) :]]}
            hot = waiting.get("hot", [])
            ff = Pairs(waiting.get("ff", []), np.uint16, np.uint16, hot)
            for kind, pairs, c in (("ff", ff, own.counts[ff.right] if len(ff.right) else np.zeros(0, np.int64)), ("fr", rare["fr"], c_of["fr"])):
                once += np.bincount(pairs.types[(pairs.types > 0) & (pairs.types <= k + 1)], minlength=k + 2)[1:]
                if not len(pairs.right):
                    continue
                p = own.probability(c)
                score = np.where(pairs.seen > 0, np.log10(np.maximum(pairs.seen, 1) / (own.history[pairs.left] + RESERVED)), np.log10(p))
                out += pairs.partial("sum", score, k, *((own.base(c), c > 0) if kind == "fr" else ()))
                histories.append(history_sums(pairs.left[pairs.first].astype(np.int64), pairs.types, p[pairs.first], k))
                if kind == "ff":  # what groups asked for: count up to k + 1 (0: alpha is lacking) and the rest of the score
                    a = pairs.placed
                    for r in hot:
                        b = a + len(r[3]) // 2
                        out.append((0, "told", r[2], *_bytes(np.frombuffer(r[5], np.uint16), np.minimum(pairs.seen[a:b], k + 1).astype(np.uint16), score[a:b])))
                        a = b
                new = np.flatnonzero(pairs.seen[: pairs.placed] == 0)  # held-out texts' pairs: they still lack alpha
                edge = np.searchsorted(pairs.row[new], np.arange(len(pairs.blocks) + 1))
                out += [(0, "back", block, *_bytes(pairs.doc[new[a:b]], pairs.left[new[a:b]])) for block, a, b in zip(pairs.blocks, edge[:-1], edge[1:], strict=True) if b > a]
            rr, c = rare["rr"], c_of["rr"]
            once += np.bincount(rr.types[(rr.types > 0) & (rr.types <= k + 1)], minlength=k + 2)[1:]
            if len(rr.right):
                out += rr.partial("sum", np.zeros(len(c)), 0, own.base(c), c > 0)
                p = own.probability(c)
                part = (mixed(rr.left) % np.uint64(parts)).astype(np.int64)
                opens = np.zeros(len(rr.left), bool)
                opens[rr.first] = True  # the pair's type counts once
                blocks = np.array(rr.blocks)[rr.row]
                events = np.empty(len(part), _RARE)
                events["doc"], events["seen"] = rr.doc, rr.seen
                events["flags"] = rr.training.astype(np.uint8) | (opens.astype(np.uint8) << 1)
                order = np.argsort(part, kind="stable")
                edge = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    o = order[a:b]
                    out.append((int(part[o[0]]), "rr", 0, *_bytes(rr.left[o], p[o], blocks[o], events[o])))
            if waiting.get("rf"):
                rf = Pairs(waiting["rf"], np.uint64, np.uint16)
                once += np.bincount(rf.types[(rf.types > 0) & (rf.types <= k + 1)], minlength=k + 2)[1:]
                out += [(current, *r[1:]) for r in waiting["rf"]]
            for big, small, mass in histories:
                at = np.flatnonzero(big + small.sum(axis=1) > 0)
                out.append((0, "history", 0, *_bytes(at.astype(np.int64), big[at], small[at].astype(np.int64), mass[at])))
            out.append((0, "seen", 0, *_bytes(once)))
            out += waiting.get("text", []) + waiting.get("places", [])
            for a in range(0, len(out), 32):
                yield _batch(out[a : a + 32])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != current and current is not None:
                    yield from closed()
                    waiting.clear()
                current = row[0]
                waiting.setdefault(row[1], []).append(row)
        if waiting:
            yield from closed()

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, _ROWS)


def summed_histories(rows: DataFrame, k: int) -> DataFrame:
    """history, big, small counts and mass, one row per frequent history of a partition."""
    schema = "history long, big double, mass double, " + ", ".join(f"s{r} long" for r in range(1, k + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for a, b, c, d in zip(*(batch.column(j).to_pylist() for j in range(3, 7)), strict=True):
                small = np.frombuffer(c, np.int64).reshape(-1, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.float64)), pa.array(np.frombuffer(d, np.float64)), *(pa.array(np.ascontiguousarray(small[:, j])) for j in range(k))], names)

    return rows.filter("kind = 'history'").mapInArrow(run, schema).groupBy("history").agg(*(F.sum(c).alias(c) for c in ["big", "mass", *(f"s{r}" for r in range(1, k + 1))]))


def alpha_of(count: np.ndarray, big: np.ndarray, small: np.ndarray, mass: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Backoff weights: what the seen pairs leave, over what their words leave in the lower order."""
    r = np.arange(1, len(d))
    taken = (big + small @ (d[1:] * r)) / (count + RESERVED)
    return np.where(count > 0, (1 - taken) / np.maximum(1 - mass, 1e-300), 1.0)


def rare_histories(rows: DataFrame, known, d: np.ndarray) -> DataFrame:
    """Second visit, for pairs with a rare history: all pairs of a history are in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Words = known.value
        k = own.k
        waiting: dict[str, list[tuple]] = {"rf": [], "rr": []}
        current = None

        def closed() -> pa.RecordBatch:
            rf = Pairs(waiting["rf"], np.uint64, np.uint16)
            rr = waiting["rr"]
            load = lambda j, t: np.concatenate([np.frombuffer(r[j], t) for r in rr] or [np.zeros(0, t)])
            left, p_rr, block_rr, events = load(3, np.uint64), load(4, np.float64), load(5, np.int64), load(6, _RARE)
            seen_rr, flags = events["seen"].astype(np.int64), events["flags"]
            p_rf = own.probability(own.counts[rf.right]) if len(rf.right) else np.zeros(0)
            opens = np.zeros(len(rf.left), bool)
            opens[rf.first] = True
            history, at = np.unique(np.concatenate([rf.left, left]), return_inverse=True)
            p, seen = np.concatenate([p_rf, p_rr]), np.concatenate([rf.seen, seen_rr])
            first = np.concatenate([opens, flags & 2 > 0])
            count = np.bincount(at, np.concatenate([rf.training, flags & 1 > 0]), len(history))
            sums = [np.zeros((len(history), *x.shape[1:])) for x in history_sums(at[first], seen[first], p[first], k)]
            for total, x in zip(sums, history_sums(at[first], seen[first], p[first], k), strict=True):
                total[: len(x)] += x
            alpha = alpha_of(count, *sums, d)
            factor = d[np.where(seen <= k, seen, 0)]
            score = np.log10(np.where(seen > 0, factor * seen / (count[at] + RESERVED), alpha[at] * p))
            block_rf = np.array(rf.blocks, np.int64)[rf.row] if len(rf.row) else np.zeros(0, np.int64)
            blocks, where = np.unique(np.concatenate([block_rf, block_rr]), return_inverse=True)
            out = []
            places, to = np.unique(where * 65536 + np.concatenate([rf.doc, events["doc"]]), return_inverse=True)
            total = np.bincount(to, score, len(places)).astype(np.float32)
            edge = np.searchsorted(places, np.arange(len(blocks) + 1) * 65536)
            for block, a, b in zip(blocks.tolist(), edge[:-1], edge[1:], strict=True):
                if b > a:
                    out.append((0, "sum", block, *_bytes((places[a:b] % 65536).astype(np.uint16), total[a:b])))
            return _batch(out)

        for batch in batches:
            for record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if record[0] != current and current is not None:
                    yield closed()
                    waiting = {"rf": [], "rr": []}
                current = record[0]
                waiting[record[1]].append(record)
        if current is not None:
            yield closed()

    return rows.filter("kind in ('rf', 'rr')").repartition("part").sortWithinPartitions("part").mapInArrow(run, _ROWS)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def gathered(rows: DataFrame, known, d: np.ndarray, alpha: np.ndarray) -> DataFrame:
    """Per text, the sum of what the partitions sent to its group."""
    shared = rows.sparkSession.sparkContext.broadcast((np.log10(d[1:]), np.log10(alpha)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Words = known.value
        log_d, log_alpha = shared.value
        current, text, places = None, None, None
        log_count = np.concatenate([[0.0], log_d, [0.0]])
        names = [x.split()[0] for x in SCORES.split(", ")]

        def closed() -> pa.RecordBatch:
            ids, flags, tokens, n_known, base, score = text
            if places:
                _, number, doc, times, value = places
                score += np.bincount(doc, value[number] * times, len(score))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=flags & 2 > 0), pa.array(flags & 1 == 0), pa.array(tokens), pa.array(n_known), pa.array(np.full(len(ids), own.total)), pa.array(base), pa.array(score)], names
            )

        for batch in batches:
            for _, kind, block, _, a, b, c, e, f in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if block != current and current is not None:
                    yield closed()
                    places = None
                current = block
                if kind == "places":
                    left = np.frombuffer(a, np.uint16)
                    places = (left, np.frombuffer(b, np.uint16), np.frombuffer(c, np.uint16), np.frombuffer(e, np.uint32), np.zeros(len(left)))
                elif kind == "told":
                    at, few = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
                    places[4][at] = np.frombuffer(c, np.float64) + log_count[few] + np.where(few == 0, log_alpha[places[0][at]], 0.0)
                elif kind == "text":
                    ids, flags = np.frombuffer(a, np.int64), np.frombuffer(b, np.uint8)
                    text = [ids, flags, np.frombuffer(c, np.int64), np.frombuffer(e, np.int64).copy(), np.frombuffer(f, np.float64).copy(), np.zeros(len(ids))]
                elif kind == "back":
                    np.add.at(text[5], np.frombuffer(a, np.uint16), log_alpha[np.frombuffer(b, np.uint16)])
                else:
                    at = np.frombuffer(a, np.uint16)
                    text[5][at] += np.frombuffer(b, np.float32)
                    if c:
                        text[5][at] += np.frombuffer(c, np.uint16).reshape(len(at), -1) @ log_d
                    if e:
                        text[4][at] += np.frombuffer(e, np.float64)
                        text[3][at] += np.frombuffer(f, np.uint32)
        if current is not None:
            yield closed()

    ordered = rows.withColumn("late", F.when(F.col("kind") == "text", 0).when(F.col("kind") == "places", 1).otherwise(2)).repartition("block").sortWithinPartitions("block", "late")
    return ordered.select("part", "kind", "block", "late", "a", "b", "c", "d", "e").mapInArrow(run, SCORES)


def scored(docs: DataFrame, k: int = K, frequent: int = FREQUENT, part_tokens: int = PART_TOKENS, group_tokens: int = GROUP_TOKENS, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns from the rows that aren't held out.

    Words are lower-cased (A-Z) runs without white space, and an end closes each text; null text is
    empty.  Null ids are held out; repeated rows are texts of their own.  Other columns are
    ignored.  Without training texts every token is the unknown word with probability one.
    Texts are told apart by their place in a partition, so docs must be read from files or stored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("training", is_training("doc_id"))
    counts = stored(word_counts(rows), "words")
    texts = rows.filter("training").count()
    words_ = known_words(counts, texts, frequent, k)
    parts = max(8, -(-words_.tokens // part_tokens))
    known = spark.sparkContext.broadcast(words_)
    first = stored(counted(dealt(rows, known, parts, group_tokens, share), known, parts), "pairs")
    once = np.zeros(k + 1, np.int64)
    for r in first.filter("kind = 'seen'").select("a").toLocalIterator():
        once += np.frombuffer(r.a, np.int64)
    d = discounts(once, k)
    table = summed_histories(first, k).toArrow()  # at most one row per frequent word
    at = table["history"].to_numpy()
    alpha = np.ones(1 << 16)
    small = np.stack([table[f"s{r}"].to_numpy() for r in range(1, k + 1)], axis=1)
    alpha[at] = alpha_of(words_.history[at], table["big"].to_numpy(), small, table["mass"].to_numpy(), d)
    sums = first.filter("kind in ('text', 'places', 'told', 'sum', 'back')").unionByName(rare_histories(first, known, d))
    return gathered(sums, known, d, alpha)
