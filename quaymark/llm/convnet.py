"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes.  Chunks of 16 bytes begin every 4 bytes and cover the whole document; a
byte is a learned vector, and one more input tells whether the 8 bytes at a place repeat those
of 2 to 32 bytes before.  Learned filters with a rectifier look at every chunk, the greatest
answer of each filter over all chunks is kept, and a logistic combination is the probability.
Only that greatest chunk gets a gradient, so learning costs little more than scoring.

Learning takes a bounded, documented sample of the labelled rows (by a hash of the id, classes in
their own proportion); scoring reads every whole text, in tasks that hold one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.text import runs_of, small_batches, utf8

CHUNK, STRIDE = 16, 4
#: At most so many labelled rows are learnt from.
SAMPLE = 4000
THRESHOLD = 0.3
_LAGS = range(2, 33)


@dataclass
class Net:
    """bytes: 257 x d (256: padding), filters: chunk x (d + 1) x f, then the combination; prior for no filters."""

    bytes: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with room between them: symbols (256: padding), repeats, and the first chunk of each text."""
    sizes = np.diff(offsets)
    room = (sizes + STRIDE - 1) // STRIDE * STRIDE + CHUNK
    first = np.cumsum(room) - room
    symbols = np.full(int(room.sum()) + 64, 256, np.int16)
    row, k = runs_of(sizes)
    symbols[first[row] + k] = data
    raw = symbols.astype(np.uint8)
    raw[symbols == 256] = 0
    eight = np.zeros(len(raw) - 7, np.uint64)
    for j in range(8):
        eight |= raw[j : len(raw) - 7 + j].astype(np.uint64) << np.uint64(8 * j)
    repeats = np.zeros(len(symbols), np.float32)
    again = repeats[: len(eight)]
    for lag in _LAGS:
        again[lag:][(eight[lag:] == eight[:-lag]) & (eight[lag:] != 0)] = 1
    # texts of padding and single bytes aside, a gap never looks like a repeat
    return symbols, repeats, first


def inputs(net: Net, symbols: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    n = len(symbols) // STRIDE * STRIDE
    x = np.empty((n, net.bytes.shape[1] + 1), np.float32)
    x[:, :-1] = net.bytes[symbols[:n]]
    x[:, -1] = repeats[:n]
    return x.reshape(n // STRIDE, -1)


def answers(net: Net, x: np.ndarray) -> np.ndarray:
    """Every filter at every chunk."""
    taps = CHUNK // STRIDE
    rows = len(x) - taps + 1
    size = x.shape[1]
    kernel = net.filters.reshape(taps, size, -1)
    out = x[:rows] @ kernel[0]
    for j in range(1, taps):
        out += x[j : j + rows] @ kernel[j]
    return np.maximum(out + net.bias, 0)


def pooled(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The greatest answer of each filter over all chunks of each text (empty: one chunk of padding)."""
    symbols, repeats, first = layout(data, offsets)
    own = answers(net, inputs(net, symbols, repeats))
    begin = first // STRIDE
    chunks = np.maximum((np.diff(offsets) + STRIDE - 1) // STRIDE, 1)
    # ranges and the gaps between them alternate
    edges = np.column_stack([begin, begin + chunks]).ravel()
    return np.maximum.reduceat(own, np.minimum(edges, len(own) - 1), axis=0)[::2] if len(begin) else np.zeros((0, own.shape[1]))


def scores(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    z = pooled(net, data, offsets).astype(np.float64) @ net.weights + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(texts: list[bytes], labels: np.ndarray, filters: int = 16, width: int = 8, steps: int = 400, batch: int = 48, rate: float = 4e-3, seed: int = 5) -> Net:
    """Learn from texts with labels 0 and 1; without both, the smoothed share of 1 is every score."""
    random = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    net = Net(
        random.normal(0, 0.5, (257, width)).astype(np.float32),
        random.normal(0, 1 / np.sqrt(CHUNK * width), (CHUNK, width + 1, filters)).astype(np.float32),
        np.zeros(filters, np.float32),
        np.zeros(filters),
        float(np.log(share / (1 - share))),
    )
    net.bytes[256] = 0
    if len(set(labels.tolist())) < 2:
        return net
    net.weights = random.normal(0, 0.3, filters)
    names = ("bytes", "filters", "bias", "weights", "offset")
    first_moment = {n: np.zeros_like(np.asarray(getattr(net, n), np.float64)) for n in names}
    second_moment = {n: np.zeros_like(m) for n, m in first_moment.items()}
    order = np.concatenate([random.permutation(len(texts)) for _ in range(-(-steps * batch // len(texts)))])
    for step in range(1, steps + 1):
        pick = order[(step - 1) * batch : step * batch]
        offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
        data = np.frombuffer(b"".join(texts[i] for i in pick), np.uint8)
        symbols, repeats, first = layout(data, offsets)
        own = answers(net, inputs(net, symbols, repeats))
        begin, chunks = first // STRIDE, np.maximum((np.diff(offsets) + STRIDE - 1) // STRIDE, 1)
        best = np.stack([b + own[b : b + c].argmax(axis=0) for b, c in zip(begin, chunks, strict=True)])
        top = own[best, np.arange(filters)].astype(np.float64)
        z = np.clip(top @ net.weights + net.offset, -30, 30)
        error = (1 / (1 + np.exp(-z)) - labels[pick]) / len(pick)
        back = error[:, None] * net.weights * (top > 0)
        window = best[:, :, None] * STRIDE + np.arange(CHUNK)
        seen, again = net.bytes[symbols[window]], repeats[window]
        grad = {
            "weights": top.T @ error + 1e-5 * net.weights,
            "offset": error.sum(),
            "bias": back.sum(axis=0),
            "filters": np.concatenate([np.einsum("df,dfcw->cwf", back, seen), np.einsum("df,dfc->cf", back, again)[:, None]], axis=1),
        }
        grad["bytes"] = np.zeros(net.bytes.shape)
        np.add.at(grad["bytes"], symbols[window].ravel(), np.einsum("df,cwf->dfcw", back, net.filters[:, :-1]).reshape(-1, width))
        grad["bytes"][256] = 0
        pace = rate * (1 - 0.9 * step / steps)
        for n in names:
            first_moment[n] = 0.9 * first_moment[n] + 0.1 * grad[n]
            second_moment[n] = 0.99 * second_moment[n] + 0.01 * grad[n] ** 2
            change = pace * (first_moment[n] / (1 - 0.9**step)) / (np.sqrt(second_moment[n] / (1 - 0.99**step)) + 1e-8)
            value = getattr(net, n)
            setattr(net, n, float(value - change) if n == "offset" else (value - change).astype(value.dtype))
    return net


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    """Rows that are never learnt from: checksum of the id as text divisible by `folds`."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds == 0, F.lit(True))


def learnt(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Net:
    """Fit on at most `sample` labelled rows outside the held-out fold.

    Only ids and labels take part in the choice; the chosen ids, a bounded number, pick their texts.
    Null labels, null ids and labels other than 0 and 1 aren't learnt from.
    """
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).filter("i is not null and y in (0, 1)").filter(~held_out("i"))
    chosen = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "i").orderBy("i", "text").limit(sample).toArrow()
    data, offsets = utf8(rows["text"])
    raw = data.tobytes()
    return fitted([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], rows["y"].to_numpy().astype(np.float64))


def scored(docs: DataFrame, net: Net, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs (a column of the score's name is replaced) with the probability of label 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.drop(score_col)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = scores(shared.value, *utf8(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, score_col])

    return rows.mapInArrow(run, rows.withColumn(score_col, F.lit(0.0)).schema)


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """held_out, score and predicted beside the columns of docs.

    Null text is empty; empty texts get a score too; null ids count as held out and repeated rows
    are scored each.  Without labels, or with one kind, the score is the smoothed share of 1.
    """
    net = learnt(docs, labels, sample, id_col, text_col, label_col)
    return scored(docs, net, text_col).withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
