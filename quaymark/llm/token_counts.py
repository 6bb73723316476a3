"""Token counts by offset-mapped attribution.

The chosen fields of a row are joined into one document, encoded once as a whole.  Every token
has a character span; the fields, and the sections (lines) inside the sectioned field, are
spans too.  Tokens and sections ascend, so each is joined to the other by binary search, and
a token that crosses a border goes where an explicit rule says:

- `first`: to the section that holds its first character,
- `most`: to the section that holds most of its characters, the earlier on a tie,
- `split`: in parts, by characters (counts are then fractions that add up to the total).

Separators between fields belong to the section before them; every token is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm import tokens
from quaymark.llm.text import runs_of, small_batches, utf8

RULES = ("first", "most", "split")
COUNTS = "doc_id long, section int, field string, first_char long, n_chars long, n_tokens double, n_crossing long, doc_tokens long"


def allocate(begin: np.ndarray, end: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval join of token spans with sections: (token, section, share) of every allocation.

    borders ascend, the first at 0 and the last at the end of the text.
    """
    first = np.searchsorted(borders, begin, side="right") - 1
    last = np.searchsorted(borders, np.maximum(end - 1, begin), side="right") - 1
    token, section = np.arange(len(begin)), first
    if rule == "first":
        return token, section, np.ones(len(token))
    row, k = runs_of(last - first + 1)
    at = first[row] + k
    share = np.minimum(end[row], borders[at + 1]) - np.maximum(begin[row], borders[at])
    if rule == "split":
        return row, at, share / np.maximum(end - begin, 1)[row]
    order = np.lexsort((at, -share, row))
    pick = order[np.concatenate([[True], np.diff(row[order]) > 0])] if len(order) else order
    return row[pick], at[pick], np.ones(len(pick))


def count_tokens(
    docs: DataFrame,
    fields: tuple[str, ...] = ("source", "lang", "text"),
    sectioned: str | None = "text",
    separator: str = "\n",
    rule: str = "most",
    vocabulary: str = tokens.VOCABULARY,
    id_col: str = "doc_id",
) -> DataFrame:
    """Tokens per field, or per line of the sectioned field, of every row.

    section numbers the parts of a document from 0; a field without characters, null or empty,
    still has its row, with the separator's tokens.  Null or repeated ids are carried as they
    are; columns not named are ignored; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    small_batches(docs.sparkSession)
    names = [part.split()[0] for part in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.pieces(vocabulary, True)
        for rows in batches:
            if not rows.num_rows:
                continue
            columns = [rows.column(k + 1).fill_null("").to_pylist() for k in range(len(fields))]
            texts = [separator.join(values) for values in zip(*columns, strict=True)]
            codes, counts, piece_first = coder.codes(*utf8(pa.array(texts, pa.large_string())))
            doc_chars = np.array([len(t) for t in texts])
            doc_first = np.cumsum(doc_chars) - doc_chars
            row, within = runs_of(coder.count[codes])
            flat = coder.start[codes][row] + within
            begin, end = piece_first[row] + coder.flat_at[flat], piece_first[row] + coder.flat_to[flat]
            owner = np.repeat(np.arange(len(texts)), counts)[row]
            marks, label, doc_of = [], [], []
            for d, values in enumerate(zip(*columns, strict=True)):
                at = int(doc_first[d])
                for f, value in zip(fields, values, strict=True):
                    lines = value.split("\n") if f == sectioned else [value]
                    for k, line in enumerate(lines):
                        marks.append(at)
                        label.append(f)
                        doc_of.append(d)
                        at += len(line) + (1 if k < len(lines) - 1 else len(separator))
            marks, doc_of = np.array(marks, np.int64), np.array(doc_of)
            total = int(doc_chars.sum())
            borders = np.append(np.minimum(marks, total), total)
            # a last field without characters begins where its document ends; keep the border inside it
            borders[:-1] = np.minimum(borders[:-1], (doc_first + doc_chars)[doc_of])
            token, section, share = allocate(begin, end, borders, rule)
            n = len(marks)
            crossing = np.searchsorted(borders, begin, side="right") != np.searchsorted(borders, np.maximum(end - 1, begin), side="right")
            per_doc = np.bincount(owner, minlength=len(texts))
            doc_section = np.concatenate([[0], np.cumsum(np.bincount(doc_of, minlength=len(texts)))])[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(doc_of)),
                    pa.array((np.arange(n) - doc_section[doc_of]).astype(np.int32)),
                    pa.array(label, pa.string()),
                    pa.array(borders[:-1] - doc_first[doc_of]),
                    pa.array(np.diff(borders)),
                    pa.array(np.bincount(section, share, n)),
                    pa.array(np.bincount(section, crossing[token], n).astype(np.int64)),
                    pa.array(per_doc[doc_of]),
                ],
                names,
            )

    chosen = [F.col(id_col).cast("long").alias("doc_id"), *(F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields))]
    return docs.select(*chosen).mapInArrow(run, COUNTS)
