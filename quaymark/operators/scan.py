"""Running values along keys.

With `long=False` a plain window takes each key in one task, which is right where the rows per key
have a bound (bars per symbol, bars per run).  With `long=True` keys may be of any length, and one may own
a third of the table: the scan goes over a range partitioning (`ranged`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.operators.ranged import Affine, Extreme, Floored, Last, Stage, Sum, scanned

_LOCAL = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    long: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Add running `sum`/`min`/`max`/`last` columns in ascending `order` per key.

    `values` maps a new column to (kind, expression).  `exclusive` leaves the current row out.
    A running sum over nothing is 0.
    """
    keys, order = list(keys), list(order)
    if not long:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
        out = df
        for name, (kind, expr) in values.items():
            v = _LOCAL[kind](expr).over(w)
            out = out.withColumn(name, F.coalesce(v, F.lit(0.0)) if kind == "sum" else v)
        return out
    rows, scans, kinds = df, [], {}
    for i, (name, (kind, expr)) in enumerate(values.items()):
        value = f"__in{i}"
        rows = rows.withColumn(value, expr if kind == "last" else expr.cast("double"))
        if kind == "last":
            rows = rows.withColumn(f"__at{i}", F.col(value).isNotNull())
            scans.append(Last(f"__at{i}", (value,), (name,), exclusive))
        else:
            scans.append(Sum(value, name, exclusive) if kind == "sum" else Extreme(value, name, kind == "max", exclusive))
        kinds[name] = dict(rows.dtypes)[value]
    return scanned(rows, keys, order, [Stage(tuple(scans))], kinds).select(*df.columns, *values)


def floored(df: DataFrame, keys: Sequence[str], order: Sequence[str], flow: Column, out: str, prev: str = "__before", gross: str = "__moved") -> DataFrame:
    """Add the running level max(level + flow, 0) along each key, `prev`, the level before, and `gross`, the running sum of the flows' sizes."""
    rows = df.withColumn("__in", flow.cast("double")).withColumn("__size", F.abs("__in"))
    stage = Stage((Floored("__in", out, prev), Sum("__size", gross)))
    return scanned(rows, keys, order, [stage], {out: "double", prev: "double", gross: "double"}).select(*df.columns, out, prev, gross)


def affine(df: DataFrame, keys: Sequence[str], order: Sequence[str], a: Column, b: Column, out: str, prev: str = "__before") -> DataFrame:
    """Add y = a * y_prev + b along each key (y before the first row is 0), and y_prev."""
    rows = df.withColumns({"__a": a.cast("double"), "__b": b.cast("double")})
    return scanned(rows, keys, order, [Stage((Affine("__a", "__b", out, prev),))], {out: "double", prev: "double"}).select(*df.columns, out, prev)


def _starts(pdf: pd.DataFrame, keys: list[str], last: tuple | None) -> tuple[list[bool], tuple]:
    """Flag the first row of every key run in a sorted batch; also the final key.

    Missing values are one key.
    """
    flags = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        values, missing = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        flags[1:] |= (values[1:] != values[:-1]) & ~(missing[1:] & missing[:-1])
    key = lambda i: tuple(None if pd.isna(v := pdf[k].iloc[i]) else v for k in keys)
    flags[0] = last is None or key(0) != last
    return flags.tolist(), key(-1)


def sorted_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Co-locate and sort each key, ready for a streaming `mapInPandas` pass.

    The pass sees Arrow batches, so its memory does not grow with the key.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _extended(df: DataFrame, *fields: tuple[str, str | T.DataType]) -> T.StructType:
    schema = T.StructType(list(df.schema.fields))
    for name, kind in fields:
        schema = schema.add(name, kind)
    return schema
