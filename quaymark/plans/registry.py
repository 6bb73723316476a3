"""Registry of named queries: a Spark plan, and SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.functions.numeric import rounded
from quaymark.plans import ctes
from quaymark.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    body: str | None
    doubles: tuple[str, ...]
    ints: tuple[str, ...]
    digits: int

    @property
    def sql(self) -> str | None:
        """The oracle text: the body with its CTEs, rounded like the Spark side."""
        if self.body is None:
            return None
        edits = [f"round({c} + {nudge(self.digits)!r}::DOUBLE, {self.digits}) + 0.0 AS {c}" for c in self.doubles]
        edits += [f"CAST({c} AS BIGINT) AS {c}" for c in self.ints]
        replace = f" REPLACE ({', '.join(edits)})" if edits else ""
        return f"SELECT *{replace} FROM (\n{ctes.compose(self.body)}\n) result"

    def run(self, spark, root: str) -> DataFrame:
        return present(self.build(Tables(spark, root)), self.digits)


QUERIES: dict[str, Query] = {}


def nudge(digits: int) -> float:
    """Added before rounding, so that exact decimal halves do not hang on the
    order in which an engine summed them."""
    return float(f"0.00137e-{digits}")


def present(df: DataFrame, digits: int) -> DataFrame:
    """Comparable output: zone-free timestamps, 64-bit integers, rounded doubles."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DoubleType):
            c = rounded(c + F.lit(nudge(digits)), digits) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, covers: str, sql: str | None = None, doubles: str = "", ints: str = "", digits: int = 4):
    """Register a query.

    `sql` may use the shared CTE names of `ctes`; the ones it mentions are put in
    front.  `doubles` and `ints` name the result columns to round and to widen.
    """

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, covers, build, sql, tuple(doubles.split()), tuple(ints.split()), digits)
        return build

    return register
