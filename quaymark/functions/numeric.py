"""Column helpers: guarded division, clipping, signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(v: Column | float | int) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def ratio(n: Column, d: Column, otherwise: float | Column | None = None) -> Column:
    """n / d, or `otherwise` when d is zero (ANSI mode raises on a zero divisor)."""
    fallback = F.lit(None).cast("double") if otherwise is None else num(otherwise)
    return F.when(d != 0, n / d).otherwise(F.when(d == 0, fallback))


def clip(c: Column, lo: Column | float | None = None, hi: Column | float | None = None) -> Column:
    """Clip that keeps nulls null (greatest/least alone would drop them)."""
    out = c
    if lo is not None:
        out = F.greatest(out, num(lo))
    if hi is not None:
        out = F.least(out, num(hi))
    return F.when(c.isNotNull(), out)


def rounded(c: Column, digits: int) -> Column:
    """Round half away from zero as SQL engines on binary doubles do: scaled, rounded to a whole number, scaled back.

    Spark's `round` takes the decimal text instead, which differs in last bits: never for small
    values, for one in nine from 1e12 at four digits.
    """
    scaled = c * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < F.lit(INF), F.round(scaled) / F.lit(10.0**digits)).otherwise(c)


def significant(c: Column, digits: int) -> Column:
    """Round to so many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(c))))
    return F.when(c != 0, F.round(c * scale) / scale).otherwise(c)


def sign(c: Column) -> Column:
    return F.when(c > 0, 1).when(c < 0, -1).otherwise(0)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def bool_share(c: Column) -> Column:
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))
