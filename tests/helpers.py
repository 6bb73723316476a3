"""Small builders and row helpers for tests."""

from datetime import datetime, timedelta, timezone

START = datetime(2024, 1, 1, tzinfo=timezone.utc)

BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def hour(n: float, start: datetime = START) -> datetime:
    return start + timedelta(hours=n)


def bars(spark, closes: dict[str, list[float]], start: datetime = START, spread: float = 0.01):
    rows = [
        (s, hour(i, start), c, c * (1 + spread), c * (1 - spread), c, 1000.0)
        for s, values in closes.items()
        for i, c in enumerate(values)
    ]
    return spark.createDataFrame(rows, BARS)


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0].asDict()
