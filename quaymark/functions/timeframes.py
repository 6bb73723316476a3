"""Candle bucket labels.

Hour frames divide the day, so they are anchored at midnight.  Multi-day frames
are anchored at the first day of the data.  Weeks run Monday to Sunday and carry
the Sunday as their label.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FRAME = re.compile(r"^(\d+)([hdw])$")


def parse(timeframe: str) -> tuple[int, str]:
    found = _FRAME.match(timeframe.lower())
    if not found:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    count, unit = int(found.group(1)), found.group(2)
    if unit == "h" and 24 % count:
        raise ValueError("hour frames must divide the day")
    if unit == "w" and count != 1:
        raise ValueError("only one-week frames are supported")
    return count, unit


HOUR, DAY = 3600, 86_400
# Fixed value: the first Monday of the epoch, 1970-01-05.
FIRST_MONDAY = 4 * DAY


def label(ts: Column, timeframe: str, origin: Column | None = None) -> Column:
    """Label of the candle that holds `ts`, in whole-second UTC arithmetic."""
    count, unit = parse(timeframe)
    seconds = F.unix_seconds(ts)
    if unit == "w":
        return F.timestamp_seconds(seconds - F.pmod(seconds - FIRST_MONDAY, F.lit(7 * DAY)) + 6 * DAY)
    step = count * (HOUR if unit == "h" else DAY)
    if unit == "h" or count == 1:
        return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(step)))
    if origin is None:
        raise ValueError("multi-day frames need the first timestamp as origin")
    first = F.unix_seconds(origin)
    start = first - F.pmod(first, F.lit(DAY))
    return F.timestamp_seconds(seconds - F.pmod(seconds - start, F.lit(step)))


def needs_origin(timeframe: str) -> bool:
    count, unit = parse(timeframe)
    return unit == "d" and count > 1
