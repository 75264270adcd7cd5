"""Time buckets. All floor, also before 1970; weeks begin on Monday."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import Invalid

#: Milliseconds of the fixed grains.
FIXED = {"second": 1000, "minute": 60_000, "five_minute": 300_000, "ten_minute": 600_000, "fifteen_minute": 900_000, "thirty_minute": 1_800_000, "hour": 3_600_000, "six_hour": 21_600_000, "day": 86_400_000}
CALENDAR = ("week", "month", "quarter", "year")
PERIODS = {"PT1S": "second", "PT1M": "minute", "PT5M": "five_minute", "PT10M": "ten_minute", "PT15M": "fifteen_minute", "PT30M": "thirty_minute", "PT1H": "hour", "PT6H": "six_hour", "P1D": "day", "P1W": "week", "P1M": "month", "P3M": "quarter", "P1Y": "year"}


def named(spec) -> str | dict:
    if isinstance(spec, dict):
        kind = spec.get("type")
        if kind == "period":
            if spec.get("period") not in PERIODS:
                raise Invalid("granularity", f"unknown period {spec.get('period')}")
            return PERIODS[spec["period"]]
        if kind == "duration":
            return spec
        return named(kind)
    name = str(spec or "all").lower()
    if name not in FIXED and name not in CALENDAR and name not in ("all", "none"):
        raise Invalid("granularity", f"unknown granularity {spec}")
    return name


def millis(text) -> int:
    if isinstance(text, int | float):
        return int(text)
    if re.fullmatch(r"-?\d+", text) and len(text) > 4:
        return int(text)
    if re.fullmatch(r"\d{4}(-\d{2})?", text):
        text = (text + "-01-01")[:10]
    try:
        moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise Invalid("time", f"can't read {text!r}") from None
    return round((moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def floored(ms: Column, size: int, origin: int = 0) -> Column:
    return F.timestamp_millis(ms - F.pmod(ms - origin, F.lit(size)))


def bucket(time: Column, spec) -> Column | None:
    """The start of the time's bucket; None for `all`, the time itself for `none`."""
    grain = named(spec)
    if grain == "all":
        return None
    if grain == "none":
        return time
    if isinstance(grain, dict):
        size = int(grain.get("duration", grain.get("period_ms", 0)))
        if size <= 0:
            raise Invalid("granularity", "a duration must be positive")
        return floored(F.unix_millis(time), size, millis(grain.get("origin", 0)))
    if grain in FIXED:
        return floored(F.unix_millis(time), FIXED[grain])
    return F.date_trunc(grain, time)


def interval(text: str) -> tuple[int, int]:
    parts = text.split("/")
    if len(parts) != 2:
        raise Invalid("interval", f"{text!r} isn't start/end")
    return millis(parts[0]), millis(parts[1])


def within(time: Column, intervals: list[str] | str | None) -> Column | None:
    """A predicate on the bare time column, so that it is pushed to the scan; half-open, any of them."""
    if not intervals:
        return None
    out = None
    for text in [intervals] if isinstance(intervals, str) else intervals:
        low, high = interval(text)
        one = (time >= F.timestamp_millis(F.lit(low))) & (time < F.timestamp_millis(F.lit(high)))
        out = one if out is None else out | one
    return out
