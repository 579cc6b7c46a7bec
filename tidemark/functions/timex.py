"""Instants as microseconds since 1970, UTC."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset in seconds to 1970 and units a second.
EPOCHS = {
    "unix_s": (0, 1),
    "unix_ms": (0, 1_000),
    "unix_us": (0, 1_000_000),
    "unix_ns": (0, 1_000_000_000),
    "apple_s": (978_307_200, 1),
    "apple_ns": (978_307_200, 1_000_000_000),
    "webkit_us": (-11_644_473_600, 1_000_000),
    "filetime": (-11_644_473_600, 10_000_000),
}
#: Seconds between which an instant is plausible.
FIRST, LAST = 789_004_800, 3_000_000_000
DAY_US = 86_400_000_000


def from_epoch(value: Column, epoch: str) -> Column:
    """Microseconds, or null for zero, null and implausible instants."""
    if epoch == "julian":
        us = F.bround((value.cast("double") - 2440587.5) * DAY_US).cast("long")
    else:
        offset, units = EPOCHS[epoch]
        us = F.bround(value.cast("decimal(38,6)") / units * 1_000_000).cast("long") + F.lit(offset * 1_000_000)
    good = (value != 0) & us.between(F.lit(FIRST * 1_000_000), F.lit(LAST * 1_000_000))
    return F.when(good, us)


def guess(value: Column, column_name: str = "") -> Column:
    """First epoch by which the number is plausible; the column's name says which ones to try first."""
    name = column_name.lower()
    order = ["unix_s", "unix_ms", "unix_us", "unix_ns", "apple_s", "webkit_us", "filetime", "apple_ns"]
    if re.search("webkit|chrome|visit", name):
        order = ["webkit_us", *order]
    elif name.startswith("z") or re.search("apple|mac", name):
        order = ["apple_s", "apple_ns", *order]
    julian = F.when(value.between(2_400_000, 2_500_000), from_epoch(value, "julian"))
    return F.coalesce(julian, *(from_epoch(value, e) for e in dict.fromkeys(order)))


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without a zone, the latter read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def at(us: Column) -> Column:
    return F.timestamp_micros(us)


def shifted(us: Column, offset_minutes: int = 0) -> Column:
    """Timestamp in a fixed zone."""
    return at(us + F.lit(offset_minutes * 60_000_000))


def day_of(us: Column, offset_minutes: int = 0) -> Column:
    return F.date_format(shifted(us, offset_minutes), "yyyy-MM-dd")


def iso(us: Column, offset_minutes: int = 0) -> Column:
    """ISO text to the second in a fixed zone, with its offset; null stays null."""
    sign, minutes = ("-" if offset_minutes < 0 else "+"), abs(offset_minutes)
    zone = f"{sign}{minutes // 60:02d}:{minutes % 60:02d}"
    return F.concat(F.date_format(shifted(us, offset_minutes), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))


def bound(text: str, end: bool = False) -> int:
    """Microseconds of a date or date and time; as an end, a bare date is its last microsecond."""
    when = datetime.fromisoformat(text)
    when = when if when.tzinfo else when.replace(tzinfo=UTC)
    if end and re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        when += timedelta(days=1) - timedelta(microseconds=1)
    return int((when - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def span(text: str, now_us: int) -> tuple[int | None, int | None]:
    """Bounds of all, 24h, 7d, 30d, 1y and the like, or first..last."""
    if text == "all":
        return None, None
    if ".." in text:
        a, b = text.split("..")
        return bound(a) if a else None, bound(b, end=True) if b else None
    m = re.fullmatch(r"(\d+)([hdy])", text)
    if not m:
        raise ValueError(f"unknown span {text!r}")
    hours = int(m[1]) * {"h": 1, "d": 24, "y": 365 * 24}[m[2]]
    return now_us - hours * 3_600_000_000, now_us
