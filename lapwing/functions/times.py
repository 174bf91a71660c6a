"""Column functions for epochs, offsets and times of day.  Local times are zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a zone-free timestamp, whatever the session's zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1000).cast("long")


def offset_minutes(zone: Column, default: int | None = None) -> Column:
    """Signed minutes of '+HH:MM' or '-HH:MM'; anything else is null, or ``default``."""
    pattern = r"^\s*([+-])(\d{1,2}):?(\d{2})\s*$"
    part = lambda i: F.regexp_extract(zone, pattern, i)
    minutes = F.when(zone.rlike(pattern), (part(2).try_cast("int") * 60 + part(3).try_cast("int")) * F.when(part(1) == "-", -1).otherwise(1))
    return minutes if default is None else F.coalesce(minutes, F.lit(default))


def local_ms(ms: Column, zone: Column, default: int | None = None) -> Column:
    """Epoch milliseconds shifted to local time."""
    return ms + offset_minutes(zone, default).cast("long") * 60_000


def hour_of(ms: Column) -> Column:
    """Number of the hour since 1970 that holds the millisecond."""
    return F.floor(ms / HOUR_MS).cast("long")


def day_of(ms: Column) -> Column:
    return F.floor(ms / DAY_MS).cast("long")


def clock_hour(ms: Column) -> Column:
    """Hour of the day, 0 to 23."""
    return F.pmod(F.floor(ms / HOUR_MS), F.lit(24)).cast("int")


def time_of_day(hour: Column) -> Column:
    """morning from 5, afternoon from 12, evening from 18, night from 0 o'clock."""
    return F.when(hour < 5, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def prompt_slot(hour: Column) -> Column:
    """Slot of a prompt; its bounds differ from the time of day's."""
    return F.when(hour < 12, "morning").when(hour < 17, "afternoon").otherwise("evening")


def is_night(hour: Column) -> Column:
    return (hour >= 22) | (hour < 6)


def from_ms(ms: Column) -> Column:
    """Zone-free timestamp of epoch milliseconds."""
    return F.timestamp_add("MILLISECOND", ms.cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
