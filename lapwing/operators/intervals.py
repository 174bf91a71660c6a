"""Consecutive events, sessions, intervals and their split over hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import times as T


def consecutive_fixes(fixes: DataFrame, max_gap_s: float = 900.0) -> DataFrame:
    """``fixes`` with gap_s, distance_m and speed_kmh from the participant's previous fix; distance and speed
    only within ``max_gap_s``, speed not for a gap of nothing."""
    w = Window.partitionBy("pid").orderBy("ms", "lat", "lon", "fix_id")
    last = F.lag(F.struct("ms", "lat", "lon")).over(w)
    gap = (F.col("ms") - F.col("last.ms")) / 1000
    near = F.col("gap_s") <= max_gap_s
    distance = F.when(near, C.haversine_m(F.col("last.lat"), F.col("last.lon"), F.col("lat"), F.col("lon")))
    return (
        fixes.withColumn("last", last).withColumn("gap_s", gap).withColumn("distance_m", distance)
        .withColumn("speed_kmh", F.when(F.col("gap_s") > 0, F.col("distance_m") / F.col("gap_s") * 3.6)).drop("last")
    )


def drop_artefacts(pairs: DataFrame, max_kmh: float = 180.0) -> DataFrame:
    """Distance and speed become null where the speed is impossible."""
    fast = F.coalesce(F.col("speed_kmh") > max_kmh, F.lit(False))
    return pairs.withColumn("distance_m", F.when(~fast, F.col("distance_m"))).withColumn("speed_kmh", F.when(~fast, F.col("speed_kmh")))


def step_changes(rows: DataFrame, key: str, second: str, value: str, tie: str) -> DataFrame:
    """abs_diff: change from the row one second before, else 0."""
    w = Window.partitionBy(key).orderBy(second, tie)
    adjacent = F.col(second) - F.lag(second).over(w) == 1
    return rows.withColumn("abs_diff", F.when(adjacent, F.abs(F.col(value) - F.lag(value).over(w))).otherwise(0.0))


def to_intervals(events: DataFrame, key: str = "pid", label: str = "category", tail_ms: int = 60_000, max_gap_ms: int | None = None) -> DataFrame:
    """Each event lasts until the next one of its key, the last for ``tail_ms``; empty intervals go.
    ``max_gap_ms`` ends an interval sooner."""
    w = Window.partitionBy(key).orderBy("ms", label, "tie")
    end = F.coalesce(F.lead("ms").over(w), F.col("ms") + tail_ms)
    if max_gap_ms is not None:
        end = F.least(end, F.col("ms") + max_gap_ms)
    return events.select(key, label, F.col("ms").alias("start_ms"), end.alias("end_ms")).where("end_ms > start_ms")


def unlock_sessions(states: DataFrame, max_ms: int | None = 3 * T.HOUR_MS) -> DataFrame:
    """A session runs from the last unlock before a lock to that lock; the zone is the lock's.  Locks that no
    unlock precedes, and sessions of nothing or over ``max_ms``, go."""
    w = Window.partitionBy("pid").orderBy("ms", "tie")
    rows = states.where(F.col("state").isin("locked", "unlocked")).withColumn("last", F.lag(F.struct("state", "ms")).over(w))
    out = rows.where("state = 'locked' and last.state = 'unlocked'").select("pid", F.col("last.ms").alias("start_ms"), F.col("ms").alias("end_ms"), "zone")
    out = out.where("end_ms > start_ms")
    return out if max_ms is None else out.where(F.col("end_ms") - F.col("start_ms") <= max_ms)


def split_by_hour(intervals: DataFrame) -> DataFrame:
    """One row for each hour that an interval touches, with ``clipped_ms`` of it inside: linear in hours, no range join."""
    start, end = F.col("start_ms"), F.col("end_ms")
    hours = F.explode(F.sequence(T.hour_of(start), T.hour_of(F.greatest(end - 1, start))))
    rows = intervals.withColumn("hour", hours)
    inside = F.least(end, (F.col("hour") + 1) * T.HOUR_MS) - F.greatest(start, F.col("hour") * T.HOUR_MS)
    return rows.withColumn("clipped_ms", inside).where("clipped_ms > 0")


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_turn = 1").drop("_turn")


def hour_spine(rows: DataFrame, key: str = "pid", hour: str = "hour") -> DataFrame:
    """Every hour of each key from its first to its last."""
    bounds = rows.groupBy(key).agg(F.min(hour).alias("lo"), F.max(hour).alias("hi"))
    return bounds.select(key, F.explode(F.sequence("lo", "hi")).alias(hour))


def drop_ghosts(rows: DataFrame) -> DataFrame:
    """Of rows with one local hour, those whose local hour is their UTC hour give way to the others."""
    ghost = F.col("hour_local") == F.col("hour_utc")
    w = Window.partitionBy("pid", "hour_local")
    return rows.withColumn("_real", F.max(F.when(ghost, 0).otherwise(1)).over(w)).where(~(ghost & (F.col("_real") == 1))).drop("_real")


def evenly_spaced(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """n rows of each key at even distances of its order, first and last included."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_m", F.count("*").over(w))
    if n == 1:
        return numbered.where("_i = 0").drop("_i", "_m")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.floor(j * (F.col("_m") - 1) / (n - 1)).cast("long"))
    return numbered.where((F.col("_m") <= n) | F.array_contains(wanted, F.col("_i").cast("long"))).drop("_i", "_m")
