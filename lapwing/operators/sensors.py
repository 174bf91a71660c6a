"""Features of nine sensors over any windows: a declared catalogue, compiled to aggregates of the columns at hand.

A feature names an aggregate and the columns it may come from, the first that is there counts; some have a rule for
tables without any of them.  A feature that nothing at hand gives is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C


def _number(name: str) -> Column:
    return C.number(F.col(name))


def total(c: Column) -> Column:
    """Sum; 0 where rows have only nulls."""
    return F.coalesce(F.sum(c), F.lit(0.0))


HOW: dict[str, Callable[[Column], Column]] = {"sum": total, "mean": F.avg, "max": F.max}


@dataclass(frozen=True)
class Feature:
    """``rule`` gives the aggregate from the columns at hand (or None); with ``first`` it goes before ``columns``."""

    name: str
    how: str
    columns: tuple[str, ...]
    rule: Callable[[frozenset[str]], Column | None] | None = None
    first: bool = False

    def aggregate(self, have: frozenset[str]) -> Column | None:
        column = next((c for c in self.columns if c in have), None)
        direct = None if column is None else F.coalesce(F.bool_or(_flag(column)), F.lit(False)) if self.how == "any" else HOW[self.how](_number(column))
        ruled = self.rule(have) if self.rule else None
        found = (ruled, direct) if self.first else (direct, ruled)
        return next((c for c in found if c is not None), None)


def _flag(name: str) -> Column:
    return F.coalesce(C.truth(F.col(name)), _number(name) != 0)


AXES = ("accel_x", "accel_y", "accel_z")
MEANS = ("accel_mean_magnitude", "mean_magnitude")


def _magnitude(have: frozenset[str]) -> Column | None:
    """Length of the raw axes at hand (a missing axis of a row is 0), or the magnitude given; none where hourly means are."""
    axes = [a for a in AXES if a in have]
    if have & set(MEANS):
        return None
    if axes:
        return F.sqrt(reduce(Column.__add__, [F.coalesce(_number(a) * _number(a), F.lit(0.0)) for a in axes]))
    return _number("magnitude") if "magnitude" in have else None


def _of_magnitude(aggregate: Callable[[Column], Column], axes_only: bool = False):
    def rule(have: frozenset[str]) -> Column | None:
        length = None if axes_only and not have & set(AXES) else _magnitude(have)
        return None if length is None else aggregate(length)

    return rule


def _covered(have: frozenset[str]) -> Column | None:
    column = next((c for c in ("magnitude", "accel_x") if c in have), None)
    return None if column is None else F.avg(_number(column).isNotNull().cast("double")) * 100


def _active(have: frozenset[str]) -> Column | None:
    parts = [total(_number(next(c for c in pair if c in have))) for pair in (("motion_walking_min", "walking_min"), ("motion_running_min", "running_min")) if have & set(pair)]
    return reduce(Column.__add__, parts) if parts else None


def _foreground(label: str | None = None):
    def rule(have: frozenset[str]) -> Column | None:
        if "amt_foreground_day_sec" not in have or (label and "category" not in have):
            return None
        seconds = _number("amt_foreground_day_sec")
        if label is None:
            return total(seconds) / 60
        mine = F.coalesce(F.lower(F.col("category").cast("string")).contains(label), F.lit(False))
        return F.when(F.count_if(mine) > 0, total(F.when(mine, seconds)) / 60)

    return rule


#: fixed values: names of features and of the columns that hold them, first choice first
CATALOGUE: dict[str, tuple[Feature, ...]] = {
    "accelerometer": (
        Feature("accel_mean_mag", "mean", MEANS, _of_magnitude(F.avg)),
        Feature("accel_std_mag", "mean", ("accel_std_magnitude", "std_magnitude"), _of_magnitude(F.stddev_samp), first=True),
        Feature("accel_activity_counts", "sum", ("accel_activity_counts", "activity_counts"), _of_magnitude(lambda m: F.count_if(F.abs(m - 1) > 0.1).cast("double"), axes_only=True), first=True),
        Feature("accel_coverage_pct", "mean", ("accel_coverage_pct", "coverage_pct"), _covered),
    ),
    "gps": (
        Feature("gps_n_captures", "sum", ("gps_n_captures", "n_captures"), lambda have: F.count(F.lit(1)).cast("double")),
        Feature("gps_distance_km", "sum", ("gps_distance_km", "distance_km")),
        Feature("gps_at_home_min", "sum", ("gps_at_home_min", "at_home_min")),
        Feature("gps_speed_max_kmh", "max", ("gps_speed_max_kmh", "speed_max_kmh", "speed_kmh")),
        Feature("gps_location_entropy", "mean", ("gps_location_entropy", "location_entropy")),
        Feature("gps_dist_from_home_max_km", "max", ("gps_dist_from_home_max_km", "dist_from_home_max_km", "dist_from_home_km")),
    ),
    "sleep": (
        Feature("sleep_duration_min", "sum", ("sleep_duration_min", "amt_sleep_day_min", "val_sleep_duration_min", "is_sleep")),
        Feature("sleep_movement_mean", "mean", ("accel_mean_mag",)),
    ),
    "screen": (
        Feature("screen_on_min", "sum", ("screen_on_min",)),
        Feature("screen_n_sessions", "sum", ("screen_n_sessions", "n_sessions")),
        Feature("app_total_min", "sum", ("app_total_min",)),
        Feature("app_social_min", "sum", ("app_social_min",)),
        Feature("app_comm_min", "sum", ("app_comm_min",)),
    ),
    "app_usage": (
        Feature("app_total_min", "sum", (), _foreground()),
        Feature("app_social_min", "sum", (), _foreground("social")),
        Feature("app_comm_min", "sum", (), _foreground("communication")),
    ),
    "motion": (
        Feature("motion_stationary_min", "sum", ("motion_stationary_min", "stationary_min")),
        Feature("motion_walking_min", "sum", ("motion_walking_min", "walking_min")),
        Feature("motion_automotive_min", "sum", ("motion_automotive_min", "automotive_min")),
        Feature("motion_running_min", "sum", ("motion_running_min", "running_min")),
        Feature("motion_active_min", "sum", ("motion_active_min", "active_min"), _active),
        Feature("motion_coverage_pct", "mean", ("motion_coverage_pct", "coverage_pct")),
    ),
    "keyboard": (
        Feature("key_chars_typed", "sum", ("key_chars_typed", "n_char_day_allapps", "chars_typed")),
        Feature("key_words_typed", "sum", ("key_words_typed", "n_word_day_allapps", "words_typed")),
        Feature("key_n_sessions", "sum", ("key_n_sessions", "n_sessions")),
        Feature("key_prop_neg", "mean", ("key_prop_neg", "prop_word_neg_day_allapps", "prop_neg")),
        Feature("key_prop_pos", "mean", ("key_prop_pos", "prop_word_pos_day_allapps", "prop_pos")),
    ),
    "music": (
        Feature("mus_is_listening", "any", ("mus_is_listening", "is_listening")),
        Feature("mus_n_tracks", "sum", ("mus_n_tracks", "n_tracks")),
    ),
    "light": (Feature("light_mean_lux", "mean", ("light_mean_lux", "mean_lux", "lux")),),
}
CATALOGUE["key_input"] = CATALOGUE["keyboard"]


def label_entropy(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, gps_location_entropy): Shannon entropy in bits of the labels of each key; null without any."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    sums = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") * F.log2("_n")).alias("_weighted"))
    return sums.select(*keys, (F.log2("_all") - F.col("_weighted") / F.col("_all") + F.lit(0.0)).alias("gps_location_entropy"))


def features(rows: DataFrame, keys: list[str], sensor: str) -> DataFrame:
    """One row for each key that has rows: the keys and the sensor's features from the columns at hand.

    Values that are no number are null; sums of nulls alone are 0, means and maxima null.  An unknown sensor raises.
    """
    if sensor not in CATALOGUE:
        raise ValueError(f"no features of {sensor!r}: {', '.join(sorted(CATALOGUE))}")
    have = frozenset(rows.columns) - set(keys)
    found = [(f.name, f.aggregate(have)) for f in CATALOGUE[sensor]]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *(c.alias(name) for name, c in found if c is not None)).drop("_rows")
    if sensor == "gps" and "gps_location_entropy" not in out.columns and "location_label" in have:
        out = out.join(label_entropy(rows, keys, "location_label"), keys, "left")
    return out


def all_features(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Features of several sensors side by side; a key that one sensor lacks has nulls there.  A feature that two
    sensors give is the later one's where that has rows for the key."""
    out = None
    for sensor, rows in frames.items():
        new = features(rows, keys, sensor).withColumn("_here", F.lit(True))
        if out is None:
            out = new.drop("_here")
            continue
        both = set(out.columns) & set(new.columns) - set(keys)
        new = new.withColumnsRenamed({c: f"_new_{c}" for c in both})
        out = out.join(new, keys, "full").withColumns({c: F.when(F.col("_here"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in both}).drop("_here", *(f"_new_{c}" for c in both))
    return out
