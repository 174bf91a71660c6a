"""Hourly feature tables, dense where the source is, and the event tables they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import texts as X
from ..functions import times as T
from . import intervals as I

MOTION_CLASSES = ("stationary", "walking", "running", "automotive", "cycling", "unclassified")


def hour_zone(rows: DataFrame, key: str = "pid") -> DataFrame:
    """key, hour, zone: the commonest zone of each hour, of equals the least."""
    return rows.groupBy(key, T.hour_of(F.col("ms")).alias("hour")).agg(F.mode("zone", True).alias("zone"))


def acceleration(rows: DataFrame, expected: int = 3600, least: float = 0.1) -> DataFrame:
    """mean, sd, movement, n, coverage and device_missing of magnitudes; rows: pid, second, magnitude, tie."""
    capped = rows.withColumn("magnitude", F.least(F.col("magnitude"), F.lit(5.0)))
    steps = I.step_changes(capped, "pid", "second", "magnitude", "tie")
    out = steps.groupBy("pid", F.floor(F.col("second") / 3600).cast("long").alias("hour")).agg(
        F.avg("magnitude").alias("mean_mag"), F.stddev_samp("magnitude").alias("sd_mag"), F.sum("abs_diff").alias("movement"), F.count("*").alias("n")
    )
    return out.withColumn("coverage", F.col("n") / expected).withColumn("device_missing", F.col("coverage") < least)


def cell_entropy(rows: DataFrame, keys: list[str], cell: list[Column], epsilon: float = 1e-12) -> DataFrame:
    """entropy: bits of the distribution over cells, 0 with fewer than two rows."""
    cells = rows.groupBy(*keys, *(c.alias(f"_c{i}") for i, c in enumerate(cell))).agg(F.count("*").alias("_n"))
    total = cells.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    p = F.col("_n") / F.col("_all")
    bits = cells.join(total, keys).groupBy(*keys).agg(F.sum(-p * F.log2(p + epsilon)).alias("_bits"), F.max("_all").alias("_all"))
    return bits.select(*keys, F.when(F.col("_all") < 2, 0.0).otherwise(F.greatest(F.col("_bits"), F.lit(0.0))).alias("entropy"))


def label_entropy(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """entropy over labels without an epsilon; null labels do not count."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    p = F.col("_n") / F.col("_all")
    return counts.join(total, keys).groupBy(*keys).agg(F.sum(-p * F.log2(p)).alias("entropy"))


def positions(fixes: DataFrame, homes: DataFrame) -> DataFrame:
    """Hourly n_fixes, distance_m, max_kmh, at_home_min, max_home_m and entropy of good fixes; homes: pid,
    home_lat, home_lon, radius_m (at home is null without one)."""
    good = fixes.where(C.good_fix(F.col("lat"), F.col("lon"), F.col("accuracy")))
    rows = I.drop_artefacts(I.consecutive_fixes(good)).withColumn("hour", T.hour_of(F.col("ms"))).join(homes, "pid", "left")
    away = C.haversine_m(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon"))
    rows = rows.withColumn("home_m", away)
    out = rows.groupBy("pid", "hour").agg(
        F.count("*").alias("n_fixes"), F.sum("distance_m").alias("distance_m"), F.max("speed_kmh").alias("max_kmh"),
        (F.avg((F.col("home_m") <= F.col("radius_m")).cast("double")) * 60).alias("at_home_min"), F.max("home_m").alias("max_home_m"),
    )
    cell = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    return out.join(cell_entropy(rows, ["pid", "hour"], [cell("lat"), cell("lon")]), ["pid", "hour"])


def motion_minutes(intervals: DataFrame) -> DataFrame:
    """Dense hourly minutes of each class, active minutes, coverage and device_missing; an hour without
    intervals has nulls, coverage 0, and is missing."""
    pieces = I.split_by_hour(intervals)
    minutes = {c: F.sum(F.when(F.col("category") == c, F.col("clipped_ms"))) / 60000 for c in MOTION_CLASSES}
    hours = pieces.groupBy("pid", "hour").agg(*(F.coalesce(m, F.lit(0.0)).alias(f"{c}_min") for c, m in minutes.items()))
    dense = I.hour_spine(pieces).join(hours, ["pid", "hour"], "left")
    classified = sum((F.col(f"{c}_min") for c in MOTION_CLASSES if c != "unclassified"), F.lit(0.0))
    dense = dense.withColumn("active_min", F.col("walking_min") + F.col("running_min") + F.col("cycling_min"))
    dense = dense.withColumn("coverage", F.coalesce(F.least(classified / 60, F.lit(1.0)), F.lit(0.0)))
    return dense.withColumn("device_missing", F.col("coverage") < 0.05)


def screen_minutes(sessions: DataFrame, starts_only: bool = False) -> DataFrame:
    """Dense hourly minutes, number, mean and longest of unlock sessions; a session counts in every hour that
    it touches, or only where it starts."""
    pieces = I.split_by_hour(sessions)
    counts = T.hour_of(F.col("start_ms")) == F.col("hour") if starts_only else F.lit(True)
    minutes = F.col("clipped_ms") / 60000
    hours = pieces.groupBy("pid", "hour").agg(F.sum(minutes).alias("screen_min"), F.count_if(counts).alias("n_sessions"), F.avg(minutes).alias("mean_min"), F.max(minutes).alias("max_min"))
    return I.hour_spine(pieces).join(hours, ["pid", "hour"], "left").withColumn("screen_min", F.coalesce("screen_min", F.lit(0.0))).withColumn("n_sessions", F.coalesce("n_sessions", F.lit(0)))


def latest_snapshots(windows: DataFrame) -> DataFrame:
    """Of accumulating snapshots (same participant, app and start), the one that ends last."""
    return I.first_by(windows, ["pid", "app", "start_ms"], F.col("end_ms").desc(), F.col("foreground_ms").desc(), F.col("tie"))


def app_minutes(windows: DataFrame, max_hours: float = 10.0) -> DataFrame:
    """Hourly foreground minutes (an hour at most a row), total (60 at most), categories and distinct apps."""
    kept = latest_snapshots(windows).where((F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") <= max_hours * T.HOUR_MS))
    pieces = I.split_by_hour(kept)
    share = F.least(F.col("foreground_ms") * F.col("clipped_ms") / (F.col("end_ms") - F.col("start_ms")), F.lit(float(T.HOUR_MS))) / 60000
    rows = pieces.withColumn("minutes", share).withColumn("category", C.app_category_hourly(F.col("app")))
    out = rows.groupBy("pid", "hour").agg(
        F.sum("minutes").alias("app_min"), F.count_distinct("app").alias("n_apps"),
        *(F.coalesce(F.sum(F.when(F.col("category") == c, F.col("minutes"))), F.lit(0.0)).alias(f"{c.lower()}_min") for c in ("SOCIAL", "COMMUNICATION", "ENTERTAINMENT", "PRODUCTIVITY", "SYSTEM", "OTHER")),
    )
    return out.withColumn("screen_on_min", F.least("app_min", F.lit(60.0)))


def typing_tone(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions, characters, words and shares of positive and negative words of typing; passwords are dropped."""
    kept = sessions.where(~F.coalesce(F.col("password"), F.lit(False)))
    rows = kept.withColumn("_w", X.tokens(F.coalesce("text", F.lit(""))))
    n = F.sum(F.size("_w"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_sessions"), F.sum(F.length("text")).alias("n_chars"), n.alias("n_words"),
        (F.sum(X.count_in(F.col("_w"), X.POSITIVE)) / F.nullif(n, F.lit(0))).alias("positive_share"), (F.sum(X.count_in(F.col("_w"), X.NEGATIVE)) / F.nullif(n, F.lit(0))).alias("negative_share"),
    )


def listening(plays: DataFrame) -> DataFrame:
    """Dense hourly tracks, adverts and a flag of listening; plays: pid, ms, advert, missing."""
    rows = plays.where(~F.coalesce(F.col("missing"), F.lit(False))).withColumn("hour", T.hour_of(F.col("ms")))
    hours = rows.groupBy("pid", "hour").agg(F.count_if(~F.col("advert")).alias("n_tracks"), F.count_if(F.col("advert")).alias("n_adverts"))
    out = I.hour_spine(rows).join(hours, ["pid", "hour"], "left").na.fill(0, ["n_tracks", "n_adverts"])
    return out.withColumn("listening", F.col("n_tracks") > 0)


def light(rows: DataFrame) -> DataFrame:
    """Hourly count, mean, greatest and least lux, where there are readings; rows: pid, ms, lux."""
    return rows.groupBy("pid", T.hour_of(F.col("ms")).alias("hour")).agg(F.count("lux").alias("n"), F.avg("lux").alias("mean_lux"), F.max("lux").alias("max_lux"), F.min("lux").alias("min_lux"))


def missing_reason(spine: DataFrame, observed: DataFrame, structural: Column) -> DataFrame:
    """OBSERVED, STRUCTURAL (the platform has no such sensor), DEVICE (hour covered too little) or PARTICIPANT
    (nothing at all) for each hour; observed: pid, hour, coverage."""
    rows = spine.join(observed, ["pid", "hour"], "left")
    reason = F.when(structural, "STRUCTURAL").when(F.col("coverage") >= 0.5, "OBSERVED").when(F.col("coverage").isNotNull(), "DEVICE").otherwise("PARTICIPANT")
    return rows.withColumn("reason", reason)


def app_events(windows: DataFrame, deduplicated: bool = True) -> DataFrame:
    """App sessions: minutes in the foreground, between 0 and 600, and a category by prefix."""
    rows = latest_snapshots(windows) if deduplicated else windows
    minutes = F.round(F.least(F.greatest(F.col("foreground_ms") / 60000, F.lit(0.0)), F.lit(600.0)), 2)
    return rows.select("pid", "app", "start_ms", minutes.alias("minutes"), C.app_category_event(F.col("app")).alias("category"))


def distinct_events(rows: DataFrame, zone: str = "zone") -> DataFrame:
    """Events at local times, one for each participant and local time."""
    local = rows.withColumn("local_ms", T.local_ms(F.col("ms"), F.col(zone)))
    return I.first_by(local, ["pid", "local_ms"], F.col("tie"))
