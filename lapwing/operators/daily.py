"""Daily rollups, rosters, homes and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from .clusters import density_clusters
from .intervals import first_by


def motion_days(hours: DataFrame, least: float = 0.5) -> DataFrame:
    """Daily minutes of motion from hours covered well enough: capped at a day, with walking episodes (hours
    with over a minute of it), tracked hours and the primary activity."""
    names = ("stationary", "walking", "automotive")
    kept = hours.where(F.col("coverage") >= least)
    days = kept.groupBy("pid", F.floor(F.col("hour") / 24).cast("long").alias("day")).agg(
        *(F.sum(f"{n}_min").alias(n) for n in names), F.count_if(F.col("walking_min") > 1).alias("walking_episodes"), F.least(F.count("*"), F.lit(24)).alias("tracked_hours")
    )
    capped = C.capped_parts({n: F.col(n) for n in names})
    days = days.select("pid", "day", *(c.alias(f"{n}_min") for n, c in capped.items()), "walking_episodes", "tracked_hours")
    return days.withColumn("primary_activity", C.argmax_name({n: F.col(f"{n}_min") for n in names}))


def sums_in_order(rows: DataFrame, keys: list[str], sums: dict[str, Column], order: str) -> DataFrame:
    """One row a key: each of ``sums`` added up row after row in the order of the column ``order``; null without a value.

    The last bit of a sum of doubles depends on the order, and a bound or a whole number may lie there, so the order must not
    be that in which rows happen to be dealt.  The rows of a key (a user's day or hour) go through one window.
    """
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select(*keys, F.col(order).alias("_order"), F.struct(*(F.sum(c).over(so_far).alias(n) for n, c in sums.items())).alias("_sums"))
    return running.groupBy(*keys).agg(F.max_by("_sums", "_order").alias("_sums")).select(*keys, "_sums.*")


MOST_MIN = 1440


def screen_days(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Screen minutes of a day, at most those of a day, and sessions; sums of nulls alone are 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return hours.groupBy(*keys).agg(F.least(total("screen_on_min"), F.lit(float(MOST_MIN))).alias("screen_total_min"), total("screen_n_sessions").alias("screen_n_sessions"))


def app_days(hours: DataFrame, keys: list[str], parts: tuple[str, ...] = ("app_social_min", "app_comm_min", "app_entertainment_min")) -> DataFrame:
    """App minutes of a day: a total over a day's minutes becomes these, and its parts shrink with it, to one digit; and the mean
    number of apps in hours with any.  Windows that overlap make such totals."""
    sums = hours.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("app_total_min", *parts)), F.avg(F.when(F.col("app_n_apps") > 0, F.col("app_n_apps"))).alias("app_n_apps_mean"))
    over = F.col("app_total_min") > MOST_MIN
    scaled = [F.when(over, F.round(F.col(c) * MOST_MIN / F.col("app_total_min"), 1)).otherwise(F.col(c)).alias(c) for c in parts]
    return sums.select(*keys, F.least("app_total_min", F.lit(float(MOST_MIN))).alias("app_total_min"), *scaled, "app_n_apps_mean")


def keyboard_days(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions and characters of the hours with a session; days without such an hour have no row."""
    return hours.where("key_n_sessions > 0").groupBy(*keys).agg(F.sum("key_n_sessions").alias("keyboard_n_sessions"), F.coalesce(F.sum("key_chars_typed"), F.lit(0)).alias("keyboard_total_chars"))


def light_days(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of a day's hourly light and its category; days without light have no row."""
    days = hours.where("light_mean_lux is not null").groupBy(*keys).agg(F.avg("light_mean_lux").alias("light_mean_lux_raw"))
    return days.withColumn("light_category", C.light_class(F.col("light_mean_lux_raw")))


def music_days(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Tracks of the hours of listening; days without such an hour have no row."""
    return hours.where("mus_is_listening").groupBy(*keys).agg(F.lit(True).alias("music_listening"), F.coalesce(F.sum("mus_n_tracks"), F.lit(0)).alias("music_n_tracks"))


def rollup(rows: DataFrame, keys: list[str], sums: tuple[str, ...] = (), means: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: listed columns summed, averaged, or true if any is."""
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.avg(c).alias(c) for c in means), *(F.bool_or(c).alias(c) for c in flags))


def roster(files: DataFrame) -> DataFrame:
    """Participants of a file listing (pid, modality, platform, day): flags, platform (of several the first by
    name), first and last day, and days between."""
    kinds = ("click", "view", "purchase", "error", "signup")
    flags = [F.bool_or(F.col("modality") == m).alias(f"has_{m}") for m in kinds]
    return files.groupBy("pid").agg(*flags, F.min("platform").alias("platform"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), (F.max("day") - F.min("day") + 1).alias("study_days"))


def homes(fixes: DataFrame, eps_m: float = 150.0, least: int = 4) -> DataFrame:
    """Home of each participant from night fixes: centre, mean radius, fixes and clusters of the largest cluster
    (of equal ones the first); fixes: pid, fix_id, lat, lon."""
    spots = fixes.groupBy("pid", "lat", "lon").agg(F.min("fix_id").alias("a"), F.count("*").alias("weight"))
    found = density_clusters(spots, eps_m, least).join(spots, ["pid", "a"])
    size = found.groupBy("pid", "cluster").agg(F.sum("weight").alias("n"), (F.sum(F.col("lat") * F.col("weight")) / F.sum("weight")).alias("home_lat"), (F.sum(F.col("lon") * F.col("weight")) / F.sum("weight")).alias("home_lon"))
    w = Window.partitionBy("pid")
    best = size.withColumn("n_clusters", F.count("*").over(w)).withColumn("turn", F.row_number().over(w.orderBy(F.col("n").desc(), "cluster"))).where("turn = 1").drop("turn")
    away = C.haversine_m(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon"))
    radius = found.join(best, ["pid", "cluster"]).groupBy("pid").agg((F.sum(away * F.col("weight")) / F.sum("weight")).alias("radius_m"))
    return best.join(radius, "pid").select("pid", "home_lat", "home_lon", "radius_m", F.col("n").alias("n_used"), "n_clusters")


def top_list(rows: DataFrame, keys: list[str], name: Column, amount: Column, n: int = 5) -> DataFrame:
    """Total and the ``n`` largest names of each key as 'name:amount' joined by commas; ties by name."""
    sums = rows.groupBy(*keys, name.alias("_name")).agg(F.sum(amount).alias("_amount"))
    ranked = sums.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_amount").desc(), "_name")))
    item = F.struct(F.col("_turn"), F.concat_ws(":", F.col("_name").cast("string"), F.col("_amount").cast("long").cast("string")).alias("t"))
    best = F.array_sort(F.collect_list(F.when(F.col("_turn") <= n, item)))
    return ranked.groupBy(*keys).agg(F.sum("_amount").alias("total"), F.array_join(F.transform(best, lambda x: x["t"]), ",").alias("top"))


def selection_scores(users: DataFrame) -> DataFrame:
    """Score of each user: users has n, coverage, sensors and has_doc."""
    most = users.agg(F.max("n")).first()[0] or 1
    return users.withColumn("score", 0.3 * F.col("n") / F.lit(most) + 0.4 * F.col("coverage") + 0.2 * F.col("sensors") / 8 + 0.1 * F.col("has_doc").cast("int"))


def complete_runs(runs: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with at most 1.5 times the expected rows, and whether 0.95 of them are there."""
    have = runs.groupBy(*keys).agg(F.count("*").alias("n")).join(expected, keys)
    return have.where(F.col("n") <= 1.5 * F.col("expected")).withColumn("complete", F.col("n") >= 0.95 * F.col("expected"))


def align_days(prompts: DataFrame, days: DataFrame, lag_days: int = 0) -> DataFrame:
    """Prompts with the daily row of their own day, or of ``lag_days`` before (1 and more look at the past
    only); of several daily rows the first counts.  prompts: participant, day; days also: tie."""
    one = first_by(days, ["participant", "day"], F.col("tie")).drop("tie").withColumn("day", F.col("day") + lag_days)
    return prompts.join(one, ["participant", "day"], "left")
