"""Queries for scalars, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import texts as X
from ..functions import times as T
from ..operators import daily as D
from ..operators import intervals as I
from ..sources import bindings as B
from .base import events_of, query, rounded

OFFSET = "(CASE WHEN zone LIKE '-%' THEN -1 ELSE 1 END * (CAST(substr(zone, 2, 2) AS BIGINT) * 60 + CAST(substr(zone, 5, 2) AS BIGINT)))"


@query(
    "p01_p04_local_times",
    f"""WITH {B.EV}, l AS (SELECT *, {OFFSET} AS minutes, ms + {OFFSET} * 60000 AS local_ms FROM ev)
    SELECT event_id, minutes, local_ms, ms // 3600000 AS hour_utc, local_ms // 3600000 AS hour_local, CAST((local_ms // 3600000) % 24 AS BIGINT) AS clock,
      CASE WHEN (local_ms // 3600000) % 24 < 5 THEN 'night' WHEN (local_ms // 3600000) % 24 < 12 THEN 'morning' WHEN (local_ms // 3600000) % 24 < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day,
      CASE WHEN (local_ms // 3600000) % 24 < 12 THEN 'morning' WHEN (local_ms // 3600000) % 24 < 17 THEN 'afternoon' ELSE 'evening' END AS slot,
      (local_ms // 3600000) % 24 >= 22 OR (local_ms // 3600000) % 24 < 6 AS night FROM l""",
)
@events_of
def local_times(ev):
    """P01-P04, P12-P14, X08."""
    local = T.local_ms(F.col("ms"), F.col("zone"))
    rows = ev.select("event_id", T.offset_minutes(F.col("zone")).alias("minutes"), local.alias("local_ms"), T.hour_of(F.col("ms")).alias("hour_utc"))
    clock = T.clock_hour(F.col("local_ms"))
    return rounded(rows.select("*", T.hour_of(F.col("local_ms")).alias("hour_local"), clock.alias("clock"), T.time_of_day(clock).alias("time_of_day"), T.prompt_slot(clock).alias("slot"), T.is_night(clock).alias("night")))


@query(
    "p05_p06_ids_and_devices",
    """WITH u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT user_id, md5(CAST(user_id AS VARCHAR)) AS h FROM u),
    e AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN substr(h, 1, 16) WHEN 1 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) ELSE 'device' END AS device FROM d)
    SELECT user_id, CASE WHEN length(CAST(user_id AS VARCHAR)) >= 3 THEN CAST(user_id AS VARCHAR) ELSE lpad(CAST(user_id AS VARCHAR), 3, '0') END AS padded,
      CASE user_id % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'unknown' END AS platform FROM e""",
)
@events_of
def ids_and_devices(ev):
    """P05, P06."""
    h = F.md5(F.col("user_id").cast("string"))
    dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    device = F.when(F.col("user_id") % 3 == 0, F.substring(h, 1, 16)).when(F.col("user_id") % 3 == 1, dashed).otherwise("device")
    return ev.select("user_id").distinct().select("user_id", C.padded_id(F.col("user_id")).alias("padded"), C.platform_of_device(device).alias("platform"))


@query(
    "p07_p33_platform_from_data",
    f"""WITH {B.EV} SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 200) OR bool_or(event_type = 'signup' AND k % 5 = 0) THEN 'android' ELSE 'ios' END AS platform,
      count(*) FILTER (event_type = 'signup') AS n_light FROM ev GROUP BY user_id""",
)
@events_of
def platform_from_data(ev):
    """Any app minutes or light rows make a participant an Android user."""
    app, light = (F.col("event_type") == "error") & (F.col("value") > 200), (F.col("event_type") == "signup") & (F.col("k") % 5 == 0)
    return ev.groupBy("user_id").agg(F.when(F.bool_or(app) | F.bool_or(light), "android").otherwise("ios").alias("platform"), F.count_if(F.col("event_type") == "signup").alias("n_light"))


RAW = "CASE k % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'maybe' WHEN 3 THEN '1.0' WHEN 5 THEN 'TRUE' WHEN 6 THEN '0' END"


@query(
    "p08_p10_coercion",
    f"""WITH {B.EV}, r AS (SELECT event_id, {RAW} AS raw FROM ev)
    SELECT event_id, TRY_CAST(trim(raw) AS DOUBLE) AS num, CASE WHEN lower(trim(raw)) IN ('true', 'yes', '1', '1.0') THEN true WHEN lower(trim(raw)) IN ('false', 'no', '0', '0.0') THEN false END AS truth FROM r""",
)
@events_of
def coercion(ev):
    """P08-P10."""
    raw = F.expr(RAW)
    return ev.select("event_id", C.number(F.trim(raw)).alias("num"), C.truth(raw).alias("truth"))


_half = "pow(sin((radians({1}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin((radians({3}) - radians({2})) / 2), 2)"
HAVERSINE = f"2 * 6371000.0 * asin(sqrt(least(1.0, {_half}) + 0 * ({_half})))"


@query(
    "p11_p25_quality_fixes",
    f"""WITH {B.EV}, {B.FIXES} SELECT fix_id, NOT (lat = 0 AND lon = 0) AND coalesce(accuracy <= 500, true) AS good, NOT (lat = 0 AND lon = 0) AND coalesce(accuracy <= 500, false) AS good_for_home,
      round({HAVERSINE.format("40.0", "lat", "-74.0", "lon")}, 3) AS metres FROM fx""",
)
@events_of
def quality_fixes(ev):
    """Both null rules of the accuracy filter."""
    lat, lon, acc = F.col("lat"), F.col("lon"), F.col("accuracy")
    metres = C.haversine_m(F.lit(40.0), F.lit(-74.0), lat, lon)
    return B.fixes(ev).select("fix_id", C.good_fix(lat, lon, acc).alias("good"), C.good_fix(lat, lon, acc, null_accuracy=False).alias("good_for_home"), F.round(metres, 3).alias("metres"))


def _case(rules: dict[str, str], test: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(k)} THEN '{v}'" for k, v in rules.items()) + " ELSE 'OTHER' END"


@query(
    "p15_app_categories",
    f"""WITH {B.EV}, {B.WINDOWS} SELECT app, count(*) AS n, {_case(C.EVENT_APPS, "starts_with(app, '{}')")} AS event_category,
      CASE WHEN app IS NULL OR lower(trim(app)) IN ('nan', 'android', '') THEN 'SYSTEM' ELSE {_case(C.HOURLY_APPS, "contains(lower(app), '{}')")} END AS hourly_category FROM aw GROUP BY app""",
)
@events_of
def app_categories(ev):
    """By prefix for events, by substring for hours."""
    return B.app_windows(ev).groupBy("app").agg(F.count("*").alias("n")).select("app", "n", C.app_category_event(F.col("app")).alias("event_category"), C.app_category_hourly(F.col("app")).alias("hourly_category"))


@query(
    "p16_motion_flags",
    f"""WITH {B.EV} SELECT event_id, CASE WHEN k % 2 = 1 THEN 'automotive' WHEN k % 3 = 1 THEN 'walking' WHEN k % 5 = 1 THEN 'running' WHEN k % 7 = 1 THEN 'cycling' WHEN k % 4 = 0 THEN 'stationary' ELSE 'unknown' END AS category FROM ev""",
)
@events_of
def motion_flags(ev):
    """P16."""
    flag = lambda m, r: F.when(F.col("k") % m == r, 1).otherwise(0)
    flags = {"automotive": flag(2, 1), "walking": flag(3, 1), "running": flag(5, 1), "cycling": flag(7, 1), "stationary": flag(4, 0), "unknown": F.lit(0)}
    return ev.select("event_id", C.motion_class(flags).alias("category"))


@query(
    "p17_p18_magnitude_and_light",
    f"""WITH {B.EV} SELECT event_id, round(least(sqrt(pow(value / 100, 2) + pow(k / 50.0, 2) + 1), 5.0), 6) AS magnitude, CASE WHEN value * 3 < 10 THEN 'dark' WHEN value * 3 < 500 THEN 'indoor' ELSE 'outdoor' END AS light FROM ev""",
)
@events_of
def magnitude_and_light(ev):
    """P17, P18."""
    mag = F.least(F.sqrt(F.pow(F.col("value") / 100, 2) + F.pow(F.col("k") / 50.0, 2) + 1), F.lit(5.0))
    return ev.select("event_id", F.round(mag, 6).alias("magnitude"), C.light_class(F.col("value") * 3).alias("light"))


@query(
    "p20_p22_p34_predictions",
    f"""WITH {B.EV}, {B.PROMPTS} SELECT prompt_id, desire >= 5 AND available = 'yes' AS receptive, least(30.0, greatest(0.0, value / 10)) AS clamped,
      concat_ws(',', CASE WHEN NOT (value / 10 BETWEEN 0 AND 30) THEN 'range' END, CASE WHEN NOT (desire BETWEEN 0 AND 10) THEN 'desire' END, CASE WHEN available <> 'yes' THEN 'available' END) AS failed,
      CASE WHEN available = 'yes' THEN 1 ELSE 0 END AS target FROM pr""",
)
@events_of
def predictions(ev):
    """Receptivity, clamping, failed rules, cleaned target."""
    value = F.col("value") / 10
    rules = {"range": value.between(0, 30), "desire": F.col("desire").between(0, 10), "available": F.col("available") == "yes"}
    return B.prompts(ev).select(
        "prompt_id", C.receptive(F.col("desire"), F.col("available")).alias("receptive"), C.clamp(value, 0.0, 30.0).alias("clamped"), C.failed_rules(rules).alias("failed"),
        F.when(C.truth(F.col("available")), 1).otherwise(0).alias("target"),
    )


@query("p24_withdrawn", f"""WITH {B.EV} SELECT user_id, count(*) AS n FROM ev WHERE user_id NOT IN (SELECT DISTINCT user_id FROM ev WHERE user_id % 50 = 7) GROUP BY user_id""")
@events_of
def withdrawn(ev):
    """P24."""
    gone = ev.where("user_id % 50 = 7").select("user_id").distinct()
    return ev.join(gone, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "p29_ghost_rows",
    f"""WITH {B.EV}, h AS (SELECT DISTINCT pid, ms // 3600000 AS hour_utc, (ms + {OFFSET} * 60000) // 3600000 AS hour_local FROM ev),
    g AS (SELECT *, max(CASE WHEN hour_local = hour_utc THEN 0 ELSE 1 END) OVER (PARTITION BY pid, hour_local) AS real_ FROM h)
    SELECT pid, hour_utc, hour_local FROM g WHERE NOT (hour_local = hour_utc AND real_ = 1)""",
)
@events_of
def ghost_rows(ev):
    """P29."""
    return I.drop_ghosts(ev.select("pid", T.hour_of(F.col("ms")).alias("hour_utc"), T.hour_of(T.local_ms(F.col("ms"), F.col("zone"))).alias("hour_local")).distinct())


@query(
    "p30_p31_daily_rendering",
    f"""WITH {B.EV}, d AS (SELECT user_id, ms // 86400000 AS day, sum(CASE WHEN event_type = 'click' THEN value END) AS a, sum(CASE WHEN event_type = 'view' THEN value END) AS b FROM ev GROUP BY ALL)
    SELECT user_id, day, concat_ws(',', CASE WHEN a IS NOT NULL THEN 'screen' END, CASE WHEN b IS NOT NULL THEN 'motion' END) AS modalities,
      CASE WHEN a IS NULL AND b IS NULL THEN 'no data' ELSE concat_ws('; ', CASE WHEN a IS NOT NULL THEN 'screen ' || CAST(CAST(floor(a) AS BIGINT) AS VARCHAR) || ' min' END, CASE WHEN b IS NOT NULL THEN 'motion ' || CAST(CAST(floor(b) AS BIGINT) AS VARCHAR) || ' min' END) END AS line,
      CASE WHEN floor(a) >= 60 THEN CAST(CAST(floor(floor(a) / 60) AS BIGINT) AS VARCHAR) || 'h ' || lpad(CAST(CAST(floor(a) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 'm' ELSE CAST(CAST(floor(a) AS BIGINT) AS VARCHAR) || 'm' END AS duration FROM d""",
)
@events_of
def daily_rendering(ev):
    """Modalities of a day and its line of text."""
    part = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    rows = D.sums_in_order(ev.withColumn("day", T.day_of(F.col("ms"))), ["user_id", "day"], {"a": part("click"), "b": part("view")}, "event_id")
    whole = lambda c: F.floor(c).cast("long")
    line = X.rendered({"a": ("screen %d min", whole(F.col("a"))), "b": ("motion %d min", whole(F.col("b")))})
    return rows.select("user_id", "day", C.present({"screen": F.col("a"), "motion": F.col("b")}).alias("modalities"), line.alias("line"), X.duration_text(F.col("a")).alias("duration"))
