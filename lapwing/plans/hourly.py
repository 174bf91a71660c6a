"""Queries for intervals, sessions and hourly tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import texts as X
from ..functions import times as T
from ..operators import hourly as H
from ..operators import intervals as I
from ..sources import bindings as B
from .base import events_of, query, rounded
from .cleaning import HAVERSINE, OFFSET

GOOD = "NOT (lat = 0 AND lon = 0) AND coalesce(accuracy <= 500, true)"
PAIRS = f"""cp0 AS (SELECT *, lag(ms) OVER w AS pms, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM {{source}} WINDOW w AS (PARTITION BY pid ORDER BY ms, lat, lon, fix_id)),
  cp1 AS (SELECT *, (ms - pms) / 1000.0 AS gap_s, CASE WHEN (ms - pms) / 1000.0 <= 900 THEN {HAVERSINE.format("plat", "lat", "plon", "lon")} END AS d FROM cp0),
  cp AS (SELECT *, CASE WHEN gap_s > 0 THEN d / gap_s * 3.6 END AS kmh FROM cp1)"""


@query(
    "w01_p26_consecutive_fixes",
    f"""WITH {B.EV}, {B.FIXES}, {PAIRS.format(source="fx")}
    SELECT fix_id, round(gap_s, 3) AS gap_s, round(CASE WHEN coalesce(kmh > 180, false) THEN NULL ELSE d END, 3) AS distance_m, round(CASE WHEN coalesce(kmh > 180, false) THEN NULL ELSE kmh END, 3) AS speed_kmh FROM cp""",
)
@events_of
def consecutive_fixes(ev):
    """W01, P26."""
    return rounded(I.drop_artefacts(I.consecutive_fixes(B.fixes(ev))).select("fix_id", "gap_s", "distance_m", "speed_kmh"), 3)


ACCEL = "ac AS (SELECT pid, ms // 1000 AS second, least(sqrt(pow(value / 100, 2) + pow(k / 50.0, 2) + 1), 5.0) AS mag, event_id AS tie FROM ev)"


@query(
    "w02_a01_acceleration",
    f"""WITH {B.EV}, {ACCEL}, st AS (SELECT *, CASE WHEN second - lag(second) OVER w = 1 THEN abs(mag - lag(mag) OVER w) ELSE 0 END AS df FROM ac WINDOW w AS (PARTITION BY pid ORDER BY second, tie))
    SELECT pid, second // 3600 AS hour, round(avg(mag), 4) AS mean_mag, round(stddev_samp(mag), 4) AS sd_mag, round(sum(df), 4) AS movement, count(*) AS n, round(count(*) / 3600.0, 4) AS coverage, count(*) / 3600.0 < 0.1 AS device_missing FROM st GROUP BY ALL""",
)
@events_of
def acceleration(ev):
    """W02, P17, A01."""
    rows = ev.select("pid", F.floor(F.col("ms") / 1000).cast("long").alias("second"), F.sqrt(F.pow(F.col("value") / 100, 2) + F.pow(F.col("k") / 50.0, 2) + 1).alias("magnitude"), F.col("event_id").alias("tie"))
    return rounded(H.acceleration(rows))


HOMES = "ho AS (SELECT pid, 40.0 AS home_lat, -74.0 AS home_lon, 3000.0 AS radius_m FROM (SELECT DISTINCT pid FROM ev) WHERE pid < 8)"


@query(
    "a02_a03_positions",
    f"""WITH {B.EV}, {B.FIXES}, {HOMES}, gf AS (SELECT * FROM fx WHERE {GOOD}), {PAIRS.format(source="gf")},
    r AS (SELECT cp.*, ms // 3600000 AS hour, CASE WHEN coalesce(kmh > 180, false) THEN NULL ELSE d END AS dd, CASE WHEN coalesce(kmh > 180, false) THEN NULL ELSE kmh END AS kk, ho.radius_m, {HAVERSINE.format("home_lat", "lat", "home_lon", "lon")} AS hm,
      floor(lat * 1000 + 0.5) AS c1, floor(lon * 1000 + 0.5) AS c2 FROM cp LEFT JOIN ho USING (pid)),
    cells AS (SELECT pid, hour, c1, c2, count(*) AS n FROM r GROUP BY ALL), tot AS (SELECT pid, hour, sum(n) AS a FROM cells GROUP BY ALL),
    en AS (SELECT pid, hour, CASE WHEN max(a) < 2 THEN 0 ELSE greatest(sum(-(n / a) * log2(n / a + 1e-12)), 0) END AS entropy FROM cells JOIN tot USING (pid, hour) GROUP BY ALL),
    ag AS (SELECT pid, hour, count(*) AS n_fixes, sum(dd) AS distance_m, max(kk) AS max_kmh, avg(CASE WHEN hm <= radius_m THEN 1.0 WHEN hm > radius_m THEN 0.0 END) * 60 AS at_home_min, max(hm) AS max_home_m FROM r GROUP BY ALL)
    SELECT pid, hour, n_fixes, round(distance_m, 3) AS distance_m, round(max_kmh, 3) AS max_kmh, round(at_home_min, 3) AS at_home_min, round(max_home_m, 3) AS max_home_m, round(entropy, 3) + 0.0 AS entropy FROM ag JOIN en USING (pid, hour)""",
)
@events_of
def positions(ev):
    """P11, P25, P26, A02, A03, J05, J08."""
    homes = ev.select("pid").distinct().where("pid < 8").select("pid", F.lit(40.0).alias("home_lat"), F.lit(-74.0).alias("home_lon"), F.lit(3000.0).alias("radius_m"))
    return rounded(H.positions(B.fixes(ev), homes), 3)


INTERVALS = "iv AS (SELECT * FROM (SELECT pid, category, ms AS start_ms, coalesce(lead(ms) OVER (PARTITION BY pid ORDER BY ms, category, tie), ms + 60000) AS end_ms FROM mo) WHERE end_ms > start_ms)"


def split_sql(source: str, name: str = "sp") -> str:
    """One row for each hour of an interval."""
    return f"""{name}0 AS (SELECT *, unnest(generate_series(start_ms // 3600000, (end_ms - 1) // 3600000)) AS hour FROM {source}),
    {name} AS (SELECT * FROM (SELECT *, least(end_ms, (hour + 1) * 3600000) - greatest(start_ms, hour * 3600000) AS clipped_ms FROM {name}0) WHERE clipped_ms > 0)"""


def spine_sql(source: str, name: str = "spine") -> str:
    return f"{name} AS (SELECT pid, unnest(generate_series(min(hour), max(hour))) AS hour FROM {source} GROUP BY pid)"


@query("w03_motion_intervals", f"WITH {B.EV}, {B.MOTIONS}, {INTERVALS} SELECT * FROM iv")
@events_of
def motion_intervals(ev):
    """W03."""
    return I.to_intervals(B.motions(ev))


@query("j07_hour_split", f"WITH {B.EV}, {B.MOTIONS}, {INTERVALS}, {split_sql('iv')} SELECT pid, category, start_ms, hour, clipped_ms FROM sp")
@events_of
def hour_split(ev):
    """J07."""
    return I.split_by_hour(I.to_intervals(B.motions(ev))).select("pid", "category", "start_ms", "hour", "clipped_ms")


MINUTES = ", ".join(f"coalesce(sum(clipped_ms) FILTER (category = '{c}'), 0) / 60000.0 AS {c}_min" for c in H.MOTION_CLASSES)
MOTION_HOURS = f"""{INTERVALS}, {split_sql('iv')}, {spine_sql('sp')}, mh0 AS (SELECT pid, hour, {MINUTES} FROM sp GROUP BY ALL),
    mh AS (SELECT pid, hour, {', '.join(f'{c}_min' for c in H.MOTION_CLASSES)}, walking_min + running_min + cycling_min AS active_min,
      coalesce(least((stationary_min + walking_min + running_min + automotive_min + cycling_min) / 60, 1.0), 0.0) AS coverage FROM spine LEFT JOIN mh0 USING (pid, hour))"""


@query(
    "a04_w13_motion_hours",
    f"""WITH {B.EV}, {B.MOTIONS}, {MOTION_HOURS} SELECT pid, hour, {', '.join(f'round({c}_min, 4) AS {c}_min' for c in H.MOTION_CLASSES)}, round(active_min, 4) AS active_min, round(coverage, 4) AS coverage, coverage < 0.05 AS device_missing FROM mh""",
)
@events_of
def motion_hours(ev):
    """A04, W13."""
    return rounded(H.motion_minutes(I.to_intervals(B.motions(ev))))


SESSIONS = """ss AS (SELECT pid, pms AS start_ms, ms AS end_ms, zone FROM (SELECT *, lag(state) OVER w AS pstate, lag(ms) OVER w AS pms FROM sc WINDOW w AS (PARTITION BY pid ORDER BY ms, tie))
    WHERE state = 'locked' AND pstate = 'unlocked' AND ms > pms AND ms - pms <= 10800000)"""


@query("w04_unlock_sessions", f"WITH {B.EV}, {B.SCREENS}, {SESSIONS} SELECT * FROM ss")
@events_of
def unlock_sessions(ev):
    """W04, P26."""
    return I.unlock_sessions(B.screens(ev))


@query(
    "a05_screen_hours",
    f"""WITH {B.EV}, {B.SCREENS}, {SESSIONS}, {split_sql('ss')}, {spine_sql('sp')}, h AS (SELECT pid, hour, sum(clipped_ms / 60000.0) AS s, count(*) AS n, avg(clipped_ms / 60000.0) AS m, max(clipped_ms / 60000.0) AS x FROM sp GROUP BY ALL)
    SELECT pid, hour, round(coalesce(s, 0), 4) AS screen_min, coalesce(n, 0) AS n_sessions, round(m, 4) AS mean_min, round(x, 4) AS max_min FROM spine LEFT JOIN h USING (pid, hour)""",
)
@events_of
def screen_hours(ev):
    """A05."""
    return rounded(H.screen_minutes(I.unlock_sessions(B.screens(ev))))


LATEST = "lw AS (SELECT pid, app, start_ms, end_ms, foreground_ms, tie FROM (SELECT *, row_number() OVER (PARTITION BY pid, app, start_ms ORDER BY end_ms DESC, foreground_ms DESC, tie) AS t FROM aw) WHERE t = 1)"
_hourly_case = "CASE WHEN app IS NULL OR lower(trim(app)) IN ('nan', 'android', '') THEN 'SYSTEM' " + " ".join(f"WHEN contains(lower(app), '{k}') THEN '{v}'" for k, v in C.HOURLY_APPS.items()) + " ELSE 'OTHER' END"


@query(
    "a06_w05_app_hours",
    f"""WITH {B.EV}, {B.WINDOWS}, {LATEST}, kw AS (SELECT * FROM lw WHERE end_ms > start_ms AND end_ms - start_ms <= 36000000), {split_sql('kw')},
    r AS (SELECT *, least(foreground_ms * clipped_ms / (end_ms - start_ms), 3600000.0) / 60000 AS minutes, {_hourly_case} AS category FROM sp)
    SELECT pid, hour, round(sum(minutes), 4) AS app_min, count(DISTINCT app) AS n_apps, {', '.join(f"round(coalesce(sum(minutes) FILTER (category = '{c}'), 0), 4) AS {c.lower()}_min" for c in ("SOCIAL", "COMMUNICATION", "ENTERTAINMENT", "PRODUCTIVITY", "SYSTEM", "OTHER"))}, round(least(sum(minutes), 60), 4) AS screen_on_min FROM r GROUP BY ALL""",
)
@events_of
def app_hours(ev):
    """A06, W05, P15."""
    return rounded(H.app_minutes(B.app_windows(ev)))


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "a07_x01_x02_typing",
    f"""WITH t AS (SELECT conv_id AS user_id, text, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g'), '\\s+'), lambda w: w <> '') AS w FROM conversations WHERE role <> 'system')
    SELECT user_id, count(*) AS n_sessions, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(w)) AS BIGINT) AS n_words,
      round(sum(len(list_filter(w, lambda x: list_contains({_listed(X.POSITIVE)}, x))) / nullif(1.0, 0)) / nullif(sum(len(w)), 0), 6) AS positive_share, round(sum(len(list_filter(w, lambda x: list_contains({_listed(X.NEGATIVE)}, x)))) / nullif(sum(len(w)), 0), 6) AS negative_share
    FROM t GROUP BY user_id""",
)
def typing(spark, sf_dir):
    """A07, X01, X02, P27."""
    return rounded(H.typing_tone(B.typing(spark, sf_dir), ["user_id"]), 6)


@query(
    "a08_a09_music_and_light",
    f"""WITH {B.EV}, pl AS (SELECT pid, ms // 3600000 AS hour, k % 4 = 0 AS advert FROM ev WHERE event_type = 'signup' AND k % 19 <> 0), {spine_sql('pl')}, m AS (SELECT pid, hour, count(*) FILTER (NOT advert) AS t, count(*) FILTER (advert) AS a FROM pl GROUP BY ALL),
    li AS (SELECT pid, ms // 3600000 AS hour, count(*) AS n, avg(value * 3) AS mean_lux, max(value * 3) AS max_lux, min(value * 3) AS min_lux FROM ev WHERE event_type = 'error' GROUP BY ALL)
    SELECT pid, hour, coalesce(t, 0) AS n_tracks, coalesce(a, 0) AS n_adverts, coalesce(t, 0) > 0 AS listening, n AS n_light, round(mean_lux, 4) AS mean_lux, round(max_lux, 4) AS max_lux, round(min_lux, 4) AS min_lux FROM spine LEFT JOIN m USING (pid, hour) LEFT JOIN li USING (pid, hour)""",
)
@events_of
def music_and_light(ev):
    """A08, A09, P27."""
    plays = ev.where("event_type = 'signup'").select("pid", "ms", (F.col("k") % 4 == 0).alias("advert"), (F.col("k") % 19 == 0).alias("missing"))
    lux = H.light(ev.where("event_type = 'error'").select("pid", "ms", (F.col("value") * 3).alias("lux"))).withColumnRenamed("n", "n_light")
    return rounded(H.listening(plays).join(lux, ["pid", "hour"], "left"))


@query(
    "a10_j08_hour_zones",
    f"""WITH {B.EV}, c AS (SELECT pid, ms // 3600000 AS hour, zone, count(*) AS n FROM ev GROUP BY ALL) SELECT pid, hour, zone FROM (SELECT *, row_number() OVER (PARTITION BY pid, hour ORDER BY n DESC, zone) AS t FROM c) WHERE t = 1""",
)
@events_of
def hour_zones(ev):
    """A10, J08."""
    return H.hour_zone(ev)


@query(
    "a03_label_entropy",
    f"""WITH {B.EV}, c AS (SELECT pid, ms // 3600000 AS hour, event_type, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT pid, hour, sum(n) AS a FROM c GROUP BY ALL)
    SELECT pid, hour, round(sum(-(n / a) * log2(n / a)), 4) + 0.0 AS entropy FROM c JOIN t USING (pid, hour) GROUP BY ALL""",
)
@events_of
def label_entropy(ev):
    """A03, over labels."""
    return rounded(H.label_entropy(ev.withColumn("hour", T.hour_of(F.col("ms"))), ["pid", "hour"], "event_type"))


@query(
    "p32_j06_missing_reasons",
    f"""WITH {B.EV}, {B.MOTIONS}, {MOTION_HOURS}, ob AS (SELECT pid, hour, coverage FROM mh WHERE coverage > 0)
    SELECT pid, hour, CASE WHEN pid % 3 = 2 THEN 'STRUCTURAL' WHEN ob.coverage >= 0.5 THEN 'OBSERVED' WHEN ob.coverage IS NOT NULL THEN 'DEVICE' ELSE 'PARTICIPANT' END AS reason FROM mh LEFT JOIN ob USING (pid, hour)""",
)
@events_of
def missing_reasons(ev):
    """P32, J06."""
    hours = H.motion_minutes(I.to_intervals(B.motions(ev))).select("pid", "hour", "coverage")
    return H.missing_reason(hours.select("pid", "hour"), hours.where("coverage > 0"), F.col("pid") % 3 == 2).select("pid", "hour", "reason")


@query(
    "e01_e03_distinct_events",
    f"""WITH {B.EV}, {B.SCREENS}, {B.MOTIONS}, a AS (SELECT 'screen' AS stream, pid, ms + {OFFSET} * 60000 AS local_ms, state AS what, tie FROM sc UNION ALL SELECT 'motion', pid, ms + {OFFSET} * 60000, category, tie FROM mo)
    SELECT stream, pid, local_ms, what FROM (SELECT *, row_number() OVER (PARTITION BY stream, pid, local_ms ORDER BY tie) AS t FROM a) WHERE t = 1""",
)
@events_of
def distinct_events(ev):
    """E01, E03, P02, W05."""
    one = lambda rows, name, what: H.distinct_events(rows).select(F.lit(name).alias("stream"), "pid", "local_ms", F.col(what).alias("what"))
    return one(B.screens(ev), "screen", "state").unionByName(one(B.motions(ev), "motion", "category"))


_event_case = "CASE " + " ".join(f"WHEN starts_with(app, '{k}') THEN '{v}'" for k, v in C.EVENT_APPS.items()) + " ELSE 'OTHER' END"


@query("e02_app_sessions", f"WITH {B.EV}, {B.WINDOWS}, {LATEST} SELECT pid, app, start_ms, round(least(greatest(foreground_ms / 60000.0, 0), 600), 2) AS minutes, {_event_case} AS category FROM lw")
@events_of
def app_sessions(ev):
    """E02, P15, W05."""
    return H.app_events(B.app_windows(ev))


@query(
    "e04_x04_typing_sessions",
    """SELECT conv_id AS user_id, turn AS ord, CAST(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS BIGINT) AS n_words, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE role <> 'system'""",
)
def typing_sessions(spark, sf_dir):
    """Whole texts, stripped."""
    rows = B.typing(spark, sf_dir).where("not password")
    return rows.select("user_id", "ord", F.size(X.words(F.col("text"))).cast("long").alias("n_words"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


@query("e05_track_plays", f"WITH {B.EV} SELECT pid, ms + {OFFSET} * 60000 AS local_ms, k % 4 = 0 AS advert, event_id FROM ev WHERE event_type = 'signup' AND k % 19 <> 0")
@events_of
def track_plays(ev):
    """E05, P02, P27."""
    return ev.where("event_type = 'signup' and k % 19 <> 0").select("pid", T.local_ms(F.col("ms"), F.col("zone")).alias("local_ms"), (F.col("k") % 4 == 0).alias("advert"), "event_id")


@query(
    "w14_evenly_spaced",
    f"""WITH {B.EV}, {B.PROMPTS}, n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS m FROM pr WINDOW w AS (PARTITION BY user_id ORDER BY ms, prompt_id))
    SELECT user_id, prompt_id FROM n WHERE m <= 4 OR list_contains(list_transform(range(4), lambda j: CAST(floor(j * (m - 1) / 3) AS BIGINT)), i)""",
)
@events_of
def evenly_spaced(ev):
    """W14."""
    return I.evenly_spaced(B.prompts(ev), ["user_id"], 4, F.col("ms"), F.col("prompt_id")).select("user_id", "prompt_id")
