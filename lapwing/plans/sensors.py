"""Queries for the features of nine sensors in the window before each prompt."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import pit as P
from ..operators import sensors as S
from ..sources import bindings as B
from .base import query, rounded

#: hours before a prompt
SPAN = 72

#: sensor -> (which events, columns); the texts are SQL for both engines
ROWS = {
    "accelerometer": ("true", {"accel_x": "value / 100", "accel_y": "CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k - 50 AS DOUBLE) / 100 END", "accel_z": "CAST(k AS DOUBLE) / 80"}),
    "gps": ("event_type <> 'signup'", {"distance_km": "value / 40", "gps_at_home_min": "CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k AS DOUBLE) / 2 END", "speed_kmh": "value / 3", "location_label": "CASE WHEN k % 11 = 0 THEN NULL ELSE k % 4 END", "dist_from_home_km": "CAST(k AS DOUBLE) / 10"}),
    "sleep": ("event_type IN ('view', 'error')", {"is_sleep": "CAST(k % 2 AS DOUBLE)", "accel_mean_mag": "value / 200"}),
    "screen": ("event_type = 'click'", {"screen_on_min": "value / 4", "n_sessions": "k % 5", "app_social_min": "CASE WHEN k % 2 = 0 THEN value / 9 END"}),
    "app_usage": ("event_type IN ('click', 'view')", {"amt_foreground_day_sec": "value * 7", "category": "CASE k % 4 WHEN 0 THEN 'Social Media' WHEN 1 THEN 'COMMUNICATION' WHEN 2 THEN 'other' END"}),
    "motion": ("event_type <> 'purchase'", {"stationary_min": "CAST(k AS DOUBLE) / 2", "motion_walking_min": "value / 10", "running_min": "CASE WHEN k % 5 = 0 THEN value / 30 END", "coverage_pct": "CAST(k AS DOUBLE)"}),
    "keyboard": ("event_type = 'error'", {"chars_typed": "k * 3", "n_word_day_allapps": "k", "prop_neg": "CAST(k AS DOUBLE) / 400", "key_prop_pos": "CASE WHEN k % 2 = 1 THEN CAST(100 - k AS DOUBLE) / 400 END"}),
    "music": ("event_type IN ('view', 'signup')", {"is_listening": "CASE WHEN k % 5 > 0 THEN k % 7 = 0 END", "mus_n_tracks": "k % 9"}),
    "light": ("event_type = 'signup'", {"lux": "value * 2", "mean_lux": "CASE WHEN k % 6 > 0 THEN value END"}),
}
_MAG = "sqrt(accel_x * accel_x + coalesce(accel_y * accel_y, 0) + accel_z * accel_z)"
_ENTROPY = "(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM unnest(list(location_label) FILTER (location_label IS NOT NULL)) t(l) GROUP BY l))"
#: the same features written out
SELECTS = {
    "accelerometer": f"avg({_MAG}) AS accel_mean_mag, stddev_samp({_MAG}) AS accel_std_mag, CAST(count(*) FILTER (abs({_MAG} - 1) > 0.1) AS DOUBLE) AS accel_activity_counts, avg(CASE WHEN accel_x IS NULL THEN 0.0 ELSE 1.0 END) * 100 AS accel_coverage_pct",
    "gps": f"CAST(count(*) AS DOUBLE) AS gps_n_captures, sum(distance_km) AS gps_distance_km, coalesce(sum(gps_at_home_min), 0.0) AS gps_at_home_min, max(speed_kmh) AS gps_speed_max_kmh, max(dist_from_home_km) AS gps_dist_from_home_max_km, {_ENTROPY} AS gps_location_entropy",
    "sleep": "sum(is_sleep) AS sleep_duration_min, avg(accel_mean_mag) AS sleep_movement_mean",
    "screen": "sum(screen_on_min) AS screen_on_min, CAST(sum(n_sessions) AS DOUBLE) AS screen_n_sessions, coalesce(sum(app_social_min), 0.0) AS app_social_min",
    "app_usage": "sum(amt_foreground_day_sec) / 60 AS app_total_min, sum(amt_foreground_day_sec) FILTER (category = 'Social Media') / 60 AS app_social_min, sum(amt_foreground_day_sec) FILTER (category = 'COMMUNICATION') / 60 AS app_comm_min",
    "motion": "sum(stationary_min) AS motion_stationary_min, sum(motion_walking_min) AS motion_walking_min, coalesce(sum(running_min), 0.0) AS motion_running_min, sum(motion_walking_min) + coalesce(sum(running_min), 0.0) AS motion_active_min, avg(coverage_pct) AS motion_coverage_pct",
    "keyboard": "CAST(sum(chars_typed) AS DOUBLE) AS key_chars_typed, CAST(sum(n_word_day_allapps) AS DOUBLE) AS key_words_typed, avg(prop_neg) AS key_prop_neg, avg(key_prop_pos) AS key_prop_pos",
    "music": "coalesce(bool_or(is_listening), false) AS mus_is_listening, CAST(sum(mus_n_tracks) AS DOUBLE) AS mus_n_tracks",
    "light": "avg(mean_lux) AS light_mean_lux",
}
NAMES = {sensor: [f.name for f in S.CATALOGUE[sensor]] for sensor in ROWS}


def sensor_rows(ev, sensor: str):
    """(user_id, hour, columns) of one sensor."""
    which, columns = ROWS[sensor]
    return ev.where(which).select("user_id", T.hour_of(F.col("ms")).alias("hour"), *(F.expr(e).alias(c) for c, e in columns.items()))


def _sql(sensor: str) -> str:
    which, columns = ROWS[sensor]
    shown = [n for n in NAMES[sensor] if f" AS {n}" in SELECTS[sensor]]
    rounds = ", ".join(n if n == "mus_is_listening" else f"round({n}, 3) AS {n}" for n in shown)
    return f"""WITH {B.EV}, {B.PROMPTS}, s AS (SELECT user_id, ms // 3600000 AS hour, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM ev WHERE {which}),
    f AS (SELECT prompt_id, {SELECTS[sensor]} FROM pr p JOIN s ON s.user_id = p.user_id AND s.hour BETWEEN p.ms // 3600000 - {SPAN} AND p.ms // 3600000 - 1 GROUP BY prompt_id) SELECT prompt_id, {rounds} FROM f"""


def _register(sensor: str) -> None:
    def work(spark, sf_dir):
        ev = B.events(spark, sf_dir)
        slots = P.lookback_slots(B.prompts(ev).select("prompt_id", "user_id", "ms"), SPAN).select("prompt_id", "user_id", "hour")
        return rounded(S.features(slots.join(sensor_rows(ev, sensor), ["user_id", "hour"]).drop("user_id", "hour"), ["prompt_id"], sensor), 3)

    work.__doc__ = f"A16: {sensor} in the {SPAN} hours before each prompt."
    query(f"a16_{sensor}", _sql(sensor))(work)


for _sensor in ROWS:
    _register(_sensor)
