"""Queries for point-in-time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import times as T
from ..operators import pit as P
from ..sources import bindings as B
from .base import events_of, query, rounded

CLICKS = "bi AS (SELECT user_id, hour, n, total, mean FROM sg WHERE modality = 'click')"
TOD = "CASE WHEN {0} % 24 < 5 THEN 'night' WHEN {0} % 24 < 12 THEN 'morning' WHEN {0} % 24 < 18 THEN 'afternoon' ELSE 'evening' END"
BASE = f"""WITH {B.EV}, {B.PROMPTS}, {B.SIGNALS}, {CLICKS}"""
BASELINE = f"""bl0 AS (SELECT p.prompt_id, p.user_id, p.value, b.hour, b.total FROM pr p LEFT JOIN bi b ON b.user_id = p.user_id AND {TOD.format('b.hour')} = {TOD.format('(p.ms // 3600000)')} AND b.hour * 3600 <= p.ms // 1000 - 3600),
    bl1 AS (SELECT prompt_id, user_id, any_value(value) AS value, count(total) AS n, avg(total) AS mean, coalesce(stddev_samp(total), 0) AS sd, max(hour) AS seen FROM bl0 GROUP BY ALL),
    bl2 AS (SELECT x.prompt_id, avg(x.total) AS week_mean FROM bl0 x JOIN bl1 y USING (prompt_id) WHERE x.hour * 3600 >= y.seen * 3600 - 7 * 86400 + 1 GROUP BY ALL),
    bl AS (SELECT prompt_id, user_id, n, mean, CASE WHEN n > 0 THEN sd END AS sd, CASE WHEN n > 0 THEN (value - mean) / greatest(sd, 1e-6) END AS z, week_mean FROM bl1 LEFT JOIN bl2 USING (prompt_id))"""
PHRASE = """CASE WHEN z IS NULL THEN NULL WHEN abs(z) < 0.5 THEN 'within typical range' WHEN abs(z) < 1 THEN CASE WHEN z > 0 THEN 'slightly elevated' ELSE 'slightly below typical' END WHEN abs(z) < 2 THEN CASE WHEN z > 0 THEN 'elevated' ELSE 'below typical' END
    ELSE CASE WHEN z > 0 THEN 'very elevated' ELSE 'very low' END || ' - ' || CASE WHEN z > 2.5 THEN 'top 1% of your hours' WHEN z > 2.0 THEN 'top 3% of your hours' WHEN z > 1.5 THEN 'top 7% of your hours' WHEN z > 1.0 THEN 'top 16% of your hours' WHEN z < -2.0 THEN 'bottom 3% of your hours' WHEN z < -1.5 THEN 'bottom 7% of your hours' ELSE '' END END"""


def clicks(ev):
    return B.signals(ev).where("modality = 'click'").drop("modality")


@query(
    "w08_lookback_and_baseline",
    f"""{BASE}, {BASELINE}, lb AS (SELECT p.prompt_id, count(b.n) AS hours_seen, coalesce(sum(b.n), 0) AS events_seen, round(sum(b.total), 3) AS total_seen FROM pr p LEFT JOIN bi b ON b.user_id = p.user_id AND b.hour BETWEEN p.ms // 3600000 - 24 AND p.ms // 3600000 - 1 GROUP BY ALL)
    SELECT prompt_id, user_id, hours_seen, CAST(events_seen AS BIGINT) AS events_seen, total_seen, n, round(mean, 3) AS mean, round(sd, 3) AS sd, CASE WHEN sd > 0.001 THEN round(z, 3) END AS z, round(week_mean, 3) AS week_mean, CASE WHEN sd > 0.001 THEN {PHRASE} END AS phrase FROM lb JOIN bl USING (prompt_id)""",
)
@events_of
def lookback_and_baseline(ev):
    """The flagship: J02, J03's predicate P28, W08, P19.  Scores against a deviation of nothing are not shown."""
    prompts, bins = B.prompts(ev), clicks(ev)
    seen = P.lookback(prompts.select("prompt_id", "user_id", "ms"), bins).groupBy("prompt_id").agg(F.count("n").alias("hours_seen"), F.coalesce(F.sum("n"), F.lit(0)).alias("events_seen"), F.sum("total").alias("total_seen"))
    base = P.personal_baseline(prompts, bins, "total")
    sure = F.col("sd") > 0.001
    out = seen.join(base, "prompt_id").withColumn("phrase", F.when(sure, C.z_phrase(F.col("z")))).withColumn("z", F.when(sure, F.col("z")))
    return rounded(out, 3)


@query(
    "j02_lookback_slots",
    f"""{BASE}, s AS (SELECT prompt_id, user_id, unnest(generate_series(ms // 3600000 - 24, ms // 3600000 - 1)) AS hour, ms // 3600000 AS own FROM pr) SELECT prompt_id, hour - own + 24 AS h, n, round(total, 3) AS total FROM s LEFT JOIN bi USING (user_id, hour)""",
)
@events_of
def lookback_slots(ev):
    """J02, P28."""
    return rounded(P.lookback(B.prompts(ev).select("prompt_id", "user_id", "ms"), clicks(ev)).select("prompt_id", "h", "n", "total"), 3)


@query(
    "j03_offset_window",
    f"""{BASE} SELECT prompt_id, b.hour, n, round(total, 3) AS total FROM pr p JOIN bi b ON b.user_id = p.user_id AND b.hour >= (p.ms - 6 * 3600000) // 3600000 AND b.hour * 3600000 < least(p.ms - 2 * 3600000, p.ms) AND (b.hour + 1) * 3600000 <= p.ms""",
)
@events_of
def offset_window(ev):
    """J03, P28."""
    return rounded(P.offset_window(B.prompts(ev), clicks(ev), 6, 4, ["prompt_id"]).select("prompt_id", "hour", "n", "total"), 3)


@query(
    "j04_today_and_yesterday",
    f"""{BASE} SELECT prompt_id, p.user_id, CAST(sum(n) FILTER (hour // 24 = ms // 86400000) AS BIGINT) AS today_n, CAST(sum(n) FILTER (hour // 24 = ms // 86400000 - 1) AS BIGINT) AS yesterday_n, round(sum(total) FILTER (hour // 24 = ms // 86400000), 3) AS today_total, round(sum(total) FILTER (hour // 24 = ms // 86400000 - 1), 3) AS yesterday_total
    FROM pr p LEFT JOIN bi b ON b.user_id = p.user_id AND b.hour // 24 BETWEEN ms // 86400000 - 1 AND ms // 86400000 AND (b.hour + 1) * 3600000 <= ms GROUP BY ALL""",
)
@events_of
def today_and_yesterday(ev):
    """J04."""
    return rounded(P.before_and_yesterday(B.prompts(ev), clicks(ev), ["n", "total"]), 3)


@query(
    "w09_daily_baseline",
    f"""WITH {B.DAILY}, w AS (SELECT *, count(quantity) OVER f AS n, avg(quantity) OVER f AS mean, coalesce(stddev_samp(quantity) OVER f, 0) AS sd, list(quantity) OVER f AS past FROM da WINDOW f AS (PARTITION BY participant ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING))
    SELECT participant, day, n, round(mean, 3) AS mean, round(sd, 3) AS sd, round(CASE WHEN sd > 0 THEN (quantity - mean) / sd ELSE 0 END, 3) AS z, round(len(list_filter(past, lambda q: q < quantity)) / n, 3) AS below FROM w WHERE n >= 2""",
)
def daily_baseline(spark, sf_dir):
    """W09 (two earlier days here: the daily table is thin)."""
    return rounded(P.daily_baseline(B.daily_orders(spark, sf_dir), "quantity", least=2), 3)


YES = "CASE WHEN desire >= 5 AND available = 'yes' THEN 1.0 ELSE 0.0 END"


@query(
    "a20_receptivity_history",
    f"""WITH {B.EV}, {B.PROMPTS}, t AS (SELECT *, {TOD.format('(ms // 3600000)')} AS tod, {YES} AS yes FROM pr)
    SELECT a.prompt_id, count(b.yes) AS n, round(avg(b.yes), 4) AS rate, round(avg(b.yes) FILTER (b.tod = a.tod), 4) AS rate_tod FROM t a LEFT JOIN t b ON b.user_id = a.user_id AND b.ms BETWEEN a.ms - 14 * 86400000 AND a.ms - 1 GROUP BY a.prompt_id""",
)
@events_of
def receptivity_history(ev):
    """A20."""
    return rounded(P.history(B.prompts(ev)))


@query(
    "a21_profiles",
    f"""WITH {B.EV}, {B.PROMPTS} SELECT prompt_id, count(*) OVER w AS n, round(avg({YES}) OVER w, 4) AS receptive, round(avg(CAST(desire >= 5 AS INT)) OVER w, 4) AS desire_share, round(avg(CAST(available = 'yes' AS INT)) OVER w, 4) AS available_share,
      CASE WHEN count(*) OVER w >= 3 THEN round(avg(CAST(state AS INT)) OVER w, 4) END AS state_rate, CASE WHEN count(*) OVER w >= 3 THEN round(avg(CASE WHEN (ms // 3600000) % 24 < 12 THEN CAST(state AS INT) END) OVER w, 4) END AS morning_rate
    FROM pr WINDOW w AS (PARTITION BY user_id ORDER BY ms, prompt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
@events_of
def profiles(ev):
    """A21, from earlier prompts only."""
    return rounded(P.profile(B.prompts(ev)))


_TAKEN = "(desire >= 5 AND available = 'yes')"
_SLOT = "CASE WHEN (ms // 3600000) % 24 < 12 THEN 'morning' WHEN (ms // 3600000) % 24 < 17 THEN 'afternoon' ELSE 'evening' END"
_DIARY = "CASE WHEN prompt_id % 3 > 0 THEN 'diary ' || prompt_id END"


@query(
    "a21_profile_details",
    f"""WITH {B.EV}, {B.PROMPTS}, t AS (SELECT *, {_TAKEN} AS taken, {_SLOT} AS slot, {_DIARY} AS diary FROM pr)
    SELECT prompt_id, count(*) OVER w AS n, round(CASE WHEN count(*) FILTER (NOT taken) OVER w > 0 THEN count(*) FILTER (desire < 5) OVER w / count(*) FILTER (NOT taken) OVER w END, 4) AS no_desire, round(CASE WHEN count(*) FILTER (NOT taken) OVER w > 0 THEN 1 - count(*) FILTER (desire < 5) OVER w / count(*) FILTER (NOT taken) OVER w END, 4) AS unavailable,
      {', '.join(f"count(*) FILTER (slot = '{x}') OVER w AS {x}_n, round(CASE WHEN count(*) FILTER (slot = '{x}') OVER w >= 3 THEN avg(CAST(taken AS INT)) FILTER (slot = '{x}') OVER w END, 4) AS {x}_rate" for x in ('morning', 'afternoon', 'evening'))},
      {', '.join(f"CASE WHEN count(diary) OVER w >= 5 AND count(CASE WHEN {c} THEN diary END) OVER w >= 2 THEN (list_filter(list(CASE WHEN {c} THEN diary END) OVER w, lambda d: d IS NOT NULL))[{i}] END AS {x}_diary_{i}" for x, c in (('receptive', 'taken'), ('other', 'NOT taken')) for i in (1, 2))}
    FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ms, prompt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
@events_of
def profile_details(ev):
    """Why not, when, and in whose words, from earlier prompts only."""
    diary = F.when(F.col("prompt_id") % 3 > 0, F.concat(F.lit("diary "), F.col("prompt_id")))
    return rounded(P.profile_details(B.prompts(ev).withColumn("diary", diary)))


@query(
    "w10_running_features",
    f"""WITH {B.EV}, {B.PROMPTS}, g AS (SELECT t.f AS fold, avg(value) AS m, stddev_pop(value) AS s FROM pr JOIN (SELECT unnest(range(1, 6)) AS f) t ON pr.fold <> t.f GROUP BY t.f), r AS (SELECT *, count(*) OVER p AS n, avg(value) OVER p AS pm, stddev_pop(value) OVER p AS ps, coalesce(avg(CAST(desire >= 5 AS INT)) OVER t, 0) AS d10, coalesce(avg(CAST(available = 'yes' AS INT)) OVER t, 0) AS a10, coalesce(avg({YES}) OVER t, 0) AS j10
      FROM pr WINDOW p AS (PARTITION BY user_id ORDER BY ms, prompt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (PARTITION BY user_id ORDER BY ms, prompt_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT prompt_id, round(CASE WHEN n >= 3 THEN (value - pm) / (ps + 1e-8) ELSE (value - m) / (s + 1e-8) END, 4) AS deviation, round(least(n / 20.0, 1), 4) AS volume, round(d10, 4) AS desire_rate, round(a10, 4) AS available_rate, round(j10, 4) AS joint_rate FROM r JOIN g USING (fold)""",
)
@events_of
def running_features(ev):
    """W10."""
    return rounded(P.running_personal(B.prompts(ev)))


@query(
    "w12_last_prompts",
    f"""WITH {B.EV}, {B.PROMPTS}, asks AS (SELECT DISTINCT user_id, ms // 86400000 AS ask_day FROM ev WHERE event_type = 'signup'), m AS (SELECT a.user_id, ask_day, prompt_id, state, desire, row_number() OVER (PARTITION BY a.user_id, ask_day ORDER BY ms DESC, prompt_id DESC) AS turn FROM asks a JOIN pr p ON p.user_id = a.user_id AND p.ms // 86400000 < ask_day)
    SELECT user_id, ask_day, turn, prompt_id, concat_ws(',', CASE WHEN state THEN 'state' END, CASE WHEN desire >= 5 THEN 'desire' END) AS raised FROM m WHERE turn <= 5""",
)
@events_of
def last_prompts(ev):
    """W12."""
    asks = ev.where("event_type = 'signup'").select("user_id", T.day_of(F.col("ms")).alias("ask_day")).distinct()
    return P.last_prompts(B.prompts(ev), asks).withColumn("turn", F.col("turn").cast("long"))


@query(
    "k02_first_events",
    f"""WITH {B.EV}, {B.PROMPTS}, m AS (SELECT prompt_id, e.event_id, row_number() OVER (PARTITION BY prompt_id ORDER BY e.ms, e.event_id) AS turn, greatest(count(*) OVER (PARTITION BY prompt_id) - 3, 0) AS more FROM pr p JOIN ev e ON e.user_id = p.user_id AND e.ms >= p.ms - 48 * 3600000 AND e.ms < p.ms)
    SELECT prompt_id, turn, event_id, more FROM m WHERE turn <= 3""",
)
@events_of
def first_events(ev):
    """The first three events of two days before (the limit is the operator)."""
    return rounded(P.first_events(B.prompts(ev), ev, 48, 3))


@query(
    "a19_sleep_hours",
    f"""{BASE}, s AS (SELECT prompt_id, total FROM pr p JOIN bi b ON b.user_id = p.user_id AND b.hour BETWEEN p.ms // 3600000 - 24 AND p.ms // 3600000 - 1 AND b.hour // 24 = p.ms // 86400000 AND b.hour % 24 < 8), l AS (SELECT prompt_id, quantile_cont(total, 0.25) AS low FROM s GROUP BY prompt_id)
    SELECT prompt_id, count(*) FILTER (total <= low) AS sleep_hours, count(*) AS n FROM s JOIN l USING (prompt_id) GROUP BY prompt_id""",
)
@events_of
def sleep_hours(ev):
    """A19."""
    return P.sleep_bins(B.prompts(ev), clicks(ev), "total")
