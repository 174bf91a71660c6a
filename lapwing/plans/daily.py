"""Queries for daily tables, rosters, homes and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import times as T
from ..operators import daily as D
from ..operators import hourly as H
from ..operators import intervals as I
from ..sources import bindings as B
from .base import events_of, query, rounded
from .hourly import MOTION_HOURS


@query(
    "a12_a14_motion_days",
    f"""WITH {B.EV}, {B.MOTIONS}, {MOTION_HOURS}, d AS (SELECT pid, hour // 24 AS day, sum(stationary_min) AS s, sum(walking_min) AS w, sum(automotive_min) AS a, count(*) FILTER (walking_min > 1) AS e, least(count(*), 24) AS t FROM mh WHERE coverage >= 0.5 GROUP BY ALL),
    c AS (SELECT *, CASE WHEN s + w + a > 1440 THEN round(s * 1440 / (s + w + a), 1) ELSE s END AS s2, CASE WHEN s + w + a > 1440 THEN round(w * 1440 / (s + w + a), 1) ELSE w END AS w2, CASE WHEN s + w + a > 1440 THEN round(a * 1440 / (s + w + a), 1) ELSE a END AS a2 FROM d)
    SELECT pid, day, round(s2, 3) AS stationary_min, round(w2, 3) AS walking_min, round(a2, 3) AS automotive_min, e AS walking_episodes, t AS tracked_hours,
      CASE WHEN s2 >= w2 AND s2 >= a2 THEN 'stationary' WHEN w2 >= a2 THEN 'walking' ELSE 'automotive' END AS primary_activity FROM c""",
)
@events_of
def motion_days(ev):
    """A12 (motion), A13, A14."""
    return rounded(D.motion_days(H.motion_minutes(I.to_intervals(B.motions(ev)))), 3)


@query(
    "a13_capped_parts",
    f"""WITH {B.EV}, d AS (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN value * 3 ELSE 0.0 END) AS a, sum(CASE WHEN event_type = 'view' THEN value * 3 ELSE 0.0 END) AS b, sum(CASE WHEN event_type = 'error' THEN value * 3 ELSE 0.0 END) AS c FROM ev GROUP BY user_id)
    SELECT user_id, {', '.join(f"round(CASE WHEN a + b + c > 1440 THEN {x} * 1440 / (a + b + c) ELSE {x} END, 1) AS {x}" for x in 'abc')} FROM d""",
)
@events_of
def capped(ev):
    """A13."""
    part = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value") * 3).otherwise(0.0))
    rows = ev.groupBy("user_id").agg(part("click").alias("a"), part("view").alias("b"), part("error").alias("c"))
    return rounded(rows.select("user_id", *(c.alias(n) for n, c in C.capped_parts({n: F.col(n) for n in "abc"}).items())), 1)


@query(
    "a12_a15_a37_signal_days",
    f"""WITH {B.EV}, {B.SIGNALS} SELECT user_id, hour // 24 AS day, modality, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 3) AS total, round(avg(mean), 3) AS mean, bool_or(total > 300) AS busy FROM sg GROUP BY ALL""",
)
@events_of
def signal_days(ev):
    """A12 (other modalities), A15, A37."""
    rows = B.signals(ev).withColumn("day", F.floor(F.col("hour") / 24).cast("long")).withColumn("busy", F.col("total") > 300)
    return rounded(D.rollup(rows, ["user_id", "day", "modality"], ("n", "total"), ("mean",), ("busy",)), 3)


_HOURS = """hd AS (SELECT user_id, ms // 3600000 // 24 AS day, sum(value) FILTER (event_type = 'click') * 3 AS screen_on_min, count(*) FILTER (event_type = 'click' AND k % 3 > 0) AS screen_n_sessions, sum(value) FILTER (event_type <> 'click') * 6 AS app_total_min, sum(value) FILTER (event_type = 'view') * 3 AS app_social_min,
      sum(value) FILTER (event_type = 'error') AS app_comm_min, sum(value) FILTER (k % 2 = 0) AS app_entertainment_min, count(DISTINCT k % 5) FILTER (k % 4 > 0) AS app_n_apps, count(*) FILTER (event_type = 'error' AND k % 2 = 0) AS key_n_sessions, sum(k) FILTER (event_type = 'error') AS key_chars_typed,
      avg(value) FILTER (event_type = 'signup') * 3 AS light_mean_lux, bool_or(k % 10 = 0) AS mus_is_listening, count(*) FILTER (k % 3 = 0) AS mus_n_tracks FROM ev GROUP BY user_id, ms // 3600000)"""


def hourly_rows(ev):
    """One row a user and hour with the columns that the daily rollups take."""
    v, k = F.col("value"), F.col("k")
    of = lambda *kinds: F.col("event_type").isin(*kinds)
    sum_, count = lambda c, x: F.sum(F.when(c, x)), lambda c: F.count_if(c)
    hours = ev.withColumn("hour", T.hour_of(F.col("ms"))).groupBy("user_id", "hour").agg(
        (sum_(of("click"), v) * 3).alias("screen_on_min"), count(of("click") & (k % 3 > 0)).alias("screen_n_sessions"), (sum_(~of("click"), v) * 6).alias("app_total_min"), (sum_(of("view"), v) * 3).alias("app_social_min"),
        sum_(of("error"), v).alias("app_comm_min"), sum_(k % 2 == 0, v).alias("app_entertainment_min"), F.count_distinct(F.when(k % 4 > 0, k % 5)).alias("app_n_apps"), count(of("error") & (k % 2 == 0)).alias("key_n_sessions"),
        sum_(of("error"), k).alias("key_chars_typed"), (F.avg(F.when(of("signup"), v)) * 3).alias("light_mean_lux"), F.bool_or(k % 10 == 0).alias("mus_is_listening"), count(k % 3 == 0).alias("mus_n_tracks"),
    )
    return hours.withColumn("day", F.floor(F.col("hour") / 24).cast("long"))


def _day_query(name: str, work, sql: str) -> None:
    run = events_of(lambda ev: rounded(work(hourly_rows(ev), ["user_id", "day"]), 3))
    run.__doc__ = f"A12: {work.__name__}."
    query(name, f"WITH {B.EV}, {_HOURS} {sql}")(run)


_day_query("a12_screen_days", D.screen_days, "SELECT user_id, day, round(least(coalesce(sum(screen_on_min), 0), 1440), 3) AS screen_total_min, CAST(sum(screen_n_sessions) AS BIGINT) AS screen_n_sessions FROM hd GROUP BY ALL")
_day_query(
    "a12_app_days", D.app_days,
    """, s AS (SELECT user_id, day, coalesce(sum(app_total_min), 0) AS t, coalesce(sum(app_social_min), 0) AS a, coalesce(sum(app_comm_min), 0) AS b, coalesce(sum(app_entertainment_min), 0) AS c, avg(CASE WHEN app_n_apps > 0 THEN app_n_apps END) AS m FROM hd GROUP BY ALL)
    SELECT user_id, day, round(least(t, 1440), 3) AS app_total_min, """ + ", ".join(f"round(CASE WHEN t > 1440 THEN round({x} * 1440 / t, 1) ELSE {x} END, 3) AS app_{n}_min" for x, n in zip("abc", ("social", "comm", "entertainment"))) + ", round(m, 3) AS app_n_apps_mean FROM s",
)
_day_query("a12_keyboard_days", D.keyboard_days, "SELECT user_id, day, CAST(sum(key_n_sessions) AS BIGINT) AS keyboard_n_sessions, CAST(coalesce(sum(key_chars_typed), 0) AS BIGINT) AS keyboard_total_chars FROM hd WHERE key_n_sessions > 0 GROUP BY ALL")
_day_query("a12_light_days", D.light_days, "SELECT user_id, day, round(avg(light_mean_lux), 3) AS light_mean_lux_raw, CASE WHEN avg(light_mean_lux) < 10 THEN 'dark' WHEN avg(light_mean_lux) < 500 THEN 'indoor' ELSE 'outdoor' END AS light_category FROM hd WHERE light_mean_lux IS NOT NULL GROUP BY ALL")
_day_query("a12_music_days", D.music_days, "SELECT user_id, day, true AS music_listening, CAST(sum(mus_n_tracks) AS BIGINT) AS music_n_tracks FROM hd WHERE mus_is_listening GROUP BY ALL")


KINDS = ("click", "view", "purchase", "error", "signup")


@query(
    "a11_roster",
    f"""WITH {B.EV} SELECT pid, {', '.join(f"bool_or(event_type = '{k}') AS has_{k}" for k in KINDS)}, min(CASE WHEN user_id % 3 <> 0 THEN 'ios' ELSE 'android' END) AS platform, min(ms // 86400000) AS first_day, max(ms // 86400000) AS last_day, max(ms // 86400000) - min(ms // 86400000) + 1 AS study_days FROM ev GROUP BY pid""",
)
@events_of
def roster(ev):
    """A11."""
    files = ev.select("pid", F.col("event_type").alias("modality"), F.when(F.col("user_id") % 3 != 0, "ios").otherwise("android").alias("platform"), T.day_of(F.col("ms")).alias("day"))
    return D.roster(files)


@query("a35_homes")
@events_of
def homes(ev):
    """Density clusters of night fixes (tests compare with brute force)."""
    local = T.local_ms(F.col("ms"), F.col("zone"))
    night = ev.where(T.is_night(T.clock_hour(local)))
    k, v = F.col("k"), F.col("value")
    fixes = night.select("pid", F.col("event_id").alias("fix_id"), (40 + (k % 2) * 0.01 + v / 1e6).alias("lat"), F.when(k % 19 == 0, -74 + v / 1000).otherwise(-74.0).alias("lon"))
    return rounded(D.homes(fixes), 6)


@query(
    "k01_top_apps",
    """WITH s AS (SELECT o_custkey AS participant, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, l_partkey, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY participant, day ORDER BY q DESC, l_partkey) AS t FROM s)
    SELECT participant, day, sum(q) AS total, string_agg(CAST(l_partkey AS VARCHAR) || ':' || CAST(CAST(q AS BIGINT) AS VARCHAR), ',' ORDER BY t) FILTER (t <= 5) AS top FROM r GROUP BY participant, day""",
)
def top_apps(spark, sf_dir):
    """K01."""
    o, li = B.read(spark, sf_dir, "orders"), B.read(spark, sf_dir, "lineitem")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long")
    rows = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("participant"), day.alias("day"), "l_partkey", "l_quantity")
    return D.top_list(rows, ["participant", "day"], F.col("l_partkey"), F.col("l_quantity"))


@query(
    "j01_daily_alignment",
    f"""WITH {B.DAILY}, p AS (SELECT o_orderkey AS prompt_id, o_custkey AS participant, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders)
    SELECT prompt_id, p.participant, p.day, round(s.quantity, 2) AS same_quantity, round(y.quantity, 2) AS earlier_quantity FROM p LEFT JOIN da s ON s.participant = p.participant AND s.day = p.day LEFT JOIN da y ON y.participant = p.participant AND y.day = p.day - 1""",
)
def daily_alignment(spark, sf_dir):
    """Of the same day, and of the day before (which looks at the past only)."""
    days = B.daily_orders(spark, sf_dir).withColumn("tie", F.lit(0))
    prompts = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prompt_id"), F.col("o_custkey").alias("participant"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"))
    same = D.align_days(prompts, days).select("prompt_id", "participant", "day", F.col("quantity").alias("same_quantity"))
    earlier = D.align_days(prompts, days, 1).select("prompt_id", F.col("quantity").alias("earlier_quantity"))
    return rounded(same.join(earlier, "prompt_id"), 2)


@query(
    "p23_traits",
    """SELECT c_custkey, c_acctbal, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'home' WHEN 'MACHINERY' THEN 'work' ELSE 'other' END AS segment, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def traits(spark, sf_dir):
    """Code map and a small lookup."""
    c, n = B.read(spark, sf_dir, "customer"), B.read(spark, sf_dir, "nation")
    segment = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "home").when(F.col("c_mktsegment") == "MACHINERY", "work").otherwise("other")
    # one row a nation: bounded by the world
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "c_acctbal", segment.alias("segment"), F.col("n_name").alias("nation"))


@query(
    "a31_a32_k03_selection",
    f"""WITH {B.EV}, u AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n, count(DISTINCT ms // 86400000) FILTER (event_type = 'click') * 1.0 / count(DISTINCT ms // 86400000) AS coverage, count(DISTINCT event_type) AS sensors, min(user_id % 5 + 1) AS fold, user_id % 2 = 0 AS has_doc FROM ev GROUP BY user_id),
    s AS (SELECT *, 0.3 * n / (SELECT max(n) FROM u) + 0.4 * coverage + 0.2 * sensors / 8 + 0.1 * CAST(has_doc AS INT) AS score FROM u)
    SELECT user_id, n, fold, round(coverage, 4) AS coverage, round(score, 4) AS score FROM s ORDER BY score DESC, user_id LIMIT 20""",
)
@events_of
def selection(ev):
    """The best twenty users (the limit is the operator)."""
    day = T.day_of(F.col("ms"))
    users = ev.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("n"), (F.count_distinct(F.when(F.col("event_type") == "click", day)) / F.count_distinct(day)).alias("coverage"),
        F.count_distinct("event_type").alias("sensors"), F.min(F.col("user_id") % 5 + 1).alias("fold"),
    ).withColumn("has_doc", F.col("user_id") % 2 == 0)
    best = D.selection_scores(users).orderBy(F.col("score").desc(), "user_id").limit(20)
    return rounded(best.select("user_id", "n", "fold", "coverage", "score"))


@query(
    "j12_a29_complete_runs",
    f"""WITH {B.EV}, h AS (SELECT user_id, count(*) AS n, avg(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END) AS empty_share FROM ev GROUP BY user_id), x AS (SELECT user_id, count(*) * 5 AS expected FROM ev WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT user_id, n, n >= 0.95 * expected AS complete, n >= 10 AND empty_share <= 0.05 AS good FROM h JOIN x USING (user_id) WHERE n <= 1.5 * expected""",
)
@events_of
def complete_runs(ev):
    """J12, A29."""
    expected = ev.where("event_type = 'purchase'").groupBy("user_id").agg((F.count("*") * 5).alias("expected"))
    runs = D.complete_runs(ev, expected, ["user_id"])
    empty = ev.groupBy("user_id").agg(F.avg(F.when(F.col("value") < 5, 1.0).otherwise(0.0)).alias("e"))
    return runs.join(empty, "user_id").select("user_id", "n", "complete", ((F.col("n") >= 10) & (F.col("e") <= 0.05)).alias("good"))


@query(
    "u01_u03_sets",
    f"""WITH {B.EV}, a AS (SELECT user_id FROM ev WHERE event_type = 'click' UNION SELECT user_id FROM ev WHERE event_type = 'view'), pilot AS (SELECT user_id FROM ev WHERE event_type = 'signup' AND k > 90),
    days AS (SELECT user_id, ms // 86400000 AS day FROM ev WHERE event_type = 'purchase' INTERSECT SELECT user_id, ms // 86400000 FROM ev WHERE event_type = 'click')
    SELECT user_id, coalesce(n, 0) AS shared_days FROM (SELECT user_id FROM a EXCEPT SELECT user_id FROM pilot) LEFT JOIN (SELECT user_id, count(*) AS n FROM days GROUP BY user_id) USING (user_id)""",
)
@events_of
def sets(ev):
    """Union, difference, intersection, semi join."""
    of = lambda kind: ev.where(F.col("event_type") == kind)
    ids = of("click").select("user_id").unionByName(of("view").select("user_id")).distinct()
    rest = ids.subtract(of("signup").where("k > 90").select("user_id"))
    day = T.day_of(F.col("ms")).alias("day")
    shared = of("purchase").select("user_id", day).intersect(of("click").select("user_id", day)).groupBy("user_id").agg(F.count("*").alias("shared_days"))
    return rest.join(shared, "user_id", "left").na.fill(0, ["shared_days"])
