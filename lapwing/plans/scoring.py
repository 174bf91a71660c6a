"""Queries for metrics, forecasts, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import metrics as M
from ..sources import bindings as B
from .base import events_of, query, rounded

PRED = f"WITH {B.DIARY}, pd AS (SELECT doc_id, user_, fold, quality = 1 AS y, n_chars > 1500 AS p, n_chars / 100.0 AS score, CAST(quality AS DOUBLE) * 20 AS yc FROM di WHERE quality IS NOT NULL)"


def predictions(spark, sf_dir):
    rows = B.diary(spark, sf_dir).where("quality is not null")
    return rows.select("doc_id", "user", "fold", (F.col("quality") == 1).alias("y"), (F.col("n_chars") > 1500).alias("p"), (F.col("n_chars") / 100).alias("score"), (F.col("quality") * 20.0).alias("yc"))


@query("a24_regression", f"{PRED} SELECT fold, count(*) AS n, round(avg(abs(yc - score)), 3) AS mae, round(avg(yc), 3) AS mean_truth, round(avg(score), 3) AS mean_guess, round(stddev_pop(yc), 3) AS sd_truth, round(stddev_pop(score), 3) AS sd_guess FROM pd GROUP BY fold HAVING count(*) >= 2")
def regression(spark, sf_dir):
    """A24."""
    return rounded(M.regression(predictions(spark, sf_dir), ["fold"], "yc", "score"), 3)


COUNTS = "count(*) AS n, count(*) FILTER (y AND {0}) AS tp, count(*) FILTER (NOT y AND {0}) AS fp, count(*) FILTER (y AND NOT {0}) AS fn, count(*) FILTER (NOT y AND NOT {0}) AS tn"
SCORES = """n, tp, fp, fn, tn, round((tp + fn) / n, 4) AS prevalence, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 4) AS balanced_accuracy, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1,
    round((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2, 4) AS macro_f1"""


@query("a25_classification", f"{PRED}, c AS (SELECT fold, {COUNTS.format('p')} FROM pd GROUP BY fold) SELECT fold, {SCORES} FROM c WHERE n >= 2 AND tp + fn > 0 AND tn + fp > 0")
def classification(spark, sf_dir):
    """A25."""
    return rounded(M.classification(predictions(spark, sf_dir), ["fold"]))


@query(
    "a26_auc",
    f"""{PRED}, r AS (SELECT fold, y, rank() OVER w + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS rk FROM pd WINDOW w AS (PARTITION BY fold ORDER BY score))
    SELECT fold, round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 4) AS auc FROM r GROUP BY fold HAVING count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0""",
)
def auc(spark, sf_dir):
    """A26."""
    return rounded(M.auc(predictions(spark, sf_dir), ["fold"], "y", "score"))


@query(
    "a27_personal_threshold",
    f"""{PRED}, s AS (SELECT user_, count(*) AS k, avg(score) AS m, stddev_samp(score) AS sd FROM pd GROUP BY user_ HAVING count(*) >= 3 AND stddev_samp(score) >= 1e-6), h AS (SELECT 'all' AS target, y, score > m + sd AS high FROM pd JOIN s USING (user_)), c AS (SELECT target, {COUNTS.format('high')} FROM h GROUP BY target) SELECT target, {SCORES} FROM c""",
)
def personal_threshold(spark, sf_dir):
    """A27."""
    rows = M.personal_threshold(predictions(spark, sf_dir), "user", "score").withColumn("target", F.lit("all"))
    return rounded(M.classification(rows, ["target"], "y", "high"))


@query(
    "a28_over_folds",
    f"""{PRED}, c AS (SELECT fold, {COUNTS.format('p')} FROM pd GROUP BY fold), s AS (SELECT 'length' AS model, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c WHERE tp + fn > 0 AND tn + fp > 0)
    SELECT model, {', '.join(f'round(avg({m}), 4) AS {m}_mean, round(stddev_samp({m}), 4) AS {m}_sd, round(stddev_pop({m}), 4) AS {m}_sd_pop' for m in ('balanced_accuracy', 'f1'))} FROM s GROUP BY model""",
)
def over_folds(spark, sf_dir):
    """A28."""
    rows = M.classification(predictions(spark, sf_dir), ["fold"]).withColumn("model", F.lit("length"))
    return rounded(M.over_folds(rows, ["model"], ["balanced_accuracy", "f1"]))


AR = f"WITH {B.EV}, {B.PROMPTS}, ar AS (SELECT fold, user_id, prompt_id, value, row_number() OVER w AS turn, lag(value) OVER w AS last, avg(value) OVER (PARTITION BY fold, user_id ORDER BY ms, prompt_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling FROM pr WINDOW w AS (PARTITION BY fold, user_id ORDER BY ms, prompt_id))"


@query("w06_w07_forecasts", f"{AR} SELECT prompt_id, turn, last, round(rolling, 4) AS rolling FROM ar")
@events_of
def forecasts(ev):
    """W06, W07."""
    return rounded(M.forecasts(B.prompts(ev)).select("prompt_id", "turn", "last", "rolling"))


@query(
    "m10_ar_evaluation",
    f"""{AR}, s AS (SELECT fold, value, unnest([{{'model': 'last', 'p': last}}, {{'model': 'rolling', 'p': rolling}}]) AS x FROM ar WHERE turn > 1)
    SELECT fold, x.model AS model, count(*) AS n, round(avg(abs(value - x.p)), 3) AS mae, round(avg(CASE WHEN (value > 50) = (x.p > 50) THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM s GROUP BY ALL""",
)
@events_of
def ar_evaluation(ev):
    """Each user's first row is skipped."""
    rows = M.forecasts(B.prompts(ev)).where("turn > 1")
    long = rows.select("fold", "value", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("last", "rolling")))).alias("x")).select("fold", "value", "x.model", "x.p")
    out = long.groupBy("fold", "model").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("value") - F.col("p"))).alias("mae"), F.avg(F.when((F.col("value") > 50) == (F.col("p") > 50), 1.0).otherwise(0.0)).alias("accuracy"))
    return rounded(out.withColumn("mae", F.round(F.col("mae") + 1e-9, 3)))


@query(
    "m11_w11_comparison",
    f"""{AR}, s AS (SELECT fold, value, unnest([{{'model': 'last', 'p': last}}, {{'model': 'rolling', 'p': rolling}}]) AS x FROM ar WHERE turn > 1),
    m AS (SELECT x.model AS model, avg(abs(value - x.p)) AS mae, avg(CASE WHEN (value > 50) = (x.p > 50) THEN 1.0 ELSE 0.0 END) AS accuracy FROM s GROUP BY ALL), l AS (SELECT model, 'mae' AS metric, mae AS value FROM m UNION ALL SELECT model, 'accuracy', accuracy FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'mae' THEN value ELSE -value END, model) AS place FROM l)
    SELECT metric, round(max(value) FILTER (model = 'last'), 3) AS last_value, round(max(value) FILTER (model = 'rolling'), 3) AS rolling_value, max(model) FILTER (place = 1) AS best FROM r GROUP BY metric""",
)
@events_of
def comparison(ev):
    """M11, W11."""
    rows = M.forecasts(B.prompts(ev)).where("turn > 1")
    long = rows.select("value", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("last", "rolling")))).alias("x")).select("value", "x.model", "x.p")
    scores = long.groupBy("model").agg(F.avg(F.abs(F.col("value") - F.col("p"))).alias("mae"), F.avg(F.when((F.col("value") > 50) == (F.col("p") > 50), 1.0).otherwise(0.0)).alias("accuracy"))
    long = scores.select("model", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mae", "accuracy")))).alias("x")).select("model", "x.metric", "x.value")
    placed = M.rankings(long)
    wide = placed.groupBy("metric").agg(*(F.max(F.when(F.col("model") == m, F.col("value"))).alias(f"{m}_value") for m in ("last", "rolling")), F.max(F.when(F.col("place") == 1, F.col("model"))).alias("best"))
    return rounded(wide, 3)


QUART = "CASE WHEN n = 1 THEN v[1] ELSE v[CAST(least(greatest(floor({k} * (n + 1) / 4.0), 1), n - 1) AS BIGINT)] + (v[CAST(least(greatest(floor({k} * (n + 1) / 4.0), 1), n - 1) + 1 AS BIGINT)] - v[CAST(least(greatest(floor({k} * (n + 1) / 4.0), 1), n - 1) AS BIGINT)]) * ({k} * (n + 1) / 4.0 - least(greatest(floor({k} * (n + 1) / 4.0), 1), n - 1)) END"


@query(
    "a30_usage_statistics",
    f"""WITH {B.EV}, c AS (SELECT event_type, user_id, count(*) AS calls FROM ev GROUP BY ALL), g AS (SELECT event_type, count(*) AS n, list(CAST(calls AS DOUBLE) ORDER BY calls) AS v, avg(calls) AS mean, min(calls) AS least, max(calls) AS most FROM c GROUP BY event_type)
    SELECT event_type, n, round(mean, 4) AS mean, {', '.join(f"round({QUART.format(k=k)}, 4) AS {name}" for k, name in ((1, 'q1'), (2, 'median'), (3, 'q3')))}, least, most, 0.0 AS zero_share FROM g""",
)
@events_of
def usage_statistics(ev):
    """Quartiles by the exclusive method."""
    calls = ev.groupBy("event_type", "user_id").agg(F.count("*").alias("calls"))
    return rounded(M.exclusive_quartiles(calls, ["event_type"], "calls").drop("sd"))


@query(
    "a30_usage_histogram",
    f"""WITH {B.EV}, c AS (SELECT event_type, user_id % 7 AS person, count(*) FILTER (k < 40) AS calls FROM ev GROUP BY event_type, user_id), h AS (SELECT event_type, string_agg(CAST(calls AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY calls) AS histogram FROM (SELECT event_type, calls, count(*) AS n FROM c GROUP BY ALL) GROUP BY event_type),
    u AS (SELECT event_type, count(*) AS n_users, avg(m) AS user_mean FROM (SELECT event_type, person, avg(calls) AS m FROM c GROUP BY ALL) GROUP BY event_type), g AS (SELECT event_type, count(*) AS n, list(CAST(calls AS DOUBLE) ORDER BY calls) AS v, avg(calls) AS mean, stddev_samp(calls) AS sd, min(calls) AS least, max(calls) AS most, avg(CASE WHEN calls = 0 THEN 1 ELSE 0 END) AS zero_share FROM c GROUP BY event_type)
    SELECT event_type, n, round(mean, 4) AS mean, round(sd, 4) AS sd, {', '.join(f"round({QUART.format(k=k)}, 4) AS {name}" for k, name in ((1, 'q1'), (2, 'median'), (3, 'q3')))}, least, most, round(zero_share, 4) AS zero_share, histogram, n_users, round(user_mean, 4) AS user_mean FROM g JOIN h USING (event_type) JOIN u USING (event_type)""",
)
@events_of
def usage_histogram(ev):
    """Quartiles, deviation, share of zeros, histogram and means by person."""
    calls = ev.groupBy("event_type", "user_id").agg(F.count_if(F.col("k") < 40).alias("calls")).withColumn("person", F.col("user_id") % 7)
    return rounded(M.usage_by_key(calls, ["event_type"], "person", "calls"))


SAYINGS = ("license", "copyright", "password")


@query(
    "a30_availability_classes",
    """SELECT source, CASE WHEN contains(text, 'token') THEN 'max_turns_hit' WHEN regexp_matches(lower(text), 'license|copyright|password') THEN 'tools_unavailable' ELSE 'tools_attempted_or_single_turn' END AS class, count(*) AS n FROM documents GROUP BY ALL""",
)
def availability_classes(spark, sf_dir):
    """Classes of texts by what they say (other sayings than the traces', which the given texts do not hold)."""
    docs = B.read(spark, sf_dir, "documents")
    return docs.groupBy("source", M.availability(F.col("text"), SAYINGS, "token").alias("class")).agg(F.count("*").alias("n"))


@query("a30_mentions", "SELECT name, count(*) FILTER (contains(text, name)) AS n FROM documents, (SELECT unnest(['license', 'Copyright', 'password', 'no such saying']) AS name) GROUP BY name")
def named_in_texts(spark, sf_dir):
    """Texts that hold each name, those of none included."""
    return M.mentions(B.read(spark, sf_dir, "documents"), "text", ("license", "Copyright", "password", "no such saying"))


@query(
    "a33_majority",
    f"""WITH {B.EV}, {B.PROMPTS}, f AS (SELECT fold, state, count(*) AS n FROM pr GROUP BY ALL), m AS (SELECT fold, state AS overall FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, state) AS t FROM f) WHERE t = 1),
    h AS (SELECT fold, (ms // 3600000) % 24 AS clock, state, count(*) AS n FROM pr GROUP BY ALL), g AS (SELECT fold, clock, state AS hourly FROM (SELECT *, row_number() OVER (PARTITION BY fold, clock ORDER BY n DESC, state) AS t FROM h) WHERE t = 1)
    SELECT fold, clock, overall, coalesce(hourly, overall) AS guess FROM (SELECT fold, unnest(range(24)) AS clock, overall FROM m) LEFT JOIN g USING (fold, clock)""",
)
@events_of
def majority(ev):
    """Majority class, by hour with the fold's as fallback."""
    prompts = B.prompts(ev)
    overall = prompts.groupBy("fold").agg(F.mode("state", True).alias("overall"))
    hourly = prompts.groupBy("fold", T.clock_hour(F.col("ms")).alias("clock")).agg(F.mode("state", True).alias("hourly"))
    grid = overall.withColumn("clock", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return rounded(grid.join(hourly, ["fold", "clock"], "left").select("fold", "clock", "overall", F.coalesce("hourly", "overall").alias("guess")))


@query(
    "a34_mann_whitney",
    f"""WITH {B.EV}, {B.PROMPTS}, r AS (SELECT state OR desire > 5 AS g, rank() OVER (ORDER BY k2) + (count(*) OVER (PARTITION BY k2) - 1) / 2.0 AS rk FROM (SELECT *, floor(value) % 40 AS k2 FROM pr))
    SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, sum(rk) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2.0 AS u, round(1 - 2 * (sum(rk) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2.0) / (count(*) FILTER (g) * count(*) FILTER (NOT g)), 6) AS effect FROM r""",
)
@events_of
def mann_whitney(ev):
    """Rank sum test; p is tested against a hand computation."""
    rows = B.prompts(ev).select((F.col("state") | (F.col("desire") > 5)).alias("g"), F.pmod(F.floor("value"), F.lit(40)).alias("v"))
    return rounded(M.mann_whitney(rows, "g", "v").drop("p"), 6)


@query(
    "a34_chi_square",
    f"""WITH {B.EV}, {B.PROMPTS}, o AS (SELECT state, available, count(*) AS o FROM pr GROUP BY ALL), a AS (SELECT state, sum(o) AS ra FROM o GROUP BY state), b AS (SELECT available, sum(o) AS cb FROM o GROUP BY available), e AS (SELECT coalesce(o, 0) AS o, ra * cb / (SELECT sum(o) FROM o) AS x FROM a CROSS JOIN b LEFT JOIN o USING (state, available))
    SELECT round(sum(pow(greatest(abs(o - x) - least(0.5, abs(o - x)), 0), 2) / x), 6) AS chi2, 1 AS dof FROM e""",
)
@events_of
def chi_square(ev):
    """Two categories each, with the continuity correction."""
    return rounded(M.chi_square(B.prompts(ev), "state", "available"), 6)


@query("a36_population_stats", f"WITH {B.EV}, d AS (SELECT event_type, user_id, sum(value) AS v FROM ev GROUP BY ALL) SELECT event_type, round(avg(v), 3) AS mean, round(CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END, 3) AS sd FROM d GROUP BY event_type")
@events_of
def population_stats(ev):
    """A36."""
    rows = ev.groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    return rounded(rows.groupBy("event_type").agg(F.avg("v").alias("mean"), F.when(F.stddev_pop("v") > 0, F.stddev_pop("v")).otherwise(1.0).alias("sd")), 3)
