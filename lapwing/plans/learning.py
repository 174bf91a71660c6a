"""Queries for feature matrices and models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import learning as L
from ..operators import matrices as X
from ..operators import metrics as M
from ..operators import pit as P
from ..sources import bindings as B
from ..sources.scratch import written
from .base import events_of, query, rounded
from .pit import BASE, BASELINE, TOD, YES, clicks

HOURS, SWEEP = 24, 6
FEATURES = ["n", "total"]
SENSED = ["hours", "total", "volume", "desire_rate", "joint_rate"]
#: what bindings deal rows to; each is held out once
FOLDS = [1, 2, 3, 4, 5]


def _prompts(ev):
    return B.prompts(ev).select("prompt_id", "user_id", "ms", "fold", "state", "value")


DAILY = [c for columns in X.DAILY.values() for c in columns]
KINDS = ("click", "view", "purchase", "error", "signup")


@query(
    "m01_daily_matrix",
    f"""WITH {B.EV}, {B.PROMPTS}, d AS (SELECT user_id, ms // 86400000 AS day, {', '.join(f"sum(value) FILTER (event_type = '{KINDS[i % 5]}' AND k % 4 = {i // 5}) AS {c}" for i, c in enumerate(DAILY))} FROM ev GROUP BY ALL)
    SELECT prompt_id, desire, state, {', '.join(f'round({c}, 3) AS {c}' for c in DAILY)} FROM pr LEFT JOIN d ON d.user_id = pr.user_id AND d.day = pr.ms // 86400000""",
)
@events_of
def daily_matrix(ev):
    """Twenty daily columns from eight tables, each a sum over one part of the day's events, with two targets."""
    day = T.day_of(F.col("ms")).alias("day")
    part = lambda i: (F.col("event_type") == KINDS[i % 5]) & (F.col("k") % 4 == i // 5)
    sums = {c: F.sum(F.when(part(i), F.col("value"))).alias(c) for i, c in enumerate(DAILY)}
    rows = ev.select(F.col("user_id").alias("participant"), day, "event_type", "k", "value")
    tables = {name: rows.groupBy("participant", "day").agg(*(sums[c] for c in columns)).withColumn("tie", F.lit(0)) for name, columns in X.DAILY.items()}
    prompts = B.prompts(ev).withColumnRenamed("user_id", "participant").withColumn("day", T.day_of(F.col("ms")))
    return rounded(X.daily_matrix(prompts, tables, ["prompt_id", "desire", "state"]), 3)


@query(
    "m02_flat_matrix",
    f"""{BASE}, s AS (SELECT p.prompt_id, b.hour - p.ms // 3600000 + {HOURS} AS h, n, total FROM pr p LEFT JOIN bi b ON b.user_id = p.user_id AND b.hour BETWEEN p.ms // 3600000 - {HOURS} AND p.ms // 3600000 - 1)
    SELECT prompt_id, {', '.join(f'max({f}) FILTER (h = {h}) AS h{h}_{f}' for h in range(HOURS) for f in ('n',))}, {', '.join(f'round(max(total) FILTER (h = {h}), 3) AS h{h}_total' for h in range(HOURS))} FROM s GROUP BY prompt_id""",
)
@events_of
def flat_matrix(ev):
    """M02, X07."""
    return rounded(X.flat(_prompts(ev), clicks(ev), FEATURES, HOURS), 3)


@query(
    "m03_tensor",
    f"""{BASE}, s AS (SELECT prompt_id, user_id, unnest(generate_series(ms // 3600000 - {HOURS}, ms // 3600000 - 1)) AS hour FROM pr)
    SELECT prompt_id, string_agg(coalesce(CAST(n AS VARCHAR), '-'), ' ' ORDER BY hour) AS counts FROM s LEFT JOIN bi USING (user_id, hour) GROUP BY prompt_id""",
)
@events_of
def tensor(ev):
    """M03, shown as a line of counts."""
    rows = X.tensor(_prompts(ev), clicks(ev), ["n"], HOURS)
    return rows.select("prompt_id", F.array_join(F.transform("tensor", lambda t: F.coalesce(t[0].cast("long").cast("string"), F.lit("-"))), " ").alias("counts"))


LONG = f"""lf AS (SELECT p.prompt_id, p.fold, s.hour - p.ms // 3600000 + {HOURS} AS h, coalesce(b.total, 0) AS x FROM pr p JOIN (SELECT prompt_id, unnest(generate_series(ms // 3600000 - {HOURS}, ms // 3600000 - 1)) AS hour FROM pr) s USING (prompt_id) LEFT JOIN bi b ON b.user_id = p.user_id AND b.hour = s.hour)"""


@query(
    "a23_sequence_statistics",
    f"""{BASE}, {LONG} SELECT prompt_id, 'total' AS feature, round(avg(x), 3) AS mean, round(stddev_pop(x), 3) AS sd, round(min(x), 3) AS least, round(max(x), 3) AS most, round(arg_max(x, h), 3) AS last, round(avg(x) FILTER (h >= 12) - avg(x) FILTER (h < 12), 3) AS trend FROM lf GROUP BY prompt_id""",
)
@events_of
def sequence_statistics(ev):
    """A23."""
    return rounded(X.sequence_statistics(X.long_form(_prompts(ev), clicks(ev), ["total"], HOURS, []), HOURS), 3)


@query(
    "m14_standardised",
    f"""{BASE}, {LONG}, st AS (SELECT t.f AS test_fold, avg(x) AS m, stddev_pop(x) AS s FROM lf JOIN (SELECT unnest(range(1, 6)) AS f) t ON lf.fold <> t.f GROUP BY t.f)
    SELECT prompt_id, h, round((x - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 4) AS z FROM lf JOIN st ON lf.fold = st.test_fold""",
)
@events_of
def standardised(ev):
    """M14."""
    return rounded(X.standardised(X.long_form(_prompts(ev), clicks(ev), ["total"], HOURS, ["fold"])).select("prompt_id", "h", "z"))


@query(
    "a22_imputed",
    f"""{BASE}, v AS (SELECT p.prompt_id, p.fold, sum(total) AS total FROM pr p LEFT JOIN bi b ON b.user_id = p.user_id AND b.hour BETWEEN p.ms // 3600000 - 24 AND p.ms // 3600000 - 1 GROUP BY ALL),
    md AS (SELECT t.f AS test_fold, quantile_cont(total, 0.5) AS m FROM v JOIN (SELECT unnest(range(1, 6)) AS f) t ON v.fold <> t.f GROUP BY t.f) SELECT prompt_id, fold, round(coalesce(total, m), 3) AS total FROM v JOIN md ON v.fold = md.test_fold""",
)
@events_of
def imputed(ev):
    """Exact medians of the other folds."""
    sums = P.lookback(_prompts(ev), clicks(ev)).groupBy("prompt_id", "fold").agg(F.sum("total").alias("total"))
    return rounded(X.imputed(sums, ["total"]), 3)


@query(
    "m09_lookback_sweep",
    f"""{BASE} SELECT w AS lookback, count(DISTINCT prompt_id) AS n, CAST(count(b.n) AS BIGINT) AS hours_seen, round(sum(b.total), 2) AS total FROM pr p CROSS JOIN (SELECT unnest(range(1, 7)) AS w) LEFT JOIN bi b ON b.user_id = p.user_id AND b.hour BETWEEN p.ms // 3600000 - w AND p.ms // 3600000 - 1 GROUP BY w""",
)
@events_of
def lookback_sweep(ev):
    """One frame for all lookbacks of one to six hours."""
    slots = P.lookback(_prompts(ev), clicks(ev), SWEEP)
    rows = slots.withColumn("lookback", F.explode(F.sequence(SWEEP - F.col("h"), F.lit(SWEEP))))
    return rounded(rows.groupBy("lookback").agg(F.count_distinct("prompt_id").alias("n"), F.count("n").alias("hours_seen"), F.sum("total").alias("total")), 2)


_ASKED = "SELECT p.prompt_id, count(b.n) AS hours_seen, sum(b.total) AS total FROM pr p LEFT JOIN bi b ON b.user_id = p.user_id AND b.hour BETWEEN p.ms // 3600000 - 24 AND p.ms // 3600000 - 1 GROUP BY ALL"
_PAST = f"SELECT a.prompt_id, count(b.yes) AS n, avg(b.yes) AS rate, avg(b.yes) FILTER (b.tod = a.tod) AS rate_tod FROM t a LEFT JOIN t b ON b.user_id = a.user_id AND b.ms BETWEEN a.ms - 14 * 86400000 AND a.ms - 1 GROUP BY a.prompt_id"


@query(
    "m13_replay",
    f"""{BASE}, {BASELINE}, t AS (SELECT *, {TOD.format('(ms // 3600000)')} AS tod, {YES} AS yes FROM pr), s AS ({_ASKED}), h AS ({_PAST})
    SELECT prompt_id, hours_seen, round(total, 4) AS total, CASE WHEN sd > 0.001 THEN round(z, 4) ELSE CASE WHEN z > 1 THEN 2.0 WHEN z IS NOT NULL THEN 0.0 END END AS z, h.n, round(rate, 4) AS rate, round(rate_tod, 4) AS rate_tod, coalesce(rate, 0) >= 0.5 OR coalesce(z, 0) > 1 AS guess, state AS outcome FROM s JOIN bl USING (prompt_id) JOIN h USING (prompt_id) JOIN pr USING (prompt_id)""",
)
@events_of
def replay(ev):
    """Every prompt's context, baseline and receptivity in one plan, scored, with its outcome joined afterwards."""
    prompts, bins = B.prompts(ev), clicks(ev)
    seen = P.lookback(prompts.select("prompt_id", "user_id", "ms"), bins).groupBy("prompt_id").agg(F.count("n").alias("hours_seen"), F.sum("total").alias("total"))
    baseline = P.personal_baseline(prompts, bins, "total")
    # against a deviation of nothing only the side counts
    baseline = baseline.withColumn("z", F.when(F.col("sd") > 0.001, F.col("z")).when(F.col("z") > 1, 2.0).when(F.col("z").isNotNull(), 0.0))
    context = seen.join(baseline.select("prompt_id", "z"), "prompt_id").join(P.history(prompts), "prompt_id")
    scored = P.replayed(context.join(prompts.select("prompt_id", "user_id", "ms"), "prompt_id"), _guess, "guess boolean", prompts.select("prompt_id", F.col("state").alias("outcome")))
    return rounded(scored.drop("user_id", "ms", "turn"))


def _guess(batches):
    """Receptive as often as not so far, or clearly over the own baseline."""
    for x in batches:
        yield x.assign(guess=(x["rate"].fillna(0.0) >= 0.5) | (x["z"].fillna(0.0) > 1))


def _sensor_rows(ev) -> DataFrame:
    prompts = B.prompts(ev)
    met = P.recent(prompts.select("prompt_id", "user_id", "ms"), clicks(ev), ["n", "total"])
    seen = met.select("prompt_id", F.size(F.filter("seen", lambda b: b["n"].isNotNull())).cast("long").alias("hours"), F.aggregate("seen", F.lit(0.0), lambda s, b: s + F.coalesce(b["total"], F.lit(0.0))).alias("total"))
    personal = P.running_personal(prompts).select("prompt_id", "volume", "desire_rate", "joint_rate")
    return seen.join(personal, "prompt_id").join(prompts.select("prompt_id", "fold", F.col("state").cast("double").alias("label")), "prompt_id").withColumnRenamed("prompt_id", "id")


def _scores(predictions: list[DataFrame]) -> DataFrame:
    both = reduce(DataFrame.unionByName, predictions)
    return rounded(M.classification(both, ["model", "fold"], both_classes=False))


@query("m04_m08_sensor_models")
@events_of
def sensor_models(ev):
    """Models on sensing for a binary target, one fold held out at a time; the logistic one on the best
    features, chosen with its regularisation in an inner validation."""
    rows = written(_sensor_rows(ev), "sensor-rows")
    stages = L.sensor_stages(SENSED)
    made = L.fold_features(rows, stages, FOLDS)
    found = [L.cross_validate(rows, stages, m, FOLDS, grid=len(SENSED) if m == "logistic" else 0, made=made) for m in L.MODELS]
    for train, _ in made.values():
        train.unpersist()
    return _scores(found)


@query("m04_sensor_regressions")
@events_of
def sensor_regressions(ev):
    """A continuous target (the wish at the prompt) by four regressions, one fold held out at a time."""
    rows = _sensor_rows(ev).drop("label").join(B.prompts(ev).select(F.col("prompt_id").alias("id"), F.col("desire").cast("double").alias("label")), "id")
    rows = written(rows, "sensor-rows")
    found = L.cross_validate_continuous(rows, L.sensor_stages(SENSED), list(L.REGRESSORS), FOLDS)
    return rounded(M.regression(found, ["model", "fold"]))


@query("m08_subset_scores")
@events_of
def subset_scores(ev):
    """Trained on all users, scored on the pooled out-of-fold rows of a subset of them (here every eighth)."""
    rows = written(_sensor_rows(ev), "sensor-rows")
    subset = B.prompts(ev).where("user_id % 8 = 1").select(F.col("prompt_id").alias("id"))
    found = [L.cross_validate(rows, L.sensor_stages(SENSED), m, FOLDS) for m in ("logistic", "forest")]
    pooled = reduce(DataFrame.unionByName, found).join(subset, "id", "left_semi")
    return rounded(M.classification(pooled, ["model"], both_classes=False))


@query("m12_text_grid")
def text_grid(spark, sf_dir):
    """Vectoriser by classifier, every combination with its mean balanced accuracy."""
    rows = B.diary(spark, sf_dir).where("quality is not null").select("text", F.col("quality").cast("double").alias("label"))
    found = L.text_grid(written(rows, "grid-rows"))
    return spark.createDataFrame(found, "min_df long, pairs boolean, reg double, l1 double, score double, max_df double, idf boolean, norm boolean, balanced boolean")


@query("m05_text_models")
def text_models(spark, sf_dir):
    """Tf-idf of damped counts, and plain counts, of diary texts."""
    rows = B.diary(spark, sf_dir).where("quality is not null").select(F.col("doc_id").alias("id"), "fold", "text", F.col("quality").cast("double").alias("label"))
    rows = L.split_once(rows, [(500, 2, True, 1.0), (300, 2, True, 1.0)], FOLDS)
    tfidf = L.cross_validate(rows, L.text_stages(500, sublinear=True, split=False), "logistic", FOLDS)
    counts = L.cross_validate(rows, L.text_stages(300, idf=False, split=False), "ridge", FOLDS)
    return _scores([tfidf, counts])


@query("m06_fused_models")
def fused_models(spark, sf_dir):
    """A prompt's sensing and its diary, scaled apart; a prompt has the text of its number, or none (a block of zeros)."""
    sensed = _sensor_rows(B.events(spark, sf_dir))
    rows = written(sensed.join(B.diary(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id", "left"), "fused-rows")
    rows = L.counted_once(L.split_once(rows, [(200, 2, True, 1.0)], FOLDS))
    sensed = [VectorAssembler(inputCols=SENSED, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="sensed", withMean=True)]
    told = [L.FoldTerms(200, "said"), StandardScaler(inputCol="said", outputCol="told")]
    stages = [*sensed, *told, VectorAssembler(inputCols=["sensed", "told"], outputCol="x")]
    return _scores([L.cross_validate(rows, stages, "logistic", FOLDS)])


@query("m07_vector_models")
def vector_models(spark, sf_dir):
    """Precomputed vectors."""
    rows = B.read(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5 + 1).alias("fold"), (F.col("label") < 5).cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    return _scores([L.cross_validate(rows, [], "logistic", FOLDS)])
