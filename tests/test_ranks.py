"""Ranks and quantiles dealt over tasks, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lapwing.operators import matrices as X
from lapwing.operators import metrics as M
from lapwing.operators import ranks as R


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    made = [("a", rng.randrange(40) / 4, rng.random() < 0.4, rng.randrange(1, 6)) for _ in range(1500)] + [("b", float(k), k % 3 == 0, 1 + k % 5) for k in range(7)] + [(None, 1.0, True, 1), (None, 2.0, False, 2), ("c", None, True, 1), ("d", 5.0, True, 3)]
    return made, spark.createDataFrame(made, "g string, v double, y boolean, fold int").repartition(7)


def test_ranks_with_ties(rows):
    made, df = rows
    for key in ("a", "b"):
        values = sorted(v for g, v, *_ in made if g == key)
        want = {v: statistics.mean(i + 1 for i, x in enumerate(values) if x == v) for v in set(values)}
        got = M.average_ranks(df.where(F.col("v").isNotNull()), ["g"], "v").where(F.col("g") == key).collect()
        assert len(got) == len(values) and all(r["rank"] == want[r.v] for r in got)


def test_no_task_holds_a_key(spark, monkeypatch):
    """The windows of ranks are those of ranges: one key's 20 000 values lie in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = spark.range(20_000).select(F.lit("k").alias("g"), F.rand(3).alias("v"), F.lit(1).alias("c"))
        parts = {}
        kept = R.written
        monkeypatch.setattr(R, "written", lambda df, name: parts.setdefault(name, kept(df, name)))
        out = R.ranked(counts, ["g"], "v")
        assert out.agg(F.max("rank"), F.count_distinct("rank")).first() == (20_000.0, 20_000)
        sizes = [r["count"] for r in parts["ranges"].groupBy("_part").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_auc_by_pairs(rows):
    made, df = rows
    got = {r.g: r.auc for r in M.auc(df, ["g"], "y", "v").collect()}
    assert set(got) == {"a", "b", None}
    for key in ("a", "b", None):
        yes, no = ([v for g, v, y, _ in made if g == key and v is not None and y == side] for side in (True, False))
        assert got[key] == pytest.approx(sum((p > q) + (p == q) / 2 for p in yes for q in no) / len(yes) / len(no))


def test_quantiles_at_any_place(rows):
    made, df = rows
    counts = df.where(F.col("v").isNotNull()).groupBy("g", "v").agg(F.count("*").alias("c"))
    got = {r.g: r for r in R.at_places(counts, ["g"], "v", {"low": (F.col("n") - 1) * 0.25, "mid": (F.col("n") - 1) * 0.5}).collect()}
    for key in ("a", "b", "d", None):
        values = sorted(v for g, v, *_ in made if g == key and v is not None)
        at = lambda q: (lambda p: values[int(p)] + (values[min(int(p) + 1, len(values) - 1)] - values[int(p)]) * (p - int(p)))((len(values) - 1) * q)  # noqa: E731, B023
        assert (got[key].n, got[key].low, got[key].mid) == (len(values), pytest.approx(at(0.25)), pytest.approx(at(0.5)))


def test_exclusive_quartiles(rows):
    made, df = rows
    got = {r.g: r for r in M.exclusive_quartiles(df, ["g"], "v").collect()}
    for key in ("a", "b"):
        values = [v for g, v, *_ in made if g == key]
        assert [got[key].q1, got[key]["median"], got[key].q3] == pytest.approx(statistics.quantiles(values, n=4)) and got[key].sd == pytest.approx(statistics.stdev(values))
        assert got[key].zero_share == pytest.approx(values.count(0) / len(values))
    # two values: the method goes on along their line; one has no deviation
    assert [got[None].q1, got[None].q3] == statistics.quantiles([1.0, 2.0], n=4)[::2] and (got["d"].q1, got["d"].sd) == (5.0, None)


def test_medians_of_the_other_folds(rows, spark):
    made, df = rows
    wide = df.withColumn("w", F.when(F.col("fold") == 2, F.col("v") * 2))
    got = {r.test_fold: r for r in R.medians_of_others(wide, ["v", "w"], "fold", 5).collect()}
    for f in range(1, 6):
        assert got[f].v == statistics.median(v for _, v, _, fold in made if fold != f and v is not None)
        others = [v * 2 for _, v, _, fold in made if fold != f and fold == 2 and v is not None]
        assert got[f].w == (statistics.median(others) if others else None)
    filled = X.imputed(wide.withColumn("x", F.lit("kept")), ["v", "w"])
    assert filled.count() == len(made) and filled.where("v is null or (w is null and fold <> 2)").count() == 0
    assert X.imputed(wide.limit(0), ["v"]).count() == 0


def test_classes_and_mentions(spark):
    df = spark.createDataFrame([("The tools aren't available",), ("The tools don’t APPEAR",), ("error_max_turns, tools unavailable",), ("fine",), (None,)], "t string")
    assert [r[0] for r in df.select(M.availability(F.col("t"))).collect()] == ["tools_unavailable", "tools_unavailable", "max_turns_hit"] + ["tools_attempted_or_single_turn"] * 2
    assert {r.name: r.n for r in M.mentions(df, "t", ("tools", "x.y", "fine")).collect()} == {"tools": 3, "x.y": 0, "fine": 1}
