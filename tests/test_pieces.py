"""A user's past cut into pieces: as from the whole past, whatever the pieces."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lapwing.operators import pit as P

HOUR = 3_600_000


def tod(hour):
    h = hour % 24
    return "night" if h < 5 else "morning" if h < 12 else "afternoon" if h < 18 else "evening"


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("level,days", [(0.0, 7), (0.0, 32), (1e6, 9)])
def test_baseline_against_the_whole_past(spark, level, days):
    rnd = random.Random(days)
    bins = {(u, h): None if rnd.random() < 0.1 else level + (5.0 if u == 3 else rnd.gauss(10, 3)) for u in (1, 2, 3, None) for h in rnd.sample(range(-200, 24 * 60), 400)}
    asks = [(i, rnd.choice([1, 2, 3, 4, None]), rnd.randrange(-100 * HOUR, 24 * 62 * HOUR), level + rnd.gauss(10, 3)) for i in range(300)]
    asks += [(300, 1, 24 * 33 * HOUR, 1.0), (301, 1, 24 * 33 * HOUR, 1.0), (302, 2, 24 * 32 * HOUR - 1, None)]
    made = spark.createDataFrame([(u, h, x) for (u, h), x in bins.items()], "user_id int, hour long, x double")
    got = {r.prompt_id: r for r in P.personal_baseline(spark.createDataFrame(asks, "prompt_id long, user_id int, ms long, value double"), made, "x", piece_days=days).collect()}
    assert len(got) == len(asks)
    for i, user, ms, value in asks:
        s = ms // 1000
        past = sorted((h, x) for (u, h), x in bins.items() if u == user and x is not None and h * 3600 <= s - 3600 and tod(h) == tod(ms // HOUR))
        xs, r = [x for _, x in past], got[i]
        assert r.n == len(xs)
        if not xs:
            assert r["mean"] is None and r.sd is None and r.z is None and r.week_mean is None
            continue
        mean, sd = statistics.fmean(xs), statistics.stdev(xs) if len(xs) > 1 else 0.0
        week = [x for h, x in past if h * 3600 > past[-1][0] * 3600 - 7 * 86400]
        assert close(r["mean"], mean) and math.isclose(r.sd, sd, rel_tol=1e-6, abs_tol=1e-12) and close(r.week_mean, statistics.fmean(week))
        assert value is None or math.isclose(r.z, (value - mean) / max(sd, 1e-6), rel_tol=1e-6, abs_tol=1e-6)


def test_running_features_against_the_whole_past(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([1, 2, 3]), rnd.randrange(0, 40 * 24) * HOUR, rnd.randrange(1, 4), 7.0 if i % 5 == 0 else rnd.gauss(50, 9), rnd.choice([None, 2, 5, 8]), rnd.choice([None, "yes", "no"])) for i in range(400)]
    rows += [(400 + i, 9, i * 30 * HOUR, 1, 4.0 if i < 6 else 5.0, 5, "yes") for i in range(8)]
    df = spark.createDataFrame(rows, "prompt_id long, user_id int, ms long, fold int, value double, desire int, available string")
    got = {r.prompt_id: r for r in P.running_personal(df).collect()}
    assert len(got) == len(rows)
    rate = lambda xs: statistics.fmean(xs) if xs else 0.0
    for r in rows:
        past = [x for x in sorted((x for x in rows if x[1] == r[1]), key=lambda x: (x[2], x[0])) if (x[2], x[0]) < (r[2], r[0])]
        xs = [x[4] for x in past] if len(past) >= 3 else [x[4] for x in rows if x[3] != r[3]]
        g, ten = got[r[0]], past[-10:]
        assert math.isclose(g.deviation, (r[4] - statistics.fmean(xs)) / (statistics.pstdev(xs) + 1e-8), rel_tol=1e-6, abs_tol=1e-6)
        assert g.volume == min(len(past) / 20, 1)
        wish, ready = [None if x[5] is None else float(x[5] >= 5) for x in ten], [None if x[6] is None else float(x[6] == "yes") for x in ten]
        both = [0.0 if 0.0 in (a, b) else None if None in (a, b) else 1.0 for a, b in zip(wish, ready)]
        for name, vs in (("desire_rate", wish), ("available_rate", ready), ("joint_rate", both)):
            assert close(g[name], rate([v for v in vs if v is not None])), name


def test_a_busy_user_is_many_tasks(spark):
    """One user with all rows: what meets in a task is a share of them."""
    bins = spark.range(24 * 3000).select(F.lit(1).alias("user_id"), F.col("id").alias("hour"), (F.col("id") % 7).cast("double").alias("x"))
    prompts = spark.range(3000).select(F.col("id").alias("prompt_id"), F.lit(1).alias("user_id"), (F.col("id") * 24 * HOUR + 10 * HOUR).alias("ms"), F.lit(1.0).alias("value"))
    seen = P.personal_baseline(prompts, bins, "x").withColumn("task", F.spark_partition_id())
    rows = seen.groupBy("task").count().collect()
    assert sum(r["count"] for r in rows) == 3000
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [user_id" in plan and "_piece" in plan
    wide = [x for x in plan.split("\n") if "Window " in x and "_piece" not in x and "of_mean" not in x]
    assert not wide  # no window holds a user's bins without their piece; those of moments hold a row a piece
    assert seen.agg(F.max("n")).first()[0] == 2999 * 7 + 5 and P.personal_baseline(prompts.limit(0), bins, "x").count() == 0
    assert P.personal_baseline(prompts, bins.limit(0), "x").where("n = 0 and z is null").count() == 3000
    with pytest.raises(ValueError):
        P.personal_baseline(prompts, bins, "x", piece_days=3)
