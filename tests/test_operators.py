"""Small cases with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lapwing.functions import cleaning as C
from lapwing.functions import texts as X
from lapwing.operators import daily as D
from lapwing.operators import hourly as H
from lapwing.operators import intervals as I
from lapwing.operators import matrices
from lapwing.operators import metrics as M
from lapwing.operators import pit as P

HOUR = 3_600_000


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_consecutive_fixes(spark):
    fixes = spark.createDataFrame([(1, i, s * 1000, 40.0 + i / 1000, -74.0) for i, s in enumerate((0, 600, 1600))], "pid int, fix_id int, ms long, lat double, lon double")
    out = rows(I.consecutive_fixes(fixes).select("gap_s", "distance_m", "speed_kmh", "ms"), "ms")
    assert out[0][:3] == (None, None, None)
    assert out[1][0] == 600 and out[1][1] == pytest.approx(111.19, abs=0.1) and out[1][2] == pytest.approx(0.667, abs=0.01)
    assert out[2][:3] == (1000, None, None)


def test_step_changes(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 0), (1, 1, 1.5, 1), (1, 3, 2.0, 2)], "pid int, second long, magnitude double, tie int")
    assert [r[0] for r in rows(I.step_changes(df, "pid", "second", "magnitude", "tie").select("abs_diff", "second"), "second")] == [0, 0.5, 0]


def test_intervals_and_split(spark):
    events = spark.createDataFrame([(1, 0, "walking", 0), (1, 60000, "stationary", 1), (1, 60000, "running", 2), (1, 120000, "automotive", 3)], "pid int, ms long, category string, tie int")
    assert rows(I.to_intervals(events).select("category", "start_ms", "end_ms"), "start_ms") == [("walking", 0, 60000), ("stationary", 60000, 120000), ("automotive", 120000, 180000)]
    one = spark.createDataFrame([(1, "x", 10 * HOUR + 50 * 60000, 12 * HOUR + 10 * 60000)], "pid int, category string, start_ms long, end_ms long")
    assert rows(I.split_by_hour(one).select("hour", (F.col("clipped_ms") / 60000).cast("int")), "hour") == [(10, 10), (11, 60), (12, 10)]


def test_unlock_sessions(spark):
    states = [(0, "unlocked"), (10, "unlocked"), (70, "locked"), (80, "locked"), (90, "unlocked"), (90 + 4 * 3600, "locked")]
    df = spark.createDataFrame([(1, s * 1000, x, i, "+00:00") for i, (s, x) in enumerate(states)], "pid int, ms long, state string, tie int, zone string")
    assert rows(I.unlock_sessions(df).select("start_ms", "end_ms"), "start_ms") == [(10000, 70000)]


def test_minutes_of_hours_keep_their_sum(spark):
    iv = spark.createDataFrame([(1, "walking", i * 1_000_003, (i + 1) * 1_000_003) for i in range(50)], "pid int, category string, start_ms long, end_ms long")
    hours = H.motion_minutes(iv)
    assert hours.where("walking_min > 60.0001").count() == 0
    assert hours.agg(F.sum("walking_min")).first()[0] == pytest.approx(50 * 1_000_003 / 60000)


def baseline(spark, prompt_ms, value):
    bins = spark.createDataFrame([(1, 8, 10.0), (1, 9, 20.0)], "user_id int, hour long, x double")
    prompts = spark.createDataFrame([(7, 1, prompt_ms, value)], "prompt_id long, user_id int, ms long, value double")
    return P.personal_baseline(prompts, bins, "x").first()


def test_personal_baseline(spark):
    r = baseline(spark, 10 * HOUR, 30.0)
    assert (r.n, r["mean"]) == (2, 15.0) and r.sd == pytest.approx(7.0711, abs=1e-4) and r.z == pytest.approx(2.1213, abs=1e-4)
    early = baseline(spark, 10 * HOUR - 60000, 30.0)
    assert (early.n, early.sd) == (1, 0.0)
    z = spark.createDataFrame([(2.1213,), (0.2,), (-1.5,)], "z double").select(C.z_phrase(F.col("z")).alias("p")).collect()
    assert [x.p for x in z] == ["very elevated - top 3% of your hours", "within typical range", "below typical"]


def test_no_leak(spark):
    """What happens at or after a prompt does not change what the prompt is told."""
    prompts = spark.createDataFrame([(7, 1, 30 * HOUR + 5, 1.0)], "prompt_id long, user_id int, ms long, value double")
    bins = lambda late: spark.createDataFrame([(1, h, float(h)) for h in range(30)] + [(1, 30 + i, late) for i in range(5)], "user_id int, hour long, x double")
    for work in (lambda b: P.personal_baseline(prompts, b, "x"), lambda b: P.lookback(prompts, b).select("h", "x").orderBy("h"), lambda b: P.offset_window(prompts, b, 4, 6, ["prompt_id"])):
        assert work(bins(1.0)).collect() == work(bins(999.0)).collect()


def test_lookback_slots(spark):
    prompts = spark.createDataFrame([(1, 1, (48 + 13) * HOUR + 37 * 60000)], "prompt_id long, user_id int, ms long")
    hours = [r.hour for r in P.lookback_slots(prompts).orderBy("h").collect()]
    assert hours == list(range(48 + 13 - 24, 48 + 13))


def test_entropy_and_caps(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 5), (3, 5)], "g int, c int")
    assert rows(H.cell_entropy(df, ["g"], [F.col("c")]).select("g", F.round("entropy", 6)), "g") == [(1, 0.0), (2, 1.0), (3, 0.0)]
    parts = C.capped_parts({"a": F.lit(1000.0), "b": F.lit(300.0), "c": F.lit(200.0)})
    assert tuple(spark.range(1).select(*parts.values()).first()) == (960.0, 288.0, 192.0)


def test_scores(spark):
    df = spark.createDataFrame([(1, True, True), (1, True, False), (1, False, False), (1, False, False), (1, None, True)], "f int, y boolean, p boolean")
    r = M.classification(df, ["f"]).first()
    assert (r.n, r.balanced_accuracy) == (4, 0.75) and r.f1 == pytest.approx(2 / 3) and r.macro_f1 == pytest.approx(0.7333, abs=1e-4)
    users = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("b", 1.0)], "u string, p double")
    assert rows(M.personal_threshold(users, "u", "p").select("p", "high"), "p") == [(1.0, False), (1.0, False), (4.0, True)]
    four = spark.createDataFrame([(1, float(i)) for i in (1, 2, 3, 4)], "g int, v double")
    q = M.exclusive_quartiles(four, ["g"], "v").first()
    assert (q.q1, q["median"], q.q3) == (1.25, 2.5, 3.75)


def test_rank_test(spark):
    df = spark.createDataFrame([(True, 1.0), (True, 2.0), (True, 3.0), (False, 2.0), (False, 4.0)], "g boolean, v double")
    r = M.mann_whitney(df, "g", "v").first()
    assert (r.n1, r.n2, r.u, r.effect) == (3, 2, 1.5, 0.5)
    sd = math.sqrt(3 * 2 / 12 * (6 - 6 / 20))
    assert r.p == pytest.approx(math.erfc((1.5 - 0.5) / sd / math.sqrt(2)))


def test_truth_and_json(spark):
    df = spark.createDataFrame([("Yes",), (" no ",), ("maybe",), (None,), ("0.0",)], "c string")
    assert [r[0] for r in df.select(C.truth(F.col("c"))).collect()] == [True, False, None, None, False]
    raw = spark.createDataFrame([('{"a": 1}',), ('x ```json\n{"a": 2}\n``` y',), ('so {"a": 3} then',), ('{"result": {"a": 4}}',), ("none",)], "t string")
    assert [r[0] for r in raw.select(X.embedded_json(F.col("t"), "a int")["a"]).collect()] == [1, 2, 3, 4, None]


def test_homes(spark):
    spots = [(0, 40.0, -74.0)] * 3 + [(0, 40.0005, -74.0)] * 2 + [(0, 41.0, -74.0)] * 4 + [(0, 42.0, -74.0)]
    fixes = spark.createDataFrame([(p, i, a, b) for i, (p, a, b) in enumerate(spots)], "pid int, fix_id long, lat double, lon double")
    r = D.homes(fixes).first()
    assert (r.n_used, r.n_clusters) == (5, 2) and r.home_lat == pytest.approx(40.0002)


def test_zone_free_inputs_everywhere(spark):
    from lapwing.functions import times as T

    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:07.179' AS ts, '-05:30' AS zone")
    assert tuple(df.select(T.epoch_ms(F.col("ts")), T.offset_minutes(F.col("zone")), T.offset_minutes(F.lit("bad"), 0)).first()) == (1704067207179, -330, 0)


def test_ids_are_padded_but_never_cut(spark):
    df = spark.createDataFrame([("7",), (' "42" ',), ("100",), ("1000",), ("10001",), (None,)], "c string")
    assert [r[0] for r in df.select(C.padded_id(F.col("c"))).collect()] == ["007", "042", "100", "1000", "10001", None]


def test_tokens_part_at_typographic_signs(spark):
    df = spark.createDataFrame([("Good—bad “happy” days… don't naïve_1  x",)], "t string")
    assert df.select(X.tokens(F.col("t"))).first()[0] == ["good", "bad", "happy", "days", "don't", "naïve_1", "x"]


def test_lexicon_profile(spark):
    df = spark.createDataFrame([(1, "Happy unhappy HAPPILY: sad\nworkshop walks"), (2, None), (3, "")], "doc_id int, text string")
    a, b, c = X.lexicon_profile(df).orderBy("doc_id").collect()
    assert (a.word_count, a.posemo_count, a.negemo_count, a.work_count, a.leisure_count) == (6, 1, 1, 1, 1) and a.posemo_prop == pytest.approx(1 / 6) and a.pos_neg_ratio == 1.0
    assert (b.word_count, c.word_count, b.posemo_count) == (1, 1, 0)


def test_running_features_know_only_other_folds(spark):
    """A prompt without a past is told the level of the other folds: nothing of its own, later ones included."""
    made = lambda own: spark.createDataFrame([(1, 10, 0, 1, own), (2, 10, 5, 1, own * 3), (3, 20, 1, 2, 2.0), (4, 21, 2, 2, 4.0)], "prompt_id long, user_id int, ms long, fold int, value double").withColumn("desire", F.lit(5)).withColumn("available", F.lit("yes"))
    get = lambda own: {r.prompt_id: r.deviation for r in P.running_personal(made(own)).collect()}
    assert get(7.0)[1] == pytest.approx((7.0 - 3.0) / 1.0) and get(7.0)[2] == pytest.approx(21.0 - 3.0)
    assert get(7.0)[3] == pytest.approx((2.0 - 14.0) / 7.0)


def test_unsettled_clusters_raise(spark):
    points = spark.createDataFrame([(1, i, 40.0 + i / 1000, -74.0, 5) for i in range(12)], "pid int, a long, lat double, lon double, weight int")
    assert {r.cluster for r in D.density_clusters(points).collect()} == {0}
    with pytest.raises(RuntimeError):
        D.density_clusters(points, rounds=1)


def test_daily_matrix(spark):
    from lapwing.operators import matrices as X

    prompts = spark.createDataFrame([(1, 7, 3), (2, 7, 4), (3, 8, 3)], "prompt_id long, participant int, day long")
    sleep = spark.createDataFrame([(7, 3, 1, 400.0), (7, 3, 0, 300.0), (8, 9, 0, 1.0)], "participant int, day long, tie int, sleep_duration_min double")
    apps = spark.createDataFrame([(8, 3, 0, 90)], "participant int, day long, tie int, total_app_seconds long")
    out = X.daily_matrix(prompts, {"sleep": sleep, "apps": apps}, ["prompt_id"]).orderBy("prompt_id").collect()
    assert len(out[0]) == 21 and [(r.sleep_duration_min, r.total_app_seconds, r.travel_km) for r in out] == [(300.0, None, None), (None, None, None), (None, 90.0, None)]


def test_narratives(spark):
    day = 24 * HOUR
    prompts = spark.createDataFrame([(1, 1, day + 5), (2, 1, day + 6), (3, 1, 2 * day), (4, 2, day), (5, 1, day + 7)], "prompt_id long, user_id int, ms long")
    told = [(1, 1, day + 5, 0, "own"), (1, 1, None, 1, "daily"), (1, 1, None, 0, "first"), (2, 1, None, 0, " "), (1, 1, day + 7, 0, ""), (1, 1, day + 7, 1, "late")]
    narratives = spark.createDataFrame(told, "user_id int, day long, ms long, tie int, narrative string")
    assert rows(P.narratives_for(prompts, narratives), "prompt_id") == [(1, "own"), (2, "first"), (3, None), (4, None), (5, None)]


def test_a_busy_user_s_past_is_many_tasks(spark):
    made = [(i, None if i % 50 == 49 else i % 3 // 2, None if i % 97 == 5 else i * 1_700_000, i % 8, ("yes", "no", None)[i % 3], i % 5 == 0, f"d{i}" if i % 4 else None) for i in range(1500)]
    prompts = spark.createDataFrame(made, "prompt_id long, user_id long, ms long, desire int, available string, state boolean, diary string").repartition(5)
    past, got, want = {}, {r.prompt_id: r for r in P.profile(prompts).collect()}, {}
    details = {r.prompt_id: r for r in P.profile_details(prompts).collect()}
    assert len(got) == len(details) == len(made)
    for row in sorted(made, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        seen = past.setdefault(row[1], [])
        yes = [x[3] >= 5 and x[4] == "yes" for x in seen if x[3] < 5 or x[4] is not None]
        states = [x[5] for x in seen]
        assert got[row[0]].n == details[row[0]].n == len(seen)
        assert got[row[0]].receptive == (sum(yes) / len(yes) if yes else None)
        assert got[row[0]].state_rate == (sum(states) / len(states) if len(seen) >= 3 else None)
        other = [x[6] for x in seen if x[6] and not (x[3] >= 5 and x[4] == "yes")]
        enough = sum(x[6] is not None for x in seen) >= 5 and len(other) >= 2
        assert (details[row[0]].other_diary_1, details[row[0]].other_diary_2) == (tuple(other[:2]) if enough else (None, None))
        seen.append(row)
    plan = P.profile(prompts)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id#" in plan and "_piece#" in plan
    assert P.profile(prompts.limit(0)).count() == 0 and P.profile_details(prompts.limit(0)).count() == 0


def test_recent_bins_of_prompts(spark):
    """Bins of the slots before each prompt, also across days and for other lookbacks; prompts are not copied for slots."""
    import random

    rng, hour = random.Random(4), 3_600_000
    bins = [(rng.randrange(4), rng.randrange(-30, 200), rng.choice((None, 1.5, 2.0)), k) for k in range(300)]
    prompts = [(k, rng.randrange(5), rng.randrange(-20 * hour, 210 * hour)) for k in range(80)]
    p, b = spark.createDataFrame(prompts, "prompt_id long, user_id long, ms long"), spark.createDataFrame(bins, "user_id long, hour long, x double, n long")
    for hours in (1, 6, 24, 50):
        found = {r.prompt_id: sorted(map(str, map(tuple, r.seen))) for r in P.recent(p, b, ["x", "n"], hours).collect()}
        assert found == {k: sorted(str((h - ms // hour + hours, x, n)) for v, h, x, n in bins if v == u and ms // hour - hours <= h < ms // hour) for k, u, ms in prompts}
    flat = {r.prompt_id: r for r in matrices.flat(p, b, ["n"], 24).collect()}
    assert all(flat[k][f"h{s}_n"] == max((n for v, h, _, n in bins if v == u and h == ms // hour - 24 + s), default=None) for k, u, ms in prompts for s in range(24))
    assert "explode(sequence((FLOOR((cast(ms" not in matrices.flat(p, b, ["n"], 24)._jdf.queryExecution().optimizedPlan().toString()


def test_sums_in_order(spark):
    """Sums of doubles are those of the rows one after another, bit by bit, however rows are dealt."""
    import random

    rng = random.Random(5)
    rows = [(i, i % 3, round(rng.expovariate(0.02), 2) if i % 7 else None) for i in range(3000)] + [(3000, 9, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double").repartition(13, "value")
    want = {}
    for _, user, value in rows:
        want[user] = value if want.get(user) is None else want[user] if value is None else want[user] + value
    found = D.sums_in_order(df, ["user_id"], {"a": F.col("value")}, "event_id")
    assert {r["user_id"]: r["a"] for r in found.collect()} == want


def test_daily_rendering_does_not_depend_on_files(spark, tmp_path):
    """A day whose minutes are whole but for the last bit: the line is that of its events in order."""
    import random
    from datetime import datetime, timedelta

    import __spark_entry__ as entry

    def total(values):
        out = 0.0
        for v in values:
            out += v
        return out

    rng, values = random.Random(1), [0.1]
    while math.floor(total(values)) == math.floor(total(values[::-1])):
        values = [rng.randrange(1, 20_000) / 100 for _ in range(39)]
        values.append(round(1 - round(total(values), 2) % 1, 2))
    at = datetime(2024, 1, 2)
    rows = [(i, at + timedelta(minutes=i), 1, "click", v, '{"k": 1}') for i, v in enumerate(values)]
    spark.createDataFrame(rows[::-1], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    line = entry.queries()["p30_p31_daily_rendering"](spark, str(tmp_path)).first()["line"]
    assert line == f"screen {math.floor(total(values))} min"
