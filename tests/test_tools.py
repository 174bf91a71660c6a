"""The eight tools over a table of requests, and features of nine sensors."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from lapwing.operators import sensors as S
from lapwing.operators import tools as O

HOUR = 3_600_000
DAY = (dt.date(2023, 11, 20) - dt.date(1970, 1, 1)).days
AT = DAY * 24 * HOUR


@pytest.fixture(scope="module")
def world(spark):
    columns = "user_id int, hour long, motion_walking_min double, motion_stationary_min double, motion_automotive_min double, gps_distance_km double, gps_at_home_min double, screen_on_min double, screen_n_sessions long, key_chars_typed long, key_words_typed long, key_prop_pos double, key_prop_neg double, light_mean_lux double"
    rows = [
        (71, DAY * 24 + 9, 30.0, 30.0, 15.0, 3.5, 30.0, 55.0, 8, 320, 60, 0.22, 0.03, None),
        (71, DAY * 24 + 12, 0.0, 180.0, 0.0, 0.0, 180.0, 5.0, 1, 10, 2, 0.01, 0.02, 20.0),
        (71, DAY * 24 + 18, 99.0, 0.0, 0.0, 9.0, 0.0, 60.0, 9, 999, 99, 0.5, 0.5, 1.0),
        (71, DAY * 24 - 15, 10.0, 20.0, 0.0, 1.0, 0.0, 20.0, 2, 30, 6, None, None, None),
        (72, DAY * 24 - 15, 11.0, 21.0, 0.0, 1.0, 0.0, 21.0, 2, 31, 6, None, None, None),
        (72, DAY * 24 - 39, 0.0, 400.0, 0.0, 0.0, 0.0, 1.0, 1, 0, 0, None, None, None),
    ]
    prompts = [(1, 71, AT - 10 * HOUR, 7, "yes"), (2, 72, AT - 10 * HOUR, 2, "yes"), (3, 72, AT - 30 * HOUR, None, None), (4, 71, AT + 18 * HOUR, 9, "yes")]
    events = [(71, AT + k * HOUR, k, "app", f"e{k}") for k in range(24)]
    diaries = [(10, 71, "walked by the lake and felt calm"), (11, 72, "walked by the lake, calm water"), (12, 73, "work meeting deadline stress"), (13, 73, None), (14, 74, "calm calm lake")]
    return O.World(
        spark.createDataFrame(rows, columns), spark.createDataFrame(prompts, "prompt_id long, user_id int, ms long, desire int, available string"),
        spark.createDataFrame(events, "user_id int, ms long, event_id long, stream string, label string"), spark.createDataFrame(diaries, "case_id long, user_id int, text string"),
    )


def ask(spark, *calls):
    rows = [(k, 71, AT + 18 * HOUR, tool, args if args is None or isinstance(args, str) else json.dumps(args)) for k, (tool, args) in enumerate(calls)]
    return spark.createDataFrame(rows, "request_id long, user_id int, ms long, tool string, args string")


def test_timeline_labels_and_cues(spark, world):
    rows = O.behavioural_timeline(ask(spark, ("get_behavioral_timeline", {"date": "2023-11-20", "segment_hours": 3})), world).orderBy("start_min").collect()
    assert [(r.start_min, r.end_min) for r in rows] == [(180.0 * k, 180.0 * k + 180) for k in range(6)]
    morning, noon, empty = rows[3], rows[4], rows[0]
    assert morning.behaviour == "physically active, out-of-home / mobile, digitally engaged, communication-heavy"
    assert morning.cue == "possible positive tone in typing, possible engaged / activated state"
    assert (noon.behaviour, noon.cue) == ("sedentary, mostly at home", "possible low-energy / withdrawn state") and "low light / likely indoors (20 lux)" in noon.observed
    assert (empty.observed, empty.behaviour, empty.cue) == ("no data", "no sensed activity", "affect unclear from sensors")


def test_segments_are_held_to_bounds_and_cut_at_the_request(spark, world):
    calls = [("get_behavioral_timeline", {"date": "2023-11-20", "segment_hours": n}) for n in (0, 99)]
    rows = O.behavioural_timeline(ask(spark, *calls).withColumn("ms", F.lit(AT + 9 * HOUR + 30 * 60_000)), world).orderBy("request_id", "start_min").collect()
    assert [r.end_min for r in rows if r.request_id == 0] == [60.0 * k for k in range(1, 10)] + [570.0]
    assert [r.end_min for r in rows if r.request_id == 1] == [360.0, 570.0]
    # the hour that has not ended is not seen
    assert all(r.observed == "no data" for r in rows)


def test_nothing_later_is_seen(spark, world):
    calls = [("get_daily_summary", {"date": "2023-11-21"}), ("get_behavioral_timeline", {"date": "2023-11-21"}), ("get_daily_summary", {"date": "2023-11-20", "lookback_days": 1})]
    asked = ask(spark, *calls)
    days = {(r.request_id, r.day - DAY): r for r in O.daily_summary(asked, world).collect()}
    assert set(days) == {(0, 1), (2, -1), (2, 0)} and days[0, 1].overall is None and O.behavioural_timeline(asked, world).where("request_id = 1").count() == 0
    assert days[2, 0].overall == "low-mobility day (30min walking); moderate screen activity (60min)" and days[2, 0].evening == "no data (after EMA cutoff)"
    assert days[2, 0].morning == "mostly stationary (40%), walking 30min, driving 15min; traveled 3.5km; screen on 55min; 320 chars typed"
    history = O.receptivity_history(ask(spark, ("get_receptivity_history", "{}")), world).collect()
    assert [(r.prompt_id, r.receptive, r.n, r.n_receptive) for r in history] == [(1, True, 1, 1)]


def test_sensing_lines(spark, world):
    calls = [("query_sensing", {"modality": m, "hours_before_ema": 9, "hours_duration": 2}) for m in ("motion", "gps", "screen", "keyboard", "light", "music")] + [("query_sensing", {"modality": "motion", "hours_before_ema": 9, "hours_duration": 4, "granularity": "daily"})]
    rows = {(r.request_id, r.hour and r.hour - DAY * 24): (r.detail, r.coverage) for r in O.query_sensing(ask(spark, *calls), world).collect()}
    assert rows[0, 9] == ("walking 30min, stationary 30min, automotive 15min", "partial") and rows[0, 10] == (None, "partial")
    assert rows[1, 9][0] == "traveled 3.50 km, home 30min" and rows[2, 9][0] == "screen on 55min, 8 sessions" and rows[3, 9][0] == "320 chars typed, 3% negative sentiment, 22% positive sentiment"
    assert rows[4, 9] == (None, "off") and rows[5, 9] == (None, "off")
    assert rows[6, None] == ("stationary 210min, walking 30min, automotive 15min", "partial")


def test_fixes_of_no_way_are_told_as_the_sql_tells_them(spark, tmp_path):
    """An hour whose only fix has a way of 0: the operator names the data, the query's detail is empty like its SQL's."""
    import duckdb

    import __spark_entry__ as entry

    at = dt.datetime(2024, 1, 2, 9, 30)
    rows = [(0, at - dt.timedelta(hours=1), 7, "error", 0.0, '{"k": 5}'), (1, at + dt.timedelta(minutes=1), 7, "purchase", 3.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = [tuple(r) for r in entry.queries()["tool_query_sensing"](spark, str(tmp_path)).select("request_id", "hour", "detail", "coverage").collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT event_id, ts AT TIME ZONE 'UTC' AS ts, user_id, event_type, value, props FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = con.execute(f"SELECT request_id, hour, detail, coverage FROM ({entry.oracle_sql()['tool_query_sensing']})").fetchall()
    assert sorted(found, key=str) == sorted(want, key=str) and any(r[2] == "" for r in found)


def test_windows_of_events_meet_whole_pieces(spark):
    """Events against brute force over windows of all lengths; arguments are read once, and a window is few pieces."""
    import random

    rng = random.Random(3)
    events = [(rng.randrange(3), AT + rng.randrange(-9 * 24 * HOUR, 2 * 24 * HOUR), k, rng.choice(("app", "music")), f"e{k}") for k in range(1500)]
    calls = [(k, rng.randrange(3), AT + rng.randrange(24 * HOUR), rng.choice(("app", "music")), rng.choice((1, 3, 12, 24, 100, 168)), rng.choice((1, 2, 11, 13, 48, 168)), rng.choice((1, 3, 100))) for k in range(60)]
    asked = spark.createDataFrame([(k, u, ms, "query_raw_events", json.dumps({"modality": m, "hours_before_ema": b, "hours_duration": d, "max_events": n})) for k, u, ms, m, b, d, n in calls], "request_id long, user_id int, ms long, tool string, args string")
    world = O.World(None, None, spark.createDataFrame(events, "user_id int, ms long, event_id long, stream string, label string"))
    want = set()
    for k, u, ms, m, b, d, n in calls:
        begin = ms - b * HOUR
        inside = sorted((e[1], e[2]) for e in events if e[0] == u and e[3] == m and begin <= e[1] < min(ms, begin + d * HOUR))
        want |= {(k, i + 1, *e, max(len(inside) - n, 0)) for i, e in enumerate(inside[:n])}
    found = O.raw_events(asked, world)
    assert {(r.request_id, r.turn, r.ms, r.event_id, r.more) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # all in one projection, none in a filter above or below it
    assert sum("get_json_object" in line for line in plan.splitlines()) == 1


def test_baseline_names_and_days(spark, world):
    calls = [("compare_to_baseline", {"modality": "screen", "feature": f, "current_value": 5}) for f in ("screen_on_min", "on_min", "none")]
    rows = {r.request_id: r for r in O.compare_to_baseline(ask(spark, *calls).withColumn("ms", F.lit(AT + 11 * HOUR)), world).collect()}
    assert rows[0].n == 2 and rows[0].mean == 37.5 and rows[0].week_mean == 37.5 and rows[0].z == pytest.approx(-32.5 / math.sqrt(612.5))
    assert rows[1].mean == 37.5 and rows[2].n == 0 and rows[2].z is None
    similar = O.similar_days(ask(spark, ("find_similar_days", {})), world).collect()
    assert [(r.place, r.day - DAY, r.desire) for r in similar] == [(1, -1, 7)]
    peers = O.peer_days(ask(spark, ("find_peer_cases", {"search_mode": "sensing", "top_k": 10})), world).collect()
    assert {r.peer for r in peers} <= {72}


def test_peers_of_every_request(spark, sf_dir):
    """The query asks for every request, as its SQL does, not for every twentieth."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet')")
    found = entry.queries()["tool_peer_cases"](spark, sf_dir)
    rows = [tuple(r) for r in found.collect()]
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()['tool_peer_cases']})").fetchall()
    assert sorted(rows) == sorted(want) and any(r[0] % 20 for r in rows)


def test_peers_with_equal_days_go_by_user_and_day(spark):
    """Twenty users with the same day: the first ten by user, also where only ten are asked for."""
    days = [(u, DAY * 24 - 24 * 3 + 9, 10.0 + (u >= 50), 5.0 + (u >= 50)) for u in range(1, 21)] + [(60, DAY * 24 - 24 * 3 + 9, 1.0, 90.0), (99, DAY * 24 + 1, 30.0, 2.0)]
    hours = spark.createDataFrame(days, "user_id int, hour long, screen_on_min double, motion_walking_min double")
    prompts = spark.createDataFrame([(u, u, (DAY - 3) * 24 * HOUR + 20 * HOUR, 5, "yes") for u, *_ in days], "prompt_id long, user_id int, ms long, desire int, available string")
    asked = spark.createDataFrame([(7, 99, AT + 2 * HOUR, "find_peer_cases", '{"search_mode": "sensing", "top_k": 10}')], "request_id long, user_id int, ms long, tool string, args string")
    rows = O.peer_days(asked, O.World(hours, prompts, None)).orderBy("place").collect()
    assert [r.peer for r in rows] == list(range(1, 11))


def test_peer_texts_by_brute_force(spark, world):
    calls = [("find_peer_cases", {"query_text": t, "top_k": 2}) for t in ("calm by the lake", "deadline", "nothing known", " ")]
    rows = [(r.request_id, r.place, r.case_id, r.peer) for r in O.peer_texts(ask(spark, *calls), world).orderBy("request_id", "place").collect()]
    assert rows == [(0, 1, 14, 74), (0, 2, 11, 72), (1, 1, 12, 73)]
    # as in plain Python: idf of the diaries alone
    docs = {10: ["walked", "lake", "felt", "calm", "walked lake", "lake felt", "felt calm"], 11: ["walked", "lake", "calm", "water", "walked lake", "lake calm", "calm water"], 12: ["work", "meeting", "deadline", "stress", "work meeting", "meeting deadline", "deadline stress"], 13: [], 14: ["calm", "calm", "lake", "calm calm", "calm lake"]}
    idf = lambda t: math.log(6 / (1 + sum(t in d for d in docs.values()))) + 1
    vector = lambda d: {t: d.count(t) * idf(t) for t in set(d)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q, d = {t: idf(t) for t in ("calm", "lake", "calm lake")}, vector(docs[14])
    got = O.peer_texts(ask(spark, calls[0]), world).where("case_id = 14").first().similarity
    assert got == pytest.approx(sum(q[t] * d.get(t, 0) for t in q) / norm(q) / norm(d))


def test_answers_are_variants_and_problems_are_told(spark, world):
    calls = [
        ("query_raw_events", {"modality": "app", "hours_before_ema": 3, "max_events": 2}), ("query_raw_events", {"modality": "light", "hours_before_ema": 3}), ("query_sensing", {"modality": "gps"}), ("query_sensing", "no json"),
        ("nothing", {}), (None, {}), ("find_similar_days", None), ("get_daily_summary", {"date": "20 November"}), ("find_peer_cases", {"search_mode": "text", "query_text": "calm lake"}), ("query_raw_events", {"modality": "music", "hours_before_ema": 3}),
    ]
    rows = {r.request_id: (r.problem, json.loads(r.j) if r.j else None) for r in O.answers(ask(spark, *calls), world).withColumn("j", F.to_json("result")).collect()}
    assert len(rows) == len(calls)
    assert [e["label"] for e in rows[0][1]] == ["e15", "e16"] and rows[0][1][0]["more"] == 1
    assert rows[1][0] == "unknown modality" and rows[2][0] == "hours_before_ema is missing" and rows[3][0].startswith("modality is missing")
    assert rows[4][0] == rows[5][0] == "unknown tool" and rows[6][0] is None and len(rows[6][1]) == 1
    assert rows[7] == ("date is missing", None) and [r["case_id"] for r in rows[8][1]][0] == 14 and rows[9] == (None, [])
    assert O.answers(ask(spark, ("find_similar_days", {})).limit(0), world).count() == 0


# -- sensors -------------------------------------------------------------------------------------------------------


def one(spark, sensor, schema, *rows):
    out = S.features(spark.createDataFrame([("w", *r) for r in rows], "key string, " + schema), ["key"], sensor).collect()
    return out[0].asDict()


def test_first_column_at_hand_counts(spark):
    r = one(spark, "accelerometer", "mean_magnitude double, accel_mean_magnitude double, activity_counts int, coverage_pct double", (9.0, 1.0, 5, 50.0), (9.0, None, None, 70.0))
    assert r == {"key": "w", "accel_mean_mag": 1.0, "accel_activity_counts": 5.0, "accel_coverage_pct": 60.0}


def test_raw_axes_and_magnitudes(spark):
    r = one(spark, "accelerometer", "accel_x double, accel_z double", (3.0, 4.0), (None, 1.0), (0.6, 0.8))
    assert r["accel_mean_mag"] == pytest.approx(7 / 3) and r["accel_activity_counts"] == 1.0 and r["accel_coverage_pct"] == pytest.approx(200 / 3) and r["accel_std_mag"] == pytest.approx(4 / math.sqrt(3))
    r = one(spark, "accelerometer", "magnitude double, activity_counts double", (1.0, 2.0), (3.0, None), (float("nan"), 1.0))
    assert (r["accel_mean_mag"], r["accel_std_mag"], r["accel_activity_counts"]) == (2.0, pytest.approx(math.sqrt(2)), 3.0) and r["accel_coverage_pct"] == pytest.approx(200 / 3)


def test_fallbacks_of_the_others(spark):
    assert one(spark, "gps", "distance_km double, location_label string", (1.0, "a"), (2.0, "b"), (None, None)) == {"key": "w", "gps_n_captures": 3.0, "gps_distance_km": 3.0, "gps_location_entropy": 1.0}
    assert one(spark, "gps", "n_captures int, location_label string", (None, None)) == {"key": "w", "gps_n_captures": 0.0, "gps_location_entropy": None}
    assert one(spark, "sleep", "is_sleep boolean", (True,), (False,), (None,)) == {"key": "w", "sleep_duration_min": 1.0}
    assert one(spark, "motion", "walking_min double", (5.0,), (None,)) == {"key": "w", "motion_walking_min": 5.0, "motion_active_min": 5.0}
    assert one(spark, "motion", "active_min double, running_min double", (1.0, 5.0))["motion_active_min"] == 1.0
    assert one(spark, "app_usage", "amt_foreground_day_sec int, category string", (60, "My SOCIAL"), (120, None)) == {"key": "w", "app_total_min": 3.0, "app_social_min": 1.0, "app_comm_min": None}
    assert one(spark, "app_usage", "category string", ("social",)) == {"key": "w"}
    assert one(spark, "music", "is_listening boolean, n_tracks string", (None, "2"), (True, "x")) == {"key": "w", "mus_is_listening": True, "mus_n_tracks": 2.0}
    assert one(spark, "key_input", "prop_neg double", (None,), (0.5,)) == {"key": "w", "key_prop_neg": 0.5}
    assert one(spark, "light", "lux double", (1.0,), (None,)) == {"key": "w", "light_mean_lux": 1.0}
    with pytest.raises(ValueError):
        S.features(spark.range(1), ["id"], "smell")


def test_all_features_side_by_side(spark):
    make = lambda schema, *rows: spark.createDataFrame(list(rows), "key string, " + schema)
    frames = {"screen": make("app_total_min double, screen_on_min double", ("a", 1.0, 2.0), ("b", 3.0, 4.0)), "app_usage": make("amt_foreground_day_sec double", ("a", 600.0), ("c", 60.0)), "light": make("lux double")}
    rows = {r.key: r for r in S.all_features(frames, ["key"]).collect()}
    assert {k: (r.app_total_min, r.screen_on_min, r.light_mean_lux) for k, r in rows.items()} == {"a": (10.0, 2.0, None), "b": (3.0, 4.0, None), "c": (1.0, None, None)}
