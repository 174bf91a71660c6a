"""Daily rollups of five modalities, and what a prompt knows of its user, on small tables."""

from pyspark.sql import functions as F

from lapwing.operators import daily as D
from lapwing.operators import pit as P

HOUR = 3_600_000


def made(spark, schema, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "day int, " + schema)


def one(df):
    rows = [r.asDict() for r in df.collect()]
    assert len(rows) == 1
    return {k: v for k, v in rows[0].items() if k != "day"}


def test_screen_days_are_capped(spark):
    schema = "screen_on_min double, screen_n_sessions long"
    assert one(D.screen_days(made(spark, schema, (1000.0, 3), (900.0, None)), ["day"])) == {"screen_total_min": 1440.0, "screen_n_sessions": 3}
    assert one(D.screen_days(made(spark, schema, (None, None)), ["day"])) == {"screen_total_min": 0.0, "screen_n_sessions": 0}


def test_app_days_shrink_in_proportion(spark):
    schema = "app_total_min double, app_social_min double, app_comm_min double, app_entertainment_min double, app_n_apps int"
    assert one(D.app_days(made(spark, schema, (2000.0, 1000.0, None, 30.0, 4), (880.0, 0.0, 100.0, 3.0, 0), (None, None, None, None, 2)), ["day"])) == {
        "app_total_min": 1440.0, "app_social_min": 500.0, "app_comm_min": 50.0, "app_entertainment_min": 16.5, "app_n_apps_mean": 3.0,
    }
    assert one(D.app_days(made(spark, schema, (100.0, 33.33, 1.0, 0.0, None)), ["day"]))["app_social_min"] == 33.33


def test_only_active_hours_make_a_day(spark):
    assert one(D.keyboard_days(made(spark, "key_n_sessions int, key_chars_typed int", (2, 10), (0, 99), (None, 7), (1, None)), ["day"])) == {"keyboard_n_sessions": 3, "keyboard_total_chars": 10}
    assert D.keyboard_days(made(spark, "key_n_sessions int, key_chars_typed int", (0, 99)), ["day"]).count() == 0
    light = lambda *v: D.light_days(made(spark, "light_mean_lux double", *((x,) for x in v)), ["day"])
    assert [one(light(*v))["light_category"] for v in ((9.0, 10.9), (10.0,), (499.0, None), (500.0,))] == ["dark", "indoor", "indoor", "outdoor"] and light(None).count() == 0
    music = lambda *v: D.music_days(made(spark, "mus_is_listening boolean, mus_n_tracks int", *v), ["day"])
    assert one(music((True, 3), (False, 5), (True, None), (None, 9))) == {"music_listening": True, "music_n_tracks": 3} and music((False, 1)).count() == 0


def test_profile_knows_earlier_prompts_only(spark):
    rows = [(k, 1, (24 * k + 9) * HOUR, d, a, t) for k, (d, a, t) in enumerate([(7, "yes", "a"), (2, "yes", "b"), (8, "no", "c"), (9, "YES ", "d"), (None, None, None), (1, "no", "e"), (5, "yes", "f")])]
    got = {r.prompt_id: r for r in P.profile_details(spark.createDataFrame(rows, "prompt_id int, user_id int, ms long, desire int, available string, diary string")).collect()}
    assert (got[0].n, got[0].no_desire, got[0].morning_rate) == (0, None, None) and (got[1].no_desire, got[2].no_desire, got[3].no_desire, got[3].unavailable) == (None, 1.0, 0.5, 0.5)
    assert (got[3].morning_n, got[3].morning_rate, got[3].evening_n) == (3, 1 / 3, 0)
    assert got[5].receptive_diary_1 is None and (got[6].receptive_diary_1, got[6].receptive_diary_2, got[6].other_diary_1, got[6].other_diary_2) == ("a", "d", "b", "c")
    assert got[6].no_desire == 0.75
