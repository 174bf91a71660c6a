"""Streams end with what the batch operators return."""

from pyspark.sql import functions as F

from lapwing.streaming import live


def put(spark, tmp_path, sf_dir, parts=3):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("user_id < 20")
    path = str(tmp_path / "in")
    cuts = events.selectExpr(f"percentile_approx(event_id, array({', '.join(str(i / parts) for i in range(1, parts))}))").first()[0]
    for i in range(parts):
        lo, hi = (cuts[i - 1] if i else -1), (cuts[i] if i < parts - 1 else 1 << 60)
        events.where((F.col("event_id") > lo) & (F.col("event_id") <= hi)).coalesce(1).write.mode("append").parquet(path)
    return events, path


def test_windows_equal_batch(spark, tmp_path, sf_dir):
    events, path = put(spark, tmp_path, sf_dir)
    for name, work in (("tumbling", live.tumbling), ("sliding", live.sliding), ("latest", live.latest)):
        got = live.run_to_memory(work(live.source(spark, path)), f"t_{name}", str(tmp_path / f"c_{name}"))
        rounded = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
        assert rounded(got) == rounded(work(events)), name


def test_join_equals_batch(spark, tmp_path, sf_dir):
    events, path = put(spark, tmp_path, sf_dir)
    stream = live.prompts_with_signals(live.source(spark, path)).where("event_id is not null")
    got = live.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    want = live.prompts_with_signals(events).where("event_id is not null")
    assert sorted(got.collect()) == sorted(want.collect())


def test_pairs_across_batches_and_timers(spark, tmp_path):
    """Unlocks meet locks of later batches, and one that is given up leaves no state."""
    hour = 3_600_000
    batches = [
        [(1, 0, "unlocked"), (2, 0, "unlocked"), (3, 0, "unlocked")],
        [(1, hour // 6, "locked"), (1, hour // 5, "locked"), (2, hour // 4, "unlocked")],
        [(2, hour, "locked"), (4, 30 * hour, "unlocked")],
        [(3, 31 * hour, "locked"), (4, 30 * hour + 1000, "locked"), (5, 40 * hour, "locked")],
    ]
    for i, rows in enumerate(batches):
        states = [(100 * i + j, u, 24 * hour + ms, s) for j, (u, ms, s) in enumerate(rows)]
        spark.createDataFrame(states, "event_id long, user_id long, ms long, state string").withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, ms long, state string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    with live.with_state_store(spark):
        out = live.run_to_table(live.paired_sessions(stream), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert sorted((u, a - 24 * hour, b - 24 * hour) for u, a, b in out) == [(1, 0, hour // 6), (2, hour // 4, hour), (4, 30 * hour, 30 * hour + 1000)]
