"""Readers and writers on files made here."""

import datetime
import gzip
import json

import pytest
from pyspark.sql import functions as F

from lapwing.sources import files as S
from lapwing.sources import scratch


def test_one_split_and_all_splits(spark, tmp_path):
    head = "Study_ID,timestamp_local,date_local,emotion_driver,PANAS_Pos,PANAS_Neg,ER_desire,INT_availability\n"
    for k in range(1, 6):
        rows = f"{k},2024-01-0{k} 10:00:00,2024-01-0{k},\"tired, but fine\",1.5,2,7,yes\n" + (f"1,2024-01-01 10:00:00,2024-01-01,again,9,9,9,no\n" if k == 3 else "")
        (tmp_path / f"group_{k}_test.csv").write_text(head + rows)
    (tmp_path / "group_1_train.csv").write_text(head + "8,2024-02-01 10:00:00,2024-02-01,,,,,\n")
    one = S.prompt_folds(spark, str(tmp_path), "test", range(2, 3)).collect()
    assert [(r.Study_ID, r.timestamp_local, r.date_local, r.emotion_driver, r.fold) for r in one] == [(2, datetime.datetime(2024, 1, 2, 10), datetime.date(2024, 1, 2), "tired, but fine", 2)]
    whole = {r.Study_ID: r for r in S.prompt_folds(spark, str(tmp_path)).collect()}
    assert sorted(whole) == [1, 2, 3, 4, 5] and whole[1].fold == 1 and whole[1].PANAS_Pos == 1.5
    assert [(r.Study_ID, r.PANAS_Pos) for r in S.prompt_folds(spark, str(tmp_path), "train").collect()] == [(8, None)]


def test_daily_tables_have_padded_ids(spark, tmp_path):
    (tmp_path / "daily.csv").write_text('id_participant,dt_feature,amt\n"""7""",2024-01-01,1.5\n 42 ,2024-01-02,x\n1001,2024-01-03,2\n')
    rows = S.daily_csv(spark, str(tmp_path / "daily.csv"), "id_participant string, dt_feature date, amt double").orderBy("dt_feature").collect()
    assert [(r.id_participant, r.amt) for r in rows] == [("007", 1.5), ("042", None), ("1001", 2.0)]


def test_sensor_files_by_name_and_header(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("GPS_data_001_ab_2024-01-01_1.csv", "id_file,epoch_gpscapture,val_lat,val_lon,val_horizontal_accuracy,timezone\n1,100,40.5,-74,5,-05:00\n1,bad,41.5,-74,,-05:00\n")
    put("GPS_data_001_ab_2024-01-02_1.csv", "timezone,val_lon,val_lat,epoch_gpscapture,val_horizontal_accuracy\n-04:00,-75,42,200,6\n")
    put("GPS_data_001_ab_2024-01-03_1.csv", "epoch_gpscapture,val_lat\n300,43\n")
    put("GPS_data_002_ab_2024-01-03_1.csv", "")
    put("LIGHT_data_001.csv", "epoch_gpscapture,val_lat,val_lon,val_horizontal_accuracy,timezone\n400,44,1,1,x\n")
    (tmp_path / "GPS_data_003_a b_2024-01-01_1.csv.gz").write_bytes(gzip.compress(b"epoch_gpscapture,val_lat,val_lon,val_horizontal_accuracy,timezone\n500,45,1,1,x\n"))
    rows = S.sensor_csv(spark, str(tmp_path), S.GPS, "GPS_data_*.csv*").collect()
    assert sorted((r.epoch_gpscapture or 0, r.val_lat, r.val_lon, r.timezone) for r in rows) == [(0, 41.5, -74, "-05:00"), (100, 40.5, -74, "-05:00"), (200, 42, -75, "-04:00"), (500, 45, 1, "x")]
    assert {r.file for r in rows if r.epoch_gpscapture == 200} == {"GPS_data_001_ab_2024-01-02_1.csv"}
    put("GPS_data_009_x_2024-01-01_1.csv.gz", "not packed")
    with pytest.raises(Exception, match="GPS_data_009|gzip"):
        S.sensor_csv(spark, str(tmp_path), S.GPS, "GPS_data_*.csv*").collect()


def test_texts_by_suffix(spark, tmp_path):
    for name, text in {"user_1_memory.txt": "one\ntwo", "user_1_memory_more.txt": "no", "user_2_memory_more.txt": "two", "notes.txt": "x"}.items():
        (tmp_path / name).write_text(text)
    rows = S.texts_by_priority(spark, str(tmp_path), ["_memory.txt", "_memory_more.txt"])
    assert sorted(map(tuple, rows.collect())) == [("user_1", "one\ntwo"), ("user_2", "two")]


def test_records_and_metrics(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"predictions": [{"x": 1}, {"x": 2}], "ground_truths": [{"x": 5}, {"x": 6}]}, indent=1))
    kind = "predictions array<struct<x:int>>, ground_truths array<struct<x:int>>"
    rows = S.records_json(spark, str(tmp_path / "a.json"), kind).orderBy("i").collect()
    assert [(r.file, r.i, r.prediction.x, r.truth.x) for r in rows] == [("a.json", 0, 1, 5), ("a.json", 1, 2, 6)]
    lines = str(tmp_path / "lines")
    S.append_records(spark.range(2), lines)
    S.append_records(spark.range(2, 3), lines)
    assert sorted(r.id for r in spark.read.json(lines).collect()) == [0, 1, 2]
    for n in (1, 2):
        S.write_metrics_json(spark.range(n), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2


def test_hourly_store_is_many_tasks_a_modality(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 100).alias("user_id"), F.col("id").alias("hour"), F.lit("view").alias("modality"))
    S.write_hourly(rows, str(tmp_path / "store"))
    assert S.read_hourly(spark, str(tmp_path / "store"), "view").count() == 4000
    assert S.read_hourly(spark, str(tmp_path / "store"), "view").where("user_id = 5").count() == 40


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("X", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_path(Cluster(), "x")
    assert scratch.written(spark.range(3), "three").count() == 3


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_incremental_store_touches_changed_partitions_only(spark, tmp_path):
    store = tmp_path / "store"
    made = lambda users, modality, total=1.0: spark.createDataFrame([(u, h, modality, total) for u in users for h in range(3)], "user_id long, hour long, modality string, total double")
    assert S.update_hourly(made(range(40), "view").unionByName(made(range(10), "click")), str(store), parts=8) == 50
    first = _files(store)
    assert len({f.rsplit("/", 1)[0] for f in first if "view" in f}) == 8
    # the same again, in another order: nothing is written
    assert S.update_hourly(made(range(39, -1, -1), "view").repartition(3), str(store), parts=8) == 0 and _files(store) == first
    # one participant changes: one partition is another
    again = made(range(40), "view").where("user_id <> 5").unionByName(made([5], "view", 2.0))
    assert S.update_hourly(again, str(store), parts=8) == 1
    second = _files(store)
    changed = {f.rsplit("/", 1)[0] for f, _ in set(second.items()) ^ set(first.items())}
    assert len(changed) == 1 and changed.pop().startswith("modality=view")
    rows = S.stored_hours(spark, str(store), "view", parts=8)
    assert rows.count() == 120 and rows.agg({"total": "sum"}).first()[0] == 123.0
    assert S.stored_hours(spark, str(store), "view", [5, 99], parts=8).select("total").distinct().collect()[0].total == 2.0
    assert S.stored_hours(spark, str(store), "click", parts=8).count() == 30
    # a new participant, a new modality, rows without an owner, no rows at all
    assert S.update_hourly(made([77], "light").unionByName(made([None], "light")).unionByName(made([3], None)), str(store), parts=8) == 1
    assert S.update_hourly(made([], "view"), str(store), parts=8) == 0
    assert spark.read.parquet(str(store)).count() == 153


def test_begin_an_empty_store(spark, tmp_path):
    rows = spark.createDataFrame([], "user_id long, hour long, modality string")
    assert S.update_hourly(rows, str(tmp_path / "none")) == 0 and not (tmp_path / "none").exists()
