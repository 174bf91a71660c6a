"""Queries for file listings and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..sources import bindings as B
from ..sources import files as S
from ..sources.scratch import shared_path
from .base import events_of, query, rounded

DATE = "strftime(CAST(to_timestamp(ms // 1000) AS TIMESTAMP), '%Y-%m-%d')"


@query(
    "s06_a11_file_roster",
    f"""WITH {B.EV}, n AS (SELECT DISTINCT pid, k % 4 AS kind, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS d FROM ev)
    SELECT CASE kind WHEN 0 THEN 'gps' WHEN 1 THEN 'accel' ELSE 'screen' END AS modality, CASE WHEN length(CAST(pid AS VARCHAR)) >= 3 THEN CAST(pid AS VARCHAR) ELSE lpad(CAST(pid AS VARCHAR), 3, '0') END AS pid, CASE kind WHEN 0 THEN 'ab12' END AS device, CAST(d AS DATE) AS day FROM n WHERE kind < 3""",
)
@events_of
def file_roster(ev):
    """Names of three forms, and one that fits none."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ms") / 86_400_000).cast("int")).cast("string")
    rows = ev.select("pid", (F.col("k") % 4).alias("kind"), day.alias("d")).distinct()
    pid = C.padded_id(F.col("pid"))
    name = (
        F.when(F.col("kind") == 0, F.concat(F.lit("GPS_data_"), pid, F.lit("_ab12_"), "d", F.lit("_1.csv"))).when(F.col("kind") == 1, F.concat(pid, F.lit("_ACCEL_complete_agg_1sec_"), "d", F.lit(".csv")))
        .when(F.col("kind") == 2, F.concat(F.lit("ScreenOnTime_"), pid, F.lit("_x_"), "d", F.lit(".csv"))).otherwise("notes.txt")
    )
    return S.file_roster(rows.select(name.alias("name"))).drop("name")


@query("s13_flattened_records", "SELECT doc_id, n_chars > 1500 AS prediction_long, n_chars AS prediction_size, quality AS truth_quality FROM documents JOIN labels USING (doc_id)")
def flattened(spark, sf_dir):
    """Struct fields as prefixed columns."""
    rows = B.diary(spark, sf_dir).where("quality is not null").select(
        "doc_id", F.struct((F.col("n_chars") > 1500).alias("long"), F.col("n_chars").alias("size"), F.lit(1).alias("_raw")).alias("prediction"), F.struct("quality").alias("truth")
    )
    return S.flattened(rows, ["prediction", "truth"])


@query("s07_s12_hourly_store", f"WITH {B.EV}, {B.SIGNALS} SELECT user_id, hour, n FROM sg WHERE modality = 'view'")
def hourly_store(spark, sf_dir):
    """Write the partitioned store, read one modality of it."""
    path = shared_path(spark, "hourly")
    S.write_hourly(B.signals(B.events(spark, sf_dir)), path)
    return S.read_hourly(spark, path, "view").select("user_id", "hour", "n")


@query("s12_incremental_store", f"WITH {B.EV}, {B.SIGNALS} SELECT user_id, modality, hour, n, round(total, 3) AS total FROM sg")
def incremental_store(spark, sf_dir):
    """A store begun with half of the users and other sums, then brought up to date."""
    path, rows = shared_path(spark, "store"), B.signals(B.events(spark, sf_dir))
    S.update_hourly(rows.where("user_id % 2 = 0").withColumn("total", F.when(F.col("user_id") % 4 == 0, F.col("total")).otherwise(0.0)), path)
    S.update_hourly(rows, path)
    return rounded(spark.read.parquet(path).select("user_id", "modality", "hour", "n", "total"), 3)
