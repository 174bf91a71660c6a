"""Canonical frames made from the given tables, and the same as SQL common table expressions.

The operators take canonical frames; FIXTURES.md says how each is bound to the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times as T

APPS = ("com.instagram.android", "com.whatsapp", "com.spotify.music", "com.android.chrome", "com.netflix.mediaclient", "com.google.android.apps.docs", "android", "org.unknown.app")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, pid (a dense participant), event_type, value, k, ms, zone."""
    k = F.get_json_object("props", "$.k").cast("long")
    zone = F.when(k % 17 == 0, "+00:00").when(F.col("user_id") % 3 == 0, "-05:00").when(F.col("user_id") % 3 == 1, "-04:00").otherwise("+05:30")
    return read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 10).alias("pid"), "event_type", "value", k.alias("k"), T.epoch_ms(F.col("ts")).alias("ms"), zone.alias("zone"))


EV = """ev AS (
  SELECT event_id, user_id, user_id % 10 AS pid, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS ms,
    CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 17 = 0 THEN '+00:00' WHEN user_id % 3 = 0 THEN '-05:00' WHEN user_id % 3 = 1 THEN '-04:00' ELSE '+05:30' END AS zone
  FROM events)"""


def prompts(ev: DataFrame) -> DataFrame:
    """prompt_id, user_id, ms, value, desire, available, state, platform, fold."""
    return ev.where("event_type = 'purchase'").select(
        F.col("event_id").alias("prompt_id"), "user_id", "ms", "value", (F.col("k") % 11).alias("desire"), F.when(F.col("k") % 2 == 0, "yes").otherwise("no").alias("available"),
        (F.col("value") > 50).alias("state"), F.when(F.col("user_id") % 3 != 0, "ios").otherwise("android").alias("platform"), (F.col("user_id") % 5 + 1).alias("fold"),
    )


PROMPTS = """pr AS (
  SELECT event_id AS prompt_id, user_id, ms, value, k % 11 AS desire, CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END AS available, value > 50 AS state,
    CASE WHEN user_id % 3 <> 0 THEN 'ios' ELSE 'android' END AS platform, user_id % 5 + 1 AS fold
  FROM ev WHERE event_type = 'purchase')"""


def signals(ev: DataFrame) -> DataFrame:
    """Hourly bins: user_id, modality, hour, n, total, mean."""
    return (
        ev.where(F.col("event_type").isin("click", "view", "error"))
        .groupBy("user_id", F.col("event_type").alias("modality"), T.hour_of(F.col("ms")).alias("hour"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    )


SIGNALS = """sg AS (
  SELECT user_id, event_type AS modality, ms // 3600000 AS hour, count(*) AS n, sum(value) AS total, avg(value) AS mean
  FROM ev WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL)"""


def fixes(ev: DataFrame) -> DataFrame:
    """pid, fix_id, ms, lat, lon, accuracy, zone; k = 99 is (0, 0), every thirteenth k has no accuracy."""
    k = F.col("k")
    return ev.select(
        "pid", F.col("event_id").alias("fix_id"), "ms", "zone", F.when(k == 99, 0.0).otherwise(40 + (k - 50) / 1000).alias("lat"), F.when(k == 99, 0.0).otherwise(-74 + F.col("value") / 10000).alias("lon"),
        F.when(k % 13 != 0, F.col("value") * 10).alias("accuracy"),
    )


FIXES = """fx AS (
  SELECT pid, event_id AS fix_id, ms, zone, CASE WHEN k = 99 THEN 0.0 ELSE 40 + (k - 50) / 1000.0 END AS lat, CASE WHEN k = 99 THEN 0.0 ELSE -74 + value / 10000 END AS lon,
    CASE WHEN k % 13 <> 0 THEN value * 10 END AS accuracy
  FROM ev)"""


def motions(ev: DataFrame) -> DataFrame:
    """pid, ms, category, tie."""
    category = F.create_map(*(F.lit(x) for x in ("click", "walking", "view", "stationary", "purchase", "automotive", "error", "unclassified", "signup", "running")))
    return ev.select("pid", "ms", category[F.col("event_type")].alias("category"), F.col("event_id").alias("tie"), "zone")


MOTIONS = """mo AS (
  SELECT pid, ms, CASE event_type WHEN 'click' THEN 'walking' WHEN 'view' THEN 'stationary' WHEN 'purchase' THEN 'automotive' WHEN 'error' THEN 'unclassified' ELSE 'running' END AS category, event_id AS tie, zone
  FROM ev)"""


def screens(ev: DataFrame) -> DataFrame:
    """pid, ms, state, tie, zone."""
    return ev.where(F.col("event_type").isin("click", "view")).select("pid", "ms", F.when(F.col("event_type") == "click", "unlocked").otherwise("locked").alias("state"), F.col("event_id").alias("tie"), "zone")


SCREENS = """sc AS (
  SELECT pid, ms, CASE event_type WHEN 'click' THEN 'unlocked' ELSE 'locked' END AS state, event_id AS tie, zone FROM ev WHERE event_type IN ('click', 'view'))"""


def app_windows(ev: DataFrame) -> DataFrame:
    """pid, app, start_ms, end_ms, foreground_ms, tie, with accumulating snapshots of one window as rows that end later."""
    app = F.array(*map(F.lit, APPS))[(F.col("k") % 8).cast("int")]
    base = ev.select("pid", app.alias("app"), F.col("ms").alias("start_ms"), (F.col("ms") + F.floor(F.col("value") * 60000)).cast("long").alias("end_ms"), F.floor(F.col("value") * 30000).cast("long").alias("foreground_ms"), F.col("event_id").alias("tie"))
    later = base.where("tie % 3 = 0").withColumn("end_ms", F.col("end_ms") + 600_000).withColumn("foreground_ms", F.col("foreground_ms") + 300_000)
    return base.unionByName(later)


WINDOWS = (
    """aw0 AS (SELECT pid, list_extract(["""
    + ", ".join(f"'{a}'" for a in APPS)
    + """], CAST(k % 8 + 1 AS INT)) AS app, ms AS start_ms, ms + CAST(floor(value * 60000) AS BIGINT) AS end_ms, CAST(floor(value * 30000) AS BIGINT) AS foreground_ms, event_id AS tie FROM ev),
aw AS (SELECT * FROM aw0 UNION ALL SELECT pid, app, start_ms, end_ms + 600000, foreground_ms + 300000, tie FROM aw0 WHERE tie % 3 = 0)"""
)


def typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ord, text, password: typing sessions."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("ord"), "text", (F.col("role") == "system").alias("password"))


def diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, user, fold, text, lang, n_chars, quality, toxic."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    fold = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 5 + 1
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("source").alias("user"), fold.alias("fold"), "text", "lang", "n_chars", "quality", "toxic")


DIARY = """di AS (
  SELECT d.doc_id, source AS user_, CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 5 + 1 AS fold, text, lang, n_chars, quality, toxic
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, day, quantity, price: one row a participant and date."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return (
        o.join(li, o.o_orderkey == li.l_orderkey)
        .groupBy(F.col("o_custkey").alias("participant"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"))
        .agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"))
    )


DAILY = """da AS (
  SELECT o_custkey AS participant, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""
