"""Readers and writers of raw and derived files.  Paths may be on any store that Spark reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as C
from ..operators.intervals import first_by
from .scratch import written

PROMPT = "Study_ID int, timestamp_local timestamp_ntz, date_local date, emotion_driver string, PANAS_Pos double, PANAS_Neg double, ER_desire double, INT_availability string"
GPS = "epoch_gpscapture double, val_lat double, val_lon double, val_horizontal_accuracy double, timezone string"
ACCEL = "epoch_1sec long, timezone string, x_1sec float, y_1sec float, z_1sec float, id_participant string"

#: fixed values: forms of raw file names, by modality (participant, device where there is one, date)
FILE_NAMES = {
    "gps": [r"^GPS_data_(\d{3})_([A-Fa-f0-9\-]+)_(\d{4}-\d{2}-\d{2})_\S+\.csv$"],
    "motion_activity": [r"^MotionActivity_data_(\d{3})_([A-Fa-f0-9\-]+)_(\d{4}-\d{2}-\d{2})_\S+\.csv$"],
    "activity_transition": [r"^ActivityTransition_data_(\d{3})_([A-Fa-f0-9\-]+)_(\d{4}-\d{2}-\d{2})_\S+\.csv$"],
    "sleep": [r"^AndroidSleep_data_(\d{3})_([A-Fa-f0-9\-]+)_(\d{4}-\d{2}-\d{2})_\S+\.csv$"],
    "screen": [r"^ScreenOnTime_data_(\d{3})_([A-Fa-f0-9\-]+)_(\d{4}-\d{2}-\d{2})_\S+\.csv$", r"^ScreenOnTime_(\d{3})_.*_(\d{4}-\d{2}-\d{2}).*\.csv$"],
    "accel": [r"^(\d{3})_ACCEL_complete_agg_1sec_(\d{4}-\d{2}-\d{2}).*\.csv$"],
    "appusage": [r"^(\d{3})_APPUSAGE_usageLog_(\d{4}-\d{2}-\d{2}).*\.csv$"],
    "keyinput": [r"^FleksyKeyInput_data_(\d{3})_([A-Fa-f0-9\-]+)_(\d{4}-\d{2}-\d{2})_\S+\.csv$", r"^(\d{3})_FleksyKeyInput_.*_(\d{4}-\d{2}-\d{2}).*\.csv$"],
    "mus": [r"^(\d{3})_MUS_complete_(\d{4}-\d{2}-\d{2}).*\.csv$"],
    "motion": [r"^(\d{3})_MOTION_(?:complete|harmonized)_(\d{4}-\d{2}-\d{2}).*\.csv$", r"^MOTION_data_(\d{3})_([A-Fa-f0-9\-]+)_(\d{4}-\d{2}-\d{2})_\S+\.csv$"],
    "light": [r"^LIGHT_data_(\d{3})_([A-Fa-f0-9\-]+)_(\d{4}-\d{2}-\d{2})_\S+\.csv$"],
}


def sensor_csv(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> DataFrame:
    """Raw sensor files: a header, lenient rows (what does not parse is null), and each row's file name.

    Columns go by their names in each file's header, in whatever order; a file whose header lacks one of the schema's
    is left out whole, as are those whose name does not fit ``pattern``.  A header line has no comma inside quotes.
    Files that cannot be read raise.  The lines are gone through once more for the headers, without being parsed.
    """
    lines = (spark.read.option("pathGlobFilter", pattern) if pattern else spark.read).text(path)
    lines = lines.select("value", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("_metadata.file_block_start").alias("start"))
    names = [x.split()[0] for x in schema.split(",")]
    clean = lambda line: F.transform(F.split(F.regexp_replace(line, "[\\uFEFF\"\\r]", ""), ","), F.trim)
    # only a file's first line can name all columns, and there are as many header lines as files
    heads = lines.where((F.col("start") == 0) & F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(clean(F.col("value")), n)))
    heads = heads.groupBy("path").agg(F.min("value").alias("head"))
    orders = heads.groupBy("head").agg(F.collect_list("path").alias("paths")).toLocalIterator()  # one row a form of header
    parts = []
    for form in orders:
        have = [x.strip() for x in form["head"].replace("\ufeff", "").replace('"', "").replace("\r", "").split(",")]
        kinds = dict(x.split() for x in schema.split(","))
        whole = ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in have)
        read = spark.read.schema(whole).option("header", True).option("mode", "PERMISSIVE").csv(form["paths"])
        parts.append(read.select(*names, F.col("_metadata.file_name").alias("file")))
    if not parts:
        return spark.createDataFrame([], f"{schema}, file string")
    return reduce(DataFrame.unionByName, parts)


def prompt_folds(spark: SparkSession, base: str, split: str = "test", folds: range = range(1, 6)) -> DataFrame:
    """Prompts of the fold files group_{k}_{split}.csv with their fold; of a prompt in several files the first counts."""
    rows = sensor_csv(spark, base, PROMPT, f"group_[{folds[0]}-{folds[-1]}]_{split}.csv")
    rows = rows.withColumn("fold", F.regexp_extract("file", r"group_(\d+)_", 1).cast("int"))
    return first_by(rows, ["Study_ID", "timestamp_local"], F.col("file"), F.coalesce("emotion_driver", F.lit(""))).drop("file")


def daily_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Daily sensor tables with clean, padded participant ids."""
    return sensor_csv(spark, path, schema).drop("file").withColumn("id_participant", C.padded_id(F.col("id_participant")))


def file_roster(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, modality, pid, device, day): what file names say, by the first form that fits."""
    c = F.col(name)

    def taken(pattern: str) -> Column:
        groups = pattern.count("(") - pattern.count("(?:")
        part = lambda i: F.regexp_extract(c, pattern, i)
        return F.struct(part(1).alias("pid"), (part(2) if groups == 3 else F.lit(None).cast("string")).alias("device"), F.to_date(part(groups)).alias("day"))

    out = None
    for modality, patterns in FILE_NAMES.items():
        for p in patterns:
            hit = F.struct(F.lit(modality).alias("modality"), taken(p).alias("x"))
            out = F.when(c.rlike(p), hit) if out is None else out.when(c.rlike(p), hit)
    return names.withColumn("_m", out).where("_m is not null").select(name, "_m.modality", "_m.x.*")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(name): files under a path, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))


def texts_by_priority(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """(user, text): each user's whole document, from the first suffix there is; names are <user><suffix>."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))
    rank, user = None, F.col("file")
    for i, s in enumerate(suffixes):
        rank = F.when(F.col("file").endswith(s), i) if rank is None else rank.when(F.col("file").endswith(s), i)
        user = F.when(F.col("file").endswith(s), F.expr(f"left(file, length(file) - {len(s)})")).otherwise(user)
    return first_by(rows.withColumn("rank", rank).where("rank is not null").withColumn("user", user), ["user"], F.col("rank"), F.col("file")).select("user", "text")


def records_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines or documents with their file's name; lists predictions and truths are paired."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    return rows.select("file", F.posexplode(F.arrays_zip("predictions", "ground_truths")).alias("i", "pair")).select("file", "i", F.col("pair.predictions").alias("prediction"), F.col("pair.ground_truths").alias("truth"))


def write_hourly(rows: DataFrame, path: str, by: str = "modality") -> None:
    """The hourly store: partitioned by modality, so that a reader prunes; a modality is many tasks, by ranges of users."""
    rows.repartitionByRange(by, "user_id", "hour").sortWithinPartitions(by, "user_id", "hour").write.mode("overwrite").partitionBy(by).parquet(path)


def read_hourly(spark: SparkSession, path: str, modality: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("modality") == modality)


STORE_PARTS = 64


def _part(user: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(parts)).cast("int")


def _marks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A mark of each participant's rows of a modality, whatever their order: their number and two sums of hashes."""
    whole = [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]
    return rows.groupBy("modality", "user_id").agg(F.struct(F.count("*").alias("n"), *(F.sum(h.cast("decimal(38,0)")).alias(f"h{i}") for i, h in enumerate(whole))).alias("mark"))


def update_hourly(rows: DataFrame, path: str, parts: int = STORE_PARTS) -> int:
    """Put the participants of ``rows`` (user_id, modality, hour, ...) into the store, each in place of what it had in that modality.
    Returns how many (participant, modality) were new or different; nothing else is written, so the same update again writes nothing.

    The store is partitioned by modality and a part of the participants (as many parts as it was begun with); only partitions with a
    change are read and written anew, by dynamic overwrite: files take their place when the job commits, and a job that dies halfway
    can be run again.  Rows without a participant or modality, and modalities that ``rows`` lacks, are left as they are.
    """
    spark = rows.sparkSession
    columns = sorted(rows.columns)
    new = written(rows.where("user_id is not null and modality is not null").select(*columns).withColumn("part", _part(F.col("user_id"), parts)), "store-rows")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        old = spark.read.schema(new.schema).option("basePath", path).parquet(path)
        touched = F.broadcast(new.select("modality", "part").distinct())  # modalities times parts
        was = _marks(old.join(touched, ["modality", "part"], "left_semi"), columns).withColumnRenamed("mark", "was")
        changed = written(_marks(new, columns).join(was, ["modality", "user_id"], "left").where(~F.col("mark").eqNullSafe(F.col("was"))).select("modality", "user_id", _part(F.col("user_id"), parts).alias("part")), "store-changes")
        affected = F.broadcast(changed.select("modality", "part").distinct())
        kept = old.join(affected, ["modality", "part"], "left_semi").join(changed.select("modality", "user_id"), ["modality", "user_id"], "left_anti")
        out = kept.select(*new.columns).unionByName(new.join(changed.select("modality", "user_id"), ["modality", "user_id"], "left_semi").select(*new.columns))
        # what is read cannot be written over in one job
        out = written(out, "store-partitions")
        n = changed.count()
    else:
        out, n = new, new.select("modality", "user_id").distinct().count()
    if n:
        out.repartition("modality", "part").sortWithinPartitions("modality", "part", "user_id", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("modality", "part").parquet(path)
    return n


def stored_hours(spark: SparkSession, path: str, modality: str, users: list | None = None, parts: int = STORE_PARTS) -> DataFrame:
    """One modality of an updated store, of all or of some participants; only their parts are listed and read."""
    rows = spark.read.option("basePath", path).parquet(path).where(F.col("modality") == modality)
    if users is not None:
        asked = spark.createDataFrame([(u,) for u in users], T.StructType([rows.schema["user_id"]]))
        wanted = [r[0] for r in asked.select(_part(F.col("user_id"), parts)).distinct().collect()]
        rows = rows.where(F.col("part").isin(wanted) & F.col("user_id").isin(users))
    return rows.drop("part")


def flattened(rows: DataFrame, structs: list[str]) -> DataFrame:
    """Struct fields as prefixed columns; fields that begin with an underscore are dropped."""
    plain = [F.col(c) for c in rows.columns if c not in structs and not c.startswith("_")]
    inner = [F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in structs for f in rows.schema[s].dataType.names if not f.startswith("_")]
    return rows.select(*plain, *inner)


def write_predictions_csv(rows: DataFrame, path: str, structs: list[str]) -> None:
    flattened(rows, structs).write.mode("overwrite").option("header", True).csv(path)


def write_metrics_json(rows: DataFrame, path: str) -> None:
    """Metrics as JSON lines, in place of what is there."""
    rows.write.mode("overwrite").json(path)


def append_records(rows: DataFrame, path: str) -> None:
    """Records as JSON lines behind those that are there."""
    rows.write.mode("append").json(path)
