"""A training-data pipeline over ``documents``, one operator a stage.

STAGES are (name, function of (spark, docs, sf_dir)); each stage's result is written as Parquet and
read again as the next one's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm import decontamination, jaccard_join, packing, quality_classifier, secret_scan
from lapwing.llm.frames import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, model, 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the Jaccard join links; documents without words are no group."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets redacted, and their lengths counted again."""
    return secret_scan.redact(docs, secret_scan.fit(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the bins they go to."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: trained models, exact set joins and greedy packing are not SQL; tests compare with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what they hand on lies in the shared folder.

    Null and empty texts are scored as texts of no bytes, are no one's copies, hold no item and no secret, and are
    packed as one end each; of repeated rows with words one stays; an empty table gives an empty result; columns
    beside those of ``documents`` go along until the last stage, whatever their names.
    """
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, stage: tuple[int, tuple]) -> DataFrame:
        k, (_, work) = stage
        work(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        return spark.read.parquet(f"{base}/{k}")

    return reduce(step, enumerate(STAGES), table(spark, sf_dir, "documents"))
