"""Session-side helpers shared by the operators: tables, shared scratch folder, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder as shared_dir  # noqa: F401
from ..sources.scratch import written as materialise  # noqa: F401

#: Bytes of text that one numpy step works on; bounds a worker's memory.
STEP_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(docs: DataFrame) -> DataFrame:
    """(did, rid, doc_id, text): did and rid tell rows apart when ids repeat or are null.  Rows that
    agree in id and text share both, which is harmless: every operator gives them the same result."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("did"),
        F.xxhash64(F.col("doc_id"), F.col("text")).alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before them until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def steps(sizes: list[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows 0..n into runs whose sizes sum to about ``limit``."""
    at = have = 0
    for i, size in enumerate(sizes):
        if have and have + size > limit:
            yield at, i
            at, have = i, 0
        have += size
    if at < len(sizes):
        yield at, len(sizes)


def per_step(work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], *columns: str) -> Callable:
    """mapInArrow function that hands ``work`` pieces of each Arrow batch of about STEP_BYTES of ``columns`` (or of text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns or ("text",))
            for i, j in steps([int(x) + 16 for x in sizes]):
                yield from work(batch.slice(i, j - i))

    return run


def crc_fold(modulus: int) -> F.Column:
    """crc32 of the document's number written as text, modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus
