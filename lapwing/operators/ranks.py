"""Ranks and exact quantiles of keys of any size, without a window over a key.

Distinct values are counted first.  The counts are dealt by ranges of (key, value), so a key's values lie in order over
several tasks; each task sums its own part, and what lies before it comes from one row for each key and range.  No task
holds more than its range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def running(counts: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """``counts`` (one row a key and value) with ``before_<c>`` for each of ``sums``: its sum over the key's smaller values."""
    # ranges are drawn from a sample, so the parts are written down before they are asked for twice
    parts = written(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    # a key has one row here for each range that it lies in
    ranges = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = parts.groupBy(*keys, "_part").agg(*(F.sum(c).alias(c) for c in sums))
    each = each.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_part").alias("_of"), *(F.coalesce(F.sum(c).over(ranges), F.lit(0)).alias(f"_base_{c}") for c in sums))
    rows = parts.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_own_{c}") for c in sums))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_part") == F.col("_of"))
    return rows.join(each, same).select(*counts.columns, *((F.col(f"_own_{c}") + F.col(f"_base_{c}")).alias(f"before_{c}") for c in sums))


def ranked(counts: DataFrame, keys: list[str], value: str, count: str = "c") -> DataFrame:
    """``counts`` with ``rank``: that of each of a value's rows within its key, from 1, ties sharing their mean."""
    return running(counts, keys, value, [count]).withColumn("rank", F.col(f"before_{count}") + (F.col(count) + 1) / 2).drop(f"before_{count}")


def at_places(counts: DataFrame, keys: list[str], value: str, places: dict[str, Column], count: str = "c") -> DataFrame:
    """One row a key: ``n`` and, for each name, the value at a place from 0 (a fraction lies between two values; places are worked
    out from ``n``).  A key without rows is not returned."""
    totals = counts.groupBy(*keys).agg(F.sum(count).alias("n")).where("n > 0")
    totals = totals.select(*(F.col(k).alias(f"_total_{k}") for k in keys), "n", *(p.cast("double").alias(f"_at_{name}") for name, p in places.items()))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_total_{k}")) for k in keys], F.lit(True))
    # few rows a key are wanted: all others go before the grouping
    rows = running(counts, keys, value, [count]).join(totals, same).drop(*(f"_total_{k}" for k in keys))
    holds = lambda place: (place >= F.col(f"before_{count}")) & (place < F.col(f"before_{count}") + F.col(count))
    low = {name: F.floor(F.col(f"_at_{name}")) for name in places}
    high = {name: F.ceil(F.col(f"_at_{name}")) for name in places}
    wanted = reduce(Column.__or__, [holds(p) for side in (low, high) for p in side.values()])
    out = rows.where((F.col(count) > 0) & wanted).groupBy(*keys, "n", *(f"_at_{name}" for name in places)).agg(
        *(F.max(F.when(holds(low[name]), F.col(value))).alias(f"_low_{name}") for name in places), *(F.max(F.when(holds(high[name]), F.col(value))).alias(f"_high_{name}") for name in places)
    )
    share = lambda name: F.col(f"_at_{name}") - low[name]
    return out.select(*keys, "n", *((F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * share(name)).alias(name) for name in places))


def medians_of_others(rows: DataFrame, columns: list[str], fold: str, folds: int) -> DataFrame:
    """(test_fold, columns): exact medians of each column over the rows of the other folds; null where they have none.

    Rows are not copied: a value has one count for each fold, and the sums of all but one fold run side by side.
    """
    cells = rows.select(F.col(fold).cast("int").alias("_fold"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("_c"))
    cells = cells.select("_fold", "_c.column", "_c.x").where(F.col("x").isNotNull())
    tests = range(1, folds + 1)
    counts = cells.groupBy("column", "x").agg(*(F.count_if(F.col("_fold") != f).alias(f"c{f}") for f in tests))
    held = written(running(counts, ["column"], "x", [f"c{f}" for f in tests]), "running")
    sizes = held.groupBy("column").agg(*(F.sum(f"c{f}").alias(f"n{f}") for f in tests))
    met = held.join(F.broadcast(sizes), "column")  # one row a column

    def middle(f: int) -> list[Column]:
        holds = lambda place: (place >= F.col(f"before_c{f}")) & (place < F.col(f"before_c{f}") + F.col(f"c{f}"))
        return [F.max(F.when(holds(F.floor((F.col(f"n{f}") - 1 + k) / 2)), F.col("x"))).alias(f"m{f}_{k}") for k in (0, 1)]

    found = met.groupBy("column").agg(*(m for f in tests for m in middle(f)))
    long = found.select("column", F.explode(F.array(*(F.struct(F.lit(f).alias("test_fold"), ((F.col(f"m{f}_0") + F.col(f"m{f}_1")) / 2).alias("m")) for f in tests))).alias("_f")).select("column", "_f.test_fold", "_f.m")
    every = rows.sparkSession.range(1, folds + 1).select(F.col("id").cast("int").alias("test_fold"))
    return every.join(long.groupBy("test_fold").agg(*(F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in columns)), "test_fold", "left")
