"""Scores of predictions, forecasts from the past, rank statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranks import at_places, ranked


def regression(rows: DataFrame, keys: list[str], truth: str = "y", guess: str = "p", least: int = 2) -> DataFrame:
    """n, mae, means and population deviations over pairs without a null."""
    kept = rows.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    out = kept.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col(truth) - F.col(guess))).alias("mae"), F.avg(truth).alias("mean_truth"), F.avg(guess).alias("mean_guess"),
        F.stddev_pop(truth).alias("sd_truth"), F.stddev_pop(guess).alias("sd_guess"),
    )
    return out.where(F.col("n") >= least)


def classification(rows: DataFrame, keys: list[str], truth: str = "y", guess: str = "p", least: int = 2, both_classes: bool = True) -> DataFrame:
    """n, prevalence, balanced accuracy, binary and macro F1 over pairs of booleans without a null; a quotient
    by nothing is 0."""
    y, p = F.col(truth), F.col(guess)
    kept = rows.where(y.isNotNull() & p.isNotNull())
    counts = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1, f0 = part(2 * tp, 2 * tp + fp + fn), part(2 * tn, 2 * tn + fp + fn)
    out = counts.withColumn("prevalence", (tp + fn) / F.col("n")).withColumn("balanced_accuracy", (part(tp, tp + fn) + part(tn, tn + fp)) / 2).withColumn("f1", f1).withColumn("macro_f1", (f1 + f0) / 2)
    out = out.where(F.col("n") >= least)
    return out.where((tp + fn > 0) & (tn + fp > 0)) if both_classes else out


def average_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rank``: ranks from 1 within keys, ties sharing their mean."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    return rows.join(ranked(counts, keys, value, "_c").drop("_c"), [*keys, value])


def auc(rows: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Area under the ROC curve from rank sums; keys with one class are left out.  Scores are counted, so ranks are
    those of distinct scores and no row is ranked by itself."""
    kept = rows.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    counts = kept.groupBy(*keys, score).agg(F.count("*").alias("_c"), F.count_if(F.col(truth)).alias("_yes"))
    out = ranked(counts, keys, score, "_c").groupBy(*keys).agg(F.sum("_yes").alias("n1"), F.sum(F.col("_c") - F.col("_yes")).alias("n0"), F.sum(F.col("rank") * F.col("_yes")).alias("r"))
    return out.where("n1 > 0 and n0 > 0").select(*keys, ((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


def personal_threshold(rows: DataFrame, user: str, guess: str, least: int = 3, floor: float = 1e-6) -> DataFrame:
    """``high``: whether a prediction is over its user's mean plus deviation of predictions; users with few rows
    or a deviation of nothing are left out."""
    stats = rows.groupBy(user).agg(F.count(guess).alias("_n"), F.avg(guess).alias("_m"), F.stddev_samp(guess).alias("_s")).where((F.col("_n") >= least) & (F.col("_s") >= floor))
    return rows.join(stats, user).withColumn("high", F.col(guess) > F.col("_m") + F.col("_s")).drop("_n", "_m", "_s")


def over_folds(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample and population deviation of each metric over folds."""
    return rows.groupBy(*keys).agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("sd_pop", F.stddev_pop))))


def forecasts(rows: DataFrame, window: int = 3) -> DataFrame:
    """last and rolling: the user's previous value, and the mean of the ``window`` before; rows: user_id, fold, ms, prompt_id, value."""
    w = Window.partitionBy("fold", "user_id").orderBy("ms", "prompt_id")
    return rows.withColumn("turn", F.row_number().over(w)).withColumn("last", F.lag("value").over(w)).withColumn("rolling", F.avg("value").over(w.rowsBetween(-window, -1)))


def rankings(rows: DataFrame, metric: str = "metric", value: str = "value", model: str = "model", ascending: tuple[str, ...] = ("mae",)) -> DataFrame:
    """``place`` of each model in each metric: errors from below, all else from above; ties by name."""
    order = F.when(F.col(metric).isin(*ascending), F.col(value)).otherwise(-F.col(value))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(metric).orderBy(order, model)))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both frames' columns for the keys of both, null ones included."""
    named = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    return left.join(named, same).drop(*(f"_other_{k}" for k in keys))


def exclusive_quartiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, deviation (of a sample), range, share of zeros and quartiles by the exclusive method (positions
    k (n + 1) / 4).  Distinct values are counted first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    counts = written(counts, "value-counts")
    n, x, c = F.col("n"), F.col(value), F.col("_c")
    names = {"q1": 1, "median": 2, "q3": 3}
    # the two values whose line a quartile lies on: from 1, and not beyond the last two
    first = {q: F.greatest(F.least(F.floor(k * (n + 1) / 4), n - 1), F.lit(1)) for q, k in names.items()}
    ends = {f"{q}_low": first[q] - 1 for q in names} | {f"{q}_high": F.least(first[q], n - 1) for q in names}
    found = at_places(counts, keys, value, ends, "_c")
    lines = {q: F.col(f"{q}_low") + (F.col(f"{q}_high") - F.col(f"{q}_low")) * (k * (n + 1) / 4 - first[q]) for q, k in names.items()}
    found = found.select(*keys, "n", *(line.alias(q) for q, line in lines.items()))
    mean = F.sum(x * c) / F.sum("_c")
    other = counts.groupBy(*keys).agg(
        mean.alias("mean"), F.sqrt(F.greatest(F.sum(x * x * c) - F.sum(x * c) * mean, F.lit(0.0)) / F.nullif(F.sum("_c") - 1, F.lit(0))).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most"),
        (F.sum(F.when(x == 0, c).otherwise(0)) / F.sum("_c")).alias("zero_share"),
    )
    return _beside(found, other, keys).select(*keys, "n", "mean", "sd", "q1", "median", "q3", "least", "most", "zero_share")


def usage_by_key(rows: DataFrame, keys: list[str], user: str, value: str) -> DataFrame:
    """exclusive_quartiles of ``value`` with a histogram (value:rows joined by commas, in order), and the users and the mean of their
    means; the histogram is as long as there are different values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    bars = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col("_c").alias("c"))))
    histogram = counts.groupBy(*keys).agg(F.array_join(F.transform(bars, lambda b: F.concat_ws(":", b["v"].cast("string"), b["c"].cast("string"))), ",").alias("histogram"))
    means = rows.groupBy(*keys, user).agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.count("*").alias("n_users"), F.avg("_m").alias("user_mean"))
    return _beside(_beside(exclusive_quartiles(rows, keys, value), histogram, keys), means, keys)


#: fixed values: what a trace says when its tools did not answer
UNAVAILABLE = (
    "tools are not available", "not available in this session", "not available in this environment", "aren't available", "don't appear", "tools unavailable",
    "tools not available", "no behavioral", "without sensing", "aren’t available", "don’t appear",
)


def availability(text: Column, patterns: tuple[str, ...] = UNAVAILABLE, stopped: str = "error_max_turns") -> Column:
    """max_turns_hit if the text holds ``stopped``, tools_unavailable if it holds a pattern in any case, else
    tools_attempted_or_single_turn; of a null text the last."""
    low = F.lower(text)
    none = F.coalesce(*[F.when(low.contains(p), True) for p in patterns], F.lit(False))
    return F.when(text.contains(stopped), "max_turns_hit").when(none, "tools_unavailable").otherwise("tools_attempted_or_single_turn")


def mentions(rows: DataFrame, text: str, names: tuple[str, ...]) -> DataFrame:
    """(name, n): texts that hold each name; names that none holds have 0."""
    counts = rows.agg(*(F.count_if(F.col(text).contains(n)).alias(n) for n in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("n")) for n in names))).alias("x")).select("x.*")


def mann_whitney(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: n1, n2, u (of the true group), effect (rank-biserial) and a two-sided p (normal, ties and
    continuity corrected).  Ranks and tie sums are distributed; p is worked out on the one row."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"), F.count_if(F.col(group)).alias("c1"))
    # ranks without one window over all rows: counts of the partitions before, then inside each partition
    parts = counts.repartitionByRange(F.col(value)).withColumn("_p", F.spark_partition_id())
    parts = parts.persist()
    before, offset = {}, 0
    for r in sorted(parts.groupBy("_p").agg(F.sum("c").alias("c")).collect(), key=lambda r: r["_p"]):  # one row a partition
        before[r["_p"]] = offset
        offset += r["c"]
    base = F.create_map(*(F.lit(x) for kv in before.items() for x in kv)) if before else F.create_map(F.lit(0), F.lit(0))
    rank = base[F.col("_p")] + F.sum("c").over(Window.partitionBy("_p").orderBy(value)) - (F.col("c") - 1) / 2
    r = parts.withColumn("r", rank).agg(F.sum(F.col("r") * F.col("c1")).alias("r1"), F.sum("c1").alias("n1"), F.sum("c").alias("n"), F.sum(F.pow(F.col("c"), 3) - F.col("c")).alias("ties")).first()
    parts.unpersist()
    spark = rows.sparkSession
    n1, n = r["n1"] or 0, r["n"] or 0
    n2 = n - n1
    u = (r["r1"] or 0) - n1 * (n1 + 1) / 2
    p = effect = None
    if n1 and n2:
        effect = 1 - 2 * u / (n1 * n2)
        sd = math.sqrt(n1 * n2 / 12 * (n + 1 - r["ties"] / (n * (n - 1)))) if n > 1 else 0.0
        p = min(1.0, math.erfc(max(abs(u - n1 * n2 / 2) - 0.5, 0) / sd / math.sqrt(2))) if sd else 1.0
    return spark.createDataFrame([(n1, n2, float(u), effect, p)], "n1 long, n2 long, u double, effect double, p double")


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2 and dof of the contingency table of two columns, with the continuity correction at one
    degree of freedom."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("o"))
    row, column = cells.groupBy(a).agg(F.sum("o").alias("ra")), cells.groupBy(b).agg(F.sum("o").alias("cb"))
    total = cells.agg(F.sum("o")).first()[0] or 1
    nr, nc = row.count(), column.count()
    dof = (nr - 1) * (nc - 1)
    full = row.join(column, F.lit(True)).join(cells, [a, b], "left")  # a table of categories: nr * nc cells
    expected = F.col("ra") * F.col("cb") / total
    gap = F.abs(F.coalesce("o", F.lit(0)) - expected)
    gap = F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0)) if dof == 1 else gap
    return full.agg(F.sum(gap * gap / expected).alias("chi2")).withColumn("dof", F.lit(dof).cast("long"))
