"""Cross-validated MLlib models on feature frames."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

MODELS = {
    "logistic": lambda: LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=20),
    "forest": lambda: RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=20, maxDepth=4, seed=7),
    "boosted": lambda: GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=5, maxDepth=3, seed=7),
    "svm": lambda: LinearSVC(featuresCol="x", labelCol="label", weightCol="weight", maxIter=10),
    "ridge": lambda: LinearRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=0.1, elasticNetParam=0.0, maxIter=20),
}

#: Models of a continuous target; huber is the robust linear one.
REGRESSORS = {
    "forest": lambda: RandomForestRegressor(featuresCol="x", labelCol="label", numTrees=20, maxDepth=4, seed=7),
    "boosted": lambda: GBTRegressor(featuresCol="x", labelCol="label", maxIter=5, maxDepth=3, seed=7),
    "ridge": lambda: LinearRegression(featuresCol="x", labelCol="label", regParam=0.1, elasticNetParam=0.0, maxIter=20),
    "huber": lambda: LinearRegression(featuresCol="x", labelCol="label", loss="huber", regParam=0.01, maxIter=20),
}


def weighted(rows: DataFrame, seen: dict | None = None) -> DataFrame:
    """Weights that balance the two labels.  ``seen``: the number of rows of each label, where it is known."""
    if seen is None:
        seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, p = sum(seen.values()), sum(label * k for label, k in seen.items() if label is not None)
    return rows.withColumn("weight", F.when(F.col("label") == 1, n / (2 * max(p, 1.0))).otherwise(n / (2 * max(n - p, 1.0))))


def sensor_stages(columns: list[str]) -> list:
    return [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep"), VarianceThresholdSelector(featuresCol="raw", outputCol="kept", varianceThreshold=0.0), StandardScaler(inputCol="kept", outputCol="x", withMean=True)]


class Sublinear(Transformer):
    """1 + ln of each count of the column "tf", as "damped"; a count of 0 stays 0.  Vectors are as long as the vocabulary's limit."""

    def _transform(self, rows: DataFrame) -> DataFrame:
        damped = F.transform(vector_to_array("tf"), lambda n: F.when(n > 0, 1 + F.log(n)).otherwise(0.0))
        # what has no terms stays a vector of zeros without entries
        return rows.withColumn("damped", F.when(F.size("terms") == 0, F.col("tf")).otherwise(array_to_vector(damped)))


def _split() -> list:
    """From a text to its words and pairs of words; a null text is an empty one."""
    return [SQLTransformer(statement="SELECT *, coalesce(text, '') AS whole FROM __THIS__"), RegexTokenizer(inputCol="whole", outputCol="words", pattern=r"\W+"), NGram(n=2, inputCol="words", outputCol="pairs")]


def text_stages(size: int = 500, idf: bool = True, out: str = "x", min_df: int = 2, pairs: bool = True, max_df: float = 1.0, sublinear: bool = False, norm: bool = True, split: bool = True, n: int = 0) -> list:
    """Counts of words and pairs (in ``min_df`` texts or more, and in at most a share ``max_df`` of them), damped or not, weighted
    by idf or not, normalised or not.  A null text is an empty one.  Without ``split`` rows have ``words`` and ``pairs`` (``split_once``).
    With the number ``n`` of texts they are not counted for ``max_df``."""
    join = SQLTransformer(statement=f"SELECT *, {'concat(words, pairs)' if pairs else 'words'} AS terms FROM __THIS__")
    stages = [*_split(), join] if split else [join]
    # a bound of 1 or more is a number of texts
    bound = {"maxDF": max_df * n if max_df * n >= 1 else max_df} if max_df < 1 else {}
    stages.append(CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=size, minDF=min_df, **bound))
    at = "tf"
    if sublinear:
        stages, at = [*stages, Sublinear()], "damped"
    if idf:
        stages, at = [*stages, IDF(inputCol=at, outputCol="tfidf")], "tfidf"
    return [*stages, Normalizer(inputCol=at, outputCol=out) if norm else SQLTransformer(statement=f"SELECT *, {at} AS {out} FROM __THIS__")]


def _terms_of(known: set[str] | None = None):
    """From the words of a text to its terms: words and pairs of words, or with ``known`` the pairs of words that are both known."""
    if known is None:
        return lambda words: words + list(map(" ".join, zip(words, words[1:])))
    return lambda words: [f"{a} {b}" for a, b in zip(words, words[1:]) if a in known and b in known]


def term_counts(rows: DataFrame, held: int = 200_000, terms=None) -> DataFrame:
    """(term, fold, total, texts) of the terms of lower-case texts, added up in tasks; a term has a row for each task and fold, or
    more where a task met over ``held`` terms.  ``terms`` makes them of the words of a text: words and pairs of words, if not given.
    rows: fold, text."""
    terms = terms or _terms_of()

    def count(batches):
        word, met = re.compile(r"\w+", re.ASCII).findall, {}
        for batch in batches:
            for fold, text in zip(batch["fold"].to_pylist(), batch["text"].to_pylist()):
                totals, texts = met.setdefault(fold, (Counter(), Counter()))
                found = terms(word(text))
                totals.update(found)
                texts.update(set(found))
                if len(totals) > held:
                    yield from told({fold: met.pop(fold)})
        yield from told(met)

    def told(met):
        for fold, (totals, texts) in met.items():
            names = list(totals)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([fold] * len(names), pa.int32()), pa.array([totals[t] for t in names], pa.int64()), pa.array([texts[t] for t in names], pa.int64())], names=["term", "fold", "total", "texts"])

    return rows.select("fold", "text").mapInArrow(count, "term string, fold int, total long, texts long")


def _held(terms: list[str]):
    """From lower-case texts to structs of their ``words`` and ``pairs`` among ``terms``, in the order of the text."""
    words, after = {t: t for t in terms if " " not in t}, {}
    for t in terms:
        if " " in t:
            first, second = t.split(" ")
            after.setdefault(first, {})[second] = t

    def kept(texts: pa.Array) -> pa.Array:
        word, none, found, pairs = re.compile(r"\w+", re.ASCII).findall, {}, [], []
        for text in texts.to_pylist():
            every = word(text or "")
            found.append([words[w] for w in every if w in words])
            pairs.append([after[a][b] for a, b in zip(every, every[1:]) if b in after.get(a, none)])
        kind = pa.list_(pa.string())
        return pa.StructArray.from_arrays([pa.array(found, kind), pa.array(pairs, kind)], names=["words", "pairs"])

    return F.arrow_udf(kept, "struct<words: array<string>, pairs: array<string>>")


def split_once(rows: DataFrame, kinds: list[tuple[int, int, bool, float]], folds: list[int] | None = None) -> DataFrame:
    """``rows`` with ``words`` and ``pairs`` in place of ``text``, written down: only those that a vocabulary holds.

    ``kinds``: (size, min_df, pairs, max_df) of each vocabulary, which is drawn from all rows, or with ``folds`` from all rows but
    those of one fold, for each fold.  Terms are counted once for all of them, and of terms as frequent as a vocabulary's last those
    stay that come first, so what CountVectorizer finds in the rest is what it finds in whole texts.

    A pair is no more frequent than its words: where ``size`` words are, only pairs of words that are more frequent than the last of
    them can be in a vocabulary.  So words are counted first, and then pairs of some hundreds of words instead of all that there are.
    """
    others = {f: F.col("fold") != f for f in folds} if folds else {0: F.lit(True)}
    texts = rows.select(F.col("fold").cast("int").alias("fold") if folds else F.lit(0).alias("fold"), F.lower("text").alias("text")).where("text is not null")
    n = rows.agg(*(F.count_if(c).alias(f"n{f}") for f, c in others.items())).first()

    def counted(terms, name: str) -> DataFrame:
        counts = term_counts(texts, terms=terms).groupBy("term").agg(*(F.coalesce(F.sum(F.when(c, F.col(k))), F.lit(0)).alias(f"{k}{f}") for f, c in others.items() for k in ("total", "texts")))
        return written(counts, name)

    def firsts(counts: DataFrame, f: int, size: int, min_df: int, pairs: bool, max_df: float) -> DataFrame:
        """The terms of a vocabulary, with their totals."""
        may = counts.where((F.col(f"texts{f}") >= min_df) & (F.col(f"texts{f}") <= (max_df * n[f"n{f}"] if max_df < 1 else n[f"n{f}"])))
        may = may if pairs else may.where(~F.contains("term", F.lit(" ")))
        return may.orderBy(F.col(f"total{f}").desc(), "term").limit(size).select("term", F.col(f"total{f}").alias("total"))

    # terms are counted by hashes of words, the words themselves are some hundreds a vocabulary
    counts = counted(lambda words: words, "words-counted")
    kinds_of = [(f, *kind) for f in others for kind in kinds]
    with_pairs = [k for k in kinds_of if k[3]]
    if with_pairs:
        last = [firsts(counts, *k).agg(F.lit(i).alias("i"), F.when(F.count("*") == k[1], F.min("total")).otherwise(0).alias("last")) for i, k in enumerate(with_pairs)]
        last = {r.i: r["last"] for r in reduce(DataFrame.unionByName, last).collect()}
        may_pair = reduce(lambda a, b: a | b, ((F.col(f"total{f}") > last[i]) & (F.col(f"texts{f}") >= min_df) for i, (f, _, min_df, *_) in enumerate(with_pairs)))
        known = {r.term for r in counts.where(may_pair).select("term").collect()}
        counts = counts.unionByName(counted(_terms_of(known), "pairs-counted"))
    held = [r.term for r in reduce(DataFrame.unionByName, [firsts(counts, *k).select("term") for k in kinds_of]).distinct().collect()]
    split = rows.withColumn("_split", _held(held)(F.lower("text")))
    return written(split.select(*(c for c in rows.columns if c != "text"), "_split.words", "_split.pairs"), "split-texts")


def counted_once(rows: DataFrame) -> DataFrame:
    """Rows of ``split_once`` with "tf", the counts of all terms that they hold, and "damped" (``Sublinear``) in place of ``words``
    and ``pairs``, written down: vocabularies of folds are parts of them (``FoldTerms``)."""
    terms = rows.withColumn("terms", F.concat("words", "pairs"))
    names = sorted(r.term for r in terms.select(F.explode("terms").alias("term")).distinct().collect())  # some vocabularies
    model = CountVectorizerModel.from_vocabulary(names or [""], "terms", "tf")
    return written(Sublinear().transform(model.transform(terms)).drop("words", "pairs", "terms"), "counted-texts")


class FoldTerms(Estimator):
    """What CountVectorizer, Sublinear, IDF and Normalizer make of texts, from the "tf" and "damped" of ``counted_once`` after one pass
    over the rows of a fit: the ``size`` most frequent terms in ``min_df`` texts or more (of terms as frequent those that come first),
    weighted by idf and normalised.  Without any term it is a block of one zero."""

    def __init__(self, size: int, out: str, min_df: int = 2):
        super().__init__()
        self.size, self.out, self.min_df = size, out, min_df

    def _fit(self, rows: DataFrame) -> Model:
        m = rows.select(Summarizer.metrics("count", "sum", "numNonZeros").summary(F.col("tf")).alias("m")).select("m.*").first()
        # sums are made of means: whole numbers again, so that terms as frequent are so
        totals, texts = m["sum"].toArray().round(), m["numNonZeros"].toArray()
        most = sorted((i for i in range(len(totals)) if texts[i] >= self.min_df), key=lambda i: (-totals[i], i))
        held = most[: self.size]
        idf = [math.log((m["count"] + 1) / (texts[i] + 1)) for i in held]
        return PipelineModel([VectorSlicer(inputCol="damped", outputCol="held", indices=held or [0]), ElementwiseProduct(inputCol="held", outputCol="tfidf", scalingVec=Vectors.dense(idf or [0.0])), Normalizer(inputCol="tfidf", outputCol=self.out)])


def _together(work, items) -> list:
    """``work`` of every item, its jobs side by side."""
    items = list(items)
    with ThreadPool(max(min(len(items), 8), 1)) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), items, chunksize=1)


def chosen(train: DataFrame, learner, columns: int) -> Model:
    """The learner fitted on the best half of ``columns`` features ("x") or on all, by threefold inner validation; for a
    logistic one its regularisation as well.  Features are ranked once an inner fold, for every candidate on its best half."""
    best = UnivariateFeatureSelector(featuresCol="x", outputCol="best", labelCol="label", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(max(columns // 2, 1))
    grid = [{learner.featuresCol: c} | ({learner.regParam: r} if r else {}) for c in ("best", "x") for r in ((0.01, 0.1) if isinstance(learner, LogisticRegression) else (None,))]
    measure, parts = BinaryClassificationEvaluator(labelCol="label"), train.withColumn("part", F.floor(F.rand(7) * 3))
    scores = [0.0] * len(grid)
    for part in range(3):
        inner = parts.where(F.col("part") != part).persist()
        ranked = best.fit(inner)
        seen, kept = ranked.transform(inner).persist(), ranked.transform(parts.where(F.col("part") == part)).persist()
        seen.count()
        found = _together(lambda p: measure.evaluate(learner.fit(seen, p).transform(kept)), grid)
        scores = [s + f / 3 for s, f in zip(scores, found)]
        for df in (inner, seen, kept):
            df.unpersist()
    won = grid[scores.index(max(scores))]
    if won[learner.featuresCol] == "x":
        return learner.fit(train, won)
    return Pipeline(stages=[best, learner.copy(won)]).fit(train)


def cross_validate_continuous(rows: DataFrame, stages: list, models: str | list[str], folds: list[int], least_train: int = 10, least_test: int = 5) -> DataFrame:
    """Out-of-fold predictions of a continuous label: id, fold, y, p, model.  A fold is skipped with few rows; its features are made
    once for all models."""
    models = [models] if isinstance(models, str) else models
    out = [rows.select("id", F.col("fold").cast("int").alias("fold"), F.col("label").alias("y"), F.col("label").alias("p"), F.lit("").alias("model")).limit(0)]
    for fold in folds:
        train, test = rows.where(F.col("fold") != fold).persist(), rows.where(F.col("fold") == fold)
        if train.count() >= least_train and test.count() >= least_test:
            features = Pipeline(stages=stages).fit(train)
            ready = features.transform(train).select("x", "label").persist()
            for model in models:
                fitted = REGRESSORS[model]().fit(ready)
                out.append(fitted.transform(features.transform(test)).select("id", F.lit(fold).alias("fold"), F.col("label").alias("y"), F.col("prediction").alias("p"), F.lit(model).alias("model")))
            ready.unpersist()
        train.unpersist()
    return reduce(DataFrame.unionByName, out)


def balanced_accuracies(rows: DataFrame, predictions: list[str]) -> list[float]:
    """Of each column of predictions the mean share of rows that are right among those of each label there is."""
    right = rows.groupBy("label").agg(*(F.avg((F.col(p) == F.col("label")).cast("double")).alias(p) for p in predictions)).collect()
    return [sum(r[p] for r in right) / len(right) if right else 0.0 for p in predictions]


#: vectorisers of the grid: (least number of texts, pairs, largest share of texts, idf, norm)
VECTORISERS = ((1, False, 1.0, True, True), (1, True, 0.9, True, True), (2, True, 1.0, True, False), (2, True, 0.9, False, True))


def text_grid(rows: DataFrame, min_df: tuple[int, ...] = (), pairs: tuple[bool, ...] = (False, True), c: tuple[float, ...] = (0.1, 1.0), l1: tuple[float, ...] = (0.0, 1.0), size: int = 500, folds: int = 5,
              max_df: tuple[float, ...] = (1.0,), idf: tuple[bool, ...] = (True,), norm: tuple[bool, ...] = (True,), balance: tuple[bool, ...] = (False, True)) -> list[tuple]:
    """(min_df, pairs, reg, l1, score, max_df, idf, norm, balanced) of every combination of vectoriser and classifier: ``score`` is the mean
    balanced accuracy over ``folds`` folds; rows: text, label.  Without ``min_df`` the vectorisers are VECTORISERS.  Features are
    made once a vectoriser; balanced classifiers weigh the labels against their frequency."""
    out, vectorisers = [], list(product(min_df, pairs, max_df, idf, norm)) if min_df else VECTORISERS
    rows = weighted(rows).withColumn("one", F.lit(1.0))
    weights = {"weight" if b else "one": b for b in balance}
    rows = split_once(rows, [(size, least, both, most) for least, both, most, *_ in vectorisers])
    n = rows.count()
    learner = LogisticRegression(featuresCol="x", labelCol="label", maxIter=20)
    grid = ParamGridBuilder().addGrid(learner.regParam, list(c)).addGrid(learner.elasticNetParam, list(l1)).addGrid(learner.weightCol, list(weights)).build()
    for least, both, most, by_idf, normed in vectorisers:
        steps = text_stages(size, min_df=least, pairs=both, max_df=most, idf=by_idf, norm=normed, split=False, n=n)
        ready = Pipeline(stages=steps).fit(rows).transform(rows).select("x", "label", "weight", "one", F.floor(F.rand(7) * folds).alias("part")).persist()
        scores = [0.0] * len(grid)
        for part in range(folds):
            train, test = ready.where(F.col("part") != part).persist(), ready.where(F.col("part") == part)
            train.count()
            models = _together(lambda p: learner.fit(train, p), grid)
            # a test row meets all models at once
            for i, m in enumerate(models):
                test = m.setProbabilityCol("").setRawPredictionCol(f"raw{i}").setPredictionCol(f"p{i}").transform(test).drop(f"raw{i}")
            scores = [s + found / folds for s, found in zip(scores, balanced_accuracies(test, [f"p{i}" for i in range(len(grid))]))]
            train.unpersist()
        out += [(least, both, m[learner.regParam], m[learner.elasticNetParam], s, most, by_idf, normed, weights[m[learner.weightCol]]) for m, s in zip(grid, scores)]
        ready.unpersist()
    return out


def fold_features(rows: DataFrame, stages: list, folds: list[int], least_train: int = 10, least_test: int = 5) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each fold the weighted features of the others (held in memory or on disk until ``unpersist``) and those of its own rows.
    A fold is skipped with few rows or one label."""

    labels = rows.where("fold is not null").groupBy("fold", "label").agg(F.count("*").alias("n")).collect() if folds else []

    def made(fold: int):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold).withColumn("weight", F.lit(1.0))
        seen = Counter()
        for r in labels:
            seen[r["label"]] += r["n"] * (r["fold"] != fold)
        seen = +seen
        if sum(seen.values()) < least_train or len(seen.keys() - {None}) != 2 or sum(r["n"] for r in labels if r["fold"] == fold) < least_test:
            return None
        train = weighted(train, seen)
        features = Pipeline(stages=stages).fit(train)
        ready = features.transform(train).select("x", "label", "weight").persist()
        ready.count()
        return ready, features.transform(test)

    return {f: m for f, m in zip(folds, _together(made, folds)) if m}


def cross_validate(rows: DataFrame, stages: list, model: str, folds: list[int], least_train: int = 10, least_test: int = 5, grid: int = 0, made: dict | None = None) -> DataFrame:
    """Out-of-fold predictions: id, fold, y, p, model.  A fold is skipped with few rows or one label.  ``grid``: number of
    features, to choose among them (``chosen``).  ``made``: ``fold_features`` that several models share."""
    ready = fold_features(rows, stages, folds, least_train, least_test) if made is None else {f: made[f] for f in folds if f in made}

    def told(fold: int) -> DataFrame:
        train, test = ready[fold]
        learner = MODELS[model]()
        fitted = chosen(train, learner, grid) if grid else learner.fit(train)
        guess = F.col("prediction") > 0.5
        return fitted.transform(test).select("id", F.lit(fold).alias("fold"), (F.col("label") == 1).alias("y"), guess.alias("p"), F.lit(model).alias("model"))

    out = _together(told, ready)
    if made is None:
        for train, _ in ready.values():
            train.unpersist()
    if not out:
        return rows.select("id", F.lit(0).alias("fold"), (F.col("label") == 1).alias("y"), (F.col("label") == 1).alias("p"), F.lit(model).alias("model")).limit(0)
    return reduce(DataFrame.unionByName, out)
