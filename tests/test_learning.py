"""The model queries hold out every fold once, with whole vocabularies."""

import pytest
from pyspark.ml.feature import CountVectorizer

from lapwing.plans import learning as Q

CALLS = {Q.sensor_models: len(Q.L.MODELS), Q.text_models: 2, Q.fused_models: 1, Q.vector_models: 1}


@pytest.mark.parametrize("work", CALLS, ids=lambda f: f.__name__)
def test_all_folds_are_asked_for(spark, sf_dir, monkeypatch, work):
    asked, whole = [], Q.L.cross_validate

    def seen(rows, stages, model, folds, **more):
        asked.append((list(folds), [s.getVocabSize() for s in stages if isinstance(s, CountVectorizer)]))
        return whole(rows, stages, model, [], **more)

    monkeypatch.setattr(Q.L, "cross_validate", seen)
    work(spark, sf_dir)
    assert [f for f, _ in asked] == [[1, 2, 3, 4, 5]] * CALLS[work]
    if work is Q.text_models:
        assert [v for _, v in asked] == [[500], [300]]


def test_every_vector_is_scored(spark, sf_dir):
    rows = Q.vector_models(spark, sf_dir).collect()
    assert {r.fold for r in rows} == {1, 2, 3, 4, 5}
    assert sum(r.n for r in rows) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def _points(spark):
    rows = [(i, i % 5 + 1, float(i % 7), float((i * 3) % 11), float(2 * (i % 7) - (i * 3) % 11 + 1)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, fold int, a double, b double, label double")


def test_regressions_predict_every_row_once(spark):
    """A linear target is found again by the linear models, out of fold; folds with few rows are left out."""
    points = _points(spark)
    out = Q.L.cross_validate_continuous(points, Q.L.sensor_stages(["a", "b"]), "huber", Q.FOLDS).collect()
    assert sorted(r.id for r in out) == list(range(60)) and max(abs(r.y - r.p) for r in out) < 0.5
    few = Q.L.cross_validate_continuous(points.where("fold <> 2 or id < 10"), Q.L.sensor_stages(["a", "b"]), "ridge", Q.FOLDS)
    assert {r.fold for r in few.collect()} == {1, 3, 4, 5}


def test_best_features_are_chosen_inside(spark):
    """Half of the features are noise: the inner validation may leave them out, and every row is predicted once."""
    points = _points(spark).selectExpr("id", "fold", "a", "b", "double(id % 13) AS c", "double(id % 17) AS d", "double(label > 0) AS label")
    out = Q.L.cross_validate(points, Q.L.sensor_stages(["a", "b", "c", "d"]), "logistic", [1, 2], grid=4).collect()
    assert {r.fold for r in out} == {1, 2} and sum(r.y == r.p for r in out) >= 0.9 * len(out)


def test_grid_has_every_combination(spark):
    texts = [("the sun is warm and good", 1.0), ("rain and cold and dark", 0.0)] * 20 + [("the dark sun", 1.0), ("warm rain", 0.0)] * 5
    rows = spark.createDataFrame(texts, "text string, label double")
    out = Q.L.text_grid(rows, (1, 2), (False, True), (0.1,), (0.0, 1.0), folds=2)
    assert len({r[:4] for r in out}) == 8 and max(r[4] for r in out) > 0.9 and all(0 <= r[4] <= 1 for r in out)


def test_null_texts_and_damped_counts(spark):
    rows = spark.createDataFrame([("a a a b", 1.0), (None, 0.0), ("b c", 1.0), ("", 0.0)], "text string, label double")
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    stages = Q.L.text_stages(10, idf=False, min_df=1, pairs=False, sublinear=True, norm=False)
    model = Pipeline(stages=stages).fit(rows)
    words = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    out = [dict(zip(words, r.x)) for r in model.transform(rows).select(vector_to_array("x").alias("x")).collect()]
    import math

    assert out[0]["a"] == pytest.approx(1 + math.log(3)) and out[0]["b"] == 1 and out[2] == {"a": 0, "b": 1, "c": 1} and set(out[1].values()) == set(out[3].values()) == {0}
    # words of more than half of the texts are left out
    few = Pipeline(stages=Q.L.text_stages(10, idf=False, min_df=1, pairs=False, max_df=0.49)).fit(rows)
    assert set(next(s for s in few.stages if hasattr(s, "vocabulary")).vocabulary) == {"a", "c"}
    assert model.transform(rows).count() == 4


def test_grid_scores_are_balanced_accuracies(spark):
    """Nine of ten texts have one label: a model that always says so has a balanced accuracy of a half."""
    rows = spark.createDataFrame([("same words here", 1.0)] * 90 + [("same words here", 0.0)] * 10, "text string, label double")
    out = Q.L.text_grid(rows, (1,), (False,), (0.1,), (0.0,), folds=2)
    assert len(out) == 2 and all(r[4] == 0.5 for r in out) and {r[8] for r in out} == {True, False}


def test_scorers_see_nothing_later(spark):
    """A scorer that tells all it is given: no outcome, and what is known does not change with later rows."""
    from pyspark.sql import functions as F

    from lapwing.operators import pit as P

    made = lambda n: spark.createDataFrame([(k, 1, k * 86_400_000 + 9 * 3_600_000, float(k), 7 if k % 2 else 2, "yes", k % 3 == 0) for k in range(n)], "prompt_id long, user_id int, ms long, value double, desire int, available string, state boolean")
    bins = lambda n: spark.createDataFrame([(1, k * 24 + 8, float(k)) for k in range(n)], "user_id int, hour long, total double")

    def tell(batches):
        for x in batches:
            yield x.assign(told=x.drop(columns=["turn"]).astype(str).agg("|".join, axis=1), given=",".join(sorted(x.columns)))

    def run(n):
        prompts = made(n)
        context = P.personal_baseline(prompts, bins(n), "total").drop("user_id").join(P.history(prompts).select("prompt_id", "rate"), "prompt_id").join(prompts.select("prompt_id", "user_id", "ms"), "prompt_id")
        return {r.prompt_id: r for r in P.replayed(context, tell, "told string, given string", prompts.select("prompt_id", F.col("state").alias("outcome"))).collect()}

    short, long = run(6), run(12)
    assert all(short[k].told == long[k].told and short[k].turn == k + 1 for k in range(6)) and [short[k].outcome for k in range(6)] == [k % 3 == 0 for k in range(6)]
    assert "outcome" not in short[0].given and "state" not in short[0].given
    with pytest.raises(ValueError):
        P.replayed(made(2), tell, "told string", made(2).select("prompt_id", "state"))


def test_texts_split_once_give_the_same_vocabularies(spark):
    """What is left of the texts holds every fold's vocabulary, with its counts; of pairs and words, or of words alone."""
    import random

    from pyspark.ml import Pipeline

    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, i % 5 + 1, None if i == 7 else " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=30))) for i in range(80)]
    texts = spark.createDataFrame(rows, "id long, fold int, text string")
    split = Q.L.split_once(texts, [(20, 2, True, 1.0), (10, 2, False, 0.8)], [1, 2, 3, 4, 5])
    assert split.count() == 80 and "text" not in split.columns
    for fold in (1, 4):
        for size, pairs, most in ((20, True, 1.0), (10, False, 0.8)):
            found = []
            for df, whole in ((texts, True), (split, False)):
                train = df.where(f"fold <> {fold}")
                model = Pipeline(stages=Q.L.text_stages(size, pairs=pairs, max_df=most, idf=False, norm=False, split=whole)).fit(train)
                names = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
                # of terms as frequent as the last any may be taken
                sums = {}
                for r in model.transform(train).select("tf").collect():
                    for i, n in zip(r.tf.indices, r.tf.values):
                        sums[names[i]] = sums.get(names[i], 0) + n
                least = min(sums.values())
                found.append(({t: n for t, n in sums.items() if n > least}, least, len(sums)))
            assert found[0] == found[1]


def test_features_of_a_fold_are_made_once_for_all_regressions(spark):
    from pyspark.ml.feature import StandardScaler

    fits = []

    class Counted(StandardScaler):
        def _fit(self, rows):
            fits.append(1)
            return super()._fit(rows)

    points = spark.range(60).selectExpr("id", "cast(id % 2 + 1 as int) as fold", "cast(id % 7 as double) as a", "cast(id % 7 * 2 + id % 3 as double) as label")
    stages = lambda: [Q.L.VectorAssembler(inputCols=["a"], outputCol="raw"), Counted(inputCol="raw", outputCol="x")]
    both = Q.L.cross_validate_continuous(points, stages(), ["ridge", "huber"], [1, 2]).collect()
    assert len(fits) == 2
    apart = [r for m in ("ridge", "huber") for r in Q.L.cross_validate_continuous(points, stages(), m, [1, 2]).collect()]
    assert sorted(map(tuple, both)) == sorted(map(tuple, apart)) and len(both) == 120


def test_terms_are_counted_as_the_tokeniser_splits(spark):
    """Words and pairs with their number and their number of texts by fold, also where a task lets go of what it holds."""
    from collections import Counter

    from pyspark.sql import functions as F

    texts = [(1, "A b, a B! İst K Ärger x_1"), (1, ""), (2, "  b a\n\nb a b"), (2, "é - Σ"), (3, "one")]
    rows = spark.createDataFrame(texts, "fold int, text string").coalesce(1)
    split = Q.reduce(lambda df, stage: stage.transform(df), Q.L._split(), rows).collect()
    totals, within = Counter(), Counter()
    for r in split:
        terms = [*r.words, *r.pairs]
        totals.update((t, r.fold) for t in terms)
        within.update((t, r.fold) for t in set(terms))
    for held in (200_000, 2):
        found = Q.L.term_counts(rows.select("fold", F.lower("text").alias("text")), held).groupBy("term", "fold").agg(F.sum("total").alias("total"), F.sum("texts").alias("texts")).collect()
        assert {(r.term, r.fold): r.total for r in found} == dict(totals) and {(r.term, r.fold): r.texts for r in found} == dict(within)


def test_grid_fits_each_classifier_once_a_fold(spark, monkeypatch):
    """No fit beside those that are scored, and texts are not held to be counted for their largest share."""
    fits, bounds = [], []

    class Counted(Q.L.LogisticRegression):
        def _fit(self, rows):
            fits.append(1)
            return super()._fit(rows)

    class Bounded(CountVectorizer):
        def _fit(self, rows):
            bounds.append(self.getMaxDF())
            return super()._fit(rows)

    monkeypatch.setattr(Q.L, "LogisticRegression", Counted)
    monkeypatch.setattr(Q.L, "CountVectorizer", Bounded)
    rows = spark.createDataFrame([("the sun is warm", 1.0), ("rain and cold", 0.0)] * 20, "text string, label double")
    out = Q.L.text_grid(rows, (1,), (False,), (0.1,), (0.0, 1.0), folds=2, max_df=(0.9,))
    assert len(out) == 4 and len(fits) == 8 and bounds == [36.0]


def test_features_of_a_fold_are_made_once_for_all_models(spark, monkeypatch):
    """Five models share the features of a fold, and the best features are ranked once an inner fold."""
    from pyspark.ml.feature import StandardScaler

    fits, ranked = [], []

    class Counted(StandardScaler):
        def _fit(self, rows):
            fits.append(1)
            return super()._fit(rows)

    class Ranked(Q.L.UnivariateFeatureSelector):
        def _fit(self, rows):
            ranked.append(1)
            return super()._fit(rows)

    monkeypatch.setattr(Q.L, "StandardScaler", Counted)
    monkeypatch.setattr(Q.L, "UnivariateFeatureSelector", Ranked)
    rows = spark.range(120).selectExpr("id", "cast(id % 2 + 1 as int) as fold", *(f"cast(id % {m} as double) as {c}" for c, m in zip(Q.SENSED, (3, 5, 7, 11, 13))), "double(id % 7 > 3) as label")
    monkeypatch.setattr(Q, "_sensor_rows", lambda ev: rows)
    monkeypatch.setattr(Q, "FOLDS", [1, 2])
    monkeypatch.setattr(Q, "_scores", lambda found: Q.reduce(Q.DataFrame.unionByName, found))
    out = Q.sensor_models(spark, "/root/testdata/sf0.001")
    assert {(r.model, r.n) for r in out.groupBy("model").count().withColumnRenamed("count", "n").collect()} == {(m, 120) for m in Q.L.MODELS}
    assert len(fits) == 2 and 6 <= len(ranked) <= 8


def test_texts_without_terms_stay_without_entries(spark):
    from pyspark.ml.linalg import SparseVector, Vectors

    rows = spark.createDataFrame([(["a"], Vectors.sparse(3, [0], [2.0])), ([], Vectors.sparse(3, [], []))], ["terms", "tf"])
    some, none = (r.damped for r in Q.L.Sublinear().transform(rows).collect())
    assert isinstance(none, SparseVector) and none.size == 3 and not none.indices.size and some[0] > 1 and some[1] == some[2] == 0


def test_only_pairs_of_frequent_words_are_counted(spark, monkeypatch):
    """What is counted in pairs is bounded by the vocabularies, however many pairs the texts have; equal words in a row are a pair too."""
    counted, whole = [], Q.L.written

    def seen(df, name):
        out = whole(df, name)
        if name.endswith("-counted"):
            counted.append(out)
        return out

    monkeypatch.setattr(Q.L, "written", seen)
    rows = [(i, i % 5 + 1, " ".join(f"often{(i + j) % 7} rare{i * 40 + j} also also" for j in range(40))) for i in range(40)]
    split = Q.L.split_once(spark.createDataFrame(rows, "id long, fold int, text string"), [(6, 2, True, 1.0)], [1, 2, 3, 4, 5])
    pairs = {r.term for df in counted for r in df.where("contains(term, ' ')").select("term").collect()}
    assert "also also" in pairs and len(pairs) <= 49 and not any("rare" in p for p in pairs)
    first = split.where("id = 0").first()
    assert first.pairs.count("also also") == 40 and first.words.count("also") == 80 and not any("rare" in w for w in first.words)


def test_terms_of_a_fold_are_those_of_its_rows(spark):
    """The same vectors as from the whole texts, and of terms as frequent those that come first."""
    import random

    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rng = random.Random(5)
    # so unevenly frequent that few terms are as frequent as another
    rows = [(i, i % 5 + 1, None if i % 9 == 0 else " ".join(rng.choices([f"w{j}" for j in range(12)], [0.6**j for j in range(12)], k=200))) for i in range(90)]
    texts = spark.createDataFrame(rows, "id long, fold int, text string")
    counts = Q.L.counted_once(Q.L.split_once(texts, [(8, 2, True, 1.0)], Q.FOLDS))
    assert "damped" in counts.columns and "words" not in counts.columns and counts.count() == 90
    for fold in (1, 3):
        found = []
        for df, stages in ((texts, Q.L.text_stages(8, out="said", sublinear=True)), (counts, [Q.L.FoldTerms(8, "said")])):
            model = Pipeline(stages=stages).fit(df.where(f"fold <> {fold}"))
            found.append({r.id: list(r.said) for r in model.transform(df).select("id", vector_to_array("said").alias("said")).collect()})
        assert all(found[0][i] == pytest.approx(found[1][i], abs=1e-12) for i in range(90))
    same = spark.createDataFrame([(1, 1, "c b a"), (2, 1, "a b c")] * 3, "id long, fold int, text string")
    counts = Q.L.counted_once(Q.L.split_once(same, [(9, 2, True, 1.0)], [1, 2]))
    assert Q.L.FoldTerms(2, "said").fit(counts).stages[0].getIndices() == [0, 2]  # a, "a b", b, ...: pairs have half their number


def test_without_any_text_there_is_a_block_of_zeros(spark):
    from pyspark.ml.functions import vector_to_array

    rows = spark.createDataFrame([(i, i % 2 + 1, None if i else "") for i in range(6)], "id long, fold int, text string")
    counts = Q.L.counted_once(Q.L.split_once(rows, [(8, 2, True, 1.0)], [1, 2]))
    out = Q.L.FoldTerms(8, "said").fit(counts).transform(counts).select(vector_to_array("said").alias("said")).collect()
    assert [list(r.said) for r in out] == [[0.0]] * 6
