"""Rules, classifier, language model: against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.llm import lm_scoring, quality_classifier, quality_rules
from lapwing.llm.kernels import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c a b c"), (6, "x\nx\n\nx\ny # * $"), (6, "x\nx\n\nx\ny # * $"), (None, "née née ÉÉ |<>&%"), (7, "word " * 5000), (8, "line one\nline one \nline one\n"), (None, None),
]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("held_out", F.lit("x")).withColumn("n_words", F.lit(0)).withColumn("shard", F.lit(-1))


def base_of(text):
    text = text or ""
    words = WORD.findall(text)
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def key(r):
    return tuple((x is None, str(x)) for x in r)


def rules(df, labels):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return sorted((tuple(r) for r in quality_rules.apply_rules(df, labels).select(*names).collect()), key=key)


def test_rules_base_columns(spark, sf_dir, odd):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    assert rules(docs, labels) == sorted(((r.doc_id, *base_of(r.text)) for r in docs.collect()), key=key)
    assert rules(odd, labels.limit(0)) == sorted(((d, *base_of(t)) for d, t in ODD), key=key)
    assert rules(odd.limit(0), labels) == []


def test_rules_verdict_follows_labels(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_rules.apply_rules(docs, labels.where("quality = 1")).join(labels, "doc_id").where("not base_failed")
    share = {r.quality: r.s for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.97 and share[0] < 0.25


def test_rules_ratio_and_verdict_equal_brute_force(spark, sf_dir, odd):
    """Counts of hashed words and pairs by dictionaries, and the ratio of every text summed one n-gram at a time."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    good = {r.doc_id for r in labels.collect()}
    docs = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    grams = {}
    for i, (_, t) in enumerate(rows):
        words = Words([t], table=None)
        hashes = words.hash.tolist()
        pairs = words.grams(2)[1].tolist()
        assert len(hashes) == len(WORD.findall(t or "")) and len(pairs) == max(len(hashes) - 1, 0)
        grams[i] = [h % quality_rules.BUCKETS for h in hashes + pairs]
    raw, target = Counter(), Counter()
    for i, (d, _) in enumerate(rows):
        raw.update(grams[i])
        target.update(grams[i] if d in good else ())
    n, m, size = sum(raw.values()), sum(target.values()), quality_rules.BUCKETS
    p_raw = lambda b: (raw[b] + 1) / (n + size)
    pulled = [p_raw(b) * (target[b] + quality_rules.PRIOR) / (m * p_raw(b) + quality_rules.PRIOR) for b in range(size)]
    total = sum(pulled)
    want = []
    for i, (d, t) in enumerate(rows):
        ratio = sum(math.log(pulled[b] / total) - math.log(p_raw(b)) for b in grams[i]) / max(len(grams[i]), 1)
        want.append((d, round(ratio, 6), not base_of(t)[-1] and ratio >= quality_rules.MIN_RATIO))
    got = [(r.doc_id, round(r.ratio, 6), r.kept) for r in quality_rules.apply_rules(docs, labels).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_classifier_sees_the_tail_and_bounds_its_sample(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(docs, labels)
    clean = "The house of the man was in the middle of the town and it had a door. " * 40
    clean = clean[: 2048 - 1]
    for tail in (" #### 9981 $$$$ zzzz qqqq" * 4, "x"):
        assert model.features(clean + tail)[4:] != model.features(clean)[4:]
    again = quality_classifier.train(docs.unionByName(docs).unionByName(docs), labels)
    assert np.allclose(again.weights, model.weights) and again.dictionaries == model.dictionaries
    small = quality_classifier.train(docs, labels, use_bytes=60_000)
    assert small.weights is not None and small.dictionaries != model.dictionaries


def test_classifier_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_classifier.score(docs, quality_classifier.train(docs, labels))
    assert out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    held = out.where("held_out").join(labels, "doc_id").collect()
    recall = lambda k: np.mean([r.predicted == k for r in held if r.quality == k])
    assert recall(1) > 0.95 and recall(0) > 0.6
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.collect())


def test_classifier_edges(spark, sf_dir, odd):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    alone = quality_classifier.train(odd, labels.limit(0))
    assert {r.score for r in quality_classifier.score(odd, alone).collect()} == {0.5}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = quality_classifier.score(odd, quality_classifier.train(docs, labels)).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows if r.doc_id == 6}) == 1
    assert quality_classifier.score(docs.limit(0), alone).count() == 0


def brute_lm(rows, modulus=7, held=2):
    out, train = [], Counter()
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % modulus
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*WORD.findall(low(t)), None] for _, t in rows]
    for (d, _), t in zip(rows, tokens):
        if fold(d) != held:
            train.update(t)
    n, v = sum(train.values()), len(train)
    for (d, _), t in zip(rows, tokens):
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t)
        out.append((d, fold(d) == held, len(t), sum(train[w] > 0 for w in t), n, round(base, 5)))
    return sorted(out, key=key)


def brute_scores(rows, modulus=7, held=2, estimation=10):
    """The interpolated model in plain Python: counts by dictionaries, the row's own counts deleted one by one."""
    crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode())
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*WORD.findall(low(t)), None] for _, t in rows]
    grams = lambda t: list(zip([None, *t], t))
    word, pair = Counter(), Counter()
    for (d, _), t in zip(rows, tokens):
        if crc(d) % modulus != held:
            word.update(t)
            pair.update(grams(t))
    n, v = sum(word.values()), len(word)
    level = lambda c: min(int(math.log2(c + 1)), lm_scoring.LEVELS - 1)
    cell = lambda p: min(int(-math.log10(p) * 12), lm_scoring.BINS - 2) if p > 0 else lm_scoring.BINS - 1
    cells = {}
    for (d, _), t in zip(rows, tokens):
        if crc(d) % modulus != held and crc(d) // modulus % estimation == 0:
            w, g = Counter(t), Counter(grams(t))
            first = Counter(h for h, _ in grams(t))
            for h, x in grams(t):
                c = word[h] - first[h]
                p2, p1 = (pair[h, x] - g[h, x]) / c if c > 0 else 0.0, (word[x] - w[x]) / max(n - len(t), 1)
                have = cells.setdefault((level(max(c, 0)), cell(p2), cell(p1)), [0, 0.0, 0.0])
                have[:] = [have[0] + 1, have[1] + p2, have[2] + p1]
    lam = lm_scoring.learn_weights([(k[0], m, p2 / m, p1 / m) for k, (m, p2, p1) in cells.items()], v)
    out = []
    for (d, _), t in zip(rows, tokens):
        total = 0.0
        for h, x in grams(t):
            a, b, c = lam[level(word[h])]
            total += math.log10(a * pair[h, x] / max(word[h], 1) + b * word[x] / max(n, 1) + c / (v + 1))
        out.append((d, round(total, 4)))
    return sorted(out, key=key)


@pytest.mark.parametrize("shard_bytes", [16_000_000, 40_000])
def test_lm_scores_equal_brute_force(spark, sf_dir, odd, monkeypatch, shard_bytes):
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", shard_bytes // 2)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, ODD)):
        got = sorted(((r.doc_id, round(r.score, 4)) for r in lm_scoring.score(df).collect()), key=key)
        want = brute_scores(rows)
        assert [d for d, _ in got] == [d for d, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want], atol=2e-3)


def lm(df):
    rows = lm_scoring.score(df).collect()
    assert all(r.score < 0 or r.train_tokens == 0 for r in rows)
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows), key=key)


def test_lm_base_and_gain(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert lm(docs) == brute_lm([(r.doc_id, r.text) for r in docs.collect()])
    assert lm(odd) == brute_lm(ODD)
    assert lm(odd.limit(0)) == []
    held = lm_scoring.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    cells = [(3, 1000 * rng.random(), p2, p1) for p2 in (0.5, 0.1, 0.0) for p1 in (0.1, 0.01)]
    cells = [(lv, n * (5 if p2 else 1), p2, p1) for lv, n, p2, p1 in cells]
    w = lm_scoring.learn_weights(cells, 1000)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and w[3, 0] > 0.3
