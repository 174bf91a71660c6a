"""Decontamination, secret scans, packing, the pipeline."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lapwing.llm import decontamination, packing, secret_scan
from lapwing.llm.decontamination import Index
from lapwing.llm.kernels import PLAIN, Words

SF = "/root/testdata/sf0.01"


def plain(text):
    return re.sub(r"[^\w]+", " ", (text or "").lower()).split()


def test_leaks_equal_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.doc_id: " " + " ".join(plain(r.text)) + " " for r in docs.collect()}
    want = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if f" {' '.join(plain(r.text))} " in t}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert want and got == want
    parts = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items, part_bytes=2000).collect()}
    assert parts == want
    kept = {r.doc_id for r in decontamination.clean(docs, items).collect()}
    assert kept == set(texts) - {d for d, _ in want}


def test_partial_copies_do_not_depend_on_the_parts(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rng, rows = random.Random(2), []
    for r in items.collect():
        words = r.text.split()
        for share in (0.02, 0.05, 0.1, 0.2):
            rows.append((len(rows), "so he said " + " ".join(w if rng.random() > share else "other" for w in words) + " and then " * 40))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda **k: sorted((r.doc_id, r.item_id, round(r.score, 9), r.n_passages) for r in decontamination.contaminated(docs, items, **k).collect())
    want = found()
    assert 0 < len({d for d, *_ in want}) < len(rows)
    assert found(part_bytes=2000) == want
    assert decontamination.clean(docs, items, part_bytes=2000).count() == len(rows) - len({d for d, *_ in want})


def test_wand_returns_all_above_threshold():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(4, 30)))) for i in range(300)]
    index = Index(items, 0.4)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.vocabulary)), 25))
        score = [0.0] * len(items)
        for t in terms:
            for k in range(index.start[t], index.start[t + 1]):
                score[index.item[k]] += index.weight[k]
        want = {i for i, s in enumerate(score) if s >= index.threshold[i] - 1e-9}
        assert {i for i, _ in index.wand(terms)} == want


def _items_of_common_and_rare_words(n=10_000):
    rng = random.Random(6)
    return [(i, " ".join([f"common{rng.randrange(40)}" for _ in range(10)] + [f"rare{i}x{k}" for k in range(6)])) for i in range(n)]


def test_wand_skips_by_blocks():
    items = _items_of_common_and_rare_words()
    index = Index(items, 0.6)
    term = {h: k for k, h in enumerate(index.vocabulary.tolist())}
    for i in (0, 4321, 9999):
        terms = sorted({term[h] for h in Words([items[i][1]], table=PLAIN).hash.tolist()})
        length = sum(int(index.start[t + 1] - index.start[t]) for t in terms)
        index.read = 0
        assert [x for x, _ in index.wand(terms)] == [i]
        assert index.read * 100 < length, (index.read, length)


def test_an_item_of_frequent_words_opens_its_own_passages_only():
    items = _items_of_common_and_rare_words(2000)
    loose = (5000, "common1 common2 common3 common4")
    texts = [items[7][1], loose[1] + " and more", "common1 of a kind " + "of no item at all " * 30, "nothing of it"]
    plain, mixed = Index(items, 0.6), Index([*items, loose], 0.6)
    hits = lambda index: {(r, index.ids[i]) for r, i in decontamination._hits(index, 0.7, texts)}
    assert hits(plain) == {(0, 7)} and hits(mixed) == {(0, 7), (1, 5000)}
    words = Words(texts, table=PLAIN)
    n = len(texts)
    opened = mixed.open_passages(mixed.look_up(words.hash), words.doc, np.zeros(words.n, np.int64), np.arange(n), np.ones(n, np.int64))
    assert opened.tolist() == [0, 1]


def test_leak_edges(spark):
    item = "Which of the seven hills did the old king climb first? He climbed the western hill at dawn."
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 5000 + item.upper() + " y" * 5000), (3, "x " * 5000 + item.upper() + " y" * 5000), (None, item), (4, item[:40])], "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("score", F.lit(0))
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (None, "short one")], "item_id long, text string")
    out = decontamination.contaminated(docs, items).collect()
    assert {r.doc_id for r in out} == {3, None} and {r.item_id for r in out} == {7}
    assert decontamination.clean(docs, items).count() == 3
    named = docs.withColumn("_did", F.lit("d")).withColumn("_rid", F.lit("r"))
    kept = decontamination.clean(named, items)
    assert kept.columns == named.columns and {(r["_did"], r["_rid"]) for r in kept.collect()} == {("d", "r")}
    assert decontamination.clean(docs.limit(0), items).count() == 0 and decontamination.clean(docs, items.limit(0)).count() == 6
    assert decontamination.contaminated(docs.limit(0), items).count() == 0 and decontamination.contaminated(docs, items.limit(0)).count() == 0


PLANTED = re.compile(r'AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}')


def test_secrets_of_the_documents(spark, forest):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = secret_scan.scan(docs, forest).collect()
    # a candidate is reported where it first occurs
    want = {(r.doc_id, r.text.index(m[0]) + 1) for r in docs.collect() for m in PLANTED.finditer(r.text)}
    assert want and {(r.doc_id, r.at) for r in out if r.is_secret} == want
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, forest).collect()}
    assert not any(PLANTED.search(t) for t in clean.values())
    changed = {r.doc_id for r in docs.collect() if clean[r.doc_id] != r.text}
    assert changed == {d for d, _ in want}


def test_secret_edges(spark, forest):
    rows = [(1, None, "src/a.py"), (2, "", None), (3, "token: a8F3kd92Lq0Zx7Tt1 " * 3, "src/b"), (4, "the commit 0123456789abcdef0123456789abcdef01234567 by", "docs/readme"), (5, "w" * 100000 + " 4418452524842581", "x"), (5, "w", "y"), (5, "w", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("at", F.lit(1)).withColumn("score", F.lit(1))
    out = secret_scan.scan(docs, forest).collect()
    assert {r.doc_id for r in out if r.is_secret} == {3}
    assert len(out) == 3
    red = {(r.doc_id, r.text) for r in secret_scan.redact(docs, forest).collect()}
    assert (1, None) in red and (3, "token: [SECRET] " * 3) in red
    assert secret_scan.scan(docs.limit(0), forest).count() == 0
    # without a model only published formats are secrets, and with a threshold of 0 every candidate
    assert secret_scan.scan(docs.drop("source"), None).where("is_secret").count() == 0
    assert secret_scan.scan(docs.drop("source"), None, threshold=0.0).where("is_secret").count() == 3


def brute_check(rows, docs, capacities):
    """Pieces tile texts, bins hold what they hold, and no bin is larger than it needs to be."""
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault((r.bin_id, r.bin_capacity), []).append((r.bin_offset, r.n_tokens))
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at and n > 0
            at += n
        assert capacity == min(c for c in capacities if c >= at)
    want = sorted((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1) for d, t in docs if d is not None)
    assert sorted((d, sum(n for _, n in p)) for d, p in pieces.items() if d is not None) == want
    return sum(n for h in bins.values() for _, n in h) / sum(c for _, c in bins)


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fill = brute_check(packing.pack_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], packing.CAPACITIES)
    assert fill > 0.97


def plain_best_fit(sizes, capacities, overhead):
    """Best fit by looking at every open bin; bins as [capacity, used]."""
    bins, filled, offered = [], 1.0, 1.0
    for size in sorted(sizes, reverse=True):
        fitting = [b for b in bins if b[0] - b[1] >= size]
        if fitting:
            min(fitting, key=lambda b: b[0] - b[1])[1] += size
            filled += size
        else:
            rate = filled / offered
            capacity = min((c for c in capacities if c >= size), key=lambda c: ((c + overhead) / (size + rate * (c - size)), c))
            bins.append([capacity, size])
            offered += capacity - size
    return sorted((min(c for c in capacities if c >= used), used) for _, used in bins)


def test_packing_equals_plain_best_fit():
    rng = random.Random(7)
    for capacities, n in (((4, 8), 60), ((512, 1024, 2048, 4096), 400), ((16,), 100)):
        sizes = [rng.randrange(1, max(capacities) + 1) if rng.random() < 0.5 else rng.randrange(1, 6) for _ in range(n)]
        which, offsets, closed = packing.pack(sizes, capacities, 2)
        used = [0] * len(closed)
        for piece, b in enumerate(which):
            used[b] += sizes[piece]
        # of bins with the same room either may be taken, so only rooms are compared
        assert sorted(zip(closed, used)) == plain_best_fit(sizes, capacities, 2)


def test_bins_do_not_depend_on_the_files(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 100)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 50")).unionByName(docs.where("doc_id < 50"))
    bins = lambda df: sorted(tuple(r) for r in packing.pack_documents(df).collect())
    assert bins(docs.repartition(7)) == bins(docs.coalesce(1).orderBy("n_chars"))


def test_packing_edges(spark):
    rows = [(1, None), (2, ""), (3, "a " * 25), (4, "b"), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("piece", F.lit(9)).withColumn("turn", F.lit(0))
    brute_check(packing.pack_documents(docs, (4, 8), 1).collect(), rows, (4, 8))
    assert packing.pack_documents(docs.unionByName(docs), (4, 8)).groupBy("doc_id").count().where("count < 2").count() == 0
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        after.write.parquet(str(tmp_path / name))
        before, kept = {r.doc_id for r in kept.select("doc_id").collect()}, spark.read.parquet(str(tmp_path / name))
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before and len(ids) > 0.5 * len(before), name
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.collect()} == set(ids)


def test_pipeline_on_odd_and_empty_tables(spark, sf_dir, tmp_path):
    """Nulls in every column, blank, long and repeated texts, and columns whose names the stages use."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = " ".join(f"word{i % 977} of" for i in range(60000))
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, None), (3, " \n", None, "s", 2), (4, long, "en", "s", None), (5, "password: " + "a8F3kd92Lq0Zx7Tt1 " * 3, "en", "s", 1), (6, long + " one more", "en", "s", 1)]
    odd = spark.createDataFrame(odd * 2, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(t) for c, t in docs.dtypes])
    extra = docs.unionByName(odd).withColumn("_lw_score", F.lit("a")).withColumn("did", F.lit("b")).withColumn("rid", F.lit("c")).withColumn("score", F.lit("d")).withColumn("_d", F.lit(1)).withColumn("_r", F.lit(2)).withColumn("_blank", F.lit(3))
    kept = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, sf_dir).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == extra.columns and {(r["_lw_score"], r.did, r.rid, r.score) for r in kept.collect()} <= {("a", "b", "c", "d")}, name
    assert kept.where("text like '%a8F3kd92%'").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()}


def test_pipeline_on_an_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs, sf_dir)
        assert empty.count() == 0 and empty.dtypes == docs.dtypes, name
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
