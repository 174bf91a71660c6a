import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.llm.suffix_dedup import repeated_bytes


def brute(rows, threshold):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + threshold] for _, b in raw for p in range(len(b) - threshold + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - threshold + 1):
            if seen[b[p : p + threshold]] > 1:
                gone[p : p + threshold] = b"\1" * threshold
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def run(df, threshold):
    return order(tuple(r) for r in repeated_bytes(df, threshold).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs, 400) == order(brute(rows, 400))


@pytest.mark.parametrize("threshold", [40, 97])
def test_edges(spark, threshold):
    words = [hashlib.md5(str(i).encode()).hexdigest() for i in range(60)]
    a, b = " ".join(words[:20]), " ".join(words[20:40])
    rows = [
        (1, None), (2, ""), (3, "é" * 300), (4, a + b), (5, b + a), (6, a[:50] + "X" + a[51:] + b[7:90]), (None, a), (7, "x" * (threshold - 1)),
        (8, "ab" * 400), (9, a), (9, a), (10, b[3:200] + " ".join(words[40:]) + b[100:300]), (11, " ".join(words[41:44])), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("rid", F.lit("x"))
    assert run(docs, threshold) == order(brute(rows, threshold))
    assert run(docs.limit(0), threshold) == []


def test_larger_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(docs, 400) == order(brute_by_hash(rows, 400))
    assert repeated_bytes(docs).where("has_repeats <> (n_removed > 0)").count() == 0


def brute_by_hash(rows, threshold):
    """As brute, with windows told apart by a rolling hash of two moduli, for speed."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen, keys = Counter(), []
    for _, b in raw:
        mine = np.zeros((2, max(len(b) - threshold + 1, 0)), np.int64)
        for k, (base, mod) in enumerate(((257, 2**31 - 1), (263, 2**31 - 19))):
            h, top = 0, pow(base, threshold - 1, mod)
            for p, x in enumerate(b):
                h = ((h - b[p - threshold] * top if p >= threshold else h) * base + x) % mod
                if p >= threshold - 1:
                    mine[k, p - threshold + 1] = h
        keys.append((mine[0] << 31 | mine[1]).tolist())
        seen.update(keys[-1])
    out = []
    for (i, b), mine in zip(raw, keys):
        edge = np.zeros(len(b) + 1, np.int64)
        for p, h in enumerate(mine):
            if seen[h] > 1:
                edge[p] += 1
                edge[p + threshold] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_many_copies_of_one_row(spark):
    words = [hashlib.md5(str(i).encode()).hexdigest() for i in range(120)]
    a, b = " ".join(words[:60]), " ".join(words[60:])
    rows = [(1, a)] * 1000 + [(2, b)] * 1000 + [(3, a[100:900] + b[5:50]), (4, b[7:300])]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"), 400)
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[:2000] == [(1, len(a), len(a), 1, nothing)] * 1000 + [(2, len(b), len(b), 1, nothing)] * 1000
    assert [r[2:4] for r in got[2000:]] == [(800, 1), (0, 0)]
