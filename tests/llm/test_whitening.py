"""Whitening by contour integration against a dense eigensolver and whole-number arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.llm import whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=4):
    """vec_id -> list of (component, n, deviation, whitened up to sign, explained), by numpy's dense solver."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    fit = [list(t) for t in {tuple(v) for _, v in x}]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(s) / n
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    out = []
    for i, c in x:
        far = sum((n * a - b) ** 2 for a, b in zip(c, s))
        z = (np.array(c) - np.array(s) / n) @ w / np.sqrt(e)
        out.append((i, n, far, z, e / np.trace(v)))
    return out


def held(got, want, tolerance=1e-7):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    sign = None
    for i, n, far, z, share in want:
        if sign is None:
            sign = [1 if (by[i][k + 1][0].whitened > 0) == (z[k] > 0) else -1 for k in range(len(z))]
        for k in range(len(z)):
            r = by[i][k + 1][0]
            assert (r.n, r.deviation, int(r.deviation_exact)) == (n, far, far)
            assert abs(r.whitened - sign[k] * z[k]) < tolerance and abs(r.explained / share[k] - 1) < 1e-9 and r.identity_error < 1e-9
    assert len(got) == sum(len(w[3]) for w in want)


def test_equals_dense_solver(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    held(whitening.whiten(vectors).collect(), brute([(r.vec_id, r.embedding) for r in vectors.collect()]))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(k, (rng.standard_normal(6) * [9, 7, 5, 3, 1, 0.1]).tolist()) for k in range(200)]
    copies = [(k, good[0][1]) for k in range(300, 600)]
    near = [(700, [c + 1e-9 for c in good[1][1]])]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0, 2.0]), (905, [])]
    rows = spark.createDataFrame(good + copies + near + bad, SCHEMA).withColumn("X", F.lit(1)).withColumn("component", F.lit("x"))
    got = whitening.whiten(rows).collect()
    held(got, brute(good + copies + near))
    assert {r.vec_id for r in got} == {i for i, _ in good + copies + near}


def test_degenerate_tables(spark):
    one = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert one([]) == [] and one([(1, None)]) == [] and one([(1, [])]) == []
    assert one([(1, [1.0, 2.0])] * 3) == []
    # a line has one component; with one entry a vector has one as well
    assert {r.component for r in one([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])} == {1}
    assert {r.component for r in one([(k, [float(k)]) for k in range(9)])} == {1}
    huge = one([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (None, [0.0, 5e17])])
    assert huge and all(r.deviation is None for r in huge if r.component == 1)


@pytest.mark.parametrize("seed", range(6))
def test_feast_finds_all(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(2, 90))
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    kinds = [np.sort(rng.random(d))[::-1], 1 + np.arange(d)[::-1] * 1e-4, np.repeat(rng.random(-(-d // 3)), 3)[:d], 2.0 ** -np.arange(d), np.full(d, 3.0), np.concatenate([[5, 5 - 1e-9], rng.random(d)])[:d]]
    e = np.sort(kinds[seed])[::-1]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    inertia = whitening.Inertia(v)
    for shift in rng.random(5) * e[0]:
        assert inertia.above(shift) == (e > shift).sum()
    values, axes = whitening.components_of(v, 4)
    k = len(values)
    assert np.allclose(values, e[:k], rtol=1e-9, atol=1e-12 * e[0]) and np.allclose(axes.T @ axes, np.eye(k), atol=1e-12)
    assert np.abs(v @ axes - axes * values).max() < 1e-12 * max(1, e[0])


def test_missing_pairs_are_noticed():
    v = np.diag([5.0, 4, 3, 2, 1])
    with pytest.raises(RuntimeError):
        whitening.feast(v, 2.5, 6.0, 4)
