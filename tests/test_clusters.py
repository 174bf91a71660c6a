"""Density clusters by cells against brute force, and how many pairs they make."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lapwing.operators import clusters as K
from lapwing.operators import daily as D

SCHEMA = "pid int, a long, lat double, lon double, weight int"


def metres(p, q):
    a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(a)))


def brute(points, eps=150.0, least=4):
    out = {}
    for pid in {p[0] for p in points}:
        mine = [p for p in points if p[0] == pid]
        near = {p[1]: [q for q in mine if metres(p[2:4], q[2:4]) <= eps] for p in mine}
        core = {a for a, qs in near.items() if sum(q[4] for q in qs) >= least}
        label = {}
        for a in sorted(core):
            if a not in label:
                todo = [a]
                while todo:
                    b = todo.pop()
                    if b not in label:
                        label[b] = a
                        todo += [q[1] for q in near[b] if q[1] in core]
        for p in mine:
            found = [label[q[1]] for q in near[p[1]] if q[1] in core]
            if found:
                out[pid, p[1]] = label.get(p[1], min(found))
    return out


def made(seed):
    rng, points = random.Random(seed), []
    for pid, (lat, lon) in enumerate([(40.0, -74.0), (-33.9, 151.2), (64.1, 179.9995), (0.0003, -180.0), (-0.0005, 0.0), (71.0, 25.0)]):
        wide = 0.0015 / math.cos(math.radians(lat))
        for _ in range(6):  # homes, chains between them and stray points
            y, x = lat + rng.gauss(0, 0.01), lon + rng.gauss(0, 0.01)
            points += [(pid, y + rng.gauss(0, 0.0004), x + rng.gauss(0, 0.0004)) for _ in range(rng.randrange(1, 25))]
        points += [(pid, lat + 0.0012 * k, lon + 0.2 * wide * (k % 2)) for k in range(12)]
        points += [(pid, lat + rng.uniform(-0.02, 0.02), lon + rng.uniform(-0.02, 0.02)) for _ in range(60)]
        points += [(pid, lat + 0.03 + 0.0009 * i, lon + wide * 0.45 * j) for i in range(6) for j in range(6)]
    return [(p, k, y, (x + 180) % 360 - 180, rng.choice((1, 1, 1, 2, 5))) for k, (p, y, x) in enumerate(points)]


@pytest.mark.parametrize("seed", range(3))
def test_equal_brute_force(spark, seed):
    points = made(seed)
    got = {(r.pid, r.a): r.cluster for r in K.density_clusters(spark.createDataFrame(points, SCHEMA)).collect()}
    assert got == brute(points)


def test_two_full_cells_are_cut_until_decided(spark):
    """Two crowds whose closest points are 150 m apart, but for a metre or so."""
    step = 150 / 111_194.9
    for gap, linked in ((0.999, True), (1.001, False)):
        rng = random.Random(4)
        left = [(0, k, 40 - rng.random() * step / 3, -74.0 + rng.random() * step / 4, 1) for k in range(300)]
        right = [(0, 1000 + k, 40 + gap * step + rng.random() * step / 3, -74.0 + rng.random() * step / 4, 1) for k in range(300)]
        points = [*left, (0, 500, 40.0, -74.0, 1), *right, (0, 1500, 40 + gap * step, -74.0, 1)]
        found = K.density_clusters(spark.createDataFrame(points, SCHEMA))
        assert found.count() == len(points) and found.select("cluster").distinct().count() == (1 if linked else 2)


def test_pairs_grow_with_the_points(spark, monkeypatch):
    """20 000 different fixes of one home: what is written stays in proportion to them."""
    sizes = {}

    def counted(df, name):
        out = K_written(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    K_written = K.written
    monkeypatch.setattr(K, "written", counted)
    fixes = spark.range(20_000).select(F.lit(1).alias("pid"), F.col("id").alias("fix_id"), (40 + F.randn(1) * 3e-4).alias("lat"), (-74 + F.randn(2) * 3e-4).alias("lon"))
    home = D.homes(fixes).collect()
    assert len(home) == 1 and home[0].n_clusters == 1 and home[0].n_used > 19_900
    assert max(sizes.values()) <= 3 * 20_000, sizes


def test_odd_rows(spark):
    made = [(1, 0, None, 1.0, 9), (1, 1, 40.0, None, 9), (1, 2, float("nan"), 1.0, 9), (1, 3, 40.0, 1.0, 4), (None, 4, 40.0, 1.0, 9), (2, 5, 40.0, 180.0, 2), (2, 6, 40.0, -180.0, 2)]
    got = {(r.pid, r.a, r.cluster) for r in K.density_clusters(spark.createDataFrame(made, SCHEMA).withColumn("y", F.lit("x"))).collect()}
    assert got == {(1, 3, 3), (2, 5, 5), (2, 6, 5)}
    assert K.density_clusters(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_in_any_order(spark):
    """A long chain whose least label stands beside its greatest is one component, within few rounds."""
    orders = {1: [0, *range(300, 0, -1)], 2: list(range(301)), 3: random.Random(3).sample(range(301), 301)}
    nodes = spark.createDataFrame([(pid, x) for pid, chain in orders.items() for x in chain], "pid long, label long")
    links = [(pid, *pair) for pid, chain in orders.items() for a, b in zip(chain, chain[1:]) for pair in ((a, b), (b, a))]
    found = K.components(nodes, spark.createDataFrame(links, "pid long, label long, other long"), ["pid"], rounds=16)
    assert found.where("cluster = 0").count() == found.count() == 903
