import random
import re

import numpy as np
from pyspark.sql import functions as F

from lapwing.llm import jaccard_join as jj


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return order((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def run(df):
    return order(tuple(r) for r in jj.components_of(df).select("doc_id", "n_shingles", "component_id").collect())


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def edited(rng, n):
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for _ in range(rng.randrange(1, 12)):
        mine = list(words)
        for _ in range(rng.randrange(0, max(n // 25, 2))):
            mine[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        out.append(mine)
    return out


def test_edited_copies_and_edges(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(t) for n in (5, 9, 30, 80, 200, 400) for t in edited(rng, n)]
    texts += [" ".join(passage + [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 60))]) for _ in range(40)]
    texts += ["One two", "one TWO", "one two three", "a\tb\nc d e", "é é é é é é", "É É É É É É"]
    rows = [(i * 7 % 1001, t) for i, t in enumerate(texts)] + [(None, texts[0]), (2001, None), (2002, ""), (2003, " \n"), (2004, None), (2005, texts[3]), (2005, texts[3]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit("x")).withColumn("n", F.lit(1))
    assert run(docs) == brute(rows)
    assert run(docs.limit(0)) == []


def test_trees_find_what_all_pairs_find():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 50, 60).astype(np.uint64)
    sets = []
    for _ in range(150):
        n = int(rng.integers(20, 60))
        mine = rng.choice(base, n, replace=False) if rng.random() < 0.5 else rng.integers(0, 1 << 50, n).astype(np.uint64)
        sets.append(np.unique(mine))
    width = min(jj._bitmap_words(len(s)) for s in sets) * 64
    bits = np.zeros((len(sets), width), bool)
    for i, s in enumerate(sets):
        bits[i, (s % np.uint64(width)).astype(int)] = True
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    size, comp = np.array([len(s) for s in sets]), np.arange(len(sets))
    tree = jj.Tree(packed, size, comp)
    found = {tuple(sorted(x)) for x in zip(*map(list, jj.dual_traversal(tree, tree, 75)))}
    half = np.arange(75)
    other = jj.dual_traversal(jj.Tree(packed[:75], size[:75], comp[:75]), jj.Tree(packed[75:], size[75:], comp[75:]), 75)
    across = set(zip(other[0].tolist(), (other[1] + 75).tolist()))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in found
                assert (j < 75) == (i < 75) or (j, i) in across
    assert len(half) == 75


def cells_equal_all_pairs(bags, cell):
    """The pairs that trees leave hold all links inside cells, and no pair of two cells; (in-cell pairs, pairs left, the tally)."""
    tally = []
    i, j = jj.forest_pairs(bags, np.arange(len(bags)), cell, 75, tally)
    left = {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())}
    assert len(left) == len(i) and all(cell[a] == cell[b] for a, b in left)
    inside = [(a, b) for a in range(len(bags)) for b in range(a + 1, len(bags)) if cell[a] == cell[b]]
    for a, b in inside:
        both = len(np.intersect1d(bags[a], bags[b]))
        assert (a, b) in left or 100 * both < 75 * (len(bags[a]) + len(bags[b]) - both)
    return len(inside), len(left), tally


def test_one_tree_prunes_across_many_small_cells():
    rng = random.Random(9)
    bags, cell = [], []
    for c in range(200):
        n = rng.choice((30, 60, 120, 400))
        for t in near_misses(rng, n, rng.choice((2, 3, 5, 12)), rng.choice((0.01, 0.1))):
            bags.append(jj.token_sets([t], 5)[1])
            cell.append(c)
    inside, left, tally = cells_equal_all_pairs(bags, np.array(cell))
    # pairs are dropped at inner nodes too, and what is looked at stays far below all pairs of the sets
    assert left < inside / 2 and sum(d for k, _, d in tally if k) > 0
    assert sum(n for _, n, _ in tally) < len(bags) * 40


def test_trees_work_on_the_given_documents(spark, sf_dir, monkeypatch):
    seen, found = [], jj._found

    def kept(cells, bags, percent):
        rows = cells.join(bags.dropDuplicates(["cid"]), "cid").orderBy("star", "i", "cid").collect()
        seen.append(([jj._from48(bytes(r.tokens)) for r in rows], np.unique([f"{r.star} {r.i}" for r in rows], return_inverse=True)[1]))
        return found(cells, bags, percent)

    monkeypatch.setattr(jj, "_found", kept)
    jj.linked_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    bags, cell = seen[0]
    order = np.argsort(cell, kind="stable")
    _, left, tally = cells_equal_all_pairs([bags[k] for k in order.tolist()], cell[order])
    assert left and sum(d for k, _, d in tally if k) > 0


def near_misses(rng, n, copies, share):
    """Copies of one text in which each word is its own with a given share, so that many pairs are just too far apart."""
    base = [f"b{i}" for i in range(n)]
    return [" ".join(w if rng.random() > share else f"z{rng.randrange(10**8)}" for w in base) for _ in range(copies)]


def test_stars_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "CELL", 10)
    monkeypatch.setattr(jj, "GROUP_BYTES", 20_000)
    rng = random.Random(8)
    texts = [t for n, share in ((60, 0.01), (60, 0.03), (150, 0.015), (40, 0.02)) for t in near_misses(rng, n, 45, share)]
    rows = list(enumerate(texts))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_links_of_a_cell_are_fewer_than_its_sets():
    rng = random.Random(4)
    bags = [jj.token_sets([t], 5)[1] for t in near_misses(rng, 120, 90, 0.005)]
    i, j = np.triu_indices(len(bags), 1)
    links = jj.cell_links(bags, np.arange(len(bags)), i, j, 75)
    alike = [len(np.intersect1d(bags[a], bags[b])) * 7 >= 3 * (len(bags[a]) + len(bags[b])) for a, b in links]
    assert all(alike) and len(links) < len(bags)


def test_many_copies_of_one_row(spark):
    rng = random.Random(6)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(2))
    rows = [(1, a)] * 1000 + [(2, a + " more words behind it")] * 1000 + [(3, b), (4, b)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == [(1, 296, 1)] * 1000 + [(2, 300, 1)] * 1000 + [(3, 296, 3), (4, 296, 3)]
