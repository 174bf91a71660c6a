"""Exact Jaccard self-join on word shingles, for the classes of texts that it links.

Equal sets are one class from the start.  Two sets of similarity t or more share l of the first
n - ceil(t n) + l of their tokens in any common order (frequent tokens last, then by hash), with the
smaller of their two l; here l grows with n.  Those prefixes are dealt out by token, packed per task
and bucket of tokens.  A token that several sets hold stands for the *star* of its least holder: two
sets that share a token are both in that star, so (star, set) rows take the place of (token, set)
rows, and tokens that near copies share fall together.

A linked pair shares at least l tokens, so a set may leave out stars that stand for l - 1 of its tokens
in all, if every set leaves them out in the same order; the largest stars go first.  Passages that very
many documents hold leave the join here.

What is left goes to *signature trees*, each over many stars (stars over CELL sets or CELL_BYTES of tokens
in blocks).  A leaf is a set's bitmap of hashed tokens in one star; a node holds the OR of its members' bitmaps,
their ranges of sizes and stars and how many tokens bitmaps hide.  A dual traversal drops pairs of nodes that
have no star in common, whose greatest possible overlap is too small, whose sizes are too far apart, or that lie
in one component already.
The pairs of sets that remain are compared exactly at once, on the tokens that came along, and only a
link between two components of the cell goes out: at most members - 1 rows a cell.  Links inside
blocks come first; stars of several blocks that still hold several components after them then meet
block by block, in ranges of sizes.

Tokens are sent only for the sets that are in a star.  Their texts are fetched with a broadcast of their
row numbers while these are at most BROADCAST_ROWS, and with a merge join beyond.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .components import components
from .kernels import Words, mix

TOKEN_BITS = 52
#: Rows of one numpy step; their number shares a word with the token.
STEP_ROWS = 1 << (64 - TOKEN_BITS)
#: Prefix tokens that a task gathers before it sends them.
GATHER = 1_000_000
#: A token is frequent if it is this often in the corpus, or more than one in 2**20 of all tokens.
FREQUENT = 64
BUCKET_BYTES = 4_000_000
#: Sets, and bytes of their tokens, that one block of a star takes at most.
CELL, CELL_BYTES = 4000, 8_000_000
LEAF = 8
#: Bytes of cells that one group takes together.
GROUP_BYTES = 2_000_000
#: A set of n tokens has l = 1 + n // SHARED of them to share in prefixes.
SHARED = 12
BROADCAST_ROWS = 200_000
#: Bytes of a token in a cell: the low 48 bits.
TOKEN_BYTES = 6


def token_sets(texts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each text, tokens): the distinct shingle hashes of each text in ascending order."""
    words = Words(texts)
    at, gram = words.grams(width)
    doc = words.doc[at]
    n = np.diff(words.first)
    few = np.flatnonzero((n > 0) & (n < width))
    whole = np.zeros(len(few), np.uint64)
    for k in range(width - 1):  # fewer words than a shingle: the whole sequence is one
        has = n[few] > k
        here = words.hash[np.minimum(words.first[few] + k, max(words.n - 1, 0))] if words.n else whole
        whole = np.where(has, mix(whole * np.uint64(0x2545F4914F6CDD1D) + here + np.uint64(k + 1)), whole)
    code = np.concatenate([doc, few]).astype(np.uint64) << np.uint64(TOKEN_BITS) | np.concatenate([gram, whole]) >> np.uint64(64 - TOKEN_BITS)
    code = np.unique(code)
    first = np.searchsorted(code >> np.uint64(TOKEN_BITS), np.arange(len(texts) + 1, dtype=np.uint64))
    return first, code & np.uint64((1 << TOKEN_BITS) - 1)


def set_ids(first: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set; zero for the empty set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens + np.uint64(1)))])
    n = np.diff(first)
    out = mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))
    return np.where(n > 0, out, 0).view(np.int64)


def _row_steps(work):
    """frames.per_step, with at most STEP_ROWS rows a step."""

    def cut(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, STEP_ROWS):
            yield from work(batch.slice(at, STEP_ROWS))

    return frames.per_step(cut)


SETS = "did long, rid long, doc_id long, n long, cid long, token long"


def _bitmap_words(n: int) -> int:
    """64-bit words of a bitmap for a set of n tokens: two to four bits a token, up to 64 kbit."""
    return 1 << min(max(math.ceil(math.log2(max(n, 1) / 32)), 0), 10)


def _sets(width: int):
    """A row for each text, and a row (token, n) for each token that several texts of a task hold."""

    def run(batches):
        gathered: list[np.ndarray] = []

        def counts():
            tokens, n = np.unique(np.concatenate(gathered), return_counts=True)
            tokens, n = tokens[n > 1].view(np.int64), n[n > 1]
            gathered.clear()
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(n), none, pa.array(tokens)], names=names)

        def step(batch: pa.RecordBatch):
            first, tokens = token_sets(batch.column("text").to_pylist(), width)
            gathered.append(tokens)
            columns = [*(batch.column(k) for k in ("did", "rid", "doc_id")), pa.array(np.diff(first)), pa.array(set_ids(first, tokens)), pa.nulls(batch.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if sum(map(len, gathered)) > GATHER:
                yield from counts()

        yield from _row_steps(step)(batches)
        if gathered:
            yield from counts()

    names = [x.split()[0] for x in SETS.split(", ")]
    return run


def _flushed(work, width: int):
    """Run ``work(tokens, owner set ids, tokens by text)`` on what a task gathers, GATHER tokens at a time."""

    def run(batches):
        kept: list = []
        have = 0

        def step(batch: pa.RecordBatch):
            nonlocal have
            first, tokens = token_sets(batch.column("text").to_pylist(), width)
            kept.append((first, tokens))
            have += len(tokens)
            if have > GATHER:
                yield from flush()

        def flush():
            nonlocal have
            if kept:
                yield from work(kept)
            kept.clear()
            have = 0

        yield from _row_steps(step)(batches)
        yield from flush()

    return run


def prefixes(first: np.ndarray, tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, token) of each text's prefix in the common order."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    late = np.zeros(len(tokens), bool)
    if len(frequent) and len(tokens):
        late = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
    # place in the order: rare ones keep their turn among the rare, the frequent follow them
    rare = np.concatenate([[0], np.cumsum(~late)])
    before = rare[:-1] - rare[first[:-1]][doc]
    rares = (rare[first[1:]] - rare[first[:-1]])[doc]
    place = np.where(late, rares + (np.arange(len(tokens)) - first[:-1][doc] - before), before)
    take = place < (n - -(-percent * n // 100) + 1 + n // SHARED)[doc]
    return doc[take], tokens[take]


def _low48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).tobytes()


def _from48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view(np.uint64).ravel()


MESSAGE = "bucket int, tokens binary, least binary, held binary, holders binary"


def _messages(width: int, percent: int, frequent: np.ndarray, buckets: int):
    def work(kept: list):
        tok, own = [], []
        for first, tokens in kept:
            doc, token = prefixes(first, tokens, frequent, percent)
            tok.append(token)
            own.append(set_ids(first, tokens)[doc])
        token, cid = np.concatenate(tok), np.concatenate(own)
        order = np.lexsort((cid, token))
        token, cid = token[order], cid[order]
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])]) if len(token) else np.zeros(0, bool)
        token, cid = token[fresh], cid[fresh]
        heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(token)))
        held = np.repeat(size > 1, size)
        owner = lambda t: ((t >> np.uint64(TOKEN_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        ht, hc, lt, lc = token[heads], cid[heads], token[held], cid[held]
        # buckets that have something: never more messages than tokens, however many buckets there are
        some, a = np.unique(owner(ht), return_index=True)
        a = np.append(a, len(ht))
        b = np.searchsorted(owner(lt), np.append(some, buckets))
        rows = [(k, _low48(ht[a[x] : a[x + 1]]), hc[a[x] : a[x + 1]].tobytes(), lt[b[x] : b[x + 1]].tobytes(), lc[b[x] : b[x + 1]].tobytes()) for x, k in enumerate(some.tolist())]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "tokens", "least", "held", "holders"])

    return _flushed(work, width)


STARS = "star long, cid long, k long"


def _stars(key, messages):
    """(star, set, number of tokens) for the tokens of a bucket that several sets hold."""
    token = np.concatenate([_from48(x.as_py()) for x in messages.column("tokens")])
    cid = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in messages.column("least")])
    # tasks name their least holder of each token, and all holders of those that several sets of the task hold
    held = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in messages.column("held")]) & np.uint64((1 << 48) - 1)
    token, cid = np.concatenate([token, held]), np.concatenate([cid, *(np.frombuffer(x.as_py(), np.int64) for x in messages.column("holders"))])
    order = np.lexsort((cid, token))
    token, cid = token[order], cid[order]
    fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])]) if len(token) else np.zeros(0, bool)
    token, cid = token[fresh], cid[fresh]
    heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(token)))
    several = np.repeat(size > 1, size)
    star, cid = np.repeat(cid[heads], size)[several], cid[several]
    order = np.lexsort((cid, star))
    star, cid = star[order], cid[order]
    first = np.flatnonzero(np.concatenate([[True], (star[1:] != star[:-1]) | (cid[1:] != cid[:-1])])) if len(star) else np.zeros(0, np.int64)
    return pa.Table.from_pydict({"star": star[first], "cid": cid[first], "k": np.diff(np.append(first, len(star)))})


def _bags(width: int):
    """(cid, tokens) of texts."""

    def work(batch: pa.RecordBatch):
        first, tokens = token_sets(batch.column("text").to_pylist(), width)
        yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([_low48(tokens[first[i] : first[i + 1]]) for i in range(batch.num_rows)], pa.binary())], names=["cid", "tokens"])

    return _row_steps(work)


def bags_of(keyed: DataFrame, shown: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(cid, tokens) of the set numbers ``nodes`` (cid); shown: (did, rid, cid), one row of each set."""
    wanted = frames.materialise(shown.join(nodes, "cid", "left_semi"), "wanted")
    small = wanted.count() <= BROADCAST_ROWS
    texts = keyed.select("did", "rid", "text").join(F.broadcast(wanted) if small else wanted.hint("merge"), ["did", "rid"]).select("cid", "text")
    return frames.materialise(texts.mapInArrow(_bags(width), "cid long, tokens binary"), "bags")


class Tree:
    """Signature tree of some sets, each in one of several cells: levels from the leaves' items up, each node over LEAF
    of the level below.  Cells are told in the order of their smallest sets, so that nodes over many cells have sets of like sizes."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, comp: np.ndarray, cell: np.ndarray | None = None):
        cell = np.zeros(len(size), np.int64) if cell is None else cell
        order = np.lexsort((comp, size, cell))
        hidden = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.item = order
        level = {"bits": bits[order], "lo": size[order], "hi": size[order], "hidden": hidden[order], "comp": comp[order], "one": np.ones(len(order), bool), "from": cell[order], "to": cell[order]}
        self.levels = [level]
        while len(level["lo"]) > 1:
            heads = np.arange(0, len(level["lo"]), LEAF)
            same = np.minimum.reduceat(level["comp"], heads) == np.maximum.reduceat(level["comp"], heads)
            level = {
                "bits": np.bitwise_or.reduceat(level["bits"], heads, 0), "lo": np.minimum.reduceat(level["lo"], heads), "hi": np.maximum.reduceat(level["hi"], heads),
                "hidden": np.maximum.reduceat(level["hidden"], heads), "comp": level["comp"][heads], "one": same & np.logical_and.reduceat(level["one"], heads),
                "from": np.minimum.reduceat(level["from"], heads), "to": np.maximum.reduceat(level["to"], heads),
            }
            self.levels.append(level)


def _possible(p: dict, q: dict, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold a link between components."""
    open_ = (p["from"][i] <= q["to"][j]) & (q["from"][j] <= p["to"][i]) & ~(p["one"][i] & q["one"][j] & (p["comp"][i] == q["comp"][j]))
    lo = np.maximum(p["lo"][i], q["lo"][j])
    open_ &= (100 * np.minimum(p["hi"][i], q["hi"][j]) >= percent * lo) & (p["hi"][i] > 0) & (q["hi"][j] > 0)
    i, j = i[open_], j[open_]
    # a common token is a common bit, or hidden behind one in the set that hides fewer
    most = np.bitwise_count(p["bits"][i] & q["bits"][j]).sum(1).astype(np.int64) + np.minimum(p["hidden"][i], q["hidden"][j])
    total = p["lo"][i] + q["lo"][j]
    open_[open_] = (100 + percent) * most >= percent * total
    return open_


def dual_traversal(p: Tree, q: Tree, percent: int, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Items (i of p, j of q) that no bound rules out; for one tree with itself, i before j.
    ``tally`` gets (level, pairs of nodes looked at, pairs dropped)."""
    deep = max(len(p.levels), len(q.levels)) - 1
    at = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(deep, -1, -1):
        keep = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 16):
            part = slice(s, s + (1 << 16))
            keep[part] = _possible(at(p, k), at(q, k), i[part], j[part], percent)
        if tally is not None:
            tally.append((k, len(keep), int((~keep).sum())))
        i, j = i[keep], j[keep]
        if k:
            for side, tree in ((0, p), (1, q)):
                if k <= len(tree.levels) - 1:  # this tree has a level below
                    below = len(tree.levels[k - 1]["lo"])
                    parent = i if side == 0 else j
                    n = np.minimum(LEAF, below - parent * LEAF)
                    again = np.repeat(np.arange(len(i)), n)
                    child = np.repeat(parent * LEAF, n) + np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                    i, j = (child, j[again]) if side == 0 else (i[again], child)
            if p is q:
                keep = i <= j
                i, j = i[keep], j[keep]
    if p is q:
        keep = i < j
        i, j = i[keep], j[keep]
    return p.item[i], q.item[j]


def bitmaps(bags: list[np.ndarray], words: int | None = None) -> np.ndarray:
    """Bitmaps of sets of tokens by their lowest bits, of so many 64-bit words, or as wide as the smallest set asks for."""
    size = (words or min(_bitmap_words(len(x)) for x in bags)) * 64
    bits = np.zeros((len(bags), size), bool)
    for row, tokens in zip(bits, bags):
        row[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def forest_pairs(bags: list[np.ndarray], comp: np.ndarray, cell: np.ndarray, percent: int, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (i, j) of one cell that no bound rules out; ``bags`` in the order of ``cell`` (whole numbers from 0).
    One tree takes all cells whose smallest sets ask for bitmaps of the same width."""
    size = np.array([len(x) for x in bags])
    least = np.minimum.reduceat(size, np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])))
    rank = np.empty(len(least), np.int64)
    rank[np.argsort(least, kind="stable")] = np.arange(len(least))
    width = np.array([_bitmap_words(int(n)) for n in least])[cell]
    found = [(np.zeros(0, np.int64),) * 2]
    for words in np.unique(width).tolist():
        mine = np.flatnonzero(width == words)
        tree = Tree(bitmaps([bags[k] for k in mine.tolist()], words), size[mine], comp[mine], rank[cell[mine]])
        i, j = dual_traversal(tree, tree, percent, tally)
        found.append((mine[i], mine[j]))
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def cell_links(bags: list[np.ndarray], comp: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among the pairs (i, j) of sets that join two components, each found by exact comparison; a pair
    whose ends are joined by then is passed over."""
    size = np.array([len(x) for x in bags])
    start = np.concatenate([[0], np.cumsum(size)])
    words, ids = np.unique(np.concatenate(bags), return_inverse=True)
    label = np.unique(comp, return_inverse=True)[1]
    marked = np.zeros(len(words), np.int64)
    out = []
    order = np.lexsort((np.abs(size[i] - size[j]), i))  # likely links first
    i, j = i[order], j[order]
    heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else i
    for a, left, right in zip(i[heads].tolist(), heads.tolist(), np.append(heads[1:], len(i)).tolist()):
        mine, step = ids[start[a] : start[a + 1]], 1
        marked[mine] = 1
        rest = j[left:right]
        while len(rest := rest[label[rest] != label[a]]):
            some, rest, step = rest[:step], rest[step:], step * 4
            n = size[some]
            end = np.cumsum(n)
            at = np.repeat(start[some] - (end - n), n) + np.arange(end[-1])
            both = np.add.reduceat(marked[ids[at]], end - n)
            for b in some[100 * both >= percent * (size[a] + n - both)].tolist():
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    out.append((a, b))
        marked[mine] = 0
    return out


def _links(percent: int):
    """Links of the cells (star, band, i, j) of a group of cells, as pairs of set numbers."""

    def meetings(home: np.ndarray, block: np.ndarray, i: int, j: int):
        at = lambda h, b: np.flatnonzero((home == h) & (block == b))
        here, there = at(True, i), at(True, j)
        return [(here, here), (here, at(False, i))] if i == j else [(here, there), (here, at(False, j)), (there, at(False, i))]

    def block_pairs(bags: list, column: dict, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a cell between two blocks, or with sets of the next range of sizes, that no bound rules out."""
        size, comp, home, block = (column[k][at] for k in ("n", "comp", "home", "block"))
        bits, found = bitmaps(bags), []
        for left, right in meetings(home, block, int(column["i"][at.start]), int(column["j"][at.start])):
            if len(left) and len(right):
                p = Tree(bits[left], size[left], comp[left])
                q = p if left is right else Tree(bits[right], size[right], comp[right])
                x, y = dual_traversal(p, q, percent)
                found.append((left[x], right[y]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in (0, 1))

    def work(key, cells):
        names = ("star", "band", "i", "j")
        cells = cells.sort_by([(k, "ascending") for k in (*names, "cid")])
        column = {k: cells.column(k).to_numpy() for k in (*names, "home", "block", "n", "comp", "cid")}
        fresh = np.ones(cells.num_rows, bool)
        fresh[1:] = np.logical_or.reduce([column[k][1:] != column[k][:-1] for k in names])
        heads, cell = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        stop = np.append(heads[1:], cells.num_rows)
        whole = np.logical_and.reduceat(column["home"] & (column["i"] == column["j"]), heads)
        a, b = [], []

        def compare(bags: list, rows: np.ndarray, i: np.ndarray, j: np.ndarray):
            for x, y in cell_links(bags, column["comp"][rows], i, j, percent) if len(i) else ():
                a.append(column["cid"][rows[x]])
                b.append(column["cid"][rows[y]])

        # cells that are a star or a block of one, many in a tree
        rows = np.flatnonzero((whole & (stop - heads > 1))[cell])
        if len(rows):
            bags = [_from48(x.as_py()) for x in cells.column("tokens").take(rows)]
            mine = np.unique(cell[rows], return_inverse=True)[1]
            i, j = forest_pairs(bags, column["comp"][rows], mine, percent)
            order = np.argsort(mine[i], kind="stable")
            i, j = i[order], j[order]
            cuts = np.flatnonzero(np.diff(mine[i])) + 1
            first = np.searchsorted(mine, np.arange(mine[-1] + 2))
            for x, y in zip(np.split(i, cuts), np.split(j, cuts)):
                if len(x):
                    lo, hi = first[mine[x[0]]], first[mine[x[0]] + 1]
                    compare(bags[lo:hi], rows[lo:hi], x - lo, y - lo)
        # and cells that are two blocks, or two ranges of sizes
        for at in map(slice, heads[~whole].tolist(), stop[~whole].tolist()):
            if at.stop - at.start > 1:
                bags = [_from48(x.as_py()) for x in cells.column("tokens")[at]]
                compare(bags, np.arange(at.start, at.stop), *block_pairs(bags, column, at))
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work


def _blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, blocks, members, lo and hi component of each cell."""
    most = F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") * TOKEN_BYTES / CELL_BYTES))
    return rows.groupBy(*keys).agg(most.cast("int").alias("blocks"), F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("home").alias("homes"))


def _found(cells: DataFrame, bags: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links that cells find; cells: star, band, i, j, home, block, n, comp, cid."""
    cells = frames.materialise(cells, "cells")
    size = cells.agg(F.sum(F.col("n") * TOKEN_BYTES + 64)).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    dealt = cells.withColumn("group", F.pmod(F.xxhash64("star", "band", "i", "j"), F.lit(groups)).cast("int"))
    met = dealt.join(bags.dropDuplicates(["cid"]), "cid")
    return frames.materialise(met.groupBy("group").applyInArrow(_links(percent), "a long, b long"), "links")


def star_links(stars: DataFrame, bags: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the sets of the stars, enough to join what is linked; stars: star, cid, n."""
    # inside the blocks of every star
    rows = stars.select("star", "cid", "n", F.col("cid").alias("comp"), F.lit(True).alias("home"))
    size = frames.materialise(_blocks(rows, "star").where("members > 1").select("star", "blocks"), "blocks")
    cells = rows.join(size, "star").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    links = _found(cells.withColumn("band", F.lit(0)).withColumn("i", F.col("block")).withColumn("j", F.col("block")).drop("blocks"), bags, percent)
    wide = frames.materialise(size.where("blocks > 1").select("star"), "wide")
    if wide.isEmpty():
        return links
    # and across blocks where a star has several components left, by ranges of sizes
    labels = components(links)
    rows = stars.join(wide, "star", "left_semi").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("star", "cid", "n", F.coalesce("root", "cid").alias("comp"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    rows = rows.select("*", F.explode(F.array(F.struct(F.lit(True).alias("home"), band.alias("band")), F.struct(F.lit(False).alias("home"), (band + 1).alias("band")))).alias("x")).select("star", "cid", "n", "comp", "x.*")
    rows = frames.materialise(rows, "wide-rows")
    size = _blocks(rows, "star", "band").where("homes and lo < hi").select("star", "band", "blocks")
    cells = rows.join(size, ["star", "band"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = cells.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    return links.unionByName(_found(cells, bags, percent))


def kept_stars(named: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(star, cid, n): the stars in which a set has to look for partners.  A partner has ``percent`` of the set's
    size at least, and so the two share at least the l of that size; largest stars are left out first."""
    # written down, as both sides of the join have to be shuffles of their own for a hot star to be split
    members = frames.materialise(named.groupBy("star").agg(F.count("*").alias("members")), "members")
    left_out = Window.partitionBy("cid").orderBy(F.col("members").desc(), F.col("star").desc())
    least = 1 + F.floor(F.ceil(percent * F.col("n") / 100) / SHARED)
    return named.join(members, "star").join(sizes, "cid").withColumn("sum", F.sum("k").over(left_out)).where(F.col("sum") >= least).select("star", "cid", "n")


def linked_sets(docs: DataFrame, width: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """((did, rid, doc_id, n, cid) of each row, (node, root) of each linked set number)."""
    keyed = frames.row_keys(docs)
    passed = frames.materialise(keyed.mapInArrow(_sets(width), SETS), "sets")
    sets = passed.where("token is null").select("did", "rid", "doc_id", "n", "cid")
    total = sets.agg(F.sum("n")).first()[0] or 0
    # at most 2**20 tokens can be as frequent as this
    often = max(FREQUENT, total >> 20)
    counts = passed.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= often)
    frequent = np.sort(np.array([r.token for r in counts.select("token").toLocalIterator()], np.int64)).view(np.uint64)
    buckets = max(1, -(-(total * 12) // (4 * BUCKET_BYTES)))
    messages = keyed.select("text").mapInArrow(_messages(width, percent, frequent, buckets), MESSAGE)
    named = messages.groupBy("bucket").applyInArrow(_stars, STARS).groupBy("star", "cid").agg(F.sum("k").alias("k"))
    named = frames.materialise(named, "stars")

    # one row of each set
    shown = sets.where("n > 0").groupBy("cid").agg(F.min(F.struct("did", "rid", "n")).alias("one")).select("cid", "one.*")
    stars = frames.materialise(kept_stars(named, shown.select("cid", "n"), percent), "kept-stars")
    several = frames.materialise(stars.groupBy("star").agg(F.count("*").alias("members")).where("members > 1").select("star"), "several")
    stars = frames.materialise(stars.join(several, "star", "left_semi"), "kept-stars")
    bags = bags_of(keyed, shown.select("did", "rid", "cid"), stars.select("cid").distinct(), width)
    return sets, components(star_links(stars, bags, percent))


def components_of(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach, the row's own included.  Null, empty and blank
    texts have no shingles and are linked with nothing, so they keep their own doc_id; repeated rows are
    linked; a null doc_id never counts as the smallest.  Other columns are ignored; an empty table gives
    an empty result.
    """
    sets, labels = linked_sets(docs, width, percent)
    rows = sets.join(labels.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each linked group: that with the smallest doc_id (null last), of equal ones
    one.  Rows without shingles all stay."""
    sets, labels = linked_sets(docs, width, percent)
    d, r, blank = frames.fresh_names(docs, "_d", "_r", "_blank")
    rows = sets.where("n > 0").join(labels.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "did", "rid")
    first = rows.groupBy("root").agg(F.min(order).alias("one")).select(F.col("one.did").alias(d), F.col("one.rid").alias(r), F.lit(False).alias(blank))
    blanks = sets.where("n = 0").select(F.col("did").alias(d), F.col("rid").alias(r), F.lit(True).alias(blank)).distinct()
    marked = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias(d), F.xxhash64(F.col("doc_id"), F.col("text")).alias(r))
    met = marked.join(first.unionByName(blanks), [d, r])
    # repeated rows share both numbers: one of them stays, unless they are blank
    alone = met.where(~F.col(blank)).dropDuplicates([d, r])
    return alone.unionByName(met.where(F.col(blank))).select(*[F.col(f"`{c}`") for c in docs.columns])
