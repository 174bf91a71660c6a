"""Benchmark decontamination: training passages that hold a test item.

Test items make a BM25 inverted index with block-max postings.  Every text is cut into overlapping
passages, long enough that any item lies wholly inside one, and every passage is a query.  The short
postings lists (words in few items) are gone through for all passages of a batch at once: an item
whose short lists give a passage too little to reach its threshold, even with all that the item's
long lists could add, is out of it.  Passages with an item left go through block-max WAND, which
returns every item whose score reaches the item's threshold (a share of its score against itself).
A hit counts when question and answer are both found in the passage, by shares of their word triples.

The index is shipped to tasks only in parts of at most ``part_bytes`` of item text, checked before;
a larger benchmark takes several passes.  Item frequencies of words, the number of items and their
lengths are counted over all items, so scores, thresholds and passages are the same in however many
parts the benchmark comes.  Texts are never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .kernels import PLAIN, Words, mix

K1, B = 1.2, 0.75
BLOCK = 64
#: An item is retrieved at this share of its score against itself.
RETRIEVE = 0.6
#: and verified at this share of word triples, of question and of answer.
VERIFY = 0.7
PART_BYTES = 8_000_000
END_MARK = -1


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last line or sentence; of a single sentence, its last quarter of words."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if re.search(r"\w", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(len(words) // 4, 1)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _triples(words: Words, row: int) -> np.ndarray:
    """Distinct hashes of three words in a row of a text; of fewer words, of all of them."""
    mine = words.hash[words.first[row] : words.first[row + 1]]
    n = min(3, len(mine))
    return _runs(mine, n) if n else np.zeros(0, np.uint64)


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    value = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for k in range(n):
        value = mix(value * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + len(value)])
    return np.unique(value)


class Index:
    """BM25 postings of some items, in the order of their numbers, with a maximum for each block.

    ``over_all``: (number, mean length and greatest length of all items, word hashes in order, in how many items
    each is), where these are not all."""

    def __init__(self, items: list[tuple[int, str]], retrieve: float, over_all: tuple[int, float, int, np.ndarray, np.ndarray] | None = None):
        self.ids = [i for i, _ in items]
        words = Words([t for _, t in items], table=PLAIN)
        size = np.diff(words.first)
        vocabulary, term = np.unique(words.hash, return_inverse=True)
        pair, tf = np.unique(term * len(items) + words.doc, return_counts=True)
        term, item = pair // max(len(items), 1), pair % max(len(items), 1)
        df = np.bincount(term, minlength=len(vocabulary))
        n, mean, longest, known, often = over_all or (len(items), float(size.mean()) if len(size) else 1.0, int(size.max(initial=0)), vocabulary, df)
        often = often[np.searchsorted(known, vocabulary)]
        idf = np.log(1 + (n - often + 0.5) / (often + 0.5))
        mean = max(mean, 1.0)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / mean))
        self.vocabulary, self.item, self.weight = vocabulary, item, weight
        self.start = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        self.greatest = np.maximum.reduceat(weight, self.start[:-1]) if len(weight) else np.zeros(0)
        # lists in blocks of BLOCK postings: of each block the last item and the greatest weight
        blocks = -(-df // BLOCK)
        self.block = np.concatenate([[0], np.cumsum(blocks)])
        head = np.repeat(self.start[:-1], blocks) + (np.arange(blocks.sum()) - np.repeat(self.block[:-1], blocks)) * BLOCK
        self.block_end = np.append(head[1:], len(weight)) if len(weight) else np.zeros(0, np.int64)
        self.block_last = item[self.block_end - 1]
        self.block_most = np.maximum.reduceat(weight, head) if len(weight) else np.zeros(0)
        self.read = 0
        own = np.bincount(item, weight, len(items))
        self.threshold = retrieve * own
        has = own > 0
        self.lowest = float(self.threshold[has].min()) if has.any() else np.inf
        # what short lists must give an item at least: its threshold without all that long lists can add; an item for
        # which that is nothing has all its postings among those gone through
        short = df <= max(2, len(items) // 50)
        needed = self.threshold - np.bincount(item, np.where(short[term], 0, weight), len(items))
        loose = needed <= 1e-5
        self.needed = np.where(has, np.where(loose, self.threshold, needed), np.inf)
        sifted = short[term] | loose[item]
        self.sieve_item, self.sieve_weight = item[sifted], weight[sifted]
        self.sieve_start = np.searchsorted(term[sifted], np.arange(len(vocabulary) + 1))
        self.span = 2 * max(64, longest)
        halves = [split_item(t) for _, t in items]
        asked, told = Words([h[0] for h in halves], table=PLAIN), Words([h[1] for h in halves], table=PLAIN)
        self.question = [_triples(asked, i) for i in range(len(items))]
        self.answer = [_triples(told, i) for i in range(len(items))]
        self.answer_words = [min(3, int(n)) for n in np.diff(told.first)]
        self.question_words = [min(3, int(n)) for n in np.diff(asked.first)]

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, or -1."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def open_passages(self, term: np.ndarray, row: np.ndarray, piece: np.ndarray, base: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Numbers of the passages in which some item may reach its threshold.  A word in piece b of its text is
        in passages b - 1 and b, as far as there are any; base and count: first passage and number of each text."""
        items = len(self.ids)
        at = np.flatnonzero(term >= 0)
        size = self.sieve_start[term[at] + 1] - self.sieve_start[term[at]]
        entry = np.repeat(self.sieve_start[term[at]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        word = np.repeat(at, size)
        keys, weights = [], []
        for back in (0, 1):
            passage = piece[word] - back
            inside = (passage >= 0) & (passage < count[row[word]])
            keys.append((base[row[word]] + passage)[inside] * items + self.sieve_item[entry][inside])
            weights.append(self.sieve_weight[entry][inside])
        key, weight = np.concatenate(keys), np.concatenate(weights)
        if not len(key):
            return key
        if int(count.sum()) * items <= 1 << 24:
            total = np.bincount(key, weight, int(count.sum()) * items)
            key = np.flatnonzero(total)
            total = total[key]
        else:
            key, where = np.unique(key, return_inverse=True)
            total = np.bincount(where, weight)
        return np.unique(key[total >= self.needed[key % items] - 1e-6] // items)

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items whose score for the distinct ``terms`` reaches their threshold.  ``read`` counts the postings looked at."""
        low = self.lowest - 1e-9
        # of each list: item it stands at, position, block, block behind its last, greatest weight
        lists = [[int(self.item[self.start[t]]), int(self.start[t]), int(self.block[t]), int(self.block[t + 1]), float(self.greatest[t])] for t in terms]
        self.read += len(lists)
        out = []
        while True:
            lists.sort()
            total, pivot = 0.0, END_MARK
            for k, x in enumerate(lists):
                total += x[4]
                if total >= low:
                    pivot = k
                    break
            if pivot == END_MARK:
                return out
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            ahead = lists[: pivot + 1]
            # block maxima of the blocks in which the pivot item would be; no posting is read for them
            bound, reach = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else len(self.ids)
            for x in ahead:
                x[2] = bisect_left(self.block_last, item, x[2], x[3])
                if x[2] < x[3]:
                    bound += float(self.block_most[x[2]])
                    reach = min(reach, int(self.block_last[x[2]]) + 1)
            if bound < low:
                target = max(reach, item + 1)
            elif bound < self.threshold[item] - 1e-9:
                target = item + 1
            elif ahead[0][0] < item:
                target = item
            else:
                score = float(sum(self.weight[x[1]] for x in ahead))
                if score >= self.threshold[item] - 1e-9:
                    out.append((item, score))
                target = item + 1
            for x in ahead:
                if x[0] < target:
                    self._seek(x, target)
            lists = [x for x in lists if x[2] < x[3]]

    def _seek(self, x: list, target: int) -> None:
        """Set a list to its first posting of an item not before ``target``: over blocks by their last items, then inside one."""
        x[2] = bisect_left(self.block_last, target, x[2], x[3])
        if x[2] < x[3]:
            end = int(self.block_end[x[2]])
            x[1] = bisect_left(self.item, target, max(x[1], end - BLOCK), end)
            x[0] = int(self.item[x[1]])
            self.read += 1

    def verify(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the item's question and answer that the passage (word hashes) holds."""
        share = lambda want, n: float(np.isin(want, _runs(passage, n)).mean()) if len(want) else 1.0
        return share(self.question[item], self.question_words[item]), share(self.answer[item], self.answer_words[item])


HITS = "did long, rid long, doc_id long, item_id long, score double, question_share double, answer_share double, n_passages long"


def _hits(index: Index, verify: float, texts: list) -> dict[tuple[int, int], list]:
    """(row, item) -> [score, question share, answer share, passages] of the items that texts hold."""
    found: dict[tuple[int, int], list] = {}
    step = index.span // 2
    words = Words(texts, table=PLAIN)
    if not words.n:
        return found
    term = index.look_up(words.hash)
    # passages start every ``step`` words of a text and are twice as long
    n = np.diff(words.first)
    count = np.maximum(-(-n // step) - 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), count)
    base = np.cumsum(count) - count
    lo = words.first[row] + (np.arange(len(row)) - base[row]) * step
    hi = np.minimum(lo + index.span, words.first[row + 1])
    open_ = index.open_passages(term, words.doc, (np.arange(words.n) - words.first[words.doc]) // step, base, count)
    for k in open_.tolist():
        mine = term[lo[k] : hi[k]]
        for item, score in index.wand(np.unique(mine[mine >= 0]).tolist()):
            asked, told = index.verify(item, words.hash[lo[k] : hi[k]])
            if asked >= verify and told >= verify:
                have = found.setdefault((int(row[k]), item), [0.0, 0.0, 0.0, 0])
                have[:] = [max(have[0], score), max(have[1], asked), max(have[2], told), have[3] + 1]
    return found


def _search(index: Index, verify: float):
    def work(batch: pa.RecordBatch):
        found = _hits(index, verify, batch.column("text").to_pylist())
        if found:
            keep = np.array([r for r, _ in found])
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False)[keep] for c in ("did", "rid")}
            columns["doc_id"] = batch.column("doc_id").take(pa.array(keep))
            v = list(found.values())
            columns |= {"item_id": pa.array([index.ids[i] for _, i in found], pa.int64()), "score": [x[0] for x in v], "question_share": [x[1] for x in v], "answer_share": [x[2] for x in v], "n_passages": [x[3] for x in v]}
            yield pa.RecordBatch.from_pydict(columns)

    return frames.per_step(work)


def _without(index: Index, verify: float):
    """The rows that hold no item."""

    def work(batch: pa.RecordBatch):
        keep = np.ones(batch.num_rows, bool)
        keep[[r for r, _ in _hits(index, verify, batch.column("text").to_pylist())]] = False
        yield batch.filter(pa.array(keep))

    return frames.per_step(work)


def _terms(batches):
    """(term, part, words): the distinct words of each item, and a row without a term for its length."""
    for batch in batches:
        words = Words(batch.column("text").to_pylist(), table=PLAIN)
        part = batch.column("part").to_numpy()
        pair = np.unique(np.stack([words.doc.astype(np.uint64), words.hash], 1), axis=0) if words.n else np.zeros((0, 2), np.uint64)
        owner = pair[:, 0].astype(np.int64)
        term = pa.array(np.concatenate([pair[:, 1], np.zeros(len(part), np.uint64)]).view(np.int64), mask=np.arange(len(pair) + len(part)) >= len(pair))
        yield pa.RecordBatch.from_arrays([term, pa.array(np.concatenate([part[owner], part]), pa.int32()), pa.array(np.concatenate([np.zeros(len(owner), np.int64), np.diff(words.first)]))], names=["term", "part", "words"])


def indexes(benchmark: DataFrame, retrieve: float, part_bytes: int) -> Iterator[Index]:
    """The index of each part of the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    over_all = None
    if parts > 1:
        terms = frames.materialise(items.mapInArrow(_terms, "term long, part int, words long"), "item-terms")
        n, mean, longest = terms.where("term is null").agg(F.count("*"), F.avg("words"), F.max("words")).first()
        often = frames.materialise(terms.where("term is not null").groupBy("term").agg(F.count("*").alias("df")), "item-frequencies")
    for part in range(parts):
        rows = items.where(F.col("part") == part).collect()  # at most about part_bytes
        if parts > 1:
            mine = often.join(terms.where((F.col("part") == part) & F.col("term").isNotNull()).select("term").distinct(), "term").collect()
            known, df = (np.array([r[k] for r in mine], np.int64) for k in ("term", "df"))
            order = np.argsort(known.view(np.uint64))
            over_all = n, mean, longest, known.view(np.uint64)[order], df[order]
        yield Index(sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])), retrieve, over_all)


def contaminated(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, verify: float = VERIFY, part_bytes: int = PART_BYTES) -> DataFrame:
    """did, rid, doc_id, item_id, score, question_share, answer_share, n_passages: one row for each row
    of ``docs`` and item that it holds.

    Null and empty texts hold nothing; items without words are never found; repeated rows of ``docs``
    are each found, repeated items are each reported; other columns are ignored; with either table
    empty the result is empty.
    """
    keyed = frames.row_keys(docs)
    return reduce(DataFrame.unionByName, (keyed.mapInArrow(_search(index, verify), HITS) for index in indexes(benchmark, retrieve, part_bytes)))


def clean(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, verify: float = VERIFY, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, whatever their names; null and empty texts
    stay, repeated rows stay or go together.  One pass a part of the benchmark hands on what has none of it."""
    return reduce(lambda rows, index: rows.mapInArrow(_without(index, verify), docs.schema), indexes(benchmark, retrieve, part_bytes), docs)
