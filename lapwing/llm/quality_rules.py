"""Quality rules: a few counts of each text, then a log-likelihood ratio of hashed n-grams.

Words and word pairs are hashed into BUCKETS counters, once over all rows (the raw corpus) and once
over the rows that ``trusted`` names (the target).  The raw multinomial is add-one smoothed; the
target's is drawn towards it with the weight of PRIOR occurrences a bucket, so a bucket that is rare
says little.  A text's ratio is the mean over its n-grams of log p_target - log p_raw, and so does
not depend on its length.
It is kept if the base rules pass and the ratio is at least ``min_ratio``; every row is judged, and
the same tables give the same verdicts.

Each task adds its counters up before anything is shuffled, so at most BUCKETS rows leave a task
whatever the text; the driver gets BUCKETS numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .kernels import SPACES, Rolling, Words

BUCKETS = 1 << 16
MIN_RATIO = -0.05
PRIOR = 30.0
#: fixed values: characters that count as symbols
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each word and each pair of words."""
    at, pairs = words.grams(2)
    bucket = np.concatenate([words.hash, pairs]) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([words.doc, words.doc[at]])


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)

    def add(batch: pa.RecordBatch):
        bucket, row = _grams(Words(batch.column("text").to_pylist(), table=None))
        np.add(raw, np.bincount(bucket, minlength=BUCKETS), out=raw)
        chosen = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)[row]
        np.add(target, np.bincount(bucket[chosen], minlength=BUCKETS), out=target)
        return ()

    for _ in frames.per_step(add)(batches):
        pass
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "raw": raw[at], "target": target[at]})


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    p_raw = (raw + 1) / (raw.sum() + len(raw))
    expected = target.sum() * p_raw
    p_target = p_raw * (target + PRIOR) / (expected + PRIOR)
    return np.log(p_target / p_target.sum()) - np.log(p_raw)


def _per_row(at: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, minlength=size).astype(np.int64)


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """The rules' counts for each text of a batch."""
    size, data = len(words.starts), words.data
    row = lambda at: np.searchsorted(words.starts, at, "right") - 1
    letters = np.concatenate([[0], np.cumsum(~SPACES[data] & ((data & 0xC0) != 0x80))])
    out = {"n_words": _per_row(words.doc, size), "word_chars": letters[words.ends] - letters[words.starts], "n_symbols": _per_row(row(np.flatnonzero(SYMBOLS[data])), size)}
    # a line ends at a line feed or where its text does
    ends = np.union1d(np.flatnonzero(data == 0x0A), words.ends)
    line = row(ends)
    begins = np.concatenate([[0], ends[:-1] + 1])
    worded = letters[ends] > letters[begins]
    key = Rolling(data, 1).of(begins[worded], ends[worded]) if len(data) else np.zeros(0, np.uint64)
    order = np.lexsort((key, line[worded]))
    again = (np.diff(key[order]) == 0) & (np.diff(line[worded][order]) == 0)
    out["n_dup_lines"] = _per_row(line[worded][order][1:][again], size)
    at, gram = words.grams(3)
    order = np.lexsort((gram, words.doc[at]))
    same = (gram[order][1:] == gram[order][:-1]) & (words.doc[at][order][1:] == words.doc[at][order][:-1])
    twice = np.zeros(len(at) + 1, bool)
    twice[1:-1] |= same[: len(at) - 1]
    hit = at[order][twice[:-1] | twice[1:]] if len(at) else at
    covered = np.zeros(words.n + 2, bool)
    for k in range(3):
        covered[hit + k] = True
    out["n_repeat_words"] = _per_row(words.doc[covered[: words.n]], size)
    return out


RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double"


def _judge(ratios: np.ndarray, min_ratio: float):
    def work(batch: pa.RecordBatch):
        words = Words(batch.column("text").to_pylist(), table=None)
        size = batch.num_rows
        base = base_counts(words)
        bucket, row = _grams(words)
        ratio = np.bincount(row, ratios[bucket], size) / np.maximum(np.bincount(row, minlength=size), 1)
        failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | base | {"base_failed": failed, "kept": ~failed & (ratio >= min_ratio), "ratio": ratio})

    return frames.per_step(work)


def apply_rules(docs: DataFrame, trusted: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, ratio.

    ``trusted`` has the doc_ids whose rows make the target.  Null and empty texts have no words and
    fail the base rules; repeated rows are judged alike and each counts; without trusted rows the
    target is the raw corpus, and no ratio speaks against a row.  Other columns of ``docs`` are ignored, and
    an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    # merged at every size: a list of trusted rows grows with the corpus, so it is never broadcast
    marked = rows.join(named.hint("merge"), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in marked.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toLocalIterator():
        raw[b], target[b] = r, t
    return rows.mapInArrow(_judge(log_ratios(raw, target), min_ratio), RULES)
