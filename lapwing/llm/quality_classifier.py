"""Quality classifier by compression: a text of a kind compresses better with a dictionary of its kind.

Two zstandard dictionaries are built from good and from bad labelled texts.  For a text of n bytes
that they compress to G and B bytes, the normalised difference (B - G) / n says which kind it is
nearer to.  It is taken of the whole text, and the least of its blocks of CHUNK bytes, so junk inside
a clean text shows as well; G / n goes along, since a difference of nearly nothing means one thing in
ordinary prose and another in a text that is one word over and over.  A logistic curve (with squares
and products) turns them into the probability of label 1.

Dictionaries and curve come from a bounded sample of labelled rows, ``per_kind`` a kind for the
dictionaries and ``for_curve`` others for the curve, taken in the order of a hash; texts of over
``max_bytes`` are left out of the sample, of a repeated doc_id one text is taken, and the texts of each
use end at ``use_bytes`` together.  Scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

DICTIONARY_BYTES = 112_640
CHUNK = 1024
LEVEL = 3


class Model:
    """Two dictionaries and a calibrated curve; plain values only, so it travels with a task."""

    def __init__(self, good: bytes, bad: bytes, prior: float):
        self.dictionaries, self.prior = (good, bad), prior
        self.mean = self.scale = self.weights = None
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    @property
    def compressors(self):
        if self._pair is None:
            self._pair = []
            for raw in self.dictionaries:
                kept = zstandard.ZstdCompressionDict(raw)
                kept.precompute_compress(level=LEVEL)
                self._pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._pair

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        n = max(len(raw), 1)
        g, b = (len(c.compress(raw)) for c in self.compressors)
        least, dense = (b - g) / n, g / n
        if len(raw) > CHUNK:
            for at in range(0, len(raw), CHUNK):
                part = raw[min(at, len(raw) - CHUNK) :][:CHUNK]  # the last one reaches back, so that it is whole
                pg, pb = (len(c.compress(part)) for c in self.compressors)
                least, dense = min(least, (pb - pg) / CHUNK), min(dense, pg / CHUNK)
        return [(b - g) / n, (b - g) / max(g + b, 1), g / n, float(np.log(n)), least, dense]

    def _terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        k = z.shape[1]
        return np.column_stack([np.ones(len(z)), z, *(z[:, i] * z[:, j] for i in range(k) for j in range(i, k))])

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> None:
        """Newton steps of a ridge-penalised logistic regression."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        terms = self._terms(x)
        w = np.zeros(terms.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(terms @ w, -30, 30)))
            curve = (terms * (p * (1 - p))[:, None]).T @ terms + ridge * np.eye(len(w))
            w = w + np.linalg.solve(curve, terms.T @ (y - p) - ridge * w)
        self.weights = w

    def score(self, texts: list) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x = np.array([self.features(t) for t in texts], float).reshape(-1, 6)
        return 1 / (1 + np.exp(-np.clip(self._terms(x) @ self.weights, -30, 30)))


def _dictionary(texts: list[str]) -> bytes:
    samples = [t.encode("utf-8", "surrogatepass") for t in texts]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its text itself
        return b"\n".join(samples)[:DICTIONARY_BYTES]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, per_kind: int = 1500, for_curve: int = 4000, max_bytes: int = 200_000, use_bytes: int = 24_000_000) -> Model:
    """Learn from rows of ``labels`` outside fold ``held``; at most 2 * per_kind + for_curve rows, and 3 * use_bytes of
    text, are gathered."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (frames.crc_fold(modulus) != held))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("kind"))
    turn = F.xxhash64("doc_id", F.lit(3))
    curve = usable.where(F.pmod(turn, F.lit(2)) == 0).orderBy(turn, "doc_id").limit(for_curve).withColumn("use", F.lit("curve"))
    picked = [curve] + [usable.where((F.pmod(turn, F.lit(2)) == 1) & (F.col("kind") == k)).orderBy(turn, "doc_id").limit(per_kind).withColumn("use", F.lit("words")) for k in (0, 1)]
    # at most 2 * per_kind + for_curve rows of three small columns
    sample = F.broadcast(picked[0].unionByName(picked[1]).unionByName(picked[2]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)).between(1, max_bytes)).join(sample, "doc_id")
    rows = frames.materialise(rows.groupBy("doc_id", "kind", "use").agg(F.min("text").alias("text")), "sample")
    sizes = sorted(rows.select("use", "kind", F.xxhash64("doc_id", F.lit(3)).alias("turn"), "doc_id", F.octet_length("text").alias("size")).collect())
    have: dict[tuple, int] = {}
    chosen = []
    for r in sizes:
        use = (r.use, r.kind if r.use == "words" else None)
        have[use] = have.get(use, 0) + r.size
        if have[use] <= use_bytes:
            chosen.append(r.doc_id)
    rows = rows.where(F.col("doc_id").isin(chosen)).collect() if len(chosen) < len(sizes) else rows.collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    texts = {k: [r.text for r in rows if r.use == "words" and r.kind == k] for k in (0, 1)}
    y = np.array([r.kind for r in rows if r.use == "curve"], float)
    known = [r.kind for r in rows]
    model = Model(b"", b"", float(np.mean(known)) if known else 0.5)
    if texts[0] and texts[1] and 0 < y.sum() < len(y):
        model = Model(_dictionary(texts[1]), _dictionary(texts[0]), model.prior)
        model.fit(np.array([model.features(r.text) for r in rows if r.use == "curve"]), y)
    return model


def scorer(model: Model, keep: list[str], name: str = "score"):
    """mapInArrow function: the columns ``keep``, and the score as ``name``."""

    def work(batch: pa.RecordBatch):
        score = model.score(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=[*keep, name])

    return frames.per_step(work)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` at least, with all their columns, whatever their names."""

    def work(batch: pa.RecordBatch):
        yield batch.filter(pa.array(model.score(batch.column("text").to_pylist()) >= threshold))

    return docs.mapInArrow(frames.per_step(work), docs.schema)


def score(docs: DataFrame, model: Model, modulus: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are scored as a text of no bytes; equal texts score alike, repeated or not;
    with no or one-sided labels every score is the share of label 1 (one half without any).  Other
    columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (frames.crc_fold(modulus) == held).alias("held_out"))
    scored = rows.mapInArrow(scorer(model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
