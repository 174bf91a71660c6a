"""Alignment of two tokenizers' tokens by interval coalescing.

A token of either tokenizer is an interval of the bytes of a text.  All intervals of both are sorted by
start (``numpy.lexsort``), the running maximum of their ends is taken (``maximum.accumulate``), and a group
breaks where a start reaches that maximum: there tokens of both end.  Within a group each A token meets the
B tokens that it overlaps; pairs that also end together are the links.

Texts are cut before a single space between two characters that are no space.  Neither vocabulary has a token
that holds such a space behind another character (A's pattern begins a token there; B's pieces are looked
through when the model is loaded), so tokens and groups break there as well, and the intervals of each
different cut are coalesced once for a chunk of texts.

How often a pair of ids is linked in the corpus is asked for by chunk, not by document: a chunk of some
CHUNK_BYTES of texts, written once, asks for each of its different pairs.  Pairs are counted with partial
aggregation and joined back by the pair, which at most one row of each chunk has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .piece_encoding import MARK, default_model, texts_of

CHUNK_BYTES = 8_000_000
#: Characters of cuts that are encoded as one text.
RUN_CHARS = 30_000

#: before a single space between ASCII signs, letters or digits of any script
CUT = re.compile(r"(?<=[\w!-~])(?= [\w!-~])")
#: a cut that may have others before and behind it
JOINT = re.compile(r"^ [\w!-~](?:.*[\w!-~])?\Z", re.S)

CHUNK = T.StructType(
    [T.StructField("chunk", T.LongType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))]
    + [T.StructField("doc_id", T.ArrayType(T.LongType()))]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("n_a", "n_b", "n_groups")]
    + [T.StructField("digest", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.BinaryType()) for c in ("cuts", "cuts_from", "links", "links_from")]
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_vocabulary() -> str:
    """The public byte-level vocabulary's file, which every machine has with the library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each interval in that order): intervals by start, and a new group where a start reaches the
    running maximum of the ends before it."""
    order = np.lexsort((side, ends, starts))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[order][1:] >= reach[:-1]]) if len(order) else np.zeros(0, bool)
    return order, np.cumsum(fresh) - 1


def overlapping(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (of an A, of a B interval) of all pairs that overlap; each side is in order and without gaps inside a group."""
    first = np.searchsorted(b_end, a_start, "right")
    n = np.searchsorted(b_start, a_end, "left") - first
    a = np.repeat(np.arange(len(a_start)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Cuts:
    """Alignment of a list of cuts: counts of each (none where a side's bytes are not the cut's), groups as text, linked pairs in a row."""

    def __init__(self, parts: list[dict]):
        none = {"n_a": np.zeros(0, np.int64), "n_b": np.zeros(0, np.int64), "n_groups": np.zeros(0, np.int64), "sound": np.zeros(0, bool), "pairs": np.zeros(0, np.int64), "said": []}
        for c in ("n_a", "n_b", "n_groups", "sound", "pairs"):
            setattr(self, c, np.concatenate([none[c], *(p[c] for p in parts)]))
        self.said = [x for p in parts for x in p["said"]]


class Aligner:
    """Both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256, 257, ... in order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.vocab_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.names = np.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))], object)
        self.digits = np.array([len(x) for x in self.names], np.int64)
        self.cuttable = not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.vocab_size()))

    def cuts(self, text: str) -> list[str]:
        """The cuts of space + text; each begins with a space."""
        return CUT.split(f" {text}") if self.cuttable else [f" {text}"]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B of a text that begins with a space (B puts that before by itself)."""
        return np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), np.array(self.b.encode(text[1:], num_threads=1), np.int64)

    def align(self, cuts: list[str]) -> Cuts:
        """Alignment of each cut.  Cuts that another may follow are encoded in runs, the others one by one."""
        joins = [self.cuttable and bool(JOINT.search(c)) for c in cuts]
        parts: list = [None] * len(cuts)
        runs = [(k, k + 1) for k, ok in enumerate(joins) if not ok]
        at = 0
        for k, _ in [*runs, (len(cuts), 0)]:
            runs += [(at + i, at + j) for i, j in frames.steps([len(c) for c in cuts[at:k]], RUN_CHARS)]
            at = k + 1
        for i, j in runs:
            parts[i] = self._run(cuts[i:j]) or Cuts([self._run(cuts[k : k + 1]) or self._unsound() for k in range(i, j)]).__dict__
        return Cuts([p for p in parts if p])

    @staticmethod
    def _unsound() -> dict:
        none = np.zeros(1, np.int64)
        return {"n_a": none, "n_b": none, "n_groups": none, "sound": np.zeros(1, bool), "pairs": np.zeros(0, np.int64), "said": [""]}

    def _run(self, cuts: list[str]) -> dict | None:
        """Alignment of cuts that are encoded as one text; None if the tokens' bytes are not its bytes."""
        text = "".join(cuts)
        raw = text.encode("utf-8", "replace")
        a_ids, b_ids = self.encode(text)
        if not b"".join([self.a_bytes[i] for i in a_ids.tolist()]) == raw == b"".join([self.b_bytes[i] for i in b_ids.tolist()]):
            return None
        sizes = [len(c) for c in cuts] if len(raw) == len(text) else [len(c.encode("utf-8", "replace")) for c in cuts]
        border = np.cumsum(sizes)
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        a_start, b_start = a_end - self.a_size[a_ids], b_end - self.b_size[b_ids]
        side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
        order, group = coalesce(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]), side)
        of = np.empty(len(order), np.int64)
        of[order] = group
        a_group, b_group = of[: len(a_ids)], of[len(a_ids) :]
        i, j = overlapping(a_start, a_end, b_start, b_end)
        link = a_end[i] == b_end[j]
        # tokens and groups up to the end of each cut, which is the end of a token of both
        a_to, b_to = np.searchsorted(a_end, border, "right"), np.searchsorted(b_end, border, "right")
        group_to = a_group[a_to - 1] + 1
        count = lambda to: np.diff(to, prepend=0)
        said = self._said(np.concatenate([a_ids, b_ids]), of, side, a_to + b_to)
        return {"n_a": count(a_to), "n_b": count(b_to), "n_groups": count(group_to), "sound": np.ones(len(cuts), bool), "pairs": a_ids[i[link]] << 32 | b_ids[j[link]], "said": said}

    def _said(self, ids: np.ndarray, group: np.ndarray, side: np.ndarray, to: np.ndarray) -> list[str]:
        """Each cut's groups as text: A ids, a bar, B ids; groups between semicolons.  ``to``: tokens up to each cut's end."""
        order = np.argsort(group * 2 + side, kind="stable")
        ids, group, side = ids[order], group[order], side[order]
        after = np.where(group[1:] != group[:-1], ";", np.where(side[1:] != side[:-1], "|", ",")).astype(object)
        words = np.empty(2 * len(ids), object)
        words[::2], words[1::2] = self.names[ids], np.concatenate([after, [""]])
        text, stop = "".join(words.tolist()), np.cumsum(self.digits[ids] + 1)[to - 1]
        return [text[i : j - 1] for i, j in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


class _Chunk:
    """Documents of one chunk; each different cut is aligned once."""

    def __init__(self, tool: Aligner):
        self.tool, self.size = tool, 0
        self.number: dict[str, int] = {}
        self.ids: list = []
        self.cuts: list[np.ndarray] = []

    def add(self, ids: list, texts: list[str]) -> None:
        number = self.number
        for doc_id, text in zip(ids, texts, strict=True):
            cuts = self.tool.cuts(text) if text else []
            self.size += len(text)
            self.ids.append(doc_id)
            self.cuts.append(np.array([number.setdefault(c, len(number)) for c in cuts], np.int32))

    def batch(self, chunk: int) -> pa.RecordBatch:
        found = self.tool.align(list(self.number))
        if not found.sound.all():
            self.cuts = [c if found.sound[c].all() else c[:0] for c in self.cuts]
        start = _starts([len(c) for c in self.cuts])
        cuts = np.concatenate([*self.cuts, np.zeros(0, np.int32)])
        counts = {c: np.diff(_starts(getattr(found, c)[cuts])[start]) for c in ("n_a", "n_b", "n_groups")}
        said = found.said
        digests = [hashlib.sha256(";".join([said[k] for k in c.tolist()]).encode()).hexdigest() if len(c) else "" for c in self.cuts]
        # each cut has as many links as groups
        pairs, place = np.unique(found.pairs, return_inverse=True)
        times = np.bincount(place, np.repeat(np.bincount(cuts, minlength=len(said)), found.n_groups), len(pairs)).astype(np.int64)
        row = {"chunk": chunk, "pairs": pairs.tolist(), "times": times.tolist(), "doc_id": self.ids, "digest": digests} | {c: v.tolist() for c, v in counts.items()}
        kept = {"cuts": cuts, "cuts_from": start, "links": place.astype(np.int32), "links_from": _starts(found.n_groups)}
        return pa.RecordBatch.from_pylist([row | {k: _packed(v) for k, v in kept.items()}], schema=_schema(CHUNK))


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _starts(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int64)


def _schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _chunks(a_path: str, b_path: str, limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        tool, n = aligner(a_path, b_path), 0
        # the written files hold one attempt of each task only, so its number tells chunks apart
        base = TaskContext.get().partitionId() << 24
        now = _Chunk(tool)
        for batch in batches:
            sizes = [x + 16 for x in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()]
            for i, j in frames.steps(sizes):
                now.add(batch.column("doc_id")[i:j].to_pylist(), texts_of(batch.column("text")[i:j]))
                if now.size >= limit:
                    yield now.batch(base + n)
                    now, n = _Chunk(tool), n + 1
        if now.cuts:
            yield now.batch(base + n)

    return work


def _answered(key, chunks, replies):
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    schema = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in names])
    out = []
    pair = replies.column("pair").to_numpy()
    order = np.argsort(pair)
    count, best = replies.column("count").to_numpy()[order], replies.column("best").to_numpy()[order].astype(np.int64)
    for row in chunks.to_batches():
        for k in range(row.num_rows):
            one = {c: row.column(c)[k] for c in row.schema.names}
            array = lambda c, kind: _unpacked(one[c].as_py(), kind)  # noqa: B023, E731
            cuts, cuts_from, links, links_from = array("cuts", np.int32), array("cuts_from", np.int64), array("links", np.int32), array("links_from", np.int64)
            total = lambda values: np.diff(_starts(values)[links_from])  # noqa: B023, E731  # of each cut
            per_cut = {"n_links": np.diff(links_from), "n_best": total(best[links]), "count_sum": total(count[links])}
            out.append(
                pa.Table.from_pydict(
                    {c: one[c].values for c in ("doc_id", "n_a", "n_b", "n_groups")} | {c: np.diff(_starts(v[cuts])[cuts_from]) for c, v in per_cut.items()} | {"groups_sha256": one["digest"].values},
                    schema=schema,
                )
            )
    return pa.concat_tables(out) if out else schema.empty_table()


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes space + text by ``vocabulary``, B the text by ``model`` (paths on every machine), which puts the space
    before by itself.  Null and empty texts, and texts whose tokens' bytes are not those of space + text, have no
    tokens: zeros and an empty digest.  Repeated rows count as often as they occur; texts are taken whole; other
    columns are ignored; an empty table gives an empty result.
    """
    paths = vocabulary or default_vocabulary(), model or default_model()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    chunks = frames.materialise(rows.mapInArrow(_chunks(*paths, chunk_bytes), CHUNK), "aligned")
    asked = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = pair_counts(asked)
    replies = asked.select(F.col("chunk").alias("asker"), "pair").join(counts, "pair").select("asker", "pair", "count", "best")
    held = chunks.drop("pairs", "times").groupBy("chunk")
    return held.cogroup(replies.groupBy("asker")).applyInArrow(_answered, ALIGNED)


def pair_counts(asked: DataFrame) -> DataFrame:
    """(pair, count, best): how often each pair of ids is linked, and whether no A id is linked to its B id more often."""
    counts = frames.materialise(asked.groupBy("pair").agg(F.sum("times").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # one row a B id: bounded by the vocabulary
    most = F.broadcast(counts.groupBy(b.alias("b")).agg(F.max("count").alias("most")))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def overlaps(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """The alignment itself: a row for each pair of tokens that overlap: doc_id, group, a_id, a_start, a_end, b_id, b_start,
    b_end (byte offsets in space + text), together (whether they end together).  Rules as for ``align``; texts without tokens
    have no rows."""
    paths = vocabulary or default_vocabulary(), model or default_model()
    names = ("doc_id", "group", "a_id", "a_start", "a_end", "b_id", "b_start", "b_end")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tool = aligner(*paths)
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
            if not text:
                continue
            a, b = tool.encode(f" {text}")
            if not b"".join(tool.a_bytes[i] for i in a) == f" {text}".encode("utf-8", "replace") == b"".join(tool.b_bytes[i] for i in b):
                continue
            a_end, b_end = np.cumsum(tool.a_size[a]), np.cumsum(tool.b_size[b])
            a_start, b_start = a_end - tool.a_size[a], b_end - tool.b_size[b]
            order, group = coalesce(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]), np.repeat([0, 1], [len(a), len(b)]))
            of = np.empty(len(order), np.int64)
            of[order] = group
            i, j = overlapping(a_start, a_end, b_start, b_end)
            columns = (pa.array([doc_id] * len(i), pa.int64()), of[i], a[i], a_start[i], a_end[i], b[j], b_start[j], b_end[j])
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(names, columns, strict=True)} | {"together": a_end[i] == b_end[j]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(frames.per_step(work), ", ".join(f"`{c}` long" for c in names) + ", together boolean")
