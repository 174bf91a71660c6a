"""Removal of byte strings that occur twice, by a depth-limited most-significant-digit radix sort.

A full suffix order is not needed: suffixes only have to be told apart through the first
``threshold`` bytes, and groups that are still together at that depth are exactly the repeated
windows.  Three radix passes refine groups of suffixes; a group of one leaves the sort at once.

1. *First digit: an anchor.*  Every window of ``threshold`` bytes holds ``threshold - ANCHOR + 1``
   strings of ANCHOR bytes; the one with the least hash is the window's anchor, and depends on the
   window's bytes alone.  Neighbouring windows share it, so suffixes come in *runs* with one anchor
   and one offset range, and a run is one row.  Runs whose anchor occurs once are done.
   Runs whose whole text (the union of their windows) equals another run's are repeated throughout.
2. *Second digit: blocks* of BLOCK windows cut at fixed distances from the anchor.  The part that
   all windows of a block share (its core) must repeat, else they are done; blocks whose whole text
   repeats are repeated throughout.
3. *Last digit: the whole window*, for what is still undecided.

At each pass one row of every group that is already known to repeat goes on as a witness, so
suffixes further down can still meet it.  Groups are compared by 96-bit hashes and counted with
partial aggregation, so a passage that a third of all documents hold is one row per task; no pairs
are made.  Joins back to the members are plain equi-joins against unique keys; those keys are written
down first, so that both sides are shuffles of their own and adaptive execution splits a hot key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .kernels import Rolling, layout, mix, sliding_min

ANCHOR = 128
BLOCK = 16
#: Window starts that one step of a very long text covers.
CHUNK = 2_000_000


def _pair(first: Rolling, second: Rolling, start, end, salt) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that tell data[start:end] (and the salt) apart."""
    salt = salt.astype(np.uint64)
    k1 = mix(first.of(start, end) + salt * np.uint64(0x9E3779B97F4A7C15))
    k2 = mix(second.of(start, end) + salt)
    return k1.view(np.int64), (k2 >> np.uint64(32)).astype(np.uint32).view(np.int32)


def find_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int) -> dict:
    """Runs of windows with one anchor: text index, first and last window start, anchor."""
    anchor = min(ANCHOR, max(threshold // 3, 1))
    none = np.zeros(0, np.int64)
    if len(data) < threshold:
        return {"doc": none, "p0": none, "p1": none, "a": none, "rolling": None}
    rolling = Rolling(data, 1)
    grams = rolling.fixed(anchor)
    ranked = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    a = (sliding_min(ranked, threshold - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.arange(len(a))
    doc = np.searchsorted(starts, at, "right") - 1
    inside = at + threshold <= ends[doc]
    cut = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1], [True]])
    p0 = np.flatnonzero(cut[:-1] & inside)
    after = np.concatenate([~inside[1:], [True]]) | cut[1:]
    p1 = np.flatnonzero(after & inside)
    return {"doc": doc[p0], "p0": p0, "p1": p1, "a": a[p0], "grams": grams, "rolling": rolling}


def _pieces_of(texts: list[bytes], threshold: int):
    """(batch of byte strings, index of the text, offset in it): long texts in overlapping chunks."""
    batch, owner, offset, have = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - threshold + 1, 1), CHUNK):
            piece = text[at : at + CHUNK + threshold - 1]
            if have and have + len(piece) > CHUNK:
                yield batch, owner, offset
                batch, owner, offset, have = [], [], [], 0
            batch.append(piece)
            owner.append(i)
            offset.append(at)
            have += len(piece)
    if batch:
        yield batch, owner, offset


RUNS = "did long, rid long, p0 long, geom int, akey long, k1 long, k2 int"


def _runs(threshold: int):
    def work(batch: pa.RecordBatch):
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        did = batch.column("did").to_numpy(zero_copy_only=False)
        rid = batch.column("rid").to_numpy(zero_copy_only=False)
        for group, owner, offset in _pieces_of(texts, threshold):
            data, starts, ends = layout(group)
            r = find_runs(data, starts, ends, threshold)
            if not len(r["p0"]):
                continue
            p0, p1, a = r["p0"], r["p1"], r["a"]
            k1, k2 = _pair(r["rolling"], Rolling(data, 2), p0, p1 + threshold, a - p0)
            row = np.asarray(owner)[r["doc"]]
            yield pa.RecordBatch.from_pydict(
                {
                    "did": did[row],
                    "rid": rid[row],
                    "p0": p0 - starts[r["doc"]] + np.asarray(offset)[r["doc"]],
                    "geom": ((p1 - p0) << 16 | (a - p0)).astype(np.int32),
                    "akey": r["grams"][a].view(np.int64),
                    "k1": k1,
                    "k2": k2,
                }
            )

    return frames.per_step(work)


FOUND = "kind int, did long, rid long, doc_id long, text string, spans array<long>, p0 long, geom int, undecided boolean, piece binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _verdict(text: bytes, spans: list[tuple[int, int]]) -> dict:
    """The digest columns of one text whose removed byte ranges are ``spans``."""
    spans = _merge(spans)
    digest, at = hashlib.sha256(), 0
    for lo, hi in spans:
        digest.update(text[at:lo])
        at = hi
    digest.update(text[at:])
    return {"n_bytes": len(text), "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": digest.hexdigest()}


def _locate(threshold: int):
    """Finish texts whose runs are all decided; send on the others, and the pieces to look into."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def batches(frames_in):
        for batch in frames_in:
            rows = []
            size = 0
            for row in batch.to_pylist():
                text = row["text"].encode("utf-8", "surrogatepass")
                base = {n: None for n in names} | {k: row[k] for k in ("did", "rid", "doc_id")}
                found = row["found"] or []
                spans = [(f["p0"], f["p0"] + (f["geom"] >> 16) + threshold) for f in found if f["what"] == 1]
                if any(f["what"] == 3 for f in found):
                    rows.append(base | {"kind": 1, "text": row["text"], "spans": [x for s in _merge(spans) for x in s]})
                else:
                    rows.append(base | {"kind": 0} | _verdict(text, spans))
                size += len(text)
                for f in found:
                    if f["what"] > 1:
                        piece = text[f["p0"] : f["p0"] + (f["geom"] >> 16) + threshold]
                        rows.append(base | {"kind": 2, "p0": f["p0"], "geom": f["geom"], "undecided": f["what"] == 3, "piece": piece})
                        size += len(piece)
                if size > frames.STEP_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return batches


_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("did", pa.int64()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.int64())), ("p0", pa.int64()), ("geom", pa.int32())]
    + [("undecided", pa.bool_()), ("piece", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
)

BLOCKS = "did long, rid long, p0 long, b int, undecided boolean, core long, k1 long, k2 int"


def _laid_out(batch: pa.RecordBatch, threshold: int):
    """The pieces of a batch in one array, with each window's piece, start and block number."""
    pieces = batch.column("piece").to_pylist()
    geom = batch.column("geom").to_numpy(zero_copy_only=False).astype(np.int64)
    data, starts, _ = layout(pieces)
    span, off = geom >> 16, geom & 0xFFFF
    owner = np.repeat(np.arange(len(pieces)), span + 1)
    rel = np.arange(len(owner)) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
    block = (off[owner] - rel) // BLOCK
    return data, starts, owner, rel, block, off


def _blocks(threshold: int):
    def work(batch: pa.RecordBatch):
        data, starts, owner, rel, block, off = _laid_out(batch, threshold)
        first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])]))
        last = np.concatenate([first[1:], [len(owner)]]) - 1
        o, b = owner[first], block[first]
        one, two = Rolling(data, 1), Rolling(data, 2)
        anchor = starts[o] + off[o]
        lo, hi = anchor - BLOCK * b, anchor - BLOCK * b - BLOCK + 1 + threshold
        lo, hi = np.maximum(lo, starts[o]), np.maximum(hi, lo + 1)
        # the core lies inside every window of the block, so inside the piece as well
        core = mix(one.of(lo, hi) + b.astype(np.uint64))
        k1, k2 = _pair(one, two, starts[o] + rel[first], starts[o] + rel[last] + threshold, b)
        take = lambda name: batch.column(name).to_numpy(zero_copy_only=False)[o]
        yield pa.RecordBatch.from_pydict(
            {"did": take("did"), "rid": take("rid"), "p0": take("p0"), "b": b.astype(np.int32), "undecided": take("undecided").astype(bool), "core": core.view(np.int64), "k1": k1, "k2": k2}
        )

    return frames.per_step(work, "piece")


WINDOWS = "did long, rid long, at long, undecided boolean, k1 long, k2 int"


def _windows(threshold: int):
    def work(batch: pa.RecordBatch):
        data, starts, owner, rel, block, _ = _laid_out(batch, threshold)
        wanted = batch.column("blocks").to_pylist()
        open_ = {(i, w["b"]): w["undecided"] for i, ws in enumerate(wanted) for w in ws}
        code = owner << 16 | block
        keys = np.array([i << 16 | b for i, b in open_], np.int64)
        flags = np.array(list(open_.values()), bool)
        order = np.argsort(keys)
        keys, flags = keys[order], flags[order]
        spot = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        hit = keys[spot] == code
        o, r = owner[hit], rel[hit]
        at = starts[o] + r
        k1, k2 = _pair(Rolling(data, 1), Rolling(data, 2), at, at + threshold, np.zeros(len(at)))
        take = lambda name: batch.column(name).to_numpy(zero_copy_only=False)[o]
        yield pa.RecordBatch.from_pydict({"did": take("did"), "rid": take("rid"), "at": take("p0") + r, "undecided": flags[spot[hit]], "k1": k1, "k2": k2})

    return frames.per_step(work, "piece")


def _finish(threshold: int):
    def work(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                known = row["spans"] or []
                spans = list(zip(known[::2], known[1::2])) + [(f["lo"], f["hi"]) for f in row["more"] or []]
                rows.append({k: row[k] for k in ("did", "rid", "doc_id")} | _verdict(row["text"].encode("utf-8", "surrogatepass"), spans))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_DONE)

    return work


DONE = "did long, rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_DONE = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in DONE.split(", ")])


def repeated_bytes(docs: DataFrame, threshold: int = 400) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats.

    A byte goes if some ``threshold``-byte string that covers it also starts anywhere else, in this
    text or another.  Null and empty texts, and texts shorter than the threshold, lose nothing.
    Rows that repeat (same id and text) are copies of each other and lose all windows; what is found
    for them is kept once for all copies.  ``has_repeats`` says whether anything was removed.  Other
    columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    keyed = frames.row_keys(docs)
    key = ["k1", "k2"]
    several = lambda rows, of: frames.materialise(rows.groupBy(of).agg(F.count("*").alias("n")).where("n > 1").select(of), f"{of}-several")

    # first digit
    runs = frames.materialise(keyed.select("did", "rid", "text").mapInArrow(_runs(threshold), RUNS), "runs")
    met = runs.join(several(runs, "akey"), "akey", "left_semi")
    # grouped by the whole text alone: a common anchor must not bring all its runs to one task
    groups = met.groupBy(*key).agg(F.min("akey").alias("akey"), F.count("*").alias("n"), F.min(F.struct("did", "rid", "p0", "geom")).alias("one"))
    groups = frames.materialise(groups, "groups")
    members = met.join(groups.where("n > 1").select(*key), key, "left_semi").select("did", "rid", "p0", "geom", F.lit(1).alias("what"))
    onward = groups.join(several(groups, "akey"), "akey", "left_semi").select("one.*", F.when(F.col("n") > 1, 2).otherwise(3).alias("what"))
    per_doc = members.unionByName(onward).groupBy("did", "rid").agg(F.collect_set(F.struct("p0", "geom", "what")).alias("found"))
    per_doc = frames.materialise(per_doc, "found-runs")

    found = frames.materialise(keyed.join(per_doc, ["did", "rid"], "left").mapInArrow(_locate(threshold), FOUND), "found")
    # repeated rows send a witness several times; that is harmless, since only undecided pieces get verdicts
    pieces = found.where("kind = 2").select("did", "rid", "p0", "geom", "undecided", "piece")

    # second digit
    blocks = frames.materialise(pieces.mapInArrow(_blocks(threshold), BLOCKS), "blocks")
    met = blocks.join(several(blocks, "core"), "core", "left_semi")
    groups = frames.materialise(met.groupBy(*key).agg(F.min("core").alias("core"), F.count("*").alias("n"), F.min(F.struct("did", "rid", "p0", "b", "undecided")).alias("one")), "block-groups")
    whole = met.where("undecided").join(groups.where("n > 1").select(*key), key, "left_semi")
    pieces_at = pieces.select("did", "rid", "p0", "geom")
    # the windows of a block that the piece has: those at distance b * BLOCK .. b * BLOCK + BLOCK - 1 before the anchor
    off, span = F.col("geom").bitwiseAND(65535), F.shiftright("geom", 16)
    decided = whole.join(pieces_at, ["did", "rid", "p0"]).select(
        "did", "rid",
        (F.col("p0") + F.greatest(F.lit(0), off - F.col("b") * BLOCK - (BLOCK - 1))).alias("lo"),
        (F.col("p0") + F.least(span, off - F.col("b") * BLOCK) + threshold).alias("hi"),
    )
    onward = groups.join(several(groups, "core"), "core", "left_semi").select("one.did", "one.rid", "one.p0", "one.b", (F.col("one.undecided") & (F.col("n") == 1)).alias("undecided"))
    wanted = onward.groupBy("did", "rid", "p0").agg(F.collect_set(F.struct("b", "undecided")).alias("blocks"))

    # last digit
    windows = frames.materialise(pieces.drop("undecided").join(wanted, ["did", "rid", "p0"]).mapInArrow(_windows(threshold), WINDOWS), "windows")
    twice = windows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    single = windows.where("undecided").join(twice, key, "left_semi").select("did", "rid", F.col("at").alias("lo"), (F.col("at") + threshold).alias("hi"))

    more = decided.unionByName(single).groupBy("did", "rid").agg(F.collect_set(F.struct("lo", "hi")).alias("more"))
    rest = found.where("kind = 1").select("did", "rid", "doc_id", "text", "spans").join(more, ["did", "rid"], "left").mapInArrow(_finish(threshold), DONE)
    names = [x.split()[0] for x in DONE.split(", ")][2:]
    return found.where("kind = 0").select(*names).unionByName(rest.select(*names)).withColumn("has_repeats", F.col("n_removed") > 0)
