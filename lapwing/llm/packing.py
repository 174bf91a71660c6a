"""Best-fit packing into bins of several permitted lengths.

A text of n tokens takes n places; texts over the largest capacity are cut into pieces of it and a
rest.  Pieces come in falling order.  A piece goes into the open bin, of whatever capacity, that it
leaves the least room in; if none takes it, a bin is opened whose expected cost for each used place
is least: cost(c) / (piece + rate * (c - piece)), with the share ``rate`` of free room that bins of
the shard have come to fill so far.  At the end every bin shrinks to the least permitted capacity
that holds its contents.

Pieces are dealt by a hash of doc_id, text and the number of the copy to shards of about SHARD_PIECES,
each packed by itself, so bins do not depend on how files are split; only a shard's last bins stay loose,
so the loss does not grow with the corpus.  Texts do not move: a row carries numbers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin besides its places.
OVERHEAD = 16
SHARD_PIECES = 20_000


def pack(sizes: list[int], capacities: tuple[int, ...], overhead: float = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset of each piece, capacity of each bin)."""
    rooms: list[list[int]] = [[] for _ in range(max(capacities) + 1)]
    open_ = 0  # bit r is set while a bin with room r is open
    used: list[int] = []
    filled, offered = 1.0, 1.0
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for piece in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[piece]
        fits = open_ >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            which = rooms[room].pop()
            if not rooms[room]:
                open_ &= ~(1 << room)
            filled += size
        else:
            rate = filled / offered
            capacity = min((c for c in capacities if c >= size), key=lambda c: ((c + overhead) / (size + rate * (c - size)), c))
            which, room = len(used), capacity
            used.append(0)
            offered += capacity - size
        bins[piece], offsets[piece] = which, used[which]
        used[which] += size
        left = room - size
        if left:
            rooms[left].append(which)
            open_ |= 1 << left
    return bins, offsets, [min(c for c in capacities if c >= u) for u in used]


PACKED = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_offset long, bin_capacity long"


def _shard(capacities: tuple[int, ...], overhead: float):
    def work(key, rows):
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, sizes = pack(rows.column("n_tokens").to_pylist(), capacities, overhead)
        base = key[0].as_py() << 32
        return pa.Table.from_pydict(
            {c: rows.column(c) for c in ("doc_id", "piece", "start", "n_tokens")}
            | {"bin_id": [base + b for b in bins], "bin_offset": offsets, "bin_capacity": [sizes[b] for b in bins]},
            schema=pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in PACKED.split(", ")]),
        )

    return work


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD) -> DataFrame:
    """One row per piece of each row of ``docs``: doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_capacity.

    Tokens are the words of the text and one end.  Null and empty texts have the end only, and are
    packed; repeated rows are packed as often as they occur; other columns are ignored; an empty table
    gives an empty result.
    """
    largest = max(capacities)
    count = docs.count()
    shards = max(1, -(-count // SHARD_PIECES))
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), F.xxhash64("doc_id", "text").alias("which"))
    # repeated rows are counted, and each copy is dealt by itself
    rows = rows.groupBy("doc_id", "n", "which").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    rows = rows.select("doc_id", "n", F.pmod(F.xxhash64("which", "copy"), F.lit(shards)).alias("turn"))
    pieces = rows.select("doc_id", "n", "turn", F.explode(F.expr(f"sequence(0L, (n - 1) div {largest})")).alias("k"))
    pieces = pieces.select(
        "doc_id", F.col("k").cast("int").alias("piece"), (F.col("k") * largest).alias("start"), F.least(F.lit(largest), F.col("n") - F.col("k") * largest).cast("long").alias("n_tokens"),
        F.pmod(F.col("turn") + F.col("k"), F.lit(shards)).cast("int").alias("shard"),
    )
    return pieces.repartition(shards, "shard").groupBy("shard").applyInArrow(_shard(tuple(capacities), overhead), PACKED)
