"""A bigram language model with deleted interpolation, counted and applied over the whole corpus.

The probability of a token w after h is

    l2[b] * c(h, w) / c(h)  +  l1[b] * c(w) / N  +  l0[b] / (V + 1)

with maximum-likelihood estimates from training rows and weights that depend on the bucket b of the
context's frequency (its binary logarithm).  The weights come from expectation-maximisation on
held-out counts: each row of the estimation fold is held out in turn, its own counts being deleted
from the totals before its tokens are looked up.

How it runs.  Texts are packed, compressed, in chunks of about CHUNK_BYTES, which are written once and
dealt to *shards* of about SHARD_BYTES.  A shard sends each of its distinct unigrams and bigrams once,
packed and sorted, with its training count, to the *bucket* that owns the key's hash range; the bucket
adds the counts of all shards up and answers each message with the totals in the order asked, so keys
do not travel back.  A frequent word is one entry per shard, whatever its count; shards and buckets
grow in number, not in size, with the corpus.  A message has at least one key, so there are never more
messages than there are distinct keys in shards, and what is sent grows in proportion to the text.
Inside a bucket 48 bits tell bigrams apart: of 10**6 distinct ones, two agree with probability 0.002.
The driver sees N, V and a histogram of bounded size for the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from .kernels import Words, mix

SHARD_BYTES = 12_000_000
BUCKET_BYTES = 8_000_000
CHUNK_BYTES = 256_000
#: Bytes of a bigram's hash in a message.
PAIR_BYTES = 6
END = np.uint64(0x6A09E667F3BCC909)
START = np.uint64(0xBB67AE8584CAA73B)
LEVELS = 24
#: Bins of a log10 probability in the histogram: twelfths of a decade down to 1e-10, and zero.
BINS = 122


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, context hash, row) of each token of the texts, an end token after each text."""
    toks, ctxs, rows = [], [], []
    for i, j in frames.steps([len(t or "") + 16 for t in texts]):
        w = Words(texts[i:j])
        n = np.diff(w.first)
        at = np.arange(w.n) + w.doc
        tok = np.full(w.n + (j - i), END, np.uint64)
        tok[at] = w.hash
        row = np.repeat(np.arange(i, j), n + 1)
        ctx = np.concatenate([[START], tok[:-1]])
        ctx[np.concatenate([[0], np.cumsum(n + 1)[:-1]])] = START
        toks.append(tok)
        ctxs.append(ctx)
        rows.append(row)
    if not toks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(toks), np.concatenate(ctxs), np.concatenate(rows)


def _pairs(tok: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return mix(mix(ctx) + tok * np.uint64(0x9E3779B97F4A7C15))


def _owners(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each of some sorted keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """One byte a count, and the large ones in full beside it."""
    big = counts >= 255
    return np.where(big, 255, counts).astype(np.uint8).tobytes(), counts[big].astype(np.int64).tobytes()


def _unpack(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, np.int64)
    return out


def _low(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :PAIR_BYTES]).tobytes()


def _from_low(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // PAIR_BYTES, 8), np.uint8)
    out[:, :PAIR_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, PAIR_BYTES)
    return out.view(np.uint64).ravel()


CHUNK = "shard int, ids binary, flags binary, sizes binary, texts binary"
#: Flags of a row in a chunk.
HELD, NAMELESS = 1, 2


def _chunks(shards: int, fitted: int):
    """Rows (doc_id, text, held_out, fits, turn) packed into chunks, the fitting ones apart."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        kept: dict[bool, list] = {False: [], True: []}
        have = {False: 0, True: 0}

        def close(fits: bool):
            ids, held, texts, turns = zip(*kept[fits])
            flags = np.array([HELD * h | NAMELESS * (d is None) for d, h in zip(ids, held)], np.uint8)
            turn = turns[0]
            shard = shards + turn % fitted if fits else turn % shards
            columns = [[shard], [np.array([d or 0 for d in ids], np.int64).tobytes()], [flags.tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], [press.compress(b"".join(texts))]]
            kept[fits].clear()
            have[fits] = 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def add(batch: pa.RecordBatch):
            for d, text, held, fits, turn in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held_out", "fits", "turn"))):
                raw = text.encode("utf-8", "surrogatepass")
                kept[fits].append((d, held, raw, turn))
                have[fits] += len(raw) + 16
                if have[fits] >= CHUNK_BYTES:
                    yield from close(fits)

        schema = _schema(CHUNK)
        yield from frames.per_step(add)(batches)
        for fits in (False, True):
            if kept[fits]:
                yield from close(fits)

    return run


class _Rows:
    """The rows of a shard's chunks."""

    def __init__(self, chunks: pa.Table):
        whole = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_py(), kind) for x in chunks.column(name))])
        flags = whole("flags", np.uint8)
        self.held, self.ids = flags & HELD > 0, pa.array(whole("ids", np.int64), mask=flags & NAMELESS > 0)
        self.texts: list[bytes] = []
        open_ = zstandard.ZstdDecompressor()
        for sizes, packed in zip(chunks.column("sizes"), chunks.column("texts")):
            raw, at = open_.decompress(packed.as_py()), 0
            for n in np.frombuffer(sizes.as_py(), np.int64).tolist():
                self.texts.append(raw[at : at + n])
                at += n

    def __len__(self) -> int:
        return len(self.texts)


MESSAGE = "shard int, bucket int, words binary, wn binary, wbig binary, pairs binary, pn binary, pbig binary"
REPLY = "shard int, bucket int, wn binary, wbig binary, pn binary, pbig binary, tokens long, types long"


def _schema(text: str) -> pa.Schema:
    kind = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kind[x.split()[1]]) for x in text.split(", ")])


def _ask(buckets: int):
    """A shard's messages: its distinct keys with the counts in its training rows."""

    def work(key, chunks):
        rows = _Rows(chunks)
        tok, ctx, row = _tokens(rows.texts)
        train = ~rows.held[row]
        hashed = _pairs(tok, ctx)
        del ctx, row, rows
        shard = key[0].as_py()
        words, at = np.unique(tok, return_inverse=True)
        wn = np.bincount(at[train], minlength=len(words))
        del at, tok
        pairs, at = np.unique(hashed, return_inverse=True)
        pn = np.bincount(at[train], minlength=len(pairs))
        del at, hashed
        ow, op = _owners(words, buckets), _owners(pairs, buckets)
        some = np.union1d(ow, op)
        wc, pc = (np.searchsorted(o, np.append(some, buckets)) for o in (ow, op))
        out = []
        for k, b in enumerate(some.tolist()):
            w, p = slice(wc[k], wc[k + 1]), slice(pc[k], pc[k + 1])
            out.append((shard, b, words[w].tobytes(), *_pack(wn[w]), _low(pairs[p]), *_pack(pn[p])))
        schema = _schema(MESSAGE)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return work


def _answer(key, messages):
    """Totals over all shards, for each message in its own order."""
    m = messages.to_pylist()
    out = {"shard": [x["shard"] for x in m], "bucket": [x["bucket"] for x in m], "tokens": [None] * len(m), "types": [None] * len(m)}
    for name, keys, raw in (("w", "words", lambda x: np.frombuffer(x, np.uint64)), ("p", "pairs", _from_low)):
        each = [raw(x[keys]) for x in m]
        counts = np.concatenate([_unpack(x[f"{name}n"], x[f"{name}big"]) for x in m])
        known, at = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(at, counts, len(known)).astype(np.int64)
        if name == "w":
            out["tokens"][0], out["types"][0] = int(total.sum()), int((total > 0).sum())
        replies = [_pack(x) for x in np.split(total[at], np.cumsum([len(x) for x in each])[:-1])]
        out[f"{name}n"], out[f"{name}big"] = [x[0] for x in replies], [x[1] for x in replies]
    return pa.Table.from_pydict(out, schema=_schema(REPLY))


class _Looked:
    """A shard's tokens with their totals from the replies."""

    def __init__(self, texts: list, replies: pa.Table):
        tok, ctx, row = _tokens(texts)
        self.row = row.astype(np.int32)
        r = sorted(replies.to_pylist(), key=lambda x: x["bucket"])
        totals = lambda name: np.concatenate([_unpack(x[f"{name}n"], x[f"{name}big"]) for x in r])
        hashed = _pairs(tok, ctx)
        words, at = np.unique(tok, return_inverse=True)
        self.w = at.astype(np.int32)
        del tok, at, row
        ctx[ctx == START] = END  # texts start as often as they end
        self.h = np.searchsorted(words, ctx).astype(np.int32)
        del ctx
        wn = totals("w")
        self.word, self.context = wn[self.w], wn[self.h]
        pairs, at = np.unique(hashed, return_inverse=True)
        del hashed, pairs
        self.p = at.astype(np.int32)
        self.pair = totals("p")[at]


def _level(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 0) + 1).astype(np.int64), LEVELS - 1)


HISTOGRAM = "level int, i int, j int, n long, p2 double, p1 double"


def _histogram(total: int):
    """Held-out estimates of the rows of a shard, each row's own counts deleted."""

    def work(key, chunks, replies):
        schema = _schema(HISTOGRAM)
        rows = _Rows(chunks)
        if not len(rows):
            return schema.empty_table()
        x = _Looked(rows.texts, replies)

        def own(ids: np.ndarray) -> np.ndarray:
            """How often a token's key occurs in its own row."""
            _, at, n = np.unique(x.row.astype(np.int64) * (int(ids.max()) + 1) + ids, return_inverse=True, return_counts=True)
            return n[at]

        length = np.bincount(x.row, minlength=len(rows))[x.row]
        pair, word = x.pair - own(x.p), x.word - own(x.w)
        # as a context a key occurs in the row wherever a pair begins with it
        span = max(int(x.h.max()), 0) + 1
        _, at, n = np.unique(x.row.astype(np.int64) * span + x.h, return_inverse=True, return_counts=True)
        context = x.context - n[at]
        p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
        p1 = word / np.maximum(total - length, 1)

        def bin_(p: np.ndarray) -> np.ndarray:
            return np.where(p > 0, np.clip((-np.log10(np.maximum(p, 1e-300)) * 12).astype(np.int64), 0, BINS - 2), BINS - 1)

        code = (_level(context) * BINS + bin_(p2)) * BINS + bin_(p1)
        known, at, n = np.unique(code, return_inverse=True, return_counts=True)
        return pa.Table.from_pydict(
            {"level": known // BINS**2, "i": known // BINS % BINS, "j": known % BINS, "n": n, "p2": np.bincount(at, p2), "p1": np.bincount(at, p1)}, schema=schema
        )

    return work


def learn_weights(cells: list, types: int, rounds: int = 60) -> np.ndarray:
    """(LEVELS, 3) mixture weights for pair, word and uniform estimates, by EM; cells: (level, n, p2, p1)
    with mean estimates.  A level without held-out tokens takes the weights of all levels together;
    an unseen context (level 0) has no pair estimate."""
    cells = np.array(cells, float).reshape(-1, 4)
    p = np.stack([cells[:, 2], cells[:, 3], np.full(len(cells), 1 / (types + 1))], 1)

    def em(which: np.ndarray, pair: bool) -> np.ndarray:
        lam = np.array([0.4, 0.4, 0.2]) if pair else np.array([0.0, 0.8, 0.2])
        n = cells[which, 1:2]
        for _ in range(rounds if n.sum() else 0):
            share = lam * p[which]
            lam = (n * share / share.sum(1, keepdims=True)).sum(0) / n.sum()
        lam = np.maximum(lam, [0, 1e-6, 1e-6])
        return lam / lam.sum()

    seen = em(cells[:, 0] > 0, True)
    out = np.tile(seen, (LEVELS, 1))
    for level in range(LEVELS):
        which = cells[:, 0] == level
        if level == 0 or which.any():
            out[level] = em(which, level > 0)
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(weights: np.ndarray, total: int, types: int):
    def work(key, chunks, replies):
        schema = _schema(SCORES)
        rows = _Rows(chunks)
        n = len(rows)
        if not n:
            return schema.empty_table()
        x = _Looked(rows.texts, replies)
        level = _level(x.context)
        p = weights[level, 0] * x.pair
        p /= np.maximum(x.context, 1)
        p += weights[level, 1] * x.word / max(total, 1)
        p += weights[level, 2] / (types + 1)
        add = lambda v: np.bincount(x.row, v, n)
        return pa.Table.from_pydict(
            {
                "doc_id": rows.ids, "held_out": rows.held, "n_tokens": np.bincount(x.row, minlength=n), "n_known": add(x.word > 0).astype(np.int64),
                "train_tokens": np.full(n, total), "base_score": add(np.log10((x.word + 1) / (total + types + 1))), "score": add(np.log10(p)),
            },
            schema=schema,
        )

    return work


def score(docs: DataFrame, modulus: int = 7, held: int = 2, estimation: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with crc32(doc_id) mod ``modulus`` = ``held`` are not learnt from; one in ``estimation`` of the
    others also serves, with its own counts deleted, to learn the weights.  Null and empty texts have
    the end token only.  Repeated rows count, and are scored, as often as they occur; other columns are
    ignored; an empty table gives an empty result, and without training rows N = V = 0.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, buckets = -(-size // SHARD_BYTES) or 1, -(-size // BUCKET_BYTES) or 1
    fitted = -(-shards // estimation)
    picked = F.xxhash64("doc_id", "text", F.lit(7))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (fold % modulus == held).alias("held_out"),
        ((fold % modulus != held) & (F.floor(fold / modulus) % estimation == 0)).alias("fits"), F.pmod(picked, F.lit(1 << 40)).alias("turn"),
    )
    rows = frames.materialise(rows.mapInArrow(_chunks(shards, fitted), CHUNK), "lm-chunks")

    asked = rows.groupBy("shard").applyInArrow(_ask(buckets), MESSAGE)
    replies = frames.materialise(asked.groupBy("bucket").applyInArrow(_answer, REPLY), "lm-replies")
    total, types = (x or 0 for x in replies.agg(F.sum("tokens"), F.sum("types")).first())

    answers = replies.select("shard", "bucket", "wn", "wbig", "pn", "pbig")
    held_out = rows.where(F.col("shard") >= shards).groupBy("shard").cogroup(answers.where(F.col("shard") >= shards).groupBy("shard")).applyInArrow(_histogram(total), HISTOGRAM)
    cells = held_out.groupBy("level", "i", "j").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).collect()
    weights = learn_weights([(c.level, c.n, c.p2 / c.n, c.p1 / c.n) for c in cells], types)
    return rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_score(weights, total, types), SCORES)
