"""SentencePiece encoding of merge-type (BPE) models by a table over prefixes, and decoding.

The merges of a text end in one sequence of pieces, and so do those of each of its prefixes.  What the
table keeps of a prefix is the last piece of its sequence: a piece that ends there and is compatible with
the last piece of the prefix before it.  An automaton over the vocabulary finds the pieces that end at
each place; two pieces are compatible if the merges of their joined characters give back just the two.
One piece passes at each place, so time is linear in the text, and the ids are recovered from the table
backwards.  A character that no piece holds stands alone and becomes its UTF-8 bytes.

No piece of the usual models has a word mark behind another character (checked when a model is loaded), so
no merge passes the start of a word; the table is then made once for each different word, and kept by the
Python worker up to a bound.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import per_step

MARK = "▁"
#: Different words, and pairs of pieces, that a worker keeps; beyond it starts anew.
KEPT = 400_000

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class _Words(dict):
    """Word -> (its ids, the same as text), made when first asked for; kept up to a bound."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.make(word))
        known = ids, ",".join(map(str, ids))
        if len(word) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[word] = known
        return known


class PieceTable:
    """Encoder of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.vocab_size())
        ids = {sp.id_to_piece(i): i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in ids.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        #: words may be taken apart: no piece has a mark behind another character
        self.parts = not any(MARK in p.lstrip(MARK) for p in ids)
        #: what can end a prefix: pieces that their own merges reach, and characters that occur in pieces only
        self.text = [p for p in ids if self.merged(p) == [p]] + sorted({c for p in ids for c in p} - set(ids))
        self.spines = [self._spine(p, -1) for p in self.text], [self._spine(p, 0) for p in self.text]
        self.sizes = [len(p) for p in self.text]
        self.out = [[ids[p]] if p in ids else self._alone(p) for p in self.text]
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(self.text):
            self.automaton.add_word(p, k)
        self.automaton.make_automaton()
        self.fits = _Fits(self)
        self.words = _Words(self._encoded)

    def _alone(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """The merges themselves, for a few characters: the best score first, of equals the leftmost."""
        parts = list(text)
        while True:
            best = max(((self.score[j], -k) for k in range(len(parts) - 1) if (j := parts[k] + parts[k + 1]) in self.score), default=None)
            if best is None or len(parts) <= down_to:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _spine(self, piece: str, side: int) -> list[tuple[str, float, float]] | None:
        """What stands at the end (side -1) or the start (0) of a piece while it grows, last first: (characters, score
        at which they came to be, score at which they were merged further); None where scores do not fall on the way."""
        out, now, until = [], piece, -math.inf
        while len(now) > 1:
            halves = self.merged(now, down_to=2)
            if any(len(h) > 1 and not self.score[h] > self.score[now] for h in halves):
                return None
            out.append((now, self.score[now], until))
            now, until = halves[side], self.score[now]
        return [*out, (now, math.inf, until)]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of the characters of two pieces (numbers) end in just these pieces.

        Merges fall in score.  So a merge across the border takes place if what stands on both sides of it at one
        time is a piece together, of a score above that of the next merge on the left, and not below that on the right.
        """
        ends, starts = self.spines[0][left], self.spines[1][right]
        if ends is None or starts is None:
            a, b = self.text[left], self.text[right]
            return self.merged(a + b) == [a, b]
        score = self.score
        for x, came_x, gone_x in ends:
            for y, came_y, gone_y in starts:
                if gone_x < came_y and gone_y <= came_x and (s := score.get(x + y)) is not None and s > gone_x and s >= gone_y:
                    return False
        return True

    def _encoded(self, word: str) -> list[int]:
        """Ids of a word, through the table of its prefixes: entry e is the piece (its number) that ends the first e
        characters, -1 a character that no piece holds."""
        last, sizes, fits = [-1] * (len(word) + 1), self.sizes, self.fits
        for end, k in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                start = end - sizes[k]
                if not start or (left := last[start]) < 0 or fits[left << 20 | k]:
                    last[end] = k
        found, at = [], len(word)
        while at:
            k = last[at]
            found.append(k if k >= 0 else word[at - 1])
            at -= sizes[k] if k >= 0 else 1
        return [i for k in reversed(found) for i in (self.out[k] if type(k) is int else self._alone(k))]

    def encode(self, text: str) -> tuple[list[int], str]:
        """(ids of a text, the same as text)."""
        plain = self.model.normalize(text)
        words = [self.words[w] for w in (_WORD.findall(plain) if self.parts else [plain] if plain else [])]
        return [i for ids, _ in words for i in ids], ",".join([said for _, said in words])


class _Fits(dict):
    """left << 20 | right -> whether the two pieces are compatible, tested when first asked for; kept up to a bound."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table = table

    def __missing__(self, pair: int) -> bool:
        if len(self) >= KEPT:
            self.clear()
        known = self[pair] = self.table.compatible(pair >> 20, pair & (1 << 20) - 1)
        return known


#: a word: marks, then what follows up to the next mark
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def default_model() -> str:
    """The public model's file, which every machine has with the library."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a binary column; null is empty, broken UTF-8 is read with replacement characters."""
    return [(b or b"").decode("utf-8", "replace") for b in column.to_pylist()]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256.

    ``model``: a path of the model file on every machine.  Null and empty texts have no ids, and the digests of
    nothing; repeated rows are encoded as often as they occur; texts are taken whole; other columns are
    ignored; an empty table gives an empty result.
    """
    path = model or default_model()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        texts = texts_of(batch.column("text"))
        found = [table.encode(t) for t in texts]
        back = table.model.decode([ids for ids, _ in found], num_threads=1) if found else []
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(ids) for ids, _ in found], pa.int64()), "ids_sha256": [digest(said) for _, said in found], "decoded_sha256": [digest(t) for t in back]}
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(per_step(work), ENCODED)


def tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, pieces) of each row of ``docs``: the encoding itself, with the same rules as ``encode``."""
    path = model or default_model()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        ids = [table.encode(t)[0] for t in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32())), "pieces": pa.array([[table.model.id_to_piece(i) for i in x] for x in ids], pa.list_(pa.string()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(per_step(work), "doc_id long, ids array<int>, pieces array<string>")


def decode(ids: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text, ids out of range an error of the library."""
    path = model or default_model()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([piece_table(path).model.decode(x) if x else "" for x in lists], pa.string())})

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(work, "doc_id long, text string")
