"""Encoding by a prefix table, alignment of two tokenizers: against the libraries and brute force."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lapwing.llm import piece_encoding, token_alignment

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "   ", "a  b", "▁", "x▁y", "<s> </s><|endoftext|>", "tab\tx\n\n y", "ﬁ①　é日本語", " lead", "trail  ", "'s it's", "a" * 3000, "\x00", "😀 😀"]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=piece_encoding.default_model())


@pytest.fixture(scope="module")
def table():
    return piece_encoding.PieceTable(piece_encoding.default_model())


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_ids_equal_the_library_on_made_texts(sp, table):
    rng, pieces = random.Random(5), list(table.score)
    made = ["".join(rng.choices("ab tehinr .,\n'▁", k=rng.randrange(40))) for _ in range(1500)]
    made += ["".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    made += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x800), rng.randrange(0x3000, 0x9FFF), rng.randrange(0x1F300, 0x1F6FF)])) for _ in range(30)) for _ in range(800)]
    made += [" " * rng.randrange(60) + rng.choice(["", "x", "the", ".", "\t"]) + " " * rng.randrange(40) + rng.choice(["", "ab", "é"]) for _ in range(800)]
    for text in made + [t or "" for t in ODD]:
        assert table.encode(text)[0] == sp.encode(text), text


def test_compatible_is_what_merges_say(table):
    rng = random.Random(6)
    for _ in range(4000):
        i, j = rng.randrange(len(table.text)), rng.randrange(len(table.text))
        a, b = table.text[i], table.text[j]
        assert table.compatible(i, j) == (table.merged(a + b) == [a, b])
    runs = [k for k, p in enumerate(table.text) if set(p) == {"▁"}]
    assert all(table.compatible(i, j) == (table.merged(table.text[i] + table.text[j]) == [table.text[i], table.text[j]]) for i in runs for j in runs)


def test_long_words_take_linear_time(table):
    import time

    began = time.time()
    ids, _ = table.encode("ab" * 400_000)
    assert time.time() - began < 30 and len(ids) > 1000


def test_encode_equals_the_library(spark, sp):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (7, "twice"), (7, "twice")], SCHEMA))
    docs = docs.withColumn("n_tokens", F.lit(-1)).withColumn("TEXT_2", F.lit("x"))
    want = Counter()
    for r in docs.collect():
        ids = sp.encode(r.text or "")
        want[r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids))] += 1
    assert Counter(map(tuple, piece_encoding.encode(docs).collect())) == want
    assert piece_encoding.encode(docs.limit(0)).count() == 0


def test_tokens_and_decode_round_trip(spark, sp):
    docs = spark.createDataFrame(list(enumerate(ODD)), SCHEMA)
    rows = piece_encoding.tokens(docs)
    assert {r.doc_id: list(r.ids) for r in rows.collect()} == {k: sp.encode(t or "") for k, t in enumerate(ODD)}
    back = {r.doc_id: r.text for r in piece_encoding.decode(rows).collect()}
    assert back == {k: (t or "").replace("▁", " ") for k, t in enumerate(ODD)}


def plain_alignment(rows):
    """The contract, token by token."""
    a = Tokenizer.from_file(token_alignment.default_vocabulary())
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.default_model())
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    token, out, counts = {i: t for t, i in a.get_vocab().items()}, [], Counter()
    for doc_id, text in rows:
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        xb = [bytes(back[c] for c in token[i]) for i in x]
        yb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or not b"".join(xb) == b"".join(yb) == f" {text}".encode():
            out.append((doc_id, [], [], [], []))
            continue
        ends = [[sum(map(len, side[: k + 1])) for k in range(len(side))] for side in (xb, yb)] if len(text) < 4000 else [list(_sums(side)) for side in (xb, yb)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in both:
            i2, j2 = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append((x[i:i2], y[j:j2]))
            i, j = i2, j2
        links = [(g[0][-1], g[1][-1]) for g in groups]
        counts.update(links)
        out.append((doc_id, x, y, groups, links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    say = lambda g: ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
    return Counter((d, len(x), len(y), len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), digest(say(g)) if x else "") for d, x, y, g, k in out)


def _sums(side):
    n = 0
    for x in side:
        n += len(x)
        yield n


def test_alignment_equals_brute_force(spark):
    extra = [(10**6 + k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (7, "twice over"), (7, "twice over")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 400").unionByName(spark.createDataFrame(extra, SCHEMA)).withColumn("n_a", F.lit("x"))
    want = plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    for size in (token_alignment.CHUNK_BYTES, 20_000):
        assert Counter(map(tuple, token_alignment.align(docs, chunk_bytes=size).collect())) == want
    assert token_alignment.align(docs.limit(0)).count() == 0


def test_cuts_do_not_change_tokens():
    tool, rng = token_alignment.Aligner(token_alignment.default_vocabulary(), piece_encoding.default_model()), random.Random(8)
    words = ["the", "it's", "'s", "12", "x1", "é", "日本", "…", "a,b", "--", "\t", "", "▂", " ", "٣", "n't", "😀"]
    for _ in range(3000):
        text = " ".join(rng.choices(words, k=rng.randrange(1, 12)))
        cuts = tool.cuts(text)
        whole, parts = tool.encode(f" {text}"), [tool.encode(c) for c in cuts]
        assert "".join(cuts) == f" {text}" and all([i for p in parts for i in p[side].tolist()] == whole[side].tolist() for side in (0, 1)), text
        together, alone = tool.align(cuts), [tool.align([c]) for c in cuts]
        assert together.said == [c.said[0] for c in alone] and together.pairs.tolist() == [i for c in alone for i in c.pairs.tolist()]


def test_overlaps(spark):
    rows = token_alignment.overlaps(spark.createDataFrame([(1, "tokenization of überraschung"), (2, None), (3, "x▁y")], SCHEMA)).collect()
    assert {r.doc_id for r in rows} == {1}
    assert all(max(r.a_start, r.b_start) < min(r.a_end, r.b_end) and r.together == (r.a_end == r.b_end) for r in rows)
    ends = {r.group: max(r.a_end, r.b_end) for r in rows}
    assert all(min(r.a_start, r.b_start) >= ends.get(r.group - 1, 0) for r in rows)
