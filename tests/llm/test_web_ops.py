"""HTML extraction and WARC archives."""

import base64
import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lapwing.llm import html_extract, warc
from lapwing.llm.html_extract import main_text

PROSE = "The house of the man was in the middle of the town and it had a door that he had made with his own hands, as all of the people there knew."


def test_article_pages():
    page = f"""<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
    <!-- ad --><div class="ad">Buy now</div><article><h1>A  title &amp; more</h1><p><b>First &eacute;&#33;<br>line.<p>Ti.</p><div class="comments"><p>{PROSE}</p></div></article><aside>{PROSE}</aside><form><p>{PROSE}</p></form><footer>&copy; us</footer>"""
    assert main_text(page) == "A title & more\nFirst é! line.\nTi."
    assert main_text("<article><p>&am &amp x</p></article>") == "&am & x"


def test_pages_without_markup():
    page = f"<body><div id='sidebar'>{PROSE}</div><p>Home</p><p><a href='x'>One link</a> <a href='y'>and another link that is quite long, so that its length is no hint</a></p><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><p>Tail</p><ul><li><a>x</a></ul>"
    assert main_text(page) == f"{PROSE}\nShort.\n{PROSE}\nTail"
    assert main_text("plain") == "" and main_text("") == "" and main_text(None) == "" and main_text("< 3 <") == ""


def test_known_markup_of_the_pages(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body))
        want[r.page_id] = "\n".join(b for b in blocks if b)
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_the_article_tag_is_one_feature(sf_dir):
    """Without the tag the two passes alone find the same texts."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    without = [re.sub(r"</?article[^>]*>", "", p) for p in pages]
    assert [main_text(p) for p in without] == [main_text(p) for p in pages] and len(pages) > 200


def test_inside_an_article_only_what_surrounds_it_goes():
    link = "<p><a href='x'>A long sentence that is one link, but stands in the middle of the article as a part of it.</a></p>"
    page = f"<article><p>{PROSE}</p>{link}<p class='share price'>The share price of the company fell by a third.</p><ul><li><a href='1'>One</a> <a href='2'>Two</a></li></ul><div class='comments'><p>{PROSE}</p></div><p>{PROSE}</p></article><p>{PROSE}</p>"
    text = main_text(page).split("\n")
    assert text == [PROSE, re.sub("<[^>]*>", "", link), "The share price of the company fell by a third.", PROSE]


def brute_labels(blocks, marked):
    """The second pass by looking at all other blocks."""
    first = [html_extract.first_label(b, marked) for b in blocks]
    out = []
    for i, label in enumerate(first):
        others = [(abs(i - j), -x) for j, x in enumerate(first) if x and (blocks[j].inside or not marked)]
        if label or blocks[i].inside and blocks[i].running and not blocks[i].links:
            out.append(label >= 0)
        elif others:
            out.append(min(others)[1] < 0)
        else:
            out.append(blocks[i].inside or blocks[i].running and not blocks[i].links)
    return out


def test_second_pass_equals_brute_force():
    rng = random.Random(9)
    texts = ["Short.", "x" * 90, PROSE, PROSE * 3, "word " * 60, "The link"]
    for _ in range(400):
        marked = rng.random() < 0.4
        blocks = [html_extract.Block(rng.choice(texts), rng.choice([0, 0, 0.2, 0.5, 1.0]), marked and rng.random() < 0.7, rng.random() < 0.5) for _ in range(rng.randrange(0, 12))]
        assert html_extract.labels_of(blocks, marked) == brute_labels(blocks, marked)


def test_extract_edges(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, "<p>" + (PROSE + " ") * 3000 + "</p>"), (None, "v", "<article>é</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(0))
    out = sorted((r.page_id or 0, r.n_chars) for r in html_extract.extract(pages).collect())
    assert out == [(0, 1), (1, 0), (1, 0), (2, len((PROSE + " ") * 3000) - 1)]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_archives(spark):
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, "http://c", "x\r\n\r\nWARC/1.1\r\n"), (4, None, None), (8, "d", ""), (7, "e e", "é" * 10), (7, "e e", "é" * 10), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("record_id", F.lit("x"))
    out = warc.archive_pages(pages).collect()
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)
    b32 = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    same, wild, none, acc = "same", "x\r\n\r\nWARC/1.1\r\n", "", "é" * 10
    want = [
        (5, 4, b32(same), "revisit", 3), (3, 4, b32(same), "response", None), (9, len(wild), b32(wild), "response", None), (4, 0, b32(none), "response", None), (8, 0, b32(none), "revisit", 4),
        (7, 20, b32(acc), "response", None), (7, 20, b32(acc), "revisit", 7), (0, 4, b32(same), "revisit", 3),
    ]
    assert got == sorted(want, key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_min_bytes_and_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "ab"), (2, "b", "ab"), (3, "c", "abcdef"), (4, "d", "abcdef")], "page_id long, url string, html string")
    records = warc.responses(pages).persist()
    warc.write_archives(records, str(tmp_path / "raw"))
    again = warc.read_archives(spark, str(tmp_path / "raw"))
    assert sorted(map(str, again.select("record_id", "url", "payload").collect())) == sorted(map(str, records.select("record_id", "url", "payload").collect()))
    kinds = {r.record_id: r.record_type for r in warc.resolve_revisits(again, min_bytes=3).collect()}
    assert sorted((r.page_id, kinds[r.record_id]) for r in again.collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_long_payloads(spark, tmp_path):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefghij \r\né", k=200_000)) * 250  # over 50 MB
    pages = spark.createDataFrame([(1, "a", long), (2, "b", long), (3, "c", "short")], "page_id long, url string, html string")
    out = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect())
    n = len(long.encode())
    assert n > 50_000_000 and out == [(1, n, "response", None), (2, n, "revisit", 1), (3, 5, "response", None)]


def test_a_changed_payload_is_noticed(spark, tmp_path):
    rows = [dict.fromkeys(["refers_to_id", "refers_to_url", "refers_to"]) | {"record_id": "x", "record_type": "response", "page_id": 1, "url": "a", "payload_digest": warc.digest(b"other"), "payload_bytes": 4, "payload": "text"}]
    warc.write_archives(spark.createDataFrame(rows, warc.HEAD + ", payload string"), str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a"), verify=False).first().payload == "text"
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(spark, str(tmp_path / "a")).collect()


def test_broken_pages_take_linear_time():
    import time

    for page in ("<a " * 300_000, "<div></p>" * 100_000, "<a \"" * 100_000, "<a '\"" * 100_000 + ">", "<svg/>" * 100_000, "<!x" * 200_000, "<a " * 200_000 + "\"", "<p class='" + "_nav" * 50_000 + "!'>x", "<div>" * 50_000 + "x" + "</p></div>" * 50_000, "</b" * 200_000):
        began = time.time()
        html_extract.main_text(page)
        assert time.time() - began < 8, page[:20]


def test_tags_as_a_slow_reader_finds_them():
    """Against a pattern that tries every < by itself."""
    slow = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
    rng = random.Random(12)
    for _ in range(3000):
        page = "".join(rng.choices(["<", "<a", "</p", ">", '"', "'", " ", "x=", "<!--", "-->", "<!d", "é", "/"], k=rng.randrange(1, 40)))
        tags, at, got, want = html_extract.Tags(page), 0, [], []
        while tag := tags.next(at):
            got.append(tag)
            at = tag[1]
        for m in slow.finditer(page):
            if not (m[0].startswith("<!--") and m[2] is None and not m[0].endswith("-->") and m.end() < len(page)):
                want.append((m.start(), m.end(), bool(m[1]), (m[2] or "").lower(), m[3] or ""))
        assert got == want, page


def test_linked_headings_of_an_article_stay():
    page = f"<article><h2><a href='x'>Linked heading</a></h2><p>{PROSE}</p><h3><a>Another</a></h3><p>{PROSE}</p></article><h2><a>Outside</a></h2>"
    assert main_text(page) == f"Linked heading\n{PROSE}\nAnother\n{PROSE}"


def test_urls_come_back_as_they_were(spark):
    urls = ["http://a/x  y", " http://b ", "http://c\td", "e\r\nWARC-Type: revisit", "", None, "http://f/%20%41", "http://g/é\u2028\u00a0x", " ", "\x00\x7f", ": x", "h:  "]
    pages = spark.createDataFrame([(k, u, "same") for k, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r.page_id: r.url for r in warc.archive_pages(pages).collect()} == dict(enumerate(urls))


def test_dates_are_given_or_now(spark, tmp_path):
    import gzip

    records = warc.responses(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")).persist()
    said = {}
    for name, date in (("given", "2020-02-02T02:02:02Z"), ("now", None)):
        warc.write_archives(records, str(tmp_path / name), date)
        text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / name).glob("part-*")).decode()
        said[name] = re.search(r"WARC-Date: (\S+)", text)[1]
    assert said["given"] == "2020-02-02T02:02:02Z" and said["now"] > "2024" and said["now"] != said["given"]
