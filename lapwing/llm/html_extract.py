"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Text inside menus, headers, footers, sidebars, forms,
scripts, styles, notices, adverts and comment sections (by element, role, or a word of the class or id)
is no block of the article and has no say about others.

The first pass decides each block by its length, the share of its characters in links and its density of
stop words: blocks made of links are bad; of those long enough to tell, blocks with many stop words are
good, and blocks that mix few stop words with links are bad.  The others (short, or few stop words and
no links) are undecided.  The second pass gives each undecided block the label of its nearest decided
neighbours; between a good and a bad one as near, it is good.

Where the page marks its article, that is one more feature: blocks outside it are bad and do not vote,
and inside it a heading, or a block of link text that reads like a sentence, is left to its neighbours, while a heading
or paragraph without links is not judged by link lists next to it.  A block with no
decided neighbour at all is good inside a marked article, or as a heading or paragraph without links.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

#: fixed values: elements whose content is never text of a page
RAW = frozenset("script style noscript template textarea title svg math iframe object select option button canvas audio video".split())
#: fixed values: elements that hold what surrounds an article
ASIDE = frozenset("head nav header footer aside form menu dialog fieldset".split())
#: fixed values: elements that end a block
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: fixed values: words of a class, id or role that mark what surrounds an article
OUTSIDE = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|masthead|footer|sidebar|aside|complementary|contentinfo|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscri\w*|signup|login|comments?|disqus|respon(?:d|ses)|replies|pagination|pager|hidden)",
    re.I,
)
#: fixed values: words that mark it outside an article only
OUTSIDE_WEAK = re.compile(r"(?:header|search|form|share|sharing|social|related|recommended|toolbar|widget)", re.I)
PARTS = re.compile(r"[\s_-]+")
MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
OPEN = re.compile(r"</?[a-zA-Z]|<!--|<[!?]")
NAME = re.compile(r"[^\s/>]*")
STOPS = re.compile(r"[>\"']")
#: fixed values: frequent function words of the four languages of the corpus
STOP = frozenset(
    "the of and to in a is that it for was on are as with his they at be this from have or by had not but what all were when we there can an your which their said if do will each about "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ses mais comme aux cette ont ou été son "
    "el los del las con una su al lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre también hasta hay donde quien desde todo nos".split()
)
SHORT, LONG = 70, 200
LINKS_MAX, STOP_LOW, STOP_HIGH = 0.33, 0.12, 0.24
#: Share of link text from which few stop words count against a block.
LINKS_SOME = 0.1
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?:;\u2026]['\")\]\u00bb\u201c\u201d\u2019]*$")
#: fixed values: elements that hold running text
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Tags:
    """Tags and comments of a page, in order, in time linear in the page.

    A tag ends at the first ``>`` outside quotes; a ``<`` without such an end is text.  Places from which no end is found are kept, so
    that no later ``<`` looks on from there again.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.no_end: set[int] = set()
        self.looked = self.found = -1  # no stop lies between these places

    def _stop(self, at: int) -> int:
        """Place of the first ``>`` or quote from ``at``; -1 if there is none."""
        if self.looked < 0 or not self.looked <= at <= self.found:
            if at > max(self.last.values()):
                return -1
            self.looked, self.found = at, STOPS.search(self.page, at).start()
        return self.found

    def _end(self, at: int) -> int:
        """Place of the tag's ``>``; -1 if it has none."""
        passed = []
        while (stop := self._stop(at)) >= 0:
            sign = self.page[stop]
            if sign == ">":
                return stop
            if stop in self.no_end:
                break
            passed.append(stop)
            if stop >= self.last[sign]:
                break
            at = self.page.find(sign, stop + 1) + 1
        self.no_end.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name in lower case, what follows the name) of the next one; comments have no name."""
        page = self.page
        while m := OPEN.search(page, at):
            start = m.start()
            if m[0] == "<!--":
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            if m[0][1] in "!?":
                end = page.find(">", start) if start < self.last[">"] else -1
                if end >= 0:
                    return start, end + 1, False, "", ""
            else:
                name = NAME.match(page, m.end() - 1)
                end = self._end(name.end())
                if end >= 0:
                    return start, end + 1, m[0][1] == "/", name[0].lower(), page[name.end() : end]
            at = start + 1
        return None


class Block(NamedTuple):
    text: str
    links: float  # share of its characters in links
    inside: bool  # inside the marked article
    running: bool  # in an element of running text
    heading: bool = False


def blocks_of(page: str) -> tuple[list[Block], bool]:
    """The blocks that no markup rules out, and whether the page marks its article."""
    out: list[Block] = []
    pieces: list[str] = []
    linked = depth_a = 0
    stack: list[tuple[str, bool, bool]] = []  # element, out, article
    skip = inside = marked = False
    at = 0

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and not skip:
                element = stack[-1][0] if stack else ""
                out.append(Block(text, min(linked / len(text), 1.0), inside, element in RUNNING, element in HEADINGS))
            pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not skip:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if depth_a:
                linked += len(" ".join(text.split()))

    def pop(k: int) -> None:
        """Close the elements from the k-th on."""
        nonlocal skip, inside
        for element, *_ in stack[k:]:
            open_[element] -= 1
        del stack[k:]
        skip, inside = stack[-1][1:] if stack else (False, False)

    tags, open_ = Tags(page), Counter()
    while True:
        tag = tags.next(at)
        if tag is None:
            say(page[at:])
            break
        start, end, closes, name, rest = tag
        say(page[at:start])
        at = end
        if not name:
            continue
        if closes:
            if name == "a":
                depth_a = max(depth_a - 1, 0)
            elif name in BLOCK:
                close_block()
                if open_[name]:
                    pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
                    depth_a = 0
            continue
        if name in RAW:
            if not rest.rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = over.end() if over else len(page)
            continue
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            depth_a += 1
        if name in BLOCK:
            close_block()
            depth_a = 0
            if name in VOID:
                continue
            if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                pop(len(stack) - 1)
            article = name in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main\b", rest, re.I))
            words = {w for g in MARK.findall(rest) for x in g for w in PARTS.split(x)} if "=" in rest else ()
            marks = any(OUTSIDE.fullmatch(w) or not inside and OUTSIDE_WEAK.fullmatch(w) for w in words)
            barred = name in ASIDE and not (name == "header" and inside) or name not in ("html", "body", "article", "main") and marks
            marked |= article and not skip and not barred
            skip, inside = skip or barred, inside or article
            stack.append((name, skip, inside))
            open_[name] += 1
    close_block()
    return out, marked


def first_label(block: Block, marked: bool) -> int:
    """1 good, -1 bad, 0 undecided."""
    if marked and not block.inside:
        return -1
    words = WORD.findall(block.text.lower())
    density = sum(w in STOP for w in words) / max(len(words), 1)
    if block.links > LINKS_MAX:
        reads = block.inside and (block.heading or density >= STOP_LOW or bool(SENTENCE.search(block.text)))
        return 0 if reads else -1
    if len(block.text) < SHORT:
        return 0
    if density >= (STOP_LOW if len(block.text) > LONG else STOP_HIGH):
        return 1
    return -1 if density < STOP_LOW and block.links > LINKS_SOME else 0


def labels_of(blocks: list[Block], marked: bool) -> list[bool]:
    """Which blocks are text of the article."""
    first = [first_label(b, marked) for b in blocks]
    votes = [(i, x) for i, x in enumerate(first) if x and (blocks[i].inside or not marked)]
    out, k = [], 0
    for i, (block, label) in enumerate(zip(blocks, first)):
        while k < len(votes) and votes[k][0] < i:
            k += 1
        if label or block.inside and block.running and not block.links:
            out.append(label >= 0)
            continue
        near = votes[max(k - 1, 0) : k + 1]  # the last decided one before, and the first behind
        if near:
            out.append(min(near, key=lambda v: (abs(v[0] - i), -v[1]))[1] > 0)
        else:
            out.append(block.inside or block.running and not block.links)
    return out


def main_text(page: str | None) -> str:
    blocks, marked = blocks_of(page or "")
    return "\n".join(b.text for b, good in zip(blocks, labels_of(blocks, marked)) if good)


def _extract(batch: pa.RecordBatch):
    texts = [main_text(p) for p in batch.column("html").to_pylist()]
    yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without a good block, give an empty text; repeated rows give equal
    results; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(frames.per_step(_extract, "html"), "page_id long, url string, text string, n_chars long")
