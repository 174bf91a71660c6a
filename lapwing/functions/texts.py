"""Column functions on texts: tokens, lexicons, embedded JSON, renderers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: words of positive and negative tone
POSITIVE = "good great happy love wonderful excellent amazing joy excited thankful grateful glad fantastic beautiful enjoyed enjoy fun nice awesome blessed positive smile laughed better best perfect well pleased cheerful hope hopeful".split()
NEGATIVE = "bad sad hurt pain tired anxious worried stress stressed depressed lonely upset angry frustrated afraid scared difficult hard sick terrible awful horrible worse worst miserable unhappy crying cried fear hate".split()
#: fixed values: prefixes of seven categories
CATEGORIES = {
    "posemo": "happy joy love good great wonderful blessed grateful thankful amazing beautiful enjoy fun excited glad pleased cheerful pleasant hope awesome fantastic smile laugh comfort peaceful calm relax content delight satisfy",
    "negemo": "sad angry upset worried anxious fear pain hurt stress tired exhausted frustrated annoyed depressed lonely miserable awful terrible horrible sick suffering cry grief sorrow nervous overwhelm disappoint struggle difficult hard",
    "health": "cancer treatment chemo radiation doctor hospital pain symptom medication therapy health medical surgery appointment nausea fatigue scan diagnosis recovery survivor",
    "social": "family friend husband wife partner child kids son daughter mother father sister brother people together talk visit call support relationship neighbor church group",
    "cogproc": "think know feel believe understand remember realize wonder consider decide expect hope wish plan try learn thought mind",
    "work": "work job office meeting project task busy deadline colleague boss retire career",
    "leisure": "walk exercise garden cook read watch movie music game play travel shop hobby art craft yoga swim hike bike dance",
}


def tokens(text: Column) -> Column:
    """Lower-case words; everything but word characters and apostrophes separates."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s']", " "), r"\s+"), lambda w: w != "")


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def count_in(token_array: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(token_array, lambda w: w.isin(*lexicon)))


def prefix_tree(words: list[str]) -> str:
    """A regular expression for the longest of ``words`` at a place: branches by letter, so that each letter is read once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    branches = "|".join(re.escape(head) + prefix_tree(rest) for head, rest in heads.items())
    if not branches:
        return ""
    return f"(?:{branches})?" if "" in words else f"(?:{branches})"


def lexicon_profile(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` without ``text``, with word_count, a count and a share for each category, and the tone ratio.

    One walk over a text finds each word's longest prefix of any category; a category counts the found ones that begin
    with one of its own."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    total = F.greatest(F.regexp_count(low, F.lit(r"\S+")), F.lit(1))
    prefixes = {name: tuple(p.split()) for name, p in CATEGORIES.items()}
    every = [p for ps in prefixes.values() for p in ps]
    found = F.regexp_extract_all(low, F.lit(rf"(?<!\S){prefix_tree(every)}"), F.lit(0))
    kept = [c for c in rows.columns if c != text]
    walked = rows.select(*kept, total.cast("long").alias("word_count"), found.alias("_found"))
    # the few that were found, sorted into categories by their names
    mine = {name: [p for p in set(every) if p.startswith(ps)] for name, ps in prefixes.items()}
    counts = [count_in(F.col("_found"), names).cast("long").alias(f"{name}_count") for name, names in mine.items()]
    counted = walked.select(*kept, "word_count", *counts)
    shares = [(F.col(f"{name}_count") / F.col("word_count")).alias(f"{name}_prop") for name in CATEGORIES]
    return counted.select("*", *shares, ((F.col("posemo_count") + 1) / (F.col("negemo_count") + 1)).alias("pos_neg_ratio"))


def embedded_json(text: Column, schema: str) -> Column:
    """A JSON object of a text that is one, holds one in a code fence, or holds one between its first and
    last brace; an object under ``result`` is unwrapped.  Braces inside strings around it are not balanced."""
    read = lambda raw: F.from_json(F.when(F.trim(raw).startswith("{"), F.trim(raw)), schema)
    inner = F.get_json_object(text, "$.result")
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    brace = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(*(F.when(raw.rlike(r"(?s)^\s*\{.*\}\s*$"), read(raw)) for raw in (F.coalesce(inner, text), fence, brace)))


def once(value: Column, work: Callable[[Column], Column]) -> Column:
    """``work`` of a value that is worked out once a row, however often ``work`` names it."""
    return F.transform(F.array(value), work)[0]


def first_object(text: Column) -> Column:
    """The text from its first opening brace to the brace that closes it; null if none does.  A fold over runs of plain
    characters, quotes, braces and escaped characters: braces inside strings do not count."""
    return once(F.regexp_extract(text, r"(?s)\{.*", 0), _closed)


def _closed(text: Column) -> Column:
    """``first_object`` of a text that begins with a brace."""
    parts = F.regexp_extract_all(text, F.lit(r'(?s)\\.|["{}\\]|[^"{}\\]+'), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, part: Column) -> Column:
        inside, at = s["quoted"], s["at"] + F.length(part)
        depth = s["depth"] + F.when(inside, 0).when(part == "{", 1).when(part == "}", -1).otherwise(0)
        closes = (s["end"] == 0) & ~inside & (part == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), F.when(part == '"', ~inside).otherwise(inside).alias("quoted"), at.alias("at"), F.when(closes, at).otherwise(s["end"]).alias("end"))

    return once(F.aggregate(parts, state, step)["end"], lambda end: F.when(end > 0, F.substring(text, F.lit(1), end)))


def strict_json(text: Column) -> Column:
    """The VARIANT of a text that is JSON from its first sign to its last, else null (the parser by itself reads the first
    value and leaves the rest, so the text is read as the one entry of a list, and of an object)."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return once(listed, lambda found: F.when((F.size(found) == 1) & held.isNotNull(), found[0]))


def json_of(text: Column) -> Column:
    """JSON in a text, as VARIANT: the whole text if it is JSON, else what the first code fence holds, else the first
    balanced object; null if none of them is JSON."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.coalesce(strict_json(text), once(fence, strict_json), once(first_object(text), strict_json))


def answer_of(text: Column) -> Column:
    """``json_of`` with a wrapper taken off: an object under ``result``, or the JSON in a text under ``result``."""
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    # the text under ``result``, or null
    said = lambda whole: F.try_variant_get(whole, "$.result", "string")
    nested = lambda whole: F.coalesce(once(F.try_variant_get(whole, "$.result", "variant"), lambda v: F.when(is_object(v), v)), once(said(whole), json_of), whole)
    return once(text, lambda t: once(json_of(t), lambda whole: F.when(is_object(whole), nested(whole)).otherwise(whole)))


def duration_text(minutes: Column) -> Column:
    """'1h 05m', '12m', or '0m'; null without minutes."""
    whole = F.floor(minutes).cast("long")
    return F.when(whole.isNull(), None).when(whole >= 60, F.format_string("%dh %02dm", F.floor(whole / 60).cast("long"), whole % 60)).otherwise(F.format_string("%dm", whole))


def rendered(parts: dict[str, tuple[str, Column]], nothing: str = "no data") -> Column:
    """'name format' of each non-null value, joined by '; '."""
    out = F.concat_ws("; ", *(F.when(c.isNotNull(), F.format_string(form, c)) for form, c in parts.values()))
    return F.when(out == "", nothing).otherwise(out)
