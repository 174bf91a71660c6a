"""Secret scans: regular expressions find candidates, a random forest removes false positives.

All of it is DataFrame and SQL functions.  A candidate is a token after a key name and an assignment, a
long token with digits, or a private key from its BEGIN to its END line; values of fewer than eight characters are
no candidates, whatever stands before them.  Its features are its length,
counts and changes of character classes, how likely its letters follow one another, its coverage by
dictionary words, words of the path it was found in, and the words before and after it.  Dictionary and
letter transitions are counted over all documents (``learn_lexicon``).  The forest is MLlib's, trained on
labelled findings; its trees are then written out as SQL conditions, so scoring (also inside an array of
candidates, where redaction needs it) stays in the same plan as the scan, without a shuffle.

``labelled_findings`` makes the training rows: no rule over the features labels them.  Secrets and hard
decoys are planted, each with what stands before and after it, and are labelled by what they are:
random values behind key names, random passwords of a word and a number, key formats; identifiers,
placeholders and paths put together from the documents' own words (behind key names as well), digests,
random identifiers and numbers that are named as such.  Candidates of the documents come in only where
their format alone says what they are: published key formats, and plain numbers.  Both labels weigh the
same.  At most ``max_findings`` of each kind are used, drawn by a hash before they are sorted, so that no
task sorts more than a few times that many, however many there are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames

#: fixed values: names of keys
NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?"
ASSIGNED = rf"(?i)(?:{NAMES})[\"']?[ \t]{{0,4}}[:=][ \t]{{0,4}}[\"']?([^\s\"',;]{{8,}})"
KEY_LINE = "(?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----"
#: a private key up to its END line, or without one (or with another BEGIN or END before it) up to the end of its lines;
#: atomic and possessive, so that it takes neither the square of a text's length nor a stack that grows with it
_EOL = r"(?:\r?\n|\\r\\n|\\n)"
PRIVATE_KEY = (
    rf"-----BEGIN {KEY_LINE}(?:(?>(?s:.*?)(?=-----(?:BEGIN|END) ))-----END {KEY_LINE}"
    rf"|(?:{_EOL}(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{_EOL}[ \t]*+(?={_EOL}))?+"
    rf"(?:\s*+[A-Za-z0-9+/]{{16,}}+={{0,2}}|{_EOL}[ \t]*+[A-Za-z0-9+/]++={{0,2}}[ \t]*+(?={_EOL}|[\"']|\z)|{_EOL}[ \t]*+[A-Za-z0-9+/]{{16,}}+={{0,2}})*+)"
)
LONG = PRIVATE_KEY + r"|(?<![A-Za-z0-9+/_-])AKIA[0-9A-Z]{16}(?![A-Za-z0-9+/_-])|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
#: fixed values: formats that are secrets by construction
KNOWN = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{24,}|-----BEGIN (?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----[\s\S]*)$"
#: fixed values: words of placeholders, besides the corpus's own in the dictionary
WORDS = "example sample test dummy demo placeholder changeme your insert here foo bar http https www html json index page image file name path user value data default version config license number order invoice document section chapter table figure token secret password".split()
#: Words of the learned dictionary, the most frequent ones, and the least of their letters.
DICTIONARY, WORD_LETTERS = 3000, 4
HARMLESS_NEAR = r"(?i)\b(?:sha1|sha256|md5|commit|revision|checksum|digest|hash|uuid|guid|isbn|issn|doi|phone|tel|fax|card|visa|iban|order|invoice|serial|version)\b"
PATHS = r"(?i)(?:^|[/_.-])(?:tests?|examples?|samples?|docs?|fixtures?|mocks?|templates?)(?:$|[/_.-])"
BEFORE, AFTER = 48, 24
RUN = 256
THRESHOLD = 0.5
FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "changes", "distinct", "covered", "transition", "assigned", "named", "known", "harmless", "path", "quoted", "hex",
]


@dataclass(frozen=True)
class Lexicon:
    """Frequent words, and the log10 probability of each pair of letters (26 x 26, a to z)."""

    words: tuple[str, ...] = ()
    pairs: tuple[float, ...] = (-math.log10(26 * 26),) * (26 * 26)


def learn_lexicon(docs: DataFrame, size: int = DICTIONARY) -> Lexicon:
    """The ``size`` most frequent words of WORD_LETTERS letters or more, and all letter pairs of words, over all
    rows of ``docs``.  Null and empty texts have none; repeated rows count; without words it is empty."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("w")).where("length(w) > 1")
    counts = frames.materialise(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    top = counts.where(F.length("w") >= WORD_LETTERS).orderBy(F.col("n").desc(), "w").limit(size).collect()  # at most ``size`` rows
    letters = F.split("w", "")
    place = F.transform(F.sequence(F.lit(0), F.length("w") - 2), lambda i: (F.ascii(F.get(letters, i)) - 97) * 26 + F.ascii(F.get(letters, i + 1)) - 97)
    pairs = {r.p: r.n for r in counts.select(F.explode(place).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).collect()}  # at most 676 rows
    total = sum(pairs.values()) + 26 * 26
    return Lexicon(tuple(r.w for r in top), tuple(math.log10((pairs.get(p, 0) + 1) / total) for p in range(26 * 26)))


@dataclass(frozen=True)
class Scanner:
    """What scanning needs: the forest, and the lexicon that its features were made with."""

    forest: RandomForestClassificationModel
    lexicon: Lexicon


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _folded(values: list[str], kind: str = "array<string>") -> Column:
    """An array that the optimizer makes one constant of, in place of a literal for each element."""
    return F.split(F.lit("|".join(values)), r"\|").cast(kind)


def _listed(xs: Column, start: dict[str, Column], none: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Array that ``step`` appends to, going through ``xs``: a step gets and returns struct<fields of start, out>.  A list
    that grows is copied at every step, so it grows in parts of RUN steps that are put together at the end."""
    begin = lambda so_far: F.struct(*((so_far[k] if so_far is not None else c).alias(k) for k, c in start.items()), none.alias("out"))

    def run(so_far: Column, k: Column) -> Column:
        done = F.aggregate(F.slice(xs, k * RUN + 1, F.lit(RUN)), begin(so_far), step)
        return _let(done, lambda d: F.struct(*(d[name].alias(name) for name in start), F.concat(so_far["parts"], F.array(d["out"])).alias("parts")))

    first = F.struct(*(c.alias(k) for k, c in start.items()), F.filter(F.array(none), lambda x: F.lit(False)).alias("parts"))
    runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / RUN).cast("int") - 1, F.lit(0)))
    return F.flatten(F.aggregate(runs, first, run)["parts"])


def _matches(text: Column, pattern: str, token: Callable[[Column], Column]) -> Column:
    """array<struct<token, at, byte, before, after>> of a pattern's matches; a token ends where its match does.
    Places are the summed lengths of the matches and of the gaps between them, and what stands around a
    token is taken from those, so that no match walks the text again."""
    none = F.array().cast("array<struct<token:string,at:int,byte:int,before:string,after:string>>")

    def step(so_far: Column, x: Column) -> Column:
        t, past = x["token"], F.concat(so_far["tail"], F.right(x["gap"], F.lit(BEFORE)), F.left(x["match"], F.length(x["match"]) - F.length(x["token"])))
        end = so_far["end"] + F.length(x["gap"]) + F.length(x["match"])
        bytes_ = so_far["bytes"] + F.octet_length(x["gap"]) + F.octet_length(x["match"])
        one = F.struct(t.alias("token"), (end - F.length(t)).alias("at"), (bytes_ - F.octet_length(t)).alias("byte"), F.right(past, F.lit(BEFORE)).alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("end"), bytes_.alias("bytes"), F.right(F.concat(past, t), F.lit(BEFORE)).alias("tail"), F.concat(so_far["out"], F.array(one)).alias("out"))

    def walk(found: Column) -> Column:
        def steps(gaps: Column) -> Column:
            # two matches are longer than AFTER
            ahead = lambda i: F.concat(*(F.left(F.coalesce(F.get(part, i + k), F.lit("")), F.lit(AFTER)) for k in (1, 2) for part in (gaps, found)))
            return F.transform(found, lambda m, i: F.struct(F.get(gaps, i).alias("gap"), m.alias("match"), token(m).alias("token"), F.left(ahead(i), F.lit(AFTER)).alias("after")))

        start = {"end": F.lit(1), "bytes": F.lit(1), "tail": F.lit("")}
        return F.when(F.size(found) == 0, none).otherwise(_let(_let(F.split(text, pattern, -1), steps), lambda xs: _listed(xs, start, none, step)))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)


def candidates(text: Column) -> Column:
    """array<struct<token, at, byte, before, after>> of a text's candidates, one for each place; ``at`` counts characters
    from 1, and ``byte`` bytes."""

    def placed(found: Column, kind: int) -> Column:
        return F.transform(found, lambda c: F.struct(c["at"].alias("at"), c["token"].alias("token"), F.lit(kind).alias("kind"), c.alias("c")))

    def once(found: Column) -> Column:  # in order of place; of the same token at the same place the first, which is the assigned one
        same = lambda x, y: (x["at"] == y["at"]) & (x["token"] == y["token"])
        return F.transform(F.filter(found, lambda x, i: (i == 0) | ~same(x, F.get(found, i - 1))), lambda x: x["c"])

    assigned, long = _matches(text, ASSIGNED, lambda m: F.regexp_extract(m, ASSIGNED, 1)), _matches(text, LONG, lambda m: m)
    return _let(F.sort_array(F.concat(placed(assigned, 0), placed(long, 1))), once)


def candidate_table(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, path, words, found): each row's candidates and, where a text is longer than 60 characters, a few of its first
    words, written to the shared folder: one pass over the texts for ``labelled_findings`` and ``scan``."""
    text, where = F.coalesce(F.col("text"), F.lit("")), F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    # words for decoys: the first few of documents, which is all that is kept of them
    first = F.filter(F.transform(F.slice(F.split(F.substring("text", 1, 400), " "), 2, 6), lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z]", ""))), lambda w: w != "")
    return frames.materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), F.when(F.length("text") > 60, first).alias("words"), candidates(text).alias("found")), "candidates")


def _by_token(found: Column) -> Column:
    """array<struct<token, places>>: candidates put together by token, places in order; candidates have token and at as first fields."""

    def runs(c: Column) -> Column:
        n = F.size(c)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(c, i)["token"] != F.get(c, F.greatest(i - 1, F.lit(0)))["token"])))
        return _let(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.get(c, at)["token"].alias("token"), F.slice(c, at + 1, F.coalesce(F.get(s, k + 1), n) - at).alias("places"))))

    return _let(F.sort_array(found), runs)


def features(c: Column, path: Column, lexicon: Lexicon) -> Column:
    """struct of the FEATURES of a candidate."""
    token, before, after = c["token"], c["before"], c["after"]
    gone = lambda pattern: F.length(token) - F.length(F.regexp_replace(token, pattern, ""))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a"), "[^0Aa]+", "_")
    # words: runs of letters, parted where small letters meet a capital
    runs = F.split(F.lower(F.regexp_replace(token, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    words = sorted({*lexicon.words, *WORDS})
    listed = _folded([" ".join(["", *(w for w in words if w[0] == a), ""]) for a in "abcdefghijklmnopqrstuvwxyz"])  # by first letter, between spaces
    known = lambda w: F.contains(F.get(listed, F.ascii(w) - 97), F.concat(F.lit(" "), w, F.lit(" ")))
    covered = F.aggregate(F.filter(runs, lambda w: (F.length(w) > 2) & known(w)), F.lit(0), lambda n, w: n + F.length(w))
    likely = _folded(list(map(repr, lexicon.pairs)), "array<double>")
    unknown = -math.log10(26 * 26)

    def transition(letters: Column) -> Column:
        at = lambda i: F.ascii(F.get(letters, i)) - 97
        inside = lambda x: (x >= 0) & (x < 26)
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(letters) - 2, F.lit(0))), lambda i: F.when(inside(at(i)) & inside(at(i + 1)), F.get(likely, at(i) * 26 + at(i + 1))))
        return _let(F.filter(each, lambda x: x.isNotNull()), lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)).otherwise(unknown))

    parts = {
        "length": F.length(token), "digits": gone("[0-9]"), "uppers": gone("[A-Z]"), "lowers": gone("[a-z]"), "others": gone("[^0-9A-Za-z]"),
        "changes": F.length(classes) - 1, "distinct": F.size(F.array_distinct(F.split(token, ""))),
        "covered": covered / F.length(token), "transition": _let(F.split(F.lower(token), ""), transition),
        "assigned": before.rlike(r"[:=][ \t]{0,4}[\"']?$").cast("double"), "named": before.rlike(rf"(?i)(?:{NAMES})[\"']?[ \t]{{0,4}}[:=]?[ \t]{{0,4}}[\"']?$").cast("double"),
        "known": token.rlike(KNOWN).cast("double"), "harmless": F.concat_ws(" ", before, after).rlike(HARMLESS_NEAR).cast("double"),
        "path": F.coalesce(path.rlike(PATHS), F.lit(False)).cast("double"), "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "hex": token.rlike("^[0-9a-f]+$").cast("double"),
    }
    return F.struct(*(parts[name].cast("double").alias(name) for name in FEATURES))


def _check_digit(token: Column) -> Column:
    """Whether a number of 13 to 19 digits has a valid check digit (every second digit from the right doubled)."""
    digits = F.transform(F.filter(F.split(F.reverse(token), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return token.rlike("^[0-9]{13,19}$") & (F.when(token.rlike("^[0-9]{13,19}$"), F.aggregate(digits, F.lit(0), lambda a, d: a + d)) % 10 == 0)


def _drawn(rows: DataFrame, turn: Column, limit: int, *ties: str) -> DataFrame:
    """``limit`` rows by the order of a hash; a share of about four times as many is cut out by the hash first,
    so that what meets in one task is bounded whatever the number of rows."""
    n = rows.count()
    if n > 4 * limit:
        rows = rows.where(F.pmod(turn, F.lit(1 << 30)) < max(int((1 << 30) * 4 * limit / n), 1))
    return rows.orderBy(turn, *ties).limit(limit)


def planted(heads: DataFrame) -> DataFrame:
    """(c, path, label, turn): secrets and decoys made from rows (doc_id, words array), labelled by what they are."""
    name = lambda i: F.col("doc_id").cast("string") if i is None else F.concat_ws("-", F.col("doc_id").cast("string"), F.lit(i))
    draw = lambda i, n: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(n))
    pick = lambda i, some: F.element_at(F.array(*map(F.lit, some)), (draw(i, len(some)) + 1).cast("int"))
    word = lambda i: F.coalesce(F.get("words", F.lit(i)), F.lit("word"))
    hexes = lambda i: F.sha2(name(i), 512)
    coded = lambda i: F.translate(F.base64(F.unhex(F.sha2(name(i), 512))), "+/=\r\n", "-_")
    cut = lambda c, i, least, most: F.substring(c, F.lit(1), (draw(i, most - least + 1) + least).cast("int"))
    long = F.concat_ws(".", *(coded(f"l{i}") for i in range(8)))
    key = pick("key", ["password", "passwd", "secret", "token", "api_key", "API_KEY", "access_key", "auth_key", "credentials", "client_secret", "DB_PASSWORD"])
    sign = pick("sign", [": ", "=", " = ", ":", "='", '="', ': "', ' = "'])
    behind = F.concat(pick("lead", ["set ", "", "export ", "\n", "  ", "use "]), key, sign)
    close = F.when(sign.endswith("'"), "' ").when(sign.endswith('"'), '" ').otherwise(pick("close", [" ", "\n", " and ", " # ", " and commit ", " by order ", " version "]))
    number = draw("number", 100_000).cast("string")
    about = pick("about", ["commit ", "revision ", "sha256: ", "md5=", "checksum ", "digest=", "hash: "])
    plain = pick("plain", ["the ", "in ", "see ", "at ", "of ", "path=", "id: ", "name = "])
    uuid = lambda i: F.concat_ws("-", *(F.substring(hexes(i), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    kinds = [
        # secrets
        (1.0, cut(hexes("h"), "h", 16, 64), behind, close), (1.0, cut(coded("c"), "c", 14, 64), behind, close), (1.0, cut(long, "j", 80, 680), behind, close),
        (1.0, F.translate(cut(long, "s", 20, 400), "_-xyz", ".!$%@"), behind, close), (1.0, F.concat(F.substring(coded("w"), 1, 3), word(1), F.substring(coded("w"), 5, 6), number), behind, close),
        (1.0, F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(hexes("a"), 11, 16), "0189", "GHJK"))), pick("free", ["the key ", "", "use ", "id="]), close),
        # decoys: made of words, behind key names too
        (0.0, F.concat_ws("_", word(1), word(2), word(3), number), plain, F.lit(" and ")), (0.0, F.concat_ws("/", word(1), word(2), word(4), number), plain, F.lit(" ")),
        (0.0, F.concat_ws("_", word(2), word(3), word(5)), behind, close), (0.0, F.concat_ws(".", word(1), word(3)), behind, F.lit("() ")),
        (0.0, F.concat(pick("of", ["example", "your", "sample", "dummy", "test"]), F.lit("_"), pick("what", ["key", "token", "password", "value"]), F.lit("_"), number, F.lit("_placeholder")), behind, close),
        # decoys: random, but named as something else
        (0.0, F.sha1(name("g")), about, F.lit(" by ")), (0.0, cut(hexes("f"), "f", 32, 64), about, F.lit(" ")), (0.0, uuid("u"), pick("id", ["uuid ", "guid: ", "id=", "request ", ""]), F.lit(".")),
        (0.0, F.concat(F.substring(F.translate(hexes("n"), "abcdef", "123456"), 1, 16)), pick("no", ["card ", "order ", "phone ", "", "number "]), F.lit(" ")),
    ]
    each = F.array(*(F.struct(F.struct(t.alias("token"), F.lit(1).alias("at"), F.lit(1).alias("byte"), F.right(b, F.lit(BEFORE)).alias("before"), F.lit(a).alias("after") if isinstance(a, str) else F.left(a, F.lit(AFTER)).alias("after")).alias("c"), F.lit(label).alias("label")) for label, t, b, a in kinds))
    rows = heads.select(F.xxhash64("doc_id", F.lit(11)).alias("turn"), pick("path", ["src/main.py", "docs/readme.md", "tests/test_it.py", "notes", "config/app.yml"]).alias("path"), F.explode(each).alias("x"))
    return rows.select("x.c", "path", "x.label", "turn").where("length(c.token) >= 8")


def labelled_findings(docs: DataFrame, path: str = "source", max_findings: int = 4000) -> DataFrame:
    """(c, path, label, turn): labelled candidates for training, see the module's head; turn is a hash of the document,
    by which findings can be held out.  An empty table gives none."""
    return _findings_of(candidate_table(docs, path), max_findings)


def _findings_of(table: DataFrame, max_findings: int = 4000) -> DataFrame:
    turn = F.xxhash64("doc_id", F.lit(11))
    rows = table.select("doc_id", "path", F.explode("found").alias("c"))
    token = F.col("c.token")
    plain = token.rlike("^[0-9]+$") | _check_digit(token)
    known = frames.materialise(rows.withColumn("label", F.when(token.rlike(KNOWN), 1.0).when(plain, 0.0)).where("label is not null").withColumn("turn", turn), "known-findings")
    by = F.xxhash64("doc_id", "c.token", "c.at", F.lit(5))
    real = [_drawn(known.where(F.col("label") == k), by, max_findings // 2, "doc_id", "c.at").select("c", "path", "label", "turn") for k in (0.0, 1.0)]
    heads = frames.materialise(_drawn(table.where("words is not null").select("doc_id", "words"), F.xxhash64("doc_id", F.lit(9)), max_findings // 4, "doc_id"), "heads")
    return real[0].unionByName(real[1]).unionByName(planted(heads))


def train(findings: DataFrame, lexicon: Lexicon | None = None, trees: int = 15, depth: int = 6) -> Scanner | None:
    """The forest with its lexicon, or None when findings of one kind are missing: then only published formats and
    private keys count as secrets."""
    lexicon = lexicon or Lexicon()
    rows = frames.materialise(findings.select(features(F.col("c"), F.col("path"), lexicon).alias("f"), "label").select("f.*", "label"), "findings")  # MLlib reads them many times
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, sum(n.values()) / (2 * n[1.0])).otherwise(sum(n.values()) / (2 * n[0.0])))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=17, cacheNodeIds=False)
    return Scanner(forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows).select("x", "label", "weight")), lexicon)


def fit(docs: DataFrame, path: str = "source", **limits: int) -> Scanner | None:
    """A scanner for ``docs``, from their own words and labelled findings."""
    return train(labelled_findings(docs, path, **limits), learn_lexicon(docs))


def fit_and_scan(docs: DataFrame, path: str = "source", threshold: float = THRESHOLD, **limits: int) -> DataFrame:
    """``scan`` of ``docs`` by a scanner fitted to them; the texts are searched once for both."""
    table = candidate_table(docs, path)
    return _reported(table, train(_findings_of(table, **limits), learn_lexicon(docs)), threshold)


_NODE = re.compile(r"^\s*(If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee]+)\)$|^\s*Predict: ([0-9.]+)$")


def vote(forest: RandomForestClassificationModel, f: Column) -> Column:
    """Share of the trees that call the candidate with features ``f`` a secret, as nested conditions."""

    value = [f[name] for name in FEATURES]

    def read(lines: list[str], at: int) -> tuple[Column, int]:
        m = _NODE.match(lines[at])
        if m[5] is not None:
            return F.lit(float(m[5])), at + 1
        yes, next_ = read(lines, at + 1)
        no, end = read(lines, next_ + 1)  # skips the Else line
        return F.when(value[int(m[2])] <= float(m[4]), yes).otherwise(no), end

    total = None
    for tree in forest.trees:
        lines = [x for x in tree.toDebugString.split("\n") if _NODE.match(x)]
        one = read(lines, 0)[0]
        total = one if total is None else total + one
    return total / len(forest.trees)


def _scored(found: Column, model: Scanner | None, where: Column) -> Column:
    """array<struct<token, at, byte, score, named>> of the candidates ``found``, each judged where it stands."""
    lexicon = model.lexicon if model else Lexicon()

    def scored(c: Column) -> Column:
        said = lambda score, named: F.struct(c["token"].alias("token"), c["at"].alias("at"), c["byte"].alias("byte"), score.alias("score"), named.alias("named"))
        judged = _let(features(c, where, lexicon), lambda f: said(vote(model.forest, f) if model else f["known"], f["named"]))
        # a private key is one by its format
        return F.when(c["token"].rlike("^-----BEGIN"), said(F.lit(1.0), F.lit(0.0))).otherwise(judged)

    return F.transform(found, scored)


def scan(docs: DataFrame, model: Scanner | None, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each distinct candidate of each row of ``docs``: doc_id, at (code point of its first
    occurrence, from 1), length, rule, score, is_secret, token_sha256, occurrences (at, score and
    is_secret of each, in order).  Each occurrence is judged where it stands; rule, score and is_secret
    of the row are those of the occurrence with the highest score.

    The token itself is not shown.  Null and empty texts have no candidates; repeated rows report theirs
    each; without a path column the path says nothing; other columns are ignored; an empty table gives
    an empty result.
    """
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    return _reported(docs.select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), candidates(F.coalesce("text", F.lit(""))).alias("found")), model, threshold)


def _reported(table: DataFrame, model: Scanner | None, threshold: float) -> DataFrame:
    rows = table.select("doc_id", F.explode(_by_token(_scored(F.col("found"), model, F.col("path")))).alias("c"))
    token, places = F.col("c.token"), F.col("c.places")
    best = F.array_max(F.transform(places, lambda p: F.struct(p["score"].alias("score"), p["named"].alias("named"))))
    rule = F.when(token.rlike("^-----BEGIN"), "private key").when(token.rlike(KNOWN), "known format").when(best["named"] == 1, "assigned to a key name").otherwise("long token")
    each = F.transform(places, lambda p: F.struct(p["at"].alias("at"), p["score"].alias("score"), (p["score"] >= threshold).alias("is_secret")))
    return rows.select("doc_id", places[0]["at"].alias("at"), F.length(token).alias("length"), rule.alias("rule"), best["score"].alias("score"), (best["score"] >= threshold).alias("is_secret"), F.sha2(token, 256).alias("token_sha256"), each.alias("occurrences"))


def redact(docs: DataFrame, model: Scanner | None, path: str = "source", threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark``; all rows and columns stay, a null text stays null.

    A token that is a secret at one of its occurrences is replaced at all.  Occurrences that overlap get
    one mark together; after them, what is left of the text is searched for the same characters."""
    text = F.col("text")

    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")

    def masked(found: Column) -> Column:
        secret = F.filter(_by_token(found), lambda g: F.exists(g["places"], lambda c: c["score"] >= threshold))
        return _let(secret, lambda groups: F.when(F.size(groups) == 0, text).otherwise(_without(groups)))

    def _without(groups: Column) -> Column:
        tokens, found = F.transform(groups, lambda g: g["token"]), F.flatten(F.transform(groups, lambda g: g["places"]))
        spans = F.sort_array(F.transform(found, lambda c: F.struct(c["byte"].alias("at"), (c["byte"] + F.octet_length(c["token"])).alias("end"))))
        def cut(raw: Column) -> Column:  # pieces by byte, as a character is found by walking to it
            piece = lambda a, n: F.decode(F.substring(raw, a, n), "UTF-8")

            def step(so_far: Column, s: Column) -> Column:
                kept = F.when(s["at"] >= so_far["at"], F.concat(so_far["out"], F.array(piece(so_far["at"], s["at"] - so_far["at"])))).otherwise(so_far["out"])
                return F.struct(F.greatest(so_far["at"], s["end"]).alias("at"), kept.alias("out"))

            last = F.array_max(F.transform(spans, lambda s: s["end"]))
            kept = _let(spans, lambda xs: _listed(xs, {"at": F.lit(1)}, F.array().cast("array<string>"), step))
            return F.array_join(F.concat(kept, F.array(piece(last, F.octet_length(raw)))), mark)

        longest_first = F.array_sort(tokens, lambda a, b: F.length(b) - F.length(a))
        return F.aggregate(longest_first, _let(F.encode(text, "UTF-8"), cut), lambda t, s: F.replace(t, s, F.lit(mark)))

    return docs.withColumn("text", F.when(text.isNotNull(), _let(_scored(candidates(F.coalesce(text, F.lit(""))), model, where), masked)))
