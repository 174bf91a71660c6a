"""Queries for texts, similarity and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as X
from ..functions import times as T
from ..operators import daily as D
from ..operators import logs as L
from ..operators import pit as P
from ..operators import similar as S
from ..sources import bindings as B
from .base import events_of, query, rounded

_w = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')"
_n = {name: f"len(list_filter(w, lambda x: regexp_matches(x, '^(?:{'|'.join(p.split())})')))" for name, p in X.CATEGORIES.items()}


@query(
    "x03_lexicon_profile",
    f"""WITH t AS (SELECT doc_id, {_w} AS w FROM documents), c AS (SELECT doc_id, greatest(len(w), 1) AS word_count, {', '.join(f'{n} AS {k}_count' for k, n in _n.items())} FROM t)
    SELECT doc_id, CAST(word_count AS BIGINT) AS word_count, {', '.join(f'CAST({k}_count AS BIGINT) AS {k}_count, round({k}_count / word_count, 6) AS {k}_prop' for k in _n)}, round((posemo_count + 1) / (negemo_count + 1), 6) AS pos_neg_ratio FROM c""",
)
def lexicon_profile(spark, sf_dir):
    """Sixteen columns."""
    docs = B.read(spark, sf_dir, "documents")
    return rounded(X.lexicon_profile(docs.select("doc_id", "text")), 6)


SHAPE = "CASE k % 4 WHEN 0 THEN '{\"a\": ' || k || ', \"yes\": true}' WHEN 1 THEN 'Here it is: ```json\n{\"a\": ' || k || ', \"yes\": false}\n``` done' WHEN 2 THEN 'so {\"a\": ' || k || ', \"yes\": true} then' ELSE '{\"result\": {\"a\": ' || k || ', \"yes\": true}}' END"


@query("x05_embedded_json", f"WITH {B.EV} SELECT event_id, k AS a, k % 4 <> 1 AS yes FROM ev")
@events_of
def embedded_json(ev):
    """An object of a text that is one, fences one, holds one, or wraps one."""
    raw = F.expr(SHAPE.replace("\n", "\\n"))
    return ev.select("event_id", X.embedded_json(raw, "a bigint, yes boolean").alias("j")).select("event_id", "j.a", "j.yes")


@query("x06_mentions", f"WITH {B.EV} SELECT user_id, 'tool_' || CAST(k % 5 AS VARCHAR) AS tool, count(*) * 2 AS n FROM ev GROUP BY ALL")
@events_of
def mentions(ev):
    """Names mentioned in log lines."""
    line = F.concat(F.lit("called tool_"), F.col("k") % 5, F.lit("(x) then tool_"), F.col("k") % 5)
    found = ev.select("user_id", F.explode(F.regexp_extract_all(line, F.lit(r"(tool_\d+)"), F.lit(1))).alias("tool"))
    return found.groupBy("user_id", "tool").agg(F.count("*").alias("n"))


NAMED = "(password|token|license|copyright|commit|isbn)"


@query("x06_text_mentions", f"SELECT source, name, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '{NAMED}')) AS name FROM documents) GROUP BY ALL")
def text_mentions(spark, sf_dir):
    """Names mentioned in the given texts, by source."""
    docs = B.read(spark, sf_dir, "documents")
    found = docs.select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(NAMED), F.lit(1))).alias("name"))
    return found.groupBy("source", "name").agg(F.count("*").alias("n"))


@query(
    "x09_records_without_nulls",
    f"""WITH {B.EV}, d AS (SELECT user_id, sum(value) FILTER (event_type = 'click') AS click, sum(value) FILTER (event_type = 'view') AS view_, sum(value) FILTER (event_type = 'error' AND k = 3) AS error FROM ev GROUP BY user_id)
    SELECT user_id, concat_ws(',', CASE WHEN click IS NOT NULL THEN 'h_click' END, CASE WHEN error IS NOT NULL THEN 'h_error' END, CASE WHEN view_ IS NOT NULL THEN 'h_view' END) AS keys FROM d""",
)
@events_of
def records(ev):
    """A map without its nulls, keys prefixed."""
    of = lambda kind, cond: F.sum(F.when((F.col("event_type") == kind) & cond, F.col("value")))
    rows = ev.groupBy("user_id").agg(of("click", F.lit(True)).alias("click"), of("view", F.lit(True)).alias("view"), of("error", F.col("k") == 3).alias("error"))
    names = ("click", "error", "view")
    whole = F.map_filter(F.map_from_arrays(F.array(*(F.lit(f"h_{n}") for n in names)), F.array(*names)), lambda _, v: v.isNotNull())
    return rows.select("user_id", F.array_join(F.array_sort(F.map_keys(whole)), ",").alias("keys"))


@query(
    "x10_conversation_log",
    """WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), l AS (SELECT conv_id, arg_max(text, turn) AS last_text FROM a GROUP BY conv_id)
    SELECT u.conv_id, u.turn, u.text AS asked, a.text AS answered, last_text AS last_answer FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 LEFT JOIN l ON l.conv_id = u.conv_id""",
)
def conversation_log(spark, sf_dir):
    """Calls joined with their answers, and each log's last answer, in full."""
    rows = B.read(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    answers = rows.where("role = 'assistant'")
    last = answers.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_answer"))
    return asked.join(answers.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answered")), ["conv_id", "turn"], "left").join(last, "conv_id", "left")


#: who a user's turn answers: the call after it, or the one before it
_ID = "CASE WHEN turn % 4 = 0 THEN turn + 1 ELSE turn - 1 END"


def log_lines(spark, sf_dir):
    """(log_id, line_no, line) made from conversations: assistants speak and call, users bring results by id, some before the call
    and some for none, system turns are no JSON, a third of the logs end with a result."""
    rows = B.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("log_id"), (F.col("turn") * 2).alias("line_no"), "turn", "role", "text", F.length("text").alias("n"))
    line = lambda sql: F.to_json(F.expr(sql))
    call = "named_struct('type', 'tool_use', 'id', concat('c', turn), 'name', concat('tool_', turn % 3), 'input', named_struct('n', n, 'none', cast(null as string)))"
    # blocks of several shapes in one list: their JSON is put in as it is
    spoken = F.concat(F.lit('{"type": "assistant", "message": {"content": ["stray", '), line("named_struct('type', 'text', 'text', text)"), F.lit(", "), line(call), F.lit("]}}"))
    brought = F.concat(F.lit('{"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c'), F.expr(_ID).cast("string"), F.lit('", "content": [{"type": "image"}, '), line("named_struct('type', 'text', 'text', text)"), F.lit(', {"type": "text", "text": "end"}]}]}}'))
    ended = F.concat(F.lit('{"type": "result", "num_turns": '), F.col("turn") + 1, F.lit(', "total_cost_usd": 0.5, "usage": {"input_tokens": '), F.col("n"), F.lit(', "cache_read_input_tokens": 7}, "result": '), F.to_json(F.array("text")), F.lit("}"))
    ended = F.regexp_replace(ended, r'(?s)"result": \[(.*)\]\}$', '"result": $1}')
    lines = rows.select("log_id", "line_no", F.when(F.col("role") == "assistant", spoken).when(F.col("role") == "user", brought).otherwise(F.concat(F.lit("note: "), F.col("text"))).alias("line"))
    return lines.unionByName(rows.where("role = 'assistant' and turn = 1 and log_id % 3 = 0").select("log_id", (F.col("line_no") + 1).alias("line_no"), ended.alias("line")))


@query(
    "x10_tool_calls",
    f"""WITH r AS (SELECT conv_id, {_ID} AS id, arg_max(left(text || ' end', 2000), turn) AS said FROM conversations WHERE role = 'user' GROUP BY ALL), a AS (SELECT * FROM conversations WHERE role = 'assistant')
    SELECT a.conv_id AS log_id, row_number() OVER (PARTITION BY a.conv_id ORDER BY turn) AS call_no, 'c' || turn AS id, 'tool_' || (turn % 3) AS name, length(text) AS n, coalesce(said, '') AS result FROM a LEFT JOIN r ON r.conv_id = a.conv_id AND r.id = a.turn""",
)
def tool_calls(spark, sf_dir):
    """Calls of JSON lines joined with their results by id."""
    calls = L.tool_calls(L.parsed(log_lines(spark, sf_dir)))
    return rounded(calls.withColumn("n", F.get_json_object("input", "$.n").cast("long")).drop("input"))


@query(
    "x10_log_totals",
    """WITH a AS (SELECT conv_id, arg_max(text, turn) AS last, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL), e AS (SELECT * FROM conversations WHERE role = 'assistant' AND turn = 1 AND conv_id % 3 = 0), c AS (SELECT conv_id, count(*) FILTER (role <> 'system') AS n, string_agg('note: ' || text, chr(10) ORDER BY turn) FILTER (role = 'system') AS raw FROM conversations GROUP BY ALL)
    SELECT c.conv_id AS log_id, c.n + CASE WHEN e.conv_id IS NULL THEN 0 ELSE 1 END AS n_events, coalesce(a.n, 0) AS n_calls, length(e.text) + 7 AS input_tokens, CASE WHEN e.conv_id IS NOT NULL THEN 0 END AS output_tokens, CASE WHEN e.conv_id IS NOT NULL THEN 0 END AS cache_creation_tokens, CASE WHEN e.conv_id IS NOT NULL THEN 7 END AS cache_read_tokens,
      CASE WHEN e.conv_id IS NOT NULL THEN 0.5 END AS cost_usd, coalesce(e.turn + 1, 1) AS num_turns, coalesce(nullif(e.text, ''), nullif(a.last, ''), CASE WHEN c.n = 0 THEN raw END, '') AS answer FROM c LEFT JOIN a USING (conv_id) LEFT JOIN e USING (conv_id)""",
)
def log_totals(spark, sf_dir):
    """Tokens, cost, turns and last answers of JSON lines."""
    lines = log_lines(spark, sf_dir)
    return rounded(L.totals(lines, L.parsed(lines)))


@query(
    "x05_balanced_objects",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '{' || text || '} "' WHEN 2 THEN 'second' WHEN 3 THEN text ELSE text || '}' END AS said, doc_id AS n FROM documents WHERE doc_id % 7 <> 0""",
)
def balanced_objects(spark, sf_dir):
    """Objects in texts with other braces around: whole, in prose before another object, fenced, under ``result`` as text or object;
    texts without an object are left out."""
    docs = B.read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[{}`]", " ").alias("plain"), "text")
    object_ = lambda text: F.to_json(F.struct(text.alias("said"), F.col("doc_id").alias("n")))
    kind = F.col("doc_id") % 5
    raw = (
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("no object } here "), F.col("plain")))
        .when(kind == 0, object_(F.col("text")))
        .when(kind == 1, F.concat(F.lit("He said: "), object_(F.concat(F.lit("{"), F.col("text"), F.lit('} "'))), F.lit(' and then {"said": "other"} } {')))
        .when(kind == 2, F.concat(F.col("plain"), F.lit('{"bad": } ```json\n'), object_(F.lit("second")), F.lit("\n``` and more")))
        .when(kind == 3, F.to_json(F.struct(F.concat(F.lit("so "), object_(F.col("text")), F.lit(" }")).alias("result"))))
        .otherwise(F.concat(F.lit('{"result": '), object_(F.concat(F.col("text"), F.lit("}"))), F.lit(', "is_error": false}')))
    )
    read = lambda v: F.array(F.struct(F.try_variant_get(v, "$.said", "string").alias("said"), F.try_variant_get(v, "$.n", "bigint").alias("n")))
    # unpacked from a list, so that the condition on ``n`` does not work out the answer a second time
    return docs.select("doc_id", F.inline_outer(X.once(X.answer_of(raw), read))).where("n is not null")


def _peers(spark, sf_dir, k: int, **terms):
    rows = B.diary(spark, sf_dir).select("doc_id", "user", "text")
    asks = F.col("doc_id") % 20 == 0
    weights = S.term_weights(rows, "doc_id", "text", asks=asks, beside="user", **terms)
    return rounded(S.nearest_to(weights, weights.where(asks), "doc_id", "user", k), 6)


@query("r01_r02_similar_texts")
def similar_texts(spark, sf_dir):
    """The ten nearest diary texts of other users, for texts whose number divides by 20 (terms in two
    texts or more, the limit of terms and the number of neighbours are the operator's).  The stop words are
    English; texts of other languages keep theirs."""
    return _peers(spark, sf_dir, 10)


@query("r02_text_peers")
def text_peers(spark, sf_dir):
    """The same over all terms, those of one text included, with five neighbours."""
    return _peers(spark, sf_dir, 5, min_df=1, max_terms=None)


_dot = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))"


@query(
    "r03_similar_vectors",
    """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m, stddev_pop(CAST(x AS DOUBLE)) AS sd FROM e GROUP BY i),
    z AS (SELECT vec_id, any_value(label) AS label, list((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END ORDER BY i) AS v FROM e JOIN s USING (i) GROUP BY vec_id),
    c AS (SELECT a.vec_id AS query, b.vec_id AS found, list_cosine_similarity(a.v, b.v) AS similarity FROM z a JOIN z b ON a.label <> b.label WHERE a.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, found) AS place FROM c WHERE similarity > 0)
    SELECT query, found, round(similarity, 5) AS similarity, place FROM r WHERE place <= 5""",
)
def similar_vectors(spark, sf_dir):
    """Standardised vectors, the five nearest of other groups, for a stated query set."""
    rows = S.standardised(B.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding").join(B.read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return rounded(S.nearest_vectors(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", "label", 5), 5)


FEATURES = ("click", "view", "error")
DAYS = f"dy AS (SELECT user_id, ms // 86400000 AS day, {', '.join(f'''sum(value) FILTER (event_type = '{f}') AS {f}''' for f in FEATURES)} FROM ev GROUP BY ALL), aq AS (SELECT dy.* FROM dy SEMI JOIN (SELECT user_id, ms // 86400000 AS day FROM ev WHERE event_type = 'purchase') p USING (user_id, day))"


def days_of(ev):
    parts = {kind: F.when(F.col("event_type") == kind, F.col("value")) for kind in FEATURES}
    return D.sums_in_order(ev.withColumn("day", T.day_of(F.col("ms"))), ["user_id", "day"], parts, "event_id")


def asks_of(ev, days):
    return days.join(ev.where("event_type = 'purchase'").select("user_id", T.day_of(F.col("ms")).alias("day")), ["user_id", "day"], "left_semi")


_c = lambda p, f: f"coalesce({p}.{f}, 0)"
_two = lambda p: " + ".join(f"CASE WHEN {_c(p, f)} <> 0 THEN 1 ELSE 0 END" for f in FEATURES)
_norm = lambda p: "sqrt(" + " + ".join(f"pow({_c(p, f)}, 2)" for f in FEATURES) + ")"


@query(
    "r04_similar_days",
    f"""WITH {B.EV}, {DAYS}, c AS (SELECT a.user_id, a.day AS ask_day, b.day, ({' + '.join(f"{_c('a', f)} * {_c('b', f)}" for f in FEATURES)}) / ({_norm('a')} * {_norm('b')}) AS similarity FROM aq a JOIN aq b ON a.user_id = b.user_id AND b.day < a.day WHERE {_two('a')} >= 2 AND {_two('b')} >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ask_day ORDER BY round(similarity, 9) DESC, day) AS place FROM c), {B.PROMPTS},
    lp AS (SELECT user_id, ms // 86400000 AS day, arg_max(desire, (ms, prompt_id)) AS last_desire, arg_max(available, (ms, prompt_id)) AS last_available FROM pr GROUP BY ALL)
    SELECT user_id, ask_day, day, round(similarity, 5) AS similarity, place, last_desire, last_available FROM r LEFT JOIN lp USING (user_id, day) WHERE place <= 5""",
)
@events_of
def similar_days(ev):
    """Earlier days with a prompt, by cosine, each with what its last prompt said."""
    days = days_of(ev)
    asks = asks_of(ev, days)
    found = S.similar_days(asks, asks, list(FEATURES))
    return rounded(found.join(P.last_of_day(B.prompts(ev), ["desire", "available"]), ["user_id", "day"], "left"), 5)


NARRATIVES = """na AS (SELECT user_id, ms // 86400000 AS day, ms, event_id AS tie, CASE WHEN k % 10 = 0 THEN ' ' ELSE 'own ' || CAST(k AS VARCHAR) END AS narrative FROM ev WHERE event_type = 'purchase' AND k % 2 = 0
    UNION ALL SELECT user_id, ms // 86400000, NULL, event_id, CASE WHEN k % 10 = 5 THEN '' ELSE 'day ' || CAST(k AS VARCHAR) END FROM ev WHERE event_type = 'error')"""


@query(
    "j16_narratives",
    f"""WITH {B.EV}, {B.PROMPTS}, {NARRATIVES}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, ms ORDER BY tie) AS t FROM na)
    SELECT prompt_id, CASE WHEN e.tie IS NOT NULL THEN CASE WHEN trim(e.narrative) <> '' THEN e.narrative END ELSE CASE WHEN trim(d.narrative) <> '' THEN d.narrative END END AS narrative
    FROM pr LEFT JOIN f e ON e.t = 1 AND e.user_id = pr.user_id AND e.ms = pr.ms LEFT JOIN f d ON d.t = 1 AND d.ms IS NULL AND d.user_id = pr.user_id AND d.day = pr.ms // 86400000""",
)
@events_of
def narratives(ev):
    """A prompt's narrative by its time, or by its day alone."""
    text = lambda head, blank: F.when(blank, F.lit(" ")).otherwise(F.concat(F.lit(head), F.col("k").cast("string"))).alias("narrative")
    day = T.day_of(F.col("ms")).alias("day")
    own = ev.where("event_type = 'purchase' and k % 2 = 0").select("user_id", day, "ms", F.col("event_id").alias("tie"), text("own ", F.col("k") % 10 == 0))
    daily = ev.where("event_type = 'error'").select("user_id", day, F.lit(None).cast("long").alias("ms"), F.col("event_id").alias("tie"), text("day ", F.col("k") % 10 == 5))
    return P.narratives_for(B.prompts(ev), own.unionByName(daily))


_terms = [f"pow((a.{f} - b.{f}) / greatest(abs(a.{f}), 1.0) + 0 * a.{f}, 2)" for f in FEATURES]


@query(
    "r05_relative_days",
    f"""WITH {B.EV}, {DAYS}, c AS (SELECT a.user_id, a.day AS ask_day, b.day, {' + '.join(f'coalesce({t}, 0)' for t in _terms)} AS total, {' + '.join(f'CASE WHEN {t} IS NOT NULL THEN 1 ELSE 0 END' for t in _terms)} AS shared FROM aq a JOIN dy b ON a.user_id = b.user_id AND b.day < a.day),
    r AS (SELECT *, sqrt(total / shared) AS distance, row_number() OVER (PARTITION BY user_id, ask_day ORDER BY round(sqrt(total / shared), 9), day) AS place FROM c WHERE shared > 0) SELECT user_id, ask_day, day, round(distance, 5) AS distance, place FROM r WHERE place <= 3""",
)
@events_of
def relative_days(ev):
    """R05."""
    days = days_of(ev)
    return rounded(S.relative_distance_days(days, asks_of(ev, days), list(FEATURES)), 5)


@query(
    "r06_r07_j13_j16_cases",
    f"""WITH {B.EV}, {B.PROMPTS}, {DAYS} SELECT prompt_id, 'value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || CASE WHEN available = 'yes' THEN ', available' ELSE ', not available' END || '; ' ||
      CASE WHEN d.click IS NULL AND d.view IS NULL THEN 'no data' ELSE concat_ws('; ', CASE WHEN d.click IS NOT NULL THEN 'click ' || CAST(CAST(floor(d.click) AS BIGINT) AS VARCHAR) END, CASE WHEN d.view IS NOT NULL THEN 'view ' || CAST(CAST(floor(d.view) AS BIGINT) AS VARCHAR) END) END AS line
    FROM pr LEFT JOIN dy d ON d.user_id = pr.user_id AND d.day = pr.ms // 86400000 - 1""",
)
@events_of
def cases(ev):
    """A case and what was sensed the day before, as a line."""
    days = days_of(ev).withColumn("day", F.col("day") + 1)
    prompts = B.prompts(ev).withColumn("day", T.day_of(F.col("ms"))).join(days, ["user_id", "day"], "left")
    whole = lambda c: F.floor(c).cast("long")
    sensed = X.rendered({"click": ("click %d", whole(F.col("click"))), "view": ("view %d", whole(F.col("view")))})
    head = F.concat(F.lit("value "), whole(F.col("value")).cast("string"), F.when(F.col("available") == "yes", ", available").otherwise(", not available"), F.lit("; "))
    return prompts.select("prompt_id", F.concat(head, sensed).alias("line"))


@query(
    "a16_a17_a18_day_segments",
    f"""WITH {B.EV}, {B.PROMPTS}, {B.SIGNALS}, s AS (SELECT prompt_id, (hour % 24) // 6 AS segment, modality, n, total FROM pr p JOIN sg ON sg.user_id = p.user_id AND sg.hour BETWEEN p.ms // 3600000 - 24 AND p.ms // 3600000 - 1 AND sg.hour // 24 = p.ms // 86400000),
    g AS (SELECT prompt_id, segment, sum(total) FILTER (modality = 'click') AS walk, sum(total) FILTER (modality = 'view') AS screen, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY ALL)
    SELECT prompt_id, segment, n, round(coalesce(walk, 0), 3) AS walk, round(coalesce(screen, 0), 3) AS screen, CASE WHEN coalesce(walk, 0) < 20 AND coalesce(screen, 0) < 45 THEN 'mixed / low-signal activity' ELSE concat_ws(', ', CASE WHEN walk >= 20 THEN 'physically active' END, CASE WHEN screen >= 45 THEN 'digitally engaged' END) END AS labels FROM g""",
)
@events_of
def day_segments(ev):
    """The day up to the prompt in segments of six hours, with labels of behaviour."""
    slots = P.lookback(B.prompts(ev).select("prompt_id", "user_id", "ms"), B.signals(ev)).where((F.floor(F.col("hour") / 24) == T.day_of(F.col("ms"))) & F.col("n").isNotNull())
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("modality") == kind, F.col("total"))), F.lit(0.0))
    rows = slots.groupBy("prompt_id", F.floor(F.pmod("hour", F.lit(24)) / 6).cast("long").alias("segment")).agg(part("click").alias("walk"), part("view").alias("screen"), F.sum("n").alias("n"))
    labels = F.concat_ws(", ", F.when(F.col("walk") >= 20, "physically active"), F.when(F.col("screen") >= 45, "digitally engaged"))
    return rounded(rows.withColumn("labels", F.when(labels == "", "mixed / low-signal activity").otherwise(labels)), 3)
