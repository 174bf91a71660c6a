"""Conversation logs as JSON lines: tool calls joined with their results by id, totals of use, last answers.

A line is an object with a ``type``: *assistant* and *user* lines hold a message of content blocks, a *result* line
ends a log with its answer and its use of tokens.  Lines are VARIANT here, so blocks of any shape pass through, and
everything is a join or a grouping over lines and blocks, however long a log is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed value: characters kept of a tool's result
RESULT_CHARS = 2000


def parsed(lines: DataFrame) -> DataFrame:
    """(log_id, line_no, kind, v) of the lines that are JSON objects; lines: log_id, line_no, line."""
    v = F.try_parse_json(F.trim("line"))
    rows = lines.select("log_id", "line_no", v.alias("v")).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    return rows.select("log_id", "line_no", F.coalesce(_text("v", "$.type"), F.lit("")).alias("kind"), "v")


def _text(v: str, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def blocks(events: DataFrame, kind: str) -> DataFrame:
    """(log_id, line_no, block_no, type, b) of the content blocks of messages; content that is no list has none."""
    content = F.try_variant_get("v", "$.message.content", "array<variant>")
    rows = events.where(F.col("kind") == kind).select("log_id", "line_no", F.posexplode(content).alias("block_no", "b"))
    return rows.select("log_id", "line_no", "block_no", F.coalesce(_text("b", "$.type"), F.lit("")).alias("type"), "b")


def _said(block: str) -> Column:
    """A result's content: a text, the texts of a list of blocks, or JSON of anything else; cut at RESULT_CHARS."""
    listed = F.try_variant_get(block, "$.content", "array<variant>")
    of_text = F.filter(listed, lambda x: F.try_variant_get(x, "$.type", "string") == "text")
    joined = F.array_join(F.transform(of_text, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))), " ")
    return F.substring(F.coalesce(F.when(listed.isNotNull(), joined), _text(block, "$.content"), F.lit("")), 1, RESULT_CHARS)


def tool_calls(events: DataFrame) -> DataFrame:
    """(log_id, call_no, id, name, input, result): calls in the order of the log, with the input as JSON and the result of their id,
    wherever in the log it stands; of several the last, without any an empty text.  Calls without an id share the empty one."""
    id_ = lambda path: F.coalesce(_text("b", path), F.lit(""))
    calls = blocks(events, "assistant").where("type = 'tool_use'")
    order = Window.partitionBy("log_id").orderBy("line_no", "block_no")
    given = F.coalesce(F.to_json(F.try_variant_get("b", "$.input", "variant")), F.lit("{}"))
    calls = calls.select("log_id", F.row_number().over(order).alias("call_no"), id_("$.id").alias("id"), F.coalesce(_text("b", "$.name"), F.lit("")).alias("name"), given.alias("input"))
    results = blocks(events, "user").where("type = 'tool_result'").select("log_id", "line_no", "block_no", id_("$.tool_use_id").alias("id"), _said("b").alias("said"))
    last = results.groupBy("log_id", "id").agg(F.max_by("said", F.struct("line_no", "block_no")).alias("said"))
    return calls.join(last, ["log_id", "id"], "left").select("log_id", "call_no", "id", "name", "input", F.coalesce("said", F.lit("")).alias("result"))


def totals(lines: DataFrame, events: DataFrame) -> DataFrame:
    """One row a log: n_events, n_calls, input_tokens (those read from the cache included), output_tokens, cache_creation_tokens,
    cache_read_tokens, cost_usd, num_turns and answer.

    The last result line counts; without one the numbers are null and turns 1.  The answer is the result's text, or else the last
    text of an assistant, or else, where no line is an object, the log as it is.
    """
    number = lambda path, kind: F.try_variant_get("v", path, kind)
    tokens = {n: F.coalesce(number(f"$.usage.{path}", "bigint"), F.lit(0)) for n, path in (("i", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_creation_tokens", "cache_creation_input_tokens"), ("cache_read_tokens", "cache_read_input_tokens"))}
    ended = F.struct(
        (tokens["i"] + tokens["cache_read_tokens"]).alias("input_tokens"), *(tokens[n].alias(n) for n in list(tokens)[1:]), F.coalesce(number("$.total_cost_usd", "double"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(number("$.num_turns", "bigint"), F.lit(1)).alias("num_turns"), F.coalesce(_text("v", "$.result"), F.lit("")).alias("answer"),
    )
    counted = events.groupBy("log_id").agg(F.count("*").alias("n_events"), F.max_by(F.when(F.col("kind") == "result", ended), F.when(F.col("kind") == "result", F.col("line_no"))).alias("end"))
    spoken = blocks(events, "assistant")
    told = spoken.groupBy("log_id").agg(F.count_if(F.col("type") == "tool_use").alias("n_calls"), F.max_by(F.when(F.col("type") == "text", F.coalesce(_text("b", "$.text"), F.lit(""))), F.when(F.col("type") == "text", F.struct("line_no", "block_no"))).alias("last"))
    # a log without any object is given back; the others' lines are not gathered
    raw = lines.join(events.select("log_id").distinct(), "log_id", "left_anti").groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("line", F.lit("")).alias("line")))), lambda x: x["line"]), "\n").alias("raw"))
    out = lines.select("log_id").distinct().join(counted, "log_id", "left").join(told, "log_id", "left").join(raw, "log_id", "left")
    filled = lambda c: F.when(c != "", c)
    return out.select(
        "log_id", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), *(F.col(f"end.{c}").alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "cost_usd")),
        F.coalesce("end.num_turns", F.lit(1)).alias("num_turns"), F.coalesce(filled(F.col("end.answer")), filled(F.col("last")), F.col("raw"), F.lit("")).alias("answer"),
    )
