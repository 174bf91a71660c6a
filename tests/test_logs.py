"""Conversation logs of JSON lines, JSON inside texts, the prefix tree."""

import json
import re

import pytest
from pyspark.sql import functions as F

from lapwing.functions import texts as X
from lapwing.operators import logs as L


def lines_of(spark, *logs):
    rows = [(k, n, line if line is None or isinstance(line, str) else json.dumps(line)) for k, log in enumerate(logs) for n, line in enumerate(log)]
    return spark.createDataFrame(rows, "log_id int, line_no int, line string")


def say(*blocks, kind="assistant"):
    return {"type": kind, "message": {"content": list(blocks)}}


def call(i, name="look", **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(i, content):
    return say({"type": "tool_result", "tool_use_id": i, "content": content}, kind="user")


def test_calls_meet_results_by_id_wherever_they_stand(spark):
    log = [
        result("b", "early"), say({"type": "text", "text": "first"}, call("a", x=1), "stray", call("b", "walk")), "no json {", None, "", "[1, 2]", result("a", [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}, 5]),
        say(call("c")), result("b", "late"), result("z", "nobody's"), {"type": "user", "message": {"content": "just text"}}, {"type": "assistant"}, say({"type": "tool_use", "name": "nameless"}), result("c", {"k": [1, "x"]}), result("a", "y" * 3000),
    ]
    rows = L.tool_calls(L.parsed(lines_of(spark, log))).orderBy("call_no").collect()
    assert [(r.call_no, r.id, r.name, json.loads(r.input)) for r in rows] == [(1, "a", "look", {"x": 1}), (2, "b", "walk", {}), (3, "c", "look", {}), (4, "", "nameless", {})]
    assert [r.result for r in rows] == ["y" * 2000, "late", '{"k":[1,"x"]}', ""]


def test_totals_and_answers(spark):
    end = {"type": "result", "result": "the end", "num_turns": 3, "total_cost_usd": 0.25, "usage": {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 7, "cache_creation_input_tokens": 2}}
    logs = [[say({"type": "text", "text": "hm"}), {"type": "result", "result": "earlier"}, end], [say({"type": "text", "text": "one"}), say({"type": "text", "text": "two"}, call("a"))], ["plain", "words"], [{"type": "result", "result": "", "usage": "none"}, say({"type": "text", "text": "still"})], [None]]
    lines = lines_of(spark, *logs)
    rows = {r.log_id: r for r in L.totals(lines, L.parsed(lines)).collect()}
    a = rows[0]
    assert (a.n_events, a.input_tokens, a.output_tokens, a.cache_creation_tokens, a.cache_read_tokens, a.cost_usd, a.num_turns, a.answer) == (3, 17, 5, 2, 7, 0.25, 3, "the end")
    assert (rows[1].answer, rows[1].n_calls, rows[1].input_tokens, rows[1].num_turns) == ("two", 1, None, 1)
    assert (rows[2].answer, rows[2].n_events) == ("plain\nwords", 0) and (rows[3].answer, rows[3].input_tokens) == ("still", 0) and rows[4].answer == ""
    assert L.totals(lines.limit(0), L.parsed(lines.limit(0))).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1}', {"a": 1}), ('  {"a": {"b": 2}}\n', {"a": {"b": 2}}), ('so {"a": 1} and {"a": 2}', {"a": 1}), ('so {"a": "}{\\"}"} }', {"a": '}{"}'}), ('x {"a": "\\\\"} y', {"a": "\\"}), ("none", None), ("", None), (None, None),
        ('{"a": 1', None), ('} {"a": [1, {"b": "{"}]} {', {"a": [1, {"b": "{"}]}), ('say ```json\n{"a": 3}\n``` {"a": 4}', {"a": 3}), ('```\n{"a": 3}```', {"a": 3}), ('```py\nx = {1}\n``` no', None), ('{bad} ```json\nnot json\n``` {"a": 1}', None),
        ('{"result": "text {\\"a\\": 5} more", "cost": 1}', {"a": 5}), ('{"result": {"a": 6}}', {"a": 6}), ('{"result": "no object"}', {"result": "no object"}), ('"quoted {" {"a": 1}', None), ('5 of {"a": 1}', {"a": 1}), ('5] {"a": 1}', {"a": 1}), ("[1, 2]", [1, 2]), ("{}", {}),
    ],
)
def test_json_in_texts(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.to_json(X.answer_of(F.col("t"))).alias("j")).first().j
    assert (None if got is None else json.loads(got)) == want


def test_long_texts_are_folded_in_time(spark):
    import time

    began = time.time()
    text = "{" * 3 + '"x' * 100_000 + "}" * 5
    assert spark.createDataFrame([(text,)], "t string").select(X.first_object(F.col("t")).alias("t")).first().t is not None or time.time() - began < 30


def test_prefix_tree_finds_the_longest():
    words = [p for ps in X.CATEGORIES.values() for p in ps.split()] + ["hop", "hopeless", "a"]
    tree = re.compile(X.prefix_tree(words))
    for text in ("hopeful", "hopelessly", "hops", "painting", "a", "awesome", "zebra", "cry", "crying", "the"):
        want = max((w for w in words if text.startswith(w)), key=len, default=None)
        hit = tree.match(text)
        assert (hit.group() if hit else None) == want


def test_profile_counts_by_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(["Painful hopeless HOPE calmly", "talk\tthoughtful workshop\nworked, (sad) crying", "hopefully appointment-free supporter", None, "", "ça playing hikes bikes yoga!"])]
    got = {r.doc_id: r for r in X.lexicon_profile(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for k, t in rows:
        words = (t or "").lower().split()
        for name, ps in X.CATEGORIES.items():
            assert got[k][f"{name}_count"] == sum(any(w.startswith(p) for p in ps.split()) for w in words)


def test_answers_are_worked_out_once(spark):
    """What is parsed or searched is named once in the plan for a text and once for a text under ``result``, also by the condition on it."""
    from lapwing.plans.retrieval import balanced_objects

    plan = balanced_objects(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and plan.count("no object } here") == 1 and plan.count("aggregate(") == 2
