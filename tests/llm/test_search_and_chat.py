"""Exact search, suffix sorting and tool chats."""

import json
import math
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from tagloom.llm import chat, mtree
from tagloom.llm.suffixes import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 4))
def test_suffix_array(text, times):
    text = text * times
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], "x") for i in range(400)]
    rows += [(1000 + i, rows[7][1], "copy") for i in range(150)]
    rows += [(200, rows[200][1], "again"), (2000, None, None), (2100, [], "nothing"), (2200, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (2300, [math.nan] * 6, ""), (None, [1.0] * 6, ""), (2400, [0.5, 0.5], "short")]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, tree string").repartition(4)).collect()
    import numpy as np

    vectors = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in vectors if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:10]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<float>, tree string")
    assert [(r.query_id, r["rank"]) for r in mtree.top_k(few).collect()] == [(0, 1), (0, 2)]
    assert mtree.top_k(few.limit(0)).count() == 0


CALLS = "conv_id bigint, turn bigint, call_id string, after string, name string, arguments string, level string"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string"


def test_chat(spark):
    calls = [
        (1, 0, "a", None, "lookup", '{"query": "q", "first": 3}', ""), (1, 2, "b", "a", "measure", '{"words":1,"chars":2}', ""), (1, 4, "c", "b", "quote", '{"text":"x\\"y"}', ""),
        (1, 6, "d", "gone", "lookup", '{"first": "3"}', ""), (1, 8, "e", "f", "nothing", "{}", ""), (1, 9, "f", "e", "quote", "[1]", ""), (2, 1, "g", None, "quote", None, ""),
        (2, 3, "h", "g", "quote", '{"text":"' + "y" * 2001 + '","more":1}', ""), (1, 0, "a", None, "lookup", '{"query": "q", "first": 3}', ""), (None, 1, "i", None, "quote", "{}", ""),
    ]
    calls += [(3, i, f"n{i}", f"n{i - 1}", "measure", '{"chars":1,"words":1}', "") for i in range(40)]
    results = [(1, 1, "a", "answer"), (1, 5, "a", "late"), (1, 3, "b", None), (9, 9, "zzz", "orphan"), (1, 1, None, "none")]
    got = {r.call_id: r for r in chat.format_tool_chat(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)).collect()}
    assert len(got) == 8 + 40
    assert [got[c].level for c in "abcdefgh"] == [0, 1, 2, 0, None, None, 0, 1]
    assert [got[f"n{i}"].level for i in range(40)] == list(range(40)) == [got[f"n{i}"].position for i in range(40)]
    assert [got[c].position for c in "adbcef"] == list(range(6))
    assert [got[c].linked for c in "abcd"] == [True, True, False, False]
    assert [got[c].faults for c in "abcdefgh"] == ["", "", "", "first no integer; query missing", "unknown tool", "no object", "no object", "text too long; unknown argument"]
    assert got["a"].message == '{"arguments":{"first":3,"query":"q"},"id":"a","name":"lookup","result":"answer"}'
    for c in "abc":
        assert json.dumps(json.loads(got[c].message), separators=(",", ":"), sort_keys=True) == got[c].message
    none = chat.format_tool_chat(spark.createDataFrame([], CALLS), spark.createDataFrame(results, RESULTS))
    assert none.count() == 0
    assert not re.search("Python|Arrow|Pandas", none._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("role", ["system", "tool", None])
def test_other_roles_are_context(spark, role):
    talk = spark.createDataFrame([(1, 0, role, "x"), (1, 1, "user", None), (1, 2, "assistant", "y"), (None, 1, "user", "z")], "conv_id bigint, turn bigint, role string, text string")
    got = chat.format_tool_chat(*chat.tool_messages(talk)).collect()
    assert [(r.turn, r.linked) for r in got] == [(1, True)]


def test_chat_keeps_whole_texts(spark):
    texts = [(0, "system", "s" * 150), (1, "user", "a" * 300), (2, "assistant", "r" * 90), (3, "user", "b" * 301), (5, "user", "c" * 302), (7, "user", "d" * 2002), (8, None, 'said "so"'), (9, "system", None)]
    talk = spark.createDataFrame([(1, *row) for row in [*texts, texts[0]]], "conv_id bigint, turn bigint, role string, text string")
    rows = chat.format_tool_chat(*chat.tool_messages(talk), context=chat.context_messages(talk)).collect()
    assert sorted(r.turn for r in rows) == [0, 1, 3, 5, 7, 8, 9] and sorted(r.position for r in rows) == list(range(7))
    got = {r.turn: json.loads(r.message) for r in rows}
    assert (got[1]["arguments"]["query"], got[3]["arguments"]["text"], got[5]["arguments"]["text"], got[7]["arguments"]["text"]) == ("a" * 300, "b" * 301, "c" * 302, "d" * 2002)
    assert got[1]["result"] == "r" * 90
    assert [(got[t]["role"], got[t]["content"]) for t in (0, 8, 9)] == [("system", "s" * 150), (None, 'said "so"'), ("system", "")]
    faults = {r.turn: r.faults for r in rows}
    assert faults == {0: "", 1: "query too long", 3: "", 5: "", 7: "chars too large; text too long", 8: "", 9: ""}
    for r in rows:
        assert json.dumps(json.loads(r.message), separators=(",", ":"), sort_keys=True) == r.message
