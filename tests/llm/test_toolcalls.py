from __future__ import annotations

import json

from pyspark.sql import functions as F

from panelloom.llm import toolcalls
from panelloom.llm.queries import QUERIES
from tests.llm.helpers import rows

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
TOOLS = "name string, types map<string,string>, required array<string>"
KIND = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}


def linked(spark, calls, results=(), tools=(("f", {"a": "integer", "b": "number", "c": "array"}, ["a"]),)):
    got = toolcalls.link_calls(spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(results), RESULTS), spark.createDataFrame(list(tools), TOOLS))
    return {(r["conv_id"], r["call_id"]): r for r in rows(got)}


def plain_errors(arguments, tool):
    if tool is None:
        return ["unknown tool"]
    try:
        a = json.loads(arguments)
    except (TypeError, ValueError):
        a = None
    if not isinstance(a, dict):
        return ["arguments are no object"]
    out = [f"missing argument {n}" for n in sorted(set(tool[2]) - set(a))]
    for n in sorted(a):
        if n not in tool[1]:
            out.append(f"unknown argument {n}")
        elif KIND[type(a[n])] != tool[1][n] and not (tool[1][n] == "number" and type(a[n]) is int):
            out.append(f"wrong type {n}")
    return out


def test_arguments_against_a_plain_check(spark):
    tool = ("f", {"a": "integer", "b": "number", "c": "array", "d": "boolean", "e": "object", "g": "string"}, ["a", "g"])
    cases = ['{"a":1,"g":"x"}', '{"g":"x"}', "{}", "[]", "null", "", "{bad", None, '{"a":1.5,"g":2}', '{"a":true,"g":null}', '{"b":2,"a":1,"g":"","zz":0}', '{"e":{"y":1,"x":[2]},"a":3,"g":"é\\n\\"","c":[],"d":false,"b":0.5}']
    got = linked(spark, [(1, i, f"k{i}", "f", c, []) for i, c in enumerate(cases)] + [(1, 99, "u", "nope", "{}", None)], tools=[tool])
    for i, c in enumerate(cases):
        r = got[1, f"k{i}"]
        assert r["errors"] == plain_errors(c, tool), c
        assert r["valid"] == (not r["errors"])
        try:
            body = json.loads(c)
        except (TypeError, ValueError):
            body = None
        assert json.loads(r["json"]) == {"arguments": body, "id": f"k{i}", "name": "f", "result": None}
    assert got[1, "u"]["errors"] == ["unknown tool"]
    assert got[1, "k11"]["json"].startswith('{"arguments":{"a":3,"b":0.5,"c":[],"d":false,"e":{"x":[2],"y":1},"g":"é\\n\\""},"id":"k11"')


def test_levels_cycles_and_lost_dependencies(spark):
    deps = {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["c", "lost"], "x": ["y"], "y": ["x"], "z": ["y", "a"], "s": ["s"], "n": None}
    got = linked(spark, [(1, i, k, "f", '{"a":1}', d) for i, (k, d) in enumerate(deps.items())] + [(2, 0, "b", "f", '{"a":1}', ["a"])])
    assert {k: got[1, k]["level"] for k in deps} == {"a": 0, "b": 1, "c": 2, "d": 3, "x": None, "y": None, "z": None, "s": None, "n": 0}
    assert got[1, "d"]["errors"] == ["unknown dependency lost"] and got[1, "x"]["errors"] == ["cyclic dependency"]
    assert got[2, "b"]["level"] == 0 and got[2, "b"]["errors"] == ["unknown dependency a"]


def test_a_long_chain_is_no_cycle(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "APART", 3)
    got = linked(spark, [(1, i, f"k{i:02d}", "f", '{"a":1}', [f"k{i - 1:02d}"] if i else []) for i in range(12)])
    assert [got[1, f"k{i:02d}"]["level"] for i in range(12)] == list(range(12))


def test_links_repeats_nulls_and_empty(spark):
    calls = [(1, 5, "a", "f", '{"a":2}', []), (1, 3, "a", "f", '{"a":1}', []), (1, 3, "a", "f", '{"a":1}', []), (None, 1, "a", "f", "{}", []), (1, 1, None, "f", "{}", [])]
    results = [(1, 9, "a", "late"), (1, 4, "a", "first"), (1, 2, "gone", None), (None, 1, "a", "x"), (1, 1, None, "x")]
    got = linked(spark, calls, results)
    assert set(got) == {(1, "a"), (1, "gone"), (None, "a"), (1, None)}
    loose = rows(toolcalls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame([], TOOLS)).filter("conv_id IS NULL OR call_id IS NULL"))
    assert sorted((r["conv_id"] or 0, r["call_id"] or "", r["n_calls"], r["n_results"], r["status"]) for r in loose) == [(0, "a", 0, 1, "unlinked"), (0, "a", 1, 0, "unlinked"), (1, "", 0, 1, "unlinked"), (1, "", 1, 0, "unlinked")]
    assert all("cyclic dependency" not in r["errors"] for r in loose)
    a, gone = got[1, "a"], got[1, "gone"]
    assert (a["turn"], a["n_calls"], a["result_turn"], a["n_results"], a["status"], a["valid"]) == (3, 3, 4, 2, "answered", True)
    assert json.loads(a["json"])["result"] == "first"
    assert (gone["status"], gone["valid"], gone["n_calls"], gone["errors"]) == ("orphan", False, 0, [])
    assert linked(spark, [], []) == {}


def test_one_conversation_with_a_third_of_all_calls(spark):
    calls = [(1, i, f"k{i}", "f", '{"a":1}', [f"k{i // 2}"] if i else []) for i in range(1_000)] + [(i, 0, "k0", "f", '{"a":1}', []) for i in range(2, 2_002)]
    got = linked(spark, calls)
    assert len(got) == 3_000 and got[1, "k999"]["level"] == 10 and got[1, "k1"]["level"] == 1


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    turns = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    every = rows(QUERIES["op7_tool_calls"](spark, folder))
    got = {(r["conv_id"], r["call_id"]): r for r in every if r["status"] != "message"}
    said = sorted((r["conv_id"], r["turn"], json.loads(r["json"])["content"]) for r in every if r["status"] == "message")
    assert said == sorted((r.conv_id, r.turn, r.text) for r in turns if r.role != "assistant" and not (r.role == "user" and r.turn > 0))
    whole = {(r.conv_id, f"call_{r.turn}"): r.text for r in turns if r.role == "assistant"}
    held = lambda a: a.get("query", a.get("text", a.get("notes")))
    assert all(held(json.loads(got[k]["json"])["arguments"]) == t for k, t in whole.items())
    calls = {(r.conv_id, f"call_{r.turn}") for r in turns if r.role == "assistant"}
    results = {(r.conv_id, f"call_{r.turn - 1}"): r.text for r in turns if r.role == "user" and r.turn > 0}
    assert set(got) == calls | set(results)
    tools = {n: (n, t, r) for n, t, r in toolcalls.TOOLS}
    for k, r in got.items():
        body = json.loads(r["json"])
        assert body["result"] == results.get(k) and body["id"] == k[1]
        assert r["status"] == ("orphan" if k not in calls else "answered" if k in results else "unanswered")
        if k in calls:
            assert [e for e in r["errors"] if "dependency" not in e] == plain_errors(json.dumps(body["arguments"]), tools[r["name"]])


def test_extra_columns(spark):
    odd = spark.createDataFrame([(1, 0, "assistant", "a b c"), (1, 1, "user", None), (None, None, None, None)], "conv_id long, turn long, role string, text string").withColumns({"n": F.lit("x"), "w": F.lit(1), "call_id": F.lit(2)})
    assert sorted((r["call_id"] or "", r["status"]) for r in rows(toolcalls.link_conversations(odd))) == [("", "message"), ("call_0", "answered")]
