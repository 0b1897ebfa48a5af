import json
import random

import pytest

from kinfold.llm import tool_calls as tc
from kinfold.llm.queries import REPLY_SCHEMA, dialogue_reference, op6_tool_calls

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "object"]}, "b": {"type": "array", "items": {"type": "number", "minimum": 0}, "maxItems": 2}}, "additionalProperties": False}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def run(spark, rows):
    return tc.link_tool_calls(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()


def test_linking(spark):
    rows = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", call(("x", "add", {"a": 1.0, "b": [2, 0.5]}), ("y", "add", '{"a": {"$ref": "x"}}'), ("z", "sub", {}))),
        (1, 2, "tool", result("x", {"v": 3.50, "u": "é"})),
        (1, 3, "tool", result("x", "again")),
        (1, 4, "tool", result("q", None)),
        (1, 5, "assistant", call(("x", "add", {"a": 2}), (None, "add", {"b": "no", "c": 1}))),
        (2, 0, "tool", result("x", "other conversation")),
        (2, 1, "assistant", call(("x", "add", {"a": {"$ref": "gone"}}))),
        (3, 0, "user", None),
        (None, 0, "assistant", call(("x", "add", {"a": 1}))),
    ]
    got = {(r["conv_id"], r["turn"], r["pos"]): r for r in run(spark, rows)}
    status = {k: r["status"] for k, r in got.items()}
    assert status == {
        (1, 0, 0): "message", (1, 1, 0): "linked", (1, 1, 1): "no_result", (1, 1, 2): "no_result", (1, 2, 0): "linked", (1, 3, 0): "repeated", (1, 4, 0): "orphan",
        (1, 5, 0): "duplicate", (1, 5, 1): "no_id", (2, 0, 0): "early", (2, 1, 0): "no_result", (3, 0, 0): "message", (None, 0, 0): "no_id",
    }
    assert got[1, 1, 0]["json"] == '{"arguments":{"a":1,"b":[2,0.5]},"id":"x","name":"add","result":{"u":"é","v":3.5}}'
    assert got[1, 1, 0]["errors"] == [] and got[1, 1, 2]["errors"] == ["unknown tool sub"]
    assert got[1, 5, 1]["errors"] == ["$.a: missing", "$.b: not array", "$.c: unknown"]
    assert got[2, 1, 0]["errors"] == ["unknown reference"]
    assert got[1, 0, 0]["json"] == '{"content":"hello","role":"user"}' and got[3, 0, 0]["json"] == '{"content":null,"role":"user"}'
    assert all(r["seq"] is None for r in got.values() if r["kind"] != "call")
    for r in got.values():
        assert tc.canonical(json.loads(r["json"])) == r["json"]


@pytest.mark.parametrize("seed", [1, 2])
def test_order_is_topological(spark, seed):
    rng = random.Random(seed)
    rows, edges = [], {}
    for conv in range(6):
        n = 8
        order = list(range(n)) if conv % 2 else rng.sample(range(n), n)
        for turn, i in enumerate(order):
            refs = [f"c{j}" for j in range(i) if rng.random() < 0.3]
            edges |= {(conv, f"c{i}", r): True for r in refs}
            args = {"a": {"$ref": refs[0]}} if refs else {"a": 1}
            edges = {k: v for k, v in edges.items() if not (k[0] == conv and k[1] == f"c{i}" and k[2] != (refs or [None])[0])}
            rows.append((conv, turn, "assistant", call((f"c{i}", "add", args))))
    seq = {(r["conv_id"], r["call_id"]): r["seq"] for r in run(spark, rows)}
    assert all(seq[c, parent] < seq[c, child] for c, child, parent in edges)
    assert all(sorted(v for (c, _), v in seq.items() if c == conv) == list(range(1, 9)) for conv in range(6))


def test_cycles_come_last(spark):
    rows = [(1, 0, "a", call(("x", "add", {"a": {"$ref": "y"}}), ("y", "add", {"a": {"$ref": "x"}}), ("z", "add", {"a": 1}), ("s", "add", {"a": {"$ref": "s"}})))]
    got = {r["call_id"]: r for r in run(spark, rows)}
    assert got["z"]["seq"] == 1 and got["z"]["errors"] == [] and all(got[c]["errors"] == ["cycle"] for c in "xys")


def test_edges(spark):
    rows = [(1, 0, "u", "{broken"), (1, 0, "u", "{broken"), (1, 1, "u", '{"tool_calls": [3, {"id": 5}]}'), (1, 2, "u", '{"a": 1e999}'), (1, 3, "u", call(("n", "add", {"a": float("nan")}))), (2, 0, "u", "x" * 300_000), (1, None, "u", result("n", 1))]
    got = run(spark, rows)
    assert len(got) == 8 and sum(r["json"] == '{"content":"{broken","role":"u"}' for r in got) == 2
    twice = run(spark, [(1, 0, "u", call(("n", "add", {"a": 1})))] * 2)
    assert sorted(r["status"] for r in twice) == ["duplicate", "no_result"]
    assert run(spark, []) == []


@pytest.mark.parametrize("several", [False, True])
def test_large_conversations_are_sorted_by_joins(spark, several):
    """A long chain against the turns, a tree, a cycle; the same with the sort of small ones and, with several references, by rounds."""
    rng = random.Random(9)
    rows = []
    for turn, i in enumerate(rng.sample(range(12), 12)):
        refs = ([{"$ref": f"c{i - 1}"}] if i else []) + ([{"$ref": "c0"}] if several and i > 3 else [])
        rows.append((1, turn, "assistant", call((f"c{i}", "add", {"a": {"all": refs}}))))
    rows += [(2, t, "assistant", call((f"d{t}", "add", {"a": {"$ref": f"d{max(9, t + 1) if t < 9 else 9 + (t == 9)}"}}))) for t in range(11)]
    rows += [(3, t, "assistant", call((f"e{t}", "add", {"a": {"$ref": f"e{2 * t + 1}"}}))) for t in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [{(r["conv_id"], r["call_id"]): (r["seq"], r["errors"]) for r in tc.link_tool_calls(df, TOOLS, small=n).collect()} for n in (5, 50_000)]
    assert got[0] == got[1]
    assert [got[0][1, f"c{i}"][0] for i in range(12)] == list(range(1, 13))
    assert "cycle" in got[0][2, "d0"][1] and got[0][3, "e0"][0] > got[0][3, "e1"][0] > got[0][3, "e3"][0]


def test_query_against_plain_linking(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    turns = {}
    for r in table:
        turns.setdefault((r["conv_id"], r["turn"]), []).append(r)
    got = op6_tool_calls(spark, sf_dir).collect()
    assert len(got) == len(table)
    for r in got:
        (source,) = [x for x in turns[r["conv_id"], r["turn"]] if x["role"] == {"call": "user", "result": "assistant"}.get(r["kind"], "system")]
        answer = [x for x in turns.get((r["conv_id"], r["turn"] + 1), []) if x["role"] == "assistant"]
        if r["kind"] == "call":
            body = json.loads(r["json"])
            assert body["arguments"]["prompt"] == source["text"] and r["status"] == ("linked" if answer else "no_result")
            assert not answer or body["result"] == answer[0]["text"]
            assert [e for e in r["errors"] if e != "unknown reference"] == tc.violations(body["arguments"], REPLY_SCHEMA)


def test_a_long_chain_of_references(spark):
    """Thousands of calls, each of the one after it: one task's sort."""
    n = 5000
    rows = [(1, t, "assistant", call((f"c{t}", "add", {"a": {"$ref": f"c{t + 1}"}} if t + 1 < n else {"a": 1}))) for t in range(n)]
    seq = {r["call_id"]: r["seq"] for r in run(spark, rows)}
    assert all(seq[f"c{t}"] == n - t for t in range(n))


def test_query_sorts_by_references(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").collect()
    turns = {}
    for r in table:
        turns.setdefault(r["conv_id"], set()).add(r["turn"])
    got = {(r["conv_id"], r["turn"]): r for r in op6_tool_calls(spark, sf_dir).collect() if r["kind"] == "call"}
    assert set(got) == {(c, t) for c, ts in turns.items() for t in ts}
    swapped = 0
    for conv, ts in turns.items():
        parent = {t: dialogue_reference(t) for t in ts}
        loose = any(p is not None and p > t and p in ts for t, p in parent.items())
        level = tc._levels_of(sorted(ts), [(t, p) for t, p in parent.items() if p in ts])
        order = sorted(ts, key=lambda t: (level[t], t)) if loose else sorted(ts)  # noqa: B023
        swapped += order != sorted(ts)
        assert [got[conv, t]["seq"] for t in order] == list(range(1, len(ts) + 1))
        assert all(("unknown reference" in got[conv, t]["errors"]) == (p is not None and p not in ts) for t, p in parent.items())
    assert swapped
