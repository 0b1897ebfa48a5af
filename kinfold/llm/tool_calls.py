"""Tool-call linking: calls and results are joined by identifier, ordered, validated and serialised.

Messages are parsed into events: calls (id, tool, arguments, references to other calls), results (the id
of their call) and plain messages. Calls meet results by a hash join on (conversation, id). Calls are
ordered topologically: where every reference points back, the order of the turns is such an order; only
conversations in which one doesn't are sorted by levels, the longest chain of references below each call. A
conversation of up to ``small`` calls is one task's work; larger ones are sorted by joins: by pointer doubling,
in rounds as the logarithm of the longest chain, where no call has several references, else by Kahn's rounds. Arguments are
validated against the tool's JSON schema, and each event is serialised as canonical JSON.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, no needless escapes, and whole floats as integers. NaN and infinities: ValueError."""

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x.is_integer() and abs(x) < 1e16 else x
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON-schema (type, enum, const, required, properties, additionalProperties, items, bounds, lengths, pattern) fails."""
    out = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds

    def is_a(kind: str) -> bool:
        if kind in ("integer", "number"):
            return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
        return isinstance(value, _TYPES[kind])

    if kinds and not any(map(is_a, kinds)):
        return [f"{at}: not {'|'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        out.append(f"{at}: not an allowed value")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            more = known.get(k, schema.get("additionalProperties", True))
            out += [f"{at}.{k}: unknown"] if more is False else violations(v, more, f"{at}.{k}") if isinstance(more, dict) else []
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: out of bounds")
    size = len(value) if isinstance(value, (str, list)) else None
    if size is not None:
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if size < schema.get(low, size) or size > schema.get(high, size):
            out.append(f"{at}: wrong length")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: pattern")
    return out


def references(value) -> list[str]:
    """Ids in ``{"$ref": id}`` anywhere in the arguments, distinct and sorted."""
    if isinstance(value, dict):
        own = {value["$ref"]} if isinstance(value.get("$ref"), str) else set()
        return sorted(own.union(*(references(v) for v in value.values())))
    return sorted(set().union(*(references(v) for v in value))) if isinstance(value, list) else []


def parse_message(conv, turn, role: str | None, text: str | None) -> list[tuple]:
    """Events (kind, id, tool, arguments, content) of one message.

    A JSON object with ``tool_calls`` holds calls {id, name, arguments}; one with ``tool_call_id`` is that
    call's result. Arguments may be an object or its JSON text. Anything else is a plain message.
    """
    try:
        body = json.loads(text) if text and text.lstrip()[:1] == "{" else None
    except (ValueError, RecursionError):
        body = None
    if isinstance(body, dict) and isinstance(body.get("tool_call_id"), str):
        return [("result", body["tool_call_id"], None, None, body.get("content"))]
    if isinstance(body, dict) and isinstance(body.get("tool_calls"), list):
        out = []
        for call in body["tool_calls"]:
            call = call if isinstance(call, dict) else {}
            args = call.get("arguments")
            if isinstance(args, str):
                try:
                    args = json.loads(args)
                except (ValueError, RecursionError):
                    pass
            out.append(("call", call["id"] if isinstance(call.get("id"), str) else None, call["name"] if isinstance(call.get("name"), str) else None, args, None))
        return out
    return [("message", None, None, None, text)]


_EVENT = "conv_id {conv}, turn {turn}, pos int, kind string, call_id string, tool string, refs array<string>, errors array<string>, body string"


def _events(schemas: dict[str, dict], parse: Callable):
    def one(conv, turn, role, text) -> Iterator[tuple]:
        for pos, (kind, call_id, tool, args, content) in enumerate(parse(conv, turn, role, text)):
            errors, refs = [], []
            try:
                if kind == "call":
                    errors = [f"unknown tool {tool}"] if tool not in schemas else violations(args, schemas[tool])
                    refs = references(args)
                    body = canonical(args)
                else:
                    body = canonical({"content": content, "role": role} if kind == "message" else content)
            except (ValueError, RecursionError) as e:
                errors, body = [*errors, f"$: {type(e).__name__}"], "null"
            yield pos, kind, call_id, tool, refs, sorted(errors), body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        types = (pa.int32(), pa.string(), pa.string(), pa.string(), strings, strings, pa.string())
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                at, rows = [], []
                for i in range(part.num_rows):
                    for event in one(*(part.column(c)[i].as_py() for c in range(4))):
                        at.append(i)
                        rows.append(event)
                columns = zip(*rows, strict=True) if rows else [[]] * 7
                take = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), *(pa.array(v, t) for v, t in zip(columns, types, strict=True))],
                    names=["conv_id", "turn", "pos", "kind", "call_id", "tool", "refs", "errors", "body"],
                )

    return run


def _levels_of(calls: list, edges: list[tuple]) -> dict:
    """Kahn's algorithm: the level of each call by (call, parent) edges; a call on a cycle or behind one has none."""
    level, waits, behind = {}, dict.fromkeys(calls, 0), {}
    for call, parent in edges:
        waits[call] += 1
        behind.setdefault(parent, []).append(call)
    ready = [c for c, n in waits.items() if not n]
    level = dict.fromkeys(ready, 0)
    while ready:
        done = ready.pop()
        for call in behind.get(done, ()):
            waits[call] -= 1
            level[call] = max(level.get(call, 0), level[done] + 1)
            if not waits[call]:
                ready.append(call)
    return {c: level[c] for c, n in waits.items() if not n}


def _sorted_whole(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of conversations that are sorted in a task each."""
    rows = nodes.select("conv_id", "call_id", F.lit(None).cast("string").alias("parent")).unionByName(edges)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pairs = list(zip(table["call_id"].to_pylist(), table["parent"].to_pylist(), strict=True))
        calls = [c for c, p in pairs if p is None]
        level = _levels_of(calls, [x for x in pairs if x[1] is not None])
        return pa.table([pa.array([key[0].as_py()] * len(calls), table["conv_id"].type), pa.array(calls, pa.string()), pa.array([level.get(c) for c in calls], pa.int32())], names=["conv_id", "call_id", "level"])

    return rows.groupBy("conv_id").applyInArrow(run, f"conv_id {dict(nodes.dtypes)['conv_id']}, call_id string, level int")


def _doubled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) where every call has one parent at most: each round skips as many parents as were skipped before."""
    key = ["conv_id", "call_id"]
    state = common.cut(nodes.join(edges, key, "left").select(*key, F.col("parent").alias("up"), F.col("parent").isNotNull().cast("int").alias("steps")), "pointers")
    for _ in range(max(1, nodes.count()).bit_length()):
        if state.where("up is not null").isEmpty():
            break
        over = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        state = common.cut(state.join(over, ["conv_id", "up"], "left").select(*key, F.col("next").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "pointers")
    return state.select(*key, F.when(F.col("up").isNull(), F.col("steps")).alias("level"))


def _levels(nodes: DataFrame, edges: DataFrame, small: int) -> DataFrame:
    """(conv_id, call_id, level) for all conversations; level is null on a cycle and behind one."""
    large = common.cut(nodes.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > small).select("conv_id"), "large")
    of = lambda df, how: df.join(large, "conv_id", how)
    out = _sorted_whole(of(nodes, "left_anti"), of(edges, "left_anti"))
    if large.isEmpty():
        return out
    many = common.cut(of(edges, "left_semi").groupBy("conv_id", "call_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id").distinct(), "many")
    nodes, edges = of(nodes, "left_semi"), of(edges, "left_semi")
    out = out.unionByName(_doubled(nodes.join(many, "conv_id", "left_anti"), edges.join(many, "conv_id", "left_anti")))
    return out if many.isEmpty() else out.unionByName(_rounds(nodes.join(many, "conv_id", "left_semi"), edges.join(many, "conv_id", "left_semi")))


def _rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Kahn's algorithm for all graphs at once. nodes: (conv_id, call_id); edges: (conv_id, call_id, parent).

    Returns (conv_id, call_id, level). As many rounds as the longest chain.
    """
    left, done, level = common.cut(nodes, "nodes"), None, 0
    while True:
        blocked = edges.join(left.withColumnRenamed("call_id", "parent"), ["conv_id", "parent"], "left_semi").select("conv_id", "call_id").distinct()
        ready = common.cut(left.join(blocked, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)), "ready")
        if ready.isEmpty():
            rest = left.withColumn("level", F.lit(None).cast("int"))
            return rest if done is None else done.unionByName(rest)
        done = ready if done is None else done.unionByName(ready)
        left = common.cut(left.join(ready.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"), "left")
        level += 1


def _numbers(calls: DataFrame, levels: DataFrame) -> DataFrame:
    """(conv_id, place, seq): numbers from 1 within each conversation, by level, then place; calls without a level in an ordered conversation last.

    Ranges of (conversation, level, place) are sorted on their own, so that one long conversation is many tasks' work.
    """
    level = F.coalesce("level", F.when(F.col("loose"), F.lit(2**31 - 1)).otherwise(F.lit(0)))
    keys = calls.join(levels, ["conv_id", "call_id"], "left").select("conv_id", "place", level.alias("level"))
    keys = common.cut(keys.repartitionByRange("conv_id", "level", "place").withColumn("range", F.spark_partition_id()), "order")
    before = keys.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = before.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), (F.sum("n").over(W.partitionBy("conv_id").orderBy("range")) - F.col("n")).alias("before"))
    number = F.row_number().over(W.partitionBy("conv_id", "range").orderBy("level", "place"))
    numbered = keys.withColumn("number", number).join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return numbered.select("conv_id", "place", (F.col("number") + F.col("before")).cast("int").alias("seq"))


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict], parse: Callable = parse_message, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", small: int = 50_000) -> DataFrame:
    """A row for each event: conv_id, turn, pos, kind, call_id, tool, status, seq, errors, json.

    status of a call: linked, no_result, duplicate (a later call of the same id) or no_id; of a result:
    linked, repeated (a later result of the same call), early (before its call, which it isn't linked
    to) or orphan; of other messages: message. seq numbers the calls of a conversation in topological
    order (from 1; by level and then by turn where a reference points on; calls on a cycle last, with the error ``cycle``); null for other events. errors also
    has ``unknown reference``. json of a linked call holds its result.

    Null texts are messages with a null content; null conversations or turns link with nothing. Rows with
    the same conversation and turn are told apart by their content, equal rows count as duplicates; an
    empty table gives an empty result. Other columns are not read.
    """
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kinds = dict(rows.dtypes)
    raw = rows.mapInArrow(_events(schemas, parse), _EVENT.format(conv=kinds["conv_id"], turn=kinds["turn"]))
    # equal rows get numbers of their own: pos counts on through them
    place = F.struct("turn", "pos", "body", "n")
    equal = ["conv_id", "turn", "pos", "kind", "call_id", "tool", "body"]
    counted = raw.groupBy(*equal).agg(F.first("refs").alias("refs"), F.first("errors").alias("errors"), F.count("*").alias("times"))
    events = common.cut(counted.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times").withColumn("place", place), "events")
    key = ["conv_id", "call_id"]
    calls = events.where("kind = 'call' and conv_id is not null and turn is not null and call_id is not null")
    results = events.where("kind = 'result' and conv_id is not null and turn is not null and call_id is not null")
    firsts = common.cut(calls.groupBy(*key).agg(F.min("place").alias("call_place")), "firsts")
    answered = results.join(firsts, key).where("place.turn > call_place.turn or (place.turn = call_place.turn and place.pos > call_place.pos)")
    linked = answered.groupBy(*key).agg(F.min(F.struct("place", "body")).alias("r")).select(*key, F.col("r.place").alias("result_place"), F.col("r.body").alias("result"))
    parent = firsts.select("conv_id", F.col("call_id").alias("parent"), F.col("call_place").alias("parent_place"))
    refs = calls.join(firsts, key).where("place = call_place").select(*key, "call_place", F.explode("refs").alias("parent"))
    edges = common.cut(refs.join(parent, ["conv_id", "parent"], "left"), "edges")
    lost = edges.where("parent_place is null").select(*key).distinct().withColumn("lost", F.lit(True))
    loose = edges.where("parent_place >= call_place").select("conv_id").distinct()
    nodes = firsts.join(loose, "conv_id", "left_semi").select(*key)
    if loose.isEmpty():
        levels = nodes.withColumn("level", F.lit(0))
    else:
        levels = common.cut(_levels(nodes, edges.where("parent_place is not null").join(loose, "conv_id", "left_semi").select(*key, "parent").distinct(), small), "levels")
    levels = levels.withColumn("loose", F.lit(True))
    known = events.join(firsts, key, "left").join(linked, key, "left").join(levels, key, "left").join(lost, key, "left")
    is_call, is_first = F.col("kind") == "call", F.col("place") == F.col("call_place")
    status = (
        F.when(F.col("kind") == "message", "message")
        .when(is_call & F.col("call_place").isNull(), "no_id")
        .when(is_call & ~is_first, "duplicate")
        .when(is_call, F.when(F.col("result_place").isNull(), "no_result").otherwise("linked"))
        .when(F.col("call_place").isNull(), "orphan")
        .when(F.col("place") == F.col("result_place"), "linked")
        .when(F.col("result_place").isNull() | (F.col("place") < F.col("result_place")), "early")
        .otherwise("repeated")
    )
    stuck = F.coalesce(is_call & is_first & F.col("loose") & F.col("level").isNull(), F.lit(False))
    more = F.filter(F.array(F.when(stuck, F.lit("cycle")), F.when(is_call & is_first & F.col("lost"), F.lit("unknown reference"))), lambda x: x.isNotNull())
    quoted = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    of_result = F.when(F.col("status") == "linked", F.concat(F.lit(',"result":'), "result")).otherwise(F.lit(""))
    of_call = F.concat(F.lit('{"arguments":'), "body", F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("tool"), of_result, F.lit("}"))
    text = F.when(is_call, of_call).when(F.col("kind") == "result", F.concat(F.lit('{"content":'), "body", F.lit(',"tool_call_id":'), quoted("call_id"), F.lit("}"))).otherwise(F.col("body"))
    order = _numbers(events.where("kind = 'call'").select(*key, "place"), levels).withColumnsRenamed({"conv_id": "c", "place": "p"})
    out = known.withColumn("status", status).join(order, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left")
    return out.select("conv_id", "turn", "pos", "kind", "call_id", "tool", "status", "seq", F.array_sort(F.concat("errors", more)).alias("errors"), text.alias("json"))
