"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON.

Messages are (conv_id, turn, role, text).  An assistant message that is a JSON object with a list
"tool_calls" makes calls: {"id", "name", "arguments" (an object), "after" (ids it depends on)}.  A message
of role "tool" that is a JSON object with "tool_call_id" gives that call's result in "content".
Other messages are plain and make neither.

Calls and results meet in one hash join by (conv_id, identifier).  Of several calls or results with one
identifier the first (by turn and position) counts; the others are counted in n_repeats.  A result
without a call is kept as an orphan (name null).  Levels order the calls topologically: 0 without
dependencies, else one more than the highest of them.  Chains of single dependencies are contracted
by pointer doubling, so a conversation of any length takes a logarithmic number of joins; calls with
several dependencies are then settled in rounds.  Dependencies on unknown ids are named in errors and
ignored; calls on or behind a cycle have no level.  No conversation is ever gathered in one task.

Only what can be written canonically is JSON here: NaN and infinite numbers, and values nested deeper than MAX_DEPTH,
make a message plain.  Ids and names that are no strings count as their canonical JSON; a name that is no
string is an unknown tool.  Lone surrogates, which UTF-8 doesn't have, stand as their escapes.

Schemas are {tool: {parameter: (type, required)}} and travel with the tasks; they are few by contract
(at most MAX_SCHEMA parameters, checked).  Null texts and JSON that does not parse are plain
messages.  Null conv_ids form a conversation of their own.  Canonical JSON: keys sorted, no
white space, UTF-8 unescaped.  An empty table gives an empty one; long texts need no more than themselves; other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop, fitted, frugal, materialize, size_of, table

MAX_SCHEMA = 10_000
TYPES = {"string": str, "object": dict, "array": list, "boolean": bool}
CALL = "conv_id long, call_id string, turn long, pos int, name string, arguments string, after array<string>, errors array<string>"
RESULT = "conv_id long, call_id string, turn long, content string"
LINKED = "conv_id long, call_id string, turn long, result_turn long, level int, valid boolean, errors string, n_repeats int, json string"


MAX_DEPTH = 200
_LONE = re.compile("[\ud800-\udfff]")


def escaped(s: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", s)


def canonical(value) -> str:
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _name(value) -> str:
    return escaped(value) if isinstance(value, str) else canonical(value)


def _fits(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, TYPES[kind])


def violations(name, arguments, schemas: dict) -> list[str]:
    """What the arguments lack against the tool's schema, sorted."""
    if not isinstance(name, str) or name not in schemas:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    schema = schemas[name]
    out = [f"{escaped(p)}: unknown" for p in arguments if p not in schema]
    for p, (kind, required) in schema.items():
        if p not in arguments:
            if required:
                out.append(f"{p}: missing")
        elif not _fits(arguments[p], kind):
            out.append(f"{p}: not {kind}")
    return sorted(out)


def _refuse(constant: str):
    raise ValueError(f"{constant} is no JSON")


def _finite(digits: str) -> float:
    x = float(digits)
    return x if math.isfinite(x) else _refuse(digits)


def _deep(value) -> bool:
    """Whether value is nested deeper than MAX_DEPTH."""
    level = [value]
    for _ in range(MAX_DEPTH):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return False
    return True


def _object(text) -> dict | None:
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        found = json.loads(text, parse_constant=_refuse, parse_float=_finite)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) and not _deep(found) else None


def calls_of(messages: DataFrame, schemas: dict) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for conv, turn, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "text"))):
                calls = (_object(text) or {}).get("tool_calls")
                for pos, c in enumerate(calls if isinstance(calls, list) else []):
                    if not isinstance(c, dict) or c.get("id") is None:
                        continue
                    args = c.get("arguments", {})
                    after = [_name(x) for x in c.get("after") or []] if isinstance(c.get("after") or [], list) else []
                    rows.append({"conv_id": conv, "call_id": _name(c["id"]), "turn": turn, "pos": pos, "name": None if c.get("name") is None else _name(c["name"]), "arguments": canonical(args), "after": sorted(set(after)), "errors": violations(c.get("name"), args, schemas)})
            yield pa.RecordBatch.from_pylist(rows, schema=_CALL)

    return messages.where("role = 'assistant'").select("conv_id", "turn", "text").mapInArrow(frugal(run), CALL)


def results_of(messages: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for conv, turn, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "text"))):
                found = _object(text) or {}
                if found.get("tool_call_id") is not None:
                    rows.append({"conv_id": conv, "call_id": _name(found["tool_call_id"]), "turn": turn, "content": canonical(found.get("content"))})
            yield pa.RecordBatch.from_pylist(rows, schema=_RESULT)

    return messages.where("role = 'tool'").select("conv_id", "turn", "text").mapInArrow(frugal(run), RESULT)


_STRINGS = pa.list_(pa.string())
_CALL = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("turn", pa.int64()), ("pos", pa.int32()), ("name", pa.string()), ("arguments", pa.string()), ("after", _STRINGS), ("errors", _STRINGS)])
_RESULT = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("turn", pa.int64()), ("content", pa.string())])


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """v, level of every node (v string); edges: v, parent, both among nodes.  Null on and behind cycles."""
    edges = edges.where("v IS NOT NULL").distinct()
    ways = edges.groupBy("v").agg(F.count("*").alias("ways"), F.min("parent").alias("only"))
    state = nodes.select("v").distinct().join(ways, "v", "left").select("v", F.when(F.col("ways") == 1, F.col("only")).otherwise(F.col("v")).alias("anchor"), F.when(F.col("ways") == 1, 1).otherwise(0).alias("dist"), (F.coalesce("ways", F.lit(0)) > 1).alias("joins"))
    state = materialize(state, "levels")
    moving = None
    while True:  # anchor: the ancestor 2^n steps up, or the chain's beginning
        up = state.select(F.col("v").alias("anchor"), F.col("anchor").alias("a2"), F.col("dist").alias("d2"))
        state = materialize(state.join(up, "anchor", "left").select("v", F.col("a2").alias("anchor"), (F.col("dist") + F.col("d2")).alias("dist"), "joins"), "levels")
        ends = state.select(F.col("v").alias("anchor"), (F.col("dist") == 0).alias("ended"))
        left = state.join(ends, "anchor").where("NOT ended").count()
        if left == 0 or left == moving:  # none, or only those on and behind cycles
            break
        moving = left
    roots = state.where("dist = 0").select(F.col("v").alias("anchor"), F.when(~F.col("joins"), 0).alias("level"))
    roots = materialize(roots, "roots")
    place = state.join(roots.select("anchor"), "anchor").select("v", "anchor", "dist")
    several = materialize(edges.join(state.where("joins").select("v"), "v").join(place.select(F.col("v").alias("parent"), "anchor", "dist"), "parent", "left"), "several")
    open_ = roots.where("level IS NULL").count()
    while open_:
        known = several.join(roots.withColumnRenamed("level", "base"), "anchor", "left")
        done = known.groupBy("v").agg(F.max(F.col("base") + F.col("dist") + 1).alias("new"), F.max(F.col("base").isNull()).alias("waits")).where("NOT waits")
        roots = materialize(roots.join(done.select(F.col("v").alias("anchor"), "new"), "anchor", "left").select("anchor", F.coalesce("level", "new").alias("level")), "roots")
        now = roots.where("level IS NULL").count()
        if now == open_:
            break
        open_ = now
    found = place.join(roots, "anchor").select("v", (F.col("level") + F.col("dist")).alias("level"))
    return nodes.select("v").distinct().join(found, "v", "left")


def link_tool_calls(messages: DataFrame, schemas: dict) -> DataFrame:
    """One row for each call and each orphan result: conv_id, call_id, turn, result_turn, level, valid,
    errors (joined by "; "), n_repeats, json."""
    if sum(map(len, schemas.values())) > MAX_SCHEMA:
        raise ValueError("the schemas are more than travel with the tasks")
    bounded_batches(messages.sparkSession)
    key = ["conv_id", "call_id"]
    calls = calls_of(messages, schemas).groupBy(*key).agg(F.min_by(F.struct("turn", "name", "arguments", "after", "errors"), F.struct("turn", "pos", "arguments")).alias("c"), (F.count("*") - 1).cast("int").alias("r1"))
    results = results_of(messages).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), (F.count("*") - 1).cast("int").alias("r2"))
    null_safe = calls.select("*", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_c"))
    other = results.select(*(F.col(k).alias(f"r_{k}") for k in key), "r", "r2", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_rc"))
    linked = null_safe.join(other, (F.col("_c") == F.col("_rc")) & (F.col("call_id") == F.col("r_call_id")), "full")
    linked = linked.select(F.coalesce("conv_id", "r_conv_id").alias("conv_id"), F.coalesce("call_id", "r_call_id").alias("call_id"), "c", "r", (F.coalesce("r1", F.lit(0)) + F.coalesce("r2", F.lit(0))).alias("n_repeats"), F.concat(F.coalesce("_c", "_rc"), F.lit("\n"), F.coalesce("call_id", "r_call_id")).alias("v"))
    linked = materialize(linked, "linked")
    nodes = linked.where("c IS NOT NULL").select("v")
    wanted = linked.where("c IS NOT NULL").select("v", F.explode("c.after").alias("dep")).select("v", "dep", F.concat(F.substring_index("v", "\n", 1), F.lit("\n"), "dep").alias("parent"))
    there = nodes.select(F.col("v").alias("parent"), F.lit(True).alias("found"))
    wanted = materialize(wanted.join(there, "parent", "left"), "dependencies")
    ordered = levels(nodes, wanted.where("found").select("v", "parent"))
    dangling = wanted.where("found IS NULL").groupBy("v").agg(F.array_sort(F.collect_set(F.concat(F.lit("after: no call "), "dep"))).alias("dangling"))
    full = linked.join(ordered, "v", "left").join(dangling, "v", "left")
    full = full.select("conv_id", "call_id", F.col("c.turn").alias("turn"), F.col("r.turn").alias("result_turn"), "level", "c.name", "c.arguments", F.concat(F.coalesce("c.errors", F.array().cast("array<string>")), F.coalesce("dangling", F.array().cast("array<string>"))).alias("errors"), "c.after", F.col("r.content").alias("content"), (F.col("c").isNull()).alias("orphan"), "n_repeats")
    return full.mapInArrow(_serialise, LINKED)


def _serialise(batches):
    names = [x.split()[0] for x in LINKED.split(", ")]
    for b in batches:
        rows = []
        for r in b.to_pylist():
            errors = ["result without a call"] if r["orphan"] else r["errors"] + (["after: a cycle"] if r["level"] is None else [])
            if not r["orphan"] and r["content"] is None:
                errors = [*errors, "no result"]
            body = {"after": r["after"] or [], "arguments": None if r["arguments"] is None else json.loads(r["arguments"]), "conversation": r["conv_id"], "id": r["call_id"], "level": r["level"], "name": r["name"], "result": None if r["content"] is None else json.loads(r["content"])}
            rows.append((r["conv_id"], r["call_id"], r["turn"], r["result_turn"], r["level"], not errors, "; ".join(errors), r["n_repeats"], canonical(body)))
        cols = list(zip(*rows)) or [()] * len(names)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


SCHEMAS = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """A plain conversation as tool messages: what a user says calls ``reply``, after what the user said
    two turns before; an assistant's turn is the result of the call of the turn before."""
    name = lambda t: F.concat(F.lit("t"), t.cast("string"))
    call = F.to_json(F.struct(F.array(F.struct(name(F.col("turn")).alias("id"), F.lit("reply").alias("name"), F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn").alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"))).alias("tool_calls")))
    result = F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise("system")
    text = F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(as_tool_messages(table(spark, sf_dir, "conversations")), SCHEMAS)


OP7_SQL = r"""
WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS prompt FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, coalesce(text, '') AS answer FROM conversations WHERE role = 'assistant'),
c AS (SELECT u.*, p.turn IS NOT NULL AS known FROM u LEFT JOIN u p ON p.conv_id = u.conv_id AND p.turn = u.turn - 2),
l AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, turn % 2, grp ORDER BY turn) - 1)::INTEGER AS level
  FROM (SELECT *, sum(CASE WHEN known THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS grp FROM c)),
j AS (SELECT l.conv_id AS lc, a.conv_id AS ac, l.turn, a.turn AS result_turn, level, known, prompt, answer
  FROM l FULL JOIN a ON a.conv_id = l.conv_id AND a.turn - 1 = l.turn),
e AS (SELECT *, coalesce(lc, ac) AS conv_id, 't' || coalesce(turn, result_turn - 1) AS call_id,
  array_to_string(CASE WHEN turn IS NULL THEN ['result without a call'] ELSE
    list_filter([CASE WHEN turn >= 2 AND NOT known THEN 'after: no call t' || (turn - 2) END, CASE WHEN result_turn IS NULL THEN 'no result' END], lambda x: x IS NOT NULL) END, '; ') AS errors FROM j)
SELECT conv_id, call_id, turn, result_turn, level, errors = '' AS valid, errors, 0 AS n_repeats,
  '{"after":' || CASE WHEN turn >= 2 THEN '["t' || (turn - 2) || '"]' ELSE '[]' END
  || ',"arguments":' || CASE WHEN turn IS NULL THEN 'null' ELSE '{"prompt":' || to_json(prompt)::VARCHAR || ',"turn":' || turn || '}' END
  || ',"conversation":' || conv_id || ',"id":"' || call_id || '","level":' || coalesce(level::VARCHAR, 'null')
  || ',"name":' || CASE WHEN turn IS NULL THEN 'null' ELSE '"reply"' END
  || ',"result":' || coalesce(to_json(answer)::VARCHAR, 'null') || '}' AS json
FROM e
"""
