"""Operator 2: chat formatting by linking tool calls and their results.

Messages become elements: plain messages, calls (id, name, arguments, ids they wait for) and results (id,
content). A hash join on (conversation, id) links results to calls; arguments are validated against the tool's
schema; elements get a topological order; each is serialised as canonical JSON (RFC 8785: keys in order of their
UTF-16 code units, no spaces, numbers as ECMAScript writes them; integers beyond 2^53 keep their digits).

Order: a result comes after its call, a call after the results it waits for. An element's `at` is the latest
turn among itself and all it depends on, its `level` the length of the longest chain before it; sorting a
conversation by (at, level, turn, part) is a topological order that moves nothing without need. Calls that
wait for each other in a circle have neither. No conversation is gathered: order is found by joins, in as
many rounds as the longest chain of waiting calls.

A text that is a JSON object with "tool_calls" or "tool_call_id" is a message of calls or a result:
  {"content": ..., "tool_calls": [{"id": ..., "name": ..., "arguments": {...} or its JSON text, "after": [ids]}]}
  {"tool_call_id": ..., "content": ...}
Any other text is plain; null is a plain message with null content. Problems, each by name: no_id, no_name,
bad_arguments (not a JSON object), unknown_tool, invalid:<path> (schema), duplicate_id (a call after the first
of its id), no_call, extra_result (after the first result of a call), no_result, unknown_after, circle.
Rows that repeat conversation and turn are one place: neither of two equal calls is later than the other.
Null conversations or turns link nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from itertools import count
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

TYPES: dict[str, Callable[[Any], bool]] = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
}


def canonical(value: Any) -> str:
    """Canonical JSON of a value. Numbers that are not finite, which JSON has not, raise ValueError."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_text(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return _text(value) if isinstance(value, str) else json.dumps(value)


def _text(x: str) -> str:
    return json.dumps(x, ensure_ascii=False)


def _number(x: float) -> str:
    """A number as ECMAScript writes it: the shortest digits that read back, with an exponent below 1e-6 and from 1e21 on."""
    if not math.isfinite(x):
        raise ValueError("not a number of JSON")
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part.rstrip("0") if part.strip("0") else whole).lstrip("0")
    point = len(whole) + int(exponent or 0)  # places before the point
    if whole == "0":
        part = part.rstrip("0")
        point -= 1 + len(part) - len(part.lstrip("0"))
        digits = part.lstrip("0")
    stripped = digits.rstrip("0")
    sign, k = "-" if x < 0 else "", len(stripped)
    if k <= point <= 21:
        return sign + stripped + "0" * (point - k)
    if 0 < point <= 21:
        return f"{sign}{stripped[:point]}.{stripped[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{stripped}"
    e = point - 1
    return f"{sign}{stripped[0]}{'.' + stripped[1:] if k > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def invalid(value: Any, schema: dict, path: str = "$") -> str | None:
    """Path of the first part of a value that its schema does not allow, in order of keywords; None if valid.

    Keywords: type, enum, required, properties, additionalProperties (boolean), items, minimum, maximum,
    minLength, maxLength, minItems, maxItems.
    """
    kinds = schema.get("type", [])
    if kinds and not any(TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return path
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return path
    if isinstance(value, dict):
        missing = [k for k in schema.get("required", []) if k not in value]
        if missing:
            return f"{path}.{missing[0]}"
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                if found := invalid(value[k], known[k], f"{path}.{k}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{path}.{k}"
    size = {str: "Length", list: "Items"}.get(type(value))
    if size and not schema.get(f"min{size}", 0) <= len(value) <= schema.get(f"max{size}", len(value)):
        return path
    if TYPES["number"](value) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return path
    if isinstance(value, list) and "items" in schema:
        return next((p for i, v in enumerate(value) if (p := invalid(v, schema["items"], f"{path}[{i}]"))), None)
    return None


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError("a number beyond all doubles")
    return x


def _object(text: Any) -> dict | None:
    if isinstance(text, str) and text.lstrip()[:1] == "{":
        try:
            found = json.loads(text, parse_constant=_no_constant, parse_float=_finite)
        except (ValueError, RecursionError):
            return None
        if not isinstance(found, dict):
            return None
        try:
            json.dumps(found, ensure_ascii=False).encode()
        except UnicodeEncodeError:  # half a surrogate pair
            found = json.loads(json.dumps(found, ensure_ascii=False).encode("utf-8", "replace"))
        return found
    return None


def elements(conversation: Any, turn: Any, role: str | None, text: str | None, tools: dict[str, dict] | None) -> list[tuple]:
    """(part, kind, id, name, after, problem, json) of a message."""
    body = _object(text)
    if body is not None and "tool_call_id" in body:
        own = body["tool_call_id"]
        named = own is not None
        return [(0, "result", str(own) if named else None, None, [], None if named else "no_id", canonical({"content": body.get("content"), "tool_call_id": own}))]
    if body is not None and isinstance(body.get("tool_calls"), list):
        out = [(0, "message", None, None, [], None, canonical({"content": body.get("content"), "role": role}))]
        for i, call in enumerate(body["tool_calls"], 1):
            call = call if isinstance(call, dict) else {}
            call = {**call, **(call["function"] if isinstance(call.get("function"), dict) else {})}
            own, name, given = call.get("id"), call.get("name"), call.get("arguments")
            given = _object(given) if isinstance(given, str) else given
            after = [str(x) for x in call["after"]] if isinstance(call.get("after"), list) else []
            problem = "no_id" if own is None else "no_name" if not isinstance(name, str) else "bad_arguments" if not isinstance(given, dict) else None
            if problem is None and tools is not None:
                problem = "unknown_tool" if name not in tools else f"invalid:{p}" if (p := invalid(given, tools[name])) else None
            out.append((i, "call", None if own is None else str(own), name if isinstance(name, str) else None, after, problem, canonical({"arguments": given, "id": own, "name": name, "type": "call"})))
        return out
    return [(0, "message", None, None, [], None, canonical({"content": text, "role": role}))]


def asked(conversation: Any, turn: Any, role: str | None, text: str | None, tools: dict[str, dict] | None) -> list[tuple]:
    """Plain dialogue read as tool traffic: what a user says is a call of "ask", the next turn of the assistant its result."""
    body = _object(text)
    if body is not None and ("tool_call_id" in body or "tool_calls" in body) or conversation is None or turn is None:
        return elements(conversation, turn, role, text, tools)
    if role == "user":
        own, given = f"{conversation}:{turn}", {"text": text}
        problem = f"invalid:{p}" if tools and (p := invalid(given, tools["ask"])) else None
        return [(0, "call", own, "ask", [], problem, canonical({"arguments": given, "id": own, "name": "ask", "type": "call"}))]
    if role == "assistant":
        own = f"{conversation}:{turn - 1}"
        return [(0, "result", own, None, [], None, canonical({"content": text, "tool_call_id": own}))]
    return elements(conversation, turn, role, text, tools)


#: Tools of plain dialogue.
ASK = {"ask": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False}}


def link(messages: DataFrame, tools: dict[str, dict] | None = None, read: Callable = elements, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int | None = None) -> DataFrame:
    """conv_id, turn, part, kind, call_id, name, linked, at, level, problem, json: one row per element.

    most: rounds after which to give up with an error (None: as many as the longest chain takes).
    """
    scratch = Scratch(messages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for c, t, r, x in zip(batch["conv_id"], batch["turn"], batch["role"], batch["text"]):
                c, t = (None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in (c, t))
                rows += [(c, t, *e) for e in read(c, t, r if isinstance(r, str) else None, x if isinstance(x, str) else None, tools)]
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "part", "kind", "call_id", "name", "after", "problem", "json"])
            for c, kind in (("conv_id", "Int64"), ("turn", "Int64")):
                out[c] = out[c].astype(kind)
            yield out

    given = messages.select(F.col(conversation).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    found = scratch.write(given.mapInPandas(run, "conv_id long, turn long, part int, kind string, call_id string, name string, after array<string>, problem string, json string"))

    place = F.struct("turn", "part")
    named = found.filter("call_id is not null and conv_id is not null and turn is not null")
    sides = named.groupBy("conv_id", "call_id").agg(F.min(F.when(F.col("kind") == "call", F.struct("turn", "part", "after"))).alias("c"), F.min(F.when(F.col("kind") == "result", place)).alias("result"))
    sides = sides.select("conv_id", "call_id", F.when(F.col("c").isNotNull(), F.struct("c.turn", "c.part")).alias("call"), "result", "c.after")
    links = _ordered(scratch.write(sides), scratch, most)
    out = found.join(links, ["conv_id", "call_id"], "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    own = F.when(is_call, F.col("call")).when(is_result, F.col("result"))
    first = own == place
    problem = F.coalesce(
        "problem",
        F.when((is_call | is_result) & F.col("link_call").isNull() & F.col("link_result").isNull() & (F.col("conv_id").isNull() | F.col("turn").isNull()), F.lit("no_id")),
        F.when(is_result & F.col("call").isNull(), F.lit("no_call")),
        F.when(is_call & ~first, F.lit("duplicate_id")),
        F.when(is_result & ~first, F.lit("extra_result")),
        F.when(is_call & F.col("unknown"), F.lit("unknown_after")),
        F.when(is_call & F.col("call_at").isNull(), F.lit("circle")),
        F.when(is_call & F.col("result").isNull(), F.lit("no_result")),
    )
    linked = (is_call | is_result) & F.coalesce(first & F.col("call").isNotNull() & F.col("result").isNotNull(), F.lit(False))
    at = F.when(is_call & first, F.col("call_at")).when(is_result & first & F.col("call").isNotNull(), F.greatest(F.col("call_at"), F.col("turn"))).otherwise(F.col("turn"))
    level = F.when(is_call & first, F.col("call_level")).when(is_result & first & F.col("call").isNotNull(), F.col("call_level") + 1).otherwise(F.lit(0))
    return out.withColumn("problem", problem).select("conv_id", "turn", "part", "kind", "call_id", "name", linked.alias("linked"), at.alias("at"), level.cast("int").alias("level"), "problem", "json")


def _ordered(sides: DataFrame, scratch: Scratch, most: int | None) -> DataFrame:
    """sides with call_at and call_level of each call (null in circles), and whether it waits for an unknown id.

    A round looks only at edges from calls that became ready in the last one, and adds to what their waiting calls
    have gathered; it ends when no call becomes ready.
    """
    calls = sides.filter("call is not null")
    waits = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("before"))
    known = calls.select("conv_id", F.col("call_id").alias("before"), F.col("result.turn").alias("answered"))
    edges = scratch.write(waits.join(known, ["conv_id", "before"]))
    unknown = waits.join(known, ["conv_id", "before"], "left_anti").select("conv_id", "call_id").distinct().withColumn("unknown", F.lit(True))
    base = calls.select("conv_id", "call_id", F.col("call.turn").alias("call_at"))
    state = base.withColumn("call_level", F.lit(0))
    if not edges.isEmpty():
        key = ["conv_id", "call_id"]
        need = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("need"))
        # what a call still waits for, and the latest turn and level that it has gathered
        waiting = scratch.write(base.join(need, key).withColumn("call_level", F.lit(0)))
        fresh, old = scratch.write(state.join(need, key, "left_anti")), [waiting]
        state = fresh
        for rounds in count():
            done = fresh.select("conv_id", F.col("call_id").alias("before"), F.col("call_at").alias("before_at"), F.col("call_level").alias("before_level"))
            fed = edges.join(done, ["conv_id", "before"]).groupBy(*key)
            fed = scratch.write(fed.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest("before_at", F.coalesce("answered", "before_at"))).alias("before_at"), F.max("before_level").alias("before_level")))
            if fed.isEmpty():
                break
            if rounds == most:
                raise RuntimeError(f"calls still become ready after {most} rounds")
            at, level = F.greatest("call_at", F.coalesce("before_at", "call_at")), F.greatest("call_level", F.coalesce(F.col("before_level") + 2, F.lit(0)))
            moved = scratch.write(waiting.join(fed, key, "left").select(*key, at.alias("call_at"), (F.col("need") - F.coalesce("n", F.lit(0))).alias("need"), level.cast("int").alias("call_level")))
            for one in old:
                scratch.drop(one)
            fresh, old, waiting = scratch.write(moved.filter("need = 0").drop("need")), [moved, fed], moved.filter("need > 0")
            state = state.unionByName(fresh)
            if rounds % 16 == 15:  # bounds the plan
                state = scratch.write(state)
    out = sides.join(state, ["conv_id", "call_id"], "left").join(unknown, ["conv_id", "call_id"], "left")
    return out.select("conv_id", "call_id", "call", "result", "call_at", "call_level", F.coalesce("unknown", F.lit(False)).alias("unknown"), F.col("call.turn").alias("link_call"), F.col("result.turn").alias("link_result"))


def op2_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, read as calls of "ask" and their results."""
    linked = link(table(spark, sf_dir, "conversations"), tools=ASK, read=asked)
    return linked.withColumn("json_sha256", F.sha2("json", 256)).drop("json")


def sha(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


ORACLE = """
WITH m AS (SELECT conv_id, turn, role, text,
  CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
  CASE role WHEN 'user' THEN concat(conv_id, ':', turn) WHEN 'assistant' THEN concat(conv_id, ':', turn - 1) END AS call_id FROM conversations),
s AS (SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS call, min(turn) FILTER (kind = 'result') AS result FROM m WHERE call_id IS NOT NULL GROUP BY ALL)
SELECT m.conv_id, m.turn, CAST(0 AS INTEGER) AS part, m.kind, m.call_id, CASE WHEN kind = 'call' THEN 'ask' END AS name,
  coalesce(kind <> 'message' AND s.call IS NOT NULL AND s.result IS NOT NULL, false) AS linked, m.turn AS "at",
  CAST(CASE WHEN kind = 'result' AND s.call IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS level,
  CASE WHEN kind = 'call' AND text IS NULL OR kind = 'call' AND text = '' THEN 'invalid:$.text' WHEN kind = 'result' AND s.call IS NULL THEN 'no_call' WHEN kind = 'call' AND s.result IS NULL THEN 'no_result' END AS problem,
  sha256(CASE kind WHEN 'call' THEN concat('{"arguments":{"text":', coalesce(CAST(to_json(text) AS VARCHAR), 'null'), '},"id":"', m.call_id, '","name":"ask","type":"call"}')
    WHEN 'result' THEN concat('{"content":', coalesce(CAST(to_json(text) AS VARCHAR), 'null'), ',"tool_call_id":"', m.call_id, '"}')
    ELSE concat('{"content":', coalesce(CAST(to_json(text) AS VARCHAR), 'null'), ',"role":', coalesce(CAST(to_json(role) AS VARCHAR), 'null'), '}') END) AS json_sha256
FROM m LEFT JOIN s ON s.conv_id = m.conv_id AND s.call_id = m.call_id
"""
