"""Chat formatting with tool-call linking.

Calls come as turns whose text is a JSON object with `tool_calls`, each of id, name and arguments; results as turns of the
role `tool` whose text is an object with `tool_call_id` and `content`. Calls and results are hash-joined by conversation
and identifier. A call that refers to another's result (`{"$result": "<id>"}` anywhere in its arguments) depends on it, and
a result on its call; levels of the dependencies are found by rounds of joins, and a conversation is written in topological
order: a result comes after its call, a call after the results that it uses, and turns keep their order otherwise.
Arguments are validated against the tools' schemas and every message is one line of canonical JSON.
Nothing gathers a conversation: a message's position comes from counts of ranges of turns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeledger.llm.shared import cut, needs, written

#: Places of a conversation whose messages are numbered together.
RANGE = 64
#: Levels of a JSON value at most.
MOST_NESTED = 100
TYPES = {
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
    "number": lambda v: not isinstance(v, bool) and isinstance(v, (int, float)),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}
#: The tools of the production query and the schemas of their arguments.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string", "minLength": 1}}, "required": ["expression"], "additionalProperties": False},
}
PARSED = (
    "conv_id long, turn long, role string, kind string, call int, call_id string, name string, arguments string, "
    "error string, refs array<string>, content string"
)


def canonical(value) -> str:
    """JSON with sorted keys and without spaces; letters beyond ASCII stay as they are. NaN and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fault(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which a value breaks a JSON schema of type, enum, const, properties, required,
    additionalProperties, items, minimum, maximum, minLength and maxLength; None if it doesn't."""
    if not isinstance(schema, dict):
        return None
    if isinstance(value, dict) and set(value) == {"$result"}:
        return None  # known only when the call is made
    kinds = schema.get("type")
    if kinds is not None and not any(TYPES.get(k, lambda v: True)(value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"
    if "enum" in schema and all(canonical(value) != canonical(v) for v in schema["enum"]):
        return f"{at}: not in enum"
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return f"{at}: not the constant"
    if TYPES["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            return f"{at}: below minimum"
        if "maximum" in schema and value > schema["maximum"]:
            return f"{at}: above maximum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: too short"
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            return f"{at}: too long"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for key in schema.get("required", []):
            if key not in value:
                return f"{at}.{key}: missing"
        for key in sorted(value):
            if key in known:
                if found := fault(value[key], known[key], f"{at}.{key}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{key}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := fault(item, schema["items"], f"{at}[{i}]"):
                return found
    return None


def references(value) -> list[str]:
    """Ids of the calls whose results a value uses."""
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return [value["$result"]]
        value = list(value.values())
    return sorted({r for v in value for r in references(v)}) if isinstance(value, list) else []


def refused(constant: str):
    raise ValueError(f"{constant} is no JSON value")


def finite(number: str) -> float:
    value = float(number)
    return value if abs(value) < float("inf") else refused(number)


def loaded(text: str | None):
    """A JSON object in a text, or None. NaN, infinities and numbers beyond the range of doubles are no JSON, nor is what is nested
    more than MOST_NESTED deep; halves of surrogate pairs that stand alone become U+FFFD."""
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text, parse_constant=refused, parse_float=finite)
        if "\\ud" in text.lower():
            whole = json.dumps(value, ensure_ascii=False).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            value = json.loads(whole)
    except (ValueError, RecursionError):
        return None
    level = [value]
    for _ in range(MOST_NESTED):
        level = [v for x in level if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
    return value if isinstance(value, dict) and not level else None


def parsed(turns: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """One row for each message, call and result of the turns; `tools` has each tool's schema of arguments."""

    def one(conv, turn, role, text) -> Iterator[tuple]:
        value = loaded(text)
        calls = value.get("tool_calls") if value else None
        if value and role == "tool" and isinstance(value.get("tool_call_id"), str):
            content = value.get("content")
            yield conv, turn, role, "result", 0, value["tool_call_id"], None, None, None, [], content if isinstance(content, str) else canonical(content)
            return
        if not isinstance(calls, list) or not calls or not all(isinstance(c, dict) for c in calls):
            yield conv, turn, role, "message", 0, None, None, None, None, [], text
            return
        if value.get("content"):
            yield conv, turn, role, "message", 0, None, None, None, None, [], value["content"] if isinstance(value["content"], str) else canonical(value["content"])
        for k, call in enumerate(calls, 1):
            name, arguments = call.get("name"), call.get("arguments")
            if isinstance(arguments, str):
                arguments = loaded(arguments) if arguments.strip() else {}
            arguments = {} if arguments is None and "arguments" not in call else arguments
            wrong = None
            if not isinstance(call.get("id"), str):
                wrong = "no id"
            elif not isinstance(name, str) or name not in tools:
                wrong = "unknown tool"
            elif not isinstance(arguments, dict):
                wrong = "arguments are no object"
            else:
                wrong = fault(arguments, tools[name])
            yield conv, turn, role, "call", k, call.get("id") if isinstance(call.get("id"), str) else None, name if isinstance(name, str) else None, canonical(arguments), wrong, references(arguments), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PARSED.split(", ")]
        for batch in batches:
            rows = [r for x in zip(batch["conv_id"].astype("Int64"), batch["turn"].astype("Int64"), batch["role"], batch["text"], strict=True) for r in one(*x)]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"conv_id": "Int64", "turn": "Int64"})

    return needs(turns, "conv_id", "turn", "role", "text").mapInPandas(run, PARSED)


def keyed(rows: DataFrame) -> DataFrame:
    """Add `conv`, a key of the conversation that is never null: null conv_ids are one conversation."""
    return rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))


def levels(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """conv, call_id, `base` (the turn and number after which a call may stand), depth and `cyclic`; calls have conv; answers have
    conv, call_id and `said`, the place of a call's result.

    A call stands at the latest of its own place and those of the calls that it depends on and of their results. Each round settles the
    calls whose references are all settled; what remains when a round settles none is on a cycle or behind one. As many rounds
    as the longest chain of calls has are run, whatever the number of references.
    """
    own = calls.select("conv", "call_id", F.struct("turn", "call").alias("own"), "refs")
    needed = own.select("conv", "call_id", F.explode("refs").alias("ref")).distinct()
    needed = cut(needed.join(own.select("conv", F.col("call_id").alias("ref")).distinct(), ["conv", "ref"]))
    places = own.groupBy("conv", "call_id").agg(F.min("own").alias("base")).withColumn("depth", F.lit(0)).join(answers, ["conv", "call_id"], "left")
    waits = needed.select("conv", "call_id").distinct().withColumn("waits", F.lit(True))
    places = cut(places.join(waits, ["conv", "call_id"], "left").withColumn("waits", F.coalesce("waits", F.lit(False))))
    behind = F.greatest("base", F.coalesce("said", "base"))
    left = places.where("waits").count()
    while left:
        of = places.select("conv", F.col("call_id").alias("ref"), behind.alias("other"), F.col("depth").alias("below"), F.col("waits").alias("open"))
        heard = needed.join(of, ["conv", "ref"]).groupBy("conv", "call_id").agg(F.max(F.when(~F.col("open"), F.col("other"))).alias("other"), F.max(F.when(~F.col("open"), F.col("below"))).alias("below"), F.max("open").alias("open"))
        met = places.join(heard, ["conv", "call_id"], "left")
        places = cut(met.select(
            "conv", "call_id", "said", F.when(F.col("waits"), F.greatest("base", F.coalesce("other", "base"))).otherwise(F.col("base")).alias("base"),
            F.when(F.col("waits"), F.greatest("depth", F.coalesce(F.col("below") + 1, "depth"))).otherwise(F.col("depth")).alias("depth"),
            (F.col("waits") & F.col("open")).alias("waits"),
        ))
        before, left = left, places.where("waits").count()
        if left == before:
            break
    # On and behind cycles only places are passed on, until none moves: they only grow, and never beyond the latest.
    moved = left > 0
    while moved:
        of = places.where("waits").select("conv", F.col("call_id").alias("ref"), behind.alias("other"))
        heard = needed.join(of, ["conv", "ref"]).groupBy("conv", "call_id").agg(F.max("other").alias("other"))
        late = F.greatest("base", F.coalesce("other", "base"))
        found = cut(places.join(heard, ["conv", "call_id"], "left").select("conv", "call_id", "said", late.alias("base"), "depth", "waits", (late > F.col("base")).alias("moved")))
        places, moved = found.drop("moved"), not found.where("moved").isEmpty()
    return places.drop("said").withColumnRenamed("waits", "cyclic")


def positions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add `position`, from 0 in each `key` by the long `order[0]` and then the rest, without a key's rows in one task: ranges of
    RANGE values of order[0] are counted, and rows are numbered within a range."""
    dealt = rows.withColumn("_range", F.floor(F.col(order[0]) / RANGE))
    counts = dealt.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_range").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(inside) - 1)
    met = numbered.join(starts, numbered[key].eqNullSafe(starts["_key"]) & numbered["_range"].eqNullSafe(starts["_of"]))
    return met.withColumn("position", (F.col("_start") + F.col("_row")).cast("long")).drop("_range", "_row", "_key", "_of", "_start")


def format_chats(turns: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """Messages in topological order: conv_id, position, turn, role, status and line (canonical JSON).

    status: `ok`; for calls also `invalid` (with the fault in the line), `cyclic`, `unanswered` or `duplicate` (an identifier used before in its
    conversation); for results `orphan` (no such call) or `duplicate` (not the first for its call). All rows stay. A text that is
    no JSON object of these forms is a message; null texts are messages with null content. Null conv_ids are one
    conversation; a null turn comes first. Repeated rows are messages each.
    """
    rows = written(parsed(turns, tools or {}))
    calls = rows.where("kind = 'call' AND call_id IS NOT NULL")
    if calls.isEmpty():
        at = rows.withColumn("base", F.struct("turn", "call")).withColumn("depth", F.lit(0)).withColumn("status", F.when(F.col("kind") == "message", "ok").when(F.col("kind") == "call", "invalid").otherwise("orphan"))
    else:
        at = _linked(rows, calls)
    ordered = positions(
        at.select("conv_id", "turn", "role", "kind", "call", "call_id", "name", "arguments", "error", "content", "status", "depth", F.col("base.turn").alias("at_turn"), F.col("base.call").alias("at_call")),
        "conv_id", ["at_turn", "at_call", "depth", "kind", "turn", "call", "role", "content"],
    )

    @F.pandas_udf("string")
    def serialised(x: pd.DataFrame) -> pd.Series:
        out = []
        for r in x.itertuples(index=False):
            if r.kind == "message":
                value = {"content": r.content, "role": r.role}
            elif r.kind == "call":
                value = {"role": r.role, "tool_call": {"id": r.call_id, "name": r.name, "arguments": json.loads(r.arguments)}} | ({"error": r.error} if r.error else {})
            else:
                value = {"content": r.content, "role": r.role, "tool_call_id": r.call_id}
            out.append(canonical(value))
        return pd.Series(out)

    packed = serialised(F.struct("kind", "role", "content", "call_id", "name", "arguments", "error"))
    return ordered.select("conv_id", "position", "turn", "role", "status", packed.alias("line"))


def _linked(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Rows with base, depth and status; results meet their calls by conversation and identifier."""
    calls = keyed(calls)
    results = keyed(rows.where("kind = 'result'")).groupBy("conv", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    placed = levels(calls, results.select("conv", "call_id", F.struct(F.col("answer.turn").alias("turn"), F.lit(0).alias("call")).alias("said")))
    first = calls.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "call")).alias("first"))
    known = placed.join(first, ["conv", "call_id"]).join(results, ["conv", "call_id"], "left")
    known = known.select(F.col("conv").alias("of"), F.col("call_id").alias("of_call"), F.col("base").alias("call_base"), F.col("depth").alias("call_depth"), "cyclic", "first", "answer")
    named = keyed(rows)
    met = named.join(known, (named["conv"] == known["of"]) & (named["call_id"] == known["of_call"]), "left")
    here = F.struct("turn", "call")
    linked = F.col("of_call").isNotNull()
    late = F.when(here < F.col("call_base"), F.col("call_base")).otherwise(here)
    status = (
        F.when(F.col("kind") == "message", "ok")
        .when(F.col("kind") == "call", F.when(F.col("error").isNotNull(), "invalid").when(~linked, "invalid").when(here != F.col("first"), "duplicate").when(F.col("cyclic"), "cyclic").when(F.col("answer").isNull(), "unanswered").otherwise("ok"))
        .otherwise(F.when(~linked, "orphan").when(F.struct("turn", "content") != F.col("answer"), "duplicate").otherwise("ok"))
    )
    # A result stands one level below its call, which stands one below the results that it uses.
    depth = F.when(~linked, 0).when(F.col("kind") == "call", 2 * F.col("call_depth")).otherwise(2 * F.col("call_depth") + 1)
    return met.select(*rows.columns, F.when(linked, late).otherwise(here).alias("base"), F.coalesce(depth, F.lit(0)).alias("depth"), status.alias("status"))


ORACLE = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS position, turn, role, 'ok' AS status,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS line
FROM conversations
"""
