"""Chat formatting: tool calls linked to results, ordered, validated, as canonical JSON.

Input: conv_id, turn, role, text. A text may be plain, or a JSON object:

* ``{"content": ..., "tool_calls": [{"id", "name", "arguments", "depends_on"}]}``:
  calls; arguments are an object or its JSON text, depends_on lists ids of calls
  whose results a call needs;
* ``{"tool_call_id": ..., "content": ...}``: a result;
* ``{"tools": [{"name", "parameters"}], ...}``: JSON schemas of a conversation's tools.

Output: a row for each message, call and result, with its place: calls come after
all calls they depend on (``depth`` counts the longest chain; a cycle has -1),
results right after their call. Sorting by (anchor_turn, depth, anchor_item, kind,
turn, item) gives the order of a conversation; no conversation is gathered, so one
that holds a third of all rows is no burden. Calls and results meet in a hash join
on (conv_id, id); salting is left to adaptive execution, which splits such joins.

Canonical JSON: keys sorted, no blanks, characters as they are (halves of surrogate
pairs escaped), integers without a fraction, other numbers in their shortest form.

``from_turns`` gives plain conversations this form: every assistant turn calls a tool
and the turn after it is the result.

Defined results: a null text is the content null; a text that is no such JSON is
plain; JSON nested too deeply to be read is plain too, with a problem; a call without
an id, with one used before in its conversation (the earlier row keeps it), or a
result without a call gets a problem and stays unlinked; a schema that makes no
sense, a keyword of it that isn't known (see ``schemas``), or a pattern that takes longer
than PATTERN_SECONDS, is a problem of the call; NaN and infinities are no JSON, so a text
that holds them is plain, and arguments that do are a problem; null conv_ids link with
nothing; repeated rows are repeated messages; an empty table gives no rows; columns other
than conv_id, turn, role and text are not looked at and not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .schemas import canonical, loads, violations
from .schemas import valid_text as _valid
from .store import Scratch

#: Once no more dependencies than these wait for a depth, the driver follows them to the end.
LOCAL_NEEDS = 100_000


def _object(text: str | None):
    if text and text.lstrip()[:1] == "{":
        try:
            found = loads(text)
        except (ValueError, RecursionError):
            return None
        return found if isinstance(found, dict) and ("tool_calls" in found or "tool_call_id" in found or "tools" in found) else None
    return None


def _items(turn, role, text) -> list[dict]:
    """The message's own row, then its calls or result and its schemas."""
    try:
        return [*_read_items(turn, role, _object(text), text)]
    except RecursionError:
        return [{"kind": "message", "problem": "nested too deeply", "json": canonical({"content": text, "role": role, "turn": turn})}]


def _name(value) -> str | None:
    return None if value is None else _valid(str(value))


def _read_items(turn, role, found: dict | None, text) -> Iterator[dict]:
    if found is None:
        yield {"kind": "message", "json": canonical({"content": text, "role": role, "turn": turn})}
        return
    if "tool_call_id" in found:
        key = found["tool_call_id"]
        yield {"kind": "result", "call_id": _name(key), "json": canonical({"content": found.get("content"), "role": role, "tool_call_id": key, "turn": turn})}
        return
    yield {"kind": "message", "json": canonical({"content": found.get("content"), "role": role, "turn": turn})}
    calls = found.get("tool_calls")
    for call in calls if isinstance(calls, list) else []:
        if not isinstance(call, dict):
            yield {"kind": "call", "problem": "no object", "json": canonical({"call": call, "turn": turn})}
            continue
        arguments, problem = call.get("arguments", {}), None
        if isinstance(arguments, str):
            try:
                arguments = loads(arguments)
            except (ValueError, RecursionError):
                problem = "arguments are no JSON"
        needs = call.get("depends_on") or []
        key, name = call.get("id"), call.get("name")
        yield {
            "kind": "call", "call_id": _name(key), "name": _name(name), "arguments": canonical(arguments), "needs": [*map(_name, needs)] if isinstance(needs, list) else [_name(needs)],
            "problem": problem or (None if key is not None else "no id"), "json": canonical({"arguments": arguments, "id": key, "name": name, "role": role, "turn": turn}),
        }
    tools = found.get("tools")
    for tool in tools if isinstance(tools, list) else []:
        if isinstance(tool, dict) and tool.get("name") is not None:
            yield {"kind": "schema", "name": _name(tool["name"]), "schema": canonical(tool.get("parameters", True)), "json": ""}


def check(arguments: str, schema: str) -> str | None:
    """What is wrong with a call's arguments; a schema that can't be applied is a problem too."""
    try:
        return "; ".join(violations(loads(arguments), loads(schema))) or None
    except TimeoutError:
        return "the schema's pattern takes too long"
    except Exception as e:  # the schema is the user's, whatever it holds
        return f"the schema can't be applied: {type(e).__name__}"


_ITEM = "conv_id long, turn long, item int, kind string, call_id string, name string, arguments string, needs array<string>, problem string, schema string, json string"
_COLUMNS = ("kind", "call_id", "name", "arguments", "needs", "problem", "schema", "json")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string())
    for batch in batches:
        out: list[tuple] = []
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            out += [(conv, turn, k, *(x.get(c) for c in _COLUMNS)) for k, x in enumerate(_items(turn, role, text))]
        columns = list(zip(*out)) or [[]] * 11
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), *types))]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "item", *_COLUMNS])


def _validate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """schema and arguments at the end become the schema's violations."""
    for batch in batches:
        found = []
        for schema, arguments, problem in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("schema", "arguments", "problem"))):
            if problem or schema is None:
                found.append(problem)
            else:
                found.append(check(arguments, schema))
        own = [c for c in batch.schema.names if c not in ("schema", "arguments", "problem")]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(found, pa.string())], names=[*own, "problem"])


def _depths(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, call_id, depth of each call that has an id: longest chain of dependencies, -1 in or after a cycle."""
    keys = calls.select("conv_id", "call_id")
    needs = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    needs = needs.join(keys.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi")  # others are no calls here
    if not needs.take(1):
        return keys.withColumn("depth", F.lit(0))
    needs = scratch.save(needs, "needs")
    keys.join(needs.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0)).write.parquet(scratch.path("depths"))
    spark, schema = calls.sparkSession, "conv_id long, call_id string, depth int"
    while True:  # a round for each depth, until a round adds no call: what then remains is in or after a cycle
        depth = spark.read.schema(schema).parquet(scratch.path("depths"))
        waiting = needs.join(depth.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").join(depth.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left")
        few = waiting.select("conv_id", "call_id", "need", "depth").take(LOCAL_NEEDS + 1)
        if len(few) <= LOCAL_NEEDS:
            new = spark.createDataFrame(_follow(few), schema)
        else:
            ready = waiting.groupBy("conv_id", "call_id").agg(F.max("depth").alias("last"), F.bool_and(F.col("depth").isNotNull()).alias("all"))
            new = stored(ready.where("all").select("conv_id", "call_id", (F.col("last") + 1).alias("depth")), "depth")
        found = bool(new.take(1))
        if found:
            new.write.mode("append").parquet(scratch.path("depths"))
        if not found or len(few) <= LOCAL_NEEDS:
            break
    depth = spark.read.schema(schema).parquet(scratch.path("depths"))
    return keys.join(depth, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("depth", F.lit(-1)).alias("depth"))


def _follow(needs: list[tuple]) -> list[tuple]:
    """conv_id, call_id, depth of the calls outside cycles; needs: conv_id, call_id, need, depth of the need or null."""
    waits: dict[tuple, int] = {}
    last: dict[tuple, int] = {}
    after: dict[tuple, list[tuple]] = {}
    for conv, call, need, depth in needs:
        key = (conv, call)
        waits[key] = waits.get(key, 0) + (depth is None)
        last[key] = max(last.get(key, 0), depth or 0)
        if depth is None:
            after.setdefault((conv, need), []).append(key)
    ready = [k for k, n in waits.items() if not n]
    for key in ready:  # grows
        for k in after.get(key, ()):
            waits[k] -= 1
            last[k] = max(last[k], last[key] + 1)
            if not waits[k]:
                ready.append(k)
    return [(*k, last[k] + 1) for k in ready]


def link(conversations: DataFrame) -> DataFrame:
    scratch = Scratch(conversations.sparkSession, "tool-calls")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    items = scratch.save(rows.mapInArrow(_parse, _ITEM).withColumn("row", F.monotonically_increasing_id()), "items", compression="zstd")
    calls = items.where("kind = 'call'")
    first = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "item", "row")).alias("first"))
    owners = first.select("conv_id", "call_id", F.col("first.turn").alias("anchor_turn"), F.col("first.item").alias("anchor_item"), F.col("first.row").alias("row"))
    owned = scratch.save(owners, "owners")
    schemas = items.where("kind = 'schema'").groupBy("conv_id", "name").agg(F.max_by("schema", F.struct("turn", "item", "row")).alias("schema"))
    depths = _depths(calls.join(owned.select("row"), "row", "left_semi"), scratch)

    same = calls.join(owned.select("row", F.lit(True).alias("owner")), "row", "left").drop("schema")
    same = same.withColumn("problem", F.coalesce("problem", F.when(F.col("owner").isNull() & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull(), "id used before")))
    checked = same.join(schemas, ["conv_id", "name"], "left").mapInArrow(_validate, "conv_id long, name string, row long, turn long, item int, kind string, call_id string, needs array<string>, json string, owner boolean, problem string")
    answered = items.where("kind = 'result' and call_id is not null").select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    done = checked.join(depths, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    out_calls = done.select(
        "conv_id", "turn", "item", "kind", "call_id", F.col("turn").alias("anchor_turn"), F.col("item").alias("anchor_item"), F.when(F.col("owner"), F.coalesce("depth", F.lit(0))).otherwise(0).alias("depth"),
        F.coalesce(F.col("owner") & F.col("answered"), F.lit(False)).alias("linked"), F.col("problem").isNull().alias("valid"), "problem", "json",
    )
    places = owned.drop("row").join(depths, ["conv_id", "call_id"])
    results = items.where("kind = 'result'").drop("problem").join(places, ["conv_id", "call_id"], "left")
    out_results = results.select(
        "conv_id", "turn", "item", "kind", "call_id", F.coalesce("anchor_turn", "turn").alias("anchor_turn"), F.coalesce("anchor_item", "item").alias("anchor_item"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.col("anchor_turn").isNotNull().alias("linked"), F.col("anchor_turn").isNotNull().alias("valid"), F.when(F.col("anchor_turn").isNull(), "no call").alias("problem"), "json",
    )
    messages = items.where("kind = 'message'").select(
        "conv_id", "turn", "item", "kind", "call_id", F.col("turn").alias("anchor_turn"), F.col("item").alias("anchor_item"), F.lit(0).alias("depth"), F.lit(False).alias("linked"), F.col("problem").isNull().alias("valid"), "problem", "json"
    )
    return messages.unionByName(out_calls).unionByName(out_results)


def ordered(linked: DataFrame) -> DataFrame:
    """linked, sorted as each conversation reads."""
    return linked.orderBy("conv_id", "anchor_turn", "depth", "anchor_item", F.expr("array_position(array('message', 'call', 'result'), kind)"), "turn", "item")


#: In from_turns, calls depend on the call two turns before, but for the first two of so many turns; the words that arguments must count at least.
CHAIN, LEAST_WORDS = 16, 12


def from_turns(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool calls: conv_id, turn, role, text.

    Every assistant turn is a call with an id made of its turn, its number of words
    as an argument and, within a stretch of CHAIN turns, the call two turns before as
    a dependency. Every later turn of another role but system answers the turn before
    it. A system turn brings the tool's schema. A turn that is null stays a message.
    """
    turn, words = F.col("turn").cast("long"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \n\t\r]+"))
    needs = F.when(F.pmod(turn, F.lit(CHAIN)) >= 2, F.array(F.concat(F.lit("c"), (turn - 2).cast("string")))).otherwise(F.array().cast("array<string>"))
    arguments = F.struct(turn.alias("turn"), words.alias("words"))
    call = F.struct(F.concat(F.lit("c"), turn.cast("string")).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"), needs.alias("depends_on"))
    counted = f'{{"type":"object","required":["turn","words"],"properties":{{"turn":{{"type":"integer"}},"words":{{"type":"integer","minimum":{LEAST_WORDS}}}}}}}'
    schema = F.from_json(F.lit(counted), "type string, required array<string>, properties struct<turn: struct<type: string>, words: struct<type: string, minimum: int>>")
    made = (
        F.when(F.col("role") == "assistant", F.to_json(F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls"))))
        .when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("content"), F.array(F.struct(F.lit("reply").alias("name"), schema.alias("parameters"))).alias("tools"))))
        .when(turn > 0, F.to_json(F.struct(F.concat(F.lit("c"), (turn - 1).cast("string")).alias("tool_call_id"), F.col("text").alias("content"))))
    )
    return conversations.select("conv_id", "turn", "role", F.coalesce(made, F.col("text")).alias("text"))
