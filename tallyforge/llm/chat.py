"""Operator 8: chat formatting with tool-call linking, with DataFrame functions only.

A message whose text is a JSON object may carry ``tool_calls``, flat ones (id, name, arguments) or nested ones (id, type,
function with name and arguments), or, from the tool, answer one by ``tool_call_id``. Members besides these are kept.
Calls and results of a conversation are hash-joined by identifier. In the topological order each message keeps its turn,
but a result never stands before its call, however many calls and results lead to that one. Where messages answer each
other in a cycle, the earliest of them (by turn) keeps its turn and the others follow it. Arguments are validated against the tools' schemas, and every message is
serialised as canonical JSON: keys sorted, no white space, numbers and strings in one form.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Tools by name: the JSON schema of their arguments. Known are type, enum, properties, required, additionalProperties
#: (false) and items, at any depth.
TOOLS: dict[str, dict] = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "weather": {"properties": {"city": {"type": "string"}, "unit": {"type": "string"}}, "required": ["city"], "additionalProperties": False},
    "fetch": {"properties": {"url": {"type": "string"}, "headers": {"type": "object"}}, "required": ["url"], "additionalProperties": False},
}
#: Turns of a conversation are numbered in runs of this many.
RUN = 1024
#: A run with more messages than this is cut on.
MOST_IN_RUN = 8 * RUN
_CALLS = "array<struct<id:string,name:string,arguments:string,shown:string>>"
#: Roles whose ``tool_call_id`` answers a call; in other messages it is a member like any other.
ANSWERING = ("tool", "function")


def canonical(text: Column) -> Column:
    """Canonical JSON of a JSON text: keys sorted at every depth; null where it is not JSON."""
    return F.to_json(F.try_parse_json(text))


def string(c: Column) -> Column:
    """A text as a JSON string, or null."""
    return F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", ""))


def _object(parts: Column) -> Column:
    """Canonical JSON of an object of (k, v): v is JSON already."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat(string(p["k"]), F.lit(":"), p["v"])), ","), F.lit("}"))


def _part(name: str, json_text: Column) -> Column:
    return F.struct(F.lit(name).alias("k"), json_text.alias("v"))


def _others(value: Column, known: Column) -> Column:
    """The members of a variant's object that are not ``known``, as (k, v)."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    rest = F.transform(F.filter(entries, lambda e: ~F.array_contains(known, e["key"])), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")))
    return F.coalesce(rest, F.array().cast("array<struct<k:string,v:string>>"))


def _call(v: Column) -> Column:
    """(id, name, arguments, shown) of a call: ``shown`` is its canonical JSON in the flat form, with all its other members;
    what is no object has nothing and shows itself."""
    get = lambda path: F.try_variant_get(v, path, "string")
    given = F.coalesce(F.try_variant_get(v, "$.function.arguments", "variant"), F.try_variant_get(v, "$.arguments", "variant"))
    arguments = F.when(F.schema_of_variant(given) == "STRING", F.try_variant_get(given, "$", "string")).otherwise(F.to_json(given))
    id_, name = get("$.id"), F.coalesce(get("$.function.name"), get("$.name"))
    names = lambda *n: F.array(*map(F.lit, n))
    inner = F.try_variant_get(v, "$.function", "variant")
    nested = F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))
    own = _others(inner, names("name", "arguments"))
    kept = F.when(nested & (F.size(own) > 0), F.array(_part("function", _object(own)))).when(inner.isNotNull() & ~nested, F.array(_part("function", F.to_json(inner)))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    parts = F.concat(F.array(_part("arguments", F.coalesce(canonical(arguments), string(arguments))), _part("id", string(id_)), _part("name", string(name))), _others(v, names("id", "name", "arguments", "function")), kept)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    none = F.lit(None).cast("string")
    of = lambda c: F.when(is_object, c).otherwise(none)
    return F.struct(of(id_).alias("id"), of(name).alias("name"), of(arguments).alias("arguments"), F.when(is_object, _object(parts)).otherwise(F.to_json(v)).alias("shown"))


def _is(kind: Column, wanted: str) -> Column:
    """Whether a variant's schema is of a JSON type."""
    return {
        "string": lambda: kind == "STRING",
        "integer": lambda: kind == "BIGINT",
        "number": lambda: (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"),
        "boolean": lambda: kind == "BOOLEAN",
        "null": lambda: kind == "VOID",
        "object": lambda: kind.startswith("OBJECT"),
        "array": lambda: kind.startswith("ARRAY"),
    }[wanted]()


def _problem(value: Column, schema: dict, path: str) -> Column:
    """The first problem of a variant under a JSON schema, or null: its own type and value, then its parts."""
    kind, problems = F.schema_of_variant(value), []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = reduce(or_, (_is(kind, k) for k in kinds))
        problems.append(F.when(~F.coalesce(fits, F.lit(False)), f"type:{path}"))
    if "enum" in schema:
        allowed = [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in schema["enum"]]
        problems.append(F.when(~F.coalesce(F.to_json(value).isin(allowed), F.lit(False)), f"enum:{path}"))
    if "properties" in schema or "required" in schema or schema.get("additionalProperties") is False:
        problems += _parts(value, F.json_object_keys(F.to_json(value)), schema, path)
    if "items" in schema:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: _problem(v, schema["items"], f"{path}[]"))
        problems.append(F.get(F.array_compact(each), F.lit(0)))
    return F.coalesce(*problems, F.lit(None).cast("string"))


def _parts(value: Column, keys: Column, schema: dict, path: str) -> list[Column]:
    """The problems of an object's members, in the order of their names, and of members that the schema doesn't name."""
    known, below, problems = schema.get("properties", {}), f"{path}." if path else "", []
    for p in sorted({*known, *schema.get("required", ())}):
        there = F.array_contains(keys, p)
        if p in schema.get("required", ()):
            problems.append(F.when(~there, f"missing:{below}{p}"))
        if p in known:
            quoted = p.replace("\\", "\\\\").replace("'", "\\'")
            problems.append(F.when(there, _problem(F.try_variant_get(value, f"$['{quoted}']", "variant"), known[p], f"{below}{p}")))
    if schema.get("additionalProperties") is False:
        extra = F.array_min(F.array_except(keys, F.array(*map(F.lit, sorted(known))) if known else F.array().cast("array<string>")))
        problems.append(F.when(extra.isNotNull(), F.concat(F.lit(f"unexpected:{below}"), extra)))
    return problems


def argument_status(name: Column, arguments: Column, tools: dict[str, dict] = TOOLS) -> Column:
    """ok, unknown_tool, invalid_json, or the first problem under the tool's JSON schema, by the names of its parameters:
    missing:p, type:p, enum:p, then unexpected:p; p is the path of what is wrong, with [] for the items of an array."""
    parsed, keys = F.try_parse_json(arguments), F.json_object_keys(arguments)
    status = F.lit("unknown_tool")
    for tool, schema in sorted(tools.items()):
        own = {k: v for k, v in schema.items() if k not in ("type", "enum", "items")}
        status = F.when(name == tool, F.coalesce(*_parts(parsed, keys, own, ""), F.lit("ok"))).otherwise(status)
    return F.when(parsed.isNull() | keys.isNull(), "invalid_json").otherwise(status)


def formatted(turns: DataFrame, tools: dict[str, dict] = TOOLS) -> DataFrame:
    """(conv_id, turn, role, position, n_calls, call_status, link, message) for every row of ``turns`` (conv_id, turn,
    role, text).

    position counts a conversation's messages from 0 in topological order (turns ascending, null last; of one turn by a hash
    of the message; of repeated rows either may stand first, and the others are duplicates). call_status joins the statuses of a message's calls; an identifier's later calls are
    ``duplicate``. link of a tool's result is linked, duplicate (the identifier was answered before) or orphan. Texts
    that are not JSON objects are content as they are; null texts are null content; an empty table gives no rows; other
    columns are not looked at. Very long texts are one value of one row. Nothing of a conversation is gathered: every row is one message, and positions are summed
    over runs of turns.
    """
    text = F.when(F.col("text").rlike(r'^\s*\{'), F.col("text"))
    rows = turns.select("conv_id", "turn", "role", "text", F.try_parse_json(text).alias("parsed"))
    answers = F.when(F.col("role").isin(*ANSWERING), F.try_variant_get("parsed", "$.tool_call_id", "string"))
    calls = F.transform(F.try_variant_get("parsed", "$.tool_calls", "array<variant>"), _call)
    rows = rows.select("conv_id", "turn", "role", "text", "parsed", F.coalesce(calls, F.array().cast(_CALLS)).alias("calls"), answers.alias("answers"), F.xxhash64("role", "text").alias("key"))
    called = rows.filter(F.size("calls") > 0).select("conv_id", "turn", "key", F.posexplode("calls").alias("at", "call"))
    called = called.filter("call.id is not null").select("conv_id", F.col("call.id").alias("id"), F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), "key", "at").alias("place"))
    first = called.groupBy("conv_id", "id").agg(F.min("place").alias("call"))
    answered = rows.filter("answers is not null").select("conv_id", F.col("answers").alias("id"), F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), "key").alias("place"))
    links = first.join(answered.groupBy("conv_id", "id").agg(F.min("place").alias("result")), ["conv_id", "id"], "full")
    links = links.select(F.col("conv_id").alias("lc"), F.col("id").alias("li"), "call", "result")
    # a message looks up the identifiers that it calls or answers; most have none and take no part in the join
    special = rows.filter((F.size("calls") > 0) | F.col("answers").isNotNull()).dropDuplicates(["conv_id", "turn", "key"])
    none = F.lit(None).cast("string")
    answer = F.when(F.col("answers").isNotNull(), F.array(F.struct(F.col("answers").alias("id"), none.alias("name"), none.alias("arguments"), none.alias("shown")))).otherwise(F.array().cast(_CALLS))
    asked = special.select("conv_id", "turn", "key", "answers", F.posexplode_outer(F.concat("calls", answer)).alias("at", "x"), F.size("calls").alias("n"))
    asked = asked.join(links, F.col("conv_id").eqNullSafe(F.col("lc")) & (F.col("x.id") == F.col("li")), "left")
    own = F.struct(F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), "key")
    is_call = F.col("at") < F.col("n")
    is_first = F.col("call") == F.struct(own["turn"].alias("turn"), own["key"].alias("key"), F.col("at").alias("at"))
    status = F.when(is_call, F.when(F.col("x.id").isNotNull() & ~is_first, "duplicate").otherwise(argument_status(F.col("x.name"), F.col("x.arguments"), tools)))
    link = F.when(~is_call, F.when(F.col("call").isNull(), "orphan").when(F.col("result") == own, "linked").otherwise("duplicate"))
    after = F.when(~is_call & F.col("call").isNotNull(), F.col("call.turn"))
    joined_up = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("at", c.alias("status"))))), lambda s: s["status"]), ",")
    facts = asked.withColumn("status", status).groupBy("conv_id", "turn", "key").agg(
        joined_up(F.col("status")).alias("call_status"),
        joined_up(F.when(F.col("status").isNotNull() & F.col("x.id").isNotNull(), "duplicate").otherwise(F.col("status"))).alias("again"),
        F.max(link).alias("link"),
        F.max(after).alias("after"),
    )
    facts = facts.select(*(F.col(c).alias(f"f_{c}") for c in facts.columns))
    joined = rows.join(facts, F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & F.col("turn").eqNullSafe(F.col("f_turn")) & (F.col("key") == F.col("f_key")), "left")
    # a message that neither calls nor answers is content as it stands, whatever its text holds
    known = F.array_compact(F.array(F.lit("content"), F.lit("role"), F.when(F.col("answers").isNotNull(), "tool_call_id"), F.when(F.size("calls") > 0, "tool_calls")))
    content = F.when(F.col("f_key").isNull(), string(F.col("text"))).otherwise(F.coalesce(F.to_json(F.try_variant_get("parsed", "$.content", "variant")), F.lit("null")))
    parts = F.array_compact(
        F.array(
            _part("content", content),
            _part("role", string(F.col("role"))),
            F.when(F.col("answers").isNotNull(), _part("tool_call_id", string(F.col("answers")))),
            F.when(F.size("calls") > 0, _part("tool_calls", F.concat(F.lit("["), F.array_join(F.transform("calls", lambda c: c["shown"]), ","), F.lit("]")))),
        )
    )
    parts = F.when(F.col("f_key").isNull(), parts).otherwise(F.concat(parts, _others(F.col("parsed"), known)))
    edges = asked.filter(~is_call & F.col("call").isNotNull()).select("conv_id", own.alias("at"), F.struct(F.col("call.turn").alias("turn"), F.col("call.key").alias("key")).alias("up"))
    levels = _levels(edges.filter("at != up").distinct()).select(F.col("conv_id").alias("l_conv_id"), F.col("at").alias("l_at"), F.col("level").alias("l_level"), "depth")
    joined = joined.join(levels, F.col("conv_id").eqNullSafe(F.col("l_conv_id")) & (F.struct(own["turn"].alias("turn"), F.col("key")) == F.col("l_at")), "left")
    out = joined.select("conv_id", "turn", "role", F.size("calls").cast("long").alias("n_calls"), F.coalesce("f_call_status", F.lit("")).alias("call_status"), F.col("f_link").alias("link"), _object(parts).alias("message"), F.coalesce("f_again", F.lit("")).alias("again"), F.coalesce("l_level", own["turn"]).alias("level"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), (F.col("f_after").isNotNull()).cast("int").alias("later"))
    return _positions(out)


def _levels(edges: DataFrame) -> DataFrame:
    """(conv_id, at, level, depth) for the results of ``edges`` (conv_id, at, up): up is the message of at's call.

    level is the largest turn of a message and of all that it answers, one after the other; depth is how many answers lie
    between it and the furthest message of that turn, so (level, depth) is larger than that of the call. A message answers
    one call at most, so each round doubles the answers that are looked through.
    """
    edges = stage(edges, "edges")
    now = edges.select("conv_id", "at", F.col("up").alias("ptr"), F.col("at.turn").alias("level"), F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("hops"), F.col("at").alias("least"))
    for _ in range(edges.count().bit_length()):
        now = stage(_doubled(now), "levels")
        if now.filter("ptr is not null").isEmpty():
            return now.select("conv_id", "at", "level", "depth")
    # what has no end by now leads into a cycle and, starting from a message of the cycle, has seen all of it
    ends = now.filter("ptr is not null").select(F.col("conv_id").alias("pc"), F.col("ptr").alias("pp")).distinct()
    on_cycle = F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("at") == F.col("pp"))
    first = now.filter("at = least").join(ends, on_cycle, "left_semi").select(F.col("conv_id").alias("pc"), F.col("at").alias("pp"))
    if first.isEmpty():
        return now.select("conv_id", "at", "level", "depth")
    return _levels(edges.join(first, on_cycle, "left_anti"))


def _doubled(now: DataFrame) -> DataFrame:
    """Each message's state with that of the message where it ends; messages without a state answer nothing."""
    up = now.select(*(F.col(c).alias(f"u_{c}") for c in now.columns))
    rows = now.join(up, F.col("conv_id").eqNullSafe(F.col("u_conv_id")) & (F.col("ptr") == F.col("u_at")), "left")
    more, level = F.col("ptr").isNotNull(), F.coalesce("u_level", "ptr.turn")
    return rows.select(
        "conv_id",
        "at",
        F.col("u_ptr").alias("ptr"),
        F.greatest("level", level).alias("level"),
        F.when(more & (level >= F.col("level")), F.coalesce("u_depth", F.lit(0)) + F.col("hops")).otherwise(F.col("depth")).alias("depth"),
        F.when(more, F.col("hops") + F.coalesce("u_hops", F.lit(1))).otherwise(F.col("hops")).alias("hops"),
        F.when(more, F.least("least", F.coalesce("u_least", "ptr"))).otherwise(F.col("least")).alias("least"),
    )


def _positions(rows: DataFrame) -> DataFrame:
    """Messages numbered by (level, depth, later, turn, hash, message) within their conversation, over runs of levels; a run
    that holds many messages, as where turns are all alike, is cut on by the rest of that order. A message that repeats the
    one before it to the letter answers and calls nothing anew: its link and statuses are duplicates."""
    rows = stage(rows.withColumn("run", F.floor(F.col("level") / RUN)).withColumn("hash", F.xxhash64("message")), "messages")
    counts = rows.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    full = counts.filter(F.col("n") > MOST_IN_RUN).select(F.col("conv_id").alias("rc"), F.col("run").alias("rr"), F.lit(True).alias("full"))
    cut = ["level", "depth", "later", "turn", "hash"]
    rows = rows.join(full, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("run") == F.col("rr")), "left").drop("rc", "rr")
    fine = {c: F.shiftright("hash", 52) if c == "hash" else F.col(c).cast("long") for c in cut}
    rows = rows.select("*", *(F.when(F.col("full"), fine[c]).alias(f"s_{c}") for c in cut))
    keys = ["conv_id", "run", *(f"s_{c}" for c in cut)]
    order = ["run", *(F.asc_nulls_last(f"s_{c}") for c in cut)]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # a row for each cut
    below = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*(F.col(k).alias(f"b_{k}") for k in keys), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below")).filter("below > 0")
    inside = Window.partitionBy(*keys).orderBy("level", "depth", "later", F.col("turn").asc_nulls_last(), "hash", "message")
    said = F.struct("turn", "role", "message")
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("repeats", F.coalesce(F.lag(said).over(inside).eqNullSafe(said), F.lit(False)) & (F.col("nth") > 1))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys))
    rows = rows.join(below, same, "left")
    position = (F.col("nth") - 1 + F.coalesce("below", F.lit(0))).cast("long")
    status = F.when(F.col("repeats"), F.col("again")).otherwise(F.col("call_status"))
    link = F.when(F.col("repeats") & (F.col("link") == "linked"), "duplicate").otherwise(F.col("link"))
    return rows.select("conv_id", "turn", "role", position.alias("position"), "n_calls", status.alias("call_status"), link.alias("link"), "message")
