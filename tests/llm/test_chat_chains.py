"""Operator 8: results follow their calls over several hops."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from tallyforge.llm import chat


def message(answers=None, calls=()):
    out = {"content": None}
    if answers:
        out["tool_call_id"] = answers
    if calls:
        out["tool_calls"] = [{"id": i, "name": "search", "arguments": {"query": "q"}} for i in calls]
    return json.dumps(out)


def order(spark, turns):
    """Turns of each conversation by position."""
    rows = [(c, t, "assistant", text) for c, t, text in turns]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    out = {}
    for r in sorted(got, key=lambda r: (r["conv_id"], r["position"])):
        out.setdefault(r["conv_id"], []).append(r["turn"])
    return out


def test_chains_and_cycles(spark):
    turns = [
        # two hops, the second result after the first, and before it
        (1, 1, message("x", ["y"])), (1, 2, message("y")), (1, 3, "hi"), (1, 5, message(None, ["x"])), (1, 6, "end"),
        (2, 1, message("y")), (2, 2, message("x", ["y"])), (2, 5, message(None, ["x"])),
        # a cycle, and what follows it; a message that answers itself
        (3, 1, message("b", ["a"])), (3, 2, message("a", ["b", "c"])), (3, 0, message("c")), (3, 4, message("s", ["s"])),
    ]
    # a long chain against the turns
    turns += [(4, t, message(f"i{t + 1}" if t < 40 else None, [f"i{t}"])) for t in range(41)]
    got = order(spark, turns)
    assert got[1] == [3, 5, 1, 2, 6] and got[2] == [5, 2, 1]
    assert got[3] == [1, 2, 0, 4]
    assert got[4] == list(range(40, -1, -1))


SCHEMA = {
    "book": {
        "properties": {
            "when": {"properties": {"day": {"type": "string"}, "hours": {"type": "array", "items": {"type": "integer"}}}, "required": ["day"], "type": "object"},
            "unit": {"enum": ["c", "f"]},
            "a.b": {"type": ["number", "null"]},
        },
        "required": ["when"],
    }
}


def test_schemas_of_any_depth(spark):
    want = {
        '{"when":{"day":"m","hours":[1,2]},"unit":"c","more":1}': "ok",
        '{"when":{"hours":[1]}}': "missing:when.day",
        '{"when":{"day":"m","hours":[1,"x"]}}': "type:when.hours[]",
        '{"when":[],"unit":"c"}': "type:when",
        '{"unit":"k","when":{"day":"m"}}': "enum:unit",
        '{"when":{"day":"m"},"a.b":null}': "ok",
        '{"when":{"day":"m"},"a.b":"x"}': "type:a.b",
        "{}": "missing:when",
        "[]": "invalid_json",
        "{": "invalid_json",
    }
    rows = spark.createDataFrame([(a,) for a in want], "a string")
    got = rows.select("a", chat.argument_status(F.lit("book"), F.col("a"), SCHEMA).alias("s")).collect()
    assert {r["a"]: r["s"] for r in got} == want


def test_order_by_brute_force(spark):
    rng = random.Random(3)
    turns = []
    for c in range(25):
        names = [f"n{i}" for i in range(6)]
        for t in range(8):
            answers = rng.choice([None, *names])
            turns.append((c, t, message(answers, [n for n in names if rng.random() < 0.2])))
    got = order(spark, turns)
    for c in range(25):
        mine = [(t, json.loads(m)) for cc, t, m in turns if cc == c]
        first = {}
        for t, m in mine:
            for call in m.get("tool_calls", ()):
                first.setdefault(call["id"], t)
        up = {t: first[m["tool_call_id"]] for t, m in mine if m.get("tool_call_id") in first and first[m["tool_call_id"]] != t}

        def cyclic(t, up=up):
            seen, x = set(), t
            while x in up and x not in seen:
                seen.add(x)
                x = up[x]
            return x in up and x in seen and _on(x, t, up)

        at = {t: i for i, t in enumerate(got[c])}
        assert sorted(at) == list(range(8))
        for t, u in up.items():
            if not cyclic(t):
                assert at[u] < at[t], (c, t, u, got[c])


def _on(x, t, up):
    """Whether t itself lies on the cycle that holds x."""
    y = up[x]
    while y != x and y != t:
        y = up[y]
    return y == t or x == t


def test_chat_edges(spark):
    call = message(None, ["z"])
    rows = [(1, 0, "user", "long " * 50_000, 1, "x"), (1, 1, "assistant", call, 1, "x"), (1, 1, "assistant", call, 1, "x"), (1, 2, "tool", message("z"), 1, "x")]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Key int, Level string")).collect()
    assert sorted(r["position"] for r in got) == [0, 1, 2, 3] and {r["link"] for r in got} == {None, "linked"}
