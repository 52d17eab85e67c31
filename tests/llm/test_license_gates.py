"""Operator 7: what the rules match is found with the gates on."""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser

from tallyforge.llm import licenses


def examples(parsed):
    """Texts that an expression matches: each alternative, each optional part with and without."""
    outs = [""]
    for op, arg in parsed:
        if op is c.LITERAL:
            parts = [chr(arg)]
        elif op is c.NOT_LITERAL:
            parts = ["x"]
        elif op is c.IN:
            parts = [chr(v if o is c.LITERAL else v[0]) for o, v in arg]
        elif op is c.BRANCH:
            parts = [x for branch in arg[1] for x in examples(branch)]
        elif op is c.SUBPATTERN:
            parts = examples(arg[3])
        elif op is c.MAX_REPEAT:
            low, high, inner = arg
            parts = sorted({x * n for x in examples(inner) for n in {low, min(high, max(low, 1))}})
        else:
            raise AssertionError(op)
        outs = [a + b for a in outs for b in parts][:40]
    return outs


def without_gates(words):
    """(at, end, priority) of the matches of all rules, less those inside another."""
    text, found = f" {words} ", []
    for p, _, _, x in licenses.rules():
        for m in re.finditer(rf"(?<= )(?:{x})(?= )", text):
            at = text[: m.start()].count(" ") - 1
            found.append((at, at + m.group().count(" ") + 1, p))
    inside = lambda d, o: o[0] <= d[0] and d[1] <= o[1] and (o[:2] != d[:2] or o[2] < d[2])
    return sorted(d for d in found if not any(inside(d, o) for o in found))


def test_every_rule_is_found(spark):
    texts = sorted({t for *_, x in licenses.rules() for t in examples(_parser.parse(x))})
    texts += ["Released under the GPLv3.", "see LGPLv3 and AGPLv3", "BSD Zero Clause", "made available under CC", "a committee of the public"]
    got = {r["doc_id"]: r for r in licenses.scanned(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = " ".join(re.findall("[a-z0-9]+", t.lower()))
        assert [(d["at"], d["end"], d["priority"]) for d in got[i]["detections"]] == without_gates(words), t
        assert got[i]["labels"] or t.startswith("a committee"), t


def test_base_and_scores_by_hand(spark):
    texts = ["Licensed under the MIT License, see LICENSE.", "cc by 4.0 and cc by sa 3.0; all rights reserved", "plain words only", "released under the MIT. " * 400, None]
    got = licenses.scanned(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    for r, t in zip(got, texts, strict=True):
        words = " ".join(re.findall("[a-z0-9]+", (t or "").lower()))
        want = without_gates(words)
        covered = {w for a, b, _ in want for w in range(a, b)}
        n = len(want) or r["n_base"]
        share = len(covered) / len(words.split()) if words else 0.0
        assert abs(r["score"] - max(share, 1 - 0.5**n)) < 1e-12
    assert got[3]["labels"] == "grant:mit" and len(got[3]["detections"]) == 400
    again = licenses.scanned(spark.createDataFrame([(1, texts[1], 5), (1, texts[1], 5)], "doc_id long, text string, Spaced int")).collect()
    assert again[0] == again[1] and again[0]["labels"] == got[1]["labels"]
