"""Operators 4, 7, 8, 9 and 10: the library, brute force, fixtures and held-out accuracy."""

from __future__ import annotations

import hashlib
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import bpe, chat, langid, licenses, urlfilter

DATA = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


ODD = ["", "ΑΣ ΑΣΑ Σ", "İstanbul ǅ ﬁ", "a<|startoftext|>b <|endoftext|>", "<|STARTOFTEXT|>", "a\x1cb\x85c d​e'S it's I'LL ½²", "日本語 é", "x" * 3000 + "ab" * 2000, "👨‍👩‍👧", "\x00a\x00", "a" * 70 + " " + "ß" * 40]


def test_bpe_is_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas()
    texts = [*docs.text, *ODD]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], TEXT)
    got = {r["doc_id"]: tuple(r)[1:4] for r in bpe.encoded(rows).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in [*enumerate(texts), (-1, "")]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))), t[:50]
    assert bpe.encoded(rows.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=40))
def test_bpe_any_latin_text(library, text):
    t = bpe.tokenizer(bpe.default_path())
    ids = t.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert t.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_side_by_side_is_one_by_one():
    t = bpe.tokenizer(bpe.default_path())
    words = ["a", "ab", "hello", "zzzzzzzz", "thethethe", "é", "x" * 64, "q" * 65, "ab" * 30]
    assert t.merge_many(words) == [t.merge(w) for w in words]


def base_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for i in range(len(w)) for p, label in licenses.BASE if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts += ["CC BY cc by. CC-BY-NC 4.0 all rights reserved", None, "...", "cc by", "All rights\nreserved General Public License all rights reserved", "ccby xcc by", "", "Ünder the GNU General Public License, version 3.", "SPDX-License-Identifier: MIT"]
    got = {r["doc_id"]: r for r in licenses.scanned(spark.createDataFrame([*enumerate(texts)], TEXT)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == base_by_hand(t), t
        assert 0 <= got[i]["score"] <= 1 and set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(","))
    assert "gpl-3.0" in got[len(texts) - 2]["labels"] and got[len(texts) - 1]["labels"] == "spdx:mit"
    first = got[len(texts) - 9]["labels"].split(",")
    assert "cc-by-nc-4.0" in first and "cc-by-nc" not in first  # contained detections give way
    assert len(licenses.rules()) > 200
    assert licenses.scanned(spark.createDataFrame([], TEXT)).count() == 0


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identified(docs.drop("n_chars")).toPandas().merge(docs.toPandas(), on="doc_id")
    assert (got.held_out == got.doc_id.map(langid.crc_held_out)).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97
    net = langid.Network(["x", "y"])
    assert langid.predict(net, [None, "", "123 ...", "abc"])[:3] == [("und", 0.0)] * 3
    edge = spark.createDataFrame([(1, None, None), (2, "", "en"), (None, "abc", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identified(edge, net).collect()} <= {"und", "x", "y"}
    assert langid.fit(edge.limit(0)) is None and langid.identified(edge.limit(0)).count() == 0
    kept = langid.accepted(edge, 0.0, net)
    assert [r["text"] for r in kept.collect()] == ["abc"] and kept.columns == edge.columns


def glob_regex(glob):
    return re.compile("".join("[^\x01]*" if g is None else "(?s:.*)" if g == "any" else re.escape("\x01" if g == 256 else chr(g)) for g in glob))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc.\x01", max_size=30), min_size=1, max_size=8))
def test_automaton_is_regular_expressions(texts):
    globs = [tuple(None if c == "*" else "any" if c == "%" else 256 if c == "\x01" else ord(c) for c in g) for g in ("a*b", "*", "abc", "*.a\x01%", "a\x01b%", "%c", "*a*b*", "", "ab" * 20 + "%", "b%\x01%")]
    hit = urlfilter.Automaton(globs).matches([[256 if c == "\x01" else ord(c) for c in t] for t in texts])
    for t, row in zip(texts, hit, strict=True):
        assert row.tolist() == [bool(glob_regex(g).fullmatch(t)) for g in globs]


def test_urls(spark):
    urls = ["https://x.EXAMPLE.com/en/7?q", "http://com/en/", "http://example.com/en/8", "ftp://a.net/de/1", "http://b.example.net/de/81", "http://org/es/x#y", "http://notorg.orgx/es/", None, "", "no-url", "http://", "https://free-bets.example.com/fr/1", "http://h/com/en/1", "http://a.com:80/en/", "http://x.com/EN/"]
    got = {r["page_id"]: tuple(r)[1:5] for r in urlfilter.judged(spark.createDataFrame([*enumerate(urls)], "page_id long, url string")).collect()}
    assert got[0] == ("x.example.com", "/en/7", "example.com/en/7", "allow") and got[1] == ("com", "/en/", "com/en/", "block")
    assert got[2][2:] == ("com/en/", "block") and got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("org/es/", "block")
    assert all(got[i][2:] == (None, "allow") for i in (6, 7, 8, 9, 10, 12, 13, 14)) and got[7][:2] == ("", "") and got[11][2:] == (None, "block")
    assert urlfilter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_chat(spark):
    call = lambda *cs: json.dumps({"content": None, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in cs]})
    rows = [
        (1, 0, "user", 'hi "x"\n'),
        (1, 1, "assistant", call(("a", "search", {"query": "q", "limit": 2}), ("b", "search", '{"limit":"x","query":"z"}'))),
        (1, 2, "tool", '{"tool_call_id":"a","content":"res"}'),
        (1, 3, "tool", '{"tool_call_id":"c","content":"early"}'),
        (1, 4, "assistant", call(("c", "weather", {"town": 1}), ("a", "nope", {}), ("d", "nope", {}), ("e", "fetch", "not json"))),
        (1, 5, "tool", '{"tool_call_id":"zz"}'),
        (1, 6, "tool", '{"tool_call_id":"a","content":"again"}'),
        (None, None, None, None),
        (2, 0, "user", ""),
        (2, 0, "user", ""),
    ]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [r["turn"] for r in one] == [0, 1, 2, 4, 3, 5, 6] and [r["position"] for r in one] == list(range(7))
    by = {r["turn"]: r for r in one}
    assert by[1]["call_status"] == "ok,type:limit" and by[4]["call_status"] == "missing:city,duplicate,unknown_tool,invalid_json"
    assert [by[t]["link"] for t in (2, 3, 5, 6)] == ["linked", "linked", "orphan", "duplicate"]
    for r in got:
        assert json.dumps(json.loads(r["message"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["message"]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(empty).count() == 0


def test_chat_nested_calls_and_other_members(spark):
    nested = {"content": [{"text": "hi", "type": "text"}], "refusal": None, "tool_calls": [{"id": "a", "type": "function", "index": 0, "function": {"name": "search", "arguments": '{"query":"q"}', "strict": True}}, "odd"]}
    rows = [
        (1, 0, "assistant", json.dumps(nested)),
        (1, 1, "user", '{"tool_call_id":"a","content":"mine"}'),
        (1, 2, "tool", '{"tool_call_id":"a","content":"res","meta":{"b":1,"a":[2]}}'),
        (1, 2, "tool", '{"tool_call_id":"a","content":"res","meta":{"b":1,"a":[2]}}'),
        (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "x", "name": "search", "arguments": {"query": "q"}, "note": "é"}]})),
        (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "x", "name": "search", "arguments": {"query": "q"}, "note": "é"}]})),
    ]
    got = sorted(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: (r["conv_id"], r["position"]))
    assert [r["position"] for r in got] == [0, 1, 2, 3, 0, 1]
    first = json.loads(got[0]["message"])
    assert first == {"content": nested["content"], "refusal": None, "role": "assistant", "tool_calls": [{"arguments": {"query": "q"}, "function": {"strict": True}, "id": "a", "index": 0, "name": "search", "type": "function"}, "odd"]}
    assert got[0]["call_status"] == "ok,invalid_json" and got[0]["n_calls"] == 2
    assert got[1]["link"] is None and json.loads(got[1]["message"])["content"] == rows[1][3]
    assert [r["link"] for r in got[2:4]] == ["linked", "duplicate"] and json.loads(got[2]["message"])["meta"] == {"a": [2], "b": 1}
    assert [r["call_status"] for r in got[4:]] == ["ok", "duplicate"] and json.loads(got[4]["message"])["tool_calls"][0]["note"] == "é"
    for r in got:
        assert json.dumps(json.loads(r["message"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["message"]


def test_chat_many_messages_of_one_turn(spark, monkeypatch):
    monkeypatch.setattr(chat, "MOST_IN_RUN", 50)
    rows = [(1, None if i % 3 else 5, "user", f"m{i % 150}") for i in range(400)] + [(1, i, "user", "x") for i in range(20)]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r["position"] for r in got) == list(range(420))
    turns = [r["turn"] for r in sorted(got, key=lambda r: r["position"])]
    assert turns == sorted(turns, key=lambda t: (t is None, t))
