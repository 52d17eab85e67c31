import hashlib
from collections import Counter

import pytest

from tallyforge.llm import alignment, subwords, tokencounts

DOCS = "doc_id long, text string, digest string, n_tokens int"
TEXTS = [
    None, "", " ", "a", "Plain words of a text.", "Plain words of a text.", "ünïcödé ☃ 中文字 é", "x<|endoftext|>y", "<s> </s> <unk> <0x41>",
    "a▁b", "tab\tand\nline  and   spaces ", "\x00\x01", "word " * 400, "q" * 5000, "  lead", "🙂🙃 emoji",
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(None if i == 3 else i, t, "x", -1) for i, t in enumerate(texts)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(subwords.public_path(alignment.A_NAME))
    return a, sentencepiece.SentencePieceProcessor(model_file=subwords.public_path(alignment.B_NAME))


def test_counts_are_the_librarys(spark, libraries):
    libraries[0].encode_special_tokens = False
    want = sorted((i if i != 3 else -1, len((t or "").encode()), len(libraries[0].encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in tokencounts.counted(docs(spark), limit=100).collect())
    assert got == want
    assert {r.over_limit for r in tokencounts.counted(docs(spark), limit=100).collect()} == {True, False}


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    folder = f"{cache}/tokenizer={subwords.version(subwords.public_path(tokencounts.TOKENIZER))}"
    first = order(tokencounts.counted(docs(spark), cache=cache))
    stored = spark.read.parquet(folder)
    assert stored.count() == stored.distinct().count() == len({t or "" for t in TEXTS})
    files = set(stored.inputFiles())
    assert order(tokencounts.counted(docs(spark), cache=cache)) == first
    assert set(spark.read.parquet(folder).inputFiles()) == files  # nothing was missing: nothing is appended
    tokencounts.counted(docs(spark, [*TEXTS, "a new text"]), cache=cache).collect()
    assert spark.read.parquet(folder).count() == len({t or "" for t in TEXTS}) + 1
    # a cache to which two runs appended the same counts
    stored.limit(3).write.mode("append").parquet(folder)
    assert order(tokencounts.counted(docs(spark), cache=cache)) == first


def test_a_version_has_its_own_counts(spark, tmp_path):
    b = subwords.public_path(alignment.B_NAME)
    assert subwords.version(b) != subwords.version(subwords.public_path(alignment.A_NAME))
    sp = subwords.library(b)
    rows = tokencounts.counted(docs(spark), cache=f"file://{tmp_path}/cache", path=b).collect()
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id is not None} == {i: len(sp.encode(t or "")) for i, t in enumerate(TEXTS) if i != 3}


def test_empty_tables(spark):
    assert tokencounts.counted(docs(spark, [])).collect() == []
    assert alignment.aligned(docs(spark, [])).collect() == []


def order(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("name", [alignment.A_NAME, alignment.B_NAME])
def test_parts_of_a_long_text_are_independent(name, monkeypatch):
    path = subwords.public_path(name)
    assert subwords.splits_at_spaces(path)
    texts = [" ".join(TEXTS[4:5] * 40), "no-space" * 200, "a  b c\td e\nf g " * 60, "ünï cödé " * 80]
    whole = list(subwords.ids_of(path, texts, special=False))
    monkeypatch.setattr(subwords, "PART", 50)
    monkeypatch.setattr(subwords.parts, "__defaults__", (50,))
    assert len(list(subwords.parts(texts[0]))) > 3 and "".join(subwords.parts(texts[2])) == texts[2]
    assert list(subwords.ids_of(path, texts, special=False)) == whole


def test_word_cache_is_the_library(libraries):
    import random

    r = random.Random(1)
    alphabet = "abé ß  \t\n\r\x0b\x1c\x1f\x85\xa0'st're.,!?12²½-_ªµ×÷ĀɏAɐ中"
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(3000)] + ["it's  we'll 're 'sure ''s 'S", "x<|endoftext|>y", " ", "  ", "\n\n x"]
    libraries[0].encode_special_tokens = True
    cache = subwords.WordCache(subwords.public_path(alignment.A_NAME), most=50)
    for i in range(0, len(texts), 100):
        assert [*cache.ids_of(texts[i : i + 100])] == [e.ids for e in libraries[0].encode_batch(texts[i : i + 100], add_special_tokens=False)]


def spelt(text, libraries):
    """Tokens, links and groups of one text by their definitions."""
    a, b = libraries
    a.encode_special_tokens = True
    of_a, of_b = (subwords.token_bytes(subwords.public_path(n)) for n in (alignment.A_NAME, alignment.B_NAME))
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if not text or any(b"".join(t[i] for i in x) != whole for t, x in zip((of_a, of_b), ids, strict=True)):
        return [], [], [], ""
    spans = []
    for t, x in zip((of_a, of_b), ids, strict=True):
        ends = [0]
        for i in x:
            ends.append(ends[-1] + len(t[i]))
        spans.append(list(zip(ends[:-1], ends[1:], strict=True)))
    links = [(i, j) for i, p in zip(ids[0], spans[0], strict=True) for j, q in zip(ids[1], spans[1], strict=True) if p[0] < q[1] and q[0] < p[1]]
    shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    within = lambda k, low, high: ",".join(str(i) for i, (s, e) in zip(ids[k], spans[k], strict=True) if low <= s and e <= high)
    return *ids, links, ";".join(f"{within(0, x, y)}|{within(1, x, y)}" for x, y in zip([0, *shared], shared, strict=False))


def test_alignment_against_definitions(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD_ROWS", 40)  # several shards
    texts = [t if t is None or len(t) < 2100 else t[:600] for t in TEXTS]
    facts = [spelt(t or "", libraries) for t in texts]
    counts = Counter(pair for f in facts for pair in set(f[2]))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    want = [
        (i if i != 3 else None, len(a), len(b), g.count(";") + bool(g), len(pairs), sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, (a, b, pairs, g) in enumerate(facts)
    ]
    got = alignment.aligned(docs(spark, texts))
    assert order(got) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert any(w[1] == 0 for w in want) and any(w[5] < w[4] for w in want)
