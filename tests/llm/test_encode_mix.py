import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codequarry.llm import encode, mix

VOCABULARY = encode.VOCABULARY


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def ours(texts):
    ids, begins = encode.encode_texts(texts, VOCABULARY)
    return [ids[begins[i] : begins[i + 1]].tolist() for i in range(len(texts))]


def test_known_texts(reference):
    texts = ["", None, " ", "aaaaaaaaa", "a aa aaa", "<|endoftext|>", "don't we'll\r\n\r\n", "数据 中文。", "👩‍💻 é ｶ", "x" * 50_000, "ab " * 20_000, "\x1c \x85 ﻿"]
    want = [reference.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    assert ours(texts) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_texts(texts):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    got = ours(texts)
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [t.decode(g, skip_special_tokens=False) for g in got] == texts


def test_vocabulary_is_a_setting(spark, tmp_path):
    """The file may come from the session's setting, or by name from the files that the session ships."""
    import shutil

    shutil.copy(VOCABULARY, tmp_path / "own_vocabulary.json")
    spark.sparkContext.addFile(str(tmp_path / "own_vocabulary.json"))
    docs = spark.createDataFrame([(1, "the cache")], "doc_id long, text string")
    spark.conf.set(encode.SETTING, "own_vocabulary.json")
    try:
        assert encode.vocabulary_of(spark) == "own_vocabulary.json" and encode.vocabulary_of(spark, "x") == "x"
        assert encode.encode_corpus(docs).first().ids == ours(["the cache"])[0]
    finally:
        spark.conf.unset(encode.SETTING)


def test_spark_rows(spark):
    rows = [(1, "the cache", "k", "t"), (2, None, "k", "t"), (3, "", "k", "t"), (3, "", "k", "t"), (None, "the cache", "k", "t")]
    got = encode.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, key string, ids string"))
    assert got.columns == ["doc_id", "ids"]
    by = sorted((r.doc_id or 0, tuple(r.ids)) for r in got.collect())
    the = tuple(ours(["the cache"])[0])
    assert by == [(0, the), (1, the), (2, ()), (3, ()), (3, ())]
    assert encode.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


DOCS = "doc_id long, text string, source string, h string, quality double"
TARGETS = "source string, target_weight double, max_repeats int"


def test_mix_shares_and_caps(spark):
    rows = [(i, f"text number {i} of source a with some words", " A " if i % 2 else "a", "h", 1.0) for i in range(300)]
    rows += [(1000 + i, f"another text {i} in source b, longer than the others by a few more words", "b", "h", 1.0) for i in range(40)]
    rows += [(2000 + i, "the same text again", "a", "h", 1.0) for i in range(50)] + [(3000, None, "a", "h", 1.0), (3001, "", "b", "h", 1.0), (3002, "no source", None, "h", 1.0), (3003, "other", "z", "h", 1.0)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2)], TARGETS)
    m, r = mix.mix_sources(docs, targets)
    got, report = m.collect(), {x.source: x for x in r.collect()}
    assert max(x.repeats for x in got if x.source == "a") == 1 and max(x.repeats for x in got if x.source == "b") <= 3
    assert len({x.doc_id for x in got}) == len(got) and sum(2000 <= x.doc_id < 3000 for x in got) <= 1
    assert {x.source for x in got} == {"a", "b"}
    used = {s: sum(x.n_tokens * x.repeats for x in got if x.source == s) for s in "ab"}
    assert used == {s: report[s].tokens_used for s in "ab"} and report["none"].tokens_used == 0
    assert abs(report["a"].actual_share - 5 / 9) < 0.01 and abs(report["b"].actual_share - 4 / 9) < 0.01
    repeats = {x.repeats for x in got if x.source == "b"}
    assert max(repeats) - min(repeats) <= 1  # complete epochs come first
    again = mix.mix_sources(docs, targets)[0].collect()
    assert sorted(again) == sorted(got)


def test_total_and_cap(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "a", "h", 1.0) for i in range(10)], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    size = mix.mix_sources(docs, targets)[1].first().tokens_available
    assert mix.mix_sources(docs, targets, total_tokens=10**6)[1].first().tokens_used == 2 * size
    assert mix.mix_sources(docs, targets, total_tokens=size + size // 2)[0].selectExpr("max(repeats)").first()[0] == 2


def test_weights_lead(spark):
    """Heavier texts are drawn more often; texts of no weight only when all others are used."""
    rows = [(i, f"words of text number {i} that read well enough", "a", "h", 8.0 if i < 300 else 1.0 if i < 600 else (None, 0.0, -1.0, float("nan"))[i % 4]) for i in range(900)]
    targets, docs = spark.createDataFrame([("a", 1.0, 1)], TARGETS), spark.createDataFrame(rows, DOCS)
    total = mix.mix_sources(docs, targets)[1].first().tokens_available
    got = [x.doc_id for x in mix.mix_sources(docs, targets, weight="quality", total_tokens=total // 4)[0].collect()]
    assert sum(d < 300 for d in got) > 3 * sum(300 <= d < 600 for d in got) > 0 and max(got) < 600
    most = {x.doc_id for x in mix.mix_sources(docs, targets, weight="quality", total_tokens=int(total * 0.8))[0].collect()}
    assert most > set(range(600)) and len(most) < 800


@pytest.mark.parametrize("weight", [None, "weight"])
def test_same_as_in_order(spark, reference, monkeypatch, weight):
    """On the given tables: tokens by the public library, and texts taken one by one in order of their keys."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("weight", mix.letter_share("text"))
    targets = spark.read.parquet("/root/testdata/sf0.01/mix_targets.parquet")
    want = [(r.source.strip().lower(), r.target_weight, r.max_repeats) for r in targets.collect()]
    first: dict = {}
    for r in docs.orderBy("doc_id").collect():
        s = (r.source or "").strip().lower()
        if r.text and s in {w[0] for w in want}:
            first.setdefault(r.text, (r.doc_id, s))
    keys = {r.doc_id: r.key for r in mix.usable_texts(docs, targets, weight=weight).collect()}
    by = {w[0]: [] for w in want}
    for text, (i, s) in first.items():
        by[s].append((keys[i], i, len(reference.encode(text, add_special_tokens=False).ids)))
    have = {s: sum(n for *_, n in t) for s, t in by.items()}
    assert len(keys) == sum(map(len, by.values()))
    mine, report = {}, {}
    for s, w, r, size, budget, epochs, rest in mix.budgets(have, want):
        at = used = 0
        for _, i, n in sorted(by[s]):
            repeats = epochs + (at + n / 2 <= rest)
            at += n
            if repeats:
                mine[i], used = (s, n, repeats), used + n * repeats
        report[s] = (w, r, size, used)
        assert abs(used - budget) <= max((n for *_, n in by[s]), default=0)
    monkeypatch.setattr(mix, "SMALL", 3)  # several levels of buckets
    m, shares = mix.mix_sources(docs, targets, weight=weight)
    assert {r.doc_id: (r.source, r.n_tokens, r.repeats) for r in m.collect()} == mine
    whole = sum(v[3] for v in report.values())
    for x in shares.collect():
        assert (x.target_weight, x.max_repeats, x.tokens_available, x.tokens_used) == report[x.source] and abs(x.actual_share - x.tokens_used / whole) < 1e-12


def test_mix_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    m, r = mix.mix_sources(docs, targets)
    assert m.count() == 0 and r.first().actual_share == 0.0
    full = spark.createDataFrame([(1, "x y", "a", "h", 1.0)], DOCS)
    assert mix.mix_sources(full, spark.createDataFrame([], TARGETS))[0].count() == 0
