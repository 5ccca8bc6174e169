"""Ranking, vectors, graph variants, index upkeep, stores and sources on small fixtures."""

import math
import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.functions import text as fx
from codequarry.operators import graph, index, ranking, search, vectors
from codequarry.sources import files
from codequarry.sources.store import Store

DOCS = "id string, content string"


def test_bm25_edges(spark):
    docs = spark.createDataFrame([("a", "cache cache miss"), ("b", "cache hit"), ("c", ""), ("d", None), ("e", "the class")], DOCS)
    score = lambda q: {r.id: r.score for r in ranking.bm25_scores(docs, "id", "content", q).collect()}
    assert score("") == score("the class") == score("zzz") == {}
    once, twice = score("cache"), score("cache cache")
    assert set(once) == {"a", "b"} and all(math.isclose(2 * once[k], twice[k]) for k in once)
    mean, n, df = 5 / 5, 5, 2
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    assert math.isclose(once["b"], idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / mean)))
    assert [r.id for r in ranking.top(ranking.bm25_scores(docs, "id", "content", "cache"), "id", 99).collect()] == ["a", "b"]
    assert ranking.bm25_scores(docs.limit(0), "id", "content", "cache").count() == 0


def test_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0]), ("c", [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id string, v array<float>")
    assert [(r.id, r.score) for r in vectors.nearest(v, "id", "v", [1.0, 0.0], 3).collect()] == [("a", 0.0), ("c", 0.0), ("z", 1.0)]
    assert [(r.id, r.score) for r in vectors.nearest(v, "id", "v", [2.0, 0.0], 9, metric="cosine").collect()] == [("a", 1.0), ("c", 1.0), ("b", 0.0), ("z", 0.0)]


CHUNKS = "id string, project_path string, file_path string, content string, language string, chunk_type string, fqn string, vector array<float>, summary_vector_json string"


def test_search_modes(spark):
    rows = [("a", "p", "/p/a.ts", "cache miss", "ts", "f", "X.a", [1.0, 0.0], "[1, 0]"), ("b", "p", "/p/b.ts", "other words", "ts", "f", None, [0.8, 0.6], "broken"), ("c", "q", "/q/c.py", "cache", "py", "g", "Y", None, None)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    related = spark.createDataFrame([("Y",)], "qualified_name string")
    o = search.SearchOptions(text="cache", vector=[1.0, 0.0], limit=5)
    run = lambda o, **kw: {r.id: round(r.score, 4) for r in search.search(chunks, related, o, **kw).collect()}
    hybrid = run(o)
    assert set(hybrid) == {"a", "b", "c"} and math.isclose(hybrid["b"], 0.4)
    assert hybrid["c"] == round(0.3 + 0.06, 4) or hybrid["a"] >= 0.5
    assert run(replace(o, mode="vector-only")) == {"a": 1.0, "b": 0.8}
    assert run(replace(o, mode="vector-graph")) == {"a": 1.0, "b": 0.8}
    assert run(replace(o, threshold=0.45)) == {k: v for k, v in hybrid.items() if v >= 0.45}
    assert run(replace(o, mode="vector-only"), summaries=False) == hybrid
    assert set(run(replace(o, language="py"))) == {"c"} and set(run(replace(o, project="p", path_prefix="/p/b"))) == {"b"}
    assert run(replace(o, summary=True))["a"] == round(hybrid["a"] + 0.25, 4)
    with pytest.raises(ValueError):
        run(replace(o, mode="other"))


def test_graph_variants(spark):
    n = spark.createDataFrame([("a", "function", "m.a", "/f", False), ("b", "function", "m.b", "/f", True), ("c", "method", "m.b", "/g", False), ("d", "enum", "D", "/g", False)], "id string, kind string, qualified_name string, file_path string, is_exported boolean")
    e = spark.createDataFrame([("a", "b", "calls", 1), ("a", "b", "calls", 2), ("a", "a", "calls", 1), ("gone", "b", "calls", 1), ("a", "c", "contains", None), ("c", "lost", "calls", 1)], "source string, target string, kind string, line int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(graph.callers(n, e, "m.b")) == ["a"] and ids(graph.callees(n, e, "m.a")) == ["a", "b"]
    assert ids(graph.dead_code(n, e)) == ["c"] and ids(graph.dead_code_engine(n, e)) == ["d"]
    roles = {(r.role, r.id) for r in graph.context(n, e, n.where("id = 'b'")).collect()}
    assert roles == {("incoming", "a")}
    assert {(r.role, r.id) for r in graph.context(n, e, n.where("id = 'b'"), semantics="as_coded").collect()} == {("incoming", "a"), ("outgoing", "b")}
    assert {r[0] for r in graph.related_names(n, e).collect()} == {"m.a", "m.b"}


def test_merges(spark):
    s = "k string, a int, b int"
    old, new = spark.createDataFrame([("x", 1, 1), ("y", 2, 2)], s), spark.createDataFrame([("y", 9, None), ("z", 3, 3)], s)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.merge_by_key(old, new, ["k"])) == [("x", 1, 1), ("y", 9, None), ("z", 3, 3)]
    merged = index.merge_by_key(old, new, ["k"], keep=["a"], fill=["b"])
    assert rows(merged) == [("x", 1, 1), ("y", 2, 2), ("z", 3, 3)] == rows(index.merge_by_key(merged, new, ["k"], keep=["a"], fill=["b"]))
    assert rows(index.replace_by_key(old, new, ["k"])) == [("x", 1, 1), ("y", 9, None), ("z", 3, 3)]
    assert rows(index.merge_by_key(old.limit(0), new, ["k"])) == rows(new)


def slot(word):
    h = 5381
    for ch in word:
        low = (h * 32) & 0xFFFFFFFF
        h = (low - (1 << 32) if low >= 1 << 31 else low) + h + ord(ch)
    return abs(h) % 3072


def test_local_embedding(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcxyz_019") for _ in range(r.randint(3, 30))) for _ in range(200)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", index.word_slot("w").alias("s")).collect()
    assert all(x.s == slot(x.w) for x in got)
    v = index.local_embedding(spark.createDataFrame([(1, "Cache cache miss is"), (2, ""), (3, None)], "k int, t string"), "k", "t").collect()
    assert {x.k for x in v} == {1} and math.isclose(sum(x.weight**2 for x in v), 1.0) and {x.slot for x in v} == {slot("cache"), slot("miss")}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(1, 30))
def test_fit_pieces(text, longest):
    pieces = index.fit_pieces(text, longest)
    assert all(p and len(p) <= longest for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(1, 9))
def test_pack_lines(text, size):
    chunks = index.pack_lines(text, size)
    assert "".join(text[s:e] for s, e, *_ in chunks).split() == text.split()
    for s, e, first, last in chunks:
        assert len(text[s:e].split()) <= size or first == last or len([x for x in text[s:e].split("\n") if x.split()]) == 1
        assert text[:s].count("\n") + 1 == first


def test_split_messages(spark):
    rows = spark.createDataFrame([("a", "x" * 3900), ("b", "x" * 3901), ("c", None), ("d", "  "), ("e", "ü" * 3000 + " " + "y" * 3000)], DOCS)
    got = index.split_messages(rows, "id", "content").collect()
    assert sorted((r.id, r.piece_no, len(r.piece)) for r in got) == [("a", 0, 3900), ("b", 0, 3900), ("b", 1, 1), ("e", 0, 3000), ("e", 1, 3000)]


def test_unique_slugs(spark):
    rows = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x-2"), ("4", "x"), ("5", "y"), ("6", "x-5")], "k string, base string")
    got = {r.k: r.slug for r in index.unique_slugs(rows, "k", "base", "k").collect()}
    assert got == {"1": "x", "2": "x-3", "3": "x-2", "4": "x-4", "5": "y", "6": "x-5"}


def test_text_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first().v
    assert [val(fx.epoch_ms(F.lit(x))) for x in ("1700000000", "1700000000123", "1700000000123456", "1700000000123456789", "2023-11-14 22:13:20", "x", "-5", "")] == [1700000000000, *[1700000000123] * 3, 1700000000000, 0, 0, 0]
    assert val(fx.ulid_ms(F.lit("ses_01HF7YAT00ABCDEFGHJKMNPQRS"))) == 1700000000000 and val(fx.ulid_ms(F.lit("01HF"))) is None
    assert val(fx.normal_path(F.lit(" /A/b// "))) == "/A/b" and val(fx.normal_path(F.lit("//"))) == "/" and val(fx.normal_path(F.lit(" "))) is None
    assert val(fx.slug(F.lit("  Ünï code! "), 5)) == "n-cod" and val(fx.slug(F.lit(None).cast("string"))) == "untitled"
    assert val(fx.scoped_parts(F.lit("-7::/w/x::y"))) == (-7.0, "/w/x::y") and all(val(fx.scoped_parts(F.lit(x))) is None for x in ("::/w", "7::", "a::/w", "7:/w", ""))
    odd = F.concat(F.lit(" \ufeffa"), F.repeat(F.lit(" \n"), F.lit(500_000)), F.lit("b\u00a0\n"))
    assert val(F.length(fx.strip(odd))) == 1_000_002 and val(fx.strip(F.repeat(F.lit(" "), F.lit(1_000_000)))) == "" and val(fx.strip(F.lit(" a b\n"))) == "a b"
    assert val(fx.scoped_path(F.lit(7), F.lit("/w"))) == "7::/w"
    assert val(fx.retry_wait_ms(F.lit("try again in 1.2s"))) == 1200 and val(fx.retry_wait_ms(F.lit("no"))) is None
    assert val(fx.command(F.lit(" /New-Task@bot a b"))) == "new_task" and val(fx.command_arguments(F.lit(" /New-Task@bot a b"))) == "a b"


def test_ignore_rules(spark):
    rules = ["*.log", "node_modules", "/only", "src/**/gen", "build/", "!keep.log", "# x", ""]
    cases = {"a.log": True, "d/keep.log": False, "a/node_modules/b.ts": True, "only/x": True, "a/only/x": False, "src/a/b/gen/c.ts": True, "src/gen": True, "x/src/gen": False, "build": False, "a/build/x": True, "node_modules2/a": False, "a\\node_modules\\b": True}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", files.ignored("p", rules).alias("i")).collect()
    assert {r.p: r.i for r in rows} == cases


def test_scan_store_and_config(spark, tmp_path):
    for p, t in {"src/a.ts": "let a", "src/b.py": "b", "dist/c.ts": "c", "notes.txt": "n", "src/big.ts": "x" * 500}.items():
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_text(t)
    root = str(tmp_path / "tree")
    scanned = files.scan_sources(spark, root, longest=100)
    assert {(r.file_path, r.language) for r in scanned.collect()} == {("src/a.ts", "typescript"), ("src/b.py", "python")}
    assert tuple(files.count_files(spark, root).first()) == (3, 1)
    assert {tuple(r) for r in files.skipped_files(spark, root, longest=100).collect()} == {("dist/c.ts", "ignored"), ("notes.txt", "ending"), ("src/big.ts", "size")}
    (tmp_path / "tree/.gitignore").write_text("# own\n*.py\n")
    (tmp_path / "tree/.indexignore").write_text("!src/b.py\nsrc/big*\n")
    assert {r.file_path for r in files.kept_files(spark, root).collect()} == {"src/a.ts", "src/b.py"}
    (tmp_path / "tree/src/odd [1]{x}.ts").write_text("odd")
    assert [r.content for r in files.scan_sources(spark, root, endings=["ts"], rules=["a.ts", "big.ts", "dist"]).collect()] == ["odd"]
    (tmp_path / "tree/src/odd [1]{x}.ts").unlink()
    assert files.scan_sources(spark, root, endings=["rs"]).count() == 0
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("code_chunks").count() == 0
    store.append("code_chunks", scanned.select("file_path", "content", "file_hash", F.lit("p").alias("project_path"), F.col("file_path").alias("id")))
    (tmp_path / "tree/src/a.ts").write_text("let changed")
    changed = files.changed_sources(files.scan_sources(spark, root, longest=100), store.read("code_chunks"))
    assert [r.file_path for r in changed.collect()] == ["src/a.ts"]
    store.replace("code_chunks", changed.select("file_path", "content", "file_hash", F.lit("p").alias("project_path"), F.lit("new").alias("id")), ["file_path"])
    assert {(r.id, r.content) for r in store.read("code_chunks").collect()} == {("src/b.py", "b"), ("new", "let changed")}
    store.delete("code_chunks", "file_path = 'src/b.py' OR summary = 'x'")
    assert [r.id for r in store.read("code_chunks").collect()] == ["new"]
    store.update("code_chunks", "id = 'new'", {"summary": F.upper("content")})
    store.update("code_chunks", "id = 'none'", {"summary": F.lit("lost")})
    assert [(r.id, r.summary, r.content) for r in store.read("code_chunks").collect()] == [("new", "LET CHANGED", "let changed")]
    with pytest.raises(ValueError):
        store.append("code_chunks", spark.createDataFrame([(1,)], "unknown int"))
    assert files.read_config('{"a": 1, /* c */ "b": {"x": "// no", "y": [1, 2,],},} // end', {"b": {"z": 3}}) == {"a": 1, "b": {"z": 3, "x": "// no", "y": [1, 2]}}
    assert files.read_config("broken", {"a": 1}) == {"a": 1}
    env = spark.createDataFrame([("A=1",), ("# B=2",), (" C = 'x y' ",), ('D="q"',), ("",)], "value string")
    assert {tuple(r) for r in files.parse_env(env).collect()} == {("A", "1"), ("C", "x y"), ("D", "q")}
    roots = spark.createDataFrame([("My App=/w/app/; /w/lib ;;=/z",)], "v string")
    assert {tuple(r) for r in files.parse_roots(roots, "v").collect()} == {(0, "my-app", "My App", "/w/app"), (1, "lib", "lib", "/w/lib"), (3, "z", "z", "/z")}
    (tmp_path / "rows.json").write_text('{"messages": [{"a": 1}, {"a": 2}]}')
    assert sorted(r.j for r in files.json_rows(spark, str(tmp_path / "rows.json"), "j").collect()) == ['{"a":1}', '{"a":2}']


def test_word_index_gives_the_same_scores(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cache parser cache"), (2, "driver of a cache"), (3, None), (4, ""), (5, "vector vector parser"), (5, "vector vector parser")], "id long, t string")
    ix = ranking.WordIndex(spark, str(tmp_path / "words")).write(docs, "id", "t")
    for query in ("cache parser cache", "vector", "nothing known", "", "the of"):
        want = sorted((r.id, round(r.score, 9)) for r in ranking.bm25_scores(docs, "id", "t", query).collect())
        assert sorted((r.id, round(r.score, 9)) for r in ix.scores(query, "id").collect()) == want
    plan = ix.scores("vector", "id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters:")[1].split("]")[0]
    big = spark.range(4000).select("id", F.concat_ws(" ", F.lit("hot"), F.concat(F.lit("w"), F.col("id") % 300)).alias("t"))
    many = ranking.WordIndex(spark, str(tmp_path / "big")).write(big.repartition(50), "id", "t")
    files_of = list((tmp_path / "big/postings").glob("*/*.parquet"))
    assert len(files_of) < 64 + 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) and many.scores("hot", "id").count() == 4000
    empty = ranking.WordIndex(spark, str(tmp_path / "none")).write(docs.limit(0), "id", "t")
    assert empty.scores("cache", "id").count() == 0


def test_numbers_of_hot_names(spark):
    rows = spark.range(5000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("key"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 7)).alias("base"))
    rows = rows.unionByName(spark.createDataFrame([("z1", "hot-2"), ("z2", "hot-3"), ("z3", "hot-900"), ("z4", "hot-99999"), ("z5", "n1-4")], "key string, base string"))
    got = {r.key: r.slug for r in index.unique_slugs(rows, "key", "base", "key").collect()}
    by, taken, want = {}, {r.base for r in rows.select("base").distinct().collect()}, {}
    for r in sorted(rows.collect()):
        n = by.get(r.base)
        if n is None:
            want[r.key], by[r.base] = r.base, 2
            continue
        while f"{r.base}-{n}" in taken:
            n += 1
        want[r.key], by[r.base] = f"{r.base}-{n}", n + 1
    assert got == want and len(set(got.values())) == len(got)
    assert index.unique_slugs(rows.limit(0), "key", "base", "key").count() == 0
