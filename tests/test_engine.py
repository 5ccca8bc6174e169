import pytest
from pyspark.sql import functions as F

from codequarry.operators import providers
from codequarry.operators.search import SearchOptions
from codequarry.plans.engine import CodeIndex


def letters():
    return lambda texts: [[float(t.lower().count(c)) for c in "abcdefgh"] for t in texts]


def test_index_search_and_graph(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "shop.ts").write_text("import { pay } from './pay'\nexport class Shop {\n  sell(item) {\n    pay(item);\n    count(item);\n  }\n}\nfunction count(x) {\n}\nfunction unused(x) {\n}\n")
    (root / "pay.ts").write_text("export function pay(x) {\n  return abacus(x);\n}\n")
    ix = CodeIndex(spark, str(tmp_path / "store"), provider=letters, chunk_words=8)
    row = ix.index_path(str(root), "p", summaries=True).first()
    assert (row.n_files, row.n_languages) == (2, 1)
    assert {r.qualified_name for r in ix.callers("count").collect()} == {"Shop.sell"} and {r.qualified_name for r in ix.callees("Shop.sell").collect()} == {"count"}
    assert {r.qualified_name for r in ix.dead_code().collect()} == {"Shop.sell", "unused"}
    assert {r.role for r in ix.context("Shop.sell").collect()} == {"outgoing"} and ix.nodes_by_file("pay.ts").count() == 1
    assert {r.depth for r in ix.ancestors().collect()} == {0, 1}
    hits = ix.search(SearchOptions(text="abacus", vector=letters()(["abacus"])[0])).collect()
    assert hits[0].file_path == "pay.ts" and hits[0].snippet.startswith("export")
    assert ix.search(SearchOptions(text="abacus")).first().file_path == "pay.ts"
    asked = ix.search(SearchOptions(text="zzz gggg hhhh", mode="vector-only")).collect()  # the question is embedded
    assert asked and {r.id for r in asked} == {r.id for r in ix.search(SearchOptions(vector=letters()(["zzz gggg hhhh"])[0], mode="vector-only")).collect()}
    node = ix.nodes_by_file("pay.ts").first()
    assert ix.node(node.id).first().qualified_name == node.qualified_name and ix.node("none").count() == 0
    assert {r.role for r in ix.call_graph("Shop.sell").collect()} == {"callee"} and ix.called_by().count() == 1
    assert {r.depth for r in ix.within("Shop.sell", 3).collect()} == {0, 1}
    ix.index_dependencies(str(root), "p")
    assert [r.source_file for r in ix.files_importing("pay").collect()] == ["shop.ts"]
    assert [r[0] for r in ix.dependencies("shop.ts").collect()] == ["pay.ts"] and [r[0] for r in ix.dependents("pay.ts").collect()] == ["shop.ts"]

    (root / "shop.ts").write_text("function other(x) {\n}\n")
    (root / "pay.ts").unlink()
    assert ix.index_path(str(root), "p").first().n_files == 1
    assert {r.qualified_name for r in ix.nodes_by_file("shop.ts").collect()} == {"other"} and ix.nodes_by_file("pay.ts").count() == 0
    assert ix.store.read("graph_edges").count() == 0
    ix.remove_path("shop.ts")
    assert ix.store.read("code_chunks").count() == 0 and ix.stats("p").count() == 0


def test_a_node_for_each_symbol(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    text = "interface Shop {\n}\nexport class Shop {\n  sell(a) {\n  }\n  sell(a, b) {\n}\nfunction f(a) {\n}\nfunction f(a, b) {\n  new Shop(a);\n  f(a);\n}\nimport { a } from './m'\nimport b from './m'\n"
    (root / "a.ts").write_text(text)
    ix = CodeIndex(spark, str(tmp_path / "store"))
    ix.index_path(str(root), "p")
    nodes = {r.id: (r.kind, r.qualified_name, r.start_line, r.is_exported) for r in ix.nodes_by_file("a.ts").collect()}
    assert sorted(nodes.values()) == [
        ("class", "Shop", 3, True), ("function", "f", 8, False), ("function", "f", 10, False), ("import", "./m", 14, False), ("import", "./m", 15, False),
        ("interface", "Shop", 1, False), ("method", "Shop.sell", 4, False),
    ]
    edges = {(r.kind, nodes[r.source][:3], nodes[r.target][:3]) for r in ix.store.read("graph_edges").collect()}
    first, second = ("function", "f", 8), ("function", "f", 10)
    assert edges >= {("instantiates", second, ("interface", "Shop", 1)), ("calls", second, first), ("contains", ("class", "Shop", 3), ("method", "Shop.sell", 4))}


def test_providers(spark):
    rows = spark.createDataFrame([("a", "abc"), ("b", None), ("c", " ")], "id string, t string")
    got = {r.id: r.v for r in providers.embed(rows, "t", "v", letters, batch=2).collect()}
    assert got["a"][:3] == [1.0, 1.0, 1.0] and sum(got["b"]) == sum(got["c"]) == 0
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError
        return x

    assert providers.with_retries(flaky, base_s=0.0)(5) == 5 and len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        providers.with_retries(lambda: 1 / 0, retries=1, base_s=0.0)()
    def unsteady():
        tries = []

        def call(texts):
            tries.append(1)
            if len(tries) % 2:
                raise ValueError
            return [t.upper() for t in texts]

        return call

    got = providers.summarize(rows, "t", "s", unsteady, longest=2, batch=1, base_s=0.0)
    assert {r.id: r.s for r in got.collect()} == {"a": "AB...", "b": "", "c": " "} and got.columns == ["id", "t", "s"]
    broken = lambda: lambda texts: 1 / 0
    assert {r.s for r in providers.summarize(rows, "t", "s", broken, retries=0).collect()} == {""}
    with pytest.raises(Exception, match="ZeroDivisionError"):
        providers.summarize(rows, "t", "s", broken, retries=0, failed=None).collect()
    texts = spark.createDataFrame([("\n  // Makes it.\ncode",), (None,), ("",)], "t string").select(providers.local_summary(F.col("t")).alias("s")).collect()
    assert [r.s for r in texts] == ["Makes it.", "", ""]
