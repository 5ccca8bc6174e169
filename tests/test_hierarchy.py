import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators import hierarchy as h

SCHEMA = "id string, parent_id string, path string, tree string"


def walked(parents):
    out = {}
    for i in parents:
        path, seen, x = [], set(), i
        while x is not None and x in parents and x not in seen:
            path.append(x)
            seen.add(x)
            x = parents[x]
        out[i] = None if x in seen else path[::-1]
    return out


def resolve(spark, rows, every=8):
    frame = spark.createDataFrame([(i, p, "x", "y") for i, p in rows], SCHEMA)
    return h.resolve_hierarchy(h.parent_pointers(frame, "t", "id", "parent_id"), every)


@pytest.mark.parametrize("every", [1, 3, 50])
def test_random_forests_with_loops(spark, every):
    r = random.Random(every)
    parents = {f"n{k}": (f"n{r.randrange(k)}" if k and r.random() < 0.9 else None) for k in range(300)}
    parents |= {f"d{k}": f"d{k - 1}" if k else None for k in range(120)}
    parents |= {f"l{k}": f"l{(k + 1) % 3}" for k in range(3)} | {f"m{k}": f"m{(k + 1) % 40}" for k in range(40)} | {"s": "s"}
    parents |= {f"u{k}": ["l0", "m7", "s", "u0", "unknown"][k % 5] for k in range(20)} | {"e": ""}
    want = walked(parents)
    rows = resolve(spark, [*parents.items(), ("d5", "d4")], every).collect()
    assert len(rows) == len(parents)
    for x in rows:
        assert x.path == want[x.id] and x.cyclic == (want[x.id] is None)
        assert (x.root, x.depth) == ((None, None) if x.cyclic else (want[x.id][0], len(want[x.id]) - 1))


def test_deep_chain_and_long_loop_without_paths(spark):
    """100,000 rows in one chain, and a loop of 3,000 with a tail, in rows that stay small."""
    rows = spark.range(100_000).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent_id"))
    rows = rows.unionByName(spark.range(3000).select(F.concat(F.lit("l"), "id").alias("id"), F.concat(F.lit("l"), (F.col("id") + 1) % 3000).alias("parent_id")))
    rows = rows.unionByName(spark.range(500).select(F.concat(F.lit("t"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("t"), F.col("id") - 1)).otherwise(F.lit("l7")).alias("parent_id")))
    for every in (8, 10**6):  # with splitters in the loop, and without any
        got = h.resolve_levels(h.parent_pointers(rows, "t", "id", "parent_id"), every)
        n = got.agg(F.count("*"), F.sum(F.col("cyclic").cast("int")), F.sum(((F.col("root") == "n0") & (F.col("id") == F.concat(F.lit("n"), "depth"))).cast("int"))).first()
        assert tuple(n) == (103_500, 3_500, 100_000)


def test_levels_agree_with_paths(spark):
    r = random.Random(9)
    rows = [(f"n{k}", f"n{r.randrange(400)}", "x", "y") for k in range(300)]
    p = h.parent_pointers(spark.createDataFrame(rows, SCHEMA), "t", "id", "parent_id")
    cols = ["id", "root", "depth", "cyclic"]
    assert sorted(map(str, h.resolve_levels(p).select(*cols).collect())) == sorted(map(str, h.resolve_hierarchy(p).select(*cols).collect()))


def test_several_parents(spark):
    rows = [("a", "p"), ("a", "q"), ("a", "q"), ("b", "p"), ("b", "p"), ("b", None), ("c", ""), (None, "p"), ("", "q")]
    frame = spark.createDataFrame([(i, p, "x", "y") for i, p in rows], SCHEMA)
    assert {tuple(r) for r in h.several_parents(frame, "t", "id", "parent_id").collect()} == {("t", "a", "p", True), ("t", "a", "q", False)}
    assert h.several_parents(frame.limit(0), "t", "id", "parent_id").count() == 0


def test_descendants(spark):
    got = h.descendants(resolve(spark, [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")])).collect()
    assert {(r.ancestor, r.descendant, r.distance) for r in got} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_nulls_ties_and_empty(spark):
    rows = resolve(spark, [(None, "a"), ("", "a"), ("a", None), ("a", None), ("b", "c"), ("b", "a"), ("c", "a")]).collect()
    assert {r.id: r.path for r in rows} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"]}
    assert resolve(spark, []).count() == 0


def test_parents_without_rows(spark):
    frame = spark.createDataFrame([("s", "t", "contains"), ("s", "u", "contains"), (None, "v", "contains"), ("q", "w", "calls")], "source string, target string, kind string")
    chunks = spark.createDataFrame([], "id string, parent_id string")
    got = h.resolve_hierarchy(h.source_trees(chunks, frame, add_parents=True)).select("id", "depth", F.array_join("path", ">").alias("p")).collect()
    assert {(r.id, r.depth, r.p) for r in got} == {("s", 0, "s"), ("t", 1, "s>t"), ("u", 1, "s>u"), ("v", 0, "v")}
