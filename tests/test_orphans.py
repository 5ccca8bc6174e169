from datetime import datetime

import pytest

from codequarry.operators import orphans as o

REFS = "a string, b string, at timestamp, _mask string"
TARGETS = "a string, b string, s timestamp, e timestamp"


def day(d, m=1):
    return datetime(2025, m, d)


@pytest.fixture(scope="module")
def targets(spark):
    rows = [("k", "x", day(2), day(5)), ("k", "x", day(4), day(8)), ("k", "x", day(20), None), ("k", "y", day(9), day(3)), ("n", None, day(1), None), (None, None, day(1), None), ("m", "z", None, None)]
    return spark.createDataFrame(rows * 2, TARGETS)


@pytest.mark.parametrize(("match", "want"), [("simple", {"old", "gap", "none", "dead", "never"}), ("partial", {"old", "gap", "none", "dead", "never", "part_lost"}), ("full", {"old", "gap", "none", "dead", "never", "part", "part_lost"})])
def test_match_rules_and_intervals(spark, targets, match, want):
    rows = [
        ("k", "x", day(1), "old"), ("k", "x", day(2), "start"), ("k", "x", day(6), "merged"), ("k", "x", day(8), "gap"), ("k", "x", day(20), "open"), ("k", "x", day(1, 9), "later"),
        ("q", "x", day(6), "none"), ("k", "y", day(10), "dead"), ("m", "z", day(10), "never"), ("n", None, day(6), "part"), (None, "w", day(6), "part_lost"), (None, None, day(6), "null"),
    ]
    refs = spark.createDataFrame([(a, b, t, n) for a, b, t, n in rows], "a string, b string, at timestamp, name string")
    got = o.orphan_references(refs, ["a", "b"], "at", targets, start="s", end="e", match=match).collect()
    assert {r.name for r in got} == want and len(got) == len(want)


def test_months_join_up(spark):
    rows = [("k", day(1, m), day(1, m + 1)) for m in range(1, 9)] + [("k", day(3, 3), day(9, 3))]
    live = o.live_intervals(spark.createDataFrame(rows, "a string, s timestamp, e timestamp"), ["a"], "s", "e").collect()
    assert len(live) == 8 and {r.live_from for r in live} == {day(1, m) for m in range(1, 9)}


def test_code_references(spark):
    dep = spark.createDataFrame([("f", "ID1", day(3)), ("f", " ", day(3)), ("f", None, day(3))], "source_id string, target_id string, indexed_at timestamp")
    edge = spark.createDataFrame([("g", "id1", day(1))], "source string, target string, indexed_at timestamp")
    ref = spark.createDataFrame([("h", " run() ", day(3)), ("h", "Run", day(3)), ("h", "()", day(3)), ("h", "go()()", day(3))], "from_node_id string, reference_name string, indexed_at timestamp")
    nodes = spark.createDataFrame([("id1", "run", "C.run", day(2), None)], "id string, name string, qualified_name string, indexed_at timestamp, removed_at timestamp")
    got = {tuple(r) for r in o.code_orphans(dep, edge, ref, nodes).collect()}
    assert got == {("graph_edges", "2025-01", "g", "id1"), ("unresolved_refs", "2025-01", "h", "Run"), ("unresolved_refs", "2025-01", "h", "go()")}
    none = [x.limit(0) for x in (dep, edge, ref, nodes)]
    assert o.code_orphans(*none).count() == 0 and o.code_orphans(dep, edge, ref, none[3]).count() == 5
    with pytest.raises(ValueError):
        o.orphan_references(edge, ["target"], "indexed_at", nodes, start="indexed_at", end="removed_at", match="any")
