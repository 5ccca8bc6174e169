import random
import re
from itertools import combinations

import pytest

from codequarry.llm import near_duplicates as near

SCHEMA = "id string, file_path string, content string, cls string, n int"


def brute(rows):
    sets, files = {}, {}
    for i, f, c, *_ in rows:
        w = [x.lower() for x in re.findall(r"[A-Za-z0-9_]+", c or "")]
        s = frozenset(zip(w, w[1:], w[2:]))
        if s and i is not None:
            sets[i, s] = s
            files[i, s] = re.sub(r"/(?:\.?/)+", "/", (f or "").replace("\\", "/"))
    out = set()
    for a, b in combinations(sets, 2):
        if a[0] != b[0] and files[a] != files[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6:
            out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def family(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for k in range(n):
        base = [word() for _ in range(r.randint(20, 80))]
        for j in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = word()
            rows.append((f"i{k}_{j}", f"/p/f{k}_{j}.ts", " ".join(w), "x", 1))
    return rows


@pytest.mark.parametrize("long_list", [near.LONG_LIST, 20, 1])
def test_equals_brute_force(spark, long_list):
    """With lists of any length, and with nearly every list split."""
    rows = family(1)
    header = "licensed under the terms of the common header of all files in this tree"
    rows += [(f"h{k}", f"/h/{k}.go", f"{header} own{k} words{k} follow{k} here{k} now{k} and{k} go{k} on{k} to{k} end{k} it{k}", "x", 1) for k in range(40)]
    got = {tuple(r) for r in near.similar_pairs(*near.duplicate_classes(spark.createDataFrame(rows, SCHEMA), long_list=long_list)).collect()}
    assert got == brute(rows)


def test_common_header_costs_no_pairs(spark, monkeypatch):
    """600 files under one header of 60 words and more sizes than one: lists are split, and few pairs meet beside the real ones."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    header, rows = [word() for _ in range(60)], []
    for k in range(600):
        own = [word() for _ in range(25 if k % 3 else 20 + k % 20)]
        rows.append((f"h{k}", f"/h/{k}", " ".join(header + own), "x", 1))
        if k % 20 == 0:
            rows.append((f"c{k}", f"/c/{k}", " ".join(header + own[:16] + [word() for _ in own[16:]]), "x", 1))
    met, split = [], near._split_by_triples
    monkeypatch.setattr(near, "_split_by_triples", lambda *a: met.append(near.cut(split(*a))) or met[0])
    got = {tuple(x) for x in near.similar_pairs(*near.duplicate_classes(spark.createDataFrame(rows, SCHEMA), long_list=100)).collect()}
    want = brute(rows)
    assert got == want and len(want) >= 30 and met[0].count() <= 2 * len(want) + 50


def test_blocks_of_a_list_meet(spark, monkeypatch):
    """A list over many blocks gives the same pairs."""
    rows = family(6, 25)
    want = brute(rows)
    monkeypatch.setattr(near, "BLOCK", 2)
    for long_list in (1, 500):
        assert {tuple(x) for x in near.similar_pairs(*near.duplicate_classes(spark.createDataFrame(rows, SCHEMA), long_list=long_list)).collect()} == want


def test_edge_cases(spark):
    text = "one two three four five"
    rows = [
        ("a", "/p/a.ts", text, "x", 1), ("a", "/p/a.ts", text, "x", 1), ("b", "\\p\\.\\a.ts", text, "x", 1), ("c", "//p/b.ts", text.upper() + " !", "x", 1),
        ("d", "/p/c.ts", "", "x", 1), ("e", "/p/d.ts", None, "x", 1), ("f", "/p/e.ts", "two words", "x", 1), (None, "/p/f.ts", text, "x", 1),
        ("g", None, text, "x", 1), ("h", "/p/g.ts", "wörter " * 30_000, "x", 1), ("k", "/p/h.ts", "w rter " * 20_000, "x", 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in near.similar_pairs(*near.duplicate_classes(frame)).collect()}
    assert got == {("a", "c"), ("b", "c"), ("a", "g"), ("b", "g"), ("c", "g"), ("h", "k")} == brute(rows)
    groups = {r.id: r for r in near.similar_groups(*near.duplicate_classes(frame)).collect()}
    assert set(groups) == set("abcghk") and groups["a"].class_id == groups["g"].class_id and groups["h"].n_links == 0


def test_groups_follow_links(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(f"c{k}", f"/p/{k}", " ".join(words[:50 - 6 * k] + [f"x{k}{j}" for j in range(6 * k)] if k < 2 else words[6 * (k - 1):]), "x", 1) for k in range(4)]
    groups = near.similar_groups(*near.duplicate_classes(spark.createDataFrame(rows, SCHEMA))).collect()
    pairs = brute(rows)
    root = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    by_group = {}
    for g in groups:
        by_group.setdefault(g.group_id, set()).add(root[g.id])
    assert all(len(v) == 1 for v in by_group.values()) and len(by_group) == len(set(root.values()))


def test_empty(spark):
    members, links = near.duplicate_classes(spark.createDataFrame([], SCHEMA))
    assert near.similar_pairs(members, links).count() == near.similar_groups(members, links).count() == 0
