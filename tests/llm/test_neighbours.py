import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import neighbours as nb

TABLES = "/root/testdata/sf0.1"
SCHEMA = "id string, vector array<float>, summary_vector_json string, cls string, field string"


def brute(vectors, k=10, floor=0.9):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    pairs, lists = set(), {}
    for i, name in enumerate(ids):
        order = np.lexsort((np.arange(len(ids)), -cos[i].round(9)))[:k]
        lists[name] = [ids[j] for j in order if cos[i, j] > -2]
        pairs |= {(min(name, ids[j]), max(name, ids[j])) for j in order if cos[i, j] >= floor}
    return pairs, lists


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 64))
    out = {}
    for k in range(1500):
        v = centres[k % 12] * 0.8 + r.normal(size=64)
        out[f"v{k:05d}"] = v * r.uniform(0.1, 9)
        if k % 9 == 0:
            for j in range(k % 4):
                out[f"v{k:05d}n{j}"] = v + r.normal(size=64) * r.uniform(0.05, 0.3)
    return {k: v.astype(np.float32).tolist() for k, v in out.items()}


def test_recall_against_brute_force(spark, vectors):
    frame = spark.createDataFrame([(k, v, None, "x", "y") for k, v in vectors.items()], SCHEMA)
    pairs, lists = brute(vectors)
    got = {(r.id_a, r.id_b) for r in nb.close_pairs(frame).collect()}
    assert got <= pairs and len(got) >= 0.97 * len(pairs) > 100
    rows = nb.nearest_ids(frame, F.pmod(F.xxhash64("id"), F.lit(5)) == 0).collect()
    hits = sum(r.other in lists[r.id] for r in rows)
    assert len(rows) == 10 * len({r.id for r in rows}) and hits >= 0.9 * len(rows)


@pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables here")
def test_recall_with_far_more_cells_than_probes(spark):
    chunks = spark.read.parquet(f"{TABLES}/code_chunks.parquet")
    asked = F.pmod(F.xxhash64("id"), F.lit(50)) == 0
    rows = nb.nearest_ids(chunks, asked).collect()
    held = nb.usable_vectors(chunks).select("field", "id", "v").collect()
    for field in ("vector", "summary_vector_json"):
        ids, x = np.array([r.id for r in held if r.field == field]), np.array([np.frombuffer(r.v, np.float32) for r in held if r.field == field])
        lists, hits, want = {}, 0, 0
        for r in rows:
            if r.vec_field == field:
                lists.setdefault(r.id, []).append(r.cosine)
        for name, found in lists.items():
            cos, best = (x[ids == name] @ x.T).max(0), {}
            for j in np.argsort(-cos)[:60]:
                if ids[j] != name:
                    best[ids[j]] = max(best.get(ids[j], -2), cos[j])
            true = sorted(best.values())[-10:]
            hits, want = hits + sum(c >= true[0] - 2e-6 for c in found), want + len(true)
        assert nb.MultiIndex(x, len(x), nb.FAR_CELL_ROWS).k ** 2 >= 3 * nb.FAR_PROBES and want > 500 and hits >= 0.95 * want


def test_dense_region_stays_linear(spark):
    """Families round one centre, all of them alike: what leaves the cells grows with their number, and each family is found."""
    r = np.random.default_rng(8)
    centre, sizes = r.normal(size=64), []
    for n in (500, 1000):
        x = {}
        for k in range(n // 4):
            base = centre + r.normal(size=64) * 0.1
            x |= {f"d{k:05d}_{j}": (base + r.normal(size=64) * 0.01).astype(np.float32).tolist() for j in range(4)}
        frame = spark.createDataFrame([(k, v, None, "x", "y") for k, v in x.items()], SCHEMA)
        _, classes = nb._prepared(frame)
        index, placed = nb.build_index(classes, nb.FAR_CELL_ROWS)
        sizes.append(nb.class_neighbours(placed, placed, index, k=10, floor=0.9).count())
    assert sizes[0] <= 500 * 30 and sizes[1] <= 1000 * 30
    pairs, _ = brute(x, k=3)
    got = {(p.id_a, p.id_b) for p in nb.close_pairs(frame).collect()}
    assert len(pairs) == 1500 and len(pairs & got) >= 0.98 * len(pairs)


@pytest.mark.parametrize("known", [nb.KNOWN_CELLS, 0])
def test_divided_cells(spark, vectors, monkeypatch, known):
    """With cells in many blocks, their list broadcast or joined, the same pairs come out."""
    some = dict(list(vectors.items())[:400])
    frame = spark.createDataFrame([(k, v, None, "x", "y") for k, v in some.items()], SCHEMA)
    want = {tuple(r) for r in nb.close_pairs(frame).collect()}
    monkeypatch.setattr(nb, "BLOCK", 7)
    monkeypatch.setattr(nb, "KNOWN_CELLS", known)
    assert {tuple(r) for r in nb.close_pairs(frame).collect()} == want != set()


def test_usable_values_and_ties(spark):
    one = [1.0] + [0.0] * 63
    text = json.dumps([2] + [0.0] * 63)
    rows = [(f"c{k:02d}", one, None, "x", "y") for k in range(25)]
    rows += [("c00", one, None, "x", "y")] * 3
    bad = [None, [], [0.0] * 64, [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63]
    rows += [(f"bad{k}", v, None, "x", "y") for k, v in enumerate(bad)]
    texts = [f" {text}\n", text.replace("2", "2e0", 1), "", "[]", "{}", "null", text[:-1], text.replace("2", "NaN", 1), text.replace("2", '"2"', 1), text.replace("2", "true", 1), text.replace("2", "1e999", 1), text.replace("2", "1" + "0" * 400, 1), json.dumps([0] * 64)]
    rows += [(f"t{k:02d}", None, t, "x", "y") for k, t in enumerate(texts)] + [(None, one, text, "x", "y")]
    got = {tuple(r) for r in nb.close_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {p for p in got if p[0] == "summary_vector_json"} == {("summary_vector_json", "t00", "t01")}
    same = {(a, b) for f, a, b in got if f == "vector"}
    names = [f"c{k:02d}" for k in range(25)]
    want = set()
    for n in names:
        want |= {(min(n, o), max(n, o)) for o in [x for x in names if x != n][:10]}
    assert same == want


def test_empty(spark):
    assert nb.close_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
