"""The most similar vectors of every vector, with an inverted multi-index.

The two halves of a unit vector are quantised apart, so K centroids a half make K*K cells. A query walks the pairs of
centroids in order of their summed distance with a heap, and is compared with the entries of the cells it reaches; the best
are reranked by their exact cosine. Every vector is indexed. Quantisers are fitted on a bounded sample: ``SAMPLE`` vectors, or
``SAMPLE_EACH`` a centroid if that is more; K is the root of the rows over the rows a cell, so cells keep their size as data grow, and
starts from sampled vectors, so a dense region gets its share of centroids. What the driver holds of an index are the
centroids and one bit a cell: at most rows / 256 bytes.

Each query and each entry keeps its best of every block of a cell, so what leaves a cell is linear in its rows, however alike
they are.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.session import cut

SIZE = 64
HALF = SIZE // 2
SAMPLE = 16_384  #: vectors a field that the quantisers are fitted on
SAMPLE_EACH = 32  #: or so many for each centroid of a half
CELL_ROWS, PROBES = 128, 12  #: rows a cell that K is chosen for, and non-empty cells a query reaches, where a floor asks for close vectors only
FAR_CELL_ROWS, FAR_PROBES = 32, 48  #: the same without a floor
SPARE = 3  #: times k that are kept of each block before the exact rerank
KNOWN_CELLS = 100_000  #: divided cells whose list is broadcast; a longer one is joined
BLOCK = 4096  #: entries of a cell that one task holds at once
SLACK = 0.01  #: by how much the cosine of rounded vectors may be too low


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _refuse(_: str) -> None:
    raise ValueError


def _from_json(text: str | None) -> list | None:
    try:
        v = json.loads(text, parse_constant=_refuse) if text else None
        return v if isinstance(v, list) and len(v) == SIZE and all(map(_number, v)) else None
    except (ValueError, RecursionError):
        return None


def _units(rows: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable ones, and which those are."""
    try:
        x = np.array(rows, np.float64).reshape(-1, SIZE)
    except OverflowError:  # a whole number beyond all floats
        x = np.array([[v if abs(v) < 1e300 else math.inf for v in r] for r in rows], np.float64).reshape(-1, SIZE)
    top = np.abs(x).max(axis=1, initial=0)
    ok = np.isfinite(top) & (top > 0)
    x = x[ok] / top[ok][:, None]
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32), np.flatnonzero(ok)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = (("vector", [v if v is not None and len(v) == SIZE and None not in v else None for v in b.column("vector").to_pylist()]), ("summary_vector_json", [_from_json(v) for v in b.column("summary").to_pylist()]))
        for field, values in found:
            at = [i for i, v in enumerate(values) if v is not None]
            x, ok = _units([values[i] for i in at])
            if len(ok):
                ids = b.column("id").take(pa.array([at[i] for i in ok]))
                cls = pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([field] * len(ok)), ids, cls, _packed(x)], names=["field", "id", "cls", "v"])


def usable_vectors(chunks: DataFrame, key: str = "id", vector: str = "vector", summary: str = "summary_vector_json") -> DataFrame:
    """``field, id, cls, v``: unit vectors (64 packed floats) of both fields; equal ones share ``cls``.

    Usable are arrays (as JSON text: a valid array of numbers, outer blanks allowed) of exactly 64 finite numbers, not all
    zero. Others, and rows with a null id, are left out.
    """
    rows = chunks.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(summary).alias("summary"))
    return rows.where(F.col("id").isNotNull()).mapInArrow(_parse, "field string, id string, cls binary, v binary")


class MultiIndex:
    """The quantisers of one field, and which cells have entries."""

    def __init__(self, sample: np.ndarray, rows: int, cell_rows: int = CELL_ROWS):
        k = min(_centroids(rows, cell_rows), max(1, len(sample)))
        self.centres = [self._fit(sample[:, h * HALF : (h + 1) * HALF], k) for h in (0, 1)]
        self.k = k
        self.filled = np.zeros(k * k, bool)

    @staticmethod
    def _fit(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
        c = x[np.random.default_rng(3).choice(len(x), k, replace=False)].copy()
        for _ in range(rounds):
            near = np.concatenate([np.argmin((c * c).sum(1) - 2 * x[s : s + 8192] @ c.T, axis=1) for s in range(0, len(x), 8192)])
            n = np.bincount(near, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            c[n > 0] = total[n > 0] / n[n > 0][:, None]
        return c

    def __getstate__(self) -> dict:
        return self.__dict__ | {"filled": np.packbits(self.filled)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"filled": np.unpackbits(state["filled"], count=state["k"] ** 2).astype(bool)}

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [(c * c).sum(1) - 2 * x[:, h * HALF : (h + 1) * HALF] @ c.T + (x[:, h * HALF : (h + 1) * HALF] ** 2).sum(1)[:, None] for h, c in enumerate(self.centres)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * self.k + b.argmin(1)

    def walk(self, x: np.ndarray, probes: int) -> list[list[int]]:
        """For each row the ``probes`` non-empty cells that it reaches first."""
        near = min(self.k, 8 * probes)
        out = []
        da, db = self.distances(x)
        oa, ob = (np.argpartition(d, near - 1, axis=1)[:, :near] for d in (da, db))
        for a, b, ia, ib in zip(da, db, oa, ob):
            cells = self._pairs(a[ia], b[ib], ia, ib, probes)
            if len(cells) < probes and near < self.k:
                every = np.arange(self.k)
                cells = self._pairs(a, b, every, every, probes)
            out.append(cells)
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, probes: int) -> list[int]:
        oa, ob = a.argsort(kind="stable"), b.argsort(kind="stable")
        a, b, ia, ib = a[oa].tolist(), b[ob].tolist(), ia[oa].tolist(), ib[ob].tolist()
        k, filled, heap, cells = self.k, self.filled, [(a[0] + b[0], 0, 0)], []
        while heap and len(cells) < probes:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            if filled[cell := ia[i] * k + ib[j]]:
                cells.append(cell)
        return cells


def _centroids(rows: int, cell_rows: int) -> int:
    return max(1, round(math.sqrt(rows / cell_rows)))


def build_index(classes: DataFrame, cell_rows: int = CELL_ROWS) -> tuple[dict[str, MultiIndex], DataFrame]:
    """Fits each field's quantisers on a bounded sample and gives ``classes`` (``field, cls, v``) their cell."""
    sizes = {r.field: r.n for r in classes.groupBy("field").agg(F.count("*").alias("n")).collect()}  # two fields
    index = {}
    for field, n in sizes.items():
        part, size = classes.where(F.col("field") == field), max(SAMPLE, SAMPLE_EACH * _centroids(n, cell_rows))
        if n > size:
            part = part.where(F.pmod(F.xxhash64("cls"), F.lit(1_000_000_000)) < int(1_000_000_000 * size / n))
        sample = _unpacked(part.select("v").limit(2 * size).toArrow().column("v").combine_chunks(), np.float32)
        index[field] = MultiIndex(sample[np.lexsort(sample[:, :8].T)], n, cell_rows)  # in an order of its own, so equal data fit alike

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cell = _unpacked(b.column("v"), np.float32), np.zeros(b.num_rows, np.int32)
            fields = np.array(b.column("field").to_pylist())
            for f in set(fields.tolist()):
                cell[fields == f] = index[f].cells(x[fields == f])
            yield b.append_column("cell", pa.array(cell, pa.int32()))

    placed = cut(classes.select("field", "cls", "v").mapInArrow(assign, "field string, cls binary, v binary, cell int"))
    bits = placed.groupBy("field", F.bitmap_bucket_number(F.col("cell") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bits"))
    for r in bits.collect():  # a bit for each of K * K cells, in parts of 32,768
        got = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little"))
        index[r.field].filled[(r.part - 1) * 32_768 + got] = True
    return index, placed


def _ship(index: dict[str, MultiIndex], probes: int):
    """Queries as a row for each cell they reach, rounded to 8 bits a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                x, fields = _unpacked(b.column("v"), np.float32), np.array(b.column("field").to_pylist())
                top = np.abs(x).max(1)
                small = np.concatenate([np.round(x / top[:, None] * 127).astype(np.int8), (top / 127).astype(np.float32)[:, None].view(np.int8)], axis=1)
                for f in sorted(set(fields.tolist())):
                    rows = np.flatnonzero(fields == f)
                    walks = index[f].walk(x[rows], probes)
                    at, cell = np.repeat(rows, [len(w) for w in walks]), np.array([c for w in walks for c in w], np.int32)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([f] * len(at)), pa.array(cell), pa.array(np.ones(len(at)), pa.int8()), b.column("cls").take(pa.array(at)), _packed(small[at])], names=["field", "cell", "tag", "cls", "v"])

    return run


def _best(cos: np.ndarray, keep: int) -> np.ndarray:
    """Per row the columns of its ``keep`` largest values."""
    return np.argpartition(-cos, keep - 1, axis=1)[:, :keep] if keep < cos.shape[1] else np.tile(np.arange(cos.shape[1]), (len(cos), 1))


class _Block:
    """The entries of one block, and of each its best queries so far."""

    def __init__(self, field: str, names: list[bytes], entries: np.ndarray, keep: int, floor: float):
        self.field, self.names, self.entries, self.keep, self.floor = field, np.array(names, object), entries, keep, floor
        self.score = np.full((len(names), keep), -9, np.float32)
        self.who = np.full((len(names), keep), None, object)

    def _rows(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
        ok = (near >= self.floor - SLACK) & (a != b)
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array([self.field] * int(ok.sum())), pa.array(a[ok], pa.binary()), pa.array(b[ok], pa.binary()), pa.array(near[ok], pa.float32())], names=["field", "a", "b", "near"])

    def pass_by(self, own: list[bytes], x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The best entries of each query; the entries take note of it, where a floor lets either side name the other."""
        cos, own = x @ self.entries.T, np.array(own, object)
        j = _best(cos, min(self.keep, len(self.names)))
        i = np.repeat(np.arange(len(x)), j.shape[1])
        yield from self._rows(own[i], self.names[j.ravel()], cos[i, j.ravel()])
        if self.floor > -1:
            rows = np.flatnonzero(cos.max(0) >= self.floor - SLACK)
            if len(rows):
                seen = cos[:, rows].T
                q = _best(seen, min(self.keep, len(own)))
                score = np.concatenate([self.score[rows], np.take_along_axis(seen, q, 1)], axis=1)
                who = np.concatenate([self.who[rows], own[q]], axis=1)
                top = _best(score, self.keep)
                self.score[rows], self.who[rows] = np.take_along_axis(score, top, 1), np.take_along_axis(who, top, 1)

    def notes(self) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(self.score >= self.floor - SLACK)
        if self.floor > -1 and len(i):
            yield from self._rows(self.names[i], self.who[i, j], self.score[i, j])


def _scan(keep: int, floor: float):
    """Rows in order of cell, block and tag: holds a block's entries and streams its queries past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        block: _Block | None = None
        names: list[bytes] = []
        parts: list[np.ndarray] = []
        for b in batches:
            tag = np.asarray(b.column("tag"))
            cell, part = np.asarray(b.column("cell")), np.asarray(b.column("block"))
            fields = b.column("field").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(tag) != 0) | (np.diff(fields) != 0)) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
                where = (b.column("field")[s].as_py(), int(cell[s]), int(part[s]))
                if where != held:
                    if block:
                        yield from block.notes()
                    held, block, names, parts = where, None, [], []
                run_ = b.slice(s, e - s)
                if not tag[s]:
                    names += run_.column("cls").to_pylist()
                    parts.append(_unpacked(run_.column("v"), np.float16).astype(np.float32))
                    continue
                if block is None and parts:
                    block = _Block(where[0], names, np.concatenate(parts), keep, floor)
                if block is None:
                    continue
                for q in range(0, e - s, 512):
                    sub = run_.slice(q, 512)
                    raw = _unpacked(sub.column("v"), np.int8)
                    x = raw[:, :SIZE].astype(np.float32) * np.ascontiguousarray(raw[:, SIZE:]).view(np.float32)
                    yield from block.pass_by(sub.column("cls").to_pylist(), x)
        if block:
            yield from block.notes()

    return run


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.set_column(b.schema.get_field_index("v"), "v", _packed(_unpacked(b.column("v"), np.float32).astype(np.float16)))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (_unpacked(b.column(c), np.float32).astype(np.float64) for c in ("va", "vb"))
        cos = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
        yield pa.RecordBatch.from_arrays([b.column("field"), b.column("a"), b.column("b"), pa.array(cos)], names=["field", "a", "b", "cosine"])


def class_neighbours(placed: DataFrame, queries: DataFrame, index: dict[str, MultiIndex], *, k: int, floor: float = -1.0, probes: int = PROBES) -> DataFrame:
    """``field, a, b, cosine``: for query classes ``a`` their near classes ``b``, reranked by exact cosine.

    They are the best of the cells that a query reaches; with a floor, those below it are left out, and each entry also has
    its best among the queries that reach it, so a pair is found when either side reaches the other's cell. A cell with more
    than ``BLOCK`` entries is divided into blocks, so no task holds a whole cell; queries stream past. The list of divided
    cells is broadcast up to ``KNOWN_CELLS``, else joined.
    """
    divided = cut(placed.groupBy("field", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where(F.col("blocks") > 1))
    if divided.count() <= KNOWN_CELLS:
        divided = F.broadcast(divided)
    entries = placed.join(divided, ["field", "cell"], "left")
    entries = entries.withColumn("block", F.coalesce(F.pmod(F.xxhash64("cls"), F.col("blocks")), F.lit(0)).cast("int"))
    layout = "field string, cell int, block int, tag tinyint, cls binary, v binary"
    entries = entries.select("field", "cell", "block", F.lit(0).cast("tinyint").alias("tag"), "cls", "v").mapInArrow(_halves, layout)
    shipped = queries.select("field", "cls", "v").mapInArrow(_ship(index, probes), layout.replace("block int, ", ""))
    shipped = shipped.join(divided, ["field", "cell"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    both = entries.unionByName(shipped.drop("blocks")).repartition("field", "cell", "block").sortWithinPartitions("field", "cell", "block", "tag")
    hits = both.mapInArrow(_scan(SPARE * k, floor), "field string, a binary, b binary, near float")
    if floor > -1:
        hits = hits.groupBy("field", "a", "b").agg(F.max("near").alias("near"))
    best = W.partitionBy("field", "a").orderBy(F.desc("near"), "b")
    hits = cut(hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= SPARE * k).select("field", "a", "b"))
    wanted = hits.select("field", F.explode(F.array("a", "b")).alias("cls")).distinct()
    vectors = cut(placed.join(wanted, ["field", "cls"], "left_semi").select("field", "cls", "v"))
    side = lambda c: vectors.select("field", F.col("cls").alias(c), F.col("v").alias(f"v{c}"))
    pairs = hits.join(side("a"), ["field", "a"]).join(side("b"), ["field", "b"])
    exact = pairs.select("field", "a", "b", "va", "vb").mapInArrow(_exact, "field string, a binary, b binary, cosine double")
    return exact.where(F.col("cosine") >= floor) if floor > -1 else exact


def nearest(members: DataFrame, near: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``field, id, other, cosine, rank``: the k nearest other ids of each asked ``field, cls, id``.

    ``members`` (``field, cls, id``) turn classes back into ids; equal vectors have cosine 1. Ties go to the smaller id. Of a
    class no more than its k + 1 smallest ids can be near anyone, so a class that holds a third of all rows stays linear.
    """
    front = members.withColumn("r", F.row_number().over(W.partitionBy("field", "cls").orderBy("id"))).where(F.col("r") <= k + 1).select("field", F.col("cls").alias("b"), F.col("id").alias("other"))
    own = front.select("field", F.col("b").alias("a"), "other", F.lit(1.0).alias("cosine"))
    away = near.join(front, ["field", "b"]).select("field", "a", "other", "cosine")
    order = [F.desc("cosine"), F.col("other")]
    listed = own.unionByName(away).groupBy("field", "a", "other").agg(F.max("cosine").alias("cosine"))
    listed = listed.withColumn("r", F.row_number().over(W.partitionBy("field", "a").orderBy(*order))).where(F.col("r") <= k + 1)
    found = asked.select("field", F.col("cls").alias("a"), "id").join(listed.drop("r"), ["field", "a"]).where(F.col("id") != F.col("other"))
    found = found.groupBy("field", "id", "other").agg(F.max("cosine").alias("cosine"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("field", "id").orderBy(*order))).where(F.col("rank") <= k)


def _prepared(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    vectors = cut(usable_vectors(chunks))
    members = vectors.select("field", "cls", "id").distinct()
    return members, vectors.dropDuplicates(["field", "cls"]).select("field", "cls", "v")


def close_pairs(chunks: DataFrame, *, k: int = 10, floor: float = 0.9, probes: int = PROBES) -> DataFrame:
    """``vec_field, id_a, id_b`` (id_a < id_b): cosine at or above the floor, one among the k nearest of the other."""
    members, classes = _prepared(chunks)
    index, placed = build_index(classes)
    near = class_neighbours(placed, placed, index, k=k, floor=floor, probes=probes)
    found = nearest(members, near, members, k)
    return found.select(F.col("field").alias("vec_field"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def nearest_ids(chunks: DataFrame, asked: Column, *, k: int = 10, probes: int = FAR_PROBES) -> DataFrame:
    """``vec_field, id, other, cosine, rank``: the k nearest others of the ids that ``asked`` holds for, among all rows.

    A query reaches ``probes`` cells, whatever the number of rows. The README has the recall against brute force by field and
    size.
    """
    members, classes = _prepared(chunks)
    index, placed = build_index(classes, FAR_CELL_ROWS)
    mine = members.where(asked)
    queries = placed.join(mine.select("field", "cls").distinct(), ["field", "cls"], "left_semi")
    near = class_neighbours(placed, queries, index, k=k, probes=probes)
    return nearest(members, near, mine, k).select(F.col("field").alias("vec_field"), "id", "other", F.round("cosine", 6).alias("cosine"), "rank")
