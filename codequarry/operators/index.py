"""Building and keeping an index: changed files, line chunks, merges, statistics and hashed word vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.session import cut

DIMENSIONS = 3072


def latest_hash(chunks: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """``keys, value``: of each key the value of its last row that has one; the largest of equals."""
    rows = chunks.where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(F.max(F.struct(order, value)).alias("m")).select(*keys, F.col(f"m.{value}").alias(value))


def changed_files(current: DataFrame, indexed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of ``current`` (keys, value) that ``indexed`` doesn't hold with the same value: new or changed files."""
    return current.join(indexed.select(*keys, value), [*keys, value], "left_anti")


def removed_files(current: DataFrame, indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return indexed.select(*keys).distinct().join(current.select(*keys), list(keys), "left_anti")


def replace_by_key(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``updates``, and the rows of ``target`` with none of their keys: a re-indexed file leaves no stale chunk behind."""
    return target.join(updates.select(*keys).distinct(), list(keys), "left_anti").unionByName(updates)


def merge_by_key(target: DataFrame, updates: DataFrame, keys: Sequence[str], *, keep: Sequence[str] = (), fill: Sequence[str] = ()) -> DataFrame:
    """Upsert by key. New values win, but for ``keep``, which stay as first written, and ``fill``, which stay where the
    update has null. Both sides have one row a key and the same columns."""
    t = target.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in target.columns if c not in keys], F.lit(True).alias("_was"))
    u = updates.withColumn("_is", F.lit(True))
    both = u.join(t, list(keys), "full")

    def pick(c: str) -> Column:
        old, new = F.col(f"_old_{c}"), F.col(c)
        if c in keep:
            return F.when(F.col("_was"), old).otherwise(new)
        if c in fill:
            return F.coalesce(new, old)
        return F.when(F.col("_is"), new).otherwise(old)

    return both.select(*keys, *[pick(c).alias(c) for c in target.columns if c not in keys])


def delete_graph_of_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the files: edges go first, at either end."""
    gone = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(files.select("file_path").distinct(), "file_path", "left_anti"), kept


def project_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, files, lines, languages and the last time of each project, over distinct chunks."""
    rows = chunks.select("project_path", "id", "file_path", "start_line", "end_line", "language", "indexed_at").distinct()
    return rows.groupBy("project_path").agg(
        F.count("*").alias("n_chunks"),
        F.countDistinct("file_path").alias("n_files"),
        F.sum(F.col("end_line") - F.col("start_line") + 1).alias("n_lines"),
        F.countDistinct("language").alias("n_languages"),
        F.max("indexed_at").alias("last_indexed"),
    )


def language_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and files of each language in each project, named apart."""
    rows = chunks.select("project_path", "language", "id", "file_path").distinct()
    return rows.groupBy("project_path", "language").agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"))


def word_slot(word: str | Column, dimensions: int = DIMENSIONS) -> Column:
    """The slot of a word: a shift-and-add hash from 5381 whose shift wraps at 32 bits."""
    w = F.col(word) if isinstance(word, str) else word
    codes = F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = lambda h: F.pmod(h * 32 + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.pmod(F.abs(F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: wrapped(h) + h + c)), F.lit(dimensions)).cast("int")


def local_embedding(docs: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``key, slot, weight``: unit word-frequency vectors, sparse. Texts without a word over two letters have no row.

    Keys are taken as unique. All distinct words count, however many.
    """
    words = F.filter(F.split(F.lower(text), r"[^A-Za-z0-9_]+"), lambda w: F.length(w) > 2)
    own = docs.select(key, words.alias("ws")).where(F.size("ws") > 0).repartition(key)  # the one shuffle: all that follows is by key
    freq = own.select(key, F.size("ws").alias("n"), F.explode("ws").alias("w")).groupBy(key, "n", "w").agg(F.count("*").alias("c"))
    slots = freq.groupBy(key, word_slot("w", dimensions).alias("slot")).agg(F.sum(F.col("c") / F.col("n")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)))
    return slots.select(key, "slot", (F.col("x") / norm).alias("weight"))


def embedding_topk(vectors: DataFrame, key: str, query: DataFrame, k: int) -> DataFrame:
    """``key, score``: largest dot products with one sparse vector ``slot, weight``. The query has a slot a word at most."""
    hits = vectors.join(query.select("slot", F.col("weight").alias("q")), "slot")
    return hits.groupBy(key).agg(F.sum(F.col("weight") * F.col("q")).alias("score")).orderBy(F.desc("score"), key).limit(k)


def pack_lines(text: str, size: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first line, last line) of chunks of whole lines with up to ``size`` words; a longer line stands alone."""
    out: list[tuple[int, int, int, int]] = []
    begin, first, held, at = 0, 1, 0, 0
    lines = text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")]
    for no, line in enumerate(lines, 1):
        n = len(line.split())
        if held and held + n > size:
            out.append((begin, at, first, no - 1))
            begin, first, held = at, no, 0
        held += n
        at += len(line)
    if text[begin:].strip():
        out.append((begin, min(at, len(text)), first, len(lines)))
    return out


def chunk_sources(sources: DataFrame, key: str, content: str, size: int = 2048) -> DataFrame:
    """``key, chunk_index, start_line, end_line, token_count, content``: sources packed into chunks at line boundaries.

    Tokens are runs of anything but white space. Null and blank sources have no chunk; a source is read whole.
    """
    src = sources.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).where(F.col("content").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, (s, e, first, last) in enumerate(pack_lines(text, size)):
                    rows.append((k, i, first, last, len(text[s:e].split()), text[s:e]))
            if rows:
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[key, "chunk_index", "start_line", "end_line", "token_count", "content"])

    return src.mapInArrow(run, f"{key} string, chunk_index int, start_line int, end_line int, token_count int, content string")


def fit_pieces(text: str, longest: int) -> list[str]:
    """Trimmed pieces of up to ``longest`` characters: cut at the last line break in reach, else blank, else hard."""
    rest, out = text.strip(), []
    while len(rest) > longest:
        cut = rest.rfind("\n", 0, longest + 1)
        if cut <= 0:
            cut = rest.rfind(" ", 0, longest + 1)
        if cut <= 0:
            cut = longest
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return [p for p in [*out, rest] if p]


def split_messages(rows: DataFrame, key: str, text: str, longest: int = 3900) -> DataFrame:
    """``key, piece_no, piece``: texts cut for a sink that takes ``longest`` characters. Null and blank ones have none."""
    short = F.char_length(text) <= longest
    trimmed = F.regexp_replace(text, r"^[\s\p{Z}]+|(?<![\s\p{Z}])[\s\p{Z}]++\z", "")
    whole = rows.where(short).select(F.col(key).cast("string").alias(key), F.lit(0).alias("piece_no"), trimmed.alias("piece")).where(F.col("piece") != "")
    src = rows.where(~short).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(k, i, p) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, p in enumerate(fit_pieces(t, longest))]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.int32(), pa.string()))], names=[key, "piece_no", "piece"])

    return whole.unionByName(src.mapInArrow(run, f"{key} string, piece_no int, piece string"))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``n``: their number from 1 on within the group, in order. No task holds a whole group.

    Rows are sorted over all tasks by group and order, so a group that holds a third of them is spread; each task numbers its
    own run of a group, and runs are shifted by what earlier tasks hold of it. Order must tell rows of a group apart.
    """
    low = (1 << 33) - 1
    at = cut(rows.orderBy(group, *order).withColumn("_at", F.monotonically_increasing_id()))  # task in the high bits
    at = at.withColumn("_task", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(low))
    runs = at.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    before = F.sum("_size").over(W.partitionBy(group).orderBy("_task")) - F.col("_size")
    runs = runs.select(group, "_task", (before - F.col("_first") + 1).alias("_shift"))
    return at.join(runs, [group, "_task"]).withColumn("n", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def unique_slugs(rows: DataFrame, key: str, base: str, order: str) -> DataFrame:
    """``key, slug``: bases made unique by ``-2``, ``-3`` and so on, in order; numbers that are some other row's base, or
    would be taken twice, are passed over.

    Natural ``x-2`` bases keep their name. Of the taken numbers t1 < t2 < … of a base, number ti is passed over by rows from
    ti - i + 1 on, so rows need just those points, with how many numbers each passes over.
    """
    ranked = numbered(rows.select(key, base, F.col(order).alias("_order")), base, ["_order", key]).select(key, base, "n")
    bases = rows.select(base).distinct()
    taken = bases.select(F.regexp_extract(base, r"^(.*)-(\d{1,9})$", 1).alias("stem"), F.regexp_extract(base, r"^(.*)-(\d{1,9})$", 2).try_cast("int").alias("no"))
    taken = numbered(taken.where((F.col("stem") != "") & (F.col("no") >= 2)).distinct(), "stem", ["no"])
    points = taken.groupBy("stem", (F.col("no") - F.col("n") + 1).alias("point")).agg(F.count("*").alias("over"))
    points = points.join(ranked.groupBy(F.col(base).alias("stem")).agg(F.max("n").alias("most")), "stem").where(F.col("point") <= F.col("most"))
    points = points.groupBy("stem").agg(F.collect_list(F.struct("point", "over")).alias("points"))  # no more than rows of the base
    joined = ranked.join(points, ranked[base] == points.stem, "left")
    passed = F.aggregate(F.filter(F.coalesce("points", F.array().cast("array<struct<point:bigint,over:bigint>>")), lambda p: p["point"] <= F.col("n")), F.lit(0).cast("long"), lambda a, p: a + p["over"])
    return joined.select(key, F.when(F.col("n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), (F.col("n") + passed).cast("string"))).alias("slug"))
