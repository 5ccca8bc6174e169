"""References to records that do not exist: missing, removed, or arriving later.

A composite reference key may be partly null. References are grouped by their null mask; every mask is anti-joined on its
own non-null columns, under one of SQL's declared match rules. Records live in time intervals, so a reference is resolved
only by a record that was live when the reference was made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MATCH_RULES = ("simple", "partial", "full")


def live_intervals(records: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The times in which some record of each key is live, as ``keys, live_from, live_to``, few for each key.

    A record is live from ``start`` on and before ``end`` (null: still live). Rows with a null key or start, or an end not
    after the start, are never live. The open intervals of a key shrink to one by a plain minimum, combined before the
    shuffle; closed ones that lie before it are merged by key and month of their start, so a key that holds a third of all
    records is not gathered in one task.
    """
    keys = list(keys)
    r = records.select(*keys, F.col(start).alias("live_from"), F.col(end).alias("live_to")).dropna(subset=[*keys, "live_from"])
    opened = r.where(F.col("live_to").isNull()).groupBy(*keys).agg(F.min("live_from").alias("live_from"))
    closed = r.where(F.col("live_to") > F.col("live_from")).groupBy(*keys, "live_from").agg(F.max("live_to").alias("live_to"))
    before = closed.join(opened.withColumnRenamed("live_from", "open_from"), keys, "left")
    before = before.where(F.col("open_from").isNull() | (F.col("live_from") < F.col("open_from")))
    w = W.partitionBy(*keys, F.trunc("live_from", "month")).orderBy("live_from").rowsBetween(W.unboundedPreceding, -1)
    fresh = (F.col("live_from") > F.max("live_to").over(w)).cast("int")
    marked = before.withColumn("month", F.trunc("live_from", "month")).withColumn("fresh", F.coalesce(fresh, F.lit(1)))
    island = F.sum("fresh").over(W.partitionBy(*keys, "month").orderBy("live_from"))
    merged = marked.withColumn("island", island).groupBy(*keys, "month", "island").agg(F.min("live_from").alias("live_from"), F.max("live_to").alias("live_to"))
    return merged.drop("month", "island").unionByName(opened.withColumn("live_to", F.lit(None).cast("timestamp_ntz").cast(r.schema["live_to"].dataType)))


def null_mask(columns: Sequence[str]) -> Column:
    """Bit i is set where column i is not null."""
    return sum((F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)), F.lit(0))


def orphan_references(refs: DataFrame, columns: Sequence[str], at: str, targets: DataFrame, *, start: str, end: str, match: str = "partial") -> DataFrame:
    """Rows of ``refs`` whose key in ``columns`` names no row of ``targets`` that was live at ``at``.

    ``targets`` has the same key columns. ``match`` tells what a key with nulls means, as in SQL:

    * ``simple``: a key with any null refers to nothing and is no orphan;
    * ``partial``: the non-null columns must agree with some record; an all-null key refers to nothing;
    * ``full``: a key that is partly null is always an orphan; an all-null key refers to nothing.

    A null ``at`` matches no interval, so such a reference is an orphan. Repeated rows are kept as given.
    """
    if match not in MATCH_RULES:
        raise ValueError(f"match must be one of {MATCH_RULES}")
    columns, whole = list(columns), (1 << len(columns)) - 1
    masked = refs.withColumn("_mask", null_mask(columns))
    parts = []
    for mask in range(1, whole + 1):
        mine = masked.where(F.col("_mask") == mask)
        if mask != whole and match == "simple":
            continue
        if mask != whole and match == "full":
            parts.append(mine)
            continue
        keys = [c for i, c in enumerate(columns) if mask >> i & 1]
        live = live_intervals(targets, keys, start, end).select(*[F.col(k).alias(f"_t_{k}") for k in keys], "live_from", "live_to")
        on = [F.col(k) == F.col(f"_t_{k}") for k in keys]
        on += [F.col("live_from") <= F.col(at), F.col("live_to").isNull() | (F.col("live_to") > F.col(at))]
        parts.append(mine.join(live, on, "left_anti"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_mask")


def code_references(dependencies: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """The references of three tables as ``ref_table, from_id, at, id_key, name_key``, each once; just one key is not null.

    Ids are taken in lower case; names without outer blanks and without one final ``()``. Null and blank keys are none.
    """
    none = F.lit(None).cast("string")
    key = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|(?<!\s)\s++$", ""), F.lit(""))
    ids = lambda df, t, a, b: df.select(F.lit(t).alias("ref_table"), F.col(a).alias("from_id"), F.col("indexed_at").alias("at"), F.lower(key(F.col(b))).alias("id_key"), none.alias("name_key"))
    name = key(F.regexp_replace(key(F.col("reference_name")), r"\(\)\z", ""))
    names = unresolved.select(F.lit("unresolved_refs").alias("ref_table"), F.col("from_node_id").alias("from_id"), F.col("indexed_at").alias("at"), none.alias("id_key"), name.alias("name_key"))
    refs = ids(dependencies, "dependency_graph", "source_id", "target_id").unionByName(ids(edges, "graph_edges", "source", "target")).unionByName(names)
    return refs.where(F.col("id_key").isNotNull() | F.col("name_key").isNotNull()).distinct()


def placed_references(unresolved: DataFrame) -> DataFrame:
    """``from_id, at, name, file_path, language`` of references by name with the file and language they stand in, each once.

    Names are without outer blanks and one final ``()``; blank values are null.
    """
    key = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|(?<!\s)\s++$", ""), F.lit(""))
    name = key(F.regexp_replace(key(F.col("reference_name")), r"\(\)\z", ""))
    return unresolved.select(F.col("from_node_id").alias("from_id"), F.col("indexed_at").alias("at"), name.alias("name"), F.nullif("file_path", F.lit("")).alias("file_path"), F.nullif("language", F.lit("")).alias("language")).distinct()


def node_keys(nodes: DataFrame) -> DataFrame:
    """Graph nodes under each key they can be referred to by: ``id_key``, or ``name_key`` (name and qualified name)."""
    none = F.lit(None).cast("string")
    by_id = nodes.select(F.lower("id").alias("id_key"), none.alias("name_key"), "indexed_at", "removed_at")
    by_name = nodes.select(none.alias("id_key"), F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name_key"), "indexed_at", "removed_at")
    return by_id.unionByName(by_name)


def code_orphans(dependencies: DataFrame, edges: DataFrame, unresolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ref_table, period, from_id, to_key`` of every orphan reference; period is the month of the reference."""
    refs = code_references(dependencies, edges, unresolved)
    lost = orphan_references(refs, ["id_key", "name_key"], "at", node_keys(nodes), start="indexed_at", end="removed_at")
    return lost.select("ref_table", F.date_format("at", "yyyy-MM").alias("period"), "from_id", F.coalesce("id_key", "name_key").alias("to_key")).distinct()


def orphan_counts(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """References and orphans for each table and month: ``ref_table, period, n_refs, n_orphans``."""
    key = ["ref_table", "period"]
    all_refs = refs.select("ref_table", F.date_format("at", "yyyy-MM").alias("period"), "from_id", F.coalesce("id_key", "name_key").alias("to_key")).distinct()
    return all_refs.groupBy(*key).agg(F.count("*").alias("n_refs")).join(orphans.groupBy(*key).agg(F.count("*").alias("n_orphans")), key, "left").select(
        *key, "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))
