"""Parent-child rows to full paths, depth, root and descendants, with cycle detection.

Deterministic hash splitters break the chains of parents into short segments. Every node is walked to its next splitter
(by doubling inside the segment), the splitters with their segments form a much smaller pointer graph that is solved the
same way, and one join then expands each node's exact path. Rows carry fixed-size facts of their segment (length, last and
smallest id); only where paths are wanted do they carry the segment itself. A cycle shows up as two consecutive segments
with one smallest id: that node was passed twice. Cycles without a splitter are found so while walking and leave there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.session import cut


def parent_pointers(rows: DataFrame, tree: str | Column, node: str, parent: str, *, add_parents: bool = False) -> DataFrame:
    """Rows as ``tree, id, parent``: one row for each id of a tree.

    Null and empty ids are no nodes. Null and empty parents end a chain. Repeated rows count once. An id has one chain of
    parents, so of several parents it keeps the smallest one; ``several_parents`` reports the others. ``add_parents`` makes
    nodes of parents that have no row of their own.
    """
    tree = F.lit(tree) if isinstance(tree, str) else tree
    p = rows.select(tree.alias("tree"), F.col(node).alias("id"), F.nullif(F.col(parent), F.lit("")).alias("parent"))
    p = p.where((F.col("id") != "") & F.col("tree").isNotNull())
    if add_parents:
        own = p.where(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent"))
        p = p.unionByName(own)
    return p.groupBy("tree", "id").agg(F.min("parent").alias("parent"))


def several_parents(rows: DataFrame, tree: str | Column, node: str, parent: str) -> DataFrame:
    """``tree, id, parent, kept``: every parent of the ids that have more than one, and whether ``parent_pointers`` kept it."""
    tree = F.lit(tree) if isinstance(tree, str) else tree
    p = rows.select(tree.alias("tree"), F.col(node).alias("id"), F.col(parent).alias("parent"))
    p = p.where((F.col("id") != "") & (F.col("parent") != "") & F.col("tree").isNotNull()).distinct()
    low = p.groupBy("tree", "id").agg(F.min("parent").alias("low"), F.count("*").alias("n")).where(F.col("n") > 1)
    return p.join(low, ["tree", "id"]).select("tree", "id", "parent", (F.col("parent") == F.col("low")).alias("kept"))


def _walk(state: DataFrame, paths: bool) -> DataFrame:
    """Doubles pointers until each row of ``tree, id, nxt, hops, last, low, done, cyc`` (and ``seg``, with paths) is done.

    ``nxt`` is where the row points to, the rest tells of its segment, the ids from the row up to nxt (without it): how many
    they are, the last and the smallest one, and all of them in order. A row is done when it points to a stop. Both rounds
    of a stop-free cycle's doubling have one smallest id as soon as they span it; rows that lead there follow one round
    later. A chain or cycle of g rows takes about log2(g) rounds.
    """
    state = cut(state)
    facts = ["nxt", "hops", "last", "low", "done", "cyc", *(["seg"] if paths else [])]
    while not state.where(~F.col("done")).isEmpty():
        ahead = state.select("tree", F.col("id").alias("at"), *[F.col(c).alias(f"{c}2") for c in facts])
        todo = state.where(~F.col("done")).withColumnRenamed("nxt", "at").join(ahead, ["tree", "at"])
        cyc = F.col("cyc2") | (F.col("low") == F.col("low2"))
        moved = todo.select(
            "tree", "id", F.when(~cyc, F.col("nxt2")).alias("nxt"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("last2").alias("last"),
            F.least("low", "low2").alias("low"), (cyc | F.col("done2")).alias("done"), cyc.alias("cyc"),
            *([F.when(~cyc, F.concat("seg", "seg2")).alias("seg")] if paths else []),
        )
        state = cut(state.where("done").unionByName(moved))
    return state


def _resolved(pointers: DataFrame, splitter_every: int, paths: bool) -> DataFrame:
    """``tree, id, root, hops, cyclic`` (and ``path`` from the node up, with paths) of each row of ``pointers``."""
    known = pointers.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    split = lambda c: F.pmod(F.xxhash64(c), F.lit(splitter_every)) == 0
    p = pointers.join(known, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("known"), F.col("parent")).alias("nxt"))
    seg = ["seg"] if paths else []
    start = p.select(
        "tree", "id", "nxt", F.lit(1).cast("long").alias("hops"), F.col("id").alias("last"), F.col("id").alias("low"),
        (F.col("nxt").isNull() | split("nxt")).alias("done"), F.lit(False).alias("cyc"), *([F.array("id").alias("seg")] if paths else []),
    )
    walked = _walk(start, paths)
    reduced = walked.where(split("id")).withColumn("done", F.col("nxt").isNull() | F.col("cyc"))
    solved = _walk(reduced, paths).select("tree", F.col("id").alias("nxt"), *[F.col(c).alias(f"{c}_up") for c in ("hops", "last", "cyc", *seg)])
    full = walked.join(solved, ["tree", "nxt"], "left")
    out = full.select("tree", "id", F.coalesce("last_up", "last").alias("root"), (F.col("hops") + F.coalesce("hops_up", F.lit(0))).alias("hops"), (F.col("cyc") | F.coalesce("cyc_up", F.lit(False))).alias("cyclic"), *([F.concat("seg", F.coalesce("seg_up", F.array().cast("array<string>"))).alias("path")] if paths else []))
    facts = [F.when(~F.col("cyclic"), F.col("root")).alias("root"), F.when(~F.col("cyclic"), F.col("hops") - 1).cast("int").alias("depth")]
    return out.select("tree", "id", *facts, *([F.when(~F.col("cyclic"), F.reverse("path")).alias("path")] if paths else []), "cyclic")


def resolve_levels(pointers: DataFrame, splitter_every: int = 8) -> DataFrame:
    """``tree, id, root, depth, cyclic`` of ``tree, id, parent``: the facts of a path without the path.

    Each row keeps its size whatever the depth, so a chain of any length costs as much as its rows. Otherwise as
    ``resolve_hierarchy``.
    """
    return _resolved(pointers, splitter_every, False)


def resolve_hierarchy(pointers: DataFrame, splitter_every: int = 8) -> DataFrame:
    """``tree, id, parent`` to ``tree, id, parent, root, depth, path, cyclic``.

    ``path`` runs from the root to the node, both included; a root has depth 0. A parent that has no row ends the chain, so
    the row below it is a root. A node in a loop or below one is ``cyclic``, with null root, depth and path. An empty table
    gives an empty result. ``splitter_every`` trades walking rounds against the size of the reduced graph. Full paths of a
    chain of n rows are n * n / 2 ids: that is the result's size. ``resolve_levels`` does without them.
    """
    return _resolved(pointers, splitter_every, True).join(pointers, ["tree", "id"]).select("tree", "id", "parent", "root", "depth", "path", "cyclic")


def descendants(resolved: DataFrame) -> DataFrame:
    """``tree, ancestor, descendant, distance``: every node with each node below it. Cyclic nodes have none and are none."""
    up = resolved.where(~F.col("cyclic") & (F.col("depth") > 0))
    pairs = up.select("tree", F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
    return pairs.where(F.col("pos") < F.col("depth")).select("tree", "ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def source_trees(chunks: DataFrame, edges: DataFrame, *, add_parents: bool = False) -> DataFrame:
    """Parent pointers of chunks (``parent_id``) and of ``contains`` edges (``source`` above ``target``) in one frame."""
    a = parent_pointers(chunks, "code_chunks", "id", "parent_id")
    b = parent_pointers(edges.where(F.col("kind") == "contains"), "graph_edges", "target", "source", add_parents=add_parents)
    return a.unionByName(b)
