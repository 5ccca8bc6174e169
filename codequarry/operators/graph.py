"""Code-graph queries: all joins of the node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import cut

NOT_DEAD = ("import", "variable", "constant", "class", "function", "method")


def _edges(edges: DataFrame, *kinds: str) -> DataFrame:
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    return e.select("source", "target", "kind").distinct()


def nodes_by_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path)


def node_by_id(nodes: DataFrame, node: str) -> DataFrame:
    """The last indexed row of a node; none for an unknown id."""
    order = [F.desc_nulls_last(c) for c in ("indexed_at", "start_line") if c in nodes.columns]
    return nodes.where(F.col("id") == node).orderBy(*order, "qualified_name").limit(1)


def edges_by_node(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch one of ``id``: ``id, source, target, kind, line``. Two equi-joins, no disjunction."""
    ids = ids.select("id").distinct()
    e = edges.select("source", "target", "kind", "line").distinct()
    out = e.join(ids, e.source == ids.id).unionByName(e.join(ids, e.target == ids.id))
    return out.select("id", "source", "target", "kind", "line").distinct()


def callers(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Nodes with a ``calls`` edge to a node of that qualified name. Unknown sources are dropped."""
    called = nodes.where(F.col("qualified_name") == name).select(F.col("id").alias("target")).distinct()
    found = _edges(edges, "calls").join(called, "target", "left_semi").select(F.col("source").alias("id")).distinct()
    return nodes.select("id", "qualified_name", "file_path").distinct().join(found, "id", "left_semi")


def callees(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Nodes that nodes of that qualified name call."""
    own = nodes.where(F.col("qualified_name") == name).select(F.col("id").alias("source")).distinct()
    found = _edges(edges, "calls").join(own, "source", "left_semi").select(F.col("target").alias("id")).distinct()
    return nodes.select("id", "qualified_name", "file_path").distinct().join(found, "id", "left_semi")


def call_graph(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    a = callers(nodes, edges, name).withColumn("role", F.lit("caller"))
    return a.unionByName(callees(nodes, edges, name).withColumn("role", F.lit("callee")))


def call_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, n_callers, n_callees`` of each node, over distinct ``calls`` edges; a hub is combined before the shuffle."""
    e = _edges(edges, "calls")
    ends = e.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(e.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("n_callers"), F.sum("o").alias("n_callees"))
    return nodes.select("id").distinct().join(sums, "id", "left").na.fill(0, ["n_callers", "n_callees"])


def called_by(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, caller``: who calls each node, a row each, so a hub's callers are never one row. Both are known nodes."""
    known = nodes.select("id").distinct()
    e = _edges(edges, "calls").select(F.col("target").alias("id"), F.col("source").alias("caller"))
    return e.join(known, "id", "left_semi").join(known.withColumnRenamed("id", "caller"), "caller", "left_semi").select("id", "caller")


def within_depth(nodes: DataFrame, edges: DataFrame, focal: DataFrame, depth: int, kinds: Sequence[str] = ()) -> DataFrame:
    """``focal, id, depth``: nodes reached from each focal node along edges in at most ``depth`` steps, with the fewest steps.

    A step is a join of the newest nodes with the edges; nodes reached before are left out, so loops end.
    """
    e = _edges(edges, *kinds).select("source", "target").distinct()
    seen = cut(focal.select(F.col("id").alias("focal"), "id", F.lit(0).alias("depth")).distinct())
    newest = seen
    for step in range(1, depth + 1):
        ahead = newest.join(e, newest.id == e.source).select("focal", F.col("target").alias("id")).distinct()
        newest = cut(ahead.join(seen.select("focal", "id"), ["focal", "id"], "left_anti").withColumn("depth", F.lit(step)))
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    return seen.join(nodes.select("id").distinct(), "id", "left_semi").select("focal", "id", "depth")


def context(nodes: DataFrame, edges: DataFrame, focal: DataFrame, *, semantics: str = "intended") -> DataFrame:
    """``focal, role, id``: children (``contains``), and nodes that refer to or are referred to by each focal node.

    As coded, incoming and outgoing references are the sources and the targets of all edges that touch the focal node, so it
    appears among them itself; as intended, they are the other ends. Ancestors come from the hierarchy operator.
    """
    f = focal.select(F.col("id").alias("focal")).distinct()
    e = _edges(edges)
    refs, held = e.where(F.col("kind") != "contains"), e.where(F.col("kind") == "contains")
    into = refs.join(f, refs.target == f.focal)
    out = refs.join(f, refs.source == f.focal)
    if semantics == "as_coded":
        touching = into.unionByName(out).distinct()
        into = out = touching
    parts = [
        held.join(f, held.source == f.focal).select("focal", F.lit("child").alias("role"), F.col("target").alias("id")),
        into.select("focal", F.lit("incoming").alias("role"), F.col("source").alias("id")),
        out.select("focal", F.lit("outgoing").alias("role"), F.col("target").alias("id")),
    ]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return found.join(nodes.select("id").distinct(), "id", "left_semi").select("focal", "role", "id")


def related_names(nodes: DataFrame, edges: DataFrame, project: str | None = None) -> DataFrame:
    """``qualified_name`` of every project node that an edge links to a project node; a self-loop links a node to itself."""
    n = nodes if project is None else nodes.where(F.col("file_path").startswith(project))
    n = n.select("id", "qualified_name").distinct()
    e = edges.select("source", "target").distinct()
    near = e.join(n.select(F.col("id").alias("source")).distinct(), "source", "left_semi").select(F.col("target").alias("id"))
    near = near.unionByName(e.join(n.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select(F.col("source").alias("id")))
    return n.join(near.distinct(), "id", "left_semi").select("qualified_name").distinct()


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] = ("function", "method", "class")) -> DataFrame:
    """Nodes of the kinds, not exported, that nothing refers to but a container."""
    used = _edges(edges).where(F.col("kind") != "contains").select(F.col("target").alias("id")).distinct()
    own = nodes.where(F.col("kind").isin(*kinds) & ~F.col("is_exported")).select("id", "kind", "qualified_name", "file_path").distinct()
    return own.join(used, "id", "left_anti")


def dead_code_engine(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As the engine endpoint has it: of the other kinds, nodes without an incoming ``calls`` edge."""
    used = _edges(edges, "calls").select(F.col("target").alias("id")).distinct()
    own = nodes.where(~F.col("kind").isin(*NOT_DEAD)).select("id", "kind", "qualified_name", "file_path").distinct()
    return own.join(used, "id", "left_anti")


def files_importing(dependencies: DataFrame, module: str) -> DataFrame:
    """Files whose target file or import name contains ``module``."""
    hit = F.contains("target_file", F.lit(module)) | F.coalesce(F.contains("import_name", F.lit(module)), F.lit(False))
    return dependencies.where(hit).select("source_file").distinct()


def file_dependencies(dependencies: DataFrame) -> DataFrame:
    """``file, n_dependencies, n_dependents`` over distinct pairs of files; blank files are none."""
    d = dependencies.select("source_file", "target_file").where((F.col("source_file") != "") & (F.col("target_file") != "")).distinct()
    both = d.select(F.col("source_file").alias("file"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(d.select(F.col("target_file").alias("file"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("file").agg(F.sum("o").alias("n_dependencies"), F.sum("i").alias("n_dependents"))


def dependencies_of(dependencies: DataFrame, path: str) -> DataFrame:
    return dependencies.where(F.col("source_file") == path).select("target_file").distinct()


def dependents_of(dependencies: DataFrame, path: str) -> DataFrame:
    return dependencies.where(F.col("target_file") == path).select("source_file").distinct()
