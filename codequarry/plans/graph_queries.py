"""Registered queries of the code graph and of file dependencies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import graph, hierarchy
from codequarry.session import table

ID_SET = "SELECT id FROM graph_nodes WHERE kind = 'class'"


def _graph(spark, d):
    return table(spark, d, "graph_nodes"), table(spark, d, "graph_edges")


def _busiest(spark, d) -> str:
    """The qualified name with most ``calls`` edges to its nodes (the smallest of equals)."""
    nodes, edges = _graph(spark, d)
    calls = edges.where(F.col("kind") == "calls").select("source", "target").distinct()
    n = nodes.select("id", "qualified_name").distinct().join(calls, F.col("id") == F.col("target")).groupBy("qualified_name").count()
    row = n.orderBy(F.desc("count"), "qualified_name").first()
    return row.qualified_name if row else ""


def nodes_by_file(spark, d):
    """Symbols of each file: counts by file, of live and removed rows alike."""
    return table(spark, d, "graph_nodes").groupBy("file_path").agg(F.countDistinct("id").alias("n_nodes"), F.countDistinct("kind").alias("n_kinds"))


def nodes_of_file(spark, d):
    """The nodes of the file that has most of them."""
    nodes = table(spark, d, "graph_nodes")
    row = nodes.groupBy("file_path").agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), "file_path").first()
    return graph.nodes_by_file(nodes, row.file_path if row else "").select("id", "kind", "qualified_name", "file_path").distinct()


def node_by_id(spark, d):
    """The last row of the node that was indexed again last."""
    nodes = table(spark, d, "graph_nodes")
    row = nodes.groupBy("id").agg(F.countDistinct("indexed_at").alias("n"), F.max("indexed_at").alias("at")).orderBy(F.desc("n"), F.desc("at"), "id").first()
    return graph.node_by_id(nodes, row.id if row else "").select("id", "kind", "qualified_name", "indexed_at")


def called_by(spark, d):
    return graph.called_by(*_graph(spark, d))


def within_depth(spark, d):
    """Nodes within two calls of the busiest name's nodes."""
    nodes, edges = _graph(spark, d)
    return graph.within_depth(nodes, edges, nodes.where(F.col("qualified_name") == _busiest(spark, d)), 2, ("calls",))


def edges_by_node(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.edges_by_node(edges, nodes.where(F.col("kind") == "class").select("id"))


def callers(spark, d):
    return graph.callers(*_graph(spark, d), _busiest(spark, d))


def callees(spark, d):
    return graph.callees(*_graph(spark, d), _busiest(spark, d))


def call_graph(spark, d):
    return graph.call_graph(*_graph(spark, d), _busiest(spark, d))


def call_counts(spark, d):
    return graph.call_counts(*_graph(spark, d))


def context(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.context(nodes, edges, nodes.where(F.col("kind") == "class"))


def context_as_coded(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.context(nodes, edges, nodes.where(F.col("kind") == "class"), semantics="as_coded")


def ancestors(spark, d):
    """Ancestors of every node along ``contains``, nearest first; nodes in or below a loop have none."""
    edges = table(spark, d, "graph_edges").where(F.col("kind") == "contains")
    up = hierarchy.descendants(hierarchy.resolve_hierarchy(hierarchy.parent_pointers(edges, "graph_edges", "target", "source", add_parents=True)))
    return up.select(F.col("descendant").alias("id"), "ancestor", "distance")


def children(spark, d):
    e = table(spark, d, "graph_edges").where(F.col("kind") == "contains").select("source", "target").distinct()
    return e.groupBy(F.col("source").alias("id")).agg(F.count("target").alias("n_children"))


def related_nodes(spark, d):
    return graph.related_names(*_graph(spark, d))


def related_nodes_project(spark, d):
    return graph.related_names(*_graph(spark, d), "/srv/checkouts/export-range")


def dead_code(spark, d):
    return graph.dead_code(*_graph(spark, d))


def dead_code_engine(spark, d):
    return graph.dead_code_engine(*_graph(spark, d))


def files_importing(spark, d):
    return graph.files_importing(table(spark, d, "dependency_graph"), "cache")


def file_dependencies(spark, d):
    return graph.file_dependencies(table(spark, d, "dependency_graph"))


def _hot_file(spark, d, column: str) -> str:
    g = table(spark, d, "dependency_graph").where(F.col(column) != "")
    row = g.groupBy(column).count().orderBy(F.desc("count"), column).first()
    return row[0] if row else ""


def dependencies(spark, d):
    return graph.dependencies_of(table(spark, d, "dependency_graph"), _hot_file(spark, d, "source_file"))


def dependents(spark, d):
    return graph.dependents_of(table(spark, d, "dependency_graph"), _hot_file(spark, d, "target_file"))


def edge_kinds(spark, d):
    """Graph statistics: edges and their ends for each kind."""
    e = table(spark, d, "graph_edges").select("source", "target", "kind").distinct()
    return e.groupBy("kind").agg(F.count("*").alias("n_edges"), F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets"))


QUERIES = {f.__name__: f for f in (
    nodes_by_file, nodes_of_file, node_by_id, called_by, within_depth, edges_by_node, callers, callees, call_graph, call_counts, context, context_as_coded, ancestors, children,
    related_nodes, related_nodes_project, dead_code, dead_code_engine, files_importing, file_dependencies, dependencies,
    dependents, edge_kinds,
)}

_BUSY = """busy AS (SELECT qualified_name AS q FROM (SELECT DISTINCT id, qualified_name FROM graph_nodes) n
      JOIN (SELECT DISTINCT source, target FROM graph_edges WHERE kind = 'calls') e ON e.target = n.id
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
_OUT = "SELECT DISTINCT id, qualified_name, file_path FROM graph_nodes WHERE id IN"
_CALLERS = f"""{_OUT} (SELECT source FROM graph_edges WHERE kind = 'calls' AND target IN
      (SELECT id FROM graph_nodes WHERE qualified_name = (SELECT q FROM busy)))"""
_CALLEES = f"""{_OUT} (SELECT target FROM graph_edges WHERE kind = 'calls' AND source IN
      (SELECT id FROM graph_nodes WHERE qualified_name = (SELECT q FROM busy)))"""


def _context(incoming: str, outgoing: str) -> str:
    return f"""WITH f AS (SELECT DISTINCT id AS focal FROM graph_nodes WHERE kind = 'class'), e AS (SELECT DISTINCT source, target, kind FROM graph_edges)
      SELECT DISTINCT * FROM (
        SELECT focal, 'child' AS role, target AS id FROM f JOIN e ON source = focal AND kind = 'contains'
        UNION ALL SELECT focal, 'incoming', source FROM f JOIN e ON {incoming} AND kind <> 'contains'
        UNION ALL SELECT focal, 'outgoing', target FROM f JOIN e ON {outgoing} AND kind <> 'contains')
      WHERE id IN (SELECT id FROM graph_nodes)"""


def _related(where: str) -> str:
    ids = f"(SELECT id FROM graph_nodes WHERE {where})"
    return f"""SELECT DISTINCT qualified_name FROM graph_nodes WHERE {where} AND id IN (
      SELECT target FROM graph_edges WHERE source IN {ids} UNION SELECT source FROM graph_edges WHERE target IN {ids})"""


ORACLE = {
    "nodes_by_file": "SELECT file_path, count(DISTINCT id) AS n_nodes, count(DISTINCT kind) AS n_kinds FROM graph_nodes GROUP BY 1",
    "nodes_of_file": """SELECT DISTINCT id, kind, qualified_name, file_path FROM graph_nodes WHERE file_path =
      (SELECT file_path FROM graph_nodes GROUP BY 1 ORDER BY count(DISTINCT id) DESC, 1 LIMIT 1)""",
    "node_by_id": """SELECT id, kind, qualified_name, indexed_at FROM graph_nodes WHERE id =
      (SELECT id FROM graph_nodes GROUP BY 1 ORDER BY count(DISTINCT indexed_at) DESC, max(indexed_at) DESC, 1 LIMIT 1)
      ORDER BY indexed_at DESC NULLS LAST, start_line DESC NULLS LAST, qualified_name LIMIT 1""",
    "called_by": """SELECT DISTINCT target AS id, source AS caller FROM graph_edges WHERE kind = 'calls'
      AND target IN (SELECT id FROM graph_nodes) AND source IN (SELECT id FROM graph_nodes)""",
    "within_depth": f"""WITH {_BUSY}, e AS (SELECT DISTINCT source, target FROM graph_edges WHERE kind = 'calls'),
      f AS (SELECT DISTINCT id AS focal FROM graph_nodes WHERE qualified_name = (SELECT q FROM busy)),
      s AS (SELECT focal, focal AS id, 0 AS depth FROM f UNION ALL SELECT focal, target, 1 FROM f JOIN e ON source = focal
        UNION ALL SELECT focal, e2.target, 2 FROM f JOIN e ON e.source = focal JOIN e e2 ON e2.source = e.target)
      SELECT focal, id, CAST(min(depth) AS INTEGER) AS depth FROM s WHERE id IN (SELECT id FROM graph_nodes) GROUP BY 1, 2""",
    "edges_by_node": f"""SELECT DISTINCT n.id, e.source, e.target, e.kind, e.line FROM ({ID_SET}) n JOIN graph_edges e ON e.source = n.id OR e.target = n.id""",
    "callers": f"WITH {_BUSY} {_CALLERS}",
    "callees": f"WITH {_BUSY} {_CALLEES}",
    "call_graph": f"WITH {_BUSY} SELECT *, 'caller' AS role FROM ({_CALLERS}) UNION ALL SELECT *, 'callee' FROM ({_CALLEES})",
    "call_counts": """WITH e AS (SELECT DISTINCT source, target FROM graph_edges WHERE kind = 'calls')
      SELECT id, (SELECT count(*) FROM e WHERE e.target = n.id) AS n_callers, (SELECT count(*) FROM e WHERE e.source = n.id) AS n_callees
      FROM (SELECT DISTINCT id FROM graph_nodes) n""",
    "context": _context("target = focal", "source = focal"),
    "context_as_coded": _context("(target = focal OR source = focal)", "(target = focal OR source = focal)"),
    "ancestors": """WITH RECURSIVE p AS (SELECT target AS id, min(source) AS a FROM graph_edges WHERE kind = 'contains' AND target <> '' AND source <> '' GROUP BY 1),
      up AS (SELECT id, a, 1 AS k FROM p UNION ALL SELECT u.id, p.a, u.k + 1 FROM up u JOIN p ON p.id = u.a WHERE u.k < 400),
      bad AS (SELECT DISTINCT id FROM up WHERE k = 400)
      SELECT id, a AS ancestor, k AS distance FROM up WHERE id NOT IN (SELECT id FROM bad)""",
    "children": "SELECT source AS id, count(DISTINCT target) AS n_children FROM graph_edges WHERE kind = 'contains' GROUP BY 1",
    "related_nodes": _related("true"),
    "related_nodes_project": _related("starts_with(file_path, '/srv/checkouts/export-range')"),
    "dead_code": """SELECT DISTINCT id, kind, qualified_name, file_path FROM graph_nodes n WHERE kind IN ('function', 'method', 'class') AND NOT is_exported
      AND NOT EXISTS (SELECT 1 FROM graph_edges e WHERE e.target = n.id AND e.kind <> 'contains')""",
    "dead_code_engine": """SELECT DISTINCT id, kind, qualified_name, file_path FROM graph_nodes n
      WHERE kind NOT IN ('import', 'variable', 'constant', 'class', 'function', 'method')
      AND NOT EXISTS (SELECT 1 FROM graph_edges e WHERE e.target = n.id AND e.kind = 'calls')""",
    "files_importing": "SELECT DISTINCT source_file FROM dependency_graph WHERE contains(target_file, 'cache') OR contains(coalesce(import_name, ''), 'cache')",
    "file_dependencies": """WITH p AS (SELECT DISTINCT source_file, target_file FROM dependency_graph WHERE source_file <> '' AND target_file <> '')
      SELECT file, CAST(sum(o) AS BIGINT) AS n_dependencies, CAST(sum(i) AS BIGINT) AS n_dependents FROM (
        SELECT source_file AS file, 1 AS o, 0 AS i FROM p UNION ALL SELECT target_file, 0, 1 FROM p) GROUP BY 1""",
    "dependencies": """SELECT DISTINCT target_file FROM dependency_graph WHERE source_file =
      (SELECT source_file FROM dependency_graph WHERE source_file <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
    "dependents": """SELECT DISTINCT source_file FROM dependency_graph WHERE target_file =
      (SELECT target_file FROM dependency_graph WHERE target_file <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
    "edge_kinds": """SELECT kind, count(*) AS n_edges, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets
      FROM (SELECT DISTINCT source, target, kind FROM graph_edges) GROUP BY 1""",
}
