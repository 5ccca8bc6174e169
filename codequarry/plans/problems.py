"""Registered queries of the two general problems: hierarchies (p2) and orphan references (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import hierarchy, orphans
from codequarry.session import cut, table


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "code_chunks"), table(spark, d, "graph_edges")


def _trees(spark: SparkSession, d: str, **kw) -> DataFrame:
    return hierarchy.resolve_hierarchy(hierarchy.source_trees(*_sources(spark, d), **kw))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_levels(hierarchy.source_trees(*_sources(spark, d))).where("cyclic").select(F.col("tree").alias("tree_table"), "id")


def p2_several_parents(spark: SparkSession, d: str) -> DataFrame:
    """Every parent of the records that have more than one, with the one that paths follow."""
    chunks, edges = _sources(spark, d)
    both = hierarchy.several_parents(chunks, "code_chunks", "id", "parent_id").unionByName(hierarchy.several_parents(edges.where(F.col("kind") == "contains"), "graph_edges", "target", "source"))
    return both.withColumnRenamed("tree", "tree_table")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each record's root, depth and path; a source that is never a target is a root of its own."""
    return _trees(spark, d, add_parents=True).select(F.col("tree").alias("tree_table"), "id", "root", "depth", F.array_join("path", "/").alias("path"), "cyclic")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_trees(spark, d, add_parents=True)).withColumnRenamed("tree", "tree_table")


def _refs(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("dependency_graph", "graph_edges", "unresolved_refs")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.code_orphans(*_refs(spark, d), table(spark, d, "graph_nodes"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """References and orphan references per table and month."""
    return orphans.orphan_counts(cut(p5_found(spark, d)), orphans.code_references(*_refs(spark, d)))


def p5_composite(spark: SparkSession, d: str) -> DataFrame:
    """References by name, file and language together, each of which may be null, under every match rule."""
    refs = orphans.placed_references(table(spark, d, "unresolved_refs"))
    nodes = table(spark, d, "graph_nodes").select("name", "file_path", "language", "indexed_at", "removed_at")
    out = None
    for rule in orphans.MATCH_RULES:
        lost = orphans.orphan_references(refs, ["name", "file_path", "language"], "at", nodes, start="indexed_at", end="removed_at", match=rule)
        part = lost.select(F.lit(rule).alias("match_rule"), F.date_format("at", "yyyy-MM").alias("period"), "from_id", "name", "file_path", "language").distinct()
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (p2_found, p2_several_parents, p2_paths, p2_descendants, p5_found, p5_counts, p5_composite)}

_POINTERS = """
ptr0 AS (
  SELECT 'code_chunks' AS t, id, min(nullif(parent_id, '')) AS p FROM code_chunks WHERE id <> '' GROUP BY id
  UNION ALL
  SELECT 'graph_edges', target, min(nullif(source, '')) FROM graph_edges WHERE kind = 'contains' AND target <> '' GROUP BY target),
ptr AS ({rows}),
up AS (
  SELECT t, id, p AS a, 1 AS k FROM ptr WHERE p IS NOT NULL AND (t, p) IN (SELECT (t, id) FROM ptr)
  UNION
  SELECT u.t, u.id, q.p, u.k + 1 FROM up u JOIN ptr q ON q.t = u.t AND q.id = u.a
  WHERE q.p IS NOT NULL AND (q.t, q.p) IN (SELECT (t, id) FROM ptr) AND u.k < 400),
reach AS (SELECT DISTINCT t, id, a FROM up),
looped AS (SELECT t, id FROM reach WHERE id = a),
bad AS (SELECT t, id FROM looped UNION SELECT r.t, r.id FROM reach r JOIN looped l ON l.t = r.t AND l.id = r.a)
"""
_ROWS = "SELECT * FROM ptr0"
_ROWS_UP = """SELECT * FROM ptr0 UNION
  SELECT t, p, NULL FROM ptr0 WHERE t = 'graph_edges' AND p IS NOT NULL AND (t, p) NOT IN (SELECT (t, id) FROM ptr0)"""

_REFS = r"""
refs AS (SELECT DISTINCT * FROM (
  SELECT 'dependency_graph' AS ref_table, source_id AS from_id, lower(trim(target_id)) AS to_key, indexed_at AS seen_at, true AS by_id FROM dependency_graph
  UNION ALL SELECT 'graph_edges', source, lower(trim(target)), indexed_at, true FROM graph_edges
  UNION ALL SELECT 'unresolved_refs', from_node_id, trim(regexp_replace(trim(reference_name), '\(\)$', '')), indexed_at, false FROM unresolved_refs)
  WHERE to_key <> ''),
nodes AS (
  SELECT lower(id) AS k, true AS by_id, indexed_at AS s, removed_at AS e FROM graph_nodes
  UNION ALL SELECT name, false, indexed_at, removed_at FROM graph_nodes
  UNION ALL SELECT qualified_name, false, indexed_at, removed_at FROM graph_nodes),
found AS (
  SELECT DISTINCT ref_table, strftime(seen_at, '%Y-%m') AS period, from_id, to_key FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.k = r.to_key AND n.by_id = r.by_id AND n.s <= r.seen_at AND (n.e IS NULL OR n.e > r.seen_at)))
"""

ORACLE = {
    "p2_found": "WITH RECURSIVE " + _POINTERS.format(rows=_ROWS) + "SELECT t AS tree_table, id FROM bad",
    "p2_several_parents": """
      WITH p AS (SELECT DISTINCT 'code_chunks' AS tree_table, id, parent_id AS parent FROM code_chunks WHERE id <> '' AND parent_id <> ''
        UNION SELECT 'graph_edges', target, source FROM graph_edges WHERE kind = 'contains' AND target <> '' AND source <> '')
      SELECT *, parent = min(parent) OVER w AS kept FROM p WINDOW w AS (PARTITION BY tree_table, id) QUALIFY count(*) OVER w > 1""",
    "p2_paths": "WITH RECURSIVE " + _POINTERS.format(rows=_ROWS_UP) + """
      SELECT p.t AS tree_table, p.id,
        CASE WHEN b.id IS NULL THEN coalesce(max_by(u.a, u.k), p.id) END AS root,
        CASE WHEN b.id IS NULL THEN CAST(count(u.a) AS INTEGER) END AS depth,
        CASE WHEN b.id IS NULL THEN coalesce(string_agg(u.a, '/' ORDER BY u.k DESC) || '/', '') || p.id END AS path,
        b.id IS NOT NULL AS cyclic
      FROM ptr p LEFT JOIN bad b ON b.t = p.t AND b.id = p.id LEFT JOIN up u ON u.t = p.t AND u.id = p.id AND b.id IS NULL
      GROUP BY p.t, p.id, b.id""",
    "p2_descendants": "WITH RECURSIVE " + _POINTERS.format(rows=_ROWS_UP) + """
      SELECT u.t AS tree_table, u.a AS ancestor, u.id AS descendant, CAST(u.k AS INTEGER) AS distance FROM up u
      WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.t = u.t AND b.id = u.id)""",
    "p5_found": "WITH " + _REFS + "SELECT * FROM found",
    "p5_counts": "WITH " + _REFS + """
      SELECT ref_table, period, count(*) AS n_refs,
        coalesce((SELECT count(*) FROM found f WHERE f.ref_table = a.ref_table AND f.period = a.period), 0) AS n_orphans
      FROM (SELECT DISTINCT ref_table, strftime(seen_at, '%Y-%m') AS period, from_id, to_key FROM refs) a GROUP BY 1, 2""",
    "p5_composite": r"""
      WITH refs AS (SELECT DISTINCT indexed_at AS seen_at, from_node_id AS from_id, nullif(trim(regexp_replace(trim(reference_name), '\(\)$', '')), '') AS name,
          nullif(file_path, '') AS file_path, nullif(language, '') AS language FROM unresolved_refs),
      marked AS (SELECT *, strftime(seen_at, '%Y-%m') AS period, name IS NOT NULL AND file_path IS NOT NULL AND language IS NOT NULL AS whole,
        NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE (r.name IS NULL OR n.name = r.name) AND (r.file_path IS NULL OR n.file_path = r.file_path)
          AND (r.language IS NULL OR n.language = r.language) AND n.indexed_at <= r.seen_at AND (n.removed_at IS NULL OR n.removed_at > r.seen_at)) AS lost
        FROM refs r WHERE coalesce(name, file_path, language) IS NOT NULL)
      SELECT DISTINCT m.match_rule, period, from_id, name, file_path, language FROM marked,
        (VALUES ('simple'), ('partial'), ('full')) AS m(match_rule)
      WHERE CASE m.match_rule WHEN 'simple' THEN whole AND lost WHEN 'partial' THEN lost ELSE lost OR NOT whole END""",
}
