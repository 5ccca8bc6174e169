"""The library's front: an index of source trees that can be searched, asked and kept current."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.operators import code, graph, hierarchy, index, providers, search
from codequarry.operators.search import SearchOptions
from codequarry.session import cut
from codequarry.sources import files
from codequarry.sources.store import Store
from codequarry.streaming.operators import watched_changes


class CodeIndex:
    """Chunks, symbols and dependencies of projects in a store folder.

    ``provider`` makes an embedding function in each task, and for the text of a question; without one chunks have no vector
    and searches rank by words.
    """

    def __init__(self, spark: SparkSession, folder: str, *, provider: Callable[[], providers.Embed] | None = None, chunk_words: int = 2048):
        self.spark, self.store, self.provider, self.chunk_words = spark, Store(spark, folder), provider, chunk_words

    def index_path(self, root: str, project: str | None = None, *, summaries: bool = False) -> DataFrame:
        """Indexes the new and changed files below a root, drops those that are gone, and gives the project's statistics."""
        project = project or root
        scanned = files.scan_sources(self.spark, root)
        held = self.store.read("code_chunks").where(F.col("project_path") == project)
        before = index.latest_hash(held.withColumn("one", F.lit(1)), ["file_path"], "file_hash", "one")
        moved = watched_changes(before, scanned.select("file_path", "file_hash"))
        fresh = scanned.join(moved.where(F.col("change") != "unlink").select("file_path"), "file_path", "left_semi")
        self._replace(project, fresh, moved.select("file_path"), summaries)
        return self.stats(project)

    def _replace(self, project: str, sources: DataFrame, paths: DataFrame, summaries: bool) -> None:
        sources, paths = cut(sources), cut(paths.distinct())
        symbols = code.extract_symbols(sources, "file_path").distinct()
        nth = F.row_number().over(W.partitionBy("file_path", "qualified_name", "kind", "line").orderBy("name", "is_exported"))
        named = lambda name: F.sha2(F.concat_ws("\n", F.lit(project), F.col("file_path"), name), 256)
        symbols = symbols.withColumn("id", named(F.concat_ws("\n", "qualified_name", "kind", F.col("line").cast("string"), nth.cast("string"))))
        by_id = symbols.withColumn("qualified_name", F.col("id")).drop("id")  # so references are between symbols, not names
        lang = sources.select("file_path", "language")
        nodes = symbols.join(lang, "file_path").select(
            "id", "kind", "name", "qualified_name", "file_path", "language", F.col("line").alias("start_line"),
            F.col("line").alias("end_line"), F.lit(0).alias("start_column"), F.lit(0).alias("end_column"), "is_exported",
            F.lit(project).alias("project_path"), F.lit("{}").alias("metadata"),
        )
        members = symbols.where(F.col("kind").isin("function", "method") & F.col("qualified_name").contains(".")).select("file_path", "line", F.col("id").alias("target"))
        held = code.containing_symbol(members, by_id.where(F.col("kind") == "class"), "file_path").select("file_path", F.lit(None).cast("int").alias("line"), F.lit("contains").alias("kind"), F.col("inside").alias("source"), "target")
        refs = code.extract_references(sources, by_id, "file_path").unionByName(held)
        edges = refs.select("source", "target", "kind", F.lit(project).alias("project_path"), F.lit("{}").alias("metadata"), "line")
        chunks = index.chunk_sources(sources, "file_path", "content", self.chunk_words).join(sources.select("file_path", "language", "file_hash"), "file_path")
        place = chunks.withColumn("line", F.col("end_line"))
        own = code.containing_symbol(place, symbols, "file_path").drop("line").withColumnRenamed("inside", "fqn")
        own = own.select(
            named(F.col("chunk_index").cast("string")).alias("id"), F.lit(project).alias("project_path"), "file_path", "content", "start_line", "end_line", "language",
            F.lit("block").alias("chunk_type"), "fqn", F.to_json(F.struct(F.col("token_count").alias("tokenCount"), F.col("chunk_index").alias("chunkIndex"))).alias("metadata"),
            "file_hash", (providers.local_summary("content") if summaries else F.lit(None).cast("string")).alias("summary"),
        )
        if self.provider is not None:
            own = providers.embed(own, "content", "vector", self.provider)
        keys = paths.select(F.lit(project).alias("project_path"), "file_path")
        gone = self.store.read("graph_nodes").join(keys, ["project_path", "file_path"], "left_semi").select("project_path", F.col("id").alias("source"))
        self.store.swap("graph_edges", edges, gone, ["project_path", "source"])
        self.store.swap("graph_nodes", nodes, keys, ["project_path", "file_path"])
        self.store.swap("code_chunks", own, keys, ["project_path", "file_path"])

    def index_dependencies(self, root: str, project: str | None = None) -> None:
        """Rebuilds the import graph of a project's files."""
        project = project or root
        scanned = files.scan_sources(self.spark, root, endings=files.LINKED)
        made = code.build_dependency_graph(scanned, scanned.select("file_path"))
        file_id = lambda c: F.sha2(F.concat_ws("\n", F.lit(project), F.col(c)), 256)
        rows = made.withColumn("source_id", file_id("source_file")).withColumn("target_id", file_id("target_file")).withColumn("project_path", F.lit(project))
        self.store.swap("dependency_graph", rows, rows.sparkSession.createDataFrame([(project,)], "project_path string"), ["project_path"])

    def remove_path(self, path: str, project: str | None = None) -> None:
        """Drops a file's chunks, nodes and edges."""
        mine = (F.col("file_path") == path) & (F.lit(True) if project is None else F.col("project_path") == project)
        nodes, edges, chunks = (self.store.read(t) for t in ("graph_nodes", "graph_edges", "code_chunks"))
        gone = nodes.where(mine).select("project_path", "id")
        touched = edges.join(gone.withColumnRenamed("id", "source"), ["project_path", "source"], "left_semi").unionByName(edges.join(gone.withColumnRenamed("id", "target"), ["project_path", "target"], "left_semi"))
        self.store.swap("graph_edges", edges.limit(0), touched, edges.columns)
        for name, rows in (("graph_nodes", nodes), ("code_chunks", chunks)):
            self.store.swap(name, rows.limit(0), rows.where(mine), ["project_path", "file_path"])

    def search(self, o: SearchOptions) -> DataFrame:
        """``id, score`` and what a hit shows: file, lines, language, snippet of 300 characters, percentage."""
        chunks = self.store.read("code_chunks")
        related = graph.related_names(self.store.read("graph_nodes"), self.store.read("graph_edges"))
        if o.text and not len(o.vector) and self.provider is not None:
            o = replace(o, vector=providers.embed_query(o.text, self.provider))
        if not len(o.vector):
            o = replace(o, mode="hybrid", summary=False)
        hits = search.search(chunks, related, o)
        shown = chunks.select("id", "file_path", "start_line", "end_line", "language", providers.truncated("content", 300).alias("snippet"))
        return hits.join(shown, "id").withColumn("percent", F.round(F.col("score") * 100).cast("int")).orderBy(F.desc("score"), "id")

    def stats(self, project: str) -> DataFrame:
        chunks = self.store.read("code_chunks").where(F.col("project_path") == project)
        return index.project_stats(chunks.withColumn("indexed_at", F.lit(None).cast("timestamp"))).drop("last_indexed")

    def nodes_by_file(self, path: str) -> DataFrame:
        return graph.nodes_by_file(self.store.read("graph_nodes"), path)

    def callers(self, name: str) -> DataFrame:
        return graph.callers(self.store.read("graph_nodes"), self.store.read("graph_edges"), name)

    def callees(self, name: str) -> DataFrame:
        return graph.callees(self.store.read("graph_nodes"), self.store.read("graph_edges"), name)

    def context(self, name: str) -> DataFrame:
        nodes = self.store.read("graph_nodes")
        return graph.context(nodes, self.store.read("graph_edges"), nodes.where(F.col("qualified_name") == name))

    def ancestors(self) -> DataFrame:
        held = self.store.read("graph_edges").where(F.col("kind") == "contains")
        return hierarchy.resolve_hierarchy(hierarchy.parent_pointers(held, "graph_edges", "target", "source", add_parents=True))

    def dead_code(self) -> DataFrame:
        return graph.dead_code(self.store.read("graph_nodes"), self.store.read("graph_edges"))

    def node(self, node: str) -> DataFrame:
        return graph.node_by_id(self.store.read("graph_nodes"), node)

    def call_graph(self, name: str) -> DataFrame:
        return graph.call_graph(self.store.read("graph_nodes"), self.store.read("graph_edges"), name)

    def called_by(self) -> DataFrame:
        return graph.called_by(self.store.read("graph_nodes"), self.store.read("graph_edges"))

    def within(self, name: str, depth: int) -> DataFrame:
        nodes = self.store.read("graph_nodes")
        return graph.within_depth(nodes, self.store.read("graph_edges"), nodes.where(F.col("qualified_name") == name), depth)

    def dependencies(self, path: str) -> DataFrame:
        return graph.dependencies_of(self.store.read("dependency_graph"), path)

    def dependents(self, path: str) -> DataFrame:
        return graph.dependents_of(self.store.read("dependency_graph"), path)

    def files_importing(self, module: str) -> DataFrame:
        return graph.files_importing(self.store.read("dependency_graph"), module)
