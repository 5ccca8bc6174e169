"""Ranked search over chunks: vector, graph boost, summary, and hybrid rankings, and the choice among them.

``semantics="intended"`` scores vectors by similarity; ``"as_coded"`` keeps raw distances as scores, sorted descending.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators.ranking import bm25_scores, top
from codequarry.operators.vectors import cosine, json_vector, nearest, squared_l2

MODES = ("hybrid", "vector-graph", "vector-only")


@dataclass(frozen=True)
class SearchOptions:
    """What a search asks for. Filters left at None don't apply; they are combined by AND."""

    text: str = ""
    vector: Sequence[float] = ()
    limit: int = 10
    mode: str = "hybrid"
    summary: bool = False
    project: str | None = None
    language: str | None = None
    path_prefix: str | None = None
    chunk_types: Sequence[str] | None = None
    threshold: float | None = None
    bm25_weight: float = 0.3
    vector_weight: float = 0.5
    graph_weight: float = 0.2
    summary_weight: float = 0.25
    graph_boost: float = 0.3
    semantics: str = "intended"


def filtered(chunks: DataFrame, o: SearchOptions) -> DataFrame:
    if o.project is not None:
        chunks = chunks.where(F.col("project_path") == o.project)
    if o.language is not None:
        chunks = chunks.where(F.col("language") == o.language)
    if o.path_prefix is not None:
        chunks = chunks.where(F.col("file_path").startswith(o.path_prefix))
    if o.chunk_types is not None:
        chunks = chunks.where(F.col("chunk_type").isin(*o.chunk_types))
    return chunks


def vector_search(chunks: DataFrame, o: SearchOptions, k: int | None = None) -> DataFrame:
    """``id, score`` of the nearest chunks: cosine, or as coded squared L2 distance (smallest first)."""
    metric = "l2" if o.semantics == "as_coded" else "cosine"
    return nearest(filtered(chunks, o), "id", "vector", o.vector, k or o.limit, metric=metric)


def _finish(scored: DataFrame, o: SearchOptions) -> DataFrame:
    if o.threshold is not None:
        scored = scored.where(F.col("score") >= o.threshold)
    return top(scored, "id", o.limit)


def _boosted(chunks: DataFrame, related: DataFrame) -> DataFrame:
    """``id`` of chunks whose fqn is a related name, each once."""
    return chunks.select("id", F.col("fqn").alias("qualified_name")).join(related, "qualified_name", "left_semi").select("id").distinct()


def graph_boost_search(chunks: DataFrame, related: DataFrame, o: SearchOptions) -> DataFrame:
    """The limit * 3 nearest chunks, those with a related name raised by the boost, reranked."""
    near = vector_search(chunks, o, o.limit * 3)
    hit = _boosted(filtered(chunks, o), related).withColumn("hit", F.lit(1))
    scored = near.join(hit, "id", "left").select("id", (F.col("score") + F.when(F.col("hit") == 1, o.graph_boost).otherwise(0.0)).alias("score"))
    return _finish(scored, o)


def summary_search(chunks: DataFrame, o: SearchOptions, weight: float = 0.3) -> DataFrame:
    """The limit * 3 nearest chunks by distance, scored (1 - distance)(1 - w) + w * cosine of the summary vector."""
    own = filtered(chunks, o).where(F.size("vector") == len(o.vector))
    dist = own.select("id", squared_l2("vector", o.vector).alias("dist"), cosine(json_vector("summary_vector_json"), o.vector).alias("sim"))
    near = dist.groupBy("id").agg(F.min("dist").alias("dist"), F.max("sim").alias("sim")).orderBy("dist", "id").limit(o.limit * 3)
    return _finish(near.select("id", ((1 - F.col("dist")) * (1 - weight) + F.col("sim") * weight).alias("score")), o)


def _held(short: DataFrame) -> DataFrame:
    """A list that a limit bounds, computed once."""
    return short.sparkSession.createDataFrame(short.collect(), short.schema)


def hybrid_search(chunks: DataFrame, related: DataFrame, o: SearchOptions) -> DataFrame:
    """Weighted sum of BM25, vector and graph parts (and the summary's cosine), over all filtered chunks; positive ones only.

    Without a query vector the vector part is 0. BM25 and vector parts come from their limit * 5 best chunks, divided by the best score; others have 0. Those two short
    lists are joined to the chunks, so nothing wide moves.
    """
    own = filtered(chunks, o)
    k = o.limit * 5
    words = _held(top(bm25_scores(own, "id", "content", o.text).groupBy("id").agg(F.max("score").alias("score")), "id", k))
    near = _held(vector_search(chunks, o, k)) if len(o.vector) else words.limit(0)
    best_w = (words.agg(F.max("score").alias("m")).first().m or 1.0) if o.text else 1.0
    ends = near.agg(F.max("score").alias("hi"), F.min("score").alias("lo")).first()
    best_v = (ends.lo if o.semantics == "as_coded" else ends.hi) or 1.0
    parts = words.select("id", (F.col("score") / best_w * o.bm25_weight).alias("score"))
    parts = parts.unionByName(near.select("id", (F.col("score") / best_v * o.vector_weight).alias("score")))
    parts = parts.unionByName(_boosted(own, related).select("id", F.lit(o.graph_boost * o.graph_weight).alias("score")))
    if o.summary:
        sims = own.select("id", cosine(json_vector("summary_vector_json"), o.vector).alias("score")).distinct()
        parts = parts.unionByName(sims.select("id", (F.col("score") * o.summary_weight).alias("score")))
    return _finish(parts.groupBy("id").agg(F.sum("score").alias("score")).where(F.col("score") > 0), o)


def search(chunks: DataFrame, related: DataFrame, o: SearchOptions, *, summaries: bool = True) -> DataFrame:
    """``id, score`` in the asked mode. A store without summaries always ranks hybrid."""
    if o.mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if not summaries:
        return hybrid_search(chunks, related, replace(o, summary=False))
    if o.mode == "hybrid":
        return hybrid_search(chunks, related, o)
    if o.mode == "vector-graph":
        return graph_boost_search(chunks, related, o)
    return _finish(vector_search(chunks, o), o)
