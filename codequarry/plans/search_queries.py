"""Registered queries of ranking, vector and hybrid search, with their SQL."""

from __future__ import annotations

from dataclasses import replace
from uuid import NAMESPACE_URL, uuid5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.text import STOP_WORDS, tokens
from codequarry.operators import graph, ranking, search
from codequarry.operators.search import SearchOptions
from codequarry.session import scratch, spread, table

QUERY = "vector cache driver cache parser"
CODE_QUERY = "render buffer query metric cache"
VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
ASKED = SearchOptions(text=CODE_QUERY, vector=VECTOR, limit=20)
WITH_SUMMARY = replace(ASKED, summary=True, bm25_weight=0.25, vector_weight=0.35, graph_weight=0.15, summary_weight=0.25)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "code_chunks").drop("summary", "metadata", "file_hash"))


def _related(spark: SparkSession, d: str) -> DataFrame:
    return graph.related_names(table(spark, d, "graph_nodes"), table(spark, d, "graph_edges"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def tokenize_documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(tokens("text")).alias("n_tokens"), F.array_join(tokens("text"), " ").alias("words"))


def term_df(spark, d):
    return ranking.document_frequency(spread(table(spark, d, "documents").select("doc_id", "text")), "text")


def term_tf(spark, d):
    return ranking.postings(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def bm25_idf(spark, d):
    docs = table(spark, d, "documents")
    n = docs.count()
    return ranking.document_frequency(docs, "text").select("term", F.round(ranking.inverse_frequency("df", F.lit(n)), 6).alias("idf"))


def bm25_topk(spark, d):
    return _rounded(ranking.top(ranking.bm25_scores(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", QUERY), "doc_id", 20))


def _word_index(spark, d, name: str, key: str, text: str) -> ranking.WordIndex:
    """The table's words, written once in this session's shared folder and found there by later questions."""
    rows = table(spark, d, name)
    folder = f"{scratch(spark)}/words-{name}-{uuid5(NAMESPACE_URL, d).hex}"
    ix = ranking.WordIndex(spark, folder)
    held = spark.conf.get(f"spark.codequarry.words.{name}.{d}", None)
    if held != folder:
        ix.write(spread(rows.select(key, text)), key, text)
        spark.conf.set(f"spark.codequarry.words.{name}.{d}", folder)
    return ix


def bm25_indexed_topk(spark, d):
    """The same question of a word index on disk."""
    return _rounded(ranking.top(_word_index(spark, d, "documents", "doc_id", "text").scores(QUERY, "doc_id"), "doc_id", 20))


def bm25_scores_all(spark, d):
    return _rounded(ranking.bm25_scores(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", QUERY))


def vector_topk_l2(spark, d):
    from codequarry.operators.vectors import nearest

    return _rounded(nearest(table(spark, d, "embeddings"), "vec_id", "embedding", VECTOR, 20))


def vector_topk_cosine(spark, d):
    from codequarry.operators.vectors import nearest

    return _rounded(nearest(table(spark, d, "embeddings"), "vec_id", "embedding", VECTOR, 20, metric="cosine"))


def vector_topk_filtered(spark, d):
    o = replace(ASKED, language="python", path_prefix="/srv/", chunk_types=("function", "class"), semantics="as_coded")
    return _rounded(search.vector_search(_chunks(spark, d), o))


def vector_summary_topk(spark, d):
    return _rounded(search.summary_search(_chunks(spark, d), ASKED))


def graph_boost_topk(spark, d):
    return _rounded(search.graph_boost_search(_chunks(spark, d), _related(spark, d), ASKED))


def graph_boost_as_coded(spark, d):
    return _rounded(search.graph_boost_search(_chunks(spark, d), _related(spark, d), replace(ASKED, semantics="as_coded")))


def hybrid_topk(spark, d):
    return _rounded(search.hybrid_search(_chunks(spark, d), _related(spark, d), ASKED))


def hybrid_as_coded(spark, d):
    return _rounded(search.hybrid_search(_chunks(spark, d), _related(spark, d), replace(ASKED, semantics="as_coded")))


def hybrid_summary_topk(spark, d):
    return _rounded(search.hybrid_search(_chunks(spark, d), _related(spark, d), WITH_SUMMARY))


def search_modes(spark, d):
    """One question in every mode."""
    chunks, related = _chunks(spark, d), _related(spark, d)
    out = None
    for mode in search.MODES:
        part = _rounded(search.search(chunks, related, replace(ASKED, mode=mode))).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (
    tokenize_documents, term_df, term_tf, bm25_idf, bm25_topk, bm25_indexed_topk, bm25_scores_all, vector_topk_l2, vector_topk_cosine,
    vector_topk_filtered, vector_summary_topk, graph_boost_topk, graph_boost_as_coded, hybrid_topk, hybrid_as_coded,
    hybrid_summary_topk, search_modes,
)}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_VEC = "[" + ", ".join(str(x) for x in VECTOR) + "]::DOUBLE[]"


def _toks(source: str, key: str, text: str) -> str:
    return rf"""toks AS (SELECT {key} AS id, list_filter(string_split_regex(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9\s_]', ' ', 'g'), '\s+'),
      lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t)) AS tk FROM {source})"""


def _bm25(query: str, source: str, key: str, text: str) -> str:
    terms = "(VALUES " + ", ".join(f"('{t}')" for t in query.split()) + ") AS v(term)"
    return _toks(source, key, text) + f""",
      sized AS (SELECT row_number() OVER () AS rn, id, tk, len(tk) AS dl FROM toks),
      corpus AS (SELECT count(*) AS n, avg(dl) AS mean FROM sized),
      asked AS (SELECT term, count(*) AS m FROM {terms} GROUP BY term),
      tfs AS (SELECT rn, id, dl, term, m, len(list_filter(tk, lambda t: t = term)) AS tf FROM sized CROSS JOIN asked),
      dfs AS (SELECT term, count(*) AS df FROM tfs WHERE tf > 0 GROUP BY term),
      bm25 AS (SELECT rn, id, sum(m * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score
        FROM tfs JOIN dfs USING (term) CROSS JOIN corpus WHERE tf > 0 GROUP BY rn, id HAVING score > 0)"""


_RELATED = """rel AS (SELECT DISTINCT qualified_name FROM graph_nodes WHERE id IN (
      SELECT e.target FROM graph_edges e WHERE e.source IN (SELECT id FROM graph_nodes) UNION
      SELECT e.source FROM graph_edges e WHERE e.target IN (SELECT id FROM graph_nodes))),
      boosted AS (SELECT DISTINCT id FROM code_chunks WHERE fqn IN (SELECT qualified_name FROM rel))"""
_COS = "coalesce(list_cosine_similarity({v}::DOUBLE[], {q}), 0)"
_FITS = "FROM code_chunks WHERE len(vector) = 64"
_SUM = """sims AS (SELECT DISTINCT id, CASE WHEN sv IS NOT NULL AND len(sv) = 64 AND list_sum(list_transform(sv, lambda x: x * x)) > 0
        THEN list_dot_product(sv, {q}) / sqrt(list_sum(list_transform(sv, lambda x: x * x))) / sqrt(list_dot_product({q}, {q})) ELSE 0 END AS sim
      FROM (SELECT id, try_cast(CASE WHEN json_valid(summary_vector_json) THEN summary_vector_json END AS DOUBLE[]) AS sv FROM code_chunks))""".format(q=_VEC)


def _near(k: int, coded: bool) -> str:
    if coded:
        return f"near AS (SELECT id, min(list_distance(vector::DOUBLE[], {_VEC}) ** 2) AS score {_FITS} GROUP BY id ORDER BY score, id LIMIT {k})"
    return f"near AS (SELECT id, max({_norm('vector')}) AS score {_FITS} GROUP BY id ORDER BY score DESC, id LIMIT {k})"


def _norm(v: str) -> str:
    d = f"{v}::DOUBLE[]"
    return f"CASE WHEN list_dot_product({d}, {d}) > 0 THEN list_dot_product({d}, {_VEC}) / (sqrt(list_dot_product({d}, {d})) * sqrt(list_dot_product({_VEC}, {_VEC}))) ELSE 0 END"


def _hybrid(w: tuple[float, float, float], coded: bool = False, summary: float | None = None) -> str:
    best = "min" if coded else "max"
    more = f" UNION ALL SELECT id, sim * {summary} FROM sims" if summary else ""
    ctes = [_bm25(CODE_QUERY, "code_chunks", "id", "content"), _near(100, coded), _RELATED] + ([_SUM] if summary else [])
    return "WITH " + ", ".join(ctes) + f""",
      words AS (SELECT id, max(score) AS score FROM bm25 GROUP BY id ORDER BY score DESC, id LIMIT 100),
      parts AS (SELECT id, score / (SELECT max(score) FROM words) * {w[0]} AS score FROM words
        UNION ALL SELECT id, score / (SELECT {best}(score) FROM near) * {w[1]} FROM near
        UNION ALL SELECT id, {0.3 * w[2]} FROM boosted{more})
      SELECT id, round(sum(score), 6) AS score FROM parts GROUP BY id HAVING sum(score) > 0 ORDER BY sum(score) DESC, id LIMIT 20"""


def _boost(coded: bool) -> str:
    return "WITH " + _near(60, coded) + ", " + _RELATED + """
      SELECT near.id, round(score + CASE WHEN b.id IS NULL THEN 0 ELSE 0.3 END, 6) AS score FROM near LEFT JOIN boosted b USING (id)
      ORDER BY score + CASE WHEN b.id IS NULL THEN 0 ELSE 0.3 END DESC, near.id LIMIT 20"""


_HYBRID = _hybrid((0.3, 0.5, 0.2))
_DOCS = _toks("documents", "doc_id", "text")
ORACLE = {
    "tokenize_documents": f"WITH {_DOCS} SELECT id AS doc_id, CAST(len(tk) AS INTEGER) AS n_tokens, coalesce(array_to_string(tk, ' '), '') AS words FROM toks",
    "term_df": f"WITH {_DOCS} SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(tk)) AS term FROM toks) GROUP BY term",
    "term_tf": f"WITH {_DOCS} SELECT id AS doc_id, term, count(*) AS tf FROM (SELECT id, unnest(tk) AS term FROM toks) GROUP BY ALL",
    "bm25_idf": f"""WITH {_DOCS}, d AS (SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(tk)) AS term FROM toks) GROUP BY term)
      SELECT term, round(greatest(0, ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1)), 6) AS idf FROM d""",
    "bm25_topk": f"WITH {_bm25(QUERY, 'documents', 'doc_id', 'text')} SELECT id AS doc_id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, id LIMIT 20",
    "bm25_indexed_topk": f"WITH {_bm25(QUERY, 'documents', 'doc_id', 'text')} SELECT id AS doc_id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, id LIMIT 20",
    "bm25_scores_all": f"WITH {_bm25(QUERY, 'documents', 'doc_id', 'text')} SELECT id AS doc_id, round(score, 6) AS score FROM bm25",
    "vector_topk_l2": f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_VEC}) ** 2, 6) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_VEC}), vec_id LIMIT 20",
    "vector_topk_cosine": f"SELECT vec_id, round({_norm('embedding')}, 6) AS score FROM embeddings ORDER BY {_norm('embedding')} DESC, vec_id LIMIT 20",
    "vector_topk_filtered": f"""SELECT id, round(min(list_distance(vector::DOUBLE[], {_VEC}) ** 2), 6) AS score {_FITS} AND language = 'python'
      AND starts_with(file_path, '/srv/') AND chunk_type IN ('function', 'class') GROUP BY id ORDER BY min(list_distance(vector::DOUBLE[], {_VEC})), id LIMIT 20""",
    "vector_summary_topk": f"""WITH {_SUM}, near AS (SELECT id, min(list_distance(vector::DOUBLE[], {_VEC}) ** 2) AS dist {_FITS} GROUP BY id ORDER BY dist, id LIMIT 60)
      SELECT id, round((1 - dist) * 0.7 + sim * 0.3, 6) AS score FROM near JOIN sims USING (id) ORDER BY (1 - dist) * 0.7 + sim * 0.3 DESC, id LIMIT 20""",
    "graph_boost_topk": _boost(False),
    "graph_boost_as_coded": _boost(True),
    "hybrid_topk": _HYBRID,
    "hybrid_as_coded": _hybrid((0.3, 0.5, 0.2), coded=True),
    "hybrid_summary_topk": _hybrid((0.25, 0.35, 0.15), summary=0.25),
    "search_modes": f"""SELECT *, 'hybrid' AS mode FROM ({_HYBRID}) UNION ALL SELECT *, 'vector-graph' FROM ({_boost(False)})
      UNION ALL SELECT *, 'vector-only' FROM (WITH {_near(20, False)} SELECT id, round(score, 6) AS score FROM near)""",
}
