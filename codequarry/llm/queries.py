"""Registered queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import encode, mix, neighbours, sentences, split_chunks
from codequarry.llm import near_duplicates as near
from codequarry.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near.similar_pairs(*near.duplicate_classes(table(spark, d, "code_chunks")))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's class of equal contents, its group of similar ones, and its number of links."""
    return near.similar_groups(*near.duplicate_classes(table(spark, d, "code_chunks")))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_chunks.split_oversized(table(spark, d, "code_chunks"), table(spark, d, "chunk_config"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_chunks.oversized_ids(_pieces(spark, d))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return _pieces(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, d, "code_chunks"))


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every fiftieth id (by hash), among all rows."""
    return neighbours.nearest_ids(table(spark, d, "code_chunks"), F.pmod(F.xxhash64("id"), F.lit(50)) == 0)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").withColumn("weight", mix.letter_share("text"))
    return mix.mix_sources(docs, table(spark, d, "mix_targets"), weight="weight")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix, each with how often it is used."""
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents")).select("doc_id", "sent_end")


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence with its place in the text."""
    return sentences.split_sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_pieces, p4_found, p4_nearest, p6_ids, p7_mix, p7_shares, p8_found, p8_sentences)}
#: The others can't be written in SQL; tests/llm holds them against brute force, round trips and held-out accuracy.
ORACLE: dict[str, str] = {
    "p1_found": r"""
      WITH docs AS (SELECT DISTINCT id, regexp_replace(replace(file_path, '\', '/'), '/(\.?/)+', '/', 'g') AS f,
          list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w
        FROM code_chunks WHERE content IS NOT NULL AND id IS NOT NULL),
      t AS (SELECT DISTINCT id, f, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT id, f, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
      n AS (SELECT id, f, count(*) AS n FROM t GROUP BY 1, 2),
      met AS (SELECT a.id AS ia, a.f AS fa, b.id AS ib, b.f AS fb, count(*) AS c FROM t a JOIN t b ON b.x = a.x AND a.id < b.id AND a.f <> b.f GROUP BY 1, 2, 3, 4)
      SELECT DISTINCT ia AS id_a, ib AS id_b FROM met JOIN n a ON a.id = ia AND a.f = fa JOIN n b ON b.id = ib AND b.f = fb
      WHERE c / (a.n + b.n - c) >= 0.6""",
    "p3_found": """
      SELECT DISTINCT id FROM code_chunks JOIN chunk_config USING (project_path)
      WHERE length(content) > max_chunk_size AND id IS NOT NULL""",
    "p4_found": """
      WITH raw AS (SELECT DISTINCT 'vector' AS field, id, vector::DOUBLE[] AS v FROM code_chunks
        UNION SELECT 'summary_vector_json', id, try_cast(CASE WHEN json_valid(summary_vector_json) THEN summary_vector_json END AS DOUBLE[]) FROM code_chunks),
      use AS (SELECT field, id, v FROM raw WHERE id IS NOT NULL AND len(v) = 64
        AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
      near AS (SELECT a.field, a.id AS i, b.id AS j, list_cosine_similarity(a.v, b.v) AS c FROM use a JOIN use b ON b.field = a.field AND b.id <> a.id
        QUALIFY row_number() OVER (PARTITION BY a.field, a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) <= 10)
      SELECT DISTINCT field AS vec_field, least(i, j) AS id_a, greatest(i, j) AS id_b FROM near WHERE c >= 0.9""",
}
