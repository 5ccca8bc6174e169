"""BM25 over any id and text columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.functions.text import query_tokens, tokens
from codequarry.session import cut

K1, B = 1.5, 0.75


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf``: how often each document has each term. Write it partitioned or bucketed by term to serve queries."""
    return docs.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """``term, df``: the number of documents with each term."""
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def inverse_frequency(df: str | Column, n: str | Column) -> Column:
    d, n = (F.col(c) if isinstance(c, str) else c for c in (df, n))
    return F.greatest(F.lit(0.0), F.log((n - d + 0.5) / (d + 0.5) + 1))


@dataclass(frozen=True)
class Corpus:
    """What a query needs to know of a whole corpus: a few numbers."""

    n: int
    mean_length: float
    df: tuple[int, ...]


def _counted(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """``key, dl, tf``: length and the counts of the query's terms; all inside the scan, nothing is exploded."""
    own = docs.select(key, tokens(text).alias("tk"))
    tf = F.array(*[F.size("tk") - F.size(F.array_remove("tk", w)) for w in terms])
    return own.select(key, F.size("tk").alias("dl"), tf.alias("tf"))


def bm25_scores(docs: DataFrame, key: str, text: str, query: str, *, k1: float = K1, b: float = B) -> DataFrame:
    """``key, score`` of every document with a positive score.

    A term repeated in the query counts repeatedly; a query without terms gives no row. Texts are read once, into lengths and
    counts; the corpus numbers are combined before their shuffle, and no postings move. Repeated documents count as documents
    of their own.
    """
    asked = query_tokens(query)
    terms = sorted(set(asked))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    counted = cut(_counted(docs, key, text, terms))
    row = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *[F.count(F.when(F.col("tf")[i] > 0, 1)).alias(f"d{i}") for i in range(len(terms))]).first()
    corpus = Corpus(row.n, row.mean or 1.0, tuple(row[f"d{i}"] for i in range(len(terms))))
    score: Column = F.lit(0.0)
    for i, term in enumerate(terms):
        tf = F.col("tf")[i].cast("double")
        norm = tf + k1 * (1 - b + b * F.col("dl") / F.lit(corpus.mean_length))
        score = score + asked.count(term) * inverse_frequency(F.lit(corpus.df[i]), F.lit(corpus.n)) * tf * (k1 + 1) / norm
    return counted.select(key, score.alias("score")).where(F.col("score") > 0)


def top(scores: DataFrame, key: str, k: int, score: str = "score", *, ascending: bool = False) -> DataFrame:
    """The k best rows; equal scores in order of the key."""
    return scores.orderBy(F.col(score) if ascending else F.col(score).desc(), key).limit(k)


class WordIndex:
    """BM25 postings on disk, by term, so a question reads the lists of its terms and nothing else.

    Below a folder lie ``postings`` (key, term, tf, dl), split into files by a hash of the term and sorted by it, and ``corpus``
    (number of documents, their mean length and largest key). Texts are tokenised once, when the index is written.
    """

    PARTS = 64  #: folders of postings; a question opens one a term

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def _part(term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(WordIndex.PARTS)).cast("int")

    def write(self, docs: DataFrame, key: str, text: str) -> WordIndex:
        """Indexes all documents in place of what was there. Repeated documents count as documents of their own."""
        own = cut(docs.select(F.col(key).alias("key"), tokens(text).alias("tk")).withColumn("doc", F.monotonically_increasing_id()))
        each = own.select("doc", "key", F.size("tk").alias("dl"), F.explode("tk").alias("term"))
        lists = each.groupBy("doc", "key", "dl", "term").agg(F.count("*").alias("tf")).withColumn("part", self._part(F.col("term")))
        # ranges of part and term, so a task writes few files; a hot term is spread over tasks, as documents are in the range too
        lists.repartitionByRange("part", "term", "doc").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/postings")
        own.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tk")), F.lit(1.0)).alias("mean"), F.max("key").alias("key")).write.mode("overwrite").parquet(f"{self.folder}/corpus")
        return self

    def scores(self, query: str, key: str = "key", *, k1: float = K1, b: float = B) -> DataFrame:
        """``key, score`` of every document with a positive score, as ``bm25_scores`` gives them."""
        asked = query_tokens(query)
        terms = sorted(set(asked))
        corpus = self.spark.read.parquet(f"{self.folder}/corpus")
        shape = T.StructType().add("doc", T.LongType()).add("key", corpus.schema["key"].dataType).add("dl", T.IntegerType()).add("term", T.StringType()).add("tf", T.LongType()).add("part", T.IntegerType())
        lists = self.spark.read.schema(shape).parquet(f"{self.folder}/postings")
        if not terms:
            return lists.select(F.col("key").alias(key), F.lit(0.0).alias("score")).where(F.lit(False))
        parts = [r.p for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._part(F.col("term")).alias("p")).distinct().collect()]
        lists = lists.where(F.col("part").isin(parts) & F.col("term").isin(terms))
        corpus = corpus.first()
        df = {r.term: r.n for r in lists.groupBy("term").agg(F.count("*").alias("n")).collect()}  # the terms of the question
        weight = F.coalesce(*[F.when(F.col("term") == t, asked.count(t) * inverse_frequency(F.lit(df.get(t, 0)), F.lit(corpus.n))) for t in terms])
        tf = F.col("tf").cast("double")
        part = weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(corpus.mean or 1.0)))
        return lists.groupBy("doc", "key").agg(F.sum(part).alias("score")).where(F.col("score") > 0).select(F.col("key").alias(key), "score")
