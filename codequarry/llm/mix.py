"""Mixing sources to target weights, sizes in tokens.

Complete epochs come first; the rest of a source's budget is filled by Efraimidis-Spirakis sampling: each text draws the
exponential key -ln(u)/weight, keys are sorted within the source and their tokens summed up to the budget. Weights are a
column of the documents that the caller names, such as a classifier's score; without one every text weighs the same. The sums
are made level by level: a source's keys fall into ``FAN`` buckets, the one that the budget cuts into ``FAN`` more, and so
on until the cut bucket is small, so no task ever sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.llm.encode import count_tokens
from codequarry.session import cut

FAN = 1024  #: buckets a level
SMALL = 10_000  #: texts of a cut bucket that one task sorts
DEEPEST = 5  #: levels at most: keys are 53 bits wide


def source_label(c: str | Column) -> Column:
    """Labels that differ only in letter case or outer blanks are one; null and blank ones are none."""
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|(?<!\s)\s++$", "")), F.lit(""))


def letter_share(text: str | Column) -> Column:
    """A plain weight in [0.1, 1] for documents that bring none: letters and digits by characters, less for texts under 50."""
    n = F.char_length(text)
    wordy = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]", "")) / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), wordy * F.least(F.lit(1.0), n / 50)))


def _uniform(c: str, seed: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), c), 11) + 0.5) / F.lit(2.0**53)


def usable_texts(documents: DataFrame, targets: DataFrame, *, weight: str | None = None, vocabulary: str | None = None, seed: int = 7) -> DataFrame:
    """Each text of the wanted sources once: ``doc_id, source, n_tokens, key``, key uniform in (0, 1), heavy texts first.

    With u uniform by the text's hash, the key is 1 - u ** (1 / weight): the order of -ln(u) / weight. Null, NaN and negative
    weights count as 0; texts of weight 0 come last in their source, in the order of u.
    A text that occurs several times, in one source or in more, is kept under its smallest doc_id and that row's source, so
    it can't be used beyond the cap. Texts without a token and sources without a target are left out.
    """
    wanted = targets.select(source_label("source").alias("source")).distinct()
    given = F.col(weight).cast("double") if weight else F.lit(1.0)
    usable = F.when((given > 0) & ~F.isnan(given), given).otherwise(0.0)
    docs = documents.select("doc_id", source_label("source").alias("source"), "text", usable.alias("weight")).where(F.char_length("text") > 0)
    docs = docs.join(wanted, "source", "left_semi")
    once = docs.withColumn("h", F.sha2("text", 256)).groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("first"))
    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    docs = docs.repartition(parts, "doc_id", "source")  # the join's own shuffle, in as many parts as the encoding needs
    docs = docs.join(once.select("first.doc_id", "first.source", "h"), ["doc_id", "source"])
    docs = docs.where(F.sha2("text", 256) == F.col("h"))
    sized = count_tokens(docs, ["doc_id", "source", "h", "weight"], vocabulary=vocabulary)
    once = sized.where(F.col("n_tokens") > 0).groupBy("h").agg(F.min(F.struct("doc_id", "source", "n_tokens", "weight")).alias("one")).select("h", "one.*")
    key = F.exp(F.log(_uniform("h", seed)) / F.col("weight"))
    return once.select("doc_id", "source", "n_tokens", F.when(F.col("weight") > 0, (1 - key) * 0.5).otherwise(0.5 + _uniform("h", seed) / 2).alias("key"))


def budgets(available: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: int | None = None) -> list[tuple]:
    """``source, target_weight, max_repeats, tokens_available, budget, epochs, rest`` of each target.

    Weights are scaled to the sources that have texts. The total is ``total_tokens``, or the largest that every such source
    can fill within its cap; a source never gets more than cap times its tokens.
    """
    there = {s: w for s, w, _ in targets if available.get(s, 0) > 0 and w > 0}
    scale = sum(there.values())
    caps = {s: max(0, r) * available.get(s, 0) for s, _, r in targets}
    total = total_tokens if total_tokens is not None else int(min((caps[s] * scale / w for s, w in there.items()), default=0))
    rows = []
    for s, w, r in targets:
        size = available.get(s, 0)
        budget = min(caps[s], round(total * w / scale)) if s in there else 0
        rows.append((s, float(w), int(r), size, budget, budget // size if size else 0, budget % size if size else 0))
    return rows


def _cut_within(texts: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, edge, left``: the key up to which texts are taken whole, and the tokens still wanted beyond it.

    Level by level: sums of ``FAN`` buckets a source, of which the budget cuts one, until that holds few texts. Only the sums
    are kept, a row for each bucket of each source; a level reads nothing but its cut buckets.
    """
    spark = texts.sparkSession
    schema = "source string, low double, left long"
    state = [(r.source, 0.0, r.rest) for r in plan.select("source", "rest").collect()]  # a row for each target
    width, done = 1.0, []
    for _ in range(DEEPEST):
        if not state:
            break
        width /= FAN
        at = F.broadcast(spark.createDataFrame(state, schema))
        mine = texts.join(at, "source").where((F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + width * FAN))
        bucket = F.floor((F.col("key") - F.col("low")) / width)
        sums = mine.groupBy("source", "low", "left", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
        upto = F.sum("tokens").over(W.partitionBy("source").orderBy("bucket"))
        cut_at = sums.withColumn("upto", upto).where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "tokens", "n", "low", "left")).alias("c"))
        state, found = [], cut_at.select("source", "c.*").collect()
        for r in found:
            row = (r.source, r.low + r.bucket * width, r.left - (r.upto - r.tokens))
            (state if r.n > SMALL else done).append(row + ((width,) if r.n <= SMALL else ()))
    done += [(*row, width) for row in state]
    return spark.createDataFrame(done, "source string, edge double, left long, width double")


def mix_sources(documents: DataFrame, targets: DataFrame, *, weight: str | None = None, total_tokens: int | None = None, vocabulary: str | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix as ``doc_id, source, n_tokens, repeats``, and the report of shares.

    The report has ``source, target_weight, max_repeats, tokens_available, tokens_used, texts_used, actual_share``, with a
    row for each target, sources without documents included. A source's rest ends with the text whose inclusion is nearest
    to the budget, so it misses by less than half a text. Targets are a small fixed table; repeated labels count once (the
    smallest row), null weights as 0. An empty table of either kind gives an empty mix.
    """
    spark = documents.sparkSession
    texts = cut(usable_texts(documents, targets, weight=weight, vocabulary=vocabulary, seed=seed))
    t = targets.groupBy(source_label("source").alias("source")).agg(F.min(F.struct(F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("r"))).alias("t"))
    plan = [(r.source, r.t.w, r.t.r) for r in t.where(F.col("source").isNotNull()).orderBy("source").collect()]
    have = {r.source: r.n for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each target at most
    schema = "source string, target_weight double, max_repeats int, tokens_available long, budget long, epochs long, rest long"
    plan = F.broadcast(spark.createDataFrame(budgets(have, plan, total_tokens), schema))

    # of the cut bucket each text is placed by its tokens before it; what lies below the bucket is taken whole
    docs = texts.join(plan.select("source", "epochs", "rest"), "source").join(F.broadcast(_cut_within(texts, plan)), "source", "left")
    inside = (F.col("key") >= F.col("edge")) & (F.col("key") < F.col("edge") + F.col("width"))
    w = W.partitionBy("source").orderBy("key", "doc_id")
    fine = docs.where(inside).withColumn("more", (F.sum("n_tokens").over(w) - F.col("n_tokens") / 2 <= F.col("left")).cast("int"))
    rough = docs.where(~F.coalesce(inside, F.lit(False))).withColumn("more", F.coalesce(F.col("key") < F.col("edge"), F.col("rest") > 0).cast("int"))
    mix = rough.unionByName(fine).withColumn("repeats", (F.col("epochs") + F.col("more")).cast("int"))
    mix = cut(mix.where(F.col("repeats") > 0).select("doc_id", "source", "n_tokens", "repeats"))

    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.count("*").alias("texts_used"))
    report = plan.join(used, "source", "left").na.fill(0, ["tokens_used", "texts_used"])
    share = F.try_divide(F.col("tokens_used"), F.sum("tokens_used").over(W.partitionBy(F.lit(1))))
    report = report.select("source", "target_weight", "max_repeats", "tokens_available", "tokens_used", "texts_used", F.coalesce(share, F.lit(0.0)).alias("actual_share"))
    return mix, report
