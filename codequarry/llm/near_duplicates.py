"""Near-duplicate records by a signature-coordinate inverted join.

Every content is a set of word triples; equal sets form one class, so copies never meet each other. A class has a MinHash
signature of ``COORDINATES`` values and is posted under its coordinate-value pairs. Two classes are a candidate pair when at
least ``MATCHES`` coordinates collide. Collisions are counted with prefix and skip merging: a class posts only under the
``m - MATCHES + 1`` shortest of its m lists that hold anybody else (two classes with enough collisions must meet in one of
them), and the long lists it skips are only looked into for pairs that met elsewhere, by comparing signatures. Candidate
pairs are verified by their exact similarity.

A pair of similarity s has Binomial(32, s) collisions: at the limit of 0.6 fewer than 9 come with probability 8e-5.

A coordinate list that holds more than ``LONG_LIST`` classes (a header in a third of all files) is split before anybody meets
in it: its classes are posted under their rarest word triples instead, each as many as a pair of its two sizes must share
one of. That bound is exact, so splitting loses no pair, and the pairs that meet are retained by the same count of collisions.
Triples that more than ``LONG_LIST`` classes post are split once more, by the sizes of both sides: a class meets another under
a common header only where the header alone, given the two sizes, can reach the limit. What is still longer is one of many
real pairs; such lists are joined block by block, so no task holds one whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from codequarry.session import cut

WORDS = 3
LIMIT = 0.6
COORDINATES = 32
MATCHES = 9
LONG_LIST = 500  #: classes in a list before it is split
BLOCK = 4096  #: classes of one list that meet in one task
BANDS = 1.04  #: ratio of neighbouring size bands of long triple lists

_WORD = re.compile(rb"[a-z0-9_]+")
_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64)
_STEPS = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _shingles(content: str, known: dict[bytes, int]) -> np.ndarray:
    """The distinct hashed word triples, ascending. Words are runs of ASCII letters, digits and _, in lower case."""
    words = _WORD.findall(content.encode().lower())  # lower() of bytes changes ASCII letters only
    if len(words) < WORDS:
        return np.zeros(0, np.uint64)
    if len(known) > 500_000:
        known.clear()
    h = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total = _mix(total + h[k : k + n] * _STEPS[k])
    return np.unique(total)


def _signature(s: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):  # a very long content in parts
        low = np.minimum(low, _mix(s[k : k + 4096, None] * _ODD + _ADD).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _scan(batches: Iterator[pa.RecordBatch], sets: bool) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for b in batches:
        rows = []
        for i, content in enumerate(b.column("content").to_pylist()):
            s = _shingles(content, known)
            if len(s):
                raw = s.tobytes()
                rows.append((i, xxhash.xxh3_128_digest(raw), len(s), s.view(np.int64) if sets else _signature(s)))
        if rows:
            at, cls, n, values = zip(*rows)
            kind = pa.int64() if sets else pa.int32()
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), pa.array(np.concatenate(values), kind))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), b.column("file").take(pa.array(at)), pa.array(cls, pa.binary()), pa.array(n, pa.int32()), lists], names=["id", "file", "cls", "n", "v"])


def _sketch(docs: DataFrame, sets: bool) -> DataFrame:
    v = T.ArrayType(T.LongType() if sets else T.IntegerType())
    schema = T.StructType().add("id", "string").add("file", "string").add("cls", "binary").add("n", "integer").add("v", v)
    return docs.mapInArrow(lambda it: _scan(it, sets), schema)


def file_key(path: str | Column) -> Column:
    """Spellings of one file made equal: ``\\`` is ``/``, ``//`` and ``/./`` are ``/``. Null is the empty path."""
    path = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    return F.regexp_replace(path, r"/(?:\.?/)+", "/")


def _documents(rows: DataFrame, key: str, file: str, content: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), file_key(F.col(file)).alias("file"), F.col(content).alias("content")).where(F.col("id").isNotNull() & F.col("content").isNotNull())


def _sizes_fit(a: str, b: str) -> Column:
    return F.least(a, b) >= F.lit(LIMIT) * F.greatest(a, b) - 1e-9


def _pairs_in_lists(left: DataFrame, right: DataFrame, key: list[str], fits: Column) -> DataFrame:
    """``a, b`` (a < b) of classes on the two sides of one list that ``fits`` (in ``na, nb, ra, rb``) and that collide often enough.

    Sides have ``key, cls, n, v, r`` and ``len``, the length of the list. Postings carry their signature, so only pairs that
    pass leave the join. A list is met block by block: each posting goes to all pairs of blocks that hold its own.
    """
    blocks = F.ceil(F.col("len") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    side = lambda df, x: df.select(*key, "ba", "bb", F.col("cls").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "v", "r")])
    hits = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    met = side(left.withColumn("ba", own).withColumn("bb", every), "a").join(side(right.withColumn("bb", own).withColumn("ba", every), "b"), [*key, "ba", "bb"])
    met = met.where((F.col("a") != F.col("b")) & _sizes_fit("na", "nb") & fits & (hits >= MATCHES))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _common(a: str | Column, b: str | Column) -> Column:
    """How many triples sets of these sizes share at least, if they reach the limit."""
    return F.ceil(F.lit(LIMIT / (1 + LIMIT)) * (a + b) - 1e-9)


def _split_by_triples(sets: DataFrame, classes: DataFrame, long_list: int) -> DataFrame:
    """``a, b`` of the classes in ``sets`` (``cls, v``: all triples) that share a triple among the rarest of both.

    With triples in one order of rarity, a pair of sizes na and nb whose c common triples reach the limit has its first common
    one among the first na - c + 1 of one and the first nb - c + 1 of the other. A triple at place r of a set of n therefore
    serves only partners of up to (n - r + 1) * (1 + limit) / limit - n triples.
    """
    n, r = F.col("n"), F.col("r")
    posts = sets.select("cls", F.size("v").alias("n"), F.explode("v").alias("t"))
    df = posts.groupBy("t").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    ranked = posts.join(df, "t", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("cls").orderBy("df", "t")))
    reach = F.floor((n - r + 1) * ((1 + LIMIT) / LIMIT) - n + 1e-6)  # the largest partner this triple serves
    prefix = ranked.where((F.col("df") > 1) & (reach >= F.ceil(n * LIMIT - 1e-9))).withColumn("reach", reach)
    lists = prefix.groupBy("t").agg(F.count("*").alias("len")).where(F.col("len") > 1)
    prefix = cut(prefix.drop("df").join(lists, "t"))
    signed = classes.select("cls", "v")
    fits = (F.col("ra") <= F.col("na") - _common(F.col("na"), F.col("nb")) + 1) & (F.col("rb") <= F.col("nb") - _common(F.col("na"), F.col("nb")) + 1)
    short = prefix.where(F.col("len") <= long_list).join(signed, "cls")
    pairs = _pairs_in_lists(short, short, ["t"], fits & (F.col("a") < F.col("b")))

    band = lambda c: F.floor(F.log(c.cast("double")) / F.log(F.lit(BANDS)) + 1e-9).cast("int")
    low, high = F.greatest(F.ceil(n * LIMIT - 1e-9), F.lit(1)), F.least(F.floor(n / LIMIT + 1e-9), F.col("reach"))
    long = prefix.where(F.col("len") > long_list).where(low <= high).withColumn("mine", band(n))
    long = long.withColumn("other", F.explode(F.sequence(band(low), band(high))))
    smaller, larger = F.col("mine") == F.col("lo"), F.col("mine") == F.col("hi")
    long = long.select("t", "cls", "n", "r", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    cells = long.groupBy("t", "lo", "hi").agg(F.count("*").alias("len"), F.count(F.when(smaller, 1)).alias("nl"), F.count(F.when(larger, 1)).alias("nh"))
    long = long.join(cells.where((F.col("nl") > 0) & (F.col("nh") > 0) & (F.col("len") > 1)).drop("nl", "nh"), ["t", "lo", "hi"]).join(signed, "cls")
    apart = fits & ((F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b")))
    return pairs.unionByName(_pairs_in_lists(long.where(smaller), long.where(larger), ["t", "lo", "hi"], apart)).distinct()


def duplicate_classes(rows: DataFrame, key: str = "id", file: str = "file_path", content: str = "content", *, long_list: int = LONG_LIST) -> tuple[DataFrame, DataFrame]:
    """Members ``cls, id, file, n`` and the links ``a, b, similarity`` (a < b) between classes at or above the limit.

    Contents under three words, null contents and null ids are in no class. Rows repeated exactly count once. A content of
    any length is read whole. Empty tables give empty results; other columns are left out.
    """
    docs = _documents(rows, key, file, content)
    sketched = cut(_sketch(docs, sets=False))
    members = sketched.select("cls", "id", "file", "n").distinct()
    classes = cut(sketched.groupBy("cls").agg(F.min(F.struct("id", "n", "v")).alias("one")).select("cls", "one.*"))

    posts = classes.select("cls", F.posexplode("v").alias("c", "x")).select("cls", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("x").cast("long")).alias("token"))
    lists = posts.groupBy("token").agg(F.count("*").alias("len")).where(F.col("len") > 1)
    shared = posts.join(lists, "token")
    own = F.sort_array(F.collect_list(F.struct("len", "token")))  # at most one for each coordinate
    prefix = shared.groupBy("cls").agg(own.alias("own")).where(F.size("own") >= MATCHES)
    prefix = prefix.select("cls", F.explode(F.slice("own", 1, F.size("own") - MATCHES + 1)).alias("p")).select("cls", "p.*")
    prefix = cut(prefix.join(classes.select("cls", "n", "v"), "cls").withColumn("r", F.lit(0)))

    met = prefix.where(F.col("len") <= long_list)
    pairs = _pairs_in_lists(met, met, ["token"], F.col("a") < F.col("b")).distinct()

    crowded = prefix.where(F.col("len") > long_list).select("cls").distinct()
    contents = lambda which: _sketch(docs.join(classes.join(which, "cls", "left_semi").select("id"), "id", "left_semi"), sets=True).select("cls", "v").dropDuplicates(["cls"])
    if not crowded.isEmpty():
        pairs = pairs.unionByName(_split_by_triples(cut(contents(crowded)), classes, long_list)).distinct()
    pairs = cut(pairs)

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    full = cut(contents(wanted))
    both = pairs.join(full.select(F.col("cls").alias("a"), F.col("v").alias("va")), "a").join(full.select(F.col("cls").alias("b"), F.col("v").alias("vb")), "b")
    common = F.size(F.array_intersect("va", "vb"))
    links = both.select("a", "b", (common / (F.size("va") + F.size("vb") - common)).alias("similarity")).where(F.col("similarity") >= LIMIT)
    return members, cut(links)


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b) of different files, each pair once: linked classes, and copies within a class."""
    m = members.select("cls", "id", "file").distinct()
    left, right = m.select(F.col("cls").alias("a"), F.col("id").alias("ia"), F.col("file").alias("fa")), m.select(F.col("cls").alias("b"), F.col("id").alias("ib"), F.col("file").alias("fb"))
    other = (F.col("fa") != F.col("fb")) & (F.col("ia") != F.col("ib"))
    across = links.select("a", "b").join(left, "a").join(right, "b").where(other)
    within = left.join(right, F.col("a") == F.col("b")).where(other & (F.col("ia") < F.col("ib")))
    both = across.select("ia", "ib").unionByName(within.select("ia", "ib"))
    return both.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def connected_groups(links: DataFrame) -> DataFrame:
    """``cls, grp`` of every class in a link: the smallest class of its connected component.

    Alternating large and small stars: edges are rewired to smaller neighbours until none changes, in about log rounds.
    """
    edges = cut(links.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where(F.col("x") != F.col("y"))
        new = cut(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    return edges.select(F.col("b").alias("cls"), F.col("a").alias("grp")).unionByName(edges.select(F.col("a").alias("cls"), F.col("a").alias("grp"))).distinct()


def similar_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id, class_id, group_id, n_links`` for each record with a class.

    class_id names the set of triples it has, group_id the component of linked classes (its own class, if none), n_links
    the number of other classes linked to its class.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    m = members.select("id", "cls").distinct().join(connected_groups(links), "cls", "left").join(ends, "cls", "left")
    return m.select("id", F.hex("cls").alias("class_id"), F.hex(F.coalesce("grp", "cls")).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
