"""Exact vector distances and nearest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _vector(v: str | Column | Sequence[float]) -> Column:
    if isinstance(v, str):
        return F.col(v)
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def dot(a: str | Column | Sequence[float], b: str | Column | Sequence[float]) -> Column:
    zipped = F.zip_with(_vector(a), _vector(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: str | Column | Sequence[float], b: str | Column | Sequence[float]) -> Column:
    """Null where a vector is null or the sizes differ."""
    gap = F.zip_with(_vector(a), _vector(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(_vector(a)) == F.size(_vector(b)), F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def cosine(a: str | Column | Sequence[float], b: str | Column | Sequence[float]) -> Column:
    """0 where a vector is null, all zero, or the sizes differ."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.coalesce(F.when(F.size(_vector(a)) == F.size(_vector(b)), value), F.lit(0.0))


def json_vector(c: str | Column) -> Column:
    """An array of doubles from JSON text; null for anything else."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, "array<double>", {"mode": "PERMISSIVE"})


def nearest(rows: DataFrame, key: str, vector: str, query: Sequence[float], k: int, *, metric: str = "l2") -> DataFrame:
    """``key, score``: the k nearest rows by squared L2 distance (smallest first) or cosine (largest first).

    Rows repeated exactly count once. Vectors of another size are left out.
    """
    fits = rows.where(F.size(vector) == len(query))
    if metric == "l2":
        scored = fits.select(key, squared_l2(vector, query).alias("score"))
        return scored.groupBy(key).agg(F.min("score").alias("score")).orderBy("score", key).limit(k)
    scored = fits.select(key, cosine(vector, query).alias("score"))
    return scored.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)
