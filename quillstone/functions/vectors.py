"""Column expressions over vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORM_EPS = 1e-9  #: added to a norm before dividing by it
POOL_EPS = 1e-9  #: least divisor of a masked mean


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, eps: float = NORM_EPS) -> Column:
    n = l2_norm(v) + F.lit(eps)
    return F.transform(_doubles(v), lambda x: x / n)


def masked_mean_pool(df: DataFrame, key: str, position: str, vector: str, mask: str) -> DataFrame:
    """Mean of token vectors whose mask is set, per key: sum(h * m) / max(sum(m), 1e-9), as an ordered array.

    Exploded by dimension so that partial sums combine before the shuffle, whatever the number of tokens of a key.
    """
    m = F.col(mask).cast("double")
    flat = df.select(F.col(key), m.alias("m_"), F.posexplode(_doubles(F.col(vector))).alias("dim_", "h_"))
    sums = flat.groupBy(key, "dim_").agg((F.sum(F.col("h_") * F.col("m_")) / F.greatest(F.sum("m_"), F.lit(POOL_EPS))).alias("v_"))
    # one element for each dimension: a bounded list
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim_", "v_"))), lambda s: s["v_"]).alias(vector))
