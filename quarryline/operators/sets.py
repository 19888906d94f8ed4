"""Set operations over rows and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.joins import first_per_key


def overlap_rate(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n_a, n_b, n_both, rate of distinct non-null keys: one aggregate over a tagged union, no join."""
    tagged = a.select(F.col(key).alias("k"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(F.col(key).alias("k"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    per_key = tagged.filter("k is not null").groupBy("k").agg(F.max("in_a").alias("x"), F.max("in_b").alias("y"))
    total = per_key.agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b"), F.count_if(F.col("x") + F.col("y") == 2).alias("n_both"))
    total = total.select(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_both")])
    return total.withColumn("rate", F.try_divide(F.col("n_both"), F.col("n_a")))


def prefix_intersection(a: DataFrame, others: Sequence[DataFrame], key: str, length: int) -> DataFrame:
    """Distinct prefixes of ``a`` that are among the prefixes of any of ``others``."""
    cut = lambda d: d.select(F.left(F.col(key), F.lit(length)).alias(key)).filter(F.col(key).isNotNull())
    union = cut(others[0])
    for o in others[1:]:
        union = union.union(cut(o))
    return cut(a).intersect(union)


def without(rows: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows whose key is in none of ``others``; rows with a null key stay."""
    out = rows
    for o in others:
        out = out.join(o.select(key), key, "left_anti")
    return out


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: keys missing from b ("missing") and keys only b has ("extra"). One combinable aggregate over a tagged union."""
    side = lambda d, n: d.select(F.col(key), F.lit(n).alias("from"))
    per_key = side(a, 0).unionByName(side(b, 1)).filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("from").alias("lo"), F.max("from").alias("hi"))
    return per_key.filter("lo = hi").select(key, F.when(F.col("lo") == 0, "missing").otherwise("extra").alias("side"))


def array_drift(old: Column, new: Column) -> tuple[Column, Column, Column]:
    """(added, removed, severity) between two arrays: ok, warning for additions, error for removals."""
    added, removed = F.array_sort(F.array_except(new, old)), F.array_sort(F.array_except(old, new))
    return added, removed, F.when(F.size(removed) > 0, "error").when(F.size(added) > 0, "warning").otherwise("ok")


def later_wins(parts: Sequence[DataFrame], key: str, tie: Sequence[str] = ()) -> DataFrame:
    """Union of sources; for a key in several, the last source's row, then the last by ``tie``."""
    out = None
    for i, p in enumerate(parts):
        one = p.withColumn("_rank", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return first_per_key(out, [key], [F.desc("_rank"), *[F.desc(t) for t in tie]]).drop("_rank")
