"""Latest rows, ranks, splits and context around rows.

Ranks are per partition key. A rank over all rows is made by a range-partitioned sort and per-partition
offsets (``global_rank``), so that no single task sorts everything.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions.arrays import let
from quarryline.session import materialize


def latest(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The row with the greatest ``by`` per key, nulls least. A combinable aggregate (max_by of structs)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r")).select(*keys, "_r.*")


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows per key with their rank; Spark limits groups before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def global_rank(rows: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Position of every row in the order of the columns ``order`` (ascending), from 1.

    Rows are range-partitioned and ranked within their range; the ranges' sizes, one row per partition,
    are added up and joined back. The partitioned rows are written once: both branches must see the same
    ranges, also where a lost executor makes a part run again. ``order`` must tell all rows apart.
    """
    part = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = part.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    within = part.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return within.join(F.broadcast(before), "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def chronological_split(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ratio: float) -> DataFrame:
    """split = memory or eval: per key the first max(1, int(n * ratio)) rows are memory, never all; a single row is eval."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    cut = F.least(F.greatest(F.lit(1), F.floor(n * F.lit(ratio))), n - 1)
    return rows.withColumn("split", F.when((n > 1) & (F.row_number().over(w.orderBy(*order)) <= cut), "memory").otherwise("eval"))


def with_context(rows: DataFrame, keys: Sequence[str], order: str, text: str, before: int, after: int) -> DataFrame:
    """context: the texts of up to ``before`` rows before and ``after`` rows after, itself included."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    return rows.withColumn("context", F.collect_list(text).over(w))


def spaced(hits: list[int], gap: int) -> list[int]:
    """Positions in order, each more than ``gap`` after the one kept before."""
    kept: list[int] = []
    for h in sorted(set(hits)):
        if not kept or h - kept[-1] > gap:
            kept.append(int(h))
    return kept


def greedy_frames(hits: Column, before: int, after: int) -> Column:
    """Hits kept in order so that their frames do not overlap; the positions of a document are passed over once."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield lists.map(lambda x: None if x is None else spaced(list(x), before + after))

    return run(hits)


def order_label(keys: Sequence[str], order: Sequence[str]) -> Column:
    """FAIL for the first row of a key, SUCCESS for the last, COMMIT_i between; a single row is FAIL."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return F.when(i == 1, "FAIL").when(i == n, "SUCCESS").otherwise(F.concat(F.lit("COMMIT_"), (i - 1).cast("string")))


def last_items(array: Column, keep: int, most: int) -> Column:
    """The array, or its last ``keep`` elements if it has more than ``most``."""
    return F.when(F.size(array) > most, F.slice(array, -keep, keep)).otherwise(array)


def tail_or_matching(parts: Column, tail: int, words: Sequence[str]) -> Column:
    """Elements of the last ``tail``, and earlier ones that hold one of the words."""
    pattern = "|".join(words)
    return let(parts, lambda ps: F.filter(ps, lambda x, i: (i >= F.greatest(F.size(ps) - tail, F.lit(0))) | F.lower(x).rlike(pattern)))


def renumbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Rows numbered from 1 without gaps per key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def natural_order(key: str) -> list[Column]:
    """Sort columns that put numeric ids in order of their numbers, before all others."""
    number = F.col(key).try_cast("bigint")
    return [number.isNull(), number, F.col(key)]


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, the same on every run: those with the least seeded hash of the key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), key).limit(n)
