"""Scores of ranked lists and of step results, per row and in total.

Inputs are one row per id with arrays: ``predicted`` (in rank order) and ``truth``. An empty prediction
counts in the denominator and scores 0; rows without truth are left out of every score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DENOMINATORS = ("predicted", "pushed", "both", "truth")


def scored_rows(truth: DataFrame, predictions: DataFrame, pushed: DataFrame | None, denominator: str) -> DataFrame:
    """id, predicted, truth of the ids that ``denominator`` counts.

    predicted: predicted ids that have truth; pushed: pushed ids with truth, missing predictions empty;
    both: ids with truth and a non-empty prediction; truth: all ids with truth.
    """
    if denominator not in DENOMINATORS:
        raise ValueError(f"denominator must be one of {DENOMINATORS}")
    return counted_rows(truth.join(predictions, "id", "left"), pushed, denominator)


def counted_rows(lists: DataFrame, pushed: DataFrame | None, denominator: str) -> DataFrame:
    """The same from one row per id with both lists; ``predicted`` is null where there is no prediction."""
    rows = lists.filter(F.size("truth") > 0)
    if denominator == "pushed":
        if pushed is None:
            raise ValueError("denominator pushed needs the pushed ids")
        rows = rows.join(pushed.select("id"), "id", "left_semi")
    if denominator in ("predicted", "both"):
        rows = rows.filter(F.col("predicted").isNotNull() & ((F.size("predicted") > 0) | F.lit(denominator == "predicted")))
    return rows.withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))


def hits_at(predicted: Column, truth: Column, k: int) -> Column:
    """Whether one of the first k predictions is true. Cut first, repeats count as places."""
    return F.coalesce(F.arrays_overlap(F.slice(predicted, 1, k), truth), F.lit(False))


def per_row(rows: DataFrame, ks: Sequence[int]) -> DataFrame:
    """n_predicted, n_truth, n_matched, exact, precision, recall and top_k per row."""
    p, t = F.array_distinct("predicted"), F.array_distinct("truth")
    matched = F.size(F.array_intersect(p, t))
    return rows.select(
        "id", F.size(p).alias("n_predicted"), F.size(t).alias("n_truth"), matched.alias("n_matched"), ((matched == F.size(t)) & (F.size(p) == F.size(t))).alias("exact"),
        F.coalesce(F.try_divide(matched, F.size(p)), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(matched, F.size(t)), F.lit(0.0)).alias("recall"), *[hits_at(F.col("predicted"), F.col("truth"), k).alias(f"top_{k}") for k in ks],
    )


def summary(scores: DataFrame, ks: Sequence[int]) -> DataFrame:
    """n, exact, mean precision and the share of top-k hits, in one aggregate."""
    out = scores.agg(F.count("*").alias("n"), F.count_if(F.col("exact")).alias("_exact"), F.sum(F.col("precision").cast("decimal(20,12)")).cast("double").alias("_precision"), *[F.count_if(F.col(f"top_{k}")).alias(f"_{k}") for k in ks])
    return out.select("n", F.try_divide("_exact", "n").alias("exact"), F.try_divide("_precision", "n").alias("precision"), *[F.try_divide(f"_{k}", "n").alias(f"top_{k}") for k in ks])


def _hit_ranks(predicted: Column, truth: Column) -> Column:
    """Ranks (from 1) of true items, in order."""
    return F.filter(F.transform(predicted, lambda x, i: F.when(F.array_contains(truth, x), i + 1)), lambda r: r.isNotNull())


def reciprocal_rank(predicted: Column, truth: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(1.0), F.get(_hit_ranks(predicted, truth), F.lit(0))), F.lit(0.0))


def average_precision(predicted: Column, truth: Column, by_truth: bool = False) -> Column:
    """Mean of the precision at each hit; ``by_truth`` divides by the number of true items and not of hits."""
    ranks = _hit_ranks(predicted, truth)
    total = F.aggregate(F.transform(ranks, lambda r, i: (i + 1) / r), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total, F.size(truth) if by_truth else F.size(ranks)), F.lit(0.0))


def recall_at(predicted: Column, truth: Column, k: int) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(F.slice(predicted, 1, k), truth)), F.size(truth)), F.lit(0.0))


def precision_at(predicted: Column, truth: Column, k: int) -> Column:
    """Hits among the first k, by k even where fewer are given."""
    return F.size(F.filter(F.slice(predicted, 1, k), lambda x: F.array_contains(truth, x))) / F.lit(k)


def dcg(gains: Column, skip_first: bool = False) -> Column:
    """Sum of gain / log2(rank + 1). ``skip_first`` leaves position 0 undiscounted out, as an older definition does."""
    terms = F.transform(gains, lambda g, i: F.when(i == 0, F.lit(0.0) if skip_first else g.cast("double")).otherwise(g / F.log2(i + (1 if skip_first else 2))))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def ndcg_at(predicted: Column, truth: Column, k: int) -> Column:
    """Standard binary NDCG of the first k."""
    gains = F.transform(F.slice(predicted, 1, k), lambda x: F.when(F.array_contains(truth, x), 1.0).otherwise(0.0))
    ideal = F.transform(F.slice(truth, 1, k), lambda _: F.lit(1.0))
    return F.coalesce(F.try_divide(dcg(gains), dcg(ideal)), F.lit(0.0))


def step_levels(failed_before: Column, failed_after: Column, known: Column) -> Column:
    """fixed, partial, none or no_data: how many of the steps that failed before do not fail after. A step not seen after is not fixed."""
    seen = F.array_intersect(failed_before, known)
    fixed = F.size(F.array_except(seen, failed_after))
    return F.when(F.coalesce(F.size(failed_before), F.lit(0)) == 0, "no_data").when(fixed == F.size(F.array_distinct(failed_before)), "fixed").when(fixed > 0, "partial").otherwise("none")


def level_rate(rows: DataFrame, level: str) -> DataFrame:
    """Counts of levels and (fixed + half of partial) / rows with data."""
    c = rows.agg(*[F.count_if(F.col(level) == x).alias(x) for x in ("fixed", "partial", "none", "no_data")])
    return c.withColumn("rate", F.try_divide(F.col("fixed") + 0.5 * F.col("partial"), F.col("fixed") + F.col("partial") + F.col("none")))


def effectiveness(first: DataFrame, second: DataFrame) -> DataFrame:
    """change, n, share between two runs with (id, rank): rank is the first hit, null without one. Joined by id."""
    both = first.withColumnRenamed("rank", "a").join(second.withColumnRenamed("rank", "b"), "id")
    none = F.lit(2**31 - 1)
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    out = both.groupBy(F.when(b < a, "improved").when(b > a, "worsened").otherwise("preserved").alias("change")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.try_divide("n", both.agg(F.count("*")).scalar()))
