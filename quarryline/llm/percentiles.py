"""Percentiles with a bounded rank error from mergeable randomized compactor hierarchies (KLL).

A sketch keeps levels of compactors; a full level is sorted and every other value moves up with
twice the weight, with a random offset. Sketches merge level by level, so sketches of partitions,
days or models combine without the values. Spark's own KLL aggregates do this in the JVM.

``K`` sets the size: the normalised rank error of a KLL sketch is about 2.3 / k**0.97 with 99 %
confidence, 0.0028 for k = 1000. The bound asked for is 0.01, about nine standard deviations off.
A sketch holds at most about 3 k values (24 kB), whatever it has seen: a hot model or day costs one
bounded sketch per partition in the shuffle, so no group is ever gathered in one task.

Defined cases: null, NaN and negative values do not count; a call_id counts once (of rows that differ the
least by model, day and measures; rows with a null call_id are one if they are equal in all used columns); a null or
blank model is the group null; a null called_at counts in the model's total and in a day null;
measures without any value have n = 0 and null percentiles; infinite values are ordinary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 1000
QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
MEASURES = ("duration_seconds", "total_tokens", "total_cost")


def usable(value: Column) -> Column:
    """The value as double, null where it is null, NaN or negative."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (v >= 0), v)


def calls_once(calls: DataFrame) -> DataFrame:
    """call model, day and usable measures, each call_id once."""
    model = F.lower(F.trim("model"))
    rows = calls.select(
        "call_id", F.when(model != "", model).alias("model"), F.to_date("called_at").alias("day"), *[usable(F.col(m)).alias(m) for m in MEASURES]
    )
    # The least row of a call, so that the choice is the same in every run; partial minima combine before the shuffle.
    unnamed = F.when(F.col("call_id").isNull(), F.xxhash64("model", "day", *MEASURES))
    least = rows.groupBy("call_id", unnamed.alias("unnamed")).agg(F.min(F.struct("model", "day", *MEASURES)).alias("r"))
    return least.select("r.*")


def daily_sketches(once: DataFrame, k: int = K) -> DataFrame:
    """One sketch per model, day and measure: what a day's job keeps."""
    return once.groupBy("model", "day").agg(*[F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in MEASURES])


def merge_sketches(sketches: DataFrame, *by: str, k: int = K) -> DataFrame:
    """Sketches of coarser groups from finer ones."""
    return sketches.groupBy(*by).agg(*[F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in MEASURES])


def with_totals(sketches: DataFrame, k: int = K) -> DataFrame:
    """The daily sketches and, by merging them, one per model over all days; ``span`` is day or all."""
    spans = F.explode(F.array(F.struct(F.lit("day").alias("span"), F.col("day")), F.struct(F.lit("all").alias("span"), F.lit(None).cast("date").alias("day"))))
    both = sketches.withColumnRenamed("day", "of_day").withColumn("day", F.col("of_day")).select("model", spans.alias("s"), *MEASURES).select("model", "s.span", "s.day", *MEASURES)
    return merge_sketches(both, "model", "span", "day", k=k)


def percentiles(sketches: DataFrame, *by: str) -> DataFrame:
    """Long form: the group, measure, n and one column per percentile."""

    def of(m: str) -> Column:
        n = F.kll_sketch_get_n_double(m)
        # A percentile of an empty sketch is an error, so it is not asked for.
        cut = [F.when(n > 0, F.kll_sketch_get_quantile_double(m, F.lit(q))).alias(p) for p, q in QUANTILES.items()]
        return F.struct(F.lit(m).alias("measure"), n.alias("n"), *cut)

    return sketches.select(*by, F.explode(F.array(*[of(m) for m in MEASURES])).alias("x")).select(*by, "x.*")


def within_bound(once: DataFrame, k: int = K, bound: float = 0.01) -> DataFrame:
    """model, day, measure, n, within_bound: whether each percentile of a daily sketch is within the rank error, against the exact ranks.

    A percentile q of n values is within it if q lies between the share of values below it and the share up to it, ``bound`` more or less."""
    group = ["model", "day", "measure"]
    asked = percentiles(daily_sketches(once, k), "model", "day")
    values = once.select("model", "day", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x")).select("model", "day", "x.*").filter("v is not null")

    def same(x: str, y: str) -> Column:
        out = F.col(f"{x}.measure") == F.col(f"{y}.measure")
        for g in group[:2]:
            out = out & F.col(f"{x}.{g}").eqNullSafe(F.col(f"{y}.{g}"))
        return out

    ranks = []
    for p in QUANTILES:
        ranks += [F.count_if(F.col("v") < F.col(p)).alias(f"below_{p}"), F.count_if(F.col("v") <= F.col(p)).alias(f"upto_{p}")]
    # The values are the side that Spark may split where a model or a day is hot; groups without values come back from the sketches.
    counted = values.alias("b").join(asked.alias("a"), same("a", "b")).groupBy(*[F.col(f"a.{g}").alias(g) for g in group]).agg(*ranks)
    inside = F.lit(True)
    for p, q in QUANTILES.items():
        inside = inside & (F.coalesce(f"below_{p}", F.lit(0)) <= (q + bound) * F.col("n")) & (F.coalesce(f"upto_{p}", F.lit(0)) >= (q - bound) * F.col("n"))
    both = asked.alias("a").join(counted.alias("c"), same("a", "c"), "left")
    return both.select(*[F.col(f"a.{g}").alias(g) for g in group], "n", inside.alias("within_bound"))
