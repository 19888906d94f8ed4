"""Label statistics, co-occurrence, rollups and usage.

All counts are combinable aggregates. Totals enter as scalar subqueries, never as joins. Ratios of
empty groups are null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.joins import first_per_key


def label_shares(labels: DataFrame, total: DataFrame) -> DataFrame:
    """label, n, share of (id, label) rows; ``total`` is one number, as a one-row frame."""
    return labels.groupBy("label").agg(F.count("*").alias("n")).withColumn("share", F.try_divide(F.col("n"), total.scalar()))


def set_sizes(labels: DataFrame) -> DataFrame:
    """labels_per_id, n: histogram of the number of labels."""
    return labels.groupBy("id").agg(F.count_distinct("label").alias("labels_per_id")).groupBy("labels_per_id").agg(F.count("*").alias("n"))


def set_size_summary(labels: DataFrame) -> DataFrame:
    """n_ids, single, multi, most, mean of the number of labels."""
    k = labels.groupBy("id").agg(F.count_distinct("label").alias("k"))
    out = k.agg(F.count("*").alias("n_ids"), F.count_if(F.col("k") == 1).alias("single"), F.count_if(F.col("k") > 1).alias("multi"), F.max("k").alias("most"), F.sum("k").alias("s"))
    return out.select("n_ids", "single", "multi", "most", F.try_divide("s", "n_ids").alias("mean"))


def co_occurrence(labels: DataFrame, mirror: bool = True) -> DataFrame:
    """label_a, label_b, n of ids that have both, the label with itself included.

    Pairs are made inside the row of an id from its sorted set of labels (bounded by the number of
    labels), so nothing is joined. ``mirror`` gives both orders.
    """
    sets = labels.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("ls"))
    size = F.size("ls")
    pairs = F.flatten(F.transform("ls", lambda x, i: F.transform(F.slice("ls", i + 1, size - i), lambda y: F.struct(x.alias("label_a"), y.alias("label_b")))))
    half = sets.select(F.explode(pairs).alias("p")).groupBy("p.label_a", "p.label_b").agg(F.count("*").alias("n"))
    if not mirror:
        return half
    both = F.when(F.col("label_a") == F.col("label_b"), F.array(F.struct("label_a", "label_b"))).otherwise(F.array(F.struct("label_a", "label_b"), F.struct(F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b"))))
    return half.select(F.explode(both).alias("p"), "n").select("p.*", "n")


def rates(rows: DataFrame, by: Sequence[str], ok: Column) -> DataFrame:
    """total, ok, failed, rate per group."""
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"))
    return out.withColumn("failed", F.col("total") - F.col("ok")).withColumn("rate", F.try_divide("ok", "total"))


def conclusion_pivot(rows: DataFrame, by: Sequence[str], value: str, known: Sequence[str], other: str = "unknown") -> DataFrame:
    """One count per known value, one for all others and null, and the total. A list of values is given, so no job finds them first."""
    v = F.col(value)
    return rows.groupBy(*by).agg(*[F.count_if(v == k).alias(k) for k in known], F.count_if(v.isNull() | ~v.isin(*known)).alias(other), F.count("*").alias("total"))


def top_label(rows: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """The most frequent label of each group; ties go to the label that sorts first."""
    counts = rows.groupBy(*by, label).agg(F.count("*").alias("n"))
    return first_per_key(counts, by, [F.desc("n"), F.col(label)])


def unique_executions(jobs: DataFrame, instance: str, name: str, order: Sequence[str]) -> DataFrame:
    """First execution of each job name per instance."""
    return first_per_key(jobs.filter(F.col(name).isNotNull()), [instance, name], [F.col(c) for c in order])


def three_way(rows: DataFrame, groups: Mapping[str, Column], value: Column, flag: Column) -> DataFrame:
    """Count, mean, largest and flagged rows of the first group whose condition holds."""
    g = F.when(F.lit(False), "")
    for name, cond in groups.items():
        g = g.when(cond, name)
    out = rows.withColumn("grp", g.otherwise("other")).groupBy("grp")
    return out.agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.max(value).alias("most"), F.count_if(flag).alias("flagged")).select("grp", "n", F.try_divide("s", "n").alias("mean"), "most", "flagged")


def words_in(text: Column) -> Column:
    """Number of blank-separated words, 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0))


def ordered_union(rows: DataFrame, by: Sequence[str], array: str, order: Sequence[str]) -> DataFrame:
    """Distinct elements of a group's arrays in order of first appearance."""
    items = rows.select(*by, *order, F.posexplode(array).alias("_p", "_x")).filter("_x is not null")
    first = items.groupBy(*by, "_x").agg(F.min(F.struct(*order, "_p")).alias("_at"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(array))


def delta_to(rows: DataFrame, key: str, baseline: str, value: str) -> DataFrame:
    """Difference and share of change to the baseline row. The baseline is one number."""
    one = rows.filter(F.col(key) == baseline).select(F.max(value)).scalar()
    return rows.select(key, value, (F.col(value) - one).alias("delta"), F.try_divide(F.col(value) - one, one).alias("change"))


def call_costs(calls: DataFrame, rates: DataFrame, model: str = "model") -> DataFrame:
    """``calls`` with ``cost``: tokens times the rates per million of their model.

    ``calls`` has input_tokens, cached_tokens, cache_write_tokens and output_tokens (null as 0; cached tokens are part of the input), ``rates`` one row per
    model with input_rate, output_rate and, where they are not those of the input, cached_rate and cache_write_rate. A model without rates costs 0.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in calls.columns else F.lit(0)
    rate = lambda c, other=None: F.coalesce(F.col(c), *([F.col(other)] if other else []), F.lit(0.0))
    fresh = F.greatest(n("input_tokens") - n("cached_tokens"), F.lit(0))
    cost = fresh * rate("input_rate") + n("cached_tokens") * rate("cached_rate", "input_rate") + n("cache_write_tokens") * rate("cache_write_rate", "input_rate") + n("output_tokens") * rate("output_rate")
    return calls.join(rates, model, "left").withColumn("cost", cost / 1_000_000).drop("input_rate", "cached_rate", "cache_write_rate", "output_rate")
