"""Paired tests and multiple comparison."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contingency(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """both, only_a, only_b, neither of two booleans; null counts as false."""
    x, y = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return pairs.groupBy(*(by or [])).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def mcnemar(table: DataFrame) -> DataFrame:
    """chi2 with continuity correction and p (one degree of freedom); without discordant pairs 0 and 1."""
    b, c = F.col("only_a"), F.col("only_b")
    chi2 = F.coalesce(F.try_divide((F.abs(b - c) - 1) * (F.abs(b - c) - 1) * F.lit(1.0), b + c), F.lit(0.0))

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)))

    return table.withColumn("chi2", chi2).withColumn("p", F.when((b + c) > 0, tail("chi2")).otherwise(1.0))


def holm(tests: DataFrame, p: str, tie: str) -> DataFrame:
    """p_adjusted by Holm's step-down. ``tests`` has one row per comparison, so one partition is small by definition."""
    w = Window.orderBy(p, tie)
    n = tests.agg(F.count("*")).scalar()
    step = F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(w) + 1))
    return tests.withColumn("_s", step).withColumn("p_adjusted", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def all_pairs(results: DataFrame, system: str, key: str, ok: str) -> DataFrame:
    """system_a, system_b and their contingency over the keys both have.

    The systems of one key are paired inside its row (bounded by the number of systems), so no self-join
    is needed.
    """
    per = results.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col(system).alias("s"), F.col(ok).alias("ok")))).alias("r"))
    pairs = F.flatten(F.transform("r", lambda x, i: F.transform(F.slice("r", i + 2, F.size("r")), lambda y: F.struct(x["s"].alias("system_a"), y["s"].alias("system_b"), x["ok"].alias("a"), y["ok"].alias("b")))))
    return contingency(per.select(F.explode(pairs).alias("p")).select("p.*"), "a", "b", ["system_a", "system_b"])
