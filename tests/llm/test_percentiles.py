from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quarryline.llm import percentiles as op

SCHEMA = "call_id bigint, model string, called_at timestamp_ntz, duration_seconds double, total_tokens bigint, total_cost double, day string"
T = dt.datetime(2031, 1, 1)


def test_rank_errors_against_exact(spark):
    random.seed(4)
    rows = [(i, random.choice(["A", " a ", "b"]), T + dt.timedelta(days=random.choice([0, 0, 0, 1])), math.exp(random.gauss(0, 2)), int(random.expovariate(0.001)), random.random(), "x") for i in range(60_000)]
    df = spark.createDataFrame(rows + rows[:5000], SCHEMA).repartition(7)
    once = op.calls_once(df)
    exact = defaultdict(list)
    for _, m, at, d, t, c, _ in rows:
        for measure, v in zip(op.MEASURES, (d, float(t), c), strict=True):
            exact[m.strip().lower(), at.date(), measure].append(v)
            exact[m.strip().lower(), None, measure].append(v)
    got = op.percentiles(op.with_totals(op.daily_sketches(once)), "model", "span", "day").collect()
    assert len(got) == len(exact)
    for r in got:
        v = sorted(exact[r["model"], r["day"], r["measure"]])
        assert r["n"] == len(v)
        for name, q in op.QUANTILES.items():
            low, high = sum(x < r[name] for x in v) / len(v), sum(x <= r[name] for x in v) / len(v)
            assert low - 0.01 <= q <= high + 0.01


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([(i, "m", T, float(i), i, 0.0, "x") for i in range(1, 101)], SCHEMA)
    r = op.percentiles(op.daily_sketches(op.calls_once(df)), "model", "day").filter("measure = 'duration_seconds'").first()
    assert abs(r["p50"] - 50) <= 1 and abs(r["p99"] - 99) <= 1


def test_what_counts(spark):
    rows = [
        (1, "m", T, 1.0, 1, 1.0, "x"), (1, "m", T, 1.0, 1, 1.0, "x"), (2, None, T, 2.0, None, -1.0, "x"), (3, "  ", T, float("nan"), 3, 0.0, "x"), (4, "M ", None, -5.0, 0, None, "x"),
        (None, "m", T, 7.0, 7, 7.0, "x"), (None, "m", T, 7.0, 7, 7.0, "x"), (None, "m", T, 8.0, 7, 7.0, "x"),
    ]
    got = {(r["model"], r["day"], r["measure"]): r["n"] for r in op.percentiles(op.daily_sketches(op.calls_once(spark.createDataFrame(rows, SCHEMA))), "model", "day").collect()}
    d = T.date()
    assert got["m", d, "duration_seconds"] == 3 and got["m", None, "duration_seconds"] == 0 and got["m", None, "total_tokens"] == 1
    assert got[None, d, "duration_seconds"] == 1 and got[None, d, "total_tokens"] == 1 and got[None, d, "total_cost"] == 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op.percentiles(op.with_totals(op.daily_sketches(op.calls_once(df))), "model", "span", "day").count() == 0


def test_merge_order_does_not_matter_for_counts(spark):
    df = spark.createDataFrame([(i, "m", T + dt.timedelta(days=i % 5), float(i), i, 0.0, "x") for i in range(5000)], SCHEMA)
    daily = op.daily_sketches(op.calls_once(df))
    a = op.merge_sketches(daily, "model").select(F.kll_sketch_get_n_double("total_tokens")).first()[0]
    assert a == 5000


def test_calls_with_differing_rows_are_the_same_in_every_run(spark):
    rows = [(i, m, T, d, 1, 1.0, "x") for i in range(50) for m, d in (("b", 1.0), ("a", 9.0), ("a", 3.0))]
    for n in (1, 3, 8):
        once = op.calls_once(spark.createDataFrame(rows[::-1] if n == 3 else rows, SCHEMA).repartition(n)).collect()
        assert len(once) == 50 and {(r["model"], r["duration_seconds"]) for r in once} == {("a", 3.0)}


def test_within_bound_says_so(spark):
    once = op.calls_once(spark.createDataFrame([(i, "m", T, float(i), i, 0.5, "x") for i in range(20_000)], SCHEMA))
    assert {r["within_bound"] for r in op.within_bound(once).collect()} == {True}
    assert False in {r["within_bound"] for r in op.within_bound(once, 1000, 0.000001).collect()}
