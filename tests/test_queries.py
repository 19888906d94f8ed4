"""Every core query runs on the smallest tables, and equals its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from quarryline.operators import windows
from quarryline.plans import catalog

QUERIES = {n: q for m in catalog.modules() for n, q in m.QUERIES.items()}
SQL = {n: q for m in catalog.modules() for n, q in m.SQL.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = Counter(repr(tuple(norm(v) for v in r)) for r in df.collect())
    if name not in SQL:
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert rows == Counter(repr(tuple(norm(r[i]) for i in order)) for r in cur.fetchall())


def test_term_graph_is_over_all_documents(spark, sf_dir):
    from pyspark.sql import functions as F

    from quarryline.operators.text import terms

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.slice(F.array_distinct(terms(F.col("text"))), 1, 2).alias("t")).filter("size(t) = 2")
    assert docs.select("source").distinct().count() > 1
    assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in QUERIES["t11_term_graph"](spark, sf_dir).select("doc").distinct().collect()}


def test_recurrence_counts_every_instance(spark, sf_dir, duck):
    n = duck.execute("SELECT count(DISTINCT instance_id) FROM (SELECT instance_id, unnest(relevant_files) AS r FROM log_analysis) WHERE r.file IS NOT NULL").fetchone()[0]
    whole = QUERIES["t19_recurrence"](spark, sf_dir).first()
    assert whole["n_ids"] == n and whole["mean_best"] is not None
    near = {r["id_a"] for r in QUERIES["t17_jaccard_pairs"](spark, sf_dir).collect()}
    assert len(near) < n and any(r["best"] < 0.2 for r in QUERIES["j14_historical_recurrence"](spark, sf_dir).collect())


def test_natural_order_sorts_every_id(spark, sf_dir, duck):
    ids = [r[0] for r in QUERIES["o06_natural_order"](spark, sf_dir).collect()]
    rows = [r[0] for r in duck.execute(SQL["o06_natural_order"]).fetchall()]
    assert len(ids) == duck.execute("SELECT count(*) FROM (SELECT DISTINCT id FROM all_instances_metadata)").fetchone()[0]
    # Nulls may stand at either end.
    assert [i for i in ids if i is not None] == [i for i in rows if i is not None]
    more = spark.createDataFrame([(str(i),) for i in range(120)], "id string").orderBy(*windows.natural_order("id"))
    assert [r[0] for r in more.collect()] == [str(i) for i in range(120)]


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
