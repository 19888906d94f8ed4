"""Searches score documents against queries without ever making rows of their pairs."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarryline.plans import text as plans

SEARCHES = ("t02_bm25", "t02_bm25_best_scores", "t03_external_idf", "t04_filtered_search", "t05_boosted_fields", "t06_rescored", "t07_fused", "t32_reranked")
N = 700


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Documents that are all queries; each pair shares a word, many texts are equal."""
    folder, rng = tmp_path_factory.mktemp("search"), random.Random(5)
    words = [a + b for a in ("ram", "lum", "tor", "bes", "cor") for b in ("il", "an", "est", "om", "ux")]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, repo VARCHAR)")
    rows = [(100 * i, f"anchor {rng.choice(words)} {rng.choice(words)}\n{' '.join(rng.choices(words, k=rng.choice((0, 1, 2, 40))))}", "en", "one/repo") for i in range(N)]
    rows += [(100 * N, None, "en", "one/repo"), (100 * N + 100, "of 12", "en", "one/repo"), (100 * N + 200, f"anchor {words[0]}", None, "one/repo")]
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    c.execute("CREATE TABLE eval_items AS SELECT i AS item_id, 'anchor ' || CASE WHEN i % 2 = 0 THEN 'ramil' ELSE 'luman toran' END AS text FROM range(20) t(i)")
    for t in ("documents", "eval_items"):
        c.execute(f"COPY {t} TO '{folder}/{t}.parquet'")
    return str(folder), c


def shuffled(plan) -> int:
    """Records that the exchanges of an executed plan have written."""
    name, n = plan.getClass().getSimpleName(), 0
    if name == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    if name == "ShuffleExchangeExec":
        n = plan.metrics().apply("shuffleRecordsWritten").value()
    children = plan.children()
    return n + sum(shuffled(children.apply(i)) for i in range(children.size()))


@pytest.mark.parametrize("name", SEARCHES)
def test_pairs_are_not_shuffled(spark, tables, name):
    folder, duck = tables
    df = plans.QUERIES[name](spark, folder)
    rows = df.collect()
    assert shuffled(df._jdf.queryExecution().executedPlan()) < N * N / 3
    cur = duck.execute(plans.SQL[name])
    names = [d[0] for d in cur.description]
    whole = sorted(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
    rows = sorted(tuple(r) for r in rows)
    assert len(rows) == len(whole) > N / 2
    for r, w in zip(rows, whole, strict=True):
        assert r == pytest.approx(w, abs=2e-9)


def test_rows_of_one_document_are_one(spark):
    from pyspark.sql import functions as F

    from quarryline.operators import text

    queries = spark.createDataFrame([(0, "a"), (0, "b")], "query int, term string")
    parted = spark.createDataFrame([(1, ["a", "c"]), (1, ["b"]), (2, ["a"]), (3, ["c"])], "d int, t array<string>")
    got = text.searches(text.tokenised(parted, "d", F.col("t")), queries).collect()
    post = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 1, 2), (1, "c", 1, 2), (2, "a", 1, 1), (3, "c", 1, 1)], "doc int, term string, tf int, doc_len int")
    assert [r["doc"] for r in got] == [1, 2]
    assert [(r["doc"], r["score_0"]) for r in got] == [(r["doc"], r["score"]) for r in text.bm25(post, queries).collect()]


@pytest.mark.parametrize(("k", "least", "rare"), [(3, 1, False), (50, 1, True), (3, 2, True), (200, 2, False)])
def test_cells_equal_brute_force(monkeypatch, k, least, rare):
    from quarryline.operators import scoring

    if rare:  # no term has a row over all documents
        monkeypatch.setattr(scoring, "COMMON", 1.0)
    rng, words, n = random.Random(k), [f"w{i}" for i in range(30)], 1500
    docs = [(i, rng.choices(words, k=rng.randint(1, 9)), rng.choice(("x", "y", None))) for i in rng.sample(range(9 * n), n)]
    asked = [(q, rng.sample([*words, "unseen"], 6), [rng.choice((1.0, 0.3, 2.5)) for _ in range(6)], rng.choice(("x", "y", "z"))) for q in range(20)]
    ways, mean = [(1.5, 0.75), (1.2, 0.2)], 5.0
    doc_table = pa.table({"doc": [d[0] for d in docs], "doc_len": [len(d[1]) for d in docs], "terms": [d[1] for d in docs], "key": [d[2] for d in docs]})
    ask_table = pa.table({"query": [a[0] for a in asked], "terms": [a[1] for a in asked], "weights": [a[2] for a in asked], "key": [a[3] for a in asked], "mean": [mean] * len(asked)})
    got = scoring.cell_search(ways, 2, k, least)(doc_table, ask_table).to_pylist()
    for way, (k1, b) in enumerate(ways):
        for q, terms, weights, key in asked:
            scored = []
            for d, held, at in docs:
                if at == key and len(set(held) & set(terms)) >= least:
                    s = sum(w * held.count(t) * (k1 + 1) / (held.count(t) + k1 * (1 - b + b * len(held) / mean)) for t, w in zip(terms, weights, strict=True) if t in held)
                    scored.append((-round(s, 9), d))
            mine = [(-r[f"score_{way}"], r["doc"]) for r in got if r["way"] == way and r["query"] == q]
            assert [d for _, d in mine] == [d for _, d in sorted(scored)[:k]]
            assert np.allclose([s for s, _ in mine], [s for s, _ in sorted(scored)[:k]], atol=2e-9)


def written(plan) -> int:
    """Bytes of the rows that the exchanges of an executed plan have written, before they are compressed."""
    name, n = plan.getClass().getSimpleName(), 0
    if name == "AdaptiveSparkPlanExec":
        return written(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return written(plan.plan())
    if name == "ShuffleExchangeExec":
        n = plan.metrics().apply("dataSize").value()
    children = plan.children()
    return n + sum(written(children.apply(i)) for i in range(children.size()))


def test_dealt_terms_take_little_more_than_their_letters(spark):
    from pyspark.sql import functions as F

    from quarryline.operators import text

    docs = spark.range(200).select("id", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.format_string("w%05d", (F.col("id") * 300 + i).cast("int"))).alias("t"))
    dealt = text.tokenised(docs, "id", F.col("t")).docs.select("doc", "terms")
    assert sum(len(r["terms"]) for r in dealt.collect()) == 60_000
    assert written(dealt._jdf.queryExecution().executedPlan()) < 60_000 * 10


def test_dealt_terms_come_back_as_they_were(spark):
    from pyspark.sql import functions as F

    from quarryline.operators import text

    odd = {1: ['"', "\\", "", "[a, b]", "é\n \0", "😀", None, "a", "a"], 2: ["null", "x" * 3000], 3: [], 4: [None]}
    got = text.tokenised(spark.createDataFrame(list(odd.items()), "d int, t array<string>"), "d", F.col("t")).docs.collect()
    assert {r["doc"]: r["terms"] for r in got} == {d: t for d, t in odd.items() if t}
    assert all(r["doc_len"] == len(odd[r["doc"]]) for r in got)


@pytest.mark.parametrize("k", [20, 50])
def test_pairs_carry_the_score_of_their_way_alone(spark, k):
    """t06_rescored and t07_fused shuffle one score a pair."""
    from pyspark.sql import functions as F

    from quarryline.operators import text

    docs = spark.range(400).select("id", F.array(F.lit("a"), F.format_string("b%d", F.col("id") % 3), *[F.lit("c")] * 4).alias("t"), (F.col("id") % 7).cast("int").alias("n"))
    held = text.tokenised(docs.select("id", F.concat("t", F.array_repeat(F.lit("d"), F.col("n"))).alias("t")), "id", F.col("t"))
    queries = spark.range(30).select(F.col("id").alias("query"), F.explode(F.array(F.lit("a"), F.format_string("b%d", F.col("id") % 3))).alias("term"))
    found = text.searches(held, queries, ways=[(1.5, 0.75), (1.5, 0.2)], ranked=2, k=k)
    rows = found.collect()
    assert len(rows) == 2 * 30 * k
    assert all(r[f"score_{r['way']}"] > 0 and r[f"score_{1 - r['way']}"] is None for r in rows)
    assert 32 <= largest_rows(found._jdf.queryExecution().executedPlan(), 2 * 30 * k) <= 40  # way, query, doc, score and the bits of nulls


def largest_rows(plan, n) -> float:
    """Bytes a row of the last exchange of an executed plan that wrote at least n rows."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return largest_rows(plan.executedPlan(), n)
    if name.endswith("QueryStageExec"):
        return largest_rows(plan.plan(), n)
    if name == "ShuffleExchangeExec" and (m := plan.metrics()).apply("shuffleRecordsWritten").value() >= n:
        return m.apply("dataSize").value() / m.apply("shuffleRecordsWritten").value()
    children = plan.children()
    return max((largest_rows(children.apply(i), n) for i in range(children.size())), default=0)


def test_fused_queries_that_ask_the_same_are_searched_once(spark, tmp_path):
    """2,000 of the 3,000 documents are queries that ask one of three things, twice the same word in one of them."""
    duck, n = duckdb.connect(), 2000
    heads = "['anchor ramil', 'ramil anchor', 'anchor luman', 'anchor anchor luman']"
    duck.execute(f"CREATE TABLE documents AS SELECT CASE WHEN i < {n} THEN 100 * i ELSE i + 1 END AS doc_id, CASE WHEN i < {n} THEN {heads}[1 + i % 4] || ' of 12' ELSE 'anchor of luman' END || chr(10) || repeat('toran ', CAST(i * 7 % 11 AS INTEGER)) AS text FROM range(3000) t(i) WHERE i < {n} OR (i + 1) % 100 <> 0")
    duck.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    df = plans.QUERIES["t07_fused"](spark, str(tmp_path))
    rows = sorted(tuple(r) for r in df.collect())
    cur = duck.execute(plans.SQL["t07_fused"])
    names = [d[0] for d in cur.description]
    whole = sorted(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
    assert len(rows) == len(whole) >= 20 * n
    for r, w in zip(rows, whole, strict=True):
        assert r == pytest.approx(w, abs=2e-9)
    assert shuffled(df._jdf.queryExecution().executedPlan()) < len(whole)
