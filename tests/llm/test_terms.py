from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarryline.llm import terms

SCHEMA = "id string, failed_jobs array<struct<job_name:string, step_names:array<string>>>, term string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, jobs, "clash", 1) for i, jobs in rows], SCHEMA)


def test_counts_by_brute_force(spark):
    random.seed(2)
    names = ["Build", " build ", "b  c", "b\tc", "", "  ", None, "x"]
    rows = [(random.choice(["1", "2", "3", "4", None]), random.choice([None, [], [None], [(random.choice(names), random.choice([None, [], [random.choice(names) for _ in range(3)]])) for _ in range(2)]])) for _ in range(200)]
    occurrences, records = Counter(), defaultdict(set)
    for i, jobs in rows:
        for j in jobs or []:
            for field, raw in [("job_name", j[0]), *[("step_names", s) for s in (j[1] or [])]] if j else []:
                t = " ".join((raw or "").replace("\t", " ").split(" ")).strip()
                t = " ".join(t.split()).lower()
                if t:
                    occurrences[field, t] += 1
                    if i is not None:
                        records[field, t].add(i)
    for salts in (1, 7):
        got = {(r["field_name"], r["term"]): (r["occurrences"], r["records"]) for r in terms.job_and_step_terms(frame(spark, rows), salts).collect()}
        assert got == {k: (n, len(records[k])) for k, n in occurrences.items()}


def test_marks_and_ties(spark):
    rows = [(str(i), [("common", ["s"] if i < 3 else None)]) for i in range(30)] + [("0", [("once", None)]), ("0", [("once", None)])]
    got = {r["term"]: (r["mark"], r["occurrences"]) for r in terms.job_and_step_terms(frame(spark, rows)).collect()}
    assert got == {"common": ("common", 30), "s": (None, 3), "once": ("rare", 2)}


def test_empty_and_long(spark):
    assert terms.job_and_step_terms(frame(spark, [])).count() == 0
    long = "word " * 20_000
    got = terms.job_and_step_terms(frame(spark, [("1", [(long, None)])])).first()
    assert got["term"] == long.strip() and got["mark"] == "rare"


def test_a_row_of_many_terms(spark):
    steps = ["t0", "T1 ", None, ""] + [f"t{i % 7}" for i in range(20_000)]
    df = frame(spark, [("1", [("j", steps)]), ("2", [("j", ["t0", "t0"])])])
    got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.job_and_step_terms(df).filter("field_name = 'step_names'").collect()}
    assert got["t0"] == (1 + 2858 + 2, 2) and got["t1"] == (1 + 2857, 1)


def test_hot_term_is_salted(spark):
    df = frame(spark, [(str(i), [("hot", None)]) for i in range(200)])
    tokens = terms.term_counts(df, "id", {"job_name": F.transform("failed_jobs", lambda j: j["job_name"])}, salts=8)
    plan = tokens._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan and tokens.first()["records"] == 200
