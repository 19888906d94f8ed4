from __future__ import annotations

import json

import pytest

from quarryline.operators import nested
from quarryline.operators.nested import flatten_commits

SCHEMA = (
    "record_id bigint, id string, commits array<struct<original_commit:string, commit_type:string, commit_date:string, workflow_run_id:bigint, workflow_conclusion:string, pending:boolean,"
    "failed_validation_jobs:array<struct<job_id:bigint, job_name:string, runner_name:string, failure_evidence:string, failed_validation_steps_count:int, failed_validation_step_names:array<string>>>>>,"
    "commits_json string, node string, commit_pos string"
)


def rows(spark, *records):
    return spark.createDataFrame([(i, str(i), c, j, "clash", "clash") for i, (c, j) in enumerate(records)], SCHEMA)


def commit(jobs):
    return ("sha", "fail", "2031-01-01T00:00:00Z", 1, "failure", None, jobs)


def job(steps):
    return (1, "build", None, None, 1, steps)


def keys(df):
    return sorted(map(tuple, flatten_commits(df).nodes().collect()))


def test_typed_positions_nulls_and_blanks(spark):
    df = rows(spark, ([None, commit([job(["a", None, " \t", "b"]), None, job(None), job([])])], None))
    assert keys(df) == sorted([(0, "commit", 1, -1, -1), (0, "job", 1, 0, -1), (0, "step", 1, 0, 0), (0, "step", 1, 0, 3), (0, "job", 1, 2, -1), (0, "job", 1, 3, -1)])


def test_legacy_shapes(spark):
    legacy = {"failed_jobs": {"job_id": "7", "step_names": ["x", {"name": "y", "number": 2}, {"number": 3}, {"name": " "}, None]}, "other": 1}
    df = rows(spark, (None, json.dumps(legacy)))
    t = flatten_commits(df)
    assert keys(df) == sorted([(0, "commit", 0, -1, -1), (0, "job", 0, 0, -1), (0, "step", 0, 0, 0), (0, "step", 0, 0, 1)])
    assert t.jobs().first()["job_id"] == 7
    assert [r["step_number"] for r in t.subtypes()["step_object"].collect()] == [2]
    assert t.records().first()["record_state"] == "json/bare"
    assert t.jobs().first()["variant"] == "step_names/list/mixed"


def test_bare_step_and_null_new_key(spark):
    df = rows(spark, (None, json.dumps([{"failed_validation_jobs": None, "failed_jobs": [{"failed_validation_step_names": "only"}]}])))
    assert keys(df) == sorted([(0, "commit", 0, -1, -1), (0, "job", 0, 0, -1), (0, "step", 0, 0, 0)])


def test_both_collectors_agree(spark):
    doc = [{"failed_validation_jobs": [{"job_name": "j", "failed_validation_step_names": ["s", ""]}]}]
    df = rows(spark, ([commit([job(["s", ""])])], None), (None, json.dumps(doc)))
    found = keys(df)
    assert [k[1:] for k in found if k[0] == 0] == [k[1:] for k in found if k[0] == 1]


def test_nothing_to_flatten(spark):
    df = rows(spark, (None, None), ([], None), (None, "not json"), (None, "null"), (None, "[]"), (None, "[null]"))
    assert keys(df) == []
    assert {r["record_state"] for r in flatten_commits(df).records().collect()} >= {"none/absent", "unparsable", "typed/list"}
    assert keys(df.limit(0)) == []


def test_no_shuffle(spark):
    plan = flatten_commits(rows(spark, (None, "[]"))).nodes()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


SHAPES = [
    {"failed_validation_jobs": [{"failed_validation_step_names": ["a", {"name": "b"}]}, {"step_names": "c"}, {"job_id": 1}]},
    {"failed_jobs": {"step_names": [{"name": "d"}, None, " "]}},
    {"original_commit": "x"},
]


def test_nodes_are_the_union_of_the_subtype_tables(spark):
    df = rows(spark, (None, json.dumps(SHAPES)), ([commit([job(["a", None])]), None], None))
    t = flatten_commits(df)
    tables = t.subtypes()
    assert len(tables) == 11 and "step_number" not in tables["step_text"].columns
    found = []
    for name, sub in tables.items():
        pos = [c for c in ("commit_pos", "job_pos", "step_pos") if c in sub.columns]
        found += [(r["record_id"], name.split("_")[0], *[r[p] for p in pos], *[-1] * (3 - len(pos))) for r in sub.collect()]
    assert sorted(found) == keys(df)
    assert {n for n, sub in tables.items() if not sub.isEmpty()} == set(tables) - {"step_other"}


@pytest.mark.parametrize(("moves", "gone", "lost"), [("STEP_MOVES", "object", 2), ("JOB_MOVES", ("step_names", "bare", "text"), 2), ("COMMIT_MOVES", ("none", "absent", "none"), 1), ("JOB_MOVES", ("none", "absent", "none"), 1)])
def test_a_removed_transition_takes_its_rows(spark, monkeypatch, moves, gone, lost):
    df = rows(spark, (None, json.dumps(SHAPES)))
    before = keys(df)
    monkeypatch.setattr(nested, moves, {k: v for k, v in getattr(nested, moves).items() if k != gone})
    after = keys(df)
    assert len(after) == len(before) - lost and set(after) < set(before)


def test_text_that_variant_refuses(spark):
    twice = '[{"original_commit":"x","original_commit":"y","failed_jobs":[{"job_id":1,"step_names":["a",{"name":"b","number":2},null," "]}]}, null, {"failed_validation_jobs":{"job_id":"7","step_names":"only"}}]'
    once = twice.replace('"original_commit":"x",', "")
    df = rows(spark, (None, twice), (None, once), (None, twice[1:-1].split(", null")[0]), (None, '{"a":1,"a"'))
    found = keys(df)
    assert [k[1:] for k in found if k[0] == 0] == [k[1:] for k in found if k[0] == 1] and len([k for k in found if k[0] == 2]) == 4
    t = flatten_commits(df)
    assert [r["original_commit"] for r in t.commits().filter("record_id = 0").collect()] == ["y", None]
    assert [r["record_state"] for r in t.records().orderBy("record_id").collect()] == ["json/list", "json/list", "json/bare", "unparsable"]
    assert [(r["record_id"], r["reason"]) for r in t.rejects().collect()] == [(3, "unparsable")]
    both = [sorted(map(str, t.jobs().filter(f"record_id = {i}").drop("record_id").collect())) for i in (0, 1)]
    assert both[0] == both[1]
