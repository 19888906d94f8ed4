from __future__ import annotations

import csv
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.operators.strict_load import FIELDS, PATTERN_CHARS, diagnose, split_csv, split_object, strict_load

GOOD = dict(id="1", repo_name="r", url="u", workflow="w", status="completed", conclusion="success", patch_applied=True, sha_original="a", commit="b")
SCHEMA = "line_id bigint, file_name string, line_no int, raw_line string, reason string"


def load(spark, lines):
    rows = [(i, f, i, t, "clash") for i, (f, t) in enumerate(lines)]
    out = strict_load(spark.createDataFrame(rows, SCHEMA))
    return {r["line_id"]: r for r in out.rows.collect()}, {r["line_id"]: r["reason"] for r in out.rejects.collect()}


def j(**change):
    return json.dumps({**GOOD, **change})


def test_reasons(spark):
    lines = [
        ("a.jsonl", j()), ("a.jsonl", j(status=" COMPLETED ")), ("a.jsonl", j(status=None, conclusion="")), ("a.jsonl", "{" + j()[1:] + " x"), ("a.jsonl", "[" + j() + "]"),
        ("a.jsonl", j(extra=1)), ("a.jsonl", j(status=True)), ("a.jsonl", j(status="done", conclusion="nope")), ("a.jsonl", j(conclusion=["failure"])), ("a.jsonl", j(id=float("nan"))),
        ("a.jsonl", " \t "), ("a.jsonl", ""), ("a.jsonl", None), ("a.jsonl", j(workflow={"deep": [1]})), ("a.jsonl", j().replace('"id"', '"id": "2", "id"')),
        ("b.csv", "1,r,u,w,completed,success,true,a,b"), ("b.csv", '1,r,u,"w, ""x""",completed,,,a,b'), ("b.csv", '1,r,u,w"x,completed,success,true,a,b'), ("b.csv", '1,r,u,"w,completed,success,true,a,b'),
        ("b.csv", "1,r,u,w,completed,success,true,a"), ("b.csv", "1,r,u,w,done,success,true,a,b"), ("b.csv", "1,r,u,w,queued,ok,true,a,b"), ("c.txt", "1,r,u,w,completed,success,true,a,b"),
        ("a.jsonl", j(workflow="x" * (PATTERN_CHARS + 10))), ("a.jsonl", j(workflow="x" * (PATTERN_CHARS + 10), status="?")),
    ]
    rows, bad = load(spark, lines)
    assert bad == {3: "broken_record", 4: "broken_record", 5: "field_count", 6: "bad_status", 7: "bad_status", 8: "bad_conclusion", 9: "broken_record", 14: "field_count", 17: "broken_record", 18: "broken_record", 19: "field_count", 20: "bad_status", 21: "bad_conclusion", 22: "broken_record", 24: "bad_status"}
    assert set(rows) == {0, 1, 2, 13, 15, 16, 23}
    assert rows[1]["status"] == "completed" and rows[2]["conclusion"] is None and rows[16]["workflow"] == 'w, "x"' and rows[0]["patch_applied"] is True


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a.jsonl", 1, j(), ""), (5, "a.jsonl", 2, j(), ""), (5, "a.jsonl", 3, "broken", "")], SCHEMA)
    out = strict_load(df)
    assert out.rows.count() == 2
    assert [r["reason"] for r in out.rejects.collect()] == ["broken_record"]


ODD = ["1e400", "12345678901234567890123", "1.50", "-0", "0.1e+05", '{"a": {"b": 1}}', '[ "\u00e9" , 1.0 ]', "true", "[]", "null", '"\\ud800x"', '"\\ud83d\\ude00"', '"a\\u0000b"', '"\u00e9\\n"', "7", '" 8 "']


def test_both_routes_give_the_same_values(spark):
    """Blanks after an object change nothing but take the line past the pattern's length."""
    lines = [j(workflow="@").replace('"@"', v) for v in ODD]
    fields = ["1", '"a ""b"""', " x ", '"in, side"', "completed", '""', "true", "\tx", "end"]
    csv_lines = [",".join(fields), ",".join(fields) + "\r", ",".join([*fields[:3], '"two\nlines"', *fields[4:]]), ",".join([*fields[:3], "two\rlines", *fields[4:]])]
    short, _ = load(spark, [("a.jsonl", x) for x in lines] + [("b.csv", x) for x in csv_lines])
    long_, _ = load(spark, [("a.jsonl", x + " " * PATTERN_CHARS) for x in lines] + [("b.csv", x.replace(",end", "," + "end" * PATTERN_CHARS)) for x in csv_lines])
    assert len(short) == len(ODD) + 4
    for i in short:
        assert [short[i][f] for f in (*FIELDS[:8], "line_no")] == [long_[i][f] for f in (*FIELDS[:8], "line_no")], i
    assert [short[i]["workflow"] for i in (0, 1, 2, 5, 6)] == ["1e400", "12345678901234567890123", "1.50", '{"a": {"b": 1}}', '[ "\u00e9" , 1.0 ]']
    assert short[10]["workflow"] == "?x" and short[11]["workflow"] == "\U0001f600" and short[len(ODD) + 2]["workflow"] == "two\nlines"


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_split_object_reads_what_json_reads(value):
    line = json.dumps({"k": value, "\u00e9 ": 1}, indent=1)
    (key, is_text, got), (other, _, one) = split_object(line)
    assert (key, other, one) == ("k", "\u00e9 ", "1")
    assert got == (None if value is None else value.encode("utf-8", "replace").decode()) if is_text else json.loads(got) == value
    assert split_object(line[:-1]) is None and split_object(line + "x") is None


def test_empty(spark):
    out = strict_load(spark.createDataFrame([], SCHEMA))
    assert out.rows.count() == 0 and out.rejects.count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab," x', max_size=6), min_size=1, max_size=5))
def test_csv_round_trip(values):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    assert split_csv(out.getvalue()) == values


@pytest.mark.parametrize("line", ['"a" b,c', 'a"b', '"a', '"a"b"', ' "a",b'])
def test_broken_quoting(line):
    assert split_csv(line) is None


def test_remainder_only_goes_to_python(spark):
    df = spark.createDataFrame([(1, "a.jsonl", 1, j(), "")], SCHEMA)
    plan = strict_load(df).rejects._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("LeftAnti")


def test_deep_nesting_is_broken_not_fatal():
    assert diagnose("jsonl", '{"id":' + "[" * 200_000)[0] == "broken_record"
    assert len(FIELDS) == 9
