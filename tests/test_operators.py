"""Golden values by hand, and properties."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quarryline.operators import aggregates, chunking, diffs, filters, graph, joins, labels, metrics, sets, stats, text, windows

RANKED = [("1", ["2", "1", "6", "3", "4"], ["1", "3", "5"]), ("2", ["1", "2", "3", "4", "5"], ["4"]), ("3", ["1", "3", "2", "4", "5"], ["2", "3", "5"]), ("4", ["2", "1", "4", "5", "3"], ["1", "4", "5"]), ("5", ["3", "1", "2", "4", "5"], ["1", "2", "3", "4", "5"])]


@pytest.fixture(scope="module")
def ranked(spark):
    return spark.createDataFrame(RANKED, "id string, predicted array<string>, truth array<string>")


def test_ranked_metrics(ranked):
    p, t = F.col("predicted"), F.col("truth")
    got = {r["id"]: r for r in ranked.select("id", metrics.reciprocal_rank(p, t).alias("rr"), metrics.average_precision(p, t).alias("ap"), metrics.recall_at(p, t, 5).alias("r"), metrics.hits_at(p, t, 5).alias("h"), metrics.precision_at(p, t, 5).alias("p")).collect()}
    assert [got[k]["rr"] for k in "12345"] == [0.5, 0.25, 0.5, 0.5, 1.0]
    assert [round(got[k]["ap"], 6) for k in "12345"] == [0.5, 0.25, 0.588889, 0.638889, 1.0]
    assert [round(got[k]["r"], 6) for k in "12345"] == [0.666667, 1, 1, 1, 1] and all(got[k]["h"] for k in "12345")
    assert [got[k]["p"] for k in "12345"] == [0.4, 0.2, 0.6, 0.6, 1.0]


def test_ndcg_and_empty_lists(spark):
    df = spark.createDataFrame([("a", ["x", "y"], ["x", "y"]), ("b", [], ["x"]), ("c", ["z", "x"], ["x"])], "id string, predicted array<string>, truth array<string>")
    got = {r["id"]: r["n"] for r in df.select("id", metrics.ndcg_at(F.col("predicted"), F.col("truth"), 5).alias("n")).collect()}
    assert got["a"] == pytest.approx(1) and got["b"] == 0 and got["c"] == pytest.approx(1 / math.log2(3))


@pytest.mark.parametrize(("denominator", "n"), [("predicted", 2), ("pushed", 2), ("both", 1), ("truth", 3)])
def test_denominators(spark, denominator, n):
    truth = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", ["z"]), ("d", [])], "id string, truth array<string>")
    predicted = spark.createDataFrame([("a", ["x", "x"]), ("b", []), ("e", ["q"])], "id string, predicted array<string>")
    pushed = spark.createDataFrame([("a",), ("c",)], "id string")
    rows = metrics.scored_rows(truth, predicted, pushed, denominator)
    out = metrics.summary(metrics.per_row(rows, [1, 3]), [1, 3]).first()
    assert out["n"] == n and out["top_1"] == pytest.approx(1 / n) and out["top_1"] <= out["top_3"]


def test_mcnemar_and_holm(spark):
    t = spark.createDataFrame([("a", 0, 10, 2, 0), ("b", 0, 0, 0, 5), ("c", 0, 4, 4, 0)], "pair string, both bigint, only_a bigint, only_b bigint, neither bigint")
    got = {r["pair"]: r for r in stats.holm(stats.mcnemar(t), "p", "pair").collect()}
    assert got["a"]["chi2"] == pytest.approx(49 / 12) and got["a"]["p"] == pytest.approx(math.erfc(math.sqrt(49 / 24)))
    assert got["b"]["p"] == 1 and got["c"]["chi2"] == pytest.approx(1 / 8)
    assert all(r["p_adjusted"] >= r["p"] and r["p_adjusted"] <= 1 for r in got.values())


DIFF = """diff --git a/dev/pyproject.toml b/dev/pyproject.toml
--- a/dev/pyproject.toml
+++ b/dev/pyproject.toml
@@ -3,3 +3,3 @@
 keep
-old = 1
+new = 2
 keep
diff --git a/src/x y_test.py b/src/x y_test.py
@@ -1,1 +1,2 @@
 import os
+import sys
"""


def test_diff_parse():
    got = diffs.parse(DIFF)
    assert [(c["path"], c["line"], c["old_line"], c["change_type"]) for c in got] == [("dev/pyproject.toml", 4, 4, "modified"), ("src/x y_test.py", 2, 2, "added")]
    assert diffs.parse(None) == [] and diffs.parse("") == []
    run = "diff --git a/f b/f\n@@ -1,3 +1,3 @@\n-a\n+b\n+c\n"
    assert [c["line"] for c in diffs.parse(run)] == [1, 2] and [c["line"] for c in diffs.parse(run, compat=True)] == [1, 1]


def test_diff_apply():
    section = "diff --git a/f b/f\n@@ -2,2 +2,3 @@\n b\n-c\n+C\n+D"
    assert diffs.apply_section("a\nb\nc\nd", section) == "a\nb\nC\nD\nd"


def test_diff_columns(spark):
    df = spark.createDataFrame([(DIFF,), ("",), (None,)], "d string")
    got = df.select(diffs.changed_paths(F.col("d")).alias("p"), F.size(diffs.sections(F.col("d"))).alias("n"), diffs.line_counts(F.col("d")).alias("c"), diffs.added_imports(F.col("d")).alias("i")).collect()
    assert got[0]["p"] == ["dev/pyproject.toml", "src/x y_test.py"] and got[0]["n"] == 2 and tuple(got[0]["c"]) == (2, 1, 2) and got[0]["i"] == ["sys"]
    assert got[1]["p"] == [] and got[2]["p"] is None


def test_chunks_cover_and_fit():
    t = "\n".join("x" * (i % 37) for i in range(200)) + "\n" + "y" * 500
    size = lambda s: -(-len(s) // 4)
    got = chunking.fill_lines(t, 30, 6, size)
    assert all(sum(size(x) for x in c["text"].split("\n")) <= 30 for c in got)
    assert got[0]["first"] == 1 and all(b["first"] <= a["last"] + 1 for a, b in zip(got, got[1:], strict=False))
    assert chunking.next_fit([5, 9, 3, 12], 10) == [2, 1, 2, 0]


def test_components_match_union_find(spark):
    import random

    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_pagerank_against_power_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("d", "a", 1.0)]
    nodes, out = "abcd", {}
    for s, _, w in edges:
        out[s] = out.get(s, 0) + w
    rank = dict.fromkeys(nodes, 0.25)
    for _ in range(10):
        lost = sum(rank[n] for n in nodes if n not in out)
        rank = {n: 0.15 / 4 + 0.85 * (sum(rank[s] * w / out[s] for s, d, w in edges if d == n) + lost / 4) for n in nodes}
    got = {r["node"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src string, dst string, w double"), rounds=10).collect()}
    assert got == pytest.approx(rank) and sum(got.values()) == pytest.approx(1)


def test_co_occurrence_is_symmetric(spark):
    lab = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "b"), ("2", "b"), ("3", "c")], "id string, label string")
    got = {(r[0], r[1]): r[2] for r in aggregates.co_occurrence(lab).collect()}
    assert got == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 1, ("b", "b"): 2, ("c", "c"): 1}


def test_split_is_a_partition(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 1), ("b", 2), ("c", 10)) for i in range(n)], "k string, t int")
    got = windows.chronological_split(rows, ["k"], ["t"], 0.7).groupBy("k", "split").count().collect()
    assert {(r["k"], r["split"]): r["count"] for r in got} == {("a", "eval"): 1, ("b", "memory"): 1, ("b", "eval"): 1, ("c", "memory"): 7, ("c", "eval"): 3}


def test_global_rank(spark):
    got = windows.global_rank(spark.range(1000).select((999 - F.col("id")).alias("x")), ["x"]).collect()
    assert all(r["x"] + 1 == r["rank"] for r in got)


def test_overlap_join_equals_theta_join(spark):
    import random

    random.seed(5)
    a = [("s", i, s, s + random.randrange(40)) for i, s in enumerate(random.sample(range(300), 40))]
    b = [("s", i, s, s + random.randrange(90)) for i, s in enumerate(random.sample(range(300), 40))]
    got = joins.overlapping(spark.createDataFrame(a, "scope string, i int, a_start int, a_end int"), spark.createDataFrame(b, "scope string, j int, b_start int, b_end int"), ["scope"], 16)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((x[1], y[1]) for x in a for y in b if x[2] <= y[3] and x[3] >= y[2])


def test_jaccard_pairs_equal_brute_force(spark):
    import random

    random.seed(9)
    rows = [(i, random.sample("abcdefghijkl", random.randint(1, 6))) for i in range(60)] + [(99, []), (98, None)]
    got = {(r["id_a"], r["id_b"]): r["jaccard"] for r in text.jaccard_pairs(spark.createDataFrame(rows, "id int, s array<string>"), [], "id", "s", 0.5).collect()}
    brute = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in rows for b, y in rows if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5}
    assert got == pytest.approx(brute) and brute


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, ["c", "c"])], "d int, t array<string>")
    post = text.postings(docs, "d", F.col("t"))
    got = text.bm25(post, spark.createDataFrame([(0, "a"), (0, "zz")], "query int, term string")).collect()
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert [r["doc"] for r in got] == [1] and got[0]["score"] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)))


def test_labels(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"])], "o array<string>, n array<string>")
    got = df.select(*[labels.updated_labels(F.col("o"), F.col("n"), F.lit(m)).alias(m) for m in ("replace", "add", "remove", "other")]).first()
    assert list(got) == [["b", "c"], ["a", "b", "c"], ["a"], ["a", "b"]]
    cells = spark.createDataFrame([("['x', 'y']",), ('["x"]',), ("x",), (None,), ("nan",), ("[broken",)], "c string")
    assert [r[0] for r in cells.select(labels.label_cell(F.col("c"))).collect()] == [["x", "y"], ["x"], ["x"], [], [], ["[broken"]]


def test_aligned_labels(spark):
    df = spark.createDataFrame([(["tests", "x", "Test Failure", " ", "x"], ["a", None, "c"])], "l array<string>, s array<string>")
    got = df.select(labels.aligned_distinct(F.col("l"), F.col("s"), {"Test Failure": ["tests"]}).alias("z")).first()["z"]
    assert [tuple(z) for z in got] == [("Test Failure", "a"), ("x", "")]


def test_violations_raise(spark):
    rows = spark.createDataFrame([("1", ["a"], ["x"]), ("1", ["q"], [])], "id string, l array<string>, s array<string>")
    found = labels.violations(rows, "id", "l", "s", ["a"], spark.createDataFrame([("1",), ("2",)], "id string"))
    assert {r["rule"] for r in found.collect()} == {"repeated", "missing", "length", "unknown_label"}
    with pytest.raises(ValueError, match="repeated"):
        labels.raise_on(found)


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "id string, label string")
    assert aggregates.co_occurrence(empty).count() == 0
    assert aggregates.set_size_summary(empty).first()["mean"] is None
    assert graph.components(spark.createDataFrame([], "src string, dst string")).count() == 0
    assert sets.overlap_rate(empty, empty, "id").first()["rate"] is None


def test_filters(spark):
    df = spark.createDataFrame([("Own/Lib",), ("x/y",), (None,)], "r string")
    assert [r[0] for r in df.select(filters.matches_repo(F.col("r"), ["lib"])).collect()] == [True, False, None]
    got = filters.band_counts(spark.range(10), F.col("id"), [0, 3, 20, 30]).collect()
    assert [r["n"] for r in got] == [3, 7, 0]


def _git_section(path, *lines):
    return "\n".join([f"diff --git a/{path} b/{path}", "@@ -1 +1 @@", *lines]) + "\n"


def test_imports_match_modules_of_the_same_diff(spark):
    from quarryline.operators import diffs

    rows = [
        (1, 0, "src/pkg/mod.py", _git_section("src/pkg/mod.py", "+import os, other as o, _private", " import util")),
        (1, 1, "pkg/other.py", _git_section("pkg/other.py", "+import pkg.mod", "+from x import util as u")),
        (1, 2, "lib/util.py", _git_section("lib/util.py", "+import lib.util")), (1, 3, "notes/util.md", _git_section("notes/util.md", "+import mod")),
        (2, 0, "mod.py", _git_section("mod.py", "+import other")), (2, 1, "a.py", None),
    ]
    df = spark.createDataFrame(rows, "diff_id int, section_pos int, path string, section string")
    got = {tuple(r) for r in diffs.import_graph(df).collect()}
    assert got == {(1, "other", "src/pkg/mod.py", "pkg/other.py"), (1, "pkg.mod", "pkg/other.py", "src/pkg/mod.py"), (1, "util", "pkg/other.py", "lib/util.py")}
    assert diffs.import_graph(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, 0, "a/m.py", ""), (1, 1, "b/m.py", ""), (1, 2, "c.py", "diff --git a/c.py b/c.py\n+import m\n")], df.schema)
    assert [r["dst"] for r in diffs.import_graph(twice).collect()] == ["b/m.py"]


def test_change_tags_patches_and_messages(spark):
    from pyspark.sql import functions as F

    from quarryline.operators import diffs

    rows = [("a/x.py", "+import x\n-def f() -> int:\n+  return 1"), ("requirements/dev.in", "+x==1"), ("README.rst", "+text"), ("tests/conf.toml", "+Assert x"), ("main.go", "+x := 1")]
    df = spark.createDataFrame(rows, "path string, section string")
    got = {r["path"]: r["tags"] for r in df.select("path", diffs.change_tags(F.col("section"), F.col("path")).alias("tags")).collect()}
    assert got == {"a/x.py": ["definitions", "imports", "returns", "type_hints"], "requirements/dev.in": ["dependencies"], "README.rst": ["docs"], "tests/conf.toml": ["assertions", "config", "tests"], "main.go": ["code"]}
    raw = [(1, "o/r", None, None, "s", "diff --git a", None), (2, None, "o", "n", "s", "", "@@ x"), (3, None, None, "n", "s", "diff", None), (4, "o/r", None, None, "s", " \n", None), (5, "o/r", None, None, None, None, "plain")]
    patches = diffs.extracted_patches(spark.createDataFrame(raw, "id int, repo string, repo_owner string, repo_name string, sha_fail string, diff string, diff_fix string"))
    assert {tuple(r) for r in patches.collect()} == {("1", "o/r", "s", "diff --git a", True), ("2", "o/n", "s", "@@ x", True), ("5", "o/r", None, "plain", False)}
    assert diffs.extracted_patches(spark.createDataFrame([(1, "o/r", "s", "+++")], "id int, repo string, sha_fail string, diff string")).count() == 1
    texts = spark.createDataFrame([("error: Corrupt Patch at line 3",), ("No valid patches in input",), ("time out",), (None,)], "m string")
    assert [r[0] for r in texts.select(diffs.looks_corrupt(F.col("m"))).collect()] == [True, True, False, False]


def test_every_rule_of_the_label_check_has_its_rows(spark):
    from quarryline.operators import labels

    rows = spark.createDataFrame([("1", ["A"], ["x"]), ("1", ["A"], ["y"]), ("2", [], []), ("3", ["A", "B"], ["x"]), ("4", ["Z"], ["x"]), ("9", None, None)], "id string, a array<string>, b array<string>")
    found = {tuple(r) for r in labels.violations(rows, "id", "a", "b", ["A", "B"], spark.createDataFrame([(str(i),) for i in range(1, 6)], "id string")).collect()}
    assert found == {("1", "repeated"), ("5", "missing"), ("9", "extra"), ("2", "empty"), ("9", "empty"), ("3", "length"), ("4", "unknown_label")}


def test_cosine_pairs_lose_none(spark):
    import itertools
    import math
    import random

    from quarryline.operators.text import cosine_pairs

    rng = random.Random(3)
    docs = {}
    for d in range(60):
        raw = {f"t{min(int(rng.expovariate(0.15)), 40)}": rng.random() for _ in range(rng.randrange(1, 15))}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        docs[d] = {t: w / norm for t, w in raw.items()}
    rows = spark.createDataFrame([(d, t, w) for d, v in docs.items() for t, w in v.items()], "doc int, term string, weight double")
    for least in (0.2, 0.5, 0.9):
        want = {(a, b) for a, b in itertools.combinations(docs, 2) if round(sum(w * docs[b].get(t, 0) for t, w in docs[a].items()), 9) >= least}
        assert {(r["id_a"], r["id_b"]) for r in cosine_pairs(rows, least).collect()} == want
    assert cosine_pairs(rows.limit(0), 0.5).count() == 0


def test_cleaned_text(spark):
    from pyspark.sql import functions as F

    from quarryline.operators.text import cleaned

    cases = {"\ufeffHello": "Hello", "ï»¿Test": "Test", "a\x00b\x07c\x9fd\x7f": "abcd", "e\u0301": "é", "x<|endoftext|>y<|im_start|>": "xy", "a\n\n\n\nb": "a\n\nb", "a  \t b": "a b", "    in": "  in", "end\n\n\n": "end\n", "\n\n": "\n", "": "", "a\r\n": "a\r\n"}
    df = spark.createDataFrame([(k,) for k in (*cases, None)], "t string")
    assert {r[0]: r[1] for r in df.select("t", cleaned(F.col("t"))).collect()} == {**cases, None: None}


def test_json_fields(spark):
    from pyspark.sql import functions as F

    from quarryline.operators.text import close_json, json_fields

    cases = {
        '{"a": 1}': ("whole", {"a": "1"}), '```json\n{"a": [1]}\n```': ("whole", {"a": "[1]"}), 'Sure: {"a": {"b": 2}} done': ("inner", {"a": '{"b":2}'}), "{'a': 'x', b: 2,}": ("lenient", {"a": "x", "b": "2"}),
        '{"a": ", }", "b": [1, 2,],}': ("lenient", {"a": ", }", "b": "[1,2]"}), 'so {"a": 1, "b": "cut of': ("closed", {"a": "1", "b": "cut of"}), "no object": (None, None), "": (None, None), "[1]": (None, None), "{": ("closed", {}),
    }
    df = spark.createDataFrame([(k,) for k in (*cases, None)], "t string")
    got = {r["t"]: (r["j"]["how"], r["j"]["fields"]) for r in df.select("t", json_fields(F.col("t")).alias("j")).collect()}
    assert got == {**cases, None: (None, None)}
    assert close_json('{"a": 1, "b": tr') == '{"a": 1}' and close_json('{"a": [ {"b": 2}, {"c') == '{"a": [ {"b": 2}, {}]}' and close_json('{"a": "x\\') == '{"a": "x"}'


def test_methods(spark):
    from pyspark.sql import functions as F

    from quarryline.operators.text import methods

    source = "import x\n\ndef one(a, b):\n    return a\n\nclass C:\n    def two(self):\n        pass\n\n    async def three(self):\n        " + "y = 1\n        " * 200
    rows = spark.createDataFrame([(source,), ("no code " * 300,), (None,)], "s string").select(methods(F.col("s")).alias("m")).collect()
    assert [m["name"] for m in rows[0]["m"]] == ["one", "two", "three"] and rows[0]["m"][0]["code"] == "def one(a, b):\n    return a\n\n" and len(rows[0]["m"][2]["code"]) == 803
    assert rows[1]["m"][0]["name"] is None and len(rows[1]["m"][0]["code"]) == 1000 and rows[2]["m"] is None


def test_long_intervals_give_few_rows(spark):
    import random

    from quarryline.operators.joins import overlapping

    rng = random.Random(5)
    span = lambda: (lambda s, n: (s, s + n))(rng.randrange(-2000, 10_000), rng.choice([0, 3, 63, 64, 65, 500, 10**6, 10**9]))
    a, b = [(i, *span()) for i in range(120)], [(i, *span()) for i in range(120)]
    x, y = spark.createDataFrame(a, "id_a int, a_start long, a_end long").selectExpr("*", "1 as g"), spark.createDataFrame(b, "id_b int, b_start long, b_end long").selectExpr("*", "1 as g")
    got = sorted((r["id_a"], r["id_b"]) for r in overlapping(x, y, ["g"], 64).collect())
    assert got == sorted((i, j) for i, s, e in a for j, t, f in b if s <= f and e >= t)
    assert overlapping(x, y.limit(0), ["g"], 64).count() == 0


def test_packs_and_frames():
    import random

    from quarryline.operators.chunking import pack_in_order
    from quarryline.operators.windows import spaced

    rng = random.Random(1)
    parts = ["x" * rng.randrange(1, 40) for _ in range(5000)]
    packs = pack_in_order(parts, 100)
    assert "".join(packs) == "".join(parts) and all(len(p) <= 100 for p in packs) and pack_in_order([], 5) == [] and pack_in_order(["abcdef", "g"], 5) == ["abcdef", "g"]
    assert spaced([9, 1, 1, 12, 11, 30], 10) == [1, 12, 30]


def test_call_costs(spark):
    from quarryline.operators.aggregates import call_costs

    calls = spark.createDataFrame([("m", 1_000_000, 400_000, 100_000, 10), ("m", None, None, None, None), ("z", 5, 0, 0, 5), (None, 1, 0, 0, 1)], "model string, input_tokens int, cached_tokens int, cache_write_tokens int, output_tokens int")
    rates = spark.createDataFrame([("m", 2.0, 8.0, 0.5, None)], "model string, input_rate double, output_rate double, cached_rate double, cache_write_rate double")
    assert sorted(round(r["cost"], 6) for r in call_costs(calls, rates).collect()) == [0.0, 0.0, 0.0, round(1.2 + 0.2 + 0.2 + 0.00008, 6)]


def test_three_way_merge(spark):
    from pyspark.sql import functions as F

    from quarryline.operators.diffs import apply_section, merge3, merged

    base = "a\nb\nc\nd\ne"
    assert merge3(base, "A\nb\nc\nd\ne", "a\nb\nc\nd\nE\nf") == ("A\nb\nc\nd\nE\nf", 0)
    assert merge3(base, "a\nX\nc\nd\ne", "a\nY\nc\nd\ne") == ("a\n<<<<<<<\nX\n=======\nY\n>>>>>>>\nc\nd\ne", 1)
    assert merge3(base, base, "a\nc\nd\ne") == ("a\nc\nd\ne", 0) and merge3(base, "z", "z") == ("z", 0) and merge3("", "", "") == ("", 0)
    one, two = apply_section(base, "@@ -1,2 +1,2 @@\n-a\n+A\n b"), apply_section(base, "@@ -4,2 +4,1 @@\n d\n-e")
    assert merge3(base, one, two) == ("A\nb\nc\nd", 0)
    rows = spark.createDataFrame([(base, one, two), (base, None, two)], "o string, a string, b string")
    assert [tuple(r["m"] or (None, None)) for r in rows.select(merged(F.col("o"), F.col("a"), F.col("b")).alias("m")).collect()] == [("A\nb\nc\nd", 0), (None, None)]


def test_java_outline(spark):
    from pyspark.sql import functions as F

    from quarryline.operators.text import java_outline

    source = """package x;
import java.util.*;
/* class Not { } */
public class Outer<T> extends Base {
    private static final Map<String, int[]> TABLE = make("}{;");
    int a, count;
    @Override
    public List<T> find(String k, int n) throws IOException {
        if (n > 0) { return null; } // }
        for (int i = 0; i < n; i++) { run(i); }
        return null;
    }
    interface Inner { void go(); }
    enum Kind { ONE, TWO }
}
"""
    got = spark.createDataFrame([(source,), (None,), ("",)], "s string").select(java_outline(F.col("s")).alias("o")).collect()
    assert [(x["kind"], x["name"], x["owner"]) for x in got[0]["o"]] == [("class", "Outer", None), ("field", "TABLE", "Outer"), ("field", "count", "Outer"), ("method", "find", "Outer"), ("interface", "Inner", "Outer"), ("method", "go", "Inner"), ("enum", "Kind", "Outer")]
    assert [(x["first"], x["last"]) for x in got[0]["o"]][0] == (4, 15) and [(x["first"], x["last"]) for x in got[0]["o"]][3] == (7, 12)
    assert got[1]["o"] is None and got[2]["o"] == []


def test_jaccard_pairs_lose_none_of_a_hot_item(spark, monkeypatch):
    import itertools
    import random

    from quarryline.operators import text

    rng = random.Random(2)
    sets = {d: sorted({"hot", *rng.sample([f"f{k}" for k in range(25)], rng.randrange(0, 8))} if rng.random() < 0.8 else {f"f{rng.randrange(25)}"}) for d in range(80)}
    rows = spark.createDataFrame(list(sets.items()), "id int, s array<string>")
    for least in (0.2, 0.5, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= least}
        assert {(r["id_a"], r["id_b"]) for r in text.jaccard_pairs(rows, [], "id", "s", least).collect()} == want
    pairs = spark.createDataFrame([("hot", i, 300) for i in range(300)] + [("cold", 1, 1), (None, 2, 1), (None, 3, 1)], "item string, id int, f int")
    got = text.prefix_pairs(pairs, ["item"], "id", [], 50)
    assert got.count() == got.distinct().count() == 300 * 299 // 2
