"""Queries of evaluation metrics and statistics (E of the inventory).

Truth of an instance: the files its diffs touch; prediction: the files its first analysis names, in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import metrics as op
from quarryline.operators import stats
from quarryline.plans import base
from quarryline.plans.registry import Registry
from quarryline.session import table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
_KS = (1, 3, 5, 10, 15, 20)

# Ranked lists from the star schema: of an order, parts by falling price against parts with a returned line.
_RANKED = """ranked AS (
  SELECT l_orderkey AS id, list(CAST(l_partkey AS VARCHAR) ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS predicted FROM lineitem GROUP BY 1),
truth AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS truth FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"""
_ROWS = {
    "predicted": "rw AS (SELECT t.id, r.predicted, t.truth FROM truth t JOIN ranked r ON t.id = r.id)",
    "pushed": "rw AS (SELECT t.id, coalesce(r.predicted, []) AS predicted, t.truth FROM truth t LEFT JOIN ranked r ON t.id = r.id WHERE t.id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))",
    "both": "rw AS (SELECT t.id, r.predicted, t.truth FROM truth t JOIN ranked r ON t.id = r.id WHERE len(r.predicted) > 0)",
    "truth": "rw AS (SELECT t.id, coalesce(r.predicted, []) AS predicted, t.truth FROM truth t LEFT JOIN ranked r ON t.id = r.id)",
}
_PER_ROW = (
    "sc AS (SELECT id, len(list_distinct(predicted)) AS n_predicted, len(truth) AS n_truth, len(list_intersect(list_distinct(predicted), truth)) AS n_matched, "
    + ", ".join(f"len(list_intersect(predicted[1:{k}], truth)) > 0 AS top_{k}" for k in _KS)
    + " FROM rw)"
)
_SUMMARY = (
    "SELECT count(*) AS n, count(*) FILTER (n_matched = n_truth AND n_predicted = n_truth) / count(*) AS exact, CAST(sum(CAST(CASE WHEN n_predicted = 0 THEN 0 ELSE n_matched / n_predicted END AS DECIMAL(20,12))) AS DOUBLE) / count(*) AS precision, "
    + ", ".join(f"count(*) FILTER (top_{k}) / count(*) AS top_{k}" for k in _KS)
    + " FROM sc"
)


def _rows(spark: SparkSession, sf_dir: str, denominator: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("part"), "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    by_price = F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), "l_partkey", "l_linenumber", "part")))
    # Both lists of an order from one shuffle.
    lists = lines.groupBy("id").agg(F.transform(by_price, lambda x: x["part"]).alias("predicted"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("part")))).alias("truth"))
    pushed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return op.counted_rows(lists, pushed, denominator)


def _add_localization(name: str, denominator: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op.summary(op.per_row(_rows(spark, sf_dir, denominator), _KS), _KS)

    _R.add(name, f"WITH {_RANKED}, {_ROWS[denominator]}, {_PER_ROW} {_SUMMARY}")(run)


for _name, _den in (("e01_localization_predicted", "predicted"), ("e02_localization_pushed", "pushed"), ("e03_localization_both", "both"), ("e04_localization_truth", "truth")):
    _add_localization(_name, _den)


@_R.add("e03_per_instance", f"WITH {_RANKED}, {_ROWS['truth']}, {_PER_ROW} SELECT id, CAST(n_predicted AS INTEGER) AS n_predicted, CAST(n_truth AS INTEGER) AS n_truth, CAST(n_matched AS INTEGER) AS n_matched, n_matched = n_truth AND n_predicted = n_truth AS exact, CASE WHEN n_predicted = 0 THEN 0.0 ELSE n_matched / n_predicted END AS precision, n_matched / n_truth AS recall, {", ".join(f"top_{k}" for k in _KS)} FROM sc")
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.per_row(_rows(spark, sf_dir, "truth"), _KS)


@_R.add(
    "e04_paths_from_headers",
    """WITH d AS (SELECT DISTINCT diff_id, diff FROM diff_output WHERE diff IS NOT NULL), l AS (SELECT diff_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT diff_id, string_split(diff, chr(10)) AS ls FROM d)),
p AS (SELECT diff_id, regexp_replace(regexp_extract(ls[i], '^diff --git a/.*? b/(.+)$', 1), '\\s+$', '') AS path, min(i) AS i FROM l WHERE starts_with(ls[i], 'diff --git a/') GROUP BY 1, 2)
SELECT d.diff_id, coalesce((list(p.path ORDER BY p.i) FILTER (p.path <> ''))[1:15], []) AS paths FROM d LEFT JOIN p ON d.diff_id = p.diff_id GROUP BY d.diff_id""",
)
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 distinct paths of each diff's headers."""
    from quarryline.operators.diffs import changed_paths

    return table(spark, sf_dir, "diff_output").filter("diff is not null").select("diff_id", F.slice(changed_paths(F.col("diff")), 1, 15).alias("paths")).distinct()


_LEVEL_SQL = f"""WITH {base.JOBS_SQL}, s AS (
  SELECT record_id, list(DISTINCT job_name) FILTER (commit_type = 'fail' AND conclusion = 'failure') AS b, list(DISTINCT job_name) FILTER (commit_type = 'success' AND conclusion = 'failure') AS a, list(DISTINCT job_name) FILTER (commit_type = 'success') AS k
  FROM job WHERE job_name IS NOT NULL GROUP BY 1),
f AS (SELECT record_id, len(coalesce(b, [])) AS nb, len(list_filter(coalesce(b, []), lambda x: list_contains(coalesce(k, []), x) AND NOT list_contains(coalesce(a, []), x))) AS nf FROM s),
lv AS (SELECT record_id, CASE WHEN nb = 0 THEN 'no_data' WHEN nf = nb THEN 'fixed' WHEN nf > 0 THEN 'partial' ELSE 'none' END AS level FROM f)"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = base.jobs(spark, sf_dir).filter("job_name is not null")
    of = lambda cond: F.collect_set(F.when(cond, F.col("job_name")))
    t, bad = F.col("commit_type"), F.col("conclusion") == "failure"
    sets = jobs.groupBy("record_id").agg(of((t == "fail") & bad).alias("b"), of((t == "success") & bad).alias("a"), of(t == "success").alias("k"))
    return sets.select("record_id", op.step_levels(F.col("b"), F.col("a"), F.col("k")).alias("level"))


@_R.add("e05_levels", _LEVEL_SQL + " SELECT record_id, level FROM lv")
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)


@_R.add("e05_level_rate", _LEVEL_SQL + ", c AS (SELECT count(*) FILTER (level = 'fixed') AS fixed, count(*) FILTER (level = 'partial') AS partial, count(*) FILTER (level = 'none') AS \"none\", count(*) FILTER (level = 'no_data') AS no_data FROM lv) SELECT fixed, partial, \"none\", no_data, (fixed + 0.5 * partial) / nullif(fixed + partial + \"none\", 0) AS rate FROM c")
def e05r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.level_rate(_levels(spark, sf_dir), "level")


@_R.add("e06_pass_rate", f"WITH {base.OUTCOMES_SQL} SELECT count(*) AS n, count(*) FILTER (ok) AS passed, count(*) FILTER (ok) / greatest(count(*), 1) AS rate FROM outc")
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E06, E08."""
    c = base.outcomes(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"))
    return c.withColumn("rate", F.col("passed") / F.greatest("n", F.lit(1)))


@_R.add("e07_merged_levels", _LEVEL_SQL + f", {base.OUTC_SQL}" + " SELECT m.record_id, lv.level, o.ok FROM all_instances_metadata m LEFT JOIN lv ON m.record_id = lv.record_id LEFT JOIN outc o ON m.id = o.id")
def e07(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "all_instances_metadata").select("record_id", "id")
    return ids.join(_levels(spark, sf_dir), "record_id", "left").join(base.outcomes(spark, sf_dir), "id", "left").select("record_id", "level", "ok")


_IR = f"""WITH {_RANKED}, {_ROWS['truth']},
hp AS (SELECT id, truth, predicted, list_filter(list_transform(predicted, lambda x, i: CASE WHEN list_contains(truth, x) THEN i END), lambda r: r IS NOT NULL) AS hr FROM rw)"""


@_R.add(
    "e15_bundle",
    _IR
    + """ SELECT id, CASE WHEN len(hr) = 0 THEN 0.0 ELSE 1.0 / hr[1] END AS rr, CASE WHEN len(hr) = 0 THEN 0.0 ELSE list_sum(list_transform(hr, lambda r, i: i / r)) / len(hr) END AS ap,
len(list_intersect(predicted[1:3], truth)) / len(truth) AS recall_3, len(list_filter(predicted[1:3], lambda x: list_contains(truth, x))) / 3 AS precision_3, len(list_intersect(predicted[1:3], truth)) > 0 AS hit_3 FROM hp""",
)
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E09-E13 and E15 per query."""
    p, t = F.col("predicted"), F.col("truth")
    return _rows(spark, sf_dir, "truth").select(
        "id", op.reciprocal_rank(p, t).alias("rr"), op.average_precision(p, t).alias("ap"), op.recall_at(p, t, 3).alias("recall_3"), op.precision_at(p, t, 3).alias("precision_3"), op.hits_at(p, t, 3).alias("hit_3")
    )


@_R.add(
    "e14_ndcg",
    f"""WITH {_RANKED}, {_ROWS['truth']}, g AS (SELECT id, list_sum(list_transform(predicted[1:5], lambda x, i: CASE WHEN list_contains(truth, x) THEN 1.0 ELSE 0.0 END / CASE WHEN i = 1 THEN 1.0 ELSE log2(i + 1) END)) AS d,
list_sum(list_transform(truth[1:5], lambda x, i: 1.0 / CASE WHEN i = 1 THEN 1.0 ELSE log2(i + 1) END)) AS b FROM rw) SELECT id, round(coalesce(d, 0) / b, 9) AS ndcg_5 FROM g""",
)
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "truth").select("id", F.round(op.ndcg_at(F.col("predicted"), F.col("truth"), 5), 9).alias("ndcg_5"))


def _first_ranks(spark: SparkSession, sf_dir: str, descending: bool) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    price = -F.col("l_extendedprice") if descending else F.col("l_extendedprice")
    lists = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(price.alias("p"), "l_partkey", "l_linenumber", "l_returnflag"))).alias("x"))
    return lists.select("id", F.nullif(F.array_position(F.transform("x", lambda s: s["l_returnflag"]), F.lit("R")), F.lit(0)).cast("int").alias("rank"))


@_R.add(
    "e16_effectiveness",
    """WITH a AS (SELECT l_orderkey AS id, nullif(list_position(list(l_returnflag ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_returnflag), 'R'), 0) AS r FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey AS id, nullif(list_position(list(l_returnflag ORDER BY l_extendedprice, l_partkey, l_linenumber, l_returnflag), 'R'), 0) AS r FROM lineitem GROUP BY 1),
c AS (SELECT coalesce(a.r, 999999) AS x, coalesce(b.r, 999999) AS y FROM a JOIN b ON a.id = b.id)
SELECT CASE WHEN y < x THEN 'improved' WHEN y > x THEN 'worsened' ELSE 'preserved' END AS change, count(*) AS n, count(*) / (SELECT count(*) FROM c) AS share FROM c GROUP BY 1""",
)
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.effectiveness(_first_ranks(spark, sf_dir, True), _first_ranks(spark, sf_dir, False))


@_R.add("e17_by_truth_size", f"WITH {_RANKED}, {_ROWS['truth']}, {_PER_ROW} SELECT least(n_truth, 4) AS truth_size, count(*) AS n, count(*) FILTER (top_1) / count(*) AS top_1, count(*) FILTER (top_3) / count(*) AS top_3 FROM sc GROUP BY ROLLUP (1)")
def e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = op.per_row(_rows(spark, sf_dir, "truth"), _KS).withColumn("truth_size", F.least("n_truth", F.lit(4)).cast("bigint"))
    out = sc.rollup("truth_size").agg(F.count("*").alias("n"), F.count_if("top_1").alias("a"), F.count_if("top_3").alias("b"))
    return out.select("truth_size", "n", F.try_divide("a", "n").alias("top_1"), F.try_divide("b", "n").alias("top_3"))


_SYS = "sy AS (SELECT lower(trim(model)) AS sys, instance_id AS id, bool_or(success) AS ok FROM llm_call_record WHERE model IS NOT NULL AND instance_id IS NOT NULL GROUP BY 1, 2)"


def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "llm_call_record").filter("model is not null and instance_id is not null")
    return rows.groupBy(F.lower(F.trim("model")).alias("sys"), F.col("instance_id").alias("id")).agg(F.bool_or("success").alias("ok"))


_PAIRS_SQL = f"WITH {_SYS}, ct AS (SELECT a.sys AS system_a, b.sys AS system_b, count(*) FILTER (a.ok AND b.ok) AS \"both\", count(*) FILTER (a.ok AND NOT b.ok) AS only_a, count(*) FILTER (NOT a.ok AND b.ok) AS only_b, count(*) FILTER (NOT a.ok AND NOT b.ok) AS neither FROM sy a JOIN sy b ON a.id = b.id AND a.sys < b.sys GROUP BY 1, 2)"


@_R.add("e18_contingency", _PAIRS_SQL + " SELECT * FROM ct")
def e18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of models."""
    return stats.all_pairs(_systems(spark, sf_dir), "sys", "id", "ok")


@_R.add("e19_chi2", _PAIRS_SQL + " SELECT system_a, system_b, CASE WHEN only_a + only_b = 0 THEN 0.0 ELSE CAST((abs(only_a - only_b) - 1) * (abs(only_a - only_b) - 1) AS DOUBLE) / (only_a + only_b) END AS chi2 FROM ct")
def e19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mcnemar(stats.all_pairs(_systems(spark, sf_dir), "sys", "id", "ok")).select("system_a", "system_b", "chi2")


@_R.add("e20_holm", _PAIRS_SQL + """, q AS (SELECT system_a || '/' || system_b AS pair, 1.0 / (1 + only_a + only_b) AS p FROM ct), s AS (SELECT pair, p, least(1.0, p * ((SELECT count(*) FROM q) - row_number() OVER (ORDER BY p, pair) + 1)) AS s FROM q)
SELECT pair, p, max(s) OVER (ORDER BY p, pair ROWS UNBOUNDED PRECEDING) AS p_adjusted FROM s""")
def e20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's adjustment of given p (SQL lacks erfc; the tail itself is tested separately)."""
    c = stats.all_pairs(_systems(spark, sf_dir), "sys", "id", "ok")
    tests = c.select(F.concat_ws("/", "system_a", "system_b").alias("pair"), (F.lit(1.0) / (1 + F.col("only_a") + F.col("only_b"))).alias("p"))
    return stats.holm(tests, "p", "pair")


@_R.add("e21_significance")
def e21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of models with chi2, p and adjusted p."""
    tests = stats.mcnemar(stats.all_pairs(_systems(spark, sf_dir), "sys", "id", "ok")).withColumn("pair", F.concat_ws("/", "system_a", "system_b"))
    return stats.holm(tests, "p", "pair")


@_R.add("e22_hit_profile", f"WITH {_RANKED}, {_ROWS['truth']}, {_PER_ROW} SELECT top_1, count(*) AS n, CAST(sum(n_predicted) AS BIGINT) / count(*) AS mean_predicted, CAST(sum(n_truth) AS BIGINT) / count(*) AS mean_truth FROM sc GROUP BY 1")
def e22(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = op.per_row(_rows(spark, sf_dir, "truth"), _KS)
    out = sc.groupBy("top_1").agg(F.count("*").alias("n"), F.sum("n_predicted").alias("p"), F.sum("n_truth").alias("t"))
    return out.select("top_1", "n", F.try_divide("p", "n").alias("mean_predicted"), F.try_divide("t", "n").alias("mean_truth"))


@_R.add("e23_two_denominators", f"WITH {_RANKED}, {_ROWS['truth']}, {_PER_ROW} SELECT count(*) FILTER (top_1) / count(*) AS with_missing, count(*) FILTER (top_1) / nullif(count(*) FILTER (n_predicted > 0), 0) AS without_missing FROM sc")
def e23(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = op.per_row(_rows(spark, sf_dir, "truth"), _KS).agg(F.count_if("top_1").alias("h"), F.count("*").alias("n"), F.count_if(F.col("n_predicted") > 0).alias("m"))
    return sc.select(F.try_divide("h", "n").alias("with_missing"), F.try_divide("h", "m").alias("without_missing"))


@_R.add("e24_correlation", "SELECT round(corr(input_tokens, output_tokens), 9) AS r FROM (SELECT DISTINCT call_id, input_tokens, output_tokens FROM llm_call_record)")
def e24(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "llm_call_record").select("call_id", "input_tokens", "output_tokens").distinct()
    return rows.agg(F.round(F.corr("input_tokens", "output_tokens"), 9).alias("r"))


@_R.add("e25_reconciliation", f"WITH {base.JOBS_SQL}, a AS (SELECT id, count(*) AS n_a FROM job WHERE conclusion = 'failure' GROUP BY 1), b AS (SELECT id, max(no_of_failed_jobs) AS n_b FROM failed_jobs_summary GROUP BY 1) SELECT a.id, n_a, n_b, abs(n_a - n_b) < 0.01 AS agrees FROM a JOIN b ON a.id = b.id")
def e25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of the same number, within 0.01."""
    a = base.jobs(spark, sf_dir).filter("conclusion = 'failure'").groupBy("id").agg(F.count("*").alias("n_a"))
    b = table(spark, sf_dir, "failed_jobs_summary").groupBy("id").agg(F.max("no_of_failed_jobs").alias("n_b"))
    return a.join(b, "id").select("id", "n_a", "n_b", (F.abs(F.col("n_a") - F.col("n_b")) < 0.01).alias("agrees"))
