"""Queries of aggregations (A of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import aggregates as op
from quarryline.operators import joins
from quarryline.plans import base
from quarryline.plans.registry import Registry
from quarryline.session import table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql

_L, _O, _J = base.LABELS_SQL, base.OUTCOMES_SQL, base.JOBS_SQL
_N_LABELLED = "(SELECT count(DISTINCT id) FROM lab)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.outcomes(spark, sf_dir).join(base.labels(spark, sf_dir), "id")


@_R.add("a01_label_shares", f"WITH {_L} SELECT label, count(*) AS n, count(*) / {_N_LABELLED} AS share FROM lab GROUP BY 1")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label once per instance."""
    lab = base.labels(spark, sf_dir)
    return op.label_shares(lab, lab.select(F.count_distinct("id").alias("n")))


@_R.add("a03_labels_per_instance", f"WITH {_L} SELECT labels_per_id, count(*) AS n FROM (SELECT id, count(DISTINCT label) AS labels_per_id FROM lab GROUP BY 1) GROUP BY 1")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.set_sizes(base.labels(spark, sf_dir))


@_R.add("a03_summary", f"WITH {_L}, k AS (SELECT count(DISTINCT label) AS k FROM lab GROUP BY id) SELECT count(*) AS n_ids, count(*) FILTER (k = 1) AS single, count(*) FILTER (k > 1) AS multi, max(k) AS most, CAST(sum(k) AS BIGINT) / count(*) AS mean FROM k")
def a03s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.set_size_summary(base.labels(spark, sf_dir))


@_R.add("a04_sublabels", "SELECT trim(e.subcategory) AS sublabel, count(*) AS n FROM (SELECT unnest(error_types) AS e FROM log_analysis) WHERE trim(e.subcategory) <> '' GROUP BY 1")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "log_analysis").select(F.explode("error_types.subcategory").alias("s")).filter("trim(s) <> ''")
    return rows.groupBy(F.trim("s").alias("sublabel")).agg(F.count("*").alias("n"))


@_R.add("a05_co_occurrence", f"WITH {_L} SELECT a.label AS label_a, b.label AS label_b, count(*) AS n FROM lab a JOIN lab b ON a.id = b.id GROUP BY 1, 2")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full matrix with self pairs."""
    return op.co_occurrence(base.labels(spark, sf_dir))


@_R.add("a06_top_pairs", f"WITH {_L} SELECT a.label AS label_a, b.label AS label_b, count(*) AS n FROM lab a JOIN lab b ON a.id = b.id AND a.label < b.label GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.co_occurrence(base.labels(spark, sf_dir), mirror=False).filter("label_a < label_b").orderBy(F.desc("n"), "label_a", "label_b").limit(20)


@_R.add("a07_canonical_co_occurrence", f"WITH {_L}, c AS (SELECT * FROM lab WHERE label IN ('Test Failure', 'Dependency Error', 'Configuration Error')) SELECT a.label AS label_a, b.label AS label_b, count(*) AS n FROM c a JOIN c b ON a.id = b.id GROUP BY 1, 2")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.co_occurrence(base.labels(spark, sf_dir).filter(F.col("label").isin("Test Failure", "Dependency Error", "Configuration Error")))


@_R.add(
    "a08_repo_rollup",
    f"""WITH {_L}, r AS (SELECT DISTINCT id, repo FROM failed_jobs_summary WHERE id IS NOT NULL AND repo IS NOT NULL), x AS (SELECT r.repo, r.id, l.label FROM r JOIN lab l ON r.id = l.id),
t AS (SELECT repo, label, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, label) AS rn FROM x GROUP BY 1, 2)
SELECT x.repo, count(DISTINCT x.id) AS n_ids, count(DISTINCT x.label) AS n_labels, count(*) / count(DISTINCT x.id) AS mean, any_value(t.label) AS top_label FROM x JOIN t ON x.repo = t.repo AND t.rn = 1 GROUP BY 1""",
)
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = table(spark, sf_dir, "failed_jobs_summary").filter("id is not null and repo is not null").select("id", "repo").distinct()
    per = repos.join(base.labels(spark, sf_dir), "id")
    top = op.top_label(per, ["repo"], "label").select("repo", F.col("label").alias("top_label"))
    out = per.groupBy("repo").agg(F.count_distinct("id").alias("n_ids"), F.count_distinct("label").alias("n_labels"), F.count("*").alias("n"))
    return out.join(top, "repo").select("repo", "n_ids", "n_labels", F.try_divide("n", "n_ids").alias("mean"), "top_label")


@_R.add(
    "a09_month_rollup",
    """WITH x AS (SELECT DISTINCT analysis_id, strftime(created_at, '%Y-%m') AS month, trim(e.category) AS label FROM (SELECT analysis_id, created_at, unnest(error_types) AS e FROM log_analysis) WHERE trim(e.category) <> ''),
t AS (SELECT month, label, count(*) AS n, row_number() OVER (PARTITION BY month ORDER BY count(*) DESC, label) AS rk FROM x WHERE month IS NOT NULL GROUP BY 1, 2) SELECT month, label, n, CAST(rk AS INTEGER) AS rk FROM t WHERE rk <= 3""",
)
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.operators.windows import top_k

    rows = table(spark, sf_dir, "log_analysis").select("analysis_id", F.date_format("created_at", "yyyy-MM").alias("month"), F.explode("error_types.category").alias("c"))
    rows = rows.select("analysis_id", "month", F.trim("c").alias("label")).filter("label <> '' and month is not null").distinct()
    return top_k(rows.groupBy("month", "label").agg(F.count("*").alias("n")), ["month"], [F.desc("n"), F.col("label")], 3, "rk")


@_R.add("a10_success_rate_per_label", f"WITH {_L}, {_O} SELECT l.label, count(*) AS total, count(*) FILTER (o.ok) AS ok, count(*) - count(*) FILTER (o.ok) AS failed, count(*) FILTER (o.ok) / count(*) AS rate FROM outc o JOIN lab l ON o.id = l.id GROUP BY 1")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rates(_labelled(spark, sf_dir), ["label"], F.col("ok")).orderBy(F.desc("rate"), "label")


@_R.add("a11_rate_with_unknown", f"WITH {_L}, {_O} SELECT coalesce(l.label, 'Unknown') AS label, count(*) AS total, count(*) FILTER (o.ok) AS ok, count(*) - count(*) FILTER (o.ok) AS failed, count(*) FILTER (o.ok) / count(*) AS rate FROM outc o LEFT JOIN lab l ON o.id = l.id GROUP BY 1")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rates(joins.lookup(base.outcomes(spark, sf_dir), base.labels(spark, sf_dir), ["id"], {"label": "Unknown"}), ["label"], F.col("ok"))


@_R.add("a12_totals_over_labels", f"WITH {_L}, {_O}, p AS (SELECT l.label, count(*) AS total, count(*) FILTER (o.ok) AS ok FROM outc o JOIN lab l ON o.id = l.id GROUP BY 1) SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(ok) AS BIGINT) AS ok, count(*) AS n_labels FROM p")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rates(_labelled(spark, sf_dir), ["label"], F.col("ok")).agg(F.sum("total").alias("total"), F.sum("ok").alias("ok"), F.count("*").alias("n_labels"))


@_R.add("a13_weak_labels", f"WITH {_L}, {_O} SELECT l.label, count(*) AS total, count(*) FILTER (o.ok) / count(*) AS rate FROM outc o JOIN lab l ON o.id = l.id GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (o.ok) / count(*) < (SELECT count(*) FILTER (ok) / count(*) FROM outc)")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of at least five instances that do worse than all instances together."""
    overall = base.outcomes(spark, sf_dir).agg(F.count_if("ok") / F.count("*")).scalar()
    return op.rates(_labelled(spark, sf_dir), ["label"], F.col("ok")).filter((F.col("total") >= 5) & (F.col("rate") < overall)).select("label", "total", "rate")


@_R.add("a14_solvable_share", f"WITH {_L}, {_O}, p AS (SELECT l.label, bool_or(o.ok) AS any_ok FROM outc o JOIN lab l ON o.id = l.id GROUP BY 1) SELECT count(*) AS n_labels, count(*) FILTER (any_ok) AS solvable, count(*) FILTER (any_ok) / count(*) AS share FROM p")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _labelled(spark, sf_dir).groupBy("label").agg(F.bool_or("ok").alias("any_ok"))
    return per.agg(F.count("*").alias("n_labels"), F.count_if("any_ok").alias("solvable")).withColumn("share", F.try_divide("solvable", "n_labels"))


@_R.add("a15_coarse_categories", f"WITH {_L} SELECT CASE WHEN contains(label, 'Test') THEN 'test' WHEN contains(label, 'Dependency') OR contains(label, 'Build') THEN 'build' ELSE 'other' END AS category, label, count(*) AS n FROM lab GROUP BY ROLLUP (1, 2)")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels rolled up to categories with subtotals."""
    cat = F.when(F.col("label").contains("Test"), "test").when(F.col("label").contains("Dependency") | F.col("label").contains("Build"), "build").otherwise("other")
    return base.labels(spark, sf_dir).withColumn("category", cat).rollup("category", "label").agg(F.count("*").alias("n"))


@_R.add("a16_unsolved", f"WITH {_L}, {_O} SELECT DISTINCT l.id, l.label FROM lab l WHERE l.id NOT IN (SELECT id FROM outc WHERE ok)")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of instances that no run has solved."""
    return base.labels(spark, sf_dir).join(base.outcomes(spark, sf_dir).filter("ok").select("id"), "id", "left_anti").select("id", "label")


@_R.add("a17_unique_jobs", f"WITH {_J}, f AS (SELECT *, row_number() OVER (PARTITION BY record_id, job_name ORDER BY commit_pos, job_pos) AS rn FROM job WHERE job_name IS NOT NULL) SELECT record_id, job_name, commit_pos, job_pos, CAST(coalesce(len(steps), 0) AS BIGINT) AS n_steps FROM f WHERE rn = 1")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = op.unique_executions(base.jobs(spark, sf_dir), "record_id", "job_name", ["commit_pos", "job_pos"])
    return first.select("record_id", "job_name", "commit_pos", "job_pos", F.coalesce(F.size("steps"), F.lit(0)).cast("bigint").alias("n_steps"))


@_R.add("a18_executions_and_unique", f"WITH {_J} SELECT record_id, count(*) AS executions, count(DISTINCT job_name) AS unique_jobs, count(*) / nullif(count(DISTINCT job_name), 0) AS multiplier FROM job GROUP BY 1")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, A21."""
    out = base.jobs(spark, sf_dir).groupBy("record_id").agg(F.count("*").alias("executions"), F.count_distinct("job_name").alias("unique_jobs"))
    return out.withColumn("multiplier", F.try_divide("executions", "unique_jobs"))


_KNOWN = ["success", "failure", "cancelled", "timed_out", "skipped"]


@_R.add("a19_conclusion_pivot", f"WITH {_J} SELECT record_id, " + ", ".join(f"count(*) FILTER (conclusion = '{k}') AS {k}" for k in _KNOWN) + f", count(*) FILTER (conclusion IS NULL OR conclusion NOT IN ({', '.join(repr(k) for k in _KNOWN)})) AS unknown, count(*) AS total FROM job GROUP BY 1")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.conclusion_pivot(base.jobs(spark, sf_dir), ["record_id"], "conclusion", _KNOWN)


@_R.add("a20_global_totals", f"WITH {_J} SELECT count(*) AS n_jobs, count(DISTINCT record_id) AS n_records, count(*) FILTER (conclusion = 'failure') AS n_failed, CAST(sum(coalesce(len(steps), 0)) AS BIGINT) AS n_steps, count(*) / count(DISTINCT record_id) AS jobs_per_record, count(*) FILTER (conclusion = 'failure') / count(*) AS failure_rate FROM job")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = base.jobs(spark, sf_dir).agg(F.count("*").alias("n_jobs"), F.count_distinct("record_id").alias("n_records"), F.count_if(F.col("conclusion") == "failure").alias("n_failed"), F.sum(F.coalesce(F.size("steps"), F.lit(0))).alias("n_steps"))
    return out.withColumn("jobs_per_record", F.try_divide("n_jobs", "n_records")).withColumn("failure_rate", F.try_divide("n_failed", "n_jobs"))


@_R.add("a22_top_step_names", f"WITH {_J}, s AS (SELECT unnest(steps) AS step_name FROM job) SELECT step_name, count(*) AS n FROM s WHERE step_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, step_name LIMIT 25")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = base.jobs(spark, sf_dir).select(F.explode("steps").alias("step_name")).filter("step_name is not null")
    return steps.groupBy("step_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "step_name").limit(25)


@_R.add("a23_failed_per_repo", f"WITH {_J} SELECT repo, count(*) AS total, count(*) FILTER (conclusion = 'failure') AS ok, count(*) - count(*) FILTER (conclusion = 'failure') AS failed, count(*) FILTER (conclusion = 'failure') / count(*) AS rate FROM job GROUP BY 1 ORDER BY rate DESC, repo LIMIT 10")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rates(base.jobs(spark, sf_dir), ["repo"], F.col("conclusion") == "failure").orderBy(F.desc("rate"), "repo").limit(10)


@_R.add("a24_conclusion_share", f"WITH {_J} SELECT conclusion, count(*) AS n, count(*) / (SELECT count(*) FROM job) AS share FROM job GROUP BY 1")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = base.jobs(spark, sf_dir)
    return op.label_shares(jobs.select(F.col("conclusion").alias("label")), jobs.agg(F.count("*").alias("n"))).withColumnRenamed("label", "conclusion")


@_R.add("a25_fail_vs_success_commits", f"WITH {_J}, c AS (SELECT record_id, commit_pos, commit_type, count(*) AS n_jobs, sum(coalesce(len(steps), 0)) AS n_steps FROM job WHERE commit_type IN ('fail', 'success') GROUP BY 1, 2, 3) SELECT commit_type, count(*) AS n, CAST(sum(n_jobs) AS BIGINT) / count(*) AS mean_jobs, CAST(sum(n_steps) AS BIGINT) / count(*) AS mean_steps FROM c GROUP BY 1")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = base.jobs(spark, sf_dir).filter("commit_type in ('fail', 'success')").groupBy("record_id", "commit_pos", "commit_type").agg(F.count("*").alias("n_jobs"), F.sum(F.coalesce(F.size("steps"), F.lit(0))).alias("n_steps"))
    out = per.groupBy("commit_type").agg(F.count("*").alias("n"), F.sum("n_jobs").alias("j"), F.sum("n_steps").alias("s"))
    return out.select("commit_type", "n", F.try_divide("j", "n").alias("mean_jobs"), F.try_divide("s", "n").alias("mean_steps"))


@_R.add("a26_dataset_metrics", """WITH d AS (SELECT * FROM parsed_file), x AS (SELECT 'changes' AS metric, CAST(total_changes AS BIGINT) AS v FROM d UNION ALL SELECT 'path_chars', length(path) FROM d UNION ALL SELECT 'file_pos', file_pos FROM d)
SELECT metric, count(v) AS n, CAST(sum(v) AS BIGINT) / count(v) AS mean, max(v) AS most FROM x GROUP BY 1""")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parsed_file")
    x = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("bigint").alias("v")) for m, v in (("changes", F.col("total_changes")), ("path_chars", F.length("path")), ("file_pos", F.col("file_pos")))]))
    out = rows.select(x.alias("x")).select("x.*").groupBy("metric").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.max("v").alias("most"))
    return out.select("metric", "n", F.try_divide("s", "n").alias("mean"), "most")


@_R.add("a27_durations", "SELECT module_name, count(*) AS n, median(duration_seconds) AS median_s, max(duration_seconds) AS most_s, min(duration_seconds) AS least_s FROM (SELECT DISTINCT call_id, module_name, duration_seconds FROM llm_call_record) WHERE duration_seconds > 0 AND NOT isnan(duration_seconds) GROUP BY 1")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.calls(spark, sf_dir).filter("duration_seconds > 0 and not isnan(duration_seconds)")
    d = "duration_seconds"
    return rows.groupBy("module_name").agg(F.count("*").alias("n"), F.median(d).alias("median_s"), F.max(d).alias("most_s"), F.min(d).alias("least_s"))


@_R.add("a28_three_way", f"WITH {base.CALLS_SQL}, g AS (SELECT CASE WHEN error_text IS NOT NULL THEN 'error' WHEN success THEN 'good' ELSE 'other' END AS grp, input_tokens AS v, output_tokens > 1000 AS f FROM call) SELECT grp, count(*) AS n, CAST(sum(v) AS BIGINT) / count(*) AS mean, max(v) AS most, count(*) FILTER (f) AS flagged FROM g GROUP BY 1")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.three_way(base.calls(spark, sf_dir), {"error": F.col("error_text").isNotNull(), "good": F.col("success")}, F.col("input_tokens"), F.col("output_tokens") > 1000)


@_R.add("a29_usage_levels", f"WITH {base.CALLS_SQL} SELECT instance_id, module_name, count(*) AS n_calls, CAST(sum(total_tokens) AS BIGINT) AS tokens, {base.money_sql('total_cost')} AS cost FROM call GROUP BY ROLLUP (instance_id, module_name)")
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to attempts to instances to the run."""
    return base.calls(spark, sf_dir).rollup("instance_id", "module_name").agg(F.count("*").alias("n_calls"), F.sum("total_tokens").alias("tokens"), base.money(F.col("total_cost")).alias("cost"))


@_R.add("a30_usage_by_module_and_model", f"WITH {base.CALLS_SQL} SELECT module_name, m AS model, count(*) AS n_calls, CAST(sum(total_tokens) AS BIGINT) AS tokens, {base.money_sql('total_cost')} AS cost FROM (SELECT *, lower(trim(model)) AS m FROM call) GROUP BY GROUPING SETS ((module_name), (m), ())")
def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A30, A31, A32."""
    rows = base.calls(spark, sf_dir).withColumn("m", F.lower(F.trim("model")))
    out = rows.groupingSets([["module_name"], ["m"], []], "module_name", "m").agg(F.count("*").alias("n_calls"), F.sum("total_tokens").alias("tokens"), base.money(F.col("total_cost")).alias("cost"))
    return out.withColumnRenamed("m", "model")


@_R.add(
    "a33_call_costs",
    f"""WITH {base.CALLS_SQL}, r(m, i, o) AS (VALUES ('quarrel-flash', 2.0, 8.0), ('tindra-mini', 0.5, 1.5)), c AS (SELECT call.*, r.i, r.o FROM call LEFT JOIN r ON call.model = r.m)
SELECT model, count(*) AS n, CAST(sum(CAST((coalesce(input_tokens, 0) * coalesce(i, 0) + coalesce(output_tokens, 0) * coalesce(o, 0)) / 1000000 AS DECIMAL(20,9))) AS DOUBLE) AS cost FROM c GROUP BY 1""",
)
def a33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by model under a table of rates per million tokens."""
    rates = spark.createDataFrame([("quarrel-flash", 2.0, 8.0, None, None), ("tindra-mini", 0.5, 1.5, None, None)], "model string, input_rate double, output_rate double, cached_rate double, cache_write_rate double")
    return op.call_costs(base.calls(spark, sf_dir), rates).groupBy("model").agg(F.count("*").alias("n"), F.sum(F.col("cost").cast("decimal(20,9)")).cast("double").alias("cost"))


@_R.add("a35_delta_to_baseline", f"WITH {base.CALLS_SQL}, c AS (SELECT lower(trim(model)) AS model, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM call WHERE model IS NOT NULL GROUP BY 1), b AS (SELECT max(tokens) AS t FROM c WHERE model = 'quarrel-flash') SELECT model, tokens, tokens - (SELECT t FROM b) AS delta, (tokens - (SELECT t FROM b)) / (SELECT t FROM b) AS change FROM c")
def a35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A34, A35."""
    per = base.calls(spark, sf_dir).filter("model is not null").groupBy(F.lower(F.trim("model")).alias("model")).agg(F.sum("total_tokens").alias("tokens"))
    return op.delta_to(per, "model", "quarrel-flash", "tokens")


@_R.add("a36_what_if", f"WITH {base.CALLS_SQL} SELECT f.factor, CAST(sum(input_tokens) AS BIGINT) * f.factor AS scaled FROM call, (SELECT unnest([1, 2, 5]) AS factor) f GROUP BY f.factor")
def a36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals scaled by factors: the factors are exploded on the one total."""
    one = base.calls(spark, sf_dir).agg(F.sum("input_tokens").alias("s"))
    return one.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("factor"), "s").select("factor", (F.col("s") * F.col("factor")).alias("scaled"))


@_R.add(
    "a37_ordered_file_union",
    """WITH f AS (SELECT instance_id, r.file AS file, min((analysis_id, i)) AS pos FROM (SELECT DISTINCT instance_id, analysis_id, relevant_files, unnest(range(1, len(relevant_files) + 1)) AS i, relevant_files[i] AS r FROM (SELECT instance_id, analysis_id, relevant_files FROM log_analysis)) WHERE r.file IS NOT NULL AND instance_id IS NOT NULL GROUP BY 1, 2)
SELECT instance_id, list(file ORDER BY pos) AS files FROM f GROUP BY 1""",
)
def a37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an instance's analyses, first mention first."""
    rows = table(spark, sf_dir, "log_analysis").filter("instance_id is not null").select("instance_id", "analysis_id", F.col("relevant_files.file").alias("files")).distinct()
    return op.ordered_union(rows, ["instance_id"], "files", ["analysis_id"])


@_R.add("a38_problems_per_file", "SELECT r.file AS file, count(*) AS n, count(DISTINCT analysis_id) AS n_analyses FROM (SELECT DISTINCT analysis_id, unnest(relevant_files) AS r FROM log_analysis) WHERE r.file IS NOT NULL GROUP BY 1 HAVING count(DISTINCT analysis_id) > 1")
def a38(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "log_analysis").select("analysis_id", F.explode("relevant_files").alias("r")).distinct().filter("r.file is not null")
    return rows.groupBy("r.file").agg(F.count("*").alias("n"), F.count_distinct("analysis_id").alias("n_analyses")).filter("n_analyses > 1")


@_R.add("a39_groups", f"WITH {base.CALLS_SQL} SELECT module_name, function_name, count(*) AS n FROM call GROUP BY 1, 2")
def a39(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.calls(spark, sf_dir).groupBy("module_name", "function_name").agg(F.count("*").alias("n"))


@_R.add("a40_any_failure_per_commit", f"WITH {_J} SELECT record_id, commit_pos, bool_or(coalesce(conclusion = 'failure', false)) AS any_failure, max_by(job_name, (started_at, job_pos)) AS last_job FROM job WHERE started_at IS NOT NULL AND job_name IS NOT NULL GROUP BY 1, 2")
def a40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A40, A41."""
    rows = base.jobs(spark, sf_dir).filter("started_at is not null and job_name is not null")
    return rows.groupBy("record_id", "commit_pos").agg(F.bool_or(F.coalesce(F.col("conclusion") == "failure", F.lit(False))).alias("any_failure"), F.max_by("job_name", F.struct("started_at", "job_pos")).alias("last_job"))


@_R.add("a42_word_counts", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS INTEGER) AS n_words FROM documents")
def a42(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", op.words_in(F.col("text")).alias("n_words"))


@_R.add("a43_repeated_keys", "SELECT analysis_id, count(*) AS n FROM log_analysis GROUP BY 1 HAVING count(*) > 1")
def a43(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "log_analysis").groupBy("analysis_id").agg(F.count("*").alias("n")).filter("n > 1")
