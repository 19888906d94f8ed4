"""Queries of scans, predicates and normalisation (S and P of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import filters as op
from quarryline.plans import base
from quarryline.plans.registry import Registry
from quarryline.session import table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql


@_R.add("s01_scan", "SELECT * FROM repo_catalog")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repo_catalog")


@_R.add("s02_projected_scan", "SELECT id, repo, loaded_at FROM all_instances_metadata")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_instances_metadata").select("id", "repo", "loaded_at")


@_R.add("s10_whitelisted_export", "SELECT coalesce(id, '') AS id, coalesce(repo, '') AS repo, coalesce(CAST(no_of_failed_jobs AS VARCHAR), '') AS no_of_failed_jobs, coalesce(CAST(no_of_failed_steps AS VARCHAR), '') AS no_of_failed_steps FROM failed_jobs_summary")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.sources.sinks import whitelisted

    return whitelisted(table(spark, sf_dir, "failed_jobs_summary"), ["id", "repo", "no_of_failed_jobs", "no_of_failed_steps"])


@_R.add("s13_point_lookup", "SELECT record_id, id, sha_fail FROM all_instances_metadata WHERE id = '1064'")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_instances_metadata").filter("id = '1064'").select("record_id", "id", "sha_fail")


@_R.add(
    "s14_predictions_union",
    """SELECT trim(instance_id) AS id, diff AS patch, 'diffs' AS origin FROM diff_output WHERE instance_id IS NOT NULL
UNION ALL SELECT trim(id), compare_url, 'compare' FROM all_instances_metadata WHERE id IS NOT NULL""",
)
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.sources.readers import normal_predictions

    diffs = normal_predictions(table(spark, sf_dir, "diff_output").select("instance_id", "diff"), "diffs")
    urls = normal_predictions(table(spark, sf_dir, "all_instances_metadata").select("id", F.col("compare_url").alias("patch")), "compare")
    return diffs.unionByName(urls)


@_R.add("s20_fingerprints", "SELECT diff_id, sha256(diff) AS fingerprint, CAST(strlen(diff) AS BIGINT) AS n_bytes FROM diff_output WHERE diff IS NOT NULL")
def s20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "diff_output").filter("diff is not null").select("diff_id", F.sha2("diff", 256).alias("fingerprint"), F.octet_length("diff").cast("bigint").alias("n_bytes"))


_COUNTED = ("repo_catalog", "diff_output", "parsed_file", "log_analysis")


@_R.add("s22_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _COUNTED))
def s22(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.sources.readers import row_counts

    return row_counts({t: table(spark, sf_dir, t) for t in _COUNTED})


@_R.add("filter_p01_allowed_ids", "SELECT record_id, id FROM all_instances_metadata WHERE id IN (SELECT instance_id FROM diff_output)")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "diff_output").select(F.col("instance_id").alias("id"))
    return op.keep_ids(table(spark, sf_dir, "all_instances_metadata").select("record_id", "id"), ids, "id")


@_R.add("filter_p02_non_empty", "SELECT analysis_id FROM log_analysis WHERE coalesce(len(error_context), 0) > 0 AND coalesce(len(relevant_files), 0) > 0")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "log_analysis")
    return rows.filter(op.non_empty(F.col("error_context")) & op.non_empty(F.col("relevant_files"))).select("analysis_id")


@_R.add("filter_p03_id_slice", "SELECT repo, workflow_file FROM repo_catalog WHERE regexp_matches(repo, '^(?:[a-m])') ORDER BY repo LIMIT 20 OFFSET 10")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.id_slice(table(spark, sf_dir, "repo_catalog").select("repo", "workflow_file"), "repo", "[a-m]", 10, 30)


@_R.add(
    "filter_p04_repo",
    """SELECT record_id, repo FROM all_instances_metadata WHERE contains(lower(repo), 'zan') AND contains(lower(repo), 'zanrest/open')
OR contains(split_part(lower(repo), '/', -1), 'lib') OR (contains('lib', split_part(lower(repo), '/', -1)) AND split_part(lower(repo), '/', -1) <> '')""",
)
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "all_instances_metadata").select("record_id", "repo")
    return rows.filter(op.matches_repo(F.col("repo"), ["zanrest/open", "lib"]))


@_R.add("filter_p05_aliases", "SELECT loaded_at, instance_id AS id, diff AS patch, CAST(NULL AS VARCHAR) AS note FROM diff_output")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "diff_output").drop("diff_id", "model", "created_at")
    return op.resolve_aliases(rows, {"id": ["id", "instance_id", "issue_id"], "patch": ["patch", "diff", "diff_fix"], "note": ["note", "comment"]})


@_R.add("filter_p06_id_equality", "SELECT count(*) AS n FROM diff_output d JOIN (SELECT DISTINCT trim(id) AS id FROM failed_jobs_summary) f ON trim(CAST(d.instance_id AS VARCHAR)) = f.id")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "failed_jobs_summary").select(op.id_text(F.col("id")).alias("k")).distinct()
    return table(spark, sf_dir, "diff_output").select(op.id_text(F.col("instance_id")).alias("k")).join(ids, "k").agg(F.count("*").alias("n"))


@_R.add("filter_p07_conclusions", f"WITH {base.JOBS_SQL} SELECT lower(trim(coalesce(conclusion, ''))) AS conclusion, count(*) AS n FROM job GROUP BY 1")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.jobs(spark, sf_dir).groupBy(op.plain(F.col("conclusion")).alias("conclusion")).agg(F.count("*").alias("n"))


@_R.add(
    "filter_p10_precedence",
    f"""WITH {base.JOBS_SQL}, v AS (SELECT record_id, commit_pos, list(DISTINCT conclusion) AS vs FROM job WHERE conclusion IS NOT NULL GROUP BY 1, 2)
SELECT record_id, commit_pos, CASE WHEN list_contains(vs, 'failure') THEN 'failure' WHEN list_contains(vs, 'timed_out') THEN 'timed_out' WHEN list_contains(vs, 'cancelled') THEN 'cancelled' WHEN list_contains(vs, 'success') THEN 'success' ELSE 'unknown' END AS overall FROM v""",
)
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall conclusion of a commit's jobs by precedence."""
    sets = base.jobs(spark, sf_dir).filter("conclusion is not null").groupBy("record_id", "commit_pos").agg(F.collect_set("conclusion").alias("vs"))
    return sets.select("record_id", "commit_pos", op.first_by_precedence(F.col("vs"), ["failure", "timed_out", "cancelled", "success"], "unknown").alias("overall"))


@_R.add("filter_p12_buckets", f"WITH {base.JOBS_SQL} SELECT CASE WHEN conclusion IN ('success') THEN 'good' WHEN conclusion IN ('failure', 'timed_out') THEN 'bad' ELSE 'open' END AS bucket, count(*) AS n FROM job GROUP BY 1")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = op.bucket(F.col("conclusion"), {"good": ["success"], "bad": ["failure", "timed_out"]}, "open")
    return base.jobs(spark, sf_dir).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


_RULES = [("^post ", "post"), ("cleanup|clean up", "cleanup"), ("^(set up|install)", "setup")]
_RULE_SQL = "CASE WHEN lower(trim({x})) = 'complete job' THEN 'exact' WHEN regexp_matches({x}, '(?i)^post ') THEN 'post' WHEN regexp_matches({x}, '(?i)cleanup|clean up') THEN 'cleanup' WHEN regexp_matches({x}, '(?i)^(set up|install)') THEN 'setup' END"


@_R.add(
    "filter_p13_step_rules",
    f"""WITH {base.JOBS_SQL}, st AS (SELECT unnest(steps) AS s FROM job) SELECT s AS step_name, {_RULE_SQL.format(x="s")} AS reason, count(*) AS n FROM st WHERE s IS NOT NULL GROUP BY 1, 2""",
)
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = base.jobs(spark, sf_dir).select(F.explode("steps").alias("step_name")).filter("step_name is not null")
    return steps.groupBy("step_name", op.first_rule(F.col("step_name"), {"complete job": "exact"}, _RULES).alias("reason")).agg(F.count("*").alias("n"))


@_R.add(
    "filter_p15_partitioned_steps",
    f"""WITH {base.JOBS_SQL}, r AS (SELECT record_id, commit_pos, job_pos, steps FROM job)
SELECT record_id, commit_pos, job_pos, list_filter(steps, lambda x: x IS NOT NULL AND ({_RULE_SQL.format(x="x")}) IS NULL) AS kept,
  list_transform(list_filter(steps, lambda x: ({_RULE_SQL.format(x="x")}) IS NOT NULL), lambda x: {{'name': x, 'reason': {_RULE_SQL.format(x="x")}}}) AS excluded FROM r""",
)
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a job kept and excluded with reason."""
    kept, excluded = op.partition_array(F.col("steps"), lambda x: op.first_rule(x, {"complete job": "exact"}, _RULES))
    return base.jobs(spark, sf_dir).select("record_id", "commit_pos", "job_pos", kept.alias("kept"), excluded.alias("excluded"))


@_R.add("filter_p14_jobs", f"WITH {base.JOBS_SQL} SELECT record_id, commit_pos, job_pos, job_name FROM job WHERE NOT regexp_matches(job_name, '(?i)lint|docs')")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.jobs(spark, sf_dir).filter(~F.col("job_name").rlike("(?i)lint|docs")).select("record_id", "commit_pos", "job_pos", "job_name")


@_R.add("filter_p16_valid_ends", "SELECT record_id FROM all_instances_metadata WHERE commits IS NOT NULL AND len(commits) > 0 AND commits[1].commit_type = 'fail' AND list_extract(commits, len(commits)).workflow_conclusion = 'success'")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = op.ends_valid(F.col("commits"), lambda c: c["commit_type"] == "fail", lambda c: c["workflow_conclusion"] == "success")
    return table(spark, sf_dir, "all_instances_metadata").filter(ok).select("record_id")


@_R.add("filter_p17_clean_keys", "SELECT DISTINCT trim(repo) AS repo, trim(lang) AS lang FROM documents WHERE trim(repo) <> '' AND trim(lang) <> ''")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.clean_keys(table(spark, sf_dir, "documents"), "repo", "lang")


_SEEN_SQL = "SELECT DISTINCT r.file AS path FROM (SELECT unnest(relevant_files) AS r FROM log_analysis)"


@_R.add("filter_p18_candidates", f"SELECT path FROM ({_SEEN_SQL}) WHERE path IS NOT NULL AND NOT contains(path, '://') AND NOT starts_with(path, '.github/') AND path NOT IN (SELECT path FROM parsed_file WHERE path IS NOT NULL)")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by an analysis that no diff has touched."""
    paths = table(spark, sf_dir, "log_analysis").select(F.explode("relevant_files.file").alias("path")).filter("path is not null and not contains(path, '://') and not startswith(path, '.github/')").distinct()
    return paths.join(table(spark, sf_dir, "parsed_file").select("path"), "path", "left_anti")


@_R.add("filter_p19_renamed_fields", "SELECT id, loaded_at, list_transform(failed_jobs, lambda x: {'name': x.job_name, 'steps': x.step_names}) AS jobs FROM failed_jobs_summary WHERE failed_jobs IS NOT NULL AND len(list_filter(failed_jobs, lambda x: x IS NULL)) = 0")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "failed_jobs_summary").filter("failed_jobs is not null and not exists(failed_jobs, x -> x is null)")
    return rows.select("id", "loaded_at", op.rename_in_array(F.col("failed_jobs"), {"name": "job_name", "steps": "step_names"}).alias("jobs"))


_ROLE_SQL = "CASE WHEN contains('/' || lower(path), '/test_') OR contains('/' || lower(path), '/tests/') OR contains('/' || lower(path), '_test.') THEN 'test' WHEN regexp_matches(lower(path), '\\.(toml|yaml|yml|cfg|ini|json)$') THEN 'config' WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$') THEN 'docs' WHEN regexp_matches(lower(path), '\\.(py|ts|js|java|go|rs)$') THEN 'code' ELSE 'other' END"


@_R.add("filter_p20_roles", f"SELECT {_ROLE_SQL} AS role, count(*) AS n FROM parsed_file WHERE path IS NOT NULL GROUP BY 1")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_file").filter("path is not null").groupBy(op.file_role(F.col("path")).alias("role")).agg(F.count("*").alias("n"))


_EDGES = [0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 1.0]


@_R.add("filter_p21_bands", " UNION ALL ".join(f"SELECT {i} AS band, CAST({a} AS DOUBLE) AS low, count(*) AS n FROM lineitem WHERE l_discount >= {a} AND l_discount < {b}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))))
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.band_counts(table(spark, sf_dir, "lineitem"), F.col("l_discount"), _EDGES)


@_R.add("filter_p22_path_like", "SELECT analysis_id, r.file AS file FROM (SELECT analysis_id, unnest(relevant_files) AS r FROM log_analysis) WHERE NOT regexp_matches(r.file, '[\\s|&;<>$`]') AND NOT contains(r.file, '://') AND (contains(r.file, '/') OR regexp_matches(lower(r.file), '\\.(py|md)$'))")
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "log_analysis").select("analysis_id", F.explode("relevant_files.file").alias("file"))
    return rows.filter(op.looks_like_path(F.col("file"), [".py", ".md"]))


@_R.add("filter_p23_fits_window", "SELECT call_id FROM (SELECT DISTINCT call_id, input_tokens, output_tokens FROM llm_call_record) WHERE input_tokens + output_tokens + least(10000, CAST(floor(8000 * 0.02) AS BIGINT)) <= 8000")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "llm_call_record").select("call_id", "input_tokens", "output_tokens").distinct()
    return rows.filter(op.fits_window(F.col("input_tokens"), F.col("output_tokens"), 8000)).select("call_id")


@_R.add("filter_p24_conflicts", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'import|function') AND regexp_matches(lower(text), 'config|yaml')")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(op.has_both(F.col("text"), ["import", "function"], ["config", "yaml"])).select("doc_id")


@_R.add(
    "filter_p25_completeness",
    """SELECT c.repo, count(DISTINCT m.record_id) AS n_records, count(DISTINCT f.id) AS n_summaries,
  CASE WHEN count(DISTINCT m.record_id) > 0 AND count(DISTINCT f.id) > 0 THEN 'complete' WHEN count(DISTINCT m.record_id) > 0 OR count(DISTINCT f.id) > 0 THEN 'partial' ELSE 'missing' END AS state
FROM repo_catalog c LEFT JOIN (SELECT DISTINCT repo, record_id FROM all_instances_metadata) m ON c.repo = m.repo LEFT JOIN (SELECT DISTINCT repo, id FROM failed_jobs_summary) f ON c.repo = f.repo GROUP BY 1""",
)
def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the expected tables each repository is in. Counted before joining, so no rows multiply."""
    records = table(spark, sf_dir, "all_instances_metadata").groupBy("repo").agg(F.count_distinct("record_id").alias("n_records"))
    summaries = table(spark, sf_dir, "failed_jobs_summary").groupBy("repo").agg(F.count_distinct("id").alias("n_summaries"))
    rows = table(spark, sf_dir, "repo_catalog").select("repo").distinct().join(records, "repo", "left").join(summaries, "repo", "left").fillna(0)
    has = (F.col("n_records") > 0).cast("int") + (F.col("n_summaries") > 0).cast("int")
    return rows.withColumn("state", F.when(has == 2, "complete").when(has == 1, "partial").otherwise("missing"))
