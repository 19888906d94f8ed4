"""Queries of label curation and updates (L of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import labels as op
from quarryline.plans import base
from quarryline.plans.registry import Registry
from quarryline.session import table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
_J = base.JOBS_SQL
_SYN = {"Test Failure": ["test failure", "tests", "unit test"], "Dependency Error": ["dependency error", "deps"]}


@_R.add("l01_canonical_labels", "SELECT CASE WHEN lower(trim(e.category)) IN ('test failure', 'tests', 'unit test') THEN 'Test Failure' WHEN lower(trim(e.category)) IN ('dependency error', 'deps') THEN 'Dependency Error' ELSE trim(e.category) END AS label, count(*) AS n FROM (SELECT unnest(error_types) AS e FROM log_analysis) WHERE e.category IS NOT NULL GROUP BY 1")
def l01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "log_analysis").select(F.explode("error_types.category").alias("c")).filter("c is not null")
    return rows.groupBy(op.canonical(F.col("c"), _SYN).alias("label")).agg(F.count("*").alias("n"))


@_R.add(
    "l02_aligned_distinct",
    """WITH d AS (SELECT DISTINCT * FROM log_analysis WHERE error_types IS NOT NULL), c AS (SELECT analysis_id, list_transform(error_types, lambda e: {'raw': trim(coalesce(e.category, '')), 'sub': coalesce(e.subcategory, '')}) AS z FROM d),
k AS (SELECT analysis_id, list_filter(list_transform(z, lambda x: {'label': CASE WHEN lower(x.raw) IN ('test failure', 'tests', 'unit test') THEN 'Test Failure' WHEN lower(x.raw) IN ('dependency error', 'deps') THEN 'Dependency Error' ELSE x.raw END, 'sub': x.sub}), lambda y: y.label <> '') AS k FROM c)
SELECT analysis_id, list_filter(k, lambda y, i: list_position(list_transform(k, lambda u: u.label), y.label) = i) AS pairs FROM k""",
)
def l02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical labels of an analysis with their sub-labels, first of each."""
    rows = table(spark, sf_dir, "log_analysis").filter("error_types is not null").distinct()
    return rows.select("analysis_id", op.aligned_distinct(F.transform("error_types", lambda e: F.coalesce(e["category"], F.lit(""))), F.transform("error_types", lambda e: e["subcategory"]), _SYN).alias("pairs"))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.labels(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


@_R.add(
    "l04_batch_updates",
    f"""WITH {base.LABELS_SQL}, s AS (SELECT id, list_sort(list(label)) AS labels FROM lab GROUP BY 1)
SELECT id, CASE WHEN TRY_CAST(id AS BIGINT) % 3 = 0 THEN ['Reviewed'] WHEN TRY_CAST(id AS BIGINT) % 3 = 1 THEN list_sort(list_distinct(list_concat(list_filter(labels, lambda x: x <> 'Test Failure'), ['Reviewed']))) ELSE labels END AS labels FROM s""",
)
def l04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several updates per id, applied in order."""
    ids = base.labels(spark, sf_dir).select("id").distinct()
    kind = F.col("id").try_cast("bigint") % 3
    step = lambda seq, mode, new: F.struct(F.lit(seq).alias("seq"), F.lit(mode).alias("mode"), F.array(F.lit(new)).alias("new"))
    steps = F.when(kind == 0, F.array(step(1, "add", "Draft"), step(2, "replace", "Reviewed"))).when(kind == 1, F.array(step(1, "remove", "Test Failure"), step(2, "add", "Reviewed")))
    updates = ids.select("id", F.explode(steps).alias("u")).select("id", "u.*")
    return op.apply_batch(_sets(spark, sf_dir), updates, "id", "labels").select("id", F.array_sort("labels").alias("labels"))


_KNOWN = ("Test Failure", "Linting", "Formatting", "Dependency Error", "Build Error")


@_R.add(
    "l05_violations",
    f"""WITH r AS (SELECT instance_id AS id, list_filter(list_transform(error_types, lambda e: e.category), lambda x: trim(x) <> '') AS a, list_filter(list_transform(error_types, lambda e: e.subcategory), lambda x: trim(x) <> '') AS b FROM (SELECT DISTINCT analysis_id, instance_id, error_types FROM log_analysis)),
u AS (SELECT DISTINCT id FROM all_instances_metadata)
SELECT id AS key, 'repeated' AS rule FROM r GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT id, 'missing' FROM u WHERE id IS NULL OR id NOT IN (SELECT id FROM r WHERE id IS NOT NULL)
UNION ALL SELECT id, 'extra' FROM (SELECT DISTINCT id FROM r) WHERE id IS NULL OR id NOT IN (SELECT id FROM u WHERE id IS NOT NULL)
UNION ALL SELECT id, 'empty' FROM r WHERE coalesce(len(a), 0) = 0
UNION ALL SELECT id, 'length' FROM r WHERE coalesce(len(a), 0) <> coalesce(len(b), 0)
UNION ALL SELECT id, 'unknown_label' FROM r WHERE len(list_filter(a, lambda x: x NOT IN {_KNOWN})) > 0""",
)
def l05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses against the instances: their labels and sub-labels without blanks, of which some are missing."""
    filled = lambda f: F.filter(F.transform("error_types", lambda e: e[f]), lambda x: F.trim(x) != "")
    once = table(spark, sf_dir, "log_analysis").select("analysis_id", "instance_id", "error_types").distinct()
    return op.violations(once.select(F.col("instance_id").alias("id"), filled("category").alias("a"), filled("subcategory").alias("b")), "id", "a", "b", _KNOWN, table(spark, sf_dir, "all_instances_metadata"))


@_R.add("l07_upsert", "SELECT id, repo, 'summary' AS origin FROM (SELECT DISTINCT id, repo FROM failed_jobs_summary WHERE id IS NOT NULL) UNION ALL SELECT id, repo, 'metadata' FROM all_instances_metadata WHERE id IS NULL OR id NOT IN (SELECT id FROM failed_jobs_summary WHERE id IS NOT NULL)")
def l07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L07, L08."""
    old = table(spark, sf_dir, "all_instances_metadata").select("id", "repo", F.lit("metadata").alias("origin"))
    new = table(spark, sf_dir, "failed_jobs_summary").filter("id is not null").select("id", "repo").distinct().withColumn("origin", F.lit("summary"))
    return op.upsert(old, new, ["id"])


@_R.add("l09_replace_values", "SELECT m.record_id, coalesce(s.wf, m.workflow_name) AS workflow_name FROM all_instances_metadata m LEFT JOIN (SELECT id, min(workflow_name) AS wf FROM failed_jobs_summary GROUP BY 1) s ON m.id = s.id")
def l09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L06, L09."""
    new = table(spark, sf_dir, "failed_jobs_summary").filter("workflow_name is not null").select("id", "workflow_name")
    return op.replace_values(table(spark, sf_dir, "all_instances_metadata").select("record_id", "id", "workflow_name"), new, "id", ["workflow_name"]).select("record_id", "workflow_name")


@_R.add("l10_label_cells", "SELECT call_id, CASE WHEN metadata IS NULL OR trim(metadata) = '' THEN [] ELSE [trim(metadata)] END AS labels FROM llm_call_record WHERE metadata IS NULL OR NOT starts_with(trim(metadata), '[')")
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "llm_call_record").filter("metadata is null or not startswith(trim(metadata), '[')").select("call_id", op.label_cell(F.col("metadata")).alias("labels"))


@_R.add("l11_failed_steps_or_first", f"WITH {_J} SELECT record_id, commit_pos, job_pos, CASE WHEN len(list_filter(coalesce(steps, []), lambda x: list_contains(['Run tests', 'Check formatting'], x))) > 0 THEN list_filter(steps, lambda x: list_contains(['Run tests', 'Check formatting'], x)) ELSE steps[1:1] END AS failed FROM job")
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.array(F.lit("Run tests"), F.lit("Check formatting"))
    return base.jobs(spark, sf_dir).select("record_id", "commit_pos", "job_pos", op.failed_steps_or_first(failed, F.col("steps")).alias("failed"))


@_R.add("l12_flattened_steps", f"WITH {_J} SELECT record_id, commit_pos, job_pos, job_name, CAST(pos AS INTEGER) AS step_pos, steps[pos + 1] AS step_name FROM (SELECT *, unnest(CASE WHEN coalesce(len(steps), 0) = 0 THEN [NULL] ELSE range(len(steps)) END) AS pos FROM job)")
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit, job and step rows, one with a null step for a job without steps."""
    return base.jobs(spark, sf_dir).select("record_id", "commit_pos", "job_pos", "job_name", F.posexplode_outer("steps").alias("step_pos", "step_name"))


@_R.add("l13_job_step_names", f"WITH {_J} SELECT record_id, commit_pos, conclusion, count(*) AS n FROM (SELECT record_id, commit_pos, conclusion, unnest(CASE WHEN len(list_filter(coalesce(steps, []), lambda x: trim(x) <> '')) > 0 THEN list_transform(list_filter(steps, lambda x: trim(x) <> ''), lambda x: job_name || ': ' || x) ELSE [job_name] END) AS s FROM job) WHERE s IS NOT NULL GROUP BY 1, 2, 3")
def l13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L13, L14."""
    names = base.jobs(spark, sf_dir).select("record_id", "commit_pos", "conclusion", F.explode(op.job_step_names(F.col("job_name"), F.col("steps"))).alias("s"))
    return names.filter("s is not null").groupBy("record_id", "commit_pos", "conclusion").agg(F.count("*").alias("n"))


@_R.add("l15_merged_records", f"WITH {base.COMMITS_SQL} SELECT a.record_id, coalesce(b.c.workflow_conclusion, a.c.workflow_conclusion) AS workflow_conclusion, coalesce(b.c.commit_date, a.c.commit_date) AS commit_date FROM com a JOIN com b ON a.record_id = b.record_id AND a.commit_pos = 0 AND b.commit_pos = 1")
def l15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.runs(spark, sf_dir).select("record_id", F.get("commits", F.lit(0)).alias("a"), F.get("commits", F.lit(1)).alias("b")).filter("a is not null and b is not null")
    return rows.select("record_id", op.merged_struct(F.col("a"), F.col("b"), ["workflow_conclusion", "commit_date"]).alias("m")).select("record_id", "m.*")
