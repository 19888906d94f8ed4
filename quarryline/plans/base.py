"""Relations that several plan modules start from, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.nested import all_runs
from quarryline.session import table

def _list_sql(of: str) -> str:
    """A JSON value as a list of its elements, a bare value as a list of one."""
    return f"CASE WHEN {of} IS NULL OR json_type({of}) = 'NULL' THEN NULL WHEN json_type({of}) = 'ARRAY' THEN CAST({of} AS JSON[]) ELSE [{of}] END"


def _first_sql(of: str, *names: str) -> str:
    """The first of the named members that is not null."""
    a, b = names
    return f"CASE WHEN coalesce(json_type({of}, '$.{a}'), 'NULL') <> 'NULL' THEN json_extract({of}, '$.{a}') ELSE json_extract({of}, '$.{b}') END"


_TEXTS = ("job_name", "status", "conclusion", "started_at", "completed_at")
#: One row per commit (null ones with a null c) of both collectors, and without the null ones.
COMMITS_SQL = f"""cdoc AS (SELECT record_id, id, repo, {_list_sql("d")} AS lst FROM (SELECT record_id, id, repo, TRY_CAST(commits_json AS JSON) AS d FROM all_instances_metadata WHERE commits IS NULL)),
cold AS (SELECT record_id, id, repo, pos, lst[pos + 1] AS e FROM (SELECT *, unnest(range(len(lst))) AS pos FROM cdoc WHERE lst IS NOT NULL)),
call_ AS (
  SELECT record_id, id, repo, pos, CASE WHEN x IS NOT NULL THEN {{'commit_type': x.commit_type, 'commit_date': x.commit_date, 'workflow_conclusion': x.workflow_conclusion,
    'validation_jobs': list_transform(x.validation_jobs, lambda j: CASE WHEN j IS NOT NULL THEN {{'job_id': j.job_id, {", ".join(f"'{t}': j.{t}" for t in _TEXTS)}, 'validation_step_names': j.validation_step_names}} END)}} END AS c
  FROM (SELECT record_id, id, repo, pos, commits[pos + 1] AS x FROM (SELECT record_id, id, repo, commits, unnest(range(len(commits))) AS pos FROM all_instances_metadata WHERE commits IS NOT NULL))
  UNION ALL SELECT record_id, id, repo, pos, CASE WHEN e IS NOT NULL AND json_type(e) <> 'NULL' THEN {{'commit_type': json_extract_string(e, '$.commit_type'), 'commit_date': json_extract_string(e, '$.commit_date'), 'workflow_conclusion': json_extract_string(e, '$.workflow_conclusion'),
    'validation_jobs': list_transform(js, lambda j: CASE WHEN json_type(j) <> 'NULL' THEN {{'job_id': TRY_CAST(json_extract_string(j, '$.job_id') AS BIGINT), {", ".join(f"'{t}': json_extract_string(j, '$.{t}')" for t in _TEXTS)},
      'validation_step_names': list_transform({_list_sql("(" + _first_sql("j", "validation_step_names", "step_names") + ")")}, lambda s: CASE json_type(s) WHEN 'OBJECT' THEN json_extract_string(s, '$.name') WHEN 'NULL' THEN NULL ELSE json_extract_string(s, '$') END)}} END)}} END
  FROM (SELECT record_id, id, repo, pos, e, {_list_sql("v")} AS js FROM (SELECT *, {_first_sql("e", "validation_jobs", "overall_jobs")} AS v FROM cold))),
com AS (SELECT record_id, id, repo, pos AS commit_pos, c FROM call_ WHERE c IS NOT NULL)"""
#: One row per validation job.
JOBS_SQL = (
    COMMITS_SQL
    + """, job AS (
  SELECT record_id, id, repo, commit_pos, pos AS job_pos, c.commit_type AS commit_type, j.job_id AS job_id, j.job_name AS job_name, j.status AS status, j.conclusion AS conclusion,
    j.started_at AS started_at, j.completed_at AS completed_at, j.validation_step_names AS steps
  FROM (SELECT record_id, id, repo, commit_pos, c, pos, c.validation_jobs[pos + 1] AS j FROM (
    SELECT record_id, id, repo, commit_pos, c, unnest(range(len(c.validation_jobs))) AS pos FROM com WHERE c.validation_jobs IS NOT NULL)) WHERE j IS NOT NULL)"""
)
#: One row per instance and distinct label.
LABELS_SQL = """lab AS (
  SELECT DISTINCT instance_id AS id, trim(e.category) AS label FROM (SELECT instance_id, unnest(error_types) AS e FROM log_analysis)
  WHERE instance_id IS NOT NULL AND trim(e.category) <> '')"""
#: Instances with a completed last commit, and whether it succeeded.
OUTC_SQL = """outc AS (
  SELECT id, bool_or(last_conclusion = 'success') AS ok FROM (SELECT record_id, id, list(c ORDER BY pos)[-1].workflow_conclusion AS last_conclusion FROM call_ GROUP BY 1, 2)
  WHERE id IS NOT NULL AND last_conclusion IS NOT NULL GROUP BY id)"""
OUTCOMES_SQL = f"{COMMITS_SQL}, {OUTC_SQL}"
#: Calls once each.
CALLS_SQL = "call AS (SELECT DISTINCT * FROM llm_call_record)"


def runs(spark: SparkSession, sf_dir: str, with_jobs: bool = False) -> DataFrame:
    """record_id, id, repo and the commits of both collectors."""
    return all_runs(table(spark, sf_dir, "all_instances_metadata"), "record_id", "id", "repo", with_jobs=with_jobs)


def commits(spark: SparkSession, sf_dir: str, with_jobs: bool = False) -> DataFrame:
    rows = runs(spark, sf_dir, with_jobs).select("record_id", "id", "repo", F.posexplode("commits").alias("commit_pos", "c"))
    return rows.filter("c is not null").withColumn("commit_pos", F.col("commit_pos").cast("bigint"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commits(spark, sf_dir, True).select("record_id", "id", "repo", "commit_pos", F.col("c.commit_type").alias("commit_type"), F.posexplode("c.jobs").alias("job_pos", "j")).filter("j is not null")
    names = ("job_id", "job_name", "status", "conclusion", "started_at", "completed_at", "steps")
    return rows.select("record_id", "id", "repo", "commit_pos", F.col("job_pos").cast("bigint").alias("job_pos"), "commit_type", *[F.col(f"j.{n}").alias(n) for n in names])


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "log_analysis").filter("instance_id is not null").select(F.col("instance_id").alias("id"), F.explode("error_types").alias("e"))
    return rows.select("id", F.trim("e.category").alias("label")).filter("label <> ''").distinct()


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.try_element_at("commits", F.lit(-1))["workflow_conclusion"]
    rows = runs(spark, sf_dir).select("id", last.alias("last")).filter("id is not null and last is not null")
    return rows.groupBy("id").agg(F.bool_or(F.col("last") == "success").alias("ok"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "llm_call_record").distinct()


def money(x: Column) -> Column:
    """A sum that does not depend on the order of its terms."""
    return F.sum(F.when(~F.isnan(x), x).cast("decimal(20,6)")).cast("double")


def money_sql(x: str) -> str:
    return f"CAST(sum(CASE WHEN NOT isnan({x}) THEN CAST({x} AS DECIMAL(20,6)) END) AS DOUBLE)"
