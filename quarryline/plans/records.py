"""Queries of problems 3 (nested records) and 4 (rows that fail to parse)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.nested import NestedTables, flatten_commits
from quarryline.operators.strict_load import Loaded, strict_load
from quarryline.plans.registry import Registry
from quarryline.session import table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql


def _nested(spark: SparkSession, sf_dir: str) -> NestedTables:
    return flatten_commits(table(spark, sf_dir, "all_instances_metadata"))


def _loaded(spark: SparkSession, sf_dir: str) -> Loaded:
    return strict_load(table(spark, sf_dir, "jobs_ids_diff"))


#: The same tables by DuckDB's JSON functions.
_NESTED_SQL = """
WITH src AS (
  SELECT record_id, CASE WHEN commits IS NOT NULL THEN to_json(commits) ELSE TRY_CAST(commits_json AS JSON) END AS doc FROM all_instances_metadata
), cl AS (
  SELECT record_id, CASE WHEN json_type(doc) = 'ARRAY' THEN CAST(doc AS JSON[]) ELSE [doc] END AS lst FROM src WHERE doc IS NOT NULL AND json_type(doc) <> 'NULL'
), c AS (
  SELECT record_id, i - 1 AS commit_pos, lst[i] AS c FROM (SELECT record_id, lst, unnest(range(1, len(lst) + 1)) AS i FROM cl)
  WHERE lst[i] IS NOT NULL AND json_type(lst[i]) <> 'NULL'
), jl0 AS (
  SELECT record_id, commit_pos, CASE WHEN coalesce(json_type(c, '$.failed_validation_jobs'), 'NULL') <> 'NULL' THEN json_extract(c, '$.failed_validation_jobs') ELSE json_extract(c, '$.failed_jobs') END AS doc FROM c
), jl AS (
  SELECT record_id, commit_pos, CASE WHEN json_type(doc) = 'ARRAY' THEN CAST(doc AS JSON[]) ELSE [doc] END AS lst FROM jl0 WHERE doc IS NOT NULL AND json_type(doc) <> 'NULL'
), j AS (
  SELECT record_id, commit_pos, i - 1 AS job_pos, lst[i] AS j FROM (SELECT *, unnest(range(1, len(lst) + 1)) AS i FROM jl)
  WHERE lst[i] IS NOT NULL AND json_type(lst[i]) <> 'NULL'
), sl0 AS (
  SELECT record_id, commit_pos, job_pos, CASE WHEN coalesce(json_type(j, '$.failed_validation_step_names'), 'NULL') <> 'NULL' THEN json_extract(j, '$.failed_validation_step_names') ELSE json_extract(j, '$.step_names') END AS doc FROM j
), sl AS (
  SELECT record_id, commit_pos, job_pos, CASE WHEN json_type(doc) = 'ARRAY' THEN CAST(doc AS JSON[]) ELSE [doc] END AS lst FROM sl0 WHERE doc IS NOT NULL AND json_type(doc) <> 'NULL'
), s0 AS (
  SELECT record_id, commit_pos, job_pos, i - 1 AS step_pos, lst[i] AS s FROM (SELECT *, unnest(range(1, len(lst) + 1)) AS i FROM sl)
), s AS (
  SELECT record_id, commit_pos, job_pos, step_pos,
    CASE WHEN json_type(s) = 'OBJECT' THEN json_extract_string(s, '$.name') WHEN json_type(s) = 'NULL' THEN NULL ELSE json_extract_string(s, '$') END AS step_name,
    CASE WHEN json_type(s) = 'OBJECT' THEN CAST(json_extract_string(s, '$.number') AS INTEGER) END AS step_number,
    CASE json_type(s) WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'text' ELSE 'other' END AS variant FROM s0
), st AS (SELECT * FROM s WHERE regexp_replace(step_name, '\\s+', '', 'g') <> '')
"""


@_R.add(
    "p3_found",
    _NESTED_SQL
    + """SELECT record_id, 'commit' AS node, CAST(commit_pos AS INTEGER) AS commit_pos, -1 AS job_pos, -1 AS step_pos FROM c
UNION ALL SELECT record_id, 'job', CAST(commit_pos AS INTEGER), CAST(job_pos AS INTEGER), -1 FROM j
UNION ALL SELECT record_id, 'step', CAST(commit_pos AS INTEGER), CAST(job_pos AS INTEGER), CAST(step_pos AS INTEGER) FROM st""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).nodes()


#: The variants by grouping: a list's name and container, and what its children are.
_VARIANTS_SQL = (
    _NESTED_SQL
    + """, ty AS (SELECT record_id, commits IS NOT NULL AS typed FROM all_instances_metadata),
sk AS (SELECT record_id, commit_pos, job_pos, CASE json_type(s) WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'text' ELSE 'other' END AS kind
  FROM s JOIN s0 USING (record_id, commit_pos, job_pos, step_pos) WHERE regexp_replace(step_name, '\\s+', '', 'g') <> ''),
jk AS (SELECT j.record_id, j.commit_pos, j.job_pos, any_value(j.j) AS j, CASE count(DISTINCT sk.kind) WHEN 0 THEN 'none' WHEN 1 THEN min(sk.kind) ELSE 'mixed' END AS kids
  FROM j LEFT JOIN sk USING (record_id, commit_pos, job_pos) GROUP BY 1, 2, 3),
jv AS (SELECT jk.*, CASE WHEN typed THEN 'typed' WHEN coalesce(json_type(j, '$.failed_validation_step_names'), 'NULL') <> 'NULL' THEN 'failed_validation_step_names' WHEN coalesce(json_type(j, '$.step_names'), 'NULL') <> 'NULL' THEN 'step_names' ELSE 'none' END AS list_name,
  coalesce(nullif(json_type(j, '$.failed_validation_step_names'), 'NULL'), nullif(json_type(j, '$.step_names'), 'NULL')) AS box FROM jk JOIN ty USING (record_id)),
ck AS (SELECT c.record_id, c.commit_pos, any_value(c.c) AS c, CASE count(DISTINCT nullif(jk.kids, 'none')) WHEN 0 THEN 'none' WHEN 1 THEN min(nullif(jk.kids, 'none')) ELSE 'mixed' END AS kids FROM c LEFT JOIN jk USING (record_id, commit_pos) GROUP BY 1, 2),
cv AS (SELECT ck.*, CASE WHEN typed THEN 'typed' WHEN coalesce(json_type(c, '$.failed_validation_jobs'), 'NULL') <> 'NULL' THEN 'failed_validation_jobs' WHEN coalesce(json_type(c, '$.failed_jobs'), 'NULL') <> 'NULL' THEN 'failed_jobs' ELSE 'none' END AS list_name,
  coalesce(nullif(json_type(c, '$.failed_validation_jobs'), 'NULL'), nullif(json_type(c, '$.failed_jobs'), 'NULL')) AS box FROM ck JOIN ty USING (record_id))
"""
)
_BOX = "CASE WHEN box IS NULL THEN 'absent' WHEN box = 'ARRAY' THEN 'list' ELSE 'bare' END"
_SPELLINGS = (
    "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%g%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y/%m/%d",
    "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%d.%m.%Y", "%d/%m/%Y %H:%M:%S", "%Y%m%dT%H%M%S%z", "%Y%m%dT%H%M%S", "%Y-%m-%d",
)
_DATE_SQL = "coalesce(" + ", ".join(f"CAST(try_strptime(d, '{x}') AS TIMESTAMP)" for x in _SPELLINGS) + ", CASE WHEN regexp_full_match(d, '[0-9]{9,10}') THEN make_timestamp(CAST(d AS BIGINT) * 1000000) END)"


@_R.add(
    "p3_commits",
    _VARIANTS_SQL
    + f""", cd AS (SELECT cv.*, regexp_replace(trim(json_extract_string(c, '$.commit_date')), 'Z$', '+00:00') AS d FROM cv)
SELECT record_id, CAST(commit_pos AS INTEGER) AS commit_pos, id, json_extract_string(c, '$.original_commit') AS original_commit, json_extract_string(c, '$.commit_type') AS commit_type, json_extract_string(c, '$.commit_date') AS commit_date,
  TRY_CAST(json_extract_string(c, '$.workflow_run_id') AS BIGINT) AS workflow_run_id, json_extract_string(c, '$.workflow_conclusion') AS workflow_conclusion, TRY_CAST(json_extract_string(c, '$.pending') AS BOOLEAN) AS pending,
  {_DATE_SQL} AS committed_at, list_name || '/' || {_BOX} || '/' || kids AS variant FROM cd JOIN (SELECT record_id, id FROM all_instances_metadata) USING (record_id)""",
)
def p3_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).commits()


@_R.add(
    "p3_jobs",
    _NESTED_SQL
    + """SELECT record_id, CAST(commit_pos AS INTEGER) AS commit_pos, CAST(job_pos AS INTEGER) AS job_pos, TRY_CAST(json_extract_string(j, '$.job_id') AS BIGINT) AS job_id,
  json_extract_string(j, '$.job_name') AS job_name, json_extract_string(j, '$.runner_name') AS runner_name, json_extract_string(j, '$.failure_evidence') AS failure_evidence,
  TRY_CAST(json_extract_string(j, '$.failed_validation_steps_count') AS INTEGER) AS failed_validation_steps_count FROM j""",
)
def p3_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).jobs().drop("variant")


@_R.add(
    "p3_steps",
    _NESTED_SQL + "SELECT record_id, CAST(commit_pos AS INTEGER) AS commit_pos, CAST(job_pos AS INTEGER) AS job_pos, CAST(step_pos AS INTEGER) AS step_pos, step_name, step_number, variant FROM st",
)
def p3_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).steps()


@_R.add("p3_variants", _VARIANTS_SQL + f"SELECT list_name || '/' || {_BOX} || '/' || kids AS variant, count(*) AS n_jobs FROM jv GROUP BY 1")
def p3_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs each structural variant has."""
    return _nested(spark, sf_dir).jobs().groupBy("variant").agg(F.count("*").alias("n_jobs"))


@_R.add("p3_steps_from_objects", _NESTED_SQL + "SELECT record_id, CAST(commit_pos AS INTEGER) AS commit_pos, CAST(job_pos AS INTEGER) AS job_pos, CAST(step_pos AS INTEGER) AS step_pos, step_name, step_number, variant FROM st WHERE variant = 'object'")
def p3_steps_from_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtype table of steps that came as objects."""
    return _nested(spark, sf_dir).subtypes()["step_object"]


#: A line's texts and kind; JSON by its grammar (DuckDB also takes commas before an end and NaN, so what is left without the strings is looked at), CSV by one pattern.
_LINES_SQL = """
WITH ln AS (
  SELECT line_id, file_name, line_no, raw_line, CASE WHEN ends_with(lower(file_name), '.jsonl') THEN 'jsonl' WHEN ends_with(lower(file_name), '.csv') THEN 'csv' END AS kind,
    regexp_replace(raw_line, '\\r$', '') AS l, regexp_replace(raw_line, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g') AS bare
  FROM jobs_ids_diff WHERE regexp_matches(raw_line, '[^ \\t]')
), js AS (
  SELECT *, json_valid(raw_line) AND NOT regexp_matches(bare, ',\\s*[\\]}]') AND NOT regexp_matches(lower(bare), 'nan|inf') AND CASE WHEN json_valid(raw_line) THEN json_type(raw_line) END = 'OBJECT' AS ok
  FROM ln WHERE kind = 'jsonl'
), jf AS (
  SELECT line_id, file_name, line_no, raw_line, coalesce(ok, false) AS ok, CASE WHEN ok THEN list_sort(json_keys(raw_line)) = ['commit', 'conclusion', 'id', 'patch_applied', 'repo_name', 'sha_original', 'status', 'url', 'workflow'] END AS whole,
    CASE WHEN ok THEN list_transform(['id', 'repo_name', 'url', 'workflow', 'status', 'conclusion', 'patch_applied', 'sha_original', 'commit'], lambda k: json_extract_string(raw_line, '$.' || k)) END AS v,
    CASE WHEN ok THEN coalesce(json_type(raw_line, '$.status'), 'NULL') IN ('NULL', 'VARCHAR') END AS s_text, CASE WHEN ok THEN coalesce(json_type(raw_line, '$.conclusion'), 'NULL') IN ('NULL', 'VARCHAR') END AS c_text
  FROM js
), cs AS (
  SELECT *, regexp_full_match(l, '(?s)(?:"[^"]*(?:""[^"]*)*"|[^",]*)(?:,(?:"[^"]*(?:""[^"]*)*"|[^",]*))*') AS ok FROM ln WHERE kind = 'csv'
), cf AS (
  SELECT line_id, file_name, line_no, raw_line, ok, CASE WHEN ok THEN list_transform(regexp_extract_all(',' || l, '(?s),("[^"]*(?:""[^"]*)*"|[^",]*)', 1), lambda f: nullif(CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END, '')) END AS v FROM cs
), f AS (
  SELECT line_id, file_name, line_no, raw_line, ok, whole, v, s_text, c_text FROM jf
  UNION ALL SELECT line_id, file_name, line_no, raw_line, ok, len(v) = 9, v, true, true FROM cf
  UNION ALL SELECT line_id, file_name, line_no, raw_line, false, NULL, NULL, NULL, NULL FROM ln WHERE kind IS NULL
), g AS (
  SELECT *, CASE WHEN NOT ok THEN 'broken_record' WHEN NOT whole THEN 'field_count'
    WHEN NOT s_text OR lower(trim(v[5])) NOT IN ('', 'queued', 'in_progress', 'completed', 'waiting') THEN 'bad_status'
    WHEN NOT c_text OR lower(trim(v[6])) NOT IN ('', 'success', 'failure', 'cancelled', 'timed_out', 'waiting', 'error') THEN 'bad_conclusion' END AS reason FROM f
)
"""


@_R.add("p3_rejects", "SELECT record_id, id, 'unparsable' AS reason, commits_json FROM all_instances_metadata WHERE commits IS NULL AND commits_json IS NOT NULL AND TRY_CAST(commits_json AS JSON) IS NULL")
def p3_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text is no JSON."""
    return _nested(spark, sf_dir).rejects()


@_R.add("p4_found", _LINES_SQL + "SELECT line_id, reason FROM g WHERE reason IS NOT NULL")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).rejects.select("line_id", "reason")


@_R.add(
    "p4_rows",
    _LINES_SQL
    + """SELECT line_id, file_name, line_no, trim(v[1]) AS id, trim(v[2]) AS repo_name, trim(v[3]) AS url, trim(v[4]) AS workflow, nullif(lower(trim(v[5])), '') AS status, nullif(lower(trim(v[6])), '') AS conclusion,
  CASE WHEN lower(trim(v[7])) IN ('true', 'false') THEN lower(trim(v[7])) = 'true' END AS patch_applied, trim(v[8]) AS sha_original, trim(v[9]) AS commit FROM g WHERE reason IS NULL""",
)
def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).rows


@_R.add("p4_rejects", _LINES_SQL + "SELECT line_id, file_name, line_no, raw_line, reason FROM g WHERE reason IS NOT NULL")
def p4_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).rejects
