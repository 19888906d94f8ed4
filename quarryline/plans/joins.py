"""Queries of joins and set operations (J and U of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import joins as op
from quarryline.operators import sets
from quarryline.plans import base
from quarryline.plans.registry import Registry
from quarryline.session import table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql


@_R.add("j01_suffixed_left_join", "SELECT c.repo, c.workflow_file AS workflow_file_x, d.workflow_file AS workflow_file_y, d.n FROM repo_catalog c LEFT JOIN (SELECT repo, min(workflow_file) AS workflow_file, count(*) AS n FROM all_instances_metadata GROUP BY 1) d ON c.repo = d.repo")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "all_instances_metadata").groupBy("repo").agg(F.min("workflow_file").alias("workflow_file"), F.count("*").alias("n"))
    return op.suffixed_join(table(spark, sf_dir, "repo_catalog").select("repo", "workflow_file"), seen, ["repo"])


_TRUTH_SQL = f"WITH {base.OUTCOMES_SQL}, {base.LABELS_SQL}"


@_R.add("j02_inner_lookup", _TRUTH_SQL + " SELECT o.id, o.ok, l.label FROM outc o JOIN lab l ON o.id = l.id")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.outcomes(spark, sf_dir).join(base.labels(spark, sf_dir), "id")


@_R.add("j04_left_default", _TRUTH_SQL + " SELECT o.id, o.ok, coalesce(l.label, 'Unknown') AS label FROM outc o LEFT JOIN lab l ON o.id = l.id")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left lookup driven by the id universe, with a default."""
    return op.lookup(base.outcomes(spark, sf_dir), base.labels(spark, sf_dir), ["id"], {"label": "Unknown"})


@_R.add(
    "j05_three_way_merge",
    """SELECT coalesce(a.id, b.id, c.id) AS id, a.n_records, b.n_summaries, c.n_diffs FROM
(SELECT id, count(*) AS n_records FROM all_instances_metadata WHERE id IS NOT NULL GROUP BY 1) a
FULL JOIN (SELECT id, count(*) AS n_summaries FROM failed_jobs_summary WHERE id IS NOT NULL GROUP BY 1) b ON a.id = b.id
FULL JOIN (SELECT instance_id AS id, count(*) AS n_diffs FROM diff_output WHERE instance_id IS NOT NULL GROUP BY 1) c ON coalesce(a.id, b.id) = c.id""",
)
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda t, k, n: table(spark, sf_dir, t).select(F.col(k).alias("id")).filter("id is not null").groupBy("id").agg(F.count("*").alias(n))
    return op.merge_records([count("all_instances_metadata", "id", "n_records"), count("failed_jobs_summary", "id", "n_summaries"), count("diff_output", "instance_id", "n_diffs")], "id")


@_R.add(
    "j07_composite_key_update",
    """SELECT m.record_id, l.analysis_id FROM all_instances_metadata m LEFT JOIN (
  SELECT instance_id, sha_fail, analysis_id FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, sha_fail ORDER BY analysis_id) AS rn FROM log_analysis) WHERE rn = 1) l ON m.id = l.instance_id AND m.sha_fail = l.sha_fail""",
)
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = op.first_per_key(table(spark, sf_dir, "log_analysis").select(F.col("instance_id").alias("id"), "sha_fail", "analysis_id"), ["id", "sha_fail"], [F.col("analysis_id")])
    return table(spark, sf_dir, "all_instances_metadata").select("record_id", "id", "sha_fail").join(first, ["id", "sha_fail"], "left").select("record_id", "analysis_id")


@_R.add(
    "j08_either_key",
    """WITH hits AS (
  SELECT d.analysis_id, m.record_id, 0 AS pair FROM (SELECT DISTINCT analysis_id, sha_fail, instance_id FROM log_analysis) d JOIN all_instances_metadata m ON d.sha_fail = m.sha_fail
  UNION ALL SELECT d.analysis_id, m.record_id, 1 FROM (SELECT DISTINCT analysis_id, sha_fail, instance_id FROM log_analysis) d JOIN all_instances_metadata m ON d.instance_id = m.id)
SELECT analysis_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY pair, record_id) AS rn FROM hits) WHERE rn = 1""",
)
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "log_analysis").select("analysis_id", F.col("sha_fail").alias("asked_sha"), "instance_id").distinct()
    records = table(spark, sf_dir, "all_instances_metadata").select("record_id", "sha_fail", "id")
    return op.either_key(asked, records, [("asked_sha", "sha_fail"), ("instance_id", "id")], "analysis_id", ["record_id"]).select("analysis_id", "record_id")


@_R.add("j09_semi_join", "SELECT DISTINCT instance_id FROM diff_output WHERE instance_id IN (SELECT instance_id FROM log_analysis)")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "diff_output").select("instance_id").distinct().join(table(spark, sf_dir, "log_analysis").select("instance_id"), "instance_id", "left_semi")


@_R.add("j10_waiting", "SELECT DISTINCT id FROM all_instances_metadata WHERE id NOT IN (SELECT instance_id FROM diff_output WHERE instance_id IS NOT NULL) AND id NOT IN (SELECT instance_id FROM log_analysis WHERE instance_id IS NOT NULL)")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in neither of two finished sets."""
    ids = lambda t: table(spark, sf_dir, t).select(F.col("instance_id").alias("id"))
    return sets.without(table(spark, sf_dir, "all_instances_metadata").select("id").distinct(), "id", ids("diff_output"), ids("log_analysis"))


@_R.add("j11_resume", "SELECT DISTINCT id FROM failed_jobs_summary WHERE id NOT IN (SELECT instance_id FROM diff_output WHERE instance_id IS NOT NULL INTERSECT SELECT instance_id FROM log_analysis WHERE instance_id IS NOT NULL)")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that have not passed all stages."""
    done = table(spark, sf_dir, "diff_output").select(F.col("instance_id").alias("id")).intersect(table(spark, sf_dir, "log_analysis").select(F.col("instance_id").alias("id")))
    return table(spark, sf_dir, "failed_jobs_summary").select("id").distinct().join(done, "id", "left_anti")


@_R.add("j15_paired_results", "SELECT a.id, a.ok AS ok_a, b.ok AS ok_b FROM (SELECT instance_id AS id, bool_or(success) AS ok FROM llm_call_record WHERE model = 'quarrel-flash' AND instance_id IS NOT NULL GROUP BY 1) a JOIN (SELECT instance_id AS id, bool_or(success) AS ok FROM llm_call_record WHERE model = 'tindra-mini' AND instance_id IS NOT NULL GROUP BY 1) b ON a.id = b.id")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "llm_call_record").filter("instance_id is not null")
    of = lambda m, n: calls.filter(F.col("model") == m).groupBy(F.col("instance_id").alias("id")).agg(F.bool_or("success").alias(n))
    return of("quarrel-flash", "ok_a").join(of("tindra-mini", "ok_b"), "id")


_EDGES_SQL = "ed AS (SELECT DISTINCT least(a.path, b.path) AS src, greatest(a.path, b.path) AS dst, a.diff_id FROM parsed_file a JOIN parsed_file b ON a.diff_id = b.diff_id AND b.file_pos = a.file_pos + 1 WHERE a.path IS NOT NULL AND b.path IS NOT NULL)"


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that follow each other in a diff: src, dst, diff_id."""
    f = table(spark, sf_dir, "parsed_file").select("diff_id", "file_pos", "path").filter("path is not null")
    nxt = f.select("diff_id", (F.col("file_pos") - 1).alias("file_pos"), F.col("path").alias("next_path"))
    return f.join(nxt, ["diff_id", "file_pos"]).select(F.least("path", "next_path").alias("src"), F.greatest("path", "next_path").alias("dst"), "diff_id").distinct()


@_R.add("j16_edges_within", f"WITH {_EDGES_SQL} SELECT diff_id, src, dst FROM ed WHERE src IN (SELECT path FROM parsed_file WHERE file_type = '.py') AND dst IN (SELECT path FROM parsed_file WHERE file_type = '.py')")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "parsed_file").filter("file_type = '.py'").select(F.col("path").alias("node"))
    return op.in_both_ends(file_edges(spark, sf_dir), nodes).select("diff_id", "src", "dst")


@_R.add(
    "j17_suffix_match",
    """WITH f AS (SELECT DISTINCT replace(replace(path, '/', '.'), '.py', '') AS name FROM parsed_file WHERE path IS NOT NULL), m AS (SELECT DISTINCT split_part(name, '.', -1) AS module FROM f UNION SELECT name FROM f)
SELECT f.name, m.module FROM f JOIN m ON f.name = m.module OR ends_with(f.name, '.' || m.module)""",
)
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names with the modules that they equal or end in, without a theta join."""
    name = F.replace(F.replace("path", F.lit("/"), F.lit(".")), F.lit(".py"), F.lit(""))
    names = table(spark, sf_dir, "parsed_file").filter("path is not null").select(name.alias("name")).distinct()
    modules = names.select(F.explode(F.array("name", F.substring_index("name", ".", -1))).alias("module")).distinct()
    return op.import_match(names, modules, [], "name", "module").select("name", "module")


_SPANS_SQL = "sp AS (SELECT parsed_id, path, min(c.line) AS b_start, max(c.line) AS b_end FROM (SELECT parsed_id, path, unnest(changes) AS c FROM parsed_file) WHERE c.line IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2)"


def change_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parsed_file").select("parsed_id", "path", F.explode("changes.line").alias("line")).filter("line is not null and path is not null")
    return rows.groupBy("parsed_id", "path").agg(F.min("line").alias("b_start"), F.max("line").alias("b_end"))


_HITS_SQL = "hit AS (SELECT DISTINCT r.file AS path, r.line_number AS line FROM (SELECT unnest(relevant_files) AS r FROM log_analysis) WHERE r.file IS NOT NULL AND r.line_number IS NOT NULL)"


@_R.add("j18_overlapping_spans", f"WITH {_SPANS_SQL}, sd AS (SELECT sp.*, p.diff_id FROM sp JOIN parsed_file p ON sp.parsed_id = p.parsed_id) SELECT a.parsed_id AS id_a, b.parsed_id AS id_b, a.diff_id FROM sd a JOIN sd b ON a.diff_id = b.diff_id AND a.parsed_id < b.parsed_id AND a.b_start <= b.b_end AND a.b_end >= b.b_start")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a diff whose changed line ranges overlap."""
    s = change_spans(spark, sf_dir).join(table(spark, sf_dir, "parsed_file").select("parsed_id", "diff_id"), "parsed_id").drop("path")
    left = s.select("diff_id", F.col("parsed_id").alias("id_a"), F.col("b_start").alias("a_start"), F.col("b_end").alias("a_end"))
    return op.overlapping(left, s.withColumnRenamed("parsed_id", "id_b"), ["diff_id"], 64).filter("id_a < id_b").select("id_a", "id_b", "diff_id")


@_R.add(
    "j19_tightest_span",
    f"""WITH {_SPANS_SQL}, pt AS (SELECT DISTINCT path, c.line AS line FROM (SELECT path, unnest(changes) AS c FROM parsed_file) WHERE c.line IS NOT NULL AND path IS NOT NULL)
SELECT path, line, parsed_id FROM (SELECT p.path, p.line, s.parsed_id, row_number() OVER (PARTITION BY p.path, p.line ORDER BY s.b_end - s.b_start, s.b_start, s.parsed_id) AS rn FROM pt p JOIN sp s ON p.path = s.path AND s.b_start <= p.line AND s.b_end >= p.line) WHERE rn = 1""",
)
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every changed line the narrowest range of changes of its file that holds it."""
    points = table(spark, sf_dir, "parsed_file").select("path", F.explode("changes.line").alias("a_start")).filter("a_start is not null and path is not null").distinct().withColumn("a_end", F.col("a_start"))
    held = op.overlapping(points, change_spans(spark, sf_dir), ["path"], 64)
    return op.first_per_key(held, ["path", "a_start"], [F.col("b_end") - F.col("b_start"), F.col("b_start"), F.col("parsed_id")]).select("path", F.col("a_start").alias("line"), "parsed_id")


@_R.add(
    "j20_best_path_match",
    """WITH f AS (SELECT DISTINCT path, string_split(path, '/') AS p FROM parsed_file WHERE path IS NOT NULL), n AS (SELECT DISTINCT r.file AS named, string_split(r.file, '/') AS q FROM (SELECT unnest(relevant_files) AS r FROM log_analysis) WHERE r.file IS NOT NULL),
c AS (SELECT named, path, len(list_filter(range(1, least(len(p), len(q)) + 1), lambda k: p[len(p) - k + 1 :] = q[len(q) - k + 1 :])) AS score FROM n JOIN f ON p[-1] = q[-1])
SELECT named, path, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY named ORDER BY score DESC, path) AS rn FROM c) WHERE rn = 1""",
)
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each file named by an analysis, the touched file that fits best."""
    named = table(spark, sf_dir, "log_analysis").select(F.explode("relevant_files.file").alias("named"))
    return op.best_path_match(named, table(spark, sf_dir, "parsed_file"), "named", "path")


@_R.add("u01_overlap_rate", """SELECT n_a, n_b, n_both, n_both / n_a AS rate FROM (SELECT (SELECT count(DISTINCT instance_id) FROM diff_output) AS n_a, (SELECT count(DISTINCT instance_id) FROM log_analysis) AS n_b, (SELECT count(*) FROM (SELECT instance_id FROM diff_output WHERE instance_id IS NOT NULL INTERSECT SELECT instance_id FROM log_analysis)) AS n_both)""")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.overlap_rate(table(spark, sf_dir, "diff_output"), table(spark, sf_dir, "log_analysis"), "instance_id")


@_R.add("u02_prefix_intersection", "SELECT left(sha_fail, 7) AS sha FROM all_instances_metadata WHERE sha_fail IS NOT NULL INTERSECT (SELECT left(sha_fail, 7) FROM log_analysis UNION SELECT left(sha_success, 7) FROM all_instances_metadata)")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "all_instances_metadata")
    return sets.prefix_intersection(m.select(F.col("sha_fail").alias("sha")), [table(spark, sf_dir, "log_analysis").select(F.col("sha_fail").alias("sha")), m.select(F.col("sha_success").alias("sha"))], "sha", 7)


@_R.add("u04_key_differences", "WITH b AS (SELECT instance_id AS id FROM log_analysis UNION ALL SELECT 'x' || instance_id FROM diff_output) SELECT DISTINCT id, 'missing' AS side FROM all_instances_metadata WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM b WHERE id IS NOT NULL) UNION ALL SELECT DISTINCT id, 'extra' FROM b WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM all_instances_metadata WHERE id IS NOT NULL)")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "log_analysis").select(F.col("instance_id").alias("id")).union(table(spark, sf_dir, "diff_output").select(F.concat(F.lit("x"), "instance_id")))
    return sets.key_differences(table(spark, sf_dir, "all_instances_metadata"), b, "id")


@_R.add(
    "u05_drift",
    f"""WITH {base.JOBS_SQL}, n AS (SELECT record_id, list(DISTINCT job_name) FILTER (commit_pos = 0) AS old, list(DISTINCT job_name) FILTER (commit_pos = 1) AS new FROM job WHERE job_name IS NOT NULL AND commit_pos < 2 GROUP BY 1),
d AS (SELECT record_id, list_sort(list_filter(coalesce(new, []), lambda x: NOT list_contains(coalesce(old, []), x))) AS added, list_sort(list_filter(coalesce(old, []), lambda x: NOT list_contains(coalesce(new, []), x))) AS removed FROM n)
SELECT record_id, added, removed, CASE WHEN len(removed) > 0 THEN 'error' WHEN len(added) > 0 THEN 'warning' ELSE 'ok' END AS severity FROM d""",
)
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job names that came and went between the first two commits."""
    rows = base.jobs(spark, sf_dir).filter("job_name is not null and commit_pos < 2")
    sides = rows.groupBy("record_id").agg(*[F.collect_set(F.when(F.col("commit_pos") == i, F.col("job_name"))).alias(n) for i, n in enumerate(("old", "new"))])
    added, removed, severity = sets.array_drift(F.col("old"), F.col("new"))
    return sides.select("record_id", added.alias("added"), removed.alias("removed"), severity.alias("severity"))


@_R.add("u06_later_source_wins", """WITH u AS (SELECT trim(id) AS id, 'metadata' AS origin, 0 AS rk, loaded_at FROM all_instances_metadata WHERE id IS NOT NULL UNION ALL SELECT trim(id), 'summary', 1, loaded_at FROM failed_jobs_summary WHERE id IS NOT NULL)
SELECT id, origin, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rk DESC, loaded_at DESC) AS rn FROM u) WHERE rn = 1""")
def u06(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t, o: table(spark, sf_dir, t).filter("id is not null").select(F.trim("id").alias("id"), F.lit(o).alias("origin"), "loaded_at")
    return sets.later_wins([of("all_instances_metadata", "metadata"), of("failed_jobs_summary", "summary")], "id", ["loaded_at"])


@_R.add("u07_ordered_distinct", f"WITH {base.JOBS_SQL}, n AS (SELECT record_id, commit_pos, job_pos, list_filter(steps, lambda x: x IS NOT NULL) AS s FROM job) SELECT record_id, commit_pos, job_pos, list_filter(s, lambda x, i: list_position(s, x) = i) AS steps FROM n")
def u07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step names of each job, repeats dropped, first occurrence kept."""
    return base.jobs(spark, sf_dir).select("record_id", "commit_pos", "job_pos", F.array_distinct(F.filter("steps", lambda s: s.isNotNull())).alias("steps"))


@_R.add(
    "u08_first_per_pair",
    """SELECT analysis_id, category, subcategory, CAST(min(pos) AS BIGINT) AS pos FROM (
  SELECT analysis_id, pos, error_types[pos + 1].category AS category, error_types[pos + 1].subcategory AS subcategory FROM (SELECT DISTINCT analysis_id, error_types, unnest(range(len(error_types))) AS pos FROM log_analysis) WHERE error_types[pos + 1] IS NOT NULL) GROUP BY 1, 2, 3""",
)
def u08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (type, sub-type) pairs of an analysis with the position of the first."""
    rows = table(spark, sf_dir, "log_analysis").select("analysis_id", F.posexplode("error_types").alias("pos", "e")).filter("e is not null")
    return rows.groupBy("analysis_id", "e.category", "e.subcategory").agg(F.min("pos").cast("bigint").alias("pos"))
