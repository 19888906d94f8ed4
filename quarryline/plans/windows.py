"""Queries of window-like operators, sorts and top-k (W and O of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import windows as op
from quarryline.plans import base
from quarryline.plans.registry import Registry
from quarryline.session import table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
_J = base.JOBS_SQL


@_R.add("w01_latest_per_key", "SELECT id, record_id, loaded_at FROM (SELECT id, record_id, loaded_at, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, record_id DESC) AS rn FROM all_instances_metadata) WHERE rn = 1")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest record per instance."""
    return op.latest(table(spark, sf_dir, "all_instances_metadata").select("id", "record_id", "loaded_at"), ["id"], ["loaded_at", "record_id"]).select("id", "record_id", "loaded_at")


@_R.add("w03_global_rank", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense position over all rows."""
    return op.global_rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


_SPLIT = "SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN n > 1 AND rn <= least(greatest(1, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)), n - 1) THEN 'memory' ELSE 'eval' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.chronological_split(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 0.7)


@_R.add("w04_chronological_split", f"SELECT o_custkey, o_orderkey, split FROM ({_SPLIT})")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).drop("o_orderdate")


@_R.add("w05_global_split", "SELECT o_orderkey, CASE WHEN rn <= CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'memory' ELSE 'eval' END AS split FROM (SELECT o_orderkey, count(*) OVER () AS n, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    n = rows.agg(F.count("*").alias("n")).scalar()
    return op.global_rank(rows, ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.when(F.col("rank") <= F.floor(n * F.lit(0.7)), "memory").otherwise("eval").alias("split"))


@_R.add("w06_split_dates", f"SELECT split, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, count(*) AS n FROM ({_SPLIT}) GROUP BY 1")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).groupBy("split").agg(F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"), F.count("*").alias("n"))


@_R.add("w07_context_lines", "SELECT analysis_id, pos, context FROM (SELECT analysis_id, pos, t, list(t) OVER (PARTITION BY analysis_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM (SELECT analysis_id, CAST(pos AS INTEGER) AS pos, error_context[pos + 1] AS t FROM (SELECT DISTINCT analysis_id, error_context, unnest(range(len(error_context))) AS pos FROM log_analysis)) WHERE t IS NOT NULL) WHERE regexp_matches(lower(t), 'cache')")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements around those that name a cache."""
    rows = table(spark, sf_dir, "log_analysis").select("analysis_id", "error_context").distinct().select("analysis_id", F.posexplode("error_context").alias("pos", "t")).filter("t is not null")
    return op.with_context(rows, ["analysis_id"], "pos", "t", 1, 1).filter(F.lower("t").rlike("cache")).select("analysis_id", "pos", "context")


@_R.add(
    "w07_greedy_frames",
    """WITH RECURSIVE h AS (SELECT doc_id, i - 1 AS h, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(lower(ls[i]), 'error|failed')),
r AS (SELECT doc_id, rn, h AS kept, true AS keep FROM h WHERE rn = 1 UNION ALL SELECT h.doc_id, h.rn, CASE WHEN h.h - 5 > r.kept + 5 THEN h.h ELSE r.kept END, h.h - 5 > r.kept + 5 FROM r JOIN h ON h.doc_id = r.doc_id AND h.rn = r.rn + 1)
SELECT doc_id, list(CAST(kept AS INTEGER) ORDER BY rn) AS frames FROM r WHERE keep GROUP BY 1""",
)
def w07g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document that name an error, greedily spaced so that frames of five lines do not overlap."""
    lines = F.split("text", "\n")
    hits = F.filter(F.transform(lines, lambda x, i: F.when(F.lower(x).rlike("error|failed"), i)), lambda x: x.isNotNull())
    return table(spark, sf_dir, "documents").select("doc_id", op.greedy_frames(hits, 5, 5).alias("frames")).filter("size(frames) > 0")


@_R.add("w08_previous_step", f"WITH {_J} SELECT record_id, commit_pos, job_pos, job_name, lag(job_name) OVER w AS previous_job, lead(conclusion) OVER w AS next_conclusion FROM job WINDOW w AS (PARTITION BY record_id ORDER BY commit_pos, job_pos)")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous and next rows."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("record_id").orderBy("commit_pos", "job_pos")
    return base.jobs(spark, sf_dir).select("record_id", "commit_pos", "job_pos", "job_name", F.lag("job_name").over(w).alias("previous_job"), F.lead("conclusion").over(w).alias("next_conclusion"))


@_R.add("w10_commit_order", f"WITH {base.COMMITS_SQL}, n AS (SELECT record_id, commit_pos, row_number() OVER (PARTITION BY record_id ORDER BY commit_pos) AS i, count(*) OVER (PARTITION BY record_id) AS n FROM com) SELECT record_id, commit_pos, CASE WHEN i = 1 THEN 'FAIL' WHEN i = n THEN 'SUCCESS' ELSE 'COMMIT_' || (i - 1) END AS label FROM n")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.commits(spark, sf_dir).select("record_id", "commit_pos", op.order_label(["record_id"], ["commit_pos"]).alias("label"))


@_R.add("w11_last_items", f"WITH {_J} SELECT record_id, commit_pos, job_pos, CASE WHEN len(steps) > 2 THEN steps[-2:] ELSE steps END AS steps FROM job")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.jobs(spark, sf_dir).select("record_id", "commit_pos", "job_pos", op.last_items(F.col("steps"), 2, 2).alias("steps"))


@_R.add("w12_tail_or_matching", "SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x, i: i > greatest(len(string_split(text, chr(10))) - 4, 0) OR regexp_matches(lower(x), 'error|failed')) AS lines FROM documents WHERE text IS NOT NULL")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    return rows.select("doc_id", op.tail_or_matching(F.split("text", "\n"), 4, ["error", "failed"]).alias("lines"))


@_R.add("w13_renumbered", f"WITH {_J} SELECT record_id, commit_pos, job_pos, row_number() OVER (PARTITION BY record_id ORDER BY commit_pos, job_pos) AS position FROM job WHERE conclusion = 'failure'")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.jobs(spark, sf_dir).filter("conclusion = 'failure'").select("record_id", "commit_pos", "job_pos")
    return op.renumbered(rows, ["record_id"], ["commit_pos", "job_pos"]).withColumn("position", F.col("position").cast("bigint"))


@_R.add("w14_first_per_path", "SELECT path, parsed_id FROM (SELECT path, parsed_id, row_number() OVER (PARTITION BY path ORDER BY parsed_id) AS rn FROM parsed_file WHERE path IS NOT NULL) WHERE rn = 1")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.operators.joins import first_per_key

    return first_per_key(table(spark, sf_dir, "parsed_file").filter("path is not null").select("path", "parsed_id"), ["path"], [F.col("parsed_id")])


@_R.add("o01_sorted", "SELECT repo, count(*) AS n FROM all_instances_metadata GROUP BY 1 ORDER BY n DESC, repo")
def o01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-key sort with a tie-break."""
    return table(spark, sf_dir, "all_instances_metadata").groupBy("repo").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo")


@_R.add("o03_top_and_bottom", "(SELECT 'top' AS side, repo, n FROM (SELECT repo, count(*) AS n FROM all_instances_metadata GROUP BY 1) WHERE n >= 2 ORDER BY n DESC, repo LIMIT 5) UNION ALL (SELECT 'bottom', repo, n FROM (SELECT repo, count(*) AS n FROM all_instances_metadata GROUP BY 1) WHERE n >= 2 ORDER BY n, repo LIMIT 5)")
def o03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O03, O04, O07."""
    per = table(spark, sf_dir, "all_instances_metadata").groupBy("repo").agg(F.count("*").alias("n")).filter("n >= 2")
    side = lambda name, *order: per.orderBy(*order).limit(5).select(F.lit(name).alias("side"), "repo", "n")
    return side("top", F.desc("n"), "repo").unionByName(side("bottom", "n", "repo"))


@_R.add("o05_top_label_per_group", "SELECT analyzer, label, n FROM (SELECT analyzer, trim(e.category) AS label, count(*) AS n, row_number() OVER (PARTITION BY analyzer ORDER BY count(*) DESC, trim(e.category)) AS rn FROM (SELECT analyzer, unnest(error_types) AS e FROM log_analysis) WHERE trim(e.category) <> '' GROUP BY 1, 2) WHERE rn = 1")
def o05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarryline.operators.aggregates import top_label

    rows = table(spark, sf_dir, "log_analysis").select("analyzer", F.explode("error_types.category").alias("c")).select("analyzer", F.trim("c").alias("label")).filter("label <> ''")
    return top_label(rows, ["analyzer"], "label")


@_R.add("o06_natural_order", "SELECT DISTINCT id FROM all_instances_metadata ORDER BY TRY_CAST(id AS BIGINT) IS NULL, TRY_CAST(id AS BIGINT), id")
def o06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids in natural order."""
    return table(spark, sf_dir, "all_instances_metadata").select("id").distinct().orderBy(*op.natural_order("id"))


@_R.add("o08_seeded_sample", "SELECT record_id, id FROM all_instances_metadata ORDER BY md5('42/' || record_id), record_id LIMIT 10")
def o08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.seeded_sample(table(spark, sf_dir, "all_instances_metadata").select("record_id", "id"), "record_id", 10, 42)
