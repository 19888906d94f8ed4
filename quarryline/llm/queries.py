"""Queries of the llm problems, with their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import bpe, leakage, lookalike, percentiles, split, terms, truncation
from quarryline.plans.registry import Registry
from quarryline.session import table

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql

_TERMS_SQL = """
WITH jobs AS (SELECT id, unnest(failed_jobs) AS j FROM failed_jobs_summary),
names AS (
  SELECT id, 'job_name' AS field_name, j.job_name AS raw FROM jobs WHERE j IS NOT NULL
  UNION ALL SELECT id, 'step_names', unnest(j.step_names) FROM jobs WHERE j IS NOT NULL
), tokens AS (SELECT id, field_name, lower(trim(regexp_replace(raw, '[ \\t]+', ' ', 'g'))) AS term FROM names WHERE regexp_replace(raw, '\\s+', '', 'g') <> ''),
counts AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM tokens GROUP BY 1, 2),
marked AS (
  SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.1 * (SELECT count(DISTINCT id) FROM failed_jobs_summary) THEN 'common' END AS mark FROM counts
)
"""


@_R.add("p1_found", _TERMS_SQL + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.job_and_step_terms(table(spark, sf_dir, "failed_jobs_summary")).filter("mark is not null").select("field_name", "term", "mark")


@_R.add("p1_terms", _TERMS_SQL + "SELECT field_name, term, CAST(occurrences AS BIGINT) AS occurrences, CAST(records AS BIGINT) AS records, mark FROM marked")
def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.job_and_step_terms(table(spark, sf_dir, "failed_jobs_summary"))


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = split.split_oversized(table(spark, sf_dir, "diff_output"), "diff_output", "diff_id", "diff")
    return diffs.unionByName(split.split_oversized(table(spark, sf_dir, "parsed_file"), "parsed_file", "parsed_id", "changes"))


_SPLIT_SQL = """
WITH long_diffs AS (SELECT DISTINCT diff_id AS item_id, diff FROM diff_output WHERE length(diff) > 6000),
lines AS (SELECT item_id, l, i FROM (SELECT item_id, ls, unnest(range(1, len(ls) + 1)) AS i, ls[i] AS l FROM (SELECT item_id, string_split(diff, chr(10)) AS ls FROM long_diffs))),
marked AS (
  SELECT item_id, length(l) AS n,
    sum(CASE WHEN starts_with(l, 'diff --git ') THEN 1 ELSE 0 END) OVER w AS file_no,
    sum(CASE WHEN starts_with(l, 'diff --git ') OR starts_with(l, '@@ ') THEN 1 ELSE 0 END) OVER w AS hunk_no
  FROM lines WINDOW w AS (PARTITION BY item_id ORDER BY i ROWS UNBOUNDED PRECEDING)
), files AS (SELECT item_id, max(s) AS m FROM (SELECT item_id, sum(n + 1) - 1 AS s FROM marked GROUP BY item_id, file_no) GROUP BY item_id),
hunks AS (SELECT item_id, max(s) AS m FROM (SELECT item_id, sum(n + 1) - 1 AS s FROM marked GROUP BY item_id, hunk_no) GROUP BY item_id),
longest AS (SELECT item_id, max(n) AS m FROM marked GROUP BY item_id),
one AS (SELECT parsed_id, unnest(changes) AS c FROM parsed_file),
sized AS (SELECT parsed_id, coalesce(length(c.before), 0) + coalesce(length(c.after), 0) AS n FROM one),
whole AS (SELECT parsed_id, sum(n) AS n, max(n) AS m FROM sized GROUP BY parsed_id HAVING sum(n) > 6000)
SELECT 'diff_output' AS item_table, f.item_id, CASE WHEN f.m <= 6000 THEN 'file' WHEN h.m <= 6000 THEN 'hunk' WHEN l.m <= 6000 THEN 'line' ELSE 'inside_line' END AS cut_level
FROM files f JOIN hunks h USING (item_id) JOIN longest l USING (item_id)
UNION ALL SELECT 'parsed_file', parsed_id, CASE WHEN m <= 6000 THEN 'change' ELSE 'inside_change' END FROM whole
"""


@_R.add("p2_found", _SPLIT_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.one_per_item(_cuts(spark, sf_dir))


@_R.add("p2_pieces")
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece, in order of piece_no, with its overlap."""
    return split.pieces_of(_cuts(spark, sf_dir))


@_R.add("p5_percentiles")
def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model and day (span day), and per model by merging the days (span all)."""
    daily = percentiles.daily_sketches(percentiles.calls_once(table(spark, sf_dir, "llm_call_record")))
    return percentiles.percentiles(percentiles.with_totals(daily), "model", "span", "day")


_CALLS_SQL = """WITH r AS (
  SELECT call_id, nullif(lower(trim(model)), '') AS model, CAST(called_at AS DATE) AS day, CASE WHEN duration_seconds >= 0 AND NOT isnan(duration_seconds) THEN duration_seconds END AS d,
    CASE WHEN total_tokens >= 0 THEN CAST(total_tokens AS DOUBLE) END AS t, CASE WHEN total_cost >= 0 AND NOT isnan(total_cost) THEN total_cost END AS c FROM llm_call_record),
o AS (SELECT *, row_number() OVER (PARTITION BY call_id, CASE WHEN call_id IS NULL THEN hash(model, day, d, t, c) END ORDER BY model NULLS FIRST, day NULLS FIRST, d NULLS FIRST, t NULLS FIRST, c NULLS FIRST) AS rn FROM r),
m AS (SELECT model, day, 'duration_seconds' AS measure, d AS v FROM o WHERE rn = 1 UNION ALL SELECT model, day, 'total_tokens', t FROM o WHERE rn = 1 UNION ALL SELECT model, day, 'total_cost', c FROM o WHERE rn = 1)
"""


@_R.add("p5_counts", _CALLS_SQL + "SELECT model, day, measure, count(v) AS n FROM m GROUP BY 1, 2, 3")
def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each daily sketch has seen."""
    daily = percentiles.daily_sketches(percentiles.calls_once(table(spark, sf_dir, "llm_call_record")))
    return percentiles.percentiles(daily, "model", "day").select("model", "day", "measure", "n")


@_R.add("p5_within_bound", _CALLS_SQL + "SELECT model, day, measure, count(v) AS n, true AS within_bound FROM m GROUP BY 1, 2, 3")
def p5_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every percentile of every day against the exact ranks of its values."""
    return percentiles.within_bound(percentiles.calls_once(table(spark, sf_dir, "llm_call_record")))


@_R.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_elements(truncation.scored(table(spark, sf_dir, "log_analysis")))


@_R.add("p6_share")
def p6_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each analyzer's elements are cut, per field."""
    return truncation.cut_share(truncation.scored(table(spark, sf_dir, "log_analysis")))


@_R.add("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


@_R.add("p7_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return bpe.decode_corpus(bpe.encode_corpus(table(spark, sf_dir, "documents")))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@_R.add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


@_R.add("p8_leaked_items")
def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each item that leaked."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))


@_R.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf_dir, "documents"))


@_R.add("p9_classes")
def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that looks like another text: its class and its number of links."""
    return lookalike.lookalike_members_of(table(spark, sf_dir, "documents"))


@_R.add("p9_normal")
def p9_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every text."""
    return lookalike.with_normal_form(table(spark, sf_dir, "documents")).select("doc_id", F.col("normal").alias("normal_text"))
