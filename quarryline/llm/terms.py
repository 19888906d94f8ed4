"""Frequency of every distinct term by last-seen counters.

Terms are hash-partitioned and ordered by record; per term the counters are occurrences, records
and the last record identifier: a record counts when its identifier differs from the last one
seen. No set of records is kept for any term.

A row is combined before the shuffle (each of its terms once, with a count; see ``combine_row``). A hot term is split
by a salt made from the record identifier: all rows of a record meet in one salt, so the records
of the salts just add up. The window, the counters per salt and their sum need two exchanges, the
second of at most ``salts`` rows a term.

Defined cases: null and blank terms do not count; a null record identifier adds occurrences but no
record; repeated rows add occurrences, not records; an empty table has no terms and no total; the
total is the number of distinct non-null identifiers of the whole table, rows without terms included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions.arrays import let
from quarryline.session import shuffle_width

#: Salts of a term: as many as this, and so many times the shuffle partitions.
SALTS, SALTS_A_PARTITION = 64, 4
LEAST_RECORDS = 3
MOST_SHARE = 0.1
COMBINED = 256


def name_form(text: Column) -> Column:
    """Trimmed of spaces and tabs, runs of them one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, "[ \t]+", " ")))


def combine_row(terms: Column) -> Column:
    """The non-blank terms of one row with their counts: array<struct<term, n>>.

    A row of up to ``COMBINED`` terms has each of them once; a longer one has its terms as they come, each with
    a count of one, as comparing them with each other would take the square of their number. The counters
    give the same either way.
    """

    def of(kept: Column) -> Column:
        once = F.transform(F.array_distinct(kept), lambda t: F.struct(t.alias("term"), F.size(F.filter(kept, lambda x: x == t)).cast("bigint").alias("n")))
        each = F.transform(kept, lambda t: F.struct(t.alias("term"), F.lit(1).cast("bigint").alias("n")))
        return F.when(F.size(kept) <= COMBINED, once).otherwise(each)

    return let(F.filter(terms, lambda t: t.isNotNull() & (F.regexp_replace(t, r"\s+", "") != "")), of)


def term_counts(rows: DataFrame, record: str, lists: dict[str, Column], salts: int | None = None) -> DataFrame:
    """field_name, term, occurrences, records for the terms in the array columns ``lists``.

    A term of most records leaves each sort one part in ``salts`` of the rows, so they grow with the cluster's partitions."""
    salts = salts or max(SALTS, SALTS_A_PARTITION * shuffle_width(rows.sparkSession))

    def of(field: str, terms: Column) -> Column:
        combined = combine_row(F.coalesce(terms, F.array().cast("array<string>")))
        return F.transform(combined, lambda t: F.struct(F.lit(field).alias("field_name"), t["term"].alias("term"), t["n"].alias("n")))

    per_row = F.flatten(F.array(*[of(f, x) for f, x in lists.items()]))
    tokens = rows.select(F.col(record).alias("rec"), F.explode(per_row).alias("t")).select("rec", "t.*", F.pmod(F.xxhash64("rec"), F.lit(salts)).cast("int").alias("salt"))
    key = ["field_name", "term", "salt"]
    last_seen = F.lag("rec").over(Window.partitionBy(*key).orderBy("rec"))
    is_new = F.col("rec").isNotNull() & ~F.col("rec").eqNullSafe(last_seen)
    counted = tokens.withColumn("new_record", is_new.cast("bigint"))
    per_salt = counted.groupBy(*key).agg(F.sum("n").alias("occurrences"), F.sum("new_record").alias("records"))
    return per_salt.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, total: DataFrame, least: int = LEAST_RECORDS, most_share: float = MOST_SHARE) -> DataFrame:
    """``counts`` with ``mark``: rare, common or null. ``total`` is one row of one number."""
    # A scalar subquery: one number, computed once, no join.
    common = F.col("records") > F.lit(most_share) * total.scalar()
    return counts.withColumn("mark", F.when(F.col("records") < least, "rare").when(common, "common"))


def job_and_step_terms(summary: DataFrame, salts: int | None = None) -> DataFrame:
    """Counts and marks of the job and step names in ``failed_jobs`` of ``summary``, per instance ``id``."""
    jobs = F.filter("failed_jobs", lambda j: j.isNotNull())
    names = F.transform(jobs, lambda j: name_form(j["job_name"]))
    steps = F.transform(F.flatten(F.transform(jobs, lambda j: F.coalesce(j["step_names"], F.array().cast("array<string>")))), name_form)
    counts = term_counts(summary.select("id", "failed_jobs"), "id", {"job_name": names, "step_names": steps}, salts)
    return mark_terms(counts, summary.select(F.count_distinct("id").alias("n")))
