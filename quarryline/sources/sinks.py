"""Sinks. Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.versions import replace_file


def _filesystem(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def whitelisted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as text, missing values and missing columns as empty text."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    return rows.select(*[one(c).alias(c) for c in columns])


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    out = whitelisted(rows, columns) if columns else rows
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def replace_parquet(rows: DataFrame, path: str, backup: bool = True) -> int:
    """Writes beside ``path``, reads back and counts, then swaps; the old data stays as a dated backup. Returns the row count.

    A folder can't be renamed over another one, so the swap takes two renames; ``finish_swap`` mends what a crash between them leaves.
    """
    spark = rows.sparkSession
    fs, at = _filesystem(spark, path)
    fresh = f"{path}.new"
    fs.delete(at(f"{path}.ready"), False)
    written = Observation()
    rows.observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(fresh)
    n = spark.read.parquet(fresh).count()
    if n != written.get["n"]:
        raise ValueError(f"{path}: {n} rows read back, not as many as were written")
    out = fs.create(at(f"{path}.ready"), True)
    out.close()
    _swap(spark, path, backup)
    return n


def _swap(spark: SparkSession, path: str, backup: bool) -> None:
    fs, at = _filesystem(spark, path)
    old = f"{path}.{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}"
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} could not be renamed")
    if not fs.rename(at(f"{path}.new"), at(path)):
        raise OSError(f"{path}.new could not be renamed")
    fs.delete(at(f"{path}.ready"), False)
    if not backup and fs.exists(at(old)):
        fs.delete(at(old), True)


def finish_swap(spark: SparkSession, path: str) -> bool:
    """Puts a table in place that was written and checked, but not swapped in before a crash. True if there was one."""
    fs, at = _filesystem(spark, path)
    ready = fs.exists(at(f"{path}.ready")) and fs.exists(at(f"{path}.new"))
    if ready:
        _swap(spark, path, True)
    return ready


def write_json_file(rows: DataFrame, path: str) -> None:
    """One JSON lines file, for small results: a single task writes it, one rename over the old file puts it in place."""
    spark = rows.sparkSession
    fs, at = _filesystem(spark, path)
    folder = f"{path}.tmp"
    rows.coalesce(1).write.mode("overwrite").json(folder)
    part = next(s.getPath() for s in fs.listStatus(at(folder)) if s.getPath().getName().startswith("part-"))
    replace_file(spark, part.toString(), path)
    fs.delete(at(folder), True)


def write_by_key(rows: DataFrame, path: str, key: str, fmt: str = "json") -> None:
    """One folder per value of ``key``; only folders of values present are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).format(fmt).save(path)


def write_bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by ``key``: later joins and lookups on it need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)


def markdown_lines(rows: DataFrame) -> DataFrame:
    """A line of a Markdown table per row."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |")).alias("line"))


def latex_text(text: Column) -> Column:
    """Text with LaTeX's special characters escaped."""
    out = F.replace(text, F.lit("\\"), F.lit("\\textbackslash "))
    for ch in "&%$#_{}":
        out = F.replace(out, F.lit(ch), F.lit("\\" + ch))
    return out
