"""Readers of the shapes that records come in."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One object per line. Strict: a bad line raises. Else bad and blank lines are left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kept = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return kept.filter("_bad is null").drop("_bad")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON lines of ``path``, or no rows where nothing is there."""
    return read_jsonl(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema)


def entries(doc: Column) -> Column:
    """array<struct<key, value>> of a variant that is a map, or a list of objects with an id under one of its names."""
    names = ("id", "issue_id", "instance_id")
    of_map = F.transform(F.map_entries(F.try_variant_get(doc, "$", "map<string,variant>")), lambda e: F.struct(F.trim(e["key"]).alias("key"), e["value"].alias("value")))
    of_list = F.transform(F.try_variant_get(doc, "$", "array<variant>"), lambda v: F.struct(F.trim(F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])).alias("key"), v.alias("value")))
    return F.when(F.schema_of_variant(doc).startswith("ARRAY"), of_list).otherwise(of_map)


def read_keyed_json(spark: SparkSession, path: str) -> DataFrame:
    """key, value (variant) of JSON documents that are a map by id or a list of objects with an id. Files are split per document."""
    docs = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("doc")).filter("doc is not null")
    return docs.select(F.explode(entries(F.col("doc"))).alias("e")).select("e.*").filter("key is not null")


def read_enveloped(spark: SparkSession, path: str, names: tuple[str, ...] = ("instances", "classifications", "data")) -> DataFrame:
    """value (variant): the elements of the first list under one of ``names``, or of the document if it is a list itself."""
    docs = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("doc")).filter("doc is not null")
    lists = [F.try_variant_get("doc", f"$.{n}", "array<variant>") for n in names]
    return docs.select(F.explode(F.coalesce(*lists, F.try_variant_get("doc", "$", "array<variant>"))).alias("value"))


def read_instances(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows from ``.json`` (a list), ``.jsonl`` (lines of an object or a list), ``.csv`` or parquet, by the name's end."""
    if path.endswith(".jsonl"):
        lines = spark.read.text(path).select(F.try_parse_json("value").alias("v")).filter("v is not null")
        values = lines.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).alias("v"))
        fields = T._parse_datatype_string(f"struct<{schema}>").fields
        return values.select(*[F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields])
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    if path.endswith(".csv"):
        return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(f"struct<{schema}>").fields])


def top_level_entries(spark: SparkSession, path: str) -> DataFrame:
    """key, line of a huge JSON object that has one entry per line: a split text scan, each line on its own."""
    lines = spark.read.text(path)
    key = F.regexp_extract("value", r'^\s*"((?:[^"\\]|\\.)+)"\s*:', 1)
    return lines.select(key.alias("key"), F.regexp_replace(F.regexp_replace("value", r'^\s*"(?:[^"\\]|\\.)+"\s*:\s*', ""), r",\s*$", "").alias("line")).filter("key <> ''")


def normal_predictions(rows: DataFrame, origin: str) -> DataFrame:
    """id, patch, origin of predictions with any of the usual names; rows without an id are left out."""
    from quarryline.operators.filters import resolve_aliases

    out = resolve_aliases(rows, {"id": ["id", "issue_id", "instance_id"], "patch": ["patch", "diff", "diff_fix", "model_patch"]})
    return out.select(F.trim(F.col("id").cast("string")).alias("id"), "patch", F.lit(origin).alias("origin")).filter("id is not null")


def source_files(spark: SparkSession, path: str, glob: str = "*.py", most_bytes: int = 1_000_000) -> DataFrame:
    """path, content of text files of at most ``most_bytes``, found recursively."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.filter(F.col("length") <= most_bytes).select("path", F.decode("content", "UTF-8").alias("content"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, n_rows of named tables."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
