"""Tables kept as versions with a manifest that is replaced atomically.

A version is written whole beside the others; one rename of the manifest makes it the current one. A crash before
the rename leaves the version before in place, so that what is repeated starts from what it started from the first time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MANIFEST = "manifest.json"


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file over another one; at no moment is there none."""
    jvm = spark._jvm
    _, make = _hadoop(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(target).toUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(make(source), make(target), how)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, in place all at once."""
    fs, make = _hadoop(spark, path)
    out = fs.create(make(f"{path}.tmp"), True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    replace_file(spark, f"{path}.tmp", path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    fs, make = _hadoop(spark, path)
    at = f"{path}/{MANIFEST}"
    if not fs.exists(make(at)):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(at).collect()))


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, path: str, manifest: dict, only: set[int] | None = None) -> DataFrame | None:
    """The rows of the named buckets (all without names) of a manifest, None where there are none."""
    folders = [f"{path}/{v}/_bucket={b}" for b, v in manifest["buckets"].items() if only is None or int(b) in only]
    return spark.read.parquet(*folders) if folders else None


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The current rows of a table kept by ``merge_batch``, None before the first batch."""
    manifest = read_manifest(spark, path)
    return None if manifest is None else read_buckets(spark, path, manifest)


def merge_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> None:
    """The newest row per key after one more batch.

    Rows lie in ``buckets`` by the hash of their key. Only the buckets that the batch touches are read and written again, as
    folders of a new version; the manifest then points to these and to the old folders of the rest. A batch that is
    repeated after its manifest is in place changes nothing; one that is repeated before that writes the same again.
    """
    from quarryline.operators.windows import latest

    spark = batch.sparkSession
    manifest = read_manifest(spark, path) or {"batch": -1, "n_buckets": buckets, "buckets": {}}
    if manifest["batch"] >= batch_id:
        return
    own = batch.withColumn("_bucket", bucket_of(keys, manifest["n_buckets"]))
    touched = {r[0] for r in own.select("_bucket").distinct().collect()}  # no more than there are buckets
    old = read_buckets(spark, path, manifest, touched)
    rows = batch if old is None else old.unionByName(batch)
    version = f"v{batch_id}"
    newest = latest(rows, keys, [order]).select(*batch.columns).withColumn("_bucket", bucket_of(keys, manifest["n_buckets"]))
    newest.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/{version}")
    now = {"batch": batch_id, "n_buckets": manifest["n_buckets"], "buckets": manifest["buckets"] | {str(b): version for b in touched}}
    write_text(spark, f"{path}/{MANIFEST}", json.dumps(now))
    # What neither this nor the manifest before needs: readers of the latter may still be at work.
    fs, make = _hadoop(spark, path)
    needed = {*now["buckets"].values(), *manifest["buckets"].values()}
    for at in fs.listStatus(make(path)):
        name = at.getPath().getName()
        if at.isDirectory() and name.startswith("v") and name not in needed:
            fs.delete(at.getPath(), True)
