"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a folder that all executors share in ``spark.checkpoint.dir``. Where that is unset a
    temporary folder is made for a local master only; elsewhere its files would lie on different machines.
    """
    sc = spark.sparkContext
    set_already = sc.getCheckpointDir()
    if set_already:
        return set_already
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quarryline-")
    sc.setCheckpointDir(folder)
    return folder


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: a cut lineage that survives lost executors.

    For what several branches of a plan read. Columns that a branch does not use are not read again.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/quarryline-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
