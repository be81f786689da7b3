"""Cutting lineage in loops, with files that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session without one gets a
    temporary folder; a cluster is refused, as its executors share no disk."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="weft-checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for files of one job."""
    return f"{shared(spark)}/weft/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again. A checkpoint keeps the planner's
    estimate of what made it, and a loop that joins its state with itself doubles the
    digits of that with every round; files have the size they have."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.weft_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a ``written`` table that no later step reads."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.weft_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
