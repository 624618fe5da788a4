"""Cutting lineage in loops: rows go to the folder that spark.checkpoint.dir names, shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder with its file system. Only where the session names none and the master is local (a laptop, tests) a
    temporary one is set; on a cluster that is an error, as executors would not see it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    path = sc._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as a Parquet table and read from there.

    A table has the size of its files, so joins of later rounds know what is small. A checkpoint() instead hands on the
    size that was estimated for its plan: the product of all that was joined, whose digits double every round until
    planning a join takes minutes.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
