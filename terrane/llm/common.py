"""Shared folder, written intermediate tables and file access on executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, read from the session, with its file system.

    Only where it is unset and the master is local (tests, a laptop) a fresh temporary folder is made and set; on a
    cluster that is an error, as executors would not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    path = sc._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, so a lost executor costs a re-read."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table of written() that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable) -> Callable:
    """A function of batches that, at its end, gives memory that it has freed back to the system: workers are kept for later tasks,
    also of other operators, and what their allocators hold counts against the executor."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return wrapped


def unused(columns, name: str) -> str:
    """A column name that none of the columns has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def open_store(uri: str):
    """(pyarrow file system, path in it) for a file:, hdfs:, s3:, gs: or abfs: address; a bare path is local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, parts) -> int:
    """Write byte strings as one new file and return its length. Names are unique, so a retried task never clashes."""
    store, path = open_store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    n = 0
    with store.open_output_stream(path, compression=None) as out:
        for part in parts:
            out.write(part)
            n += len(part)
    return n
