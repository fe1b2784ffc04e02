"""Intermediate tables in the folder that every executor shares.

Long plans are cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it again.  The table survives lost executors, which a local checkpoint
does not.  Where the setting is missing (tests, notebooks) a folder is chosen once.
"""

from __future__ import annotations

import contextlib
import contextvars
import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

FALLBACK_DIR = "file:/tmp/bandloom-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.  A local session, as in tests, may leave it unset; a cluster may not."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = FALLBACK_DIR
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/bandloom-{spark.sparkContext.applicationId}"


_scope: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="")


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables made inside lie in a folder of their own, which ``drop_scope`` removes as a whole."""
    token = _scope.set(f"{name}/")
    try:
        yield
    finally:
        _scope.reset(token)


def drop_scope(spark: SparkSession, name: str) -> None:
    remove(spark, f"{shared_dir(spark)}/{name}")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{_scope.get()}{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again with the same schema."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def make_dirs(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A whole small file, on any file system that Spark can open."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A whole small file; None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it was there.  Of several callers at once one makes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(p)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Atomic on file systems with an atomic directory rename."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    return a.getFileSystem(spark._jsc.hadoopConfiguration()).rename(a, b)


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate, for choosing a number of partitions; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column.  The optimiser's estimate counts 20 bytes for any string, so they are summed."""
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that nothing refers to any more.

    Spark removes a shuffle when the driver's JVM collects its last reference, which may be
    long after a stage of a job has written its table; executors' disks are free sooner so.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
