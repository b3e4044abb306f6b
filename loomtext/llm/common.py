"""What the operators share: reading tables, the shared folder and materialised intermediates."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets
    one of its own; a cluster gets an error, since its executors don't see each other's folders."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomtext-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomtext/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def deleted(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read any more. Others are left alone."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def release() -> None:
    """Gives memory that this process no longer uses back to the system, so that a reused worker starts small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


Walk = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(walk: Walk) -> Walk:
    """walk, for mapInArrow, that releases memory when its task ends. What walk holds must be local to it."""

    @functools.wraps(walk)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = walk(batches)
        try:
            yield from inner
        finally:
            inner.close()
            del inner
            release()

    return run


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def only(df: DataFrame, *names: str) -> DataFrame:
    """The operator's own columns; extra columns, whatever they are called, stay outside."""
    return df.select(*[df[n] for n in names])
