"""What the operators share: table access, shared-folder tables and partition counts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="chronoweave-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Jobs within give back their shuffle files as they end: what they wrote is all that is read later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Tables written within each scratch() that is open, and those of them that outlive it.
_written: list[list[str]] = []
_kept: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession, keep_all: bool = False):
    """Tables that save() writes within are deleted at the end; those that were to be kept are left to the scope around."""
    _written.append([])
    _kept.append([])
    try:
        yield
    finally:
        paths, kept = _written.pop(), _kept.pop()
        if _written:
            _written[-1] += kept
        if not keep_all:
            drop(spark, *paths)


def save(df: DataFrame, tag: str, partition_by: str | None = None, codec: str = "zstd", keep: bool = False) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder; returns what reads it, and its path. This cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _written:
        (_kept if keep else _written)[-1].append(path)
    writer = df.write.option("compression", codec)
    with shuffles_freed(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by save() that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def width(df: DataFrame, factor: float = 1) -> int:
    """Shuffle partitions for data as large as df: in proportion to its scan, never under the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), round(factor * df.rdd.getNumPartitions()))
