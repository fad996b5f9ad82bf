"""Intermediate tables in the shared folder.

Loops and reused results are cut from their lineage by writing them to the
folder of ``spark.checkpoint.dir``; unlike a local checkpoint they survive the
loss of an executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode one is made where it is unset, on a cluster that is an error, as executors share no disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="symweave-shared-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/symweave-{tag}-{uuid.uuid4().hex[:12]}"


def local_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder that the driver writes by its path, for formats that have one writer; the shared folder must be mounted."""
    at = urlparse(fresh_path(spark, tag))
    if at.scheme not in ("", "file"):
        raise RuntimeError(f"{at.scheme}: cannot be written by path; mount the shared folder")
    path = unquote(at.path)
    os.makedirs(path)
    return path


def few(spark: SparkSession) -> int:
    """Files for a narrow table: an eighth of the shuffle partitions, as opening and committing a file costs more than its rows."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Writes in here delete their shuffle files as they end; else those stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, tag: str, compression: str = "zstd", files: int | None = None, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again; ``files`` merges the partitions of a cheap last step, ``made`` gets the folder for ``discard``."""
    spark, path, schema = df.sparkSession, fresh_path(df.sparkSession, tag), df.schema
    if made is not None:
        made.append(path)
    if files:
        df = df.coalesce(files)
    with tidy(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, order: list, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with a dense number from 0 in the given order.

    Rows are dealt by range and sorted in their partitions; one count a partition
    gives the offsets, so no task ever sees all rows.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()
    placed = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", row), "ordered")
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    offset, before = {}, 0
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row a partition
        offset[r[0]] = before
        before += r[1]
    if not offset:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__at")
    starts = spark.createDataFrame(list(offset.items()), "__p long, __o long")
    rows = placed.withColumn("__p", part.cast("long")).join(F.broadcast(starts), "__p")  # one row a partition
    return rows.withColumn(name, F.col("__o") + at).drop("__at", "__p", "__o")
