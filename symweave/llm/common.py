"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.storage import few, fresh_path, materialise, shared_dir, table

__all__ = ["SHARE", "dealt_join", "few", "fresh_path", "id_bucket", "materialise", "regrouped", "shared_dir", "small_batches", "table", "tree_sum", "unit_hash"]

#: Rows and bytes of one Arrow batch handed to Python: the same for every operator, so that none changes another's batches.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20
#: Rows of one key that one task takes in a join whose other side has one row a key.
SHARE = 4096


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session; plans read these settings when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows (but the last) for steps that pay for each batch; for narrow rows only."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tree_sum(partials: DataFrame, shape: tuple[int, ...], groups: int = 16) -> np.ndarray:
    """The sum of float64 arrays of one shape (column ``total``, one a task): summed in ``groups`` tasks first, so the driver gets that many."""
    small_batches(partials.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                total += np.frombuffer(b).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    total = np.zeros(shape)
    for r in partials.select("total").repartition(groups).mapInArrow(run, "total binary").collect():
        total += np.frombuffer(r[0]).reshape(shape)
    return total


def dealt_join(rows: DataFrame, once: DataFrame, on: list[str], by: list[str], how: str = "inner", share: int = SHARE) -> DataFrame:
    """``rows`` joined with ``once`` (one row a key); rows of a frequent key are dealt over tasks by the columns ``by``.

    ``rows`` is read twice. Keys are frequent from ``share`` rows on, so there are few of them: one for each ``share`` rows at most.
    """
    often = F.broadcast(rows.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > share).select(*on, F.ceil(F.col("__n") / share).cast("int").alias("__n")))
    parts = F.coalesce("__n", F.lit(1))
    dealt = rows.join(often, on, "left").withColumn("__s", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("__n")
    held = once.join(often, on, "left").withColumn("__s", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__n")
    return dealt.join(held, [*on, "__s"], how).drop("__s")


def id_bucket(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``: how the contracts hold rows out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def unit_hash(*columns: str):
    """A deterministic number in [0, 1) for each row, for samples that do not depend on partitioning."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)
