"""Incremental indexing of a drop folder of source files.

Each micro-batch writes the facts of its files to a folder of its own, named by
the batch, so a batch that is run again replaces itself. The current facts of a
file are those of its latest batch; a file that is dropped again thereby
replaces what was known of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symweave.extract import LANGUAGES, facts
from symweave.sources.files import relative

_BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def start(spark: SparkSession, folder: str, store: str, lang: str, trigger: dict | None = None) -> StreamingQuery:
    """Follow ``folder`` and keep facts in ``store``; ``trigger`` as for a stream writer (default: what is there now)."""
    suffixes = ",".join(e[1:] for e in LANGUAGES[lang].extensions)
    files = spark.readStream.format("binaryFile").schema(_BINARY_FILE).option("pathGlobFilter", f"*.{{{suffixes}}}").option("recursiveFileLookup", "true").load(folder)
    rows = files.select(relative(F.col("path"), folder).alias("file_path"), "content")

    def put(batch: DataFrame, number: int) -> None:
        batch.select("file_path").distinct().write.mode("overwrite").parquet(f"{store}/seen/batch={number}")
        facts(batch, lang).write.mode("overwrite").parquet(f"{store}/facts/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{store}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    """Facts of the latest version of each file."""
    latest = spark.read.parquet(f"{store}/seen").groupBy("file_path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{store}/facts").join(latest, ["file_path", "batch"], "left_semi").drop("batch")
