"""The index as an SQLite file: six tables, read in ranges of ids by a Python data source.

One file has one writer, so the driver streams the deduplicated tables into it
in a single transaction. Document strings and notes have no place in these
tables; the native store keeps them.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from symweave.operators.index import CODED_SYMBOLS, SymbolIndex
from symweave.schema import LOCATION, packed, unpacked
from symweave.storage import materialise, numbered

#: Tables, their columns and types (fixed by the format).
TABLES = {
    "symbols": "id long, name string, class_name string, symbol_type string",
    "code_locations": "id long, file_path string, start_lineno int, start_col int, end_lineno int, end_col int, start_byte int, end_byte int",
    "definitions": "id long, symbol_id long, location_id long",
    "references": "id long, symbol_id long, location_id long",
    "definition_references": "definition_id long, reference_id long",
    "metadata": "index_type string",
}
#: Passes over the calls at most, and calls of a pass before there is another.
PASSES, PASS_ROWS = 4, 10_000_000
_KINDS = {"simple": "simple_index", "crossref": "cross_ref_index"}


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", "4"))
        self.columns = [c.split(" ")[0] for c in TABLES[self.table].split(", ")]

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._connect() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        with self._connect() as db:
            names = ", ".join(f'"{c}"' for c in self.columns)
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """``format("symweave_sqlite")`` with options ``path`` and ``table``; the file must be readable where tasks run."""

    @classmethod
    def name(cls) -> str:
        return "symweave_sqlite"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options)


def index_path(path: str) -> str:
    return os.path.join(path, "index.sqlite") if os.path.isdir(path) else path


def normalised(index: SymbolIndex) -> dict[str, DataFrame]:
    """The five tables of facts, with dense ids. Facts and calls meet with numbers in place of symbols; many calls find their ids in passes over the symbols, which bounds the disk for them."""
    merged = index.mode == "crossref"
    symbols = numbered(index.symbols(), [F.col("symbol.type"), F.col("symbol.name"), F.col("symbol.class_name")], "id")
    numbers = symbols.select(F.col("symbol").alias("__s"), F.col("id").alias("__i"))
    small = symbols.count() <= CODED_SYMBOLS

    def coded(rows: DataFrame, c: str, to: str, chosen: Column | None = None) -> DataFrame:
        known = numbers if chosen is None else numbers.where(chosen)
        return rows.join(F.broadcast(known) if small else known, F.col(c) == F.col("__s")).withColumn(to, F.col("__i")).drop("__s", "__i")

    def facts(rows: DataFrame, end: str) -> DataFrame:
        rows = rows.select("symbol", "location")
        if merged and not index.complete:
            rows = rows.unionByName(index.calls.select(f"{end}.symbol", f"{end}.location"))
        rows = coded(rows, "symbol", "symbol_id").select("symbol_id", packed("location").alias("place"))
        return materialise(rows.distinct() if merged else rows, "facts")

    d, r = facts(index.definitions, "caller"), facts(index.references, "callee")
    places = numbered(d.select("place").unionByName(r.select("place")).distinct(), [F.col("place")], "id")

    def keyed(rows: DataFrame) -> DataFrame:
        return numbered(rows.join(places.withColumnRenamed("id", "location_id"), "place"), [F.col("location_id"), F.col("symbol_id")], "id")

    defs, refs = keyed(d), keyed(r)
    passes, bridge = min(PASSES, max(1, -(-index.calls.count() // PASS_ROWS))), None
    for i in range(passes):
        calls = index.calls.select(F.col("caller.symbol").alias("c1"), packed("caller.location").alias("l1"), F.col("callee.symbol").alias("c2"), packed("callee.location").alias("l2"))
        calls = coded(coded(calls, "c2", "s2", F.pmod("__i", F.lit(passes)) == i), "c1", "s1").select("s1", "l1", "s2", "l2")
        ids = calls.join(refs.select(F.col("symbol_id").alias("s2"), F.col("place").alias("l2"), F.col("id").alias("reference_id")), ["s2", "l2"]).select("s1", "l1", "reference_id")
        ids = ids.join(defs.select(F.col("symbol_id").alias("s1"), F.col("place").alias("l1"), F.col("id").alias("definition_id")), ["s1", "l1"]).select("definition_id", "reference_id")
        ids = materialise(ids.distinct(), "bridge")
        bridge = ids if bridge is None else bridge.unionByName(ids)
    one = lambda c: F.col(c) + 1
    return {
        "symbols": symbols.select(one("id").alias("id"), "symbol.name", "symbol.class_name", F.col("symbol.type").alias("symbol_type")),
        "code_locations": places.select("id", unpacked("place").alias("location")).select(one("id").alias("id"), *[F.col(f"location.{n}") for n in LOCATION.names]),
        "definitions": defs.select(one("id").alias("id"), one("symbol_id").alias("symbol_id"), one("location_id").alias("location_id")),
        "references": refs.select(one("id").alias("id"), one("symbol_id").alias("symbol_id"), one("location_id").alias("location_id")),
        "definition_references": bridge.select(one("definition_id").alias("definition_id"), one("reference_id").alias("reference_id")),
    }


def _streamed(rows: DataFrame) -> Iterator[tuple]:
    """The rows in order, a partition at a time, as Arrow batches that the driver unpacks one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["b"])

    for r in rows.mapInArrow(run, "b binary").toLocalIterator():
        for batch in pa.ipc.open_stream(bytes(r[0])):
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def write_sqlite(index: SymbolIndex, path: str) -> str:
    """Write all tables in one transaction; an existing file is kept beside as ``.bak``."""
    target = index_path(path)
    tables = normalised(index)
    if os.path.exists(target):
        shutil.move(target, target + ".bak")
    types = {"long": "INTEGER", "int": "INTEGER", "string": "TEXT"}
    try:
        db = sqlite3.connect(target)
        try:
            with db:
                for name, columns in TABLES.items():
                    cols = [c.split(" ") for c in columns.split(", ")]
                    db.execute(f'CREATE TABLE "{name}" (' + ", ".join(f'"{c}" {types[t]}' + (" PRIMARY KEY" if c == "id" else "") for c, t in cols) + ")")
                    rows = [(_KINDS[index.mode],)] if name == "metadata" else _streamed(tables[name])
                    db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(cols))})', rows)
        finally:
            db.close()
    except (OSError, sqlite3.Error) as e:
        raise RuntimeError(f"cannot write {target}: {e}") from e
    return target


def read_sqlite(spark: SparkSession, path: str) -> SymbolIndex:
    target = index_path(path)
    if not os.path.exists(target):
        raise FileNotFoundError(target)
    spark.dataSource.register(SqliteSource)
    read = lambda t: spark.read.format("symweave_sqlite").option("path", target).option("table", t).load()
    try:
        meta = read("metadata").limit(2).collect()
    except Exception as e:
        raise RuntimeError(f"cannot load {target}: {e}") from e
    if len(meta) != 1:
        raise RuntimeError(f"{target} has {len(meta)} metadata rows")
    symbols = read("symbols").select(F.col("id").alias("symbol_id"), F.struct(F.col("symbol_type").alias("type"), "name", "class_name").alias("symbol"))
    places = read("code_locations").select(F.col("id").alias("location_id"), F.struct(*LOCATION.names).alias("location"))
    full = lambda t: read(t).join(symbols, "symbol_id").join(places, "location_id").select("id", "symbol", "location")
    d, r = full("definitions"), full("references")
    note = F.lit(None).cast("struct<description:string,potential_vulnerabilities:string,control_flow:string>").alias("llm_note")
    placed = F.struct("symbol", "location")
    calls = read("definition_references").join(d.select(F.col("id").alias("definition_id"), placed.alias("caller")), "definition_id").join(r.select(F.col("id").alias("reference_id"), placed.alias("callee")), "reference_id")
    mode = next((m for m, k in _KINDS.items() if k == meta[0][0]), "crossref")
    return SymbolIndex(d.select("symbol", "location", F.lit(None).cast("string").alias("doc"), note, F.col("id").alias("seq")), r.select("symbol", "location", F.col("id").alias("seq")), calls.select("caller", "callee", F.col("reference_id").alias("seq")), mode, mode == "crossref")
