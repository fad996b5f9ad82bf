"""The syntax tree of Python files as rows."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SCHEMA = "file_path string, node_id int, parent_id int, node_type string, depth int, start_lineno int, end_lineno int"
_ARROW = pa.schema([("file_path", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("node_type", pa.string()), ("depth", pa.int32()), ("start_lineno", pa.int32()), ("end_lineno", pa.int32())])


def tree(content: bytes) -> list[tuple]:
    """(node_id, parent_id, node_type, depth, start_lineno, end_lineno), parents first; nothing for a file that does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            root = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows, stack = [], [(root, None, 1)]
    while stack:
        node, parent, depth = stack.pop()
        n = len(rows)
        rows.append((n, parent, type(node).__name__, depth, getattr(node, "lineno", None), getattr(node, "end_lineno", None)))
        stack.extend((c, n, depth + 1) for c in reversed(list(ast.iter_child_nodes(node))))
    return rows


def ast_nodes(files: DataFrame) -> DataFrame:
    """All nodes of files(file_path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = tree(content) if content else []
                if rows:
                    columns = zip(*[(path, *r) for r in rows], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return files.select("file_path", "content").mapInArrow(run, _SCHEMA)


def histogram(nodes: DataFrame) -> DataFrame:
    """(node_type, count), sorted by type."""
    return nodes.groupBy("node_type").count().orderBy("node_type")


def samples(nodes: DataFrame, node_type: str, n: int = 3) -> DataFrame:
    """The first nodes of a type in each file."""
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy("node_id"))
    return nodes.where(F.col("node_type") == node_type).withColumn("r", rank).where(F.col("r") <= n).drop("r")


def extent(nodes: DataFrame) -> DataFrame:
    """(file_path, nodes, max_depth); the root has depth 1."""
    return nodes.groupBy("file_path").agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"))
