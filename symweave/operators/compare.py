"""Differences between two indexes, whatever the order of their facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.operators.index import SymbolIndex


def _rows(index: SymbolIndex) -> dict[str, DataFrame]:
    pairs = index.calls.select(F.col("caller.symbol"), F.col("caller.location"), F.to_json("callee").alias("value")).distinct()
    return {
        "definition": index.all_definitions().select("symbol", "location", F.to_json(F.struct("doc", "llm_note")).alias("value")),
        "reference": index.all_references().select("symbol", "location", F.lit(None).cast("string").alias("value")),
        "call": pairs,
    }


def difference(left: SymbolIndex, right: SymbolIndex) -> DataFrame:
    """(side, kind, symbol, location, value): facts that only the left or only the right index has, as often as it has more of them."""
    a, b, out = _rows(left), _rows(right), None
    for kind in a:
        for side, x, y in (("left", a[kind], b[kind]), ("right", b[kind], a[kind])):
            part = x.exceptAll(y).select(F.lit(side).alias("side"), F.lit(kind).alias("kind"), "symbol", "location", "value")
            out = part if out is None else out.unionByName(part)
    return out


def missing_symbols(left: SymbolIndex, right: SymbolIndex) -> DataFrame:
    """Symbols of the left index that the right one does not have."""
    return left.symbols().exceptAll(right.symbols())


def common_symbols(left: SymbolIndex, right: SymbolIndex) -> DataFrame:
    return left.symbols().intersect(right.symbols())


def assert_equal(left: SymbolIndex, right: SymbolIndex) -> None:
    few = difference(left, right).limit(5).collect()
    if few:
        raise AssertionError("the indexes differ: " + "; ".join(map(str, few)))
