"""A report on the call graph of an index."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.operators import graph as G
from symweave.operators.index import SymbolIndex


class Report(Mapping):
    """The parts of a report by name; each is made when it is asked for."""

    def __init__(self, index: SymbolIndex):
        self._index = index
        self._parts = {
            "symbols": index.sorted_symbols,
            "stats": lambda: G.call_stats(index),
            "largest_components": lambda: G.component_sizes(self._found[0]).orderBy(F.desc("size"), "scc_id").limit(5),
            "entry_points": lambda: G.terminal_components(*self._found, "entry").orderBy("scc_id").limit(10),
            "end_points": lambda: G.terminal_components(*self._found, "end").orderBy("scc_id").limit(10),
            "top_files": lambda: self._per_file().orderBy(F.desc("definitions"), "file").limit(10),
        }

    @cached_property
    def _found(self) -> tuple[DataFrame, DataFrame]:
        """Components and the edges between them."""
        return G.graph_components(G.call_graph(self._index))

    def _per_file(self) -> DataFrame:
        return self._index.all_definitions().groupBy(F.element_at(F.split("location.file_path", "/"), -1).alias("file")).agg(F.count("*").alias("definitions"))

    def __getitem__(self, name: str) -> DataFrame:
        return self._parts[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


def call_graph_report(index: SymbolIndex) -> Report:
    """Symbols, counts, the five largest components, ten entry and end components, the ten files with most definitions."""
    return Report(index)
