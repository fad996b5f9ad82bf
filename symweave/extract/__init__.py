"""Definitions and call sites of source files, one registered extractor a language.

An extractor is a function from the bytes of a file to rows
``(kind, type, name, class_name, start_byte, end_byte, body_start, body_end, doc)``.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.extract import c_family, python_source
from symweave.extract.rows import Row
from symweave.operators.contain import contained
from symweave.operators.index import SymbolIndex
from symweave.schema import LOCATION, location, symbol


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    extract: Callable[[bytes], list[Row]]


#: ``.h`` belongs to C and to C++: the caller's language decides.
LANGUAGES = {
    "python": Language("python", (".py",), python_source.extract),
    "c": Language("c", (".c", ".h"), c_family.extract_c),
    "cpp": Language("cpp", (".cpp", ".hpp", ".cc", ".h", ".cxx", ".hxx"), c_family.extract_cpp),
}


def language(name: str) -> Language | None:
    """The registered language, or None (with a warning) for a name that is not known."""
    found = LANGUAGES.get(name)
    if found is None:
        import logging

        logging.getLogger("symweave").warning("unsupported language %r", name)
    return found


_SCHEMA = "kind string, file_path string, type string, name string, class_name string, start_lineno int, start_col int, end_lineno int, end_col int, start_byte int, end_byte int, body_start int, body_end int, doc string"


def line_starts(content: bytes) -> list[int]:
    return [0, *(m.end() for m in re.finditer(rb"\n", content))]


def facts(files: DataFrame, lang: str) -> DataFrame:
    """All definitions (kind ``definition``) and call sites (``reference``) of files(file_path, content)."""
    extract = LANGUAGES[lang].extract

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not content:
                    continue
                starts = line_starts(content)

                def place(b: int, starts=starts) -> tuple[int, int]:
                    n = bisect.bisect_right(starts, b)
                    return n, b - starts[n - 1]

                for r in extract(content):
                    (l1, c1), (l2, c2) = place(r.start), place(r.end)
                    out.append((r.kind, path, r.type, r.name, r.class_name, l1, c1, l2, c2, r.start, r.end, r.body_start, r.body_end, r.doc))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in out], schema=_ARROW)

    return files.select("file_path", "content").mapInArrow(run, _SCHEMA)


_NAMES = [f.split(" ")[0] for f in _SCHEMA.split(", ")]
_ARROW = pa.schema([(n, pa.string() if f.endswith(" string") else pa.int32()) for n, f in zip(_NAMES, _SCHEMA.split(", "), strict=True)])


def index_files(files: DataFrame, lang: str, mode: str = "crossref") -> SymbolIndex:
    """The index of files(file_path, content): facts, and the calls inside each definition's body."""
    rows = facts(files, lang)
    sym = symbol(F.col("type"), F.col("name"), F.col("class_name"))
    loc = location(F.col("file_path"), *[F.col(n) for n in LOCATION.names[1:]])
    placed = rows.select("kind", "file_path", "start_byte", "end_byte", "body_start", "body_end", "doc", sym.alias("symbol"), loc.alias("location"), F.col("start_byte").cast("long").alias("seq"))
    definitions = placed.where("kind = 'definition'")
    references = placed.where("kind = 'reference'")
    bodies = definitions.select("file_path", "body_start", "body_end", F.struct("symbol", "location").alias("caller"))
    calls = contained(bodies, references.select("file_path", "start_byte", "end_byte", F.struct("symbol", "location").alias("callee"), "seq")).select("caller", "callee", "seq")
    note = F.lit(None).cast("struct<description:string,potential_vulnerabilities:string,control_flow:string>").alias("llm_note")
    return SymbolIndex(definitions.select("symbol", "location", "doc", note, "seq"), references.select("symbol", "location", "seq"), calls, mode)
