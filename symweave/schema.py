"""Relations of the engine and the keys they are joined on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOL_TYPES = ("unset", "function", "method")
_INT_FIELDS = ("start_lineno", "start_col", "end_lineno", "end_col", "start_byte", "end_byte")

SYMBOL = T.StructType([T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("class_name", T.StringType())])
LOCATION = T.StructType([T.StructField("file_path", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in _INT_FIELDS]])
NOTE = T.StructType([T.StructField(n, T.StringType()) for n in ("description", "potential_vulnerabilities", "control_flow")])
PLACED = T.StructType([T.StructField("symbol", SYMBOL), T.StructField("location", LOCATION)])

DEFINITIONS = T.StructType([T.StructField("symbol", SYMBOL), T.StructField("location", LOCATION), T.StructField("doc", T.StringType()), T.StructField("llm_note", NOTE), T.StructField("seq", T.LongType())])
REFERENCES = T.StructType([T.StructField("symbol", SYMBOL), T.StructField("location", LOCATION), T.StructField("seq", T.LongType())])
CALLS = T.StructType([T.StructField("caller", PLACED), T.StructField("callee", PLACED), T.StructField("seq", T.LongType())])
FILES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("content", T.BinaryType())])

#: One entry of a persisted index document.
INDEX_DATA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "data",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("symbol", SYMBOL),
                        T.StructField(
                            "info",
                            T.StructType(
                                [
                                    T.StructField(
                                        "definitions",
                                        T.ArrayType(T.StructType([T.StructField("location", LOCATION), T.StructField("doc", T.StringType()), T.StructField("calls", T.ArrayType(PLACED)), T.StructField("llm_note", NOTE)])),
                                    ),
                                    T.StructField("references", T.ArrayType(T.StructType([T.StructField("location", LOCATION), T.StructField("called_by", T.ArrayType(PLACED))]))),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def symbol(type_: Column, name: Column, class_name: Column) -> Column:
    return F.struct(type_.cast("string").alias("type"), name.cast("string").alias("name"), class_name.cast("string").alias("class_name"))


def function(name: str) -> Column:
    return symbol(F.lit("function"), F.lit(name), F.lit(None))


def method(name: str, class_name: str | None = None) -> Column:
    return symbol(F.lit("method"), F.lit(name), F.lit(class_name))


def location(file_path: Column, *ints: Column) -> Column:
    return F.struct(file_path.cast("string").alias("file_path"), *[c.cast("int").alias(n) for n, c in zip(_INT_FIELDS, ints, strict=True)])


def same_symbol(a: Column, b: Column) -> Column:
    """Equality of symbols; a missing class equals a missing class."""
    return (a["name"] == b["name"]) & (a["type"] == b["type"]) & a["class_name"].eqNullSafe(b["class_name"])


def same_location(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def qualified(s: Column) -> Column:
    """``Class.name`` or ``name``."""
    return F.concat_ws(".", s["class_name"], s["name"])


def packed(c: str) -> Column:
    """A location with its ends counted from its starts, which differ less from row to row."""
    less = lambda a, b: (F.col(f"{c}.{a}").cast("long") - F.coalesce(F.col(f"{c}.{b}"), F.lit(0))).alias(a)
    return F.struct(*[F.col(f"{c}.{n}") if not n.startswith("end_") or n == "end_col" else less(n, n.replace("end_", "start_")) for n in LOCATION.names])


def unpacked(c: str) -> Column:
    """The location that ``packed`` made."""
    more = lambda a, b: (F.col(f"{c}.{a}") + F.coalesce(F.col(f"{c}.{b}"), F.lit(0))).cast("int").alias(a)
    return F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{n}") if not n.startswith("end_") or n == "end_col" else more(n, n.replace("end_", "start_")) for n in LOCATION.names]))


def location_text(c: Column) -> Column:
    return F.format_string("%s:%d:%d-%d:%d", c["file_path"], c["start_lineno"], c["start_col"], c["end_lineno"], c["end_col"])
