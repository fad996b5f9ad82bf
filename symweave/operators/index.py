"""The symbol index: relations of definitions, references and calls, and what is built from them.

In ``simple`` mode facts are appended and duplicates survive; in ``crossref``
mode facts at one location are merged and definitions and references know each
other. Both are views over the same relations: building an index shuffles each
relation once on its key, and point queries only filter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.schema import packed, qualified, same_symbol
from symweave.storage import few, materialise

MODES = ("simple", "crossref")
FILTERS = ("all", "function", "method")
_KEY = ["symbol", "location"]
#: Symbols that are held in every task as a table; with more, rows carry the symbols themselves.
CODED_SYMBOLS = 200_000


@dataclass(frozen=True)
class SymbolIndex:
    definitions: DataFrame
    references: DataFrame
    calls: DataFrame
    mode: str = "crossref"
    #: Definitions and references hold every caller and call site already, as they do in a store.
    complete: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown index mode {self.mode!r}")

    # ---- building and changing ------------------------------------------

    def append(self, definitions: DataFrame | None = None, references: DataFrame | None = None, calls: DataFrame | None = None) -> SymbolIndex:
        """More facts; merging, where the mode asks for it, happens in the views."""
        more = lambda a, b: a if b is None else a.unionByName(b)
        return replace(self, definitions=more(self.definitions, definitions), references=more(self.references, references), calls=more(self.calls, calls), complete=self.complete and calls is None)

    def without(self, symbols: DataFrame) -> SymbolIndex:
        """Drop every fact of the given symbols (column ``symbol``)."""
        gone = symbols.select(F.col("symbol").alias("__s")).distinct()
        keep = lambda df, col: df.join(gone, same_symbol(F.col(col), F.col("__s")), "left_anti")
        return replace(self, definitions=keep(self.definitions, "symbol"), references=keep(self.references, "symbol"), calls=keep(keep(self.calls, "caller.symbol"), "callee.symbol"))

    def replaced(self, other: SymbolIndex) -> SymbolIndex:
        """Symbols of ``other`` in place of the same symbols here."""
        return self.without(other.symbols()).append(other.definitions, other.references, other.calls)

    def updated(self, other: SymbolIndex) -> SymbolIndex:
        """``crossref``: merge fact by fact; ``simple``: replace symbol by symbol."""
        return self.append(other.definitions, other.references, other.calls) if self.mode == "crossref" else self.replaced(other)

    def emptied(self) -> SymbolIndex:
        return replace(self, definitions=self.definitions.limit(0), references=self.references.limit(0), calls=self.calls.limit(0))

    def delete(self, type_: str, name: str, class_name: str | None = None) -> SymbolIndex:
        """Drop one symbol; KeyError if there is none."""
        if self.symbols().where(is_symbol(F.col("symbol"), type_, name, class_name)).isEmpty():
            raise KeyError(f"{type_} {name} of {class_name}")
        cond = lambda c: ~F.coalesce(is_symbol(F.col(c), type_, name, class_name), F.lit(False))
        return replace(self, definitions=self.definitions.where(cond("symbol")), references=self.references.where(cond("symbol")), calls=self.calls.where(cond("caller.symbol") & cond("callee.symbol")))

    # ---- facts as the mode has them -------------------------------------

    def all_definitions(self) -> DataFrame:
        """(symbol, location, doc, llm_note, seq) with duplicates merged in ``crossref`` mode; callers without a definition get a bare one."""
        if self.mode == "simple":
            return self.definitions
        if self.complete:
            return merge_definitions(self.definitions.select("symbol", "location", "doc", "llm_note", "seq"))
        bare = self.calls.select("caller.symbol", "caller.location", F.lit(None).cast("string").alias("doc"), F.lit(None).cast(self.definitions.schema["llm_note"].dataType).alias("llm_note"), F.lit(1 << 62).alias("seq"))
        return merge_definitions(self.definitions.select("symbol", "location", "doc", "llm_note", "seq").unionByName(bare))

    def all_references(self) -> DataFrame:
        """(symbol, location, seq), merged by location in ``crossref`` mode, call sites included."""
        if self.mode == "simple":
            return self.references
        if self.complete:
            return self.references.groupBy(*_KEY).agg(F.min("seq").alias("seq"))
        sites = self.calls.select("callee.symbol", "callee.location", "seq")
        return self.references.select("symbol", "location", "seq").unionByName(sites).groupBy(*_KEY).agg(F.min("seq").alias("seq"))

    def calls_by_definition(self) -> DataFrame:
        """(symbol, location, calls): for each caller its distinct call sites in order."""
        return _ordered_set(self.calls.select(F.col("caller.symbol"), F.col("caller.location"), F.col("callee").alias("x"), "seq"), "calls")

    def called_by(self) -> DataFrame:
        """(symbol, location, called_by): for each call site its distinct callers in order; none in ``simple`` mode."""
        rows = self.calls.select(F.col("callee.symbol"), F.col("callee.location"), F.col("caller").alias("x"), "seq")
        return _ordered_set(rows if self.mode == "crossref" else rows.limit(0), "called_by")

    def symbols(self) -> DataFrame:
        """(symbol): every key of the index once."""
        parts = [self.definitions.select("symbol"), self.references.select("symbol")]
        if self.mode == "crossref" and not self.complete:
            parts += [self.calls.select("caller.symbol"), self.calls.select("callee.symbol")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()

    def sorted_symbols(self) -> DataFrame:
        """Symbols in the order of their printed form: functions, then methods, then names, then classes with none last."""
        return self.symbols().orderBy("symbol.type", "symbol.name", F.col("symbol.class_name").asc_nulls_last())

    def info(self, of: Column | None = None) -> DataFrame:
        """(symbol, definitions, references): the nested document of each symbol, or of those that meet a condition on ``symbol``, which reaches the facts first."""
        asked = (lambda df: df) if of is None else (lambda df: df.where(of))
        d = asked(self.all_definitions() if self.mode == "crossref" else self.definitions).join(asked(self.calls_by_definition()), _KEY, "left")
        r = asked(self.all_references()).join(asked(self.called_by()), _KEY, "left")
        none = F.array().cast("array<struct<symbol:struct<type:string,name:string,class_name:string>,location:struct<file_path:string,start_lineno:int,start_col:int,end_lineno:int,end_col:int,start_byte:int,end_byte:int>>>")
        entry_d = F.struct("seq", "location", "doc", F.coalesce("calls", none).alias("calls"), "llm_note")
        entry_r = F.struct("seq", "location", F.coalesce("called_by", none).alias("called_by"))
        defs = d.groupBy("symbol").agg(F.array_sort(F.collect_list(entry_d)).alias("definitions"))
        refs = r.groupBy("symbol").agg(F.array_sort(F.collect_list(entry_r)).alias("references"))
        # the symbol is never null here, though its class may be: a full join on the whole struct keeps such keys apart
        s = F.to_json(F.col("symbol"))
        joined = defs.withColumn("__k", s).join(refs.withColumn("__k", s).withColumnRenamed("symbol", "__r"), "__k", "full")
        strip = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda x: x.dropFields("seq"))
        return joined.select(F.coalesce("symbol", "__r").alias("symbol"), F.when(F.col("definitions").isNull(), F.slice(strip("definitions"), 1, 0)).otherwise(strip("definitions")).alias("definitions"), strip("references").alias("references"))

    def outline(self) -> DataFrame:
        """(symbol, starts, n_definitions, n_references): ``info`` without its nested documents. Facts are written once and meet with numbers in place of symbols."""
        facts = self.definitions.select(F.lit(True).alias("d"), "symbol", "location").unionByName(self.references.select(F.lit(False).alias("d"), "symbol", "location"))
        if self.mode == "crossref" and not self.complete:
            ends = F.explode(F.array(F.struct(F.lit(True).alias("d"), "caller.symbol", "caller.location"), F.struct(F.lit(False).alias("d"), "callee.symbol", "callee.location"))).alias("x")
            facts = facts.unionByName(self.calls.select(ends).select("x.*"))
        facts = materialise(facts.select("d", "symbol", packed("location").alias("place")), "facts")
        codes = materialise(facts.select("symbol").distinct().withColumn("id", F.monotonically_increasing_id()), "symbols", files=few(facts.sparkSession))
        coded = codes.count() <= CODED_SYMBOLS
        rows = facts.withColumnRenamed("symbol", "s")
        if coded:
            rows = facts.join(F.broadcast(codes), "symbol").select("d", F.col("id").alias("s"), "place")
        if self.mode == "crossref":
            rows = rows.distinct()
        start = F.col("place.start_byte")
        found = rows.groupBy("s").agg(F.array_sort(F.collect_list(F.when(F.col("d"), start))).alias("starts"), F.count_if(F.col("d")).alias("n_definitions"), F.count_if(~F.col("d")).alias("n_references"))
        return found.join(codes.withColumnRenamed("id", "s"), "s").select("symbol", "starts", "n_definitions", "n_references") if coded else found.withColumnRenamed("s", "symbol")

    def counts(self) -> DataFrame:
        """(symbol, n_definitions, n_references)"""
        d = self.all_definitions().select("symbol", F.lit(1).alias("d"), F.lit(0).alias("r"))
        r = self.all_references().select("symbol", F.lit(0).alias("d"), F.lit(1).alias("r"))
        return d.unionByName(r).groupBy("symbol").agg(F.sum("d").alias("n_definitions"), F.sum("r").alias("n_references"))

    def totals(self) -> DataFrame:
        c = self.counts()
        return c.agg(F.count("*").alias("n_symbols"), F.coalesce(F.sum("n_definitions"), F.lit(0)).alias("n_definitions"), F.coalesce(F.sum("n_references"), F.lit(0)).alias("n_references"))

    def size(self) -> int:
        """The number of symbols."""
        return self.symbols().count()

    def contains(self, type_: str, name: str, class_name: str | None = None) -> bool:
        return not self.symbols().where(is_symbol(F.col("symbol"), type_, name, class_name)).isEmpty()

    def get(self, type_: str, name: str, class_name: str | None = None):
        """The document of one symbol; KeyError if there is none."""
        row = self.info(is_symbol(F.col("symbol"), type_, name, class_name)).first()
        if row is None:
            raise KeyError(f"{type_} {name} of {class_name}")
        return row

    def definitions_of(self, type_: str, name: str, class_name: str | None = None) -> DataFrame:
        """Definitions of a symbol, none where it is absent."""
        return self.all_definitions().where(is_symbol(F.col("symbol"), type_, name, class_name))

    def references_of(self, type_: str, name: str, class_name: str | None = None) -> DataFrame:
        return self.all_references().where(is_symbol(F.col("symbol"), type_, name, class_name))

    def notes(self, type_: str, name: str, class_name: str | None = None) -> DataFrame:
        """(location, llm_note) of a symbol's definitions that have a note."""
        return self.definitions_of(type_, name, class_name).where("llm_note is not null").select("location", "llm_note")

    def __repr__(self) -> str:
        return f"SymbolIndex({self.mode})"


def _ordered_set(rows: DataFrame, name: str) -> DataFrame:
    """Distinct ``x`` of each (symbol, location), in order of first ``seq``."""
    once = rows.groupBy("symbol", "location", "x").agg(F.min("seq").alias("seq"))
    return once.groupBy("symbol", "location").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x"))), lambda e: e["x"]).alias(name))


def merge_definitions(rows: DataFrame) -> DataFrame:
    """Definitions at one location become one: the first document string, the last note."""
    has_doc, has_note = F.col("doc").isNotNull(), F.col("llm_note").isNotNull()
    return rows.groupBy(*_KEY).agg(
        F.min_by("doc", F.when(has_doc, F.col("seq"))).alias("doc"),
        F.max_by("llm_note", F.when(has_note, F.col("seq"))).alias("llm_note"),
        F.min("seq").alias("seq"),
    )


# ---- point queries ---------------------------------------------------------


def is_symbol(c: Column, type_: str, name: str, class_name: str | None) -> Column:
    return (c["type"] == type_) & (c["name"] == name) & c["class_name"].eqNullSafe(F.lit(class_name))


def of_type(c: Column, kind: str) -> Column:
    if kind not in FILTERS:
        raise ValueError(f"unknown filter {kind!r}")
    return F.lit(True) if kind == "all" else c["type"] == kind


def regex_filter(c: Column, pattern: str) -> Column:
    """Unanchored search; a pattern that Python rejects is an error, Python's named groups are rewritten for Java."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"Invalid regex pattern {pattern!r}: {e}") from e
    if re.search(r"\(\?P[=>]|\(\?\(|\\Z", pattern):
        return _python_search(pattern)(c)
    return c.rlike(pattern.replace("(?P<", "(?<"))


def _python_search(pattern: str):
    """Search by Python's own dialect, for patterns that Java has no form of."""
    import pandas as pd

    def search(names: pd.Series) -> pd.Series:
        found = re.compile(pattern)
        return names.map(lambda x: None if x is None else found.search(x) is not None)

    search.__annotations__ = {"names": pd.Series, "return": pd.Series}
    return F.pandas_udf(search, "boolean")


def facts(index: SymbolIndex, condition: Column) -> DataFrame:
    """(kind, symbol, location, seq) of definitions and references whose symbol meets the condition; the filter reaches both scans."""
    d = index.all_definitions().where(condition).select(F.lit("definition").alias("kind"), "symbol", "location", "seq")
    r = index.all_references().where(condition).select(F.lit("reference").alias("kind"), "symbol", "location", "seq")
    return d.unionByName(r)


def query_by_key(index: SymbolIndex, type_: str, name: str, class_name: str | None = None) -> DataFrame:
    return facts(index, is_symbol(F.col("symbol"), type_, name, class_name))


def query_by_name(index: SymbolIndex, name: str, kind: str = "all") -> DataFrame:
    return facts(index, (F.col("symbol.name") == name) & of_type(F.col("symbol"), kind))


def query_by_regex(index: SymbolIndex, pattern: str, kind: str = "all") -> DataFrame:
    return facts(index, regex_filter(F.col("symbol.name"), pattern) & of_type(F.col("symbol"), kind))


def query_full_definition(index: SymbolIndex, type_: str, name: str, class_name: str | None, at: Column) -> DataFrame:
    """The definition at a location and all references of its symbol; nothing where the symbol is not defined there."""
    own = query_by_key(index, type_, name, class_name)
    hit = own.where((F.col("kind") == "definition") & at)
    return hit.unionByName(own.where("kind = 'reference'").join(hit.select(F.col("symbol").alias("__s")).distinct(), same_symbol(F.col("symbol"), F.col("__s")), "left_semi"))


def find_full_definition(index: SymbolIndex, locations: DataFrame) -> DataFrame:
    """(location, symbol, doc): the owner of each given location; of several the least by type, name and class."""
    found = index.all_definitions().join(locations.select("location").distinct(), "location", "left_semi")
    return found.groupBy("location").agg(F.min(F.struct("symbol", "doc")).alias("m")).select("location", "m.symbol", "m.doc")


def find_definitions(index: SymbolIndex, name: str) -> DataFrame:
    """Definitions of functions of that name; methods are not looked up."""
    return index.all_definitions().where(is_symbol(F.col("symbol"), "function", name, None))


def find_references(index: SymbolIndex, name: str) -> DataFrame:
    return index.all_references().where(is_symbol(F.col("symbol"), "function", name, None))


def with_source(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` with ``source_code``: the bytes of their location as text, null where the file or the bytes are not there."""
    content = files.select(F.col("file_path").alias("__f"), F.col("content").alias("__c"))
    start, end = F.col("location.start_byte"), F.col("location.end_byte")
    text = F.try_validate_utf8(F.substring(F.col("__c"), start + 1, end - start).cast("string"))
    return rows.join(content, F.col("location.file_path") == F.col("__f"), "left").withColumn("source_code", F.when(F.col("__c").isNotNull(), text)).drop("__f", "__c")


def names_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("qualified_name", qualified(F.col("symbol")))
