"""Projections of the star-schema tables onto the engine's relations.

The tables hold no source code, so the registered queries run the operators on
relations built from them: parts are symbols, consecutive parts of an order are
calls, customers of a nation form chains with back edges. Every projection
covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symweave.operators.index import SymbolIndex
from symweave.schema import location, symbol
from symweave.storage import table

#: Parts of at most this size are known by name only: they have no definition.
EXTERNAL_SIZE = 5


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, p_size, symbol, location): each part as a symbol with a place."""
    method = F.col("p_size") % 4 == 0
    sym = symbol(F.when(method, "method").otherwise("function"), F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_size").cast("string")), F.when(method, F.col("p_brand")))
    start = (F.col("p_partkey") * 100).cast("int")
    loc = location(F.col("p_brand"), F.col("p_partkey") + 1, F.lit(0), F.col("p_partkey") + 2, F.lit(0), start, start + 100)
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", sym.alias("symbol"), loc.alias("location"))


def part_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = part_symbols(spark, sf_dir).where(F.col("p_size") > EXTERNAL_SIZE)
    return parts.select("p_partkey", "symbol", "location", F.col("p_type").alias("doc"), F.lit(None).cast("struct<description:string,potential_vulnerabilities:string,control_flow:string>").alias("llm_note"), F.col("p_partkey").alias("seq"))


def following_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, caller_key, callee_key): the part of each line of an order and that of the next one."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.withColumn("callee_key", F.lead("l_partkey").over(w)).where("callee_key is not null").withColumnRenamed("l_partkey", "caller_key")


def site_byte() -> Column:
    return (F.col("l_orderkey") % 1_000_000 * 100 + F.col("l_linenumber") * 10).cast("int")


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller, callee, seq): each line of an order calls the next one, if the caller is defined."""
    lines = following_lines(spark, sf_dir)
    callers = part_definitions(spark, sf_dir).select(F.col("p_partkey").alias("caller_key"), F.struct("symbol", "location").alias("caller"))
    callees = part_symbols(spark, sf_dir).select(F.col("p_partkey").alias("callee_key"), F.col("symbol").alias("callee_symbol"))
    joined = lines.join(callees, "callee_key").join(callers, "caller_key")  # the wide side last, so that only its own rows are shuffled
    start = site_byte()
    site = location(F.col("caller.location.file_path"), F.col("l_orderkey") % 1_000_000 + 1, F.col("l_linenumber"), F.col("l_orderkey") % 1_000_000 + 1, F.col("l_linenumber") + 5, start, start + 5)
    return joined.select("caller", F.struct(F.col("callee_symbol").alias("symbol"), site.alias("location")).alias("callee"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), "caller_key", "callee_key")


def call_bytes(spark: SparkSession, sf_dir: str, callees: DataFrame) -> DataFrame:
    """(src_byte, site_byte, class_id): the calls of ``order_calls`` by their first bytes, narrow from the start, of callees(p_partkey, class_id)."""
    lines = following_lines(spark, sf_dir).select("caller_key", "callee_key", site_byte().alias("site_byte"))
    callers = part_definitions(spark, sf_dir).select(F.col("p_partkey").alias("caller_key"), F.col("location.start_byte").alias("src_byte"))
    return lines.join(callers, "caller_key").join(callees.select(F.col("p_partkey").alias("callee_key"), "class_id"), "callee_key").select("src_byte", "site_byte", "class_id")


def part_index(spark: SparkSession, sf_dir: str, mode: str = "crossref") -> SymbolIndex:
    calls = order_calls(spark, sf_dir)
    references = calls.select("callee.symbol", "callee.location", "seq")
    return SymbolIndex(part_definitions(spark, sf_dir).drop("p_partkey"), references, calls.select("caller", "callee", "seq"), mode)


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, ordinal): within a nation each customer points at the next by balance, and back at the one before it in the same market segment."""
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    chain = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lead("c_custkey").over(w).alias("following"), F.lead("c_mktsegment").over(w).alias("segment")).where("following is not null")
    ahead = chain.select(F.col("c_custkey").alias("src"), F.col("following").alias("dst"), F.lit(0).cast("long").alias("ordinal"))
    back = chain.where("c_mktsegment = segment").select(F.col("following").alias("src"), F.col("c_custkey").alias("dst"), F.lit(1).cast("long").alias("ordinal"))
    return ahead.unionByName(back)


def customer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"))


def _identifier(c):
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def part_files(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """files(file_path, content): every defined part written out as source, with its calls in its body."""
    calls = order_calls(spark, sf_dir).groupBy("caller_key").agg(F.array_sort(F.collect_list(_identifier(F.col("callee.symbol.name")))).alias("called"))
    parts = part_definitions(spark, sf_dir).join(calls, F.col("p_partkey") == F.col("caller_key"), "left")
    name, called = _identifier(F.col("symbol.name")), F.coalesce("called", F.array().cast("array<string>"))
    if lang == "python":
        inside = F.col("symbol.class_name").isNotNull()
        pad = F.when(inside, "    ").otherwise("")
        head = F.when(inside, F.concat(F.lit("class "), _identifier(F.col("symbol.class_name")), F.lit(":\n    def "), name, F.lit("(self):\n"))).otherwise(F.concat(F.lit("def "), name, F.lit("():\n")))
        doc = F.concat(pad, F.lit('    """'), F.col("doc"), F.lit('"""\n'))
        body = F.array_join(F.transform(called, lambda c: F.concat(pad, F.lit("    "), c, F.lit("(1)\n"))), "")
        text = F.concat(head, doc, body)
    else:
        body = F.array_join(F.transform(called, lambda c: F.concat(F.lit("    "), c, F.lit("(1, \"(\");\n"))), "")
        text = F.concat(F.lit("/* "), F.col("doc"), F.lit(" */\nint "), name, F.lit("(void)\n{\n"), body, F.lit("    return 0;\n}\n"))
    suffix = {"python": ".py", "c": ".c", "cpp": ".cpp"}[lang]
    return parts.select(F.concat(_identifier(F.col("location.file_path")), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(suffix)).alias("file_path"), text.cast("binary").alias("content"))
