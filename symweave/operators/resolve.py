"""Call resolution: calls joined with the definitions of their callee."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.schema import same_symbol
from symweave.storage import materialise

MUST, MAY = "must", "may"
NO_DEFINITIONS, AMBIGUOUS = "no_definitions_found", "ambiguous_targets"
#: Above so many edges a plain join of calls and targets is left for runs.
PLAIN_EDGES = 2_000_000
#: Calls of a task, so few that Parquet's dictionaries hold them, and edges that are put out together.
TASK_CALLS, PIECE_EDGES = 48_000, 4_000_000


def target_counts(definitions: DataFrame) -> DataFrame:
    """(symbol, n_targets): definitions of each symbol."""
    return definitions.groupBy("symbol").agg(F.count("*").alias("n_targets"))


def sites(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Calls with ``n_targets``; 0 where nothing defines the callee. The counts are one row a symbol, so a hot callee only fans in."""
    counts = target_counts(definitions).select(F.col("symbol").alias("__s"), "n_targets")
    return calls.join(counts, same_symbol(F.col("callee.symbol"), F.col("__s")), "left").drop("__s").withColumn("n_targets", F.coalesce("n_targets", F.lit(0)))


def call_edges(calls: DataFrame, definitions: DataFrame, expand_calls: bool = True) -> DataFrame:
    """(caller, callee, seq, target, kind): one row for each call site and target; parallel edges stay."""
    return edges_of(sites(calls, definitions), definitions, expand_calls)


def edges_of(found: DataFrame, definitions: DataFrame, expand_calls: bool = True) -> DataFrame:
    """The edges of call sites whose targets are counted."""
    wanted = F.col("n_targets") >= 1 if expand_calls else F.col("n_targets") == 1
    carried = [c for c in ("symbol", "location", "node_id") if c in definitions.columns]
    targets = definitions.select(F.struct(*carried).alias("target"))
    joined = found.where(wanted).join(targets, same_symbol(F.col("callee.symbol"), F.col("target.symbol")))
    return joined.withColumn("kind", F.when(F.col("n_targets") == 1, MUST).otherwise(MAY)).drop("n_targets")


def target_classes(definitions: DataFrame, kind: str) -> DataFrame:
    """(symbol, class_id, n_targets) of the symbols whose calls are edges of that kind."""
    wanted = F.col("n_targets") == 1 if kind == MUST else F.col("n_targets") > 1
    return materialise(target_counts(definitions).where(wanted).withColumn("class_id", F.monotonically_increasing_id()), "target-classes")


def classed(symbols: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with a ``symbol`` and its ``class_id``; those of other symbols go."""
    return symbols.join(classes.select(F.col("symbol").alias("__s"), "class_id"), same_symbol(F.col("symbol"), F.col("__s"))).drop("__s")


def edges_in_runs(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Every call with every target of its ``class_id``: the other columns of both.

    Calls are written once without symbols and counted. Of many edges, those of a class come out together and the targets of a
    call one after the other in the same order for every call, which columns of a file hold in little space; a class of many
    edges is cut by its calls into pieces, so no task gets it whole.
    """
    calls = materialise(calls, "classed-calls")
    asked = calls.groupBy("class_id").agg(F.count("*").alias("sites")).join(targets.groupBy("class_id").agg(F.count("*").alias("n")), "class_id")
    asked = materialise(asked.select("class_id", "sites", (F.col("sites") * F.col("n")).alias("edges")), "class-edges")
    sites, edges = asked.agg(F.sum("sites"), F.sum("edges")).first()
    if (edges or 0) <= PLAIN_EDGES:
        return calls.join(targets.hint("merge"), "class_id").drop("class_id")
    pieces = F.ceil(F.col("edges") / PIECE_EDGES).cast("int")
    cut = F.broadcast(asked.where(F.col("edges") > PIECE_EDGES).select("class_id", pieces.alias("pieces")))  # one row for each PIECE_EDGES edges at most
    of_call = F.coalesce(F.pmod(F.xxhash64(*calls.columns), F.col("pieces")), F.lit(0)).cast("int")
    of_target = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))
    tasks = max(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sites // TASK_CALLS), -(-edges // (8 * PIECE_EDGES)))
    dealt = [df.join(cut, "class_id", "left").withColumn("piece", piece).drop("pieces").repartition(tasks, "class_id", "piece") for df, piece in ((calls, of_call), (targets, of_target))]
    return dealt[0].join(dealt[1].hint("merge"), ["class_id", "piece"]).drop("class_id", "piece")


def unresolved(calls: DataFrame, definitions: DataFrame, expand_calls: bool = True) -> DataFrame:
    """(caller, via_symbol, callsite, reason) of call sites that get no edge."""
    return unresolved_of(sites(calls, definitions), expand_calls)


def unresolved_of(found: DataFrame, expand_calls: bool = True) -> DataFrame:
    """The unresolved ones of call sites whose targets are counted."""
    reason = F.when(F.col("n_targets") == 0, NO_DEFINITIONS)
    if not expand_calls:
        reason = reason.when(F.col("n_targets") > 1, AMBIGUOUS)
    return found.withColumn("reason", reason).where("reason is not null").select("caller", F.col("callee.symbol").alias("via_symbol"), F.col("callee.location").alias("callsite"), "reason")


def summary(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(outcome, call_sites, edges): call sites by how they resolve."""
    outcome = F.when(F.col("n_targets") == 0, NO_DEFINITIONS).when(F.col("n_targets") == 1, MUST).otherwise(MAY)
    return sites(calls, definitions).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("call_sites"), F.sum("n_targets").cast("long").alias("edges"))
