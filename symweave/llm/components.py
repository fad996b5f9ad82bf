"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import materialise


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


#: Edges in one file of a round.
FILE_ROWS = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(u, m): for every node of the edges (u, v), the smallest node that it reaches.

    Each round joins the edges with one minimum a node; no neighbour list is
    ever gathered, so a node of any degree is spread by the join. The number of
    rounds grows with the logarithm of the largest component; they go on until
    nothing changes.
    """
    current = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, files = None, max(2, -(-current.count() // FILE_ROWS))
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the least of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself move to the least of them
        small = large.join(_least(large), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        current = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "edges", files=files)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return current.select("u", F.col("v").alias("m"))
        mark = now
