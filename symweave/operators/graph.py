"""Call graphs and the loops over them.

A graph is ``nodes(node_id, ...)`` and ``edges(src, dst, ordinal, ...)``; the
ordinal orders the edges of one source. Every loop has two strategies with equal
results: joins over the edge table, one step a round, for graphs of any size;
and, for graphs of at most ``LOCAL_EDGES`` edges (counted first), one task that
holds the adjacency.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.operators import resolve
from symweave.operators.index import SymbolIndex
from symweave.schema import same_symbol
from symweave.storage import materialise, numbered

#: Edges that one task may hold (24 bytes each and their adjacency).
LOCAL_EDGES = 2_000_000
FORWARD, BACKWARD, BOTH = "forward", "backward", "both"
DIRECTIONS = (FORWARD, BACKWARD, BOTH)


@dataclass(frozen=True)
class CallGraph:
    """nodes(node_id, owner, location), edges(src, dst, ordinal, kind), unresolved(caller, via_symbol, callsite, reason).

    A call of a symbol with many definitions is as many edges, so edges may grow with the square of the sources. A graph of more
    than ``LOCAL_EDGES`` edges keeps them apart: calls(src, cid, kind, place, seq) and members(cid, node_id), classes of nodes that
    the same symbols name. Each node is in one class, and a call and a member of its class are one edge. ``edges`` is then a plan
    only, and the functions on graphs walk the calls and members.
    """

    nodes: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    calls: DataFrame | None = None
    members: DataFrame | None = None

    def stats(self) -> DataFrame:
        """(num_nodes, num_edges, unresolved_calls): edges are counted with their parallels."""
        if self.calls is not None:
            n_edges = self.calls.join(class_sizes(self), "cid").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_edges"))
            return self.nodes.agg(F.count("*").alias("num_nodes")).crossJoin(n_edges).crossJoin(self.unresolved.agg(F.count("*").alias("unresolved_calls")))
        kinds = [df.select(F.lit(name).alias("k")) for name, df in (("num_nodes", self.nodes), ("num_edges", self.edges), ("unresolved_calls", self.unresolved))]
        both = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
        return both.agg(*[F.count(F.when(F.col("k") == name, 1)).alias(name) for name in ("num_nodes", "num_edges", "unresolved_calls")])


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as they are, turned round, or both (the turned ones after the others)."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    rest = [c for c in edges.columns if c not in ("src", "dst", "ordinal")]
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ordinal", *rest)
    if direction == FORWARD:
        return edges
    if direction == BACKWARD:
        return turned
    return edges.unionByName(turned.withColumn("ordinal", F.col("ordinal") + F.lit(1 << 40)))


def call_graph(index: SymbolIndex, expand_calls: bool = True, direction: str = FORWARD, entrypoints: DataFrame | None = None) -> CallGraph:
    """Nodes are definitions by location (the least symbol owns a shared one), numbered by place; edges are resolved calls.

    ``entrypoints`` (column ``location``) prunes to what they reach.
    """
    calls = materialise(index.calls, "calls")
    definitions = materialise(replace(index, calls=calls).all_definitions().select("symbol", "location"), "definitions")
    owned = definitions.groupBy("location").agg(F.min("symbol").alias("owner"))
    nodes = numbered(owned, [F.col("location.file_path"), F.col("location.start_byte"), F.col("location.end_byte"), F.col("location")], "node_id")
    at = nodes.select("location", "node_id")
    # nodes that the same symbols name, each as often, are one class; the order of a source's edges is that of its call sites and their targets
    named = definitions.join(at, "location").groupBy("node_id", "symbol").agg(F.count("*").alias("times"))
    signed = named.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("symbol", "times"))).alias("names"))
    signed = materialise(signed, "signed")
    classes = materialise(signed.groupBy("names").agg(F.min("node_id").alias("cid"), F.count("*").alias("n")), "classes")
    members = materialise(signed.join(classes, "names").select("cid", "node_id"), "members")
    hits = classes.select("cid", "n", F.explode("names").alias("e")).select("cid", "n", "e.symbol", "e.times")
    counts = hits.groupBy("symbol").agg(F.sum(F.col("n") * F.col("times")).alias("n_targets"))
    hits = materialise(hits.join(counts, "symbol").where("true" if expand_calls else "n_targets = 1").drop("n"), "hits")
    hit = F.when(F.col("n_targets") == 1, resolve.MUST).otherwise(resolve.MAY).alias("kind"), F.col("callee.location").alias("place"), "seq", "times"
    sited = calls.join(hits, same_symbol(F.col("callee.symbol"), F.col("symbol"))).select(F.col("caller.location").alias("location"), "cid", *hit)
    sited = sited.join(at, "location").select(F.col("node_id").alias("src"), "cid", "kind", "place", "seq", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("again")).drop("again")
    sited = materialise(sited, "sites")
    graph = CallGraph(nodes, expanded(sited, members), resolve.unresolved_of(resolve.sites(calls, definitions), expand_calls), sited, members)
    n_edges = sited.join(classes.select("cid", "n"), "cid").agg(F.sum("n")).first()[0] or 0
    if n_edges <= LOCAL_EDGES:
        graph = replace(graph, edges=materialise(graph.edges, "edges"), calls=None, members=None)
    if entrypoints is not None:
        roots = nodes.join(entrypoints.select("location").distinct(), "location", "left_semi").select("node_id")
        reached = graph_reachable(graph, roots) if direction == FORWARD else reachable(directed(graph.edges, direction), roots)
        graph = induced(graph, reached)
    return graph if direction == FORWARD else replace(graph, edges=directed(graph.edges, direction), calls=None, members=None)


def call_stats(index: SymbolIndex, expand_calls: bool = True) -> DataFrame:
    """The ``stats`` of an index's call graph, from counts by symbol; no graph is made."""
    definitions = index.all_definitions().select("symbol", "location")
    placed = F.col("caller.location").isNotNull()
    calls = index.calls.select("caller", "callee")
    if index.mode == "simple":  # callers without a definition are no nodes here
        calls = calls.join(definitions.select(F.col("location").alias("__l")).distinct(), F.col("caller.location") == F.col("__l"), "left")
        placed = F.col("__l").isNotNull()
    asked = calls.groupBy("callee.symbol").agg(F.count("*").alias("sites"), F.count(F.when(placed, 1)).alias("placed"))
    found = resolve.sites(asked.select(F.struct("symbol").alias("callee"), "sites", "placed"), definitions)
    lost = F.col("n_targets") == 0 if expand_calls else F.col("n_targets") != 1
    edges = F.col("placed") * F.col("n_targets") if expand_calls else F.when(F.col("n_targets") == 1, F.col("placed"))
    sums = found.agg(F.coalesce(F.sum(edges), F.lit(0)).alias("num_edges"), F.coalesce(F.sum(F.when(lost, F.col("sites"))), F.lit(0)).alias("unresolved_calls"))
    return definitions.select("location").distinct().agg(F.count("*").alias("num_nodes")).crossJoin(sums)


# ---- graphs of calls and classes ---------------------------------------------


def class_sizes(graph: CallGraph) -> DataFrame:
    return graph.members.groupBy("cid").agg(F.count("*").alias("n"))


def in_turn(calls: DataFrame) -> DataFrame:
    """(src, turn, cid, kind): the calls of each source numbered in order of their sites."""
    order = Window.partitionBy("src").orderBy("place.start_byte", "place", "seq")
    return calls.select("src", F.dense_rank().over(order).cast("long").alias("turn"), "cid", "kind")


def expanded(calls: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, ordinal, kind): every edge."""
    order = Window.partitionBy("src").orderBy("turn", "dst")
    each = in_turn(calls).join(members.withColumnRenamed("node_id", "dst"), "cid")
    return each.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")).select("src", "dst", "ordinal", "kind")


def hops(graph: CallGraph) -> DataFrame:
    """(src, dst): a graph with as many paths, in which a call leads to its class, a node below zero, and that to its members."""
    at = -F.col("cid") - 1
    return graph.calls.select("src", at.alias("dst")).distinct().unionByName(graph.members.select(at.alias("src"), F.col("node_id").alias("dst")))


def graph_reachable(graph: CallGraph, roots: DataFrame, depth: int | None = None, direction: str = FORWARD) -> DataFrame:
    """``reachable`` on a graph of either form."""
    if graph.calls is None:
        return reachable(directed(graph.edges, direction), roots, depth)
    steps = hops(graph) if direction == FORWARD else hops(graph).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(steps, roots, None if depth is None else 2 * depth).where("node_id >= 0").select("node_id", (F.col("level") / 2).cast("int").alias("level"))


def graph_components(graph: CallGraph) -> tuple[DataFrame, DataFrame]:
    """(node_id, scc_id) and (src_scc, dst_scc) of a graph of either form."""
    if graph.calls is None:
        sccs = materialise(components(graph.nodes, graph.edges), "sccs")
        return sccs, materialise(component_edges(graph.edges, sccs), "dag")
    ids = graph.nodes.select("node_id").unionByName(graph.members.select((-F.col("cid") - 1).alias("node_id")).distinct())
    real = components(ids, materialise(hops(graph), "hops")).where("node_id >= 0")
    sccs = materialise(real.join(real.groupBy("scc_id").agg(F.min("node_id").alias("least")), "scc_id").select("node_id", F.col("least").alias("scc_id")), "sccs")
    ahead = graph.calls.select(F.col("src").alias("node_id"), "cid").join(sccs, "node_id").select("cid", F.col("scc_id").alias("src_scc")).distinct()
    behind = graph.members.join(sccs, "node_id").select("cid", F.col("scc_id").alias("dst_scc")).distinct()
    return sccs, materialise(ahead.join(behind, "cid").where("src_scc <> dst_scc").select("src_scc", "dst_scc").distinct(), "dag")


def graph_degrees(graph: CallGraph) -> DataFrame:
    """``degrees`` of a graph of either form."""
    if graph.calls is None:
        return degrees(graph.nodes, graph.edges)
    out = graph.calls.join(class_sizes(graph), "cid").groupBy(F.col("src").alias("node_id")).agg(F.sum("n").alias("n_out"))
    into = graph.calls.groupBy("cid").agg(F.count("*").alias("n_in")).join(graph.members, "cid").select("node_id", "n_in")
    return graph.nodes.select("node_id").join(into, "node_id", "left").join(out, "node_id", "left").fillna(0, ["n_in", "n_out"])


def edge_counts(graph: CallGraph, direction: str = FORWARD) -> DataFrame:
    """(node_id, edges, targets): of each node with edges in that direction their number and that of the distinct nodes they lead to."""
    if graph.calls is None:
        return directed(graph.edges, direction).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("targets"))
    pairs = materialise(graph.calls.groupBy("src", "cid").agg(F.count("*").alias("c")), "pairs")
    out = pairs.join(class_sizes(graph), "cid").groupBy(F.col("src").alias("node_id")).agg(F.sum(F.col("c") * F.col("n")).alias("edges"), F.sum("n").alias("targets"))
    into = pairs.groupBy("cid").agg(F.sum("c").alias("edges"), F.count("*").alias("targets")).join(graph.members, "cid").select("node_id", "edges", "targets")
    if direction != BOTH:
        return {FORWARD: out, BACKWARD: into}[direction]
    # a node that lies both ahead and behind counts once: of class B, it is called by x of class A and calls A
    owned = materialise(pairs.select("src", "cid").join(graph.members.select(F.col("node_id").alias("src"), F.col("cid").alias("own")), "src"), "owned")
    back = owned.groupBy(F.col("own").alias("cid"), F.col("cid").alias("own")).agg(F.count("*").alias("n"))
    twice = owned.join(back, ["cid", "own"]).groupBy(F.col("src").alias("node_id")).agg((-F.sum("n")).alias("targets")).select("node_id", F.lit(0).cast("long").alias("edges"), "targets")
    return out.unionByName(into).unionByName(twice).groupBy("node_id").agg(F.sum("edges").alias("edges"), F.sum("targets").alias("targets"))


def graph_order(graph: CallGraph, starts: DataFrame) -> DataFrame:
    """``bfs_order`` of a graph of either form. A class is reached whole, by the first call of it, so each is followed once."""
    if graph.calls is None:
        return bfs_order(graph.nodes, graph.edges, starts)
    turns = materialise(in_turn(graph.calls).groupBy("src", "cid").agg(F.min("turn").alias("turn")), "turns")
    ids = graph.nodes.select("node_id")
    firsts = starts.join(ids, "node_id", "left_semi").groupBy("node_id").agg(F.min("rank").alias("rank"))
    level = numbered(firsts, [F.col("rank"), F.col("node_id")], "position").select("node_id", "position")
    seen, base, met = level, level.count(), turns.select("cid").limit(0)
    while True:
        offers = turns.join(level.withColumnRenamed("node_id", "src"), "src").groupBy("cid").agg(F.min(F.struct("position", "turn")).alias("k"))
        fresh = materialise(offers.join(met, "cid", "left_anti"), "fresh")
        met = met.unionByName(fresh.select("cid"))
        reached = fresh.join(graph.members, "cid").join(seen, "node_id", "left_anti")
        level = numbered(reached, [F.col("k.position"), F.col("k.turn"), F.col("node_id")], "at").select("node_id", (F.col("at") + base).alias("position"))
        n = level.count()
        if not n:
            break
        seen, base = seen.unionByName(level), base + n
    rest = numbered(ids.distinct().join(seen, "node_id", "left_anti"), [F.col("node_id")], "at").select("node_id", (F.col("at") + base).alias("position"))
    return seen.unionByName(rest)


def graph_paths(graph: CallGraph, src: int, dst: int, k: int = 1, max_depth: int | None = None) -> DataFrame:
    """``first_paths`` of a graph of either form. A prefix grows only by nodes whose least steps to the goal are left."""
    if graph.calls is None or k <= 0 or src == dst:
        return first_paths(graph.edges, src, dst, k, max_depth)
    spark = graph.edges.sparkSession
    steps = graph_reachable(graph, spark.createDataFrame([(dst,)], "node_id long"), max_depth, BACKWARD)
    useful = materialise(graph.members.join(steps, "node_id").select("cid", F.col("node_id").alias("dst"), "level"), "useful")
    limit = useful.count() if max_depth is None else max_depth
    open_ = spark.createDataFrame([([src], [])], "nodes array<long>, ords array<struct<turn:long,dst:long>>")
    done: DataFrame | None = None
    for n in range(1, limit + 1):
        ends = open_.select(F.element_at("nodes", -1).alias("src")).distinct()
        turns = in_turn(graph.calls.join(ends, "src", "left_semi")).select("src", "turn", "cid")
        near = useful if max_depth is None else useful.where(F.col("level") <= max_depth - n)
        step = open_.withColumn("src", F.element_at("nodes", -1)).join(turns, "src").join(near, "cid").where(~F.array_contains("nodes", F.col("dst")))
        grown = materialise(step.select(F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("ords", F.array(F.struct("turn", "dst"))).alias("ords")), "paths")
        if grown.isEmpty():
            break
        ended = grown.where(F.element_at("nodes", -1) == dst)
        done = materialise((ended if done is None else done.unionByName(ended)).orderBy("ords").limit(k), "done")
        open_ = grown.where(F.element_at("nodes", -1) != dst)
        if done.count() >= k:
            worst = done.agg(F.max("ords").alias("w")).first()["w"]
            bound = F.array(*[F.struct(F.lit(x["turn"]).cast("long").alias("turn"), F.lit(x["dst"]).cast("long").alias("dst")) for x in worst])
            open_ = open_.where(F.col("ords") < bound)
    if done is None:
        return spark.createDataFrame([], "path_no int, nodes array<long>")
    return done.withColumn("path_no", F.row_number().over(Window.orderBy("ords")) - 1).select("path_no", "nodes")  # k rows at most


def induced(graph: CallGraph, kept: DataFrame) -> CallGraph:
    """The graph on the kept nodes (column ``node_id``), renumbered densely."""
    keep = kept.select("node_id").distinct()
    nodes = numbered(graph.nodes.join(keep, "node_id", "left_semi").withColumnRenamed("node_id", "__old"), [F.col("__old")], "node_id")
    ids = nodes.select(F.col("__old"), "node_id")
    if graph.calls is not None:
        sources = ids.select(F.col("__old").alias("src"), F.col("node_id").alias("__s"))
        calls = materialise(graph.calls.join(sources, "src").drop("src").withColumnRenamed("__s", "src"), "sites")
        members = materialise(graph.members.withColumnRenamed("node_id", "__old").join(ids, "__old").select("cid", "node_id"), "members")
        return replace(graph, nodes=nodes.drop("__old"), edges=expanded(calls, members), calls=calls, members=members)
    edges = graph.edges.join(ids.select(F.col("__old").alias("src"), F.col("node_id").alias("__s")), "src").join(ids.select(F.col("__old").alias("dst"), F.col("node_id").alias("__d")), "dst")
    rest = [c for c in graph.edges.columns if c not in ("src", "dst")]
    return replace(graph, nodes=nodes.drop("__old"), edges=edges.select(F.col("__s").alias("src"), F.col("__d").alias("dst"), *rest))


def subgraph(graph: CallGraph, roots: DataFrame | None = None, depth: int | None = None, include_reverse: bool = False) -> CallGraph:
    """What the roots (column ``node_id``) reach within ``depth`` steps; without roots, or with an empty set, the whole graph."""
    if roots is None or roots.isEmpty():
        return graph
    known = roots.join(graph.nodes.select("node_id"), "node_id", "left_semi")
    return induced(graph, reachable(directed(graph.edges, BOTH), known, depth) if include_reverse else graph_reachable(graph, known, depth))


# ---- strategies ------------------------------------------------------------


def _local(edges: DataFrame, strategy: str, *others: DataFrame) -> bool:
    """Whether one task may hold the edges and the other tables, each counted up to the bound."""
    if strategy not in ("auto", "local", "distributed"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return strategy == "local" or strategy == "auto" and all(df.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES for df in (edges, *others))


def _in_one_task(inputs: list[DataFrame], solve: Callable[..., list[np.ndarray]], schema: str, names: list[str]) -> DataFrame:
    """Run ``solve`` in one task on tables of long columns, each already bounded in size."""
    tagged = None
    width = max(len(df.columns) for df in inputs)
    for k, df in enumerate(inputs):
        cols = [F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(df.columns)] + [F.lit(None).cast("long").alias(f"c{i}") for i in range(len(df.columns), width)]
        part = df.select(F.lit(k).alias("t"), *cols)
        tagged = part if tagged is None else tagged.unionByName(part)
    widths = [len(df.columns) for df in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        tables: list[np.ndarray] = []
        whole = pa.Table.from_batches(held) if held else None
        for k, w in enumerate(widths):
            if whole is None:
                tables.append(np.zeros((0, w), np.int64))
                continue
            part = whole.filter(pa.compute.equal(whole.column("t"), k))
            tables.append(np.stack([part.column(f"c{i}").to_numpy() for i in range(w)], 1).astype(np.int64) if part.num_rows else np.zeros((0, w), np.int64))
        columns = solve(*tables)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return tagged.coalesce(1).mapInArrow(run, schema)


class Adjacency:
    """Edges of one task as arrays: nodes get dense numbers, targets of a node lie side by side in order of ordinal and number."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, ordinal: np.ndarray | None = None, more: np.ndarray | None = None):
        self.names = np.unique(np.concatenate([src, dst] + ([] if more is None else [more])))
        s, d = self.number(src), self.number(dst)
        order = np.argsort(s, kind="stable") if ordinal is None else np.lexsort((d, ordinal, s))
        self.targets = d[order]
        self.starts = np.searchsorted(s[order], np.arange(len(self.names) + 1))

    def number(self, names: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.names, names)

    def of(self, n: int) -> list[int]:
        return self.targets[self.starts[n] : self.starts[n + 1]].tolist()

    def ahead(self, nodes: np.ndarray) -> np.ndarray:
        """Distinct targets of many nodes."""
        size = self.starts[nodes + 1] - self.starts[nodes]
        at = np.repeat(self.starts[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.unique(self.targets[at])

    def levels(self, roots: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Least steps from the roots to each node, -1 beyond them."""
        level = np.full(len(self.names), -1, np.int32)
        level[roots] = 0
        front, step = np.unique(roots), 0
        while len(front) and (depth is None or step < depth):
            step += 1
            front = self.ahead(front)
            front = front[level[front] < 0]
            level[front] = step
        return level


# ---- reachability ----------------------------------------------------------


def reachable(edges: DataFrame, roots: DataFrame, depth: int | None = None, strategy: str = "auto") -> DataFrame:
    """(node_id, level): what the roots reach, with the least number of steps; at most ``depth`` steps."""
    pairs = edges.select("src", "dst")
    roots = roots.select("node_id").distinct()
    if _local(pairs, strategy, roots):

        def solve(e: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
            graph = Adjacency(e[:, 0], e[:, 1], None, r[:, 0])
            level = graph.levels(graph.number(r[:, 0]), depth)
            seen = level >= 0
            return [graph.names[seen], level[seen]]

        return _in_one_task([pairs, roots], solve, "node_id long, level int", ["node_id", "level"])
    pairs = materialise(pairs.distinct(), "pairs")
    seen = frontier = materialise(roots.select(F.col("node_id").cast("long"), F.lit(0).alias("level")), "frontier")
    step = 0
    while depth is None or step < depth:
        step += 1
        ahead = pairs.join(frontier.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").cast("long").alias("node_id")).distinct()
        frontier = materialise(ahead.join(seen, "node_id", "left_anti").withColumn("level", F.lit(step)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


# ---- strongly connected components -----------------------------------------


def tarjan(graph: Adjacency) -> np.ndarray:
    """For each node the least node of its component; iterative, so depth is not bounded by a stack."""
    n, targets, starts = len(graph.names), graph.targets.tolist(), graph.starts.tolist()
    number, low, where, at = [-1] * n, [0] * n, [-1] * n, starts[:-1].copy()
    stack: list[int] = []
    count = 0
    for root in range(n):
        if number[root] >= 0:
            continue
        walk = [root]
        while walk:
            x = walk[-1]
            if number[x] < 0:
                number[x] = low[x] = count
                count += 1
                stack.append(x)
            if at[x] < starts[x + 1]:
                d = targets[at[x]]
                at[x] += 1
                if number[d] < 0:
                    walk.append(d)
                elif where[d] < 0 and number[d] < low[x]:
                    low[x] = number[d]
                continue
            walk.pop()
            if walk and low[x] < low[walk[-1]]:
                low[walk[-1]] = low[x]
            if low[x] == number[x]:
                cut = len(stack) - 1
                while stack[cut] != x:
                    cut -= 1
                least = min(stack[cut:])
                for m in stack[cut:]:
                    where[m] = least
                del stack[cut:]
    return np.asarray(where, np.int64)


def components(nodes: DataFrame, edges: DataFrame, strategy: str = "auto") -> DataFrame:
    """(node_id, scc_id): strongly connected components, named by their least node."""
    pairs, ids = edges.select("src", "dst"), nodes.select("node_id")
    if _local(pairs, strategy, ids):

        def solve(e: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
            graph = Adjacency(e[:, 0], e[:, 1], None, n[:, 0])
            return [graph.names, graph.names[tarjan(graph)] if len(graph.names) else graph.names]

        return _in_one_task([pairs, ids], solve, "node_id long, scc_id long", ["node_id", "scc_id"])
    return _colour(ids.select(F.col("node_id").cast("long")), pairs)


def _fixpoint(labels: DataFrame, edges: DataFrame, better: Callable) -> DataFrame:
    """Spread labels(node_id, label) along edges until none changes; only changed labels travel on."""
    changed = labels
    while True:
        offers = edges.join(changed.select(F.col("node_id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node_id")).agg(better("label").alias("offer"))
        merged = materialise(labels.join(offers, "node_id", "left").select("node_id", "label", F.when(F.col("offer") < F.col("label"), F.col("offer")).alias("new")), "labels")
        changed = merged.where("new is not null").select("node_id", F.col("new").alias("label"))
        labels = merged.select("node_id", F.coalesce("new", "label").alias("label"))
        if changed.isEmpty():
            return labels


def _colour(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Forward colouring by the least reaching node, then backward search within a colour; settled nodes leave the graph."""
    left = materialise(pairs.where("src <> dst").select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct(), "pairs")
    open_ = materialise(nodes.distinct(), "open")
    settled: DataFrame | None = None
    while True:
        # nodes without an edge in or without one out are components of their own
        alive = left.select(F.col("src").alias("node_id")).intersect(left.select(F.col("dst").alias("node_id")))
        alone = materialise(open_.join(alive, "node_id", "left_anti").select("node_id", F.col("node_id").alias("scc_id")), "alone")
        settled = alone if settled is None else settled.unionByName(alone)
        open_ = materialise(open_.join(alone, "node_id", "left_anti"), "open")
        if open_.isEmpty():
            return settled
        shrunk = left.join(open_.select(F.col("node_id").alias("src")), "src", "left_semi").join(open_.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")
        if not alone.isEmpty():
            left = materialise(shrunk, "pairs")
            continue
        colour = materialise(_fixpoint(open_.select("node_id", F.col("node_id").alias("label")), left, F.min), "colour")
        # within a colour, whoever reaches the colour's own node is in its component
        of = colour.select("node_id", F.col("label").alias("colour"))
        inside = left.join(of.withColumnRenamed("node_id", "src").withColumnRenamed("colour", "cs"), "src").join(of.withColumnRenamed("node_id", "dst").withColumnRenamed("colour", "cd"), "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        member = materialise(reachable(materialise(inside, "inside"), of.where("node_id = colour").select("node_id"), None, "distributed").select("node_id"), "member")
        settled = settled.unionByName(of.join(member, "node_id", "left_semi").select("node_id", F.col("colour").alias("scc_id")))
        open_ = materialise(open_.join(member, "node_id", "left_anti"), "open")
        left = materialise(left.join(member.select(F.col("node_id").alias("src")), "src", "left_anti").join(member.select(F.col("node_id").alias("dst")), "dst", "left_anti").select("src", "dst"), "pairs")


def component_edges(edges: DataFrame, sccs: DataFrame) -> DataFrame:
    """(src_scc, dst_scc): distinct edges between components."""
    a = sccs.select(F.col("node_id").alias("src"), F.col("scc_id").alias("src_scc"))
    b = sccs.select(F.col("node_id").alias("dst"), F.col("scc_id").alias("dst_scc"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").where("src_scc <> dst_scc").select("src_scc", "dst_scc").distinct()


def component_sizes(sccs: DataFrame) -> DataFrame:
    """(scc_id, size, sample): sample holds the five least members."""
    rank = F.row_number().over(Window.partitionBy("scc_id").orderBy("node_id"))
    few = sccs.withColumn("r", rank).where("r <= 5").groupBy("scc_id").agg(F.array_sort(F.collect_list("node_id")).alias("sample"))
    return sccs.groupBy("scc_id").agg(F.count("*").alias("size")).join(few, "scc_id")


def terminal_components(sccs: DataFrame, scc_edges: DataFrame, side: str) -> DataFrame:
    """(scc_id) of components without an edge in (``entry``) or out (``end``)."""
    column = {"entry": "dst_scc", "end": "src_scc"}[side]
    return sccs.select("scc_id").distinct().join(scc_edges.select(F.col(column).alias("scc_id")).distinct(), "scc_id", "left_anti")


# ---- breadth-first order ---------------------------------------------------


def starting_nodes(nodes: DataFrame, edges: DataFrame, direction: str = FORWARD, sccs: DataFrame | None = None) -> DataFrame:
    """(node_id, rank): members of components without an edge in (without one out for the other directions), in order of component and node."""
    sccs = components(nodes, edges) if sccs is None else sccs
    found = terminal_components(sccs, component_edges(edges, sccs), "entry" if direction == FORWARD else "end")
    return sccs.join(found, "scc_id", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, n_in, n_out) of every node; parallel edges count each."""
    ends = edges.select(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    each = ends.groupBy("node_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select("node_id").join(each, "node_id", "left").fillna(0, ["n_in", "n_out"])


def plain_starts(nodes: DataFrame, edges: DataFrame, direction: str = FORWARD, each: DataFrame | None = None) -> DataFrame:
    """(node_id, rank) without components: nodes without an edge in (without one out for the other directions); where there are none, the first node (the last). ``each``: the degrees, if known."""
    ahead = direction == FORWARD
    found = (degrees(nodes, edges) if each is None else each).where(F.col("n_in" if ahead else "n_out") == 0).select("node_id", F.col("node_id").alias("rank"))
    if not found.isEmpty():
        return found
    end = nodes.agg((F.min if ahead else F.max)("node_id").alias("node_id")).where("node_id is not null")
    return end.select("node_id", F.col("node_id").alias("rank"))


def bfs_order(nodes: DataFrame, edges: DataFrame, starts: DataFrame, strategy: str = "auto") -> DataFrame:
    """(node_id, position): plain breadth-first order; starts in their ``rank``, unreached nodes after the others by number."""
    links = edges.select("src", "dst", "ordinal")
    ids = nodes.select("node_id")
    firsts = starts.join(ids, "node_id", "left_semi").select("node_id", "rank")
    if _local(links, strategy, ids, firsts):

        def solve(e: np.ndarray, n: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
            graph = Adjacency(e[:, 0], e[:, 1], e[:, 2], n[:, 0])
            seen, order = np.zeros(len(graph.names), bool), []
            queue = deque(graph.number(s[np.lexsort((s[:, 0], s[:, 1])), 0]).tolist())
            while queue:
                x = queue.popleft()
                if not seen[x]:
                    seen[x] = True
                    order.append(x)
                    queue.extend(d for d in graph.of(x) if not seen[d])
            rest = np.unique(n[:, 0])
            rest = rest[~seen[graph.number(rest)]]
            out = np.concatenate([graph.names[np.asarray(order, np.int64)], rest])
            return [out, np.arange(len(out), dtype=np.int64)]

        return _in_one_task([links, ids, firsts], solve, "node_id long, position long", ["node_id", "position"])
    links = materialise(links, "links")
    level = numbered(firsts.groupBy("node_id").agg(F.min("rank").alias("rank")), [F.col("rank"), F.col("node_id")], "position").select("node_id", "position")
    seen, base = level, level.count()
    while True:
        offers = links.join(level.select(F.col("node_id").alias("src"), "position"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.min(F.struct("position", "ordinal", "dst")).alias("k"))
        fresh = offers.join(seen, "node_id", "left_anti")
        level = numbered(fresh, [F.col("k.position"), F.col("k.ordinal"), F.col("k.dst")], "at").select("node_id", (F.col("at") + base).alias("position"))
        n = level.count()
        if not n:
            break
        seen, base = seen.unionByName(level), base + n
    rest = numbered(ids.distinct().join(seen, "node_id", "left_anti"), [F.col("node_id")], "at").select("node_id", (F.col("at") + base).alias("position"))
    return seen.unionByName(rest)


# ---- paths -----------------------------------------------------------------


def first_paths(edges: DataFrame, src: int, dst: int, k: int = 1, max_depth: int | None = None, strategy: str = "auto") -> DataFrame:
    """(path_no, nodes): the first ``k`` simple paths in depth-first order, that is, by the ordinals of their edges; parallel edges repeat a path.

    Only edges between nodes that ``src`` reaches and that reach ``dst`` are followed. ``max_depth`` counts edges.
    """
    spark = edges.sparkSession
    schema = "path_no int, nodes array<long>"
    if k <= 0:
        return spark.createDataFrame([], schema)
    if src == dst:
        return spark.createDataFrame([(0, [src])], schema)
    links = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("ordinal").cast("long"))
    if _local(links, strategy):

        def solve(e: np.ndarray) -> list:
            ends = np.asarray([src, dst])
            graph, back = Adjacency(e[:, 0], e[:, 1], e[:, 2], ends), Adjacency(e[:, 1], e[:, 0], None, ends)
            a, goal = graph.number(ends).tolist()
            steps = back.levels(np.asarray([goal])).tolist()  # least steps to the goal prune branches that cannot reach it in time
            found, path, on = [], [a], {a}
            walk = [iter(graph.of(a))]
            while walk and len(found) < k:
                for d in walk[-1]:
                    if d in on or steps[d] < 0 or (max_depth is not None and len(path) + steps[d] > max_depth):
                        continue
                    if d == goal:
                        found.append(graph.names[[*path, d]].tolist())
                        if len(found) >= k:
                            break
                        continue
                    path.append(d)
                    on.add(d)
                    walk.append(iter(graph.of(d)))
                    break
                else:
                    walk.pop()
                    on.discard(path.pop())
            return [np.arange(len(found), dtype=np.int32), pa.array(found, pa.list_(pa.int64()))]

        return _in_one_task([links], solve, schema, ["path_no", "nodes"])
    one = lambda n: spark.createDataFrame([(n,)], "node_id long")
    ahead, behind = reachable(links, one(src), max_depth, "distributed"), reachable(directed(links, BACKWARD), one(dst), max_depth, "distributed")
    useful = materialise(ahead.join(behind.select("node_id"), "node_id", "left_semi").select("node_id"), "useful")
    links = materialise(links.join(useful.select(F.col("node_id").alias("src")), "src", "left_semi").join(useful.select(F.col("node_id").alias("dst")), "dst", "left_semi"), "links")
    limit = useful.count() if max_depth is None else max_depth
    open_ = spark.createDataFrame([([src], [])], "nodes array<long>, ords array<struct<ordinal:long,dst:long>>")
    done: DataFrame | None = None
    for _ in range(limit):
        step = open_.join(links, F.element_at("nodes", -1) == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        grown = materialise(step.select(F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("ords", F.array(F.struct("ordinal", "dst"))).alias("ords")), "paths")
        if grown.isEmpty():
            break
        ended = grown.where(F.element_at("nodes", -1) == dst)
        best = (ended if done is None else done.unionByName(ended)).orderBy("ords").limit(k)
        done = materialise(best, "done")
        open_ = grown.where(F.element_at("nodes", -1) != dst)
        if done.count() >= k:
            worst = done.agg(F.max("ords").alias("w")).first()["w"]
            # prefixes that come after the k-th path cannot be among the first k
            bound = F.array(*[F.struct(F.lit(x["ordinal"]).cast("long").alias("ordinal"), F.lit(x["dst"]).cast("long").alias("dst")) for x in worst])
            open_ = open_.where(F.col("ords") < bound)
    if done is None:
        return spark.createDataFrame([], schema)
    return done.withColumn("path_no", F.row_number().over(Window.orderBy("ords")) - 1).select("path_no", "nodes")  # k rows at most


def segments(paths: DataFrame, sccs: DataFrame) -> DataFrame:
    """(path_no, segment_no, scc_id, nodes): paths cut where the component changes."""
    steps = paths.select("path_no", F.posexplode("nodes").alias("at", "node_id")).join(sccs, "node_id")
    w = Window.partitionBy("path_no").orderBy("at")
    marked = steps.withColumn("new", F.when(F.lag("scc_id").over(w).eqNullSafe(F.col("scc_id")), 0).otherwise(1)).withColumn("segment_no", F.sum("new").over(w) - 1)
    ordered = marked.groupBy("path_no", "segment_no", "scc_id").agg(F.array_sort(F.collect_list(F.struct("at", "node_id"))).alias("s"))
    return ordered.select("path_no", F.col("segment_no").cast("int").alias("segment_no"), "scc_id", F.transform("s", lambda x: x["node_id"]).alias("nodes"))


def rendered_segments(segs: DataFrame, names: DataFrame) -> DataFrame:
    """(path_no, text): ``SCC[1](a->b)->SCC[2](c)`` with names(node_id, name)."""
    steps = segs.select("path_no", "segment_no", "scc_id", F.posexplode("nodes").alias("at", "node_id")).join(names, "node_id")
    each = steps.groupBy("path_no", "segment_no", "scc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), "->").alias("t"))
    text = F.concat(F.lit("SCC["), F.col("scc_id").cast("string"), F.lit("]("), F.col("t"), F.lit(")"))
    return each.groupBy("path_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_no", text.alias("x")))), lambda s: s["x"]), "->").alias("text"))


def rendered_nodes(paths: DataFrame, names: DataFrame) -> DataFrame:
    """(path_no, text): ``a->Cls.b->c``."""
    steps = paths.select("path_no", F.posexplode("nodes").alias("at", "node_id")).join(names, "node_id")
    return steps.groupBy("path_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), "->").alias("text"))


def component_paths(scc_edges: DataFrame, sccs: DataFrame, src: int, dst: int, k: int = 1, max_depth: int | None = None) -> DataFrame:
    """Paths between the components of two nodes over the component graph; none for unknown nodes."""
    of = {r[0]: r[1] for r in sccs.where(F.col("node_id").isin(src, dst)).collect()}
    if src not in of or dst not in of:
        return scc_edges.sparkSession.createDataFrame([], "path_no int, nodes array<long>")
    return first_paths(scc_edges.select(F.col("src_scc").alias("src"), F.col("dst_scc").alias("dst"), F.col("dst_scc").alias("ordinal")), of[src], of[dst], k, max_depth)
