import random

import pytest
from pyspark.sql import functions as F

from symweave.operators import graph as G
from symweave.operators import resolve as R
from symweave.operators.index import SymbolIndex
from symweave.schema import CALLS, DEFINITIONS, REFERENCES
from symweave.storage import materialise

BOTH = ["local", "distributed"]


def loc(file, base):
    return (file, base, 0, base, 5, base * 10, base * 10 + 5)


def facts(spark, defs, calls):
    """defs: (name, base); calls: (caller, caller base, callee, site base)."""
    d = [(("function", n, None), loc("f.py", b), None, None, b) for n, b in defs]
    c = [((("function", a, None), loc("f.py", x)), (("function", b, None), loc("f.py", s)), s) for a, x, b, s in calls]
    r = [(callee[0], callee[1], s) for _, callee, s in c]
    return SymbolIndex(spark.createDataFrame(d, DEFINITIONS), spark.createDataFrame(r, REFERENCES), spark.createDataFrame(c, CALLS))


@pytest.fixture(scope="module")
def small(spark):
    return facts(spark, [("A", 1), ("B", 2), ("C", 3), ("D", 4), ("D", 5)], [("A", 1, "B", 101), ("B", 2, "C", 102), ("A", 1, "D", 103), ("C", 3, "nowhere", 104)])


def test_resolution_kinds(small):
    e = {(r.caller.symbol.name, r.target.location.start_byte): r.kind for r in R.call_edges(small.calls, small.definitions).collect()}
    assert e == {("A", 20): "must", ("B", 30): "must", ("A", 40): "may", ("A", 50): "may"}
    assert [r.reason for r in R.unresolved(small.calls, small.definitions).collect()] == [R.NO_DEFINITIONS]


def test_resolution_without_expansion(small):
    assert {r.target.symbol.name for r in R.call_edges(small.calls, small.definitions, False).collect()} == {"B", "C"}
    assert sorted(r.reason for r in R.unresolved(small.calls, small.definitions, False).collect()) == [R.AMBIGUOUS, R.NO_DEFINITIONS]


def test_method_calls_do_not_bind_to_methods_of_classes(spark):
    d = spark.createDataFrame([(("method", "m", "K"), loc("f.py", 1), None, None, 1), (("method", "m", None), loc("f.py", 2), None, None, 2)], DEFINITIONS)
    c = spark.createDataFrame([((("method", "m", "K"), loc("f.py", 1)), (("method", "m", None), loc("f.py", 9)), 9)], CALLS)
    assert [r.target.location.start_byte for r in R.call_edges(c, d).collect()] == [20]


def test_graph_numbers_and_directions(small):
    g = G.call_graph(small)
    assert g.stats().first().asDict() == {"num_nodes": 5, "num_edges": 4, "unresolved_calls": 1}
    pairs = lambda x: sorted((r.src, r.dst) for r in x.collect())
    assert pairs(g.edges) == [(0, 1), (0, 3), (0, 4), (1, 2)]
    assert pairs(G.directed(g.edges, G.BACKWARD)) == [(1, 0), (2, 1), (3, 0), (4, 0)]
    assert len(pairs(G.directed(g.edges, G.BOTH))) == 8
    with pytest.raises(ValueError):
        G.directed(g.edges, "up")


def test_entrypoints_prune(small):
    roots = small.definitions.where("symbol.name = 'B'")
    g = G.call_graph(small, entrypoints=roots)
    assert {r.owner.name for r in g.nodes.collect()} == {"B", "C"} and g.edges.count() == 1


def test_subgraph_rules(spark, small):
    g = G.call_graph(small)
    empty = spark.createDataFrame([], "node_id long")
    assert G.subgraph(g, None, 1).edges.count() == 4 and G.subgraph(g, empty, 1).edges.count() == 4
    one = spark.createDataFrame([(0,)], "node_id long")
    assert G.subgraph(g, one, 1).nodes.count() == 4
    assert G.subgraph(g, spark.createDataFrame([(2,)], "node_id long"), 1, True).nodes.count() == 2
    assert G.subgraph(g, spark.createDataFrame([(99,)], "node_id long"), 1).nodes.count() == 0


def edges_of(spark, pairs):
    count = {}
    rows = []
    for s, d in pairs:
        rows.append((s, d, count.setdefault(s, 0)))
        count[s] += 1
    return spark.createDataFrame(rows, "src long, dst long, ordinal long")


def nodes_of(spark, n):
    return spark.range(n).withColumnRenamed("id", "node_id")


def closure(n, pairs):
    reach = {a: {a} for a in range(n)}
    for _ in range(n):
        for s, d in pairs:
            for a in reach:
                if s in reach[a]:
                    reach[a].add(d)
    return reach


def dfs(pairs, src, dst, k, depth):
    """Recursive first-k search, the measure for the set-based one."""
    out = {}
    for s, d in pairs:
        out.setdefault(s, []).append(d)
    found = []

    def go(path):
        if len(found) >= k:
            return
        if path[-1] == dst:
            found.append(list(path))
            return
        if depth is not None and len(path) - 1 >= depth:
            return
        for d in out.get(path[-1], ()):
            if d not in path:
                go([*path, d])

    if k > 0:
        go([src])
    return found[:k]


@pytest.mark.parametrize("strategy", BOTH)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_loops_against_brute_force(spark, strategy, seed):
    rng = random.Random(seed)
    n = 9
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(14)]
    edges, nodes = edges_of(spark, pairs), nodes_of(spark, n)
    reach = closure(n, pairs)
    got = {r.node_id: r.level for r in G.reachable(edges, spark.createDataFrame([(0,)], "node_id long"), None, strategy).collect()}
    assert set(got) == reach[0]
    assert got[0] == 0
    scc = {r.node_id: r.scc_id for r in G.components(nodes, edges, strategy).collect()}
    assert scc == {a: min(b for b in reach[a] if a in reach[b]) for a in range(n)}
    order = [r.node_id for r in G.bfs_order(nodes, edges, spark.createDataFrame([(3, 0), (0, 1), (77, 2)], "node_id long, rank long"), strategy).orderBy("position").collect()]
    adjacency = {}
    for s, d in pairs:
        adjacency.setdefault(s, []).append(d)
    seen, queue = [], [3, 0]
    while queue:
        x = queue.pop(0)
        if x not in seen:
            seen.append(x)
            queue += adjacency.get(x, [])
    assert order == seen + [x for x in range(n) if x not in seen]


@pytest.mark.parametrize("strategy", BOTH)
@pytest.mark.parametrize(("k", "depth"), [(1, None), (3, None), (2, 2), (5, 3), (0, None)])
def test_first_paths_are_in_depth_first_order(spark, strategy, k, depth):
    pairs = [(0, 1), (0, 2), (0, 1), (1, 2), (1, 3), (2, 3), (2, 1), (3, 0), (2, 4), (4, 3)]
    got = [r.nodes for r in G.first_paths(edges_of(spark, pairs), 0, 3, k, depth, strategy).orderBy("path_no").collect()]
    assert got == dfs(pairs, 0, 3, k, depth)


def test_path_to_itself(spark):
    assert G.first_paths(edges_of(spark, [(0, 1)]), 1, 1, 2).first().nodes == [1]


def test_segments_and_renderings(spark):
    pairs = [(0, 1), (1, 2), (2, 1), (2, 3)]
    edges, nodes = edges_of(spark, pairs), nodes_of(spark, 4)
    sccs = G.components(nodes, edges)
    paths = G.first_paths(edges, 0, 3, 1)
    names = nodes.withColumn("name", F.concat(F.lit("n"), "node_id"))
    segs = G.segments(paths, sccs)
    assert [(r.scc_id, r.nodes) for r in segs.orderBy("segment_no").collect()] == [(0, [0]), (1, [1, 2]), (3, [3])]
    assert G.rendered_segments(segs, names).first().text == "SCC[0](n0)->SCC[1](n1->n2)->SCC[3](n3)"
    assert G.rendered_nodes(paths, names).first().text == "n0->n1->n2->n3"
    assert G.component_paths(G.component_edges(edges, sccs), sccs, 0, 3).first().nodes == [0, 1, 3]
    assert G.component_paths(G.component_edges(edges, sccs), sccs, 0, 99).count() == 0


def test_starting_nodes(spark):
    nodes, edges = nodes_of(spark, 5), edges_of(spark, [(0, 1), (2, 3)])
    assert sorted(r.node_id for r in G.starting_nodes(nodes, edges, G.FORWARD).collect()) == [0, 2, 4]
    assert sorted(r.node_id for r in G.starting_nodes(nodes, edges, G.BACKWARD).collect()) == [1, 3, 4]


def test_long_chain_does_not_recurse(spark):
    n = 3000
    pairs = [(i, i + 1) for i in range(n - 1)] + [(n - 1, 0)]
    assert G.components(nodes_of(spark, n), edges_of(spark, pairs)).select("scc_id").distinct().count() == 1


PART_QUERIES = ["bfs_order", "call_edges_may", "entrypoint_pruned_stats", "graph_direction_backward", "graph_direction_both", "graph_direction_forward", "graph_stats", "node_degrees", "paths_max_depth", "paths_node_k3", "report_top_files"]


@pytest.mark.parametrize("name", PART_QUERIES)
def test_large_graphs_are_walked_without_their_edges(name, spark, duck, sf_dir, monkeypatch):
    """Above the bound the answers are those of the SQL, and no plan lists the edges of calls."""
    from compare import matches_sql
    from symweave.plans.registry import ORACLES, QUERIES

    monkeypatch.setattr(G, "LOCAL_EDGES", 0)
    listed = []
    monkeypatch.setattr(G, "materialise", lambda df, tag, *a, **k: listed.append(tag) or materialise(df, tag, *a, **k))
    matches_sql(spark, duck, sf_dir, QUERIES[name], ORACLES[name])
    assert "edges" not in listed


def shared_places(spark, mode):
    """Two symbols at one place, a symbol with several places, a definition twice, loops and calls at one site."""
    defs = [("A", 1), ("B", 2), ("C", 2), ("B", 3), ("C", 4), ("D", 5), ("A", 6), ("D", 5)]
    calls = [("A", 1, "B", 101), ("A", 1, "C", 101), ("B", 2, "D", 102), ("C", 4, "B", 103), ("D", 5, "A", 104), ("A", 6, "A", 105), ("B", 3, "C", 106), ("A", 1, "D", 107), ("E", 9, "A", 108), ("D", 5, "nowhere", 109)]
    x = facts(spark, defs, calls)
    return SymbolIndex(x.definitions, x.references, x.calls, mode)


@pytest.mark.parametrize("mode", ["crossref", "simple"])
def test_both_forms_of_a_graph_agree(spark, monkeypatch, mode):
    x = shared_places(spark, mode)
    plain = G.call_graph(x)
    with monkeypatch.context() as m:
        m.setattr(G, "LOCAL_EDGES", 0)
        fanned = G.call_graph(x)
    assert plain.calls is None and fanned.calls is not None
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(plain.edges) == rows(fanned.edges)
    assert rows(plain.stats()) == rows(fanned.stats()) == rows(G.call_stats(x))
    for d in G.DIRECTIONS:
        assert rows(G.edge_counts(plain, d)) == rows(G.edge_counts(fanned, d))
    assert rows(G.graph_degrees(plain).select("node_id", "n_in", "n_out")) == rows(G.graph_degrees(fanned).select("node_id", "n_in", "n_out"))
    assert [rows(df.select(*sorted(df.columns))) for df in G.graph_components(plain)] == [rows(df.select(*sorted(df.columns))) for df in G.graph_components(fanned)]
    one = spark.createDataFrame([(0,)], "node_id long")
    for depth in (None, 1, 2):
        assert rows(G.graph_reachable(plain, one, depth)) == rows(G.graph_reachable(fanned, one, depth))
    starts = spark.createDataFrame([(3, 0), (0, 1)], "node_id long, rank long")
    assert rows(G.graph_order(plain, starts)) == rows(G.graph_order(fanned, starts))
    text = lambda df: [r.nodes for r in df.orderBy("path_no").collect()]
    for goal, depth in ((1, 3), (3, None), (4, 2)):
        assert text(G.graph_paths(plain, 0, goal, 4, depth)) == text(G.graph_paths(fanned, 0, goal, 4, depth))
