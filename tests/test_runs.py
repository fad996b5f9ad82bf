"""Calls with many targets: every edge, in runs that lie together, dealt to tasks by edges."""

from collections import Counter
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from symweave.operators import resolve as R
from symweave.plans.registry import ORACLES, QUERIES

TIMES = 20


@pytest.fixture(scope="module")
def repeated(sf_dir, tmp_path_factory):
    """Parts and lines repeated with shifted keys: each symbol has as many times the definitions, and each call as many edges."""
    at = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    parts, orders = con.sql(f"SELECT max(p_partkey) + 1 FROM '{sf_dir}/part.parquet'").fetchall()[0][0], con.sql(f"SELECT max(l_orderkey) + 1 FROM '{sf_dir}/lineitem.parquet'").fetchall()[0][0]
    for name, moved in (("part", f"p_partkey + r * {parts} AS p_partkey"), ("lineitem", f"l_partkey + r * {parts} AS l_partkey, l_orderkey + r * {orders} AS l_orderkey")):
        con.sql(f"COPY (SELECT t.* REPLACE ({moved}) FROM '{sf_dir}/{name}.parquet' t, range({TIMES}) g(r) ORDER BY r) TO '{at}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    return str(at), con


def written(spark, repeated, path):
    """The edges of the query in files, held against the SQL; their number and bytes."""
    d, con = repeated
    QUERIES["call_edges_may"](spark, d).write.parquet(str(path))
    ours, theirs = f"SELECT src_byte, dst_byte, site_byte FROM '{path}/*.parquet'", f"SELECT src_byte, dst_byte, site_byte FROM ({ORACLES['call_edges_may']})"
    for a, b in ((ours, theirs), (theirs, ours)):
        assert con.sql(f"SELECT count(*) FROM (({a}) EXCEPT ALL ({b}))").fetchall()[0][0] == 0
    return con.sql(f"SELECT count(*) FROM ({ours})").fetchall()[0][0], sum(p.stat().st_size for p in path.glob("*.parquet"))


@pytest.mark.parametrize("plain", [None, 0])
def test_edges_of_many_targets_are_whole_and_small_in_a_file(plain, spark, repeated, tmp_path, monkeypatch):
    if plain is not None:
        monkeypatch.setattr(R, "PLAIN_EDGES", plain)
    edges, size = written(spark, repeated, tmp_path / "edges")
    assert edges > 1_000_000
    assert size < 0.75 * edges


def test_edges_are_whole_in_small_pieces(spark, repeated, tmp_path, monkeypatch):
    for name, v in (("PLAIN_EDGES", 0), ("TASK_CALLS", 2_000), ("PIECE_EDGES", 5_000)):
        monkeypatch.setattr(R, name, v)
    written(spark, repeated, tmp_path / "edges")


def test_a_class_of_many_edges_is_dealt_to_many_tasks(spark, monkeypatch):
    for name, v in (("PLAIN_EDGES", 0), ("TASK_CALLS", 20), ("PIECE_EDGES", 500)):
        monkeypatch.setattr(R, name, v)
    calls = [(0, i) for i in range(400)] + [(0, 7)] * 3 + [(1, i) for i in range(1000, 1003)] + [(2, 2000)]
    targets = [(0, -i) for i in range(50)] + [(0, -1)] + [(1, -100)]
    df = R.edges_in_runs(spark.createDataFrame(calls, "class_id long, site int"), spark.createDataFrame(targets, "class_id long, target int"))
    assert sorted(df.columns) == ["site", "target"]
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    assert Counter((r.site, r.target) for r in rows) == Counter((site, target) for c, site in calls for k, target in targets if c == k)
    shares = Counter(r.task for r in rows)
    assert len(shares) > 10 and max(shares.values()) < len(rows) / 3
    runs = [(site, len(list(g))) for site, g in groupby(rows, lambda r: (r.task, r.site)) if site[1] < 1000]
    assert len(runs) <= 403 and all(n % 51 == 0 for _, n in runs)


def test_no_call_gives_no_edge(spark):
    none = spark.createDataFrame([], "class_id long, site int")
    assert R.edges_in_runs(none, spark.createDataFrame([(0, 1)], "class_id long, target int")).collect() == []
