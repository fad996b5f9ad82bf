import json
import os

import pytest
from pyspark.sql import functions as F

from symweave.operators import index as I
from symweave.operators.tasks import TaskList
from symweave.schema import CALLS, DEFINITIONS, REFERENCES
from symweave.sources.json_index import read_json, read_parquet, write_json, write_parquet
from symweave.sources.sqlite import normalised, read_sqlite, write_sqlite


def loc(file, base):
    return (file, base, 0, base, 5, base * 10, base * 10 + 5)


FN = lambda n: ("function", n, None)
ME = lambda n, c=None: ("method", n, c)


@pytest.fixture(scope="module")
def index(spark):
    """main calls a and b, a calls b; the definition of a is given twice."""
    d = [(FN("main"), loc("m.c", 1), None, None, 1), (FN("a"), loc("m.c", 2), None, None, 2), (FN("a"), loc("m.c", 2), "doc of a", ("n1", "", ""), 3), (FN("a"), loc("m.c", 2), "later", ("n2", "", ""), 4), (ME("a", "K"), loc("k.c", 3), None, None, 5)]
    c = [((FN("main"), loc("m.c", 1)), (FN("a"), loc("m.c", 11)), 11), ((FN("main"), loc("m.c", 1)), (FN("b"), loc("m.c", 12)), 12), ((FN("a"), loc("m.c", 2)), (FN("b"), loc("m.c", 21)), 21)]
    r = [(callee[0], callee[1], s) for _, callee, s in c]
    return I.SymbolIndex(spark.createDataFrame(d, DEFINITIONS), spark.createDataFrame(r, REFERENCES), spark.createDataFrame(c, CALLS))


def test_merge_rules(index):
    (a,) = index.all_definitions().where("symbol.name = 'a' and symbol.type = 'function'").collect()
    assert (a.doc, a.llm_note.description) == ("doc of a", "n2")
    assert I.SymbolIndex(index.definitions, index.references, index.calls, "simple").all_definitions().count() == 5


def test_cross_references(index):
    by = {(r.symbol.name, r.location.start_byte): [x.symbol.name for x in r.called_by] for r in index.called_by().collect()}
    assert by == {("a", 110): ["main"], ("b", 120): ["main"], ("b", 210): ["a"]}
    calls = {r.symbol.name: [x.symbol.name for x in r.calls] for r in index.calls_by_definition().collect()}
    assert calls == {"main": ["a", "b"], "a": ["b"]}


def test_callers_without_a_definition_get_a_bare_one(spark, index):
    x = I.SymbolIndex(index.definitions.limit(0), index.references.limit(0), index.calls)
    assert {r.symbol.name for r in x.all_definitions().collect()} == {"main", "a"}


def test_info_and_counts(index):
    info = {(r.symbol.name, r.symbol.class_name): r for r in index.info().collect()}
    assert len(info) == 4
    assert len(info["b", None].definitions) == 0 and len(info["b", None].references) == 2
    assert [c.symbol.name for c in info["main", None].definitions[0].calls] == ["a", "b"]
    assert index.totals().first().asDict() == {"n_symbols": 4, "n_definitions": 3, "n_references": 3}


def test_sorted_symbols(index):
    assert [(r.symbol.type, r.symbol.name) for r in index.sorted_symbols().collect()] == [("function", "a"), ("function", "b"), ("function", "main"), ("method", "a")]


def test_point_queries(index):
    n = lambda df: df.count()
    assert n(I.query_by_key(index, "function", "a")) == 2 and n(I.query_by_key(index, "method", "a")) == 0
    assert n(I.query_by_name(index, "a")) == 3 and n(I.query_by_name(index, "a", "method")) == 1
    assert n(I.query_by_regex(index, "")) == 6 and n(I.query_by_regex(index, "(?i)^MA")) == 1
    assert n(I.query_by_regex(index, "(?P<x>b)")) == 2 and n(I.query_by_regex(index, "(?P<x>m)ain(?P=x)?")) == 1
    with pytest.raises(ValueError, match="Invalid regex pattern"):
        I.query_by_regex(index, "(")
    with pytest.raises(ValueError):
        I.query_by_name(index, "a", "klass")
    at = F.col("location.start_byte") == 20
    assert n(I.query_full_definition(index, "function", "a", None, at)) == 2
    assert n(I.query_full_definition(index, "function", "a", None, F.lit(False))) == 0
    assert n(I.find_definitions(index, "a")) == 1 and n(I.find_references(index, "b")) == 2


def test_shared_location_belongs_to_the_least_symbol(spark, index):
    more = spark.createDataFrame([(FN("Z"), loc("k.c", 3), None, None, 9)], DEFINITIONS)
    (r,) = I.find_full_definition(index.append(definitions=more), spark.createDataFrame([(loc("k.c", 3),)], "location struct<file_path:string,start_lineno:int,start_col:int,end_lineno:int,end_col:int,start_byte:int,end_byte:int>")).collect()
    assert r.symbol.name == "Z"


def test_changes(spark, index):
    with pytest.raises(KeyError):
        index.delete("function", "nope")
    assert index.delete("function", "a").definitions.count() == 2
    other = I.SymbolIndex(spark.createDataFrame([(FN("a"), loc("x.c", 7), None, None, 1)], DEFINITIONS), index.references.limit(0), index.calls.limit(0))
    assert index.replaced(other).definitions.where("symbol.name = 'a' and symbol.type = 'function'").count() == 1
    assert index.updated(other).all_definitions().where("symbol.name = 'a' and symbol.type = 'function'").count() == 2
    assert index.emptied().totals().first().n_symbols == 0
    with pytest.raises(ValueError):
        I.SymbolIndex(index.definitions, index.references, index.calls, "other")


def shape(x):
    return sorted((r.symbol.name, r.symbol.class_name or "", [(d.location.start_byte, [c.symbol.name for c in d.calls]) for d in r.definitions], sorted((f.location.start_byte, tuple(sorted(c.symbol.name for c in f.called_by))) for f in r.references)) for r in x.info().collect())


def test_json_round_trip(spark, index, tmp_path):
    p = str(tmp_path / "i.json")
    write_json(index, p, {"k": "v"})
    doc = json.load(open(p))
    assert doc["type"] == "cross_ref_index" and len(doc["data"]) == 4 and "llm_note" not in json.dumps(doc["data"][-1])
    back = read_json(spark, p)
    assert shape(back) == shape(index)
    assert back.all_definitions().where("doc = 'doc of a'").count() == 1


def test_single_symbols_and_differences(spark, index):
    from symweave.operators import compare

    assert index.size() == 4 and index.contains("method", "a", "K") and not index.contains("method", "a")
    assert index.get("function", "main").definitions[0].location.start_byte == 10
    with pytest.raises(KeyError):
        index.get("function", "nope")
    assert index.definitions_of("function", "nope").count() == 0 and index.references_of("function", "b").count() == 2
    assert [r.llm_note.description for r in index.notes("function", "a").collect()] == ["n2"]
    compare.assert_equal(index, index)
    less = index.delete("function", "b")
    assert {(r.side, r.kind) for r in compare.difference(index, less).collect()} == {("left", "reference"), ("left", "call")}
    assert compare.missing_symbols(index, less).count() == 1 and compare.common_symbols(index, less).count() == 3
    with pytest.raises(AssertionError):
        compare.assert_equal(less, index)


def test_json_errors(spark, index, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_json(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        read_json(spark, str(tmp_path))
    (tmp_path / "bad.json").write_text("{ nothing")
    with pytest.raises(RuntimeError):
        read_json(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        write_json(index, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        write_json(index, str(tmp_path / "no" / "i.json"))
    with pytest.raises(ValueError):
        write_json(index, str(tmp_path / "bad.json" / "i.json"))
    write_json(index, str(tmp_path / "x.json"))
    with pytest.raises(ValueError):
        read_json(spark, str(tmp_path / "x.json"), "simple")


def test_sqlite_round_trip(spark, index, tmp_path):
    counts = {k: v.count() for k, v in normalised(index).items()}
    assert counts == {"symbols": 4, "code_locations": 6, "definitions": 3, "references": 3, "definition_references": 3}
    target = write_sqlite(index, str(tmp_path))
    write_sqlite(index, str(tmp_path))
    assert os.path.exists(target + ".bak")
    assert shape(read_sqlite(spark, str(tmp_path))) == shape(index)
    with pytest.raises(FileNotFoundError):
        read_sqlite(spark, str(tmp_path / "none"))


def test_parquet_round_trip(spark, index, tmp_path):
    write_parquet(index, str(tmp_path / "p"))
    assert shape(read_parquet(spark, str(tmp_path / "p"))) == shape(index)


def tasks(spark, done=(), again=False):
    t = spark.createDataFrame([(i, f"task_{i}") for i in range(10)], "ord long, task_id string")
    s = spark.createDataFrame([(n, t_, r) for n, (t_, r) in enumerate(done)], "seq long, task_id string, result string")
    return TaskList(t, s, again)


def test_work_queue(spark):
    q = tasks(spark, [("task_3", "x"), ("task_1", "y")])
    assert [r.task_id for r in q.pending_page(3, 1).collect()] == ["task_2", "task_4", "task_5"]
    assert q.any_pending().first().task_id == "task_0" and not q.is_pending("task_3")
    assert [r.task_id for r in q.recent(1).collect()] == ["task_1"]
    assert q.result("task_3") == "x" and q.result("task_0") is None
    assert q.progress().first()["text"] == "2/10 submitted, 8 pending"
    with pytest.raises(KeyError):
        q.result("none")
    rest, gone = q.clear_submitted()
    assert gone == 2 and rest.tasks.count() == 8


def test_submissions(spark):
    q = tasks(spark)
    with pytest.raises(KeyError):
        q.submit("none", "r")
    with pytest.raises(KeyError):
        q.add(q.tasks.limit(1))

    def fail(*_):
        raise RuntimeError("refused")

    with pytest.raises(RuntimeError):
        q.submit("task_1", "r", fail)
    assert q.is_pending("task_1")
    q2 = q.submit("task_1", "r")
    with pytest.raises(ValueError):
        q2.submit("task_1", "again")
    q3 = TaskList(q2.tasks, q2.submissions, True).submit("task_1", "again")
    assert q3.result("task_1") == "again" and q3.recent(5).count() == 2


def test_a_document_is_read_in_several_tasks(spark, sf_dir, tmp_path):
    """Entries lie on lines of their own, so a document is split, and its text is still one JSON value in order of the symbols."""
    import json

    from symweave.sources import fixtures, json_index

    x = fixtures.part_index(spark, sf_dir, "simple")
    path = str(tmp_path / "index.json")
    json_index.write_json(x, path, {"made": "here"})
    whole = json.load(open(path, encoding="utf-8"))
    assert whole["type"] == "simple_index" and whole["metadata"] == {"made": "here"} and len(whole["data"]) == x.info().count()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = json_index.read_json(spark, path, "simple").definitions
        assert found.rdd.getNumPartitions() > 1 and found.count() == x.definitions.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
