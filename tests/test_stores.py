"""Stores at size: documents that no task holds an entry of, and what a store still has to merge."""

import json

import pytest
from pyspark.sql import functions as F

from symweave.operators import index as I
from symweave.schema import CALLS, DEFINITIONS, REFERENCES
from symweave.sources import json_index, sqlite
from symweave.sources.json_index import read_json, write_json

SYMBOLS = [("function", "a", None), ("function", 'b","info":{"x', None), ("method", "a", "K"), ("method", "é\n]", "K")]


def loc(file, base):
    return (file, base, 0, base + 1, 5, base * 10, base * 10 + 5)


@pytest.fixture(scope="module")
def large(spark):
    """One symbol with most of the facts, symbols with one kind of facts alone, calls given twice, notes that are empty."""
    d = [(SYMBOLS[0], loc("m.c", i), f"doc {i}" if i % 3 else None, ("n", None, "") if i % 5 == 0 else (None, None, None), i) for i in range(400)]
    d += [(SYMBOLS[2], loc("k.c", 1), None, None, 1), (SYMBOLS[0], loc("m.c", 7), "later", ("last", "", ""), 900)]
    c = [((SYMBOLS[0], loc("m.c", i)), (SYMBOLS[1 if i % 7 == 0 else 0], loc("x.c", i + 3 * n)), 10 * i + n) for i in range(400) for n in range(3)]
    c += [((SYMBOLS[3], loc("u.c", 2)), (SYMBOLS[0], loc("u.c", 3)), 5)] + c[:50]
    r = [(SYMBOLS[1], loc("y.c", i), i) for i in range(60)] + [(c[0][1][0], c[0][1][1], 77)]
    return {m: I.SymbolIndex(spark.createDataFrame(d, DEFINITIONS), spark.createDataFrame(r, REFERENCES), spark.createDataFrame(c, CALLS), m) for m in I.MODES}


def entries(index):
    """The nested documents of an index, as JSON without defaults."""
    def bare(v):
        if isinstance(v, dict):
            return {k: b for k, x in v.items() if (b := bare(x)) not in (None, [], {})}
        return [bare(x) for x in v] if isinstance(v, list) else v

    return sorted((json.dumps(e.pop("symbol"), sort_keys=True), e) for e in (bare(r.asDict(True)) for r in index.info().collect()))


def text_of(path):
    return "".join(json_index._text(path, *x[:3]).decode() for x in json_index._hops(path)) if path.endswith(".zst") else open(path, encoding="utf-8").read()


@pytest.mark.parametrize("setting, mode, name", [("plain", "simple", "i.json"), ("hot", "crossref", "i.json"), ("uncoded", "crossref", "i.json.zst"), ("passes", "crossref", "i.json.zst"), ("hot", "simple", "i.json.zst")])
def test_a_document_is_whole_in_small_frames(setting, mode, name, spark, large, tmp_path, monkeypatch):
    """No frame, line or range holds an entry, and the document is that of ``info``."""
    monkeypatch.setattr(json_index, "_FRAME", 2_000)
    if setting == "hot":
        monkeypatch.setattr(json_index, "SYMBOL_ROWS", 10)
    if setting == "uncoded":
        monkeypatch.setattr(json_index, "CODED_SYMBOLS", 1)
    if setting == "passes":
        monkeypatch.setattr(json_index, "PASS_ROWS", 100)
    index, path = large[mode], str(tmp_path / name)
    write_json(index, path, {"made": "here"})
    whole = json.loads(text_of(path))
    assert whole["metadata"] == {"made": "here"}
    expected = entries(index)
    assert sorted((json.dumps(e["symbol"], sort_keys=True), e["info"]) for e in whole["data"]) == expected
    assert max(map(len, text_of(path).split("\n"))) < 2_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    try:
        back = read_json(spark, path)
        assert back.definitions.rdd.getNumPartitions() > 1
        assert [k for k, _ in entries(back)] == [k for k, _ in expected]
        for ours, theirs in ((back.all_definitions(), index.all_definitions()), (back.all_references(), index.all_references())):
            cols = [c for c in theirs.columns if c not in ("seq", "llm_note")]
            assert sorted(map(str, ours.select(cols).collect())) == sorted(map(str, theirs.select(cols).collect()))
        pairs = lambda x: set(x.calls.select("caller", "callee").collect())
        assert pairs(back) == (pairs(index) if mode == "crossref" else {p for p in pairs(index) if p.caller.symbol.name == "a"})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_cut_document_is_refused(spark, large, tmp_path):
    for name in ("i.json", "i.json.zst"):
        path = tmp_path / name
        write_json(large["crossref"], str(path))
        path.write_bytes(path.read_bytes()[:-9])
        with pytest.raises(RuntimeError, match="no end"):
            read_json(spark, str(path))


def test_added_calls_are_merged_into_what_a_store_held(spark, large, tmp_path):
    path = str(tmp_path / "i.json")
    write_json(large["crossref"], path)
    back = read_json(spark, path)
    more = spark.createDataFrame([((("function", "new", None), loc("n.c", 1)), (SYMBOLS[0], loc("n.c", 2)), 1)], CALLS)
    assert back.complete and not back.append(calls=more).complete
    assert back.append(calls=more).all_definitions().count() == back.all_definitions().count() + 1
    assert back.append(calls=more).all_references().where(F.col("location.file_path") == "n.c").count() == 1


@pytest.mark.parametrize("mode, coded", [("crossref", 200_000), ("crossref", 0), ("simple", 200_000)])
def test_an_outline_has_what_info_has(mode, coded, spark, large, monkeypatch):
    monkeypatch.setattr(I, "CODED_SYMBOLS", coded)
    index = large[mode]
    theirs = sorted((str(r.symbol), sorted(d.location.start_byte for d in r.definitions), len(r.definitions), len(r.references)) for r in index.info().collect())
    assert sorted((str(r.symbol), r.starts, r.n_definitions, r.n_references) for r in index.outline().collect()) == theirs


@pytest.mark.parametrize("mode, rows, coded", [("crossref", 100, 200_000), ("crossref", 10_000, 0), ("simple", 100, 200_000)])
def test_an_sqlite_store_is_whole_in_passes(mode, rows, coded, spark, large, tmp_path, monkeypatch):
    """Calls find their ids in passes, and what was stored is read without its calls being merged again."""
    monkeypatch.setattr(sqlite, "PASS_ROWS", rows)
    monkeypatch.setattr(sqlite, "CODED_SYMBOLS", coded)
    index = large[mode]
    back = sqlite.read_sqlite(spark, sqlite.write_sqlite(index, str(tmp_path / "i.sqlite")))
    assert back.complete == (mode == "crossref")
    for ours, theirs in ((back.all_definitions(), index.all_definitions()), (back.all_references(), index.all_references())):
        assert sorted(map(str, ours.select("symbol", "location").collect())) == sorted(map(str, theirs.select("symbol", "location").collect()))
    pairs = lambda x, keep=lambda p: True: {p for p in x.calls.select("caller", "callee").collect() if keep(p)}
    placed = {(r.symbol, r.location) for r in index.all_references().collect()}, {(r.symbol, r.location) for r in index.all_definitions().collect()}
    assert pairs(back) == pairs(index, lambda p: tuple(p.callee) in placed[0] and tuple(p.caller) in placed[1])
