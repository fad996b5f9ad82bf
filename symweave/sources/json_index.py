"""The index as one JSON document, the exchange format; Parquet is the native one."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symweave.operators.index import SymbolIndex
from symweave.schema import INDEX_DATA, NOTE, SYMBOL, packed, unpacked
from symweave.storage import few, fresh_path, numbered, tidy

_TYPES = {"simple": "simple_index", "crossref": "cross_ref_index"}


#: Text that is compressed together, and zstd's mark of a frame to skip, which stands before each of ours and holds its sizes.
_FRAME, _SKIP = 8 << 20, b"P*M\x18"
#: How lines begin that open, part or close an entry.
_MARKS = (b'{"symbol":', b',{"symbol":', b"]")
#: Symbols that are numbered, as every task holds their table, and rows of a symbol that one task sorts.
CODED_SYMBOLS, SYMBOL_ROWS = 200_000, 4_000_000
#: Passes over the symbols at most, rows of a pass before there is another, and rows of a task.
PASSES, PASS_ROWS, TASK_ROWS = 4, 10_000_000, 200_000


def _codes(index: SymbolIndex) -> DataFrame:
    """(symbol, has_d, has_r, n, id): every symbol, what its entry holds and its number in order."""
    flags = lambda df, c, d: df.select(F.col(c).alias("symbol"), F.lit(d).alias("d"))
    rows = flags(index.definitions, "symbol", True).unionByName(flags(index.references, "symbol", False))
    if index.mode == "crossref":
        rows = rows.unionByName(flags(index.calls, "caller.symbol", True)).unionByName(flags(index.calls, "callee.symbol", False))
    found = rows.groupBy("symbol").agg(F.bool_or("d").alias("has_d"), F.bool_or(~F.col("d")).alias("has_r"), F.count("*").alias("n"))
    return numbered(found, [F.col("symbol")], "id", few(rows.sparkSession))


def _items(index: SymbolIndex, codes: DataFrame, coded: bool, of: Column) -> DataFrame:
    """(s, part, place, seq, doc, note, c, at, one) of every fact and call that the lines of the chosen symbols are made of: narrow, with numbers in place of symbols."""
    numbers = codes.select(F.col("symbol").alias("__s"), F.col("id").cast("int").alias("__i"))

    def code(df: DataFrame, c: str, to: str, chosen: Column | None = None) -> DataFrame:
        if not coded:
            return df.withColumn(to, F.col(c))
        return df.join(F.broadcast(numbers if chosen is None else numbers.where(chosen)), F.col(c) == F.col("__s")).withColumn(to, F.col("__i")).drop("__s", "__i")

    no_doc = F.lit(None).cast("struct<seq:bigint,doc:string>").alias("doc")
    no_note = F.lit(None).cast(T.StructType([T.StructField("seq", T.LongType()), T.StructField("note", NOTE)])).alias("note")
    no_one = F.lit(None).cast(T.StructType([T.StructField("seq", T.LongType()), T.StructField("doc", T.StringType()), T.StructField("note", NOTE)])).alias("one")
    simple, out = index.mode == "simple", []
    for part, facts, own, other in ((1, index.definitions, "caller", "callee"), (3, index.references, "callee", "caller")):
        if part == 1 or not simple:
            calls = index.calls.select(F.col(f"{own}.symbol").alias("symbol"), packed(f"{own}.location").alias("place"), F.col(f"{other}.symbol").alias("o"), packed(f"{other}.location").alias("ol"), "seq")
            calls = code(code(calls, "symbol", "s", of), "o", "os")
            out.append(calls.select("s", F.lit(part).alias("part"), "place", F.lit(1 << 62).alias("seq") if part == 1 else "seq", no_doc, no_note, F.struct("os", "ol").alias("c"), F.col("seq").alias("at"), no_one))
        doc = F.when(F.col("doc").isNotNull(), F.struct("seq", "doc")).alias("doc") if part == 1 else no_doc
        note = F.when(F.col("llm_note").isNotNull(), F.struct("seq", F.col("llm_note").cast(NOTE).alias("note"))).alias("note") if part == 1 else no_note
        one = no_one
        if simple:  # facts are not merged
            one = F.struct("seq", F.col("doc") if part == 1 else F.lit(None).cast("string").alias("doc"), F.col("llm_note").cast(NOTE).alias("note") if part == 1 else F.lit(None).cast(NOTE).alias("note")).alias("one")
        rows = code(facts, "symbol", "s", of)
        out.append(rows.select("s", F.lit(part).alias("part"), packed("location").alias("place"), "seq", doc, note, F.lit(None).cast(T.StructType([T.StructField("os", rows.schema["s"].dataType), T.StructField("ol", rows.select(packed("location").alias("p")).schema["p"].dataType)])).alias("c"), F.lit(None).cast("long").alias("at"), one))
    rows = out[0]
    for df in out[1:]:
        rows = rows.unionByName(df)
    return rows


def _listed(rows: DataFrame, codes: DataFrame, coded: bool, simple: bool) -> DataFrame:
    """(s, part, seq, place, doc, note, calls, mark): facts merged by place, with the distinct calls of each in order; no shuffle where rows of a symbol lie together."""
    listed = lambda more: [F.flatten(F.collect_list("one")).alias("one") if more else F.collect_list("one").alias("one")] if simple else []
    rows = rows.groupBy("s", "part", "place", "c").agg(F.min("seq").alias("seq"), F.min("doc").alias("doc"), F.max("note").alias("note"), F.min("at").alias("at"), F.max("mark").alias("mark"), *listed(False))
    if coded:
        rows = rows.join(F.broadcast(codes.select(F.col("symbol").alias("os"), F.col("id").cast("int").alias("__i"))), F.col("c.os") == F.col("__i"), "left")
    else:
        rows = rows.withColumn("os", F.col("c.os"))
    call = F.when(F.col("c").isNotNull(), F.struct("at", F.col("os").alias("symbol"), unpacked("c.ol").alias("location")))
    rows = rows.groupBy("s", "part", "place").agg(F.min("seq").alias("seq"), F.min("doc").alias("doc"), F.max("note").alias("note"), F.array_sort(F.collect_list(call)).alias("calls"), F.max("mark").alias("mark"), *listed(True))
    if simple:
        rows = rows.withColumn("one", F.explode_outer("one")).where("one is not null or mark is not null").select("s", "part", F.col("one.seq").alias("seq"), "place", F.struct(F.col("one.seq").alias("seq"), F.col("one.doc").alias("doc")).alias("doc"), F.struct(F.col("one.seq").alias("seq"), F.col("one.note").alias("note")).alias("note"), "calls", "mark")
    return rows


def _line() -> Column:
    """A definition or reference as JSON; defaults are left out."""
    calls = F.when(F.size("calls") > 0, F.transform("calls", lambda x: x.dropFields("at")))
    said = F.coalesce(*[F.col(f"note.note.{n}") for n in NOTE.names]).isNotNull()
    at = unpacked("place").alias("location")
    d = F.to_json(F.struct(at, F.col("doc.doc").alias("doc"), calls.alias("calls"), F.when(said, F.col("note.note")).alias("llm_note")))
    return F.when(F.col("part") == 1, d).when(F.col("part") == 3, F.to_json(F.struct(at, calls.alias("called_by")))).otherwise(F.col("mark"))


def _framed(text: bytes, **said) -> bytes:
    """A frame of zstd behind a frame to skip that holds its sizes and what the frame leaves open; without the mark, which stands between frames."""
    held = bytes(pa.Codec("zstd", 3).compress(text, asbytes=True))
    about = struct.pack("<II", len(held), len(text)) + json.dumps(said).encode()
    return struct.pack("<I", len(about)) + about + held


def _turn(line: bytes) -> tuple[bytes | None, str]:
    """The symbol that a line opens, none in the middle of an entry, and the part of its entry that begins."""
    line = line.removeprefix(b",")
    part = "references" if line.endswith(b'"references":[') else "definitions" if line.endswith(b'"definitions":[') else ""
    return (line[len(b'{"symbol":') : line.rindex(b',"info":{')] if line.startswith(b'{"symbol":') else None), part


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (part, line) of a task, in order, as frames."""
    held, size, before, symbol, part, first = [], 0, None, None, "", None

    def out() -> pa.RecordBatch:
        text = b"\n".join(held) + b"\n"
        return pa.RecordBatch.from_arrays([pa.array([_framed(text, symbol=symbol and symbol.decode(), part=part, first=first, last=before)], pa.binary())], names=["value"])

    for batch in batches:
        for kind, line in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            item = kind in (1, 3)
            if item:
                line = b"," + line if before else line
            else:
                opened, part = _turn(line)
                symbol = opened or symbol
            first = item if first is None else first
            held.append(line)
            size, before = size + len(line), item
            if size >= _FRAME:
                yield out()
                held, size, symbol, first = [], 0, None, True
    if held:
        yield out()


def write_json(index: SymbolIndex, path: str, metadata: dict[str, str] | None = None) -> None:
    """Write the document, a definition or reference a line in order of their symbols, so that no task holds an entry; a path that ends in ``.zst`` gets it compressed."""
    if os.path.isdir(path):
        raise ValueError(f"{path} is a directory")
    parent = os.path.dirname(os.path.abspath(path))
    if not os.path.exists(parent):
        raise FileNotFoundError(parent)
    if not os.path.isdir(parent):
        raise ValueError(f"{parent} is not a directory")
    head = '{"type": ' + json.dumps(_TYPES[index.mode]) + ',\n"data": [\n'
    tail = "]" + (', "metadata": ' + json.dumps(metadata, ensure_ascii=False) if metadata else "") + "}\n"
    target = path if path.endswith(".zst") else f"{path}.{uuid.uuid4().hex[:8]}.zst"
    codes = _codes(index)
    try:
        _joined(codes.sparkSession, head, _written(index, codes), tail, target)
        if target != path:
            with open(path, "wb") as out:
                for at, size, raw, _ in _hops(target):
                    out.write(_text(target, at, size, raw))
            os.remove(target)
    except OSError as e:
        raise RuntimeError(f"cannot write {path}: {e}") from e


def _written(index: SymbolIndex, codes: DataFrame) -> Iterator[str]:
    """Folders of frames in order, each to be used up before the next is made: many rows are sorted a range of symbols at a time, which bounds the disk for them."""
    spark, simple = codes.sparkSession, index.mode == "simple"
    known, most, total = codes.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    coded, hot = known <= CODED_SYMBOLS, (most or 0) > SYMBOL_ROWS
    passes = min(PASSES, -(-(total or 1) // PASS_ROWS)) if coded else 1
    ends = [known]
    if passes > 1:
        ends, sum_ = [], 0
        for i, n in codes.orderBy("id").select("id", "n").collect():  # CODED_SYMBOLS rows at most
            sum_ += n
            if sum_ >= total * (len(ends) + 1) / passes or i == known - 1:
                ends.append(i + 1)
    s = (F.col("id").cast("int") if coded else F.col("symbol")).alias("s")
    begin = F.concat(F.when(F.col("id") > 0, ",").otherwise(""), F.lit('{"symbol":'), F.to_json("symbol"), F.lit(',"info":{'), F.when(F.col("has_d"), '"definitions":[').otherwise('"references":['))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // passes // TASK_ROWS)
    order, few_rows = ["s", "part", "seq", "place"], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for low, high in zip([0, *ends], ends, strict=False):
        of = (F.col("__i") >= low) & (F.col("__i") < high)
        rows = _items(index, codes, coded, of)
        own = codes.where((F.col("id") >= low) & (F.col("id") < high))
        marks = lambda k, text, keep=F.lit(True): own.where(keep).select(s, F.lit(k).alias("part"), text.alias("mark"))  # noqa: B023, E731
        marks = marks(0, begin).unionByName(marks(2, F.lit('],"references":['), F.col("has_d") & F.col("has_r"))).unionByName(marks(4, F.lit("]}}")))
        rows = rows.withColumn("mark", F.lit(None).cast("string")).unionByName(marks, allowMissingColumns=True)
        if hot:
            rows = _listed(rows.repartition(tasks, "s", "part", "place"), codes, coded, simple).repartitionByRange(tasks, *order)
        else:
            rows = _listed(rows.repartitionByRange(tasks, "s"), codes, coded, simple)
        rows = rows.sortWithinPartitions(*order).select("part", _line().alias("line"))
        parts = fresh_path(spark, "json-lines")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")  # a line may be large
        try:
            with tidy(spark):
                rows.mapInArrow(_frames, "value binary").select(F.col("value").cast("string")).write.option("lineSep", _SKIP.decode()).text(parts)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few_rows)
        yield parts

def _joined(spark: SparkSession, head: str, folders: Iterable[str], tail: str, path: str) -> None:
    """The part files one after the other in one file, copied as streams and deleted; between two of them there is room for a comma."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = jvm.java.io.FileOutputStream(path)
    try:
        out.write(bytearray(_SKIP + _framed(head.encode()) + _SKIP))
        for parts in folders:
            folder = jvm.org.apache.hadoop.fs.Path(parts)
            fs = folder.getFileSystem(conf)
            for at in sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
                out.write(bytearray(_framed(b" \n", gap=True) + _SKIP))
                one = fs.open(at)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(one, out, 1 << 16, False)
                finally:
                    one.close()
                fs.delete(at, False)
            fs.delete(folder, True)
        out.write(bytearray(_framed(tail.encode())))
    finally:
        out.close()
    last, gap = False, None
    with open(path, "r+b") as f:
        for at, _, _, about in _hops(path):
            if about.get("gap"):
                gap = at
            elif "last" in about:
                if about["first"] and last and gap is not None:
                    f.seek(gap)
                    f.write(bytes(pa.Codec("zstd", 3).compress(b",\n", asbytes=True)))
                last, gap = about["last"], None


def _hops(path: str) -> Iterator[tuple[int, int, int, dict]]:
    """Where the frames of a compressed document are, their sizes and what is said of them."""
    with open(path, "rb") as f:
        while mark := f.read(4):
            n = struct.unpack("<I", f.read(4).ljust(4, b"\0"))[0] if mark == _SKIP else 0
            about = f.read(n)
            if len(about) < max(n, 8):
                raise RuntimeError(f"cannot load {path}: it has no end")
            size, raw = struct.unpack("<II", about[:8])
            at = f.tell()
            yield at, size, raw, json.loads(about[8:])
            f.seek(at + size)
        if f.tell() != os.path.getsize(path):
            raise RuntimeError(f"cannot load {path}: it has no end")


def _text(path: str, at: int, size: int, raw: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(at)
        return bytes(pa.Codec("zstd").decompress(f.read(size), decompressed_size=raw, asbytes=True))


def _before(path: str, at: int) -> tuple[bytes | None, str]:
    """The symbol and part that are open before a line of a plain document, found backwards a block at a time."""
    part, rest = "", b""
    with open(path, "rb") as f:
        while at > 0:
            low = max(0, at - (1 << 20))
            f.seek(low)
            lines = (f.read(at - low) + rest).split(b"\n")
            for line in reversed(lines[1:] if low else lines):
                if line.startswith(_MARKS):
                    symbol, begun = _turn(line)
                    part = part or begun
                    if symbol or line.endswith(b"]}}"):
                        return symbol, part if symbol else ""
            # a first line may begin before the block
            at, rest = low, lines[0] + b"\n" if low else b""
    return None, ""


def _facts_in(lines: Iterable[bytes], symbol: bytes | None, part: str, wanted: str) -> Iterator[tuple[bytes, int, bytes]]:
    """(symbol, number of the line, definition or reference) of one part of the entries."""
    for n, line in enumerate(lines):
        if line.startswith(_MARKS):
            opened, part = _turn(line)
            symbol = opened or symbol
        elif part == wanted and len(line) > 1:
            yield symbol, n, line.removeprefix(b",")


def _rows(spark: SparkSession, pieces: list, wanted: str, lines, slices: int) -> DataFrame:
    """(k, n, line) of the pieces of a document; ``lines`` gives those of a piece and what is open before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                held, size = [], 0
                for k, n, line in _facts_in(*lines(pieces[i]), wanted):
                    held.append((k, (i << 32) + n, line))
                    size += len(line)
                    if size >= 4 << 20:
                        yield out(held)
                        held, size = [], 0
                if held:
                    yield out(held)

    def out(held: list) -> pa.RecordBatch:
        k, n, line = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(line, pa.binary()).cast(pa.string())], names=["k", "n", "line"])

    return spark.range(0, len(pieces), 1, max(1, min(len(pieces), slices))).mapInArrow(run, "k string, n long, line string")


def _read_pieces(spark: SparkSession, path: str, mode: str | None) -> SymbolIndex | None:
    """A document as ``write_json`` lays it out, read in all tasks without an entry in memory; None where it is laid out otherwise."""
    with open(path, "rb") as f:
        packed = f.read(4) == _SKIP
        f.seek(0)
        begin = b"" if packed else f.readline(200) + f.readline(200)
        f.seek(0, os.SEEK_END)
        size = f.tell()
        f.seek(max(0, size - 2))
        ended = packed or f.read() == b"}\n"
    if packed:
        symbol, part, pieces = None, "", []
        for at, held, raw, about in _hops(path):
            if not pieces:
                begin = _text(path, at, held, raw)
            pieces.append((at, held, raw, symbol, part))
            symbol, part = about.get("symbol") or symbol, about.get("part") or part
    head = re.fullmatch(rb'\{"type": "(\w+)",\n"data": \[\n', begin)
    if not head or head[1].decode() not in _TYPES.values():
        return None
    kind = head[1].decode()
    if packed:
        ended = _text(path, *pieces[-1][:3]).endswith(b"}\n")
        slices = max(spark.sparkContext.defaultParallelism, len(pieces) // 4)
        lines = lambda p: (_text(path, *p[:3]).split(b"\n"), p[3] and p[3].encode(), p[4])
    else:
        step = _bytes_of(spark.conf.get("spark.sql.files.maxPartitionBytes"))
        pieces = [(a, min(size, a + step)) for a in range(0, size, step)]
        slices, lines = len(pieces), lambda p: _range_lines(path, *p)
    if not ended:
        raise RuntimeError(f"cannot load {path}: it has no end")
    if mode == "simple" and kind != _TYPES["simple"]:
        raise ValueError(f"{path} holds a {kind}")
    info = INDEX_DATA["data"].dataType.elementType["info"].dataType
    parsed = lambda part: _rows(spark, pieces, part, lines, slices).select(F.from_json("k", SYMBOL, {"mode": "FAILFAST"}).alias("symbol"), F.from_json("line", info[part].dataType.elementType, {"mode": "FAILFAST"}).alias("e"), F.col("n").alias("seq"))
    d, r = parsed("definitions"), parsed("references")
    calls = d.select(F.struct("symbol", "e.location").alias("caller"), F.posexplode("e.calls").alias("at", "callee")).select("caller", "callee", F.col("at").cast("long").alias("seq"))
    crossref = kind == _TYPES["crossref"]
    if not crossref:  # definitions at one place have the same calls
        calls = calls.groupBy("caller", "callee").agg(F.min("seq").alias("seq"))
    return SymbolIndex(d.select("symbol", "e.location", "e.doc", "e.llm_note", "seq"), r.select("symbol", "e.location", "seq"), calls, mode or next(m for m, t in _TYPES.items() if t == kind), crossref)


def _bytes_of(text: str) -> int:
    n, unit = re.fullmatch(r"(\d+)\s*([kmg]?)b?", text.strip().lower()).groups()
    return int(n) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]


def _range_lines(path: str, low: int, high: int) -> tuple[Iterator[bytes], bytes | None, str]:
    """The lines that begin in a range of a plain document."""
    f = open(path, "rb")  # noqa: SIM115
    if low:
        f.seek(low - 1)
        f.readline()
    at = f.tell()

    def run() -> Iterator[bytes]:
        with f:
            while f.tell() < high and (line := f.readline()):
                yield line.removesuffix(b"\n")

    return run(), *(_before(path, at) if low and at < high else (None, ""))


def _read_lines(spark: SparkSession, path: str, mode: str | None) -> SymbolIndex | None:
    """A document that has an entry a line, as ``write_json`` once laid it out, read in all tasks; None where it is laid out otherwise."""
    with open(path, "rb") as f:
        head = re.fullmatch(rb'\{"type": "(\w+)", "data": \[\n', f.readline(200))
        if not head or head[1].decode() not in _TYPES.values():
            return None
        f.seek(-2, os.SEEK_END)
        if f.read() != b"}\n":
            raise RuntimeError(f"cannot load {path}: it has no end")
    kind = head[1].decode()
    if mode == "simple" and kind != _TYPES["simple"]:
        raise ValueError(f"{path} holds a {kind}")
    entry = INDEX_DATA["data"].dataType.elementType
    # the first line and the last are no entries; they become null before they are parsed, as a filter may be tried after the parser
    text = F.when(F.col("value").rlike("^,?[{].symbol"), F.regexp_replace("value", "^,", ""))
    data = spark.read.option("lineSep", "\n").text(path).select(F.from_json(text, entry, {"mode": "FAILFAST"}).alias("e")).select("e.symbol", "e.info")
    return from_document(data, mode or next(m for m, t in _TYPES.items() if t == kind))


def from_document(data: DataFrame, mode: str) -> SymbolIndex:
    """The index of rows (symbol, info)."""
    d = data.select("symbol", F.posexplode("info.definitions").alias("n", "d"))
    r = data.select("symbol", F.posexplode("info.references").alias("n", "r"))
    definitions = d.select("symbol", "d.location", "d.doc", "d.llm_note", F.col("n").cast("long").alias("seq"))
    references = r.select("symbol", "r.location", F.col("n").cast("long").alias("seq"))
    called = d.select(F.struct("symbol", "d.location").alias("caller"), F.posexplode("d.calls").alias("at", "callee"))
    callers = r.select(F.struct("symbol", "r.location").alias("callee"), F.posexplode("r.called_by").alias("at", "caller"))
    calls = called.select("caller", "callee", F.col("at").cast("long").alias("seq")).unionByName(callers.select("caller", "callee", F.col("at").cast("long").alias("seq")))
    return SymbolIndex(definitions, references, calls.groupBy("caller", "callee").agg(F.min("seq").alias("seq")), mode)


def read_json(spark: SparkSession, path: str, mode: str | None = None) -> SymbolIndex:
    """Load a document; ``mode`` simple insists on a document of that type."""
    if "://" not in path:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        if not os.path.isfile(path):
            raise ValueError(f"{path} is not a file")
        if (found := _read_pieces(spark, path, mode) or _read_lines(spark, path, mode)) is not None:
            return found
    try:
        raw = spark.read.schema(INDEX_DATA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
        kind = raw.select("type").first()
    except Exception as e:
        raise RuntimeError(f"cannot load {path}: {e}") from e
    if kind is None or kind[0] is None:
        raise RuntimeError(f"cannot load {path}: no index in it")
    if mode == "simple" and kind[0] != _TYPES["simple"]:
        raise ValueError(f"{path} holds a {kind[0]}")
    return from_document(raw.select(F.explode("data").alias("e")).select("e.symbol", "e.info"), mode or next((m for m, t in _TYPES.items() if t == kind[0]), "crossref"))


def write_parquet(index: SymbolIndex, path: str) -> None:
    """The native store: one table a relation, sorted by symbol name so that point queries skip row groups."""
    for name, df in (("definitions", index.definitions), ("references", index.references)):
        df.sortWithinPartitions("symbol.name").write.mode("overwrite").parquet(f"{path}/{name}")
    index.calls.sortWithinPartitions("callee.symbol.name").write.mode("overwrite").parquet(f"{path}/calls")
    index.definitions.sparkSession.createDataFrame([(index.mode,)], "mode string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_parquet(spark: SparkSession, path: str) -> SymbolIndex:
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    return SymbolIndex(read("definitions"), read("references"), read("calls"), read("meta").first()[0])
