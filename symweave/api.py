"""One object a session: index a repository, ask it, walk its graph, annotate it."""

from __future__ import annotations

import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from symweave.extract import index_files, language
from symweave.functions import text as T
from symweave.operators import graph as G
from symweave.operators import index as I
from symweave.operators.tasks import TaskList, describe_tasks
from symweave.schema import NOTE, PLACED, qualified
from symweave.sources import files as S
from symweave.sources.json_index import read_json, read_parquet, write_json, write_parquet
from symweave.sources.sqlite import read_sqlite, write_sqlite
from symweave.storage import materialise

log = logging.getLogger("symweave")
CACHE = ".symweave"
#: Submitted notes, one JSON line each, beside the stored index.
NOTES = "notes.jsonl"
POLICIES = ("arbitrary", "bfs_callee_to_caller", "bfs_caller_to_callee")


class CodeAnalytics:
    """Facade over the operators; every method that returns a frame is lazy but for loops over the graph."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root: str | None = None
        self._index: I.SymbolIndex | None = None
        self._files: DataFrame | None = None
        self._graphs: dict[tuple, G.CallGraph] = {}
        self._tasks: TaskList | None = None
        self._notes = 0
        self._store: str | None = None

    def __repr__(self) -> str:
        return f"CodeAnalytics({self.root}, {self._index!r})"

    @property
    def index(self) -> I.SymbolIndex:
        """The current index; every call that needs one is logged, and fails while there is none."""
        if self._index is None:
            raise RuntimeError("no repository is indexed yet")
        log.debug("%s asked by %s", self.root, sys._getframe(1).f_code.co_name)
        return self._index

    @index.setter
    def index(self, value: I.SymbolIndex) -> None:
        self._index = value
        self._graphs.clear()  # a graph never outlives the index it was made from

    # ---- set-up and persistence ----

    def setup_repo_index(self, root: str, lang: str, mode: str = "crossref", persist: str = "auto") -> CodeAnalytics:
        """Load the repository's stored index, or extract and store one. ``persist``: auto, json, sqlite, parquet or none."""
        if persist not in ("auto", "json", "sqlite", "parquet", "none"):
            raise ValueError(f"unknown persistence {persist!r}")
        if language(lang) is None:
            raise ValueError(f"unsupported language {lang!r}")
        self.root = root
        self._files = S.scan_project(self.spark, root, lang)
        cache = os.path.join(root, CACHE)
        self._store = cache if persist != "none" else None
        kinds = [k for k in ("json", "sqlite", "parquet") if persist in ("auto", k) and os.path.exists(f"{cache}/index.{k}")]
        if kinds:
            self.load_index(f"{cache}/index.{kinds[0]}", kinds[0])
            return self._with_stored_notes()
        index = index_files(self._files, lang, mode)
        self.index = I.SymbolIndex(*[materialise(df, "index") for df in (index.definitions, index.references, index.calls)], mode)
        if persist != "none":
            os.makedirs(cache, exist_ok=True)
            kind = "json" if persist == "auto" else persist
            self.dump_index(f"{cache}/index.{kind}", kind)
        return self._with_stored_notes()

    def _with_stored_notes(self) -> CodeAnalytics:
        """Notes that were submitted in earlier sessions, beside whatever the stored index holds."""
        path = os.path.join(self._store or "", NOTES)
        if self._store and os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                rows = [json.loads(line) for line in f]
            self._notes = len(rows)
            schema = T_.StructType([*PLACED.fields, T_.StructField("llm_note", NOTE), T_.StructField("seq", T_.LongType())])
            lines = self.spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
            self._index = self.index.append(definitions=lines.select(F.from_json("j", schema).alias("r")).select("r.symbol", "r.location", F.lit(None).cast("string").alias("doc"), "r.llm_note", "r.seq"))
        return self

    def index_file(self, path: str, lang: str) -> CodeAnalytics:
        """Add one file; a missing one changes nothing."""
        found = S.scan_file(self.spark, path, lang, self.root)
        more = index_files(found, lang, self._index.mode if self._index else "crossref")
        self.index = more if self._index is None else self.index.append(more.definitions, more.references, more.calls)
        self._files = found if self._files is None else self._files.unionByName(found)
        return self

    def dump_index(self, path: str, kind: str = "json") -> None:
        {"json": write_json, "sqlite": write_sqlite, "parquet": write_parquet}[kind](self.index, path)

    def load_index(self, path: str, kind: str = "json") -> CodeAnalytics:
        """Replace the index by a stored one."""
        self.index = {"json": read_json, "sqlite": read_sqlite, "parquet": read_parquet}[kind](self.spark, path)
        return self

    def clear_index(self) -> CodeAnalytics:
        self.index = self.index.emptied()
        return self

    # ---- symbols and source ----

    def get_all_symbols(self) -> DataFrame:
        return self.index.sorted_symbols()

    def query_symbol(self, type_: str | None = None, name: str | None = None, class_name: str | None = None, regex: str | None = None, with_code: bool = True) -> DataFrame:
        """By key (type, name and class), by name (of one type or all), or by pattern; definitions and references, with their source.

        A method without a class is asked by name: methods of that name in every class, and calls of methods whose class is not known.
        """
        if regex is not None:
            rows = I.query_by_regex(self.index, regex, type_ or "all")
        elif name is None:
            raise ValueError("a name or a pattern is needed")
        elif type_ == "method" and class_name is None:
            rows = I.query_by_name(self.index, name, type_)
        elif type_ is not None:
            rows = I.query_by_key(self.index, type_, name, class_name)
        else:
            rows = I.query_by_name(self.index, name)
        return I.with_source(rows, self._files) if with_code and self._files is not None else rows

    def get_symbol_info(self, type_: str, name: str, class_name: str | None = None) -> DataFrame:
        """The document of one symbol; only its own facts are gathered."""
        return self.index.info(I.is_symbol(F.col("symbol"), type_, name, class_name))

    def get_llm_note(self, type_: str, name: str, class_name: str | None = None) -> DataFrame:
        return self.index.notes(type_, name, class_name)

    def find_definitions(self, name: str) -> DataFrame:
        return I.find_definitions(self.index, name)

    def find_references(self, name: str) -> DataFrame:
        return I.find_references(self.index, name)

    def get_full_definition(self, type_: str, name: str, class_name: str | None, start_byte: int, file_path: str) -> DataFrame:
        return I.query_full_definition(self.index, type_, name, class_name, (F.col("location.start_byte") == start_byte) & (F.col("location.file_path") == file_path))

    def resolve_file_path(self, path: str) -> str:
        return S.resolve_path(self.root or ".", path)

    def _content(self, path: str) -> DataFrame:
        found = S.scan_file(self.spark, self.resolve_file_path(path), "any")
        if found.isEmpty():
            raise FileNotFoundError(path)
        return found

    def fetch_source_code(self, path: str) -> str:
        return self._content(path).select(T.text_of(F.col("content"))).first()[0]

    def fetch_source_code_by_lineno_range(self, path: str, start: int, end: int) -> str:
        T.check_range(start, end)
        return self._content(path).select(T.line_slice(T.text_of(F.col("content")), start, end)).first()[0]

    def fetch_source_code_by_byte_range(self, path: str, start: int, end: int) -> str:
        T.check_range(start, end, strict=True)
        return self._content(path).select(T.byte_slice(F.col("content"), start, end)).first()[0]

    # ---- graph ----

    def graph(self, expand_calls: bool = True, direction: str = G.FORWARD) -> G.CallGraph:
        key = (expand_calls, direction)
        if key not in self._graphs:
            self._graphs[key] = G.call_graph(self.index, expand_calls, direction)
        return self._graphs[key]

    def get_graph_overview(self) -> dict:
        """Counts, component sizes, and at most ten entry and end components."""
        g = self.graph()
        sccs = materialise(G.components(g.nodes, g.edges), "sccs")
        dag = materialise(G.component_edges(g.edges, sccs), "dag")
        ends = lambda side: [r[0] for r in G.terminal_components(sccs, dag, side).orderBy("scc_id").limit(10).collect()]
        return {"stats": g.stats().first().asDict(), "sccs": G.component_sizes(sccs).orderBy(F.desc("size"), "scc_id"), "entry_points": ends("entry"), "end_points": ends("end")}

    def get_subgraph(self, roots: DataFrame | None = None, depth: int | None = 5, include_reverse: bool = False) -> G.CallGraph:
        """``roots``: column ``location``; none, or none that is a node, gives the whole graph."""
        g = self.graph()
        ids = None if roots is None else g.nodes.join(roots.select("location").distinct(), "location", "left_semi").select("node_id")
        return G.subgraph(g, ids, depth, include_reverse)

    def _node(self, type_: str, name: str, class_name: str | None) -> int:
        row = self.graph().nodes.where(I.is_symbol(F.col("owner"), type_, name, class_name)).agg(F.min("node_id")).first()
        if row[0] is None:
            raise ValueError("Source or destination node not found in graph")
        return row[0]

    def find_paths(self, src: tuple, dst: tuple, k: int = 3, mode: str = "hybrid", max_depth: int | None = None) -> DataFrame:
        """(path_no, text) between two symbols (type, name, class): node, scc or hybrid paths."""
        g, a, b = self.graph(), self._node(*src), self._node(*dst)
        if mode not in ("node", "scc", "hybrid"):
            raise ValueError(f"unknown path mode {mode!r}")
        if mode == "node":
            return G.rendered_nodes(G.first_paths(g.edges, a, b, k, max_depth), g.nodes.select("node_id", qualified(F.col("owner")).alias("name")))
        sccs = materialise(G.components(g.nodes, g.edges), "sccs")
        if mode == "scc":
            paths = G.component_paths(G.component_edges(g.edges, sccs), sccs, a, b, k, max_depth)
            return paths.select("path_no", F.array_join(F.transform("nodes", lambda n: F.concat(F.lit("SCC["), n.cast("string"), F.lit("]"))), "->").alias("text"))
        segs = G.segments(G.first_paths(g.edges, a, b, k, max_depth), sccs)
        return G.rendered_segments(segs, g.nodes.select("node_id", qualified(F.col("owner")).alias("name")))

    def get_topological_order(self, direction: str = G.BACKWARD) -> DataFrame:
        """(node_id, position): breadth-first order from the ends of the component graph."""
        g = self.graph()
        sccs = materialise(G.components(g.nodes, g.edges), "sccs")
        starts = G.starting_nodes(g.nodes, g.edges, direction, sccs)
        ranked = starts.withColumn("rank", F.col("scc_id") * F.lit(1 << 31) + F.col("node_id")).select("node_id", "rank")
        return G.bfs_order(g.nodes, G.directed(g.edges, direction), ranked)

    # ---- annotation ----

    def setup_describe_definitions(self, policy: str = "arbitrary", skip_existing_notes: bool = True) -> TaskList:
        if policy not in POLICIES:
            raise ValueError(f"unknown policy {policy!r}; one of {', '.join(POLICIES)}")
        nodes = self.graph().nodes.select(F.col("node_id").alias("task_id"), F.col("owner").alias("symbol"), "location")
        noted = self.index.all_definitions().where("llm_note is not null").join(nodes, ["location"], "left_semi").select("location")
        known = nodes.join(noted, "location", "left_semi").select("task_id")
        order = None
        if policy != "arbitrary":
            order = self.get_topological_order(G.BACKWARD if policy == "bfs_callee_to_caller" else G.FORWARD).select(F.col("node_id").alias("task_id"), "position")
        tasks = materialise(describe_tasks(nodes, known, order, skip_existing_notes), "tasks")
        self._tasks = TaskList(tasks, self.spark.createDataFrame([], "seq long, task_id long, result string"))
        return self._tasks

    @property
    def tasks(self) -> TaskList:
        if self._tasks is None:
            raise RuntimeError("no task list is set up yet")
        return self._tasks

    def get_one_describe_definition_task(self):
        return self.tasks.any_pending().first()

    def get_pending_describe_tasks(self, n: int) -> DataFrame:
        return self.tasks.pending_page(n)

    def get_stats_of_describe_definition_todolist(self) -> str:
        return self.tasks.progress().first()["text"]

    def submit_definition_task(self, task_id: int, description: str, potential_vulnerabilities: str = "", control_flow: str = "") -> None:
        """Store the note on the definition, also beside the stored index, and mark its task."""
        row = self.tasks.tasks.where(F.col("task_id") == task_id).first()
        if row is None:
            raise KeyError(task_id)
        self._tasks = self.tasks.submit(task_id, description)
        values = {"description": description, "potential_vulnerabilities": potential_vulnerabilities, "control_flow": control_flow}
        note = F.struct(*[F.lit(v).alias(n) for n, v in values.items()])
        own = self.index.all_definitions().where((F.col("location") == F.struct(*[F.lit(v).alias(n) for n, v in row["location"].asDict().items()])))
        # the latest note wins: its number is above every place in a file
        self._notes += 1
        more = materialise(own.select("symbol", "location", F.lit(None).cast("string").alias("doc"), note.alias("llm_note"), F.lit((1 << 40) + self._notes).alias("seq")), "note")
        self._index = self.index.append(definitions=more)
        if self._store:
            os.makedirs(self._store, exist_ok=True)
            with open(os.path.join(self._store, NOTES), "a", encoding="utf-8") as f:
                for r in more.select("symbol", "location", "llm_note", "seq").toLocalIterator():
                    f.write(json.dumps(r.asDict(True), ensure_ascii=False) + "\n")
