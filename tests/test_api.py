import pytest

from symweave.api import CodeAnalytics
from symweave.streaming import incremental

MAIN = '#include "u.h"\nint main(void) { print_result(add(1, 2)); return multiply(2, 3); }\n'
UTILS = "/* Adds. */\nint add(int a, int b) { return a + b; }\nint multiply(int a, int b) { int r = 0; r = add(r, a); r = add(r, b); return r; }\nvoid print_result(int r) { printf(\"%d\", r); }\n"


@pytest.fixture()
def repo(tmp_path):
    (tmp_path / "main.c").write_text(MAIN)
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "utils.c").write_text(UTILS)
    (tmp_path / "notes.txt").write_text("add(1)")
    return tmp_path


def test_repository_end_to_end(spark, repo):
    code = CodeAnalytics(spark)
    with pytest.raises(RuntimeError):
        code.get_all_symbols()
    code.setup_repo_index(str(repo), "c", persist="auto")
    counts = {r.symbol.name: (r.n_definitions, r.n_references) for r in code.index.counts().collect()}
    assert counts == {"main": (1, 0), "add": (1, 3), "multiply": (1, 1), "print_result": (1, 1), "printf": (0, 1)}
    rows = code.query_symbol("function", "add").where("kind = 'definition'").collect()
    assert rows[0].source_code == "int add(int a, int b) { return a + b; }" and rows[0].location.file_path == "sub dir/utils.c"
    info = code.get_symbol_info("function", "add").first()
    assert {c.symbol.name for r in info.references for c in r.called_by} == {"main", "multiply"}
    assert code.fetch_source_code_by_lineno_range("main.c", 1, 1) == '#include "u.h"'
    assert code.fetch_source_code_by_byte_range("main.c", 0, 8) == "#include"
    with pytest.raises(FileNotFoundError):
        code.fetch_source_code("nothing.c")
    over = code.get_graph_overview()
    assert over["stats"] == {"num_nodes": 4, "num_edges": 5, "unresolved_calls": 1}
    assert len(over["entry_points"]) == 1 and over["sccs"].count() == 4
    paths = [r.text for r in code.find_paths(("function", "main", None), ("function", "add", None), 3, "node").orderBy("path_no").collect()]
    assert paths == ["main->add", "main->multiply->add", "main->multiply->add"]
    assert code.find_paths(("function", "main", None), ("function", "add", None), 1).first().text.count("SCC[") == 2
    with pytest.raises(ValueError, match="not found in graph"):
        code.find_paths(("function", "x", None), ("function", "add", None))
    order = [r.node_id for r in code.get_topological_order().orderBy("position").collect()]
    assert len(order) == 4
    again = CodeAnalytics(spark).setup_repo_index(str(repo), "c")
    assert {r.symbol.name for r in again.get_all_symbols().collect()} == set(counts)


@pytest.mark.parametrize("policy", ["arbitrary", "bfs_callee_to_caller", "bfs_caller_to_callee"])
def test_annotation(spark, repo, policy):
    code = CodeAnalytics(spark).setup_repo_index(str(repo), "c", persist="none")
    q = code.setup_describe_definitions(policy)
    assert {r.symbol.name for r in q.pending().collect()} == {"main", "add", "multiply", "print_result"}
    task = code.get_one_describe_definition_task()
    code.submit_definition_task(task.task_id, "what it does")
    assert code.get_stats_of_describe_definition_todolist() == "1/4 submitted, 3 pending"
    assert code.setup_describe_definitions(policy).tasks.count() == 3
    with pytest.raises(KeyError):
        code.submit_definition_task(999, "x")
    with pytest.raises(ValueError):
        code.setup_describe_definitions("sideways")


def test_bad_arguments(spark, repo):
    with pytest.raises(ValueError):
        CodeAnalytics(spark).setup_repo_index(str(repo), "cobol")
    with pytest.raises(ValueError):
        CodeAnalytics(spark).setup_repo_index(str(repo), "c", persist="tape")
    code = CodeAnalytics(spark).setup_repo_index(str(repo), "c", persist="none")
    n = code.index.totals().first()
    code.index_file(str(repo / "gone.c"), "c")
    assert code.index.totals().first() == n


def test_drop_folder(spark, tmp_path):
    src, store = tmp_path / "src", tmp_path / "store"
    src.mkdir()
    (src / "a.py").write_text("def f():\n    g()\n")
    incremental.start(spark, str(src), str(store), "python").awaitTermination()
    (src / "b.py").write_text("def h():\n    pass\n")
    incremental.start(spark, str(src), str(store), "python").awaitTermination()
    rows = incremental.current(spark, str(store)).select("file_path", "kind", "name").collect()
    assert sorted(tuple(r) for r in rows) == [("a.py", "definition", "f"), ("a.py", "reference", "g"), ("b.py", "definition", "h")]
