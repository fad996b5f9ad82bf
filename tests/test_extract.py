import pytest

from symweave.extract import LANGUAGES, index_files, language
from symweave.extract.c_family import clean_comment, extract_c, extract_cpp
from symweave.extract.python_source import clean_docstring, extract, scan


def texts(rows, source, kind):
    return [source[r.start : r.end].decode() for r in rows if r.kind == kind]


def named(rows, kind):
    return [(r.type, r.name, r.class_name) for r in rows if r.kind == kind]


PY = b'''@dec(1)
def f(a, b=g()):
    """Doc."""
    def inner():
        return h.k(f(2)).z()
    return inner()


class C:
    class D:
        async def m(self):
            'one'
            self.m()
            (a + b).q(1)
            f()()
            x[0]()
'''


def test_python_definitions_span_decorators_and_nest():
    rows = extract(PY)
    assert named(rows, "definition") == [("function", "f", None), ("function", "inner", None), ("method", "m", "D")]
    assert texts(rows, PY, "definition")[0].startswith("@dec(1)\ndef f") and texts(rows, PY, "definition")[0].endswith("return inner()")
    assert [r.doc for r in rows if r.kind == "definition"] == ["Doc.", None, "one"]


def test_python_calls_have_exact_ranges():
    assert texts(extract(PY), PY, "reference") == ["dec(1)", "g()", "h.k(f(2)).z()", "h.k(f(2))", "f(2)", "inner()", "self.m()", "(a + b).q(1)", "f()"]


def test_python_offsets_are_bytes():
    src = "s = 'é日'; café(1)\n".encode()
    assert texts(extract(src), src, "reference") == ["café(1)"]


@pytest.mark.parametrize("src", [b"", b"def f(:\n  g(1)\n", b"\x00", b"class (((", b"print 'x'\n"])
def test_python_never_raises(src):
    extract(src)


def test_broken_python_is_scanned():
    rows = scan(b"class K:\n    def m(self):\n        return go(1)\n\ndef broken(:\n    obj.call(2)\n    'quoted(3)' # noted(4)\n")
    assert named(rows, "definition") == [("method", "m", "K"), ("function", "broken", None)]
    assert named(rows, "reference") == [("function", "go", None), ("method", "call", None)]


@pytest.mark.parametrize(("raw", "clean"), [('"""a"""', "a"), ("'''b\n'''", "b"), ('"c"', "c"), ("'d'", "d"), ('r"""e"""', 'r"""e"""'), ("  ' f '", "f")])
def test_docstring_cleaning(raw, clean):
    assert clean_docstring(raw.strip()) == clean


C = b'''/* Adds
 * two. */

// second
int add(int a, int b) { return a + b; }
static char *name(void) { return "x("; }
char **names(void) { return 0; }
int proto(int);
#define M(x) add(x, 1)
int multiply(int a, int b) {
  int r = 0;
  for (;;) r = add(r, a);
  p->call(1); (*fp)(2); obj.f(3);
  if (r) printf("%d", add(r, mul2(3)));
  foo bar(baz); foo_t *x = make(1);
  return sizeof(r) + M(2);
}
'''


def test_c_definitions_and_documents():
    rows = extract_c(C)
    assert named(rows, "definition") == [("function", n, None) for n in ("add", "name", "multiply")]
    assert rows[0].doc == "Adds\ntwo.\nsecond"
    assert texts(rows, C, "definition")[0] == "int add(int a, int b) { return a + b; }"


def test_c_calls_are_whole_expressions():
    assert texts(extract_c(C), C, "reference") == ["add(r, a)", 'printf("%d", add(r, mul2(3)))', "add(r, mul2(3))", "mul2(3)", "make(1)", "M(2)"]


def test_header_has_no_definitions():
    assert extract_c(b"int f(int);\nstruct s { int (*g)(int); };\n") == []


CPP = b'''// doc
namespace n {
template <class T> T pick(T a) { return clip(a); }
int plain(int x) { return A::b(x) + plain(1); }
}
class K { public: K(int a) : v(a) { init(); } int m() { return helper(v); } int v; };
int K::d(int q) { return free_call(q); }
int *ptr() { return 0; }
std::vector<int> v2() { std::vector<int> w(3); return w; }
auto s = R"(not(1))";
// documented
int documented() { K k(3); new K(1); return K(2).m(); }
'''


def test_cpp_definitions_are_plain_functions():
    rows = extract_cpp(CPP)
    assert [r.name for r in rows if r.kind == "definition"] == ["pick", "plain", "v2", "documented"]
    assert [r.doc for r in rows if r.kind == "definition"] == [None, None, None, "documented"]


def test_cpp_calls_are_names_alone():
    assert texts(extract_cpp(CPP), CPP, "reference") == ["clip", "plain", "init", "helper", "free_call", "K"]


@pytest.mark.parametrize("src", [b"", b"int f( {", b"}}}} ) f(1)", b'"unclosed', b"/* open", b"#if X\nint a(\n#else"])
def test_c_never_raises(src):
    extract_c(src)
    extract_cpp(src)


@pytest.mark.parametrize(("raw", "clean"), [("/* a */", "a"), ("// b", "b"), ("/**\n * c\n * d\n */", "c\nd"), ("/*\n*e\n*/", "e")])
def test_comment_cleaning(raw, clean):
    assert clean_comment(raw) == clean


def test_languages():
    assert LANGUAGES["c"].extensions == (".c", ".h") and ".h" in LANGUAGES["cpp"].extensions
    assert language("rust") is None


def test_index_of_a_class(spark):
    src = b"class Calc:\n    def add(self, a):\n        return a\n\ndef use(c):\n    c.add(1)\n    return c.add(2)\n"
    files = spark.createDataFrame([("calc.py", bytearray(src)), ("empty.py", bytearray(b"")), ("none.py", None)], "file_path string, content binary")
    got = {(r.symbol.name, r.symbol.class_name): (r.n_definitions, r.n_references) for r in index_files(files, "python").counts().collect()}
    assert got == {("add", "Calc"): (1, 0), ("use", None): (1, 0), ("add", None): (0, 2)}


def test_calls_belong_to_every_enclosing_definition(spark):
    src = b"def outer():\n    def inner():\n        deep()\n    inner()\n"
    calls = index_files(spark.createDataFrame([("a.py", bytearray(src))], "file_path string, content binary"), "python").calls
    assert sorted((r.caller.symbol.name, r.callee.symbol.name) for r in calls.collect()) == [("inner", "deep"), ("outer", "deep"), ("outer", "inner")]


def test_syntax_tree_rows(spark):
    from symweave.extract.ast_nodes import ast_nodes, extent, histogram, samples

    files = spark.createDataFrame([("a.py", bytearray(b"def f():\n    g(1)\n    g(2)\n    g(3)\n    g(4)\n")), ("bad.py", bytearray(b"def ("))], "file_path string, content binary")
    nodes = ast_nodes(files)
    count = {r["node_type"]: r["count"] for r in histogram(nodes).collect()}
    assert count["Call"] == 4 and count["FunctionDef"] == 1 and list(count) == sorted(count)
    assert samples(nodes, "Call").count() == 3
    assert extent(nodes).first().max_depth == 6


def test_files_that_do_not_parse_keep_document_strings_and_long_calls():
    from symweave.extract.python_source import extract

    src = b'def f(a: int = 1) -> int:\n    """Doc of f."""\n    g(1, (2))\n\nclass C:\n    def m(self):  # x\n        # note\n        \'single\'\n        h(' + b"1, " * 20_000 + b'2)\n    def n(self):\n        x = "no"\n        k(\n(((\n'
    rows = extract(src)
    assert [(r.name, r.class_name, r.doc) for r in rows if r.kind == "definition"] == [("f", None, "Doc of f."), ("m", "C", "single"), ("n", "C", None)]
    assert [r.name for r in rows if r.kind == "reference"] == ["g", "h"]
