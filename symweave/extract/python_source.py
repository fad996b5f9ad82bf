"""Python files: the standard library's parser, and a tolerant scan where it refuses."""

from __future__ import annotations

import ast
import re
import warnings

from symweave.extract.rows import DEFINITION, REFERENCE, Row

#: Words that look like calls when a parenthesis follows (fixed values).
KEYWORDS = frozenset("and as assert async await class def del elif else except for from global if import in is lambda nonlocal not or pass raise return while with yield match case print exec".split()) - {"print", "exec", "match", "case"}


def clean_docstring(raw: str) -> str:
    """Without one matching pair of quotes; literals with a prefix stay raw."""
    for mark in ('"""', "'''", '"', "'"):
        if raw.startswith(mark) and raw.endswith(mark) and len(raw) >= 2 * len(mark):
            return raw[len(mark) : -len(mark)].strip()
    return raw.strip()


def extract(content: bytes) -> list[Row]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return scan(content)
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", content))]
    bom = 3 if content.startswith(b"\xef\xbb\xbf") else 0

    def at(line: int, col: int) -> int:
        return starts[line - 1] + col + (bom if line == 1 else 0)

    def begin(node) -> int:
        if getattr(node, "decorator_list", None):
            first = node.decorator_list[0]
            return content.rindex(b"@", 0, at(first.lineno, first.col_offset))
        return at(node.lineno, node.col_offset)

    def end(node) -> int:
        return at(node.end_lineno, node.end_col_offset)

    def doc_of(body: list[ast.stmt]) -> str | None:
        for s in body:
            if not isinstance(s, ast.Expr):
                return None
            text = isinstance(s.value, ast.JoinedStr) or isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)
            if text:
                return clean_docstring(content[at(s.lineno, s.col_offset) : end(s)].decode("utf-8", "replace"))
        return None

    definitions: list[Row] = []
    references: list[Row] = []
    # an explicit stack: sources may nest deeper than Python's own
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, owner = stack.pop()
        inner = owner
        if isinstance(node, ast.ClassDef):
            inner = node.name
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            definitions.append(Row(DEFINITION, "method" if owner else "function", node.name, owner, begin(node), end(node), begin(node.body[0]), end(node), doc_of(node.body)))
        elif isinstance(node, ast.Call):
            a, b = at(node.lineno, node.col_offset), end(node)
            if isinstance(node.func, ast.Attribute):
                references.append(Row(REFERENCE, "method", node.func.attr, None, a, b))
            elif isinstance(node.func, ast.Name) and content[a : a + 1] != b"(":
                references.append(Row(REFERENCE, "function", node.func.id, None, a, b))
        stack.extend((child, inner) for child in ast.iter_child_nodes(node))
    return sorted(definitions, key=lambda r: (r.start, r.end)) + sorted(references, key=lambda r: (r.start, -r.end))


_STRING = re.compile(rb"(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|#[^\n]*", re.DOTALL)
_HEAD = re.compile(rb"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)", re.MULTILINE)
_CALL = re.compile(rb"(?<![\w.])((?:[^\W\d]\w*[ \t]*\.[ \t]*)*)([^\W\d]\w*)[ \t]*\(")


_DOC = re.compile(rb"(?:[ \t\r\n\\]|#[^\n]*\n)*+((?:[rRbBuU]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))[ \t]*(?:[\r\n;#]|\Z)", re.DOTALL)


def closers(text: bytes) -> dict[int, int]:
    """The place after the closing parenthesis of each opening one, in one pass."""
    found, held = {}, []
    for m in re.finditer(rb"[()]", text):
        if m[0] == b"(":
            held.append(m.start())
        elif held:
            found[held.pop()] = m.end()
    return found


def scan(content: bytes) -> list[Row]:
    """Definitions by indentation, with the string that opens their body, and calls by their parentheses, for files that do not parse."""
    blank = _STRING.sub(lambda m: re.sub(rb"[^\n]", b" ", m[0]), content)
    lines = [(m.start(), m[0]) for m in re.finditer(rb"[^\n]*\n?", blank) if m[0]]
    rows: list[Row] = []
    classes: list[tuple[int, int, str]] = []  # begin, end, name
    found = []
    for m in _HEAD.finditer(blank):
        depth, stop = len(m[1].expandtabs()), len(content.rstrip())
        for at, text in lines:
            if at > m.start() and text.strip() and len(text) - len(text.lstrip()) <= depth and len(text.expandtabs()) - len(text.expandtabs().lstrip()) <= depth:
                stop = len(content[:at].rstrip())
                break
        if m[2] == b"class":
            classes.append((m.start(), stop, m[3].decode("utf-8", "replace")))
        else:
            found.append((m, stop))
    heads, closed = {m.start(3) for m, _ in found}, closers(blank)
    for m, stop in found:
        owner = next((n for a, b, n in reversed(classes) if a < m.start() < b), None)
        colon = blank.find(b":", closed.get(blank.find(b"(", m.end(), max(stop, m.end())), m.end()))
        body = colon + 1 if 0 <= colon < stop else m.end()
        opens = _DOC.match(content, body, max(stop, body))
        doc = clean_docstring(opens[1].decode("utf-8", "replace")) if opens else None
        rows.append(Row(DEFINITION, "method" if owner else "function", m[3].decode("utf-8", "replace"), owner, m.start() + len(m[1]), max(stop, m.end()), body, max(stop, m.end()), doc))
    for m in _CALL.finditer(blank):
        name = m[2].decode("utf-8", "replace")
        if name in KEYWORDS or m.start(2) in heads or re.search(rb"\b(?:def|class)[ \t]+$", blank[: m.start(2)][-40:]):
            continue
        close = closed.get(m.end() - 1)
        if close is not None:
            rows.append(Row(REFERENCE, "method" if m[1] else "function", name, None, m.start(), close))
    return rows
