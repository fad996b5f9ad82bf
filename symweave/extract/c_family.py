"""C and C++ files: a lexer and one pass over its tokens.

Definitions are recognised at file, namespace and template scope by a declarator
``name ( ... )`` before a body; prototypes have none. In C one level of pointer
in the result is allowed for, in C++ only plain names count, and methods in
classes are left out, though calls in their bodies are references. A call is a
plain name before a parenthesis in a body or an initialiser; C refers to the
whole call, C++ to the name.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from symweave.extract.rows import DEFINITION, REFERENCE, Row


class Token(NamedTuple):
    kind: str  # word, mark, text
    text: bytes
    start: int
    end: int


_LEX = re.compile(
    rb"""(?P<comment>/\*.*?(?:\*/|\Z)|//(?:[^\n\\]|\\.)*)
|(?P<raw>(?:u8|[uUL])?R"(?P<tag>[^ ()\\\t\v\f\n]{0,16})\(.*?(?:\)(?P=tag)"|\Z))
|(?P<text>(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"?|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+'?)
|(?P<pre>^[ \t]*\#(?:[^\n\\/]|\\.|/(?![*/])|/\*.*?\*/)*)
|(?P<word>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)
|(?P<number>\.?\d(?:[eEpP][+-]|[\w.'])*)
|(?P<mark>->\*?|::|\.\.\.|[-+*/%&|^=<>!~?:;,.(){}\[\]\#@])""",
    re.DOTALL | re.MULTILINE | re.VERBOSE,
)

#: Words that are never the name of a call (fixed values).
NOT_CALLED = frozenset(
    b"if for while switch return sizeof do else case goto default break continue typeof __typeof__ _Alignof alignof _Generic _Static_assert static_assert defined "
    b"int char short long float double void signed unsigned bool _Bool auto const volatile struct union enum class typename template operator new delete catch throw "
    b"decltype noexcept alignas asm __asm__ __attribute__ __declspec static extern inline register typedef namespace using friend public private protected virtual explicit "
    b"static_cast dynamic_cast const_cast reinterpret_cast co_await co_return co_yield requires size_t".split()
)
#: Words after which a name before a parenthesis is still a call.
BEFORE_CALL = frozenset(b"return else do case throw co_return co_await co_yield and or not goto in sizeof".split())
_TYPES = frozenset(b"class struct union enum".split())
_AFTER_LIST = frozenset(b"const volatile noexcept override final mutable try __attribute__ throw requires".split())


def clean_comment(text: str) -> str:
    """A comment without its marks; leading stars of its lines go too."""
    text = text.strip()
    if text.startswith("/*"):
        text = text[2:-2] if text.endswith("*/") and len(text) >= 4 else text[2:]
    elif text.startswith("//"):
        text = text[2:]
    out = []
    for line in text.split("\n"):
        line = line.strip()
        out.append(line[2:] if line.startswith("* ") else line[1:] if line.startswith("*") else line)
    return "\n".join(out).strip()


class _Source:
    def __init__(self, content: bytes, cpp: bool):
        self.cpp = cpp
        self.tokens: list[Token] = []
        self.comments: dict[int, list[Token]] = {}  # by the number of tokens before them
        for m in _LEX.finditer(content):
            kind = m.lastgroup if m.lastgroup != "tag" else "raw"
            if kind == "comment":
                self.comments.setdefault(len(self.tokens), []).append(Token(kind, m[0], m.start(), m.end()))
            elif kind != "pre":
                self.tokens.append(Token("word" if kind == "word" else "mark" if kind == "mark" else "text", m[0], m.start(), m.end()))
        self.match = self._pairs()
        self.rows: list[Row] = []

    def _pairs(self) -> dict[int, int]:
        """Numbers of opening brackets to those of their closing ones; unmatched ones close at the end of their parent."""
        out: dict[int, int] = {}
        stack: list[int] = []
        ends = {b")": b"(", b"]": b"[", b"}": b"{"}
        for i, t in enumerate(self.tokens):
            if t.kind != "mark":
                continue
            if t.text in (b"(", b"[", b"{"):
                stack.append(i)
            elif t.text in ends:
                while stack and self.tokens[stack[-1]].text != ends[t.text] and t.text == b"}":
                    out[stack.pop()] = i - 1
                if stack and self.tokens[stack[-1]].text == ends[t.text]:
                    out[stack.pop()] = i
        for i in stack:
            out[i] = len(self.tokens) - 1
        return out

    def is_(self, i: int, *texts: bytes) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind != "text"

    # ---- scopes ----

    def scope(self, i: int, stop: int, in_class: bool) -> None:
        """Declarations between two tokens; nested scopes are walked with a stack."""
        work = [(i, stop, in_class)]
        while work:
            i, stop, in_class = work.pop()
            first = i
            while i < stop:
                t = self.tokens[i]
                if t.text in (b";", b"}") and t.kind == "mark":
                    self.calls(first, i, not in_class, top=True)
                    i += 1
                    first = i
                elif t.text == b":" and t.kind == "mark" and in_class and self.is_(i - 1, b"public", b"private", b"protected"):
                    i += 1
                    first = i
                elif t.text == b"template" and self.is_(i + 1, b"<") and self.cpp and i == first:
                    i = self._angle(i + 1)
                    first = i
                    self.comments.pop(i, None)
                elif t.text in (b"(", b"[") and t.kind == "mark":
                    i = self.match.get(i, stop) + 1
                elif t.text == b"{" and t.kind == "mark":
                    close = min(self.match.get(i, stop), stop)
                    head = self.tokens[first:i]
                    words = [x.text for x in head if x.kind == "word"]
                    opened = any(x.text == b"(" for x in head)
                    if words[:1] == [b"namespace"] or words[:2] == [b"inline", b"namespace"] or words == [b"extern"]:
                        work.append((close + 1, stop, in_class))
                        i, stop, first = i + 1, close, i + 1
                        continue
                    if not opened and any(w in _TYPES for w in words) and not any(x.text == b"=" for x in head):
                        if self.cpp and b"enum" not in words:
                            work.append((i + 1, close, True))
                        i = close + 1  # what follows declares variables of the type
                        continue
                    name = self._declarator(first, i)
                    if name is None:
                        self.calls(first, close, True, top=True)
                        i = close + 1
                        if not any(x.text == b"=" for x in head):
                            first = i
                        continue
                    if not in_class and name >= 0:
                        self._define(first, name, i, close)
                    self.calls(i + 1, close, True)
                    i = close + 1
                    first = i
                else:
                    i += 1
            self.calls(first, min(i, stop), not in_class, top=True)

    def _angle(self, i: int) -> int:
        """The number after a template's parameter list."""
        depth = 0
        while i < len(self.tokens):
            t = self.tokens[i].text
            depth += (t == b"<") - (t == b">")
            i += 1
            if not depth or t in (b";", b"{"):
                break
        return i

    def _declarator(self, first: int, brace: int) -> int | None:
        """The number of the defined name before ``( ... ) ... {``; -1 for a function whose name does not count; None for no function."""
        i = first
        while i < brace:
            t = self.tokens[i]
            if t.text == b"=" and t.kind == "mark":
                return None
            if t.text == b"(" and t.kind == "mark":
                close = self.match.get(i, brace)
                if i > first and self.tokens[i - 1].kind == "word" and self.tokens[i - 1].text not in (b"__attribute__", b"__declspec", b"alignas", b"decltype", b"noexcept", b"throw"):
                    return self._counts(first, i - 1, close, brace)
                if i > first and self.is_(i - 1, b">", b"]", b"*", b")"):
                    return -1
                i = close
            elif t.text == b"operator":
                return -1
            i += 1
        return None

    def _counts(self, first: int, name: int, close: int, brace: int) -> int:
        if self.tokens[name].text in NOT_CALLED:
            return -1
        after = self.tokens[close + 1 : brace]
        # between the parameters and the body stand qualifiers, a result type, an initialiser list or old-style parameters
        if after and not self.cpp and after[-1].text != b";" and not any(x.text in _AFTER_LIST for x in after):
            return -1
        if self.cpp and any(x.text == b":" for x in after):
            return -1
        before = name - 1
        if self.is_(before, b"::", b"~"):
            return -1
        stars = 0
        while before >= first and self.is_(before, b"*", b"&", b"const"):
            stars += self.tokens[before].text != b"const"
            before -= 1
        return name if stars <= (0 if self.cpp else 1) else -1

    def _define(self, first: int, name: int, brace: int, close: int) -> None:
        t = self.tokens
        doc = None
        held = self.comments.get(first)
        if held:
            doc = "\n".join(clean_comment(c.text.decode("utf-8", "replace")) for c in held)
        self.rows.append(Row(DEFINITION, "function", t[name].text.decode("utf-8", "replace"), None, t[first].start, t[close].end, t[brace].start, t[close].end, doc))

    # ---- calls ----

    def calls(self, first: int, stop: int, allowed: bool, top: bool = False) -> None:
        """Calls between two tokens. At the top of a scope, only what stands after ``=``, or a macro-like statement of its own, is an expression."""
        if top and not allowed:
            first = next((k + 1 for k in range(first, stop) if self.is_(k, b"=")), stop)
        inside = not top
        for i in range(first, min(stop, len(self.tokens) - 1)):
            t = self.tokens[i]
            if t.text == b"=" and t.kind == "mark":
                inside = True
            if t.kind != "word" or not self.is_(i + 1, b"(") or t.text in NOT_CALLED:
                continue
            if not inside and not (i == first and self.is_(self.match.get(i + 1, -2) + 1, b";", b"}")):
                continue
            if self.is_(i - 1, b".", b"->", b"::", b"->*", b"~") and i > 0:
                continue
            p = self.tokens[i - 1] if i > first else None
            if p is not None and p.kind == "word" and p.text not in BEFORE_CALL:
                continue
            if p is not None and p.text in (b">", b"*", b"&") and p.kind == "mark" and self._declares(first, i):
                continue
            close = self.match.get(i + 1)
            if close is None or self.tokens[close].text != b")":
                continue
            end = t.end if self.cpp else self.tokens[close].end
            self.rows.append(Row(REFERENCE, "function", t.text.decode("utf-8", "replace"), None, t.start, end))

    def _declares(self, first: int, i: int) -> bool:
        """Whether ``Type<...> name(`` or ``Type *name(`` begins a statement: all before the name in it is a type."""
        k = i - 1
        while k >= first and not self.is_(k, b";", b"{", b"}", b"(", b"=", b",", b"return"):
            if self.tokens[k].kind == "text" and not self.tokens[k].text.isdigit():
                return False
            k -= 1
        if k >= first and not self.is_(k, b";", b"{", b"}"):
            return False
        body = self.tokens[k + 1 : i]
        if not body or body[0].kind != "word":
            return False
        if body[-1].text == b">":
            return any(x.text == b"<" for x in body)
        # ``a * f(x);`` alone would discard a product: it is read as a declaration of a pointer
        return all(x.kind == "word" or x.text in (b"*", b"&", b"::") for x in body)


def _extract(content: bytes, cpp: bool) -> list[Row]:
    source = _Source(content, cpp)
    source.scope(0, len(source.tokens), False)
    seen = dict.fromkeys(source.rows)
    return sorted((r for r in seen if r.kind == DEFINITION), key=lambda r: r.start) + sorted((r for r in seen if r.kind == REFERENCE), key=lambda r: (r.start, -r.end))


def extract_c(content: bytes) -> list[Row]:
    return _extract(content, False)


def extract_cpp(content: bytes) -> list[Row]:
    return _extract(content, True)
