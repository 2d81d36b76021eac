"""Lines of C# sources on which types, methods, constructors and operators are declared.

A scan over a file's tokens with a stack of brackets: comments, strings (verbatim, interpolated, raw) and directives are
passed over, and between the members of a type or namespace each run of tokens up to its body, semicolon or value is read as
a declaration: attributes, modifiers, then a type word or a return type, a name, type parameters and a parenthesis. Line
breaks mean nothing, so a declaration over several lines is found; it counts by the line of its first modifier, or of its
type word, return type or constructor name. Bodies are passed over as a whole, so calls and local functions are none.
Enumerations, delegates, properties, events and fields are none either.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the language.
MODIFIERS = frozenset({
    "public", "private", "protected", "internal", "static", "sealed", "abstract", "virtual", "override", "async", "partial", "readonly",
    "extern", "unsafe", "new", "file", "required", "const", "volatile",
})
TYPES = frozenset({
    "class", "struct", "interface",
})
#: Words that no return type or method name is.
OTHERS = frozenset({
    "return", "throw", "if", "for", "while", "switch", "lock", "catch", "foreach", "using", "fixed", "goto", "yield", "await", "case",
    "default", "do", "else", "try", "finally", "break", "continue", "checked", "unchecked", "this", "base", "typeof", "event", "delegate",
    "enum", "namespace", "in", "out", "is", "as", "get", "set", "init", "add", "remove",
})

TOKEN = re.compile(
    r"""(?P<blank>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|(?<![^\n])[ \t]*\#[^\n]*)
    |(?P<raw>\$*"{3,})|(?P<open>(?:\$@|@\$|\$)")|(?P<string>@"(?:[^"]|"")*(?:"|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z))|(?P<char>'(?:\\.|[^'\\\n])+'?)
    |(?P<name>@?[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>=>|==|::|.)""",
    re.S | re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int


def _interpolated(source: str, at: int, verbatim: bool) -> int:
    """Where an interpolated string ends that is open at this place; its holes may hold strings."""
    depth = 0
    while at < len(source):
        c = source[at]
        if depth and c in "\"'":
            m = TOKEN.match(source, at)
            at = m.end()
            continue
        if c == "{" or c == "}":
            if not depth and source[at + 1 : at + 2] == c:
                at += 1
            else:
                depth = max(0, depth + (1 if c == "{" else -1))
        elif not depth and c == '"':
            if not verbatim or source[at + 1 : at + 2] != '"':
                return at + 1
            at += 1
        elif not depth and c == "\\" and not verbatim:
            at += 1
        elif c == "\n" and not verbatim and not depth:
            return at
        at += 1
    return at


def tokens(source: str) -> list[Token]:
    out, at, line = [], 0, 0
    while at < len(source):
        m = TOKEN.match(source, at)
        kind, end = m.lastgroup, m.end()
        if kind == "raw":
            quotes = m[0].lstrip("$")
            close = source.find(quotes, end)
            end = len(source) if close < 0 else close + len(quotes)
            while source[end : end + 1] == '"':
                end += 1
        elif kind == "open":
            end = _interpolated(source, end, "@" in m[0])
        if kind != "blank":
            out.append(Token("name" if kind == "name" else "mark" if kind == "mark" else "value", m[0], line))
        line += source.count("\n", at, end)
        at = end
    return out


def _closing(run: list[Token], i: int, opening: str, closing: str) -> int:
    """The place behind the bracket that closes the one here; behind all if none does."""
    depth = 0
    for k in range(i, len(run)):
        depth += (run[k].text == opening) - (run[k].text == closing)
        if depth == 0:
            return k + 1
    return len(run)


def _named(run: list[Token], i: int) -> int:
    """The place behind a dotted name with type arguments; here if there is none."""
    at = i
    while at < len(run) and run[at].kind == "name" and run[at].text not in OTHERS:
        at += 1
        if at < len(run) and run[at].text == "<":
            at = _closing(run, at, "<", ">")
        if at < len(run) and run[at].text in (".", "::"):
            at += 1
            continue
        return at
    return i


def _typed(run: list[Token], i: int) -> int:
    """The place behind a type; here if there is none."""
    while i < len(run) and run[i].text in ("ref", "readonly", "scoped"):
        i += 1
    at = _closing(run, i, "(", ")") if i < len(run) and run[i].text == "(" else _named(run, i)
    while at > i and at < len(run) and run[at].text in ("?", "*", "["):
        at = _closing(run, at, "[", "]") if run[at].text == "[" else at + 1
    return at


def _declared(run: list[Token], inside: str | None) -> tuple[Token | None, str | None]:
    """The token that a declaration counts by, and the name of the type if it is one. inside: the enclosing type's name, none
    for namespaces."""
    i = 0
    while i < len(run) and run[i].text == "[":
        i = _closing(run, i, "[", "]")
    first = i
    while i < len(run) and run[i].text in MODIFIERS:
        i += 1
    if i == len(run):
        return None, None
    word = run[i].text
    if word == "ref" and i + 1 < len(run) and run[i + 1].text == "struct":
        i, word = i + 1, "struct"
    follows = run[i + 1].text if i + 1 < len(run) else ""
    if word == "record" and i + 1 < len(run) and run[i + 1].kind == "name" and (follows in TYPES or i + 2 == len(run) or run[i + 2].text in ("(", "<", ":", "where")):
        name = run[i + 2] if follows in TYPES and i + 2 < len(run) else run[i + 1]
        return run[first], name.text
    if word in TYPES and i + 1 < len(run) and run[i + 1].kind == "name":
        return run[first], follows
    if inside is None or word in OTHERS:
        return None, None
    if any(t.text == "operator" for t in run[i:]):
        return run[first], None
    if run[i].text == inside and follows == "(":
        return run[first], None
    name = _typed(run, i)
    behind = _named(run, name) if name > i else name
    return (run[first], None) if behind > name and behind < len(run) and run[behind].text == "(" else (None, None)


def declared_lines(source: str | None) -> dict[int, str]:
    """Numbers (from 0) of lines on which a declaration begins, and the whole lines. The first of a line counts."""
    source = source or ""
    lines = re.split(r"\r\n|[\r\n]", source)
    source = "\n".join(lines)
    out: dict[int, str] = {}
    #: of each open brace: whether members stand in it, and the type's name if it is one
    stack: list[tuple[bool, str | None]] = [(True, None)]
    run: list[Token] = []
    depth, valued = 0, False  # open parentheses and brackets, and whether a value is being passed over
    for t in tokens(source):
        members, inside = stack[-1]
        if not members:
            if t.text in ("{", "}") and t.kind == "mark":
                stack.append((False, None)) if t.text == "{" else stack.pop()
            continue
        mark = t.text if t.kind == "mark" else ""
        if mark in ("(", "["):
            depth += 1
        elif mark in (")", "]"):
            depth = max(0, depth - 1)
        if depth == 0 and mark in ("{", ";", "=>", "=") and not valued:
            begin, name = _declared(run, inside)
            if begin:
                out.setdefault(begin.line, lines[begin.line])
            space = any(x.text == "namespace" for x in run[:1])
            if mark == "{":
                stack.append((True, name if name else None) if name or space else (False, None))
            valued = mark in ("=>", "=")
            run = []
        elif mark == "{":
            stack.append((False, None))
        elif mark == "}" and depth == 0 and not valued:
            run = []
            if len(stack) > 1:
                stack.pop()
        elif mark == ";" and depth == 0:
            run, valued = [], False
        elif not valued:
            run.append(t)
    return out


def declarations(source: Column) -> Column:
    """array<struct<line,declaration>> of a C# source, in order of lines."""

    @F.pandas_udf("array<struct<line:long,declaration:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"line": k, "declaration": v} for k, v in sorted(declared_lines(t).items())] for t in texts], dtype=object)

    return run(source)
