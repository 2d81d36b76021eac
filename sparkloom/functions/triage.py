"""Whether the change of one file needs review, from evidence in its diff.

Lines are cut into tokens; removed and added lines are paired, and each pair gives evidence that is kept for the pairs
after it. So a file is one ordered fold, and files are independent rows of Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.declarations import declared_lines
from sparkloom.functions.pairing import pairs
from sparkloom.functions.text import KEEP_OUT, REVIEW, TEST_ENDS, TEST_PARTS

# Words of the two languages, and names that tell what a line is about.
CSHARP_WORDS = {
    "abstract", "as", "base", "bool", "break", "byte", "case", "catch", "char", "checked", "class", "const", "continue", "decimal",
    "default", "delegate", "do", "double", "else", "enum", "event", "explicit", "extern", "false", "finally", "fixed", "float", "for",
    "foreach", "goto", "if", "implicit", "in", "int", "interface", "internal", "is", "lock", "long", "namespace", "new", "null", "object",
    "operator", "out", "override", "params", "private", "protected", "public", "readonly", "ref", "return", "sbyte", "sealed", "short",
    "sizeof", "stackalloc", "static", "string", "struct", "switch", "this", "throw", "true", "try", "typeof", "uint", "ulong", "unchecked",
    "unsafe", "ushort", "using", "virtual", "void", "volatile", "while", "async", "await", "record", "var", "dynamic", "when", "nameof",
    "get", "set", "init", "add", "remove",
}
SCRIPT_WORDS = {
    "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "export", "extends", "finally",
    "for", "function", "if", "import", "in", "instanceof", "new", "return", "super", "switch", "this", "throw", "try", "typeof", "var",
    "void", "while", "with", "yield", "let", "enum", "await", "async", "implements", "interface", "package", "private", "protected",
    "public", "null", "true", "false",
}
CONTROL = {
    "if", "else", "for", "foreach", "while", "switch", "case", "default", "return", "throw", "try", "catch", "finally", "using", "await",
    "lock", "yield", "break", "continue",
}
CONCURRENCY = {
    "await", "async", "Task", "Thread", "lock", "Monitor", "Interlocked", "Parallel", "Semaphore", "Channel", "IAsyncEnumerable", "Promise",
    "then", "setTimeout", "setInterval",
}
VISIBILITY = {
    "public", "private", "protected", "internal", "export", "default",
}
ERRORS = {
    "throw", "catch", "finally", "ILogger", "Log", "Console", "Debug",
}
DATA = {
    "Sql", "Db", "DbSet", "ExecuteSql", "SqlCommand", "SaveChanges", "Find", "Add", "Update", "Remove", "fetch", "axios",
}
SECURITY = {
    "Authorize", "Authentication", "Jwt", "Cors", "CORS", "Cookie", "X-Frame-Options", "Content-Security-Policy",
}
CALL_PUNCTUATION = set(".,:=()<>{}[];")
CALL_FORBIDDEN = {
    "await", "throw", "try", "catch", "lock", "using",
}
ACCESSORS = {
    "get", "set", "init", "add", "remove",
}

# Labels in the order in which a reason names them.
LABELS = [
    "generated-artifact", "config-formatting-only", "snapshots-formatting-only", "license-header-only", "project-noise", "deletions-only",
    "whitespace-only", "comments-only", "imports-only", "regions-only", "typo-fix", "pure-rename", "bad-rename", "callsite-adaptation-only",
    "tests-behavior-changed", "tests-refactor-only", "logic-changed", "signature-or-visibility-changed", "control-flow-changed",
    "concurrency-changed", "error-handling-logging-changed", "data-access-changed", "security-or-boundary-changed",
    "build-or-runtime-values-changed", "uncertain-keep",
]

# Patterns of tokens, hunk headers and assertions.
NUMBER = r"\b(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+\-]?\d+)?)\b"
STRING = r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\''
PUNCTUATION = r"[~!%^&*()\-+={}\[\]|:;,<>?./\\]"
HEADER = re.compile(r"@@\s+-\d+(?:,\d+)?\s+\+\d+(?:,\d+)?\s+@@")
ASSERTION = re.compile(r"\bAssert\.|\b(?:expect|assert)\b")


@dataclass(frozen=True)
class Token:
    kind: str  # id, word, lit, punct, other
    text: str


@dataclass(frozen=True)
class Language:
    words: frozenset[str]
    pattern: re.Pattern
    imports: re.Pattern

    def tokens(self, line: str) -> list[Token]:
        """Comments go first, so a string with two slashes in it ends there."""
        line = re.sub(r"(?s)/\*.*?\*/", "", re.sub(r"(?m)//.*?$", "", line or ""))
        out = []
        for m in self.pattern.finditer(line):
            kind, text = m.lastgroup, m[0]
            if kind == "id" and text in self.words:
                kind = "word"
            out.append(Token("lit", f"<{kind}>") if kind in ("str", "num") else Token(kind, text))
        return out


def language(words: Iterable[str], extra_string: str, name: str, imports: str) -> Language:
    """A language by its words, strings besides those in quotes (a pattern that begins with |), names, and import lines."""
    pattern = rf"(?P<str>{STRING}{extra_string})|(?P<num>{NUMBER})|(?P<id>{name})|(?P<punct>{PUNCTUATION})|(?P<other>\S)"
    return Language(frozenset(words), re.compile(pattern), re.compile(imports))


CSHARP = language(CSHARP_WORDS, "", r"\b[_A-Za-z]\w*\b", r"\s*using\s+[\w.=]+")
SCRIPT = language(SCRIPT_WORDS, r"|`(?:\\.|[^`\\])*`", r"\b[$_A-Za-z][$\w]*\b", r"\s*(?:import|export)\b")


def groups(diff: str | None) -> Iterator[tuple[list[str], list[str]]]:
    """Removed and added lines that stand together; a header or a line of context ends a group."""
    removed: list[str] = []
    added: list[str] = []
    for raw in re.split(r"\r?\n", diff or ""):
        if raw.startswith(("--- ", "+++ ")) or not raw:
            continue
        if raw[0] in "+-" and not HEADER.match(raw):
            (removed if raw[0] == "-" else added).append(raw[1:])
        elif removed or added:
            yield removed, added
            removed, added = [], []
    if removed or added:
        yield removed, added


def texts(tokens: list[Token], kind: str) -> list[str]:
    return [t.text for t in tokens if t.kind == kind]


def shape(tokens: list[Token]) -> list[str]:
    """Tokens with names and literals made alike."""
    return [{"id": "ID", "lit": "LIT"}.get(t.kind, f"{t.kind}:{t.text}") for t in tokens if t.kind != "other"]


def is_call(tokens: list[Token]) -> bool:
    return any(a.kind == "id" and b == Token("punct", "(") for a, b in zip(tokens, tokens[1:], strict=False)) or Token("word", "new") in tokens


def call_part(tokens: list[Token]) -> list[Token]:
    """The parentheses of the first call or construction, or all tokens if there is no whole one."""
    for i, t in enumerate(tokens[:-1]):
        new = t == Token("word", "new")
        if not new and not (t.kind == "id" and tokens[i + 1] == Token("punct", "(")):
            continue
        begin = next((j for j in range(i + 1, len(tokens)) if tokens[j] == Token("punct", "(")), None)
        if begin is None:
            break
        depth = 0
        for k in range(begin, len(tokens)):
            depth += {"(": 1, ")": -1}.get(tokens[k].text, 0) if tokens[k].kind == "punct" else 0
            if depth == 0:
                return tokens[begin : k + 1]
        break
    return tokens


def nesting(tokens: list[Token]) -> int:
    depth = most = 0
    for t in texts(tokens, "punct"):
        depth = depth + 1 if t == "(" else max(0, depth - 1) if t == ")" else depth
        most = max(most, depth)
    return most


def only_adapts_call(old: list[Token], new: list[Token]) -> bool:
    old, new = call_part(old), call_part(new)
    for t in [*old, *new]:
        fine = t.kind in ("id", "lit") or (t.kind == "word" and t.text in ("null", "default", "new")) or (t.kind == "punct" and t.text in CALL_PUNCTUATION)
        if not fine or (t.kind == "word" and t.text in CALL_FORBIDDEN):
            return False
    return nesting(new) <= nesting(old)


def is_declaration(tokens: list[Token]) -> bool:
    words, marks = set(texts(tokens, "word")), set(texts(tokens, "punct"))
    accessor = {"{", "}"} <= marks and bool(words & ACCESSORS)
    return accessor or (bool(words & {"public", "private", "protected", "internal", "export", "function"}) and bool(marks & {"(", ")"}))


def parameters(tokens: list[Token]) -> list[str]:
    """Names at the first level of the parentheses, up to where they close."""
    out, depth = [], 0
    for t in tokens:
        if t == Token("punct", "("):
            depth += 1
        elif t == Token("punct", ")"):
            if depth == 1:
                break
            depth = max(0, depth - 1)
        elif depth == 1 and t.kind == "id":
            out.append(t.text)
    return out


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@dataclass
class Evidence:
    language: Language
    is_test: bool
    only: set[str] = field(default_factory=lambda: {"whitespace-only", "comments-only", "imports-only", "regions-only"})
    found: set[str] = field(default_factory=set)
    literal: bool = False
    operator: bool = False
    renames: dict[str, str] = field(default_factory=dict)
    renamed: bool = False
    consistent: bool = True
    typo: bool = False
    new_names: set[str] = field(default_factory=set)
    adapted: bool = False
    other_call: bool = False

    def line(self, text: str) -> None:
        if not re.match(r"(//|/\*|\*/)", text.strip()):
            self.only.discard("comments-only")
        if not self.language.imports.match(text):
            self.only.discard("imports-only")
        if not re.match(r"\s*#(region|endregion)\b", text):
            self.only.discard("regions-only")

    def pair(self, old: str, new: str) -> None:
        a, b = self.language.tokens(old), self.language.tokens(new)
        if re.sub(r"\s+", "", old) != re.sub(r"\s+", "", new):
            self.only.discard("whitespace-only")
        call = is_call(a) or is_call(b)
        adapts = call and only_adapts_call(a, b)
        self.adapted |= adapts
        self.other_call |= call and not adapts
        self.rename(texts(a, "id"), texts(b, "id"))
        if adapts:
            return
        if not call and (is_declaration(a) or is_declaration(b)):
            self.declaration(a, b)
        if shape(a) != shape(b):
            self.meaning(a, b)
        if (ASSERTION.search(old) or ASSERTION.search(new)) and (self.literal or self.operator):
            self.found.add("tests-behavior-changed")

    def rename(self, old: list[str], new: list[str]) -> None:
        """Names are paired by place. Any pair counts as a rename seen, even of a name with itself."""
        for x, y in zip(old, new, strict=False):
            self.renamed = True
            if x != y and self.renames.setdefault(x, y) != y:
                self.consistent = False
        if len(self.renames) == 1 and old and new:
            self.typo |= distance(*next(iter(self.renames.items()))) <= 2

    def declaration(self, a: list[Token], b: list[Token]) -> None:
        paren = Token("punct", "(")
        if paren in a or paren in b:
            before, after = parameters(a), parameters(b)
            self.new_names |= set(after) - set(before)
            changed = before != after
        else:
            changed = shape(a) != shape(b)
        if changed:
            self.found.add("signature-or-visibility-changed")

    def meaning(self, a: list[Token], b: list[Token]) -> None:
        words = texts(a, "word") != texts(b, "word")
        marks = texts(a, "punct") != texts(b, "punct")
        self.literal |= len(texts(a, "lit")) != len(texts(b, "lit"))
        self.operator |= words or marks
        keys, all_ = {*texts(a, "word"), *texts(b, "word")}, {t.text for t in [*a, *b]}
        rules = (
            ("control-flow-changed", words and keys & CONTROL),
            ("concurrency-changed", words and (keys & CONCURRENCY or all_ & {"Task", "await", "async"})),
            ("signature-or-visibility-changed", words and keys & VISIBILITY),
            ("error-handling-logging-changed", (words or marks) and all_ & ERRORS),
            ("data-access-changed", (words or marks or self.literal) and all_ & DATA),
            ("security-or-boundary-changed", (words or marks or self.literal) and all_ & SECURITY),
            ("build-or-runtime-values-changed", self.literal),
        )
        self.found |= {label for label, holds in rules if holds}

    def labels(self) -> set[str]:
        out = self.only | self.found
        control = "control-flow-changed" in self.found
        if self.renamed and not self.consistent:
            out.add("bad-rename")
        elif self.renamed and not (self.operator or self.literal or control):
            out.add("typo-fix" if self.typo else "pure-rename")
        if self.adapted and not (self.other_call or self.literal or control):
            out.add("callsite-adaptation-only")
        if self.is_test and "tests-behavior-changed" not in self.found:
            out.add("tests-refactor-only")
        if self.operator or self.literal:
            out.add("logic-changed")
        return out


@dataclass(frozen=True)
class FileKind:
    """Files that a classifier takes: their endings, how their lines are cut into tokens, and labels that a path gives, each by
    a pattern (which Python and Java read alike)."""

    ends: tuple[str, ...]
    language: Language
    marks: tuple[tuple[str, str], ...] = ()


#: The kinds of files known; callers may give others beside them, which come first.
KINDS = (
    FileKind((".cs",), CSHARP, (("generated-artifact", r"(\.designer|\.g|\.generated)\.cs$|/obj/|/bin/"), ("project-noise", r"/\.github/"))),
    FileKind((".js", ".ts", ".jsx", ".tsx"), SCRIPT, (("generated-artifact", r"\.min\.js$"), ("config-formatting-only", r"webpack\.config\.js$"), ("project-noise", r"/\.github/"))),
)


def noise(path: str, kinds: tuple[FileKind, ...] = KINDS) -> tuple[Language, set[str]] | None:
    """The language of a file by its ending, and labels that its path gives; nothing for other files."""
    for kind in kinds:
        if path.endswith(kind.ends):
            return kind.language, {label for label, pattern in kind.marks if re.search(pattern, path)}
    return None


def path_labels(path: Column, kinds: tuple[FileKind, ...] = KINDS) -> Column:
    """The labels that a path gives (in any case, with either slash), without a worker: an array, null for files of no kind."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(None).cast("array<string>")
    for kind in reversed(kinds):
        labels = F.array_compact(F.array(*(F.when(low.rlike(pattern), F.lit(label)) for label, pattern in kind.marks))) if kind.marks else F.array().cast("array<string>")
        out = F.when(low.rlike("(" + "|".join(re.escape(e) for e in kind.ends) + ")$"), labels).otherwise(out)
    return out


def decide(labels: set[str]) -> tuple[bool, str]:
    """As text.decide, with labels in their fixed order."""
    out, keep = ([x for x in LABELS if x in labels and x in known] for known in (KEEP_OUT, REVIEW))
    if keep == ["logic-changed"] and {"pure-rename", "typo-fix", "callsite-adaptation-only"} & set(out):
        keep = []
    if keep and out:
        return True, ";".join(["mixed-keep", *keep, *out])
    return (True, ";".join(keep)) if keep else (False, ";".join(out)) if out else (True, "uncertain-keep")


def classify(path: str | None, diff: str | None, kinds: tuple[FileKind, ...] = KINDS) -> tuple[bool, str] | None:
    """Whether to review, and why; nothing for files that no classifier takes."""
    low = (path or "").replace("\\", "/").lower()
    known = noise(low, kinds)
    if known is None:
        return None
    language, labels = known
    evidence = Evidence(language, any(p in low for p in TEST_PARTS) or low.endswith(TEST_ENDS))
    changes = list(groups(diff))
    if not changes:
        return decide(labels | {"whitespace-only"})
    if not any(new for _, new in changes):
        labels |= {"deletions-only"}
    for old, new in changes:
        for line in [*old, *new]:
            evidence.line(line)
        for a, b in pairs(old, new):
            evidence.pair(a, b)
    return decide((labels | evidence.labels()) or {"uncertain-keep"})


def triage(path: Column, diff: Column, others: tuple[FileKind, ...] = ()) -> Column:
    """struct(filter, reason), null fields for files that no classifier takes. others: kinds of files besides those known."""
    kinds = (*others, *KINDS)

    @F.pandas_udf("struct<filter:boolean,reason:string>")
    def run(paths: pd.Series, diffs: pd.Series) -> pd.DataFrame:
        found = [classify(p, d, kinds) or (None, None) for p, d in zip(paths, diffs, strict=True)]
        return pd.DataFrame({"filter": pd.array([f[0] for f in found], "boolean"), "reason": [f[1] for f in found]})

    return run(path, diff)


def name_distance(a: Column, b: Column) -> Column:
    """distance() of two names."""

    @F.pandas_udf("long")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(left, right, strict=True)], dtype="Int64")

    return run(a, b)


def tokens_of(line: Column, script: bool = False) -> Column:
    language = SCRIPT if script else CSHARP

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: [{"kind": t.kind, "text": t.text} for t in language.tokens(x or "")])

    return run(line)


def declarations(source: str | None) -> dict[int, str]:
    """Lines (from 0) on which a type, method, constructor or operator is declared, with their text up to the body."""
    return {line: text.strip().rstrip("{").strip() for line, text in declared_lines(source).items()}
