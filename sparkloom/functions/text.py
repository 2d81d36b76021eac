"""Text functions as Column expressions, all inside the JVM.

Regular expressions are Java's; classes are Unicode where ``(?U)`` says so. Positions and lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes per token by kind of text, and the limits of a context.
BYTES_PER_TOKEN = {"english": 4.0, "default": 3.3, "code": 2.3, "guaranteed": 2.0, "json": 3.0, "worst": 1.5}
COMMENT_CHARS = 65_536

# Names of what a merge commit's message holds.
MERGE_HINTS = ("merge branch", "merge pull request", "merge remote-tracking branch", "merge with develop", "merge tag")

# Labels of a change that need no review, and of one that does.
KEEP_OUT = ("deletions-only", "whitespace-only", "comments-only", "imports-only", "regions-only", "pure-rename", "typo-fix", "generated-artifact", "project-noise", "config-formatting-only", "snapshots-formatting-only", "license-header-only", "callsite-adaptation-only", "tests-refactor-only")
REVIEW = ("logic-changed", "signature-or-visibility-changed", "control-flow-changed", "concurrency-changed", "error-handling-logging-changed", "security-or-boundary-changed", "data-access-changed", "build-or-runtime-values-changed", "tests-behavior-changed", "bad-rename", "uncertain-keep")

# Parts of a path that mark a test file.
TEST_PARTS = ("/test/", "/tests/", "__tests__/")
TEST_ENDS = ("tests.cs", "test.cs", ".spec.ts", ".spec.tsx", ".test.ts", ".test.tsx", ".spec.js", ".test.js", ".spec.jsx", ".test.jsx")

# How series, numbered headings, addresses and thoughts are written.
SERIES = r"(?i)\b(S[3-6]|Series [3-6]|series_[3-6])\b"
HEADER = r"^(#+)\s+(?:\d+(?:\.\d+)*\.?\s+)?(.*)$"
URL = r"https?://[^\s<>\"'\])}]+"
THINK = r"(?is)<think\b[^>]*>([\s\S]*?)</think>"


def series_of(text: Column) -> Column:
    """Product series that a text names, as S and a digit, each once in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(SERIES), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: F.concat(F.lit("S"), F.right(m, F.lit(1)))))


def has_series(text: Column) -> Column:
    return F.coalesce(text.rlike(SERIES), F.lit(False))


def series_union(title: Column, prefixes: Column, labels: Column, labels_first: bool = False) -> Column:
    """Series named by a title, given as prefixes, or named by labels (null: none): each once, in that order, or with labels
    before prefixes, as requirements and designs have it."""
    none = F.array().cast("array<string>")
    named = F.flatten(F.transform(F.coalesce(labels, none), lambda x: series_of(x)))
    given = F.coalesce(prefixes, none)
    return F.array_distinct(F.concat(F.coalesce(series_of(title), none), *((named, given) if labels_first else (given, named))))


def header_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, HEADER, 1))


def header_text(line: Column) -> Column:
    """A heading's text without its section number."""
    return F.trim(F.regexp_extract(line, HEADER, 2))


def clean_title(title: Column, *parts: str) -> Column:
    """A title without the given parts (in any case) and without dashes, dots and blanks at its end."""
    for p in parts:
        title = F.regexp_replace(title, rf"(?i)\Q{p}\E", "")
    return F.rtrim(F.trim(title), F.lit("- ."))


def safe_file_name(name: Column) -> Column:
    """Runs of characters that file systems forbid become one underscore; no dots at the end; 100 characters at most."""
    clean = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]+', "_")
    return F.left(F.rtrim(F.trim(clean), F.lit(".")), F.lit(100))


def page_id_of(url: Column) -> Column:
    """The number in a page's address, null if it has none."""
    found = F.regexp_extract(url, r"[?&]pageId=(\d+)", 1)
    return F.when(found != "", found)


def _plain(part: Column) -> Column:
    return F.try_url_decode(part)


def space_of(url: Column) -> Column:
    """The space that an address names by parameter, else the last path part but one."""
    named = F.regexp_extract(url, r"[?&]spaceKey=([^&#]*)", 1)
    return F.when(page_id_of(url).isNotNull(), F.lit(None)).when(named != "", _plain(named)).otherwise(_plain(_part(url, -2)))


def title_of(url: Column) -> Column:
    named = F.regexp_extract(url, r"[?&]title=([^&#]*)", 1)
    return F.when(page_id_of(url).isNotNull(), F.lit(None)).when(named != "", _plain(named)).otherwise(_plain(_part(url, -1)))


def _part(url: Column, at: int) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    return F.try_element_at(F.split(path, "/"), F.lit(at))


def title_query(title: Column, space: Column) -> Column:
    """The query string that asks for a page by title and space, whatever escapes the title came with."""
    escape = lambda c: F.replace(F.url_encode(F.try_url_decode(c)), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("title="), escape(title), F.lit("&spaceKey="), escape(space))


def console_url(url: Column) -> Column:
    """Where a build's whole console is, from its address in either layout; null for other addresses."""
    classic = r"^(https?://[^/]+)((?:/[^/]+)*)/job/([^/]+)/(\d+)(?:/.*)?$"
    modern = r"^(https?://[^/]+)/blue/organizations/jenkins/([^/]+)/detail/[^/]+/(\d+)/pipeline/?"
    old = F.concat(F.regexp_extract(url, classic, 1), F.regexp_extract(url, classic, 2), F.lit("/job/"), F.regexp_extract(url, classic, 3), F.lit("/"), F.regexp_extract(url, classic, 4), F.lit("/consoleFull"))
    new = F.concat(F.regexp_extract(url, modern, 1), F.lit("/job/"), F.regexp_extract(url, modern, 2), F.lit("/"), F.regexp_extract(url, modern, 3), F.lit("/consoleFull"))
    return F.when(url.rlike(modern), new).when(url.rlike(classic), old)


def urls_of(text: Column) -> Column:
    """Addresses in a text, without punctuation at their ends, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.rtrim(u, F.lit(".,;:!?")))
    return F.array_distinct(F.filter(found, lambda u: u.rlike(r"^https?://[^/]")))


def wiki_urls_of(text: Column, host: str | Column) -> Column:
    """Addresses in a text that are pages of the wiki on the host."""
    low = F.lower(host if isinstance(host, Column) else F.lit(host))
    return F.filter(urls_of(text), lambda u: F.regexp_extract(F.lower(u), "^https?://([^/:?#]+)", 1) == low)


def issue_keys(text: Column, prefix: str = "ISW") -> Column:
    """Keys of issues in order of appearance, repeats included."""
    return F.regexp_extract_all(text, F.lit(rf"(?i){prefix}-\d+"), F.lit(0))


def cut_between(body: Column, start: str, end: str) -> Column:
    """A body without what stands from the start marker to the end marker (in any case), both included. Without an end
    marker after the start it stays as it is."""
    text = F.coalesce(body, F.lit(""))
    a, b = (F.locate(x.lower(), F.lower(text)) for x in (start, end))
    rest = F.substring(text, b + len(end), F.length(text))
    cut = F.concat(F.substring(text, F.lit(1), a - 1), F.lit("\n\n"), rest)
    return trim_blank(F.when((a > 0) & (b > a), cut).otherwise(text))


def cut_from(body: Column, start: str) -> Column:
    """A body up to the start marker, or all of it."""
    text = F.coalesce(body, F.lit(""))
    a = F.locate(start.lower(), F.lower(text))
    return F.when(trim_blank(text) == "", F.lit("")).when(a > 0, trim_blank(F.substring(text, F.lit(1), a - 1))).otherwise(text)


def trim_blank(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def without_thinking(text: Column) -> Column:
    return trim_blank(F.regexp_replace(text, THINK, ""))


def thinking(text: Column) -> Column:
    """What the think blocks hold, joined by line ends."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(THINK), F.lit(1)), trim_blank), "\n")


def json_slice(text: Column) -> Column:
    """From the first opening brace to the last closing one; null without such a pair."""
    a, b = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((a > 0) & (F.instr(text, "}") > 0) & (b > a), F.substring(text, a, b - a + 1))


def tokens_estimated(text: Column, bytes_per_token: float = 3.3) -> Column:
    if bytes_per_token <= 0:
        raise ValueError("bytes per token must be positive")
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(float(bytes_per_token))).cast("int")


def context_fit(total_bytes: Column, limit: int, bytes_per_token: float = 3.3, least_bytes_per_token: float = 2.0) -> Column:
    """Whether texts of so many bytes fit a context for certain, hardly, or maybe."""
    return F.when(total_bytes <= limit * least_bytes_per_token, "FitGuaranteed").when(total_bytes / F.lit(float(bytes_per_token)) >= limit, "ExceedLikely").otherwise("Ambiguous")


def is_merge(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit(False)
    for hint in MERGE_HINTS:
        out = out | low.contains(hint)
    return F.coalesce(out, F.lit(False))


def file_status(status: Column) -> Column:
    """A file's status by name; any other than the four is an error."""
    known = {"added": "Added", "modified": "Modified", "removed": "Deleted", "renamed": "Renamed"}
    out = F.raise_error(F.concat(F.lit("unknown file status "), F.coalesce(status, F.lit("null"))))
    for k, v in known.items():
        out = F.when(status == k, F.lit(v)).otherwise(out)
    return out


def change_of_sides(before: Column, after: Column) -> Column:
    """Added, deleted or modified by which side of a comparison is empty; deleted if both are."""
    return F.when(F.coalesce(after, F.lit("")) == "", "Deleted").when(F.coalesce(before, F.lit("")) == "", "Added").otherwise("Modified")


def is_test_path(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(False)
    for p in TEST_PARTS:
        out = out | low.contains(p)
    for p in TEST_ENDS:
        out = out | low.endswith(p)
    return out


def classifier_of(path: Column) -> Column:
    """Which classifier takes a file by its extension; null if none does."""
    low = F.lower(path)
    return F.when(low.endswith(".cs"), "csharp").when(low.rlike(r"\.(js|ts|jsx|tsx)$"), "script")


def decide(labels: Column) -> Column:
    """struct(filter, reason) from the labels of a change: whether it needs review, and why.

    Labels are trimmed, in lower case, and cut to 60 characters. A logic change that stands alone beside a rename, a typo
    or an adapted call does not count."""
    norm = F.array_distinct(F.filter(F.transform(labels, lambda x: F.left(F.lower(trim_blank(x)), F.lit(60))), lambda x: x != ""))
    out = F.filter(norm, lambda x: x.isin(*KEEP_OUT))
    keep = F.filter(norm, lambda x: x.isin(*REVIEW))
    light = F.arrays_overlap(out, F.array(F.lit("pure-rename"), F.lit("typo-fix"), F.lit("callsite-adaptation-only")))
    keep = F.when(light & (F.size(keep) == 1) & F.array_contains(keep, "logic-changed"), F.array().cast("array<string>")).otherwise(keep)
    final = (
        F.when((F.size(keep) == 0) & (F.size(out) > 0), out)
        .when((F.size(keep) > 0) & (F.size(out) == 0), keep)
        .when(F.size(keep) > 0, F.concat(F.array(F.lit("mixed-keep")), keep, out))
        .otherwise(F.array(F.lit("uncertain-keep")))
    )
    return F.struct(((F.size(keep) > 0) | (F.size(out) == 0)).alias("filter"), F.array_join(final, ";").alias("reason"))


def no_blanks(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def is_comment(line: Column) -> Column:
    return F.coalesce(F.trim(line).rlike(r"^(//|/\*|\*/)"), F.lit(False))


def is_import(line: Column, script: bool = False) -> Column:
    return F.coalesce(line.rlike(r"^\s*(import|export)\b" if script else r"^\s*using\s+[\w.=]+"), F.lit(False))


def is_region(line: Column) -> Column:
    return F.coalesce(line.rlike(r"^\s*#(region|endregion)\b"), F.lit(False))


def without_prompt(output: Column) -> Column:
    """A debugger's output without the prompt at the beginning of lines."""
    return F.regexp_replace(output, r"(?m)^\d+:\d+> ?", "")


def method_table(output: Column) -> Column:
    """The last word of the first line that names a method table."""
    lines = F.filter(F.split(output, "\r?\n"), lambda x: F.ltrim(x).startswith("MethodTable:"))
    return F.try_element_at(F.split(F.trim(F.get(lines, F.lit(0))), r"\s+"), F.lit(-1))


def questions(content: Column) -> Column:
    """The parts between pipes that are questions."""
    return F.filter(F.transform(F.split(content, r"[|]"), lambda x: F.trim(x)), lambda x: x.endswith("?"))


def last_part(url: Column) -> Column:
    return F.try_element_at(F.split(url, "/"), F.lit(-1))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template with {names} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def without_fence(text: Column) -> Column:
    """Markdown without the fence around it."""
    return trim_blank(F.rtrim(F.regexp_replace(trim_blank(text), r"^```markdown\s*", ""), F.lit("`")))


def chunks(text: Column, size: int, overlap: int = 200) -> Column:
    """Pieces of a text, each so many characters with some of the one before; a text within the size stays whole."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - overlap), F.lit(step))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def relative_path(path: Column, root: Column) -> Column:
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def fahrenheit(celsius: Column) -> Column:
    return F.lit(32) + (celsius / 0.5556).cast("int")


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def seconds_left(reset: Column, now: Column) -> Column:
    """Seconds from now until a limit is reset, none if that is past."""
    return F.greatest(F.lit(0).cast("long"), F.unix_seconds(reset.cast("timestamp")) - F.unix_seconds(now.cast("timestamp")))


def base64_text(content: Column) -> Column:
    """Text from base64 with line breaks in it; nothing for a missing file."""
    return F.coalesce(F.decode(F.unbase64(F.regexp_replace(content, r"[\r\n]", "")), "UTF-8"), F.lit(""))


def has_marker(body: Column, marker: str) -> Column:
    return F.coalesce(F.lower(body).startswith(marker.lower()), F.lit(False))


def is_start_process(body: Column) -> Column:
    return F.coalesce(F.lower(trim_blank(body)) == "start-process", F.lit(False))
