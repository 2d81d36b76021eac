"""Markdown as segments under heading paths."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from sparkloom.functions.text import header_level, header_text


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def segments(markdown: Column) -> Column:
    """array<struct<key, content>>: the text below each heading, under the path of headings that leads to it.

    A heading takes the place of those at its level and below on the path. Levels that are left out are not filled, so a
    third-level heading right under a first-level one stands second, and another third-level one goes below it. Blank
    lines count as text, so a heading followed by blank lines alone has an empty segment; one followed by a heading has
    none. Text before any heading has an empty key. The paths are a fold over the headings alone, and a segment's lines
    are a slice, so a long text takes time in proportion."""
    lines = F.transform(F.split(markdown, "\n"), lambda x: F.rtrim(x, F.lit("\r")))

    def heads(lines: Column) -> Column:
        each = F.transform(lines, lambda x, i: F.struct(i.alias("at"), header_level(x).alias("level"), header_text(x).alias("text")))
        return F.filter(each, lambda h: h["level"] > 0)

    def marks(heads: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("path"), F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("key"))).alias("out"))

        def step(s: Column, h: Column) -> Column:
            path = F.concat(F.slice(s["path"], F.lit(1), F.least(F.size(s["path"]), h["level"] - 1)), F.array(h["text"]))
            return _let(path, lambda p: F.struct(p.alias("path"), F.concat(s["out"], F.array(F.struct(h["at"].alias("at"), F.array_join(p, " > ").alias("key")))).alias("out")))

        return F.aggregate(heads, start, step, lambda s: s["out"])

    def cut(lines: Column, marks: Column) -> Column:
        def below(m: Column, k: Column) -> Column:
            end = F.coalesce(F.get(marks, k + 1)["at"], F.size(lines))
            return F.struct(m["key"].alias("key"), F.slice(lines, m["at"] + 2, end - m["at"] - 1).alias("held"))

        own = F.filter(F.transform(marks, below), lambda s: F.size(s["held"]) > 0)
        return F.transform(own, lambda s: F.struct(s["key"].alias("key"), F.trim(F.array_join(s["held"], "\n"), F.lit("\n ")).alias("content")))

    return _let(lines, lambda L: _let(_let(heads(L), marks), lambda M: cut(L, M)))


def explode_segments(docs: DataFrame, markdown: str = "md", *keep: str) -> DataFrame:
    """A row for each segment: the columns kept, pos, key, content."""
    rows = docs.select(*keep, F.posexplode(segments(F.col(markdown))).alias("pos", "s"))
    return rows.select(*keep, "pos", "s.key", "s.content")


def generated(docs: DataFrame, generator: Callable[[dict, str], Iterable[str]], *keep: str, text: str = "md") -> DataFrame:
    """Samples that a caller's generator makes of each document: a table function over the document's other columns (as a dict)
    and its text, joined laterally. The columns kept, pos, sample. The generator goes to the workers with the plan; it may
    give any number of samples, one by one."""

    @udtf
    class Generator:
        @staticmethod
        def analyze(metadata: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(metadata.dataType, StructType) or not isinstance(text.dataType, StringType):
                raise TypeError("a generator takes a struct and a text")
            return AnalyzeResult(StructType([StructField("pos", LongType(), False), StructField("sample", StringType())]))

        def eval(self, metadata: Row, text: str | None) -> Iterator[tuple[int, str]]:
            yield from enumerate(generator(metadata.asDict() if metadata is not None else {}, text or ""))

    others = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.struct(*(F.col(f"`{c}`") for c in others)).alias("_m"), F.col(f"`{text}`").alias("_t"))
    return rows.lateralJoin(Generator(F.col("_m").outer(), F.col("_t").outer())).select(*keep, "pos", "sample")


def samples(found: DataFrame, *keep: str) -> DataFrame:
    """Samples that segments give to an index: motivation, requirements, user stories, and headings of introductions."""
    low, filled = F.lower("key"), F.col("content") != ""
    rules = {
        "motivation": (low.contains("background & motivation") | low.contains("background and motivation")) & filled,
        "requirement": low.contains("requirements"),
        "story": low.contains("scenario analysis / user story"),
        "introduction": low.contains("introduction > background"),
    }
    rule = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    sample = F.trim(F.concat_ws("\n", "key", "content"))
    return found.select(*keep, "pos", F.explode(rule).alias("rule"), sample.alias("sample"))
