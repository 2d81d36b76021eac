"""Typed diff lines: numbers, blocks, rendering, and resolution of line numbers.

A line has the columns file, pos (0, 1, ... within the file), type (U, I, D for unchanged, inserted, deleted) and text.
Every window is within a file, so files spread over tasks and no order over all lines is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in(file: str) -> tuple:
    w = Window.partitionBy(file).orderBy("pos")
    return w, w.rowsBetween(Window.unboundedPreceding, -1)


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def numbers(lines: DataFrame, file: str = "file") -> DataFrame:
    """With source_index and target_index: how many lines of either side stand before."""
    _, before = _in(file)
    old, new = F.col("type").isin("U", "D"), F.col("type").isin("U", "I")
    return lines.withColumn("source_index", F.coalesce(_count(old).over(before), F.lit(0))).withColumn("target_index", F.coalesce(_count(new).over(before), F.lit(0)))


def block_ids(lines: DataFrame, before: int = 3, after: int = 3, file: str = "file") -> DataFrame:
    """With block: the number of the run of lines that are, or are not, near a change.

    A line is near if a changed one lies from ``before`` lines above to ``after - 1`` below; a change on the last line of
    the file is not looked at. With both 0 only a line's own type counts."""
    w, _ = _in(file)
    changed = F.col("type") != "U"
    if before == after == 0:
        near = changed.cast("int")
    else:
        last = F.lead("pos").over(w).isNull()
        seen = lines.withColumn("_c", (changed & ~last).cast("int"))
        lines, near = seen, F.max("_c").over(w.rowsBetween(-before, after - 1)) if after - 1 >= -before else F.lit(0)
    out = lines.withColumn("_near", F.coalesce(near, F.lit(0)))
    turn = F.coalesce((F.col("_near") != F.lag("_near").over(w)).cast("long"), F.lit(0))
    out = out.withColumn("_turn", turn).withColumn("block", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_c", "_near", "_turn")


def hunks(lines: DataFrame, before: int = 3, after: int = 3, file: str = "file") -> DataFrame:
    """A row for each block: its header (hunk), whether it holds a change, line counts of both sides, and its text with
    markers, trimmed. A first line's marker that is a blank goes with the trimming."""
    marked = F.concat(F.when(F.col("type") == "I", "+").when(F.col("type") == "D", "-").otherwise(" "), F.col("text"))
    numbered = numbers(block_ids(lines, before, after, file), file).withColumn("_m", marked)
    out = numbered.groupBy(file, "block").agg(
        F.min("source_index").alias("source_start"),
        F.min("target_index").alias("target_start"),
        _count(F.col("type").isin("U", "D")).alias("source_count"),
        _count(F.col("type").isin("U", "I")).alias("target_count"),
        F.bool_or(F.col("type") != "U").alias("is_modification"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_m"))), lambda x: x["_m"]), "\n").alias("_t"),
    )
    head = F.format_string("@@ -%d,%d +%d,%d @@", F.col("source_start") + 1, "source_count", F.col("target_start") + 1, "target_count")
    return out.select(file, "block", head.alias("hunk"), "is_modification", "source_count", "target_count", F.btrim("_t", F.lit(" \t\r\n")).alias("diff"))


def with_context(blocks: DataFrame, declarations: DataFrame, file: str = "file") -> DataFrame:
    """Blocks (with start) and the last declaration (file, line, declaration) at or before their start; nothing for a
    file's last block. An as-of join by one sort of both sides."""
    w = Window.partitionBy(file).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = blocks.withColumn("_at", F.col("start")).withColumn("_kind", F.lit(1)).withColumn("_d", F.lit(None).cast("string")).unionByName(
        declarations.select(file, F.col("line").alias("_at"), F.lit(0).alias("_kind"), F.col("declaration").alias("_d")), allowMissingColumns=True
    )
    found = both.withColumn("context", F.last("_d", ignorenulls=True).over(w)).filter("_kind = 1")
    last = F.lead("block").over(Window.partitionBy(file).orderBy("block")).isNull()
    return found.withColumn("context", F.when(last, "").otherwise(F.coalesce("context", F.lit("")))).drop("_at", "_kind", "_d")


def skipped(lines: DataFrame, before: int = 5, after: int = 5, file: str = "file") -> DataFrame:
    """Lines as shown with long unchanged runs cut: a file's first run keeps its last lines, its last run its first, and
    others both ends. A row with kind skip stands where lines were left out, and says how many."""
    w, _ = _in(file)
    unchanged = (F.col("type") == "U").cast("int")
    runs = lines.withColumn("_u", unchanged)
    runs = runs.withColumn("_turn", F.coalesce((F.col("_u") != F.lag("_u").over(w)).cast("long"), F.lit(0)))
    runs = runs.withColumn("run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of_run, of_file = Window.partitionBy(file, "run"), Window.partitionBy(file)
    runs = runs.withColumn("_i", F.row_number().over(of_run.orderBy("pos"))).withColumn("_n", F.count("*").over(of_run)).withColumn("_last", F.max("run").over(of_file))
    head, tail = F.col("_i") <= after, F.col("_i") > F.col("_n") - before
    middle = (F.col("_n") <= before + after) | head | tail
    keep = F.when(F.col("_u") == 0, True).when(F.col("run") == 0, tail).when(F.col("run") == F.col("_last"), head).otherwise(middle)
    runs = runs.withColumn("_keep", keep)
    shown = runs.filter("_keep").select(file, "pos", F.lit("line").alias("kind"), "type", "text", F.lit(0).cast("long").alias("n_skipped"))
    left_out = runs.filter("not _keep").groupBy(file, "run").agg(F.min("pos").alias("pos"), F.count("*").alias("n_skipped"))
    marks = left_out.select(file, "pos", F.lit("skip").alias("kind"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("text"), "n_skipped")
    return shown.unionByName(marks)


HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def resolve(lines: DataFrame, file: str = "file") -> DataFrame:
    """Raw lines of a unified diff (file, pos, raw) with kind (header, deletion, line) and their line number.

    Numbers start from a header's second start and grow with every line but deletions, before they are reported: the
    first line of a hunk has its start plus 1. A header has none, nor deletions right after it; other deletions have the
    number reached. Without a header numbers count from 1."""
    w = Window.partitionBy(file).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.regexp_extract("raw", HUNK, 1)
    out = lines.withColumn("_s", F.when(start != "", start.cast("long"))).withColumn("_g", F.count("_s").over(w))
    own = Window.partitionBy(file, "_g").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(F.col("_s").isNotNull(), "header").when(F.col("raw").startswith("-"), "deletion").otherwise("line")
    out = out.withColumn("kind", kind).withColumn("_b", F.max("_s").over(own)).withColumn("_i", _count(F.col("kind") == "line").over(own))
    number = F.when((F.col("kind") == "header") | (F.col("_i") == 0), None).otherwise(F.coalesce("_b", F.lit(0)) + F.col("_i"))
    return out.withColumn("line", number.cast("long")).drop("_s", "_g", "_b", "_i")


def resolve_markers(lines: DataFrame, file: str = "file") -> DataFrame:
    """Lines with markers ([L12] +code) and the line number of each marker: here numbers are reported before they grow,
    so a hunk's first line has its start. Deletions have none. Lines before the first hunk are left out."""
    w = Window.partitionBy(file).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.regexp_extract("raw", HUNK, 1)
    out = lines.withColumn("_s", F.when(start != "", start.cast("long"))).withColumn("_g", F.count("_s").over(w)).filter("_g > 0")
    marker = F.regexp_extract("raw", r"^\[L(\d+)\]", 1)
    deleted = F.regexp_extract("raw", r"^\[L\d+\] ([-+ ]?)", 1) == "-"
    own = Window.partitionBy(file, "_g").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("marker", F.when(marker != "", marker.cast("long"))).withColumn("_grow", F.col("marker").isNotNull() & ~deleted)
    out = out.withColumn("_b", F.max("_s").over(Window.partitionBy(file, "_g"))).withColumn("_i", F.coalesce(_count(F.col("_grow")).over(own), F.lit(0)))
    bad = F.col("_s").isNull() & F.col("marker").isNull()
    return out.withColumn("line", F.when(F.col("_grow"), F.col("_b") + F.col("_i"))).withColumn("error", bad).filter("_s is null").drop("_s", "_g", "_b", "_i", "_grow")


def place_comments(comments: DataFrame, marked: DataFrame, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """Comments at markers with their lines, and those that are at no line."""
    at = marked.filter("line is not null").select(file, "marker", "line")
    return comments.join(at, [file, "marker"]), comments.join(at, [file, "marker"], "left_anti")


def neighbours(lines: DataFrame, comments: DataFrame, reach: int = 3, file: str = "file") -> DataFrame:
    """Lines (file, line, text) within reach of a comment (file, at), on either side only as far as no number is missing."""
    w = Window.partitionBy(file).orderBy("line")
    islands = lines.withColumn("_i", F.col("line") - F.row_number().over(w))
    own = islands.select(file, F.col("line").alias("at"), F.col("_i").alias("_own"))
    near = comments.join(own, [file, "at"]).withColumn("line", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)))
    return near.join(islands, [file, "line"]).filter("_i = _own").select(file, "at", "line", "text")
