"""Quality rules whose thresholds adapt to each language and source.

Base rules reject texts that no corpus wants. The others compare a few rates of a text with what is usual in its language
and source, among the texts that pass the base rules: a rate may lie above a high quantile, or below a low one, by so many
times that quantile's distance from the median, and no more. No cutoff is fixed; where a distance is smaller than a
sketch tells apart, the sketch's resolution there counts in its place.

The quantiles come from sketches that count values in buckets which keep six leading bits, so quantiles are within 1/32 of
the true ones, sketches merge by adding counts, and neither the order nor the number of parts changes the outcome. A
source's quantiles are drawn towards those of its language as by ``PRIOR`` more texts that are like the language's, and a
language's likewise towards those of all texts: a source of few texts hardly differs from its language, one of many goes
its own way. What makes up less of a source than lies beyond its quantile (a quarter, for symbols) does not move its
thresholds; junk that makes up more passes for what is usual there.

Everything is in built-in functions. Sketches are combined before the shuffle, and the join that brings thresholds back
is one that adaptive execution splits or broadcasts by size, so a source with a third of all texts is as good as many.

Null texts have no words; they and texts of blanks fail the base rules. Very long texts are read whole. A rate at its
threshold passes. A null language or source is a group of its own. Repeated rows count each; where no text passes the
base rules none is kept, and an empty table gives an empty one; columns besides those named are not read, whatever their
names.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.storage import materialize, scratch

BLANKS = " \t\n\x0b\f\r"
GRAM = 8
#: Texts like the language's (or like all) that a group's quantiles are mixed with.
PRIOR = 40
#: Rates, as whole numbers: what they are; the percentage of texts beyond each quantile that bounds them (none for a rate
#: that may be as low as it likes); and how many times its distance from the median a text may lie beyond it.
RATES: dict[str, tuple[str, int | None, int, int]] = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", None, 25, 4),
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 25, 25, 8),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", None, 1, 2),
}
BASE = "(n_words < 20 or 100 * n_repeat_words > 30 * n_words)"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = docs.select("doc_id", "lang", "source", text.alias("text"), words.alias("words"), lines.alias("lines"))
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - (GRAM - 1)), lambda i: F.xxhash64(F.slice("words", i, GRAM)))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > GRAM, windows).alias("windows"),
    )
    # most texts repeat no window, and only the others have theirs sorted
    found = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(found, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.filter("sorted", lambda x, i: ((i > 0) & (F.get("sorted", i - 1)["h"] == x["h"])) | ((i < F.size("sorted") - 1) & (F.get("sorted", i + 1)["h"] == x["h"])))
    rows = rows.withColumn("places", F.when(F.col("sorted").isNotNull(), F.sort_array(F.transform(same, lambda x: x["i"])))).drop("sorted", "windows")
    reach = F.transform("places", lambda p, i: F.least(F.lit(GRAM), F.coalesce(F.get("places", i + 1) - p, F.lit(GRAM))))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("places")


def bucket(value: Column) -> Column:
    """The least value in the sketch's bucket: all but the six leading bits are cleared."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame) -> DataFrame:
    """Counts by language, source, rate and bucket of the texts that pass the base rules, at three levels: of the source (0),
    the language (1), and all (2)."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rate"), bucket(F.expr(e)).alias("bucket")) for n, (e, *_) in RATES.items())))
    own = rows.filter(f"not {BASE}").select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.rate", "x.bucket").agg(F.count("*").alias("n"))
    own = materialize(own, "quality-sketches")
    null = F.lit(None).cast("string")
    lang = own.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", null.alias("source"), "rate", "bucket", "n")
    total = own.groupBy("rate", "bucket").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), null.alias("lang"), null.alias("source"), "rate", "bucket", "n")
    return own.select(F.lit(0).alias("level"), "lang", "source", "rate", "bucket", "n").unionByName(lang).unionByName(total)


def quantiles(sketch: DataFrame) -> DataFrame:
    """level, lang, source, rate, n, and the quantiles low (null if the rate has none), mid and high."""
    group = ["level", "lang", "source", "rate"]
    w = Window.partitionBy(*group)
    upto = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("n", F.sum("n").over(w))
    share = {q: F.coalesce(*(F.when(F.col("rate") == name, F.lit(p)) for name, p in shares.items())) for q, shares in {
        "low": {name: p for name, (_, p, _, _) in RATES.items() if p is not None},
        "mid": dict.fromkeys(RATES, 50),
        "high": {name: 100 - p for name, (_, _, p, _) in RATES.items()},
    }.items()}
    return upto.groupBy(*group, "n").agg(*(F.min(F.when(100 * F.col("upto") >= F.col("n") * p, F.col("bucket"))).alias(q) for q, p in share.items()))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, and low_<rate> and high_<rate>: a source's bounds for each rate."""
    found = materialize(quantiles(sketch), "quality-quantiles")
    names = ["low", "mid", "high"]

    def drawn(own: DataFrame, towards: DataFrame, on: list[str]) -> DataFrame:
        """own's quantiles mixed with those of the groups above, which are joined on the columns."""
        above = towards.select(*(F.col(c).alias(f"{c}_") for c in on), *(F.col(c).alias(f"{c}_") for c in names))
        joined = own.join(above, reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in on)))
        mixed = [F.expr(f"(n * {c} + {PRIOR} * {c}_) div (n + {PRIOR})").alias(c) for c in names]
        return joined.select("lang", "source", "rate", "n", *mixed)

    level = [found.filter(F.col("level") == i).select("lang", "source", "rate", "n", *names) for i in range(3)]
    best = drawn(level[0], drawn(level[1], level[2], ["rate"]), ["lang", "rate"])
    least = "greatest(1, mid div 32)"
    bounds = []
    for name, (_, low, _, times) in RATES.items():
        own = F.col("rate") == name
        if low is not None:
            bounds.append(F.max(F.when(own, F.expr(f"low - {times} * greatest(mid - low, {least})"))).alias(f"low_{name}"))
        bounds.append(F.max(F.when(own, F.expr(f"high + {times} * greatest(high - mid, {least})"))).alias(f"high_{name}"))
    return best.groupBy("lang", "source").agg(*bounds)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows = materialize(measures(docs), "quality-measures")
    with scratch(docs.sparkSession):
        bounds = materialize(thresholds(sketches(rows)), "quality-thresholds", outlive=True)
    bounds = bounds.withColumnsRenamed({"lang": "l", "source": "s"})
    joined = rows.join(bounds, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    inside = F.lit(True)
    for name, (rate, low, _, _) in RATES.items():
        inside &= F.expr(rate) <= F.col(f"high_{name}")
        if low is not None:
            inside &= F.expr(rate) >= F.col(f"low_{name}")
    base = F.expr(BASE)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.coalesce(inside, F.lit(False))).alias("kept"))


#: The same in another engine.
SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM (SELECT DISTINCT doc_id, words FROM d WHERE len(words) >= 8)),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM w),
r AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(j - i, 8))) AS n FROM r GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
v AS (
  SELECT *, (1000 * n_symbols) // greatest(word_chars, 1) AS symbols, (100 * word_chars) // greatest(n_words, 1) AS word_length,
    (1000 * n_dup_lines) // greatest(n_lines, 1) AS dup_lines
  FROM m),
x AS (UNPIVOT (SELECT lang, source, symbols, word_length, dup_lines FROM v WHERE NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words))
      ON symbols, word_length, dup_lines INTO NAME rate VALUE value),
b AS (SELECT lang, source, rate, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bucket FROM x),
s AS (
  SELECT 0 AS level, lang, source, rate, bucket, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, rate, bucket, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, rate, bucket, count(*) FROM b GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS upto,
        sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM s),
p(rate, below, above, times) AS (VALUES ('symbols', NULL, 75, 4), ('word_length', 25, 75, 8), ('dup_lines', NULL, 99, 2)),
q AS (SELECT level, lang, source, rate, times, total::BIGINT AS n, min(bucket) FILTER (100 * upto >= total * below) AS low,
        min(bucket) FILTER (100 * upto >= total * 50) AS mid, min(bucket) FILTER (100 * upto >= total * above) AS high
      FROM u JOIN p USING (rate) GROUP BY ALL),
q1 AS (SELECT a.lang, a.rate, (a.n * a.low + 40 * z.low) // (a.n + 40) AS low, (a.n * a.mid + 40 * z.mid) // (a.n + 40) AS mid,
         (a.n * a.high + 40 * z.high) // (a.n + 40) AS high
       FROM q a JOIN q z ON a.level = 1 AND z.level = 2 AND a.rate = z.rate),
q0 AS (SELECT a.lang, a.source, a.rate, a.times, (a.n * a.low + 40 * z.low) // (a.n + 40) AS low, (a.n * a.mid + 40 * z.mid) // (a.n + 40) AS mid,
         (a.n * a.high + 40 * z.high) // (a.n + 40) AS high
       FROM q a JOIN q1 z ON a.level = 0 AND a.lang IS NOT DISTINCT FROM z.lang AND a.rate = z.rate),
h AS (SELECT lang, source, rate, low - times * greatest(mid - low, 1, mid // 32) AS least, high + times * greatest(high - mid, 1, mid // 32) AS most FROM q0),
t AS (SELECT lang, source, max(most) FILTER (rate = 'symbols') AS symbols, max(most) FILTER (rate = 'word_length') AS longest,
        max(least) FILTER (rate = 'word_length') AS shortest, max(most) FILTER (rate = 'dup_lines') AS dup_lines
      FROM h GROUP BY ALL),
k AS (SELECT v.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, t
      FROM v LEFT JOIN t ON t.lang IS NOT DISTINCT FROM v.lang AND t.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= t.symbols AND word_length BETWEEN t.shortest AND t.longest AND dup_lines <= t.dup_lines, false) AS kept
FROM k
"""
