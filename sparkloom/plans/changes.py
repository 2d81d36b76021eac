"""Queries on diffs: line numbers, blocks, rendering, resolution, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import declarations, html, pairing, triage
from sparkloom.operators import diff, segments
from sparkloom.plans.registry import query
from sparkloom.session import table

#: A document's lines as typed diff lines, by a rule on their numbers.
_RULE = "CASE (doc_id * 31 + pos * 7) % 11 WHEN 0 THEN 'I' WHEN 1 THEN 'D' ELSE 'U' END"
_LINES = f"""l AS (SELECT doc_id, pos, text, {_RULE} AS type FROM (
  SELECT doc_id, unnest(range(0, len(t)))::INTEGER AS pos, unnest(t) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))"""
_NUMBERED = """n AS (SELECT *, coalesce(sum(CASE WHEN type IN ('U', 'D') THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS source_index,
  coalesce(sum(CASE WHEN type IN ('U', 'I') THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS target_index
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_BLOCKS = """c AS (SELECT *, CASE WHEN type <> 'U' AND lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL THEN 1 ELSE 0 END AS c FROM n),
  m AS (SELECT *, max(c) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS near FROM c),
  t AS (SELECT *, CASE WHEN near <> lag(near) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS turn FROM m),
  b AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS block FROM t)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.withColumn("type", F.expr(_RULE))


@query(f"WITH {_LINES}, {_NUMBERED} SELECT doc_id, pos, type, source_index, target_index FROM n")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.numbers(_lines(spark, sf_dir), "doc_id").select("doc_id", "pos", "type", "source_index", "target_index")


@query(f"WITH {_LINES}, {_NUMBERED}, {_BLOCKS} SELECT doc_id, pos, type, block FROM b")
def diff_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.block_ids(_lines(spark, sf_dir), file="doc_id").select("doc_id", "pos", "type", "block")


@query(
    f"""WITH {_LINES}, {_NUMBERED}, {_BLOCKS} SELECT doc_id, block,
    format('@@ -{{}},{{}} +{{}},{{}} @@', min(source_index) + 1, count(*) FILTER (type IN ('U', 'D')), min(target_index) + 1, count(*) FILTER (type IN ('U', 'I'))) AS hunk,
    bool_or(type <> 'U') AS is_modification, count(*) FILTER (type IN ('U', 'D'))::BIGINT AS source_count, count(*) FILTER (type IN ('U', 'I'))::BIGINT AS target_count,
    trim(string_agg(CASE type WHEN 'I' THEN '+' WHEN 'D' THEN '-' ELSE ' ' END || text, chr(10) ORDER BY pos), chr(32) || chr(9) || chr(10) || chr(13)) AS diff
    FROM b GROUP BY doc_id, block"""
)
def hunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.hunks(_lines(spark, sf_dir), file="doc_id")


@query(
    f"""WITH {_LINES}, {_NUMBERED}, t AS (SELECT *, (type <> 'U')::INT AS near FROM n),
    u AS (SELECT *, CASE WHEN near <> lag(near) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS turn FROM t)
    SELECT doc_id, pos, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS block FROM u"""
)
def diff_blocks_without_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.block_ids(_lines(spark, sf_dir), 0, 0, "doc_id").select("doc_id", "pos", "block")


@query(
    f"""WITH {_LINES}, t AS (SELECT *, CASE WHEN (type = 'U') <> (lag(type) OVER (PARTITION BY doc_id ORDER BY pos) = 'U') THEN 1 ELSE 0 END AS turn FROM l),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM t),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id, run) AS n, max(run) OVER (PARTITION BY doc_id) AS last FROM r),
    q AS (SELECT *, CASE WHEN type <> 'U' THEN true WHEN run = 0 THEN i > n - 2 WHEN run = last THEN i <= 2 ELSE n <= 4 OR i <= 2 OR i > n - 2 END AS keep FROM k)
    SELECT doc_id, pos, 'line' AS kind, type, text, 0::BIGINT AS n_skipped FROM q WHERE keep
    UNION ALL SELECT doc_id, min(pos), 'skip', NULL, NULL, count(*)::BIGINT FROM q WHERE NOT keep GROUP BY doc_id, run"""
)
def skip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.skipped(_lines(spark, sf_dir), 2, 2, "doc_id")


_RAW = """r AS (SELECT doc_id, pos, CASE WHEN pos % 9 = 3 THEN format('@@ -{},4 +{},6 @@ x', pos, pos * 10 + doc_id % 7) ELSE CASE type WHEN 'I' THEN '+' WHEN 'D' THEN '-' ELSE ' ' END || text END AS raw FROM l)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.format_string("@@ -%d,4 +%d,6 @@ x", F.col("pos"), F.col("pos") * 10 + F.col("doc_id") % 7)
    mark = F.when(F.col("type") == "I", "+").when(F.col("type") == "D", "-").otherwise(" ")
    return _lines(spark, sf_dir).select("doc_id", "pos", F.when(F.col("pos") % 9 == 3, header).otherwise(F.concat(mark, "text")).alias("raw"))


@query(
    f"""WITH {_LINES}, {_RAW}, s AS (SELECT *, TRY_CAST(nullif(regexp_extract(raw, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@', 1), '') AS BIGINT) AS s FROM r),
    g AS (SELECT *, count(s) OVER (PARTITION BY doc_id ORDER BY pos) AS g, CASE WHEN s IS NOT NULL THEN 'header' WHEN raw LIKE '-%' THEN 'deletion' ELSE 'line' END AS kind FROM s),
    i AS (SELECT *, max(s) OVER (PARTITION BY doc_id, g ORDER BY pos) AS b, sum((kind = 'line')::INT) OVER (PARTITION BY doc_id, g ORDER BY pos) AS i FROM g)
    SELECT doc_id, pos, kind, CASE WHEN kind = 'header' OR i = 0 THEN NULL ELSE coalesce(b, 0) + i END::BIGINT AS line FROM i"""
)
def resolve_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.resolve(_raw(spark, sf_dir), "doc_id").select("doc_id", "pos", "kind", "line")


@query(
    f"""WITH {_LINES}, {_RAW}, h AS (SELECT doc_id, pos, CASE WHEN raw LIKE '@@%' THEN raw ELSE format('[L{{}}] ', pos) || raw END AS raw FROM r),
    s AS (SELECT *, TRY_CAST(nullif(regexp_extract(raw, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@', 1), '') AS BIGINT) AS s FROM h),
    g AS (SELECT *, count(s) OVER (PARTITION BY doc_id ORDER BY pos) AS g, TRY_CAST(nullif(regexp_extract(raw, '^\\[L(\\d+)\\]', 1), '') AS BIGINT) AS marker,
      regexp_extract(raw, '^\\[L\\d+\\] ([-+ ]?)', 1) = '-' AS deleted FROM s),
    i AS (SELECT *, max(s) OVER (PARTITION BY doc_id, g) AS b,
      coalesce(sum((marker IS NOT NULL AND NOT deleted)::INT) OVER (PARTITION BY doc_id, g ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM g WHERE g > 0)
    SELECT doc_id, marker, b + i AS line FROM (SELECT doc_id, marker, b, i::BIGINT AS i FROM i WHERE s IS NULL AND NOT deleted) WHERE marker % 4 = 0"""
)
def resolve_marked_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).withColumn("raw", F.when(F.col("raw").startswith("@@"), F.col("raw")).otherwise(F.concat(F.format_string("[L%d] ", F.col("pos")), "raw")))
    marked = diff.resolve_markers(raw, "doc_id")
    comments = marked.filter("marker % 4 = 0").select("doc_id", "marker")
    return diff.place_comments(comments, marked, "doc_id")[0]


@query(
    f"""WITH {_LINES}, k AS (SELECT doc_id, pos::BIGINT AS line, text, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l WHERE pos % 11 <> 7)
    SELECT c.doc_id, c.line AS "at", k.line, k.text FROM k c JOIN k ON c.doc_id = k.doc_id AND c.island = k.island AND abs(k.line - c.line) <= 3 WHERE c.line % 10 = 6"""
)
def neighbors_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).filter("pos % 11 <> 7").select("doc_id", F.col("pos").cast("long").alias("line"), "text")
    return diff.neighbours(lines, lines.filter("line % 10 = 6").select("doc_id", F.col("line").alias("at")), 3, "doc_id")


@query(
    f"""WITH {_LINES}, {_NUMBERED}, {_BLOCKS}, s AS (SELECT doc_id, block, min(source_index) AS start FROM b GROUP BY ALL),
    d AS (SELECT doc_id, pos::BIGINT AS line, 'decl ' || pos AS declaration FROM l WHERE pos % 5 = 2),
    z AS (SELECT s.doc_id, s.block, s.start, (SELECT max_by(d.declaration, d.line) FROM d WHERE d.doc_id = s.doc_id AND d.line <= s.start) AS c,
      lead(block) OVER (PARTITION BY doc_id ORDER BY block) IS NULL AS last FROM s)
    SELECT doc_id, block, start, CASE WHEN last THEN '' ELSE coalesce(c, '') END AS context FROM z"""
)
def block_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    blocks = diff.numbers(diff.block_ids(lines, file="doc_id"), "doc_id").groupBy("doc_id", "block").agg(F.min("source_index").alias("start"))
    declared = lines.filter("pos % 5 = 2").select("doc_id", F.col("pos").cast("long").alias("line"), F.format_string("decl %d", F.col("pos")).alias("declaration"))
    return diff.with_context(blocks, declared, "doc_id").select("doc_id", "block", "start", "context")


@query(
    """WITH l AS (SELECT doc_id, unnest(range(0, len(t)))::INTEGER AS pos, unnest(t) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)),
    k AS (SELECT *, sum((pos % 11 NOT IN (0, 4, 5, 6))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM l),
    o AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id, block ORDER BY pos) AS i, pos || ': ' || text AS old FROM k WHERE pos % 11 IN (0, 4, 5, 6)),
    n AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id, block ORDER BY pos) AS i, pos || '! ' || text AS new FROM k WHERE pos % 11 IN (4, 6, 8))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block, i) - 1)::INTEGER AS pos, coalesce(old, '') AS old, coalesce(new, '') AS new FROM o FULL JOIN n USING (doc_id, block, i)"""
)
def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines beside a version in which some are dropped, changed and put in, by a rule on their numbers."""
    lines = F.split("text", "\n")
    numbered = F.transform(lines, lambda x, i: F.concat(i.cast("string"), F.lit(": "), x))
    other = F.flatten(F.transform(lines, lambda x, i: F.when((i % 11).isin(4, 6), F.array(F.concat(i.cast("string"), F.lit("! "), x))).when((i % 11).isin(0, 5), F.array().cast("array<string>")).when(i % 11 == 8, F.array(F.concat(i.cast("string"), F.lit(": "), x), F.concat(i.cast("string"), F.lit("! "), x))).otherwise(F.array(F.concat(i.cast("string"), F.lit(": "), x)))))
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pairing.side_by_side(numbered, other)).alias("pos", "p"))
    return found.select("doc_id", "pos", "p.old", "p.new")


@query(
    """WITH l AS (SELECT doc_id, unnest(range(0, len(t)))::INTEGER AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))
    SELECT doc_id, 2::BIGINT AS line, 'class D' || doc_id AS declaration FROM documents
    UNION ALL SELECT doc_id, 5 + 8 * pos, '  public Task<Map<string,' FROM l WHERE pos % 4 <> 3 UNION ALL SELECT doc_id, 5 + 8 * pos, '  int[] M' || pos || '(' FROM l WHERE pos % 4 = 3"""
)
def declared_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of sources that have a method for each of a document's lines, over several lines, with the text in it."""
    member = lambda x, i: F.concat(
        F.lit('  [Obsolete("{"), Other]\n'), F.when(i % 4 == 3, F.lit("  int[] M")).otherwise(F.lit("  public Task<Map<string,\n    int>> M")), i.cast("string"), F.lit("(\n    int a)\n"), F.when(i % 4 == 3, F.lit("\n")).otherwise(F.lit("")), F.lit("  {\n    // "), x, F.lit("\n    Call(a);\n  }\n")
    )
    body = F.array_join(F.transform(F.split("text", "\n"), member), "")
    source = F.concat(F.lit("namespace N\n{\nclass D"), F.col("doc_id").cast("string"), F.lit("\n{\n"), body, F.lit("}\n}\n"))
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(declarations.declarations(source)).alias("d"))
    return found.select("doc_id", "d.line", "d.declaration")


@query()
def diff_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes made of documents' lines, as files of both languages and others."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, "-").when(i % 3 == 1, "+").otherwise(" "), x)), "\n")
    path = F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".cs").when(F.col("doc_id") % 3 == 1, ".spec.ts").otherwise(".md"))
    found = triage.triage(path, F.concat(F.lit("@@ -1,9 +1,9 @@\n"), body))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("t")).select("doc_id", "t.filter", "t.reason")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 <> 2 THEN false END AS filter,
    CASE doc_id % 4 WHEN 0 THEN 'whitespace-only' WHEN 1 THEN 'comments-only' WHEN 3 THEN 'generated-artifact;comments-only' END AS reason FROM documents"""
)
def triage_of_known_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' whole texts, changed in their blanks alone or as comments, in files of several kinds."""
    kind = F.col("doc_id") % 4
    moved = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("-"), x, F.lit("\n+  "), x))
    said = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("-// "), x, F.lit("\n+ // "), x, F.lit(" again")))
    path = F.concat(F.lit("Src/F"), F.col("doc_id").cast("string"), F.when(kind == 0, ".cs").when(kind == 1, ".ts").when(kind == 2, ".md").otherwise(".g.cs"))
    found = triage.triage(path, F.concat(F.lit("@@ -1,9 +1,9 @@\n"), F.array_join(F.when(kind == 0, moved).otherwise(said), "\n")))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("t")).select("doc_id", "t.filter", "t.reason")


@query()
def line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each kind documents' lines have as code."""
    t = _lines(spark, sf_dir).select("doc_id", F.explode(triage.tokens_of(F.col("text"))).alias("t"))
    return t.groupBy("doc_id", F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.to_markdown(F.col("html")).alias("markdown"))


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.to_text(F.col("html")).alias("plain"))


_BUILT = """l AS (SELECT doc_id, unnest(range(0, len(t))) AS i, unnest(t) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)),
    b AS (SELECT doc_id, string_agg(CASE WHEN i % 4 = 3 THEN '  - ' || line || chr(10) ELSE line || chr(10) || chr(10) END, '' ORDER BY i) AS body FROM l GROUP BY doc_id)"""


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have a document's lines as paragraphs and list items, escaped, below a heading."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    block = lambda x, i: F.when(i % 4 == 3, F.concat(F.lit("<ul><li>"), x, F.lit("</li></ul>"))).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>")))
    body = F.array_join(F.transform(F.split(escaped, "\n"), block), "")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<html><body><h1>Doc &amp; "), F.col("doc_id").cast("string"), F.lit("</h1>"), body, F.lit("</body></html>")).alias("html"))


@query(f"WITH {_BUILT} SELECT doc_id, rtrim('# Doc & ' || doc_id || chr(10) || chr(10) || body, chr(10) || chr(32) || chr(9) || chr(13)) AS markdown FROM b")
def html_built_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).select("doc_id", html.to_markdown(F.col("html")).alias("markdown"))


@query(f"WITH {_BUILT} SELECT doc_id, rtrim('Doc & ' || doc_id || chr(10) || chr(10) || body, chr(10) || chr(32) || chr(9) || chr(13)) AS plain FROM b")
def html_built_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).select("doc_id", html.to_text(F.col("html")).alias("plain"))


@query()
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.to_sections(F.col("html"))).alias("pos", "s"))
    return rows.select("page_id", "pos", "s.key", "s.content")


@query()
def html_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of pages turned to Markdown."""
    pages = table(spark, sf_dir, "pages").select("page_id", html.to_markdown(F.col("html")).alias("md"))
    return segments.explode_segments(pages, "md", "page_id")
