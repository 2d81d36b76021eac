"""Queries on text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import flags, triage
from sparkloom.functions import text as X
from sparkloom.plans.registry import query
from sparkloom.session import table


@query(
    """SELECT doc_id, CAST(ceil(strlen(text) / 3.3::DOUBLE) AS INTEGER) AS tokens, CAST(ceil(strlen(text) / 2.3::DOUBLE) AS INTEGER) AS tokens_as_code,
    strlen(text)::BIGINT AS n_bytes FROM documents"""
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.tokens_estimated(t).alias("tokens"), X.tokens_estimated(t, X.BYTES_PER_TOKEN["code"]).alias("tokens_as_code"), F.octet_length(t).cast("long").alias("n_bytes"))


@query(
    """WITH c AS (SELECT conv_id, sum(strlen(text))::BIGINT AS n_bytes, max(length(text))::BIGINT AS longest FROM conversations GROUP BY conv_id)
    SELECT conv_id, n_bytes, longest, CASE WHEN n_bytes <= 500 * 2.0 THEN 'FitGuaranteed' WHEN n_bytes / 3.3::DOUBLE >= 500 THEN 'ExceedLikely' ELSE 'Ambiguous' END AS fit FROM c"""
)
def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.max(F.length("text")).cast("long").alias("longest"))
    return c.select("conv_id", "n_bytes", "longest", X.context_fit(F.col("n_bytes"), 500).alias("fit"))


#: A text that names series, made from a document's numbers.
_TITLED = "concat('Series ', 3 + doc_id % 4, ' notes, s', 3 + (doc_id // 4) % 5, ' and series_', 3 + doc_id % 3, '; xS6')"


@query(
    f"""SELECT doc_id, unnest(list_sort(list_distinct(list_transform(regexp_extract_all({_TITLED}, '(?i)\\b(S[3-6]|Series [3-6]|series_[3-6])\\b'), lambda m: 'S' || right(m, 1))))) AS series
    FROM documents"""
)
def series_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("title", F.expr(_TITLED.replace("//", "div")))
    return docs.select("doc_id", F.explode(X.series_of(F.col("title"))).alias("series"))


@query(
    """SELECT doc_id, count(*)::BIGINT AS n, min(s) AS least FROM (
      SELECT doc_id, unnest(list_distinct(['S' || (3 + doc_id % 4), 'S' || (3 + doc_id % 3), 'S' || (3 + doc_id % 2)])) AS s FROM documents) GROUP BY doc_id"""
)
def series_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    title, prefix, label = (F.concat(F.lit(p), (3 + F.col("doc_id") % n).cast("string")) for p, n in (("about Series ", 4), ("S", 3), ("series_", 2)))
    each = docs.select("doc_id", F.explode(X.series_union(title, F.array(prefix), F.array(label))).alias("s"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("s").alias("least"))


@query(
    r"""SELECT conv_id, turn, trim(regexp_replace(concat('<think a="1">', role, '</think> ', text, chr(10), '<THINK>', turn, '</THINK>'), '(?is)<think\b[^>]*>([\s\S]*?)</think>', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS answer,
    role || chr(10) || turn AS thought FROM conversations WHERE role IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL"""
)
def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role is not null and turn is not null and text is not null")
    raw = F.concat(F.lit('<think a="1">'), "role", F.lit("</think> "), "text", F.lit("\n<THINK>"), F.col("turn").cast("string"), F.lit("</THINK>"))
    return c.select("conv_id", "turn", X.without_thinking(raw).alias("answer"), X.thinking(raw).alias("thought"))


@query(
    r"""WITH u AS (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(concat('see ', url, ', or ', url, '. ', html), 'https?://[^\s<>"''\])}]+'), lambda x: rtrim(x, '.,;:!?')))) AS found FROM pages)
    SELECT page_id, found FROM u WHERE regexp_matches(found, '^https?://[^/]')"""
)
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("see "), "url", F.lit(", or "), "url", F.lit(". "), "html")
    return table(spark, sf_dir, "pages").select("page_id", F.explode(X.urls_of(raw)).alias("found"))


@query(
    """SELECT o_orderkey, len(k)::BIGINT AS n, k[1] AS first_key FROM (SELECT o_orderkey, regexp_extract_all(
      concat('ISW-', o_orderkey, ' fixes isw-', o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN ' and ISW-7' ELSE ' ISW-x' END), '(?i)ISW-\\d+') AS k FROM orders)"""
)
def issue_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    title = F.concat(F.lit("ISW-"), F.col("o_orderkey").cast("string"), F.lit(" fixes isw-"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, " and ISW-7").otherwise(" ISW-x"))
    k = X.issue_keys(title)
    return o.select("o_orderkey", F.size(k).cast("long").alias("n"), F.get(k, F.lit(0)).alias("first_key"))


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) END AS page,
    CASE page_id % 3 WHEN 1 THEN 'SP' || (page_id % 7) WHEN 2 THEN 'DOC' END AS space,
    CASE page_id % 3 WHEN 1 THEN 'My Title ' || page_id WHEN 2 THEN 'A b ' || page_id END AS title FROM pages"""
)
def url_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id").cast("string")
    by_id = F.concat(F.lit("https://wiki.example.org/pages?x=1&pageId="), i)
    by_path = F.concat(F.lit("https://wiki.example.org/display/SP"), (F.col("page_id") % 7).cast("string"), F.lit("/My+Title+"), i, F.lit("#part"))
    by_name = F.concat(F.lit("https://wiki.example.org/pages?spaceKey=DOC&title=A%20b%20"), i)
    url = F.when(F.col("page_id") % 3 == 0, by_id).when(F.col("page_id") % 3 == 1, by_path).otherwise(by_name)
    return p.withColumn("u", url).select("page_id", X.page_id_of(F.col("u")).alias("page"), X.space_of(F.col("u")).alias("space"), X.title_of(F.col("u")).alias("title"))


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://ci.example.org/job/folder/job/main/' || page_id || '/consoleFull'
    WHEN 1 THEN 'https://ci.example.org/job/main/' || page_id || '/consoleFull' END AS console FROM pages"""
)
def console_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    url = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://ci.example.org/job/folder/job/main/"), i, F.lit("/artifact/x")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://ci.example.org/blue/organizations/jenkins/main/detail/branch/"), i, F.lit("/pipeline/12")))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", X.console_url(url).alias("console"))


@query(
    """SELECT page_id, left(rtrim(trim(regexp_replace(url || ' |:', '[<>:"/\\\\|?*]+', '_', 'g')), '.'), 100) AS name, string_split(url, '/')[-1] AS last FROM pages"""
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.safe_file_name(F.concat("url", F.lit(" |:"))).alias("name"), X.last_part(F.col("url")).alias("last"))


@query(
    """SELECT l_orderkey, l_linenumber, m AS message, regexp_matches(lower(m), 'merge branch|merge pull request|merge remote-tracking branch|merge with develop|merge tag') AS is_merge
    FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'Merge Branch ' || l_shipdate::DATE WHEN 2 THEN 'fix merge' WHEN 3 THEN 'MERGE TAG v1' ELSE 'work' END AS m FROM lineitem)"""
)
def commit_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.expr("CASE l_linenumber WHEN 1 THEN concat('Merge Branch ', CAST(l_shipdate AS DATE)) WHEN 2 THEN 'fix merge' WHEN 3 THEN 'MERGE TAG v1' ELSE 'work' END")
    return table(spark, sf_dir, "lineitem").withColumn("message", m).select("l_orderkey", "l_linenumber", "message", X.is_merge(F.col("message")).alias("is_merge"))


@query(
    """WITH f AS (SELECT l_orderkey AS pr, bit_or(1 << (l_linenumber - 1))::INTEGER AS mask FROM lineitem GROUP BY 1)
    SELECT pr, mask, (mask & -mask)::INTEGER AS lowest, (mask & 7)::INTEGER AS up_to_4, bit_count(mask)::BIGINT AS n FROM f"""
)
def flag_bit_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.expr("shiftleft(1, l_linenumber - 1)")
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pr")).agg(flags.union(one).alias("mask"))
    return f.select("pr", "mask", flags.lowest(F.col("mask")).alias("lowest"), flags.up_to(F.col("mask"), F.lit(4)).alias("up_to_4"), F.bit_count("mask").cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE ((1 << (l_linenumber - 1)) & 5) <> 0")
def bitmask_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(flags.has_any(F.expr("shiftleft(1, l_linenumber - 1)"), 5)).select("l_orderkey", "l_linenumber")


@query(
    """SELECT l_orderkey AS pr, min(1 << (l_linenumber - 1))::INTEGER AS min_flag, count(*) FILTER ((1 << (l_linenumber - 1)) <= 4)::BIGINT AS n_up_to_4 FROM lineitem GROUP BY 1"""
)
def min_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.expr("shiftleft(1, l_linenumber - 1)")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pr")).agg(F.coalesce(F.min(flags.lowest(one)), F.lit(0)).alias("min_flag"), F.count_if(one <= 4).alias("n_up_to_4"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS filter,
    CASE doc_id % 5 WHEN 0 THEN 'pure-rename' WHEN 1 THEN 'mixed-keep;logic-changed;comments-only' WHEN 2 THEN 'uncertain-keep'
      WHEN 3 THEN 'data-access-changed;logic-changed' ELSE 'typo-fix;whitespace-only' END AS reason FROM documents"""
)
def label_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [["logic-changed", "pure-rename"], [" Logic-Changed ", "comments-only"], ["", "something"], ["data-access-changed", "logic-changed"], ["typo-fix", "whitespace-only", "typo-fix"]]
    arrays = F.array(*(F.array(*map(F.lit, s)) for s in sets))
    d = X.decide(F.get(arrays, (F.col("doc_id") % 5).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", d.alias("d")).select("doc_id", "d.filter", "d.reason")


#: Paths made from a page's number.
_PATH = "concat('Src/', CASE page_id % 6 WHEN 0 THEN 'Tests/A.cs' WHEN 1 THEN 'x/Widget.SPEC.tsx' WHEN 2 THEN 'lib/b.js' WHEN 3 THEN 'TestKit.cs' WHEN 4 THEN 'ThingTests.cs' ELSE 'readme.md' END)"


@query(f"SELECT page_id, {_PATH} AS path, page_id % 6 IN (0, 1, 4) AS is_test FROM pages")
def test_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("path", F.expr(_PATH)).select("page_id", "path", X.is_test_path(F.col("path")).alias("is_test"))


@query(f"SELECT page_id, CASE WHEN page_id % 6 IN (0, 3, 4) THEN 'csharp' WHEN page_id % 6 IN (1, 2) THEN 'script' END AS classifier, {_PATH} AS path FROM pages")
def ext_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("path", F.expr(_PATH)).select("page_id", X.classifier_of(F.col("path")).alias("classifier"), "path")


@query(
    """SELECT conv_id, turn, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS before_marker, trim(concat(text, chr(10), chr(10), text), chr(32) || chr(9) || chr(10) || chr(13)) AS without_block
    FROM conversations WHERE text IS NOT NULL AND length(text) > 0"""
)
def body_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block cut out of a body that has the whole text before and after it."""
    c = table(spark, sf_dir, "conversations").filter("text is not null and length(text) > 0")
    body = F.concat("text", F.lit("<!--Start-->\nchecks\n<!--END-->"), "text")
    return c.select("conv_id", "turn", X.cut_from(body, "<!--start-->").alias("before_marker"), X.cut_between(body, "<!--START-->", "<!--end-->").alias("without_block"))


@query(
    """SELECT event_id, '{"id": ' || event_id || ', "p": {"k": 1}}' AS json, event_id::BIGINT AS id FROM events"""
)
def json_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('Sure:\n```json\n{"id": '), F.col("event_id").cast("string"), F.lit(', "p": {"k": 1}}\n``` done'))
    j = X.json_slice(raw)
    return table(spark, sf_dir, "events").select("event_id", j.alias("json"), F.get_json_object(j, "$.id").cast("long").alias("id"))


@query("SELECT n_nationkey, s.c_nationkey AS other, levenshtein(n.n_name, s.n_name)::BIGINT AS distance FROM nation n JOIN (SELECT n_nationkey AS c_nationkey, n_name FROM nation) s ON n.n_nationkey + 1 = s.c_nationkey")
def name_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    o = n.select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("o"))
    return n.join(o, F.col("n_nationkey") + 1 == F.col("other")).select("n_nationkey", "other", triage.name_distance(F.col("n_name"), F.col("o")).alias("distance"))


@query(
    """SELECT doc_id, i::INTEGER AS pos, substring(text, i * 800 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 200) / 800.0) AS BIGINT)))) AS i FROM documents)"""
)
def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 1000)).alias("pos", "chunk"))


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Added' WHEN 'F' THEN 'Modified' ELSE 'Renamed' END AS status,
    CASE WHEN o_orderkey % 4 < 2 THEN 'Deleted' WHEN o_orderkey % 4 = 2 THEN 'Added' ELSE 'Modified' END AS change FROM orders"""
)
def change_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("CASE o_orderstatus WHEN 'O' THEN 'added' WHEN 'F' THEN 'modified' ELSE 'renamed' END")
    before = F.when(F.col("o_orderkey") % 4 % 2 == 1, "old")
    after = F.when(F.col("o_orderkey") % 4 >= 2, "new")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.file_status(status).alias("status"), X.change_of_sides(before, after).alias("change"))


@query(
    """SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS from_ms, 32 + trunc(value / 0.5556::DOUBLE)::INTEGER AS fahrenheit,
    lower(event_type) = 'error' AS is_error FROM events"""
)
def scalar_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.timestamp_millis(ms).cast("timestamp_ntz").alias("from_ms"), X.fahrenheit(F.col("value")).alias("fahrenheit"), (F.lower("event_type") == "error").alias("is_error"))


@query(
    """SELECT page_id, lower(replace(url, 'x', 'y')) AS a, string_split(url, '/')[3] AS host, 'q' || page_id || '?' AS question,
      'MyType 00007ff' || page_id AS table_line, 'plain ' || page_id AS markdown, 'text of ' || page_id AS content FROM pages"""
)
def small_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    asked = X.questions(F.concat(F.lit("note | q"), i, F.lit("? | other")))
    prompt = X.without_prompt(F.concat(F.lit("0:000> MyType 00007ff"), i))
    fenced = X.without_fence(F.concat(F.lit("```markdown\nplain "), i, F.lit("\n```")))
    coded = X.base64_text(F.concat(F.substring(F.base64(F.concat(F.lit("text of "), i).cast("binary")), 1, 4), F.lit("\r\n"), F.substring(F.base64(F.concat(F.lit("text of "), i).cast("binary")), 5, 1000)))
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.replace("url", F.lit("x"), F.lit("y"))).alias("a"), F.try_element_at(F.split("url", "/"), F.lit(3)).alias("host"), F.get(asked, F.lit(0)).alias("question"), prompt.alias("table_line"), fenced.alias("markdown"), coded.alias("content"))
