"""Queries on the parts of a review: files and their diffs, orders, lists, model calls on the stand-ins, and reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import ci
from sparkloom.functions import text as X
from sparkloom.operators import diff, flows, index, models, tree, work
from sparkloom.plans.changes import _BLOCKS, _LINES, _NUMBERED, _lines
from sparkloom.plans.records import _consoles, _edges
from sparkloom.plans.registry import query
from sparkloom.plans.work import _COMMITS, _REVIEWS, _commits, _reviews
from sparkloom.session import table
from sparkloom.sources import paged, requests

#: What the stand-in model answers to a prompt: its length and its first eight words.
_STUB = "length({p}) || ': ' || array_to_string(list_filter(string_split_regex({p}, '\\s+'), lambda x: x <> '')[1:8], ' ')"


def _stub(prompt: str) -> str:
    return "(" + _STUB.replace("{p}", f"({prompt})") + ")"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of pull requests: number, name, min_class, diff."""
    li = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("src/F"), F.col("l_linenumber").cast("string"), F.lit(".cs"))
    text = F.concat(F.lit("+ part "), F.col("l_partkey").cast("string"), F.lit(" by "), F.col("l_suppkey").cast("string"))
    return li.select(F.col("l_orderkey").alias("number"), name.alias("name"), (F.col("l_suppkey") % 4).cast("int").alias("min_class"), text.alias("diff"))


_FILES = "f AS (SELECT l_orderkey AS number, 'src/F' || l_linenumber || '.cs' AS name, (l_suppkey % 4)::INTEGER AS min_class, '+ part ' || l_partkey || ' by ' || l_suppkey AS diff FROM lineitem)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with names of their own: number, name, class, diff."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_size").alias("number"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") % 4).cast("int").alias("class"), F.concat("p_name", F.lit(" "), "p_type").alias("diff"))


_PARTS = "f AS (SELECT p_size AS number, 'f' || p_partkey AS name, (p_partkey % 4)::INTEGER AS class, p_name || ' ' || p_type AS diff FROM part)"


@query(f"WITH {_PARTS} SELECT number, name, diff FROM f")
def strict_file_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _parts(spark, sf_dir)
    return work.with_diffs(f.select("number", "name"), f.select("number", "name", "diff"))


@query("SELECT o_orderkey AS number, o_orderpriority AS name, CASE o_orderstatus WHEN 'O' THEN 'Added' WHEN 'F' THEN 'Modified' ELSE 'Deleted' END AS change FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("name"), "o_orderstatus")
    return work.changed_files(*(o.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "OFP"))


@query("SELECT l_orderkey AS number, l_linenumber AS file FROM lineitem WHERE l_returnflag = 'A' OR l_linenumber % 2 = 1")
def reviews_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_returnflag") == "A", "text").when(F.col("l_returnflag") == "N", " ")
    comments = F.when(F.col("l_linenumber") % 2 == 1, F.array(F.lit("c"))).when(F.col("l_linenumber") % 4 == 0, F.array().cast("array<string>"))
    rows = li.select(F.col("l_orderkey").alias("number"), F.col("l_linenumber").alias("file"), text.alias("review"), comments.alias("comments"))
    return work.with_content(rows).select("number", "file")


@query("SELECT conv_id AS number, turn % 3 AS line, count(*)::BIGINT AS n, string_agg(coalesce(role, '') || ':' || coalesce(text, ''), '|' ORDER BY turn, coalesce(role, '') || ':' || coalesce(text, '')) AS bodies FROM conversations GROUP BY ALL")
def comments_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("number"), (F.col("turn") % 3).alias("line"), F.col("turn").alias("id"), F.concat(F.coalesce("role", F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).alias("body"))
    return work.comments_by_line(rows, "number").select("number", "line", F.size("bodies").cast("long").alias("n"), F.array_join("bodies", "|").alias("bodies"))


@query(
    f"""WITH {_COMMITS} SELECT number, sha, row_number() OVER (PARTITION BY number ORDER BY date, sha)::INTEGER AS oldest_first,
    (count(*) OVER (PARTITION BY number) - row_number() OVER (PARTITION BY number ORDER BY date, sha) + 1)::INTEGER AS newest_first FROM c"""
)
def commits_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.commit_order(_commits(spark, sf_dir)).select("number", "sha", "oldest_first", "newest_first")


@query(
    f"""WITH {_PARTS} SELECT number, name, row_number() OVER (PARTITION BY number ORDER BY class, name)::INTEGER AS by_class,
    row_number() OVER (PARTITION BY number ORDER BY length(diff) DESC, name)::INTEGER AS by_length FROM f"""
)
def files_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.file_order(_parts(spark, sf_dir)).select("number", "name", "by_class", "by_length")


@query(f"WITH {_REVIEWS} SELECT number, string_agg(id || ' ' || state, ',' ORDER BY submitted_at, id) AS reviews FROM r GROUP BY number")
def reviews_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = work.in_time_order(_reviews(spark, sf_dir), "submitted_at", "id", "state")
    shown = F.transform("entries", lambda x: F.concat_ws(" ", x["id"].cast("string"), x["state"]))
    return listed.select("number", F.array_join(shown, ",").alias("reviews"))


_READ = f"""WITH {_COMMITS}, {_REVIEWS}, a AS (SELECT number, count(*) AS n, string_agg(sha, ',' ORDER BY date, sha) AS s FROM c GROUP BY 1), b AS (SELECT number, count(*) AS n, max(submitted_at) AS last FROM r GROUP BY 1)
    SELECT 'repo' AS repo, o_orderkey AS number, coalesce(a.n, 0)::BIGINT AS n_commits, coalesce(a.s, '') AS shas, coalesce(b.n, 0)::BIGINT AS n_reviews, b.last AS last_review
    FROM orders LEFT JOIN a ON a.number = o_orderkey LEFT JOIN b ON b.number = o_orderkey"""


@query(_READ)
def pull_requests_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests with their commits and reviews as arrays, as the service's reads give them."""
    pulls = table(spark, sf_dir, "orders").select(F.lit("repo").alias("repo"), F.col("o_orderkey").alias("number"))
    commits = _commits(spark, sf_dir).select(F.lit("repo").alias("repo"), "number", F.col("date").alias("at"), "sha", "message")
    reviews = _reviews(spark, sf_dir).select(F.lit("repo").alias("repo"), "number", F.col("submitted_at").alias("at"), "id", "state")
    return _shown(work.nested(pulls, commits=commits, reviews=reviews))


def _shown(rows: DataFrame) -> DataFrame:
    shas = F.array_join(F.transform("commits", lambda x: x["sha"]), ",")
    last = F.try_element_at("reviews", F.lit(-1))["at"]
    return rows.select("repo", "number", F.size("commits").cast("long").alias("n_commits"), shas.alias("shas"), F.size("reviews").cast("long").alias("n_reviews"), last.alias("last_review"))


@query(_READ)
def pull_requests_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by requests: lists of commits and reviews page by page, and a GET for each commit, of a service that is the
    tables (its addresses hold its answers)."""
    by = ["repo", "number"]
    pulls = table(spark, sf_dir, "orders").select(F.lit("repo").alias("repo"), F.col("o_orderkey").alias("number"))
    details = F.to_json(F.struct("sha", F.col("date").cast("string").alias("date"), "message"))
    commits = _commits(spark, sf_dir).withColumn("repo", F.lit("repo")).groupBy(*by).agg(F.to_json(F.collect_list(F.struct("sha", paged.holding(details).alias("url")))).alias("body"))
    reviews = _reviews(spark, sf_dir).withColumn("repo", F.lit("repo")).groupBy(*by).agg(F.to_json(F.collect_list(F.struct("id", "state", F.col("submitted_at").cast("string").alias("submitted_at")))).alias("body"))
    asked = [pulls.join(rows, by, "left").select(*by, F.lit(part).alias("part"), paged.holding(F.coalesce("body", F.lit("[]"))).alias("address"), F.lit(True).alias("listed")) for part, rows in (("commits", commits), ("reviews", reviews))]
    found = requests.pull_request_parts(asked[0].unionByName(asked[1]), "sparkloom.sources.paged:held", size=3, wait=0)
    field = lambda name, kind: F.get_json_object("answer", f"$.{name}").cast(kind)
    dates, times = _commits(spark, sf_dir).schema["date"].dataType, _reviews(spark, sf_dir).schema["submitted_at"].dataType
    each = found.filter("part = 'commit' and failed is null").select(*by, field("date", dates).alias("at"), field("sha", "string").alias("sha"), field("message", "string").alias("message"))
    told = found.filter("part = 'reviews' and failed is null").select(*by, field("submitted_at", times).alias("at"), field("id", "long").alias("id"), field("state", "string").alias("state"))
    return _shown(work.nested(pulls, commits=each, reviews=told))


@query(
    f"""WITH {_LINES}, {_NUMBERED}, {_BLOCKS} SELECT doc_id, block, count(*) FILTER (type IN ('U', 'D'))::BIGINT AS source_count, count(*) FILTER (type IN ('U', 'I'))::BIGINT AS target_count
    FROM b GROUP BY doc_id, block HAVING bool_or(type <> 'U')"""
)
def modified_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.hunks(_lines(spark, sf_dir), file="doc_id").filter("is_modification").select("doc_id", "block", "source_count", "target_count")


@query(
    """SELECT l_orderkey AS number, 'F' || l_partkey AS name, l_orderkey IN (SELECT l_orderkey FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_returnflag = 'R' AND x.l_partkey = l.l_partkey) AS touched FROM lineitem l"""
)
def files_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey").cast("string")
    commits = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("number"), F.array(F.concat(F.lit("f"), part)).alias("files"))
    return work.touched(li.select(F.col("l_orderkey").alias("number"), F.concat(F.lit("F"), part).alias("name")), commits)


@query("SELECT l_returnflag AS change_type, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def files_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.change_counts(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "change_type"))


@query(
    """SELECT ' k' || user_id AS key, c_name AS name, c_mktsegment AS segment FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0"""
)
def issue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select(F.concat(F.lit(" k"), F.col("user_id").cast("string")).alias("key")).distinct()
    issues = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return work.lookup(issues, keys)


@query("SELECT s_suppkey AS key, s_nationkey AS sprint_id, 'u' || s_suppkey % 5 AS assignee FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey % 2 = 0 AND s_suppkey % 5 IN (1, 2)")
def sprint_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("sprint_id"), F.concat(F.lit("u"), (F.col("s_suppkey") % 5).cast("string")).alias("assignee"))
    sprints = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sprint_id"), F.when(F.col("n_regionkey") % 2 == 0, "active").otherwise("closed").alias("state"))
    return work.sprint_issues(issues, sprints, users=["u1", "u2"]).select("key", "sprint_id", "assignee")


@query("SELECT 'I' || page_id AS key, page_id, 'https://wiki.example.org/pages?pageId=' || page_id AS url, url AS title FROM pages")
def issue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id").cast("string")
    issues = p.select(F.concat(F.lit("I"), i).alias("key"), F.concat(F.lit("as in https://wiki.example.org/pages?pageId="), i, F.lit(", and "), "url").alias("summary"))
    return work.linked_documents(issues, p.select("page_id", F.col("url").alias("title")), "summary").select("key", "page_id", "url", "title")


@query("SELECT doc_id, text AS title FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))")
def missing_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole text, as a title, no labelled document has."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"))
    return index.missing_titles(t, t.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")).select("doc_id", "title")


@query(
    """WITH s AS (SELECT doc_id, 'S' || (3 + doc_id % 4) AS a, 'S' || (3 + doc_id % 3) AS b, 'S' || (3 + doc_id % 2) AS c FROM documents)
    SELECT doc_id, a || CASE WHEN b <> a THEN ',' || b ELSE '' END || CASE WHEN c NOT IN (a, b) THEN ',' || c ELSE '' END AS generic,
      a || CASE WHEN c <> a THEN ',' || c ELSE '' END || CASE WHEN b NOT IN (a, c) THEN ',' || b ELSE '' END AS requirement FROM s"""
)
def series_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, prefix, label = (F.concat(F.lit(p), (3 + F.col("doc_id") % n).cast("string")) for p, n in (("about Series ", 4), ("S", 3), ("series_", 2)))
    both = (X.series_union(title, F.array(prefix), F.array(label), labels_first=first) for first in (False, True))
    return table(spark, sf_dir, "documents").select("doc_id", *(F.array_join(u, ",").alias(n) for u, n in zip(both, ("generic", "requirement"), strict=True)))


@query(
    """SELECT page_id, len(u)::BIGINT AS n, u[1] AS first_url FROM (SELECT page_id, list_filter([rtrim(url, '.,;:!?')], lambda x: lower(regexp_extract(x, '^https?://([^/:?#]+)', 1)) = lower(h)) AS u
    FROM pages, (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)))"""
)
def wiki_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    first = p.agg(F.min_by("url", "page_id").alias("u")).select(F.upper(F.regexp_extract("u", r"^https?://([^/:?#]+)", 1)))
    asked = p.withColumn("host", first.scalar())  # a subquery of the plan
    u = X.wiki_urls_of(F.concat(F.lit("see "), "url", F.lit(" or http://elsewhere.example.org/x.")), F.col("host"))
    return asked.select("page_id", F.size(u).cast("long").alias("n"), F.get(u, F.lit(0)).alias("first_url"))


@query(
    """SELECT page_id, '{"build_tag":"build-' || page_id || '","finish_status":"' || CASE WHEN page_id % 3 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END || '","failed":[' || CASE WHEN page_id % 3 = 0 THEN '"Test"' ELSE '' END || '],"skipped":[]}' AS summary FROM pages"""
)
def console_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _consoles(spark, sf_dir)
    return c.select("page_id", ci.pipeline_json(F.col("p")).alias("summary"))


@query("WITH RECURSIVE e AS (SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN doc_id // 2 END AS parent FROM documents), d AS (SELECT id, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.id, d.depth + 1 FROM e JOIN d ON e.parent = d.id) SELECT id, depth FROM d JOIN documents ON doc_id = id WHERE source = 'src5' ORDER BY depth, id LIMIT 1")
def stage_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage of a name nearest to the root, whether it is marked as parallel or not."""
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "Parallel ").otherwise(""), F.col("source"))
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), name.alias("name"))
    return tree.first_by_level(nodes, _edges(spark, sf_dir), tree.named(F.col("name"), "parallel SRC5")).select("id", "depth")


@query(
    """WITH n AS (UNPIVOT (SELECT count(COLUMNS(*)) FROM lineitem) ON COLUMNS(*) INTO NAME name VALUE n)
    SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'integer' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'number' ELSE 'string' END AS type, n FROM (DESCRIBE lineitem) JOIN n ON name = column_name"""
)
def json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and types of the schema that rows are told by, and how many rows have each."""
    rows = table(spark, sf_dir, "lineitem")
    types = F.create_map(*(F.lit(x) for n, p in json.loads(flows.json_schema(rows))["properties"].items() for x in (n, p["type"])))
    counts = F.array(*(F.struct(F.lit(c).alias("name"), F.count(c).alias("n")) for c in rows.columns))
    return rows.agg(counts.alias("c")).select(F.explode("c").alias("c")).select("c.name", types[F.col("c.name")].alias("type"), "c.n")


@query("SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS at, greatest(0, (epoch_us(TIMESTAMP '2024-01-20 00:00:00') // 1000000) - epoch_us(ts) // 1000000)::BIGINT AS seconds_left FROM events")
def epoch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = X.from_epoch_seconds(F.unix_seconds(F.col("ts").cast("timestamp")))
    return e.select("event_id", at.cast("timestamp_ntz").alias("at"), X.seconds_left(F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("seconds_left"))


@query(
    """SELECT user_id, event_id, row_number() OVER w AS place, coalesce(epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER w) // 1000, 0)::BIGINT AS ms FROM (SELECT *, lpad(event_id::VARCHAR, 12, '0') AS name FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, name)""".replace("row_number() OVER w AS place", "(row_number() OVER w)::INTEGER AS place")
)
def run_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("time"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("name"))
    return flows.diagnostics(e, "user_id").select("user_id", "event_id", "place", "ms")


#: Lines that a classifier of lines tells apart.
_LINE = "CASE page_id % 5 WHEN 0 THEN '  // note' WHEN 1 THEN 'using System.IO;' WHEN 2 THEN '#region x' WHEN 3 THEN ' import a from b' ELSE 'x = 1' END"


@query(
    f"""SELECT page_id, 'My Plan ' || page_id AS title, 'title=A%20b%20c' || page_id || '&spaceKey=SP' AS asked, page_id % 5 = 0 AS is_comment, page_id % 5 = 1 AS is_import, page_id % 5 = 3 AS is_script_import, page_id % 5 = 2 AS is_region,
    regexp_replace({_LINE}, '\\s+', '', 'g') AS bare, '00007ff' || page_id AS address, 'Review repo#' || page_id AS instructions, 'a/' || page_id || '.md' AS inside, '/other/' || page_id AS outside FROM pages"""
)
def string_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    line = F.expr(_LINE)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        X.clean_title(F.concat(F.lit("My PRD Plan "), i, F.lit(" - .")), "prd ").alias("title"),
        X.title_query(F.concat(F.lit("A+b c"), i), F.lit("SP")).alias("asked"),
        X.is_comment(line).alias("is_comment"),
        X.is_import(line).alias("is_import"),
        X.is_import(line, script=True).alias("is_script_import"),
        X.is_region(line).alias("is_region"),
        X.no_blanks(line).alias("bare"),
        X.method_table(F.concat(F.lit("0:000> x\r\n  MethodTable: 1 00007ff"), i, F.lit("\r\nMethodTable: 2"))).alias("address"),
        X.fill(F.lit("Review {repo}#{number}"), {"repo": F.lit("repo"), "number": F.col("page_id")}).alias("instructions"),
        X.relative_path(F.concat(F.lit("/root/docs/a/"), i, F.lit(".md")), F.lit("/root/docs")).alias("inside"),
        X.relative_path(F.concat(F.lit("/other/"), i), F.lit("/root/docs")).alias("outside"),
    )


@query(f"SELECT item_id, text AS query, {_stub("'Put as a search query:' || chr(10) || text")} AS optimised FROM benchmark")
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "benchmark").select("item_id", flows.search_query(F.col("text"), models.StubChat()).alias("s"))
    return found.select("item_id", "s.query", "s.optimised")


@query(
    f"""WITH t AS (SELECT 'S3' AS series, 'P' || page_id AS title, html AS sample, page_id FROM pages) SELECT series, title, {_stub("'Rephrase the background of ' || title || ':' || chr(10) || sample")} AS background
    FROM t WHERE page_id % 3 <> 0"""
)
def background_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as backgrounds; an index that has every third of them."""
    t = table(spark, sf_dir, "pages").select(F.lit("S3").alias("series"), F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("title"), F.col("html").alias("sample"), "page_id")
    return flows.background_samples(t, t.filter("page_id % 3 = 0"), models.StubChat()).select("series", "title", "background")


def _classes(prompt: str, attempt: int) -> str:
    """A stand-in that classifies by the supplier's number: some at once, some after one answer of no use, some never."""
    n = int(prompt.rsplit(" ", 1)[1]) % 4
    if n == 3 or attempt < n % 2:
        return "I can not say" if attempt else '{"class": "unheard of"}'
    return "It is " + json.dumps({"class": flows.CLASSES[n], "reason": f"supplier {n}"}) + "."


@query(
    f"WITH {_FILES} SELECT number, name, CASE min_class WHEN 1 THEN 'interface' WHEN 2 THEN 'tests' ELSE 'logic' END AS class, CASE WHEN min_class = 3 THEN 'not classified' ELSE 'supplier ' || min_class END AS reason FROM f"
)
def classified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.classify_files(_files(spark, sf_dir), models.ScriptedChat(_classes)).select("number", "name", "class", "reason")


@query(
    f"""WITH a AS (SELECT c_custkey AS number, 'about ' || c_name AS x, 'in ' || c_mktsegment AS y, c_custkey % 2 = 0 AS two FROM customer),
    b AS (SELECT *, {_stub("'Draft:' || chr(10) || x")} AS d FROM a), c AS (SELECT number, CASE WHEN two THEN {_stub("'Refine:' || chr(10) || d || chr(10) || y")} ELSE d END AS r FROM b)
    SELECT number, {_stub("'Shorten:' || chr(10) || r")} AS overview FROM c"""
)
def overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overviews of one or two files, each of which fills a context."""
    c = table(spark, sf_dir, "customer")
    first = c.select(F.col("c_custkey").alias("number"), F.lit("a").alias("name"), F.concat(F.lit("about "), "c_name").alias("summary"))
    second = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("number"), F.lit("b").alias("name"), F.concat(F.lit("in "), "c_mktsegment").alias("summary"))
    return flows.overview(first.unionByName(second), models.StubChat(), 4)


def _comments(prompt: str, attempt: int) -> str:
    """A stand-in that comments on a line that is not there first, and then on the first line that is."""
    n = int(re.search(r"^\[L(\d+)\]", prompt, re.M)[1])
    return json.dumps([{"line": 99_999 if not attempt else n, "text": f"look at {n}"}, {"line": n, "text": "again"}])


@query("SELECT l_orderkey AS number, 'f' || l_linenumber AS name, l_linenumber + 10 AS line, unnest(['look at ' || (l_linenumber + 10), 'again']) AS text FROM lineitem")
def line_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    marked = F.format_string("@@ -1,2 +1,2 @@\n[L%d] +new\n[L%d]  old", F.col("l_linenumber") + 10, F.col("l_linenumber") + 11)
    rows = li.select(F.col("l_orderkey").alias("number"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"), marked.alias("diff"))
    return flows.line_comments(rows, models.ScriptedChat(_comments))


@query(
    f"""WITH {_FILES}, a AS (SELECT number, string_agg(name, chr(10) ORDER BY min_class, name) AS names FROM f WHERE min_class <= 1 GROUP BY number)
    SELECT number, {_stub("'Plan the review of:' || chr(10) || names")} AS plan FROM a"""
)
def review_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.review_plan(_files(spark, sf_dir), models.StubChat(), 1)


@query(
    f"""WITH f AS (SELECT p_size AS number, 'src/f' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.g.cs' ELSE '.md' END AS name, p_name || ' ' || p_type AS diff, p_partkey % 5 = 0 AS skipped FROM part),
    r AS (SELECT number, name, '### 🔴 `' || name || '`' || chr(10) || {_stub("'Review ' || name || chr(10) || diff")} AS text FROM f WHERE NOT skipped),
    t AS (SELECT *, sum(length(text) + 4) OVER (PARTITION BY number ORDER BY name ROWS UNBOUNDED PRECEDING) - 4 AS total FROM r),
    c AS (SELECT number, string_agg(text, chr(10) || chr(10) || chr(10) || chr(10) ORDER BY name) AS comment FROM t WHERE total <= 65536 GROUP BY number),
    p AS (SELECT number, string_agg(name, chr(10) ORDER BY name) AS names FROM r GROUP BY number)
    SELECT number, count(*) FILTER (NOT skipped)::BIGINT AS n_files, count(*) FILTER (skipped)::BIGINT AS n_skipped, coalesce(any_value(c.comment), '') AS comment, coalesce(any_value({_stub("'Plan the review of:' || chr(10) || names")}), '') AS plan
    FROM f LEFT JOIN c USING (number) LEFT JOIN p USING (number) GROUP BY number"""
)
def comprehensive_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reviews of parts as files, every fifth of them generated, by the stand-in model."""
    ending = F.when(F.col("p_partkey") % 5 == 0, ".g.cs").otherwise(".md")
    files = table(spark, sf_dir, "part").select(F.col("p_size").alias("number"), F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), ending).alias("name"), F.concat("p_name", F.lit(" "), "p_type").alias("diff"))
    return flows.comprehensive_review(files, models.StubChat()).drop("overview")


@query(f"SELECT item_id, {_stub("'Improve this prompt for yourself:' || chr(10) || text")} AS prompt FROM benchmark")
def better_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", flows.better_prompt(F.col("text"), models.StubChat()).alias("prompt"))
