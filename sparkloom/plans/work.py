"""Queries on pull requests, issues, comments and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import flows, work
from sparkloom.plans.registry import query
from sparkloom.session import table

_COMMITS = """c AS (SELECT l_orderkey AS number, l_orderkey || '-' || l_linenumber AS sha, l_shipdate AS date, CASE WHEN l_linenumber = 2 THEN 'Merge branch x' ELSE 'work' END AS message,
  l_quantity::BIGINT AS additions, (l_quantity * l_discount)::BIGINT AS deletions FROM lineitem)"""
_REVIEWS = """r AS (SELECT event_id AS id, user_id AS number, 'u' || event_id % 5 AS user, ts AS submitted_at, CASE event_type WHEN 'purchase' THEN 'approved' ELSE 'COMMENTED' END AS state FROM events)"""


def _pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("number"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("u"), (F.col("o_custkey") % 5).cast("string")).alias("author"))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("number"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("sha"),
        F.col("l_shipdate").alias("date"),
        F.when(F.col("l_linenumber") == 2, "Merge branch x").otherwise("work").alias("message"),
        F.col("l_quantity").cast("long").alias("additions"),
        F.rint(F.col("l_quantity") * F.col("l_discount")).cast("long").alias("deletions"),
    )


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("number"), F.concat(F.lit("u"), (F.col("event_id") % 5).cast("string")).alias("user"), F.col("ts").alias("submitted_at"), F.when(F.col("event_type") == "purchase", "approved").otherwise("COMMENTED").alias("state"))


@query(
    f"""WITH {_COMMITS}, {_REVIEWS}, a AS (SELECT number, count(*) AS n_commits, count(*) FILTER (message ILIKE 'merge%') AS n_merges, sum(additions)::BIGINT AS additions,
      sum(deletions)::BIGINT AS deletions, max(date) AS last_commit FROM c GROUP BY number),
    b AS (SELECT number, count(*) AS n_reviews, count(*) FILTER (state = 'approved') AS n_approvals, min(submitted_at) FILTER (state = 'approved') AS approved_at FROM r GROUP BY number)
    SELECT o_orderkey AS number, o_orderdate AS created_at, 'u' || o_custkey % 5 AS author, coalesce(n_commits, 0)::BIGINT AS n_commits, coalesce(n_merges, 0)::BIGINT AS n_merges,
      coalesce(additions, 0)::BIGINT AS additions, coalesce(deletions, 0)::BIGINT AS deletions, last_commit, coalesce(n_reviews, 0)::BIGINT AS n_reviews, coalesce(n_approvals, 0)::BIGINT AS n_approvals, approved_at
    FROM orders LEFT JOIN a ON a.number = o_orderkey LEFT JOIN b ON b.number = o_orderkey"""
)
def pr_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.pull_request_facts(_pulls(spark, sf_dir), _commits(spark, sf_dir), _reviews(spark, sf_dir))


@query(
    f"""WITH {_COMMITS}, {_REVIEWS}, a AS (SELECT number, min(submitted_at) FILTER (state = 'approved') AS approved FROM r GROUP BY number)
    SELECT sha, CASE WHEN date <= o_orderdate THEN 'BeforePullRequestCreation' WHEN approved IS NULL OR date <= approved THEN 'BeforePullRequestApproval' ELSE 'AfterPullRequestApproval' END AS phase
    FROM c JOIN orders ON o_orderkey = c.number LEFT JOIN a ON a.number = c.number"""
)
def commit_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _commits(spark, sf_dir).join(_pulls(spark, sf_dir), "number").join(work.first_approval(_reviews(spark, sf_dir)), "number", "left")
    return rows.select("sha", work.commit_phase(F.col("date"), F.col("created_at"), F.col("approved_at")).alias("phase"))


@query(
    f"""WITH {_REVIEWS}, u AS (SELECT number, user, state = 'approved' AS yes FROM r UNION ALL SELECT o_orderkey, 'u' || (o_orderkey % 7), false FROM orders),
    g AS (SELECT number, user, bool_or(yes) AS approved FROM u GROUP BY ALL), k AS (SELECT g.* FROM g ANTI JOIN (SELECT o_orderkey AS number, 'u' || o_custkey % 5 AS user FROM orders) a USING (number, user))
    SELECT *, row_number() OVER (PARTITION BY number ORDER BY NOT approved, user)::INTEGER AS rank FROM k"""
)
def reviewers_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pulls(spark, sf_dir)
    asked = p.select("number", F.concat(F.lit("u"), (F.col("number") % 7).cast("string")).alias("user"))
    return work.reviewers(asked, _reviews(spark, sf_dir), p)


@query(
    f"""WITH {_COMMITS}, a AS (SELECT number % 150 + 1 AS number, max(date) - INTERVAL 400 DAY AS last_commit FROM c GROUP BY 1),
    s AS (SELECT user_id AS number, ts FROM events WHERE event_type = 'signup')
    SELECT a.number, any_value(last_commit) AS last_commit, min(ts) FILTER (ts > last_commit) AS started_at FROM a LEFT JOIN s ON s.number = a.number GROUP BY a.number"""
)
def first_start_after_last_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir).select((F.col("number") % 150 + 1).alias("number"), F.expr("date - INTERVAL 400 DAY").alias("date"))
    comments = table(spark, sf_dir, "events").select(F.col("user_id").alias("number"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "signup", " Start-Process ").otherwise("no").alias("body"))
    return work.first_start_after_commits(comments, commits)


@query(
    """SELECT l1.l_orderkey AS number, 'F' || l1.l_partkey AS name, l2.l_orderkey || '-' || l2.l_linenumber AS sha, l2.l_shipdate AS date
    FROM lineitem l1 JOIN lineitem l2 ON l1.l_orderkey = l2.l_orderkey AND l2.l_partkey IN (l1.l_partkey, l1.l_partkey - 1) GROUP BY ALL"""
)
def commits_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey").cast("string")
    sha = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    commits = li.select(F.col("l_orderkey").alias("number"), sha.alias("sha"), F.col("l_shipdate").alias("date"), F.array(F.concat(F.lit("f"), part)).alias("files"))
    files = li.select(F.col("l_orderkey").alias("number"), F.concat(F.lit("F"), part).alias("name"), F.concat(F.lit("F"), (F.col("l_partkey") - 1).cast("string")).alias("previous"))
    return work.commits_of_file(commits, files)


@query(
    """WITH e AS (SELECT l_orderkey AS number, l_linenumber AS pos, 'f' || l_partkey AS filename, CASE WHEN l_linenumber % 2 = 0 THEN 'old' || l_partkey ELSE '' END AS previous FROM lineitem),
    n AS (SELECT *, filename AS name FROM e UNION ALL SELECT *, previous FROM e WHERE previous <> ''),
    f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY number, name ORDER BY pos) = 1)
    SELECT l_orderkey AS number, 'f' || l_partkey AS name, coalesce(nullif(f.previous, ''), f.filename, 'f' || l_partkey) AS base_path, coalesce(f.filename, 'f' || l_partkey) AS head_path
    FROM lineitem LEFT JOIN f ON f.number = l_orderkey AND f.name = 'f' || l_partkey"""
)
def base_and_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey").cast("string")
    name = F.concat(F.lit("f"), part)
    compared = li.select(F.col("l_orderkey").alias("number"), F.col("l_linenumber").alias("pos"), name.alias("filename"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("old"), part)).otherwise("").alias("previous_filename"))
    return work.base_and_head(li.select(F.col("l_orderkey").alias("number"), name.alias("name")), compared)


@query(
    """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'E' || o_custkey END AS epic_key, coalesce(c_name, '') AS epic_name, coalesce(c_mktsegment, '') AS epic_segment
    FROM orders LEFT JOIN customer ON o_orderkey % 5 <> 0 AND o_custkey = c_custkey"""
)
def issue_epic_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("E"), F.col("o_custkey").cast("string"))).alias("epic_key"))
    epics = table(spark, sf_dir, "customer").select(F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return work.filled(work.with_epics(issues, epics))


@query(
    """SELECT event_id AS key, 'u' || user_id AS assignee, CASE event_type WHEN 'view' THEN 'Closed' ELSE event_type END AS status FROM events
    WHERE event_id % 2 = 0 AND event_type <> 'view' AND user_id IN (1, 2, 3)"""
)
def open_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    issues = e.select(F.col("event_id").alias("key"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("assignee"), F.when(F.col("event_type") == "view", "Closed").otherwise(F.col("event_type")).alias("status"), F.when(F.col("event_id") % 2 == 0, "Incident").otherwise("Task").alias("type"))
    return work.open_defects(issues, ["u1", "u2", "u3"]).drop("type")


@query("SELECT n_nationkey AS suite_id, n_name AS suite, s_suppkey AS case_id, s_name AS title, 'R' || s_suppkey % 3 || ', R9' AS refs FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 1")
def suite_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    suites = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("suite_id"), F.col("n_name").alias("suite"))
    cases = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("suite_id"), F.col("s_suppkey").alias("case_id"), F.col("s_name").alias("title"), F.format_string("R%d, R9", F.col("s_suppkey") % 3).alias("refs"))
    return work.suite_cases(suites, cases, "R1")


@query(
    """WITH w AS (SELECT DISTINCT conv_id AS number FROM conversations), e AS (SELECT conv_id AS number, min(turn) AS existing_id FROM conversations WHERE turn % 3 = 1 GROUP BY 1)
    SELECT number, 'new' AS body, existing_id, CASE WHEN existing_id IS NULL THEN 'add' ELSE 'update' END AS action FROM w LEFT JOIN e USING (number)"""
)
def marked_comment_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    comments = c.select(F.col("conv_id").alias("number"), F.col("turn").alias("id"), F.col("role").alias("user"), F.concat(F.when(F.col("turn") % 3 == 1, "<!-- AI Overview --> ").otherwise(""), F.coalesce("text", F.lit(""))).alias("body"))
    wanted = c.select(F.col("conv_id").alias("number")).distinct().withColumn("body", F.lit("new"))
    return work.marked_upsert(wanted, comments, "<!-- ai overview -->")


@query(
    """WITH r AS (SELECT user_id AS number, max(ts) AS last_commit FROM events GROUP BY 1), c AS (SELECT user_id AS number, max(ts) AS cached_commit FROM events WHERE event_id % 3 <> 0 GROUP BY 1)
    SELECT 'repo' AS repo, r.number, last_commit, cached_commit, coalesce(cached_commit >= last_commit, false) AS reuse FROM r LEFT JOIN c USING (number)"""
)
def cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    asked = e.groupBy(F.lit(" Repo").alias("repo"), F.col("user_id").alias("number")).agg(F.max("ts").alias("last_commit"))
    cache = e.filter("event_id % 3 <> 0").groupBy(F.lit("REPO ").alias("repo"), F.col("user_id").alias("number")).agg(F.max("ts").alias("cached_commit"))
    return work.fresh_results(asked, cache)


@query("SELECT event_id, ts > TIMESTAMP '2024-01-20 00:10:00' - INTERVAL 10 MINUTE AS fresh, NOT (ts > TIMESTAMP '2024-01-20 00:10:00' - INTERVAL 10 MINUTE) AS inverted FROM events")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20 00:10:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", work.within_ttl(F.col("ts"), now).alias("fresh"), work.within_ttl(F.col("ts"), now, inverted=True).alias("inverted"))


@query(
    """WITH f AS (SELECT l_orderkey AS pr, l_linenumber AS file, (l_suppkey % 4)::BIGINT AS risk, (1 << (l_linenumber - 1))::INTEGER AS min_class FROM lineitem)
    SELECT *, row_number() OVER (PARTITION BY pr ORDER BY risk, min_class, file)::INTEGER AS place FROM f"""
)
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("pr"), F.col("l_linenumber").alias("file"), (F.col("l_suppkey") % 4).alias("risk"), F.expr("shiftleft(1, l_linenumber - 1)").alias("min_class"))
    return work.review_order(rows)


@query("SELECT l_returnflag AS change_type, count(*)::BIGINT AS n, sum(l_quantity)::BIGINT AS additions, count(DISTINCT l_partkey)::BIGINT AS files FROM lineitem GROUP BY 1")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("change_type")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("additions"), F.countDistinct("l_partkey").alias("files"))


@query(
    r"""SELECT page_id AS key, unnest(list_distinct(list_filter(list_concat(['https://wiki.example.org/d'], list_transform(regexp_extract_all('see ' || url || '.', 'https?://[^\s<>"''\])}]+'), lambda x: rtrim(x, '.,;:!?'))), lambda x: x IS NOT NULL))) AS url FROM pages"""
)
def issue_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.concat(F.lit("see "), "url", F.lit(".")).alias("summary"), F.array(F.lit("https://wiki.example.org/d")).alias("declared"))
    return work.links_of(issues, "summary", declared="declared")


_LINKS = r"""u(t, key, text) AS (SELECT 'i', page_id, 'see ' || url || '. ' || html FROM pages UNION ALL SELECT 'i', i.page_id, e.url FROM pages i JOIN pages e ON e.page_id = i.page_id // 10 * 10
      UNION ALL SELECT 'c', conv_id, text || ' (http://talk.example.org/' || turn || ').' FROM conversations),
    l AS (SELECT DISTINCT key, url FROM (SELECT key, unnest(list_transform(regexp_extract_all(text, 'https?://[^\s<>"''\])}]+'), lambda x: rtrim(x, '.,;:!?'))) AS url FROM u) WHERE regexp_matches(url, '^https?://[^/]'))"""


def _issue_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages as issues, every tenth as the epic of those after it, and turns of conversations as comments on them."""
    p, c = table(spark, sf_dir, "pages"), table(spark, sf_dir, "conversations")
    key = lambda n: F.concat(F.lit("E"), n.cast("string"))
    tenth = F.floor(F.col("page_id") / 10) * 10
    issues = p.select(F.col("page_id").alias("key"), key(tenth).alias("epic_key"), F.lit(None).cast("string").alias("declared"), F.concat(F.lit("see "), "url", F.lit(".")).alias("summary"), F.col("html").alias("description"))
    epics = p.filter("page_id % 10 = 0").select(key(F.col("page_id")).alias("key"), F.col("url").alias("declared"))
    comments = c.select(F.col("conv_id").alias("key"), F.col("turn").alias("id"), F.concat("text", F.lit(" (http://talk.example.org/"), F.col("turn").cast("string"), F.lit(").")).alias("body"))
    return issues, epics, comments


@query(f"WITH {_LINKS} SELECT key, url FROM l")
def issue_links_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of issues, of their epics and of their comments, out of whole pages and turns."""
    issues, epics, comments = _issue_tables(spark, sf_dir)
    return work.all_links(issues, comments, epics)


@query(
    f"""WITH {_LINKS}, c AS (SELECT conv_id AS key, string_agg(text || ' (http://talk.example.org/' || turn || ').', chr(10) ORDER BY turn) AS comments, count(*) AS n FROM conversations GROUP BY 1),
    k AS (SELECT key, string_agg(url, ' ' ORDER BY url) AS links FROM l GROUP BY 1)
    SELECT page_id AS key, 'E' || (page_id // 10 * 10) AS epic_key, coalesce(e.url, '') AS epic_declared, coalesce(c.comments, '') AS comments, coalesce(c.n, 0)::BIGINT AS n_comments, coalesce(k.links, '') AS links
    FROM pages p LEFT JOIN (SELECT page_id AS e, url FROM pages) e ON e.e = page_id // 10 * 10 LEFT JOIN c ON c.key = page_id LEFT JOIN k ON k.key = page_id"""
)
def issue_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with all that is told of them, as one call."""
    issues, epics, comments = _issue_tables(spark, sf_dir)
    docs = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("title"))
    found = work.issue_information(issues, epics, comments, docs)
    return found.select("key", "epic_key", "epic_declared", F.array_join("comments", "\n").alias("comments"), F.size("comments").cast("long").alias("n_comments"), F.array_join("links", " ").alias("links"))


@query("SELECT DISTINCT s_suppkey AS case_id, s_name AS title, s_nationkey AS suite_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def cases_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by their numbers, as all lines ask for them."""
    cases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("suite_id"))
    return work.cases_asked(cases, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("case_id")))


@query(
    """WITH f AS (SELECT p_size AS number, 'f' || p_partkey AS name, p_name || ' ' || p_type AS diff FROM part)
    SELECT number, string_agg(name || chr(10) || coalesce(diff, ''), chr(10) || chr(10) ORDER BY name) AS diff, count(*)::BIGINT AS n_files FROM f GROUP BY number"""
)
def full_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("number"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.concat("p_name", F.lit(" "), "p_type").alias("diff"))
    return work.full_diff(p)


@query(
    """WITH f AS (SELECT l_orderkey AS pr, (l_suppkey % 4)::INTEGER AS risk, 1 << (l_linenumber - 1) AS min_class, 'f' || l_linenumber AS file,
      concat('### ', CASE l_suppkey % 4 WHEN 0 THEN '⚪' WHEN 1 THEN '🟢' WHEN 2 THEN '🟡' ELSE '🔴' END, ' `f', l_linenumber, '`', chr(10), 'fine', chr(10), '- part ', l_partkey) AS text FROM lineitem),
    t AS (SELECT *, sum(length(text) + 4) OVER (PARTITION BY pr ORDER BY risk, min_class, file, text ROWS UNBOUNDED PRECEDING) - 4 AS total FROM f)
    SELECT pr, string_agg(text, chr(10) || chr(10) || chr(10) || chr(10) ORDER BY risk, min_class, file, text) AS comment, count(*)::BIGINT AS n_files FROM t WHERE total <= 120 GROUP BY pr"""
)
def review_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    risk, file = (F.col("l_suppkey") % 4).cast("int"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))
    text = flows.file_review(file, F.lit(" fine "), risk, F.array(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))))
    rows = li.select(F.col("l_orderkey").alias("pr"), risk.alias("risk"), F.expr("shiftleft(1, l_linenumber - 1)").alias("min_class"), file.alias("file"), text.alias("text"))
    return flows.review_comment(rows, most=120)


@query(
    """SELECT o_orderkey AS number, 'ISW-' || o_orderkey || ' done' AS title, CASE WHEN o_orderkey % 2 = 0 THEN '<!-- Overview --> ' || o_orderkey END AS overview, ['ISW-' || o_orderkey] AS issues FROM orders"""
)
def pull_request_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey").cast("string")
    pulls = o.select(F.col("o_orderkey").alias("number"), F.concat(F.lit("ISW-"), i, F.lit(" done")).alias("title"), F.lit("x").alias("_internal"))
    comments = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("number"), F.col("o_custkey").alias("id"), F.concat(F.lit("<!-- Overview --> "), i).alias("body"))
    return flows.pull_request_view(pulls, comments, "<!-- overview -->")
