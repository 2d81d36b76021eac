"""Issues, reviews, comments and caches: joins, precedence and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import has_marker, is_merge, is_start_process, page_id_of, urls_of


def with_epics(issues: DataFrame, epics: DataFrame, key: str = "epic_key") -> DataFrame:
    """Issues with their epics (key, and other columns prefixed epic_); an empty key has none."""
    own = epics.select(F.col("key").alias("_k"), *(F.col(c).alias(f"epic_{c}") for c in epics.columns if c != "key"))
    return issues.join(own, F.nullif(F.col(key), F.lit("")) == F.col("_k"), "left").drop("_k")


def filled(rows: DataFrame, *names: str) -> DataFrame:
    """With empty strings for nulls in the named columns, or in all of strings."""
    chosen = names or [c for c, kind in rows.dtypes if kind == "string"]
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in chosen})


def open_defects(issues: DataFrame, users: list[str], closed: tuple[str, ...] = ("Closed", "Done", "Resolved")) -> DataFrame:
    """Incidents of the users that are not closed, by assignee and status; none for no users."""
    if not users:
        return issues.limit(0)
    return issues.filter((F.col("type") == "Incident") & ~F.col("status").isin(*closed) & F.col("assignee").isin(*users)).orderBy("assignee", "status", "key")


def sprint(sprints: DataFrame, state: str | None = None, name: str | None = None) -> DataFrame:
    """The first sprint in a state, or of a name in any case."""
    chosen = sprints.filter(F.col("state") == state) if state else sprints
    chosen = chosen.filter(F.lower("name") == name.lower()) if name else chosen
    return chosen.orderBy("id").limit(1)


def links_of(issues: DataFrame, *texts: str, declared: str | None = None) -> DataFrame:
    """key and each address that an issue declares or its texts hold, once."""
    arrays = ([F.coalesce(F.col(declared), F.array().cast("array<string>"))] if declared else []) + [F.coalesce(urls_of(F.col(t)), F.array().cast("array<string>")) for t in texts]
    return issues.select("key", F.explode(F.array_distinct(F.concat(*arrays))).alias("url"))


def all_links(issues: DataFrame, comments: DataFrame, epics: DataFrame, declared: str = "declared") -> DataFrame:
    """key and each address of an issue, once: those that it declares (a text), that its epic declares, and that its summary,
    description and comments hold. issues: key, epic_key, declared, summary, description; comments: key, body; epics: key,
    declared. Each side's addresses come together by key alone, so no text is shuffled."""
    each = lambda rows, key, *texts: rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.concat(*(F.coalesce(urls_of(F.col(t)), F.array().cast("array<string>")) for t in texts)))).alias("url"))
    epic = each(epics, "key", declared).withColumnsRenamed({"key": "_e"})
    of_epics = issues.select("key", F.nullif("epic_key", F.lit("")).alias("_e")).join(epic, "_e").select("key", "url")
    return each(issues, "key", declared, "summary", "description").unionByName(of_epics).unionByName(each(comments, "key", "body")).distinct()


def issue_information(issues: DataFrame, epics: DataFrame, comments: DataFrame, docs: DataFrame) -> DataFrame:
    """All that is told of issues in one row each: the issue with its epic, its comments in order (key, id, body), its links, and
    the titles of the documents (page_id, title) that they lead to. Empty arrays where there is nothing."""
    links = all_links(issues, comments, epics)
    found = links.withColumn("page_id", page_id_of(F.col("url")).cast("long")).join(docs.select("page_id", "title"), "page_id")
    parts = {
        "comments": comments.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "body"))), lambda x: x["body"]).alias("comments")),
        "links": links.groupBy("key").agg(F.sort_array(F.collect_list("url")).alias("links")),
        "documents": found.groupBy("key").agg(F.sort_array(F.collect_set("title")).alias("documents")),
    }
    out = filled(with_epics(issues, epics))
    for name, rows in parts.items():
        out = out.join(rows, "key", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def full_diff(files: DataFrame, by: str = "number") -> DataFrame:
    """Each pull request's files (name, diff) as one text in order of their names, the file's name before its diff."""
    each = F.array_sort(F.collect_list(F.struct("name", F.coalesce("diff", F.lit("")).alias("diff"))))
    return files.groupBy(by).agg(F.array_join(F.transform(each, lambda x: F.concat(x["name"], F.lit("\n"), x["diff"])), "\n\n").alias("diff"), F.count("*").alias("n_files"))


def cases_asked(cases: DataFrame, asked: DataFrame, key: str = "case_id") -> DataFrame:
    """The cases that are asked for by their number, each once; one that is not there is an error."""
    missing = F.raise_error(F.concat(F.lit("no case "), F.col("_a").cast("string")))
    found = asked.select(F.col(key).alias("_a")).distinct().join(cases, F.col("_a") == F.col(key), "left")
    return found.withColumn(key, F.coalesce(F.col(key), missing.cast(cases.schema[key].dataType))).drop("_a")


def commit_phase(date: Column, created: Column, approved: Column) -> Column:
    """Whether a commit came before a pull request was made, before its first approval, or after."""
    return F.when(date <= created, "BeforePullRequestCreation").when(approved.isNull() | (date <= approved), "BeforePullRequestApproval").otherwise("AfterPullRequestApproval")


def first_approval(reviews: DataFrame, by: str = "number") -> DataFrame:
    approved = F.upper("state") == "APPROVED"
    return reviews.groupBy(by).agg(F.min(F.when(approved, F.col("submitted_at"))).alias("approved_at"))


def reviewers(requested: DataFrame, reviews: DataFrame, author: DataFrame, by: str = "number") -> DataFrame:
    """Each user asked to review or who did, once, without the author: whether they approved. Those who did come first,
    in rank."""
    asked = requested.select(by, "user", F.lit(False).alias("yes"))
    did = reviews.select(by, "user", (F.upper("state") == "APPROVED").alias("yes"))
    each = asked.unionByName(did).groupBy(by, "user").agg(F.bool_or("yes").alias("approved"))
    each = each.join(author.select(by, F.col("author").alias("user")), [by, "user"], "left_anti")
    w = Window.partitionBy(by).orderBy(F.when(F.col("approved"), 0).otherwise(1), "user")
    return each.withColumn("rank", F.row_number().over(w))


def first_start_after_commits(comments: DataFrame, commits: DataFrame, by: str = "number") -> DataFrame:
    """When a comment first asked for the process after the last commit."""
    last = commits.groupBy(by).agg(F.max("date").alias("last_commit"))
    after = comments.filter(is_start_process(F.col("body"))).join(last, by).filter("created_at > last_commit")
    return last.join(after.groupBy(by).agg(F.min("created_at").alias("started_at")), by, "left")


def commits_of_file(commits: DataFrame, files: DataFrame, by: str = "number") -> DataFrame:
    """Commits (number, sha, files array<string>) that touched a file (number, name, previous) under either name, in any
    case: names are exploded and joined by equality."""
    # dealt by the join's keys, each side loses its repeats where it lies, without another shuffle
    touched = commits.select(by, "sha", "date", F.explode(F.array_distinct(F.transform("files", lambda f: F.lower(f)))).alias("_n")).repartition(by, "_n").distinct()
    either = F.array_distinct(F.array_compact(F.array(F.lower("name"), F.lower(F.nullif(F.col("previous"), F.lit(""))))))
    names = files.select(by, "name", F.explode(either).alias("_n")).repartition(by, "_n").distinct()
    return names.join(touched, [by, "_n"]).select(by, "name", "sha", "date").distinct()


def base_and_head(files: DataFrame, compared: DataFrame, by: str = "number") -> DataFrame:
    """Paths of a file (number, name) on both sides, by the first entry of a comparison (number, pos, filename,
    previous_filename) that has it under either name."""
    each = compared.select(by, "pos", "filename", "previous_filename", F.explode(F.array_distinct(F.array_compact(F.array("filename", F.nullif(F.col("previous_filename"), F.lit("")))))).alias("name"))
    w = Window.partitionBy(by, "name").orderBy("pos")
    first = each.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    joined = files.join(first, [by, "name"], "left")
    return joined.select(by, "name", F.coalesce(F.nullif(F.col("previous_filename"), F.lit("")), F.col("filename"), F.col("name")).alias("base_path"), F.coalesce("filename", "name").alias("head_path"))


def marked_upsert(wanted: DataFrame, comments: DataFrame, marker: str, by: str = "number", same_user: str | None = None) -> DataFrame:
    """What to do with a comment that carries a marker: wanted (number, body), with the action add or update and the id
    of the first comment that begins with the marker in any case (and is the user's, if one is named)."""
    own = comments.filter(has_marker(F.col("body"), marker))
    own = own.filter(F.col("user") == same_user) if same_user else own
    first = own.groupBy(by).agg(F.min("id").alias("existing_id"))
    return wanted.join(first, by, "left").withColumn("action", F.when(F.col("existing_id").isNull(), "add").otherwise("update"))


def fresh_results(requests: DataFrame, cache: DataFrame, by: tuple[str, ...] = ("repo", "number")) -> DataFrame:
    """Requests (repo, number, last_commit) and whether a cached result (with cached_commit) is as new; without either
    date it is not. Names of repositories compare without case or blanks around them."""
    own = cache.withColumn("repo", F.lower(F.trim("repo")))
    asked = requests.withColumn("repo", F.lower(F.trim("repo")))
    return asked.join(own, list(by), "left").withColumn("reuse", F.coalesce(F.col("cached_commit") >= F.col("last_commit"), F.lit(False)))


def within_ttl(created: Column, now: Column, minutes: int = 10, inverted: bool = False) -> Column:
    """Whether a cache entry may be used: it is younger than so many minutes, or older if inverted."""
    young = created > now - F.make_dt_interval(mins=F.lit(minutes))
    return ~young if inverted else young


def pull_request_facts(pulls: DataFrame, commits: DataFrame, reviews: DataFrame, by: str = "number") -> DataFrame:
    """Pull requests with counts of commits, merges, changed lines, reviews and approvals, and first approval."""
    c = commits.groupBy(by).agg(F.count("*").alias("n_commits"), F.count_if(is_merge(F.col("message"))).alias("n_merges"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.max("date").alias("last_commit"))
    r = reviews.groupBy(by).agg(F.count("*").alias("n_reviews"), F.count_if(F.upper("state") == "APPROVED").alias("n_approvals"), F.min(F.when(F.upper("state") == "APPROVED", F.col("submitted_at"))).alias("approved_at"))
    out = pulls.join(c, by, "left").join(r, by, "left")
    return out.fillna(0, ["n_commits", "n_merges", "additions", "deletions", "n_reviews", "n_approvals"])


def suite_cases(suites: DataFrame, cases: DataFrame, refs: str | None = None) -> DataFrame:
    """Cases of every suite, those that refer to an issue if one is named. Cases in several suites come several times."""
    chosen = cases.filter(F.array_contains(F.split("refs", r"\s*,\s*"), refs)) if refs else cases
    return suites.join(chosen, "suite_id")


def review_order(files: DataFrame, by: str = "pr") -> DataFrame:
    """Reviews with their place within a pull request: by risk, then by the lowest class, then by file."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("risk", "min_class", "file")))


def file_order(files: DataFrame, by: str = "number") -> DataFrame:
    """Files (class, name, diff) with their place by class and by the length of the diff, the longest first."""
    w = Window.partitionBy(by)
    return files.withColumn("by_class", F.row_number().over(w.orderBy("class", "name"))).withColumn("by_length", F.row_number().over(w.orderBy(F.desc(F.length("diff")), "name")))


def commit_order(commits: DataFrame, by: str = "number") -> DataFrame:
    """Commits (sha, date) with their place by author date, the oldest first, and the newest first. One sort gives both, so
    rows that are equal in both have the same places in either order, whichever of them comes first."""
    w = Window.partitionBy(by)
    oldest = commits.withColumn("oldest_first", F.row_number().over(w.orderBy("date", "sha")))
    return oldest.withColumn("newest_first", (F.count("*").over(w) - F.col("oldest_first") + 1).cast("int"))


def in_time_order(rows: DataFrame, time: str, *columns: str, by: str = "number") -> DataFrame:
    """Of each pull request an array of its reviews or comments, the oldest first; ties in order of the columns."""
    listed = F.array_sort(F.collect_list(F.struct(time, *columns)))
    return rows.groupBy(by).agg(listed.alias("entries"))


def with_diffs(files: DataFrame, diffs: DataFrame, by: tuple[str, ...] = ("number", "name")) -> DataFrame:
    """Files with their diffs (column diff), one to one: a file that is named twice, or has no diff or several, is an error."""
    own = files.withColumn("_m", F.count("*").over(Window.partitionBy(*by)))
    held = diffs.groupBy(*by).agg(F.count("*").alias("_n"), F.first("diff").alias("_d"))
    joined = own.join(held, list(by), "left")
    wrong = F.raise_error(F.concat(F.lit("no single diff for "), F.col(by[-1]).cast("string")))
    return joined.withColumn("diff", F.when((F.col("_m") == 1) & (F.col("_n") == 1), F.col("_d")).otherwise(wrong)).drop("_m", "_n", "_d")


def changed_files(added: DataFrame, modified: DataFrame, deleted: DataFrame) -> DataFrame:
    """All files of a change, those added first, with what was done to them."""
    parts = [(added, "Added"), (modified, "Modified"), (deleted, "Deleted")]
    first, *rest = (rows.withColumn("change", F.lit(name)) for rows, name in parts)
    for rows in rest:
        first = first.unionByName(rows)
    return first


def with_content(reviews: DataFrame, text: str = "review", comments: str = "comments") -> DataFrame:
    """Reviews that say something: in their text or in comments on lines."""
    nothing = (F.trim(F.coalesce(text, F.lit(""))) == "") & (F.coalesce(F.size(comments), F.lit(0)) <= 0)
    return reviews.filter(~nothing)


def comments_by_line(comments: DataFrame, *by: str) -> DataFrame:
    """The comments (id, body) on each line as a list, in order of their ids."""
    listed = F.array_sort(F.collect_list(F.struct("id", "body")))
    return comments.groupBy(*by, "line").agg(F.transform(listed, lambda x: x["body"]).alias("bodies"))


def change_counts(files: DataFrame) -> DataFrame:
    """How many files each class of change has, in order of the class."""
    return files.groupBy("change_type").agg(F.count("*").alias("n")).orderBy("change_type")


def touched(files: DataFrame, commits: DataFrame, by: str = "number") -> DataFrame:
    """Files (number, name), and whether any commit (number, files) touches that name, in any case."""
    names = commits.select(by, F.explode("files").alias("_f")).select(by, F.lower("_f").alias("_f"), F.lit(True).alias("_t")).distinct()
    keyed = files.withColumn("_f", F.lower("name"))
    return keyed.join(names, [by, "_f"], "left").withColumn("touched", F.coalesce("_t", F.lit(False))).drop("_f", "_t")


def lookup(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """What is known of each key that is asked for, nulls if nothing is. Keys compare without blanks around them and in
    any case."""
    bare = lambda c: F.lower(F.trim(c))
    known = rows.withColumnRenamed(key, "_known").withColumn("_k", bare(F.col("_known")))
    return keys.select(F.col(key)).join(known, bare(F.col(key)) == F.col("_k"), "left").drop("_k", "_known")


def sprint_issues(issues: DataFrame, sprints: DataFrame, state: str = "active", users: list[str] | None = None) -> DataFrame:
    """Issues of the sprints in a state, of the users if any are named (none for an empty list)."""
    if users is not None:
        issues = issues.filter(F.col("assignee").isin(*users)) if users else issues.limit(0)
    return issues.join(sprints.filter(F.col("state") == state).select("sprint_id"), "sprint_id", "left_semi")


def linked_documents(issues: DataFrame, docs: DataFrame, *texts: str, declared: str | None = None) -> DataFrame:
    """Issues' keys with the documents (page_id, title) that their addresses name by page."""
    links = links_of(issues, *texts, declared=declared).withColumn("page_id", page_id_of(F.col("url")).cast("long"))
    return links.join(docs.select("page_id", "title"), "page_id")


def nested(pulls: DataFrame, by: tuple[str, ...] = ("repo", "number"), **parts: DataFrame) -> DataFrame:
    """Pull requests with all that was read for them: an array for each named part (comments, reviews, commits, files; all
    with the columns of by and a column at that orders them), empty where there is nothing."""
    out = pulls
    for name, rows in parts.items():
        own = F.struct("at", *(c for c in rows.columns if c not in (*by, "at")))
        listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(own)).alias(name))
        out = out.join(listed, list(by), "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out
