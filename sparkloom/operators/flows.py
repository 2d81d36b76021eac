"""Whole flows out of single operators: answering a question from the wiki, reviewing a pull request, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import COMMENT_CHARS, has_marker, issue_keys
from sparkloom.functions.triage import triage
from sparkloom.operators import blocks, models, packing, vector
from sparkloom.operators.ranks import first_rows
from sparkloom.storage import materialize

# Signs of a review's risk, from none to high.
RISK_SIGNS = ("⚪", "🟢", "🟡", "🔴")


def search_series(samples: DataFrame, queries: DataFrame, threshold: float = 0.6, most: int = vector.MOST, candidates: int = vector.CANDIDATES, each: str | None = None) -> DataFrame:
    """Best documents of every series asked for: samples (series, sampling, doc_id, vec), queries (series, query). The
    ranks are limits within a series, which Spark applies in each task before the shuffle, so a large series is cut to its
    candidates where it lies. With each, a column of queries, a series is ranked for each of its queries, without the sample
    whose key is the query's own."""
    by = ["series", each] if each else ["series"]
    if each:
        scored = blocks.near(samples, queries, candidates, each, by=("series",)).withColumn("similarity", F.round("similarity", 6))
    else:
        scored = samples.join(queries, "series").withColumn("similarity", vector.similarity(F.col("vec"), F.col("query"))).drop("vec", "query")
    order = (F.desc_nulls_last("similarity"), "sampling")
    near = first_rows(scored, order, candidates, *by)
    good = first_rows(near, order, 1, *by, "doc_id").filter(F.col("similarity") >= threshold)
    return first_rows(good, order, most, *by, rank="place")


def answer(hits: DataFrame, docs: DataFrame, question: str, endpoint: models.Chat) -> DataFrame:
    """One answer for each series from the documents (doc_id, text) that were found, best first; a series without any has
    no row. A document may have nothing to say, and is then left out."""
    asked = hits.join(docs.select("doc_id", "text"), "doc_id")
    each = asked.withColumn("answer", models.complete(F.concat(F.lit(f"Question: {question}\n"), F.coalesce("text", F.lit(""))), endpoint))
    return models.merge(each, "series", "place", "answer", endpoint)


def file_review(file: Column, review: Column, risk: Column, focus: Column) -> Column:
    """A file's review as Markdown; risk from 0 to 3, focus: what to look at."""
    sign = F.get(F.array(*map(F.lit, RISK_SIGNS)), risk)
    points = F.when(F.size(focus) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(focus, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    return F.concat(F.lit("### "), sign, F.lit(" `"), file, F.lit("`\n"), F.trim(F.coalesce(review, F.lit(""))), points)


def review_comment(files: DataFrame, by: str = "pr", most: int = COMMENT_CHARS) -> DataFrame:
    """A pull request's comment from its files' reviews (risk, min_class, file, text): the riskiest class first as far as
    the comment's size allows."""
    kept = packing.truncate(files.withColumn("_size", F.length("text")), "_size", (F.col("risk"), F.col("min_class"), F.col("file"), F.col("text")), most, by=(by,))
    listed = F.array_sort(F.collect_list(F.struct("risk", "min_class", "file", "text")))
    return kept.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n\n\n").alias("comment"), F.count("*").alias("n_files"))


def pull_request_view(pulls: DataFrame, comments: DataFrame, marker: str, by: str = "number", prefix: str = "ISW") -> DataFrame:
    """Pull requests with their linked issues and the first comment that carries the marker, without internal columns."""
    own = comments.filter(has_marker(F.col("body"), marker)).groupBy(by).agg(F.min_by("body", "id").alias("overview"))
    return pulls.join(own, by, "left").withColumn("issues", issue_keys(F.col("title"), prefix)).drop(*[c for c in pulls.columns if c.startswith("_")])


def as_json(rows: DataFrame, *hidden: str) -> DataFrame:
    """Rows as JSON texts without the hidden columns."""
    return rows.drop(*hidden).select(F.to_json(F.struct("*")).alias("json"))


# Classes of a change by how much review they need, the most first.
CLASSES = ("logic", "interface", "tests", "formatting")
CLASSIFIED = "class string, reason string"
COMMENTS = "array<struct<line:int,text:string>>"


def search_query(question: Column, endpoint: models.Chat) -> Column:
    """struct(query, optimised): the question as it is searched for, and as a model would put it, which is only reported."""
    return F.struct(question.alias("query"), models.complete(F.concat(F.lit("Put as a search query:\n"), question), endpoint).alias("optimised"))


def background_samples(samples: DataFrame, index: DataFrame, endpoint: models.Chat) -> DataFrame:
    """Backgrounds (series, title, sample) that the index does not have yet, in a model's words; those it has are not asked
    for again."""
    fresh = samples.join(index.select("series", "title").distinct(), ["series", "title"], "left_anti")
    prompt = F.concat(F.lit("Rephrase the background of "), "title", F.lit(":\n"), "sample")
    return fresh.withColumn("background", models.complete(prompt, endpoint))


def _is_class(prompt: str, answer: str) -> bool:
    import json

    try:
        found = json.loads(answer[answer.find("{") : answer.rfind("}") + 1])
    except ValueError:
        return False
    return isinstance(found, dict) and found.get("class") in CLASSES


def classify_files(files: DataFrame, endpoint: models.Chat, tries: int = models.TRIES) -> DataFrame:
    """Files (name, diff) with their class and the reason for it. What a model does not classify in so many tries needs the
    most review."""
    prompt = F.concat(F.lit("Classify "), "name", F.lit("\n"), F.coalesce("diff", F.lit("")))
    answer = models.accepted(prompt, endpoint, _is_class, tries)
    found = files.withColumn("_c", F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), CLASSIFIED))
    return found.withColumn("class", F.coalesce("_c.class", F.lit(CLASSES[0]))).withColumn("reason", F.coalesce("_c.reason", F.lit("not classified"))).drop("_c")


def overview(files: DataFrame, endpoint: models.Chat, limit: int, by: str = "number", finals: tuple[str, ...] = ("Shorten:",)) -> DataFrame:
    """One overview of each pull request from its files' summaries (name, summary): packed into contexts in order of their
    names, a draft of the first and a refinement for each that follows, and final prompts."""
    listed = F.array_sort(F.collect_list(F.struct("name", "summary")))
    rows = files.groupBy(by).agg(F.transform(listed, lambda x: x["summary"]).alias("texts"))
    rows = rows.withColumn("bin", packing.bins(F.transform("texts", lambda x: F.octet_length(x)), limit))
    texts = F.transform(F.array_distinct("bin"), lambda b: F.array_join(F.transform(F.filter(F.arrays_zip("texts", "bin"), lambda x: x["bin"] == b), lambda x: x["texts"]), "\n"))
    # an exchange of its own, since Spark does not take a Python function out of what it folds into the aggregate; it also
    # spreads the calls
    packed = rows.select(by, texts.alias("contexts")).repartition(F.col(by))
    return packed.select(by, models.refined(F.col("contexts"), endpoint, "Draft:", "Refine:", finals).alias("overview"))


def _on_lines(prompt: str, answer: str) -> bool:
    import json
    import re

    marks = {int(x) for x in re.findall(r"^\[L(\d+)\]", prompt, re.M)}
    try:
        found = json.loads(answer[answer.find("[") : answer.rfind("]") + 1])
        return all(x["line"] in marks and str(x["text"]).strip() for x in found)
    except (ValueError, TypeError, KeyError):
        return False


def line_comments(files: DataFrame, endpoint: models.Chat, tries: int = models.TRIES) -> DataFrame:
    """Comments (line, text) on files whose diff has markers; an answer with a line that the diff does not have is asked for
    again, and a file without a valid answer has no comments."""
    answer = models.accepted(F.concat(F.lit("Review "), "name", F.lit("\n"), "diff"), endpoint, _on_lines, tries)
    comments = F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), COMMENTS)
    return files.select(*(c for c in files.columns if c != "diff"), F.explode(comments).alias("_x")).select("*", "_x.line", "_x.text").drop("_x")


def review_plan(files: DataFrame, endpoint: models.Chat, worst: int, by: str = "number") -> DataFrame:
    """A plan for the review of each pull request, over its files of no lower class (min_class) than so much."""
    asked = files.filter(F.col("min_class") <= worst)
    listed = F.array_sort(F.collect_list(F.struct("min_class", "name")))
    rows = asked.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["name"]), "\n").alias("_names"))
    return rows.select(by, models.complete(F.concat(F.lit("Plan the review of:\n"), "_names"), endpoint).alias("plan"))


def comprehensive_review(files: DataFrame, endpoint: models.Chat, worst: int = 1, limit: int = 32_768, by: str = "number") -> DataFrame:
    """The whole review of pull requests from their files (number, name, diff), as one call: files that triage finds need none
    are passed over; the others are classified and reviewed, and of their reviews come a comment, an overview and a plan. A row
    for each pull request: n_files (reviewed), n_skipped, comment, overview, plan; empty texts where no file was reviewed. What a
    model says of a file is written to a table, so that it is asked once."""
    judged = files.withColumn("_t", triage(F.col("name"), F.col("diff")))
    skipped = F.coalesce(~F.col("_t.filter"), F.lit(False))
    judged = materialize(judged.select(by, "name", F.coalesce("diff", F.lit("")).alias("diff"), skipped.alias("skipped")), "triage")
    classed = classify_files(judged.filter("not skipped"), endpoint)
    level = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")).cast("int") - 1
    said = models.complete(F.concat(F.lit("Review "), "name", F.lit("\n"), "diff"), endpoint)
    done = materialize(classed.select(by, "name", level.alias("min_class"), (len(CLASSES) - 1 - level).alias("risk"), F.col("reason"), said.alias("summary")), "reviews")
    texts = done.select(by, "risk", "min_class", F.col("name").alias("file"), file_review(F.col("name"), F.col("summary"), F.col("risk"), F.array().cast("array<string>")).alias("text"))
    comments = review_comment(texts, by).select(by, "comment")
    counts = judged.groupBy(by).agg(F.count_if(~F.col("skipped")).alias("n_files"), F.count_if("skipped").alias("n_skipped"))
    out = counts.join(comments, by, "left").join(overview(done, endpoint, limit, by), by, "left").join(review_plan(done, endpoint, worst, by), by, "left")
    return out.select(by, "n_files", "n_skipped", *(F.coalesce(c, F.lit("")).alias(c) for c in ("comment", "overview", "plan")))


def better_prompt(prompt: Column, endpoint: models.Chat) -> Column:
    """A system prompt as the model itself would put it."""
    return models.complete(F.concat(F.lit("Improve this prompt for yourself:\n"), prompt), endpoint)


def diagnostics(events: DataFrame, by: str, time: str = "time") -> DataFrame:
    """What happened, in order of time within each run, and the milliseconds since what came before."""
    w = Window.partitionBy(by).orderBy(time, "name")
    since = F.unix_millis(F.col(time).cast("timestamp")) - F.unix_millis(F.lag(time).over(w).cast("timestamp"))
    return events.withColumn("place", F.row_number().over(w)).withColumn("ms", F.coalesce(since, F.lit(0).cast("long")))


def json_schema(rows: DataFrame) -> str:
    """The rows' JSON schema, which a model is told to answer by."""
    import json

    kinds = {"string": "string", "boolean": "boolean", "double": "number", "float": "number", "integer": "integer", "long": "integer", "short": "integer", "byte": "integer"}

    def of(kind: dict | str) -> dict:
        if isinstance(kind, str):
            return {"type": kinds.get(kind, "string")}
        if kind["type"] == "array":
            return {"type": "array", "items": of(kind["elementType"])}
        if kind["type"] == "struct":
            return {"type": "object", "properties": {f["name"]: of(f["type"]) for f in kind["fields"]}, "required": [f["name"] for f in kind["fields"]]}
        return {"type": "object"}

    return json.dumps(of(json.loads(rows.schema.json())))
