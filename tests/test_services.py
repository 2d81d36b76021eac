"""Sources and sinks against fake services that count what they are asked."""

from __future__ import annotations

import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import landing, paged, requests, reviews, wiki
from sparkloom.streaming import bounded
from tests import services


@pytest.fixture(autouse=True)
def service():
    shutil.rmtree(services.HOME, ignore_errors=True)
    os.makedirs(services.HOME)
    yield


# reads that lead to reads


def test_pull_request_read(spark):
    pulls = spark.createDataFrame([("r", n, "h", "b") for n in (0, 1, 3, 4, 130)], "repo string, number int, head string, base_sha string")
    found = requests.pull_request_parts(requests.addresses(pulls, "http://h"), "tests.services:code_host", wait=0, tries=2).collect()
    commits = {n: [r for r in found if r["number"] == n and r["part"] == "commit"] for n in (0, 1, 3, 4, 130)}
    assert [len(commits[n]) for n in (0, 1, 3, 4, 130)] == [0, 1, 3, 0, 130]
    assert [json.loads(r["answer"])["sha"] for r in sorted(commits[130], key=lambda r: r["place"])] == [f"c130-{i}" for i in range(130)]
    (failed,) = [r for r in commits[3] if r["failed"]]
    assert failed["place"] == 1 and failed["answer"] is None and "reset" in failed["failed"]
    assert {r["part"] for r in found if r["number"] == 4 and r["failed"]} == {"comments", "review_comments", "reviews", "commits", "files", "details"}
    assert {r["part"] for r in found if r["number"] == 1} == {"comments", "review_comments", "commits", "commit", "files", "details", "compare"}
    asked = services.noted("asked")
    # a GET a commit, the one that fails twice; lists page by page
    assert sum("/r/commits/" in a for a in asked) == 134 + 1 and sum(a.startswith("http://h/r/pulls/130/commits") for a in asked) == 3
    assert [sum(a == f"http://h/r/pulls/{n}" for a in asked) for n in (0, 1, 4)] == [1, 1, 1]  # what is not there is asked for once


def test_requests_are_bounded_and_keep_the_rows(spark):
    rows = spark.createDataFrame([(i, f"http://h/r/pulls/{i}", "x") for i in range(200, 400)], "n int, url string, answered string").repartition(16)
    found = requests.answers(rows, F.col("url"), "tests.services:code_host", parallel=3, most=6)
    assert found.rdd.getNumPartitions() == 2
    assert sorted((r["n"], json.loads(r["answer"])["number"], r["answered"]) for r in found.collect()) == [(i, i, "x") for i in range(200, 400)]
    nothing = requests.answers(rows.limit(1), F.lit(None), "tests.services:code_host").first()
    assert nothing["answer"] is None and nothing["failed"] == "no address"


def test_contents_by_commit(spark):
    files = spark.createDataFrame([("r", "a.cs", "sha"), ("r", "gone.cs", "sha"), ("r", "folder", "main")], "repo string, path string, ref string")
    found = {r["path"]: (r["content"], r["failed"]) for r in requests.contents(files, "http://h", "tests.services:code_host").collect()}
    assert found["a.cs"] == ("class A {}", None) and found["gone.cs"] == ("", None)
    assert found["folder"][1] == "the answer holds no content"
    assert any(a.endswith("contents/a.cs?ref=sha") for a in services.noted("asked"))


# filters in requests


def test_filters_go_into_the_requests(spark):
    pages = lambda: wiki.of_space(spark, "http://w/pages", ["AB", "CD"], fetch="tests.services:filtering_wiki", wait=0)
    assert pages().count() == 240
    every = len(services.noted("asked"))
    one = pages().filter("space = 'AB' and title = 'Title 2'")
    assert sorted(r["id"] for r in one.collect()) == sorted(f"AB{i}" for i in range(2, 120, 4))
    asked = services.noted("asked")[every:]
    assert len(asked) < every / 2 and all("spaceKey=AB" in a and "title=Title%202" in a for a in asked)
    assert pages().filter("space in ('CD', 'XX')").count() == 120 and pages().filter("title like '%3'").count() == 60


def test_tries():
    calls = []

    def ask() -> str:
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert paged.tried(ask, 3, 0) == "ok" and len(calls) == 3
    with pytest.raises(paged.NotFound):
        paged.tried(lambda: (_ for _ in ()).throw(paged.NotFound("x")), 3, 60)
    with pytest.raises(OSError):
        paged.tried(lambda: open("/nowhere/at/all").read() and "", 2, 0)


# landing


def test_documents_land_as_folders(spark, tmp_path):
    root = f"file://{tmp_path}/wiki"
    rows = [("S", 1, "One: first", "<h1>A</h1><p>b</p>"), ("S", 2, "One: first", "<p>same title</p>"), ("T", 3, "Gone", None), (None, 4, "No space", "<p>x</p>"), ("S", 5, "B" * 300, "<p>long name</p>")]
    docs = spark.createDataFrame(rows, "space string, doc_id int, title string, html string").repartition(3)
    landing.land_files(docs, root)
    names = sorted(str(p.relative_to(tmp_path / "wiki")) for p in (tmp_path / "wiki").rglob("*") if p.is_file() and "Failures" not in str(p))
    assert "S/One_ first-1/One_ first.html" in names and "S/One_ first-2/One_ first_Markdown.txt" in names and "S/One_ first-1/_Metadata.json" in names
    assert len(names) == 4 * 3 and not any("_staging" in n for n in names)
    landed = wiki.corpus(spark, root)
    assert {r["doc_id"]: "A" in r["markdown"] for r in landed.collect()}["1"]
    assert [(r["doc_id"], r["reason"]) for r in landing.failures(spark, root).collect()] == [("3", "no body")]
    assert [r["doc_id"] for r in landing.to_retry(docs, root, landed).collect()] == [3]
    again = docs.withColumn("html", F.coalesce("html", F.lit("<p>now</p>")))
    landing.land_files(landing.to_retry(again, root, landed), root)
    assert wiki.corpus(spark, root).count() == 5 and landing.to_retry(docs, root, wiki.corpus(spark, root)).count() == 0


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/wiki"
    docs = spark.createDataFrame([("S", i, f"T{i}", "<p>x</p>") for i in range(40)], "space string, doc_id int, title string, html string").repartition(4)
    broken = docs.withColumn("title", F.when(F.col("doc_id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        landing.land_files(broken, root)
    assert not list((tmp_path / "wiki").rglob("*.html"))
    landing.land_files(docs, root)
    assert wiki.corpus(spark, root).count() == 40 and landing.failures(spark, root).count() == 0


# reviews


ACTION = "repo string, number int, text string"


def test_reviews_are_added_updated_and_done_again(spark):
    wanted = spark.createDataFrame([("r", 1, "good"), ("r", 2, "bad")], ACTION)
    there = spark.createDataFrame([("r", 2, 9, "Bot", "## AI\r\n\r\nold"), ("r", 2, 5, "other", "## ai x"), ("r", 1, 7, "bot", "hello")], "repo string, number int, id int, user string, body string")
    found = reviews.planned(wanted, there, "## AI", "bye", reviewer="bot").orderBy("number", "step").collect()
    assert [(r["number"], r["kind"], r["id"]) for r in found] == [(1, "add_review", None), (2, "update_review", 9), (2, "add_review", None)]
    assert [r["body"] for r in found] == ["## AI\r\n\r\ngood\r\n\r\nbye", "## AI\r\n\r\nbad\r\n\r\nbye", "## AI\r\n\r\nRe-review completed\r\n\r\nbye"]
    comments = reviews.planned(wanted, there, "## AI", "bye").orderBy("number").collect()
    assert [(r["kind"], r["id"]) for r in comments] == [("add_comment", None), ("update_comment", 5)]


def test_lines_go_to_commits_that_know_them(spark, tmp_path):
    comments = spark.createDataFrame([("r", 1, "a.cs", 5, "x"), ("r", 1, "b.cs", 6, "y"), ("r", 1, "c.cs", 7, "z")], "repo string, number int, path string, line int, body string")
    pulls = spark.createDataFrame([("r", 1, "head")], "repo string, number int, head string")
    commits = spark.createDataFrame([("r", 1, "k1", 1, False, ["a.cs", "b.cs"]), ("r", 1, "n2", 2, False, ["a.cs"]), ("r", 1, "k3", 3, True, ["c.cs", "b.cs"])], "repo string, number int, sha string, date int, merge boolean, files array<string>")
    targets = reviews.inline_targets(comments, pulls, commits)
    found = {r["path"]: (r["shas"], r["refused"]) for r in targets.collect()}
    assert found == {"a.cs": (["head", "n2", "k1"], None), "b.cs": (["head", "k1"], None), "c.cs": ([], "no user's commit changed c.cs")}
    reviews.Delivery(f"file://{tmp_path}/d", services.post, services.posted).batch(targets.filter("refused is null").drop("refused"))
    assert sorted(json.loads(x)["sha"] for x in services.noted("posted")) == ["k1", "k1"]


def numbers() -> list[int]:
    return sorted(json.loads(x)["number"] for x in services.noted("posted"))


def test_a_killed_batch_posts_nothing_twice(spark, tmp_path):
    actions = spark.createDataFrame([("r", n, f"text {n}") for n in range(10, 30)], ACTION)
    first = reviews.Delivery(f"file://{tmp_path}/d", services.post, services.posted)
    open(f"{services.HOME}/broken", "w").close()
    todo = first.intend(actions)
    first.deliver(todo.filter("number < 20")).collect()  # sent, and killed before this was written
    assert numbers() == [10, 11, 12, 14, 15, 16, 17, 18, 19]
    again = reviews.Delivery(f"file://{tmp_path}/d", services.post, services.posted)
    again.batch(actions)
    assert numbers() == [n for n in range(10, 30) if n != 13]
    os.remove(f"{services.HOME}/broken")
    again.batch(spark.createDataFrame([("r", 40, "later")], ACTION))  # what failed goes with the next batch
    again.batch(actions)
    assert numbers() == [*range(10, 30), 40]


def test_actions_of_a_stream_are_sent_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"repo": "r", "number": 1, "text": "x"}\n{"repo": "r", "number": 2, "text": "y"}\n')
    for _ in range(2):
        actions = spark.readStream.schema(ACTION).json(f"file://{tmp_path}/in")
        query = reviews.Delivery(f"file://{tmp_path}/d", services.post, services.posted).stream(actions, f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None and numbers() == [1, 2]
        shutil.rmtree(tmp_path / "cp")  # even a stream that has lost its place sends nothing again


# back-pressure


def test_growing_list_is_admitted_bit_by_bit(spark, tmp_path):
    sizes: list[int] = []
    seen: list[int] = []

    def take(batch, epoch: int) -> None:
        rows = [r["row"] for r in batch.collect()]
        sizes.append(len(rows))
        seen.extend(rows)

    checkpoint = f"file://{tmp_path}/cp"
    for size in (47, 47, 60):
        services.note("size", str(size))
        stream = bounded.growing(spark, "http://g/list", "tests.services:growing_rows", "tests.services:growing_count", checkpoint, "v string", limit=20, rows=7)
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
        deadline = time.time() + 60
        while len(seen) < size and time.time() < deadline and query.exception() is None:
            time.sleep(0.5)
        query.processAllAvailable()
        query.stop()
        assert sorted(seen) == list(range(size))
    assert max(sizes) <= 20 and sizes[:3] == [20, 20, 7]


def test_a_replay_reads_the_same_numbers():
    reader = bounded.BoundedReader({"address": "http://g/list", "fetch": "tests.services:growing_rows", "count": "tests.services:growing_count", "checkpoint": "/nowhere", "limit": "20", "rows": "7", "wait": "0"})
    services.note("size", "50")
    assert reader.initialOffset() == {"row": 0} and [reader.latestOffset()["row"] for _ in range(4)] == [20, 40, 50, 50]
    parts = reader.partitions({"row": 20}, {"row": 40})
    assert [(p.begin, p.end) for p in parts] == [(20, 27), (27, 34), (34, 40)]
    rows = [x for p in parts for x in reader.read(p)]
    services.note("size", "90")
    assert rows == [x for p in parts for x in reader.read(p)] == [(i, json.dumps({"v": f"row {i}"})) for i in range(20, 40)]
