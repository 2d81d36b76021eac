"""Golden cases of table operators, sources and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import diff, index, models, tree, vector, work
from sparkloom.sources import outbox, paged, wiki
from sparkloom.streaming import polling


def lines(spark, types):
    return spark.createDataFrame([("f", i, t, f"l{i}") for i, t in enumerate(types)], "file string, pos int, type string, text string")


@pytest.mark.parametrize(
    ("types", "context", "want"),
    [
        ("UUUUIUUUUU", (3, 3), [("@@ -1,2 +1,2 @@", False), ("@@ -3,5 +3,6 @@", True), ("@@ -8,2 +9,2 @@", False)]),
        ("UUI", (3, 3), [("@@ -1,2 +1,3 @@", True)]),
        ("UUUUUUUUDI", (3, 3), [("@@ -1,6 +1,6 @@", False), ("@@ -7,3 +7,3 @@", True)]),
        ("UDIU", (0, 0), [("@@ -1,1 +1,1 @@", False), ("@@ -2,1 +2,1 @@", True), ("@@ -3,1 +3,1 @@", False)]),
    ],
)
def test_blocks(spark, types, context, want):
    found = diff.hunks(lines(spark, types), *context).orderBy("block").collect()
    assert [(r["hunk"], r["is_modification"]) for r in found] == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("@@ -1,2 +10,3 @@\n a\n+b\n-c\n d", [None, 11, 12, 12, 13]),
        ("@@ -1,1 +10,1 @@\n-x\n+y", [None, None, 11]),
        ("a\nb", [1, 2]),
    ],
)
def test_resolve(spark, raw, want):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(raw.split("\n"))], "file string, pos int, raw string")
    assert [r["line"] for r in diff.resolve(df).orderBy("pos").collect()] == want


def test_markers(spark):
    raw = "@@ -1,2 +10,3 @@ x\n[L1]  a\n[L2] +b\n[L3] -c\n[L4]  d"
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(raw.split("\n"))], "file string, pos int, raw string")
    comments = spark.createDataFrame([("f", m) for m in (1, 2, 3, 4)], "file string, marker long")
    placed, lost = diff.place_comments(comments, diff.resolve_markers(df))
    assert sorted((r["marker"], r["line"]) for r in placed.collect()) == [(1, 10), (2, 11), (4, 12)]
    assert [r["marker"] for r in lost.collect()] == [3]


def test_neighbours(spark):
    known = spark.createDataFrame([("f", n, f"t{n}") for n in (5, 6, 8)], "file string, line long, text string")
    found = diff.neighbours(known, spark.createDataFrame([("f", 6)], "file string, at long"))
    assert sorted(r["line"] for r in found.collect()) == [5, 6]


def test_search(spark):
    rows = spark.createDataFrame([(1, "d1", [0.9, (1 - 0.81) ** 0.5]), (2, "d1", [0.8, 0.6]), (3, "d2", [0.7, (1 - 0.49) ** 0.5]), (4, "d3", [0.5, 0.75**0.5]), (5, "d4", [0.0, 0.0])], "sampling int, doc_id string, vec array<float>")
    one = spark.createDataFrame([([1.0, 0.0],)], "query array<float>")
    found = vector.search_by_threshold(rows, one, 0.6).collect()
    assert [(r["doc_id"], round(r["similarity"], 3)) for r in found] == [("d1", 0.9), ("d2", 0.7)]
    assert [r["similarity"] for r in vector.search_by_count(rows, one, 4).collect()][-1] == 0.0
    with pytest.raises(ValueError):
        vector.search_by_count(rows, one, 0)


def test_upsert_again_changes_nothing(spark):
    held = spark.createDataFrame([("S3", "a", 1, 0), ("S3", "b", 1, 0)], "series string, sampling string, ts long, v int")
    new = spark.createDataFrame([("S3", "b", 2, 1), ("S3", "b", 3, 2), ("S4", "a", 1, 1)], "series string, sampling string, ts long, v int")
    once = index.upsert(held, new)
    twice = index.upsert(once, new)
    want = [("S3", "a", 1, 0), ("S3", "b", 3, 2), ("S4", "a", 1, 1)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_index_on_disk(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index.write(spark.createDataFrame([("S3", "a", 1), ("S4", "b", 1)], "series string, sampling string, ts long"), path)
    index.write(spark.createDataFrame([("S4", "c", 2)], "series string, sampling string, ts long"), path)
    assert sorted(r["sampling"] for r in spark.read.parquet(path).collect()) == ["a", "c"]
    index.drop(spark, path)
    assert not (tmp_path / "index").exists()


def test_tree_with_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id long, parent long")
    assert tree.ancestors(e, 5).filter("id = 3").count() == 5


def test_comment_upsert(spark):
    wanted = spark.createDataFrame([(1, "n"), (2, "n")], "number int, body string")
    comments = spark.createDataFrame([(1, 7, "u", "<!-- AI --> x"), (1, 8, "u", "other"), (2, 9, "u", None)], "number int, id int, user string, body string")
    found = {r["number"]: (r["action"], r["existing_id"]) for r in work.marked_upsert(wanted, comments, "<!-- ai -->").collect()}
    assert found == {1: ("update", 7), 2: ("add", None)}


def test_phase_and_ttl(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' a, timestamp_ntz'2024-01-01 00:05:00' b")
    got = row.select(work.commit_phase(F.col("b"), F.col("a"), F.col("a")), work.within_ttl(F.col("a"), F.col("b")), work.within_ttl(F.col("a"), F.col("b"), inverted=True)).first()
    assert tuple(got) == ("AfterPullRequestApproval", True, False)


PAGES: dict[str, object] = {}


def fetch(address: str) -> str:
    start = int(address.split("start=")[1].split("&")[0])
    return json.dumps({"results": [{"id": str(i), "title": f"T{i}", "metadata": {"labels": {"results": [{"name": "S4"}]}}} for i in range(start, min(start + 2, 5))]})


def pending(address: str) -> str:
    return json.dumps([{"repo": "r", "number": 1, "last_commit": "2024-01-01T00:00:00Z"}, {"repo": "r", "number": 1, "last_commit": "2024-01-01T00:00:00Z"}, {"repo": "r", "number": 2}])


def test_paged_source(spark):
    found = wiki.scan(spark, {"SP": "http://x/pages", "OT": "http://y?a=1"}, fetch="tests.test_operators:fetch", wait=0)
    assert found.count() == 10
    assert sorted(r["id"] for r in found.filter("space = 'SP'").collect()) == list("01234")
    assert found.filter(wiki.is_requirement(F.concat("title", F.lit(" Requirements")), F.col("labels"))).count() == 10


def test_paging_rules():
    assert paged.with_query("u?a=1", b=2) == "u?a=1&b=2"
    assert not paged.has_more("short", [], [1], 2, 0) and paged.has_more("empty", [], [1], 2, 0)
    assert paged.has_more("total", {"total": 5}, [1, 2], 2, 0) and not paged.has_more("total", {"total": 5}, [5], 2, 4)
    assert not paged.has_more("total", {"total": 5, "maxResults": 2}, [1, 2], 2, 0, compat=True)
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return "[]"

    assert list(paged.read_pages(flaky, "u", wait=0)) == [] and len(calls) == 3


def test_wiki_bodies_and_corpus(spark, tmp_path):
    raw = spark.createDataFrame([('{"results": [{"id": "1", "title": "a", "body": {"view": {"value": "<p>x</p>"}}}]}',), ('{"id": "2", "title": "b", "body": {"view": {"value": "y"}}}',)], "json string")
    docs = wiki.bodies(raw)
    assert sorted(map(tuple, docs.collect())) == [("1", "a", "<p>x</p>"), ("2", "b", "y")]
    wiki.land(docs.withColumn("space", F.lit("SP")), f"file://{tmp_path}/landed")
    assert {r["markdown"] for r in spark.read.parquet(f"file://{tmp_path}/landed").collect()} == {"x", ""}
    (tmp_path / "c/a").mkdir(parents=True)
    (tmp_path / "c/a/t_Markdown.txt").write_text("# A\nb")
    (tmp_path / "c/a/_Metadata.json").write_text(json.dumps({"id": "1", "space": "SP", "title": "T"}))
    (tmp_path / "c/lone_Markdown.txt").write_text("z")
    assert [(r["doc_id"], r["markdown"]) for r in wiki.corpus(spark, f"file://{tmp_path}/c").collect()] == [("1", "# A\nb")]
    located = wiki.by_url(spark.createDataFrame([("5", "SP", "My Title")], "doc_id string, space string, title string"), spark.createDataFrame([("http://h/display/SP/My+Title",), ("http://h/p?pageId=5",), ("http://h/p?pageId=6",)], "url string"))
    assert located.count() == 2


def test_outbox(spark, tmp_path):
    path = f"file://{tmp_path}/outbox"
    actions = spark.createDataFrame([(1, "add", "x"), (1, "add", "x"), (2, "add", "y")], "number int, action string, body string")
    outbox.write(actions, path)
    outbox.write(actions, path)
    rows = outbox.unsent(spark.read.parquet(path), spark.createDataFrame([], "key string"))
    assert rows.count() == 2
    assert sorted(r["status"] for r in outbox.deliver(rows, lambda r: 200 if r["number"] == 1 else 1 // 0).collect()) == [200, 599]
    answers = iter([422, 201])
    assert outbox.post_inline({"line": 1}, ["head", "old"], lambda c: next(answers)) == 201
    with pytest.raises(RuntimeError):
        outbox.post_inline({}, ["head"], lambda c: 500)
    (tmp_path / "s.json").write_text('{"poll_seconds": 5, "unknown": 1}')
    assert outbox.Settings.load(str(tmp_path / "s.json")).poll_seconds == 5
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("one two")
    assert outbox.summarize_folder(spark, f"file://{tmp_path}/d", models.StubChat()).endswith("one two")


def test_structured_gives_up(spark):
    got = spark.range(1).select(models.structured(F.lit("none"), "a int", models.StubChat()).alias("x")).first()["x"]
    assert got is None


def test_polling(spark, tmp_path):
    placed, published = [], []
    stream = polling.requests(spark, "tests.test_operators:pending")
    writer = polling.review(stream, lambda b: placed.extend(r["number"] for r in b.collect()), lambda b: b.withColumn("result", F.lit("ok")), lambda b: published.extend(r["number"] for r in b.collect()), 1)
    q = writer.option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(placed) == sorted(published) == [1, 2]


def test_event_windows(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    q = polling.counts_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT sum(n) FROM windows").first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    finally:
        q.stop()


def test_changed_only(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "repo string, number int, last_commit timestamp"

    def land(name: str, *rows: str) -> None:
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(rows))

    land("a.json", '{"repo": "r", "number": 1, "last_commit": "2024-01-01T00:00:00Z"}', '{"repo": "r", "number": 2}')
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    q = polling.changed_only(stream).writeStream.outputMode("update").format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        land("b.json", '{"repo": "r", "number": 1, "last_commit": "2024-01-01T00:00:00Z"}')
        q.processAllAvailable()
        land("c.json", '{"repo": "r", "number": 1, "last_commit": "2024-01-02T00:00:00Z"}')
        q.processAllAvailable()
        assert sorted(str(r["last_commit"]) for r in spark.table("changed").collect()) == ["2024-01-01 00:00:00", "2024-01-02 00:00:00"]
    finally:
        q.stop()


def test_deep_trees_and_circles(spark):
    """A chain of 1,500 nodes, a circle with a tail, and a parent that is no node."""
    chain = [(i, i - 1 if i else None) for i in range(1500)]
    rows = [*chain, (9001, 9002), (9002, 9003), (9003, 9001), (9004, 9001), (9100, 77_777), (5, 4), (5, 1400)]
    e = spark.createDataFrame(rows, "id long, parent long")
    depth = {r["id"]: r["depth"] for r in tree.depths(e).collect()}
    assert all(depth[i] == i for i in range(1500)) and depth[9100] == 0 and {depth[i] for i in (9001, 9002, 9003, 9004)} == {None}
    near = {r["id"]: r["ancestor"] for r in tree.nearest_ancestor(e, spark.createDataFrame([(0,), (700,), (9002,)], "id long")).collect()}
    assert near[1] == near[700] == 0 and near[701] == near[1499] == 700 and 0 not in near
    assert {near[i] for i in (9001, 9002, 9003, 9004)} == {9002}
    flags = spark.createDataFrame([(1499, True, False), (9004, False, True)], "id long, a boolean, b boolean")
    below = {r["id"]: (r["below_a"], r["below_b"]) for r in tree.any_below(e, flags, "a", "b").collect()}
    assert all(below[i] == (True, False) for i in range(1499)) and below[1499] == (False, False)
    assert {below[i] for i in (9001, 9002, 9003)} == {(False, True)} and below[9004] == (False, False)


def pending_in_file(address: str) -> str:
    from pathlib import Path

    return Path(address).read_text()


def test_polling_of_a_list_that_shrinks_and_grows(spark, tmp_path):
    import json

    from sparkloom.streaming.polling import PollReader

    at = tmp_path / "pending.json"
    reader = PollReader({"fetch": "tests.test_operators:pending_in_file", "address": str(at)})

    def poll(offset: dict, numbers: list[int]) -> tuple[list[int], dict]:
        at.write_text(json.dumps([{"repo": "r", "number": n} for n in numbers]))
        rows, following = reader.read(offset)
        return [json.loads(r)["number"] for (r,) in rows], following

    first, a = poll(reader.initialOffset(), [1, 2, 3, 4, 5])
    second, b = poll(a, [3, 4, 9])
    third, c = poll(b, [9, 4, 3])
    assert (first, second, third) == ([1, 2, 3, 4, 5], [3, 4, 9], []) and c == b
    assert [json.loads(r)["number"] for (r,) in reader.readBetweenOffsets(a, b)] == [3, 4, 9]
    reader.commit(b)
    fourth, d = poll(b, [])
    fifth, _ = poll(d, [3])
    assert (fourth, fifth) == ([], [3])


def test_strict_join_of_files_and_diffs(spark):
    from sparkloom.operators import work

    files = spark.createDataFrame([(1, "a"), (1, "b")], "number int, name string")
    diffs = [(1, "a", "x"), (1, "b", "y")]
    schema = "number int, name string, diff string"
    assert work.with_diffs(files, spark.createDataFrame(diffs, schema)).count() == 2
    for f, d in ((files, diffs[:1]), (files, [*diffs, (1, "a", "z")]), (files.union(files), diffs)):
        with pytest.raises(Exception, match="no single diff"):
            work.with_diffs(f, spark.createDataFrame(d, schema)).collect()


def test_endpoints_by_kind():
    assert models.embedder("stub", dimensions=4).dimensions == 4 and models.chat("stub").complete(["a b"]) == ["3: a b"]
    given = models.StubChat()
    assert models.chat("given", endpoint=given) is given
    for f in (models.embedder, models.chat):
        with pytest.raises(ValueError, match="unknown kind"):
            f("other")


def test_sprints_cases_and_classifier_chain(spark):
    sprints = spark.createDataFrame([(3, "Next", "future"), (2, "Now", "active"), (1, "Then", "closed"), (5, "Later", "future"), (4, "now", "active")], "id int, name string, state string")
    assert work.sprint(sprints, "active").first()["id"] == 2 and work.sprint(sprints, "future").first()["id"] == 3
    assert work.sprint(sprints, name="NOW").first()["id"] == 2 and work.sprint(sprints, "active", "then").count() == 0
    cases = spark.createDataFrame([(1, "a"), (2, "b")], "case_id int, title string")
    asked = spark.createDataFrame([(2,), (2,)], "case_id int")
    assert [tuple(r) for r in work.cases_asked(cases, asked).collect()] == [(2, "b")]
    with pytest.raises(Exception, match="no case 9"):
        work.cases_asked(cases, spark.createDataFrame([(9,)], "case_id int")).collect()
    rows = spark.createDataFrame([(1, None, "b"), (2, "a", "b"), (3, None, None)], "id int, x string, y string")
    chain = models.first_that_handles(F.col("x"), F.col("y"), F.lit("none"))
    assert [r["c"] for r in rows.orderBy("id").select(chain.alias("c")).collect()] == ["b", "a", "none"]


def test_links_of_issues_epics_and_comments(spark):
    issues = spark.createDataFrame([(1, "E1", "http://w/own", "see http://w/a.", None), (2, "", None, None, None), (3, "E9", None, "http://w/a", "[http://w/b]")], "key int, epic_key string, declared string, summary string, description string")
    epics = spark.createDataFrame([("E1", "http://w/epic")], "key string, declared string")
    comments = spark.createDataFrame([(1, 2, "and http://w/a, http://w/c!"), (1, 1, "first"), (2, 1, None)], "key int, id int, body string")
    found = sorted(map(tuple, work.all_links(issues, comments, epics).collect()))
    assert found == [(1, "http://w/a"), (1, "http://w/c"), (1, "http://w/epic"), (1, "http://w/own"), (3, "http://w/a"), (3, "http://w/b")]
    docs = spark.createDataFrame([(7, "Seven")], "page_id long, title string")
    told = {r["key"]: r for r in work.issue_information(issues, epics, comments.withColumn("body", F.concat("body", F.lit(" http://w/p?pageId=7"))), docs).collect()}
    assert told[1]["comments"][0].startswith("first") and told[1]["documents"] == ["Seven"] and told[2]["links"] == [] and told[1]["epic_declared"] == "http://w/epic"
