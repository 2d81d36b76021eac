"""The operators against plain versions, and their edges: nulls, empty and long texts, ties, repeats, empty tables, extra
columns with clashing names."""

from __future__ import annotations

import io
import random
import string
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import components, langid, licenses, mixing, nbsvm, quality_rules, queries, rabitq, sentencepiece_codec, simhash, suffix_dedup, warc
from tests.compare import connection, same
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", fp string, ord string, th string, size string, taken string, score string, own string, n_words string, grp string, _id string, own_id string, gone_th string, uid string, _size string, _pattern string, _place string, _copies string, pattern string, place string, copies string, p string, picks string, held_out string, label string, good string"


def words(seed: int, n: int, vocabulary: int = 500) -> str:
    rng = random.Random(seed)
    names = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choices(names, k=n))


def awkward() -> list[tuple]:
    base = words(1, 120)
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),  # an exact copy
        (3, base[:300] + " changed " + base[300:], "en", None, 1),
        (4, None, "en", "b", None),
        (5, "", None, "b", 0),
        (6, " \n\t ", "de", "b", 3),
        (7, "one", "de", "b", 3),
        (8, "é€😀 " * 40, "fr", "c", 9),
        (9, words(2, 30_000), "en", "a", 1),  # very long
        (9, words(2, 30_000), "en", "a", 1),  # a repeated row
        (None, base, "en", "a", 1),
        (10, words(3, 80) + base[100:400] + words(4, 80), None, "d", 1),
        (11, "x" * 400, "en", "d", 400),
        (12, "x" * 400, "en", "d", 400),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(awkward(), DOCS)
    return rows.select("*", *(F.lit("clash").alias(c.split()[0]) for c in EXTRA.strip(", ").split(", ")))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_queries_as_sql(spark, sf_dir):
    con = connection(sf_dir)
    for name, sql in queries.ORACLES.items():
        same(queries.QUERIES[name](spark, sf_dir), con, sql)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(chain).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.components(chain.limit(0)).count() == 0


# 1 quality rules


def test_quality_measures(docs):
    found = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert len(found) == 13 and quality_rules.judge(docs).count() == 14
    assert (found[4]["n_words"], found[4]["base_failed"], found[4]["kept"]) == (0, True, False)
    assert found[8]["n_repeat_words"] == 40 and found[8]["word_chars"] == 120 and found[8]["base_failed"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=6))
def test_repeated_windows(spark, texts):
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.measures(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in enumerate(texts):
        grams = [tuple(t[k : k + 8]) for k in range(len(t) - 7)]
        held = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
        assert got[i] == len(held)


def test_thresholds_adapt_to_the_source(spark):
    rows = [(i, words(i, 40).replace(" ", "## " if i % 2 else " "), "en", "symbols" if i % 2 else "clean", 0) for i in range(400)]
    rows.append((1000, words(5, 40).replace(" ", "## "), "en", "clean", 0))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(kept[i] for i in range(400)) and not kept[1000]


def test_thresholds_of_sources_differ(spark):
    """On the test documents no threshold is a constant: at least two rates have other bounds from source to source."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    measured = quality_rules.materialize(quality_rules.measures(rows), "test-measures")
    bounds = [r.asDict() for r in quality_rules.thresholds(quality_rules.sketches(measured)).collect()]
    names = [c for c in bounds[0] if c.startswith(("low_", "high_"))]
    varied = {c.split("_", 1)[1] for c in names if any(len({b[c] for b in bounds if b["lang"] == lang}) >= 3 for lang in {b["lang"] for b in bounds})}
    assert len(varied) >= 2, {c: sorted({b[c] for b in bounds}) for c in names}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_rules.judge(rows).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert {r["quality"]: (r["kept"] > 0.98, r["kept"] < 0.1) for r in found} == {1: (True, False), 0: (False, True)}


def test_quality_edges(spark, docs, none):
    assert quality_rules.judge(none).count() == 0
    alike = spark.createDataFrame([(i, words(1, 40), None, None, 0) for i in range(30)] + [(99, None, "en", "a", 0)], DOCS)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(alike).collect()}
    assert kept == {i: True for i in range(30)} | {99: False}  # all at the quantiles, none beyond them
    assert not any(r["kept"] for r in quality_rules.judge(docs.filter("text is null or length(text) < 5")).collect())


def test_bucket_error(spark):
    got = spark.range(0, 100_000, 37).select("id", quality_rules.bucket(F.col("id")).alias("b")).collect()
    assert all(r["b"] <= r["id"] and r["id"] - r["b"] <= r["id"] / 32 for r in got)


# 2 WARC


def pages(spark):
    long_, other = "<p>é" * 400, "<p>x" * 400
    return spark.createDataFrame([(1, "http://a/1\r\nX: y", long_), (2, "http://a/2", long_), (3, None, other), (4, "http://a/4", None), (5, "http://a/5", "s"), (6, "http://a/6", "s"), (7, "http://b/7", long_), (None, "http://b/0", long_)], "page_id long, url string, html string")


def test_archive_round_trip(spark):
    rows = {r["page_id"]: r for r in warc.archived_pages(pages(spark)).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in rows.items()} == {1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 7)}
    assert rows[1]["payload_bytes"] == rows[7]["payload_bytes"] == 2000 and rows[1]["payload_digest"] == rows[7]["payload_digest"]
    assert warc.archived_pages(pages(spark).limit(0)).count() == 0


def test_archive_predicates(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive(pages(spark), path)
    assert warc.read(spark, path, record_type="revisit").count() == 3
    assert warc.read(spark, path, target_uri=["http://a/5", "http://a/6"]).count() == 2
    pushed = warc.read(spark, path, pushdown=True).filter("record_type = 'response' and target_uri like 'http://a/%' and payload_bytes > 0")
    assert sorted(r["record_id"] for r in pushed.collect()) == ["urn:page:5", "urn:page:6"]
    assert all(r["payload"] is None for r in warc.read(spark, path, payload=False).collect())
    uri = warc.read(spark, path).filter("record_id = 'urn:page:1'").first()["target_uri"]
    assert uri == "http://a/1%0D%0AX: y"
    with pytest.raises(Exception, match="no headers"):
        warc.read(spark, path, body="x").count()


def test_archive_of_long_repeated_and_clashing_rows(spark):
    """Payloads of several read buffers, equal rows, and columns that the archive has names for."""
    long_ = "".join(random.Random(1).choices(string.ascii_letters, k=300_000))
    rows = spark.createDataFrame([(1, "u", long_), (2, "u", long_), (2, "u", long_), (3, "v", "x" * 999), (4, "v", "x" * 999)], "page_id long, url string, html string")
    rows = rows.select("*", *(F.lit("clash").alias(c) for c in ("payload", "digest", "n", "stored", "record_type", "refers_to", "payload_bytes")))
    found = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.archived_pages(rows).collect())
    digest = __import__("hashlib").sha1(long_.encode()).hexdigest()
    assert [f[:4] for f in found] == [(1, "revisit", 2, 300_000), (2, "response", None, 300_000), (2, "response", None, 300_000), (3, "response", None, 999), (4, "response", None, 999)]
    assert {f[4] for f in found[:3]} == {digest}


def test_archive_filters_reach_the_reader(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive(pages(spark), path)
    frame = warc.read(spark, path, pushdown=True).filter("record_type = 'response'")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "(record_type#" not in plan.split("BatchScan")[0], plan  # no filter is left above the scan
    assert frame.count() == 5


def test_payloads_are_read_in_linear_time():
    import time

    def seconds(n: int) -> float:
        data = warc.record({"record_type": "response", "record_id": "urn:x", "payload": b"x" * n})
        begin = time.process_time()
        assert len(next(iter(warc.records(io.BytesIO(data), warc.Reading())))[-1]) == n
        return time.process_time() - begin

    seconds(1 << 20)
    assert seconds(80 << 20) < 20 * max(0.02, seconds(10 << 20))


@pytest.mark.parametrize("pack", [warc.member, lambda r: __import__("gzip").compress(r), lambda r: r])
def test_archive_layouts(pack):
    rows = [{"record_type": "response" if i % 3 else "revisit", "record_id": f"urn:{i}", "payload": bytes([i]) * n} for i, n in enumerate([0, 5, 300, 200_000, 7])]
    data = b"".join(pack(warc.record(r)) for r in rows)
    every = list(warc.records(io.BytesIO(data), warc.Reading()))
    assert [r[1] for r in every] == [f"urn:{i}" for i in range(5)] and [len(r[-1]) for r in every if r[-1] is not None] == [5, 300, 7]
    some = list(warc.records(io.BytesIO(data), warc.Reading([lambda row: row["record_type"] == "revisit"], False)))
    assert [(r[1], r[-2]) for r in some] == [("urn:0", 0), ("urn:3", 200_000)]
    with pytest.raises((EOFError, ValueError)):
        list(warc.records(io.BytesIO(data[: len(data) // 2]), warc.Reading()))


# 3 language ID


def test_language_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 200 and sum(r["lang"] == r["lang_pred"] for r in found) > 0.98 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(docs, none):
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert {found[i]["lang_pred"] for i in (4, 5, 6)} == {"und"} and found[4]["score"] == 0
    assert langid.identify(docs).count() == 14 and langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_back_off_goes_to_shorter_grams():
    m = langid.Model(["a", "b"], ["known"], np.array([[-1.0, -5.0]]), ["<kn", "z"], np.array([[-5.0, -1.0], [-2.0, -9.0]]))
    assert m.predict("known")[0] == "a" and m.predict("knight")[0] == "b" and m.predict("zz")[0] == "a"
    assert m.predict("12 ½ !") == ("und", 0.0)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.none() | st.text(alphabet="abcdé ½²1_Ж\n", max_size=30), st.sampled_from(["x", "y", "z", None])), max_size=12))
def test_language_as_plain(spark, rows):
    rows = [*rows, ("½ ² 1 _", "x"), ("ab ½ ca", "y"), ("½", "y"), ("ab ca ab", "x")]
    got = langid.identify(spark.createDataFrame([(i, t, l, None, 0) for i, (t, l) in enumerate(rows)], DOCS)).collect()
    held = {r["doc_id"]: r["held_out"] for r in got}
    want = plain.languages([(t, l, not held[i]) for i, (t, l) in enumerate(rows)])
    for r in got:
        lang, score = want[r["doc_id"]]
        assert abs(r["score"] - score) < 1e-4 and (r["lang_pred"] == lang or score < 0.5001)


def test_language_sample_is_bounded(spark):
    """By rows and by bytes, however often a row or an id comes."""
    many = spark.range(4000).selectExpr("cast(null as long) doc_id", "concat('word', id % 1000, ' ', repeat('ab ', 30)) text", "if(id % 2 = 0, 'x', 'y') lang")
    few = langid.bounded_sample(many.select("text", "lang"), "text", 100, 1 << 20, "test-sample")
    assert 50 <= few.count() <= 180 and few.count() == few.distinct().count()
    tight = langid.bounded_sample(many.select("text", "lang"), "text", 4000, 5000, "test-sample")
    assert tight.agg(F.sum(F.octet_length("text"))).first()[0] < 12_000
    assert langid.bounded_sample(many.select("text", "lang").limit(0), "text", 10, 10, "test-sample").count() == 0


# 4 SimHash


def test_simhash_as_plain(docs, none):
    rows = [(d, t) for d, t, *_ in awkward() if d is not None]
    want = plain.simhash(list(dict(rows).items()))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {k: v for k, v in got.items() if k is not None} == want and got[None][1] == 1
    assert want[4] == ("0" * 16, 4) and want[5] == ("0" * 16, 4)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("spread", "shards"), [(64, 1), (64, 9), (11, 5)])
def test_vantage_trees_find_all_pairs(spread, shards):
    rng = np.random.default_rng(shards)
    points = [rng.integers(0, 1 << spread, 500, dtype=np.uint64)]
    for _ in range(4):
        points.append(points[-1] ^ (np.uint64(1) << rng.integers(0, spread, 500).astype(np.uint64)))
    p = np.unique(np.concatenate(points))
    want, got, place = plain.Sets(len(p)), plain.Sets(len(p)), {int(v): i for i, v in enumerate(p)}
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= 2):
            want.join(i, int(j))
    links = 0
    for _, home, guests in simhash.deal(simhash.grow(rng.permutation(p)[:300], shards), p, 2):
        for a, b in zip(*simhash.forest(p[home], p[guests], 2), strict=True):
            got.join(place[int(a)], place[int(b)])
            links += 1
        assert links <= 8 * len(p)
    assert [got.root(i) for i in range(len(p))] == [want.root(i) for i in range(len(p))]


def test_one_of_each(docs):
    """Near copies go, a repeated row stays once, and rows without an id stay; columns are as they were."""
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in rows) == [-1, 1, 4, 7, 8, 9, 10, 11]
    assert all(r["_id"] == "clash" and r["uid"] == "clash" for r in rows)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def edited(seed: int, text: str, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["new", "other", "words"]) + str(rng.random()) if rng.random() < share else w for w in text.split(" "))


def test_near_copies_as_plain(spark):
    """Texts that were edited more or less, in groups of one to forty, beside unrelated ones, one id twice."""
    rows = []
    for g in range(30):
        base = words(g, 60 + 40 * (g % 5))
        rows += [(len(rows) + k, edited(1000 * g + k, base, [0, 0.004, 0.01, 0.02, 0.05][k % 5])) for k in range(40 if g == 0 else g % 6)]
    rows += [(5000 + i, words(900 + i, 100)) for i in range(40)] + [(6000, ""), (6001, None), (6002, " ")]
    want = plain.near_copies(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(want[got[i]] == want[i] for i in got)  # no link that is none
    assert len(set(want.values())) < 0.6 * len(want)


def test_near_copies_of_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = plain.near_copies(rows)
    found = simhash.near_copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.995 * len(want) and all(want[got[i]] == want[i] for i in got)
    assert sum(r["kept"] for r in found.collect()) == len(set(got.values()))


def form_letters(seed: int, families: int, members: int, shared: int) -> list[str]:
    """Letters on one form: just above the similarity within a family, which shares so many words, and mostly below it across."""
    rng = random.Random(seed)
    letters = []
    for f in range(families):
        family = {i: f"f{f}x{i}" for i in rng.sample(range(0, 200, 9), shared)}
        for m in range(members):
            own = family | {i: f"m{f}x{m}x{i}" for i in rng.sample(range(4, 200, 9), 2)}
            letters.append(" ".join(own.get(i, f"form{i}") for i in range(200)))
    return letters


@pytest.mark.parametrize("bucket, dealt", [(None, None), (64, 1024)])
def test_near_copies_are_all_found(spark, monkeypatch, bucket, dealt):
    """Every link of brute force, whatever the trees' forest, the bands and their leaders leave out; also in many buckets."""
    if bucket:
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        monkeypatch.setattr(simhash, "DEALT", dealt)
    texts = form_letters(1, 150, 2, 2) + [edited(7 * g + k, words(300 + g, 60), 0.025) for g in range(25) for k in range(4)]
    rows = list(enumerate([*texts, "one two three", "One two  three", "", None, "a"]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.near_copies(rows)


def test_dealing_shingles_holds_few(spark, monkeypatch):
    """A task holds a bounded number of shingles, and hands them to Spark in small batches, however many it deals and counts."""
    frame, group, made = type(spark.range(0)), type(spark.range(0).groupBy("id")), {}
    for kind, name in ((frame, "mapInArrow"), (group, "applyInArrow")):
        monkeypatch.setattr(kind, name, lambda self, f, *a, name=name, own=getattr(kind, name), **b: made.update({name: f}) or own(self, f, *a, **b))
    simhash.shared_grams(spark.createDataFrame([(1, [1, 2], bytearray(b"ab"))], "uid long, grams array<int>, more binary"))
    rng = np.random.default_rng(1)

    def sets():
        for uid in range(300):
            grams = pa.array([rng.integers(-(1 << 31), 1 << 31, 10_000, np.int64).astype(np.int32)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([uid]), grams, pa.array([bytes(10_000)])], names=["uid", "grams", "more"])

    tracemalloc.start()
    dealt = [(x.nbytes, x.num_rows) for x in made["mapInArrow"](sets())]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(x for x, _ in dealt) >= 12 * 3_000_000
    assert max(x for x, _ in dealt) < 8 << 20 and most < 48 << 20
    # of a bucket whose shingles are all in two sets, and of one of common shingles
    grams, uids = np.repeat(np.arange(200_000, dtype=np.uint32), 2), np.arange(400_000)
    for bucket in (0, 1):
        rows = pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([grams.tobytes()]), pa.array([uids.tobytes()])], names=["bucket", "grams", "uids"])
        counted = list(made["applyInArrow"](iter([rows])))
        assert max(x.nbytes for x in counted) < 2 << 20
        counted = pa.Table.from_batches(counted)
        assert counted.column("uid").to_pylist() == uids.tolist() and counted.column("key").to_pylist() == grams.tolist()
        assert set(counted.column("df").to_pylist()) == {simhash.COMMON if bucket else 2}


def test_remaining_finds_all_pairs(spark):
    """With nothing joined before, no pair at the similarity is missing, and few others are asked."""
    rows = list(enumerate(form_letters(5, 30, 4, 5)))
    sets = [plain.shingles(t) for _, t in rows]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    reps = simhash.signatures(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("uid", F.col("doc_id"))
    label = spark.createDataFrame([], "node long, component long")
    got = {(r["a"], r["b"]) for r in simhash.remaining(reps, label, 0.8).collect()}
    assert want and want <= got and len(got) <= 2 * len(want)
    joined = spark.createDataFrame([(i, 0) for i in range(len(rows))], "node long, component long")
    assert simhash.remaining(reps, joined, 0.8).count() == 0


def test_sketches_bound_the_difference():
    """Two sketches never differ in more bits than the sets in shingles, of whatever sizes, and hardly in fewer where it counts."""
    rng = np.random.default_rng(4)
    for n, m in ((0, 1), (1, 1), (5, 60), (140, 150), (146, 180), (1_000, 1_100), (20_000, 21_000)):
        pool = rng.integers(0, 1 << 32, n + m, np.uint64).astype(np.uint32)
        for lost in (0, 1, n // 9):
            a, b = np.unique(pool[:n]), np.unique(pool[lost : m + lost])
            x, y = simhash.sketch(a), simhash.sketch(b)
            w = min(len(x), len(y))
            x, y = (z.reshape(len(z) // w, w) for z in (x, y))
            bits = int(np.bitwise_count(np.bitwise_xor.reduce(x) ^ np.bitwise_xor.reduce(y)).sum())
            differ = len(np.setxor1d(a, b))
            assert bits <= differ and (n < 100 or n >= 20_000 or bits >= 0.8 * differ)


@pytest.mark.parametrize("cell", [None, 16])
def test_near_copies_just_below_ask_few(spark, monkeypatch, cell):
    """Texts on one form, nearly all pairs of which share many rare shingles and are not alike: pairs that are rows stay in
    proportion to the texts, not to their square, and no link is missing; also where the texts meet in many cells."""
    if cell:
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "MET", 64)
    rng, rows = random.Random(3), []
    for k in range(240):
        at = rng.sample(range(0, 200, 5), 3 + k % 3)
        rows.append((k, " ".join(f"own{k}x{i}" if i in at else f"form{i}" for i in range(200))))
    asked, alike = [], simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda pairs, *a: asked.append(pairs.count()) or alike(pairs, *a))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain.near_copies(rows)
    assert got == want and 100 < len(set(want.values())) < 230
    print("asked", asked)
    assert sum(asked[1:]) < 10 * len(rows)


def test_bands_catch_what_is_alike():
    rng = np.random.default_rng(1)
    caught = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
        b = np.concatenate([a[:356], rng.integers(0, 1 << 64, 44, dtype=np.uint64)])  # 356 of 444: 0.80
        caught += bool((simhash.bands(a) == simhash.bands(b)).any())
    assert caught >= 295
    assert not (simhash.bands(a) == simhash.bands(b[356:])).any()


# 5 quality classifier


def test_quality_held_out(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = nbsvm.classify(d.join(l.select("doc_id"), "doc_id", "left_semi"), l).join(l, "doc_id").filter("held_out").collect()
    assert len(found) > 900 and sum(r["predicted"] == r["quality"] for r in found) > 0.97 * len(found)


def test_quality_edges(spark, docs, none):
    l = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = nbsvm.classify(docs, l).collect()
    assert len(found) == 14 and all(0 <= r["score"] <= 1 for r in found)
    assert nbsvm.classify(none, l).count() == 0
    assert {r["predicted"] for r in nbsvm.classify(docs, l.filter("quality = 1")).collect()} == {1}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 12), min_size=1, max_size=6), st.booleans()), min_size=3, max_size=16), st.integers(0, 5))
def test_descent_as_plain(rows, seed):
    """Against the same steps taken feature by feature."""
    lists, good = [sorted(f) for f, _ in rows], [g for _, g in rows]
    w, bias, ratio = plain.hinge(lists, good, nbsvm.COST, nbsvm.EPOCHS, seed)
    arrays = [np.array(f, np.uint32) for f in lists]
    own = nbsvm.log_ratios(arrays, np.array(good))
    got, shift = nbsvm.descend(arrays, np.array(good), own, seed=seed)
    assert all(abs(own[f] - ratio[f]) < 1e-9 for f in ratio) and abs(shift - bias) < 1e-6
    assert all(abs(got[f] - w.get(f, 0.0)) < 1e-6 for f in ratio)


def test_classifier_as_plain(spark):
    """The query's scores on a small table against the plain model's margins under its own curve; equal texts tie."""
    rows = [(i, words(i % 7, 30) + (" GOOD text here" if i % 3 else " bad bad bad bad"), None, None, 0) for i in range(60)]
    labels = [(i, int(bool(i % 3)), 0) for i in range(60)]
    docs, l = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in nbsvm.classify(docs, l).collect()}
    learned = [i for i in range(60) if not got[i]["held_out"]]
    feats = {i: sorted(set(nbsvm.features(rows[i][1]).tolist())) for i in range(60)}
    good = [bool(i % 3) for i in learned]
    w, bias, ratio = plain.hinge([feats[i] for i in learned], good, nbsvm.COST, nbsvm.EPOCHS, 0)
    model = nbsvm.fit(docs, l.filter(~langid.held_out(F.col("doc_id"))))
    for i, r in got.items():
        own = [ratio.get(f, 0.0) for f in feats[i]]
        margin = sum(w.get(f, 0.0) * v for f, v in zip(feats[i], own, strict=True)) / max(1e-12, float(np.sqrt(sum(v * v for v in own)))) + bias
        assert abs(r["score"] - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-4
        assert r["predicted"] == int(r["score"] >= 0.7) and (r["score"] > 0.5) == bool(i % 3)


def test_descent_separates():
    good = np.arange(40) % 2 == 0
    rows = [np.unique(np.array([1 if g else 2, 3 + i], np.uint32)) for i, g in enumerate(good)]
    ratio = nbsvm.log_ratios(rows, good)
    assert ratio[1] > 0 > ratio[2] and ratio[3] == 0
    w, bias = nbsvm.descend(rows, good, ratio)
    assert all((float(w[r] @ ratio[r]) + bias > 0) == g for r, g in zip(rows, good, strict=True))


# 6 SentencePiece


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(queries.tokenizer_bytes())


TEXTS = ["", " ", "  a  b ", "▁", "▁▁ a▁b", "\n\n x\ty", "日本語 テスト", "😀😀 a", "a\0b", "<s> </s><unk>", "<0x41> x", "ﬁ ½", words(1, 2000), "x" * 3000]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_codec_as_the_library(codec, texts):
    for t in [*texts, *TEXTS]:
        n, ids, text, spans = codec.digest(t)
        want = codec.library.encode(t)
        e = codec.encode(t)
        assert e.ids == want and n == len(want) and ids.hex() == plain.sha(",".join(map(str, want)).encode())
        assert text.hex() == plain.sha(codec.library.decode(want).encode()) and codec.decode(want) == codec.library.decode(want)
        assert b"".join(t.encode()[b:s] for b, s in e.spans) == t.encode()
        assert spans.hex() == plain.sha(b"".join(int(x).to_bytes(8, "little") for s in e.spans for x in s))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_spans_as_the_library(codec, text):
    """Every inner boundary: a piece that is no single byte covers the text that the library says it covers."""
    for t in [text, *TEXTS]:
        e, theirs = codec.encode(t), codec.library.encode(t, return_type="proto").pieces
        at = 0  # characters of the text before the piece, by the library's surfaces
        for name, (begin, end), p in zip(e.pieces, e.spans, theirs, strict=True):
            if not name.startswith("<0x"):
                assert begin == len(t[:at].encode()) and t.encode()[begin:end].decode() == p.surface, (t, name)
            at += len(p.surface)


def with_map(squeeze: bytes) -> bytes:
    """The public vocabulary under a normaliser with one of the library's compiled maps."""
    import sentencepiece

    fields = sentencepiece_codec._fields
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    blob = {n: v for n, v, _ in fields({n: v for n, v, _ in fields(rules)}[3])}[2]
    spec = sentencepiece_codec._delimited(3, sentencepiece_codec._delimited(2, blob) + b"\x18\x01\x20" + squeeze + b"\x28\x01")
    return b"".join(raw for n, _, raw in fields(queries.tokenizer_bytes()) if n != 3) + spec


def test_documents_under_a_character_map(spark, sf_dir):
    """The whole table through the map's trie, beside the library."""
    import sentencepiece

    model = with_map(b"\x01")
    library, calls = sentencepiece.SentencePieceProcessor(model_proto=model), []
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r["doc_id"]: r for r in sentencepiece_codec.digests(table, model).collect()}
    for r in table.collect():
        ids = library.encode(r["text"] or "")
        got = found[r["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == (len(ids), plain.sha(",".join(map(str, ids)).encode()), plain.sha(library.decode(ids).encode()))
    c = sentencepiece_codec.Codec(model)
    longest = c.map.longest
    c.map.longest = lambda data, at: calls.append(at) or longest(data, at)
    c.digest("ﬁne Ａ text")
    assert calls


@pytest.mark.parametrize("squeeze", [b"\x00", b"\x01"])
def test_character_map_as_the_library(squeeze):
    """With and without extra blanks removed."""
    c = sentencepiece_codec.Codec(with_map(squeeze))
    for t in ["ﬁ½", "Ａｂｃ　ｄ", "é①\u200b\tx", "가나", "か\u3099", "plain", "", "  a  ﬁ  ", "\u3000", "a\n b ", " ½ ", *TEXTS]:
        want = c.library.encode(t)
        e = c.encode(t)
        assert e.ids == want, t
        assert all(0 <= b <= n <= len(t.encode()) for b, n in e.spans)
        assert c.digest(t)[1].hex() == plain.sha(",".join(map(str, want)).encode())
        assert c.digest(t)[2].hex() == plain.sha(c.library.decode(want).encode()), t


def test_encode_frames(spark, docs, none):
    model = queries.tokenizer_bytes()
    assert sentencepiece_codec.digests(none, model).count() == 0
    found = {r["doc_id"]: r for r in sentencepiece_codec.digests(docs, model).collect()}
    assert found[4]["n_tokens"] == 0 and found[4]["ids_sha256"] == found[4]["decoded_sha256"] == plain.sha(b"")
    pieces = sentencepiece_codec.encode(docs, model).filter("doc_id = 8").first()["pieces"]
    text = awkward()[7][1].encode()
    assert b"".join(text[p["begin"] : p["end"]] for p in pieces) == text
    ids = spark.createDataFrame([(1, [p["id"] for p in pieces]), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(ids, model).collect()} == {1: awkward()[7][1], 2: ""}


# 7 licences


def test_license_bounds_lose_nothing():
    for size in range(1, 60):
        low, high = licenses.bounds(size, 0.8)
        assert all(low <= n <= high for n in range(1, 200) if 2 * min(n, size) / (n + size) >= 0.8)


def test_license_marks_lose_nothing():
    """What reaches the threshold with a template has one of the words that units are passed over without."""
    rng = random.Random(11)
    chosen = set(licenses.marks((t for _, t in licenses.known()), 0.8))
    for _ in range(3000):
        _, template = rng.choice(licenses.known())
        w = template.split()
        drop = rng.choice([0.0, 0.05, 0.15, 0.3])
        unit = [x for x in w if rng.random() >= drop and x not in chosen] if rng.random() < 0.3 else [x for x in w if rng.random() >= drop]
        a, b = set(licenses.bigrams(" ".join(unit))), set(licenses.bigrams(template))
        if a and 2 * len(a & b) >= 0.8 * (len(a) + len(b)):
            assert not chosen.isdisjoint(unit)


def test_license_scan_as_sql(spark):
    """Notices that lack their usual words, and templates with words left out, changed and moved."""
    rng = random.Random(12)
    rows = [(1, "Released under the MIT"), (2, "work is dedicated to the public\tdomain under CC0 1.0 Universal"), (3, "All rights reserved"), (4, None), (5, "")]
    for i in range(300):
        w = rng.choice(licenses.known())[1].split()[:400]
        at = rng.randrange(len(w))
        w = w[at:] + w[:at] if rng.random() < 0.2 else w
        rows.append((10 + i, rng.choice(["", "so.\n"]) + " ".join(x if rng.random() < 0.9 else rng.choice(["", "other", "the"]) for x in w) + rng.choice([".", "\n\nand more", ". And more"])))
    con = connection("/root/testdata/sf0.001")
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    same(found, con, licenses.sql())
    got = {r["doc_id"]: (r["license_id"], r["dice"]) for r in found.collect()}
    assert got[1] == ("MIT", 0.857143) and got[2] == ("CC0-1.0", 0.956522) and got[3][0] == "LicenseRef-Reserved"
    assert sum(v[0] is not None for v in got.values()) > 50


def full(name: str) -> str:
    from pathlib import Path

    return (Path(licenses.__file__).parent / "licences" / f"{name}.txt").read_text()


def test_license_scan(spark, docs, none):
    mit = full("MIT").split("\n\n")[0]
    rows = spark.createDataFrame([(1, f"Hello\n{mit.upper()}\n\nbye"), (2, mit.replace("free of charge", "at no charge")), (3, "Released under the Apache license"), (4, None), (5, words(1, 20_000))], "doc_id long, text string")
    found = {r["doc_id"]: (r["license_id"], r["dice"]) for r in licenses.scan(rows).collect()}
    assert found[1] == ("MIT", 1.0) and found[2][0] == "MIT" and 0.8 <= found[2][1] < 1
    assert found[3] == found[4] == found[5] == (None, None)
    assert licenses.scan(docs).count() == 14 and licenses.scan(none).count() == 0


def test_full_licences_are_found(spark):
    """Whole, within a longer text, in other line breaks, and as a notice amid a line; ties go to the first by id."""
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
    rows = [(n, full(n)) for n in names]
    rows += [(f"in {n}", f"{words(1, 300)}\n\n{full(n)}\n\n{words(2, 300)}") for n in ("BSD-2-Clause", "ISC", "MIT", "Zlib")]
    rows += [("wrapped", " ".join(full("MIT").split())), ("line", "This library is small and fast. Released under the MIT License. Patches are welcome."), ("reserved", f"{words(3, 20)}\nAll rights reserved.\n{words(4, 20)}")]
    found = {r["doc_id"]: (r["license_id"], r["dice"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(found[n] == (n, 1.0) for n in names), found
    assert {found[f"in {n}"][0] for n in ("ISC", "Zlib")} == {"ISC", "Zlib"} and found["in MIT"][0] in ("MIT", "Unlicense") and found["in BSD-2-Clause"][0].startswith("BSD")
    assert found["wrapped"] == ("MIT", 1.0) and found["line"] == ("MIT", 1.0) and found["reserved"] == ("LicenseRef-Reserved", 1.0)


# 8 embeddings


def vectors(seed: int, n: int, d: int = 32) -> dict[int, list[float]]:
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(n // 2, n):
        x[i] = x[i - n // 2] * rng.uniform(0.5, 3) + rng.standard_normal(d) * rng.choice([0.05, 0.2, 0.3])
    return {i: v.astype(np.float32).tolist() for i, v in enumerate(x)}


def test_embeddings_recall(spark):
    v = vectors(1, 3000)
    got = {r["vec_id"]: r for r in rabitq.near_duplicates(spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>")).collect()}
    want = plain.cosine_classes(v)
    assert all(got[i]["n_links"] <= want[i][0] for i in v)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i]["component_id"] == want[i][1] for i in v) > 0.98 * len(v)


def test_embeddings_large_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK_BYTES", 64 * 8 * 32)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    v = {i: (centre + rng.standard_normal(16) * 0.1).tolist() for i in range(200)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rabitq.near_duplicates(spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")).collect()}
    want = plain.cosine_classes(v)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in v)


def test_embeddings_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [0.0, 1e-30]), (None, [1.0, 0.0]), (10, [float("inf"), 1.0])]
    got = rabitq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[None] == (3, 1, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert rabitq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("d", [4, 16, 64, 200])
def test_rows_with_links_stay_open(d):
    """Every vector of a pair that the estimates let through is sent, and few others."""
    rng = np.random.default_rng(d)
    base = rng.standard_normal((300, d))
    x = np.concatenate([base, base[:60] + rng.standard_normal((60, d)) * 0.2 / np.sqrt(d) * np.linalg.norm(base[:60], axis=1)[:, None]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    code, factor, keys = rabitq.encode(x, 8, 3)
    q, step = rabitq.rounded(x @ rabitq.directions(d, d).T)
    found = rabitq.open_rows(q, step, code, factor, None, 0.95)
    linked = {int(i) for a, b in rabitq.compare(x, code, factor, keys, 0, None, 0.95) for i in (*a, *b)}
    assert linked <= set(np.flatnonzero(found)) and (len(linked) >= 100 or d == 4)
    assert d < 64 or found.sum() < 160
    side = np.arange(len(x)) % 2
    across = {int(i) for a, b in rabitq.compare(x, code, factor, keys, 0, side, 0.95) for i in (*a, *b)}
    assert across <= set(np.flatnonzero(rabitq.open_rows(q, step, code, factor, side, 0.95)))


def test_embeddings_with_clashing_columns_long_vectors_and_ties(spark):
    rng = np.random.default_rng(8)
    long_ = rng.standard_normal((3, 4000))
    long_[1] = long_[0] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(long_)] + [(10, [1.0, 0.0]), (11, [0.95, float(np.sqrt(1 - 0.95**2))]), (12, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit("clash").alias(c) for c in ("uid", "v", "d", "t", "key", "grp", "mult", "h1", "h2", "n", "component", "least")))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rabitq.near_duplicates(df).collect()}
    dot = np.dot(np.array(rows[3][1]), np.array(rows[4][1]))
    assert got[0] == (1, 0) and got[1] == (1, 0) and got[2] == (0, 2) and got[12] == (0, 12)
    assert got[10][0] == int(dot >= 0.95)  # a cosine of the threshold links


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, factor, _ = rabitq.encode(x, 8, 4)
    signs = np.unpackbits(code, axis=1, count=64) * 2.0 - 1
    estimate = (x @ rabitq.directions(64, 64).T) @ (signs / 8).T / factor[None, :]
    error = estimate - x @ x.T
    assert abs(error[~np.eye(400, dtype=bool)].mean()) < 0.002 and np.abs(np.diag(error)).max() < 1e-9
    bound = np.sqrt((1 - factor**2) / factor**2 / 63)[None, :] * np.sqrt(1 - np.clip(x @ x.T, -1, 1) ** 2)
    assert (np.abs(error) <= rabitq.CONFIDENCE * bound + 1e-9).mean() > 0.999


# 9 suffix arrays


def test_removal_as_plain(docs, none):
    rows = [(d if d is not None else 1 << 60, t) for d, t, *_ in awkward()]
    want = sorted((d, len((t or "").encode()), len((t or "").encode()) - len(k), n, plain.sha(k)) for (d, t), (_, k, n) in zip(rows, plain.repeats(rows), strict=True))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 60, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_removal_from_repeated_rows(spark):
    shared = "a passage of more than fifty bytes that the first document holds as well. "
    rows = [(1, shared + "first"), *[(2, shared + "second")] * 3, *[(None, "third " + shared)] * 2]
    got = sorted((r["doc_id"] or 1 << 60, r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    texts = [(d or 1 << 60, t) for d, t in rows]
    assert got == sorted((d, len(t) - len(k), n, plain.sha(k)) for (d, t), (_, k, n) in zip(texts, plain.repeats(texts), strict=True))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=12), min_size=2, max_size=8), st.randoms())
def test_removal_of_shared_passages(spark, plans, rng):
    parts = ["".join(random.Random(i).choices("abcé ", k=37)) for i in range(6)]
    rows = [(rng.randint(0, 20), "".join(parts[i] for i in p)) for p in plans]
    got = sorted((r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted((d, len(t.encode()) - len(k), n, plain.sha(k)) for (d, t), (_, k, n) in zip(rows, plain.repeats(rows), strict=True))
    assert got == want


def test_windows_are_sorted():
    data = (b"abcdefgh" * 30 + bytes(range(256))) * 3
    at = np.arange(len(data) - 49)
    classes = suffix_dedup.sort_windows(data, at, 50)
    want: dict[bytes, list[int]] = {}
    for i in at.tolist():
        want.setdefault(data[i : i + 50], []).append(i)
    assert sorted(sorted(c.tolist()) for c in classes) == sorted(v for v in want.values() if len(v) > 1)


@pytest.mark.parametrize(("hot", "sent"), [(2, 0), (2, 1 << 30), (1 << 30, 0)])
def test_removal_with_hot_keys_and_many_groups(spark, monkeypatch, hot, sent):
    """A phrase that goes on differently everywhere, in many groups, with copies marked or filtered out."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(suffix_dedup, "GROUP_LEAST", 1500)
    monkeypatch.setattr(suffix_dedup, "GROUP_MOST", 1500)
    rng = random.Random(5)
    phrase = "all of this text was written by the following author "
    rows = [(i, words(i, rng.randint(0, 12)) + " " + phrase[: rng.choice([30, 53])] + words(i % 9, 6)) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(0, 30, 3)] + rows[5:8]
    got = sorted((r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted((d, len(t.encode()) - len(k), n, plain.sha(k)) for (d, t), (_, k, n) in zip(rows, plain.repeats(rows), strict=True))
    assert got == want


def test_removal_reads_the_texts_once(spark, docs):
    """One exchange of the packed texts, which both readers use, in groups whose texts GROUP_MOST bounds."""
    rows = docs.filter("doc_id is not null").selectExpr("doc_id ord", "xxhash64(text) th", "coalesce(text, '') text")
    found = suffix_dedup._spans(rows, 50)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(grp") - plan.count("ReusedExchange") < plan.count("FlatMap") and "ReusedExchange" in plan


# 10 mixing


def test_shares():
    assert mixing.shares([100, 100, 100], [5, 2, 1], 3, 300) == [187.5, 75.0, 37.5]
    got = mixing.shares([10, 100, 0, 190], [5, 2, 1, 5], 3, 300)
    assert got[0] == 30 and got[2] == 0 and abs(sum(got) - 300) < 1e-9 and all(t <= 3 * s + 1e-9 for t, s in zip(got, [10, 100, 0, 190], strict=True))
    assert mixing.shares([], [], 3, 0) == []


def test_every_source_goes_through_the_network(spark, sf_dir, monkeypatch):
    """A network for each source of documents that can give something, none passed by."""
    built = []

    class Seen(mixing._Network):
        def fill(self, source: int, sink: int) -> None:
            built.append(len(self.out))
            super().fill(source, sink)

    monkeypatch.setattr(mixing, "_Network", Seen)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixing.recipe(table)
    assert len(built) == 3 * table.select("source").distinct().count()


def test_flow_prefers_fresh_documents():
    flows = mixing.route([((0,), 100), ((0, 1), 100), ((1,), 100)], [150, 150], 3)
    assert sum(sum(f.values()) for f in flows) == 300 and all(sum(f.values()) == 100 for f in flows)
    alone = mixing.route([((0,), 100), ((0, 1), 10)], [200, 30], 3)
    assert alone[1].get(1, 0) == 30 and alone[0][0] == 200


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 2), min_size=1, max_size=3), st.integers(0, 3)), min_size=1, max_size=4), st.lists(st.integers(0, 5), min_size=3, max_size=3), st.integers(1, 3))
def test_flow_is_the_cheapest(patterns, quotas, epochs):
    """Against all flows there are: the largest amount at the least cost, within sizes and quotas."""
    patterns = [(tuple(sorted(m)), n) for m, n in patterns]
    flows = mixing.route(patterns, quotas, epochs)
    given = [sum(f.values()) for f in flows]
    assert all(set(f) <= set(m) and sum(f.values()) <= n * epochs and min(f.values(), default=0) >= 0 for f, (m, n) in zip(flows, patterns, strict=True))
    assert all(sum(f.get(s, 0) for f in flows) <= q for s, q in enumerate(quotas))
    cost = sum(e * e * max(0, min(n, g - e * n)) for g, (_, n) in zip(given, patterns, strict=True) for e in range(epochs))
    assert (sum(given), cost) == plain.cheapest_flow(patterns, quotas, epochs)


def test_many_overlapping_sources_take_seconds():
    import time

    rng = random.Random(3)
    patterns = [((i,), rng.randint(1, 1000)) for i in range(10_000)] + [(tuple(sorted(rng.sample(range(10_000), 2))), rng.randint(1, 1000)) for _ in range(10_000)]
    total = sum(n for _, n in patterns)
    quotas = [rng.randint(0, 2 * total // 10_000) for _ in range(10_000)]
    begin = time.process_time()
    flows = mixing.route(patterns, quotas, 3)
    assert time.process_time() - begin < 30
    assert all(sum(f.values()) <= 3 * n for f, (_, n) in zip(flows, patterns, strict=True))


def test_mix_keeps_columns_with_clashing_names(docs):
    rows = mixing.mixed(docs).collect()
    assert rows and all(r["_size"] == r["_copies"] == r["size"] == r["pattern"] == r["picks"] == "clash" for r in rows)


def test_mix_of_ties_and_a_hot_source(spark):
    """One source with nearly all documents, of equal size, whose ids repeat."""
    rows = [(i // 2, "one two three", "en", "a" if i % 10 else "b", 0) for i in range(1000)]
    found = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()]
    by = {}
    for r in found:
        by.setdefault((r["doc_id"], r["source"]), set()).add(r["taken"])
    assert all(len(v) == 1 for v in by.values())
    for s in "ab":
        own = [r for r in found if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 6


def test_mix_meets_targets(spark):
    rows = [(i, words(i, 20 + i % 180), "en", ["b", "a", "c", None, "a", "a"][i % 6], 0) for i in range(3000)]
    found = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()]
    size = {r["doc_id"]: len(plain.WORD.findall(rows[r["doc_id"]][1])) for r in found}
    names = ["a", "b", "c", None]
    sizes = [sum(size[r["doc_id"]] for r in found if r["source"] == s) for s in names]
    target = dict(zip(names, mixing.shares(sizes, [5, 2, 1, 5], 3, sum(sizes)), strict=True))
    for s in names:
        own = [r for r in found if r["source"] == s]
        assert {round(r["target"], 6) for r in own} == {round(target[s], 6)}
        assert abs(sum(r["taken"] for r in own) - target[s]) < 0.005 * target[s]
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] in {r["size"] * k for k in range(4)} for r in found)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(rows[::-1], DOCS)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in found}


def test_mix_of_overlapping_sources(spark):
    rows = [(i, words(i, 100), [["a"], ["a", "b"], ["b"]][i % 3]) for i in range(300)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert abs(sum(r["taken"] for r in found) - 30_000) < 300 and len(found) == 300


def test_mix_edges(docs, none):
    found = mixing.mix(docs).collect()
    assert len(found) == 14 and all(r["taken"] == 0 for r in found if r["size"] == 0)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
