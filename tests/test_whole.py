"""Queries that read whole texts and tables, against brute force."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import triage
from sparkloom.operators import packing, ranks, vector
from sparkloom.plans.catalogue import QUERIES


def test_line_tokens_of_every_line(spark, tmp_path):
    texts = {d: "\n".join(f"int x{n} = {n}; // line {n}" if n % 3 else f'call("a{n}", {d});' for n in range(d + 1)) for d in range(1, 14)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((d, t.kind) for d, text in texts.items() for line in text.split("\n") for t in triage.CSHARP.tokens(line))
    got = {(r["doc_id"], r["kind"]): r["n"] for r in QUERIES["line_tokens"](spark, str(tmp_path)).collect()}
    assert got == want


def test_search_for_each_of_many_queries(spark):
    rows = [(n, f"d{n % 3}", [float(n % 5), float(n % 7), 1.0]) for n in range(20)]
    samples = spark.createDataFrame(rows, "sampling int, doc_id string, vec array<float>")
    asked = samples.filter("sampling % 4 = 0").selectExpr("sampling as asked", "vec as query")
    got = {(r["asked"], r["sampling"], r["doc_id"]) for r in vector.search_by_count(samples, asked, 2, each="asked").collect()}
    want = set()
    for a, _, q in rows[::4]:
        cos = {k: round(sum(x * y for x, y in zip(v, q)) / (sum(x * x for x in v) * sum(x * x for x in q)) ** 0.5, 6) for k, _, v in rows}
        best: dict[str, int] = {}
        for k, d, _ in sorted((r for r in rows if r[0] != a), key=lambda r: (-cos[r[0]], r[0])):
            best.setdefault(d, k)
        want |= {(a, k, d) for d, k in sorted(best.items(), key=lambda x: (-cos[x[1]], x[1]))[:2]}
    assert got == want


def test_more_than_one_query_row_is_an_error(spark):
    samples = spark.createDataFrame([(1, "d", [1.0]), (2, "d", [2.0])], "sampling int, doc_id string, vec array<float>")
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        vector.nearest(samples, samples.selectExpr("vec as query")).collect()


def test_consoles_hold_whole_pages(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkloom.plans import records

    rows = [(n, "u", "<p>" + "word " * 200 * n + f"last{n}</p>") for n in (1, 2)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = records._consoles(spark, str(tmp_path)).select("page_id", F.to_json("p").alias("p")).collect()
    assert len(found) == 2 and all(f"last{r['page_id']}" in r["p"] for r in found)


def test_segments_of_every_line(spark, tmp_path):
    spark.createDataFrame([(7, "\n".join(f"line {n}" for n in range(8)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["pos"], r["content"]) for r in QUERIES["markdown_segments"](spark, str(tmp_path)).collect())
    assert got == [(n, f"line {n}") for n in range(8)]


def test_texts_with_one_beginning_are_no_copies(spark, tmp_path):
    same = "the same forty characters at the start of both texts, "
    spark.createDataFrame([(4, same + "a"), (8, same + "b"), (12, same + "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [tuple(r) for r in QUERIES["dup_samples"](spark, str(tmp_path)).select("sample", "n").collect()] == [(same + "b", 2)]
    assert sorted(r["doc_id"] for r in QUERIES["index_incremental_anti_join"](spark, str(tmp_path)).collect()) == [8, 12]
    assert sorted((r["sampling"][-1], r["ts"], r["origin"]) for r in QUERIES["index_upsert_last_wins"](spark, str(tmp_path)).collect()) == [("a", 4, "new"), ("b", 12, "old")]


def test_groups_are_cut_before_the_shuffle(spark):
    rows = spark.range(20_000).selectExpr("id % 3 AS g", "id AS k", "hash(id) AS v")
    before = spark.conf.get(ranks.LIMIT)
    try:
        spark.conf.set(ranks.LIMIT, "1000")
        got = ranks.first_rows(rows, ("v", "k"), 4096, "g", rank="place")
        plan = got._jdf.queryExecution().executedPlan().toString()
        partial, final = plan.index("Partial"), plan.index("Final")
        assert "WindowGroupLimit" in plan and final < plan.index("Exchange") < partial
        want = {(r["g"], r["place"], r["k"]) for r in rows.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY v, k) AS place").filter("place <= 4096").collect()}
        assert {(r["g"], r["place"], r["k"]) for r in got.collect()} == want
        spark.conf.set(ranks.LIMIT, "-1")
        assert {(r["g"], r["k"]) for r in ranks.first_rows(rows, ("v", "k"), 4096, "g").collect()} == {(g, k) for g, _, k in want}
        assert spark.conf.get(ranks.LIMIT) == "-1"
    finally:
        spark.conf.set(ranks.LIMIT, before)


@pytest.mark.parametrize("cut", [100_000, 0])
def test_truncation_of_one_source(spark, monkeypatch, cut):
    """The first that fit, found among no more rows of a group than can fit, or by ranges."""
    monkeypatch.setattr(packing, "CUT", cut)
    sizes = [(k * 7919) % 23 for k in range(3000)]
    rows = spark.createDataFrame([(k, "s" if k % 5 else "t", n) for k, n in enumerate(sizes)], "k int, source string, n int").repartition(7)
    for by, group in (((), lambda k: 0), (("source",), lambda k: k % 5 == 0)):
        for most in (-1, 0, 3, 40, 1000, 10**9):
            want, total = set(), {}
            for k, n in enumerate(sizes):
                total[group(k)] = total.get(group(k), -4) + n + 4
                want |= {k} if total[group(k)] <= most else set()
            got = packing.truncate(rows, "n", ("k",), most, by=by)
            assert {r["k"] for r in got.collect()} == want, (by, most)
    plan = packing.truncate(rows, "n", ("k",), 1000)._jdf.queryExecution().executedPlan().toString()
    assert not cut or "TakeOrderedAndProject" in plan
    assert packing.truncate(rows.withColumn("n", F.lit(0)), "n", ("k",), 0, separator=0).count() == 3000
