"""Search for many queries by blocks, against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import blocks, vector
from sparkloom.plans.catalogue import QUERIES

SAMPLES = "sampling int, vec array<double>, doc_id string, series string"


def rows() -> list[tuple]:
    rng = random.Random(4)
    out = [(k, [rng.gauss(0, 1) for _ in range(5)], f"d{k % 7}", "ST"[k % 2]) for k in range(160)]
    out += [(200 + k, out[k][1], "copy", "S") for k in range(20)]  # ties
    out += [(300, [0.0] * 5, "zero", "S"), (301, None, "none", "S"), (302, [], "empty", "S"), (303, [1.0, None, 0.0, 0.0, 0.0], "hole", "S"), (304, [1.0, 2.0], "short", "S"), (305, [2.0, 4.0], "short", "S"), (None, out[0][1], "no key", "S")]
    return out


def cosine(a: list | None, b: list | None) -> float | None:
    if not a or not b or len(a) != len(b) or None in a or None in b:
        return None
    size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 6) if size else None


def wanted(most: int, by_series: bool) -> set[tuple]:
    out = set()
    for asked, q, _, series in rows():
        if asked is None or asked % 5:
            continue
        theirs = [(k, cosine(v, q)) for k, v, _, s in rows() if k is not None and k != asked and (not by_series or s == series)]
        theirs.sort(key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        out |= {(asked, k, c) for k, c in theirs[:most]}
    return out


@pytest.fixture(scope="module")
def tables(spark):
    samples = spark.createDataFrame(rows(), SAMPLES).repartition(6)
    return samples, samples.filter("sampling % 5 = 0").select(F.col("sampling").alias("asked"), "series", F.col("vec").alias("query"))


@pytest.mark.parametrize(("most", "query_bytes", "cell", "by"), [(1, 64, 16, ()), (12, 400, 30, ()), (12, 1 << 20, 1 << 20, ("series",)), (7, 200, 9, ("series",)), (1000, 100, 50, ())])
def test_nearest_as_brute_force(tables, monkeypatch, most, query_bytes, cell, by):
    """In one cell and in many, with fewer and more samples than are wanted."""
    monkeypatch.setattr(blocks, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(blocks, "CELL_SAMPLES", cell)
    samples, asked = tables
    found = blocks.near(samples, asked if by else asked.drop("series"), most, "asked", by=by).withColumn("similarity", F.round("similarity", 6))
    got = {(r["asked"], r["sampling"], r["similarity"]) for r in vector.first_rows(found, (F.desc_nulls_last("similarity"), "sampling"), most, "asked", *by).collect()}
    assert got == wanted(most, bool(by))


def test_few_rows_beyond_the_wanted_come_out(tables):
    samples, asked = tables
    assert blocks.near(samples, asked.drop("series"), 5, "asked").count() < 12 * asked.count()


def test_plan_has_no_join_of_pairs(tables):
    samples, asked = tables
    plan = blocks.near(samples, asked.drop("series"), 5, "asked")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_sides(tables):
    samples, asked = tables
    assert blocks.near(samples.limit(0), asked.drop("series"), 5, "asked").count() == 0
    assert blocks.near(samples, asked.drop("series").limit(0), 5, "asked").count() == 0


def test_queries_ask_every_hundredth_vector(spark, sf_dir):
    asked = {r[0] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 100 = 0").select("vec_id").collect()}
    for name in ("knn_topk", "hits_by_doc_max", "series_search"):
        assert {r["asked"] for r in QUERIES[name](spark, sf_dir).collect()} == asked
