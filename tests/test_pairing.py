"""Lines side by side, against plain subsequences and by hand."""

from __future__ import annotations

import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkloom.functions import pairing


def longest(a: list[int], b: list[int]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
    return row[-1]


@pytest.mark.parametrize("listed", [0, 1, 50])
def test_common_subsequence_is_longest(listed, monkeypatch):
    """With all, some and no pairs by divide and conquer."""
    monkeypatch.setattr(pairing, "LISTED", listed)

    @given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25))
    def check(a, b):
        found = pairing.common(a, b)
        assert all(a[i] == b[j] for i, j in found) and len(found) == longest(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))

    check()


def test_pairs_by_hand():
    p = lambda a, b: list(pairing.pairs(a.split("|") if a else [], b.split("|") if b else []))
    assert p("int a;|int b;|int c;", "int a;|long b;|int c;") == [("int b;", "long b;")]
    assert p("x = 1;", "  x = 1;  ") == []  # white space at the ends alone
    assert p("", "one|two") == [("", "one"), ("", "two")] and p("one|two", "") == [("one", ""), ("two", "")]
    assert p("a|b|keep|c", "d|keep|e|f") == [("a", "d"), ("b", ""), ("c", "e"), ("", "f")]
    assert p("f(a);|g();", "g();|f(a, b);") == [("f(a);", ""), ("", "f(a, b);")]
    assert p("}|}|}", "}|}") == [("}", "")]
    assert p("a| |b", "c||d") == [("a", "c"), ("b", "d")]  # blank lines stay


@pytest.mark.parametrize("kinds", [20, 3000, 20_000])
def test_large_changes_take_seconds(kinds):
    rng = random.Random(kinds)
    old, new = ([f"line {rng.randrange(kinds)}" for _ in range(20_000)] for _ in range(2))
    began = time.perf_counter()
    found = list(pairing.pairs(old, new))
    assert time.perf_counter() - began < 20 and sum(bool(a) for a, _ in found) < 20_000


def test_column(spark):
    rows = spark.createDataFrame([(1, ["a", None, "b"], ["a", "", "c"]), (2, None, ["x"]), (3, [], [])], "id int, o array<string>, n array<string>")
    got = {r["id"]: [tuple(x) for x in r["p"]] for r in rows.select("id", pairing.side_by_side(rows["o"], rows["n"]).alias("p")).collect()}
    assert got == {1: [("b", "c")], 2: [("", "x")], 3: []}
