"""Lines of two versions side by side.

The lines that stay are those of a longest common subsequence; what lies between them is paired by place, and the longer
side's rest stands alone. Two lines are the same if they are so but for white space at their ends.

Lines of one side only, and equal lines at both ends, are set aside first. Where the rest has few equal pairs, the common
subsequence comes from their threshold lists (Hunt and Szymanski 1977), in memory of those pairs. Where lines repeat, so
that there are many, it comes by divide and conquer (Hirschberg 1975) on rows of lengths that are kept as the bits of
one number (Hyyrö 2004), in memory of the lines. Neither grows with the square of a change but by the bit.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equal pairs for each line, up to which they are listed.
LISTED = 50


def _bits(row: int, n: int) -> np.ndarray:
    """How many of the lowest 0, 1, .. n bits are not set."""
    raw = np.frombuffer((row & ((1 << n) - 1)).to_bytes(-(-n // 8), "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(raw, bitorder="little", count=n).astype(np.int64))])


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of b and each beginning of a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = whole = (1 << len(a)) - 1
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & whole
    return _bits(row, len(a))


def _listed(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    where: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple | None] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence on both sides, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        here, there = Counter(a[i:n]), Counter(b[j:m])
        equal = sum(count * there[x] for x, count in here.items())
        if equal <= LISTED * (n - i + m - j):
            out += [(i + x, j + y) for x, y in _listed(a[i:n], b[j:m])] if equal else []
        elif m - j == 1:
            out.append((a.index(b[j], i, n), j))
        else:
            half = (j + m) // 2
            left, right = _lengths(a[i:n], b[j:half]), _lengths(a[i:n][::-1], b[half:m][::-1])[::-1]
            cut = i + int(np.argmax(left + right))
            todo += [(i, cut, j, half), (cut, n, half, m)]
    return sorted(out)


def pairs(removed: list[str], added: list[str]) -> Iterator[tuple[str, str]]:
    """Lines that changed, side by side; a side without a line has an empty one."""
    known: dict[str, int] = {}
    a, b = ([known.setdefault(x.strip(), len(known)) for x in side] for side in (removed, added))
    both = set(a) & set(b)
    ours, theirs = ([i for i, x in enumerate(side) if x in both] for side in (a, b))
    stay = [(ours[x], theirs[y]) for x, y in common([a[i] for i in ours], [b[j] for j in theirs])]
    i = j = 0
    for x, y in [*stay, (len(removed), len(added))]:
        old, new = removed[i:x], added[j:y]
        for k in range(max(len(old), len(new))):
            yield old[k] if k < len(old) else "", new[k] if k < len(new) else ""
        i, j = x + 1, y + 1


def side_by_side(removed: Column, added: Column) -> Column:
    """array<struct<old,new>> of two arrays of lines; null arrays and null lines count as empty."""

    @F.pandas_udf("array<struct<old:string,new:string>>")
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        lines = lambda side: [x or "" for x in side] if side is not None else []
        return pd.Series([[{"old": a, "new": b} for a, b in pairs(lines(o), lines(n))] for o, n in zip(old, new, strict=True)], dtype=object)

    return run(removed, added)
