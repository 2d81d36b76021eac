"""What five filters remove from a corpus, alone and after each other, in every order.

A document fails a set of filters: a mask of five bits. A to D look at its text alone; E fails copies of a smaller id's text.

1. ``failures``: an RDD of texts keyed by their 64-bit XXH64 fingerprint. Each task first settles the copies among its own
   texts, so that of a text it sends at most one record a chunk, however often the text occurs. Fingerprints are dealt to
   partitions and sorted there (Spark's sort spills), so a task holds the chain of one fingerprint at a time: the full
   texts that share it, each with the smallest id so far. A row whose id is not the smallest is emitted at once, with E in
   its mask; the rest when the chain ends. Texts are compared whole, so equal fingerprints decide nothing.
2. The rows (id, part, mask) get their labels, and ``combineByKey`` merges for each part a vector of counts by mask.
3. ``effects``: 32 masks of a part give all 120 orders and five steps each.

Defined results: a null text counts as empty. A null lang is the part ''. Rows without an id are never a copy of another nor
its original; rows that repeat an id and its text are no copies of each other. A document is good or toxic if a row of labels
with its id says so; rows without an id have no labels. Labels of absent documents do nothing. Other columns are not looked
at, whatever their names. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import materialize

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = re.compile(rb"[#$%&*|]")
#: A task hands on the texts that it has compared with each other when they have so many bytes.
CHUNK_BYTES = 48 << 20
#: Bytes of text that a partition of fingerprints is meant to get; there are as many as there are input partitions at least.
PART_BYTES = 64 << 20

#: doc_id, part, mask
Row = tuple[int | None, str, int]


def own_mask(text: str, raw: bytes) -> int:
    """Which of the filters A to D a text fails. raw: its UTF-8 bytes."""
    words = raw.split()  # bytes split at ASCII white space only
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * len(text)) << 2 | bool(SIGNS.search(raw)) << 3


class Chain:
    """The texts of one fingerprint: of each its mask, its smallest id and the parts of the rows with that id."""

    def __init__(self) -> None:
        self.links: list[list] = []

    def add(self, raw: bytes, mask: int, doc: int, parts: list[str]) -> Iterator[Row]:
        """Takes in a text's rows with one id; gives the rows that turn out not to have the smallest."""
        for link in self.links:
            if link[0] == raw:
                if doc == link[2]:
                    link[3] = link[3] + parts
                elif doc > link[2]:
                    yield from ((doc, p, mask | COPY) for p in parts)
                else:
                    yield from ((link[2], p, mask | COPY) for p in link[3])
                    link[2:] = [doc, parts]
                return
        self.links.append([raw, mask, doc, parts])

    def smallest(self) -> Iterator[Row]:
        return ((doc, p, mask) for _, mask, doc, parts in self.links for p in parts)


def _compared(rows: Iterator[tuple]) -> Iterator[tuple]:
    """What a task knows of its own texts: rows that are settled, under no fingerprint, and a record for each text of a chunk."""
    chains: dict[int, Chain] = {}
    held = 0

    def out() -> Iterator[tuple]:
        for fingerprint, chain in chains.items():
            for link in chain.links:
                yield fingerprint, tuple(link)

    for doc, text, part in rows:
        text = text or ""
        raw = text.encode()
        mask = own_mask(text, raw)
        if doc is None:
            yield None, (doc, part, mask)
            continue
        fingerprint = xxhash.xxh64_intdigest(raw)
        chain = chains.setdefault(fingerprint, Chain())
        before = len(chain.links)
        for row in chain.add(raw, mask, doc, [part]):
            yield None, row
        held += len(raw) + 200 if len(chain.links) > before else 0
        if held > CHUNK_BYTES:
            yield from out()
            chains.clear()
            held = 0
    yield from out()


def _dealt(key: tuple) -> int:
    return key[1]


def _keyed(record: tuple) -> tuple:
    """Settled rows are dealt by their id, so that they fill no partition; texts by their fingerprint. Settled rows first."""
    fingerprint, x = record
    return ((0, hash(x[0]) & 0xFFFFFFFF), x) if fingerprint is None else ((1, fingerprint), x)


def _resolved(records: Iterator[tuple]) -> Iterator[Row]:
    """The rows of a partition that is sorted by fingerprint, one chain at a time."""
    at, chain = None, Chain()
    for (kind, fingerprint), x in records:
        if kind == 0:
            yield x
            continue
        if fingerprint != at:
            yield from chain.smallest()
            at, chain = fingerprint, Chain()
        yield from chain.add(*x)
    yield from chain.smallest()


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> RDD:
    """(id, part, mask) of every row."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))).rdd
    n = max(1, rows.getNumPartitions(), -(-size // PART_BYTES))
    return rows.mapPartitions(_compared).map(_keyed).repartitionAndSortWithinPartitions(n, _dealt).mapPartitions(_resolved)


def _vector(x: tuple[int, int, int, int]) -> np.ndarray:
    return _plus(np.zeros((3, MASKS), np.int64), x)


def _plus(v: np.ndarray, x: tuple[int, int, int, int]) -> np.ndarray:
    mask, n, good, toxic = x
    v[:, mask] += (n, n * good, n * toxic)
    return v


def counts(rows: DataFrame, labels: DataFrame) -> RDD:
    """(part, vectors of all, good and toxic documents by mask). rows: doc_id, part, mask, n."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(marks, F.col("doc_id") == F.col("_id"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    return marked.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_vector, _plus, np.add)


def effects(part: str, v: np.ndarray) -> Iterator[tuple]:
    """A part's rows: each filter's effects at each step of each order."""
    masks = np.arange(MASKS)
    fails = {f: (masks >> k & 1).astype(bool) for k, f in enumerate(FILTERS)}
    orders = ["".join(p) for p in permutations(FILTERS)]
    every = {f: 0 for f in FILTERS}
    rows = []
    for order in orders:
        left = np.ones(MASKS, bool)
        for step, f in enumerate(order, 1):
            gone = left & fails[f]
            redundant = ~left & fails[f]
            left = left & ~gone
            removed, good, toxic = v[:, gone].sum(axis=1).tolist()
            every[f] += removed
            rows.append((part, order, step, int(v[0, left].sum()), removed, int(v[0, redundant].sum()), int(v[0, 1 << FILTERS.index(f)]), good, toxic))
    return ((*r, every[r[1][r[2] - 1]]) for r in rows)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each part,
    order and step."""
    spark = docs.sparkSession
    found = spark.createDataFrame(failures(docs), "doc_id long, part string, mask int", verifySchema=False)
    rows = materialize(found.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")), "masks")
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return spark.createDataFrame(counts(rows, labels).flatMap(lambda kv: effects(*kv)), schema, verifySchema=False)


#: The same rows.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
     w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                  min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
     m AS (SELECT doc_id, part,
                  (len(words) < 100)::INT AS a,
                  (100 * len(list_distinct(words)) < 80 * len(words))::INT AS b,
                  (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT AS c,
                  regexp_matches(text, '[#$%&*|]')::INT AS d,
                  coalesce(first_id < doc_id, FALSE)::INT AS e FROM w),
     l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic
           FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
     v AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
           FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
     f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
     o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM f p, f q, f r, f s, f t
           WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
     g AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before
           FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
     h AS (SELECT *, concat(CASE WHEN a = 1 THEN 'A' ELSE '' END, CASE WHEN b = 1 THEN 'B' ELSE '' END,
                            CASE WHEN c = 1 THEN 'C' ELSE '' END, CASE WHEN d = 1 THEN 'D' ELSE '' END,
                            CASE WHEN e = 1 THEN 'E' ELSE '' END) AS fails FROM v),
     k AS (SELECT part, filter_order, step, x, fails, n, good, toxic, contains(fails, x) AS own,
                  fails <> translate(fails, before, '') AS earlier FROM h, g),
     r AS (SELECT part, filter_order, step, x,
                  coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0)::BIGINT AS kept,
                  coalesce(sum(n) FILTER (own AND NOT earlier), 0)::BIGINT AS removed,
                  coalesce(sum(n) FILTER (own AND earlier), 0)::BIGINT AS redundant,
                  coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
                  coalesce(sum(good) FILTER (own AND NOT earlier), 0)::BIGINT AS good_lost,
                  coalesce(sum(toxic) FILTER (own AND NOT earlier), 0)::BIGINT AS toxic_lost
           FROM k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM r
"""
