"""Near-duplicate vectors by randomised-rotation binary codes (RaBitQ).

A unit vector x, turned by a random rotation, is stored as the signs s of its components and the correction factor
f = <s / sqrt(d), x>. For any unit y, <s / sqrt(d), y> / f is an unbiased estimate of <x, y>, and its error has a standard
deviation of sqrt((1 - f^2) / (f^2 (d - 1))) * sqrt(1 - <x, y>^2). A pair whose estimate lies more than ``CONFIDENCE`` of
these below the threshold is decided by the bound; every other pair gets its cosine in double precision, and only that
makes a link.

Which pairs are estimated: each vector falls into one bucket of each of several tables, keyed by the signs of further
random directions. The length of a key grows with the logarithm of the number of vectors, so buckets stay small, and the
number of tables is that at which a pair at the threshold shares a bucket with probability ``RECALL``. To the tables go
the codes and factors, and the turned vectors as bytes, whose rounding the bound allows for. Only vectors that have a
partner there which the bound can't rule out are sent themselves, to those tables alone, where the estimates and exact
cosines of pairs are made; most vectors of a corpus have none, and are not sent at all.

A pair that meets in several tables counts in the first. Equal vectors are one vector with a count. A bucket of over
``BLOCK_BYTES`` of vectors is split into blocks, and each two blocks meet in a group of their own, so no task holds more
than two blocks of a bucket and nothing is dropped. Groups give counts and a spanning forest, never their pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of different
length do not link with each other. A cosine of the threshold, as double precision has it, links. Vectors may be of any
length. A null id is part of no class's smallest id. Repeated rows count as vectors of their
own, linked if they are equal. An empty table gives an empty one; columns besides the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import components
from sparkloom.storage import materialize

RECALL, CONFIDENCE, SEED = 0.99, 3.5, 7
#: Vectors that a bucket is meant to have; bytes of those of a block, in double precision; rows of a group.
BUCKET, BLOCK_BYTES, GROUP = 64, 8 << 20, 16_384


@lru_cache(maxsize=8)
def directions(d: int, count: int) -> np.ndarray:
    """Rows of random rotations of d dimensions, one under the other; the first d rows are the code's rotation."""
    rng = np.random.default_rng((SEED, d))
    parts = []
    for _ in range(-(-count // d)):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        parts.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(parts)[:count]


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a key, and tables."""
    bits = min(40, max(4, int(np.ceil(np.log2(max(2, n) / BUCKET)))))
    together = (1 - np.arccos(threshold) / np.pi) ** bits
    return bits, max(1, int(np.ceil(np.log(1 - RECALL) / np.log(1 - together))))


def encode(x: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs and correction factors of unit vectors, and their keys, a column for each table."""
    d = x.shape[1]
    turned = x @ directions(d, d).T
    code = np.packbits(turned >= 0, axis=1)
    factor = np.abs(turned).sum(1) / np.sqrt(d)
    signs = (x @ directions(d, d + bits * tables)[d:].T >= 0).reshape(len(x), tables, bits)
    return code, factor, signs @ (1 << np.arange(bits, dtype=np.int64))


def compare(x: np.ndarray, code: np.ndarray, factor: np.ndarray, keys: np.ndarray, table: int, side: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of a bucket, each with the smaller index first, as far as this table is the first they share.
    side: which of two blocks a vector is in, if only pairs across them count."""
    m, d = x.shape
    turned = x @ directions(d, d).T
    signs = (np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1).T / np.sqrt(d)
    spread = CONFIDENCE * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, d - 1)) * np.sqrt(1 - threshold**2)
    floor = (threshold - spread) * factor if d >= 8 else np.full(m, -np.inf)
    light = turned.astype(np.float32)
    for at in range(0, m, 512):
        near = light[at : at + 512] @ signs >= floor[None, :]
        i, j = np.nonzero(near)
        i += at
        keep = i < j
        if side is not None:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            first = ~(keys[a, :table] == keys[b, :table]).any(1) if table else np.ones(len(a), bool)
            a, b = a[first], b[first]
            linked = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            yield a[linked], b[linked]


def rounded(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turned vectors as bytes, and the steps that these count."""
    step = np.abs(turned).max(1) / 127
    return np.rint(turned / step[:, None]).astype(np.int8), step


def open_rows(q: np.ndarray, step: np.ndarray, code: np.ndarray, factor: np.ndarray, side: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which vectors of a bucket have a partner that the bound can't rule out. A little more than compare() asks for, by what
    rounding can have taken away."""
    m, d = q.shape
    if d < 8:
        return np.ones(m, bool)
    signs = (np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1).T / np.sqrt(d)
    spread = CONFIDENCE * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, d - 1)) * np.sqrt(1 - threshold**2)
    floor = (threshold - spread) * factor
    lost = step * np.sqrt(d) / 2 + 1e-5
    light = q.astype(np.float32) * step[:, None].astype(np.float32)
    out = np.zeros(m, bool)
    for at in range(0, m, 512):
        near = light[at : at + 512] @ signs >= floor[None, :] - lost[at : at + 512, None]
        near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        if side is not None:
            near &= side[at : at + 512, None] != side[None, :]
        out[at : at + 512] |= near.any(1)
        out |= near.any(0)
    return out


def _buckets(rows: pa.Table) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """A group's columns of numbers, and the rows of each of its buckets in order of their vectors."""
    col = {c: rows.column(c).to_numpy() for c in ("d", "t", "key", "low", "high", "block", "uid", "factor")}
    order = np.lexsort((col["uid"], col["high"], col["low"], col["key"], col["t"], col["d"]))
    change = np.zeros(len(order), bool)
    for c in ("d", "t", "key", "low", "high"):
        change[1:] |= col[c][order][1:] != col[c][order][:-1]
    return col, [own for own in np.split(order, np.flatnonzero(change)) if len(own) > 1]


def _unit(flat: bytes, d: int, kind: str) -> np.ndarray:
    x = np.frombuffer(flat, kind).reshape(-1, d).astype("<f8")
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each vector."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(usable, v).alias("v"))
    narrow = materialize(rows.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2")), "rabitq-rows")
    same = rows.filter("v is not null").groupBy(F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")).agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"), F.first("v").alias("v"))
    # numbered once and written, so that the numbers stay
    distinct = materialize(same.withColumn("uid", F.monotonically_increasing_id()), "rabitq-vectors")
    n = distinct.count()
    bits, tables = plan(n, threshold)
    groups = max(1, -(-n * tables // GROUP))
    # what is sent is as narrow as it can be without a loss
    kind = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    key_kind = "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8"

    def vectors_of(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Places, dimension and vectors (as they are sent) of the rows of each dimension."""
        sizes, begin = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            x = flat[begin[own][:, None] + np.arange(d)].astype("<f8")
            if kind == "<f8":
                x /= np.abs(x).max(1)[:, None]  # so that squares neither overflow nor vanish
            yield own, int(d), np.ascontiguousarray(x, kind)

    blobs = lambda a: pa.array([r.tobytes() for r in a], pa.binary())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for own, d, x in vectors_of(batch.column(1)):
                unit = _unit(x.tobytes(), d, kind)
                code, factor, keys = encode(unit, bits, tables)
                q, step = rounded(unit @ directions(d, d).T)
                for part in range(0, len(own), 512):
                    o = slice(part, part + 512)
                    k = len(own[o])
                    rep = lambda a, k=k: np.repeat(a, tables, axis=0)
                    body = [blobs(a[o]).take(pa.array(np.repeat(np.arange(k), tables))) for a in (q, code)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k * tables, d, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), k)), pa.array(keys[o].ravel()), pa.array(rep(uid[own[o]])), pa.array(rep(factor[o])), pa.array(rep(step[o])), *body],
                        names=["d", "t", "key", "uid", "factor", "step", "q", "code"],
                    )

    def still_open(rows: pa.Table) -> pa.Table:
        col, buckets = _buckets(rows)
        step, blob = rows.column("step").to_numpy(), {c: rows.column(c).to_pylist() for c in ("q", "code")}
        found = [np.zeros(0, np.int64)]
        for own in buckets:
            q = np.frombuffer(b"".join([blob["q"][i] for i in own]), np.int8).reshape(len(own), -1)
            code = np.frombuffer(b"".join([blob["code"][i] for i in own]), np.uint8).reshape(len(own), -1)
            side = col["block"][own] if col["low"][own[0]] != col["high"][own[0]] else None
            found.append(own[open_rows(q, step[own], code, col["factor"][own], side, threshold)])
        at = pa.array(np.concatenate(found))
        return pa.table({c: rows.column(c).take(at) for c in ("grp", "d", "t", "key", "low", "high", "block", "uid")})

    entries = distinct.select("uid", "v").mapInArrow(spread, "d int, t int, key long, uid long, factor double, step double, q binary, code binary")
    block = max(64, BLOCK_BYTES // (8 * max(1, distinct.agg(F.max(F.size("v"))).first()[0] or 1)))
    large = entries.groupBy("d", "t", "key").count().filter(F.col("count") > block).select("d", "t", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    large = materialize(large, "rabitq-large")
    dealt = entries.join(large, ["d", "t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("low"), F.greatest("block", j).alias("high"))))
    dealt = dealt.withColumn("p", pair).select(F.pmod(F.xxhash64("d", "t", "key", "p.low", "p.high"), F.lit(groups)).cast("int").alias("grp"), "d", "t", "key", F.col("p.low").alias("low"), F.col("p.high").alias("high"), "block", "uid", "factor", "step", "q", "code")
    left = materialize(dealt.groupBy("grp").applyInArrow(still_open, "grp int, d int, t int, key long, low int, high int, block int, uid long"), "rabitq-open")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, d, x in vectors_of(batch.column(8)):
                code, factor, keys = encode(_unit(x.tobytes(), d, kind), bits, tables)
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:8]), batch.column(9).take(at), pa.array(factor), blobs(x), blobs(code), blobs(keys.astype(key_kind))], names=["grp", "d", "t", "key", "low", "high", "block", "uid", "mult", "factor", "x", "code", "keys"])

    # the vectors themselves, of rows that are still open
    exact = left.join(distinct.select("uid", "v", "mult"), "uid").select("grp", "d", "t", "key", "low", "high", "block", "uid", "v", "mult")
    exact = exact.mapInArrow(sent, "grp int, d int, t int, key long, low int, high int, block int, uid long, mult long, factor double, x binary, code binary, keys binary")

    def within(rows: pa.Table) -> pa.Table:
        col, buckets = _buckets(rows)
        mults = rows.column("mult").to_numpy()
        blob = {c: rows.column(c).to_pylist() for c in ("x", "code", "keys")}
        uids, where = np.unique(col["uid"], return_inverse=True)
        count = np.zeros(len(uids), np.int64)
        parent = np.arange(len(uids))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for own in buckets:
            d, t = int(col["d"][own[0]]), int(col["t"][own[0]])
            x = _unit(b"".join([blob["x"][i] for i in own]), d, kind)
            code = np.frombuffer(b"".join([blob["code"][i] for i in own]), np.uint8).reshape(len(own), -1)
            keys = np.frombuffer(b"".join([blob["keys"][i] for i in own]), key_kind).reshape(len(own), -1)
            side = col["block"][own] if col["low"][own[0]] != col["high"][own[0]] else None
            place, mult = where[own], mults[own]
            for a, b in compare(x, code, col["factor"][own], keys, t, side, threshold):
                np.add.at(count, place[a], mult[b])
                np.add.at(count, place[b], mult[a])
                # links whose ends are together already are told apart from the rest at once
                roots = np.array([root(i) for i in range(len(parent))]) if len(a) > len(parent) else None
                for i, j in zip(place[a].tolist(), place[b].tolist(), strict=True):
                    if roots is not None and roots[i] == roots[j]:
                        continue
                    i, j = root(i), root(j)
                    if i != j:
                        parent[max(i, j)] = min(i, j)
        hit = np.flatnonzero(count)
        return pa.table({"uid": uids[hit], "n": count[hit], "other": uids[[root(i) for i in hit]]} if len(hit) else {"uid": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})

    found = materialize(exact.groupBy("grp").applyInArrow(within, "uid long, n long, other long"), "rabitq-links")
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    label = materialize(components(found.select("uid", "other")), "rabitq-components")
    known = distinct.select("uid", "h1", "h2", "least", "mult").join(label.select(F.col("node").alias("uid"), "component"), "uid", "left").withColumn("component", F.coalesce("component", "uid")).join(counts, "uid", "left")
    known = materialize(known, "rabitq-known")
    # only classes of several distinct vectors need their smallest id looked up
    several = label.select(F.col("node").alias("uid"), "component").join(distinct.select("uid", "least"), "uid").groupBy("component").agg(F.min("least").alias("low"))
    classes = known.join(several, "component", "left").select("h1", "h2", F.coalesce("low", "least").alias("component_id"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = narrow.join(classes, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
