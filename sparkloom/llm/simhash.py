"""SimHash near-duplicates, found with vantage-point trees over Hamming space.

A fingerprint sums up the hashes of a text's word shingles. Distinct fingerprints are dealt to shards by a vantage-point
tree that is grown on the driver from a bounded sample: a node holds a fingerprint and a radius, and those within the
radius go to one side. A pair of fingerprints at most r apart that a node separates has its inner one within r of the
boundary (the triangle bound), so only the inner ones near the boundary also visit the other side; visitors go on below
wherever the bound lets them have a partner. Every shard grows its own tree over its fingerprints in the same way down
to small blocks, which are compared in full. So all pairs within r are found, whatever the sample was.

A shard gives a spanning forest of its links (one link for each fingerprint at most), not its pairs, and connected
components of the forests are the classes. Texts with the same fingerprint are one fingerprint all the way.

``near_duplicates`` links texts by their fingerprints alone. ``near_copies`` links texts whose sets of shingles have a
Jaccard similarity of at least so much. The fingerprints of two such texts lie too far apart for any tree to prune by
(at 0.8 some 10 of 64 bits differ, of unrelated texts 32 plus or minus 4), so each text also has ``BANDS`` band values, each
of ``BAND`` minima of its shingles' hashes under random permutations: a pair at 0.8 shares one with probability 0.998.
Texts that share a band value, and fingerprints that the trees find close, are candidates, and the similarity of the whole
sets decides. Within a band all are held against one leader: the text whose band values most others share, which is the
middle of a group of copies if the group has one. Those who are not like it meet again in the next round under a key of one
band more, which few but those that are more alike than that share, until no key has two of them left. So pairs grow with
the texts and not with a group's square, and texts with equal sets are one text all the way.

That joins most of what is alike, but not all: the trees give a forest whose links need not be alike themselves, bands can
miss, and a text may be like none of its leaders. ``joined`` finds the rest, whatever the first part has found, by prefixes:
with the shingles of every set in one order, the rarest first, two sets at the similarity share one among the first fifth
of each (at 0.8), and where it stands bounds what they can share in all. Only pairs that lie in different components so far
are compared. The order is by the exact number of sets that have a shingle, but for those in a hundredth of a bounded sample,
which come last; any order gives the same result, and this one few pairs. Of a large group just below the similarity nearly
all pairs share such shingles. They are compared inside tasks by sketches, whose bits bound the difference of two sets from
below, and are no rows; a set asks the nearest first, and those of a component that it has been joined to need not be asked.

Null and empty texts have fingerprint zero and no shingles, and are linked like any other. A row whose id is null gets its
fingerprint and the component of the others (null if there is none). Very long texts are read whole, in parts. Ties go to
the smallest id, and repeated rows get repeated results; an empty table gives an empty one; columns besides the id and the
text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.arrow import LARGE, bounded, give_back, pieces, tidy, unused
from sparkloom.llm.components import components
from sparkloom.storage import fitted, held_bytes, materialize, remove, reread, scratch

SEED = 42
#: Fingerprints of the sample for each shard of the tree that is grown from it; fingerprints meant for a shard; shards at
#: most, whose tree and sample (8 MB) the driver holds. At 10 thousand million distinct fingerprints a shard has 150,000 of
#: them, which take 1 MB.
SAMPLE, SHARD, MAX_SHARDS = 15, 6_000, 65_536
#: Bands of near_copies, and minima in each.
BANDS, BAND = 16, 5
#: Ids that are sent to all machines take at most so much in memory; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Fingerprints of a block that is compared in full.
BLOCK = 256
#: Shingles that a task deals to buckets at a time, of which a worker holds about 80 bytes each; shingles meant for a bucket, 12
#: bytes each; buckets at most, as a power of 2; rows of shingles in a batch that a worker hands to Spark.
DEALT, BUCKET, BUCKET_BITS, HANDED = 1 << 18, 1 << 19, 16, 1 << 16
#: Sets of the sample in which shingles count as common if a hundredth has them, and where those stand in the order.
COMMON_SAMPLE, COMMON = 4_096, 1 << 30
#: Bits of a sketch for each shingle of its set, and at most; sets of a shingle that meet in a cell, on each side; early shingles
#: meant for a task; pairs that are looked at in one go; what ranks count in, of all shingles of a pair.
SKETCH, SKETCH_BITS, CELL, MEET, MET, RANKS = 4, 1 << 15, 2_048, 256, 1 << 17, 1_000_000


def hashes(text: str | None, shingle: int = 3) -> Iterator[np.ndarray]:
    """The hashes of the text's shingles, in parts of bounded size."""
    from xxhash import xxh64_intdigest as xxh

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and blanks are 0x20 and 0x09 to 0x0D
    if not words:
        return
    line = b" ".join(words)
    ends = [n + i for i, n in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    size = max(1, len(words) - shingle + 1)
    for at in range(0, size, 1 << 16):
        upto = min(size, at + (1 << 16))
        yield np.array([xxh(line[s:e], SEED) for s, e in zip(starts[at:upto], ends[at + min(shingle, len(words)) - 1 : upto + shingle - 1], strict=False)], np.uint64)


def _majority(parts: list[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes."""
    counts, size = np.zeros(64, np.int64), sum(map(len, parts))
    for h in parts:
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > size).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes, repeats included."""
    return _majority(list(hashes(text, shingle)))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return tuple(rng.integers(0, 1 << 64, (BANDS * BAND, 1), dtype=np.uint64) | np.uint64(k) for k in (1, 0))


def bands(grams: np.ndarray) -> np.ndarray:
    """The band values of a set of hashes, as longs."""
    factor, shift = _permutations()
    low = np.full(BANDS * BAND, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 4096):
        low = np.minimum(low, (grams[None, at : at + 4096] * factor + shift).min(1))
    value = np.zeros(BANDS, np.uint64)
    for column in low.reshape(BANDS, BAND).T:
        value = (value ^ column) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value.view(np.int64)


def signatures(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text), fp, same (a digest of the set of shingles), bands, grams (the set, as 32-bit hashes),
    more (a byte for each of them: the next 8 bits of its hash)."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps, same, values, sets, more = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                parts = list(hashes(text, shingle))
                grams = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                fps.append(_majority(parts))
                same.append(xxh3_128_digest(grams.tobytes()))
                values.append(bands(grams))
                short, first = np.unique((grams >> np.uint64(32)).astype(np.uint32), return_index=True)
                sets.append(short.view(np.int32))
                more.append((grams[first] >> np.uint64(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(same, pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32())), pa.array(more, pa.binary())], names=["doc_id", "th", "fp", "same", "bands", "grams", "more"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, th long, fp long, same binary, bands array<long>, grams array<int>, more binary")


@dataclass
class Node:
    """Of a vantage-point tree; shard is the number of a leaf."""

    shard: int = -1
    point: int = 0
    radius: int = 0
    inner: Node | None = None
    outer: Node | None = None


def _split(points: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """A vantage point, the radius that halves the points best, and their distances; None if nothing splits them."""
    best = None
    for vantage in points[:: max(1, len(points) // 5)][:5]:
        far = np.bitwise_count(points ^ vantage).astype(np.int64)
        within = np.cumsum(np.bincount(far, minlength=65))
        radius = int(np.argmin(np.abs(within - len(points) / 2)))
        near_edge = np.count_nonzero((far <= radius) & (far > radius - 2)) / len(points)
        worth = abs(within[radius] / len(points) - 0.5) + near_edge
        if 0 < within[radius] < len(points) and (best is None or worth < best[0]):
            best = worth, int(vantage), radius, far
    return best and best[1:]


def grow(points: np.ndarray, shards: int) -> Node:
    """A tree over distinct points with about so many leaves, each with as many of the points."""
    size, count = max(1, len(points) // max(1, shards)), 0

    def below(own: np.ndarray) -> Node:
        nonlocal count
        parts = _split(own) if len(own) > size * 1.5 else None
        if parts is None:
            count += 1
            return Node(shard=count - 1)
        point, radius, far = parts
        return Node(-1, point, radius, below(own[far <= radius]), below(own[far > radius]))

    return below(points)


def deal(tree: Node, points: np.ndarray, r: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shards with the indices of the points at home there and of those that visit."""
    none = np.zeros(0, np.int64)
    stack = [(tree, np.arange(len(points)), none)]
    while stack:
        node, home, guests = stack.pop()
        if not len(home) and not len(guests):
            continue
        if node.shard >= 0:
            yield node.shard, home, guests
            continue
        h = np.bitwise_count(points[home] ^ np.uint64(node.point)).astype(np.int64)
        g = np.bitwise_count(points[guests] ^ np.uint64(node.point)).astype(np.int64)
        stack.append((node.inner, home[h <= node.radius], guests[g - r <= node.radius]))
        stack.append((node.outer, home[h > node.radius], np.concatenate([guests[g + r > node.radius], home[(h <= node.radius) & (h + r > node.radius)]])))


def forest(home: np.ndarray, guests: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within r among the home points, and between them and guests, thinned to a spanning forest."""
    points = np.concatenate([home, guests])
    parent = np.arange(len(points))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def compare(own: np.ndarray, visiting: np.ndarray) -> None:
        """In blocks of bounded size. Of a block, each point is joined to the smallest it reaches within the block."""
        for i in range(0, len(own), BLOCK):
            a = own[i : i + BLOCK]
            for other in (own[i:], visiting):
                for j in range(0, len(other), 4 * BLOCK):
                    b = other[j : j + 4 * BLOCK]
                    close = np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= r
                    if np.count_nonzero(close) == (len(a) if other is not visiting and j == 0 else 0):
                        continue
                    label = np.where(close.any(1), a[0], -1)
                    first = np.argmax(close, axis=1)  # each row's first partner, and each column's first row
                    upper = np.argmax(close, axis=0)
                    pairs = [(a[x], b[first[x]]) for x in np.flatnonzero(label >= 0)] + [(a[upper[y]], b[y]) for y in np.flatnonzero(close.any(0))]
                    for x, y in pairs:
                        x, y = root(x), root(y)
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                    # what the first partners leave apart
                    ra = np.array([root(x) for x in a])
                    rb = np.array([root(y) for y in b])
                    for x, y in zip(*np.nonzero(close & (ra[:, None] != rb[None, :])), strict=True):
                        p, q = root(a[x]), root(b[y])
                        if p != q:
                            parent[max(p, q)] = min(p, q)

    stack = [(np.arange(len(home)), np.arange(len(home), len(points)))]
    while stack:
        own, visiting = stack.pop()
        if not len(own):
            continue
        parts = _split(points[own]) if len(own) > BLOCK else None
        if parts is None:
            compare(own, visiting)
            continue
        point, radius, h = parts
        g = np.bitwise_count(points[visiting] ^ np.uint64(point)).astype(np.int64)
        stack.append((own[h <= radius], visiting[g - r <= radius]))
        stack.append((own[h > radius], np.concatenate([visiting[g + r > radius], own[(h <= radius) & (h + r > radius)]])))
    at = np.array([root(x) for x in range(len(points))], np.int64)
    linked = np.flatnonzero(at != np.arange(len(points)))
    return points[linked], points[at[linked]]


def links(distinct: DataFrame, r: int) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that join all those at most r bits apart."""
    spark = distinct.sparkSession
    n = distinct.count()
    shards = min(MAX_SHARDS, max(1, -(-n // SHARD)))
    wanted = max(4_096, SAMPLE * shards)
    share = min(1.0, wanted / max(1, n))
    sample = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else distinct
    points = np.unique(np.array([x[0] for x in sample.select("fp").limit(2 * wanted).collect()], np.int64).view(np.uint64))
    tree = grow(np.random.default_rng(SEED).permutation(points), shards)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for shard, home, guests in deal(tree, fps.view(np.uint64), r):
                at = np.concatenate([home, guests])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(fps[at]), pa.array(np.arange(len(at)) < len(home))], names=["shard", "fp", "home"])

    def within(rows: pa.Table) -> pa.Table:
        fps = rows.column("fp").to_numpy().view(np.uint64)
        home = rows.column("home").to_numpy()
        a, b = forest(fps[home], fps[~home], r)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = distinct.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(within, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable over fingerprints at most so many
    bits apart)."""
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    with scratch(docs.sparkSession):
        distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
        label = materialize(components(links(distinct, bits)), "simhash-components")
        named = label.join(distinct, label["node"] == distinct["fp"]).select("component", "fp", "first")
        least = named.groupBy("component").agg(F.min("first").alias("least"))
        linked = named.join(least, "component").select(F.col("fp").alias("linked"), "least")
        alone = distinct.select(F.col("fp").alias("known"), "first")
        classes = alone.join(linked, F.col("known") == F.col("linked"), "left").select("known", F.coalesce("least", "first").alias("component_id"))
        classes = materialize(classes, "simhash-classes", outlive=True)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(classes, rows["fp"] == classes["known"]).select("doc_id", hexed, "component_id")


def only(rows: DataFrame, uids: DataFrame) -> DataFrame:
    """The rows with these uids (a table of distinct ones)."""
    return rows.join(fitted(uids, BROADCAST_BYTES), "uid", "left_semi")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (uid, grams) have a Jaccard similarity of at least so much. Only the sets of texts in
    some pair are moved, if the list of those can be sent to all machines."""
    held = only(sets, materialize(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "simhash-used"))
    first, second = (held.select(F.col("uid").alias(n), F.col("grams").alias(f"g{n}")) for n in ("a", "b"))
    both = pairs.join(first, "a").join(second, "b")
    common = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - common
    return both.filter((union == 0) | (common >= similarity * union - 1e-9)).select("a", "b")


def common_grams(reps: DataFrame) -> np.ndarray:
    """The shingles (32 bits, sorted) that a hundredth of a bounded sample of the sets has."""
    share = min(1.0, COMMON_SAMPLE / max(1, reps.count()))
    sample = reps.filter(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counted = sample.select(F.explode("grams").alias("gram")).groupBy("gram").count().filter(F.col("count") >= COMMON_SAMPLE // 100)
    return np.sort(np.array([r["gram"] for r in counted.select("gram").collect()], np.int32).view(np.uint32))


def shared_grams(reps: DataFrame) -> DataFrame:
    """uid, key (of a shingle that other sets have as well), df (how many sets have it; COMMON for the common ones, whether
    others have them or not). Tasks send shingles and the ids of their sets in blocks to buckets by hash, where they are
    counted. Common shingles are dealt by task, so that no bucket has much more than others."""
    total = reps.agg(F.sum(F.size("grams").cast("long"))).first()[0] or 0
    bits = min(BUCKET_BITS, max(0, int(total // BUCKET).bit_length()))
    common = common_grams(reps)

    def block(grams: list[np.ndarray], nexts: list[np.ndarray], uids: list[np.ndarray], salt: int) -> pa.RecordBatch:
        gram, uid = np.concatenate(grams), np.concatenate(uids)
        bucket = (((np.concatenate(nexts).astype(np.uint32) << np.uint32(8)) | (gram >> np.uint32(24))) >> np.uint32(16 - bits)).astype(np.int32)
        if len(common):
            is_common = common[np.minimum(np.searchsorted(common, gram), len(common) - 1)] == gram
            bucket[is_common] = (1 << bits) + salt % (1 << bits)
        order = np.argsort(bucket, kind="stable")
        numbers, starts = np.unique(bucket[order], return_index=True)
        gram, uid, ends = gram[order], uid[order], [*starts[1:], len(order)]
        cut = list(zip(starts, ends, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([gram[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([uid[i:j].tobytes() for i, j in cut], pa.binary())], names=["bucket", "grams", "uids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, nexts, uids, held = [], [], [], 0
        for batch in pieces(batches):
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            grams.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint32))
            nexts.append(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8))
            uids.append(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes))
            held += len(uids[-1])
            if held >= DEALT:
                out = block(grams, nexts, uids, int(uids[-1][-1]))
                grams, nexts, uids, held = [], [], [], 0
                yield out
        if held:
            yield block(grams, nexts, uids, int(next(u for u in reversed(uids) if len(u))[-1]))

    def read(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        gram = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("grams")])
        return gram, np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("uids")])

    def handed(uid: np.ndarray, gram: np.ndarray, df: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(uid), HANDED):
            part = slice(at, at + HANDED)
            yield pa.RecordBatch.from_arrays([pa.array(uid[part]), pa.array(gram[part].astype(np.int64) | (bucket << 32)), pa.array(df[part].astype(np.int32))], names=["uid", "key", "df"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        bucket, rows = first.column("bucket")[0].as_py(), chain([first], batches)
        if bucket >= 1 << bits:  # not counted, so none is held
            for gram, uid in map(read, rows):
                yield from handed(uid, gram, np.full(len(uid), COMMON), 0)
            return
        gram, uid = (np.concatenate(x) for x in zip(*map(read, rows), strict=True))
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        sizes = np.diff(np.append(starts, len(gram))).astype(np.int32)
        df = np.repeat(sizes, sizes)
        many = df > 1
        yield from handed(uid[order[many]], gram[many], df[many], bucket)
        if len(gram) * 12 >= LARGE:
            give_back()

    dealt = bounded(reps).select("uid", "grams", "more").mapInArrow(run, "bucket int, grams binary, uids binary")
    return dealt.groupBy("bucket").applyInArrow(count, "uid long, key long, df int")


def sketch(grams: np.ndarray) -> np.ndarray:
    """For each residue of the shingles (32 bits each) whether an odd number of them has it, as 64-bit words. The sketches of
    two sets differ in no more bits than the sets in shingles. Halves laid over each other are the sketch of half the bits."""
    bits = min(SKETCH_BITS, max(64, 1 << (SKETCH * len(grams) - 1).bit_length()))
    return np.packbits(np.bincount(grams & np.uint32(bits - 1), minlength=bits) % 2 == 1).view(np.uint64)


def sketches(sets: DataFrame) -> DataFrame:
    """uid, sketch of sets (uid, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = [sketch(x.values.to_numpy(zero_copy_only=False).view(np.uint32)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["uid", "sketch"])

    return bounded(sets).select("uid", "grams").mapInArrow(run, "uid long, sketch binary")


def met(rows: pa.Table, similarity: float, each: int | None) -> pa.Table:
    """The pairs (a, b) of the cells in the rows that may be so alike, as far as their components, sizes, places and sketches
    tell, with their rank: the share of shingles in which they differ at least. Of each that asks and each cell the first so
    many that come after those it has asked before."""
    uid, component, size, left, after_rank, after = (rows.column(c).to_numpy() for c in ("uid", "component", "size", "left", "after_rank", "after"))
    asks, there = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "there"))
    words = rows.column("sketch").to_pylist()
    width = np.array([len(w) // 8 for w in words])
    bits, place = {}, np.zeros(len(width), np.int64)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        bits[w], place[own] = np.frombuffer(b"".join(words[k] for k in own), np.uint64).reshape(-1, w), np.arange(len(own))

    def taken(which: np.ndarray, w: int, upto: int) -> np.ndarray:
        out = bits[w][place[which]]
        while out.shape[1] > upto:
            out = out[:, : out.shape[1] // 2] ^ out[:, out.shape[1] // 2 :]
        return out

    cells = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")])
    order = np.lexsort(cells)
    edges = np.flatnonzero((np.diff(cells[:, order]) != 0).any(0)) + 1
    found = [np.zeros((3, 0), np.int64)]
    for cell in np.split(order, edges):
        own, others = cell[asks[cell]], cell[there[cell]]
        step = max(1, MET // max(1, len(others)))
        for at in range(0, len(own), step):
            a, b = own[at : at + step, None], others[None, :]
            total = size[a] + size[b]
            fits = (component[a] != component[b]) & (np.minimum(left[a], left[b]) + 1 >= similarity / (1 + similarity) * total - 1e-6)
            fits &= np.minimum(size[a], size[b]) + 1e-6 >= similarity * np.maximum(size[a], size[b]) - 1
            x, y = np.nonzero(fits)
            x, y = own[at + x], others[y]
            differ = np.zeros(len(x), np.int64)
            for wx, wy in {*zip(width[x].tolist(), width[y].tolist(), strict=True)}:
                some, w = np.flatnonzero((width[x] == wx) & (width[y] == wy)), min(wx, wy)
                for part in np.split(some, range(MET * 8 // w, len(some), MET * 8 // w)):
                    differ[part] = np.bitwise_count(taken(x[part], wx, w) ^ taken(y[part], wy, w)).sum(1, dtype=np.int64)
            total = size[x] + size[y]
            rank = differ * RANKS // total
            good = (differ <= (1 - similarity) / (1 + similarity) * total + 1e-6) & ((rank > after_rank[x]) | ((rank == after_rank[x]) & (uid[y] > after[x])))
            x, y, rank = uid[x[good]], uid[y[good]], rank[good]
            first = np.lexsort((y, rank, x))
            x, y, rank = x[first], y[first], rank[first]
            starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            number = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
            near = slice(None) if each is None else number < each
            found.append(np.stack([x[near], y[near], rank[near]]))
    return pa.table(dict(zip(("a", "b", "rank"), np.concatenate(found, axis=1), strict=True)))


def early(reps: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """key, uid, size, left (shingles from there on), outside (the component that has most sets of the key) of the shingles by
    which sets meet that a label (node, component) leaves apart and that may be so alike. One shingle more than the bounds
    ask for is taken, as two may share their 32 bits."""
    shared = materialize(shared_grams(reps), "simhash-shingles")
    # the first of a set, the rarest first, of which two that are alike share one
    first = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 2
    sizes = reps.select("uid", F.size("grams").alias("size")).join(shared.groupBy("uid").agg(F.count("*").alias("n")), "uid")
    open_ = sizes.filter(F.col("size") - F.col("n") < first)  # the others have enough that no other set has
    open_ = open_.join(label.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    open_ = materialize(open_, "simhash-open-sets")
    ranked = shared.join(fitted(open_, BROADCAST_BYTES), "uid")
    place = F.col("size") - F.col("n") + F.row_number().over(Window.partitionBy("uid").orderBy("df", "key"))  # from 1
    keys = ranked.withColumn("place", place).filter(F.col("place") <= first)
    keys = keys.select("key", "uid", "component", F.col("size").cast("long"), (F.col("size") - F.col("place") + 1).cast("long").alias("left"))
    keys = materialize(keys, "simhash-keys")
    parts = keys.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    return materialize(keys.join(mixed, "key").select("key", "uid", "size", "left", (F.col("component") != F.col("most")).alias("outside")), "simhash-mixed")


def apart(keys: DataFrame, drawn: DataFrame, label: DataFrame, similarity: float, each: int | None = None, asking: DataFrame | None = None) -> DataFrame:
    """a, b, rank: pairs of early shingles' sets in different components that may be so alike, repeated if they share several.
    Of each shingle, the sets outside ask all, or those of them that are asking (uid, after_rank, after), for the first so many
    of each. Who is outside stays as it was, whatever the label joins later, so that what one has asked is asked. Sets that
    share a shingle are compared in cells of a grid by their sketches (drawn), so that only pairs that pass become rows."""
    if asking is None:
        asking = keys.filter("outside").select("uid").distinct().select("uid", *(F.lit(-1).cast("long").alias(c) for c in ("after_rank", "after")))
    named = keys.join(fitted(label.withColumnRenamed("node", "uid"), BROADCAST_BYTES), "uid", "left").join(fitted(asking, BROADCAST_BYTES), "uid", "left")
    named = named.withColumn("component", F.coalesce("component", "uid")).withColumn("ask", F.col("outside") & F.col("after").isNotNull()).fillna(-1, ["after_rank", "after"])
    mixed = named.groupBy("key").agg(F.count("*").alias("n"), F.count_if("ask").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    rows = named.join(mixed.filter("m > 0 and low <> high").drop("low", "high"), "key").join(fitted(drawn, BROADCAST_BYTES), "uid")
    down, across = F.ceil(F.col("m") / CELL), F.ceil(F.col("n") / CELL)
    rows = rows.withColumn("down", down).withColumn("across", across).withColumn("own_i", F.pmod(F.xxhash64("uid", F.lit(1)), "down")).withColumn("own_j", F.pmod(F.xxhash64("uid"), "across"))
    met_in = F.transform(F.sequence(F.lit(0).cast("long"), F.col("down") - 1), lambda i: F.struct(i.alias("i"), F.col("own_j").alias("j"), (F.col("ask") & (i == F.col("own_i"))).alias("asks"), F.lit(True).alias("there")))
    asks_in = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("across") - 1), lambda j: F.col("ask") & (j != F.col("own_j"))), lambda j: F.struct(F.col("own_i").alias("i"), j.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("there")))
    rows = rows.withColumn("cell", F.explode(F.concat(met_in, asks_in))).select("key", "cell.*", "uid", "component", "size", "left", "after_rank", "after", "sketch")
    tasks = 1 + keys.count() // MEET
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(tidy(lambda group: met(group, similarity, each)), "a long, b long, rank long")


def pairs_of(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def remaining(reps: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) that a label (node, component) leaves apart and whose sets may have so high a Jaccard similarity:
    none that have it is missing."""
    keys = early(reps, label, similarity)
    return pairs_of(apart(keys, sketches(only(reps, keys.select("uid").distinct())), label, similarity))


def joined(reps: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """The label (node, component) with the components joined that it leaves apart although two of their sets have so high a
    Jaccard similarity. Round by round each set asks the one of another component that differs least from it, four times as
    many in each round, until it has asked all that its components leave it: so pairs that need not be asked, as others have
    joined them by then, are none."""
    keys = early(reps, label, similarity)
    sets = materialize(only(reps, materialize(keys.select("uid").distinct(), "simhash-open")).select("uid", "grams"), "simhash-sets")
    drawn = materialize(sketches(sets), "simhash-sketches")
    each, asking = 1, None
    while True:
        found = apart(keys, drawn, label, similarity, each, asking).distinct()
        number = F.row_number().over(Window.partitionBy("a").orderBy("rank", "b"))
        found = materialize(found.withColumn("number", number).filter(F.col("number") <= each), "simhash-remaining")
        if found.isEmpty():
            return label
        more = materialize(alike(pairs_of(found), sets, similarity), "simhash-more")
        if not more.isEmpty():
            label = materialize(components(label.toDF("a", "b").unionByName(more)), "simhash-joined")
        last = F.max(F.struct("rank", "b")).alias("last")
        asking = found.groupBy("a").agg(F.count("*").alias("n"), last).filter(F.col("n") == each).select(F.col("a").alias("uid"), F.col("last.rank").alias("after_rank"), F.col("last.b").alias("after"))
        asking = materialize(asking, "simhash-asking")
        if asking.isEmpty():
            return label
        each *= 4


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text), component_id (the smallest id reachable over texts so alike in their shingles, or the
    row's own if all lack one), kept (of each component the row with the smallest id and th). Written to a table."""
    spark = docs.sparkSession
    with scratch(spark):
        rows = materialize(signatures(docs, shingle, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "simhash-signatures")
        best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "uid")).alias("best")
        texts = materialize(rows.groupBy("same").agg(best).select("same", "best.*"), "simhash-texts")
        reps = only(rows, texts.select("uid"))
        if held_bytes(texts.select("uid")) > BROADCAST_BYTES:
            reps = materialize(reps, "simhash-reps")  # sets are moved once for it, and not at each use
        sets = bands_of = reps
        # from the trees: fingerprints that are close, and texts that share one
        owners = materialize(reps.groupBy("fp").agg(F.min("uid").alias("owner")), "simhash-owners")
        near = links(owners.select("fp"), bits).toDF("x", "y")
        near = near.join(owners.toDF("x", "a"), "x").join(owners.toDF("y", "b"), "y").select("a", "b")
        equal = reps.join(owners, "fp").filter("uid <> owner").select(F.col("uid").alias("a"), F.col("owner").alias("b"))
        close = near.unionByName(equal)
        found = []
        # from the bands, round by round, each with one band more in its key; with the first the pairs of the trees
        members = reps.select("uid", F.size("grams").alias("size"), F.posexplode("bands").alias("band", "value"))
        # a value that no other text has is no key, now or with more bands, and most are such
        shared = members.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1")
        members = materialize(members.join(shared, ["band", "value"]), "simhash-shared")
        company = members.groupBy("uid").agg(F.sum("n").alias("company"))
        members, where = reread(members.drop("n").join(company, "uid"), "simhash-members")
        for step in range(1, BANDS + 1):
            leaders = members.groupBy("band", "value").agg(F.max_by(F.struct("uid", "size"), F.struct("company", F.xxhash64("uid"))).alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
            asked = members.join(leaders, ["band", "value"]).filter("uid <> lead.uid").select("band", "company", "size", F.col("uid").alias("a"), F.col("lead.uid").alias("b"), F.col("lead.size").alias("other"))
            asked = materialize(asked, "simhash-asked")
            remove(spark, where)
            if step > 1 and asked.isEmpty():
                break
            # sets whose sizes differ too much can't be so alike, and need not be moved
            fits = F.least("size", "other") + 1e-9 >= similarity * F.greatest("size", "other")
            pairs = asked.filter(fits).select("a", "b")
            found.append(materialize(alike((pairs.unionByName(close) if step == 1 else pairs).distinct(), sets, similarity), "simhash-links"))
            rest = materialize(asked.join(found[-1], ["a", "b"], "left_anti").select(F.col("a").alias("uid"), "band", "company", "size"), "simhash-rest")
            if step == 1:  # what stays open after that is little: later rounds read no more than this
                sets = bands_of = materialize(only(reps, materialize(rest.select("uid").distinct(), "simhash-open")).select("uid", "bands", "grams"), "simhash-sets")
            key = F.xxhash64(F.slice(F.concat("bands", "bands"), F.col("band") + 1, F.lit(step + 1)))
            members, where = reread(rest.join(bands_of.select("uid", "bands"), "uid").select("uid", "size", "band", key.alias("value"), "company"), "simhash-members")
        label = materialize(components(reduce(DataFrame.unionByName, found)), "simhash-joined")
        label = joined(reps, label, similarity)
        label = materialize(texts.join(label.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid")), "simhash-label")
        low = label.groupBy("component").agg(F.min(F.struct("last", "doc_id", "th")).alias("low"))
        classes = label.join(low, "component").select("same", "low")
        out = rows.select("doc_id", "th", "same").join(classes, "same")
        kept = (F.col("doc_id") == F.col("low.doc_id")) & (F.col("th") == F.col("low.th"))
        return materialize(out.select("doc_id", "th", F.coalesce("low.doc_id", "doc_id").alias("component_id"), F.coalesce(kept, F.lit(False)).alias("kept")), "simhash-found", outlive=True)


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, as they are, but for near copies: of each component the row with the smallest id stays, once. Rows without
    an id stay."""
    found = near_copies(docs, shingle, similarity, bits, id_col, text_col)
    own_id, own_th, gone_id, gone_th = unused(docs, "own_id", "own_th", "gone_id", "gone_th")
    keyed = docs.withColumn(own_id, F.col(id_col)).withColumn(own_th, F.xxhash64(text_col))
    same = (F.col(own_id) == F.col(gone_id)) & (F.col(own_th) == F.col(gone_th))

    def listed(rows: DataFrame, label: str) -> DataFrame:
        return fitted(materialize(rows.select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th)).distinct(), label), BROADCAST_BYTES)

    rest = keyed.join(listed(found.filter("doc_id is not null and not kept"), "simhash-gone"), same, "left_anti")
    again = found.filter("kept").groupBy("doc_id", "th").count().filter("count > 1")
    again = listed(again, "simhash-repeated")
    once = rest.join(again, same, "left_semi").dropDuplicates([own_id, own_th])
    return rest.join(again, same, "left_anti").unionByName(once).select(*docs.columns)
