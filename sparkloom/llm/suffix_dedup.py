"""Removal of byte passages that a document with a smaller id holds as well, by deep-shallow suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Strings are
judged on the input and never cross documents; overlaps count.

To sort only suffixes that may matter, and to bring equal strings to one place without sending every suffix, each window
of ``length`` bytes is keyed by the smallest hash among its k-grams. Neighbouring windows mostly share that key, so a
text falls into few runs of windows, each a segment of somewhat over ``length`` bytes. The steps:

1. Whole texts that equal one with a smaller id are removed at once, and take no part in the rest.
2. The others are packed and dealt into groups by a hash of the document. A group sends each of its keys once, with how
   many runs have it, to the key's bucket; the bucket tells the groups which keys at least two documents have.
3. For those keys a group sends each distinct segment once, with the smallest id that has it there. A key of more than
   ``HOT`` runs (a phrase that goes on differently everywhere) would fill one bucket: its windows are sent one by one, to
   the bucket of a hash of the whole window.
4. A bucket sorts the windows of its segments, a slice at a time: multikey quicksort on 8-byte characters down to a
   shallow depth, and for what still shares its prefix a blind trie, which looks at the branching bytes only. Windows that
   are equal over the whole length get the smallest id of their class, and each group gets that back as runs of windows.
5. A group compares those with the ids of its own documents, and has all removed spans of a document.

A passage that very many documents share is sent once by each group and not by each document, so no task grows with it.
Texts are shuffled once, packed. A worker holds a group's packed text and keys or a bucket's segments, both of which
``GROUP_MOST`` bounds, and unpacks one text at a time. At more than 16 TB (a million groups of a million keys each) the
rows of step 2 come to hold one key each, and their overhead makes that step's shuffle larger than the text's.

Null texts count as empty. A null id comes after all others, and equal ids are not smaller than each other, so repeated
rows stay as they are; they have the same spans. Very long texts are read in overlapping chunks. An empty table gives an
empty result. Columns besides the id, the text and those to keep are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import bounded, pieces, tidy, tidy_pair
from sparkloom.storage import fitted, held_bytes, materialize, scratch

LENGTH = 50
#: Bytes of the k-grams whose hashes key the windows; bytes that multikey quicksort looks at before the tries.
GRAM, SHALLOW = 20, 16
#: Bytes handled at once in a worker.
CHUNK = 1 << 18
#: Text of a group: a two-hundredth of all within these bounds. Windows of a slice that is sorted at once.
GROUP_LEAST, GROUP_MOST, SLICE = 4 << 20, 16 << 20, 1 << 18
#: Runs of a key beyond which its windows are sent one by one.
HOT = 2_048
#: What is sent to all machines takes at most so much in memory; more is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
MOST = np.iinfo(np.int64).max
#: What groups and buckets send each other; n is the unpacked size of data.
SENT = pa.schema([("target", pa.int32()), ("kind", pa.int32()), ("grp", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    eight = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)).copy()
    n = len(data) - GRAM + 1
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += eight[8 : 8 + n]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += eight[GRAM - 8 : GRAM - 8 + n]
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(texts: Iterable[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with the same key, chunk by chunk: the chunk's bytes, and of each run its key, document, first
    window in the document, first window in the chunk, and number of windows."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> tuple:
        data = b"".join(p[2] for p in parts)
        sizes = np.array([len(p[2]) for p in parts])
        begin = np.cumsum(sizes) - sizes
        key = _sliding_min(_grams(np.frombuffer(data, np.uint8)), length - GRAM + 1)
        of = np.repeat(np.arange(len(parts)), sizes)
        valid = of[: len(key)] == of[length - 1 : length - 1 + len(key)]
        change = np.ones(len(key), bool)
        change[1:] = (key[1:] != key[:-1]) | (of[1 : len(key)] != of[: len(key) - 1])
        end = np.flatnonzero(np.concatenate([change | ~valid, [True]]))
        first = np.flatnonzero(change & valid)
        windows = end[np.searchsorted(end, first, "right")] - first
        part = of[first]
        docs, offsets = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        return data, key[first], docs[part], offsets[part] + first - begin[part], first, windows

    for doc, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            parts.append((doc, at, piece))
            held += len(piece)
            if held >= CHUNK:
                yield flush()
                parts, held = [], 0
    if parts:
        yield flush()


def sort_windows(data: bytes, at: np.ndarray, length: int) -> list[np.ndarray]:
    """Classes of windows (as indices of at) that are equal over the length, in suffix order. Only classes of two or
    more are given."""
    view = np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))
    order = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    # shallow: multikey quicksort, all open groups at once, one 8-byte character after the other
    depth = 0
    while depth < min(SHALLOW, length - 7) and len(order):
        char = view[at[order] + depth].astype(np.uint64)
        by = np.lexsort((char, group)) if depth else np.argsort(char)
        order, group, char = order[by], group[by], char[by]
        change = np.ones(len(order), bool)
        change[1:] = (group[1:] != group[:-1]) | (char[1:] != char[:-1])
        order, group = _open(order, change)
        depth += 8
    # deep: blind tries, a level of all of them at once
    flat = np.frombuffer(data, np.uint8)
    done: list[np.ndarray] = []
    while len(order):
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        lead = at[order[np.repeat(heads, np.diff(np.append(heads, len(order))))]]
        mine = at[order]
        common = np.full(len(order), length)
        live = np.arange(len(order))
        for d in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            differ = view[mine[live] + d] != view[lead[live] + d]
            where = live[differ]
            if len(where):
                x = (view[mine[where] + d] ^ view[lead[where] + d]).astype(">u8").view(np.uint8).reshape(-1, 8)
                common[where] = d + np.argmax(x != 0, axis=1)
                live = live[~differ]
        branch = np.minimum.reduceat(common, heads)
        sizes = np.diff(np.append(heads, len(order)))
        whole = branch >= length
        for h, s in zip(heads[whole], sizes[whole], strict=True):
            done.append(order[h : h + s])
        keep = np.repeat(~whole, sizes)
        byte = flat[np.minimum(mine + np.repeat(branch, sizes), len(flat) - 1)][keep]
        order, group = order[keep], group[keep]
        by = np.lexsort((byte, group))
        order, group, byte = order[by], group[by], byte[by]
        change = np.ones(len(order), bool)
        change[1:] = (group[1:] != group[:-1]) | (byte[1:] != byte[:-1])
        order, group = _open(order, change)
    return done


def classes(data: bytes, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """sort_windows() slice by slice, windows being dealt into slices by their first eight bytes: members of the slice's
    classes one after the other, where each class begins, and its size."""
    slices = -(-len(at) // SLICE)
    first = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    place = ((first[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(max(1, slices))
    for i in range(slices):
        own = np.flatnonzero(place == i)
        found = sort_windows(data, at[own], length)
        if found:
            counts = np.array([len(c) for c in found])
            yield own[np.concatenate(found)], np.cumsum(counts) - counts, counts


def _open(order: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and numbers of the groups that have more than one member."""
    heads = np.flatnonzero(change)
    sizes = np.diff(np.append(heads, len(order)))
    group = np.repeat(np.arange(len(heads)), sizes)
    keep = np.repeat(sizes > 1, sizes)
    return order[keep], group[keep]


def _by(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of the rows for each target."""
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(target[rows[0]]), rows


def _docs(rows: pa.Table) -> tuple[pa.Table, Iterator[bytes]]:
    """A group's documents, each (ord, th) once and without those that the group is told are gone, and their texts."""
    rows = rows.combine_chunks()
    gone = rows.filter(pc.equal(rows.column("n"), -1))
    mark = set(zip(gone.column("ord").to_pylist(), gone.column("th").to_pylist(), strict=True))
    keep = []
    for key in zip(rows.column("ord").to_pylist(), rows.column("th").to_pylist(), strict=True):
        keep.append(key not in mark)
        mark.add(key)
    rows = rows.filter(pa.array(keep, pa.bool_()))
    packer = pa.Codec("zstd")
    return rows, (packer.decompress(d.as_py(), n.as_py(), asbytes=True) for c in (rows.select(["data", "n"]).to_batches()) for d, n in zip(c.column(0), c.column(1), strict=True))


def _zip(data: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unzip(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True) if size else b""


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Removed spans of each document that has any, written to a table: ord, th (a hash of the text), begins, ends.
    docs: ord, th, text."""
    with scratch(docs.sparkSession):
        return materialize(_spans(bounded(docs), length), "suffix-spans", outlive=True)


def _spans(docs: DataFrame, length: int) -> DataFrame:
    spark = docs.sparkSession
    narrow = materialize(docs.select("ord", "th", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n")).filter(F.col("n") >= length), "suffix-docs")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // min(GROUP_MOST, max(GROUP_LEAST, total // 200))))
    # as many partitions at least as other exchanges have, which would deal the texts out again otherwise
    usual = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(usual, min(groups, usual * 4))

    firsts = narrow.groupBy("sha").agg(F.min("ord").alias("ord"))
    copies = materialize(narrow.join(firsts, ["sha", "ord"], "left_anti").select("ord", "th", "n").distinct(), "suffix-copies")
    base = docs.filter(F.octet_length("text") >= length)
    few = held_bytes(copies) <= BROADCAST_BYTES
    if few:
        base = base.join(F.broadcast(copies.select("ord", "th")), ["ord", "th"], "left_anti")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = pa.Codec("zstd", 1)
        for batch in pieces(batches):
            texts = batch.column(2).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t.as_buffer()) for t in texts], pa.int32()), pa.array([packer.compress(t.as_buffer(), asbytes=True) for t in texts], pa.binary())], names=["ord", "th", "n", "data"])

    packed = base.select("ord", "th", "text").mapInArrow(pack, "ord long, th long, n int, data binary")
    if not few:  # the groups leave out what these mark, so that the texts are still shuffled once
        packed = packed.unionByName(copies.select("ord", "th", F.lit(-1).alias("n"), F.lit(None).cast("binary").alias("data")))
    grouped = packed.withColumn("grp", F.pmod(F.xxhash64("ord", "th"), F.lit(groups)).cast("int")).repartition(parts, "grp")

    def keys(rows: pa.Table) -> pa.Table:
        """For each bucket the group's keys there, and how many runs have each; 0 stands for runs of one document."""
        own = rows.column("grp")[0].as_py()
        found = [(key, doc.astype(np.int32)) for _, key, doc, *_ in runs(_docs(rows)[1], length)]
        key = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.uint64)
        doc = np.concatenate([d for _, d in found]) if found else np.zeros(0, np.int32)
        del found
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads) if len(heads) else np.zeros(0, bool)
        many = np.where(several, np.minimum(np.diff(np.append(heads, len(key))), 255), 0).astype(np.uint8)
        key = key[heads]
        out = {"bucket": [], "grp": [], "keys": [], "many": []}
        for bucket, at in _by((key % np.uint64(groups)).astype(np.int64)):
            out["bucket"].append(bucket)
            out["grp"].append(own)
            out["keys"].append(_pack(key[at], groups))
            out["many"].append(many[at].tobytes())
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())]))

    def shared(rows: pa.Table) -> pa.Table:
        blobs = [_unpack(x) for x in rows.column("keys").to_pylist()]
        many = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("many").to_pylist()])
        values, inverse, counts = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
        wanted = counts > 1
        wanted[inverse[many > 0]] = True
        hot = np.bincount(inverse, np.maximum(many, 1)) > HOT
        out = {"grp": [], "bucket": [], "keys": [], "hot": []}
        at = 0
        for grp, bucket, own in zip(rows.column("grp").to_pylist(), rows.column("bucket").to_pylist(), blobs, strict=True):
            which = inverse[at : at + len(own)]
            at += len(own)
            keep = wanted[which]
            if keep.any():
                out["grp"].append(grp)
                out["bucket"].append(bucket)
                out["keys"].append(own[keep].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                out["hot"].append(np.packbits(hot[which[keep]]).tobytes())
        return pa.table(out, schema=pa.schema([("grp", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary())]))

    def segments(rows: pa.Table, told: pa.Table) -> pa.Table:
        """kind 0, to a bucket: distinct segments there; kind 1, to the group itself: where its documents have them."""
        out = {n: [] for n in SENT.names}
        if not rows.num_rows or not told.num_rows:
            return pa.table(out, schema=SENT)
        own = rows.column("grp")[0].as_py()
        blobs = [_unpack(x) for x in told.column("keys").to_pylist()]
        wanted = np.concatenate([b * np.uint64(groups) + np.uint64(t) for b, t in zip(blobs, told.column("bucket").to_pylist(), strict=True)])
        hot = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(b)) for x, b in zip(told.column("hot").to_pylist(), blobs, strict=True)]).astype(bool)
        order = np.argsort(wanted)
        wanted, hot = wanted[order], hot[order]
        docs_, texts = _docs(rows)
        ord_, th = (docs_.column(c).to_numpy() for c in ("ord", "th"))
        seen: dict[bytes, int] = {}
        least: list[int] = []
        where: list[int] = []  # bucket
        places: list[np.ndarray] = []

        def note(piece: bytes, bucket: int, low: int) -> int:
            n = seen.setdefault(piece, len(least))
            if n == len(least):
                least.append(low)
                where.append(bucket)
            elif low < least[n]:
                least[n] = low
            return n

        for data, key, doc, start, first, windows in runs(texts, length):
            folded = (key // np.uint64(groups) & np.uint64(0xFFFFFFFFFFFF)) * np.uint64(groups) + key % np.uint64(groups)
            hit = np.minimum(np.searchsorted(wanted, folded), len(wanted) - 1)
            pick = np.flatnonzero(wanted[hit] == folded)
            found: list[tuple[int, int, int]] = []
            bucket = (key[pick] % np.uint64(groups)).astype(np.int64).tolist()
            for b, d, s, a, w, apart in zip(bucket, doc[pick].tolist(), start[pick].tolist(), first[pick].tolist(), windows[pick].tolist(), hot[hit[pick]].tolist(), strict=True):
                low = int(ord_[d])
                if apart:
                    for i in range(w):
                        piece = data[a + i : a + i + length]
                        found.append((note(piece, zlib.crc32(piece) % groups, low), d, s + i))
                else:
                    found.append((note(data[a : a + w + length - 1], b, low), d, s))
            places.append(np.array(found, "<u4").reshape(-1, 3))
        pieces_ = list(seen)
        low = np.array(least, np.int64)
        for bucket, at in _by(np.array(where, np.int64)):
            mine = b"".join([pieces_[i] for i in at.tolist()])
            sizes = np.array([len(pieces_[i]) for i in at.tolist()], "<u4")
            for c, v in zip(SENT.names, (bucket, 0, own, len(mine), np.stack([at, low[at]]).astype("<i8").tobytes(), sizes.tobytes(), _zip(mine)), strict=True):
                out[c].append(v)
        number, doc, start = np.concatenate(places).T if places else np.zeros((3, 0), "<u4")
        used, inverse = np.unique(doc, return_inverse=True)
        mine = np.stack([number, inverse, start]).astype("<u4").tobytes()
        for c, v in zip(SENT.names, (own, 1, own, len(mine), np.stack([ord_[used], th[used]]).astype("<i8").tobytes(), None, _zip(mine)), strict=True):
            out[c].append(v)
        return pa.table(out, schema=SENT)

    def sort(rows: pa.Table) -> pa.Table:
        """Runs of windows of a group's segments with the smallest id of their class: number, first, count, id. What the
        group sent to itself goes on as it is."""
        out = {n: [] for n in SENT.names}
        rows = rows.combine_chunks()
        kept = rows.filter(pc.equal(rows.column("kind"), 1))
        rows = rows.filter(pc.equal(rows.column("kind"), 0))
        if rows.num_rows:
            numbers, lows = (np.concatenate(x) for x in zip(*(np.frombuffer(b, "<i8").reshape(2, -1) for b in rows.column("ids").to_pylist()), strict=True))
            sizes = [np.frombuffer(b, "<u4").astype(np.int64) for b in rows.column("sizes").to_pylist()]
            grp = np.repeat(np.array(rows.column("grp").to_pylist()), [len(s) for s in sizes])
            size = np.concatenate(sizes)
            data = b"".join([_unzip(d, n) for d, n in zip(rows.column("data").to_pylist(), rows.column("n").to_pylist(), strict=True)])
            windows = size - length + 1
            of = np.repeat(np.arange(len(size), dtype=np.int32), windows)
            inside = (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
            at = (np.cumsum(size) - size)[of] + inside
            best = lows[of]
            for flat, heads, counts in classes(data, at, length):
                best[flat] = np.repeat(np.minimum.reduceat(best[flat], heads), counts)
            change = np.ones(len(of), bool)
            change[1:] = (of[1:] != of[:-1]) | (best[1:] != best[:-1])
            heads = np.flatnonzero(change)
            count = np.diff(np.append(heads, len(of)))
            for g, own in _by(grp[of[heads]]):
                h = heads[own]
                mine = np.stack([numbers[of[h]], inside[h], count[own], best[h]]).astype("<i8").tobytes()
                for c, v in zip(SENT.names, (g, 0, g, len(mine), None, None, _zip(mine)), strict=True):
                    out[c].append(v)
        return pa.concat_tables([pa.table(out, schema=SENT), kept.cast(SENT)])

    def settle(rows: pa.Table) -> pa.Table:
        schema = pa.schema([("ord", pa.int64()), ("th", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
        none = pa.table({n: [] for n in schema.names}, schema=schema)
        rows = rows.combine_chunks()
        mine, told = (rows.filter(pc.equal(rows.column("kind"), k)) for k in (1, 0))
        if not mine.num_rows or not told.num_rows:
            return none
        ids, places = mine.column("ids")[0].as_py(), _unzip(mine.column("data")[0].as_py(), mine.column("n")[0].as_py())
        ord_, th = np.frombuffer(ids, "<i8").reshape(2, -1)
        number, doc, start = np.frombuffer(places, "<u4").astype(np.int64).reshape(3, -1)
        run = np.concatenate([np.frombuffer(_unzip(b, n), "<i8").reshape(4, -1) for b, n in zip(told.column("data").to_pylist(), told.column("n").to_pylist(), strict=True)], axis=1)
        run = run[:, np.lexsort((run[1], run[0]))]
        lo, hi = np.searchsorted(run[0], number, "left"), np.searchsorted(run[0], number, "right")
        many = hi - lo
        place = np.repeat(np.arange(len(number)), many)
        which = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + lo[place]
        goes = run[3][which] < ord_[doc[place]]
        place, which = place[goes], which[goes]
        d = doc[place]
        a = start[place] + run[1][which]
        b = a + run[2][which] + length - 1
        if not len(d):
            return none
        order = np.lexsort((a, d))
        d, a, b = d[order], a[order], b[order]
        # ends so far, document by document: offsets keep documents apart
        step = int(b.max()) + 1
        upto = np.maximum.accumulate(b + d * step)
        fresh = np.ones(len(d), bool)
        fresh[1:] = a[1:] + d[1:] * step > upto[:-1]
        heads = np.flatnonzero(fresh)
        last = np.append(heads[1:], len(d)) - 1
        ends = upto[last] - d[last] * step
        docs_, firsts_ = d[heads], a[heads]
        cut = np.flatnonzero(np.concatenate([[True], docs_[1:] != docs_[:-1], [True]]))
        which = docs_[cut[:-1]]
        lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int64())) for x in (firsts_, ends)]
        return pa.Table.from_arrays([pa.array(ord_[which]), pa.array(th[which]), *lists], schema=schema)

    sent = grouped.groupBy("grp").applyInArrow(tidy(keys), "bucket int, grp int, keys binary, many binary")
    back = sent.groupBy("bucket").applyInArrow(tidy(shared), "grp int, bucket int, keys binary, hot binary")
    form = "target int, kind int, grp int, n int, ids binary, sizes binary, data binary"
    cut = grouped.groupBy("grp").cogroup(back.groupBy("grp")).applyInArrow(tidy_pair(segments), form)
    # segments and places go through the same two exchanges, so that neither is worked out twice or stored
    ordered = cut.groupBy("target").applyInArrow(tidy(sort), form)
    found = ordered.groupBy("grp").applyInArrow(tidy(settle), "ord long, th long, begins array<long>, ends array<long>")
    return found.unionByName(copies.select("ord", "th", F.array(F.lit(0).cast("long")).alias("begins"), F.array("n").alias("ends")))


def _pack(key: np.ndarray, buckets: int) -> bytes:
    """48 bits of each key besides its bucket: enough to tell which keys may be equal; equal strings are told by sorting."""
    return (key // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_text (those bytes as text, without the parts
    of characters that were cut apart), kept_sha256, and the columns named in keep."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(MOST).cast("long")).alias("ord"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep))).alias("own"),
    )
    cuts = spans(rows.select("ord", "th", "text"), length)
    joined = rows.join(fitted(cuts, BROADCAST_BYTES), ["ord", "th"], "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, removed, count, kept, clean, sha = [], [], [], [], [], []
            for text, begins, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = text.encode()
                at, rest = 0, []
                for b, e in zip(begins or [], ends or [], strict=True):
                    rest.append(data[at:b])
                    at = e
                rest.append(data[at:])
                left = b"".join(rest)
                n.append(len(data))
                removed.append(len(data) - len(left))
                count.append(len(begins or []))
                kept.append(left)
                clean.append(left.decode(errors="ignore"))
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array(clean, pa.string()), pa.array(sha, pa.string())], names=["own", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256"])

    own = joined.schema["own"].dataType.simpleString()
    out = joined.select("own", "text", "begins", "ends").mapInArrow(apply, f"own {own}, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, kept_sha256 string")
    return out.select(F.col("own.doc_id").cast(kind).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256", *(F.col(f"own.c{i}").alias(c) for i, c in enumerate(keep)))
