"""Mixing sources to target weights by min-cost flow.

Documents are counted by membership pattern (the set of sources that a document belongs to). A pattern offers its words
once free, and again, up to ``epochs`` times in all, at a cost that rises with every repetition. Those offers flow to
the sources of the pattern, and from each source to its quota; the cheapest maximal flow says how many words of every
pattern the mix takes. A pattern's flow is whole passes over its documents plus part of one more; the documents of that
part are the first by a seeded hash, whose cut is found by counting words in finer and finer ranges of the hash.

All costs lie on what patterns offer, and the amounts that patterns can give together form a polymatroid, so the cheapest
flow is found pass by pass: a maximal flow of all first passes, to which second passes are added, and so on. No amount
found earlier is ever given up. Each is found by blocking flows, in parts of the network that hang together; where every
document has one source, as in op10's table, each source is a network of its own.

Only patterns (not documents) reach the driver: their number is that of the distinct source sets, and more than
``MAX_PATTERNS`` of them is an error. No group of documents is ordered or gathered in one task, so a source that holds
a third of all rows costs no more than as many rows spread out.

Null or empty texts have size 0 and are never taken. A null source is a source of its own, last in order. Very long texts
count whole and are taken or left whole. Documents that tie in the seeded hash are taken or left together, as are
repeated rows (same id). An empty table gives an empty mix. Columns besides the id, the text and the source are not read,
and go along unchanged, whatever their names.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.storage import fitted, materialize, scratch

WORD = r"[^\x20\x09-\x0D]+"
MAX_PATTERNS = 200_000
#: The recipe is sent to all machines if it takes no more than this in memory, and joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20
#: Bits of the seeded hash that each counting pass resolves, the passes, and the rounds of selection.
STEP_BITS, STEPS, ROUNDS = 14, 2, 3
PICKS = "array<struct<start:long,cut:long,most:long>>"


def shares(sizes: list[int], weights: list[float], cap: float, total: int) -> list[float]:
    """Targets that share the total by weight. None exceeds cap times its size: what one would have above
    that goes to the others by weight, until none is above."""
    target = [0.0] * len(sizes)
    open_, left = {i for i, s in enumerate(sizes) if s > 0}, float(total)
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        full = {i for i in open_ if left * weights[i] / weight > cap * sizes[i]}
        if not full:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in sorted(full):
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ -= full
    return target


class _Network:
    """A network with maximal flows by blocking flows; arcs come in pairs, each the other's way back."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self, source: int, sink: int) -> list[int] | None:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for arc in self.out[a]:
                if self.room[arc] and level[self.to[arc]] < 0:
                    level[self.to[arc]] = level[a] + 1
                    queue.append(self.to[arc])
        return level if level[sink] >= 0 else None

    def fill(self, source: int, sink: int) -> None:
        """Adds flow until it is maximal."""
        while (level := self._levels(source, sink)) is not None:
            at = [0] * len(self.out)  # the next arc to try
            path: list[int] = []
            node = source
            while True:
                if node == sink:
                    amount = min(self.room[arc] for arc in path)
                    for arc in path:
                        self.room[arc] -= amount
                        self.room[arc ^ 1] += amount
                    while path and not self.room[path[-1]]:
                        path.pop()
                    # back to the first arc that is full now
                    full = next((i for i, arc in enumerate(path) if not self.room[arc]), len(path))
                    del path[full:]
                    node = self.to[path[-1]] if path else source
                    continue
                arcs = self.out[node]
                while at[node] < len(arcs) and not (self.room[arcs[at[node]]] and level[self.to[arcs[at[node]]]] == level[node] + 1):
                    at[node] += 1
                if at[node] < len(arcs):
                    path.append(arcs[at[node]])
                    node = self.to[path[-1]]
                elif path:
                    node = self.to[path.pop() ^ 1]
                    at[node] += 1
                else:
                    break


def _parts(patterns: list[tuple[tuple[int, ...], int]], sources: int) -> list[list[int]]:
    """Patterns that hang together by sources that they share."""
    up = list(range(sources))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for members, _ in patterns:
        for s in members[1:]:
            a, b = root(members[0]), root(s)
            up[max(a, b)] = min(a, b)
    out: dict[int, list[int]] = {}
    for i, (members, _) in enumerate(patterns):
        out.setdefault(root(members[0]), []).append(i)
    return list(out.values())


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], epochs: int) -> list[dict[int, int]]:
    """Words that each pattern (sources, size) gives to each of its sources: as many in all as the quotas and so many passes
    allow, and of those flows one whose sum of costs is the least, a word's cost rising with the pass it is of. Among
    equals the order of the patterns decides."""
    out: list[dict[int, int]] = [{} for _ in patterns]
    for part in _parts(patterns, len(quotas)):
        place = {s: i for i, s in enumerate(sorted({s for i in part for s in patterns[i][0]}))}
        net = _Network(len(part) + len(place) + 2)
        source, sink = len(part) + len(place), len(part) + len(place) + 1
        offers = [net.add(source, k, 0) for k in range(len(part))]
        links = [{s: net.add(k, len(part) + place[s], patterns[i][1] * epochs) for s in patterns[i][0]} for k, i in enumerate(part)]
        for s, k in place.items():
            net.add(len(part) + k, sink, quotas[s])
        for _ in range(epochs):
            for k, i in enumerate(part):
                net.room[offers[k]] += patterns[i][1]
            net.fill(source, sink)
        for k, i in enumerate(part):
            out[i] = {s: net.room[arc ^ 1] for s, arc in links[k].items()}
    return out


def _seeded(seed: int, key: Column) -> Column:
    """A document's place in the seeded order: STEPS * STEP_BITS uniform bits."""
    bits = STEP_BITS * STEPS
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), key.cast("string")), 64 - bits)


@dataclass
class Recipe:
    """How often to take each document: the settings, and the picks of each pattern."""

    seed: int
    id_col: str
    text_col: str
    source_col: str
    cuts: DataFrame

    def measured(self, docs: DataFrame, *keep: Column) -> DataFrame:
        """pattern, size and place of each document, after the columns to keep."""
        many = docs.schema[self.source_col].dataType.typeName() == "array"
        pattern = F.array_sort(F.array_distinct(F.col(self.source_col))) if many else F.array(F.col(self.source_col))
        size = F.coalesce(F.regexp_count(F.col(self.text_col), F.lit(WORD)), F.lit(0)).cast("long")
        return docs.select(*keep, F.to_json(F.struct(pattern.alias("s"))).alias("pattern"), size.alias("size"), _seeded(self.seed, F.col(self.id_col)).alias("place"))

    def counted(self, measured: DataFrame) -> DataFrame:
        """measured rows with source_size, target and copies."""
        out = measured.join(fitted(self.cuts, BROADCAST_BYTES), F.col("pattern") == F.col("p"), "left")
        again = F.exists("picks", lambda x: (F.col("place") >= x["start"]) & (F.col("place") < x["cut"]) & (F.col("size") <= x["most"]))
        return out.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + again.cast("long")).otherwise(F.lit(0)).cast("long")).drop("p")


def recipe(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[Recipe, DataFrame]:
    """The recipe for a mix of the documents, and their measures (doc_id, source, pattern, size, place).

    source_col: a string, or an array of strings where a document belongs to several sources. weights: of the sources in
    code-point order, repeating. cap: the most passes over a document, and the most that a target is of its source's
    size."""
    spark = docs.sparkSession
    found = Recipe(seed, id_col, text_col, source_col, docs)
    many = docs.schema[source_col].dataType.typeName() == "array"
    rows = materialize(found.measured(docs, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")), "mixing-sizes")
    counted = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("source").alias("source")).orderBy("pattern").limit(MAX_PATTERNS + 1).collect()
    if len(counted) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} source patterns")
    members = [sorted(set(r["source"] or [None]), key=_order) if many else [r["source"]] for r in counted]
    names = sorted({x for m in members for x in m}, key=_order)
    place = {x: i for i, x in enumerate(names)}
    sizes = [0] * len(names)
    for r, m in zip(counted, members, strict=True):
        for x in m:
            sizes[place[x]] += r["size"]
    # words in several sources count once towards what is shared out
    target = shares(sizes, [weights[i % len(weights)] for i in range(len(names))], cap, sum(r["size"] for r in counted))
    flows = route([(tuple(place[x] for x in m), r["size"]) for r, m in zip(counted, members, strict=True)], [round(t) for t in target], cap)
    plan = []
    for r, m, flow in zip(counted, members, flows, strict=True):
        passes, part = divmod(sum(flow.values()), r["size"]) if r["size"] else (0, 0)
        plan.append((r["pattern"], sum(sizes[place[x]] for x in m), float(sum(target[place[x]] for x in m)), int(passes), int(part)))
    plans = spark.createDataFrame(plan, "pattern string, source_size long, target double, passes long, part long")
    with scratch(spark):
        cuts = _cuts(rows.select("pattern", "size", "place"), plans).toDF("p", "source_size", "target", "passes", "picks")
        found.cuts = materialize(cuts, "mixing-recipe", outlive=True)
    return found, rows


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix, a row for each document: doc_id, source, size, source_size, target, taken, copies. Settings as of
    recipe(); source_size and target are sums over a document's sources."""
    found, rows = recipe(docs, **settings)
    out = found.counted(rows)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns it has."""
    found, _ = recipe(docs, **settings)
    out = found.counted(found.measured(docs, F.struct("*").alias("own"))).filter("copies > 0")
    return out.select("own", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("own.*")


def _order(name: str | None) -> tuple[bool, str]:
    return name is None, name or ""


def _cuts(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """plans with each pattern's picks, ROUNDS of (start, cut, most): a document at a place from start to below cut,
    of no more than most words, gets one more pass. A round goes along the seeded order until the next document would
    exceed what is left of the pattern's part; the next goes on from there with documents that still fit. Every pass
    of a round counts the words of one range of the hash in smaller ranges, so what meets in a window is at most
    2 ** STEP_BITS counts of a pattern."""
    bits = STEP_BITS * STEPS
    end = F.lit(1 << bits).cast("long")
    known = plans.select("*", F.col("part").alias("left"), F.lit(0).cast("long").alias("start"), F.lit(1 << 62).cast("long").alias("most"), F.array().cast(PICKS).alias("picks"))
    for _ in range(ROUNDS):
        known = known.withColumn("base", F.lit(0).cast("long")).withColumn("got", F.lit(0).cast("long")).withColumn("open", F.lit(True))
        for step in range(1, STEPS + 1):
            width = bits - STEP_BITS * step
            ask = known.filter("open").select(F.col("pattern").alias("p"), "base", "start", "most", F.col("left") - F.col("got"))
            ask = ask.toDF("p", "base", "start", "most", "want")
            same = F.shiftright("place", width + STEP_BITS) == F.shiftright("base", width + STEP_BITS)
            on = rows["pattern"].eqNullSafe(F.col("p")) & same & (F.col("place") >= F.col("start")) & (F.col("size") <= F.col("most"))
            counts = rows.filter("size > 0").join(ask, on).groupBy("p", F.shiftright("place", width).alias("range")).agg(F.sum("size").alias("words"), F.first("want").alias("want"))
            upto = counts.withColumn("upto", F.sum("words").over(Window.partitionBy("p").orderBy("range")))
            over = F.col("upto") > F.col("want")
            found = upto.groupBy("p").agg(F.min(F.when(over, F.shiftleft("range", width))).alias("next"), F.max(F.when(~over, F.col("upto"))).alias("more"))
            known = (
                known.join(found, F.col("pattern").eqNullSafe(F.col("p")), "left")
                .withColumn("base", F.when(F.col("open"), F.coalesce("next", end)).otherwise(F.col("base")))
                .withColumn("got", F.col("got") + F.when(F.col("open"), F.coalesce("more", F.lit(0))).otherwise(F.lit(0)))
                .withColumn("open", F.col("open") & F.col("next").isNotNull())
                .drop("p", "next", "more")
            )
            known = materialize(known, "mixing-cut")
        pick = F.struct(F.col("start"), F.col("base").alias("cut"), F.col("most"))
        known = (
            known.withColumn("picks", F.concat("picks", F.array(pick)))
            .withColumn("left", F.col("left") - F.col("got"))
            .withColumn("start", F.col("base"))
            .withColumn("most", F.col("left"))
            .drop("base", "got", "open")
        )
    return known.select("pattern", "source_size", "target", "passes", "picks")
