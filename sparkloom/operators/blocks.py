"""Exact search for many query vectors at once, by products of blocks.

Queries and samples are dealt to the cells of a grid: a query goes to one row of cells, a sample to one column. Within a
cell the queries come first and are held as one matrix of a bounded size; the samples stream past it in batches, each
of them one matrix product. Every pair is looked at once in a pass, no pair is a row of a join, and what is shuffled grows
with the sides of the grid and not with the pairs.

The first pass counts each query's similarities by bins, so that the second gives only pairs down to the bin in which the
query's last wanted sample lies (and one more, for rounding). What comes out holds the wanted samples for certain and few
others; the caller ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from sparkloom.operators.ranks import first_rows

#: Bytes of a cell's queries as a matrix; samples of a cell at least; similarities that are worked out at once.
QUERY_BYTES, CELL_SAMPLES, AT_ONCE = 32 << 20, 8_192, 1 << 18
#: Bins of similarities from -1 to 1. Bin 0 is for pairs without one.
BINS = 512


def _rows(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of the rows of each dimension; rows without a direction are in none."""
    out = []
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, begin = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for d in np.unique(sizes[sizes > 0]):
        own = np.flatnonzero(sizes == d)
        x = flat[begin[own][:, None] + np.arange(d)].astype(np.float64)
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        some = ~(length == 0)
        out.append((own[some], x[some] / length[some, None]))
    return out


class Cell:
    """The queries of a cell: their rows, their vectors by dimension, and the place of each one's own sample."""

    def __init__(self, name: str):
        self.name, self.parts, self.rows, self.vectors = name, [], None, {}

    def close(self, asked: str) -> None:
        if self.parts:
            self.rows = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
            self.parts = []
            self.vectors = {x.shape[1]: (own, x) for own, x in _rows(self.rows.column("_v"))}
            self.place = {k: i for i, k in enumerate(self.rows.column(asked).to_pylist())}

    def similarities(self, samples: pa.RecordBatch, key: str, at: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of some queries and all samples of a batch: cosines (not a number where there is none), and which pairs count."""
        m = min(size, self.rows.num_rows - at)
        found = np.full((m, samples.num_rows), np.nan)
        for own, x in _rows(samples.column("_v")):
            if x.shape[1] in self.vectors:
                theirs, y = self.vectors[x.shape[1]]
                low, high = np.searchsorted(theirs, [at, at + m])
                found[np.ix_(theirs[low:high] - at, own)] = y[low:high] @ x.T
        counts = np.ones(found.shape, bool)
        for j, k in enumerate(samples.column(key).to_pylist()):
            i = self.place.get(k, -1) - at
            if 0 <= i < m:
                counts[i, j] = False
        return found, counts


def _bins(found: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(found), 0, np.clip(((found + 1) * (BINS / 2)), 0, BINS - 1).astype(np.int64) + 1)


def _cells(batches: Iterator[pa.RecordBatch], asked: str) -> Iterator[tuple[Cell, pa.RecordBatch]]:
    """Each batch of samples with the queries of its cell."""
    cell = Cell("")
    for batch in batches:
        names = batch.column("_cell").to_pylist()
        sample = batch.column("_sample").to_numpy(zero_copy_only=False)
        begin = 0
        for end in range(1, batch.num_rows + 1):
            if end < batch.num_rows and names[end] == names[begin] and sample[end] == sample[begin]:
                continue
            if names[begin] != cell.name:
                cell = Cell(names[begin])
            part = batch.slice(begin, end - begin)
            if sample[begin]:
                cell.close(asked)
                if cell.rows is not None:
                    yield cell, part
            else:
                cell.parts.append(part)
            begin = end


def _vector(v: Column) -> Column:
    wide = v.cast("array<double>")
    return F.when(F.forall(wide, lambda x: x.isNotNull()), wide)


def near(samples: DataFrame, queries: DataFrame, most: int, asked: str, key: str = "sampling", vector: str = "vec", by: tuple[str, ...] = ()) -> DataFrame:
    """The so many samples nearest to each query, and some beyond: the samples' columns but for the vector, the column asked
    and similarity (a double; null if either has no direction or they differ in dimension, which counts as the farthest).
    queries: asked (which tells them apart), query, and the columns by, which a sample has to share. A sample whose key is
    the query's own is left out; so are rows with a null among these columns. A query whose dimension hardly any sample has
    gets the others as well."""
    whole = lambda rows, *columns: rows.dropna(subset=[*columns, *by])
    samples, queries = whole(samples, key).withColumn("_v", _vector(F.col(vector))).drop(vector), whole(queries, asked).select(asked, *by, _vector(F.col("query")).alias("_v"))
    # without a direction all samples are as far, so the first by key are enough, of samples and for queries
    points = F.coalesce(F.exists("_v", lambda x: x != 0), F.lit(False))
    first = lambda rows: first_rows(rows, (key,), most + 1, *by) if by else rows.orderBy(key).limit(most + 1)
    blind, every = queries.filter(~points).drop("_v"), first(samples.drop("_v"))
    queries, samples = queries.filter(points), samples.filter(points).unionByName(first(samples.filter(~points)))
    n_samples = samples.count()
    n_queries, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("_v")), F.lit(1))).first()
    rows = max(1, -(-n_queries * 8 * max(1, width) // QUERY_BYTES))
    # as many columns as make cells of CELL_SAMPLES, while the copies of queries are no more than those of samples
    columns = max(1, min(-(-n_samples // CELL_SAMPLES), -(-n_samples * rows // max(1, n_queries))))
    kept = [c for c in samples.columns if c != "_v" and c not in by]

    def grid(least: DataFrame | None) -> DataFrame:
        cell = lambda row, column: F.to_json(F.struct(*by, row.alias("_r"), column.alias("_c")))
        row, column = F.pmod(F.xxhash64(asked), F.lit(rows)), F.pmod(F.xxhash64(key, "_v"), F.lit(columns))
        ask = queries if least is None else queries.join(least, [asked, *by])
        q = ask.select(F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("_c"), row.alias("_r"), "*").withColumn("_cell", cell(F.col("_r"), F.col("_c")))
        s = samples.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("_r"), column.alias("_c"), "*").withColumn("_cell", cell(F.col("_r").cast("long"), F.col("_c")))
        s = s.select("_cell", F.lit(1).alias("_sample"), "_v", *kept, *by)
        q = q.withColumn("_cell", cell(F.col("_r"), F.col("_c").cast("long"))).select("_cell", F.lit(0).alias("_sample"), "_v", asked, *by, *(["_least"] if least is not None else []))
        return s.unionByName(q, allowMissingColumns=True).repartition(min(rows * columns, 100_000), "_cell").sortWithinPartitions("_cell", "_sample")

    fields = {f.name: f for f in [*samples.schema, *queries.schema]}
    tally = StructType([fields[asked], *(fields[b] for b in by), StructField("_bin", IntegerType()), StructField("_n", LongType())])
    pairs = StructType([*(fields[c] for c in kept), *(fields[b] for b in by), fields[asked], StructField("similarity", DoubleType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Cell, np.ndarray] | None = None

        def out() -> pa.RecordBatch:
            cell, n = held
            # a query's bins beyond the last of its wanted samples here can't hold a wanted one
            above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
            i, b = np.nonzero((n > 0) & (above < most))
            at = pa.array(i)
            return pa.RecordBatch.from_arrays([cell.rows.column(asked).take(at), *(cell.rows.column(c).take(at) for c in by), pa.array(b.astype(np.int32)), pa.array(n[i, b])], schema=to_arrow_schema(tally))

        for cell, batch in _cells(batches, asked):
            if held is None or held[0] is not cell:
                if held:
                    yield out()
                held = cell, np.zeros((cell.rows.num_rows, BINS + 1), np.int64)
            step = max(1, AT_ONCE // batch.num_rows)
            for at in range(0, cell.rows.num_rows, step):
                found, counts = cell.similarities(batch, key, at, step)
                place = (np.arange(len(found))[:, None] * (BINS + 1) + _bins(found))[counts]
                held[1][at : at + step] += np.bincount(place, minlength=len(found) * (BINS + 1)).reshape(len(found), BINS + 1)
        if held:
            yield out()

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, batch in _cells(batches, asked):
            least = cell.rows.column("_least").to_numpy()
            step = max(1, AT_ONCE // batch.num_rows)
            for at in range(0, cell.rows.num_rows, step):
                found, counts = cell.similarities(batch, key, at, step)
                i, j = np.nonzero(counts & (_bins(found) >= least[at : at + step, None]))
                ours, theirs = pa.array(j), pa.array(i + at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(ours) for c in [*kept, *by]), cell.rows.column(asked).take(theirs), pa.array(found[i, j], mask=np.isnan(found[i, j]))], schema=to_arrow_schema(pairs))

    counted = grid(None).mapInArrow(count, tally).groupBy(asked, *by, "_bin").agg(F.sum("_n").alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(asked, *by).orderBy(F.desc("_bin")))
    least = counted.withColumn("_above", above).groupBy(asked, *by).agg(F.coalesce(F.max(F.when(F.col("_above") >= most, F.col("_bin") - 1)), F.lit(0)).alias("_least"))
    found = grid(least).mapInArrow(give, pairs)
    listed = F.explode(every.agg(F.collect_list(F.struct(*every.columns))).scalar())  # most + 1 rows
    unseen = blind.join(every, list(by)) if by else blind.withColumn("_e", listed).select(asked, "_e.*")
    return found.unionByName(unseen.filter(F.col(key) != F.col(asked)).withColumn("similarity", F.lit(None).cast("double")))
