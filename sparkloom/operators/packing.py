"""Fitting texts into contexts and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranks import first_rows
from sparkloom.storage import materialize


#: Rows of a group up to which it is cut to what can fit; beyond that it is summed by ranges.
CUT = 100_000


def truncate(rows: DataFrame, size: str, order: tuple, most: int = 65_536, separator: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """The first rows in the order while they, with a separator between each two, stay within the size. Sizes are not
    negative, so the running total only grows and a filter on it is the stop at the first that does not fit.

    Each row takes a separator's length at least, so no more than (most + separator) / separator can fit: groups are cut to
    as many in each task before the shuffle. Where that is no bound (a huge size, no separator) the rows are dealt by ranges
    of the order, and each range is summed on from what those before it hold. Either way no task holds a whole source."""
    fit = (most + separator) // separator if separator > 0 else CUT + 1
    each = F.col(size) + separator
    if fit <= CUT:
        rows = first_rows(rows, order, fit, *by) if by else rows.orderBy(*order).limit(max(0, fit))
        total = F.sum(each).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("_total", total - separator).filter(F.col("_total") <= most).drop("_total")
    ranged = materialize(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*by, "_range").agg(F.sum(each).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    # of each group a row for each of its ranges; ranges behind the cut are not opened
    opened = sums.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before")).filter(F.col("_before") <= most)
    on = [F.col("_range") == F.col("_r"), *(F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by))]
    total = F.col("_before") + F.sum(each).over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - separator
    return ranged.join(opened, on).withColumn("_total", total).filter(F.col("_total") <= most).select(*rows.columns)


def bins(items: Column, limit: int, carry: int = 0, bytes_per_token: float = 3.3, least: float = 2.0, share: float = 0.9) -> Column:
    """Numbers of contexts for an ordered array of byte sizes. A context is closed before the item with which it would
    reach so large a share of its limit, once it may not fit for certain; the next begins with what is carried over."""

    def full(total: Column) -> Column:
        return (total > limit * least) & (total / F.lit(float(bytes_per_token)) >= share * limit)

    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("bin"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, size: Column) -> Column:
        over = full(s["held"] + size) & (s["held"] > F.when(s["bin"] > 0, F.lit(carry)).otherwise(F.lit(0)))
        number = s["bin"] + over.cast("int")
        return F.struct((F.when(over, F.lit(carry).cast("long")).otherwise(s["held"]) + size).alias("held"), number.alias("bin"), F.concat(s["out"], F.array(number)).alias("out"))

    return F.aggregate(F.transform(items, lambda x: x.cast("long")), start, step, lambda s: s["out"])


def pack(rows: DataFrame, key: str, size: str, limit: int, by: str, **settings) -> DataFrame:
    """Rows with their context number, the largest first within each group; ties in order of the key. A group is what
    one review sees, so its size is that of a change and not of the data."""
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("s"), F.col(key).alias("k")))).alias("i"))
    packed = listed.withColumn("b", bins(F.transform("i", lambda x: -x["s"]), limit, **settings))
    return packed.select(by, F.explode(F.arrays_zip("i", "b")).alias("x")).select(by, F.col("x.i.k").alias(key), F.col("x.b").alias("bin"))
