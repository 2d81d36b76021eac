"""Keeping an index of samples: what is new, last-wins upserts, reports, and storage by series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def missing(samples: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("series", "sample")) -> DataFrame:
    """Samples that the index does not have under the same series."""
    return samples.join(index.select(*keys), list(keys), "left_anti")


def missing_titles(samples: DataFrame, index: DataFrame, title: str = "title") -> DataFrame:
    """Title samples that the index does not have, whatever their series."""
    return samples.join(index.select(title).distinct(), title, "left_anti")


def duplicates(samples: DataFrame, keys: tuple[str, ...] = ("series", "sample")) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def upsert(index: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("series", "sampling"), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The index with the rows in place of those of the same keys. Of several new rows of a key the last by the order
    wins. One shuffle on the keys, whatever the share of new rows."""
    both = index.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *(F.desc_nulls_last(c) for c in order))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def batches(rows: DataFrame, size: int = 1000, by: str = "series") -> DataFrame:
    """How many batches of the size the rows of each series take."""
    counted = rows.groupBy(by).agg(F.count("*").alias("n"))
    return counted.withColumn("batches", F.ceil(F.col("n") / size).cast("long"))


def write(index: DataFrame, path: str) -> None:
    """Stores the index, a folder for each series; only the series that the rows have are replaced."""
    spread = index.repartition(F.col("series"), F.pmod(F.xxhash64("sampling"), F.lit(16)))  # a large series takes several tasks
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("series").parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    from sparkloom.storage import remove

    remove(spark, path)
