"""The first rows of each group in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def _limit_early(spark: SparkSession, most: int) -> None:
    """Raises, for the session, up to which rank Spark cuts groups in each task before the shuffle (1,000 unless set), so
    that a large group is cut where it lies. Where the session has that turned off it stays so."""
    now = int(spark.conf.get(LIMIT))
    if 0 <= now < most:
        spark.conf.set(LIMIT, str(most))


def first_rows(rows: DataFrame, order: tuple[Column | str, ...], most: int, *by: str, rank: str | None = None) -> DataFrame:
    """At most so many rows of each group, the first in the order; rank: a column to hold their places from 1 on."""
    _limit_early(rows.sparkSession, most)
    name = rank or "_n"
    kept = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= most)
    return kept if rank else kept.drop(name)
