"""Connected components of a graph of links, by alternating star operations.

Each round rewires every node's links to the smallest node it knows of, first among its larger neighbours, then among
its smaller ones, until nothing changes; the rounds grow with the logarithm of the longest chain. Every round is written
to the shared folder, so lineage stays short, and its predecessor is dropped. Nodes with very many links cost no task
more than others: minima are combined before the shuffle, and the join that deals them out again is one that adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import remove, reread


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: two columns of longs. Gives node, component (the smallest node reachable), for each node with a link to
    another. Repeated, reversed, null and self links change nothing."""
    spark = links.sparkSession
    e = links.toDF("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = reread(e, "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        following, path_following = reread(small.select("x.*").filter("a <> b").distinct(), "links")
        state_following = _state(following)
        remove(spark, path)
        if state_following == state:
            break
        edges, path, state = following, path_following, state_following
    # the caller's scratch() drops the last table
    return following.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(following.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
