"""Trees as edges (id, parent): depths, nearest ancestors, rollups and ordered search, by pointer doubling.

Every node points at an ancestor, first its parent, and each round at the ancestor of that ancestor, so a tree of any
depth takes as many rounds as its depth has binary digits, each a join of one row for each node. Pairs of nodes and all
their ancestors are never made. Each round is written to the shared folder and its predecessor dropped.

A node has one parent; of several the smallest counts. Parents that are no nodes end a path like a root's do. Nodes whose
parents run in a circle, and those below, have no depth; they still have ancestors and descendants, each other included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import remove, reread


def ancestors(edges: DataFrame, depth: int) -> DataFrame:
    """id, ancestor, distance (1 for the parent), up to so many levels: for shallow trees and few nodes, as the rows are
    nodes times depth. A circle ends at the bound."""
    spark = edges.sparkSession
    name = f"tree_{uuid.uuid4().hex}"
    edges.select("id", "parent").filter("parent is not null").createOrReplaceTempView(name)
    return spark.sql(f"""
        WITH RECURSIVE up(id, ancestor, distance) MAX RECURSION LEVEL {depth + 1} AS (
          SELECT id, parent, 1 FROM {name}
          UNION ALL
          SELECT up.id, e.parent, up.distance + 1 FROM up JOIN {name} e ON e.id = up.ancestor WHERE up.distance < {depth})
        SELECT id, ancestor, distance FROM up""")


def _nodes(edges: DataFrame) -> DataFrame:
    """One row for each id: id, up (the parent, if that is a node)."""
    each = edges.groupBy("id").agg(F.min("parent").alias("parent"))
    known = each.select(F.col("id").alias("known"))
    return each.join(known, F.col("parent") == F.col("known"), "left").select("id", F.col("known").alias("up"))


def _doubled(state: DataFrame, step) -> DataFrame:
    """Applies step(state) until no node points anywhere, or for as many rounds as the longest path can take, which leaves
    circles alone."""
    at, path = reread(state, "tree")
    rounds = max(1, at.count().bit_length())
    for _ in range(rounds):
        if at.filter("up is not null").isEmpty():
            break
        following, where = reread(step(at), "tree")
        remove(at.sparkSession, path)
        at, path = following, where
    return at


def _joined(at: DataFrame, *carried: str) -> DataFrame:
    """Each node beside the one it points at, whose columns have an underscore before them."""
    other = at.select(F.col("id").alias("_id"), F.col("up").alias("_up"), *(F.col(c).alias(f"_{c}") for c in carried))
    return at.join(other, F.col("up") == F.col("_id"), "left")


def depths(edges: DataFrame) -> DataFrame:
    """id and depth, 0 for roots, null for what has no root."""
    start = _nodes(edges).withColumn("depth", F.col("up").isNotNull().cast("int"))
    found = _doubled(start, lambda at: _joined(at, "depth").select("id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
    return found.select("id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def nearest_ancestor(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and its nearest ancestor among the wanted ids (column id); ids without one are left out."""
    marks = wanted.select(F.col("id").alias("mark")).distinct()
    start = _nodes(edges).join(marks, F.col("up") == F.col("mark"), "left").select("id", "up", F.col("mark").alias("near"))

    def step(at: DataFrame) -> DataFrame:
        found = _joined(at, "near").withColumn("near", F.coalesce("near", "_near"))
        # who has found one need not look on, but is looked through by those below
        return found.select("id", F.col("_up").alias("up"), "near")

    return _doubled(start, step).filter("near is not null").select("id", F.col("near").alias("ancestor"))


def any_below(edges: DataFrame, flags: DataFrame, *names: str) -> DataFrame:
    """id, and for each named flag of flags (id, names) whether any descendant has it."""
    nodes, path = reread(_nodes(edges), "tree")
    own = flags.groupBy("id").agg(*(F.bool_or(n).alias(n) for n in names))
    start = nodes.join(own, "id", "left").select("id", "up", *(F.coalesce(n, F.lit(False)).alias(n) for n in names))

    def step(at: DataFrame) -> DataFrame:
        """Flags of a node and all less than a stretch below it, joined with those a stretch further down."""
        far = at.filter("up is not null").groupBy(F.col("up").alias("_far")).agg(*(F.bool_or(n).alias(f"far_{n}") for n in names))
        grown = at.join(far, F.col("id") == F.col("_far"), "left").select("id", "up", *(F.coalesce(F.col(n) | F.col(f"far_{n}"), F.col(n)).alias(n) for n in names))
        other = at.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        return grown.join(other, F.col("up") == F.col("_id"), "left").select("id", F.col("_up").alias("up"), *names)

    whole = _doubled(start, step).drop("up")
    below = nodes.filter("up is not null").join(whole, "id").groupBy(F.col("up").alias("_at")).agg(*(F.bool_or(n).alias(n) for n in names))
    return nodes.join(below, F.col("id") == F.col("_at"), "left").select("id", *(F.coalesce(n, F.lit(False)).alias(f"below_{n}") for n in names))


def first_by_level(nodes: DataFrame, edges: DataFrame, matches: Column) -> DataFrame:
    """Of the nodes (id, ...) that match, the one nearest to a root, the smallest id first."""
    found = nodes.filter(matches).join(depths(edges), "id")
    return found.orderBy(F.asc_nulls_last("depth"), "id").limit(1)


def named(name: Column, wanted: str) -> Column:
    """Whether a stage has the name, in any case and whether or not either is marked as parallel."""
    bare = lambda c: F.regexp_replace(F.lower(c), "^parallel ", "")
    return F.coalesce(bare(name) == bare(F.lit(wanted)), F.lit(False))
