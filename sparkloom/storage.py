"""Intermediate tables in the folder that all machines of the cluster share.

``spark.checkpoint.dir`` names that folder. Writing an intermediate result there cuts its lineage, so that a lost
executor costs the tasks it was running and not the whole chain before them, and lets two consumers share one
computation. Only where the setting is absent and the session is a local one (tests, a laptop) a folder on the local
machine is made; without the setting a cluster is refused, as its machines would write to different disks.

Tables go when the driver ends, or earlier: what is written inside ``scratch()`` goes at the end of the block.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

_LOCAL: dict[str, str] = {}
_SCOPES = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one if a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what was written at the path, if anything was."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver delete what was written at the path when it ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, the tables that this thread wrote inside it, but for those with outlive. Only
    what has been written by then may depend on them."""
    stack = _SCOPES.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            remove(spark, path)


def materialize(df: DataFrame, label: str, outlive: bool = False) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back under the same schema. outlive: keep the table
    beyond the innermost scratch() block."""
    return reread(df, label, outlive)[0]


def reread(df: DataFrame, label: str, outlive: bool = False) -> tuple[DataFrame, str]:
    """As materialize(), with the path, for callers that drop the table when a later one replaces it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    stack = _SCOPES.__dict__.get("stack") or []
    if owner := stack[:-1] if outlive else stack:
        owner[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def _held(value: Column, kind: DataType) -> Column:
    """Bytes that a value takes in memory, a little high rather than low."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType):
            return F.coalesce(F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0)) + 24
        each = 8 * len(kind.elementType.fields) + 16 if isinstance(kind.elementType, StructType) else 8
        return F.greatest(F.size(value), F.lit(0)) * each + 24
    if isinstance(kind, MapType):
        return F.greatest(F.size(value), F.lit(0)) * 64 + 48
    return F.lit(8)


def held_bytes(df: DataFrame) -> int:
    """An estimate of what the rows take in the memory of a machine that they are broadcast to: what a broadcast is
    checked against. One pass over the rows, so they should lie in a table."""
    each = sum((_held(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(48))
    return int(df.agg(F.sum(each.cast("long"))).first()[0] or 0)


def fitted(df: DataFrame, most: int) -> DataFrame:
    """The rows, marked to be broadcast if they take no more than so many bytes in memory; else joins shuffle them."""
    return F.broadcast(df) if held_bytes(df) <= most else df
