"""Arrow batches of texts, small enough that neither the JVM nor a worker holds many texts at a time, and names for
columns that a table does not have yet."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

ROWS = 512
#: Bytes of a batch that Spark hands to a worker, in place of its 64 MB; one row at least.
BATCH_BYTES = 2 << 20
#: Bytes of a group after which a worker gives memory back.
LARGE = 2 << 20
_LIMIT, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded(df: DataFrame) -> DataFrame:
    """The rows, whose session hands them to workers in batches of BATCH_BYTES from now on, unless it has a limit of its
    own. Spark reads the limit when the plan runs, so it stays set."""
    conf = df.sparkSession.conf
    if conf.get(_LIMIT, _UNSET) == _UNSET:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return df


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The rows in slices, so that a worker holds the Python objects of few of them. Gives back at the end what the task
    has used, as workers are used again."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        give_back()


def give_back() -> None:
    """Gives memory that is not used any more back to the machine: Arrow's, and that of the C library where it can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group that gives back what a large one has used."""

    def run(rows: pa.Table) -> pa.Table:
        out = f(rows)
        if rows.nbytes >= LARGE:
            give_back()
        return out

    return run


def tidy_pair(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups."""

    def run(rows: pa.Table, others: pa.Table) -> pa.Table:
        out = f(rows, others)
        if rows.nbytes >= LARGE:
            give_back()
        return out

    return run


@contextmanager
def lent(sent: Broadcast) -> Iterator[object]:
    """What was sent to all tasks, for the time of one: a worker that goes on to other work does not keep it in memory, and
    loads it again from the executor's file when it needs it again."""
    try:
        yield sent.value
    finally:
        if getattr(sent, "_path", None) is not None and hasattr(sent, "_value"):
            del sent._value


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that is no column of the table, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out
