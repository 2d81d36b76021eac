"""A stream of a growing list, read in partitions and admitted so many rows at a time.

The service numbers its rows and tells how many there are. ``latestOffset`` lets a batch go no further than ``limit`` rows
beyond the last one, however many wait: that is the back-pressure. A batch's rows are ranges of numbers, read by several
tasks at once (``limit / rows``, so the service sees no more requests than that), page by page with retries. A replay asks
for the same numbers, so it gives the same rows.

Spark does not tell a reader where a restarted stream stands before it asks how far to go, so the reader looks it up in
the stream's own log of offsets, in the checkpoint folder, which is therefore an option as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from sparkloom.sources import paged

#: Rows of a batch, and of a partition.
LIMIT, ROWS = 1000, 250


def last_planned(checkpoint: str) -> int:
    """Up to which row the stream with this checkpoint has planned its batches; 0 if it has none."""
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri("file:///" + checkpoint[5:].lstrip("/") if checkpoint.startswith("file:") else checkpoint)
    found = system.get_file_info(fs.FileSelector(f"{top}/offsets", allow_not_found=True))
    batches = [f for f in found if f.base_name.isdigit()]
    if not batches:
        return 0
    with system.open_input_stream(max(batches, key=lambda f: int(f.base_name)).path) as log:
        return int(json.loads(log.read().decode().strip().split("\n")[-1])["row"])


class Range(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class BoundedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.limit, self.rows = int(options.get("limit", LIMIT)), int(options.get("rows", ROWS))
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = last_planned(self.options["checkpoint"])
        self.at = max(self.at, min(int(paged.resolve(self.options["count"])(self.options["address"])), self.at + self.limit))
        return {"row": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(i, min(i + self.rows, end["row"])) for i in range(start["row"], end["row"], self.rows)]

    def read(self, partition: Range) -> Iterator[tuple[int, str]]:
        fetch = paged.resolve(self.options["fetch"])
        at = partition.begin
        while at < partition.end:
            url = paged.with_query(self.options["address"], start=at, limit=partition.end - at)
            rows = paged.rows_of(paged.tried(lambda url=url: json.loads(fetch(url)), int(self.options.get("tries", paged.TRIES)), float(self.options.get("wait", paged.WAIT_SECONDS))))
            if not rows:
                raise ValueError(f"the service holds {at} rows and told of {partition.end}")
            for row in rows[: partition.end - at]:
                yield at, json.dumps(row)
                at += 1

    def commit(self, end: dict) -> None:
        pass


class BoundedSource(DataSource):
    """format("growing"): options address, fetch (a page of rows by start and limit), count (how many there are), checkpoint,
    limit, rows, tries, wait."""

    @classmethod
    def name(cls) -> str:
        return "growing"

    def schema(self) -> str:
        return "row long, json string"

    def streamReader(self, schema: StructType) -> BoundedReader:
        return BoundedReader({k.lower(): v for k, v in self.options.items()})


def growing(spark: SparkSession, address: str, fetch: str, count: str, checkpoint: str, schema: str, limit: int = LIMIT, rows: int = ROWS, **options: object) -> DataFrame:
    """The rows of a growing list with their numbers (row), as a stream whose batches hold limit rows at most. checkpoint: the
    folder that the query is started with."""
    spark.dataSource.register(BoundedSource)
    raw = spark.readStream.format("growing").options(address=address, fetch=fetch, count=count, checkpoint=checkpoint, limit=limit, rows=rows, **options).load()
    return raw.select("row", F.from_json("json", schema).alias("r")).select("row", "r.*")
