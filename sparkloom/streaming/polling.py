"""Reviews as a stream: polled requests, placeholders first, then results; and results remembered by key."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from sparkloom.sources.paged import resolve


class PollReader(SimpleDataSourceStreamReader):
    """Each read is one poll. A service lists what is pending now, so its list shrinks as well as grows: a list that differs
    from the last one is given whole, under the next batch number, and one that does not is no news. A batch is kept until
    it is committed, so that a replay gives the same rows; after a restart, when it is lost, what is pending then."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.held: dict[int, list[str]] = {}

    def initialOffset(self) -> dict:
        return {"batch": 0, "digest": ""}

    def _pending(self) -> list[str]:
        return [json.dumps(r, sort_keys=True) for r in json.loads(resolve(self.options["fetch"])(self.options.get("address", "")))]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._pending()
        digest = hashlib.sha256("\n".join(sorted(rows)).encode()).hexdigest() if rows else ""
        if digest == start["digest"]:
            return iter([]), start
        self.held[start["batch"] + 1] = rows
        return iter([(r,) for r in rows]), {"batch": start["batch"] + 1, "digest": digest}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        wanted = range(start["batch"] + 1, end["batch"] + 1)
        rows = [r for n in wanted for r in self.held[n]] if all(n in self.held for n in wanted) else self._pending()
        return iter([(r,) for r in rows])

    def commit(self, end: dict) -> None:
        self.held = {n: rows for n, rows in self.held.items() if n > end["batch"]}


class PollSource(DataSource):
    """format("poll"): options fetch ("module:function" that gives a JSON array), address."""

    @classmethod
    def name(cls) -> str:
        return "poll"

    def schema(self) -> str:
        return "json string"

    def simpleStreamReader(self, schema) -> PollReader:
        return PollReader({k.lower(): v for k, v in self.options.items()})


def requests(spark: SparkSession, fetch: str, address: str = "") -> DataFrame:
    spark.dataSource.register(PollSource)
    raw = spark.readStream.format("poll").options(fetch=fetch, address=address).load()
    return raw.select(F.from_json("json", "repo string, number int, last_commit timestamp").alias("r")).select("r.*")


def review(stream: DataFrame, placeholder: Callable[[DataFrame], None], process: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame], None], seconds: int = 30, progress: Callable[[str, int], None] = lambda step, batch: None) -> DataStreamWriter:
    """Micro-batches every so many seconds: each pull request of a batch once, its placeholder first. process() keeps
    failures in its rows, so one request's does not stop others. progress() is told of each step of a batch."""

    def run(batch: DataFrame, epoch: int) -> None:
        each = batch.dropDuplicates(["repo", "number"]).persist()
        try:
            progress("placeholder", epoch)
            placeholder(each)
            progress("process", epoch)
            done = process(each)
            progress("publish", epoch)
            publish(done)
            progress("done", epoch)
        finally:
            each.unpersist()

    return stream.writeStream.foreachBatch(run).trigger(processingTime=f"{seconds} seconds")


class LatestCommit(StatefulProcessor):
    """Lets a request through unless its commit is no newer than the one last let through for its key."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at timestamp", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = max((r.last_commit for frame in rows for r in frame.itertuples() if pd.notna(r.last_commit)), default=None)
        held = self.seen.get()[0] if self.seen.exists() else None
        if latest is not None and (held is None or latest > pd.Timestamp(held)):
            self.seen.update((latest.to_pydatetime(),))
            yield pd.DataFrame({"repo": [key[0]], "number": [key[1]], "last_commit": [latest]})

    def close(self) -> None:
        pass


def changed_only(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Requests whose last commit is news, by state that may expire. Needs the RocksDB state store."""
    return stream.groupBy("repo", "number").transformWithStateInPandas(LatestCommit(ttl_ms), "repo string, number int, last_commit timestamp", "Update", "ProcessingTime" if ttl_ms else "None")


def counts_by_window(stream: DataFrame, minutes: int = 60, late: int = 10) -> DataFrame:
    """Events (ts, event_type, value) by window and type, with late rows up to the watermark."""
    w = F.window("ts", f"{minutes} minutes")
    return stream.withWatermark("ts", f"{late} minutes").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
