"""What goes out: comments by an outbox table, reports as files, and settings that come in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import models

#: Seconds between polls, and the answer of a service that does not know a line in a commit.
POLL_SECONDS, UNKNOWN_LINE = 30, 422


def write(actions: DataFrame, path: str) -> None:
    """Appends actions with a key that tells repeats apart, so that a sender may run again."""
    keyed = actions.withColumn("key", F.sha2(F.to_json(F.struct(*sorted(actions.columns))), 256))
    keyed.dropDuplicates(["key"]).write.mode("append").parquet(path)


def unsent(outbox: DataFrame, sent: DataFrame) -> DataFrame:
    return outbox.join(sent.select("key"), "key", "left_anti").dropDuplicates(["key"])


def post_inline(comment: dict, shas: list[str], send: Callable[[dict], int]) -> int:
    """Posts a comment on a line: at the head first, then at older commits as long as the line is unknown there. Any other
    failure is an error. Gives the last status."""
    status = UNKNOWN_LINE
    for sha in shas:
        status = send(comment | {"sha": sha})
        if status != UNKNOWN_LINE:
            break
    if status >= 400 and status != UNKNOWN_LINE:
        raise RuntimeError(f"the service answered {status}")
    return status


def deliver(rows: DataFrame, send: Callable[[dict], int]) -> DataFrame:
    """key and status of each action sent; one that fails does not hold up others."""

    def run(part: Iterator) -> Iterator:
        import pandas as pd

        for frame in part:
            out = []
            for r in frame.to_dict("records"):
                try:
                    out.append((r["key"], int(send(r))))
                except Exception:  # noqa: BLE001  reported by its status
                    out.append((r["key"], 599))
            yield pd.DataFrame(out, columns=["key", "status"])

    return rows.mapInPandas(run, "key string, status int")


def write_reports(reports: DataFrame, path: str, text: str = "report") -> None:
    reports.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


@dataclass
class Settings:
    poll_seconds: int = POLL_SECONDS
    debug: bool = False
    debug_pulls: list[int] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path) as f:
            known = json.load(f)
        return cls(**{k: v for k, v in known.items() if k in cls.__dataclass_fields__})


def summarize_folder(spark: SparkSession, path: str, endpoint: models.Chat) -> str:
    """A summary of the summaries of a folder's files. The number of files is a person's folder, not a corpus."""
    files = spark.read.text(path, wholetext=True).select(F.lit(1).alias("k"), F.col("_metadata.file_path").alias("f"), models.complete(F.col("value"), endpoint).alias("a"))
    row: Row | None = models.merge(files, "k", "f", "a", endpoint).first()
    return row["a"] if row else ""
