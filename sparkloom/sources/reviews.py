"""Comments and reviews on pull requests, planned as rows and delivered exactly once from a stream.

``planned`` turns texts into actions: a comment or review that begins with a marker is updated where there is one, with a
note that the review was done again, and added where there is none. ``inline_targets`` says at which commits a comment on
a line may be placed.

``Delivery`` sends actions in two steps that a killed job can take up again. What is to be sent is first written as an
intent, with a key; then it is sent, the key with it; then what was sent is written. Where an intent lies without an
outcome, or a task is tried again, nobody knows whether the action arrived: before it is sent the service is asked for the
key. So nothing is sent twice, and nothing is lost: what failed stays unsent and goes with the next batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException

from sparkloom.functions.text import has_marker
from sparkloom.sources.outbox import UNKNOWN_LINE

#: Fixed value: what a review says that only tells that another one was updated.
AGAIN = "Re-review completed"


def body(marker: str, text: Column, end: str) -> Column:
    return F.concat(F.lit(f"{marker}\r\n\r\n"), text, F.lit(f"\r\n\r\n{end}"))


def planned(wanted: DataFrame, existing: DataFrame, marker: str, end: str = "", reviewer: str | None = None) -> DataFrame:
    """Actions repo, number, kind, id, body for wanted (repo, number, text) and what is there (repo, number, id, user, body). As
    comments: add_comment, or update_comment of the first that begins with the marker in any case. As reviews of a reviewer:
    add_review, or update_review of the first of that user and, after it, add_review that says that it was done again."""
    by = ["repo", "number"]
    own = existing.filter(has_marker(F.col("body"), marker))
    own = own.filter(F.lower("user") == reviewer.lower()) if reviewer else own
    found = wanted.join(own.groupBy(*by).agg(F.min("id").alias("id")), by, "left").withColumn("body", body(marker, F.col("text"), end))
    kind = "review" if reviewer else "comment"
    first = found.select(*by, F.lit(0).alias("step"), F.when(F.col("id").isNull(), f"add_{kind}").otherwise(f"update_{kind}").alias("kind"), "id", "body")
    if not reviewer:
        return first
    again = found.filter("id is not null").select(*by, F.lit(1).alias("step"), F.lit("add_review").alias("kind"), F.lit(None).cast(found.schema["id"].dataType).alias("id"), body(marker, F.lit(AGAIN), end).alias("body"))
    return first.unionByName(again)


def inline_targets(comments: DataFrame, pulls: DataFrame, commits: DataFrame) -> DataFrame:
    """Comments on lines (repo, number, path, line, body) with the commits to try: the head, then users' commits that touched the
    file, the newest first. pulls: repo, number, head; commits: repo, number, sha, date, merge, files. Where no user's commit
    touched the file, refused says so and nothing is tried."""
    by = ["repo", "number", "path"]
    each = commits.filter("not merge").select("repo", "number", "sha", "date", F.explode("files").alias("path")).dropDuplicates([*by, "sha"])
    newest = each.groupBy(*by).agg(F.reverse(F.array_sort(F.collect_list(F.struct("date", "sha")))).alias("c"))
    found = comments.join(pulls.select("repo", "number", "head"), ["repo", "number"]).join(newest, by, "left")
    shas = F.when(F.col("c").isNotNull(), F.array_distinct(F.concat(F.array("head"), F.transform("c", lambda x: x["sha"]))))
    refused = F.when(F.col("c").isNull(), F.concat(F.lit("no user's commit changed "), F.col("path")))
    return found.select(*comments.columns, F.coalesce(shas, F.array().cast("array<string>")).alias("shas"), refused.alias("refused"))


def _sent(row: dict, send: Callable[[dict], int]) -> int:
    """A row's action sent; one with commits to try goes to each of them until the line is known there."""
    shas = row.get("shas")
    status = UNKNOWN_LINE
    for sha in [None] if shas is None else list(shas):
        status = int(send(row if sha is None else row | {"sha": sha}))
        if status != UNKNOWN_LINE:
            break
    return status


class Delivery:
    """Sends actions once. path: a folder of intents and outcomes in a store that all machines share. send: sends a row with
    its key and gives a status; posted: whether the service has an action with this row's key. Tasks must not run twice at the
    same time (speculation off)."""

    def __init__(self, path: str, send: Callable[[dict], int], posted: Callable[[dict], bool]):
        self.path, self.send, self.posted = path.rstrip("/"), send, posted

    def _held(self, spark: SparkSession, name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def intend(self, actions: DataFrame) -> DataFrame:
        """Writes what is to be sent now: the actions, and earlier ones without an outcome, each marked if it may have been sent
        already."""
        spark = actions.sparkSession
        names = sorted(actions.columns)
        new = actions.withColumn("key", F.sha2(F.to_json(F.struct(*names)), 256)).withColumn("doubt", F.lit(False))
        before, outcomes = self._held(spark, "intents"), self._held(spark, "outcomes")
        if before is not None:
            new = new.unionByName(before.withColumn("doubt", F.lit(True)), allowMissingColumns=True)
        if outcomes is not None:
            new = new.join(outcomes.filter("status < 400").select("key"), "key", "left_anti")
        # one row a key, the doubtful one if there is any
        last = Window.partitionBy("key").orderBy(F.desc("doubt"))
        todo = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
        run = f"{self.path}/runs/{uuid.uuid4().hex}"
        todo.write.parquet(run)
        written = spark.read.schema(todo.schema).parquet(run)
        written.filter("not doubt").drop("doubt").write.mode("append").parquet(f"{self.path}/intents")
        return written

    def deliver(self, todo: DataFrame) -> DataFrame:
        """key and status of each action; one that fails does not hold up others."""
        send, posted = self.send, self.posted

        def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            context = TaskContext.get()
            again = context is not None and context.attemptNumber() > 0
            for frame in part:
                out = []
                for row in frame.to_dict("records"):
                    try:
                        there = (row["doubt"] or again) and posted(row)
                        out.append((row["key"], 208 if there else _sent(row, send)))
                    except Exception:  # noqa: BLE001  reported by its status
                        out.append((row["key"], 599))
                yield pd.DataFrame(out, columns=["key", "status"])

        # the steps of one pull request follow each other
        dealt = todo.repartition("repo", "number").sortWithinPartitions("repo", "number", "step") if "step" in todo.columns else todo
        return dealt.mapInPandas(run, "key string, status int")

    def batch(self, actions: DataFrame) -> None:
        """Sends a batch and writes its outcomes. Killed anywhere and run again, it sends nothing twice."""
        self.deliver(self.intend(actions)).write.mode("append").parquet(f"{self.path}/outcomes")

    def stream(self, actions: DataFrame, checkpoint: str) -> DataStreamWriter:
        return actions.writeStream.foreachBatch(lambda batch, epoch: self.batch(batch)).option("checkpointLocation", checkpoint)
