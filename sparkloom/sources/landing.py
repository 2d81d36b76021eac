"""Pages landed as files: a folder for each document, with its metadata, its HTML and its Markdown.

The data source ``landing`` writes in two phases. Tasks write documents below a staging folder of the job, each to a name
of its own; when all tasks have succeeded the driver moves the documents of the attempts that count into place, so a lost
or repeated task leaves nothing behind and no document is ever half there. A document that can't be written (no body, a
conversion that fails, a name that the store refuses) becomes a line of the ledger in place of an error, and does not hold
up the others. Files go through pyarrow's file systems, so the folder may be in a store.

The move is one rename a document: this is for what people read and for corpora of a wiki's size. Bulk tables go through
``wiki.land``, as Parquet.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from sparkloom.functions.html import Renderer
from sparkloom.functions.text import safe_file_name

SCHEMA = "space string, doc_id string, title string, file string, metadata string, html string"
FAILURES = "Failures"
FAILED = "space string, doc_id string, title string, reason string"
#: Renames at a time.
MOVES = 16


def _files(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Landed(WriterCommitMessage):
    #: staged folder and place below the root of each document
    documents: list[tuple[str, str]]
    ledger: str | None


class LandingWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, f"_staging-{uuid.uuid4().hex}"

    def _document(self, system: fs.FileSystem, folder: str, row: dict) -> None:
        if row["html"] is None:
            raise ValueError("no body")
        texts = {f"{row['file']}.html": row["html"], f"{row['file']}_Markdown.txt": Renderer(True, True).render(row["html"]), "_Metadata.json": row["metadata"] or json.dumps({"id": row["doc_id"], "space": row["space"], "title": row["title"]})}
        system.create_dir(folder, recursive=True)
        for name, text in texts.items():
            with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(text.encode())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Landed:
        system, top = _files(self.path)
        attempt = f"{top}/{self.job}/{uuid.uuid4().hex}"
        documents, failed = [], []
        for batch in iterator:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    staged = f"{attempt}/{len(documents)}"
                    try:
                        self._document(system, staged, row)
                        documents.append((staged, f"{row['space']}/{row['file']}-{row['doc_id']}"))
                    except (OSError, ValueError, TypeError, RecursionError, pa.ArrowException) as e:
                        failed.append({k: row[k] for k in ("space", "doc_id", "title")} | {"reason": str(e)[:500]})
                        if system.get_file_info(staged).type == fs.FileType.Directory:
                            system.delete_dir(staged)
        ledger = None
        if failed:
            ledger = f"{attempt}.json"
            system.create_dir(f"{top}/{self.job}", recursive=True)
            with system.open_output_stream(ledger, compression=None) as out:
                out.write("".join(json.dumps(x) + "\n" for x in failed).encode())
        return Landed(documents, ledger)

    def commit(self, messages: list[Landed | None]) -> None:
        system, top = _files(self.path)

        def move(staged: str, place: str) -> None:
            if system.get_file_info(place).type == fs.FileType.Directory:
                system.delete_dir(place)  # landed before: the new one takes its place
            system.move(staged, place)

        held = [m for m in messages if m]
        moves = {f"{top}/{place}": staged for m in held for staged, place in m.documents}  # of rows with one place the last
        for parent in {place.rpartition("/")[0] for place in moves}:
            system.create_dir(parent, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda x: move(x[1], x[0]), moves.items()))
        ledgers = [m.ledger for m in held if m.ledger]
        if ledgers:
            system.create_dir(f"{top}/{FAILURES}", recursive=True)
        for ledger in ledgers:
            system.move(ledger, f"{top}/{FAILURES}/{ledger.rpartition('/')[2]}")
        self.abort(messages)

    def abort(self, messages: list[Landed | None]) -> None:
        system, top = _files(self.path)
        if system.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.job}")


class LandingSource(DataSource):
    """format("landing"), for writing: option path."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> LandingWriter:
        return LandingWriter(self.options["path"])


def land_files(docs: DataFrame, path: str) -> None:
    """Lands documents (space, doc_id, title, html, and metadata as JSON if there is such a column): a folder each below its
    space, and a line of the ledger for each that fails. One that has landed before is replaced."""
    docs.sparkSession.dataSource.register(LandingSource)
    known = F.col("metadata").cast("string") if "metadata" in docs.columns else F.lit(None).cast("string")
    place = F.coalesce(F.col("space").cast("string"), F.lit("none"))
    rows = docs.select(place.alias("space"), F.col("doc_id").cast("string").alias("doc_id"), "title", safe_file_name(F.coalesce("title", F.lit("untitled"))).alias("file"), known.alias("metadata"), "html")
    rows.write.format("landing").mode("append").save(path)


def failures(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: space, doc_id, title, reason of each failure, those of documents that landed later included."""
    system, top = _files(path)
    if system.get_file_info(f"{top}/{FAILURES}").type != fs.FileType.Directory:
        return spark.createDataFrame([], FAILED)
    return spark.read.schema(FAILED).json(f"{path}/{FAILURES}")


def to_retry(docs: DataFrame, path: str, landed: DataFrame) -> DataFrame:
    """Documents of the ledger that have not landed since (landed: wiki.corpus)."""
    lost = failures(docs.sparkSession, path).select("doc_id").distinct().join(landed.select("doc_id"), "doc_id", "left_anti")
    return docs.join(lost, docs["doc_id"].cast("string") == lost["doc_id"], "left_semi")
