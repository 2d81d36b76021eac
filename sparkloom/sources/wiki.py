"""Wiki pages: metadata, a corpus on disk, and where it lands."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.html import to_markdown
from sparkloom.functions.text import has_series, page_id_of, safe_file_name, space_of, title_of
from sparkloom.sources import paged

METADATA = "id string, space string, title string, metadata struct<labels:struct<results:array<struct<id:string,prefix:string,name:string>>>>, _links struct<webui:string,tinyui:string>"
BODY = "id string, title string, type string, status string, body struct<view:struct<value:string>>"


def scan(spark: SparkSession, spaces: dict[str, str], **options: object) -> DataFrame:
    """Metadata of all pages of the spaces (space and address), stamped with their space; null labels stay null."""
    rows = paged.load(spark, spaces, METADATA, size=paged.PAGE_ROWS["wiki"], **options)
    return rows.select("id", F.col("key").alias("space"), "title", F.col("metadata.labels.results").alias("labels"), F.col("_links.webui").alias("web_ui"), F.col("_links.tinyui").alias("tiny_ui"))


def of_space(spark: SparkSession, address: str, spaces: list[str], **options: object) -> DataFrame:
    """Metadata of a service's pages, each space under an address of its own. A filter on the space or the title becomes part
    of the requests: pages of other spaces are not asked for."""
    fields = "id string, title string"
    rows = paged.load(spark, {s: paged.with_query(address, spaceKey=s) for s in spaces}, fields, asked={"title": "title"}, size=paged.PAGE_ROWS["wiki"], **options)
    return rows.select("id", F.col("key").alias("space"), "title")


def bodies(answers: DataFrame, column: str = "json") -> DataFrame:
    """Pages of raw answers that are a page or hold results, of which the first counts; neither is an error."""
    found = F.coalesce(F.from_json(column, f"results array<struct<{_struct(BODY)}>>")["results"][0], F.from_json(column, BODY))
    row = answers.select(found.alias("p"))
    missing = F.raise_error(F.lit("the answer holds no page"))
    return row.select(F.coalesce("p.id", missing).alias("doc_id"), "p.title", F.col("p.body.view.value").alias("html"))


def _struct(ddl: str) -> str:
    out, depth = "", 0
    for part in ddl.split(", "):
        out += ("," if out else "") + (part.replace(" ", ":", 1) if not depth else part)
        depth += part.count("<") - part.count(">")
    return out


def by_url(docs: DataFrame, urls: DataFrame) -> DataFrame:
    """Documents (doc_id, space, title, ...) that addresses (column url) lead to: by number, or by space and title."""
    asked = urls.select("url", page_id_of(F.col("url")).alias("_id"), space_of(F.col("url")).alias("_space"), title_of(F.col("url")).alias("_title"))
    number = asked.filter("_id is not null").join(docs, F.col("_id") == F.col("doc_id").cast("string"))
    name = asked.filter("_id is null").join(docs, (F.col("_space") == F.col("space")) & (F.col("_title") == F.col("title")))
    return number.unionByName(name).drop("_id", "_space", "_title")


def is_requirement(title, labels=None):
    """Titles that end in Requirements and name a supported series, by title or label."""
    named = F.exists(labels, lambda x: has_series(x["name"])) if labels is not None else F.lit(False)
    return F.lower(title).endswith("requirements") & (has_series(title) | F.coalesce(named, F.lit(False)))


def is_design(title, labels=None):
    named = F.exists(labels, lambda x: has_series(x["name"])) if labels is not None else F.lit(False)
    low = F.lower(title)
    return (low.endswith("sw design") | low.endswith("design document")) & (has_series(title) | F.coalesce(named, F.lit(False)))


def land(docs: DataFrame, path: str) -> None:
    """Writes pages with their Markdown by space. A page whose body is missing lands with a reason and not silently."""
    rows = docs.select("space", "doc_id", "title", safe_file_name(F.col("title")).alias("file"), "html", to_markdown(F.col("html")).alias("markdown"), F.when(F.col("html").isNull(), "no body").alias("failed"))
    rows.write.mode("append").partitionBy("space").parquet(path)


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files below a folder with the metadata beside them (_Metadata.json, a name that Spark's readers hide);
    files without are left out, and metadata that hold nothing are an error."""
    name = F.col("_metadata.file_path")
    text = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*_Markdown.txt")
    text = text.select(F.regexp_replace(name, "/[^/]*$", "").alias("folder"), name.alias("md_path"), F.col("value").alias("markdown"))
    beside = text.withColumn("meta", F.pandas_udf(_beside, "string")(F.col("folder"))).filter("meta is not null")
    known = F.from_json("meta", "id string, space string, title string")
    return beside.select("folder", "md_path", "markdown", F.coalesce(known["id"], F.raise_error(F.concat(F.lit("no metadata in "), "folder"))).alias("doc_id"), known["space"].alias("space"), known["title"].alias("title"))


def _beside(folders: pd.Series) -> pd.Series:
    """What the metadata file of each folder holds; null if there is none."""
    from pyarrow import fs

    out = []
    for folder in folders:
        system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
        try:
            with system.open_input_stream(f"{path}/_Metadata.json") as f:
                out.append(f.read().decode())
        except FileNotFoundError:
            out.append(None)
    return pd.Series(out, dtype=object)
