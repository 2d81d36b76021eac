"""Queries on embedded samples, their index, and segments of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import flows, index, models, packing, segments, vector
from sparkloom.plans.registry import query
from sparkloom.session import table
from sparkloom.sources import wiki


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors as samples, and those whose id is divisible by 100 as queries."""
    e = table(spark, sf_dir, "embeddings")
    samples = e.select(F.col("vec_id").alias("sampling"), F.col("label").alias("doc_id"), F.col("embedding").alias("vec"))
    return samples, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("asked"), F.col("embedding").alias("query"))


_NEAREST = """WITH q AS (SELECT vec_id AS asked, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
n AS (SELECT asked, vec_id AS sampling, label AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity
  FROM embeddings, q WHERE vec_id <> asked QUALIFY row_number() OVER (PARTITION BY asked ORDER BY similarity DESC, sampling) <= 4096),
d AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY asked, doc_id ORDER BY similarity DESC, sampling) = 1) """
_BEST = "QUALIFY row_number() OVER (PARTITION BY asked ORDER BY similarity DESC, sampling)"


@query(_NEAREST + f"SELECT asked, sampling, doc_id, similarity FROM d WHERE similarity >= 0.2 {_BEST} <= 10")
def knn_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search_by_threshold(*_asked(spark, sf_dir), 0.2, each="asked").select("asked", "sampling", "doc_id", "similarity")


@query(_NEAREST + f"SELECT asked, sampling, doc_id, similarity FROM d {_BEST} <= 5")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search_by_count(*_asked(spark, sf_dir), 5, each="asked").select("asked", "sampling", "doc_id", "similarity")


@query(_NEAREST + "SELECT asked, doc_id AS title, max(similarity) AS similarity FROM n GROUP BY asked, doc_id")
def hits_by_doc_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.best_by_title(vector.nearest(*_asked(spark, sf_dir), each="asked").withColumnRenamed("doc_id", "title"), each="asked")


@query(
    """SELECT count(*)::BIGINT AS n, count(*) FILTER (len(embedding) <> 64)::BIGINT AS bad_dimension,
    count(*) FILTER (list_max(list_transform(embedding, lambda x: abs(x))) < 1e-6)::BIGINT AS zero_vector FROM embeddings"""
)
def embedding_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.quality(table(spark, sf_dir, "embeddings"), "embedding", 64)


#: Whole texts of documents under one to four series, from their numbers.
_WHOLE = "SELECT doc_id, unnest(list_slice(['S3', 'S4', 'S5', 'S6'], 1, (doc_id % 4 + 1)::INT)) AS series, text AS sample FROM documents"


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = F.slice(F.array(*map(F.lit, ("S3", "S4", "S5", "S6"))), F.lit(1), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(series).alias("series"), F.col("text").alias("sample"))


@query(f"WITH s AS ({_WHOLE}), i AS (SELECT series, text AS sample FROM documents CROSS JOIN (VALUES ('S3'), ('S5')) t(series) JOIN labels USING (doc_id)) SELECT doc_id, series, sample FROM s ANTI JOIN i USING (series, sample)")
def index_incremental_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts that an index of the labelled documents under two series does not hold."""
    known = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    held = known.select(F.explode(F.array(F.lit("S3"), F.lit("S5"))).alias("series"), F.col("text").alias("sample"))
    return index.missing(_whole(spark, sf_dir), held)


@query(f"WITH s AS ({_WHOLE}) SELECT series, sample, count(*)::BIGINT AS n FROM s GROUP BY ALL HAVING count(*) > 1")
def dup_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.duplicates(_whole(spark, sf_dir))


@query(
    f"""WITH s AS ({_WHOLE}), o AS (SELECT series, sample AS sampling, max(doc_id) AS ts, 'old' AS origin FROM s GROUP BY ALL),
    n AS (SELECT series, sample AS sampling, max(doc_id) AS ts, 'new' AS origin FROM s JOIN labels USING (doc_id) GROUP BY series, sample)
    SELECT * FROM n UNION ALL SELECT o.* FROM o ANTI JOIN n USING (series, sampling)"""
)
def index_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of the labelled documents put into an index that holds those of all."""
    s = _whole(spark, sf_dir).select("series", F.col("sample").alias("sampling"), F.col("doc_id").alias("ts"))
    held = s.groupBy("series", "sampling").agg(F.max("ts").alias("ts")).withColumn("origin", F.lit("old"))
    new = s.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ts")), "ts")
    return index.upsert(held, new.select("series", "sampling", "ts").withColumn("origin", F.lit("new")))


@query(f"WITH s AS ({_WHOLE}) SELECT series, count(*)::BIGINT AS n, CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches FROM s GROUP BY series")
def upsert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.batches(_whole(spark, sf_dir), 100)


@query(
    """WITH l AS (SELECT doc_id, unnest(range(0, len(t)))::INTEGER AS pos, unnest(t) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))
    SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN 'Part ' || pos WHEN 1 THEN 'Part ' || (pos - 1) || ' > Requirements ' || pos ELSE 'Part ' || (pos - 2) || ' > Notes ' || pos END AS key,
    trim(line, chr(10) || ' ') AS content FROM l"""
)
def markdown_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of all lines of documents, each under a heading of its own."""

    def headed(line: Column, i: Column) -> Column:
        title = F.when(i % 3 == 0, "# Part ").when(i % 3 == 1, "## Requirements ").otherwise("## Notes ")
        return F.concat(title, i.cast("string"), F.lit("\n"), line)

    md = F.array_join(F.transform(F.split("text", "\n"), headed), "\n")
    return segments.explode_segments(table(spark, sf_dir, "documents").select("doc_id", md.alias("md")), "md", "doc_id")


@query(
    """WITH d AS (SELECT doc_id, trim(text, chr(10) || chr(32)) AS c FROM documents)
    SELECT doc_id, 2::INTEGER AS pos, 'requirement' AS rule, trim(concat('T > Requirements', chr(10), c)) AS sample FROM d
    UNION ALL SELECT doc_id, 1::INTEGER, 'motivation', trim(concat('T > Background & Motivation', chr(10), c)) FROM d WHERE c <> ''"""
)
def segment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of Markdown that has a document's whole text below two headings."""
    md = F.concat(F.lit("# T\nx\n## Background & Motivation\n"), "text", F.lit("\n## Requirements\n"), "text")
    found = segments.explode_segments(table(spark, sf_dir, "documents").select("doc_id", md.alias("md")), "md", "doc_id")
    return segments.samples(found, "doc_id")


@query(
    """WITH t AS (SELECT doc_id, source, length(text)::BIGINT AS n, sum(length(text) + 4) OVER (PARTITION BY source ORDER BY doc_id) - 4 AS total FROM documents)
    SELECT doc_id, source, n FROM t WHERE total <= 65536"""
)
def size_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n"))
    return packing.truncate(docs, "n", (F.col("doc_id"),), by=("source",))


@query(
    """WITH RECURSIVE i AS (SELECT conv_id, turn, strlen(text)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY strlen(text) DESC, turn) AS k FROM conversations),
    b AS (SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS held, 0 AS bin, NULL::BIGINT AS turn FROM (SELECT DISTINCT conv_id FROM i)
      UNION ALL SELECT conv_id, k, CASE WHEN shut THEN 100 ELSE held END + n, bin + shut::INT, turn
      FROM (SELECT i.conv_id, i.k, i.n, i.turn, b.held, b.bin, b.held + i.n > 800 AND (b.held + i.n) / 3.3 >= 0.9 * 400 AND b.held > CASE WHEN b.bin > 0 THEN 100 ELSE 0 END AS shut FROM b JOIN i ON i.conv_id = b.conv_id AND i.k = b.k + 1))
    SELECT conv_id, turn, bin::INTEGER AS bin FROM b WHERE k > 0"""
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation packed into contexts, the longest first."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").alias("n"))
    return packing.pack(c, "turn", "n", 400, "conv_id", carry=100)


_SERIES = """WITH s AS (SELECT 'S' || (3 + vec_id % 4) AS series, vec_id AS sampling, label AS doc_id, embedding FROM embeddings),
    q AS (SELECT vec_id AS asked, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
    n AS (SELECT asked, series, sampling, doc_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM s, q WHERE sampling <> asked QUALIFY row_number() OVER (PARTITION BY asked, series ORDER BY similarity DESC, sampling) <= 4096),
    d AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY asked, series, doc_id ORDER BY similarity DESC, sampling) = 1)
    SELECT *, row_number() OVER (PARTITION BY asked, series ORDER BY similarity DESC, sampling)::INTEGER AS place FROM d WHERE similarity >= 0.1 QUALIFY place <= 10"""


@query(_SERIES)
def series_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, asked = _asked(spark, sf_dir)
    samples = samples.withColumn("series", F.concat(F.lit("S"), (3 + F.col("sampling") % 4).cast("string")))
    asked = asked.select(F.explode(F.array(*map(F.lit, ("S3", "S4", "S5", "S6")))).alias("series"), "asked", "query")
    return flows.search_series(samples, asked, 0.1, each="asked")


@query(f"WITH f AS ({_SERIES}) SELECT asked || ' ' || series AS series, count(DISTINCT f.doc_id)::BIGINT AS n_found, 1::BIGINT AS n FROM f JOIN documents d ON d.doc_id = f.doc_id GROUP BY 1")
def series_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each query and series, answered from the documents found by the stand-in model."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int"), "text")
    found = series_search(spark, sf_dir).withColumn("series", F.concat_ws(" ", F.col("asked").cast("string"), "series"))
    answers = flows.answer(found, docs, "what is it", models.StubChat()).groupBy("series").agg(F.count("*").alias("n"))
    return found.join(docs.select("doc_id"), "doc_id").groupBy("series").agg(F.count_distinct("doc_id").alias("n_found")).join(answers, "series")


@query(
    """SELECT page_id, (lower(t) LIKE '%requirements') AND page_id % 2 = 0 AS is_requirement, (lower(t) LIKE '%design document') AND page_id % 2 = 0 AS is_design
    FROM (SELECT page_id, concat('Plan ', CASE WHEN page_id % 2 = 0 THEN 'S4 ' ELSE 'S9 ' END, CASE page_id % 3 WHEN 0 THEN 'REQUIREMENTS' WHEN 1 THEN 'Design Document' ELSE 'notes' END) AS t FROM pages)"""
)
def title_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "REQUIREMENTS").when(F.col("page_id") % 3 == 1, "Design Document").otherwise("notes")
    title = F.concat(F.lit("Plan "), F.when(F.col("page_id") % 2 == 0, "S4 ").otherwise("S9 "), kind)
    labels = F.when(F.col("page_id") % 5 == 0, F.lit(None)).otherwise(F.array(F.struct(F.lit("other").alias("name"))))
    return p.select("page_id", wiki.is_requirement(title, labels).alias("is_requirement"), wiki.is_design(title, labels).alias("is_design"))
