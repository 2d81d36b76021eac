"""Search in a table of embedded samples: nearest samples to a query, one for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import blocks
from sparkloom.operators.ranks import first_rows

#: Nearest samples that a search looks at, and documents it returns.
CANDIDATES, MOST = 4096, 10


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def similarity(a: Column, b: Column, places: int = 6) -> Column:
    """Cosine in double precision, rounded; null for zero vectors and vectors of different length."""
    size = norm(a) * norm(b)
    return F.when((size > 0) & (F.size(a) == F.size(b)), F.round(dot(a, b) / size, places))


def nearest(samples: DataFrame, query: DataFrame, vector: str = "vec", key: str = "sampling", candidates: int = CANDIDATES, each: str | None = None) -> DataFrame:
    """The samples nearest to the query, with their similarity. Ties are in order of the key. The limit belongs to the
    meaning: documents whose samples all lie beyond it are not found. query has a column query and one row (more are an
    error), or with each any number of rows, which that column tells apart: all samples are then ranked for every row by
    products of blocks, and a sample whose key is the row's own is left out."""
    if each is None:
        one = query.select("query").scalar()  # a subquery that runs once, no join
        scored = samples.withColumn("_query", one).withColumn("similarity", similarity(F.col(vector), F.col("_query"))).drop("_query", vector)
        return scored.orderBy(F.desc_nulls_last("similarity"), key).limit(candidates)
    rounded = blocks.near(samples, query, candidates, each, key, vector).withColumn("similarity", F.round("similarity", 6))
    return first_rows(rounded, (F.desc_nulls_last("similarity"), key), candidates, each)


def first_of_document(hits: DataFrame, document: str = "doc_id", key: str = "sampling", each: str | None = None) -> DataFrame:
    return first_rows(hits, (F.desc_nulls_last("similarity"), key), 1, *([each] if each else []), document)


def _best(hits: DataFrame, most: int, key: str, each: str | None) -> DataFrame:
    order = (F.desc("similarity"), key)
    return first_rows(hits, order, most, each) if each else hits.orderBy(*order).limit(most)


def search_by_threshold(samples: DataFrame, query: DataFrame, threshold: float, most: int = MOST, document: str = "doc_id", key: str = "sampling", each: str | None = None, **settings) -> DataFrame:
    """Documents whose best sample is at least so similar, best first, at most so many (for each query, without an order of rows, if each is given)."""
    hits = first_of_document(nearest(samples, query, key=key, each=each, **settings), document, key, each)
    return _best(hits.filter(F.col("similarity") >= threshold), most, key, each)


def search_by_count(samples: DataFrame, query: DataFrame, most: int, document: str = "doc_id", key: str = "sampling", each: str | None = None, **settings) -> DataFrame:
    """The so many documents nearest; without a similarity they count as 0."""
    if most < 1:
        raise ValueError("at least one document must be asked for")
    hits = first_of_document(nearest(samples, query, key=key, each=each, **settings), document, key, each)
    return _best(hits.withColumn("similarity", F.coalesce("similarity", F.lit(0.0))), most, key, each)


def best_by_title(hits: DataFrame, title: str = "title", each: str | None = None) -> DataFrame:
    by = [each, title] if each else [title]
    return hits.groupBy(*by).agg(F.max("similarity").alias("similarity")).orderBy(*by[:-1], F.desc("similarity"), title)


def quality(samples: DataFrame, vector: str = "vec", dimensions: int = 1024) -> DataFrame:
    """Counts of vectors with another dimension, and of those that are all but zero."""
    v = F.col(vector)
    return samples.agg(
        F.count("*").alias("n"),
        F.count_if(F.size(v) != dimensions).alias("bad_dimension"),
        F.count_if(F.forall(v, lambda x: F.abs(x) < 1e-6)).alias("zero_vector"),
    )
