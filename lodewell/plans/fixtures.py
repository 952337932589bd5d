"""Articles, chunks, mentions and edges as views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.functions.text import weighted_score
from lodewell.operators import textindex, vectorindex
from lodewell.sources.tables import dealt, scratch_path, table

_indexes: dict[tuple[str, str, str], textindex.TextIndex | vectorindex.VectorIndex] = {}


def vector_index(spark: SparkSession, d: str) -> vectorindex.VectorIndex:
    """The index of the embeddings, written once an application."""
    name = (spark.sparkContext.applicationId, d, "vectors")
    if name not in _indexes:
        _indexes[name] = vectorindex.build(table(spark, d, "embeddings"), scratch_path(spark, "index"), key="vec_id", vector="embedding")
    return _indexes[name]


def text_index(spark: SparkSession, d: str, *, weighted: bool = False) -> textindex.TextIndex:
    """The full-text index of the documents, written once an application: of their texts, or `weighted` of the stems of
    their source and text."""
    name = (spark.sparkContext.applicationId, d, "weighted" if weighted else "texts")
    if name not in _indexes:
        docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
        settings = {"title": "source", "stemmed": True} if weighted else {"body": 1.0}
        _indexes[name] = textindex.build(docs, scratch_path(spark, "index"), key="id", text="text", buckets=8, **settings)
    return _indexes[name]


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as articles, scored from labels and length; every 17th is undated."""
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.join(labels, "doc_id", "left")
    impact, attention = 10.0 * F.coalesce("quality", F.lit(0)), 10.0 * (1 - F.coalesce("toxic", F.lit(0)))
    milestone = F.least(F.lit(10.0), F.col("n_chars") / 500.0)
    published = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    return rows.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.col("source").alias("source_name"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("full_content"),
        F.when(F.col("doc_id") % 17 != 0, published).alias("published_at"),
        F.round(weighted_score(impact, milestone, attention), 6).alias("total_score"),
    )


ARTICLES = """
articles AS (
    SELECT d.doc_id AS id, source || '/' || d.doc_id AS source_url, source AS source_name, text[1:60] AS title,
           text AS full_content,
           CASE WHEN d.doc_id % 17 <> 0 THEN make_timestamp((1704067200 + d.doc_id * 3600) * 1000000) END AS published_at,
           round(0.4e0 * 10 * coalesce(quality, 0) + 0.35e0 * least(10e0, n_chars / 500e0)
                 + 0.25e0 * 10 * (1 - coalesce(toxic, 0)), 6) AS total_score
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
)
"""


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Part names on orders as entity mentions; of odd parts in capitals."""
    # The size of the compressed file is no measure of the names in it: they are not to go through the driver.
    line, part = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_name", "p_brand").hint("shuffle_hash")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.when(F.col("p_partkey") % 2 == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
        F.col("p_brand").alias("type"),
        F.col("l_orderkey").alias("article_id"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("ordinal"),
    )


MENTIONS = """
mentions AS (
    SELECT CASE WHEN p_partkey % 2 = 1 THEN upper(p_name) ELSE p_name END AS name, p_brand AS type,
           l_orderkey AS article_id, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS ordinal
    FROM lineitem JOIN part ON l_partkey = p_partkey
)
"""


def edges(spark: SparkSession, d: str, *, sparse: bool = False) -> DataFrame:
    """Suppliers to parts (numbered from a million), weighted by their lines."""
    line = table(spark, d, "lineitem")
    line = line.where("l_quantity >= 50 AND l_discount >= 0.09") if sparse else line
    pair = dealt(line.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 1_000_000).alias("target")), "source", "target")
    return pair.groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))


def edges_sql(sparse: bool = False) -> str:
    where = "WHERE l_quantity >= 50 AND l_discount >= 0.09" if sparse else ""
    return f"""
edges AS (
    SELECT l_suppkey AS source, l_partkey + 1000000 AS target, count(*)::DOUBLE AS weight
    FROM lineitem {where} GROUP BY 1, 2
)
"""
