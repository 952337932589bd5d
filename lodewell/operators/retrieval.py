"""Vector search, full-text search and their fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, DoubleType

from lodewell.functions.text import shorten, terms
from lodewell.functions.vectors import cosine, literal
from lodewell.operators.textindex import TextIndex
from lodewell.operators.vectorindex import VectorIndex

RANK_OFFSET = 60  # of reciprocal-rank fusion
NO_RANK = 1000  # the rank of what an arm did not return


def similar(
    df: DataFrame, query, k: int, *, threshold: float | None = None, default: float | None = None, exclude=(), key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The k rows nearest to a query vector by cosine, with `similarity`; ties to the smaller key.

    With a `default`, a threshold of 0 counts as unset, as none does.

    The query is a literal, so the plan is one scan with a bounded top-k (TakeOrderedAndProject).
    """
    threshold = (threshold or default) if default is not None else threshold
    scored = df.where(F.col(vector).isNotNull())
    if len(exclude):
        scored = scored.where(~F.col(key).isin(list(exclude)))
    scored = scored.withColumn("similarity", cosine(F.col(vector), literal(query)))
    if threshold is not None:
        scored = scored.where(F.col("similarity") >= threshold)
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def similar_chunks(chunks: DataFrame, titles: DataFrame, query, k: int = 10, *, threshold: float | None = None, key: str = "chunk_id", article: str = "article_id", vector: str = "embedding") -> DataFrame:
    """The k chunks nearest to a query vector with a similarity of at least `threshold`, 0.5 if that is 0 or not given,
    with the `title` of their article (null without one). Titles are joined to the k rows only.
    """
    best = similar(chunks, query, k, threshold=threshold or 0.5, key=key, vector=vector)
    return best.join(titles.select(F.col(article).alias("_article"), "title"), F.col(article) == F.col("_article"), "left").drop("_article")


def postings(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, term, tf): how often each term stands in each document."""
    return df.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _equals(term: str):
    return lambda w: w == term


def text_match(df: DataFrame, query: list[str], k: int, *, key: str, text: str) -> DataFrame:
    """The k best of the documents that hold every query term, with `text_score`: the sum of 1 + ln(tf).

    Evaluated in the scan, for texts without an index: no posting is shuffled for a query of a few terms. The terms of a text
    are made once; what is left of them passes a generator, through which no filter is pushed that would make them again.
    """
    held = F.filter(terms(F.col(text)), lambda w: w.isin(query))
    rows = df.select(key, F.explode(F.array(held)).alias("held"))
    counts = [F.size(F.filter("held", _equals(t))) for t in query]
    every = reduce(lambda a, b: a & b, (c > 0 for c in counts), F.lit(True))
    score = sum((1 + F.log(c.cast("double")) for c in counts), F.lit(0.0))
    return rows.where(every).select(key, score.alias("text_score")).orderBy(F.desc("text_score"), key).limit(k)


def _ranked(df: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """Numbers the rows of a bounded top-k; only ever applied behind a limit."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), key)))


def fuse(near: DataFrame, said: DataFrame, k: int, *, key: str = "id", vector_weight: float = 0.6, text_weight: float = 0.4) -> DataFrame:
    """Reciprocal-rank fusion of a vector arm (key, similarity) and a text arm (key, text_score): the k best by rrf_score.

    Both arms are bounded, the first so many of a search. A document that an arm did not return has rank 1000 and
    score 0 in it. `similarity` is the vector score. Limits come before ranks and join.
    """
    near = _ranked(near.select(key, "similarity"), "similarity", key, "vector_rank")
    said = _ranked(said.select(key, "text_score"), "text_score", key, "text_rank")
    fused = near.join(said, key, "full_outer").na.fill({"similarity": 0.0, "text_score": 0.0, "vector_rank": NO_RANK, "text_rank": NO_RANK})
    score = F.lit(vector_weight) / (F.col("vector_rank") + RANK_OFFSET) + F.lit(text_weight) / (F.col("text_rank") + RANK_OFFSET)
    return fused.withColumn("rrf_score", score).orderBy(F.desc("rrf_score"), key).limit(k)


def hybrid(
    vectors: DataFrame | VectorIndex, texts: DataFrame | TextIndex, query, words: list[str], k: int, *, key: str = "id", vector: str = "embedding", text: str = "text", **weights
) -> DataFrame:
    """The k best by fusion of a vector arm and a text arm, 2k candidates each; either is searched by its index, or read."""
    near = vectors.search(query, 2 * k, name=key) if isinstance(vectors, VectorIndex) else similar(vectors, query, 2 * k, key=key, vector=vector)
    said = texts.search(words, 2 * k, name=key) if isinstance(texts, TextIndex) else text_match(texts, words, 2 * k, key=key, text=text)
    return fuse(near, said, k, key=key, **weights)


def rerank(found: DataFrame, query: list[str], k: int, *, text: str, order: str) -> DataFrame:
    """The k best by the share of query terms that a text holds, ties in the given order: the offline reranker."""
    words = terms(F.col(text))
    share = sum((F.array_contains(words, t).cast("double") for t in query), F.lit(0.0)) / max(1, len(query))
    return found.withColumn("rerank_score", share).orderBy(F.desc("rerank_score"), order).limit(k)


def shown(found: DataFrame, *, text: Column, score: Column, most: int = 500) -> DataFrame:
    """Content cut to `most` characters, relevance rounded to three digits."""
    return found.withColumn("content", shorten(text, most)).withColumn("relevance", F.round(score, 3))


def summary_context(found: DataFrame, *, by: str, text: str, score: str = "similarity", key: str = "id", k: int = 5) -> DataFrame:
    """(by, context): the texts of the k best rows of each group, the best first, ties to the smaller key, parted by blank
    lines; the ranking is cut off map-side."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key))
    best = found.withColumn("_rank", rank).where(F.col("_rank") <= k)
    texts = F.array_sort(F.collect_list(F.struct("_rank", F.coalesce(text, F.lit("")).alias("t"))))
    return best.groupBy(by).agg(F.array_join(F.transform(texts, lambda x: x["t"]), "\n\n").alias("context"))


def related(found: DataFrame, articles: DataFrame, *, key: str, most: int = 200) -> DataFrame:
    """title, summary (its first `most` characters), source, url and score of the articles among the rows of `found`."""
    cut = F.substring(F.coalesce("summary", F.lit("")), 1, most)
    return found.join(articles, key).select(F.coalesce("title", F.lit("")).alias("title"), cut.alias("summary"), "source", "url", F.round("similarity", 3).alias("score"))


@F.pandas_udf(ArrayType(DoubleType()))
def embed_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The offline embedding: hashed words of at most 32,000 characters, signed, of length 1."""
    import zlib

    for texts in batches:
        out = []
        for t in texts:
            x = np.zeros(64)
            for w in (t or "")[:32000].lower().split():
                h = zlib.crc32(w.encode())
                x[h % 64] += 1.0 if h & 64 else -1.0
            norm = np.linalg.norm(x)
            out.append((x / norm if norm else x).tolist())
        yield pd.Series(out, dtype=object)


def article_chunks(chunks: DataFrame, article, *, key: str = "article_id", order: str = "chunk_number") -> DataFrame:
    """The chunks of one article in their order."""
    return chunks.where(F.col(key) == article).orderBy(order)


def distinct_sources(found: DataFrame, by: str, *, source: str = "source") -> DataFrame:
    """(by, sources): the distinct sources of each set of results, in alphabetical order, nulls left out; duplicates go map-side."""
    rows = found.select(by, source).distinct()
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(source)).alias("sources"))
