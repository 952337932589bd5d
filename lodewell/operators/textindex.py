"""Full-text search over a stored index.

Postings lie in a folder for each bucket of terms and block of documents: a search opens the folders of its terms only, and
of those only the blocks that can still hold a result. Blocks hold documents of like length, as long documents
have the high counts, so that the best scores of the blocks differ and most blocks can be left out.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.functions.text import stems, terms
from lodewell.sources.tables import discard, materialize

# The weights of the two fields, the heading and the text.
HEADING, BODY = 1.0, 0.4


@dataclass(frozen=True)
class TextIndex:
    """An index below `path`; `splits` holds how many blocks the documents of each class of length have."""

    spark: SparkSession
    path: str
    key_type: str
    buckets: int
    splits: dict[int, int]
    heading: float
    body: float
    stemmed: bool

    @staticmethod
    def open(spark: SparkSession, path: str) -> TextIndex:
        """The index that `build` wrote."""
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return TextIndex(spark, path, **meta | {"splits": {int(k): v for k, v in meta["splits"].items()}})

    def _meta(self) -> dict:
        return {"key_type": self.key_type, "buckets": self.buckets, "splits": self.splits, "heading": self.heading, "body": self.body, "stemmed": self.stemmed}

    def postings(self) -> DataFrame:
        """(term, key, heading, body, bucket, block): how often each term stands in either field of a document."""
        return self.spark.read.schema(f"term string, key {self.key_type}, heading long, body long, bucket int, block int").parquet(f"{self.path}/postings")

    def documents(self) -> DataFrame:
        """(key, length): the number of terms of each document."""
        return self.spark.read.schema(f"key {self.key_type}, length long").parquet(f"{self.path}/documents")

    def maxima(self) -> DataFrame:
        """(term, best, documents, bucket, block): the best score of a term within a block, a row for each addition."""
        return self.spark.read.schema("term string, best double, documents long, bucket int, block int").parquet(f"{self.path}/maxima")

    def impact(self) -> Column:
        """What a posting adds to a score: 1 + ln of its weighted count."""
        return 1 + F.log(self.heading * F.col("heading") + self.body * F.col("body"))

    def add(self, docs: DataFrame, *, key: str, text: str, title: str | None = None) -> None:
        """Documents put into the index beside those there are; their keys are new to it.

        Null texts and headings count as empty. Documents without a term have a length only.
        """
        parsed = _parsed(docs, key, text, title)
        self._add(parsed)
        discard(parsed)

    def _add(self, parsed: DataFrame) -> None:
        parsed.select("key", "length").write.mode("append").parquet(f"{self.path}/documents")
        ways = F.create_map(*(F.lit(x) for c, n in sorted(self.splits.items()) for x in (c, n))) if self.splits else F.create_map().cast("map<int,int>")
        kind = length_class(F.col("length"))
        block = kind * 10_000 + F.pmod(F.xxhash64("key"), F.coalesce(F.try_element_at(ways, kind), F.lit(1))).cast("int")
        # Documents go to tasks by their keys, so that all their words are counted, stemmed and counted again there.
        each = parsed.withColumn("block", block).repartition("key")
        both = F.concat(*(F.transform(name, _word(heading)) for name, heading in (("heading", 1), ("body", 0))))
        counts = [F.sum("h").cast("long").alias("heading"), F.sum(F.col("n") - F.col("h")).cast("long").alias("body")]
        counted = each.select("key", "block", F.explode(both).alias("w")).select("key", "block", "w.term", "w.h", F.lit(1).alias("n"))
        if self.stemmed:
            counted = counted.groupBy("key", "block", "term").agg(F.sum("h").alias("h"), F.sum("n").alias("n"))
            counted = counted.withColumn("term", stems(F.array("term"))[0])
        counted = counted.groupBy("key", "term", "block").agg(*counts)
        counted = counted.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int"))
        # A frequent term is split over the blocks; within a folder its postings lie together.
        counted = materialize(counted.select("term", "key", "heading", "body", "bucket", "block"), "counted")
        stored = counted.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "term", "key")
        stored.write.mode("append").partitionBy("bucket", "block").parquet(f"{self.path}/postings")
        best = counted.groupBy("term", "bucket", "block").agg(F.max(self.impact()).alias("best"), F.count("*").alias("documents"))
        best.select("term", "best", "documents", "bucket", "block").repartition("bucket").write.mode("append").partitionBy("bucket", "block").parquet(f"{self.path}/maxima")
        discard(counted)

    def search(self, query: list[str], k: int, *, name: str = "id") -> DataFrame:
        """(name, text_score): the k best of the documents that hold every term, best first, ties to the smaller key.

        The blocks with the highest bounds are searched first; what they give rules out every block whose bound, the sum of
        its terms' best scores, is lower than the k-th score so far. The bounds of blocks reach the driver, postings don't.
        """
        asked = sorted(set(self._words(query)))
        none = self.spark.createDataFrame([], f"{name} {self.key_type}, text_score double")
        if not asked:
            return none
        there = self._of(self.maxima(), asked).groupBy("block", "term").agg(F.max("best").alias("best"), F.sum("documents").alias("n"))
        bounds = there.groupBy("block").agg(F.count("*").alias("terms"), F.sum("best").alias("bound"), F.min("n").alias("n")).where(F.col("terms") == len(asked))
        blocks = sorted(bounds.collect(), key=lambda r: (-r["bound"], r["block"]))
        first, seen = [], 0
        while blocks and (not first or seen < 8 * k):
            first.append(blocks.pop(0))
            seen += first[-1]["n"]
        if not first:
            return none
        within = lambda some: self._best(asked, [r["block"] for r in some], k, name)
        if not blocks:
            return within(first)
        found = within(first).collect()
        least = found[-1]["text_score"] if len(found) == k else float("-inf")
        more = [r for r in blocks if r["bound"] * (1 + 1e-9) >= least]
        return within(first + more)

    def _words(self, query: list[str]) -> list[str]:
        if not self.stemmed or not query:
            return list(query)
        return self.spark.range(1).select(stems(F.array(*map(F.lit, query)))).first()[0]

    def _of(self, df: DataFrame, asked: list[str]) -> DataFrame:
        """The rows of some terms, by their buckets."""
        return df.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in asked})) & F.col("term").isin(asked))

    def _best(self, asked: list[str], blocks: list[int], k: int, name: str) -> DataFrame:
        rows = self._of(self.postings(), asked).where(F.col("block").isin(blocks))
        parts = [F.max(F.when(F.col("term") == t, self.impact())).alias(f"p{i}") for i, t in enumerate(asked)]
        held = rows.groupBy("key").agg(*parts)
        score = sum((F.col(f"p{i}") for i in range(len(asked))), F.lit(0.0))  # in one order, so that equal counts tie
        return held.where(score.isNotNull()).select(F.col("key").alias(name), score.alias("text_score")).orderBy(F.desc("text_score"), name).limit(k)


def _parsed(docs: DataFrame, key: str, text: str, title: str | None) -> DataFrame:
    """(key, heading, body, length): the words of each document, written once, as all that follows counts them."""
    words = lambda name: F.coalesce(terms(F.col(name)), F.array().cast("array<string>")) if name else F.array().cast("array<string>")
    rows = docs.select(F.col(key).alias("key"), words(title).alias("heading"), words(text).alias("body"))
    return materialize(rows.withColumn("length", (F.size("heading") + F.size("body")).cast("long")), "parsed")


def _word(heading: int):
    return lambda w: F.struct(w.alias("term"), F.lit(heading).alias("h"))


def length_class(length: Column) -> Column:
    """Documents of 2^c to 2^(c+1) - 1 terms are of class c; those without a term are of class 0."""
    return F.floor(F.log2(F.greatest(length, F.lit(1)))).cast("int")


def build(
    docs: DataFrame, path: str, *, key: str, text: str, title: str | None = None, stemmed: bool = False, heading: float = HEADING, body: float = BODY,
    buckets: int = 32, block_documents: int = 100_000, block_words: int = 32_000_000,
) -> TextIndex:
    """An index of `docs` (key, text, and a heading if `title` is given), written below `path`, where nothing is yet.

    Keys are unique. `buckets` parts the terms, and about `block_documents` documents of like length, or fewer of about `block_words` words
    in all, make a block, so that a term of any frequency is spread over as many files as the documents call for.
    """
    spark = docs.sparkSession
    parsed = _parsed(docs, key, text, title)
    classes = parsed.select(length_class(F.col("length")).alias("c"), "length").groupBy("c").agg(F.count("*").alias("n"), F.sum("length").alias("words")).collect()  # a row for each power of two
    splits = {r["c"]: max(-(-r["n"] // block_documents), -(-r["words"] // block_words)) for r in classes}
    index = TextIndex(spark, path, docs.schema[key].dataType.simpleString(), buckets, splits, heading, body, stemmed)
    index._add(parsed)
    discard(parsed)
    spark.createDataFrame([(json.dumps(index._meta()),)], "value string").coalesce(1).write.text(f"{path}/meta")
    return index
