"""What the building of a full-text index reads and how it is dealt."""

from pyspark.sql import functions as F

from lodewell.operators import textindex


def test_texts_are_parsed_once_and_blocks_hold_few_words(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(t):
        seen.add(1)
        return t

    docs = spark.range(200).select("id", F.concat_ws(" ", F.array_repeat(F.lit("words"), 50), "id").alias("text"))
    docs = docs.withColumn("text", read.asNondeterministic()("text"))
    index = textindex.build(docs, str(tmp_path / "i"), key="id", text="text", body=1.0, buckets=2, block_words=1000)
    assert seen.value == 200
    sizes = index.postings().where("term = 'words'").groupBy("block").count().collect()
    assert len(sizes) == 11 and sum(r["count"] for r in sizes) == 200
    found = index.search(["words", "17"], 3).collect()
    assert [r["id"] for r in found] == [17]
