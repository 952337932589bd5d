"""The full-text index against reading every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodewell.functions.text import stems
from lodewell.operators import retrieval, textindex


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.choice([3, 20, 20, 200]))), rng.choice(words)) for i in range(400)]
    rows += [(400, None, None), (401, "", "w1"), (402, "w0 " * 5000, None), (403, "the of", None)]
    return spark.createDataFrame(rows, "id long, text string, title string")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return textindex.build(docs, str(tmp_path_factory.mktemp("index") / "i"), key="id", text="text", body=1.0, buckets=4, block_documents=30)


def rows(df):
    return [(r["id"], round(r["text_score"], 9)) for r in df.collect()]


def test_searches_equal_reading_every_text(docs, index):
    for query, k in ((["w0"], 5), (["w0", "w1"], 10), (["w28", "w29"], 50), (["w1", "w2", "w3"], 1000), (["w0", "nowhere"], 5), (["w3", "w3"], 7)):
        assert rows(index.search(query, k)) == rows(retrieval.text_match(docs, sorted(set(query)), k, key="id", text="text")), query
    assert rows(index.search([], 5)) == [] and rows(index.search(["the"], 5)) == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_search_opens_the_folders_of_its_terms_and_of_the_best_blocks(index):
    found = index.search(["w0", "w1"], 3)
    text = plan(found)
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|INSET|=)", text) and re.search(r"PartitionFilters: \[.*block#\d+ (IN|INSET|=)", text)
    every = {r["block"] for r in index.postings().select("block").distinct().collect()}
    opened = {f.split("block=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(every) > 12 and {int(b) for b in opened} <= every
    read = [int(b) for b in re.search(r"block#\d+ (?:IN|INSET) \(?([\d,\s]+)", text)[1].split(",") if b.strip()]
    assert len(read) < len(every) / 2  # block maxima rule out the rest


def test_additions_are_found_and_an_index_can_be_opened_again(spark, docs, tmp_path):
    path = str(tmp_path / "i")
    first = textindex.build(docs.where("id % 2 = 0"), path, key="id", text="text", title="title", buckets=4, block_documents=50)
    first.add(docs.where("id % 2 = 1"), key="id", text="text", title="title")
    again = textindex.TextIndex.open(spark, path)
    assert again == first
    whole = textindex.build(docs, str(tmp_path / "w"), key="id", text="text", title="title", buckets=2, block_documents=1000)
    for query in (["w0"], ["w2", "w5"], ["w29"]):
        assert rows(again.search(query, 20)) == rows(whole.search(query, 20)) != []
    assert again.documents().count() == docs.count()


def test_headings_count_more(spark, tmp_path):
    df = spark.createDataFrame([(1, "deep learning", "news"), (2, "old news", "deep learning"), (3, "deep deep learning learning", "x")], "id long, text string, title string")
    found = textindex.build(df, str(tmp_path / "i"), key="id", text="text", title="title").search(["deep", "learning"], 3)
    assert [r["id"] for r in found.collect()] == [2, 3, 1]


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    index = textindex.build(none, str(tmp_path / "i"), key="id", text="text")
    assert index.search(["w0"], 5).count() == 0 and textindex.TextIndex.open(spark, str(tmp_path / "i")).search(["w0"], 5).count() == 0


def test_stems(spark):
    given = ["cats", "class", "virus", "flies", "eies", "boxes", "running", "run", "falling", "sing", "hopped", "agreed", "the", "runs", "bed"]
    got = spark.range(1).select(stems(F.array(*map(F.lit, given)))).first()[0]
    assert got == ["cat", "class", "virus", "fly", "eie", "box", "run", "run", "fall", "sing", "hop", "agre", "the", "run", "bed"]


def test_stemmed_searches(spark, tmp_path):
    df = spark.createDataFrame([(1, "He was running for miles"), (2, "runs a mile"), (3, "a runner")], "id long, text string")
    index = textindex.build(df, str(tmp_path / "i"), key="id", text="text", stemmed=True)
    assert sorted(r["id"] for r in index.search(["run", "miles"], 9).collect()) == [1, 2]
