"""Numbers within groups, newest rows, and the small rules of listings, chats and graphs."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodewell.functions import contracts
from lodewell.operators import conversation, graph, ingest, listing, memory, report, retrieval


def test_numbers_of_a_group_that_holds_most_rows(spark):
    rng = random.Random(3)
    rows = [(1, i) for i in range(20_000)] + [(rng.choice([2, 3, None]), i) for i in range(500)] + [(4, None), (4, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, o long").repartition(8)
    got = {}
    for g, o, item in listing.numbered(df, "g", "o").collect():
        got.setdefault(g, []).append((item, -1 if o is None else o))
    expected = {}
    for g, o in rows:
        expected.setdefault(g, []).append(-1 if o is None else o)
    assert {g: sorted(v) for g, v in got.items()} == {g: list(enumerate(sorted(v))) for g, v in expected.items()}


def test_numbers_of_equal_rows_and_of_none(spark):
    df = spark.createDataFrame([("a", 1)] * 300 + [("b", 1)], "_rank string, _range long")
    got = listing.numbered(df, "_rank", "_range", name="n")
    assert got.columns == ["_rank", "_range", "n"]
    assert sorted(r["n"] for r in got.where("_rank = 'a'").collect()) == list(range(300))
    assert listing.numbered(df.limit(0), "_rank", "_range").isEmpty()


def test_a_large_group_in_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(50_000).select((F.col("id") % 50 == 0).alias("g"), F.hash("id").alias("o"), "id")
        got = listing.numbered(rows, "g", "o", "id")
        place = F.row_number().over(Window.partitionBy("g").orderBy("o", "id")) - 1
        assert got.count() == 50_000 and got.exceptAll(rows.withColumn("item", place.cast("long"))).isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_newest(spark):
    df = spark.createDataFrame([(1, 5, "x"), (2, 9, "y"), (3, 9, "x"), (4, None, "x")], "id long, at long, kind string")
    ids = lambda **k: [r["id"] for r in listing.newest(df, 3, when="at", key="id", **k).collect()]
    assert ids() == [2, 3, 1] and ids(kind="x") == [3, 1, 4] and ids(kind=None, since=F.lit(9)) == [2, 3] and ids(kind="z") == []


def test_citations_of_what_was_collected(spark):
    schema = "c array<struct<source:string,content:string>>"

    def cited(*infos):
        out = spark.createDataFrame([(list(infos),)], schema).select(contracts.info_citations(F.col("c")).alias("c")).first()["c"]
        return [tuple(c) for c in out]

    assert cited() == [] and cited(("web_search", None), ("web_search", '{"url": "u"}'), ("web_search", "[1, 2")) == []
    assert cited((None, None)) == [("", "", None, "")]
    assert cited(("memo", "x" * 300)) == [("memo", "memo", None, "x" * 100)]
    assert cited(("web_search", '[{"title": "a"}, {"url": "u", "source": "s"}, {"url": "v", "snippet": "' + "y" * 150 + '"}, {"url": "w"}]')) == [("web", "s", "u", ""), ("web", "", "v", "y" * 100)]
    assert len(cited(*[("memo", "x")] * 14)) == 10


def test_queries_behind_their_own(spark):
    df = spark.createDataFrame([("q", ["a", "q", "b"]), ("q", ["a", "b", "c"]), ("q", []), ("q", None)], "q string, x array<string>")
    assert [r[0] for r in df.select(contracts.expanded_queries(F.col("q"), F.col("x"), 2)).collect()] == [["a", "q"], ["q", "a"], ["q"], ["q"]]


def test_chats_and_memories(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 3, "assistant", None), (2, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in conversation.latest_message(rows).collect()] == [(1, 3, None)]
    stored = spark.createDataFrame([(1, "session", "s"), (1, "profile", None), (2, "session", "t"), (3, None, "u")], "conv_id long, memory_type string, content string")
    assert dict(memory.loaded(stored).collect()) == {1: {"session": "s", "profile": None}, 2: {"session": "t"}}
    assert dict(memory.loaded(stored, "profile").collect()) == {1: {"profile": None}}


def test_communities_and_what_is_shown(spark):
    members = spark.createDataFrame([("c", 1), ("c", 2), ("d", 3), ("d", 2), (None, 4), (None, 1)], "community string, id long")
    links = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 12), (9, 13)], "id long, article_id long")
    assert sorted(tuple(r) for r in graph.community_articles(members.where("community IS NOT NULL"), links).collect()) == [("c", 10), ("c", 11), ("d", 10), ("d", 11), ("d", 12)]
    around = spark.createDataFrame([(2,), (3,), (4,), (None,)], "id long")
    got = graph.community_overlap(around, members, spark.createDataFrame([(1,)], "id long"))
    assert {r["id"]: r["overlap"] for r in got.collect()} == {2: 1.0, 3: 0.0, 4: 0.0, None: 0.0}
    nodes = spark.createDataFrame([(True,), (False,), (None,)], "is_expanded boolean")
    assert tuple(graph.visual_statistics(nodes, links, members.limit(0)).first()) == (3, 2, 1, 5, 0)


def test_statuses_sources_and_chunks(spark):
    texts = spark.createDataFrame([(None,), ("",), (" " * 200,), ("x" * 99,), ("x" * 100,)], "t string")
    assert [r[0] for r in texts.select(ingest.backfill_status(F.col("t"))).collect()] == ["error", "error", "skipped", "skipped", "success"]
    assert [r[0] for r in spark.createDataFrame([(0,), (2,), (None,)], "e long").select(ingest.run_status(F.col("e"))).collect()] == ["completed", "completed_with_errors", "completed"]
    reports = spark.createDataFrame([(1, None, None), (2, "", 5), (3, "r", 6)], "id long, deepsearch_report string, deepsearch_performed_at long")
    assert [tuple(r) for r in report.status(reports).orderBy("id").collect()] == [(1, False, None, None), (2, True, 5, None), (3, True, 6, "r")]
    found = spark.createDataFrame([("q", "b"), ("q", "a"), ("q", "b"), ("r", None)], "by string, source string")
    assert dict(retrieval.distinct_sources(found, "by").collect()) == {"q": ["a", "b"], "r": []}
    chunks = spark.createDataFrame([(1, 2), (1, 0), (2, 1), (1, 1)], "article_id long, chunk_number long")
    assert [r["chunk_number"] for r in retrieval.article_chunks(chunks, 1).collect()] == [0, 1, 2]
