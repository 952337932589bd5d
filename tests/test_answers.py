"""Matching of vectors of any kind, summaries before chunks, report sections, components of the whole graph, and
scratch tables that go when nothing needs them."""

import os

import pytest
from pyspark.sql import functions as F

from lodewell.functions.chunking import chunk_array_summary_first, chunks, summary_first
from lodewell.operators import matching, report
from lodewell.operators.components import connected_components
from lodewell.plans import queries
from lodewell.plans.fixtures import edges
from lodewell.sources import tables

SF = "/root/testdata/sf0.001"


def test_unusable_vectors_match_nothing_and_spoil_nothing(spark):
    inf, nan = float("inf"), float("nan")
    kind = "id long, embedding array<double>"
    stored = spark.createDataFrame([(10, [1.0, 0.0]), (11, [inf, 1.0]), (12, [nan, 1.0]), (13, [0.0, 0.0]), (14, None), (15, []), (16, [1.0, None]), (17, [1.0, 0.0, 0.0]), (18, [2e200, 1e190]), (9, [2.0, 0.0])], kind)
    new = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0, 0.1]), (3, [0.0, 1.0]), (4, [inf, inf]), (5, None), (6, [1e-200, 0.0])], kind)
    got = {r["id"]: r["match"] for r in matching.best_matches(new, stored).collect()}
    assert got == {1: 18, 2: 17, 6: 9}
    assert matching.best_matches(new.limit(0), stored).count() == 0 and matching.best_matches(new, stored.limit(0)).count() == 0


def test_summaries_lead_chunks(spark):
    rows = [(1, "word " * 1000, "short"), (2, "word " * 10, "s" * 900), (3, "x" * 1990, "summary"), (4, "", "only"), (5, "text", None), (6, None, "s"), (7, "text", "")]
    docs = spark.createDataFrame(rows, "id long, text string, summary string")
    got = {r["id"]: [c.asDict() for c in r["c"]] for r in docs.select("id", chunk_array_summary_first("text", "summary").alias("c")).collect()}
    assert got == {i: summary_first(chunks(t), s) for i, t, s in rows}
    assert [c["chunk_number"] for c in got[3]] == [0, 1] and got[3][0]["chunk_end"] == 0


def test_sections_are_cut_off(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id"), F.when(F.col("id") != 99, F.concat(F.lit("- "), "id")).alias("line"))
    got = {r["g"]: r["text"] for r in report.section(rows, "g", F.col("line"), F.desc("id"), most=3).collect()}
    assert got == {0: "- 98\n- 96\n- 94", 1: "none\n- 97\n- 95"}


def test_components_of_the_whole_graph(spark):
    links = [(r["source"], r["target"]) for r in edges(spark, SF).collect()]
    root = {n: n for link in links for n in link}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r["id"]: r["community"] for r in queries.QUERIES["g07_components"](spark, SF).collect()} == {n: find(n) for n in root}


def test_scratch_tables_go(spark):
    folder = tables.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    chain = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = connected_components(chain)
    assert {r["component"] for r in found.collect()} == {0}
    assert len(set(os.listdir(folder)) - before) == 1  # what the result reads
    kept = tables.materialize(chain, "kept")
    tables.discard(kept, chain)
    assert len(set(os.listdir(folder)) - before) == 1


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())
