"""Mentions are joined where they lie: no names go through the driver."""

from lodewell.operators import merge
from lodewell.plans.fixtures import mentions

SF_DIR = "/root/testdata/sf0.001"


def test_names_are_not_broadcast(spark):
    rows = mentions(spark, SF_DIR)
    assert rows.count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_sets_are_not_broadcast(spark):
    rows = "canonical_name string, name string, type string, description string, article_ids array<bigint>, aliases array<string>, mention_count long"
    batch = spark.createDataFrame([("a", "A", "t", None, [1, 2], ["A"], 1, 5), ("a", "a", "t", None, [2], ["a"], 1, 6)], rows + ", ordinal long")
    merged = merge.merge_entities(spark.createDataFrame([], rows), batch)
    assert [(r["article_ids"], r["aliases"], r["mention_count"]) for r in merged.collect()] == [([1, 2], ["A", "a"], 2)]
    assert "BroadcastHashJoin" not in merged._jdf.queryExecution().executedPlan().toString()
