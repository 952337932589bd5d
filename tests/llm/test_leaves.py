"""Leaves of the tree at any number of fingerprints, dealt out in units, and keys of any name."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.llm import simhash
from lodewell.operators.components import connected_components


def brute_force(values):
    low = {int(v): int(v) for v in values}
    points = np.sort(np.array(values, np.int64))
    near = np.bitwise_count(points.view(np.uint64)[:, None] ^ points.view(np.uint64)[None, :]) <= 3
    group = np.arange(len(points))
    while True:
        after = np.array([group[row].min() for row in near])
        if (after == group).all():
            return {int(p): int(points[g]) for p, g in zip(points, group, strict=True)} | {k: v for k, v in low.items() if k not in set(points.tolist())}
        group = after


@pytest.mark.parametrize("sizes", [{}, {"leaf_rows": 40, "min_leaves": 1, "sample_rows": 100, "unit_rows": 25}, {"leaf_rows": 20, "sample_rows": 10, "sample_per_leaf": 4, "unit_rows": 1000}])
def test_links_connect_what_brute_force_does(spark, sizes):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)) for c in np.repeat(centres, 15)]
    values = np.unique(np.concatenate([centres, np.array(near, np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)])).view(np.int64)
    prints = spark.createDataFrame([(int(v),) for v in values], "fp long")
    parts = {r["node"]: r["component"] for r in connected_components(simhash.near_links(prints, **sizes)).collect()}
    expected = brute_force(values)
    assert {v: parts.get(v, v) for v in map(int, values)} == expected and len(set(expected.values())) < len(values) - 500


def test_the_tree_has_the_leaves_asked_for():
    points = np.random.default_rng(1).integers(0, 2**63, 40_000, dtype=np.uint64)
    assert simhash.build_tree(points, 2500).leaves == 2500


def test_any_column_names(spark):
    rows = [(1, "one text of some words", 5), (2, "one text of some words", 6), (3, "quite another thing altogether here", 7)]
    docs = spark.createDataFrame(rows, "fp long, k string, root long")
    got = {r["fp"]: r["component_id"] for r in simhash.groups(docs, text="k", key="fp").collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    kept = simhash.deduplicate(docs.unionByName(docs.where("fp = 1")), text="k", key="fp")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_very_many_copies_and_long_texts(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.repeat(F.lit("a long text "), 50_000)).otherwise(F.lit("the same text in each")).alias("text"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(docs).collect()}
    assert got == {i: 7 if i == 7 else 0 for i in range(2000)}
