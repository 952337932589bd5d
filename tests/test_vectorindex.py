"""The vector index against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.operators import retrieval, vectorindex

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = 4 * rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000 + i, x[7].tolist()) for i in range(1500)]  # a third are copies
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0, 2.0]), (9004, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), x


@pytest.fixture(scope="module")
def index(clustered, tmp_path_factory):
    return vectorindex.build(clustered[0], str(tmp_path_factory.mktemp("index") / "i"), key="vec_id", vector="embedding", lists=40)


def rows(df):
    return [(r[0], round(r[1], 9)) for r in df.collect()]


def test_exact_searches_equal_the_scan(clustered, index):
    df, x = clustered
    df = df.where(F.size("embedding") == 16).where("vec_id < 9000")
    for query, k, threshold, exclude in ((x[0], 5, None, ()), (x[7], 12, None, (7, 3000)), (x[3] + x[400], 50, 0.9, ()), (-x[5], 4, None, ()), (x[9], 10, 0.99999, (9,))):
        want = retrieval.similar(df, query.tolist(), k, threshold=threshold, exclude=exclude).select("vec_id", "similarity")
        assert rows(index.search(query, k, threshold=threshold, exclude=exclude)) == rows(want)
    for bad in ([0.0] * 16, [float("nan")] * 16, [1.0], [None] * 16):
        assert index.search(bad, 5).count() == 0


def test_a_search_opens_few_folders(clustered, index):
    x = clustered[1]
    for found in (index.search(x[11], 5), index.search(x[11], 5, exact=False)):
        text = found._jdf.queryExecution().executedPlan().toString()
        opened = re.search(r"PartitionFilters: \[.*?list#\d+ (?:IN|INSET) \(?([\d,\s]+)|PartitionFilters: \[.*?\(list#\d+ = (\d+)", text)
        assert len([c for c in (opened[1] or opened[2]).split(",") if c.strip()]) <= 12


def test_recall_on_the_table(spark, tmp_path):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    index = vectorindex.build(df, str(tmp_path / "i"), key="vec_id", vector="embedding")
    found = index.search_all(df.where("vec_id % 50 = 0"), 10, key="vec_id", vector="embedding").toPandas()
    kept = df.where("embedding IS NOT NULL").toPandas()
    x = np.stack(kept["embedding"]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = kept["vec_id"].to_numpy()
    hits = total = 0
    for i in np.flatnonzero(keys % 50 == 0):
        cos = x @ x[i]
        cos[i] = -np.inf
        hits += (cos[np.searchsorted(keys, found.loc[found["query"] == keys[i], "match"])] >= np.sort(cos)[-10] - 1e-9).sum()
        total += 10
    assert hits / total >= 0.9 and index.probes < len(index.centroids)


def test_additions_are_found_and_an_index_can_be_opened_again(spark, clustered, tmp_path):
    df, x = clustered
    first = vectorindex.build(df.where("vec_id % 3 > 0"), str(tmp_path / "i"), key="vec_id", vector="embedding", lists=20)
    first.add(df.where("vec_id % 3 = 0"), key="vec_id", vector="embedding")
    again = vectorindex.VectorIndex.open(spark, str(tmp_path / "i"))
    assert (again.centroids == first.centroids).all() and again.probes == first.probes
    assert again.vectors().count() == 4500 and again.lists().agg(F.sum("n")).first()[0] == 4500
    want = retrieval.similar(df.where("vec_id < 9000"), x[6].tolist(), 30).select("vec_id", "similarity")
    assert rows(again.search(x[6], 30)) == rows(want)


def test_large_lists_are_dealt_in_units(clustered, index):
    df, _ = clustered
    some = df.where("vec_id % 500 = 0 AND vec_id < 9000")
    key = lambda d: sorted((r["query"], r["rank"], r["match"]) for r in d.collect())
    assert key(index.search_all(some, 7, key="vec_id", vector="embedding", unit_rows=90)) == key(index.search_all(some, 7, key="vec_id", vector="embedding"))


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    index = vectorindex.build(none, str(tmp_path / "i"), key="vec_id", vector="embedding")
    assert index.search([1.0], 5).count() == 0 and index.search_all(none, 5, key="vec_id", vector="embedding").count() == 0
    assert vectorindex.VectorIndex.open(spark, str(tmp_path / "i")).search([1.0], 5).count() == 0
