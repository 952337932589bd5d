"""Recall of the index under repeated vectors, and with the settings that ship."""

import numpy as np
from pyspark.sql import functions as F

from lodewell.llm import additive, queries


def recall(found, keys, x, asked, k):
    """Share of the true k nearest that were found; copies of one vector count as one another."""
    hits = total = 0
    by_query = {q: set(g["vec_id"]) for q, g in found.groupby("query_id")}
    for q in asked:
        scores = x @ x[np.flatnonzero(keys == q)[0]]
        scores[keys == q] = -np.inf
        least = np.sort(scores)[-k]
        hits += sum(scores[np.flatnonzero(keys == v)[0]] >= least - 1e-9 for v in by_query.get(q, ()))
        total += k
    return hits / total


def test_copies_do_not_displace_the_sample(spark):
    x = np.random.default_rng(2).standard_normal((6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    first = df.orderBy(F.xxhash64("embedding")).select("embedding").first()[0]
    copies = spark.range(10_000, 30_000).select(F.col("id").alias("vec_id"), F.lit(first).cast("array<double>").alias("embedding"))
    both = df.union(copies)
    found = additive.nearest(both, (F.col("k") % 100 == 0) & (F.col("k") < 6000), k=5).toPandas()
    hot = int(np.flatnonzero((x == np.array(first)).all(axis=1))[0])
    asked = [q for q in range(0, 6000, 100)]
    found["vec_id"] = found["vec_id"].where(found["vec_id"] < 6000, hot)
    found = found.drop_duplicates(["query_id", "vec_id"])
    hits = 0
    for q in asked:
        scores = x @ x[q]
        scores[q] = -np.inf
        own = set(found.loc[found["query_id"] == q, "vec_id"])
        hits += len(own & set(np.argsort(-scores)[: len(own)].tolist())) / max(len(own), 1)
    assert hits / len(asked) >= 0.9
    assert additive.fit(both).words.std(axis=1).min() > 0  # no codebook holds one codeword only
    assert (found.groupby("query_id").size() <= 5).all()


def test_recall_with_the_settings_that_ship(spark):
    for sf in ("sf0.01", "sf0.1"):
        d = f"/root/testdata/{sf}"
        kept = spark.read.parquet(f"{d}/embeddings.parquet").where(F.col("embedding").isNotNull()).toPandas()
        keys, x = kept["vec_id"].to_numpy(), np.stack(kept["embedding"]).astype(np.float64)
        asked = [k for k in keys.tolist() if k % 20 == 0]
        found = queries.op10_nearest(spark, d).toPandas()
        assert (found.groupby("query_id").size() == 20).all() and recall(found, keys, x, asked, 20) >= 0.95
