"""Connected components of an undirected edge table, as DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.sources.tables import by_partition, discard, handed, materialize


def _toward_minimum(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`pairs` (node, other) with `low`, the least node among a node and its neighbours; and the table of these minima.

    The minima are written first: with a plain exchange on either side of the join, AQE can split a hub.
    """
    least = materialize(pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low")), "least")
    return pairs.join(least, "node"), least


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that `edges` names; component is the smallest node reachable.

    Large-star and small-star rounds: each replaces a node's links by links to the least node of its
    neighbourhood, until nothing changes. Neighbourhoods are only ever reduced with `min`, which combines map-side, and
    joined back on the node, which AQE splits when one node is a hub; none is gathered into a row, and no table goes
    through the driver. Each round is written to the shared folder, and what the round before wrote is deleted. Null
    endpoints and self links are ignored; no edges gives no rows.
    """
    links = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    links = materialize(by_partition(links), "links")
    before = _signature(links)
    written, links = links, by_partition(links, rows=before[0])
    while True:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        # Large star: neighbours above a node move to the least node around it.
        large, large_minima = _toward_minimum(both)
        large = large.where("other > node").select(F.col("other").alias("a"), F.col("low").alias("b"))
        # Small star: a node and its smaller neighbours move to the least of them.
        down = materialize(large.distinct().select(F.col("a").alias("node"), F.col("b").alias("other")), "down")
        near, near_minima = _toward_minimum(down)
        small = (
            near.select(F.col("other").alias("a"), F.col("low").alias("b"))
            .union(near.select(F.col("node").alias("a"), F.col("low").alias("b")))
            .where("a <> b")
            .distinct()
        )
        after = materialize(small, "links")
        discard(written, large_minima, down, near_minima)
        links, written, settled = after, after, before
        before = _signature(links)
        if before == settled:
            links = handed(links, edges.sparkSession)
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )


def _signature(links: DataFrame) -> tuple:
    # xxhash64 sums identify the set of links; decimals keep the sum from overflowing.
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
