"""Tables dealt in parts of an even size."""

from pyspark.sql import functions as F

from lodewell.plans.fixtures import edges
from lodewell.sources.tables import dealt


def test_parts_hold_no_more_the_larger_the_table(spark):
    for n in (100, 10_000, 40_000):
        parts = dealt(spark.range(n), "id", rows=1000).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in parts) == n and max(r["count"] for r in parts) < 1400
    assert dealt(spark.range(0), "id").count() == 0


def test_edges_are_summed_in_parts_of_their_own(spark):
    rows = edges(spark, "/root/testdata/sf0.1")  # 600,000 lines
    assert rows.rdd.getNumPartitions() == 3 and rows.agg(F.sum("weight")).first()[0] == 600_000
