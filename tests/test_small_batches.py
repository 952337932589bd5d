"""Texts go to Python in small batches, whatever the session's settings."""

import pytest

from lodewell.plans import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["c01_chunks", "c02_summary_first_chunks", "c04_page_text", "s31_chunk_backfill", "v15_offline_embedding", "c11_reflection_rounds"])
def test_batches_of_texts_are_bounded(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    assert found.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert found.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("8m", "8388608", "8388608b")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
