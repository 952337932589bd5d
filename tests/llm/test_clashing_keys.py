"""Rows of different texts under one key: every group keeps a document."""

from lodewell.llm import simhash

A, B, C = ("the quick brown fox jumps over the lazy dog by the river", "numbers and letters make up most of what is written here", "a third text that has nothing in common with the other two")


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, feed string")
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "", r["feed"]) for r in out.collect())


def test_a_key_shared_by_two_groups(spark):
    # Key 5 has a copy of 1's text and a text of its own group, in which 5 is the smallest.
    rows = [(1, A, "x"), (5, A, "x"), (5, B, "y"), (7, B, "x"), (9, C, "x")]
    assert kept(spark, rows) == [(1, A, "x"), (5, B, "y"), (9, C, "x")]


def test_both_groups_stay_under_one_key(spark):
    rows = [(5, A, "x"), (5, B, "y"), (5, B, "y"), (8, A, "z"), (None, A, "n"), (None, A, "n")]
    assert kept(spark, rows) == sorted([(-1, A, "n"), (-1, A, "n"), (5, A, "x"), (5, B, "y")])


def test_ties_go_to_the_smallest_text(spark):
    # Fingerprints ignore case, so these are one group.
    assert kept(spark, [(5, A.upper(), "x"), (5, A, "y"), (5, A.upper(), "x")]) == [(5, A.upper(), "x")]
