"""Requests of several texts, report contexts within a budget, and stored tables that change."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodewell.operators import merge, report
from lodewell.operators.providers import Offline, embedded, reranked
from lodewell.operators.stored import StoredTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Embedder:
    """Replies in any order; refuses more than ten texts, and whatever stands with `bad`."""

    def embed(self, texts):
        if len(texts) > 10 or "bad" in texts:
            raise OSError(f"{len(texts)} texts")
        found = [(i, [float(len(t)), float(len(texts))]) for i, t in enumerate(texts)]
        random.Random(len(texts)).shuffle(found)
        return found[:-1] if "short" in texts else found

    def rerank(self, query, texts):
        if len(texts) > 10 or query == "bad":
            raise OSError("no")
        return [(i, float(len(t))) for i, t in reversed(list(enumerate(texts)))]


def test_texts_are_sent_ten_at_a_time_and_replies_put_back(spark):
    rows = [(i, "x" * i, "e") for i in range(25)] + [(25, None, "e"), (26, "y" * 40_000, "e")]
    got = {r["id"]: r for r in embedded(spark.createDataFrame(rows, "id int, text string, error string").coalesce(1), "text", Embedder).collect()}
    assert all(got[i]["embedding"] == [float(i), 10.0 if i < 20 else 7.0] for i in range(25))
    assert got[25]["embedding"][0] == 0.0 and got[26]["embedding"][0] == 32_003.0 and got[0]["error"] == "e" and got[0]["_error"] is None


def test_a_failed_request_leaves_the_others_alone(spark):
    rows = [(i, "bad" if i == 3 else "short" if i == 17 else "fine") for i in range(30)]
    got = {r["id"]: r for r in embedded(spark.createDataFrame(rows, "id int, text string").coalesce(1), "text", Embedder, attempts=2).collect()}
    assert all(got[i]["embedding"] is None and got[i]["error"] == "OSError: 10 texts" for i in range(10))
    assert all(got[i]["embedding"] is None and got[i]["error"] == "9 replies to 10 texts" for i in range(10, 20))
    assert all(got[i]["embedding"] == [4.0, 10.0] and got[i]["error"] is None for i in range(20, 30))


def test_reranking_falls_back_to_the_given_order(spark):
    rows = [(q, name, i, "z" * ((7 * i) % 13), 0.5 - i / 100, i) for q, name in ((1, "good"), (2, "bad")) for i in range(12)]
    df = spark.createDataFrame(rows, "query int, query_text string, doc int, text string, similarity double, rank int")
    got = reranked(df, 4, Embedder).orderBy("query", "place").collect()
    assert [(r["doc"], r["rerank_score"]) for r in got[:4]] == [(11, 12.0), (9, 11.0), (7, 10.0), (5, 9.0)] and all(r["reranked"] for r in got[:4])
    assert [(r["doc"], r["rerank_score"]) for r in got[4:]] == [(i, 0.5 - i / 100) for i in range(4)] and not any(r["reranked"] for r in got[4:])
    assert reranked(df.limit(0), 4, Embedder).count() == 0


def test_contexts_are_packed_within_a_budget(spark):
    rows = [(1, i, "x" * 19) for i in range(10)] + [(2, 0, "short")] + [(3, i, "") for i in range(50)] + [(4, 0, "y" * 1000), (4, 1, None), (5, 0, None)]
    df = spark.createDataFrame(rows, "g int, o int, t string")
    got = {r["g"]: r for r in report.packed(df, "g", F.col("t"), F.col("o"), budget=13).collect()}
    assert got[1]["text"] == "x" * 19 + "\n" + "x" * 19 + "\n" + "x" * 12 and (got[1]["tokens"], got[1]["lines"], got[1]["cut"]) == (13, 3, True)
    assert got[2]["text"] == "short" and not got[2]["cut"] and got[3]["lines"] == 13 and len(got[4]["text"]) == 52 and 5 not in got
    made = report.written(report.packed(df, "g", F.col("t"), F.col("o"), budget=13), "g", "On {text}:", Offline).collect()
    assert len(made) == 4 and all(json.loads(r["report"]) and r["error"] is None for r in made)


def test_lines_of_a_report(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    s = F.lit
    assert one(report.numbered_entity(s(2), s("A"), s("ORG"), s("d"))) == "2. A (ORG)\n   d" and one(report.numbered_entity(s(1), s("A"), s("ORG"), s(None))) == "1. A (ORG)"
    assert one(report.community_line(s("c"), s(None), s(3))) == "- c: N/A (3 entities)" and one(report.expanded_line(s("x"), s(0.456), s(2))) == "- x: relevance 0.46, hop 2"
    assert one(report.article_block(s(1), s("t"), s(None), s(None), s("z" * 300))) == "### Article 1\nTitle: t\nSource: N/A\nPublished: N/A\nSummary: " + "z" * 200 + "..."
    assert one(report.found_block(s(1), s("web"), s("why"), s("w" * 600))).endswith("w" * 500 + "...") and one(report.type_line(s("ORG"), s("firms"))) == "- ORG: firms"
    assert one(report.optional_section("Content:", s("q" * 3000))) == "\n\nContent:\n" + "q" * 2000 and one(report.optional_section("Content:", s(None))) == ""


def names(table):
    return {f.split("/_bucket=")[1] for f in table.read().inputFiles()}


def test_a_batch_changes_its_buckets_once(spark, tmp_path):
    kind = "canonical_name string, name string, type string, description string, article_ids array<int>, aliases array<string>, mention_count long"
    table = StoredTable.create(spark, str(tmp_path / "t"), kind, ["canonical_name"], buckets=16)
    first = spark.createDataFrame([(f"e{i}", f"E{i}", "X", "d", [i], ["a"], 1, i) for i in range(40)], kind + ", ordinal int")
    second = spark.createDataFrame([("e3", "e3", "Y", "", [99], ["b"], 2, 0), ("new", "New", "Z", "n", [1], [], 1, 1)], kind + ", ordinal int")
    assert table.apply(first, merge.merge_entities, "one") and table.read().count() == 40
    before = names(table)
    assert table.apply(second, merge.merge_entities, "two")
    after = names(table)
    assert len(before & after) >= len(before) - 2 and len(before - after) >= 1  # other buckets keep their files
    rows = sorted(map(str, table.read().collect()))
    assert not table.apply(second, merge.merge_entities, "two") and not table.apply(first, merge.merge_entities, "one")
    assert names(table) == after and sorted(map(str, StoredTable.open(spark, str(tmp_path / "t")).read().collect())) == rows
    got = table.read().where("canonical_name = 'e3'").first()
    assert got["mention_count"] == 3 and sorted(got["article_ids"]) == [3, 99] and got["description"] == "d"


def test_a_batch_cut_short_is_finished_and_not_merged_again(spark, tmp_path, monkeypatch):
    table = StoredTable.create(spark, str(tmp_path / "t"), "k long, n long", ["k"], buckets=4)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    batch = spark.range(20).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n"))
    table.apply(batch, add, "a")

    def broken(self, staged, touched):
        raise OSError("lost")

    for point in ("_replace", "_delete"):
        with monkeypatch.context() as m:
            m.setattr(StoredTable, point, broken if point == "_replace" else lambda self, path: broken(self, path, []))
            with pytest.raises(OSError, match="lost"):
                table.apply(batch, add, point)
        table.apply(batch, add, point)
    assert [r["n"] for r in table.read().select("n").distinct().collect()] == [3]
    gone = spark.range(20).select(F.col("id").alias("k"))
    table.apply(gone, lambda old, new: merge.remove(old, new, ["k"]), "gone")
    assert table.read().count() == 0
