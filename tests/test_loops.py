"""Loops of model calls: limits, isolation of failures, and rows that can't end."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodewell.operators import loops

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

ARTICLE = "id long, title string, source string, published_at string, summary string"
EDITED = "id long, original_title string, content string, title string, summary string"
GOOD = "one\n\n· two\n\n主编洞察：three"


class Endless:
    """Always wants another tool."""

    def complete(self, prompt):
        return "the report" if prompt.startswith("Write") else json.dumps({"thought": "t", "action": "echo", "action_input": {"q": "x"}})


class Moody:
    """Fails for titles with `bad`, answers nonsense for `odd`, and concludes otherwise."""

    def complete(self, prompt):
        if "bad" in prompt:
            raise OSError("down")
        return "nonsense" if "odd" in prompt and not prompt.startswith("Write") else '{"thought": "t", "action": "conclude"'


def echo(calls):
    return calls.where("key <> 2").select("key", F.concat(F.lit("echo "), F.col("input")["q"]).alias("output"))


def test_a_search_takes_no_more_steps_than_allowed(spark):
    df = spark.createDataFrame([(i, f"t{i}", "s", None, None) for i in (1, 2)] + [(3, None, None, None, None)], ARTICLE)
    got = {r["id"]: r for r in loops.search(df, Endless, {"echo": echo}, most_steps=3).collect()}
    assert got[1]["steps"] == 3 and [c["output"] for c in got[1]["collected"]] == ["echo x"] * 3 and got[1]["errors"] == []
    assert got[2]["steps"] == 3 and got[2]["collected"] == [] and got[2]["errors"] == ["tools: no output of echo"] * 3
    assert got[1]["report"] == got[2]["report"] == "the report"
    assert got[3]["errors"] == ["reasoning: no article"] and got[3]["report"] is None
    assert loops.search(df.limit(0), Endless, {"echo": echo}).count() == 0


def test_a_failed_call_stops_no_other_search(spark):
    df = spark.createDataFrame([(1, "fine", "s", None, "x"), (2, "bad", "s", None, "x"), (3, "odd", "s", None, "x")], ARTICLE)
    got = {r["id"]: r for r in loops.search(df, Moody, {}).collect()}
    assert got[1]["errors"] == [] and got[1]["report"] and got[3]["errors"] == [] and got[3]["report"]
    assert [e.split(":")[0] for e in got[2]["errors"]] == ["reasoning", "conclude"] and got[2]["report"] is None
    assert {r["steps"] for r in got.values()} == {0}


class Stubborn:
    """Explains at once, and never passes a check."""

    def complete(self, prompt):
        return '{"route": "explainer"}' if "Check: none\n" in prompt and "Response: no" in prompt or "Check: failed" in prompt and prompt.startswith("Route") else '{"route": "fact_checker", "passed": false, "issues": ["wrong"]}'


class Lost:
    def complete(self, prompt):
        return '{"route": "researcher", "thought": "t", "action": "dance"}'


class Silent:
    def complete(self, prompt):
        raise OSError("down")


def test_a_chat_ends_after_three_failed_checks(spark):
    df = spark.createDataFrame([(1, "hello")], "conv_id long, message string")
    r = loops.chat(df, Stubborn, {}).first()
    assert r["failures"] == 3 and r["passed"] is False and r["path"].count("fact_checker") == 3 and r["errors"] == []
    assert loops.chat(df.limit(0), Stubborn, {}).count() == 0


def test_a_chat_without_a_model_goes_by_rule_and_one_without_an_end_comes_back(spark):
    df = spark.createDataFrame([(1, "hello")], "conv_id long, message string")
    r = loops.chat(df, Silent, {}, most_rounds=16).first()
    assert r["failures"] == 1 and r["passed"] is False and r["response"].startswith("No answer")  # incomplete, so back to research
    assert r["path"] == ["supervisor", "think"] * 5 + ["supervisor", "explainer", "supervisor", "fact_checker", "supervisor", "think"]
    assert r["errors"][-1] == "chat: no end after 16 rounds, at supervisor"
    r = loops.chat(df, Lost, {}, most_rounds=9).first()
    assert "unknown tool dance" in r["errors"][0] and r["errors"][-1].startswith("chat: no end after 9 rounds")


class Writer:
    def complete(self, prompt):
        if "bad" in prompt:
            raise OSError("down")
        if prompt.startswith("Reflect"):
            return '{"passed": false, "issues": ["tone"]}' if "picky" in prompt else '{"passed": false, "issues": ["空行 missing"]}'
        return json.dumps({"chinese_title": "[AI] new", "chinese_summary": GOOD, "entities_preserved": []}, ensure_ascii=False)


def test_reflection_rounds(spark):
    rows = [(1, "o", "text", "[AI] t", GOOD), (2, "o", "text", "t", "short"), (3, "o", "picky", "[AI] t", GOOD), (4, "bad", "text", "[AI] t", GOOD), (5, "o", "", "t", "short"), (6, "o", "text", None, GOOD)]
    got = {r["id"]: r for r in loops.reflect(spark.createDataFrame(rows, EDITED), Writer).collect()}
    assert all(r["passed"] for r in got.values()) and len(got) == 6
    assert {i: r["retries"] for i, r in got.items()} == {1: 0, 2: 1, 3: 3, 4: 3, 5: 0, 6: 0}
    assert got[2]["title"] == "[AI] new" and got[2]["feedback"] is None and got[3]["feedback"] == "- tone" and got[4]["title"] == "[AI] t"


def test_rounds_refuse_nodes_without_a_step(spark):
    df = spark.createDataFrame([(1, "a"), (2, "end")], "id int, node string")
    assert sorted(r["id"] for r in loops.rounds(df, {"a": lambda rows: rows.withColumn("node", F.lit("end"))}).collect()) == [1, 2]
    with pytest.raises(ValueError, match="no step"):
        loops.rounds(df, {"a": lambda rows: rows.withColumn("node", F.lit("b"))})
    still = loops.rounds(df, {"a": lambda rows: rows}, most=2).collect()
    assert sorted((r["id"], r["node"]) for r in still) == [(1, "a"), (2, "end")]
