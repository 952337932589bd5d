"""Translations read once: each step of the parser stands in the plan once, whatever is picked from its result."""

from pyspark.sql import functions as F

from lodewell.functions import contracts

ANSWERS = {
    '```json\n{"chinese_title": "t", "chinese_summary": "s", "entities_preserved": ["a"]}\n```': ("t", "s", ["a"], "json"),
    '{"chinese_title": "t", "chinese_summary": "s", "entities_preserved": ["a"': ("t", "s", ["a"], "json"),
    '{"chinese_title": "t", "chinese_summary": ""}': ("t", "", [], "json"),
    "chinese_title: t\nchinese_summary: s, and more": ("t", "s, and more", [], "fields"),
    'chinese_title: t\nchinese_summary: ""': ("chinese_title: t", 'chinese_summary: ""', [], "text"),
    " t\n\n s\nu ": ("t", "s\nu", [], "text"),
    "only one line": (None, None, [], "error"),
    "": (None, None, [], "error"),
    "  \n ": (None, None, [], "error"),
    None: (None, None, [], "error"),
}


def test_answers_of_every_kind(spark):
    df = spark.createDataFrame([(a,) for a in ANSWERS], "answer string")
    got = df.select("answer", contracts.translation(F.col("answer")).alias("t")).collect()
    assert {r["answer"]: tuple(r["t"]) for r in got} == ANSWERS


def test_steps_stand_once_in_the_plan(spark):
    made = contracts.translation(F.col("answer"))
    df = spark.createDataFrame([("x",)], "answer string").select(made["title"].alias("a"), made["summary"].alias("b"), made["parser_mode"].alias("c"))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    # Three columns name the result. Written out wherever it is named, the parser took 16 readings of JSON and 230 of patterns.
    assert text.count("from_json(") <= 3 and text.count("regexp_extract(") <= 18
