"""The graph builder, its report, and the parsers of a chat's steps."""

from pyspark.sql import functions as F

from lodewell.functions import contracts
from lodewell.operators import graph, knowledge, merge

ANSWERS = "article_id long, entities string, relations string"


def test_spellings_are_one_entity_and_unknown_ends_are_dropped(spark):
    rows = [
        (1, '{"entities": [{"name": "Ada"}, {"name": " Bob "}]}', '{"relationships": [{"source": "ADA", "target": "bob"}, {"source": "Ada", "target": "Zoe"}]}'),
        (2, '{"entities": [{"name": "ada"}, {"name": "Cy"}', '{"relationships": [{"source": "ada", "target": "Bob"}'),
        (3, None, "nothing"),
    ]
    kg = knowledge.build(spark.createDataFrame(rows, ANSWERS))
    assert sorted((r.id, r.name, r.mention_count) for r in kg.entities.collect()) == [(1_000_000, "Ada", 2), (1_000_001, "Bob", 1), (2_000_001, "Cy", 1)]
    assert [tuple(r) for r in kg.edges.select("source", "target", "weight").collect()] == [(1_000_000, 1_000_001, 2.0)]
    assert {r.id: r.community for r in kg.members.collect()} == {1_000_000: 1_000_000, 1_000_001: 1_000_000, 2_000_001: 2_000_001}
    assert sorted(tuple(r) for r in kg.mentions.collect()) == [(1, 1_000_000), (1, 1_000_001), (2, 1_000_000), (2, 2_000_001)]

    report = {r.section: r.text for r in knowledge.analyse(kg, spark.createDataFrame([(2,)], "article_id long")).collect()}
    assert report["entities"] == "- Ada (CONCEPT): N/A\n- Cy (CONCEPT): N/A"
    assert report["expanded"] == "- * Bob (CONCEPT): N/A"
    assert report["relationships"] == "- Ada --[RELATED_TO]--> Bob"
    assert report["communities"] == "- community 1000000: 2 entities\n- community 2000001: 1 entities"


def test_stored_names_unite_entities(spark):
    rows = [(1, '{"entities": [{"name": "IBM"}, {"name": "Big Blue"}, {"name": "Ada"}]}', '{"relationships": [{"source": "Ada", "target": "IBM"}, {"source": "Ada", "target": "Big Blue"}]}')]
    embed = lambda name: F.when(name == "Ada", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    stored = spark.createDataFrame([(7, "International Business Machines", [1.0, 0.1])], "id long, canonical_name string, embedding array<double>")
    kg = knowledge.build(spark.createDataFrame(rows, ANSWERS), stored=stored, embed=embed)
    assert sorted((r.name, r.mention_count) for r in kg.entities.collect()) == [("Ada", 1), ("International Business Machines", 2)]
    assert [r.weight for r in kg.edges.collect()] == [2.0]


def test_no_answers_no_graph(spark):
    kg = knowledge.build(spark.createDataFrame([], ANSWERS))
    assert kg.entities.isEmpty() and kg.edges.isEmpty() and kg.members.isEmpty()
    assert knowledge.analyse(kg, spark.createDataFrame([(1,)], "article_id long")).isEmpty()


def test_checks_fail_closed_and_words_stand_in(spark):
    texts = [None, "", "it passes", "核查通过", 'well {"passed": true, "reason": "ok"} and }', '{"passed": "maybe"}', "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = df.select(contracts.fact_check(F.col("t")).alias("c"), contracts.supervision(F.col("t"))["route"].alias("r"), contracts.research_thought(F.col("t"))["action"].alias("a")).collect()
    assert [r.c.passed for r in got] == [False, False, False, True, True, False, False]
    assert [r.c.issues == [] for r in got] == [False, False, False, True, True, True, False]
    assert all(r.r == "researcher" for r in got[:3]) and got[3].r == "fact_checker"
    assert all(r.a == "conclude" for r in got)


def test_updates_name_what_they_change(spark):
    stored = spark.createDataFrame([(1, "running", 5), (2, "running", 6)], "run int, status string, n int")
    batch = spark.createDataFrame([(1, "done", None), (9, "done", 1)], "run int, status string, n int")
    assert sorted(tuple(r) for r in merge.update(stored, batch, ["run"]).collect()) == [(1, "done", 5), (2, "running", 6)]


def test_spellings_are_closed_over_chains(spark):
    entities = spark.createDataFrame([(1, "Acme"), (2, "ACME Corp"), (3, "Apex"), (4, " "), (5, "acme")], "id long, name string")
    aliases = spark.createDataFrame([(1, "A.C."), (2, "a.c. "), (2, "Apex Ltd"), (3, "apex ltd"), (9, None)], "id long, alias string")
    found = {r["name"]: r["id"] for r in graph.resolution_map(entities, aliases).collect()}
    assert found == {"acme": 1, "acme corp": 1, "a.c.": 1, "apex ltd": 1, "apex": 1}
    edges = spark.createDataFrame([("Acme", "Apex"), ("A.C.", "apex"), ("nobody", "Apex")], "source_name string, target_name string")
    pairs = lambda df: sorted((r["source"], r["target"]) for r in df.collect())
    assert pairs(graph.resolve_names(edges, entities)) == [(1, 3)]
    assert pairs(graph.resolve_names(edges, entities, aliases=aliases)) == [(1, 1), (1, 1)]
