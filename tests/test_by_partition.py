"""What grows with the tables is joined by partition: nothing of it goes through the driver, and no task's part grows."""

from pyspark.sql import functions as F

from lodewell.operators import graph, knowledge, vectorindex
from lodewell.operators.components import connected_components
from lodewell.sources.tables import by_partition


def test_names_are_not_broadcast(spark):
    entities = spark.range(1000).select("id", F.concat(F.lit("Name "), "id").alias("name"))
    aliases = spark.range(0, 1000, 7).select("id", F.concat(F.lit("other "), (F.col("id") - F.col("id") % 2).cast("string")).alias("alias"))
    named = spark.range(1000).select(F.concat(F.lit("name "), "id").alias("source_name"), F.concat(F.lit("Name "), F.col("id") % 5).alias("target_name"))
    for found in (graph.resolve_names(named, entities), graph.resolve_names(named, entities, aliases=aliases)):
        assert found.count() == 1000 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_spellings_of_one_entity_link_nothing(spark, monkeypatch):
    given = []

    def counted(links, *ends):
        given.append(links.count())
        return connected_components(links, *ends)

    monkeypatch.setattr(graph, "connected_components", counted)
    entities = spark.createDataFrame([(i, f"E{i}") for i in range(1, 9)], "id long, name string")
    aliases = spark.createDataFrame([(5, "x"), (4, "X "), (4, "y"), (2, "Y"), (7, "z"), (8, "E7"), (None, "e1"), (3, None)], "id long, alias string")
    found = {r["name"]: r["id"] for r in graph.resolution_map(entities, aliases).collect()}
    assert found == {"e1": 1, "e2": 2, "e3": 3, "e4": 2, "e5": 2, "e6": 6, "e7": 7, "e8": 7, "x": 2, "y": 2, "z": 7}
    assert given == [3]  # x, y and e7 are shared, by two entities each


def test_settings_stay_where_they_are(spark):
    before = dict(spark.conf.getAll)
    df = by_partition(spark.range(10), rows=1 << 22)
    assert int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) == 16 and df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    parts = connected_components(spark.range(1, 50).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert parts.sparkSession is spark and [r["component"] for r in parts.select("component").distinct().collect()] == [1]
    assert dict(spark.conf.getAll) == before


def test_a_graph_is_built_without_broadcasts(spark):
    answers = spark.range(300).select(
        F.col("id").alias("article_id"),
        F.format_string('{"entities": [{"name": "P%s"}, {"name": "Q%s"}]}', "id", F.col("id") % 7).alias("entities"),
        F.format_string('{"relationships": [{"source": "p%s", "target": "q%s"}]}', "id", F.col("id") % 7).alias("relations"),
    )
    built = knowledge.build(answers)
    shown = built.entities.join(built.members, "id").join(graph.degrees(built.edges), "id")
    assert shown.count() == 307 and built.members.select("community").distinct().count() == 7
    assert "Broadcast" not in shown._jdf.queryExecution().executedPlan().toString()


def test_an_index_is_built_without_a_table_of_its_keys(spark, monkeypatch, tmp_path):
    rows = spark.range(2000).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i)).alias("x"))
    plans, kind = [], type(rows)

    def read(df, f=kind.toPandas):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(df)

    monkeypatch.setattr(kind, "toPandas", read)
    index = vectorindex.build(rows, str(tmp_path / "i"), key="id", vector="x", lists=10)
    assert len(plans) >= 2 and not any("Join" in plan for plan in plans)
    found = index.search_all(rows.where("id % 100 = 0"), 3, key="id", vector="x")
    assert found.columns == ["query", "rank", "match", "similarity"] and found.count() == 57  # the first is zero


def test_rows_of_a_small_file_are_dealt_before_they_are_ranked(spark):
    from lodewell.plans import queries

    plan = queries.QUERIES["t14_report_sections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2  # parts, as edges
