"""Queries that build a knowledge graph from answers and report on it, and those of the parsers of a chat's steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.functions import contracts
from lodewell.operators import knowledge, merge, retrieval
from lodewell.plans.registry import query
from lodewell.sources.tables import table


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """What a model might answer about each customer: where they live; of every third broken off behind the last entity."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations, 5 regions
    close = F.when(F.col("c_custkey") % 3 == 0, "").otherwise("]}")
    entities = F.format_string('{"entities": [{"name": "%s", "type": "PERSON"}, {"name": "%s "}, {"name": "%s", "type": "REGION"}', "c_name", F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")), "r_name")
    relations = F.format_string('{"relationships": [{"source": "%s", "target": "%s"}, {"source": "%s", "target": "%s"}, {"source": "%s", "target": "nowhere"}', "c_name", "n_name", F.lower("n_name"), "r_name", "c_name")
    return rows.select(F.col("c_custkey").alias("article_id"), F.concat(entities, close).alias("entities"), F.concat(relations, close).alias("relations"))


_GRAPH = """
said AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (
    SELECT c_custkey AS article, c_custkey * 1000000 AS o, c_name AS name, 'PERSON' AS type, r_name AS part FROM said
    UNION ALL SELECT c_custkey, c_custkey * 1000000 + 1, CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE n_name END, 'CONCEPT', r_name FROM said
    UNION ALL SELECT c_custkey, c_custkey * 1000000 + 2, r_name, 'REGION', r_name FROM said
),
e AS (SELECT lower(name) AS key, min(o) AS id, arg_min(name, o) AS name, arg_min(type, o) AS type, count(*) AS mention_count, min(part) AS part FROM m GROUP BY 1),
g AS (SELECT e.*, min(id) OVER (PARTITION BY part) AS community FROM e),
links AS (
    SELECT s.id AS source, t.id AS target, sum(n)::DOUBLE AS weight
    FROM (SELECT lower(c_name) AS a, lower(n_name) AS b, count(*) AS n FROM said GROUP BY 1, 2 UNION ALL SELECT lower(n_name), lower(r_name), count(*) FROM said GROUP BY 1, 2)
    JOIN e s ON s.key = a JOIN e t ON t.key = b GROUP BY 1, 2
)
"""


@query("g11_graph_builder", f"""
WITH {_GRAPH}, ends AS (SELECT source AS id, weight FROM links UNION ALL SELECT target, weight FROM links),
     d AS (SELECT id, count(*) AS degree, sum(weight) AS weight FROM ends GROUP BY 1)
SELECT id, name, type, mention_count, community, degree, weight FROM g JOIN d USING (id)
""")
def g11(spark, d):
    built = knowledge.build(_answers(spark, d))
    ends = built.edges.select(F.col("source").alias("id"), "weight").union(built.edges.select("target", "weight"))
    ends = ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))
    return built.entities.join(built.members, "id").join(ends, "id").select("id", "name", "type", F.col("mention_count").cast("long").alias("mention_count"), "community", "degree", "weight")


@query("g12_graph_analyst", f"""
WITH {_GRAPH}, b AS (SELECT source AS node, target AS other, weight FROM links UNION ALL SELECT target, source, weight FROM links),
s AS (SELECT DISTINCT id FROM m JOIN e ON lower(m.name) = key WHERE article <= 5),
f AS (
    SELECT id, 0.3e0 * least(w / 5, 1e0) + CASE WHEN community IN (SELECT community FROM g WHERE id IN (FROM s)) THEN 0.3e0 ELSE 0 END AS relevance
    FROM (SELECT node AS id, avg(weight) AS w FROM b WHERE other IN (FROM s) AND node NOT IN (FROM s) GROUP BY 1) JOIN g USING (id)
    ORDER BY relevance DESC, id LIMIT 50
),
n AS (SELECT id FROM s UNION ALL SELECT id FROM f),
lines AS (
    SELECT 'entities' AS section, 20 AS most, '- ' || name || ' (' || type || '): N/A' AS line, row_number() OVER (ORDER BY mention_count DESC, id) AS r FROM g WHERE id IN (FROM s)
    UNION ALL SELECT 'expanded', 10, '- * ' || name || ' (' || type || '): N/A', row_number() OVER (ORDER BY relevance DESC, id) FROM f JOIN g USING (id)
    UNION ALL SELECT 'relationships', 20, '- ' || x.name || ' --[RELATED_TO]--> ' || y.name, row_number() OVER (ORDER BY weight DESC, source, target)
              FROM links JOIN g x ON x.id = source JOIN g y ON y.id = target WHERE source IN (FROM n) AND target IN (FROM n)
    UNION ALL SELECT 'communities', 10, '- community ' || community || ': ' || count(*) || ' entities', row_number() OVER (ORDER BY count(*) DESC, community)
              FROM g WHERE community IN (SELECT community FROM g WHERE id IN (FROM n)) GROUP BY community
)
SELECT section, string_agg(line, chr(10) ORDER BY r) AS text FROM lines WHERE r <= most GROUP BY 1
""")
def g12(spark, d):
    """The report on the articles of five customers, one hop around what they mention."""
    wanted = table(spark, d, "customer").where("c_custkey <= 5").select(F.col("c_custkey").alias("article_id"))
    return knowledge.analyse(knowledge.build(_answers(spark, d)), wanted, hops=1)


@query("v13_related_articles", """
WITH s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings WHERE vec_id <> 0),
     b AS (SELECT * FROM s ORDER BY s DESC, id LIMIT 5)
SELECT source AS title, text[1:200] AS summary, lang AS source, source || '/' || doc_id AS url, round(s, 3) AS score FROM b JOIN documents ON doc_id = id
""")
def v13(spark, d):
    vectors = table(spark, d, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()
    found = retrieval.similar(vectors, first[0] if first else [0.0], 5, exclude=[0])
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("title"), F.col("text").alias("summary"), F.col("lang").alias("source"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"))
    return retrieval.related(found, docs, key="vec_id")


@query("l18_chat_steps", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'explainer' WHEN 1 THEN 'researcher' WHEN 2 THEN 'end' ELSE 'fact_checker' END AS route,
       CASE event_id % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 WHEN 2 THEN 1 ELSE 0.9 END::DOUBLE AS completeness,
       CASE event_id % 4 WHEN 0 THEN 'web_search' WHEN 1 THEN 'conclude' WHEN 2 THEN 'conclude' ELSE 'vector_search' END AS action,
       event_id % 4 = 0 AS passed
FROM events
""")
def l18(spark, d):
    """Answers in JSON, of an unknown route, and in plain words; a check of facts that can't be read has failed."""
    k = F.col("event_id") % 4
    whole = F.lit('{"route": "explainer", "info_completeness": 0.75, "thought": "t", "action": "web_search", "passed": true, "reason": "r"}')
    other = F.lit('so: {"route": "elsewhere", "action": "conclude", "passed": false}')
    answer = F.when(k == 0, whole).when(k == 1, other).when(k == 2, "We are at the END, it may pass").otherwise("look at facts, by Vector_Search")
    step, thought, check = contracts.supervision(answer), contracts.research_thought(answer), contracts.fact_check(answer)
    return table(spark, d, "events").select("event_id", step["route"].alias("route"), step["completeness"].alias("completeness"), thought["action"].alias("action"), check["passed"].alias("passed"))


@query("l14_answer_parts", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || '!' ELSE '' END AS content FROM events")
def l14(spark, d):
    k = F.col("event_id") % 3
    kind = F.col("event_type")
    parts = F.format_string('["%s", {"type": "image", "text": "x"}, {"type": "text", "text": "!"}]', kind)
    answer = F.when(k == 0, kind).when(k == 1, parts).otherwise("[]")
    return table(spark, d, "events").select("event_id", contracts.content_text(answer).alias("content"))


@query("s18_run_records", """
SELECT conv_id AS run, CASE WHEN conv_id % 3 = 0 THEN 'running' WHEN conv_id % 3 = 1 THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN conv_id % 3 = 0 THEN 0 ELSE count(*) END AS articles, CASE WHEN conv_id % 3 = 2 THEN 'timeout' END AS error
FROM conversations GROUP BY conv_id
""")
def s18(spark, d):
    """Runs are recorded as running when they start, and updated when they end; what an update doesn't name stays."""
    runs = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("run")).agg(F.count("*").alias("articles"))
    started = runs.select("run", F.lit("running").alias("status"), F.lit(0).cast("long").alias("articles"), F.lit(None).cast("string").alias("error"))
    status = F.when(F.col("run") % 3 == 1, "completed").otherwise("failed")
    ended = runs.where("run % 3 <> 0").select("run", status.alias("status"), "articles", F.when(F.col("run") % 3 == 2, "timeout").alias("error"))
    return merge.update(started, ended, ["run"])


@query("s26_seeded_feeds", "SELECT DISTINCT source AS name, 'https://' || source || '/rss' AS url, true AS is_active FROM documents WHERE source IS NOT NULL")
def s26(spark, d):
    """Default feeds go into an empty table, and into no other."""
    sources = table(spark, d, "documents").where("source IS NOT NULL").select("source").distinct()
    feeds = sources.select(F.col("source").alias("name"), F.concat(F.lit("https://"), "source", F.lit("/rss")).alias("url"), F.lit(True).alias("is_active"))
    seeded = merge.seed(feeds.where("false"), feeds)
    return merge.seed(seeded, feeds.withColumn("is_active", F.lit(False)))
