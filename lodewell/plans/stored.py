"""Queries of reranked candidates, report contexts, and stored tables that change."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.functions import contracts
from lodewell.operators import conversation, graph, merge, report
from lodewell.operators.providers import reranked
from lodewell.operators.stored import StoredTable
from lodewell.plans.fixtures import MENTIONS, edges, edges_sql, mentions
from lodewell.plans.registry import query
from lodewell.plans.scripted import Ranker
from lodewell.sources.tables import dealt, scratch_path, table


@query("v10_reranked_candidates", """
WITH c AS (
    SELECT conv_id, turn, length(text) % 97 AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations
), p AS (
    SELECT *, conv_id % 7 = 3 AS off, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 7 = 3 THEN 0 ELSE -score END, rank) AS place FROM c WHERE rank <= 15
)
SELECT conv_id, turn, place, CASE WHEN off THEN 1e0 / rank ELSE score END AS rerank_score, NOT off AS reranked FROM p WHERE place <= 5
""")
def v10(spark, d):
    """The first turns of each conversation as candidates: the five best by a model, or by their order where it fails."""
    rank = F.row_number().over(conversation.turns("conv_id", "turn"))
    some = table(spark, d, "conversations").withColumn("rank", rank).where("rank <= 15")
    found = some.withColumns({"query_text": F.concat(F.lit("conversation "), "conv_id"), "similarity": 1 / F.col("rank")})
    return reranked(found, 5, Ranker, by="conv_id").select("conv_id", "turn", "place", "rerank_score", "reranked")


@query("l16_report_contexts", f"""
WITH {edges_sql()}, l AS (
    SELECT p_size AS community, 1 AS part, p_retailprice AS o, p_partkey AS i, 0 AS j, '- ' || p_name || ' (' || p_brand || '): N/A' AS line FROM part
    UNION ALL SELECT source % 50 + 1, 2, weight, source, target, '- ' || source || ' --[SUPPLIES]--> ' || target FROM edges
), c AS (
    SELECT *, row_number() OVER w AS n, greatest(1, (length(line) + 1) // 4) AS cost, coalesce(sum(greatest(1, (length(line) + 1) // 4)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM l WINDOW w AS (PARTITION BY community ORDER BY part, o DESC, i, j)
)
SELECT community, string_agg(CASE WHEN cost > 300 - before THEN line[:(300 - before)::INT * 4] ELSE line END, chr(10) ORDER BY n) AS text,
       sum(least(cost, 300 - before))::BIGINT AS tokens, count(*) AS lines, bool_or(cost > 300 - before) AS cut
FROM c WHERE before < 300 GROUP BY 1
""")
def l16(spark, d):
    """For each community its entities, the dearest first, and then its relationships, within 300 tokens."""
    part = dealt(table(spark, d, "part"), "p_partkey")
    entity = report.entity_line(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), F.lit(False))
    one = part.select(F.col("p_size").cast("long").alias("community"), F.lit(1).alias("part"), F.col("p_retailprice").cast("double").alias("o"), F.col("p_partkey").cast("long").alias("i"), F.lit(0).cast("long").alias("j"), entity.alias("line"))
    relation = report.relation_line(F.col("source").cast("string"), F.lit("SUPPLIES"), F.col("target").cast("string"))
    two = edges(spark, d).select((F.col("source") % 50 + 1).cast("long"), F.lit(2), "weight", F.col("source").cast("long"), F.col("target").cast("long"), relation)
    return report.packed(one.union(two), "community", F.col("line"), F.col("part"), F.desc("o"), F.col("i"), F.col("j"), budget=300)


_ENTITIES = "canonical_name string, name string, type string, description string, article_ids array<bigint>, aliases array<string>, mention_count long"


@query("s15_stored_entities", f"""
WITH {MENTIONS} SELECT lower(name) AS canonical_name, count(*) AS mention_count, count(DISTINCT article_id) AS articles, count(DISTINCT name) AS spellings FROM mentions GROUP BY 1
""")
def s15(spark, d):
    """Mentions in two batches into a stored table, the second of them twice: it counts once."""
    each = mentions(spark, d).select(F.lower("name").alias("canonical_name"), "name", "type", F.lit(None).cast("string").alias("description"), F.array("article_id").alias("article_ids"), F.array("name").alias("aliases"), F.lit(1).cast("long").alias("mention_count"), "ordinal")
    stored = StoredTable.create(spark, scratch_path(spark, "entities"), _ENTITIES, ["canonical_name"], buckets=8)
    for batch, rows in (("even", each.where("article_ids[0] % 2 = 0")), ("odd", each.where("article_ids[0] % 2 = 1")), ("odd", each.where("article_ids[0] % 2 = 1"))):
        stored.apply(rows, merge.merge_entities, batch)
    return stored.read().select("canonical_name", "mention_count", F.size("article_ids").alias("articles"), F.size("aliases").alias("spellings"))


@query("s16_stored_links", f"""
WITH {MENTIONS} SELECT name AS canonical_name, type, count(*) AS mention_count, count(DISTINCT article_id) AS articles FROM (SELECT lower(name) AS name, article_id, arg_min(type, ordinal) OVER (PARTITION BY lower(name)) AS type FROM mentions) GROUP BY 1, 2
""")
def s16(spark, d):
    """Entities and the articles they stand in, as two stored tables: no row grows with the articles."""
    each = mentions(spark, d).select(F.lower("name").alias("canonical_name"), "name", "type", F.lit(None).cast("string").alias("description"), F.lit(1).cast("long").alias("mention_count"), "ordinal", "article_id")
    entities = StoredTable.create(spark, scratch_path(spark, "entities"), "canonical_name string, name string, type string, description string, mention_count long", ["canonical_name"], buckets=8)
    links = StoredTable.create(spark, scratch_path(spark, "links"), "canonical_name string, article_id long", ["canonical_name", "article_id"], buckets=8)
    for odd in (0, 1, 1):
        batch = each.where(F.col("article_id") % 2 == odd)
        entities.apply(batch.drop("article_id"), merge.merge_entity_rows, f"batch {odd}")
        links.apply(batch, merge.merge_links, f"batch {odd}")
    articles = links.read().groupBy("canonical_name").agg(F.count("*").alias("articles")).hint("shuffle_hash")
    first = each.groupBy("canonical_name").agg(F.min_by("type", "ordinal").alias("type")).hint("shuffle_hash")
    return entities.read().drop("type").join(first, "canonical_name").join(articles, "canonical_name").select("canonical_name", "type", "mention_count", "articles")


@query("s20_report_write_back", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'report on ' || doc_id WHEN doc_id % 3 = 1 THEN 'old' END AS report, doc_id % 3 = 0 AS analysed FROM documents
""")
def s20(spark, d):
    """Reports are written back to their articles; one that failed is null, and leaves what was there."""
    k = F.col("doc_id")
    articles = table(spark, d, "documents").select("doc_id", F.when(k % 3 < 2, "old").alias("report"), F.lit(False).alias("analysed"))
    reports = articles.where("doc_id % 3 <> 1").select("doc_id", F.when(k % 3 == 0, F.concat(F.lit("report on "), k.cast("string"))).alias("report"))
    return merge.update(articles, reports.withColumn("analysed", F.when(F.col("report").isNotNull(), F.lit(True))), ["doc_id"])


@query("s21_analysis_records", """
SELECT conv_id AS analysis, conv_id % 5 AS user_id, count(*) AS articles FROM conversations WHERE conv_id % 5 <> 0 GROUP BY 1
UNION ALL SELECT -conv_id - 1, 9, 1 FROM conversations WHERE turn = 0
""")
def s21(spark, d):
    """Analyses are recorded for users who are known, beside the records there are."""
    rows = table(spark, d, "conversations")
    stored = rows.where("turn = 0").select((-F.col("conv_id") - 1).alias("analysis"), F.lit(9).cast("long").alias("user_id"), F.lit(1).cast("long").alias("articles"))
    made = rows.groupBy("conv_id").agg(F.count("*").alias("articles"))
    made = made.select(F.col("conv_id").alias("analysis"), F.when(F.col("conv_id") % 5 != 0, F.col("conv_id") % 5).alias("user_id"), "articles")
    return merge.record(stored, made, user="user_id")


@query("h13_archive", "SELECT conv_id, CASE WHEN conv_id = 4 THEN 'archived' ELSE 'active' END AS status FROM conversations GROUP BY 1")
def h13_one(spark, d):
    stored = table(spark, d, "conversations").select("conv_id").distinct().withColumns({"user_id": F.lit(0), "status": F.lit("active")})
    return conversation.archived(stored, spark.createDataFrame([(4, 0)], "conv_id long, user_id int")).select("conv_id", "status")


@query("h13_own_archive", """
SELECT conv_id, CASE WHEN conv_id % 4 = 1 AND conv_id % 3 = 0 THEN 'archived' ELSE 'active' END AS status FROM conversations GROUP BY 1
""")
def h13(spark, d):
    """Users archive conversations of their own: a third of those that are asked for."""
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    stored = ids.withColumns({"user_id": F.col("conv_id") % 3, "status": F.lit("active")})
    asked = ids.where("conv_id % 4 = 1").withColumn("user_id", F.lit(0))
    return conversation.archived(stored, asked).select("conv_id", "status")


@query("h01_context", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS ago FROM conversations)
SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'cache' WHEN 1 THEN 'session' ELSE 'messages' END AS source,
       CASE conv_id % 3 WHEN 0 THEN 'cached ' || conv_id WHEN 1 THEN 'session ' || conv_id ELSE string_agg(CASE WHEN ago <= 10 THEN turn END, ',' ORDER BY turn) END AS context
FROM r GROUP BY 1
""")
def h01(spark, d):
    """The context of a chat: what is cached, else the stored session, else the last ten messages."""
    rows = table(spark, d, "conversations")
    ids = rows.select("conv_id").distinct()
    given = lambda part, name: ids.where(part).select("conv_id", F.concat(F.lit(f"{name} "), "conv_id").alias("context"))
    last = conversation.last_messages(rows, 10)
    shown = last.select("conv_id", F.array_join(F.transform("messages", lambda m: m["turn"].cast("string")), ",").alias("context"))
    return conversation.context(given("conv_id % 3 = 0", "cached"), given("conv_id % 3 < 2", "session"), shown)


@query("j12_visual_hubs", f"""
WITH {edges_sql()}, m AS (SELECT source AS id, source % 20 AS community FROM edges UNION SELECT target, source % 20 FROM (SELECT target, min(source) AS source FROM edges GROUP BY 1)),
b AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges), d AS (SELECT id, count(*) AS degree FROM b GROUP BY 1),
h AS (SELECT community, id AS hub FROM m JOIN d USING (id) QUALIFY row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) = 1)
SELECT community, hub, CASE WHEN hub % 2 = 1 THEN 'node ' || hub END AS hub_label FROM h
""")
def j12(spark, d):
    """Hubs of communities with their labels, which only nodes that are shown have: those with odd ids."""
    rows = edges(spark, d)
    first = rows.groupBy("target").agg(F.min("source").alias("source"))
    members = rows.select(F.col("source").alias("id"), (F.col("source") % 20).alias("community")).union(first.select("target", F.col("source") % 20)).distinct()
    shown = members.where("id % 2 = 1").select("id", F.concat(F.lit("node "), F.col("id").cast("string")).alias("label")).distinct()
    return graph.hub_labels(graph.hubs(members, rows), shown).select("community", "hub", "hub_label")


@query("l08_translations", """
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_type END AS title, CASE WHEN event_id % 5 = 4 THEN NULL ELSE 'about ' || event_type END AS summary,
       CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'fields' WHEN 3 THEN 'text' ELSE 'error' END AS mode
FROM events
""")
def l08(spark, d):
    """Translations in whole JSON, in JSON that broke off, by labelled fields, in plain text, and none."""
    kind, k = F.col("event_type"), F.col("event_id") % 5
    whole = F.format_string('```json\n{"chinese_title": "%s", "chinese_summary": "about %s"}\n```', kind, kind)
    broken = F.format_string('{"chinese_title": "%s", "chinese_summary": "about %s", "entities_preserved": ["a"', kind, kind)
    fields = F.format_string('chinese_title: %s\nchinese_summary: about %s', kind, kind)
    plain = F.format_string("%s\n\nabout %s", kind, kind)
    answer = F.when(k == 0, whole).when(k == 1, broken).when(k == 2, fields).when(k == 3, plain).otherwise("")
    made = contracts.translation(answer)
    return table(spark, d, "events").select("event_id", made["title"].alias("title"), made["summary"].alias("summary"), made["parser_mode"].alias("mode"))


@query("f18_listed_conversations", "SELECT conv_id FROM conversations WHERE conv_id % 2 = 0 AND conv_id % 3 = 1 AND conv_id % 5 <> 2 GROUP BY 1")
def f18_listed(spark, d):
    """The active conversations of a user about an article, and those about others."""
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    stored = ids.withColumns({"status": F.when(F.col("conv_id") % 2 == 0, "active").otherwise("archived"), "user_id": F.col("conv_id") % 3, "article_id": F.col("conv_id") % 5})
    about = [conversation.listed(stored, user=1, article=a) for a in (0, 1, 3, 4)]
    return about[0].union(about[1]).union(about[2]).union(about[3]).select("conv_id")
