"""Queries over model answers, chunks, report sections and the records of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.functions import contracts
from lodewell.functions.chunking import chunk_array_summary_first
from lodewell.operators import feeds, merge, report, retrieval
from lodewell.plans.fixtures import edges, edges_sql
from lodewell.plans.registry import query
from lodewell.sources.tables import dealt, small_batches, table


@query("l10_entity_answers", """
SELECT event_id, event_type AS name, CASE WHEN event_id % 2 = 0 THEN 'ORG' ELSE 'CONCEPT' END AS type FROM events WHERE event_id % 4 <> 3
UNION ALL SELECT event_id, 'Spark', 'CONCEPT' FROM events WHERE event_id % 4 = 0
""")
def l10(spark, d):
    """Answers as models give them: fenced, broken off in their last entity, or not to be read; nameless entities go."""
    k = F.col("event_id")
    kind = F.when(k % 2 == 0, '"ORG"').otherwise("null")
    body = F.concat(F.lit('{"entities": [{"name": " '), F.col("event_type"), F.lit('", "type": '), kind, F.lit('}, {"name": " "}, {"name": "Spark", "description": "an engine"'))
    answer = F.when(k % 4 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("}]}\n```"))).when(k % 4 == 3, "I found nothing").otherwise(body)
    return table(spark, d, "events").select("event_id", F.inline(contracts.entities(answer))).select("event_id", "name", "type")


@query("l11_relation_answers", """
SELECT event_id, event_type AS source, 'Spark' AS target, 'USES' AS relation_type, CASE WHEN event_id % 3 = 0 THEN 2.5 ELSE 1 END::DOUBLE AS weight FROM events WHERE event_id % 3 <> 2
""")
def l11(spark, d):
    k = F.col("event_id")
    weight = F.when(k % 3 == 0, ', "weight": 2.5').otherwise("")
    body = F.concat(F.lit('{"relationships": [{"source": "'), F.col("event_type"), F.lit('", "target": "Spark", "relation_type": "USES"'), weight, F.lit('}, {"source": "", "target": "x"'))
    answer = F.when(k % 3 == 2, "[]").otherwise(body)
    return table(spark, d, "events").select("event_id", F.inline(contracts.relations(answer)))


@query("l12_query_expansion", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || ' news,' || event_type || ' today' ELSE event_type || ',more' END AS queries FROM events
""")
def l12(spark, d):
    kind, more = F.col("event_type"), F.lit(" news")
    listed = F.concat(F.lit('Sure: ["'), kind, more, F.lit('", "", "'), kind, F.lit(' today", "third"] done'))
    lines = F.concat(F.lit("1. "), kind, F.lit("\n\n- more\n* last"))
    answer = F.when(F.col("event_id") % 2 == 0, listed).otherwise(lines)
    return table(spark, d, "events").select("event_id", F.array_join(contracts.string_list(answer, 2), ",").alias("queries"))


@query("t14_report_sections", f"""
WITH {edges_sql()}, e AS (SELECT 'entities' AS section, p_size AS community, '- ' || CASE WHEN p_partkey % 5 = 0 THEN '* ' ELSE '' END || p_name || ' (' || p_brand || '): N/A' AS line,
                  row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 97 DESC, p_partkey) AS n FROM part),
r AS (SELECT 'relationships' AS section, source % 10 AS community, '- ' || source || ' --[SUPPLIES]--> ' || target AS line,
             row_number() OVER (PARTITION BY source % 10 ORDER BY weight DESC, source, target) AS n FROM edges)
SELECT section, community, string_agg(line, chr(10) ORDER BY n) AS text FROM (SELECT * FROM e UNION ALL SELECT * FROM r) WHERE n <= 20 GROUP BY 1, 2
""")
def t14(spark, d):
    # A small file holds many rows: they are dealt before they are ranked.
    part = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.col("p_size").alias("community")), "p_partkey")
    line = report.entity_line(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_partkey") % 5 == 0)
    entities = report.section(part, "community", line, F.desc(F.col("p_partkey") % 97), F.col("p_partkey"), most=report.CAPS["entities"])
    links = edges(spark, d).withColumn("community", F.col("source") % 10)
    line = report.relation_line(F.col("source").cast("string"), F.lit("SUPPLIES"), F.col("target").cast("string"))
    relations = report.section(links, "community", line, F.desc("weight"), F.col("source"), F.col("target"), most=report.CAPS["relationships"])
    named = lambda df, name: df.select(F.lit(name).alias("section"), F.col("community").cast("long").alias("community"), "text")
    return named(entities, "entities").union(named(relations, "relationships"))


@query("d09_section_merge", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ' and ' || lang ELSE source || chr(10) || chr(10) || lang || '!' END AS merged FROM documents
""")
def d09(spark, d):
    k = F.col("doc_id") % 3
    summary = F.when(k == 0, F.concat("source", F.lit(" and "), "lang", F.lit("\n"))).otherwise(F.concat(F.lit("  "), F.col("source")))
    sections = F.when(k == 0, F.array(F.col("lang"), F.lit(" "), F.lit("and"))).otherwise(F.array(F.col("source"), F.concat(F.lit("\n"), F.col("lang"), F.lit("!")), F.col("lang")))
    return table(spark, d, "documents").select("doc_id", report.merged_sections(summary, sections).alias("merged"))


@query("v03_similar_chunks", """
WITH s AS (SELECT vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings),
     b AS (SELECT * FROM s WHERE s >= 0.15 ORDER BY s DESC, chunk_id LIMIT 10)
SELECT chunk_id, source AS title, round(s, 6) AS similarity FROM b LEFT JOIN documents ON doc_id = chunk_id // 2
""")
def v03(spark, d):
    """Chunks by vector, two of them an article."""
    vectors = table(spark, d, "embeddings")
    query = vectors.where("vec_id = 0").select("embedding").first()
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 2).alias("article_id"), "embedding")
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("title"))
    found = retrieval.similar_chunks(chunks, titles, query[0] if query else [0.0], threshold=0.15)
    return found.select("chunk_id", "title", F.round("similarity", 6).alias("similarity"))


@query("c02_summary_first_chunks")
def c02(spark, d):
    """Chunks of each document behind a summary, its source."""
    return small_batches(table(spark, d, "documents").select("doc_id", "text", "source")).select("doc_id", F.inline(chunk_array_summary_first("text", "source")))


@query("s14_delete_result", "SELECT count(*) FILTER (vec_id = 3) > 0 AS deleted FROM embeddings")
def s14(spark, d):
    return merge.removed(table(spark, d, "embeddings"), spark.createDataFrame([(3,), (-1,)], "vec_id long"), ["vec_id"])


@query("s17_append_communities", """
SELECT 1 AS run, label AS community, count(*) AS members FROM embeddings GROUP BY label UNION ALL SELECT 2, label, count(*) FROM embeddings WHERE vec_id % 2 = 0 GROUP BY label
""")
def s17(spark, d):
    """Communities of two runs side by side, not merged."""
    rows = table(spark, d, "embeddings")
    run = lambda df, n: df.groupBy(F.col("label").alias("community")).agg(F.count("*").alias("members")).withColumn("run", F.lit(n))
    return merge.append(run(rows, 1), run(rows.where("vec_id % 2 = 0"), 2))


@query("s25_feed_changes", """
SELECT 'https://' || source || '/rss' AS url, source AS name, true AS is_active, false AS refused FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
WHERE source NOT IN ('src1', 'src2')
UNION ALL SELECT 'https://src2/rss', 'src2', false, false WHERE EXISTS (FROM documents WHERE source = 'src2')
UNION ALL SELECT 'https://new/rss', 'new', true, false
UNION ALL SELECT 'https://src3/rss', 'again', true, true WHERE EXISTS (FROM documents WHERE source = 'src3')
""")
def s25_changes(spark, d):
    """Feeds created, a known url refused, one deleted and one switched off."""
    names = table(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("name")).distinct()
    stored = names.select(F.concat(F.lit("https://"), "name", F.lit("/rss")).alias("url"), "name", F.lit(True).alias("is_active"))
    asked = spark.createDataFrame([("https://new/rss", "new", True), ("https://new/rss", "newer", True), ("https://src3/rss", "again", True)], "url string, name string, is_active boolean")
    url = lambda name: spark.createDataFrame([(f"https://{name}/rss",)], "url string")
    now = feeds.toggled(merge.remove(feeds.created(stored, asked), url("src1"), ["url"]), url("src2"))
    shown = feeds.listed(now, active_only=False).withColumn("refused", F.lit(False))
    return shown.unionByName(feeds.rejected(stored, asked).withColumn("refused", F.lit(True)))
