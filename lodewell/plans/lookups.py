"""Queries over stored tables: lookups, statuses, replacements and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.functions import contracts
from lodewell.functions import text as T
from lodewell.functions.chunking import chunk_array
from lodewell.operators import feeds, graph, ingest, listing, matching, memory, merge, report, retrieval
from lodewell.operators.providers import Offline, complete
from lodewell.plans.fixtures import MENTIONS, edges, edges_sql, mentions
from lodewell.plans.registry import query
from lodewell.sources.tables import small_batches, table


@query("f10_point_lookup", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 7")
def f10(spark, d):
    return table(spark, d, "documents").where("doc_id = 7").select("doc_id", "source", "n_chars")


@query("f18_conversation_filter", "SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE conv_id % 4 = 1 AND role = 'user' GROUP BY 1 HAVING max(turn) >= 2")
def f18(spark, d):
    rows = table(spark, d, "conversations").where("conv_id % 4 = 1 AND role = 'user'")
    return rows.groupBy("conv_id").agg(F.max("turn").alias("last_turn")).where("last_turn >= 2")


@query("f20_run_history", "SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR ORDER BY ts DESC, event_id LIMIT 20")
def f20(spark, d):
    events = table(spark, d, "events")
    since = F.lit(events.agg(F.max("ts")).first()[0]) - F.make_interval(hours=F.lit(48))
    return listing.newest(events, 20, when="ts", key="event_id", since=since).select("event_id", "event_type")


@query("f23_valid_entities", "SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#11'), 'CONCEPT') AS type FROM part WHERE p_partkey % 5 <> 0")
def f23(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("name"), F.nullif("p_brand", F.lit("Brand#11")).alias("type"))
    return rows.where(T.first_text(F.col("name")).isNotNull()).select("p_partkey", F.coalesce("type", F.lit("CONCEPT")).alias("type"))


@query("f25_report_status", "SELECT doc_id, quality IS NOT NULL AS has_report FROM documents LEFT JOIN labels USING (doc_id)")
def f25(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return report.status(joined, key="doc_id", report="quality", when="toxic").select("doc_id", "has_report")


@query("j11_community_members", """
SELECT vec_id, label IN (SELECT label FROM embeddings WHERE vec_id < 3) AS same FROM embeddings WHERE vec_id >= 3
""")
def j11(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    members = rows.select(F.col("label").alias("community"), F.col("vec_id").alias("id"))
    found = graph.community_overlap(members.where("id >= 3").select("id"), members, members.where("id < 3"))
    return found.select(F.col("id").alias("vec_id"), (F.col("overlap") == 1).alias("same"))


@query("a02_filtered_counts", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def a02(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 100000").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("a09_community_articles", """
SELECT p_size AS community, count(DISTINCT l_orderkey) AS articles, min(l_orderkey) AS first FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def a09(spark, d):
    members = table(spark, d, "part").select(F.col("p_size").alias("community"), F.col("p_partkey").alias("id"))
    pairs = graph.community_articles(members, table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("article_id")))
    return pairs.groupBy("community").agg(F.count("*").alias("articles"), F.min("article_id").alias("first"))


@query("a12_mean_weight", f"""
WITH {edges_sql()}, b AS (SELECT source AS node, weight FROM edges UNION ALL SELECT target, weight FROM edges)
SELECT node, round(avg(CASE WHEN coalesce(weight, 0) = 0 THEN 1 ELSE weight END), 6) AS mean FROM b GROUP BY 1
""")
def a12(spark, d):
    return graph.both_ways(edges(spark, d)).groupBy("node").agg(F.round(F.avg("weight"), 6).alias("mean"))


@query("a13_visual_statistics", f"""
WITH {edges_sql()} SELECT count(*) AS total, count(*) FILTER (source <= 5) AS seed, count(*) FILTER (source > 5) AS expanded FROM edges
""")
def a13(spark, d):
    seed = F.col("source") <= 5
    return edges(spark, d).agg(F.count("*").alias("total"), F.count_if(seed).alias("seed"), F.count_if(~seed).alias("expanded"))


@query("a17_distinct_sources", "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY 1")
def a17(spark, d):
    return retrieval.distinct_sources(table(spark, d, "documents"), "lang").select("lang", F.array_join("sources", ",").alias("sources"))


@query("a18_mean_length", "SELECT source, (sum(length(text)) // count(*))::BIGINT AS mean_length FROM documents GROUP BY 1")
def a18(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(T.mean_length(F.col("text")).alias("mean_length"))


@query("a19_backfill_tallies", """
SELECT CASE WHEN text IS NULL OR text = '' THEN 'error' WHEN length(trim(text, ' \t\n\r')) < 100 THEN 'skipped' ELSE 'success' END AS status, count(*) AS n FROM documents GROUP BY 1
""")
def a19(spark, d):
    return table(spark, d, "documents").groupBy(ingest.backfill_status(F.col("text")).alias("status")).agg(F.count("*").alias("n"))


@query("w04_item_numbers", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS item FROM conversations WHERE role = 'user'")
def w04(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn")
    return listing.numbered(rows, "conv_id", "turn")


@query("t11_newest_by_level", "SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id LIMIT 15")
def t11(spark, d):
    events = table(spark, d, "events")
    kind = events.agg(F.min("event_type")).first()[0]
    return listing.newest(events, 15, when="ts", key="event_id", event_type=kind).select("event_id")


@query("d05_semantic_dedup", """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)
SELECT id FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.id < v.id AND v.id % 2 = 1 AND o.id % 2 = 0 AND list_cosine_similarity(o.x, v.x) >= 0.85)
   AND NOT EXISTS (SELECT 1 FROM v o WHERE o.id > v.id AND v.id % 2 = 1 AND o.id % 2 = 0 AND list_cosine_similarity(o.x, v.x) >= 0.85)
""")
def d05(spark, d):
    """New (odd) rows go where a stored (even) one is at least 0.85 similar."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    known = matching.best_matches(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"), threshold=0.85)
    return rows.join(known, "id", "left_anti").select("id")


@query("d08_unvisited", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey <= 3)")
def d08(spark, d):
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    return line.select("l_partkey").distinct().join(line.where("l_suppkey <= 3"), "l_partkey", "left_anti")


@query("d10_query_union", "SELECT doc_id, source || '|' || lang AS queries FROM documents")
def d10(spark, d):
    union = contracts.expanded_queries(F.col("source"), F.array("source", "lang", F.lit("more")), 2)
    return table(spark, d, "documents").select("doc_id", F.array_join(union, "|").alias("queries"))


@query("v14_chunks_in_order", "SELECT l_orderkey AS article, l_linenumber AS chunk, l_comment FROM (SELECT *, l_returnflag AS l_comment FROM lineitem) WHERE l_orderkey = 3 ORDER BY chunk")
def v14(spark, d):
    rows = retrieval.article_chunks(table(spark, d, "lineitem"), 3, key="l_orderkey", order="l_linenumber")
    return rows.select(F.col("l_orderkey").alias("article"), F.col("l_linenumber").alias("chunk"), F.col("l_returnflag").alias("l_comment"))


@query("v15_offline_embedding")
def v15(spark, d):
    return small_batches(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", retrieval.embed_text("text").alias("embedding"))


@query("c12_token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def c12(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("c14_citations_from_results", """
SELECT event_id, 'http://' || event_type || '/' || n AS url FROM events, (SELECT unnest([1, 2, 3]) AS n)
""")
def c14(spark, d):
    results = [F.concat(F.lit('{"url": "http://'), F.col("event_type"), F.lit(f'/{n}"}}')) for n in (1, 2, 3, 4)]
    body = F.concat(F.lit("["), F.concat_ws(",", *results), F.lit("]"))
    rows = table(spark, d, "events")
    found = F.slice(F.filter(F.from_json(body, "array<struct<url:string>>"), lambda x: x["url"].isNotNull()), 1, 3)
    return rows.select("event_id", F.inline(found))


@query("c15_confidence", """
SELECT doc_id, CASE WHEN contains(lower(text), 'unsure') OR doc_id % 3 = 0 THEN 'low' WHEN doc_id % 3 = 1 THEN 'high' ELSE 'medium' END AS confidence FROM documents
""")
def c15(spark, d):
    said = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, " Unsure, verified").when(F.col("doc_id") % 3 == 1, " VERIFIED.").otherwise(""))
    return table(spark, d, "documents").select("doc_id", contracts.confidence(said, ["verified."], ["unsure"]).alias("confidence"))


@query("c18_score_bands", "SELECT o_orderkey, CASE WHEN o_totalprice / 50000 >= 8 THEN 'high' WHEN o_totalprice / 50000 >= 6 THEN 'medium' ELSE 'low' END AS band FROM orders")
def c18(spark, d):
    return table(spark, d, "orders").select("o_orderkey", graph.relevance_band(F.col("o_totalprice") / 50000).alias("band"))


@query("l02_offline_scores")
def l02(spark, d):
    """Articles scored by the offline provider, as a live one would: answers parsed, failures kept apart."""
    rows = table(spark, d, "documents").select("doc_id", contracts.prompt("Score this: {text}", text=F.col("text")).alias("prompt"))
    answered = complete(rows, "prompt", Offline)
    score = F.from_json(T.json_in_text(F.col("answer")), "industry_impact_score double, milestone_score double, attention_score double")
    total = T.weighted_score(score["industry_impact_score"], score["milestone_score"], score["attention_score"])
    return answered.select("doc_id", total.alias("total_score"), "error")


@query("l09_reflections", "SELECT event_id, event_id % 2 = 0 AS passed, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS issues FROM events")
def l09(spark, d):
    answer = F.when(F.col("event_id") % 2 == 0, "nothing to read").otherwise('```json\n{"passed": false, "issues": ["tone"]\n```')
    r = contracts.reflection(answer)
    return table(spark, d, "events").select("event_id", r["passed"].alias("passed"), F.size(r["issues"]).alias("issues"))


@query("l17_decisions", """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 1 THEN 'dance' ELSE 'search' END AS action,
       CASE WHEN event_id % 3 = 2 THEN 'no action' WHEN event_id % 3 = 1 THEN 'unknown action dance' END AS error FROM events
""")
def l17(spark, d):
    k = F.col("event_id") % 3
    answer = F.when(k == 0, '{"thought": "look", "action": "search", "action_input": {"q": "x"').when(k == 1, '{"action": "dance"}').otherwise("I do not know")
    r = contracts.decision(answer, ["search", "finish"])
    return table(spark, d, "events").select("event_id", r["action"].alias("action"), r["error"].alias("error"))


@query("g01_entity_resolution", """
WITH p AS (SELECT a.vec_id AS id, b.vec_id AS match, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
           FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 1 AND b.vec_id % 2 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, match) AS n FROM p WHERE s >= 0.85)
SELECT vec_id AS id, CASE WHEN r.id IS NULL THEN 'entity ' || vec_id ELSE 'stored ' || match END AS canonical_name
FROM embeddings LEFT JOIN r ON r.id = vec_id AND n = 1 WHERE vec_id % 2 = 1
""")
def g01(spark, d):
    """New (odd) entities take the canonical name of the nearest stored (even) one from 0.85 on, others keep their own."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    named = lambda odd, kind, name: rows.where(F.col("id") % 2 == odd).withColumn(name, F.concat(F.lit(kind), F.col("id").cast("string")))
    return graph.resolve_entities(named(1, "entity ", "name"), named(0, "stored ", "canonical_name")).select("id", "canonical_name")


@query("g08_detection_scope", f"""
WITH {edges_sql()}, s AS (SELECT source AS id FROM edges WHERE source <= 3 UNION SELECT target FROM edges WHERE source <= 3)
SELECT source, target FROM edges WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)
""")
def g08(spark, d):
    rows = edges(spark, d).select("source", "target")
    seeds = rows.where("source <= 3").select(F.col("source").alias("id")).distinct()
    touched = graph.incident(rows, seeds)
    scope = touched.select(F.col("source").alias("id")).union(touched.select("target")).distinct()
    for end in ("source", "target"):
        rows = rows.join(scope.select(F.col("id").alias(end)), end, "left_semi")
    return rows.select("source", "target")


@query("h11_history_tool", """
SELECT conv_id, turn, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS content
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10
""")
def h11(spark, d):
    return listing.latest(table(spark, d, "conversations"), 10, "conv_id", "turn").select("conv_id", "turn", T.shorten(F.col("text"), 500).alias("content"))


@query("s12_replace_embeddings", """
SELECT vec_id, 'summary' AS embedding_type, CASE WHEN vec_id % 10 = 0 THEN 2 ELSE 1 END AS version FROM embeddings UNION ALL SELECT vec_id, 'chunk', 1 FROM embeddings
""")
def s12(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id")
    kind = lambda df, name, version: df.select("vec_id", F.lit(name).alias("embedding_type"), F.lit(version).alias("version"))
    stored = kind(rows, "summary", 1).union(kind(rows, "chunk", 1))
    return merge.upsert(stored, kind(rows.where("vec_id % 10 = 0"), "summary", 2), ["vec_id", "embedding_type"])


@query("s24_memory_load", "SELECT conv_id, count(DISTINCT role) AS types, arg_max(text, turn) FILTER (role = 'user') AS user_memory FROM conversations GROUP BY 1")
def s24(spark, d):
    last = table(spark, d, "conversations").groupBy("conv_id", F.col("role").alias("memory_type")).agg(F.max_by("text", "turn").alias("content"))
    memories = memory.loaded(last)
    return memories.select("conv_id", F.size("memories").cast("long").alias("types"), F.try_element_at("memories", F.lit("user")).alias("user_memory"))


@query("s25_active_feeds", "SELECT source, count(*) AS entries FROM documents WHERE source <> 'src3' GROUP BY 1 ORDER BY 1")
def s25(spark, d):
    found = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("entries"))
    stored = found.select("source", "entries", F.col("source").alias("name"), F.col("source").alias("url"), (F.col("source") != "src3").alias("is_active"))
    return feeds.listed(stored).select("source", "entries")


@query("s29_json_rows", "SELECT r_regionkey, to_json({r_regionkey: r_regionkey, r_name: r_name})::VARCHAR AS line FROM region")
def s29(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("line"))


@query("s31_chunk_backfill")
def s31(spark, d):
    """Chunks with hashes of all documents that have text and no embedding, as one set-based job."""
    docs = table(spark, d, "documents").where(F.length(T.strip(F.col("text"))) > 100)
    missing = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    chunks = small_batches(missing.select("doc_id", "text")).select("doc_id", F.sha2("text", 256).alias("hash"), F.inline(chunk_array("text")))
    return chunks.select("doc_id", "chunk_number", "chunk_start", "chunk_end", T.chunk_hash(F.col("hash"), F.col("chunk_number")).alias("content_hash"))
