"""The registry of the library's own queries, each with the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodewell.functions import text as T
from lodewell.functions.chunking import chunk_array
from lodewell.functions.html import extract_content
from lodewell.functions.json_repair import parsed
from lodewell.functions.vectors import cosine
from lodewell.operators import conversation, graph, ingest, listing, matching, merge, modularity, retrieval
from lodewell.plans import answers, knowledge, lookups, loops, rules, stored
from lodewell.plans.fixtures import ARTICLES, MENTIONS, articles, edges, edges_sql, mentions, text_index, vector_index
from lodewell.plans.registry import ORACLE_SQL, QUERIES, query
from lodewell.sources.tables import materialize, small_batches, table

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "answers", "knowledge", "lookups", "loops", "rules", "stored"]

FLAGSHIP = "v06_hybrid_search"

TERMS = ["en", "ea"]  # of the text queries


def _vector(spark: SparkSession, d: str, key: int = 0) -> list[float]:
    """The query vector: the row with this key."""
    row = table(spark, d, "embeddings").where(F.col("vec_id") == key).select("embedding").first()
    return list(row[0]) if row else [0.0]


# Filters and projections


@query("f01_recency", """
WITH a AS (SELECT max(ts) AS anchor FROM events)
SELECT event_id, event_type FROM events, a WHERE ts IS NULL OR ts >= anchor - INTERVAL 24 HOUR
""")
def f01(spark, d):
    events = table(spark, d, "events")
    anchor = F.lit(events.agg(F.max("ts")).first()[0])
    return ingest.recent(events, anchor, 24, when="ts").select("event_id", "event_type")


@query("f02_score_threshold", f"WITH {ARTICLES} SELECT id, total_score FROM articles WHERE coalesce(total_score, 0) >= 6")
def f02(spark, d):
    return ingest.above(articles(spark, d), 6.0).select("id", "total_score")


@query("f03_threshold_below_default", f"WITH {ARTICLES} SELECT id, total_score FROM articles WHERE total_score >= 5")
def f03(spark, d):
    return ingest.above(articles(spark, d), 3.0).select("id", "total_score")


@query("f04_content_split", """
SELECT CASE WHEN length(trim(text, ' \t\n\r')) > 100 THEN 'chunk' ELSE 'skip' END AS status, count(*) AS n FROM documents GROUP BY 1
""")
def f04(spark, d):
    ok, short = ingest.split_by(table(spark, d, "documents"), F.when(~(F.length(T.strip(F.col("text"))) > 100), F.lit("short")))
    return ok.select(F.lit("chunk").alias("status")).union(short.select(F.lit("skip"))).groupBy("status").agg(F.count("*").alias("n"))


@query("f06_article_page", f"""
WITH {ARTICLES}, f AS (SELECT * FROM articles WHERE total_score >= 3)
SELECT id, source_name, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, (SELECT count(*) FROM f) AS total,
       ((SELECT count(*) FROM f) + 19) // 20 AS pages
FROM f ORDER BY f.published_at DESC NULLS FIRST, id LIMIT 20 OFFSET 20
""")
def f06(spark, d):
    rows = articles(spark, d).where("total_score >= 3")
    rows = rows.select("id", "source_name", "published_at")
    out = listing.page(rows, 2, 20, F.desc_nulls_first("published_at"), F.col("id"))
    return out.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query("f07_source_ilike", "SELECT doc_id, source FROM documents WHERE source ILIKE '%SRC1%'")
def f07(spark, d):
    return table(spark, d, "documents").where(F.col("source").ilike("%SRC1%")).select("doc_id", "source")


@query("f09_entity_lookup", """
SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' AND upper(p_brand) = upper('brand#13') ORDER BY p_name, p_partkey LIMIT 5
""")
def f09(spark, d):
    part = table(spark, d, "part").where(F.col("p_name").ilike("%re%") & (F.upper("p_brand") == F.upper(F.lit("brand#13"))))
    return part.orderBy("p_name", "p_partkey").limit(5).select("p_partkey", "p_name")


@query("f12_in_and_not_in", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 3) AND vec_id NOT IN (1, 2, 3)")
def f12(spark, d):
    return table(spark, d, "embeddings").where(F.col("label").isin(1, 3) & ~F.col("vec_id").isin(1, 2, 3)).select("vec_id", "label")


@query("f14_array_overlap", """
SELECT l_suppkey AS entity FROM lineitem WHERE l_orderkey <= 200 GROUP BY 1
""")
def f14(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), "l_orderkey")
    wanted = table(spark, d, "orders").where("o_orderkey <= 200").select("o_orderkey")
    return listing.touching(pairs, wanted, "l_orderkey", ["entity"])


@query("f15_edge_incidence", f"""
WITH {edges_sql()} SELECT * FROM edges WHERE source IN (1, 2, 3) OR target IN (1000001, 1000002)
""")
def f15(spark, d):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (1000001,), (1000002,)], "id long")
    return graph.incident(edges(spark, d), nodes).select("source", "target", "weight")


@query("f21_first_text", """
SELECT event_id, coalesce(nullif(CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN event_type END, ''), props) AS shown FROM events
""")
def f21(spark, d):
    local = F.when(F.col("user_id") % 3 == 0, F.lit("")).when(F.col("user_id") % 3 == 1, F.col("event_type"))
    return table(spark, d, "events").select("event_id", T.first_text(local, F.col("props")).alias("shown"))


@query("f24_tool_expiry", """
SELECT conv_id, turn FROM conversations
WHERE NOT (role = 'system' AND (turn % 4 = 3 OR turn * 5 < (SELECT max(turn) FROM conversations) * 5 - 30))
""")
def f24(spark, d):
    rows = table(spark, d, "conversations")
    last = rows.agg(F.max("turn")).first()[0] or 0
    at = lambda t: F.timestamp_seconds(F.lit(1704067200) + t * 300)
    rows = rows.withColumn("role", F.when(F.col("role") == "system", "tool").otherwise(F.col("role")))
    rows = rows.withColumn("created_at", F.when(F.col("turn") % 4 != 3, at(F.col("turn")).cast("string")))
    return conversation.live_messages(rows, at(F.lit(last))).select("conv_id", "turn")


@query("f26_tool_projection", """
SELECT doc_id, CASE WHEN length(text) > 2000 THEN text[1:2000] || '...' ELSE text END AS content FROM documents
""")
def f26(spark, d):
    return table(spark, d, "documents").select("doc_id", T.shorten(F.col("text"), 2000).alias("content"))


# Joins


@query("j02_chunks_with_articles", """
SELECT vec_id, source, label FROM embeddings JOIN documents ON doc_id = vec_id
""")
def j02(spark, d):
    return table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("doc_id") == F.col("vec_id")).select("vec_id", "source", "label")


@query("j05_backfill_candidates", """
SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings)
""")
def j05(spark, d):
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").where("text IS NOT NULL AND text <> ''").join(stored, "doc_id", "left_anti").select("doc_id")


@query("j07_known_hash", "SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def j07(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.join(rows.where("doc_id % 2 = 0").select("h"), "h", "left_semi").select("doc_id")


@query("j08_name_resolution", """
WITH e AS (SELECT p_partkey AS id, p_name AS name FROM part),
     x AS (SELECT name, min(id) AS id FROM e GROUP BY 1), l AS (SELECT lower(name) AS name, min(id) AS id FROM e GROUP BY 1),
     r AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN upper(a.p_name) ELSE a.p_name END AS s, b.p_name || CASE WHEN l_linenumber = 2 THEN '?' ELSE '' END AS t
           FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON b.p_partkey = l_suppkey)
SELECT k, n, coalesce(x1.id, l1.id) AS source, coalesce(x2.id, l2.id) AS target
FROM r LEFT JOIN x x1 ON s = x1.name LEFT JOIN l l1 ON lower(s) = l1.name LEFT JOIN x x2 ON t = x2.name LEFT JOIN l l2 ON lower(t) = l2.name
WHERE coalesce(x1.id, l1.id) IS NOT NULL AND coalesce(x2.id, l2.id) IS NOT NULL
""")
def j08(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    line = table(spark, d, "lineitem")
    rows = line.join(part.toDF("a", "source_name"), F.col("l_partkey") == F.col("a")).join(part.toDF("b", "target_name"), F.col("l_suppkey") == F.col("b"))
    rows = rows.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        F.when(F.col("l_linenumber") == 1, F.upper("source_name")).otherwise(F.col("source_name")).alias("source_name"),
        F.when(F.col("l_linenumber") == 2, F.concat("target_name", F.lit("?"))).otherwise(F.col("target_name")).alias("target_name"),
    )
    return graph.resolve_names(rows, part).select("k", "n", "source", "target")


@query("j08_alias_names", """
SELECT l_orderkey AS k, l_linenumber AS n, s.id AS source, t.id AS target, mode
FROM lineitem, (VALUES ('strict'), ('alias aware')) m(mode), LATERAL (
    SELECT CASE WHEN l_linenumber = 1 THEN 'alias of ' || l_partkey ELSE 'part ' || l_partkey END AS a, 'part ' || l_suppkey AS b
) x JOIN (
    SELECT 'part ' || p_partkey AS name, p_partkey AS id, 'strict' AS of FROM part
    UNION ALL SELECT 'part ' || p_partkey, p_partkey - CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END, 'alias aware' FROM part
    UNION ALL SELECT 'alias of ' || p_partkey, p_partkey, 'alias aware' FROM part WHERE p_partkey % 4 = 1
) s ON s.name = a AND s.of = mode JOIN (
    SELECT 'part ' || p_partkey AS name, p_partkey AS id, 'strict' AS of FROM part
    UNION ALL SELECT 'part ' || p_partkey, p_partkey - CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END, 'alias aware' FROM part
) t ON t.name = b AND t.of = mode
""")
def j08_alias(spark, d):
    """Two parts of every four share an alias: strictly, edges that name it are dropped; alias-aware, they end at the first."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    entities = part.select("id", F.concat(F.lit("Part "), "id").alias("name"))
    shared = F.col("id") - F.when(F.col("id") % 4 == 2, 1).otherwise(0)
    aliases = part.where("id % 4 IN (1, 2)").select("id", F.concat(F.lit("Alias of "), shared).alias("alias"))
    line = table(spark, d, "lineitem")
    said = F.when(F.col("l_linenumber") == 1, "ALIAS OF ").otherwise("part ")
    named = line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.concat(said, "l_partkey").alias("source_name"), F.concat(F.lit("Part "), "l_suppkey").alias("target_name"))
    mode = lambda found, name: found.select("k", "n", "source", "target", F.lit(name).alias("mode"))
    return mode(graph.resolve_names(named, entities), "strict").union(mode(graph.resolve_names(named, entities, aliases=aliases), "alias aware"))


@query("j10_mean_incident_weight", f"""
WITH {edges_sql()}, b AS (SELECT source AS node, target AS other, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)
SELECT node AS id, round(avg(weight), 6) AS avg_weight FROM b WHERE other IN (1, 2, 3) AND node NOT IN (1, 2, 3) GROUP BY 1
""")
def j10(spark, d):
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    return graph.neighbours(edges(spark, d), seeds).select("id", F.round("avg_weight", 6).alias("avg_weight"))


@query("j13_conversation_article", """
SELECT conv_id, turn, source FROM conversations LEFT JOIN documents ON doc_id = conv_id * 3 WHERE turn = 0
""")
def j13(spark, d):
    first = table(spark, d, "conversations").where("turn = 0")
    return first.join(table(spark, d, "documents"), F.col("doc_id") == F.col("conv_id") * 3, "left").select("conv_id", "turn", "source")


@query("j14_entity_best_match", """
WITH p AS (SELECT a.vec_id AS id, b.vec_id AS match, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
           FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 1 AND b.vec_id % 2 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, match) AS n FROM p WHERE s >= 0.3)
SELECT id, match, round(s, 6) AS similarity FROM r WHERE n = 1
""")
def j14(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = matching.best_matches(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"), threshold=0.3)
    return found.select("id", "match", F.round("similarity", 6).alias("similarity"))


@query("j15_entities_by_article", f"""
WITH {MENTIONS} SELECT article_id, count(DISTINCT name) AS n, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM mentions GROUP BY 1
""")
def j15(spark, d):
    rows = mentions(spark, d).select("article_id", "name").distinct().groupBy("article_id")
    return rows.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"))


# Aggregations and merges


@query("a03_graph_statistics", f"""
WITH {edges_sql()} SELECT (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM edges) AS relationships,
       (SELECT count(DISTINCT label) FROM embeddings) AS communities
""")
def a03(spark, d):
    counts = [
        table(spark, d, "part").agg(F.count("*").alias("entities")),
        edges(spark, d).agg(F.count("*").alias("relationships")),
        table(spark, d, "embeddings").agg(F.countDistinct("label").alias("communities")),
    ]
    return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))  # one row each


_GROUPED = """
g AS (
    SELECT lower(name) AS key, arg_min(name, ordinal) AS name, arg_min(type, ordinal) AS type, count(*) AS mention_count,
           count(DISTINCT article_id) AS articles, count(DISTINCT name) - 1 AS aliases
    FROM mentions GROUP BY 1
)
"""


@query("a04_entity_grouping", f"WITH {MENTIONS}, {_GROUPED} SELECT * FROM g")
def a04(spark, d):
    return graph.count_entities(mentions(spark, d))


@query("a05_entity_upsert", f"""
WITH {MENTIONS}, u AS (
    SELECT lower(name) AS canonical_name, name, type, article_id, CASE WHEN article_id % 2 = 0 THEN -1 ELSE ordinal END AS o FROM mentions
)
SELECT canonical_name, count(*) AS mention_count, count(DISTINCT article_id) AS articles,
       arg_max(article_id % 7, o) FILTER (article_id % 2 = 1) AS description
FROM u GROUP BY 1
""")
def a05(spark, d):
    rows = mentions(spark, d).withColumn("canonical_name", F.lower("name"))
    side = lambda odd, last: (
        rows.where(F.col("article_id") % 2 == odd)
        .groupBy("canonical_name")
        .agg(
            F.min_by("name", "ordinal").alias("name"), F.min_by("type", "ordinal").alias("type"),
            F.max_by((F.col("article_id") % 7).cast("string"), "ordinal").alias("description") if odd else F.lit("").alias("description"),
            F.collect_set("article_id").alias("article_ids"), F.collect_set("name").alias("aliases"), F.count("*").alias("mention_count"), *last,
        )
    )
    merged = merge.merge_entities(side(0, []), side(1, [F.max("ordinal").alias("ordinal")]))
    return merged.select("canonical_name", "mention_count", F.size("article_ids").cast("long").alias("articles"), F.col("description").cast("long").alias("description"))


@query("a06_relationship_upsert", """
SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS relation_type, count(*)::DOUBLE AS weight,
       string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR) AS article_ids
FROM lineitem GROUP BY 1, 2, 3
""")
def a06(spark, d):
    line = table(spark, d, "lineitem")
    rows = line.select(
        F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("relation_type"), F.lit(1.0).alias("weight"),
        F.lit(None).cast("string").alias("description"), F.array(F.col("l_orderkey").cast("string")).alias("article_ids"), F.col("l_orderkey").alias("ordinal"),
    )
    merged = merge.merge_relationships(rows.where("ordinal % 2 = 0").drop("ordinal"), rows.where("ordinal % 2 = 1"))
    return merged.select("source", "target", "relation_type", "weight", F.array_join("article_ids", ",").alias("article_ids"))


@query("a07_distinct_entities", f"WITH {MENTIONS} SELECT article_id % 10 AS run, count(DISTINCT name) AS n FROM mentions GROUP BY 1")
def a07(spark, d):
    return mentions(spark, d).groupBy((F.col("article_id") % 10).alias("run")).agg(F.countDistinct("name").alias("n"))


@query("a08_community_profile", """
WITH m AS (SELECT p_partkey AS id, p_size AS community, p_brand AS type, p_name || ' ' || p_partkey AS name, p_partkey % 97 AS mention_count FROM part),
     c AS (SELECT community, type, count(*) AS c FROM m GROUP BY 1, 2),
     t AS (SELECT community, sum(c)::BIGINT AS n, string_agg(type || ':' || c, ', ' ORDER BY c DESC, type || ':' || c) AS types FROM c GROUP BY 1),
     r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY mention_count DESC, name) AS r FROM m)
SELECT community, n, types, (SELECT string_agg(name, ', ' ORDER BY r) FROM r WHERE r.community = t.community AND r <= 3) AS top_names FROM t
""")
def a08(spark, d):
    part = table(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("community"), F.col("p_brand").alias("type"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") % 97).alias("mention_count"))
    return graph.profiles(rows.select("id", "community"), rows.drop("community"))


@query("a10_hubs", f"""
WITH {edges_sql()}, b AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges), g AS (SELECT id, count(*) AS degree FROM b GROUP BY 1),
     r AS (SELECT id % 10 AS community, id, degree, row_number() OVER (PARTITION BY id % 10 ORDER BY degree DESC, id) AS n FROM g)
SELECT community, id AS hub, degree FROM r WHERE n = 1
""")
def a10(spark, d):
    rows = edges(spark, d)
    members = graph.degrees(rows).select("id", (F.col("id") % 10).alias("community"))
    return graph.hubs(members, rows)


@query("a11_mean_vector", """
SELECT i - 1 AS position, round(avg(embedding[i]::DOUBLE), 6) AS mean
FROM (SELECT embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings WHERE vec_id < 20) GROUP BY 1
""")
def a11(spark, d):
    rows = table(spark, d, "embeddings").where("vec_id < 20").select(F.posexplode("embedding").alias("position", "x"))
    return rows.groupBy(F.col("position").cast("long").alias("position")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("a14_ingest_funnel", f"""
WITH {ARTICLES} SELECT 0 AS step, 'found' AS stage, count(*) AS n FROM articles
UNION ALL SELECT 1, 'distinct', count(DISTINCT full_content) FROM articles
UNION ALL SELECT 2, 'scored', count(*) FROM articles WHERE total_score >= 5
""")
def a14(spark, d):
    rows = articles(spark, d)
    return ingest.funnel([("found", rows), ("distinct", rows.groupBy(F.sha2("full_content", 256)).count()), ("scored", ingest.above(rows))])


@query("a15_run_status", """
SELECT source, CASE WHEN count(*) FILTER (length(text) < 50) = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status,
       count(*) FILTER (length(text) < 50) AS errors FROM documents GROUP BY 1
""")
def a15(spark, d):
    errors = F.count_if(F.length("text") < 50)
    return table(spark, d, "documents").groupBy("source").agg(ingest.run_status(errors).alias("status"), errors.alias("errors"))


@query("a16_tokens_by_conversation", "SELECT conv_id, sum(length(text) // 4)::BIGINT AS tokens FROM conversations GROUP BY 1")
def a16(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


# Windows, pages and limits


@query("w03_running_tokens", """
SELECT conv_id, turn, coalesce(sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
FROM conversations
""")
def w03(spark, d):
    return conversation.compact(table(spark, d, "conversations"), 1000).select("conv_id", "turn", "before")


@query("w05_first_seen", """
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1
""")
def w05(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))  # combines map-side
    return first.select("doc_id", "source")


@query("t08_latest_messages", """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3
""")
def t08(spark, d):
    return listing.latest(table(spark, d, "conversations"), 3, "conv_id", "turn").select("conv_id", "turn", "role")


@query("t09_keyset_page", """
WITH c AS (SELECT ts AS t, event_id AS e FROM events WHERE event_id = 500),
     p AS (SELECT event_id, ts FROM events, c WHERE ts < t OR (ts = t AND event_id < e) ORDER BY ts DESC, event_id DESC LIMIT 26)
SELECT event_id, (SELECT count(*) FROM p) > 25 AS has_more FROM (SELECT * FROM p ORDER BY ts DESC, event_id DESC LIMIT 25)
""")
def t09(spark, d):
    events = table(spark, d, "events")
    at = events.where("event_id = 500").select("ts", "event_id").first()
    return listing.after(events, 25, tuple(at) if at else None, "ts", "event_id").select("event_id", "has_more")


@query("t10_latest_answer", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1")
def t10(spark, d):
    return conversation.latest_message(table(spark, d, "conversations"))


# Deduplication and sets


@query("d01_greedy_dedup", """
WITH RECURSIVE r AS (
    SELECT doc_id, sha256(text) AS h, 'u' || doc_id % 300 AS u FROM documents
), k(i, hs, us, keep) AS (
    SELECT -1, []::VARCHAR[], []::VARCHAR[], NULL::BIGINT
    UNION ALL
    SELECT k.i + 1, CASE WHEN ok THEN list_append(hs, h) ELSE hs END, CASE WHEN ok THEN list_append(us, u) ELSE us END, CASE WHEN ok THEN r.doc_id END
    FROM k JOIN r ON r.doc_id = k.i + 1, LATERAL (SELECT NOT list_contains(hs, h) AND NOT list_contains(us, u) AS ok)
)
SELECT keep AS doc_id FROM k WHERE keep IS NOT NULL
""")
def d01(spark, d):
    """The documents as the feed of one run: its URLs collide every 300."""
    rows = table(spark, d, "documents")
    rows = rows.select("doc_id", F.sha2("text", 256).alias("h"), F.concat(F.lit("u"), (F.col("doc_id") % 300).cast("string")).alias("u"))
    return ingest.first_seen(rows, order="doc_id", content="h", url="u").select("doc_id")


@query("d02_content_hash", """
SELECT doc_id, sha256(lower(regexp_replace(source || text, '^\\s+|\\s+$', '', 'g'))) AS content_hash, sha256(source || ' ' || text) AS summary_hash
FROM documents
""")
def d02(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", T.content_hash(F.col("source"), F.col("text")).alias("content_hash"), T.summary_hash(F.col("source"), F.col("text")).alias("summary_hash"))


@query("d06_array_union", """
SELECT l_orderkey, string_agg(DISTINCT k::VARCHAR, ',' ORDER BY k::VARCHAR) AS ids
FROM (SELECT l_orderkey, l_partkey AS k FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1
""")
def d06(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("a"), F.collect_list("l_suppkey").alias("b"))
    united = F.array_sort(F.transform(F.array_union("a", "b"), lambda x: x.cast("string")))
    return rows.select("l_orderkey", F.array_join(united, ",").alias("ids"))


@query("d07_edge_union", f"""
WITH {edges_sql()} SELECT source, target FROM edges WHERE source <= 20 UNION SELECT source, target FROM edges WHERE target <= 1000050
""")
def d07(spark, d):
    rows = edges(spark, d).select("source", "target")
    return rows.where("source <= 20").union(rows.where("target <= 1000050")).dropDuplicates(["source", "target"])


# Retrieval


@query("v01_cosine_pairs", """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def v01(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(other, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


_NEAR = "SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings"


@query("v02_similar_articles", f"""
WITH s AS ({_NEAR}) SELECT vec_id, source, round(s, 6) AS similarity FROM s JOIN documents ON doc_id = vec_id
WHERE s >= 0.2 AND vec_id NOT IN (0, 1) ORDER BY s DESC, vec_id LIMIT 10
""")
def v02(spark, d):
    joined = table(spark, d, "embeddings").join(table(spark, d, "documents").select("doc_id", "source"), F.col("doc_id") == F.col("vec_id"))
    return retrieval.similar(joined, _vector(spark, d), 10, threshold=0.2, exclude=(0, 1)).select("vec_id", "source", F.round("similarity", 6).alias("similarity"))


@query("v04_similar_entities", f"WITH s AS ({_NEAR}) SELECT vec_id, label, round(s, 6) AS similarity FROM s WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 20")
def v04(spark, d):
    found = vector_index(spark, d).search(_vector(spark, d), 20, threshold=0.1, name="vec_id")
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    return labels.join(F.broadcast(found), "vec_id").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))  # twenty rows


@query("v05_indexed_matches")
def v05_indexed(spark, d):
    """The ten nearest of each vector whose id is divisible by 50, among the lists that the index probes."""
    found = vector_index(spark, d).search_all(table(spark, d, "embeddings").where("vec_id % 50 = 0"), 10, key="vec_id", vector="embedding")
    return found.select("query", "rank", "match", F.round("similarity", 6).alias("similarity"))


_TERMS = """
tokens AS (
    SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents
)
"""
_MATCH = "SELECT doc_id AS id, 1 + ln(len(list_filter(w, lambda x: x = 'en'))) + 1 + ln(len(list_filter(w, lambda x: x = 'ea'))) AS text_score FROM tokens WHERE list_contains(w, 'en') AND list_contains(w, 'ea')"


@query("v07_text_match", f"WITH {_TERMS} SELECT id, round(text_score, 6) AS text_score FROM ({_MATCH}) ORDER BY text_score DESC, id LIMIT 20")
def v07(spark, d):
    found = text_index(spark, d).search(TERMS, 20)
    return found.select("id", F.round("text_score", 6).alias("text_score"))


_STEMS = """
words AS (
    SELECT doc_id, 1 AS heading, string_split(regexp_replace(lower(source), '[^\\p{L}\\p{Nd}]+', ' ', 'g'), ' ') AS w FROM documents
    UNION ALL SELECT doc_id, 0, w FROM tokens
), t AS (SELECT doc_id, heading, unnest(w) AS w FROM words), p AS (
    SELECT *, CASE WHEN regexp_matches(w, '[^ae]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ss|sh|ch|x|z)es$') THEN regexp_replace(w, 'es$', '')
                   WHEN regexp_matches(w, '[^su]s$') THEN regexp_replace(w, 's$', '') ELSE w END AS plural
    FROM t
), b AS (SELECT *, regexp_replace(plural, '^(.*[aeiouy].*)(ing|ed)$', '\\1') AS bare FROM p),
stems AS (
    SELECT doc_id, heading, CASE WHEN length(w) <= 3 THEN w WHEN bare <> plural AND regexp_matches(bare, '[b-df-hjkmnp-rtv-x]$') AND bare[-1] = bare[-2] THEN bare[:-2] ELSE bare END AS term FROM b
)
"""


@query("v08_weighted_search", f"""
WITH {_TERMS}, {_STEMS}, f AS (
    SELECT doc_id AS id, term, 1 + ln(1.0e0 * sum(heading) + 0.4e0 * sum(1 - heading)) AS impact FROM stems WHERE term IN ('src1', 'onnd', 'er') GROUP BY 1, 2
)
SELECT id, round(sum(impact), 6) AS text_score FROM f GROUP BY 1 HAVING count(*) = 3 ORDER BY text_score DESC, id LIMIT 15
""")
def v08(spark, d):
    """Terms of a heading, the source, count more than those of the text; `er` is what is left of `ering`."""
    found = text_index(spark, d, weighted=True).search(["src1", "onnd", "ering"], 15)
    return found.select("id", F.round("text_score", 6).alias("text_score"))


@query("v09_postings", f"""
WITH {_TERMS}, t AS (SELECT doc_id, unnest(w) AS term FROM tokens)
SELECT doc_id, term, count(*) AS tf FROM t WHERE term NOT IN ({", ".join(repr(w) for w in T.STOP_WORDS)}) GROUP BY 1, 2
""")
def v09(spark, d):
    return retrieval.postings(table(spark, d, "documents"), key="doc_id", text="text")


_HYBRID = f"""
WITH {_TERMS}, near AS (
    SELECT vec_id AS id, s AS similarity, row_number() OVER (ORDER BY s DESC, vec_id) AS vector_rank FROM ({_NEAR}) ORDER BY s DESC, vec_id LIMIT 20
), said AS (
    SELECT id, text_score, row_number() OVER (ORDER BY text_score DESC, id) AS text_rank FROM ({_MATCH}) ORDER BY text_score DESC, id LIMIT 20
)
SELECT id, round(coalesce(similarity, 0), 6) AS similarity, coalesce(vector_rank, 1000) AS vector_rank, coalesce(text_rank, 1000) AS text_rank,
       round(0.6e0 / (coalesce(vector_rank, 1000) + 60) + 0.4e0 / (coalesce(text_rank, 1000) + 60), 9) AS rrf_score
FROM near FULL JOIN said USING (id) ORDER BY rrf_score DESC, id LIMIT 10
"""


@query("v06_hybrid_search", _HYBRID)
def v06(spark, d):
    found = retrieval.hybrid(vector_index(spark, d), text_index(spark, d), _vector(spark, d), TERMS, 10)
    return found.select("id", F.round("similarity", 6).alias("similarity"), F.col("vector_rank").cast("long").alias("vector_rank"), F.col("text_rank").cast("long").alias("text_rank"), F.round("rrf_score", 9).alias("rrf_score"))


@query("v11_retrieve_and_rerank", f"""
WITH h AS ({_HYBRID}), t AS (SELECT h.*, d.text FROM h JOIN documents d ON doc_id = id),
     x AS (SELECT *, (list_contains(w, 'ing')::INT + list_contains(w, 'en')::INT) / 2e0 AS rerank_score
           FROM t, LATERAL (SELECT string_split(regexp_replace(lower(t.text), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' ') AS w))
SELECT id, rerank_score, round(similarity, 3) AS relevance, CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END AS content
FROM x ORDER BY rerank_score DESC, rrf_score DESC, id LIMIT 5
""")
def v11(spark, d):
    found = v06(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    order = F.row_number().over(Window.orderBy(F.desc("rrf_score"), "id"))  # of ten rows
    best = retrieval.rerank(found.withColumn("place", order), ["ing", "en"], 5, text="text", order="place")
    return retrieval.shown(best, text=F.col("text"), score=F.col("similarity")).select("id", "rerank_score", "relevance", "content")


# Text


@query("c01_chunks")
def c01(spark, d):
    return small_batches(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.inline(chunk_array("text")))


@query("c04_page_text")
def c04(spark, d):
    return small_batches(table(spark, d, "pages").select("page_id", "html")).select("page_id", extract_content("html").alias("content"))


@query("c06_page_host", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages")
def c06(spark, d):
    return table(spark, d, "pages").select("page_id", T.host(F.col("url")).alias("host"))


@query("c07_feed_name", """
SELECT page_id, CASE WHEN contains(url, '//') THEN replace(split_part(split_part(url, '//', 2), '/', 1), 'www.', '') ELSE url[1:50] END AS name FROM pages
""")
def c07(spark, d):
    return table(spark, d, "pages").select("page_id", T.feed_name(F.col("url")).alias("name"))


@query("c08_fallback_query", """
WITH q AS (SELECT doc_id, 'News 2024 2023-2025 ' || text AS q FROM documents)
SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(q, '\\s+', ' ', 'g')), ' '), lambda w: NOT regexp_full_match(w, '\\d{4}(-\\d{4})?') AND w <> '')[1:7], ' ') AS q FROM q
""")
def c08(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fallback_query(F.concat(F.lit("News 2024 2023-2025 "), F.col("text"))).alias("q"))


@query("c10_format_issues", """
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[AI] ' ELSE '' END || source AS title,
                  'one' || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '· ' ELSE '' END || 'two' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE chr(10) || chr(10) || CASE WHEN doc_id % 7 = 0 THEN '影响' ELSE '' END || 'three' END AS dummy FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 2 <> 0 THEN 'title' END, CASE WHEN doc_id % 5 = 0 THEN 'paragraphs' END,
       CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN 'bullets' END, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'label' END) AS issues FROM s
""")
def c10(spark, d):
    k, brk = F.col("doc_id"), F.lit("\n\n")
    title = F.concat(F.when(k % 2 == 0, "[AI] ").otherwise(""), F.col("source"))
    third = F.when(k % 5 == 0, "").otherwise(F.concat(brk, F.when(k % 7 == 0, "影响").otherwise(""), F.lit("three")))
    summary = F.concat(F.lit("one"), brk, F.when(k % 3 == 0, "· ").otherwise(""), F.lit("two"), third)
    return table(spark, d, "documents").select("doc_id", F.array_join(T.format_issues(title, summary, "影响"), ",").alias("issues"))


@query("c13_citations", """
SELECT doc_id, source AS cited FROM documents UNION ALL SELECT doc_id, lang FROM documents
""")
def c13(spark, d):
    marks = F.concat(F.lit("see [文章："), F.col("source"), F.lit("] and [文章："), F.col("lang"), F.lit("], not [网络：x]"))
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.explode(T.citations(marks, "文章")).alias("cited"))


@query("l01_weighted_score", f"WITH {ARTICLES} SELECT id, total_score FROM articles")
def l01(spark, d):
    return articles(spark, d).select("id", "total_score")


@query("l06_json_in_text", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def l06(spark, d):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```")))
    wrapped = wrapped.when(F.col("event_id") % 3 == 1, F.concat(F.lit("Answer "), F.col("props"), F.lit(" done"))).otherwise(F.col("props"))
    body = T.json_in_text(wrapped)
    return table(spark, d, "events").select("event_id", F.from_json(body, "k long")["k"].alias("k"))


@query("l07_json_repair", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def l07(spark, d):
    broken = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"\}\s*$", "")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", parsed(broken, "k long")["k"].alias("k"))


# Graph


@query("g03_seed_subgraph", """
SELECT DISTINCT l_suppkey AS source, l_partkey + 1000000 AS target FROM lineitem WHERE l_orderkey BETWEEN 10 AND 60
""")
def g03(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 1_000_000).alias("target"), "l_orderkey")
    wanted = table(spark, d, "orders").where("o_orderkey BETWEEN 10 AND 60").select("o_orderkey")
    return listing.touching(pairs, wanted, "l_orderkey", ["source", "target"])


@query("g04_neighbours", f"""
WITH {edges_sql()}, b AS (SELECT source AS node, target AS other, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)
SELECT node AS id, round(avg(weight), 6) AS avg_weight FROM b WHERE other IN (5, 6) AND node NOT IN (5, 6) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50
""")
def g04(spark, d):
    seeds = spark.createDataFrame([(5,), (6,)], "id long")
    near = graph.neighbours(edges(spark, d), seeds).select("id", F.round("avg_weight", 6).alias("avg_weight"))
    return near.orderBy(F.desc("avg_weight"), "id").limit(50)


_ONE_HOP = """
    SELECT b.node AS id, avg(weight) AS w FROM b WHERE other IN (SELECT id FROM {frontier}) AND node NOT IN (SELECT id FROM {seen}) GROUP BY 1
"""


@query("g05_expansion", f"""
WITH {edges_sql()}, n AS (SELECT source AS id FROM edges UNION SELECT target FROM edges),
v AS (SELECT n.id, e.embedding::DOUBLE[] AS x, e.label FROM n JOIN embeddings e ON e.vec_id = n.id % 500),
b AS (SELECT source AS node, target AS other, weight FROM edges UNION ALL SELECT target, source, weight FROM edges),
s AS (SELECT id FROM n WHERE id IN (1, 2)),
mean AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x[i]) AS m FROM v, generate_series(1, 64) g(i) WHERE id IN (SELECT id FROM s) GROUP BY i)),
h1 AS (
    SELECT c.id, 1 AS hop, 0.4e0 * list_cosine_similarity(x, m) + 0.3e0 * least(w / 5, 1e0) + CASE WHEN label IN (SELECT label FROM v WHERE id IN (SELECT id FROM s)) THEN 0.3e0 ELSE 0 END AS relevance
    FROM ({_ONE_HOP.format(frontier="s", seen="s")}) c JOIN v USING (id), mean ORDER BY relevance DESC, c.id LIMIT 50
), seen AS (SELECT id FROM s UNION SELECT id FROM h1),
h2 AS (
    SELECT c.id, 2 AS hop, 0.4e0 * list_cosine_similarity(x, m) + 0.3e0 * least(w / 5, 1e0) + CASE WHEN label IN (SELECT label FROM v WHERE id IN (SELECT id FROM s)) THEN 0.3e0 ELSE 0 END AS relevance
    FROM ({_ONE_HOP.format(frontier="h1", seen="seen")}) c JOIN v USING (id), mean ORDER BY relevance DESC, c.id LIMIT (SELECT 50 - count(*) FROM h1)
)
SELECT id, hop, round(relevance, 6) AS relevance FROM h1 UNION ALL SELECT id, hop, round(relevance, 6) FROM h2
""")
def g05(spark, d):
    rows = edges(spark, d)
    ids = rows.select(F.col("source").alias("id")).union(rows.select("target")).distinct()
    vectors = table(spark, d, "embeddings").withColumnRenamed("label", "community")
    nodes = ids.join(vectors, F.col("vec_id") == F.col("id") % 500).select("id", "embedding", "community")
    found = graph.expand(rows, ids.where("id IN (1, 2)"), nodes, nodes.select("community", "id"))
    return found.withColumn("relevance", F.round("relevance", 6))


@query("g06_communities")
def g06(spark, d):
    rows = materialize(edges(spark, d), "pairs")
    ids = rows.select(F.col("source").alias("id")).union(rows.select("target")).distinct()
    return modularity.communities(rows, ids)


@query("g06_stars", """
WITH c AS (SELECT c_custkey AS id, c_nationkey + 1000000 AS hub FROM customer),
e AS (SELECT id AS a, hub AS b, 5e0 AS w FROM c UNION ALL SELECT n_nationkey + 1000000, (n_nationkey + 1) % 25 + 1000000, 0.1e0 FROM nation),
n AS (SELECT id, min(id) OVER (PARTITION BY hub) AS community FROM c UNION ALL SELECT n_nationkey + 1000000, coalesce(min(id), n_nationkey + 1000000) FROM nation LEFT JOIN c ON hub = n_nationkey + 1000000 GROUP BY n_nationkey),
k AS (SELECT community, sum(w) AS t FROM (SELECT a AS id, w FROM e UNION ALL SELECT b, w FROM e) JOIN n USING (id) GROUP BY 1),
m AS (SELECT sum(t) AS m2, sum(t * t) AS tt FROM k),
i AS (SELECT 2 * sum(w) AS inside FROM e JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE x.community = y.community)
SELECT id, community, round(inside / m2 - tt / (m2 * m2), 9) AS modularity FROM n, m, i
""")
def g06_stars(spark, d):
    """Customers around their nations, which hang together by a thread: each nation is a community."""
    hub = lambda c: (c + 1_000_000).cast("long")
    stars = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("source"), hub(F.col("c_nationkey")).alias("target"), F.lit(5.0).alias("weight"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"))
    rows = materialize(stars.union(nations.select(hub(F.col("n")), hub((F.col("n") + 1) % 25), F.lit(0.1))), "stars")
    ids = rows.select(F.col("source").alias("id")).union(rows.select("target")).distinct()
    found = modularity.communities(rows, ids)
    return found.withColumn("modularity", F.round(F.lit(modularity.modularity(rows, found)), 9))


# SQL that reaches every pair of a giant component is too slow; tests hold it against brute force.
@query("g07_components")
def g07(spark, d):
    rows = edges(spark, d)
    ids = rows.select(F.col("source").alias("id")).union(rows.select("target")).distinct()
    return graph.components(rows, ids)


@query("g09_visual_edges", f"""
WITH {edges_sql()} SELECT source, target, source > 3 OR target > 1000100 AS is_expanded FROM edges WHERE source <= 6 AND target <= 1000200
""")
def g09(spark, d):
    rows = edges(spark, d)
    ids = rows.select(F.col("source").alias("id")).union(rows.select("target")).distinct()
    near = "id <= 3 OR (id >= 1000000 AND id <= 1000100)"
    far = "(id > 3 AND id <= 6) OR (id > 1000100 AND id <= 1000200)"
    return graph.visual(rows, ids.where(near), ids.where(far)).select("source", "target", "is_expanded")


# Conversations


@query("h02_compression_trigger", "SELECT conv_id, sum(length(text) // 4)::BIGINT AS tokens, sum(length(text) // 4) >= 700 AS compress FROM conversations GROUP BY 1")
def h02(spark, d):
    return conversation.budgets(table(spark, d, "conversations"), 1000)


@query("h03_compaction", """
WITH t AS (SELECT *, length(text) // 4 AS tok FROM conversations),
     r AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(tok) OVER (PARTITION BY conv_id) AS total FROM t)
SELECT conv_id, min(turn) AS period_start, max(turn) AS period_end, count(*) AS messages_replaced, sum(tok)::BIGINT AS tokens_removed
FROM r WHERE total >= 700 AND before < total - 400 GROUP BY 1
""")
def h03(spark, d):
    return conversation.boundaries(conversation.compact(table(spark, d, "conversations"), 1000))


@query("h04_rule_summary", """
SELECT conv_id, string_agg(text[1:50], ' | ' ORDER BY turn) AS summary
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n <= 3 GROUP BY 1
""")
def h04(spark, d):
    return conversation.outline(table(spark, d, "conversations"))


@query("h05_interests", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT DISTINCT conv_id, k AS interest FROM r, (SELECT unnest(['the', 'ing', 'data', 'on']) AS k) WHERE n <= 5 AND role = 'user' AND contains(lower(text), k)
""")
def h05(spark, d):
    return conversation.interests(table(spark, d, "conversations"), ["the", "ing", "data", "on"])


@query("h12_open_conversations", """
SELECT conv_id, 'archived' AS status FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1
UNION ALL SELECT conv_id, 'active' FROM conversations WHERE conv_id % 2 = 1 GROUP BY 1
""")
def h12(spark, d):
    asked = table(spark, d, "conversations").select("conv_id")
    stored = asked.where("conv_id % 2 = 0").distinct().withColumn("status", F.lit("archived"))
    return conversation.opened(stored, asked, ["conv_id"])


# Sinks


@query("s11_article_upsert", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0
""")
def s11(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    stored, batch = docs.where("doc_id % 2 = 0").withColumn("state", F.lit("old")), docs.where("doc_id % 3 = 0").withColumn("state", F.lit("new"))
    return merge.upsert(stored, batch, ["doc_id"])


@query("s13_chunk_hash", "SELECT doc_id, sha256(text)[1:60] || '_c' || doc_id % 5 AS chunk_hash FROM documents")
def s13(spark, d):
    return table(spark, d, "documents").select("doc_id", T.chunk_hash(F.sha2("text", 256), F.col("doc_id") % 5).alias("chunk_hash"))


@query("s22_turn_counters", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1")
def s22(spark, d):
    return table(spark, d, "conversations").where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


@query("s23_memory_upsert", """
WITH o AS (SELECT conv_id, arg_max(text, turn) AS content FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 GROUP BY 1),
     n AS (SELECT conv_id, arg_max(text, turn) AS content FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 0 GROUP BY 1)
SELECT conv_id, 'topic' AS memory_type, coalesce(n.content, o.content) AS content, CASE WHEN n.content IS NULL THEN 1 WHEN o.content IS NULL THEN 1 ELSE 2 END AS version
FROM o FULL JOIN n USING (conv_id)
""")
def s23(spark, d):
    rows = table(spark, d, "conversations")
    last = lambda role, k: rows.where((F.col("role") == role) & (F.col("conv_id") % k == 0)).groupBy("conv_id").agg(F.max_by("text", "turn").alias("content")).withColumn("memory_type", F.lit("topic"))
    return merge.merge_memories(last("user", 2).withColumn("version", F.lit(1)), last("assistant", 3))


@query("s33_cascade_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id % 5 <> 0")
def s33(spark, d):
    rows = table(spark, d, "conversations")
    return merge.remove(rows, rows.where("conv_id % 5 = 0").select("conv_id").distinct(), ["conv_id"]).select("conv_id", "turn")
