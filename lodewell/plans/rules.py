"""Queries of single rules: gates, fallbacks, JSON rows, prompts and list reducers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.functions import contracts
from lodewell.functions import text as T
from lodewell.functions.html import extracted
from lodewell.operators import graph, ingest, listing, retrieval
from lodewell.plans.fixtures import edges, edges_sql
from lodewell.plans.registry import query
from lodewell.sources.tables import table


@query("f05_length_gates", """
SELECT doc_id, length(trim(text[1:98 + doc_id % 5], ' \t\n\r')) > 100 AS stored, length(trim(text[1:98 + doc_id % 5], ' \t\n\r')) >= 100 AS afterwards FROM documents
""")
def f05(spark, d):
    """Texts around the two thresholds, which differ at exactly 100 characters."""
    docs = table(spark, d, "documents").select("doc_id", F.substr("text", F.lit(1), (98 + F.col("doc_id") % 5).cast("int")).alias("text"))
    return docs.select("doc_id", ingest.long_enough(F.col("text")).alias("stored"), ingest.long_enough(F.col("text"), afterwards=True).alias("afterwards"))


@query("f11_known_urls", """
SELECT page_id, url IN (SELECT url FROM pages WHERE page_id % 3 = 0 AND url IS NOT NULL) AND url IS NOT NULL AS known FROM pages
""")
def f11(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("source_url"))
    return ingest.known_urls(pages, pages.where("page_id % 3 = 0")).select("page_id", "known")


@query("f16_default_threshold", """
WITH s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings)
SELECT vec_id, round(s, 6) AS similarity, given FROM (
    SELECT *, 0 AS given FROM (SELECT * FROM s WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 30) UNION ALL SELECT *, 1 FROM (SELECT * FROM s WHERE s >= 0.15 ORDER BY s DESC, vec_id LIMIT 30)
)
""")
def f16(spark, d):
    """A threshold of 0 stands for the default."""
    rows = table(spark, d, "embeddings")
    first = rows.where("vec_id = 0").select("embedding").first()
    found = lambda t, given: retrieval.similar(rows, first[0] if first else [0.0], 30, threshold=t, default=0.2).select("vec_id", F.round("similarity", 6).alias("similarity"), F.lit(given).alias("given"))
    return found(0, 0).union(found(0.15, 1))


@query("f22_content_fallback", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN source WHEN 2 THEN lang ELSE '' END AS content FROM documents
""")
def f22(spark, d):
    k = F.col("doc_id") % 4
    full, summary, description = F.when(k == 0, F.col("text")).otherwise(""), F.when(k == 1, F.col("source")), F.when(k == 2, F.col("lang")).otherwise("")
    return table(spark, d, "documents").select("doc_id", T.content_text(full, summary, description).alias("content"))


@query("t13_summary_context", """
WITH r AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY n_chars % 101 DESC, doc_id) AS n FROM documents)
SELECT source, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY n) AS context FROM r WHERE n <= 5 GROUP BY 1
""")
def t13(spark, d):
    docs = table(spark, d, "documents").withColumn("score", F.col("n_chars") % 101)
    return retrieval.summary_context(docs, by="source", text="text", score="score", key="doc_id")


@query("c05_extraction", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url END AS content, CASE page_id % 3 WHEN 1 THEN 'no text' WHEN 2 THEN 'no page' END AS error FROM pages
""")
def c05(spark, d):
    """Pages with their address as text, with a menu only, and missing ones."""
    k, url = F.col("page_id") % 3, F.col("url")
    html = F.when(k == 0, F.concat(F.lit("<html><body><nav>menu</nav><p>"), url, F.lit("</p></body></html>"))).when(k == 1, "<html><body><nav>menu</nav></body></html>")
    page = extracted(html)
    return table(spark, d, "pages").select("page_id", page["content"].alias("content"), page["error"].alias("error"))


@query("d11_bag_union", """
SELECT conv_id, string_agg(role, ',' ORDER BY late, turn) AS roles FROM (SELECT *, turn % 2 AS late FROM conversations) GROUP BY 1
""")
def d11(spark, d):
    """Even turns as a list, and odd ones appended; repeats stay."""
    rows = table(spark, d, "conversations")
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda m: m["role"]).alias("roles")
    part = lambda odd: rows.where(F.col("turn") % 2 == odd).groupBy("conv_id").agg(roles)
    return listing.appended(part(0), part(1), "conv_id", "roles").select("conv_id", F.array_join("roles", ",").alias("roles"))


@query("s29_typed_json", """
SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","price":' || (o_orderkey % 100)::DOUBLE / 4 || ',"status":'
       || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS line
FROM orders
""")
def s29_typed(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day"), ((F.col("o_orderkey") % 100) / 4).cast("decimal(10,2)").alias("price"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"),
    )
    return orders.select("o_orderkey", listing.json_rows(orders).alias("line"))


PROMPTS = contracts.Prompts({"score": "Score {kind} of user {user}.", "plain": "Say nothing."})


@query("l15_prompts", "SELECT event_id, 'Score ' || event_type || ' of user ' || coalesce(user_id::VARCHAR, '') || '.' AS prompt, 'Say nothing.' AS plain FROM events")
def l15(spark, d):
    events = table(spark, d, "events")
    given = {"kind": F.col("event_type"), "user": F.col("user_id"), "other": F.col("props")}
    return events.select("event_id", PROMPTS.prompt("score", **given).alias("prompt"), PROMPTS.prompt("plain", **given).alias("plain"))


@query("c14_collected_citations", """
SELECT event_id, 0 AS place, 'web' AS source_type, event_type AS source_name, 'http://' || event_type || '/1' AS url, 'about ' || event_type AS snippet FROM events
UNION ALL SELECT event_id, 1, 'web', 'news', 'http://' || event_type || '/2', '' FROM events
UNION ALL SELECT event_id, 2, 'article', 'article', NULL, repeat(event_type || ' ', 100)[1:100] FROM events
UNION ALL SELECT event_id, 3 + n, 'note', 'note', NULL, n::VARCHAR FROM events, (SELECT unnest(range(7)) AS n)
""")
def c14_collected(spark, d):
    """A web search of four results, of which the third has no URL and the fourth is one too many; an answer that is no list; an
    article; and more notes than citations are kept."""
    kind = F.col("event_type")
    results = [
        F.concat(F.lit('{"title": "'), kind, F.lit('", "url": "http://'), kind, F.lit('/1", "snippet": "about '), kind, F.lit('"}')),
        F.concat(F.lit('{"source": "news", "url": "http://'), kind, F.lit('/2"}')),
        F.lit('{"title": "without"}'),
        F.concat(F.lit('{"title": "late", "url": "http://'), kind, F.lit('/4"}')),
    ]
    info = lambda source, content: F.struct(F.lit(source).alias("source"), content.alias("content"))
    web = F.concat(F.lit(" ["), F.concat_ws(", ", *results), F.lit("]"))
    notes = [info("note", F.lit(str(n))) for n in range(9)]
    collected = F.array(info("web_search", web), info("web_search", F.lit('{"url": "http://one"}')), info("web_search", F.lit("[nothing")), info("article", F.repeat(F.concat(kind, F.lit(" ")), F.lit(100))), *notes)
    cited = table(spark, d, "events").select("event_id", F.posexplode(contracts.info_citations(collected)).alias("place", "c"))
    return cited.select("event_id", "place", "c.*")


@query("d10_expanded_queries", """
SELECT doc_id, array_to_string((CASE WHEN doc_id % 2 = 0 THEN ['first', source, 'last', 'more'] ELSE [source, 'first', 'last', 'more'] END)[1:3], '|') AS queries FROM documents
""")
def d10_expanded(spark, d):
    """The query stays where the expansion has it, and goes in front where it has not."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    expanded = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("first"), "source", F.lit("last"), F.lit("more"))).otherwise(F.array(F.lit("first"), F.lit("last"), F.lit("more")))
    return docs.select("doc_id", F.array_join(contracts.expanded_queries(F.col("source"), expanded, 3), "|").alias("queries"))


@query("a13_graph_statistics", f"""
WITH {edges_sql()} SELECT count(*) AS total_entities, count(*) FILTER (p_partkey % 3 <> 0) AS seed_entities, count(*) FILTER (p_partkey % 3 = 0) AS expanded_entities,
       (SELECT count(*) FROM edges) AS total_relationships, count(DISTINCT p_size) AS total_communities FROM part
""")
def a13_graph(spark, d):
    part = table(spark, d, "part")
    nodes = part.select((F.col("p_partkey") % 3 == 0).alias("is_expanded"))
    return graph.visual_statistics(nodes, edges(spark, d), part.select("p_size").where("p_size IS NOT NULL").distinct())
