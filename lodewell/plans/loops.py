"""Queries of the loops of model calls and of memories, with providers that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.operators import loops, memory
from lodewell.plans.registry import query
from lodewell.plans.scripted import Editor, Rememberer, Searcher, Talker
from lodewell.sources.tables import table


@query("h10_search_loop", """
WITH RECURSIVE a AS (
    SELECT doc_id, count(*) OVER (PARTITION BY source) AS source_size, count(*) OVER (PARTITION BY lang) AS language_size FROM documents
), r AS (
    SELECT doc_id, 0 AS steps, '' AS used, '' AS errors, true AS going FROM a
    UNION ALL
    SELECT doc_id, steps + CASE WHEN tool IS NULL THEN 0 ELSE 1 END,
           used || CASE WHEN tool IS NULL THEN '' ELSE tool || '=' || CASE tool WHEN 'source_size' THEN source_size ELSE language_size END || ' ' END,
           errors || CASE WHEN down THEN 'reasoning: OSError: down ' ELSE '' END, tool IS NOT NULL AND steps + 1 < 5
    FROM (
        SELECT *, doc_id % 11 = 3 AND steps = 2 AS down,
               CASE WHEN doc_id % 11 = 3 AND steps = 2 OR doc_id % 7 = 2 AND steps = 1 OR steps >= doc_id % 9 THEN NULL
                    WHEN doc_id % 4 = 0 THEN CASE steps % 2 WHEN 0 THEN 'source_size' ELSE 'language_size' END
                    ELSE CASE (doc_id + steps) % 3 WHEN 0 THEN 'source_size' WHEN 1 THEN 'language_size' END END AS tool
        FROM r JOIN a USING (doc_id) WHERE going
    )
)
SELECT doc_id, steps, trim(used) AS used, CASE WHEN doc_id % 13 <> 5 THEN 'doc ' || doc_id || ': ' || steps || ' findings' END AS report,
       trim(errors || CASE WHEN doc_id % 13 = 5 THEN 'conclude: OSError: no report' ELSE '' END) AS errors
FROM r WHERE NOT going
""")
def h10(spark, d):
    """A search about each document, whose tools count the documents of its source and of its language."""
    docs = table(spark, d, "documents")
    articles = docs.select("doc_id", F.concat(F.lit("doc "), "doc_id").alias("title"), "source", F.lit(None).alias("published_at"), F.col("text").alias("summary"))

    def size(column):
        def tool(asked):
            counts = docs.groupBy(column).agg(F.count("*").alias("n"))
            of = docs.select("doc_id", column).join(counts, docs[column].eqNullSafe(counts[column])).select("doc_id", "n")
            return asked.join(of, F.col("input")["doc"] == F.col("doc_id").cast("string")).select("key", F.col("n").cast("string").alias("output"))

        return tool

    found = loops.search(articles, Searcher, {"source_size": size("source"), "language_size": size("lang")}, key="doc_id")
    used = F.array_join(F.transform("collected", lambda c: F.concat(c["tool"], F.lit("="), c["output"])), " ")
    return found.select("doc_id", "steps", used.alias("used"), "report", F.array_join("errors", " ").alias("errors"))


@query("h09_chat_loop", """
WITH RECURSIVE r AS (
    SELECT DISTINCT conv_id AS c, 'supervisor' AS node, 0e0 AS whole, '' AS said, NULL::BOOLEAN AS passed, 0 AS failures, 0 AS research, 0 AS n, '' AS path, 0 AS errors FROM conversations
    UNION ALL
    SELECT c,
        CASE node
            WHEN 'supervisor' THEN CASE WHEN failures >= 3 THEN 'end' WHEN goto = 'researcher' THEN 'think' ELSE goto END
            WHEN 'think' THEN CASE WHEN goes THEN 'tool' ELSE 'supervisor' END WHEN 'tool' THEN 'think' ELSE 'supervisor' END,
        CASE WHEN node = 'supervisor' AND c % 3 = 1 THEN 0.5 WHEN node = 'supervisor' AND c % 3 = 2 THEN CASE goto WHEN 'end' THEN 1 WHEN 'explainer' THEN 0.8 WHEN 'fact_checker' THEN 0.9 ELSE 0.3 END
             WHEN node = 'think' AND NOT goes AND NOT lost THEN 0.9 ELSE whole END,
        CASE WHEN node = 'explainer' THEN CASE WHEN c % 17 = 4 THEN 'No answer could be made: OSError: no words' ELSE 'answer ' || failures + 1 END ELSE said END,
        CASE WHEN node = 'explainer' AND c % 17 <> 4 THEN NULL WHEN node = 'fact_checker' THEN ok ELSE passed END,
        CASE WHEN node = 'fact_checker' THEN CASE WHEN ok THEN 0 ELSE failures + 1 END ELSE failures END,
        CASE WHEN node = 'tool' OR node = 'think' AND NOT goes THEN research + 1 ELSE research END,
        CASE WHEN node = 'tool' AND (c + n) % 4 <> 3 THEN n + 1 ELSE n END,
        path || CASE node WHEN 'supervisor' THEN 's' WHEN 'think' THEN 't' WHEN 'tool' THEN 'u' WHEN 'explainer' THEN 'e' ELSE 'f' END,
        errors + CASE WHEN node = 'think' AND lost OR node = 'tool' AND (c + n) % 4 = 3 OR node = 'explainer' AND c % 17 = 4 THEN 1 ELSE 0 END
    FROM (
        SELECT *, c % 5 = 0 AND n = 1 AS lost, NOT (c % 5 = 0 AND n = 1) AND n < c % 7 AND research < 5 AS goes, failures >= c % 5 AS ok,
               CASE WHEN c % 3 = 0 THEN CASE WHEN NOT passed THEN CASE WHEN whole >= 0.7 THEN 'explainer' ELSE 'researcher' END WHEN passed THEN 'end' WHEN said <> '' THEN 'fact_checker'
                                             WHEN whole >= 0.7 THEN 'explainer' WHEN research < 5 THEN 'researcher' ELSE 'explainer' END
                    WHEN n < c % 4 AND research < 5 THEN 'researcher' WHEN said = '' OR NOT passed THEN 'explainer' WHEN passed IS NULL THEN 'fact_checker' ELSE 'end' END AS goto
        FROM r WHERE node <> 'end' AND length(path) < 50
    )
)
SELECT c AS conv_id, said AS response, passed, failures, research, n AS collected, path, errors + CASE WHEN node <> 'end' THEN 1 ELSE 0 END AS errors
FROM r WHERE node = 'end' OR length(path) = 50
""")
def h09(spark, d):
    """One turn of each conversation; path has a letter for each node passed, u where a tool was used."""
    rows = table(spark, d, "conversations")
    asked = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).select("conv_id", F.concat(F.lit("conversation "), "conv_id", F.lit(" says "), F.coalesce("text", F.lit(""))).alias("message"))
    counts = rows.groupBy("conv_id").agg(F.count("*").cast("string").alias("output"))
    turns = lambda calls: calls.join(counts, F.col("key") == F.col("conv_id")).select("key", "output")
    done = loops.chat(asked, Talker, {"turns": turns})
    letters = F.create_map(*(F.lit(x) for pair in {"supervisor": "s", "think": "t", "tool": "u", "explainer": "e", "fact_checker": "f"}.items() for x in pair))
    path = F.array_join(F.transform("path", lambda p: F.try_element_at(letters, p)), "")
    return done.select("conv_id", F.coalesce("response", F.lit("")).alias("response"), "passed", "failures", "research", F.size("collected").alias("collected"), path.alias("path"), F.size("errors").alias("errors"))


@query("c11_reflection_rounds", """
WITH RECURSIVE a AS (SELECT doc_id AS d, coalesce(text, '') <> '' AND doc_id % 19 <> 0 AS whole FROM documents),
r AS (
    SELECT d, 0 AS retries, 0 AS revision, d % 2 = 0 AS tagged, NULL::VARCHAR AS feedback, NOT whole AS done FROM a
    UNION ALL
    SELECT d, CASE WHEN good THEN retries ELSE retries + 1 END, CASE WHEN writes AND d % 5 <> 0 THEN retries + 1 ELSE revision END,
           CASE WHEN writes AND d % 5 <> 0 THEN d % 3 <> 0 ELSE tagged END,
           CASE WHEN good THEN NULL WHEN writes AND d % 5 <> 0 THEN CASE WHEN tagged THEN '- tone' ELSE '- title' END ELSE feedback END, good OR retries + 1 >= 3
    FROM (
        SELECT *, tagged AND d % 7 <> 3 AND (d % 4 <> 1 OR revision >= 2) AS good, NOT tagged OR d % 7 <> 3 AND d % 4 = 1 AND revision < 2 AS writes FROM r WHERE NOT done
    )
)
SELECT d AS doc_id, CASE WHEN d % 19 = 0 THEN '' WHEN tagged THEN '[AI] doc ' || d || ' r' || revision ELSE 'doc ' || d || ' r' || revision END AS title, true AS passed, retries, feedback
FROM r WHERE done
""")
def c11(spark, d):
    """Titles of odd documents lack the tag that the format asks for; every nineteenth document has no title."""
    k, name = F.col("doc_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    title = F.when(k % 19 == 0, "").otherwise(F.concat(F.when(k % 2 == 0, "[AI] ").otherwise(""), name, F.lit(" r0")))
    articles = table(spark, d, "documents").select("doc_id", name.alias("original_title"), F.col("text").alias("content"), title.alias("title"), F.lit("one\n\n· two\n\n主编洞察：three").alias("summary"))
    return loops.reflect(articles, Editor, key="doc_id").select("doc_id", "title", "passed", "retries", "feedback")


@query("h06_memory_extraction", """
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS ago FROM conversations),
k AS (SELECT unnest(['the', 'ing', 'data', 'on']) AS word, unnest([1, 2, 3, 4]) AS i),
w AS (SELECT conv_id, word, min(turn * 10 + i) AS o FROM m, k WHERE ago <= 5 AND role = 'user' AND contains(lower(text), word) GROUP BY 1, 2),
i AS (SELECT conv_id, string_agg(word, ',' ORDER BY o) AS words FROM w GROUP BY 1),
c AS (
    SELECT conv_id, count(*) FILTER (ago <= 10 AND role IN ('user', 'assistant', 'system')) AS lines, arg_max(text, turn) FILTER (role = 'user') AS topic FROM m GROUP BY 1
)
SELECT conv_id, 'user_profile' AS memory_type, CASE WHEN conv_id % 4 >= 2 THEN 'level ' || lines ELSE coalesce(words, '') END AS content, CASE WHEN conv_id % 4 >= 2 THEN 'model' ELSE 'rule' END AS by
FROM c LEFT JOIN i USING (conv_id)
UNION ALL
SELECT conv_id, 'conversation_state', CASE WHEN conv_id % 4 = 3 THEN 'topic ' || conv_id ELSE topic[1:200] END, CASE WHEN conv_id % 4 = 3 THEN 'model' ELSE 'rule' END
FROM c WHERE conv_id % 4 <> 2
""")
def h06(spark, d):
    """Memories by a model where it can be had, by rule elsewhere; of the contents what a reader looks for."""
    found = memory.extracted(table(spark, d, "conversations"), Rememberer, keywords=["the", "ing", "data", "on"])
    part = lambda name: F.get_json_object("content", f"$.{name}")
    interests = F.array_join(F.from_json(part("interests"), "array<string>"), ",")
    return found.select("conv_id", "memory_type", F.coalesce(part("expertise_level"), part("current_topic"), interests).alias("content"), "by")


@query("s32_memory_generations", """
WITH e AS (
    SELECT conv_id, role AS memory_type, text AS content, turn, make_timestamp((1704067200 + turn * 300 + CASE WHEN turn >= 4 THEN conv_id % 3 * 3000 ELSE 0 END) * 1000000) AS time
    FROM conversations WHERE coalesce(text, '') <> ''
), g AS (
    SELECT *, sum(CASE WHEN before IS NULL OR time > before + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, memory_type ORDER BY time, turn) AS g
    FROM (SELECT *, lag(time) OVER (PARTITION BY conv_id, memory_type ORDER BY time, turn) AS before FROM e)
)
SELECT conv_id, memory_type, arg_max(content, turn) AS content, count(*) AS version, epoch(min(time))::BIGINT AS first_at, epoch(max(time))::BIGINT AS last_at,
       CASE WHEN max(time) + INTERVAL 1 HOUR < (SELECT max(time) - INTERVAL 10 MINUTE FROM e) THEN 'expired' ELSE 'live' END AS status
FROM g GROUP BY conv_id, memory_type, g
""")
def s32(spark, d):
    """What each role said last, remembered for an hour; later turns of some conversations come long after the first."""
    rows = table(spark, d, "conversations")
    late = F.when(F.col("turn") >= 4, F.col("conv_id") % 3 * 3000).otherwise(0)
    events = rows.select("conv_id", F.col("role").alias("memory_type"), F.col("text").alias("content"), "turn", F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 300 + late).alias("at"))
    last = events.where("content <> ''").agg(F.max("at")).first()[0]
    kept = memory.generations(events, "1 hour", F.lit(last) - F.expr("INTERVAL 10 MINUTES"))
    return kept.withColumns({c: F.unix_timestamp(c) for c in ("first_at", "last_at")})
