"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lodewell.llm import additive, kdtree_codes, langid, license, mixing, range_join, sentencepiece_trie, simhash, substring, token_counts, toxicity, warc_zip, whitening
from lodewell.sources.tables import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = langid.held_out("doc_id", 5, 0)
    model = langid.fit(docs.where(~held))
    return langid.identify(docs, model).withColumn("held_out", held)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    mixed = mixing.interleave(docs, mixing.tempered_weights(docs))
    return mixed.select("doc_id", "source", "mix.*")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = substring.strip_repeats(_documents(spark, sf_dir))
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    held = langid.held_out("doc_id", 4, 2)
    model = toxicity.fit(docs, labels.where(~held))
    return toxicity.classify(docs, model).withColumn("held_out", held)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(_documents(spark, sf_dir)).drop("matches")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_trie.tokenize(_documents(spark, sf_dir))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(table(spark, sf_dir, "embeddings"), F.col("k") % 20 == 0)


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_warc_zip": op8_warc_zip,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_nearest": op10_nearest,
    "op11_whitening": op11_whitening,
    "op12_token_counts": op12_token_counts,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op8_warc_zip"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLE_SQL["op4_substring_dedup"] = """
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d
), h AS (
    SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM s
), again AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM h) WHERE n > 1
), gone AS (
    SELECT doc_id, list_distinct(flatten(list(generate_series(i, i + 34)))) AS cut FROM again GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN cut IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce(array_to_string([w[k] FOR k IN generate_series(1, len(w)) IF NOT list_contains(cut, k)], ' '), '') END)
           AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

ORACLE_SQL["op9_embedding_dedup"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS x,
           sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda c: c * c))) AS norm
    FROM embeddings
), link AS (
    SELECT a.vec_id AS src, b.vec_id AS dst
    FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93
), reach(vec_id, root) AS (
    SELECT vec_id, vec_id FROM v
    UNION
    SELECT l.dst, r.root FROM reach r JOIN link l ON l.src = r.vec_id
)
SELECT v.vec_id, coalesce(any_value(c.n), 0) AS n_links, min(r.root) AS component_id, v.vec_id = min(r.root) AS kept
FROM v JOIN reach r USING (vec_id)
LEFT JOIN (SELECT src AS vec_id, count(*) AS n FROM link GROUP BY src) c USING (vec_id)
GROUP BY v.vec_id
"""


def _vector_codes_sql(rounds: int = 2) -> str:
    """The rounds spelled out: nearest entries by all distances, then means rounded down."""
    steps = [f"""
start AS (
    SELECT m, r - 1 AS e, c FROM part WHERE r <= 64
), book0 AS (
    SELECT * FROM start
)"""]
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS (
    SELECT r, m, min({{'d': list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS best
    FROM part p JOIN book{i} b USING (m) GROUP BY r, m
)""")
        if i < rounds:
            steps.append(f"""
sum{i} AS (
    SELECT m, best.e AS e, k, floor(sum(c[k]) / count(*))::BIGINT AS v
    FROM near{i} JOIN part USING (r, m), unnest(generate_series(1, len(c))) AS u(k) GROUP BY 1, 2, 3
), mean{i} AS (
    SELECT m, e, list(v ORDER BY k) AS v FROM sum{i} GROUP BY 1, 2
), book{i + 1} AS (
    SELECT m, e, coalesce(v, c) AS c FROM book{i} LEFT JOIN mean{i} USING (m, e)
)""")
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id) AS r
    FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), part AS (
    SELECT r, m, x[m * len(x) // 16 + 1:(m + 1) * len(x) // 16] AS c FROM kept, unnest(generate_series(0, 15)) AS u(m)
), {",".join(steps)}, coded AS (
    SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY m) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY r
), digest AS (
    SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY m, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""


ORACLE_SQL["op13_vector_codes"] = _vector_codes_sql()
