"""The pipeline against a plain version of its stages, and on the edges of their input."""

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F
from test_texts import groups_of, plain_fingerprint, removed_by_windows

from lodewell.llm import langid, mixing, sentencepiece_trie
from lodewell.sources.tables import materialize

SF = "/root/testdata/sf0.001"


def test_run_equals_the_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    scorer = langid.fit(docs.where(~langid.held_out("doc_id", 5, 0))).scorer()
    rows = {i: r for i, r in rows.items() if not scorer.decide(r["text"])[3]}
    first = groups_of({i: plain_fingerprint(r["text"]) for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if first[i] == i}
    for r, (n, gone, kept) in zip(list(rows.values()), removed_by_windows([r["text"] for r in rows.values()], 35), strict=True):
        if n and gone == n:
            del rows[r["doc_id"]]
        elif gone:
            r["text"], r["n_chars"] = kept, len(kept)
    processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_trie.load_model())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    # The mix keeps every document.
    assert set(got) == set(rows) and len(got) > 100
    for i, r in got.items():
        assert (r["text"], r["n_chars"], r["source"]) == (rows[i]["text"], rows[i]["n_chars"], rows[i]["source"])
        assert r["ids"] == processor.encode(rows[i]["text"]) and r["n_tokens"] == len(r["ids"])


def test_stages_keep_columns_and_survive_edges(spark, edge_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge_docs, SF).columns == edge_docs.columns, name
        out = stage(spark, no_docs, SF)
        assert out.columns == no_docs.columns and out.count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, edge_docs, SF).count() == edge_docs.count() and last(spark, no_docs, SF).count() == 0


def test_the_order_of_the_mix_reaches_the_result(spark):
    """Files are read by their size, not in the order of the mix: the result tells it all the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").otherwise(F.col("source")))
    mixed = mixing.interleave(docs, mixing.tempered_weights(docs, power=0.9), block_rows=4)
    expected = [r["doc_id"] for r in mixed.select("doc_id", "mix.position").orderBy("position").collect()]
    written = materialize(corpus_pipeline.mix_sources(spark, docs, SF), "mixed")
    got = corpus_pipeline.encode_pieces(spark, written, SF).select("doc_id", "position").collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])] == expected
    assert sorted(r["position"] for r in got) == list(range(docs.count()))


def test_rows_of_no_file_and_taken_names_have_their_place(spark):
    docs = spark.range(0, 500, 1, 4).select(F.col("id").alias("doc_id"), F.lit("a").alias("position"), F.lit("b").alias("_file"))
    out = corpus_pipeline.in_order(docs)
    assert out.columns == ["doc_id", "position", "_file", "_position"]
    assert sorted((r["_position"], r["doc_id"]) for r in out.collect()) == [(i, i) for i in range(500)]
