"""Dictionaries of whole texts, and decisions against plain compression."""

import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from lodewell.llm import langid

SF = "/root/testdata/sf0.001"


def plain_size(content, text):
    """Bytes of a text, block by block, with a compressor made for each."""
    data = langid.normalize(text)

    def packed(block):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=6)
        return len(zstandard.ZstdCompressor(level=6, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block))

    total = 0
    for at in range(0, len(data), 4096):
        block = data[at : at + 4096]
        total += packed(block) if len(block) >= 512 else packed(content[-512:] + block) - packed(content[-512:])
    return total


def test_decisions_are_those_of_plain_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out("doc_id", 5, 0)), docs_per_language=8)
    rows = docs.select("doc_id", "text", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()
    # The dictionaries hold whole texts, of the least hash in each bucket.
    least = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            at = (r["lang"], r["h"] % 8)
            least[at] = min(least.get(at, (r["h"], r["text"])), (r["h"], r["text"]))
    for name, content in model.dictionaries:
        assert content == b" ".join(langid.normalize(t) for _, t in sorted(v for (lang, _), v in least.items() if lang == name))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for r in [r for r in rows if r["text"] and langid.has_letter(r["text"])][:60]:
        sizes = np.array([plain_size(content, r["text"]) for _, content in model.dictionaries], float)
        ordered = np.sort(sizes)
        mine = got[r["doc_id"]]
        assert mine["lang_pred"] == model.dictionaries[int(sizes.argmin())][0]
        assert abs(mine["margin"] - (ordered[1] - ordered[0]) / ordered[1]) < 1e-12 and mine["rejected"] == (mine["margin"] < 0.002)


def test_languages_of_short_texts_are_learnt(spark):
    swedish = ["jag vet inte vad du menar", "det var en gång en flicka", "hon gick genom skogen", "och så kom vargen fram", "vi ses i morgon då"]
    english = ["the quick brown fox jumped over the lazy dog and ran away into the woods beyond the river"] * 5
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([(t, "sv") for t in swedish * 10] + [(t, "en") for t in english * 10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, d string")
    model = langid.fit(docs)
    assert {name for name, _ in model.dictionaries} == {"sv", "en"}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang, _ in rows)


def test_repeated_keys_send_one_text(spark):
    docs = spark.range(5000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    assert langid.fit(docs).dictionaries == (("en", b"text number  "),)
    tiny = spark.createDataFrame([(1, "a", "x"), (2, "12", "y")], "doc_id int, text string, lang string")
    assert len(langid.identify(tiny, langid.fit(tiny)).collect()) == 2
