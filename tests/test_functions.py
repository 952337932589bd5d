from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodewell.functions import contracts
from lodewell.functions import text as T
from lodewell.functions.chunking import chunks, pieces, summary_first
from lodewell.functions.html import main_text
from lodewell.functions.json_repair import repair
from lodewell.functions.vectors import cosine


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_short_text_is_one_chunk():
    assert chunks("This is a short text.", 500, 50) == [{"chunk_number": 0, "chunk_text": "This is a short text.", "chunk_start": 0, "chunk_end": 21}]
    assert chunks("", 500, 50) == [] and chunks(None) == [] and chunks(" \n ") == []


def test_long_text_has_numbered_chunks():
    found = chunks("\n\n".join("word " * 30 for _ in range(3)), 100, 20)
    assert len(found) > 1 and [c["chunk_number"] for c in found] == list(range(len(found)))
    assert all(0 <= c["chunk_start"] < c["chunk_end"] for c in found)


@given(st.text(alphabet="ab. \n内", max_size=400), st.integers(5, 60), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_chunks_slice_back_and_cover(text, size, overlap):
    found = chunks(text, size, min(overlap, size - 1))
    assert "".join(pieces(text, size)) == text
    covered = set()
    for c in found:
        assert text[c["chunk_start"] : c["chunk_end"]] == c["chunk_text"] and len(c["chunk_text"]) <= size
        covered.update(range(c["chunk_start"], c["chunk_end"]))
    assert all(i in covered or text[i].isspace() for i in range(len(text)))


def test_summary_comes_first():
    found = summary_first(chunks("body " * 20, 500, 50), "short", 500)
    assert found[0]["chunk_text"].startswith("[摘要] short") and len(found) == 1
    own = summary_first(chunks("x" * 490, 500, 50), "short", 500)
    assert len(own) == 2 and own[0]["chunk_end"] == 0 and own[1]["chunk_number"] == 1


def test_main_text():
    page = "<html><head><style>x</style></head><body><nav>menu</nav><article><h1>Title</h1><p>One  two</p><script>bad()</script></article><footer>f</footer></body></html>"
    assert main_text(page) == "Title\nOne\ntwo"
    assert main_text("<div class='a content'>x &amp; y<br>z</div><p>no</p>") == "x & y\nz"
    assert main_text("") == "" and main_text(None) == "" and main_text("<p>open") == "open"


@pytest.mark.parametrize("broken, mended", [('{"a": "b', '{"a": "b"}'), ('{"a": [1, 2,', '{"a": [1, 2]}'), ('{"a": 1,}', '{"a": 1}'), ('{"a": "\\"', '{"a": "\\""}')])
def test_repair(broken, mended):
    assert repair(broken) == mended


@pytest.mark.parametrize("text", ['{"key": "value"}', '```json\n{"key": "value"}\n```', 'Here: {"key": "value"} done', '```\n{"key": "value"}\n```'])
def test_json_in_text(spark, text):
    assert one(spark, F.from_json(T.json_in_text(F.lit(text)), "key string")["key"]) == "value"


def test_hashes_and_defaults(spark):
    a, b = T.content_hash(F.lit(" Title"), F.lit("Desc ")), T.content_hash(F.lit("title"), F.lit("desc"))
    assert one(spark, a) == one(spark, b) and len(one(spark, a)) == 64
    assert one(spark, T.or_default(F.lit(0.0), 5.0)) == 5.0 and one(spark, T.or_default(F.lit(2.0), 5.0)) == 2.0
    assert one(spark, T.first_text(F.lit(""), F.lit(None), F.lit("x"))) == "x"


def test_weighted_score(spark):
    assert one(spark, T.weighted_score(F.lit(8.0), F.lit(7.0), F.lit(9.0))) == pytest.approx(7.9, rel=0.01)
    assert one(spark, T.weighted_score(F.lit(11.0), F.lit(7.0), F.lit(9.0))) is None
    with pytest.raises(ValueError):
        T.weighted_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), (0.5, 0.5, 0.5))


def test_query_words(spark):
    q = "latest  AI chip news 2024 2023-2025 from big labs today please"
    assert one(spark, T.fallback_query(F.lit(q))) == "latest AI chip news from big labs"
    assert one(spark, T.feed_name(F.lit("https://www.example.com/feed"))) == "example.com"


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert one(spark, cosine(v(1, 0, 0), v(1, 0, 0))) == 1.0
    assert one(spark, cosine(v(1, 0, 0), v(0, 1, 0))) == 0.0 and one(spark, cosine(v(0, 0), v(1, 1))) == 0.0


def test_parts_of_a_date_are_kept(spark):
    from lodewell.operators.ingest import recent

    rows = spark.createDataFrame([(1, datetime(2024, 1, 2)), (2, datetime(2023, 1, 1)), (3, None)], "id int, published_at timestamp")
    assert {r["id"] for r in recent(rows, F.lit(datetime(2024, 1, 2, 12)), 24).collect()} == {1, 3}


def test_prompts_say_what_they_need(spark):
    prompts = contracts.Prompts({"a": "{x} and {y}"})
    assert prompts.needs("a") == ["x", "y"] and one(spark, prompts.prompt("a", x=F.lit(1), y=F.lit(None), z=F.lit(3))) == "1 and "
    with pytest.raises(ValueError, match="needs y"):
        prompts.prompt("a", x=F.lit(1))
    with pytest.raises(KeyError, match="no prompt"):
        prompts.needs("b")
    with pytest.raises(ValueError, match="already"):
        prompts.register("a", "")
