import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodewell.operators import conversation, graph, ingest, listing, matching, merge, modularity, retrieval
from lodewell.operators.components import connected_components
from lodewell.operators.providers import Offline, Tools, complete
from lodewell.sources import rss
from lodewell.streaming import ingest as stream


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((30, 20), (200, 180), (40, 0)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(0, 0)] + [(1, k) for k in range(2, min(20, m))]
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        nodes = {x for a, b in pairs if a != b for x in (a, b)}
        got = connected_components(spark.createDataFrame([*pairs, (None, 3)], "src long, dst long"))
        assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in nodes}


def test_greedy_dedup_is_the_sequential_scan(spark):
    rng = random.Random(9)
    for _ in range(3):
        rows = [(i, f"h{rng.randrange(25)}", f"u{rng.randrange(25)}") for i in range(60)] + [(60, None, None), (61, None, "u99"), (62, None, None)]
        hashes, urls, kept = set(), {"u3"}, []
        for i, h, u in rows:
            if h not in hashes and u not in urls:
                hashes |= {h} - {None}
                urls |= {u} - {None}
                kept.append(i)
        df = spark.createDataFrame(rows, "i int, h string, u string")
        stored = spark.createDataFrame([("u3",)], "u string")
        assert sorted(r["i"] for r in ingest.first_seen(df, order="i", content="h", url="u", stored=stored).collect()) == kept


def test_merging_in_two_batches_equals_one(spark):
    kind = "canonical_name string, name string, type string, description string, article_ids array<int>, aliases array<string>, mention_count long"
    stored = spark.createDataFrame([("a", "A", "X", "old", [1, 2], ["A"], 2)], kind)
    batch = [("a", "a", "Y", "", [2, 3], ["a"], 1, 0), ("b", "B", "Z", "new", [4], [], 1, 1), ("a", "aa", "Y", "newer", [5], ["aa"], 1, 2)]
    got = {r["canonical_name"]: r for r in merge.merge_entities(stored, spark.createDataFrame(batch, kind + ", ordinal int")).collect()}
    assert (got["a"]["name"], got["a"]["type"], got["a"]["description"], got["a"]["mention_count"]) == ("A", "X", "newer", 4)
    assert got["a"]["article_ids"] == [1, 2, 3, 5] and got["a"]["aliases"] == ["A", "a", "aa"]
    assert got["b"]["description"] == "new" and got["b"]["aliases"] is None


def test_hybrid_counts_missing_ranks_as_a_thousand(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    texts = spark.createDataFrame([(2, "deep learning"), (3, "deep deep learning"), (4, "deep")], "id long, text string")
    rows = {r["id"]: r for r in retrieval.hybrid(vectors, texts, [1.0, 0.0], ["deep", "learning"], 10).collect()}
    assert rows[1]["rrf_score"] == pytest.approx(0.6 / 61 + 0.4 / 1060)
    assert rows[3]["rrf_score"] == pytest.approx(0.6 / 1060 + 0.4 / 61) and rows[3]["similarity"] == 0.0
    assert rows[2]["rrf_score"] == pytest.approx(0.6 / 62 + 0.4 / 62) and 4 not in rows


def test_best_matches_over_blocks(spark):
    rng = random.Random(2)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    a = spark.createDataFrame([(i, vec()) for i in range(40)] + [(99, None)], "id long, embedding array<double>")
    b = spark.createDataFrame([(i, vec()) for i in range(30)], "id long, embedding array<double>")
    key = lambda df: sorted((r["id"], r["match"], round(r["similarity"], 9)) for r in df.collect())
    assert key(matching.best_matches(a, b, threshold=0.5, block_rows=7)) == key(matching.best_matches(a, b, threshold=0.5))


def test_communities_cover_all_nodes(spark):
    edges = spark.createDataFrame([(1, 2, 3.0), (2, 3, 3.0), (1, 3, 3.0), (3, 4, 1.0), (4, 5, 3.0), (5, 6, 3.0), (4, 6, 3.0)], "source long, target long, weight double")
    nodes = spark.range(1, 8).toDF("id")
    got = {r["id"]: r["community"] for r in modularity.communities(edges, nodes).collect()}
    assert set(got) == set(range(1, 8)) and got[1] == got[2] == got[3] and got[4] == got[5] == got[6] and got[7] == 7
    assert {r["id"]: r["community"] for r in graph.components(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7}


def test_expansion_stops_on_an_empty_hop(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0)], "source long, target long, weight double")
    nodes = spark.createDataFrame([(i, [1.0, float(i)]) for i in (1, 2, 3)], "id long, embedding array<double>")
    members = spark.createDataFrame([(0, 1), (0, 3)], "community long, id long")
    found = graph.expand(edges, spark.createDataFrame([(1,)], "id long"), nodes, members, hops=5)
    assert [(r["id"], r["hop"]) for r in found.orderBy("hop").collect()] == [(2, 1), (3, 2)]


def test_pages(spark):
    rows = spark.range(10)
    got = listing.page(rows, 2, 4, F.desc("id")).collect()
    assert [(r["id"], r["total"], r["pages"]) for r in got] == [(5, 10, 3), (4, 10, 3), (3, 10, 3), (2, 10, 3)]
    assert [(r["id"], r["has_more"]) for r in listing.after(rows.withColumn("at", F.col("id") % 5), 2, (3, 8), "at", "id").collect()] == [(3, True), (7, True)]


def test_route(spark):
    cases = [
        ((False, "r", 0.7, 0), "explainer"), ((False, "r", 0.6, 9), "researcher"), ((None, "r", 0.9, 0), "fact_checker"), ((True, "r", 0.1, 0), "end"),
        ((None, "", 0.7, 0), "explainer"), ((None, None, 0.0, 4), "researcher"), ((None, None, 0.0, 5), "explainer"), ((None, None, None, 0), "researcher"),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, passed boolean, response string, completeness double, research int")
    got = df.orderBy("i").select(conversation.route(F.col("passed"), F.col("response"), F.col("completeness"), F.col("research"))).collect()
    assert [r[0] for r in got] == [expected for _, expected in cases]


def test_providers_isolate_failures(spark):
    class Picky(Offline):
        def complete(self, prompt):
            if "bad" in prompt:
                raise OSError("down")
            return super().complete(prompt)

    df = spark.createDataFrame([(1, "good prompt", "x"), (2, "bad prompt", "y"), (3, None, "z")], "id int, prompt string, answer string")
    got = {r["id"]: r for r in complete(df, "prompt", Picky).collect()}
    assert got[1]["_answer"] and got[1]["error"] is None and got[1]["answer"] == "x"
    assert got[2]["_answer"] is None and got[2]["error"].startswith("OSError") and got[3]["_answer"]


def test_tools(spark):
    tools = Tools()
    tools.register("count", lambda df: df.groupBy().count())
    assert tools.run("count", spark.range(3)).first()[0] == 3
    with pytest.raises(KeyError, match="no tool"):
        tools.run("other")


FEED = """<rss><channel><item><title>T</title><link>http://a/1</link><description>D</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>
<item><title>no link</title></item></channel></rss>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "ok.xml").write_text(FEED)
    (tmp_path / "bad.xml").write_text("<rss><item>")
    found, errors = rss.read_landed(spark, str(tmp_path))
    rows = rss.parse_entries(found).collect()
    assert [(r["source_url"], r["original_title"], str(r["published_at"])) for r in rows] == [("http://a/1", "T", "2024-01-02 03:04:05")]
    assert len(rows[0]["content_hash"]) == 64 and errors.count() == 1


def test_fetch_retries_network_errors_only():
    import io
    import urllib.error

    calls, waits = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.URLError("down")
        return io.BytesIO(b"body")

    assert rss.fetch("u", opener=opener, sleep=waits.append) == "body" and waits == [1.0, 2.0]

    def refused(url, timeout):
        calls.append(url)
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    n = len(calls)
    with pytest.raises(urllib.error.HTTPError):
        rss.fetch("u", opener=refused, sleep=waits.append)
    assert len(calls) == n + 1


def test_stream_keeps_the_first_of_a_key(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"url": "a", "at": "2024-01-01T00:00:00"}', '{"url": "b", "at": "2024-01-01T00:01:00"}', '{"url": "a", "at": "2024-01-01T00:02:00"}']
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    rows = stream.first_seen_stream(stream.landed(spark, str(tmp_path / "in"), "url string, at timestamp"), when="at", keys=["url"])
    stream.run_once(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_small_batches_leave_the_session_alone(spark):
    from lodewell.sources.tables import small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    df = spark.range(25, numPartitions=1).selectExpr("id", "id AS `a b`", "cast(id AS string) AS C")
    out = small_batches(df, records=10)
    sizes = out.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert sorted(r[0] for r in sizes.collect()) == [5, 10, 10]
    assert out.columns == df.columns and sorted(out.collect()) == sorted(df.collect())
    assert spark.conf.get(name) == before and spark.catalog.listTables("global_temp") == []
    assert small_batches(df.where("false")).count() == 0


def test_matches_of_clusters_visit_few_lists_and_lose_none(spark):
    rng = random.Random(7)
    centres = [[5 * rng.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    near = lambda c: [v + rng.gauss(0, 0.3) for v in centres[c]]
    stored = [(i, near(i % 10)) for i in range(300)] + [(300 + i, centres[0]) for i in range(200)] + [(900, [1.0, 2.0]), (901, None)]
    new = [(i, near(i % 10)) for i in range(100)] + [(100, [2.0, 4.0]), (101, [float("nan")] * 8), (102, [1.0] * 5)]
    a, b = (spark.createDataFrame(rows, "id long, embedding array<double>") for rows in (new, stored))
    got = {r["id"]: (r["match"], r["similarity"]) for r in matching.best_matches(a, b, threshold=0.9, block_rows=40).collect()}

    def cosine(x, y):
        return sum(p * q for p, q in zip(x, y, strict=True)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5

    for i, x in new[:100]:
        best = max((cosine(x, y), -j) for j, y in stored[:500])
        assert (i in got) == (best[0] >= 0.9) and (i not in got or (got[i][0], got[i][1]) == (-best[1], pytest.approx(best[0])))
    assert got[100] == (900, pytest.approx(1.0)) and not {101, 102} & set(got)
