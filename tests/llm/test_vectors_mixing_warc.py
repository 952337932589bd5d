"""Mixing, archives and vectors against brute force, and on the edges of their input."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.llm import additive, mixing, queries, range_join, warc_zip
from lodewell.sources.tables import scratch_path

# Mixing


def test_mixing_places_every_row(spark):
    rows = [(i, "ab"[i % 5 == 0], "x") for i in range(1000)] + [(None, "a", "n"), (5000, None, "n"), (7, "b", "x"), (6000, "w", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix string")
    out = mixing.interleave(docs, {"a": 0.75, "b": 0.25, "w": 0}, block_rows=8, bucket_rows=50)
    assert out.columns == ["doc_id", "source", "mix", "_mix"] and out.count() == len(rows)
    mixed = out.where("_mix.in_mix").select("source", "_mix.*").orderBy("position").collect()
    assert len(mixed) == 1002 and {r["slot"] for r in mixed} == set(range(101 + 26))
    for n in range(8, 8 * 100, 8):  # until b runs out
        share = sum(r["source"] == "a" for r in mixed[:n]) / 8
        assert abs(share - 0.75 * n / 8) < 1
    assert out.where("source IS NULL OR source = 'w'").where("_mix.in_mix OR _mix.slot IS NOT NULL").count() == 0


def test_mixing_edges(spark, edge_docs, no_docs):
    assert mixing.interleave(no_docs, {}).count() == 0 and mixing.interleave(no_docs, {"a": 1}).count() == 0
    out = mixing.interleave(edge_docs, mixing.tempered_weights(edge_docs), block_rows=1)
    assert out.count() == edge_docs.count() and out.columns == [*edge_docs.columns, "_mix"]
    assert out.where("_mix.in_mix").count() == edge_docs.count()
    assert mixing.interleave(edge_docs, {}).where("_mix.in_mix").count() == 0


# Archives


def test_archives_against_the_pages(spark):
    pages = spark.createDataFrame(
        [(3, "http://a", "x" * 200), (1, "http://b", "x" * 200), (2, None, "x" * 200), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u\r\nv", ""), (None, "u", "x" * 200), (8, "u", "é\r\n\r\n" * 50), (3, "http://a", "x" * 200)],
        "page_id long, url string, html string",
    )
    archives = warc_zip.write_archives(pages, scratch_path(spark, "t"), archive_bytes=500)
    assert archives.count() > 1
    rows = warc_zip.read_archives(archives, payloads=True).collect()
    assert len(rows) == 10
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows if r["page_id"] is not None)
    assert kinds == [(1, "response", None, 200), (2, "revisit", 1, 200), (3, "revisit", 1, 200), (3, "revisit", 1, 200), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (7, "response", None, 0), (8, "response", None, 300)]
    assert {r["payload"] for r in rows if r["page_id"] == 8} == {("é\r\n\r\n" * 50).encode()} and {r["url"] for r in rows if r["page_id"] == 7} == {"u v"}
    assert warc_zip.round_trip(pages.limit(0)).count() == 0
    assert sorted(map(str, warc_zip.read_archives(archives, payloads=True, task_bytes=300).collect())) == sorted(map(str, rows))
    more = pages.limit(3).selectExpr("page_id", "url", "repeat(html, 100000) AS html", "1 AS payload", "2 AS digest", "3 AS refers_to", "4 AS first", "5 AS page")
    assert sorted((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in warc_zip.round_trip(more).collect()) == [(1, 20_000_000, None), (2, 20_000_000, 1), (3, 20_000_000, 1)]


def reader(data):
    return lambda at, n: data[at : at + n]


def test_zip64_directories_are_read():
    """The same archive with its sizes, offsets and counts moved to ZIP64 records."""
    data = warc_zip.archive([warc_zip.record(1, "u", b"payload", warc_zip.hashlib.sha256(b"payload").hexdigest(), None)])
    members = warc_zip.directory(reader(data), len(data))
    begin = data.index(warc_zip.CENTRAL)
    central = b""
    for name, m in members.items():
        extra = struct.pack("<HHQQQ", 1, 24, m.size, m.stored, m.header)
        central += warc_zip.CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(b""), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name.encode() + extra
    end64 = warc_zip.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), len(central), begin)
    locator = warc_zip.LOCATOR64 + struct.pack("<IQI", 0, begin + len(central), 1)
    end = warc_zip.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 4) + b"note"
    wide = data[:begin] + central + end64 + locator + end
    assert warc_zip.directory(reader(wide), len(wide)) == members
    assert [r["payload"] for r in warc_zip.read_archive(reader(wide), len(wide))] == [b"payload"]


def test_neighbours_are_read_together():
    payloads = [bytes([65 + i]) * (50 * i + 1) for i in range(20)]
    data = warc_zip.archive([warc_zip.record(i, "u", p, warc_zip.hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)])
    for most in (1, 900, 1 << 20):
        asked = []
        got = list(warc_zip.read_archive(lambda at, n, asked=asked: (asked.append(n), data[at : at + n])[1], len(data), most))
        assert [r["payload"] for r in got] == payloads and len(asked) == {1: 25, 1 << 20: 6}.get(most, len(asked))
        assert max(asked[5:]) <= max(most, 1500)


def test_damaged_archives_are_refused():
    data = warc_zip.archive([warc_zip.record(1, "u", b"payload", "0" * 64, None)])
    with pytest.raises(ValueError, match="digest"):
        list(warc_zip.read_archive(reader(data), len(data)))
    with pytest.raises(ValueError, match="no end"):
        warc_zip.directory(reader(data[:-30]), len(data) - 30)


# Vectors

BAD = [(900, None, 1), (901, [0.0] * 6, 1), (902, [1.0, float("nan")] * 3, 1), (903, [1.0, None] * 3, 1), (904, [float("inf")] + [1.0] * 5, 1), (905, [1.0] * 6, None), (906, [], 1), (907, [1.0, 2.0], 1), (None, [5.0] * 6, 2)]


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, copies, multiples and repeated rows; then what links with nothing."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=6)
        for _ in range(15):
            rows.append((len(rows), [float(np.float32(v)) for v in centre + rng.normal(size=6) * 0.2], int(c % 3)))
    rows += [(200 + i, rows[0][1], 0) for i in range(20)] + [(250, [2 * v for v in rows[5][1]], rows[5][2]), rows[7], rows[7]]
    return spark.createDataFrame(rows + BAD, "vec_id long, embedding array<float>, label int"), rows


@pytest.mark.parametrize("sizes", [{}, {"part_rows": 10, "unit_rows": 7}, {"part_rows": 25, "unit_rows": 1000}])
def test_range_join_against_brute_force(spark, vectors, sizes):
    df, rows = vectors
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    low = np.array([r[0] for r in rows])
    while True:
        after = np.array([min([low[i], *low[near[i]]]) for i in range(len(rows))])
        if (after == low).all():
            break
        low = after
    expected = sorted((r[0], int(near[i].sum()), int(low[i]), r[0] == low[i]) for i, r in enumerate(rows))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in range_join.near_vectors(df, **sizes).collect()]
    assert sorted(g for g in got if g[0] is not None and g[0] < 900) == expected and sum(e[1] for e in expected) > 300
    assert sorted(g for g in got if g[0] is not None and g[0] >= 900) == [(i, 0, i, True) for i in range(900, 908)]
    assert [g for g in got if g[0] is None] == [(None, 0, None, False)]


@pytest.mark.parametrize("dimension,n", [(2, 40), (3, 300), (8, 1500)])
def test_pivots_lose_no_link(dimension, n):
    """Cells, visitors and planes against the plain product, at every number of vectors; some cells are left out."""
    rng = np.random.default_rng(n)
    x = range_join.units(np.repeat(rng.normal(size=(n // 5, dimension)), 5, axis=0) + rng.normal(size=(n // 5 * 5, dimension)) * 0.1)
    near = x @ x.T >= 0.93
    met = [(int(a), int(b)) for i, j in range_join.links_within(x, None, 0.93) for a, b in zip(i, j, strict=True)]
    assert len(met) == len(set(map(frozenset, met))) and set(map(frozenset, met)) == {frozenset(map(int, p)) for p in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
    left, right = x[::2], x[1::2]
    met = [(int(a), int(b)) for i, j in range_join.links_within(left, right, 0.93) for a, b in zip(i, j, strict=True)]
    assert sorted(met) == sorted((int(a), int(b)) for a, b in zip(*np.nonzero(left @ right.T >= 0.93), strict=True))
    pivots = range_join.Pivots(x[:: max(1, n // 10)], range_join.reach_of(0.93))
    assert sum(len(at) for at, _, _ in pivots.route(x)) < len(x) * len(pivots.x)


def test_very_large_and_small_components(spark):
    rows = [(1, [1e200, 1.0], 1), (2, [1e200, 2.0], 1), (3, [1e-200, 1e-200], 1), (4, [3e-200, 3e-200], 1), (5, [1e-200, -1e-200], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in range_join.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_range_join_of_nothing(spark, vectors):
    assert range_join.near_vectors(vectors[0].limit(0)).count() == 0


def test_recall_of_nearest(spark):
    sf = "/root/testdata/sf0.1"
    frame = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(frame.embedding).astype(np.float64), frame.vec_id.to_numpy()
    got = additive.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("k") % 20 == 0, pool=60, candidate_rows=500, query_rows=30).toPandas()
    hit = 0
    for q in range(0, len(ids), 20):
        score = x @ x[q]
        best = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and list(mine.score) == sorted(mine.score, reverse=True)
        hit += len(set(ids[best]) & set(mine.vec_id))
    assert hit / (20 * math.ceil(len(ids) / 20)) >= 0.9


def test_nearest_edges(spark, vectors):
    df, rows = vectors
    got = additive.nearest(df, F.col("k") % 50 == 0, k=5).toPandas()
    by = {r[0]: np.array(r[1], np.float32).astype(np.float64) for r in rows}
    assert set(got.query_id) == {i for i in by if i % 50 == 0}
    for q, mine in got.groupby("query_id"):
        every = sorted(((-float(np.dot(by[q], np.array(r[1], np.float32))), r[0]) for r in rows if r[0] != q))[:5]
        assert [v for _, v in every] == list(mine.sort_values("rank").vec_id)
        assert q not in set(mine.vec_id)
    assert additive.nearest(df.limit(0), F.col("k") % 50 == 0).count() == 0
    few = additive.nearest(df.where("vec_id < 4"), F.col("k") == 0)
    assert few.count() == 3
    named = df.selectExpr("vec_id", "embedding", "1 AS k", "2 AS x", "3 AS rep", "4 AS score", "5 AS query")
    assert sorted(map(tuple, additive.nearest(named, F.col("k") % 50 == 0, k=5).collect())) == sorted(tuple(r) for r in got.itertuples(index=False))
    # Very many copies of one vector displace no other.
    copies = spark.range(3000).selectExpr("id + 10000 AS vec_id", "array(1.0F, 0.0F, 0.0F, 0.0F, 0.0F, 0.0F) AS embedding")
    far = spark.createDataFrame([(1, [2.0] + [0.0] * 5), (2, [1.5, 0.1] + [0.0] * 4)], "vec_id long, embedding array<float>")
    best = {}
    for r in additive.nearest(copies.union(far), F.col("k").isin(2, 10000, 10007), k=3, pool=2).collect():
        best.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(best[2]) == [(1, 1, 3.0), (2, 10000, 1.5), (3, 10001, 1.5)]
    assert sorted(best[10000]) == [(1, 1, 2.0), (2, 2, 1.5), (3, 10001, 1.0)] and sorted(best[10007]) == [(1, 1, 2.0), (2, 2, 1.5), (3, 10000, 1.0)]


def test_queries_are_whole(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES["op10_nearest"](spark, sf).count() == 25 * 20
    assert queries.QUERIES["op3_source_mixing"](spark, sf).count() == 200
