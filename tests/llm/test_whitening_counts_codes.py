"""Whitening, token counts and vector codes against plain versions."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodewell.llm import kdtree_codes, queries, token_counts, whitening

SF_DIR = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, code string, n string, component string, x string, k string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, label, *"abcde") for k, v, label in rows], VECTORS)


def random_rows(n, d, seed=3, ranks=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * (np.arange(d, 0, -1) if ranks is None else ranks)
    return [(i, [float(v) for v in row], i % 3 if i % 7 else None) for i, row in enumerate(x)]


ODD = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 32, 0), (903, [float("inf")] * 32, 0), (904, [], 0), (905, [1.0, 2.0], 0)]


# Whitening


def plain_whitening(x):
    x = np.floor(1024 * x.astype(np.float64)) + 100000
    n = len(x)
    y = (n * x - x.sum(axis=0)) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return y @ vectors / np.sqrt(values), values / np.trace(y.T @ y / n), ((n * x - x.sum(axis=0)).astype(np.int64).astype(object) ** 2).sum(axis=1)


def check_whitening(out, keys, x):
    z, explained, deviation = plain_whitening(x)
    out = out.toPandas().sort_values(["vec_id", "component"], kind="stable")
    got = out["whitened"].to_numpy().reshape(len(keys), -1)
    z = z[np.argsort(keys, kind="stable")][:, : got.shape[1]]
    assert sorted(out["vec_id"]) == sorted(np.repeat(keys, got.shape[1]))
    sign = np.sign((got * z).sum(axis=0))
    assert np.abs(got - z * sign).max() < 1e-7
    assert np.allclose(out["explained"].to_numpy().reshape(len(keys), -1)[0], explained[: got.shape[1]], rtol=1e-9)
    assert (out["n"] == len(keys)).all() and (out["identity_error"] <= 1e-9).all()
    assert (out.groupby("vec_id")["deviation"].first().to_numpy() == deviation[np.argsort(keys, kind="stable")].astype(np.int64)).all()


def test_whitening_equals_the_eigenvectors_of_the_table(spark):
    kept = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").toPandas()
    check_whitening(queries.op11_whitening(spark, SF_DIR), kept["vec_id"].to_numpy(), np.stack(kept["embedding"]))


def test_power_passes_suffice_where_the_spectrum_falls_and_full_dimension_follows_where_not(spark):
    for ranks, full in ((0.5 ** np.arange(32) * 100, False), (np.ones(32), True)):
        rows = random_rows(400, 32, ranks=ranks)
        df = frame(spark, rows + ODD)
        kept = df.where(F.col("vec_id") < 900).select(F.col("embedding").alias("x"))
        x = np.array([r[1] for r in rows], np.float32)
        numbers = np.floor(1024 * x.astype(np.float64)).astype(np.int64) + 100000
        model = whitening.fit(kept, whitening.Centre(400, numbers.sum(axis=0)))
        assert model.full is full and model.passes <= 4
        check_whitening(whitening.whiten(df), np.arange(400), x)


def test_whitening_edges(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, ODD[:1])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.25], 1)])).count() == 0  # one row has no variance
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.25], 1)] * 9)).count() == 0
    flat = whitening.whiten(frame(spark, [(i, [float(i), 1.0, 0.0], 1) for i in range(5)])).toPandas()
    assert set(flat["component"]) == {1} and flat["explained"].iloc[0] == pytest.approx(1.0)
    rows = random_rows(50, 12)
    twice = whitening.whiten(frame(spark, [*rows, rows[0], (None, rows[1][1], 1)]))
    assert twice.where("vec_id = 0").count() == 16 and twice.where("vec_id IS NULL").count() == 8
    assert set(twice.columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    with pytest.raises(Exception, match="reaches"):
        whitening.whiten(frame(spark, [(1, [1e30, 1.0], 1), (2, [1.0, 2.0], 1)])).count()


def test_deviations_are_exact_and_null_beyond_a_long():
    x = np.array([[100000, 7], [99000, 9]], np.int64)
    assert whitening.Centre(2, x.sum(axis=0)).deviations(x) == [1000**2 + 4, 1000**2 + 4]
    assert whitening.Centre(10**12, np.array([0, 0])).deviations(x) == [None, None]
    assert whitening.Centre(10**13, 10**13 * x[0] - 5).deviations(x) == [50, None]


# Token counts


@pytest.fixture(scope="module")
def tokenizer():
    spec, classes = token_counts.load_tokenizer()
    return token_counts.Counter(spec, classes), Tokenizer.from_str(spec)


def counts(counter, texts):
    encoded = [t.encode() for t in texts]
    return counter.count(b"".join(encoded), np.append(0, np.cumsum([len(t) for t in encoded])).astype(int).tolist()).tolist()


def library(reference, texts):
    return [len(e.ids) for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library_on_random_texts(tokenizer):
    rng = random.Random(5)
    make = lambda alphabet, n, most: ["".join(rng.choice(alphabet) for _ in range(rng.randrange(most))) for _ in range(n)]
    texts = make("abe lrvstm'd  \n\t.,1289é中あ 　\x85!-́\U0001f600٣", 4000, 60) + make("'srevl td", 4000, 20)
    texts += make("abcdefghijklmnopqrstuvwxyz", 20, 3000) + make(["<|endoftext|>", "<|endof", "text|>", " ", "a", "'", "s"], 500, 12)
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(200)) for _ in range(100)]
    assert counts(tokenizer[0], texts) == library(tokenizer[1], texts)


def test_counts_of_very_long_and_repetitive_texts(tokenizer):
    texts = [c * n for c in "a -=1\n'中" for n in (1, 255, 256, 257, 5003, 300_000)] + ["ab" * 40_000, "the sea " * 300_000, "don't " * 50_000 + "\n" * 700]
    assert counts(tokenizer[0], texts) == library(tokenizer[1], texts)


def test_counts_do_not_depend_on_chunks_blocks_or_the_number_of_states_kept(tokenizer):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["alpha", "beta", "x9", " ", " ", "'ll", "\n", "zq" * 30]) for _ in range(400)) for _ in range(60)]
    expected = library(tokenizer[1], texts)
    small = token_counts.Counter(*token_counts.load_tokenizer())
    small.BLOCK, small.words.CHUNK, small.tokens.CHUNK, small.tokens.most_states = 500, 7, 3, 50
    assert counts(small, texts) == expected


def test_maps_of_chunks_compose_as_one_machine_reads(tokenizer):
    words = tokenizer[0].words
    codes = np.array([ord(c) for c in "we'll  go'r on \n 12'd"] * 40)
    state, begins = token_counts.BETWEEN, np.zeros(len(codes), bool)
    for i, kind in enumerate(words.kinds[codes].tolist()):
        state, marks = token_counts._word_step(state, kind)
        begins[i] |= bool(marks & token_counts.HERE)
        if marks & token_counts.BEFORE:
            begins[i - 1] = True
        if marks & token_counts.NOT_BEFORE:
            begins[i - 1] = False
    assert (words.begins(codes, np.array([0])) == begins).all()


def test_token_counts_of_the_table(spark, tokenizer, small_docs, edge_docs, no_docs):
    df, pdf = small_docs
    out = queries.op12_token_counts(spark, SF_DIR).toPandas().set_index("doc_id").loc[pdf["doc_id"]]
    texts = [t or "" for t in pdf["text"]]
    assert out["n_tokens"].tolist() == library(tokenizer[1], texts) and out["n_bytes"].tolist() == [len(t.encode()) for t in texts]
    assert (out["over_limit"] == (out["n_tokens"] > 512)).all()
    odd = token_counts.token_counts(edge_docs)
    assert odd.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = [(r["doc_id"], r["text"] or "") for r in edge_docs.collect()]
    expected = sorted(zip((k if k is not None else -1 for k, _ in rows), library(tokenizer[1], [t for _, t in rows]), strict=True))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in odd.collect()) == expected
    assert token_counts.token_counts(no_docs).count() == 0


# Vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Codes, errors and books by all distances, in Python's integers."""
    rows = sorted(rows, key=lambda r: r[0])
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v, _ in rows]
    width = len(x[0]) // parts
    cut = lambda v, m: v[m * width : (m + 1) * width]
    books = [[cut(v, m) for v in x[:entries]] for m in range(parts)]
    nearest = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for m in range(parts):
            groups = {}
            for v in x:
                groups.setdefault(nearest(cut(v, m), books[m])[1], []).append(cut(v, m))
            for e, members in groups.items():
                books[m][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [[nearest(cut(v, m), books[m]) for m in range(parts)] for v in x]
    return [(r[0], "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for r, f in zip(rows, found, strict=True)], books


def test_vector_codes_equal_all_distances_with_ties(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-3, 4) / 256 for _ in range(32)], rng.choice([1, 2, None])) for i in range(150)]  # full of ties
    out = kdtree_codes.compress(frame(spark, rows + ODD)).toPandas().sort_values("vec_id")
    expected, books = plain_codes(rows)
    assert list(zip(out["vec_id"], out["code"], out["error"], strict=True)) == expected
    by_label = {}
    for (_, _, label), (_, _, error) in zip(rows, expected, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    assert out["label_error"].tolist() == [by_label[r[2]] for r in rows]
    assert out["codebooks_sha256"].nunique() == 1 and out["codebooks_sha256"].iloc[0] == kdtree_codes.Codebooks(np.array(books)).sha256


def test_vector_codes_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    expected = con.execute(queries.ORACLE_SQL["op13_vector_codes"]).df().sort_values("vec_id")
    got = queries.op13_vector_codes(spark, SF_DIR).toPandas().sort_values("vec_id")[expected.columns]
    assert (got.to_numpy() == expected.to_numpy()).all()


def test_a_tree_finds_the_nearest_entry_and_of_ties_the_lowest():
    rng = np.random.default_rng(1)
    for width, spread in ((1, 4), (2, 3), (4, 30)):
        entries, q = rng.integers(-spread, spread, (64, width)), rng.integers(-2 * spread, 2 * spread, (500, width))
        index, d = kdtree_codes.KdTree(entries, leaf=2).nearest(q)
        every = ((q[:, None] - entries[None]) ** 2).sum(-1)
        assert (index == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def test_vector_codes_edges(spark):
    assert kdtree_codes.compress(frame(spark, [])).count() == 0
    assert kdtree_codes.compress(frame(spark, [ODD[0], ODD[4]])).count() == 0
    same = kdtree_codes.compress(frame(spark, [(1, [0.5] * 16, None)] * 5 + [(None, [0.0] * 16, None)])).toPandas()
    assert len(same) == 6 and (same["error"] == 0).all() and same["code"].nunique() == 2
    with pytest.raises(ValueError, match="do not divide"):
        kdtree_codes.compress(frame(spark, [(1, [0.5] * 10, None)]))
    with pytest.raises(Exception, match="reaches"):
        kdtree_codes.compress(frame(spark, [(1, [1e9] * 16, None)])).count()
