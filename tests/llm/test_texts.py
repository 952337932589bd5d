"""The text operators against brute force, and on the edges of their input."""

import hashlib
import re
from collections import Counter

import ahocorasick
import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodewell.llm import langid, license, queries, sentencepiece_trie, simhash, substring, toxicity

SF = "/root/testdata/sf0.01"


def groups_of(prints: dict) -> dict:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    spans = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def removed_by_windows(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = b"\1" * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


# Language ID


def test_language_accuracy_on_held_out_rows(spark):
    got = queries.QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert 100 < len(held) < 300 and (held.lang_pred == held.lang).mean() > 0.97


def test_language_edges(spark, edge_docs, no_docs):
    model = langid.fit(edge_docs)
    assert langid.fit(no_docs).dictionaries == ()
    rows = langid.identify(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    for i in (0, 1, 2, 5):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"]
    assert langid.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edge_docs, langid.fit(no_docs)).collect()} == {"und"}


def test_equal_sizes_are_rejected():
    scorer = langid.LanguageModel((("a", b"same text here"), ("b", b"same text here"))).scorer()
    assert scorer.decide("some words") == ("a", 0.5, 0.0, True)


# SimHash


def test_simhash_against_brute_force(spark, small_docs):
    df, frame = small_docs
    prints = {i: plain_fingerprint(t) for i, t in zip(frame.doc_id, frame.text, strict=True)}
    expected = groups_of(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.groups(df).collect()}
    assert got == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def test_simhash_edges(spark, edge_docs, no_docs):
    rows = simhash.groups(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by[i]["component_id"] for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 3, 3] and by[0]["fingerprint"] == "0" * 16
    kept = simhash.deduplicate(edge_docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == edge_docs.columns and ids.count(3) == 1 and 4 not in ids and 1 not in ids and ids.count(None) == 2
    assert simhash.groups(no_docs).count() == 0 and simhash.deduplicate(no_docs).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(1, 12), st.randoms())
@settings(max_examples=60, deadline=None)
def test_tree_meets_every_pair_once(values, leaves, rng):
    near = [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for v in values]
    points = np.unique(np.array(values + near, dtype=np.uint64))
    tree = simhash.build_tree(points, leaves)
    members, met = {}, Counter()
    for at, leaf, home in tree.route(points):
        members.setdefault(leaf, []).extend((int(p), home) for p in at)
    assert sorted(p for some in members.values() for p, home in some if home) == list(range(len(points)))
    for some in members.values():
        for p, home in some:
            for q, other in some:
                if other and (p < q if home else True) and simhash.distance(points[p : p + 1], points[q])[0] <= 3:
                    met[min(p, q), max(p, q)] += 1
    pairs = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if bin(int(points[i]) ^ int(points[j])).count("1") <= 3}
    assert set(met) == pairs and set(met.values()) <= {1}


# Substring dedup


def ahocorasick_of_nothing():
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    automaton.add_word((2**31,), 0)
    automaton.make_automaton()
    return automaton


@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=50), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_passages_cover_what_recurs(documents):
    """The phrase and window logic of one shard, with short windows and few words so that much recurs."""
    texts = [" ".join(d).encode() for d in documents]
    docs = substring.Passages(texts, window=5, phrase=2)
    at = np.flatnonzero(docs.valid)
    one, two = docs.windows(at)
    counts = Counter(zip(one.tolist(), two.tolist(), strict=True))
    again = np.array([counts[p] > 1 for p in zip(one.tolist(), two.tolist(), strict=True)], bool)
    value, first, second = docs.least[at[again]], one[again], two[again]
    # Every phrase is named with some document that holds it, by its number.
    rows, places = np.arange(len(texts)) * 10, {}
    for p in np.flatnonzero(docs.document[: len(docs.phrases)] == docs.document[1 : len(docs.phrases) + 1]) if len(docs.phrases) else []:
        places[int(docs.phrases[p])] = int(docs.document[p])
    named = np.unique(value)
    row = np.array([rows[places[int(v)]] for v in named] + [0] * len(value), np.int64)
    kind = np.array([substring.ENTRY_PHRASE] * len(named) + [substring.ENTRY_WINDOW] * len(value))
    none = np.zeros(len(named), np.uint64)
    entries = (kind, np.concatenate([named, value]), row, np.concatenate([none, first]), np.concatenate([none, second]))
    gone = substring.covered_words(docs, rows, *entries)
    expected = removed_by_windows([t.decode() for t in texts], 5)
    assert [int(gone[a:b].sum()) for a, b in zip(docs.starts[:-1], docs.starts[1:], strict=True)] == [e[1] for e in expected]
    # The automaton alone locates: an empty one finds nothing, and hits that are left out are not removed.
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(substring, "_automaton", lambda phrases: ahocorasick_of_nothing())
        assert not substring.covered_words(docs, rows, *entries).any()
    # Every recurring window lies under a phrase whose runs say so.
    doc, values, segments, often = docs.runs()
    total = Counter()
    for v, n in zip(values.tolist(), often.tolist(), strict=True):
        total[v] += n
    assert all(total[int(v)] > 1 for v in docs.least[at[again]])


def test_substring_against_brute_force(spark, small_docs):
    df, frame = small_docs
    expected = dict(zip(frame.doc_id, removed_by_windows(frame.text, 35), strict=True))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.strip_repeats(df).collect()}
    assert got == expected and sum(e[1] for e in expected.values()) > 0
    rewritten = {r["doc_id"]: r for r in substring.rewrite(df).collect()}
    for i, t in zip(frame.doc_id, frame.text, strict=True):
        n, gone, kept = expected[i]
        if gone == n and n:
            assert i not in rewritten
        else:
            assert rewritten[i]["text"] == (kept if gone else t) and rewritten[i]["n_chars"] == len(rewritten[i]["text"])


def test_passages_of_one_phrase_and_any_surroundings(spark):
    """A phrase that very many different surroundings share, and one document many times over."""
    shared = " ".join(f"boilerplate{i}" for i in range(40))
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) + " " + shared + " " + " ".join(f"v{i}y{j}" for j in range(30)) for i in range(60)]
    texts += ["the same document " + " ".join(f"d{j}" for j in range(50))] * 40 + [shared]
    docs = spark.createDataFrame([(1, t, "x", 0, 0) for t in texts], "doc_id long, text string, value string, _n int, row int")
    expected = removed_by_windows(texts, 35)
    got = substring.strip_repeats(docs, shard_bytes=500, min_shards=1).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted(expected)
    out = substring.rewrite(docs, shard_bytes=500)
    assert out.columns == docs.columns and sorted(r["text"] for r in out.collect()) == sorted(k for n, g, k in expected if g < n)


def test_substring_edges(spark, edge_docs, no_docs):
    rows = substring.strip_repeats(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["n_words"] for i in (0, 1, 2, 3)] == [0, 0, 0, 1] and by[0]["kept"] == ""
    assert by[6]["n_words"] == 30000 and by[6]["n_removed"] == 30000  # it repeats itself throughout
    out = substring.rewrite(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count() - 1
    assert substring.strip_repeats(no_docs).count() == 0 and substring.rewrite(no_docs).count() == 0


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    got = queries.QUERIES["op5_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.8 and (clean.predicted == 0).mean() > 0.9


def test_disguises_are_restored():
    words = b"the loser is a stupid idiot and this trash is disgusting, pathetic and worthless. " * 50
    restore = toxicity.Restorer(toxicity.CharacterModel.of(toxicity.count_trigrams([words])))
    for disguised, plain in {"l0ser": "loser", "stup1d": "stupid", "s t u p i d": "stupid", "looooser": "loser", "tr@sh": "trash", "$tupid": "stupid"}.items():
        assert restore(f"you {disguised}\nok") == f"you {plain}\nok"
    assert restore("nothing to see, 24 of them!!") == "nothing to see, 24 of them!!" and restore("") == ""


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (7, 0), (8, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit(edge_docs, labels)
    rows = toxicity.classify(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = toxicity.fit(no_docs, labels.limit(0))
    assert toxicity.classify(no_docs, empty).count() == 0 and toxicity.classify(edge_docs, empty).count() == edge_docs.count()


# Licenses


def test_license_base_columns_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_license_scan"](spark, SF).collect()}
    found = 0
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(a, label) for p, label in license.BASE_PHRASES.items() for a in range(len(words)) if words[a : a + len(p.split())] == p.split()]
        starts = [a for a, _ in places]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        found += bool(places)
    assert found > 5


def test_templates():
    t = license.compile_template("x", "released [[at last]] under <<2>> terms")
    words = lambda s: s.encode().split()
    for text, end in {"released under terms": 3, "released at last under the terms": 6, "released under a b terms": 5}.items():
        assert t.match(words(text), 0) == end
    for text in ("released at under terms", "released under a b c terms", "released under", "release under terms"):
        assert t.match(words(text), 0) is None
    with pytest.raises(ValueError):
        license.compile_template("x", "[[open").starts()
    with pytest.raises(ValueError):
        license.compile_template("x", "<<1>> word").starts()


def test_license_edges(spark, edge_docs, no_docs):
    more = spark.createDataFrame([(50, "CC BY. cc by! ALL rights\nreserved"), (51, "General  Public-License")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license.scan_licenses(edge_docs.select("doc_id", "text", "score").unionByName(more, allowMissingColumns=True)).collect()}
    assert (rows[50]["n_base"], rows[50]["first_word"], rows[50]["last_word"], rows[50]["base_labels"]) == (3, 0, 4, "cc-by,reserved")
    assert rows[51]["base_labels"] == "gpl" and rows[0]["n_words"] == 0 and rows[0]["labels"] == "" and rows[0]["first_word"] is None
    assert license.scan_licenses(no_docs).count() == 0


# SentencePiece


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_trie.load_model())


@pytest.fixture(scope="module")
def encoder():
    return sentencepiece_trie.Encoder(sentencepiece_trie.PieceModel(sentencepiece_trie.load_model()), remember=50)


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("the inga▁  \n.,é'²"), st.characters(exclude_categories=["Cs"]))), max_size=5))
@settings(max_examples=200, deadline=None)
def test_ids_are_the_library_s(processor, encoder, texts):
    ids = list(encoder.encode(texts))
    assert ids == [processor.encode(t) for t in texts]
    assert [sentencepiece_trie.decode(encoder.model, i) for i in ids] == [t.replace("▁", " ") for t in texts]


def test_sentencepiece_edges(spark, edge_docs, no_docs):
    rows = sentencepiece_trie.tokenize(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[0]["ids"] is None and by[0]["n_tokens"] is None and by[0]["decoded"] is None
    assert by[1]["ids"] == [] and by[1]["n_tokens"] == 0 and by[1]["decoded"] == "" and by[2]["decoded"] == " \t\n "
    coded = sentencepiece_trie.coded(edge_docs)
    assert coded.columns == [*edge_docs.columns, "_ids", "decoded"]
    assert coded.where("decoded IS DISTINCT FROM text").count() == 0
    back = coded.select("text", sentencepiece_trie.decode_column("_ids", sentencepiece_trie.load_model()).alias("t"))
    assert back.where("t IS DISTINCT FROM text").count() == 0
    assert sentencepiece_trie.tokenize(no_docs).count() == 0


def test_round_trip_of_real_documents(spark):
    got = queries.QUERIES["op7_sentencepiece"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.sha2("text", 256).alias("h"))
    assert got.join(docs, "doc_id").where("decoded_sha256 <> h").count() == 0
    assert hashlib.sha256(b"").hexdigest() != got.first()["decoded_sha256"]
