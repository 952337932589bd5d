"""Disguises at any place of a word, set apart, with a euro sign, and longer than any buffer."""

import itertools
import random

import pytest

from lodewell.llm import langid, toxicity

WORDS = b"shit, such an ass, asshole, idiot, evil devil, ass, shit, shit, evil. " * 500


@pytest.fixture(scope="module")
def model():
    return toxicity.CharacterModel.of(toxicity.count_trigrams([WORDS]))


@pytest.mark.parametrize("disguised,plain", [("a$$", "ass"), ("idio7", "idiot"), ("shi7", "shit"), ("5h17", "shit"), ("s h ! t", "shit"), ("a $ $ h o l e", "asshole"), ("d€vil", "devil"), ("€vil", "evil")])
def test_disguises_at_any_place(model, disguised, plain):
    assert toxicity.may_be_disguised(disguised)
    assert toxicity.Restorer(model)(f"you, {disguised}, ok") == f"you, {plain}, ok"


def test_plain_text_stays(model):
    restore = toxicity.Restorer(model)
    for text in ("the ass!", "(an idiot)", "24 + 12 = 36", "* * * * *", "1 + 2", "5 € is 24 €"):
        assert restore(text) == text


def test_long_spans_are_one_pass(model, monkeypatch):
    """A word across any cut is read as elsewhere, and writing out what is settled changes nothing."""
    for lead in range(50, 70):
        assert toxicity.decode(" ".join("idiot" * lead + "sh1t"), model).replace(" ", "") == "idiot" * lead + "shit"
    span = "".join(random.Random(1).choice("st1d0$a5h!") for _ in range(3000))
    whole = toxicity.decode(span, model)
    monkeypatch.setattr(toxicity, "_SETTLED", 7)
    assert toxicity.decode(span, model) == whole


def test_the_quick_look_misses_no_span():
    pick = random.Random(2)
    for _ in range(20_000):
        text = "".join(pick.choice("aaé€$1*! .-_,x") for _ in range(pick.randrange(1, 9)))
        if toxicity._DISGUISED.search(text):
            assert toxicity.may_be_disguised(text), text


def test_the_quick_look_misses_no_letter_of_any_length():
    pick = random.Random(3)
    for _ in range(20_000):
        text = "".join(pick.choice("哈哈жЖ\U00010437ſsİiẞßéÉςσ 1.") for _ in range(pick.randrange(1, 9)))
        assert not toxicity._DISGUISED.search(text) or toxicity.may_be_disguised(text), text
    assert toxicity.may_be_disguised("哈哈哈") and toxicity.may_be_disguised("\U00010437" * 3) and not toxicity.may_be_disguised("哈哈 é")


def readings(span, model):
    """Every reading of a span with its log-probability, by going through all of them."""
    for choice in itertools.product(*toxicity.lattice(span)):
        a = b = toxicity.EDGE
        total = 0.0
        for meant, channel in choice:
            total += channel
            for ch in meant:
                z = toxicity.symbol(ch)
                if z == toxicity.EDGE and b == toxicity.EDGE:
                    continue
                total += model.logs[a, b, z]
                a, b = b, z
        yield total + (model.logs[a, b, toxicity.EDGE] if b != toxicity.EDGE else 0.0), "".join(m for m, _ in choice)


def test_viterbi_finds_the_best_of_all_readings(model):
    pick = random.Random(3)
    spans = ["".join(pick.choice("ashit10$!*e ") for _ in range(pick.randrange(1, 8))) for _ in range(300)]
    spans += ["s h 1 t", "a s s", "1 d 1 0 t", "shiiiit", "*a5$* "]
    for span in spans:
        every = sorted(readings(span, model), reverse=True)
        best = {text for total, text in every if every[0][0] - total < 1e-9}
        assert toxicity.decode(span, model) in best, span


def test_the_model_does_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where(~langid.held_out("doc_id", 4, 2))
    one = toxicity.fit(docs, train)
    # A contradictory label makes a toxic key no less toxic.
    other = toxicity.fit(docs, train.unionByName(train.where("toxic = 1").selectExpr("doc_id", "quality", "0 AS toxic")))
    assert other.weights == one.weights and other.slope == one.slope
    again = toxicity.fit(docs.repartition(7), train.repartition(3))
    assert again.weights == one.weights and again.slope == one.slope


def test_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "you idiot", "x", 2), (None, None, "y", 3)], "k long, t string, score string, y int")
    model = toxicity.fit(rows, spark.createDataFrame([(1, 1)], "k long, toxic int"), text="t", key="k")
    assert [r["predicted"] for r in toxicity.classify(rows, model, text="t", key="k").collect()] == [1, 1]
