"""Toxicity of texts whose spelling may be disguised.

A noisy channel stands between what a writer meant and what is read: letters become look-alikes, are repeated,
or are set apart. Disguised spans are read as lattices of characters and decoded by Viterbi search under a
character trigram model of the corpus; the restored text is scored by the words and word beginnings that mark
toxic documents among the labelled ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.sources.tables import materialize

# What a look-alike may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h",
}

LITERAL, REPLACED, DROPPED, SINGLED = np.log([0.5, 0.1, 0.3, 0.3])

# Symbols of the character model: 0-25 a-z, 26 any other letter, 27 everything else.
OTHER, EDGE, SYMBOLS = 26, 27, 28
_FOLD = bytes(
    c - 97 if 97 <= c <= 122 else c - 65 if 65 <= c <= 90 else OTHER if c >= 128 else EDGE for c in range(256)
)

_SEPARATORS = " .-_*"
_ALIKE = "0-9" + re.escape("".join(k for k in LOOK_ALIKES if not k.isalnum()))
_ONE = rf"(?:[^\W_]|[{_ALIKE}])"
_FIRST = rf"(?<![^\W_])(?<![{_ALIKE}])"  # where a run of letters, digits and look-alikes begins
_DISGUISED = re.compile(
    rf"{_FIRST}{_ONE}(?:[ .\-_*]{_ONE}){{2,}}(?![^\W_])"  # letters and look-alikes set apart
    rf"|{_FIRST}(?:[^\W\d_]++[{_ALIKE}]|[{_ALIKE}]++[^\W\d_])(?:[^\W\d_]|[{_ALIKE}])*+"  # a run with a letter and a look-alike
    rf"|(?<![^\W_])[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*",  # a letter three times or more
    re.IGNORECASE,
)
_REPEATED = re.compile(r"([^\W\d_])\1\1", re.IGNORECASE)  # the last of these
# Classes of characters for a quick look: a letter, a look-alike or digit, a separator, both of these, or anything
# else. UTF-8 continuation bytes are left out, so that one character is one byte; the euro sign is looked up as $.
_CLASSES = bytes(
    ord("M") if chr(c) == "*"
    else ord("A") if chr(c) in LOOK_ALIKES
    else ord("L") if c >= 128 or chr(c).isalpha()
    else ord("S") if chr(c) in _SEPARATORS
    else ord("O")
    for c in range(256)
)
_QUICK = re.compile(rb"[AM]L|L[AM]|[LAM][SM][LAM][SM][LAM]")
_CONTINUATION = bytes(range(0x80, 0xC0))
_LETTERS = re.compile(r"[^\W\d_]+")
_SETTLED = 4096  # steps of a lattice after which the beginning that all readings share is written out
_REMEMBERED = 64  # characters of the longest span whose reading is remembered


def symbol(c: str) -> int:
    low = c.lower()
    return ord(low) - 97 if "a" <= low <= "z" else OTHER if c.isalpha() else EDGE


def count_trigrams(texts: list[bytes]) -> np.ndarray:
    """How often each three symbols follow one another, runs of other characters taken once."""
    counts = np.zeros(SYMBOLS**3, np.int64)
    for at in range(0, len(texts), 256):
        data = np.frombuffer(b" ".join(texts[at : at + 256]).translate(_FOLD), np.uint8).astype(np.int32)
        data = data[np.append(True, (data[1:] != EDGE) | (data[:-1] != EDGE))] if len(data) else data
        if len(data) > 2:
            counts += np.bincount(data[:-2] * SYMBOLS**2 + data[1:-1] * SYMBOLS + data[2:], minlength=SYMBOLS**3)
    return counts


def may_be_disguised(text: str) -> bool:
    """False only if no disguised span is in the text."""
    data = text.encode("utf-8", "replace")
    classes = data.replace(b"\xe2\x82\xac", b"$").translate(_CLASSES, _CONTINUATION)
    if _QUICK.search(classes):
        return True
    if not data.isascii():
        return _REPEATED.search(text) is not None
    x = np.frombuffer(data.lower(), np.uint8)
    return len(x) > 2 and bool(((x[:-2] == x[1:-1]) & (x[1:-1] == x[2:]) & (x[2:] >= 97) & (x[2:] <= 122)).any())


@dataclass
class CharacterModel:
    """Interpolated trigram log-probabilities, by symbols."""

    logs: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> CharacterModel:
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1)) + 1.0
        p1 = one / one.sum()
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)
        return cls(np.log(p3))


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each character, or run of one letter, what it may stand for and at which log-probability."""
    apart = len(span) > 4 and all(c in _SEPARATORS for c in span[1::2])
    steps: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(span):
        c, run = span[i], 1
        while i + run < len(span) and span[i + run].lower() == c.lower():
            run += 1
        if apart and i % 2 and run == 1:
            alike = LOOK_ALIKES.get(c, "")
            steps.append([("", DROPPED), (" ", LITERAL), *((x, REPLACED - np.log(len(alike))) for x in alike)])
        elif c.isalpha() and run > 2:
            steps.append([(c, SINGLED), (c * 2, SINGLED + np.log(0.5))])
        else:
            alike = LOOK_ALIKES.get(c, "")
            meant = [(x, REPLACED - np.log(len(alike))) for x in alike]
            steps += [[(each, LITERAL), *meant] for each in span[i : i + run]]
        i += run
    return steps


def _settle(best: dict[tuple[int, int], tuple[float, list]], parts: list[str]) -> None:
    """Moves to `parts` what all readings begin with, so that memory does not grow with the span."""
    paths = []
    for _, node in best.values():
        path = []
        while node is not None:
            path.append(node)
            node = node[0]
        paths.append(path[::-1])
    shared = 0
    for nodes in zip(*paths, strict=False):
        if any(n is not nodes[0] for n in nodes):
            break
        shared += 1
    # The last node stays, for the states refer to it.
    shared = min(shared, min(map(len, paths)) - 1)
    parts.extend(n[1] for n in paths[0][:shared])
    for path in paths:
        path[shared][0] = None


def decode(span: str, model: CharacterModel) -> str:
    """The likeliest reading of a span of any length: one Viterbi pass over the last two symbols."""
    logs, parts = model.logs, []
    best: dict[tuple[int, int], tuple[float, list | None]] = {(EDGE, EDGE): (0.0, None)}
    for n, options in enumerate(lattice(span), 1):
        after: dict[tuple[int, int], tuple[float, list]] = {}
        for (a, b), (score, node) in best.items():
            for meant, channel in options:
                x, y, total = a, b, score + channel
                for ch in meant:
                    z = symbol(ch)
                    if z == EDGE and y == EDGE:
                        continue
                    total += logs[x, y, z]
                    x, y = y, z
                known = after.get((x, y))
                if known is None or total > known[0]:
                    after[x, y] = (total, [node, meant])
        best = after
        if n % _SETTLED == 0:
            _settle(best, parts)
    _, node = max(((score + logs[a, b, EDGE] if b != EDGE else score, node) for (a, b), (score, node) in best.items()), key=lambda r: r[0])
    rest = []
    while node is not None:
        rest.append(node[1])
        node = node[0]
    return "".join(parts + rest[::-1])


class Restorer:
    """Restores the disguised spans of texts, remembering a bounded number of them."""

    def __init__(self, model: CharacterModel, remember: int = 100_000):
        self.model, self.remember, self.known = model, remember, {}

    def _span(self, match: re.Match) -> str:
        span = match.group(0)
        if any(c in LOOK_ALIKES and not c.isalnum() for c in span) and not any(map(str.isalpha, span)):
            return span  # a sum, a rule or the like
        found = self.known.get(span)
        if found is None:
            found = decode(span, self.model)
            if len(span) > _REMEMBERED:
                return found
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[span] = found
        return found

    def __call__(self, text: str) -> str:
        """Spans lie within a line; only lines that may hold one are searched."""
        if not may_be_disguised(text):
            return text
        return "\n".join(
            _DISGUISED.sub(self._span, line) if may_be_disguised(line) else line for line in text.split("\n")
        )


def words_of(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def marks_of(word: str) -> list[str]:
    """A word itself and its beginnings, marked by a star."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n)]


class Marks:
    """How strongly words mark toxic documents: logs of how much commoner a mark is there, cautiously."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.words = {f for f in weights if f[-1] != "*"}
        self.starts = {n: {f[:-1] for f in weights if f[-1] == "*" and len(f) == n + 1} for n in (4, 5, 6)}

    def summary(self, words: set[str]) -> tuple[float, float, float, float]:
        """(1, the log of all marks together, of their density, the strongest) over the distinct words."""
        hit = words & self.words
        for n, starts in self.starts.items():
            if starts:
                hit.update(w for w in words if w[:n] in starts and len(w) >= n)
        each = [max(self.weights.get(m, 0.0) for m in marks_of(w)) for w in hit]
        total = sum(sorted(each))  # in one order, so that equal texts get equal scores
        return 1.0, float(np.log1p(total)), float(np.log1p(100 * total / (len(words) + 20))), max(each, default=0.0)


@dataclass
class ToxicityModel:
    characters: CharacterModel
    weights: dict[str, float] = field(default_factory=dict)
    slope: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)  # of the logistic score over Marks.summary

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.restore, self.marks = model, Restorer(model.characters), Marks(model.weights)

    def score(self, text: str | None) -> float:
        words = words_of(self.restore(text)) if text else set()
        return float(1 / (1 + np.exp(-np.dot(self.marks.summary(words), self.model.slope))))


def _least_phrase(text: str, words: int = 5) -> int:
    """The least hash of the text's phrases: near copies mostly share it."""
    w = text.lower().encode("utf-8", "replace").split()
    spans = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    return min(map(xxhash.xxh64_intdigest, spans)) - (1 << 63)


def character_counts(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """Trigram counts of all texts; what reaches the driver is bounded by the alphabet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            total += count_trigrams([t for t in batch.column(0).to_pylist() if t])
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], names=["code", "n"])

    rows = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3, np.int64)
    for code, n in rows.collect():
        counts[code] = n
    return counts


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    max_labelled: int = 30_000,
    max_marks: int = 50_000,
    max_rows: int = 20_000,
    least_documents: int = 4,
    least_weight: float = 0.7,
) -> ToxicityModel:
    """A model from the texts of `docs` (characters) and those of them that `labels` (key, label 0 or 1) marks.

    The labelled keys are a sample of at most `max_labelled`, by a hash of the key; only they are broadcast, so that
    texts are not moved to their labels. Rows with null text, key or label are not used. A key with several labels is toxic
    if one of them is 1, and of several texts under one key the smallest counts. Near copies, which mostly share their
    least phrase, count once. Words and word beginnings are counted in all sampled rows, a document's distinct words once
    each; the `max_marks` most frequent of the toxic rows are candidates, which bounds what reaches the driver. The
    logistic score is fitted on at most `max_rows` rows, each summarized with the marks of the other half of the rows.
    Without labelled rows of both kinds, as of an empty table, every text scores the share of toxic rows. The model does
    not depend on how the input is partitioned. Other columns may have any names.
    """
    characters = CharacterModel.of(character_counts(docs, text=text))

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(characters)
        for batch in batches:
            clean = [restorer(t) for t in batch.column(0).to_pylist()]
            columns = [pa.array(clean, pa.string()), batch.column(1), batch.column(2), pa.array(map(_least_phrase, clean), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "y", "h", "least"])

    marked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    sample = F.broadcast(marked.orderBy(F.xxhash64("k"), "k").limit(max_labelled))
    usable = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(sample, "k")
    single = usable.groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y")).select("t", "y", F.xxhash64("k").alias("h"))
    restored = single.mapInArrow(restore, "t string, y int, h long, least long")
    # Of near copies one text, whatever the partitions: the least by the hash of its key.
    restored = restored.groupBy("least", "y").agg(F.min_by("t", F.struct("h", "t")).alias("t"))
    kept = materialize(restored.withColumn("half", F.pmod("least", F.lit(2)).cast("int")), "labelled")

    def counted(rows: DataFrame, wanted: set[str] | None) -> dict[str, list[int]]:
        """Documents of each half with each mark, and under '' all their words."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                totals = (Counter(), Counter())
                for t, half in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = words_of(t)
                    marks = (m for w in words for m in marks_of(w))
                    totals[half].update(marks if wanted is None else filter(wanted.__contains__, marks))
                    totals[half][""] += len(words)
                for half, total in enumerate(totals):
                    names = [pa.array(list(total), pa.string()), pa.array([half] * len(total), pa.int32()), pa.array(list(total.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays(names, names=["f", "half", "n"])

        split = rows.select("t", "half").mapInArrow(count, "f string, half int, n long").groupBy("f")
        halves = split.agg(*(F.coalesce(F.sum(F.when(F.col("half") == h, F.col("n"))), F.lit(0)).alias(f"n{h}") for h in (0, 1)))
        enough = halves.where((F.col("n0") + F.col("n1") >= least_documents) | (F.col("f") == "")) if wanted is None else halves
        return {r["f"]: [r["n0"], r["n1"]] for r in enough.orderBy(F.desc(F.col("n0") + F.col("n1")), "f").limit(max_marks).collect()}

    toxic = counted(kept.where("y = 1"), None)
    clean = counted(kept.where("y = 0"), set(toxic))
    sizes = dict(kept.groupBy("y").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        share = min(max(sizes.get(1, 0) / max(1, sum(sizes.values())), 1e-6), 1 - 1e-6)
        return ToxicityModel(characters, {}, (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))

    def weights(pick) -> dict[str, float]:
        found = {}
        for f, halves in toxic.items():
            t, n = pick(halves), pick(clean.get(f, [0, 0]))
            if f and t >= least_documents:
                ratio = np.log((t + 0.5) / (pick(toxic[""]) + 1)) - np.log((n + 0.5) / (pick(clean.get("", [0, 0])) + 1))
                cautious = ratio - 1.5 * np.sqrt(1 / (t + 0.5) + 1 / (n + 0.5))
                if cautious > least_weight:
                    found[f] = float(cautious)
        return found

    others = [weights(lambda halves: halves[1]), weights(lambda halves: halves[0])]

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [Marks(w) for w in others]
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            x = [marks[half].summary(words_of(t)) for t, half in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    sample = F.broadcast(kept.select("least", "y").orderBy(F.xxhash64("least"), "y").limit(max_rows))  # numbers alone
    rows = kept.join(sample, ["least", "y"], "left_semi").select("t", "y", "half").mapInArrow(summarize, "x array<double>, y int").toPandas()
    return ToxicityModel(characters, weights(sum), _logistic(np.array(rows["x"].tolist()), rows["y"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> tuple[float, ...]:
    """Newton's method for a logistic regression, the intercept all but free."""
    order = np.lexsort((y, *x.T))  # the sums don't depend on the order of the rows
    x, y = x[order], y[order]
    penalty = np.array([1e-3] + [ridge] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty)
        w = w + np.linalg.solve(curve, x.T @ (y - p) - penalty * w)
    return tuple(map(float, w))


def toxicity(model: ToxicityModel, text: Column | str) -> Column:
    """The score, 0 to 1, of a whole text; null and empty texts get that of a text without marks, long ones are read whole."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return score.asNondeterministic()(text)


def restored(model: ToxicityModel, text: Column | str) -> Column:
    """The text with its disguised spans restored; null stays null."""

    @F.pandas_udf("string")
    def restore(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(model.characters)
        for texts in batches:
            yield pd.Series([None if t is None else restorer(t) for t in texts], dtype=object)

    return restore.asNondeterministic()(text)


def classify(docs: DataFrame, model: ToxicityModel, *, text: str = "text", key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """One row per row of `docs`, repeated rows included: key, score, predicted (1 from `threshold` on).

    Null and empty texts score as a text without marks, long ones are read whole. Rows with a null key are scored like
    others, an empty table gives no rows, and other columns, whatever their names, are left out.
    """
    scored = docs.select(F.col(key).alias("k"), toxicity(model, F.col(text)).alias("score"))
    return scored.select(F.col("k").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
