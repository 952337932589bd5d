"""Removal of passages that recur in the corpus, located by sharded Aho-Corasick automata.

A window of `window` consecutive words that occurs twice has the same least phrase (of `phrase` words) both
times. Counting the runs of windows that share a least phrase therefore finds every phrase that can lie in a
recurring passage, with about one row per fifteen words; windows themselves are only counted under phrases
whose surroundings differ between occurrences. A table names each confirmed phrase to every shard of documents that
holds it, with one document to take its words from. The words of a shard's phrases are compiled into an automaton, all
documents of the shard are streamed through it, and every confirmed window around a hit is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructField, StructType

from lodewell.llm.worker import give_back
from lodewell.sources.tables import discard, materialize

WINDOW = 35
PHRASE = 8

ENTRY_PHRASE, ENTRY_WHOLE, ENTRY_WINDOW = 0, 1, 2

_WORDS_AT_ONCE = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8: powers of it differ in all but a few low bits
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) over every `width` consecutive values."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[:-rest], x[rest:]) if rest else x


class Passages:
    """Word, phrase and window hashes of some documents laid end to end."""

    def __init__(self, texts: list[bytes | None], window: int = WINDOW, phrase: int = PHRASE):
        self.window, self.phrase = window, phrase
        split = [t.split() if t else [] for t in texts]
        self.lengths = np.array([len(w) for w in split], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.words = list(chain.from_iterable(split))
        n = len(self.words)
        numbers = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        self.ids = np.fromiter(map(numbers.__getitem__, self.words), dtype=np.int64, count=n)
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, numbers), dtype=np.uint64, count=len(numbers))[self.ids]
        self.document = np.repeat(np.arange(len(texts)), self.lengths)
        count = max(0, n - window + 1)
        # A window is valid if it ends in the document it starts in.
        self.valid = self.document[:count] == self.document[window - 1 :] if count else np.zeros(0, bool)
        self.power = np.cumprod(np.full(n + 1, _MULTIPLIER, np.uint64)) if n else np.zeros(1, np.uint64)
        self.back = np.cumprod(np.full(n + 1, _INVERSE, np.uint64)) if n else np.zeros(1, np.uint64)
        self.sums = [self._sums(self.hash), self._sums(_mix(self.hash, 0xA5A5))]
        spans = np.arange(max(0, n - phrase + 1))
        self.phrases = _mix(self._over(0, spans, spans + phrase), 0x51)
        self.least = _extreme(self.phrases, window - phrase + 1, np.minimum)[:count] if count else np.zeros(0, np.uint64)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.power[: len(values)], dtype=np.uint64)])

    def _over(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words from start to end, the same wherever they stand."""
        return (self.sums[which][end] - self.sums[which][start]) * self.back[start]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each window that starts at `at`."""
        return tuple(_mix(self._over(k, at, at + self.window), 0x77) for k in (0, 1))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of windows with one least phrase: its document, that phrase, a hash of the words that the
        run covers, and how often the phrase stands in it."""
        at = np.flatnonzero(self.valid)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none.view(np.uint64), none.view(np.uint64), none
        value, doc = self.least[at], self.document[at]
        new = np.ones(len(at), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        begin, end = at[first], at[last] + self.window
        segment = _mix(self._over(0, begin, end) ^ _mix((end - begin).astype(np.uint64), 3), 0x33)
        # Standing places of the least phrase: of all windows around a place, the greatest least value equals it.
        width = self.window - self.phrase + 1
        marked = np.where(self.valid, self.least, np.uint64(0))
        padded = np.concatenate([np.zeros(width - 1, np.uint64), marked, np.zeros(width - 1, np.uint64)])
        places = np.flatnonzero(_extreme(padded, width, np.maximum)[: len(self.phrases)] == self.phrases)
        # How many of them are in a run and are its phrase: places in order of (phrase, place) are counted by bounds.
        known, rank = np.unique(self.phrases[places], return_inverse=True)
        key, span = np.sort(rank * (len(self.phrases) + 1) + places), len(self.phrases) + 1
        of = np.searchsorted(known, value[first]) * span
        often = np.searchsorted(key, of + np.minimum(at[last] + width, span - 1)) - np.searchsorted(key, of + begin)
        return doc[first], value[first], segment, np.maximum(often, 1)


def _portions(texts: list) -> Iterator[tuple[int, int]]:
    """Bounds of parts, each of a bounded size or a single document."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= 6 * _WORDS_AT_ONCE:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Positions of x in `ordered`, -1 where it is absent."""
    if not len(ordered):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return np.where(ordered[at] == x, at, -1)


def _automaton(phrases: np.ndarray) -> ahocorasick.Automaton:
    """An automaton over word numbers; each hit gives the phrase's number in that order."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for number, words in enumerate(map(tuple, phrases.tolist())):
        automaton.add_word(words, number)
    automaton.make_automaton()
    return automaton


def _marked(docs: Passages, automaton: ahocorasick.Automaton, values: np.ndarray) -> np.ndarray:
    """For each place the value of the phrase that the automaton finds there, and the greatest number where it finds none.

    A hit takes up eight bytes while its document is streamed, and none afterwards.
    """
    marks = np.full(len(docs.phrases), np.iinfo(np.uint64).max)
    for a, b in zip(docs.starts[:-1].tolist(), docs.starts[1:].tolist(), strict=True):
        if b - a >= docs.window:
            hits = np.fromiter((end << 32 | number for end, number in automaton.iter(tuple(docs.ids[a:b].tolist()))), np.int64)
            marks[a + (hits >> 32) - docs.phrase + 1] = values[hits & 0xFFFFFFFF]
    return marks


def covered_words(docs: Passages, rows: np.ndarray, kind: np.ndarray, value: np.ndarray, row: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which words a confirmed window covers, of documents with the ascending numbers `rows`.

    An entry of kind ENTRY_PHRASE or ENTRY_WHOLE names a phrase by its hash `value` and a document `row` to take its words from;
    under the latter all windows with that least phrase are confirmed. ENTRY_WINDOW confirms the window with
    the hashes (first, second) under its phrase.
    """
    covered = np.zeros(len(docs.words) + 1, np.int64)
    named = kind != ENTRY_WINDOW
    values = np.unique(value[(kind == ENTRY_WHOLE) | ~named])
    # The words of each phrase, at its place in one of the documents that are named.
    holders = np.zeros(len(rows), bool)
    holders[_member(row[named], rows)] = True
    at = np.flatnonzero(holders[docs.document[: len(docs.phrases)]])
    at = at[docs.document[at] == docs.document[at + docs.phrase - 1]]
    which = _member(docs.phrases[at], values)
    at, which = at[which >= 0], which[which >= 0]
    places = np.full(len(values), -1)
    places[which[::-1]] = at[::-1]
    values, places = values[places >= 0], places[places >= 0]
    if not len(places):
        return covered[:-1] > 0
    # A window counts if the automaton finds its least phrase in it: the least of the phrases found there is then that one.
    marks = _marked(docs, _automaton(docs.ids[places[:, None] + np.arange(docs.phrase)]), values)
    found = _extreme(marks, docs.window - docs.phrase + 1, np.minimum)[: len(docs.least)]
    at = np.flatnonzero(docs.valid & (found == docs.least))
    sure = _member(docs.least[at], np.unique(value[kind == ENTRY_WHOLE])) >= 0
    one, two = docs.windows(at)
    windows = np.flatnonzero(~named)
    windows = windows[np.argsort(first[windows], kind="stable")]
    first, second = first[windows], second[windows]
    # Windows are confirmed by both hashes; the first alone locates the candidates, which stand side by side.
    slot, left = np.searchsorted(first, one), np.flatnonzero(~sure)
    while len(left := left[slot[left] < len(first)]) and len(left := left[first[slot[left]] == one[left]]):
        equal = second[slot[left]] == two[left]
        sure[left[equal]] = True
        left = left[~equal]
        slot[left] += 1
    np.add.at(covered, at[sure], 1)
    np.add.at(covered, at[sure] + docs.window, -1)
    return np.cumsum(covered[:-1]) > 0


def strip_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """One row per row of `docs`: key, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if any window of `window` words that covers it occurs more than once in the corpus, in the same
    document or overlapping itself included; all occurrences go. Words are runs of other than ASCII white space,
    compared byte by byte. A null or blank text has no words and keeps an empty text; a text shorter than
    the window is never changed, one of any length is read whole. Rows with one key, or none, are separate documents,
    repeated rows included; an empty table gives no rows, and other columns, whatever their names, are left out.

    Documents are numbered and spread over shards of about `shard_bytes` of text by a hash of that number, so that copies
    spread; each shard is one group. A passage reaches a shard once, however often it stands there, so nothing grows with
    its number of copies. Phrases are located by their words, windows compared by 128-bit hashes of theirs. Settings are
    those of `_stripped`.
    """
    return _stripped(docs, text, [key], **settings).select(F.col("c0").alias(key), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def rewrite(docs: DataFrame, *, text: str = "text", length: str = "n_chars", **settings) -> DataFrame:
    """`docs` without the recurring passages, all columns kept; `length`, if there is such a column, follows the text.

    A text without a recurring passage is left as it is, null included; rows of which no word is left go. Repeated
    rows are each cut on their own, and null keys are keys like others. An empty table stays empty, and columns may have
    any names.
    """
    out = _stripped(docs, text, docs.columns, **settings)
    out = out.withColumn("kept", F.when(F.col("n_removed") > 0, F.col("kept").cast("string")))
    columns = []
    for i, name in enumerate(docs.columns):
        column = F.col(f"c{i}")
        if name == text:
            column = F.coalesce("kept", column)
        elif name == length:
            column = F.when(F.col("kept").isNull(), column).otherwise(F.length("kept").cast(docs.schema[name].dataType))
        columns.append(column.alias(name))
    return out.where("kept IS NULL OR kept <> ''").select(*columns)


def _stripped(
    docs: DataFrame, text: str, carried: list[str], *, window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = 2 << 20, min_shards: int = 32
) -> DataFrame:
    """n_words, n_removed and kept of each row, and the carried columns as c0, c1, ...

    Rows are written once with a number, which makes them distinct and names them in all passes. The text goes through
    one exchange, which the two passes over the shards share.
    """
    own = [] if text in carried else [F.col(text).alias("_text")]
    docs_ = materialize(docs.select(F.struct(*carried).alias("_row"), *own, F.monotonically_increasing_id().alias("_n")), "numbered")
    words = F.col("_text") if own else F.col("_row")[text]
    total = docs_.agg(F.sum(F.octet_length(words))).first()[0] or 0
    shards = max(min_shards, -(-total // shard_bytes))
    shard = F.pmod(F.xxhash64("_n"), F.lit(shards)).cast("int").alias("_shard")
    plain = docs_.select("*", shard)

    def texts_of(docs: pa.Table) -> list[bytes | None]:
        column = docs.column("_text") if "_text" in docs.column_names else pc.struct_field(docs.column("_row"), text)
        return column.cast(pa.binary()).to_pylist()

    def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, owners, numbers = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b in _portions(texts):
                doc, value, segment, often = Passages(texts[a:b], window, phrase).runs()
                yield pa.RecordBatch.from_arrays(
                    [_signed(value), _signed(segment), pa.array(owners[a:b][doc]), pa.array(numbers[a:b][doc]), pa.array(often)],
                    names=["value", "segment", "_shard", "row", "often"],
                )
        give_back()

    runs = (
        docs_.select(words.cast("binary").alias("t"), shard, "_n")
        .mapInArrow(count_runs, "value long, segment long, _shard int, row long, often long")
        .groupBy("value", "segment", "_shard")
        .agg(F.count("*").alias("runs"), F.sum("often").alias("often"), F.min("row").alias("row"))
    )
    runs = materialize(runs, "runs")
    # A phrase of very many surroundings is reduced in two steps and joined back, never gathered.
    segments = runs.groupBy("value", "segment").agg(F.sum("runs").alias("same"), F.sum("often").alias("often"))
    values = segments.groupBy("value").agg(F.sum("often").alias("times"), (F.min("same") > 1).alias("whole")).where("times > 1").drop("times")
    recurring = materialize(runs.groupBy("value", "_shard").agg(F.min("row").alias("row")).join(values, "value"), "phrases")
    discard(runs)

    def count_windows(docs: pa.Table, mixed: pa.Table) -> pa.Table:
        rows = {"_shard": [], "value": [], "first": [], "second": [], "times": []}
        if docs.num_rows and mixed.num_rows:
            there = Passages(texts_of(docs), window, phrase)
            values = np.unique(mixed.column("value").to_numpy().view(np.uint64))
            at = np.flatnonzero(there.valid & (_member(there.least, values) >= 0))
            one, two = there.windows(at)
            order = np.lexsort((two, one))
            one, two, at = one[order], two[order], at[order]
            first = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(at) else at
            shard = docs.column("_shard")[0].as_py()
            rows = {
                "_shard": pa.array(np.full(len(first), shard, np.int32)),
                "value": _signed(there.least[at[first]]),
                "first": _signed(one[first]),
                "second": _signed(two[first]),
                "times": pa.array(np.diff(np.append(first, len(at)))),
            }
            del there
            give_back()
        return pa.table(rows, schema=_WINDOWS)

    mixed = recurring.where(~F.col("whole")).select("_shard", "value")
    counted = plain.groupBy("_shard").cogroup(mixed.groupBy("_shard")).applyInArrow(count_windows, _WINDOWS_DDL)
    # One row for each shard that a window is in, which spill; writing them first for a join back would cost their size again.
    confirmed = counted.withColumn("all", F.sum("times").over(Window.partitionBy("first", "second"))).where("all > 1")
    none = F.lit(0).cast("long")
    kind = F.when(F.col("whole"), ENTRY_WHOLE).otherwise(ENTRY_PHRASE)
    found = recurring.select("_shard", kind.alias("kind"), "value", "row", none.alias("first"), none.alias("second"))
    found = found.union(confirmed.select("_shard", F.lit(ENTRY_WINDOW).alias("kind"), "value", none.alias("row"), "first", "second"))

    def locate(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs = docs.sort_by("_n")
        texts = texts_of(docs)
        there = Passages(texts, window, phrase) if found.num_rows and texts else None
        if there:
            column = lambda name, kind: found.column(name).to_numpy().view(kind)
            gone = covered_words(
                there, docs.column("_n").to_numpy(), column("kind", np.int32), column("value", np.uint64), column("row", np.int64), column("first", np.uint64), column("second", np.uint64)
            )
        n_words, n_removed, kept = [], [], []
        for i, t in enumerate(texts):
            words, removed = (t.split() if t else []), 0
            if there and len(words):
                mask = gone[there.starts[i] : there.starts[i + 1]]
                removed = int(mask.sum())
            n_words.append(len(words))
            n_removed.append(removed)
            kept.append(b" ".join(w for w, g in zip(words, mask.tolist(), strict=True) if not g) if removed else b" ".join(words))
        columns = [pc.struct_field(docs.column("_row"), [i]) for i in range(len(carried))]
        columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]
        del there, texts, kept
        give_back()
        return pa.table(columns, names=[f.name for f in schema])

    schema = StructType([StructField(f"c{i}", docs.schema[name].dataType) for i, name in enumerate(carried)])
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept", "binary")
    return plain.groupBy("_shard").cogroup(found.groupBy("_shard")).applyInArrow(locate, schema)


_WINDOWS = pa.schema(
    [("_shard", pa.int32()), ("value", pa.int64()), ("first", pa.int64()), ("second", pa.int64()), ("times", pa.int64())]
)
_WINDOWS_DDL = "_shard int, value long, first long, second long, times long"
