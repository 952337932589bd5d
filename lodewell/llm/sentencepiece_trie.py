"""SentencePiece encoding by a shared-prefix Viterbi search, and decoding.

The distinct marked words of a block of texts are sorted, which lays them out as a trie, and traversed depth
first: a word takes over the forward states of the prefix it shares with the word before it. The pieces of the
public model come from merges, so a path through the lattice of pieces is scored 0 if every two neighbouring
pieces stand unmerged when they are merged alone, and minus infinity otherwise. Exactly one path to each prefix
survives, namely the model's own encoding of it, and its last piece is all the forward state needed.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lodewell.functions.names import fresh
from lodewell.llm.worker import give_back

MARK = "▁"
TOKENIZERS = "/opt/tokenizers"
MODEL_FILE = "piece_bpe_32k.model"

# Words with the marks before them. Letters and digits end where other characters begin, if no piece joins the two.
_LETTERS = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_WORD = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
_PART = re.compile(rf"{MARK}*[{_LETTERS}]+|{MARK}*[^{MARK}{_LETTERS}]+|{MARK}+")


class PieceModel:
    """Pieces, merge scores and the byte fallback of a SentencePiece model of the merging kind."""

    def __init__(self, data: bytes):
        processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = processor.get_piece_size()
        self.pieces = [processor.id_to_piece(i) for i in range(n)]
        self.unknown = processor.unk_id()
        self.bytes = {}
        plain = []
        for i, piece in enumerate(self.pieces):
            if processor.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                plain.append(i)
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: processor.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces of this model reach across words")
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a character of a piece is no piece of this model")
        joins = re.compile(rf"[{_LETTERS}][^{MARK}{_LETTERS}]|[^{MARK}{_LETTERS}][{_LETTERS}]")
        self.words = (_WORD if any(map(joins.search, self.ids)) else _PART).findall
        self.longest = max(map(len, self.ids), default=1)
        self.spelled = [p.replace(MARK, " ").encode() for p in self.pieces]
        self.spelled[self.unknown] = " \u2047 ".encode()
        for b, i in self.bytes.items():
            self.spelled[i] = bytes([b])
        self.known_fits: dict[int, bool] = {}
        # Finds the pieces within a word, at each end the longest first; pieces that no merging makes are left out.
        self.finder = ahocorasick.Automaton()
        for p in self.ids:
            if self.merge(p) == [p]:
                self.finder.add_word(p, (len(p), self.ids[p]))
        self.finder.make_automaton()

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the best-scored neighbours first, of equals the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are next to one another."""
        if len(self.known_fits) >= 300_000:
            self.known_fits.clear()
        a, b = self.pieces[left], self.pieces[right]
        found = self.known_fits[left << 32 | right] = self.merge(a + b) == [a, b]
        return found

    def fallback(self, char: str) -> list[int]:
        codes = [self.bytes.get(b) for b in char.encode("utf-8", "replace")]
        return [self.unknown] if None in codes else codes


class Encoder:
    """Encodes texts block by block; keeps the ids of a bounded number of words."""

    def __init__(self, model: PieceModel, remember: int = 500_000):
        self.model, self.remember = model, remember
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: set[str]) -> None:
        """The ids of words not known yet, from one depth-first pass over them in order."""
        model, pieces, longest, fits = self.model, self.model.pieces, self.model.longest, self.model.known_fits
        before, last = "", [-1]  # last[i]: the final piece of the encoding of word[:i], -1 before the first and if unknown
        for word in sorted(words):
            shared = len(os.path.commonprefix((before, word)))
            last[shared + 1 :] = [-1] * (len(word) - shared)
            settled = shared
            for at, (length, piece) in model.finder.iter(word, max(0, shared + 1 - longest)):
                if at >= settled:
                    left = last[at + 1 - length]
                    if left >= 0:
                        stays = fits.get(left << 32 | piece)
                        if stays is None:
                            stays = model.fits(left, piece)
                        if not stays:
                            continue
                    last[at + 1], settled = piece, at + 1
            before, found, end = word, [], len(word)
            while end:
                piece = last[end]
                if piece >= 0:
                    found.append(piece)
                    end -= len(pieces[piece])
                else:
                    end -= 1
                    found.extend(reversed(model.fallback(word[end])))
            found.reverse()
            self.known[word] = tuple(found)

    def encode(self, texts: list[str | None]) -> Iterator[list[int] | None]:
        """Ids of each text, as the model gives them without special tokens; None for None."""
        split = [None if t is None else self.model.words(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        distinct = set().union(*filter(None, split))
        if len(self.known) + len(distinct) > self.remember:
            self.known.clear()
        self.learn(distinct.difference(self.known))
        get = self.known.__getitem__
        for words in split:
            yield None if words is None else list(chain.from_iterable(map(get, words)))


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(PieceModel(data))


def decode(model: PieceModel, ids: list[int] | None) -> str | None:
    """The text of ids: bytes are joined to characters, marks are spaces, the first of them is dropped."""
    if ids is None:
        return None
    return b"".join(map(model.spelled.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def load_model(folder: str = TOKENIZERS, name: str = MODEL_FILE) -> bytes:
    """The model file, read by the driver; at half a megabyte it travels with the task."""
    with open(os.path.join(folder, name), "rb") as file:
        return file.read()


_BLOCK_CHARS = 1 << 20


def _blocks(texts: list) -> Iterator[list]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= _BLOCK_CHARS:
            yield texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def coded(docs: DataFrame, *, text: str = "text", data: bytes | None = None, with_text: bool = True) -> DataFrame:
    """`docs`, all columns, with `ids` (array<int>) and, `with_text`, `decoded` (underscores in front if taken).

    Null gives null, an empty text no ids; a text of any length is encoded whole. Texts are coded in blocks of
    about a million characters, and each block is handed on by itself, so that memory does not follow a batch.
    """
    data = data or load_model()
    names = [fresh(docs, "ids")] + [fresh(docs, "decoded")] * with_text
    position = docs.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(position).to_pylist()):
                ids = list(encoder.encode(block))
                columns = [*batch.slice(at, len(block)).columns, _lists(ids)]
                if with_text:
                    columns.append(pa.array([decode(encoder.model, x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])
                at += len(block)
        give_back()

    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)]).add("ids", ArrayType(IntegerType()))
    schema = schema.add("decoded", "string") if with_text else schema
    return docs.mapInArrow(encode, schema).toDF(*docs.columns, *names)


def _lists(values: list[list[int] | None]) -> pa.Array:
    """An Arrow list column, by offsets rather than from objects."""
    lengths = np.array([0 if v is None else len(v) for v in values], np.int64)
    flat = np.fromiter(chain.from_iterable(v for v in values if v), np.int32, count=int(lengths.sum()))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    missing = pa.array([v is None for v in values])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=missing)


def decode_column(ids: Column | str, data: bytes) -> Column:
    """The text of piece ids. Null gives null. A mark U+2581 in the original text comes back as a space."""

    @F.pandas_udf("string")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _encoder(data).model
        for each in batches:
            yield pd.Series([decode(model, None if x is None else list(x)) for x in each], dtype=object)

    return join.asNondeterministic()(ids)


def tokenize(docs: DataFrame, *, text: str = "text", key: str = "doc_id", data: bytes | None = None) -> DataFrame:
    """One row per row of `docs`, repeated rows included: key, n_tokens, ids, decoded.

    n_tokens is null for a null text, 0 for an empty one.
    """
    out = coded(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), data=data)
    return out.select(F.col("key").alias(key), F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_tokens"), "ids", "decoded")
