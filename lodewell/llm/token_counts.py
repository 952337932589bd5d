"""Token counts from a byte-level tokenizer compiled into two deterministic transducers.

The first reads characters and marks where a word of the tokenizer's pattern begins. It has eleven states; what it
can only tell one character later, it marks then. The second reads bytes. Its state is all that later bytes can
depend on: for each end of the word so far that may grow into a longer piece, the place in the trie of pieces, the
piece before it, and the tokens up to there. A transition carries the number of tokens it adds, which is below zero where a byte
joins several tokens into one. Its states are made when they are first reached. A word's first byte
always leaves the start state, so a mark resets the machine.

A block of text is cut into chunks, all of which are read in step. The first transducer maps every state before a chunk
to one after it; these maps compose by a parallel prefix scan, which gives the state before each chunk. For the second,
chunks begin at marks, where the state is known. Within a word longer than a chunk the maps of the chunks hold the
states that were asked for, and are composed by doubling, until no chunk is asked for a state that its map lacks.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

TOKENIZERS = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.json"

# Classes of characters; the letters that may follow an apostrophe have classes of their own.
LETTER, NUMBER, SPACE, WHITE, OTHER, APOSTROPHE, SHORT, R_OR_V, L, E = range(10)
_SHORT, _SPECIAL = "stmd", {"'": APOSTROPHE, " ": SPACE, "r": R_OR_V, "v": R_OR_V, "l": L, "e": E}
_LETTERS = {LETTER, SHORT, R_OR_V, L, E}

# States of the word transducer: within letters, numbers, others; after one or several white characters of which the last
# is a space or not; after an apostrophe that may begin a short form, and after its r or v, or l; and between words.
(BETWEEN, LETTERS, NUMBERS, OTHERS, ONE_SPACE, ONE_WHITE, SPACES, WHITES, QUOTE, QUOTE_RV, QUOTE_L) = range(11)
_SPREAD = 0x9E3779B1  # spreads the keys of transitions over a table
HERE, BEFORE, NOT_BEFORE = 1, 2, 4  # a word begins here; it began a character earlier; it did not


def _word_step(state: int, kind: int) -> tuple[int, int]:
    """(next state, marks) of the word transducer."""
    white = kind in (SPACE, WHITE)
    if state in (ONE_SPACE, ONE_WHITE, SPACES, WHITES):
        if white:
            return (SPACES if kind == SPACE else WHITES), 0
        if state in (ONE_SPACE, SPACES):  # the space goes with what follows
            run = LETTERS if kind in _LETTERS else NUMBERS if kind == NUMBER else OTHERS
            return run, BEFORE if state == SPACES else 0
        after, _ = _word_step(BETWEEN, kind)
        return after, HERE | (BEFORE if state == WHITES else 0)
    if white:
        return (ONE_SPACE if kind == SPACE else ONE_WHITE), HERE
    if state == QUOTE and kind == SHORT:
        return BETWEEN, 0
    if (state == QUOTE_RV and kind == E) or (state == QUOTE_L and kind == L):
        return BETWEEN, NOT_BEFORE
    if state == QUOTE and kind in (R_OR_V, L):
        return (QUOTE_L if kind == L else QUOTE_RV), HERE
    if kind in _LETTERS:
        return LETTERS, 0 if state in (LETTERS, QUOTE_RV, QUOTE_L) else HERE
    if kind == NUMBER:
        return NUMBERS, 0 if state == NUMBERS else HERE
    if state in (OTHERS, QUOTE):
        return OTHERS, 0
    return (QUOTE if kind == APOSTROPHE else OTHERS), HERE


def _byte_letters() -> dict[str, int]:
    """The letters by which a vocabulary of this kind spells bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes(spec: str) -> list[tuple[int, int]]:
    """(first character, class) of each run of characters of one class, as the tokenizer's own library sorts them."""
    split = tokenizers.Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
    chars = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 0x20]
    text = "".join(map(chr, chars))

    def probe(c: str) -> int:
        for kind, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(split(lead + c)) == 1:
                return kind
        return WHITE

    found = [(chars[begin], probe(text[begin])) for _, (begin, _) in split(text)]
    return [found[0], *(b for a, b in zip(found, found[1:]) if a[1] != b[1])]


def load_tokenizer(folder: str = TOKENIZERS, name: str = TOKENIZER_FILE) -> tuple[str, list[tuple[int, int]]]:
    """The tokenizer's file and its classes of characters, made by the driver; two megabytes that travel with the task."""
    with open(os.path.join(folder, name), encoding="utf-8") as file:
        spec = file.read()
    parsed = json.loads(spec)
    model, words = parsed["model"], parsed["pre_tokenizer"] or {}
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and parsed["normalizer"] is None
    merging = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not (plain and merging) or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in parsed["added_tokens"]):
        raise ValueError(f"{name} is no byte-level tokenizer of the kind that is compiled here")
    return spec, character_classes(spec)


class WordTransducer:
    """Marks the beginnings of words in characters."""

    STATES, CHUNK = 11, 64

    def __init__(self, classes: list[tuple[int, int]]):
        starts, kinds = zip(*classes, strict=True)
        self.kinds = np.repeat(np.array(kinds, np.uint8), np.diff([*starts, 0x110000]))
        for chars, kind in [(_SHORT, SHORT), *_SPECIAL.items()]:
            self.kinds[[ord(c) for c in chars]] = kind
        steps = np.array([[_word_step(s, k) for k in range(10)] for s in range(self.STATES)])
        self.next, self.marks = steps[:, :, 0].T.astype(np.uint8), steps[:, :, 1].T.astype(np.uint8)

    def begins(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a word begins at each character; `first` holds the positions where texts begin, 0 among them."""
        n = len(codes)
        if not n:
            return np.zeros(0, bool)
        kinds = self.kinds[codes].astype(np.intp)
        ends = np.append(first[1:], n)
        chunks = -(-(ends - first) // self.CHUNK)
        owner = np.repeat(np.arange(len(first)), chunks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = first[owner] + within * self.CHUNK
        length = np.minimum(self.CHUNK, ends[owner] - start)
        order = np.argsort(-length, kind="stable")
        active = np.searchsorted(-length[order], -np.arange(self.CHUNK), side="left")  # chunks longer than j
        maps = np.tile(np.arange(self.STATES, dtype=np.uint8), (len(start), 1))
        maps[within == 0] = BETWEEN  # whatever was before, a text begins between words
        self._read(kinds, start, order, active, maps)
        shift = 1
        while shift < len(maps):  # composes the map of each chunk with those of all before it
            maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), axis=1)
            shift *= 2
        state = np.full(len(start), BETWEEN, np.uint8)
        state[1:] = maps[:-1, 0]
        state[within == 0] = BETWEEN
        marks = np.zeros(n, np.uint8)
        self._read(kinds, start, order, active, state[:, None], marks)
        begins = (marks & HERE).astype(bool)
        begins[:-1] |= (marks[1:] & BEFORE).astype(bool)
        begins[:-1] &= ~(marks[1:] & NOT_BEFORE).astype(bool)
        return begins

    def _read(self, kinds, start, order, active, states: np.ndarray, marks: np.ndarray | None = None) -> None:
        """All chunks read in step, each from the states in its row, which become those after it."""
        table, now = self.next.ravel(), states[order].astype(np.intp)
        at = start[order]
        for j in range(self.CHUNK):
            m = active[j]
            if not m:
                break
            row = kinds[at[:m] + j, None] * self.STATES + now[:m]
            if marks is not None:
                marks[at[:m] + j] = self.marks.ravel()[row[:, 0]]
            now[:m] = table[row]
        states[order] = now


class TokenTransducer:
    """Counts the tokens of words byte by byte; its states are compiled when they are first reached."""

    CHUNK = 256

    def __init__(self, spec: str, most_states: int = 250_000):
        parsed = json.loads(spec)
        model, letters = parsed["model"], _byte_letters()
        added = {t["content"] for t in parsed["added_tokens"]}
        spelled = {p: bytes(map(letters.__getitem__, p)) for p in model["vocab"] if p not in added}
        self.pieces = sorted(spelled.values())
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, (a, b) in enumerate(pairs):
            self.rank[spelled[a], spelled[b]] = i
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("a byte is no piece of this tokenizer")
        self.children: list[dict[int, int]] = [{}]
        self.piece_at = [-1]
        for piece, i in self.ids.items():
            if self.merge(piece) != [piece]:  # no merging makes it
                continue
            node = 0
            for b in piece:
                after = self.children[node].get(b)
                if after is None:
                    after = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.piece_at.append(-1)
                node = after
            self.piece_at[node] = i
        self.most_states = most_states
        self.fits: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone."""
        self.states = [array("i", (0, -1, 0)).tobytes()]
        self.known = {self.states[0]: 0}
        self.keys = np.zeros(0, np.int64)
        self._make_room(1 << 16)

    def _make_room(self, slots: int) -> None:
        """Transitions by state << 8 | byte, in a table of `slots` places of which at most half are taken; a taken place leads to the next."""
        kept = self.keys >= 0
        moved = [c[kept].tolist() for c in (self.keys, self.after, self.added)] if kept.any() else []
        self.slots, self.taken = slots, 0
        self.keys, self.after, self.added = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int8)
        for transition in zip(*moved, strict=True):
            self._put(*transition)

    def _put(self, key: int, after: int, added: int) -> None:
        place = key * _SPREAD % self.slots
        while self.keys[place] >= 0:
            place = (place + 1) % self.slots
        self.keys[place], self.after[place], self.added[place] = key, after, added
        self.taken += 1

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where the transitions are, -1 for those that are not compiled."""
        place = keys * _SPREAD % self.slots
        found = self.keys[place]
        open_ = np.flatnonzero(found != keys)
        while open_.size:
            empty = found[open_] < 0
            place[open_[empty]] = -1
            open_ = open_[~empty]
            place[open_] = (place[open_] + 1) % self.slots
            found[open_] = self.keys[place[open_]]
            open_ = open_[found[open_] != keys[open_]]
        return place

    def merge(self, text: bytes) -> list[bytes]:
        """Pieces of a short text by merging: of neighbours those of the least rank, of equals the leftmost."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(parts, parts[1:])]
            least = min(ranks)
            if least == len(self.rank):
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stays(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are next to one another."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= 1_000_000:
                self.fits.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self.fits[left, right] = self.merge(a + b) == [a, b]
        return known

    def compile(self, state: int, byte: int) -> None:
        """Fill in one transition.

        An encoding of all bytes so far ends in exactly one piece, namely the one that stays next to the piece before it.
        """
        own = array("i")
        own.frombytes(self.states[state])
        ends = zip(own[::3], own[1::3], own[2::3], strict=True)
        grown = [(self.children[node][byte], left, tokens) for node, left, tokens in ends if byte in self.children[node]]
        last, added = next(
            (piece, tokens + 1) for node, left, tokens in grown if (piece := self.piece_at[node]) >= 0 and (left < 0 or self.stays(left, piece))
        )
        after = array("i")
        for node, left, tokens in grown:
            if self.children[node]:
                after.extend((node, left, tokens - added))
        after.extend((0, last, 0))
        name = after.tobytes()
        number = self.known.get(name)
        if number is None:
            number = self.known[name] = len(self.states)
            self.states.append(name)
        if 2 * self.taken >= self.slots:
            self._make_room(2 * self.slots)
        self._put(state << 8 | byte, number, added)

    def read(self, data: np.ndarray, resets: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after, tokens added) of chunks of `data` read in step, each from its own state."""
        order = np.argsort(-length, kind="stable")
        at, now, tokens = start[order], state[order].astype(np.int64), np.zeros(len(order), np.int64)
        longest = int(length.max(initial=0))
        active = np.searchsorted(-length[order], -np.arange(longest), side="left")
        for j in range(longest):
            m = active[j]
            place = at[:m] + j
            keys = np.where(resets[place], 0, now[:m]) << 8 | data[place]
            found = self._places(keys)
            if (lacking := found < 0).any():
                for key in np.unique(keys[lacking]).tolist():
                    self.compile(key >> 8, key & 255)
                found = self._places(keys)
            tokens[:m] += self.added[found]
            now[:m] = self.after[found]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], tokens[back]

    def count(self, data: np.ndarray, resets: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each text data[first:end]; a word begins with each text."""
        if len(self.states) > self.most_states:
            self.forget()
        grid = -(-(end - first) // self.CHUNK)
        owner = np.repeat(np.arange(len(first)), grid)
        start = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(grid) - grid, grid)) * self.CHUNK
        marks = np.append(np.flatnonzero(resets), len(data))
        mark = marks[np.searchsorted(marks, start)]  # chunks begin at words, where one begins early enough
        start = np.where(mark < np.minimum(start + self.CHUNK, end[owner]), mark, start)
        stop = np.append(start[1:], 0)
        final = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        stop[final] = end[owner[final]]
        after, tokens = self.read(data, resets, start, stop - start, np.zeros(len(start), np.int64))
        inside = np.flatnonzero(~resets[start])
        if inside.size:
            tokens[inside] = self._compose(data, resets, start, stop, after, inside)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, owner, tokens)
        return total

    def _compose(self, data, resets, start, stop, after, inside: np.ndarray) -> np.ndarray:
        """Tokens of the chunks `inside`, which begin within a word; a run of them follows a chunk whose end is known.

        Chunks of equal bytes share a map, a row for each state that was asked for. What leads from row to row is doubled
        until each run knows how far it gets; where it stops, a state is asked for, and the map gains a row.
        """
        content: dict[bytes, int] = {}
        kind = np.array([content.setdefault(data[a:b].tobytes() + resets[a:b].tobytes(), len(content)) for a, b in zip(start[inside], stop[inside], strict=True)])
        example = np.zeros(len(content), np.int64)
        example[kind] = inside
        head = np.append(True, np.diff(inside) != 1)
        run = np.cumsum(head) - 1
        begins, ends = np.flatnonzero(head), np.append(np.flatnonzero(head)[1:], len(inside))
        known = after[inside[begins] - 1]  # the state before each run
        # The state after a chunk read from the start state is a good guess at what comes before the next one.
        ask = np.unique(kind << 32 | after[inside - 1])
        rows = np.zeros((0, 3), np.int64)  # (map << 32 | state before, state after, tokens), in order
        while True:
            at = example[ask >> 32]
            then, n = self.read(data, resets, start[at], stop[at] - start[at], ask & 0xFFFFFFFF)
            rows = np.concatenate([rows, np.column_stack([ask, then, n])])
            rows = rows[np.argsort(rows[:, 0])]
            low, high = np.searchsorted(rows[:, 0], kind << 32), np.searchsorted(rows[:, 0], (kind + 1) << 32)
            own = np.repeat(np.arange(len(inside)), high - low)  # one node for each chunk and row of its map
            offset = np.cumsum(high - low) - (high - low)
            row = np.arange(len(own)) - offset[own] + low[own]

            def node(chunk: np.ndarray, state: np.ndarray) -> np.ndarray:
                """The node of a chunk's row for a state, -1 if its map lacks that state."""
                key = kind[chunk] << 32 | state
                found = np.searchsorted(rows[:, 0], key)
                there = (found < len(rows)) & (rows[np.minimum(found, len(rows) - 1), 0] == key)
                return np.where(there, offset[chunk] + found - low[chunk], -1)

            following = np.minimum(own + 1, len(inside) - 1)
            leads = np.where((own + 1 < len(inside)) & (run[following] == run[own]), node(following, rows[row, 1]), -1)
            place, reach = node(begins, known), np.arange(len(own))
            while (leads >= 0).any():
                on = leads >= 0
                reach = np.where(on, reach[leads], reach)
                leads = np.where(on, leads[leads], -1)
            stopped = np.where(place >= 0, reach[place], -1)
            chunk = np.where(place >= 0, own[stopped] + 1, begins)  # of each run the first chunk not reached
            state = np.where(place >= 0, rows[row[stopped], 1], known)
            short = chunk < ends
            if not short.any():
                break
            ask = np.unique(kind[chunk[short]] << 32 | state[short])
        # Each run's path, walked from its first node in step with those of the other runs.
        out, chunk, state = np.zeros(len(inside), np.int64), begins, known
        while chunk.size:
            found = rows[row[node(chunk, state)]]
            out[chunk] = found[:, 2]
            more = chunk + 1 < ends
            chunk, state, ends = chunk[more] + 1, found[more, 1], ends[more]
        return out


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, code points) of the characters of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    lead, b, c, d = (padded[at + i] for i in range(4))
    b, c, d = b & 63, c & 63, d & 63
    codes = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 31) << 6 | b, np.where(lead < 0xF0, (lead & 15) << 12 | b << 6 | c, (lead & 7) << 18 | b << 12 | c << 6 | d)))
    return at, codes


class Counter:
    """Both transducers, and the special strings that stand for a token each."""

    BLOCK = 1 << 20

    def __init__(self, spec: str, classes: list[tuple[int, int]]):
        self.words, self.tokens = WordTransducer(classes), TokenTransducer(spec)
        self.special = [t["content"].encode() for t in json.loads(spec)["added_tokens"]]

    def _segments(self, data: bytes, offsets: list[int]) -> Iterator[tuple[int, int, int]]:
        """(text, begin, end): texts split at special strings, each of which comes as (text, begin, begin)."""
        hits = []
        for special in self.special:
            at = data.find(special)
            while at >= 0:
                hits.append((at, -len(special)))
                at = data.find(special, at + 1)
        hits.sort()
        which = 0
        for text, (begin, end) in enumerate(zip(offsets, offsets[1:])):
            while which < len(hits) and hits[which][0] < end:
                at, size = hits[which]
                which += 1
                if at < begin or at - size > end:  # within the one before, or across the end of the text
                    continue
                if at > begin:
                    yield text, begin, at
                yield text, at, at
                begin = at - size
            if begin < end:
                yield text, begin, end

    def _pieces(self, data: bytes, begin: int, end: int) -> Iterator[tuple[int, int]]:
        """A long text cut where white space follows another ASCII character, as a word always begins there."""
        while end - begin > self.BLOCK:
            cut = begin + self.BLOCK
            while cut < end and not (data[cut] in b" \n" and 0x20 < data[cut - 1] < 0x7F):
                cut += 1
            yield begin, cut
            begin = cut
        if begin < end:
            yield begin, end

    def count(self, data: bytes, offsets: list[int]) -> np.ndarray:
        """Tokens of the texts that lie in `data` between neighbouring offsets, a block of about a million bytes at a time."""
        total = np.zeros(len(offsets) - 1, np.int64)
        block: list[tuple[int, int, int]] = []
        size = 0
        for text, begin, end in self._segments(data, offsets):
            if begin == end:
                total[text] += 1
            for a, b in self._pieces(data, begin, end):
                block.append((text, a, b))
                size += b - a
                if size >= self.BLOCK:
                    self._count_block(data, block, total)
                    block, size = [], 0
        if block:
            self._count_block(data, block, total)
        return total

    def _count_block(self, data: bytes, block: list[tuple[int, int, int]], total: np.ndarray) -> None:
        joined = np.frombuffer(b"".join(data[a:b] for _, a, b in block), np.uint8)
        end = np.cumsum([b - a for _, a, b in block])
        first = np.append(0, end[:-1])
        at, codes = _characters(joined)
        resets = np.zeros(len(joined), bool)
        resets[at[self.words.begins(codes, np.searchsorted(at, first))]] = True
        np.add.at(total, [text for text, _, _ in block], self.tokens.count(joined, resets, first, end))


@lru_cache(maxsize=2)
def _counter(spec: str, classes: tuple[tuple[int, int], ...]) -> Counter:
    """One counter for all tasks of a Python worker."""
    return Counter(spec, list(classes))


def token_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = 512, tokenizer: tuple[str, list[tuple[int, int]]] | None = None) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit), one row per row of `docs`, repeated rows included.

    The tokens are those that the tokenizer's library gives for the whole text, without tokens added at its ends; a special
    string within a text is one token. Null counts as empty, and an empty text has no tokens. A text of any length is
    read whole, in blocks; memory follows the longest stretch without white space. Null keys are kept; an empty table gives
    no rows; other columns, whatever their names, are left out. One pass, no shuffle.
    """
    spec, classes = tokenizer or load_tokenizer()
    classes = tuple(classes)
    kept = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = StructType([StructField(key, docs.schema[key].dataType), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec, classes)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            _, places, content = texts.buffers()
            offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            data = content.to_pybytes() if content is not None else b""
            n = counter.count(data, offsets.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=schema.names)

    return kept.mapInArrow(count, schema)
