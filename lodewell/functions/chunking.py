"""Overlapping chunks of text, split where a text divides naturally."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", " ", "")

CHUNK = "array<struct<chunk_number:int,chunk_text:string,chunk_start:int,chunk_end:int>>"


def pieces(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of at most `size` characters that join to the text; a separator stays at the end of its part."""
    if len(text) <= size:
        return [text] if text else []
    for k, separator in enumerate(separators):
        if separator == "":
            return [text[i : i + size] for i in range(0, len(text), size)]
        if separator in text:
            parts = text.split(separator)
            whole = [p + separator for p in parts[:-1]] + [parts[-1]] * bool(parts[-1])
            return [q for p in whole for q in pieces(p, size, separators[k + 1 :])]
    return [text]


def chunks(text: str | None, size: int = 2000, overlap: int = 400) -> list[dict]:
    """Chunks of at most `size` characters, each repeating at most `overlap` of the one before; none of a blank text.

    Parts are gathered until the next does not fit; then as many of the last parts as the overlap allows begin the
    next chunk. White space around a chunk is left out of it and of its offsets.
    """
    if text is None or not text.strip():
        return []
    found, held, start, at = [], [], 0, 0
    for part in pieces(text, size):
        if held and at - start + len(part) > size:
            found.append((start, at))
            while held and (at - start > overlap or at - start + len(part) > size):
                start += held.pop(0)
        held.append(len(part))
        at += len(part)
    found.append((start, at))
    out = []
    for begin, end in found:
        body = text[begin:end]
        inner = body.strip()
        if inner:
            begin += len(body) - len(body.lstrip())
            out.append({"chunk_number": len(out), "chunk_text": inner, "chunk_start": begin, "chunk_end": begin + len(inner)})
    return out


def summary_first(found: list[dict], summary: str | None, size: int = 2000, most: int = 500) -> list[dict]:
    """The summary before the first chunk if it still fits, else as a chunk of its own with offsets 0, 0."""
    if not summary:
        return found
    lead = f"[摘要] {summary[:most]}\n\n---\n\n"
    if found and len(lead) + len(found[0]["chunk_text"]) <= size:
        return [{**found[0], "chunk_text": lead + found[0]["chunk_text"]}, *found[1:]]
    own = {"chunk_number": 0, "chunk_text": lead.strip(), "chunk_start": 0, "chunk_end": 0}
    return [own, *({**c, "chunk_number": c["chunk_number"] + 1} for c in found)]


def chunk_array_summary_first(text: Column | str, summary: Column | str, size: int = 2000, overlap: int = 400, most: int = 500) -> Column:
    """As `chunk_array`, led by the first `most` characters of a summary; an empty or null summary changes nothing."""

    @F.pandas_udf(CHUNK)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, summaries in batches:
            yield pd.Series([summary_first(chunks(t, size, overlap), s, size, most) for t, s in zip(texts, summaries, strict=True)], dtype=object)

    return cut(text, summary)


def chunk_array(text: Column | str, size: int = 2000, overlap: int = 400) -> Column:
    """array<struct<chunk_number, chunk_text, chunk_start, chunk_end>>; `inline` makes rows of it."""

    @F.pandas_udf(CHUNK)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([chunks(t, size, overlap) for t in texts], dtype=object)

    return cut(text)
