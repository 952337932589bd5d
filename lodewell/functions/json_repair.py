"""Repair of JSON that a model's answer broke off."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodewell.functions.text import bound


def repair(text: str) -> str:
    """The text with an open string and all open brackets closed, and commas before a closing bracket removed."""
    closing, out, quoted, escaped = [], [], False, False
    for c in text.strip():
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            closing.append("}" if c == "{" else "]")
        elif c in "}]":
            if closing:
                closing.pop()
            _drop_comma(out)
        out.append(c)
    if quoted:
        out.append('"')
    _drop_comma(out)
    return "".join(out) + "".join(reversed(closing))


def _drop_comma(out: list[str]) -> None:
    while out and (out[-1].isspace() or out[-1] == ","):
        out.pop()


def repaired(c: Column | str) -> Column:
    @F.pandas_udf("string")
    def mend(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else repair(t))

    return mend(c)


def parsed(c: Column, schema: str) -> Column:
    """from_json of the text, or of its repair where the text is no JSON."""
    # Python sees broken texts only: an expression of a UDF is evaluated for every row, whatever branch it is in.
    mended = repaired(bound(F.col(c) if isinstance(c, str) else c, lambda t: F.when(F.try_parse_json(t).isNull(), t)))
    return F.from_json(F.coalesce(mended, c), schema)
