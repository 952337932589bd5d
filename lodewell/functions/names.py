"""Column names that do not clash."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, base: str) -> str:
    """`base`, with underscores in front until no column of `df` has that name, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base
