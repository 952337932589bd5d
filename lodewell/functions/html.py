"""Main text of web pages, with the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tags whose text does not show, tags without an end, and the containers of the main text, the most
# telling first, as (tag, class or None), and what parts two lines of text besides a line break.
SKIPPED = {"script", "style", "nav", "header", "footer", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = [("article", None), ("main", None), ("div", "content"), ("div", "article"), ("body", None)]
GAP = "  "


class _Texts(HTMLParser):
    """Text lines, and for each kind of container those inside its first occurrence."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden = 0
        self.inside: dict[int, int] = {}  # container -> depth at which it was opened
        self.done: set[int] = set()
        self.found: dict[int, list[str]] = {}
        self.all: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.open.append(tag)
        self.hidden += tag in SKIPPED
        classes = (dict(attrs).get("class") or "").split()
        for i, (name, wanted) in enumerate(CONTAINERS):
            if name == tag and (wanted is None or wanted in classes) and i not in self.inside and i not in self.done:
                self.inside[i], self.found[i] = len(self.open), []

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            self.hidden -= last in SKIPPED
            for i, depth in list(self.inside.items()):
                if depth > len(self.open):
                    del self.inside[i]
                    self.done.add(i)
            if last == tag:
                break

    def handle_data(self, data):
        if not self.hidden:
            self.all.append(data)
            for i in self.inside:
                self.found[i].append(data)


def main_text(html: str | None) -> str:
    """Text of the first container there is, a line for each piece of text, blank lines dropped; '' on no text."""
    if not html:
        return ""
    parser = _Texts()
    parser.feed(html)
    parser.close()
    pieces = next((parser.found[i] for i in range(len(CONTAINERS)) if i in parser.found), parser.all)
    lines = "\n".join(pieces).replace(GAP, "\n").splitlines()
    return "\n".join(filter(None, map(str.strip, lines)))


@F.pandas_udf(StringType())
def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(main_text)


def extract_content(html: Column | str) -> Column:
    return _extract(html)


def extracted(html: Column) -> Column:
    """struct<content, error> of a page, one of them null: a page that is missing, or has no text, is an error."""
    text = F.nullif(extract_content(html), F.lit(""))
    error = F.when(F.coalesce(html, F.lit("")) == "", "no page").when(text.isNull(), "no text")
    return F.struct(text.alias("content"), error.alias("error"))
