"""News feeds: landed XML files, a live Python data source, and rows of entries."""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ENTRY = "source_name string, source_url string, original_title string, original_description string, published string"

_ATOM = "{http://www.w3.org/2005/Atom}"


def entries(xml: str, source: str) -> Iterator[tuple]:
    """Rows of an RSS or Atom document; a malformed one raises ValueError."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        raise ValueError(f"malformed feed {source}: {e}") from e

    def text(node, *names):
        for n in names:
            found = node.find(n)
            if found is not None and (found.text or "").strip():
                return found.text.strip()
        return None

    for item in root.iter("item"):
        yield source, text(item, "link"), text(item, "title"), text(item, "description"), _iso(text(item, "pubDate"))
    for item in root.iter(f"{_ATOM}entry"):
        link = item.find(f"{_ATOM}link")
        url = link.get("href") if link is not None else None
        yield source, url, text(item, f"{_ATOM}title"), text(item, f"{_ATOM}summary", f"{_ATOM}content"), text(item, f"{_ATOM}published", f"{_ATOM}updated")


def _iso(date: str | None) -> str | None:
    try:
        return parsedate_to_datetime(date).isoformat() if date else None
    except (TypeError, ValueError):
        return date


def parse_entries(df: DataFrame) -> DataFrame:
    """Entries with link and title, dates in UTC (naive ones taken as UTC), and their content hash."""
    from lodewell.functions.text import content_hash

    usable = df.where((F.coalesce("source_url", F.lit("")) != "") & (F.coalesce("original_title", F.lit("")) != ""))
    return usable.withColumns({"published_at": F.try_to_timestamp("published"), "content_hash": content_hash(F.col("original_title"), F.col("original_description"))}).drop("published")


def read_landed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) of feed files below `path`; a malformed feed is an error row and stops no other."""
    names = [field.split()[0] for field in ENTRY.split(", ")]
    files = spark.read.text(path, wholetext=True).withColumn("source", F.input_file_name())

    @F.pandas_udf(f"struct<rows:array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>,error:string>")
    def parse(xml: pd.Series, source: pd.Series) -> pd.DataFrame:
        out = []
        for x, s in zip(xml, source, strict=True):
            try:
                out.append({"rows": [dict(zip(names, row, strict=True)) for row in entries(x, s)], "error": None})
            except ValueError as e:
                out.append({"rows": [], "error": str(e)})
        return pd.DataFrame(out)

    parsed = files.select("source", parse("value", "source").alias("p"))
    return parsed.select(F.inline("p.rows")), parsed.where("p.error IS NOT NULL").select("source", F.col("p.error").alias("error"))


def fetch(url: str, *, retries: int = 3, delay: float = 1.0, opener=urllib.request.urlopen, sleep=time.sleep) -> str:
    """The body of a URL; network errors are tried again with doubled delays, an HTTP status is final."""
    for attempt in range(retries + 1):
        try:
            with opener(url, timeout=30) as response:
                return response.read().decode("utf-8", "replace")
        except urllib.error.HTTPError:
            raise
        except OSError:
            if attempt == retries:
                raise
            sleep(delay * 2**attempt)
    raise AssertionError("unreachable")


FEED = f"{ENTRY}, error string"


def poll(url: str, **settings) -> tuple[list[tuple], str | None]:
    """(rows of a feed, error): of a feed that can't be fetched or read no rows, and why."""
    try:
        return [(*row, None) for row in entries(fetch(url, **settings), url)], None
    except (OSError, ValueError) as e:
        return [], f"{type(e).__name__}: {e}"


def _failed(url: str, error: str) -> tuple:
    return (url, None, None, None, None, error)


class FeedSource(DataSource):
    """`spark.read` or `spark.readStream`, `.format("feeds").option("urls", "...")`: a partition for each feed, separated by
    white space. A feed that fails gives one row, with `error`, and stops no other. `retries` and `delay` are options."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return FEED

    def _settings(self) -> dict:
        return {"retries": int(self.options.get("retries", 3)), "delay": float(self.options.get("delay", 1.0))}

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options["urls"].split(), self._settings())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FeedStream(self.options["urls"].split(), self._settings())


class _FeedReader(DataSourceReader):
    def __init__(self, urls: list[str], settings: dict):
        self.urls, self.settings = urls, settings

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows, error = poll(partition.value, **self.settings)
        yield from rows if error is None else [_failed(partition.value, error)]


class _FeedStream(DataSourceStreamReader):
    """Offsets hold, for each feed, a digest of each entry it shows, or the error of the poll.

    A batch consists of the entries that its end shows and its start does not, and of the errors that are new. The entries
    of a poll are kept until its batch is planned; after a restart feeds are polled again for a batch that was planned
    before. An entry that a feed takes back and shows again is read again; `live` drops it.
    """

    def __init__(self, urls: list[str], settings: dict):
        self.urls, self.settings = urls, settings
        self.offset: dict = {}
        self.polled: dict[str, dict[str, tuple]] = {}

    def _poll(self) -> dict:
        with ThreadPoolExecutor(max_workers=16) as pool:
            found = list(pool.map(lambda u: poll(u, **self.settings), self.urls))
        state = {}
        for url, (rows, error) in zip(self.urls, found, strict=True):
            before = self.offset.get(url, {"shown": []})
            if error is None:
                self.polled[url] = {hashlib.sha256(repr(row).encode()).hexdigest()[:16]: row for row in rows}
            state[url] = {"shown": before["shown"], "error": error} if error else {"shown": sorted(self.polled[url]), "error": None}
        return state

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.offset = self._poll()
        return self.offset

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if any(d not in self.polled.get(url, {}) for url, state in end.items() for d in state["shown"]):
            self._poll()  # planned before a restart
        planned = []
        for url, state in end.items():
            before = start.get(url, {"shown": [], "error": None})
            known = self.polled.get(url, {})
            rows = [known[d] for d in state["shown"] if d not in set(before["shown"]) and d in known]
            if state["error"] and state["error"] != before["error"]:
                rows.append(_failed(url, state["error"]))
            if rows:
                planned.append(InputPartition(rows))
        return planned

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.value


def live(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    """A stream of the entries of feeds, each once, and of their errors, each once (`error`; the entry is null then).

    What was seen is state of the stream, so that neither a restart nor an entry that comes back repeats a row.
    """
    spark.dataSource.register(FeedSource)
    reader = spark.readStream.format("feeds").option("urls", " ".join(urls))
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().dropDuplicates(["source_name", "source_url", "error"])
