"""Live feeds against a local server: a batch, a stream, and its restart."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lodewell.sources import rss


def feed(*names):
    items = "".join(f"<item><title>T {n}</title><link>http://x/{n}</link><description>D</description></item>" for n in names)
    return f"<rss><channel>{items}</channel></rss>"


@pytest.fixture
def served():
    """(base url, pages): what the server gives for each path; an integer is a status."""
    pages = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = pages.get(self.path, 404)
            self.send_response(page if isinstance(page, int) else 200)
            self.end_headers()
            self.wfile.write(b"" if isinstance(page, int) else page.encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", pages
    server.shutdown()


def test_a_batch_has_one_error_row_for_each_failed_feed(spark, served):
    base, pages = served
    pages.update({"/a": feed(1, 2), "/b": 500, "/c": "<rss><item>", "/d": feed(3)})
    spark.dataSource.register(rss.FeedSource)
    urls = " ".join(base + p for p in ("/a", "/b", "/c", "/d"))
    df = spark.read.format("feeds").option("urls", urls).option("retries", 0).load()
    rows = df.collect()
    assert sorted(r["source_url"] for r in rows if r["error"] is None) == ["http://x/1", "http://x/2", "http://x/3"]
    assert sorted((r["source_name"][len(base) :], r["error"].split(":")[0]) for r in rows if r["error"]) == [("/b", "HTTPError"), ("/c", "ValueError")]
    assert rss.parse_entries(df).count() == 3


def test_a_stream_reads_each_entry_once_over_restarts(spark, served, tmp_path):
    base, pages = served
    urls = [base + p for p in ("/a", "/b")]

    def run():
        stream = rss.live(spark, urls, retries=0)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.schema(rss.FEED).parquet(str(tmp_path / "out")).collect()
        return sorted(r["source_url"].split("/")[-1] for r in rows if r["source_url"]), [r["source_name"][len(base) :] for r in rows if r["error"]]

    pages.update({"/a": feed(1, 2), "/b": 500})
    assert run() == (["1", "2"], ["/b"])
    assert run() == (["1", "2"], ["/b"])  # nothing new
    pages.update({"/a": feed(2, 3), "/b": feed(9)})
    assert run() == (["1", "2", "3", "9"], ["/b"])
    pages.update({"/a": feed(1, 3, 4)})  # an entry comes back
    assert run() == (["1", "2", "3", "4", "9"], ["/b"])


def test_a_planned_batch_is_read_again_after_a_restart(served):
    base, pages = served
    pages["/a"] = feed(1, 2)
    first = rss._FeedStream([base + "/a"], {"retries": 0})
    start, middle = first.initialOffset(), first.latestOffset()
    pages["/a"] = feed(1, 2, 3)
    end = first.latestOffset()
    again = rss._FeedStream([base + "/a"], {"retries": 0})
    links = lambda reader, a, b: sorted(r[1] for p in reader.partitions(a, b) for r in reader.read(p))
    assert links(again, start, middle) == ["http://x/1", "http://x/2"] and links(again, middle, end) == ["http://x/3"] and links(again, end, end) == []
