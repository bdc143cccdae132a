"""Live reading against a local server, the reading job, the command line, and streams."""

import datetime as dt
import io
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from feedloom import cli
from feedloom.plans.reader import FeedError, FeedJob, write_lines
from feedloom.sources.http import Client, http_get, read_feed

ATOM = '<feed xmlns="http://www.w3.org/2005/Atom">{}</feed>'


class Site:
    def __init__(self):
        self.pages, self.asked = {}, []
        site = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                site.asked.append((self.path, time.monotonic(), self.headers.get("User-Agent")))
                got = site.pages.get(self.path, (404, "text/plain", "gone"))
                status, kind, body = got
                self.send_response(status)
                if status in (301, 302):
                    self.send_header("Location", body)
                    body = ""
                data = body if isinstance(body, bytes) else body.encode()
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.base = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def json(self, path, *ids, next_url=None, **more):
        items = [i if isinstance(i, dict) else {"id": i} for i in ids]
        self.pages[path] = (200, "application/feed+json", json.dumps({"version": "https://jsonfeed.org/version/1.1", "title": path, "next_url": next_url, "items": items} | more))

    def rss(self, path, *ids):
        inner = "".join(f"<item><guid>{i}</guid></item>" for i in ids)
        self.pages[path] = (200, "application/rss+xml", f"<rss><channel><generator>https://wordpress.org/?v=6</generator>{inner}</channel></rss>")

    def urls(self):
        return [a[0] for a in self.asked]


@pytest.fixture()
def site():
    s = Site()
    yield s
    s.server.shutdown()


def pages(site, path, **k):
    return [(n, r.error, r.status) for n, r in read_feed(site.base + path, http_get, **k)]


def test_explicit_pages_cycles_and_limits(site):
    site.json("/f", "one", next_url="/f?p=2#x")
    site.json("/f?p=2", "two", next_url="/f")
    assert pages(site, "/f") == [(1, None, 200), (2, None, 200)] and site.urls() == ["/f", "/f?p=2"]
    assert pages(site, "/f", max_pages=1) == [(1, None, 200)]


def test_guessed_pages(site):
    site.rss("/feed?a=1", "one", "same")
    site.rss("/feed?a=1&paged=2", "same", "two")
    assert pages(site, "/feed?a=1") == [(1, None, 200), (2, None, 200)] and site.urls()[-1] == "/feed?a=1&paged=3"
    site.rss("/feed?a=1&paged=3", "two")  # adds nothing
    site.asked.clear()
    assert len(pages(site, "/feed?a=1")) == 3 and len(site.urls()) == 3
    site.pages["/feed?a=1&paged=2"] = (500, "text/plain", "")
    assert pages(site, "/feed?a=1")[-1] == (2, "HTTP_STATUS", 500)
    site.rss("/empty")
    site.asked.clear()
    assert len(pages(site, "/empty")) == 1 and site.urls() == ["/empty"]


def test_redirects_and_discovery(site):
    site.pages["/old"] = (301, "", "/new")
    site.json("/new", "one", next_url="?p=2")
    site.json("/new?p=2", "two", next_url="/old")
    got = list(read_feed(site.base + "/old", http_get))
    assert [r.source_url for _, r in got] == [site.base + "/new", site.base + "/new?p=2"]
    site.pages["/"] = (200, "text/html", '<link rel="alternate" type="application/rss+xml" href="/new"><link rel=feed href="/x">')
    assert len(pages(site, "/", max_pages=1)) == 1
    site.pages["/none"] = (200, "text/html", "<p>no</p>")
    assert pages(site, "/none") == [(1, "NO_FEED_FOUND", 200)]
    assert pages(site, "/", discovery=False) == [(1, "NOT_FEED", 200)]
    site.json("/p", "one", next_url="/none")
    assert pages(site, "/p") == [(1, None, 200), (2, "NOT_FEED", 200)]
    assert http_get("ftp://x/").error == "INVALID_URL" and http_get("http://127.0.0.1:1/").error == "NETWORK"


def test_early_stop(site):
    day = lambda d: {"id": str(d), "date_published": f"2024-02-{d:02d}T00:00:00Z"}
    site.json("/f", day(9), day(8), next_url="/f?p=2")
    site.json("/f?p=2", day(7), day(6), day(5), next_url="/f?p=3")
    site.json("/f?p=3", day(4))
    since = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    assert len(pages(site, "/f", since=since)) == 2
    assert len(pages(site, "/f", since=dt.datetime(2024, 2, 5, tzinfo=dt.timezone.utc))) == 3
    assert len(pages(site, "/f")) == 3


class Reply:
    def __init__(self, status=200, body=b"", **headers):
        self.status, self.headers, self.body = status, headers, body

    def read(self, n):
        out, self.body = self.body[:n], self.body[n:]
        return out


def test_requests_to_a_host_keep_their_distance():
    times = []

    def transport(url, headers, seconds):
        times.append(time.monotonic())
        return Reply(302, Location="/moved") if url.endswith("/hop") else Reply()

    get = Client(interval=0.2, transport=transport)
    for u in ("http://a.example/1", "http://A.example:80/2", "http://b.example/", "http://a.example./3"):
        get(u)
    assert times[1] - times[0] >= 0.19 and times[2] - times[1] < 0.15 and times[3] - times[1] >= 0.19
    # a redirect is a request of its own
    times.clear()
    r = get("http://c.example/hop")
    assert r.source_url == "http://c.example/moved" and times[1] - times[0] >= 0.19


def test_the_whole_request_has_a_time():
    class Slow(Reply):
        def read(self, n):
            time.sleep(0.1)
            return b"x"

    t = time.monotonic()
    assert Client(timeout=0.3, transport=lambda *a: Slow())("http://a.example/").error == "NETWORK" and time.monotonic() - t < 1
    r = Client(transport=lambda u, h, s: Reply(301, Location="/again"))("http://a.example/")
    assert r.error == "NETWORK" and "redirects" in r.message
    assert Client(transport=lambda u, h, s: Reply(301, Location="ftp://x/"))("http://a.example/").error == "INVALID_URL"


def from_memory(url, headers, seconds):
    return Reply(200, json.dumps({"version": "https://jsonfeed.org/version/1", "items": [{"id": url}]}).encode())


def test_addresses_from_a_table(spark):
    """With a transport of one's own, named so that the tasks can import it."""
    import sys

    sys.modules.setdefault("feedloom_test_transport", sys.modules[__name__])
    table = spark.createDataFrame([(k, f"https://h{k % 5}.example/{k}") for k in range(20)] + [(20, None)], "feed_idx int, url string")
    job = FeedJob(transport="feedloom.sources.http:open_once", at_once=3)
    assert job._options()["transport"] == "feedloom.sources.http:open_once"
    docs = job.fetch_table(table.where("url is null"), interval="0")
    assert [(r.feed_idx, r.error) for r in docs.collect()] == [(20, "INVALID_URL")]
    from feedloom.sources.http import FeedReader, documents

    assert documents(table, {"atOnce": "3"}).rdd.getNumPartitions() == 3
    parts = FeedReader({"urls": json.dumps([f"https://h{k % 5}.example/{k}" for k in range(20)]), "atOnce": "3"}).partitions()
    hosts = [{u.split("/")[2] for _, u in p.feeds} for p in parts]
    assert len(parts) == 3 and sum(map(len, hosts)) == 5 and sum(len(p.feeds) for p in parts) == 20


def test_data_source_and_job(spark, site):
    site.json("/a", {"id": "1", "title": "A", "date_published": "2024-01-15T00:00:00Z", "tags": ["go"]}, {"id": "1"}, next_url="/a?p=2")
    site.json("/a?p=2", {"id": "2", "title": "B", "date_published": "2024-02-15T00:00:00Z"}, {"id": "1"})
    site.json("/b", {"id": "1", "title": "C"})
    every = [site.base + "/a", site.base + "/b", site.base + "/a"]
    job = FeedJob(with_feed=True, jq="[.id, ._feed.title] | @tsv", raw=True, user_agent="tester/1")
    assert list(job.run(spark, every, interval="0")) == ["1\t/a", "2\t/a?p=2", "1\t/b", "1\t/a", "2\t/a?p=2"]
    assert {a[2] for a in site.asked} == {"tester/1"}
    assert list(FeedJob(since="2024-01-01", until="2024-02-01").run(spark, every[:1], interval="0")) == ['{"date_published":"2024-01-15T00:00:00Z","id":"1","tags":["go"],"title":"A"}']
    lines = FeedJob(jq=".id").run(spark, [every[1], site.base + "/missing", every[0]], interval="0")
    got = []
    with pytest.raises(FeedError, match="404") as e:
        for x in lines:
            got.append(x)
    assert got == ['"1"'] and e.value.feed_idx == 1


def test_wrong_options():
    for bad in ({"max_pages": 0}, {"since": "2024-02-01", "until": "2024-01-01"}, {"user_agent": " "}, {"raw": True}, {"jq": "["}, {"since": "now"}):
        with pytest.raises(ValueError):
            FeedJob(**bad)


def test_written_lines_are_in_order(spark, tmp_path):
    df = spark.createDataFrame([(f, p, k, 0, f"{f}-{p}-{k}") for f in range(5) for p in range(3) for k in range(4)], "feed_idx int, page int, pos int, out_pos int, value string").repartition(6)
    write_lines(df, str(tmp_path / "out"))
    got = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().split()]
    assert got == [f"{f}-{p}-{k}" for f in range(5) for p in range(3) for k in range(4)]


def run(argv, stdin="", **k):
    out, err = io.StringIO(), io.StringIO()
    return cli.main(argv, io.StringIO(stdin), out, err, **k), out.getvalue(), err.getvalue()


def test_command_line(spark, site):
    site.json("/a", {"id": "1", "title": "A", "date_published": "2024-01-15T00:00:00Z"}, {"id": "2"})
    assert run(["--version"])[0] == 0
    for argv, message in (([], "address"), (["-r", "u"], "program"), (["--all", "--since", "2024-01-01", "u"], "--all"), (["--all", "--updated", "u"], "--updated"), (["--since", "x", "u"], "is no time"), (["--max-pages", "0", "u"], "pages"), (["--jq", "[", "u"], "no jq program")):
        code, out, err = run(argv)
        assert code == 1 and message in err and not out
    code, out, err = run(["--all", "--jq", ".title // .id", "-r", site.base + "/a"], stdin=f"\n {site.base}/a \n", spark=spark, interval="0")
    assert (code, out.split(), err) == (0, ["A", "2", "A", "2"], "")
    assert run([site.base + "/a"], spark=spark, interval="0")[1] == ""  # older than a week
    code, out, err = run(["--all", site.base + "/no"], spark=spark, interval="0")
    assert code == 1 and "404" in err
    job = cli.job(cli.parser().parse_args(["u"]), now=dt.datetime(2024, 1, 8, tzinfo=dt.timezone.utc))
    assert job.since == dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    parsed = cli.parser().parse_args(["--since", "2024-06-01", "u"])
    assert cli.job(parsed, zone="Asia/Tokyo").since == dt.datetime(2024, 5, 31, 15, tzinfo=dt.timezone.utc)
    assert cli.job(parsed).since == dt.datetime(2024, 6, 1).astimezone()


def test_streams(spark, tmp_path):
    from feedloom.operators import redelivery
    from feedloom.session import scratch_path
    from feedloom.streaming import feeds as streams

    doc = lambda *ids: json.dumps({"version": "https://jsonfeed.org/version/1.1", "items": [{"id": i} for i in ids]}).encode()
    schema = "feed_idx int, page int, body binary, source_url string, content_type string, fetched_at timestamp"
    t = dt.datetime(2024, 1, 1)
    for n, rows in enumerate([[(0, 1, doc("a", "a", "b"), "https://e.example/", "", t)], [(0, 2, doc("b", "c"), "https://e.example/", "", t), (1, 1, doc("a"), "https://e.example/", "", t)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
        time.sleep(0.02)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    q = streams.stream_items(src).select("feed_idx", "id").writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("seen").collect())) == [(0, "a"), (0, "b"), (0, "c"), (1, "a")]
    from pyspark.sql import functions as F

    from feedloom.operators import feeds

    flat = feeds.parse(src).where("parsed.error is null").select("feed_idx", "page", F.posexplode("parsed.items").alias("pos", "item")).select("feed_idx", "page", "pos", "item.id")
    q = streams.first_occurrences(flat).writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.feed_idx, r.id) for r in spark.table("firsts").collect()) == [(0, "a"), (0, "b"), (0, "c"), (1, "a")]
    rows = [(k, 0, k // 3, f"i{k % 4}", None) for k in range(12)]
    spark.createDataFrame(rows, "item_row bigint, feed_idx int, batch_id bigint, id string, url string").repartition(3).write.parquet(str(tmp_path / "items.parquet"))
    root = scratch_path(spark, "s")
    got = streams.deliveries(spark, str(tmp_path), root, redelivery.entry_key(), "item_row", lambda col: col("batch_id"), "item_row", "feed_idx", "batch_id", "id", "url")
    assert sorted(r.item_row for r in got.collect()) == [0, 1, 2, 3]
    again = streams.deliveries(spark, str(tmp_path), root, redelivery.entry_key(), "item_row", lambda col: col("batch_id"), "item_row", "feed_idx", "batch_id", "id", "url")
    assert sorted(r.item_row for r in again.collect()) == [0, 1, 2, 3]


def test_sql_functions(spark):
    from feedloom.plans import sql

    sql.register(spark)
    spark.createDataFrame([(1, b'<html><link rel=feed href="/a">', "https://e.example/"), (2, None, None), (3, b"<rss>", "https://e.example/")], "k int, body binary, u string").createOrReplaceTempView("t")
    assert [tuple(r) for r in spark.sql("select k, f.url from t, lateral feed_links(body, u, null) f").collect()] == [(1, "https://e.example/a")]
    assert [r.e for r in spark.sql("select feed_parse(body, u).error as e from t order by k").collect()] == ["NOT_FEED", "INVALID_URL", "NOT_FEED"]
    assert [tuple(r) for r in spark.sql("""select j.* from values ('{"a":[1,2]}'), (null) v(x), lateral jq(x, '.a[]') j""").collect()] == [(0, "1"), (1, "2")]
