import datetime as dt
import hashlib
import json

import pytest

from feedloom.operators import feeds
from feedloom.sources.jsonfeed import generated_id

SRC = "https://harbour.example/out/list.xml"


def parse(body, src=SRC, **k):
    return feeds.parse_document(body if isinstance(body, bytes) else body.encode(), src, **k)


def one(body, src=SRC):
    got = parse(body, src)
    assert got["error"] is None, got["message"]
    return got["items"][0]


def js(**item):
    return json.dumps({"version": "https://jsonfeed.org/version/1.1", "items": [item]})


RSS = '<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>T</title><link>/home</link><generator>https://wordpress.org/?v=6</generator>{}</channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom">{}</feed>'


def test_rss():
    it = one(b"\xef\xbb\xbf" + RSS.format('<atom:link rel="self next" href="?page=2#x"/><item><guid>g</guid><link>posts/1</link><title>A &amp; B</title><description>d</description><content:encoded>&lt;p&gt;c&lt;/p&gt;</content:encoded><pubDate>Mon, 15 Jan 2024 12:00:00 GMT</pubDate><category>x</category><category>y</category><dc:creator>Me</dc:creator><enclosure url="/f.mp3" type="audio/mpeg" length="12"/></item>').encode())
    assert it["id"] == "g" and it["url"] == "https://harbour.example/out/posts/1" and it["title"] == "A & B" and it["content_html"] == "<p>c</p>" and it["summary"] == "d"
    assert it["date_published"] == "2024-01-15T12:00:00Z" and it["tags"] == ["x", "y"] and it["authors"][0]["name"] == "Me"
    assert it["attachments"] == [{"url": "https://harbour.example/f.mp3", "mime_type": "audio/mpeg", "title": None, "size_in_bytes": 12, "duration_in_seconds": None}]
    assert it["_feed"] == {"title": "T", "home_page_url": "https://harbour.example/home", "feed_url": SRC}
    got = parse(RSS.format('<atom:link rel="self next" href="?page=2#x"/>'))
    assert got["next_url"] == "https://harbour.example/out/list.xml?page=2" and got["generator"].startswith("https://wordpress")


@pytest.mark.parametrize("length, size", [("12", 12), ("-1", None), ("0", None), ("", None), (" 5 ", None), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), ("1e3", None)])
def test_enclosure_sizes(length, size):
    assert one(RSS.format(f'<item><guid>g</guid><enclosure url="/f" type="t/t" length="{length}"/></item>'))["attachments"][0]["size_in_bytes"] == size


def test_entries_without_identity_are_dropped():
    got = parse(RSS.format("<item><title>no</title></item><item><link>yes</link></item>"))
    assert [i["id"] for i in got["items"]] == ["https://harbour.example/out/yes"]


def test_atom_bases_and_contents():
    body = ATOM.format(
        '<title>F</title><author><name>N</name><uri>/me</uri></author><link href="/"/>'
        '<entry xml:base="e/"><id>1</id><link href="one"/><content type="html">&lt;a href="x?a=1&amp;amp;b=2"&gt;t&lt;/a&gt;</content></entry>'
        '<entry><id>2</id><link href="two"/><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><img src="i.png"/></div></content></entry>'
        '<entry><id>3</id><content type="text">&lt;em&gt;</content><summary>s</summary></entry><entry><id>4</id><summary>s</summary><updated>2024-01-16T12:00:00+01:00</updated></entry>'
    )
    a, b, c, d = parse(body)["items"]
    assert a["url"] == "https://harbour.example/out/e/one" and a["content_html"] == '<a href="https://harbour.example/out/e/x?a=1&amp;b=2">t</a>'
    assert b["content_html"] == '<img src="https://harbour.example/out/i.png"/>'
    assert c["content_text"] == "<em>" and c["content_html"] is None
    assert d["content_text"] == d["summary"] == "s" and d["date_modified"] == "2024-01-16T12:00:00+01:00" and d["date_published"] is None
    assert a["authors"] == [{"name": "N", "url": "https://harbour.example/me", "avatar": None}]


def test_rewritten_html():
    from feedloom.sources.xmlfeed import rewrite_html

    base = "https://harbour.example/log/"
    for text, want in [
        ('<a href="x?a=1&amp;b=2">t</a>', '<a href="https://harbour.example/log/x?a=1&amp;b=2">t</a>'),
        ("<IMG SRC=i.png alt='a > b'> 3 < 4", '<IMG src="https://harbour.example/log/i.png" alt="a &gt; b"> 3 < 4'),
        ('<!-- <a href="x"> --><p cite=y>', '<!-- <a href="x"> --><p cite="https://harbour.example/log/y">'),
        ('<script src=s.js>var a = \'<a href="x">\';</script><a href=z>', '<script src="https://harbour.example/log/s.js">var a = \'<a href="x">\';</script><a href="https://harbour.example/log/z">'),
        ('<textarea><a href="x"></TEXTAREA><a href=z>', '<textarea><a href="x"></TEXTAREA><a href="https://harbour.example/log/z">'),
        ('<title>open <a href="x">', '<title>open <a href="x">'),
        ("<a href=%zz>", '<a href="%zz">'),
        ("", ""),
    ]:
        assert rewrite_html(text, base) == want


def test_encodings():
    assert one('<?xml version="1.0" encoding="ISO-8859-1"?>'.encode() + ATOM.format("<entry><id>1</id><title>Café</title></entry>").encode("latin-1"))["title"] == "Café"
    assert one('<?xml version="1.0" encoding="Shift_JIS"?>'.encode() + ATOM.format("<entry><id>1</id><title>日本</title></entry>").encode("shift_jis"))["title"] == "日本"


@pytest.mark.parametrize("body", ["not a feed", "", "<html></html>", "<rss>", "<rss/>", "[1]", "{}", js().replace("1.1", "2"), js(id=5), js(tags="x"), js(authors={"name": "x"}), '{"version":"https://jsonfeed.org/version/1","items":{}}', "<a>" * 6000])
def test_no_feeds(body):
    assert parse(body)["error"] == "NOT_FEED"


def test_errors():
    assert parse(js(id="1"), status=404)["error"] == "HTTP_STATUS" and parse(js(id="1"), "ftp://x/")["error"] == "INVALID_URL" and parse(js(id="1"), None)["error"] == "INVALID_URL"
    assert parse(b"x" * (33 << 20))["error"] == "TOO_LARGE"
    assert "HTML" in parse("<!DOCTYPE html><p>")["message"] and "secret" not in parse("x", "https://u:secret@e/")["message"]


def test_json_identity():
    assert one(js(id="", url="u"))["id"] == "u" and one(js(ID="x"))["id"] == "x"
    a = one(js(title="<a> & b", content_text="\u2028"))["id"]
    want = '{"id":"","url":"","external_url":"","title":"\\u003ca\\u003e \\u0026 b","content_html":"","content_text":"\\u2028","summary":"","image":"","banner_image":"","date_published":"","date_modified":"","authors":null,"author":null,"tags":null,"attachments":null}'
    assert a == "urn:sha256:" + hashlib.sha256(want.encode()).hexdigest()
    assert generated_id({"tags": []}) != generated_id({}) and generated_id({"author": {}}) != generated_id({})


def test_json_values():
    it = one(js(id="1", url="/rel", date_published="yesterday", date_modified="2024-01-15T12:00:00.1230+00:00", attachments=[{"url": "u", "mime_type": "m", "size_in_bytes": -1, "duration_in_seconds": 1.5}, {"url": "u"}], author={"name": "A"}, authors=[]))
    assert it["url"] == "/rel" and it["date_published"] is None and it["date_modified"] == "2024-01-15T12:00:00.123Z" and it["authors"][0]["name"] == "A"
    assert it["attachments"] == [{"url": "u", "mime_type": "m", "title": None, "size_in_bytes": None, "duration_in_seconds": 1.5}]


# Date order ---------------------------------------------------------------------------------------------------------------
def items(spark, rows):
    t = lambda x: None if x is None else dt.datetime(2024, *x)
    return spark.createDataFrame([(0, p, k, f"i{n}", t(a), t(b)) for n, (p, k, a, b) in enumerate(rows)], "feed_idx int, page int, pos int, id string, ts_published timestamp, ts_modified timestamp")


def pages(spark, *feeds_, crawl=None):
    """Parsed documents of feeds given as pages of (published, modified) days."""
    iso = lambda d: d and "2024-%02d-%02dT00:00:00Z" % d
    docs = [
        (f, n + 1, bytearray(json.dumps({"version": "https://jsonfeed.org/version/1.1", "items": [{"id": str(k), "date_published": iso(a), "date_modified": iso(b)} for k, (a, b) in enumerate(page)]}).encode()), SRC)
        for f, feed in enumerate(feeds_)
        for n, page in enumerate(feed)
    ]
    df = spark.createDataFrame(docs, "feed_idx int, page int, body binary, source_url string")
    return feeds.parse(df if crawl is None else df.selectExpr("*", f"{crawl} as crawl"))


NEW, OLD = (4, 1), (2, 1)
ONLY = lambda *days: [(d, None) for d in days]


@pytest.mark.parametrize(
    "feed, stop",
    [
        ([ONLY(NEW, NEW), ONLY((2, 9), (2, 8), (2, 7)), ONLY((2, 1))], 2),
        ([ONLY(NEW, NEW), ONLY((2, 9), (2, 8)), ONLY((2, 1))], 3),  # five samples only on the third page
        ([ONLY(NEW, NEW), ONLY((2, 7), (2, 8), (2, 9)), ONLY((2, 1))], None),  # a later date follows
        ([ONLY((2, 9), (2, 8), (2, 7)), ONLY((2, 8), (2, 7), (2, 6))], None),  # it falls within both pages, and rises between them
        ([ONLY(NEW, None), ONLY((2, 9), None, (2, 8), (2, 7), (2, 6))], 2),
        ([ONLY(*[NEW] * 5)], None),
        ([ONLY(*[(3, 1)] * 5)], None),  # equal to the bound isn't before it
        ([[], ONLY(*[OLD] * 5), []], 2),
    ],
)
def test_order_stop(spark, feed, stop):
    got = feeds.order_stop(pages(spark, feed), dt.datetime(2024, 3, 1)).collect()
    assert (got[0].stop_page if got else None) == stop


def test_crawls_stop_apart(spark):
    """Interleaved readings of one feed: each has an order of its own."""
    a, b = [ONLY(*[OLD] * 5), ONLY(OLD)], [ONLY((2, 1), (2, 2)), ONLY(OLD)]
    both = pages(spark, a, b).selectExpr("0 as feed_idx", "feed_idx as crawl", "page", "source_url", "parsed")
    assert [tuple(r) for r in feeds.order_stop(both, dt.datetime(2024, 3, 1)).collect()] == [(0, 0, 1)]
    rows = feeds.items(both)
    assert feeds.cut_after(rows, feeds.order_stop(both, dt.datetime(2024, 3, 1))).count() == 5 + 3
    assert {(r.crawl, r.id) for r in feeds.keep_first(rows).collect()} == {(0, str(k)) for k in range(5)} | {(1, "0"), (1, "1")}


def test_a_page_that_came_more_than_once(spark):
    """However often it came, it counts once."""
    p = pages(spark, [ONLY(OLD, OLD), ONLY(OLD)])
    many = p.unionByName(p).unionByName(p)
    assert feeds.order_stop(p, dt.datetime(2024, 3, 1)).collect() == feeds.order_stop(many, dt.datetime(2024, 3, 1)).collect() == []
    assert feeds.order_stop(p.limit(0), dt.datetime(2024, 3, 1)).collect() == []


def test_stretches_join_in_any_grouping():
    from functools import reduce
    from operator import add
    from random import Random

    from feedloom.operators import descent

    rng = Random(4)
    for _ in range(200):
        parts = [descent.of_items([{"date_published": rng.choice([None, f"2024-01-{rng.randrange(1, 29):02d}T00:00:00.{rng.randrange(999999999):09d}Z"]), "date_modified": rng.choice([None, "2024-01-15T00:00:00+02:00"])} for _ in range(rng.randrange(4))]) for _ in range(6)]
        k = rng.randrange(7)
        assert reduce(add, parts[:k], descent.Stretch()) + reduce(add, parts[k:], descent.Stretch()) == reduce(add, parts, descent.Stretch())
        assert descent.from_record(descent.to_record(parts[0])) == parts[0]


def test_a_job_parses_once_and_moves_only_summaries(spark):
    from feedloom.plans.reader import FeedJob

    docs = spark.createDataFrame([(0, 1, bytearray(js(id="1").encode()), SRC, "")], "feed_idx int, page int, body binary, source_url string, content_type string")
    plan = FeedJob().from_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow ") == 1 and plan.count("Exchange hashpartitioning") == 1
    plan = FeedJob(since="2024-01-01").from_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Window" not in plan  # the parsed pages were written; their summaries alone are grouped


def test_order_stop_by_modified(spark):
    since = dt.datetime(2024, 3, 1)
    fine = [[((1, 1 + k), (2, 9 - k)) for k in range(5)]]  # published rises, modified falls, published before modified
    late = [[((2, 10 + k), (2, 9 - k)) for k in range(5)]]  # published after modified
    stops = lambda updated: {r.feed_idx: r.stop_page for r in feeds.order_stop(pages(spark, fine, late), since, updated).collect()}
    assert stops(False) == {0: 1} and stops(True) == {0: 1, 1: 1}


def test_period(spark):
    rows = items(spark, [(1, 0, (3, 1), None), (1, 1, (4, 1), None), (1, 2, None, None), (1, 3, (2, 1), (3, 15))])
    a, b = dt.datetime(2024, 3, 1), dt.datetime(2024, 4, 1)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(feeds.in_period(rows)) == ["i0", "i1", "i2", "i3"]
    assert ids(feeds.in_period(rows, a, b)) == ["i0"] and ids(feeds.in_period(rows, a, b, True)) == ["i0", "i3"] and ids(feeds.in_period(rows, a, a)) == []
    with pytest.raises(ValueError):
        feeds.in_period(rows, b, a)


def test_first_occurrences_combine_before_the_shuffle(spark):
    rows = items(spark, [(2, 0, NEW, None), (1, 5, NEW, None), (1, 2, OLD, None)]).selectExpr("feed_idx", "page", "pos", "'same' as id", "ts_published", "ts_modified")
    got = feeds.keep_first(rows)
    assert [(r.page, r.pos) for r in got.collect()] == [(1, 2)] and got.columns == rows.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
    assert {(r.page, r.new_items) for r in feeds.new_per_page(rows).collect()} == {(1, 1), (2, 0)}
    assert feeds.before_first_error(rows, rows.limit(0)).count() == 3 and feeds.before_first_error(rows, rows).count() == 0


def test_numbers_in_the_output(spark):
    docs = spark.createDataFrame([(0, 1, bytearray(js(id="1", title='"duration_in_seconds":"9"', attachments=[{"url": "u", "mime_type": "m", "duration_in_seconds": x} for x in (3600, 1.5, 12345678, 0.1, 12345678.5, 1e-7, 1e21)]).encode()), SRC)], "feed_idx int, page int, body binary, source_url string")
    rows = feeds.items(feeds.parse(docs))
    value = feeds.as_output(rows).first().value
    assert [x.split(",")[0] for x in value.split('"duration_in_seconds":')[1:]] == ["3600", "1.5", "12345678", "0.1", "12345678.5", "1e-7", "1e+21"]
    from feedloom.plans import jq

    for columns in (True, False):
        assert jq.apply(rows, ".", with_feed=False, columns=columns).first().value == value


def test_operator_on_odd_rows(spark):
    docs = spark.createDataFrame([(0, 1, None, None, None, None), (1, 1, bytearray(js(id="1", title="t" * 100_000).encode()), SRC, None, None), (None, None, bytearray(b""), SRC, "text/html", 200)], "feed_idx int, page int, body binary, source_url string, content_type string, status int").selectExpr("*", "'x' as error")
    p = feeds.parse(docs)
    assert feeds.items(p).count() == 1 and {r.error for r in feeds.errors(p.drop("error")).collect()} == {"INVALID_URL", "NOT_FEED"}
    assert feeds.items(feeds.parse(docs.limit(0))).count() == 0
