import pytest

from feedloom.functions import urls


@pytest.mark.parametrize(
    "value, want",
    [
        ("https://News.Site.EXAMPLE", "https://news.site.example/"),
        ("HTTPS://news.example:443/a/../B?Q=Z#frag", "https://news.example/a/../B?Q=Z"),
        ("http://news.example:443/", "http://news.example:443/"),
        ("http://news.example:080/x", "http://news.example:080/x"),
        ("https://news.example/%7ejoe/%C3%A9", "https://news.example/%7ejoe/%C3%A9"),
        ("https://[2001:DB8::A]:443", "https://[2001:db8::a]/"),
        ("http://[2001:DB8::A%25Eth1]:8080/", "http://[2001:db8::a%25Eth1]:8080/"),
        ("mailto:Me@Site.example#x", "mailto:Me@Site.example"),
        ("https://x.example/%zz", "https://x.example/%zz"),
    ],
)
def test_canonical(value, want):
    assert urls.canonical(value) == want


@pytest.mark.parametrize(
    "base, ref, want",
    [
        ("https://e.example/a/b?q#f", "", ""),
        ("https://e.example/a/b?q#f", "?x", "https://e.example/a/b?x"),
        ("https://e.example/a/b?q#f", "#x", "https://e.example/a/b?q#x"),
        ("https://e.example/a/b", "../c/./d", "https://e.example/c/d"),
        ("https://e.example/a/b", "//o.example/x", "https://o.example/x"),
        ("https://e.example/a/b", "/café.xml", "https://e.example/caf%C3%A9.xml"),
        ("https://e.example/a/b", "%zz", "%zz"),
        ("https://e.example/a/b", "mailto:x@y", "mailto:x@y"),
        ("https://e.example", "x", "https://e.example/x"),
        (None, "x", "x"),
    ],
)
def test_resolve(base, ref, want):
    assert urls.resolve(base, ref) == want


@pytest.mark.parametrize("value, ok", [("https://e.example", True), ("HTTP://e", True), ("https://:443/", False), ("ftp://e/", False), ("https://u:p@e/", False), ("/x", False), ("", False), (None, False), ("http://e:x/", False)])
def test_valid(value, ok):
    assert urls.valid_http(value) is ok


@pytest.mark.parametrize(
    "generator, ok",
    [("https://wordpress.org/?v=6.5", True), ("HTTP://WordPress.ORG:80/", True), ("https://wordpress.org.evil/", False), ("https://me@wordpress.org/", False), ("WordPress", False), ("", False), (None, False), (" https://wordpress.org ", True), ("https://www.wordpress.org/", False)],
)
def test_wordpress(generator, ok):
    assert urls.is_wordpress(generator) is ok


def test_wordpress_pages():
    assert urls.next_wordpress("https://e.example/feed?z=1&a=2#f", 1) == "https://e.example/feed?a=2&paged=2&z=1"
    assert urls.wordpress_page("https://e.example/feed?paged=3") == 3
    assert urls.wordpress_page("https://e.example/feed?paged=x") == 1


def test_display_hides_secrets():
    assert "secret" not in urls.display("https://me:secret@e.example/x")
    assert urls.display("https://e.example/%zz") == "(no URL)"


@pytest.mark.parametrize("a, b", [("EXAMPLE.com.", "example.com"), ("[2001:DB8:0:0::1]", "2001:db8::1"), ("bücher.example", "xn--bcher-kva.example"), ("127.0.0.1", "127.0.0.1")])
def test_canonical_host(a, b):
    assert urls.canonical_host(a) == b


def test_columns_over_batches(spark):
    rows = [("HTTPS://A.example:443#x", "b", True), (None, None, False), ("", "", False), ("HTTPS://A.example:443#x", None, True)]
    df = spark.createDataFrame(rows, "u string, r string, ok boolean")
    c = urls.columns()
    got = df.select(c["canonical_url"]("u").alias("c"), c["valid_url"]("u").alias("v"), c["resolve_url"]("u", "r").alias("r"), c["page_url"]("u").alias("p"), c["display_url"]("u").alias("d"), "ok").collect()
    assert [r.c for r in got] == ["https://a.example/", None, "", "https://a.example/"] and all(r.v == r.ok for r in got)
    assert [r.r for r in got] == ["https://A.example:443/b", None, "", None] and got[1].p is None
    assert df.limit(0).select(c["canonical_url"]("u")).count() == 0
