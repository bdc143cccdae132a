"""Feed documents written from relational tables, so that every parser can be checked against SQL on the same tables.

A feed is a user of ``events``, newest event first, ten to a page.  Defects are set by the event's number:
no id (7), neither id nor address (77), an id that repeats within the feed (17), a date that is none (13), a modified date
before (19) or after (5) the published one, an attachment without a type (23), of negative size (29) or sound (11).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.session import table

PAGE = 10


def entries(spark: SparkSession, d: str) -> DataFrame:
    """``feed_idx, page, pos`` and the fields of each entry as written."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    n = F.col("event_id")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    ident = F.when(n % 7 == 0, None).when(n % 17 == 0, F.concat(F.lit("dup-"), F.col("user_id"))).otherwise(F.concat(F.lit("evt-"), n))
    return e.withColumn("rn", rn).select(
        F.col("user_id").cast("int").alias("feed_idx"),
        (F.floor((F.col("rn") - 1) / PAGE) + 1).cast("int").alias("page"),
        ((F.col("rn") - 1) % PAGE).cast("int").alias("pos"),
        n,
        ident.alias("id"),
        F.when(n % 77 != 0, F.concat(F.lit("https://u"), "user_id", F.lit(".example/e/"), n)).alias("url"),
        F.col("event_type").alias("title"),
        F.when(n % 13 == 0, F.lit("yesterday")).otherwise(iso(F.col("ts"))).alias("date_published"),
        F.when(n % 19 == 0, iso(F.expr("ts - interval 1 hour"))).when(n % 5 == 0, iso(F.expr("ts + interval 1 hour"))).alias("date_modified"),
        F.array("event_type").alias("tags"),
        _attachments(n),
    )


def _attachments(n: Column) -> Column:
    def one(mime: str, size: Column, seconds: Column) -> Column:
        return F.array(F.struct(F.concat(F.lit("https://m.example/"), n).alias("url"), F.lit(mime).alias("mime_type"), size.cast("bigint").alias("size_in_bytes"), seconds.cast("double").alias("duration_in_seconds")))

    return F.when(n % 77 == 0, None).when(n % 23 == 0, one("", n, F.lit(1.5))).when(n % 29 == 0, one("audio/mpeg", -n, F.lit(-0.5))).when(n % 11 == 0, one("audio/mpeg", n * 10, F.lit(1.5))).alias("attachments")


def _pages(rows: DataFrame, one: Column) -> DataFrame:
    """Pages with their entries in order.  A page has ten; nothing larger gathers."""
    return rows.groupBy("feed_idx", "page").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("entry")))).alias("list")).withColumn("list", F.transform("list", lambda x: x["entry"]))


def _address() -> Column:
    return F.concat(F.lit("https://u"), "feed_idx", F.lit(".example/feed?page="), "page")


def json_pages(rows: DataFrame, with_author: bool = True) -> DataFrame:
    fields = ["id", "url", "title", "date_published", "date_modified", "tags", "attachments"]
    p = _pages(rows, F.struct(*fields))
    last = F.max("page").over(Window.partitionBy("feed_idx"))
    nxt = F.when(F.col("page") < last, F.concat(F.lit("?page="), F.col("page") + 1))
    author = [F.struct(F.concat(F.lit("user "), "feed_idx").alias("name")).alias("author")] if with_author else []
    feed = F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.concat(F.lit("Feed "), "feed_idx").alias("title"), F.concat(F.lit("https://u"), "feed_idx", F.lit(".example/")).alias("home_page_url"), nxt.alias("next_url"), *author, F.col("list").alias("items"))
    return p.select("feed_idx", "page", F.to_json(feed).cast("binary").alias("body"), _address().alias("source_url"), F.lit("application/feed+json").alias("content_type"))


def esc(c: Column | str) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _tag(name: str, c: Column | str) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit(f"<{name}>"), esc(v), F.lit(f"</{name.split()[0]}>")), F.lit(""))


def _enclosure() -> Column:
    a = F.col("attachments")[0]
    return F.when(F.col("attachments").isNotNull(), F.concat(F.lit('<enclosure url="'), a["url"], F.lit('" type="'), a["mime_type"], F.lit('" length="'), a["size_in_bytes"], F.lit('"/>'))).otherwise("")


def rss_pages(rows: DataFrame, linked: bool = False) -> DataFrame:
    """``linked``: with a generator, and Atom links to the next page."""
    item = F.concat(F.lit("<item>"), _tag("guid", "id"), _tag("link", "url"), _tag("title", "title"), _tag("pubDate", _rfc1123("date_published")), _tag("category", "title"), _enclosure(), F.lit("</item>"))
    p = _pages(rows, item)
    head = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>Feed '), "feed_idx", F.lit("</title><link>/</link><managingEditor>user "), "feed_idx", F.lit("</managingEditor>"))
    more = F.lit("")
    if linked:
        last = F.max("page").over(Window.partitionBy("feed_idx"))
        link = F.when(F.col("page") < last, F.concat(F.lit('<l:link xmlns:l="http://www.w3.org/2005/Atom" rel="self NEXT" href="?page='), F.col("page") + 1, F.lit('#top"/>'))).otherwise("")
        p = p.withColumn("more", F.concat(F.lit("<generator>https://wordpress.org/?v=6</generator>"), link))
        more = F.col("more")
    return p.select("feed_idx", "page", F.concat(head, more, F.array_join("list", ""), F.lit("</channel></rss>")).cast("binary").alias("body"), _address().alias("source_url"), F.lit("application/rss+xml").alias("content_type"))


def _rfc1123(c: str) -> Column:
    t = F.try_to_timestamp(F.when(F.col(c) != "yesterday", F.col(c)))
    return F.coalesce(F.date_format(t, "dd MMM yyyy HH:mm:ss 'GMT'"), F.col(c))


def rdf_pages(rows: DataFrame) -> DataFrame:
    item = F.concat(F.lit("<item>"), _tag("title", "title"), _tag("link", "url"), _tag("dc:date", "date_published"), F.lit("</item>"))
    p = _pages(rows, item)
    head = F.concat(F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Feed '), "feed_idx", F.lit("</title></channel>"))
    return p.select("feed_idx", "page", F.concat(head, F.array_join("list", ""), F.lit("</rdf:RDF>")).cast("binary").alias("body"), _address().alias("source_url"), F.lit("application/rdf+xml").alias("content_type"))


def atom_pages(rows: DataFrame) -> DataFrame:
    """Addresses are written relative to bases: the feed's, and for even events the entry's own."""
    own = F.col("event_id") % 2 == 0
    link = F.when(F.col("url").isNull(), "").when(own, F.concat(F.lit('<a:link href="'), "event_id", F.lit('"/>'))).otherwise(F.concat(F.lit('<a:link href="e/'), "event_id", F.lit('"/>')))
    content = F.concat(F.lit('<a:content type="html">&lt;a href="x?a=1&amp;amp;b='), "event_id", F.lit('"&gt;t&lt;/a&gt;</a:content>'))
    item = F.concat(F.when(own, '<a:entry xml:base="e/">').otherwise("<a:entry>"), _tag("a:id", "id"), _tag("a:title", "title"), link, _tag("a:published", "date_published"), _tag("a:updated", "date_modified"), F.concat(F.lit('<a:category term="'), "title", F.lit('"/>')), content, F.lit("</a:entry>"))
    p = _pages(rows, item)
    head = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><a:feed xmlns:a="http://www.w3.org/2005/Atom" xml:base="/"><a:title>Feed '), "feed_idx", F.lit('</a:title><a:author><a:name>user '), "feed_idx", F.lit("</a:name><a:uri>me</a:uri></a:author>"))
    return p.select("feed_idx", "page", F.concat(head, F.array_join("list", ""), F.lit("</a:feed>")).cast("binary").alias("body"), _address().alias("source_url"), F.lit("application/atom+xml").alias("content_type"))


def html_pages(links: DataFrame, before: Column | None = None, wrap: tuple[str, str] = ("", "")) -> DataFrame:
    """Pages that advertise the rows of the links table, in their order."""
    one = F.concat(F.lit('<link rel="alternate" href="'), esc("url"), F.lit('"'), F.coalesce(F.concat(F.lit(' title="'), esc("title"), F.lit('"')), F.lit("")), F.coalesce(F.concat(F.lit(' type="'), esc("link_type"), F.lit('"')), F.lit("")), F.lit(">"))
    p = links.groupBy("page_url").agg(F.array_sort(F.collect_list(F.struct("pos", "link_row", one.alias("entry")))).alias("list"))
    head = F.coalesce(before, F.lit("")) if before is not None else F.lit("")
    body = F.concat(F.lit("<!DOCTYPE html><html><head>"), head, F.lit(wrap[0]), F.array_join(F.transform("list", lambda x: x["entry"]), ""), F.lit(wrap[1]), F.lit("</head><body></body></html>"))
    return p.select(body.cast("binary").alias("body"), F.col("page_url").alias("source_url"), F.lit("text/html").alias("content_type"))


def xhtml_pages(links: DataFrame) -> DataFrame:
    """The same as XHTML; what only looks like a link stands in another namespace."""
    one = F.concat(F.lit('<h:link rel="alternate" href="'), esc("url"), F.lit('"'), F.coalesce(F.concat(F.lit(' title="'), esc("title"), F.lit('"')), F.lit("")), F.coalesce(F.concat(F.lit(' type="'), esc("link_type"), F.lit('"')), F.lit("")), F.lit("/>"))
    p = links.groupBy("page_url").agg(F.array_sort(F.collect_list(F.struct("pos", "link_row", one.alias("entry")))).alias("list"))
    body = F.concat(F.lit('<?xml version="1.0"?><h:html xmlns:h="http://www.w3.org/1999/xhtml"><h:head><link rel="feed" href="/no"/>'), F.array_join(F.transform("list", lambda x: x["entry"]), ""), F.lit("</h:head></h:html>"))
    return p.select(body.cast("binary").alias("body"), F.col("page_url").alias("source_url"), F.lit("application/xhtml+xml").alias("content_type"))
