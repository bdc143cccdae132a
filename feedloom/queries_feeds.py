"""Queries of the feed operators: documents written from the driver's tables, read back, and compared with SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import dates, urls
from feedloom.operators import feeds, redelivery
from feedloom.plans import jq
from feedloom.sources import corpus
from feedloom.session import materialize, scratch_path, table
from feedloom.streaming import feeds as streams

UTC = dt.timezone.utc
SINCE, UNTIL = dt.datetime(2024, 1, 10, tzinfo=UTC), dt.datetime(2024, 1, 20, tzinfo=UTC)



def _list_sql(texts) -> str:
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _parsed(spark, d) -> DataFrame:
    return feeds.parse(corpus.json_pages(corpus.entries(spark, d)))


def _json(spark, d) -> DataFrame:
    return feeds.items(_parsed(spark, d))


# The same entries in SQL.
_TRIM = "regexp_replace(regexp_replace({0}, '0+Z$', 'Z'), '\\.Z$', 'Z')"
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ')"
_EV = f"""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events),
w as (select cast(user_id as integer) as feed_idx, cast((rn - 1) // 10 + 1 as integer) as page, cast((rn - 1) % 10 as integer) as pos, event_id, ts, event_type as title,
  case when event_id % 7 = 0 then null when event_id % 17 = 0 then 'dup-' || user_id else 'evt-' || event_id end as raw_id,
  case when event_id % 77 <> 0 then 'https://u' || user_id || '.example/e/' || event_id end as url,
  case when event_id % 13 = 0 then null else ts end as tp,
  case when event_id % 19 = 0 then ts - interval 1 hour when event_id % 5 = 0 then ts + interval 1 hour end as tm,
  case when event_id % 77 = 0 then 0 when event_id % 23 = 0 then 0 when event_id % 29 = 0 then 2 when event_id % 11 = 0 then 1 else 0 end as att
  from r),
j as (select *, {_TRIM.format(_ISO.format("tp"))} as date_published, {_TRIM.format(_ISO.format("tm"))} as date_modified,
  coalesce(raw_id, url, 'urn:sha256:' || sha256('{{"id":"","url":"","external_url":"","title":"' || title || '","content_html":"","content_text":"","summary":"","image":"","banner_image":"","date_published":"' ||
    case when tp is null then 'yesterday' else {_ISO.format("tp")} end || '","date_modified":"' || coalesce({_ISO.format("tm")}, '') || '","authors":null,"author":null,"tags":["' || title || '"],"attachments":null}}')) as id from w)
"""
_BASE = "feed_idx, page, pos, id, url, title, date_published, date_modified"


@query("parse_jsonfeed", f"{_EV} select {_BASE}, title as tag, 'https://u' || feed_idx || '.example/feed?page=' || page as feed_url from j")
def parse_jsonfeed(spark: SparkSession, d: str) -> DataFrame:
    return _json(spark, d).select(*_BASE.split(", "), F.col("tags")[0].alias("tag"), F.col("_feed.feed_url").alias("feed_url"))


@query("generated_id", f"{_EV} select feed_idx, page, pos, id from j where raw_id is null and url is null")
def generated_id(spark, d):
    return _json(spark, d).where("id like 'urn:sha256:%'").select("feed_idx", "page", "pos", "id")


@query("identity_fallback", f"{_EV} select feed_idx, page, pos, id from j where raw_id is null and url is not null")
def identity_fallback(spark, d):
    return _json(spark, d).where("id = url").select("feed_idx", "page", "pos", "id")


@query("authors_inherit", f"{_EV} select feed_idx, page, pos, cast(1 as bigint) as authors, 'user ' || feed_idx as author from j")
def authors_inherit(spark, d):
    return _json(spark, d).select("feed_idx", "page", "pos", F.size("authors").cast("bigint").alias("authors"), F.col("authors")[0]["name"].alias("author"))


@query("attachments_clamp", f"{_EV} select feed_idx, page, pos, case when att = 1 then event_id * 10 end as bytes, case when att = 1 then 1.5 end as seconds from j where att > 0")
def attachments_clamp(spark, d):
    return _json(spark, d).where("attachments is not null").select("feed_idx", "page", "pos", F.col("attachments")[0]["size_in_bytes"].alias("bytes"), F.col("attachments")[0]["duration_in_seconds"].alias("seconds"))


# XML keeps entries that have an id or an address.
_XID = "coalesce(raw_id, url) as id"
_SEC = "strftime(date_trunc('second', {0}), '%Y-%m-%dT%H:%M:%SZ')"


@query("parse_rss", f"{_EV} select feed_idx, page, cast(row_number() over (partition by feed_idx, page order by pos) - 1 as integer) as pos, {_XID}, url, title, {_SEC.format('tp')} as date_published, title as tag, 'user ' || feed_idx as author from j where coalesce(raw_id, url) is not null")
def parse_rss(spark, d):
    rows = feeds.items(feeds.parse(corpus.rss_pages(corpus.entries(spark, d))))
    return rows.select("feed_idx", "page", "pos", "id", "url", "title", "date_published", F.col("tags")[0].alias("tag"), F.col("authors")[0]["name"].alias("author"))


@query("enclosure_size", f"{_EV} select feed_idx, page, url, case when att = 1 then event_id * 10 end as bytes from j where att > 0 and coalesce(raw_id, url) is not null")
def enclosure_size(spark, d):
    rows = feeds.items(feeds.parse(corpus.rss_pages(corpus.entries(spark, d))))
    return rows.where("attachments is not null").select("feed_idx", "page", "url", F.col("attachments")[0]["size_in_bytes"].alias("bytes"))


@query("parse_rdf", f"{_EV} select feed_idx, page, url as id, url, title, date_published, date_published as date_modified from j where url is not null")
def parse_rdf(spark, d):
    rows = feeds.items(feeds.parse(corpus.rdf_pages(corpus.entries(spark, d))))
    return rows.select("feed_idx", "page", "id", "url", "title", "date_published", "date_modified")


_CONTENT = "'<a href=\"https://u' || feed_idx || '.example/' || case when event_id % 2 = 0 then 'e/' else '' end || 'x?a=1&amp;b=' || event_id || '\">t</a>'"


@query("parse_atom", f"{_EV} select feed_idx, page, {_XID}, url, title, date_published, date_modified, {_CONTENT} as content_html, 'https://u' || feed_idx || '.example/me' as author_url from j where coalesce(raw_id, url) is not null")
def parse_atom(spark, d):
    rows = feeds.items(feeds.parse(corpus.atom_pages(corpus.entries(spark, d))))
    return rows.select("feed_idx", "page", "id", "url", "title", "date_published", "date_modified", "content_html", F.col("authors")[0]["url"].alias("author_url"))


@query("dates_normalize", f"{_EV} select feed_idx, page, pos, date_published, epoch_us(tp) as published_us, epoch_us(tm) as modified_us from j")
def dates_normalize(spark, d):
    e = corpus.entries(spark, d)
    return e.select("feed_idx", "page", "pos", dates.normalized(F.col("date_published")).alias("date_published"), F.unix_micros(dates.instant(F.col("date_published"))).alias("published_us"), F.unix_micros(dates.instant(F.col("date_modified"))).alias("modified_us"))


# Period -----------------------------------------------------------------------------------------------------------
_P, _M = "coalesce(tp, tm)", "coalesce(tm, tp)"
_IN = "{0} >= timestamp '2024-01-10' and {0} < timestamp '2024-01-20'"


@query("period_published", f"{_EV} select feed_idx, page, pos, id from j where {_IN.format(_P)}")
def period_published(spark, d):
    return feeds.in_period(_json(spark, d), SINCE, UNTIL).select("feed_idx", "page", "pos", "id")


@query("period_updated", f"{_EV} select feed_idx, page, pos, id from j where {_IN.format(_M)}")
def period_updated(spark, d):
    return feeds.in_period(_json(spark, d), SINCE, UNTIL, prefer_updated=True).select("feed_idx", "page", "pos", "id")


@query("period_empty", f"{_EV} select feed_idx, page, pos, id from j where false")
def period_empty(spark, d):
    return feeds.in_period(_json(spark, d), SINCE, SINCE).select("feed_idx", "page", "pos", "id")


@query("period_undated", f"{_EV} select feed_idx, page, pos, id from j where tp is null and tm is null")
def period_undated(spark, d):
    rows = feeds.in_period(_json(spark, d))  # without bounds undated items stay
    return rows.where("ts_published is null and ts_modified is null").select("feed_idx", "page", "pos", "id")


# Identity -----------------------------------------------------------------------------------------------------------
_FIRST = "row_number() over (partition by feed_idx, id order by page, pos) = 1"


@query("dedup_first", f"{_EV} select feed_idx, page, pos, id from j qualify {_FIRST}")
def dedup_first(spark, d):
    return feeds.keep_first(_json(spark, d)).select("feed_idx", "page", "pos", "id")


@query("dedup_none_in_parse", f"{_EV} select feed_idx, count(*) as items from j group by feed_idx")
def dedup_none_in_parse(spark, d):
    return _json(spark, d).groupBy("feed_idx").agg(F.count("*").alias("items"))


@query("new_per_page", f"{_EV} select feed_idx, page, count(*) filter (where f) as new_items from (select *, {_FIRST} as f from j) group by feed_idx, page")
def new_per_page(spark, d):
    return feeds.new_per_page(_json(spark, d))


# Pages --------------------------------------------------------------------------------------------------------------
def _edges(spark, d, cycle: bool = False) -> tuple[DataFrame, DataFrame]:
    parsed = feeds.parse(corpus.json_pages(corpus.entries(spark, d).select("feed_idx", "page", "pos", "id", "url", "title", "date_published", "date_modified", "tags", "attachments")))
    nxt = F.col("parsed.next_url")
    if cycle:
        nxt = F.coalesce(nxt, F.concat(F.lit("https://u"), "feed_idx", F.lit(".example/feed?page=1")))
    slim = materialize(parsed.select("feed_idx", "page", F.col("source_url").alias("url"), nxt.alias("next_url")), "edges")
    return slim.select("url", "next_url"), slim.where("page = 1").select("feed_idx", "url")


_URL = "'https://u' || feed_idx || '.example/feed?page=' || page as url"
_PAGES = f"{_EV}, g as (select distinct feed_idx, page from j)"


@query("paginate_explicit", f"{_PAGES} select feed_idx, page, {_URL} from g where page <= 10")
def paginate_explicit(spark, d):
    return feeds.follow(*_edges(spark, d))


@query("paginate_cycle", f"{_PAGES} select feed_idx, page, {_URL} from g where page <= 10")
def paginate_cycle(spark, d):
    return feeds.follow(*_edges(spark, d, cycle=True))


@query("paginate_max_pages", f"{_PAGES} select feed_idx, page, {_URL} from g where page <= 3")
def paginate_max_pages(spark, d):
    return feeds.follow(*_edges(spark, d), max_pages=3)


_GUESS = """select feed_idx, min(page) as stop_page from (select feed_idx, page, count(*) filter (where f) as n from (
select *, row_number() over (partition by feed_idx, title order by page, pos) = 1 as f from j) group by feed_idx, page) where n = 0 group by feed_idx"""


@query("paginate_guess", f"{_EV}, s as ({_GUESS}) select j.feed_idx, page, pos from j left join s using (feed_idx) where page <= coalesce(stop_page, 10) and page <= 10")
def paginate_guess(spark, d):
    """Identity by title here, so pages that add nothing do occur."""
    rows = materialize(_json(spark, d).select("feed_idx", "page", "pos", F.col("title").alias("id")), "guess")
    return feeds.cut_after(rows, feeds.guessed_pages(rows)).select("feed_idx", "page", "pos")


def _stop_sql(updated: bool) -> str:
    def fold(c: str) -> str:
        return f"""bool_and({c} is null or p{c} is null or {c} <= p{c}) over w and count({c}) over w >= 5 and coalesce(last_value({c} ignore nulls) over w < timestamp '2024-01-25', false)"""

    stop = "db" if updated else "da or (bound and db)"
    return f"""{_EV}, x as (select *, {_P} as a, {_M} as b from j where page <= 10),
y as (select *, lag(a ignore nulls) over o as pa, lag(b ignore nulls) over o as pb from x window o as (partition by feed_idx order by page, pos)),
z as (select *, {fold("a")} as da, {fold("b")} as db, bool_and(not coalesce(tp > tm, false)) over w as bound, row_number() over (partition by feed_idx, page order by pos desc) = 1 as fin
  from y window w as (partition by feed_idx order by page, pos rows unbounded preceding))
select feed_idx, min(page) as stop_page from z where fin and ({stop}) group by feed_idx"""


EARLY = dt.datetime(2024, 1, 25, tzinfo=UTC)


@query("early_stop_published", _stop_sql(False))
def early_stop_published(spark, d):
    return feeds.order_stop(_parsed(spark, d), EARLY)


@query("early_stop_modified", _stop_sql(True))
def early_stop_modified(spark, d):
    return feeds.order_stop(_parsed(spark, d), EARLY, prefer_updated=True)


@query("early_stop_cut", f"select j.feed_idx, page, pos from ({_EV} select * from j) j left join ({_stop_sql(False)}) s using (feed_idx) where page <= least(coalesce(stop_page, 10), 10)")
def early_stop_cut(spark, d):
    parsed = materialize(_parsed(spark, d), "parsed")
    return feeds.cut_after(feeds.items(parsed), feeds.order_stop(parsed, EARLY)).select("feed_idx", "page", "pos")


@query("wordpress_detect", "select feed_idx, regexp_matches(trim(generator), '^[hH][tT][tT][pP][sS]?://[wW][oO][rR][dD][pP][rR][eE][sS][sS]\\.[oO][rR][gG](:[0-9]*)?([/?#].*)?$') as wordpress from feeds where generator is not null")
def wordpress_detect(spark, d):
    host = F.lower(F.try_parse_url(F.trim("generator"), F.lit("HOST")))
    ok = (host == "wordpress.org") & F.try_parse_url(F.trim("generator"), F.lit("USERINFO")).isNull() & F.lower(F.try_parse_url(F.trim("generator"), F.lit("PROTOCOL"))).isin("http", "https")
    return table(spark, d, "feeds").where("generator is not null").select("feed_idx", F.coalesce(ok, F.lit(False)).alias("wordpress"))


# Addresses --------------------------------------------------------------------------------------------------------------
_ORIGIN = "regexp_extract(page_url, '^(https?://[^/?#]+)', 1)"
_RESOLVED = f"case when url like 'http%' then url when url like '/%' then {_ORIGIN} || url else regexp_replace(page_url, '[^/]*$', '') || url end"


@query("resolve_urls", f"select link_row, {_RESOLVED} as resolved from links where url is not null")
def resolve_urls(spark, d):
    u = urls.columns()
    return table(spark, d, "links").where("url is not null").select("link_row", u["resolve_url"]("page_url", "url").alias("resolved"))


@query("canonical_url", "select link_row, page_url as canonical from links where page_url is not null and page_url like '%://%/%'")
def canonical_url(spark, d):
    """Addresses are first made untidy: upper-case host, default port, a fragment."""
    u = urls.columns()
    l = table(spark, d, "links").where("page_url like '%://%/%'")
    host = F.regexp_extract("page_url", "^https?://([^/]+)", 1)
    untidy = F.concat(F.lit("HTTPS://"), F.upper(host), F.lit(":443"), F.regexp_replace("page_url", "^https?://[^/]+", ""), F.lit("#top"))
    return l.select("link_row", u["canonical_url"](untidy).alias("canonical"))


@query("validate_url", "select link_row, link_row % 4 in (0, 3) as valid from links")
def validate_url(spark, d):
    u = urls.columns()
    k = F.col("link_row") % 4
    made = F.when(k == 0, F.col("page_url")).when(k == 1, F.lit("https://:443/")).when(k == 2, F.lit("https://me@e.example/")).otherwise(F.lit("HTTP://E.example"))
    return table(spark, d, "links").select("link_row", u["valid_url"](made).alias("valid"))


@query("page_url", "select page_row, source_url as url from feed_pages where source_url is not null")
def page_url(spark, d):
    u = urls.columns()
    return table(spark, d, "feed_pages").where("source_url is not null").select("page_row", u["page_url"](F.concat("source_url", F.lit("#part"))).alias("url"))


# Discovery --------------------------------------------------------------------------------------------------------------
_FOUND = f"select page_url, url, title, type from (select page_url, pos, link_row, {_RESOLVED} as url, coalesce(title, '') as title, coalesce(link_type, '') as type from links where url is not null) where url <> page_url"


@query("discover_links", _FOUND)
def discover_links(spark, d):
    found = feeds.discover(corpus.html_pages(table(spark, d, "links")))
    return feeds.links(found, "source_url").select(F.col("source_url").alias("page_url"), "url", "title", "type")


@query("discover_first", f"select page_url, arg_min(url, (pos, link_row)) as url from (select page_url, pos, link_row, {_RESOLVED} as url from links) where url <> page_url group by page_url")
def discover_first(spark, d):
    found = feeds.discover(corpus.html_pages(table(spark, d, "links")))
    return feeds.first_link(found, "source_url").select(F.col("source_url").alias("page_url"), "url")


@query("discover_foreign", "select distinct page_url, cast(0 as bigint) as links from links")
def discover_foreign(spark, d):
    """Links inside an SVG drawing advertise nothing."""
    found = feeds.discover(corpus.html_pages(table(spark, d, "links"), wrap=("<svg>", "</svg>")))
    return found.select(F.col("source_url").alias("page_url"), F.size("links").cast("bigint").alias("links"))


@query("discover_template", "select distinct page_url, cast(0 as bigint) as links from links")
def discover_template(spark, d):
    found = feeds.discover(corpus.html_pages(table(spark, d, "links"), wrap=("<template><div>", "</div></template>")))
    return found.select(F.col("source_url").alias("page_url"), F.size("links").cast("bigint").alias("links"))


@query("discover_base", "select page_url, case when url like 'http%' then url else 'https://base.example' || case when url like '/%' then '' else '/a/' end || url end as url from links where case when url like 'http%' then url else '' end <> page_url")
def discover_base(spark, d):
    found = feeds.discover(corpus.html_pages(table(spark, d, "links"), before=F.lit('<base href="https://base.example/a/b">')))
    return feeds.links(found, "source_url").select(F.col("source_url").alias("page_url"), "url")


@query("display_url", "select link_row, page_url as shown from links where page_url is not null")
def display_url(spark, d):
    """User information is never shown."""
    u = urls.columns()
    return table(spark, d, "links").where("page_url is not null").select("link_row", u["display_url"](F.regexp_replace("page_url", "://", "://me:secret@")).alias("shown"))


@query("discover_breakout", _FOUND)
def discover_breakout(spark, d):
    """A paragraph leaves the drawing, so the links behind it count."""
    found = feeds.discover(corpus.html_pages(table(spark, d, "links"), wrap=("<svg><g><p>", "")))
    return feeds.links(found, "source_url").select(F.col("source_url").alias("page_url"), "url", "title", "type")


@query("discover_integration", _FOUND)
def discover_integration(spark, d):
    """HTML inside MathML inside SVG; void elements and end tags without their element change nothing."""
    found = feeds.discover(corpus.html_pages(table(spark, d, "links"), wrap=("<svg><foreignObject><br></x><math><mtext>", "</mtext></math></foreignObject></svg>")))
    return feeds.links(found, "source_url").select(F.col("source_url").alias("page_url"), "url", "title", "type")


@query("discover_xhtml", _FOUND)
def discover_xhtml(spark, d):
    """The same links on strict XHTML pages."""
    found = feeds.discover(corpus.xhtml_pages(table(spark, d, "links")))
    return feeds.links(found, "source_url").select(F.col("source_url").alias("page_url"), "url", "title", "type")


@query("discover_rel_type", "select link_row, link_row % 6 in (0, 2, 3) as found from links")
def discover_rel_type(spark, d):
    """Relations and media types, one page for each row."""
    tags = ['rel="me FEED"', 'rel="stylesheet"', 'rel="alternate" type="Application/RSS+xml; charset=x"', 'rel="alternate" type="text/xml"', 'rel="alternate" type="text/html"', 'rel="alternates"']
    l = table(spark, d, "links").select("link_row")
    tag = F.element_at(F.array(*map(F.lit, tags)), (F.col("link_row") % len(tags) + 1).cast("int"))
    pages = l.select("link_row", F.concat(F.lit("<html><link "), tag, F.lit(' href="/x"></html>')).cast("binary").alias("body"), F.lit("https://harbour.example/log/").alias("source_url"), F.lit("text/html").alias("content_type"))
    return feeds.discover(pages).select("link_row", (F.size("links") > 0).alias("found"))


@query("discover_errors", "select link_row, case link_row % 4 when 0 then 'TOO_DEEP' when 1 then 'DISCOVERY' when 2 then 'INVALID_URL' end as error from links")
def discover_errors(spark, d):
    k = F.col("link_row") % 4
    body = F.when(k == 0, F.repeat(F.lit("<template>"), 513)).when(k == 1, F.lit("<html xmlns='http://www.w3.org/1999/xhtml'>")).otherwise(F.lit("<html>"))
    pages = table(spark, d, "links").select("link_row", body.cast("binary").alias("body"), F.when(k == 2, F.lit("ftp://x.example/")).otherwise(F.lit("https://x.example/")).alias("source_url"), F.when(k == 1, "application/xhtml+xml").otherwise("text/html").alias("content_type"))
    return feeds.discover(pages).select("link_row", "error")


@query("next_atom", f"{_PAGES} select feed_idx, page, case when page < max(page) over (partition by feed_idx) then 'https://u' || feed_idx || '.example/feed?page=' || page + 1 end as next_url from g")
def next_atom(spark, d):
    """The next page as an Atom link in an RSS channel; fragments go."""
    p = corpus.rss_pages(corpus.entries(spark, d), linked=True)
    return feeds.parse(p).select("feed_idx", "page", "parsed.next_url")


@query("wordpress_pages", f"{_EV} select distinct feed_idx, page, 'https://u' || feed_idx || '.example/feed?a=%26&paged=' || page + 1 as next_url, true as counts from j where coalesce(raw_id, url) is not null")
def wordpress_pages(spark, d):
    """Addresses made by counting up, of feeds whose generator says so."""
    import pyarrow as pa

    def following(page: pa.Array, source: pa.Array) -> pa.Array:
        return pa.array([urls.next_wordpress(f"{s.split('?')[0]}?paged={p}&a=%26", p) for p, s in zip(page.to_pylist(), source.to_pylist())], pa.string())

    following.__annotations__ = {"page": pa.Array, "source": pa.Array, "return": pa.Array}

    def counts(generator: pa.Array) -> pa.Array:
        return pa.array(list(map(urls.is_wordpress, generator.to_pylist())), pa.bool_())

    counts.__annotations__ = {"generator": pa.Array, "return": pa.Array}
    parsed = feeds.parse(corpus.rss_pages(corpus.entries(spark, d), linked=True)).where(F.size("parsed.items") > 0)
    return parsed.select("feed_idx", "page", F.arrow_udf(following, "string")("page", "source_url").alias("next_url"), F.arrow_udf(counts, "boolean")("parsed.generator").alias("counts"))


_HINTS = ["/blog/feed/", "/rss", "/blog-rss", "/index.XML", "/feedback", "/newsfeed", "/anatomy", "/RSSReader", "/updates"]


@query("discover_hints", f"select link_row from links where link_row % {len(_HINTS)} < 4")
def discover_hints(spark, d):
    """One page for each row, with an address that hints at a feed or only seems to."""
    l = table(spark, d, "links").select("link_row")
    href = F.element_at(F.array(*map(F.lit, _HINTS)), (F.col("link_row") % len(_HINTS) + 1).cast("int"))
    pages = l.select("link_row", F.concat(F.lit('<html><link rel="alternate" href="'), href, F.lit('"></html>')).cast("binary").alias("body"), F.lit("https://example.com/blog/").alias("source_url"), F.lit("text/html").alias("content_type"))
    return feeds.discover(pages).where(F.size("links") > 0).select("link_row")


_HEX = "regexp_matches(hex(body), '^(EFBBBF)?(20|09|0A|0D)*{0}')"


@query("format_sniff", f"select page_row, {_HEX.format('7B')} as json, {_HEX.format('3C(21)?(64|44|68|48)')} as html from feed_pages where body is not null")
def format_sniff(spark, d):
    from pyspark.sql.functions import pandas_udf

    from feedloom.operators.discovery import looks_like_html

    @pandas_udf("boolean")
    def is_json(b):
        return b.map(lambda x: feeds.looks_like_json(bytes(x).removeprefix(b"\xef\xbb\xbf")))

    @pandas_udf("boolean")
    def is_html(b):
        return b.map(lambda x: looks_like_html(bytes(x)))

    return table(spark, d, "feed_pages").where("body is not null").select("page_row", is_json("body").alias("json"), is_html("body").alias("html"))


@query("sql_functions", f"select page_url, url, upper(title) as title from ({_FOUND})")
def sql_functions(spark, d):
    """Discovery and a program per row, from SQL."""
    from feedloom.plans import sql

    sql.register(spark)
    corpus.html_pages(table(spark, d, "links")).createOrReplaceTempView("feedloom_pages")
    return spark.sql("""
        select p.source_url as page_url, canonical_url(f.url) as url, from_json(concat('[', j.value, ']'), 'array<string>')[0] as title
        from feedloom_pages p, lateral feed_links(p.body, p.source_url, p.content_type) f, lateral jq(to_json(named_struct('t', upper(f.title))), '.t') j
        where looks_like_html(p.body, p.content_type)""")


# Errors -----------------------------------------------------------------------------------------------------------------
def _broken(spark, d) -> DataFrame:
    p = corpus.json_pages(corpus.entries(spark, d))
    k = F.col("feed_idx") % 10
    text = F.col("body").cast("string")
    body = (
        F.when(k == 1, F.lit("<!DOCTYPE html><html><body>no</body></html>"))
        .when(k == 2, F.replace(text, F.lit("version/1.1"), F.lit("version/2")))
        .when(k == 3, F.substring(text, F.lit(1), F.length(text) - 5))
        .when(k == 4, F.concat(F.lit("["), text, F.lit("]")))
        .when(k == 5, F.replace(text, F.lit('"tags":['), F.lit('"tags":[1,')))
        .otherwise(text)
    )
    return p.select("feed_idx", "page", body.cast("binary").alias("body"), F.when(k == 6, F.lit("ftp://u.example/")).otherwise(F.col("source_url")).alias("source_url"), "content_type", F.when(k == 0, 500).otherwise(200).alias("status"))


_KIND = "case feed_idx % 10 when 0 then 'HTTP_STATUS' when 6 then 'INVALID_URL' when 1 then 'NOT_FEED' when 2 then 'NOT_FEED' when 3 then 'NOT_FEED' when 4 then 'NOT_FEED' when 5 then 'NOT_FEED' end"


@query("error_classes", f"{_PAGES} select feed_idx, page, {_KIND} as error from g where {_KIND} is not null")
def error_classes(spark, d):
    return feeds.errors(feeds.parse(_broken(spark, d))).select("feed_idx", "page", "error")


# A body that is a JSON Feed: an object of a known version whose members, where they are given, have the right types.
_GOOD = """with t as (select *, try(decode(case when hex(body) like 'EFBBBF%' then body[4:] else body end)) as s from feed_pages),
j as (select *, cast(case when coalesce(json_valid(s), false) and json_type(s) = 'OBJECT' then s end as json) as j from t),
n as (select page_row, bool_or(coalesce(json_type(it), 'NULL') not in ('OBJECT', 'NULL') {types}) as wrong
  from (select page_row, json_extract(j, '$.items[' || k || ']') as it from (select page_row, j, unnest(range(cast(json_array_length(j, '$.items') as bigint))) as k from j where json_type(j, '$.items') = 'ARRAY')) group by page_row),
g as (select j.*, case when status not between 200 and 299 then 'HTTP_STATUS' when not regexp_matches(coalesce(source_url, ''), '^https?://[^/?#@]+([/?#]|$)') then 'INVALID_URL'
  when coalesce(j ->> '$.version', '') in ('https://jsonfeed.org/version/1', 'https://jsonfeed.org/version/1.1') and coalesce(json_type(j, '$.items'), 'NULL') in ('ARRAY', 'NULL') and not coalesce(wrong, false) then 'OK' else 'NOT_FEED' end as outcome from j left join n using (page_row))
""".format(types="".join(f" or coalesce(json_type(it, '$.{m}'), 'NULL') not in ('VARCHAR', 'NULL')" for m in "id url external_url title content_html content_text summary image banner_image date_published date_modified".split()) + " or coalesce(json_type(it, '$.tags'), 'NULL') not in ('ARRAY', 'NULL') or coalesce(json_type(it, '$.attachments'), 'NULL') not in ('ARRAY', 'NULL') or coalesce(json_type(it, '$.authors'), 'NULL') not in ('ARRAY', 'NULL') or coalesce(json_type(it, '$.author'), 'NULL') not in ('OBJECT', 'NULL')")


@query("page_errors", f"{_GOOD} select page_row, outcome from g where body is not null or status not between 200 and 299")
def page_errors(spark, d):
    """Delivered pages by what reading them gives; failed pages keep their status."""
    docs = table(spark, d, "feed_pages").where("body is not null or status not between 200 and 299").select("feed_idx", "page", "page_row", "body", "source_url", "content_type", "status")
    return feeds.parse(docs).select("page_row", F.coalesce("parsed.error", F.lit("OK")).alias("outcome"))


@query("fail_fast_prefix", f"{_EV}, b as (select min(feed_idx) as bad from j where feed_idx % 10 in (7) and feed_idx >= 5) select feed_idx, page, pos from j, b where bad is null or feed_idx < bad")
def fail_fast_prefix(spark, d):
    rows = _json(spark, d)
    failed = rows.where("feed_idx % 10 = 7 and feed_idx >= 5").select("feed_idx").distinct()
    return feeds.before_first_error(rows, failed).select("feed_idx", "page", "pos")


# Programs and output ------------------------------------------------------------------------------------------------------
def _jq(name: str, program: str, sql: str, raw: bool = False, columns: bool = True):
    def run(spark, d):
        out = jq.apply(_json(spark, d), program, columns=columns)
        return (jq.raw(out) if raw else out).select("feed_idx", "page", "pos", "out_pos", "value")

    query(name, f"{_EV} select feed_idx, page, pos, {sql}")(run)


_Q = "'\"' || {0} || '\"'"
_jq("jq_path", ".title", f"0 as out_pos, {_Q.format('title')} as value from j")
_jq("jq_missing", ".external_url", "0 as out_pos, 'null' as value from j")
_jq("jq_select", 'select(.tags | index("click")) | .id', f"0 as out_pos, {_Q.format('id')} as value from j where title = 'click'")
_jq("jq_multi", "[.id, .title][]", f"k as out_pos, case k when 0 then {_Q.format('id')} else {_Q.format('title')} end as value from j, (values (0), (1)) v(k)")
_jq("jq_if", 'if .title == "click" then "c" elif .url then "u" else empty end', """0 as out_pos, case when title = 'click' then '"c"' else '"u"' end as value from j where title = 'click' or url is not null""")
_jq("jq_object", "{title, url}", """0 as out_pos, '{"title":"' || title || '","url":' || coalesce('"' || url || '"', 'null') || '}' as value from j""")
_jq("jq_tsv", "[.id, .title] | @tsv", "0 as out_pos, id || chr(9) || title as value from j", raw=True)
_jq("jq_raw", ".title", "0 as out_pos, title as value from j", raw=True)
_jq("jq_feed", "._feed.title", "0 as out_pos, '\"Feed ' || feed_idx || '\"' as value from j")
_jq("jq_interpreted", "[.tags[] | ascii_upcase] + [.id] | join(\"-\")", "0 as out_pos, '\"' || upper(title) || '-' || id || '\"' as value from j")
_jq("jq_reduce", "reduce (.attachments // [])[] as $a (0; . + ($a.size_in_bytes // 0))", "0 as out_pos, case when att = 1 then cast(event_id * 10 as varchar) else '0' end as value from j")

_DURATIONS = ("3600", "1.5", "12345678", "0.1", "12345678.25", "1e-7")


def _long(spark, d) -> DataFrame:
    """The entries with durations of several sizes, in the order of the events."""
    k = F.array(*(F.lit(float(x)) for x in _DURATIONS))
    e = corpus.entries(spark, d)
    sized = F.transform("attachments", lambda a: a.withField("duration_in_seconds", F.element_at(k, (F.col("event_id") % len(_DURATIONS) + 1).cast("int"))))
    return feeds.items(feeds.parse(corpus.json_pages(e.withColumn("attachments", sized))))


_IDENTITY = f"""'{{"attachments":[{{"duration_in_seconds":' || {_list_sql(_DURATIONS)}[event_id % {len(_DURATIONS)} + 1] || ',"mime_type":"audio/mpeg",' || case att when 1 then '"size_in_bytes":' || event_id * 10 || ',' else '' end || '"url":"https://m.example/' || event_id || '"}}],'"""
_TAIL = """ || '"authors":[{"name":"user ' || feed_idx || '"}],' || coalesce('"date_modified":"' || date_modified || '",', '') || coalesce('"date_published":"' || date_published || '",', '')
 || '"id":"' || id || '","tags":["' || title || '"],"title":"' || title || '"' || coalesce(',"url":"' || url || '"', '') || '}'"""


@query("jq_identity", f"{_EV} select feed_idx, page, pos, {_IDENTITY}{_TAIL} as value from j where att > 0")
def jq_identity(spark, d):
    """Numbers of all sizes, whole ones without a fraction, through the program ``.``."""
    return jq.apply(_long(spark, d).where("attachments is not null"), ".", with_feed=False).select("feed_idx", "page", "pos", "value")


@query("output_numbers", f"{_EV} select feed_idx, page, pos, {_IDENTITY}{_TAIL} as value from j where att > 0")
def output_numbers(spark, d):
    return feeds.as_output(_long(spark, d).where("attachments is not null"))


@query("jq_has", f"{_EV} select feed_idx, page, pos, case when url is null then 'false' else 'true' end as value from j")
def jq_has(spark, d):
    return jq.apply(_json(spark, d), 'has("url")').select("feed_idx", "page", "pos", "value")


_OUT = """'{' || coalesce('"attachments":[{' || case att when 1 then '"duration_in_seconds":1.5,' else '' end || '"mime_type":"audio/mpeg",' || case att when 1 then '"size_in_bytes":' || event_id * 10 || ',' else '' end || case when att > 0 then '"url":"https://m.example/' || event_id || '"}],' end, '')
 || '"authors":[{"name":"user ' || feed_idx || '"}],' || coalesce('"date_modified":"' || date_modified || '",', '') || coalesce('"date_published":"' || date_published || '",', '')
 || '"id":"' || id || '","tags":["' || title || '"],"title":"' || title || '"' || coalesce(',"url":"' || url || '"', '') || '}'"""


@query("output_jsonl", f"{_EV} select feed_idx, page, pos, {_OUT} as value from j")
def output_jsonl(spark, d):
    return feeds.as_output(_json(spark, d))


_FEEDOUT = """'{"_feed":{"feed_url":"https://u' || feed_idx || '.example/feed?page=' || page || '","home_page_url":"https://u' || feed_idx || '.example/","title":"Feed ' || feed_idx || '"}'"""


@query("with_feed", f"{_EV} select feed_idx, page, pos, {_FEEDOUT} as feed from j")
def with_feed(spark, d):
    out = feeds.as_output(_json(spark, d), with_feed=True)
    return out.select("feed_idx", "page", "pos", F.regexp_extract("value", r"^(\{\"_feed\":\{[^}]*\})", 1).alias("feed"))


@query("feed_order", f"{_EV} select id, row_number() over (order by feed_idx, page, pos) as line from j")
def feed_order(spark, d):
    """Line numbers of the output, as a sink numbers them: by a range sort and offsets of its partitions."""
    rows = _json(spark, d).select("feed_idx", "page", "pos", "id").orderBy("feed_idx", "page", "pos")
    kept = materialize(rows.withColumn("part", F.spark_partition_id()).withColumn("own", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)), "ordered")
    from pyspark.sql import Window

    sizes = kept.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return kept.join(F.broadcast(sizes.select("part", "before")), "part").select("id", (F.col("before") + F.col("own") + 1).alias("line"))


_RFC = "case when regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.,][0-9]+)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})') then epoch_us(try_cast(replace({0}, ',', '.') as timestamptz)) end"
_FLOOR, _CEIL = "epoch_us(timestamp '2023-09-01')", "epoch_us(timestamp '2025-09-01')"


def _fold_sql(c: str) -> str:
    return f"bool_and({c} is null or p{c} is null or {c} <= p{c}) over w and count({c}) over w >= 5 and coalesce(last_value({c} ignore nulls) over w < {_FLOOR}, false)"


@query(
    "read_feeds",
    f"""{_GOOD},
p as (select feed_idx, batch_id as crawl, page, j from g where outcome = 'OK' and body is not null and page <= 10),
i as (select feed_idx, crawl, page, cast(k as integer) as pos, json_extract(j, '$.items[' || k || ']') as it from (select *, unnest(range(cast(json_array_length(j, '$.items') as bigint))) as k from p where json_type(j, '$.items') = 'ARRAY')),
r as (select feed_idx, crawl, page, pos, coalesce(nullif(it ->> '$.id', ''), nullif(it ->> '$.url', '')) as id, nullif(it ->> '$.url', '') as url, nullif(it ->> '$.title', '') as title, {_RFC.format("(it ->> '$.date_published')")} as tp, {_RFC.format("(it ->> '$.date_modified')")} as tm from i),
x as (select *, coalesce(tp, tm) as a, coalesce(tm, tp) as b from r),
y as (select *, lag(a ignore nulls) over o as pa, lag(b ignore nulls) over o as pb from x window o as (partition by feed_idx, crawl order by page, pos)),
z as (select *, {_fold_sql("a")} as da, {_fold_sql("b")} as db, bool_and(not coalesce(tp > tm, false)) over w as bound, row_number() over (partition by feed_idx, crawl, page order by pos desc) = 1 as fin
  from y window w as (partition by feed_idx, crawl order by page, pos rows unbounded preceding)),
s as (select feed_idx, crawl, min(page) as stop_page from z where fin and (da or (bound and db)) group by feed_idx, crawl),
k as (select x.* from x left join s using (feed_idx, crawl) where page <= coalesce(stop_page, 10) qualify row_number() over (partition by x.feed_idx, x.crawl, coalesce(id, page || '-' || pos) order by page, pos) = 1)
select feed_idx, crawl, page, pos, id, url, title, tp as published_us from k where coalesce(tp, tm) >= {_FLOOR} and coalesce(tp, tm) < {_CEIL}""",
)
def read_feeds(spark, d):
    """The whole job on the delivered JSON pages, each delivery batch a crawl of its own: parse, early stop, first occurrences, period, output.  The fields are read from the lines it writes."""
    from feedloom.plans.reader import FeedJob

    job = FeedJob(since="2023-09-01", until="2025-09-01")
    docs = table(spark, d, "feed_pages").where("body is not null and status between 200 and 299").select("feed_idx", F.col("batch_id").alias("crawl"), "page", "body", "source_url", "content_type")
    made = F.col("value")
    ident = F.get_json_object(made, "$.id")
    return job.lines(job.from_documents(docs)).select(
        "feed_idx", "crawl", "page", "pos", F.when(~ident.startswith("urn:sha256:"), ident).alias("id"), *(F.get_json_object(made, f"$.{c}").alias(c) for c in ("url", "title")), F.unix_micros(dates.instant(F.get_json_object(made, "$.date_published"))).alias("published_us")
    )


# Streaming ------------------------------------------------------------------------------------------------------------------
_IDENT = "coalesce(nullif(id, ''), nullif(url, ''))"


@query("stream_items", f"{_EV} select feed_idx, id, min(page) >= 1 as found from j group by feed_idx, id")
def stream_items(spark, d):
    """Documents as a stream of files: parsed, each id of a feed once.  Which of its copies comes out is a matter of arrival."""
    root = scratch_path(spark, "stream-documents")
    docs = corpus.json_pages(corpus.entries(spark, d)).withColumn("fetched_at", F.lit(EARLY).cast("timestamp"))
    docs.write.parquet(f"{root}/docs")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/docs")
    q = streams.stream_items(stream).select("feed_idx", "page", "pos", "id").writeStream.format("parquet").option("path", f"{root}/items").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/items").select("feed_idx", "id", (F.col("page") >= 1).alias("found"))


@query("stream_dedup", f"select item_row, feed_idx from (select *, {_IDENT} as k, min(item_row) over (partition by feed_idx, {_IDENT}) as first from items) where k is null or item_row = first")
def stream_dedup(spark, d):
    """Deliveries as a stream of files, merged batch by batch into the store."""
    root = scratch_path(spark, "stream-store")
    home = lambda col: F.floor(col("batch_id") / 16)
    return streams.deliveries(spark, d, root, redelivery.entry_key(), "item_row", home, "item_row", "feed_idx", "batch_id", "id", "url").select("item_row", "feed_idx")
