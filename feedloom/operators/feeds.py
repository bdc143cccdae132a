"""Documents to items, and what is decided over the pages and items of a feed.

A document row is ``feed_idx, page, body, source_url, content_type`` (and ``status``); where a feed was read more than
once, ``crawl`` tells the readings apart, and all that is said of a feed below holds for each of its crawls.  The order of items is
``(feed_idx, crawl, page, pos)``.  Operators never sort; only sinks do.  Identity is settled by aggregations that combine
before the shuffle; the order of dates by one small summary of each page.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import dates, urls
from feedloom.functions.numbers import number_column
from feedloom.operators import descent
from feedloom.operators.discovery import DiscoveryError, find_links, looks_like_html
from feedloom.schema import ITEM_FIELDS, LINK, MAX_BYTES, MAX_PAGES, PARSED
from feedloom.sources.jsonfeed import NotFeed, parse_json_feed
from feedloom.sources.xmlfeed import parse_xml_feed


def feed_keys(df: DataFrame) -> list[str]:
    return [c for c in ("feed_idx", "crawl") if c in df.columns]


def position(df: DataFrame) -> list[str]:
    """The columns that put items in order."""
    return [*feed_keys(df), *(c for c in ("page", "pos", "out_pos") if c in df.columns)]


# Parsing --------------------------------------------------------------------------------------------------------


def looks_like_json(body: bytes) -> bool:
    """The first byte that is no space opens an object; a list isn't taken for JSON."""
    return body.lstrip(b" \t\r\n\x0b\x0c\xc2\x85\xa0")[:1] == b"{"


def parse_document(body: bytes | None, source_url: str | None, content_type: str | None = "", status: int | None = 200) -> dict:
    """One document: items, generator and next link, or an error class with its message."""

    def failed(kind: str, message: str) -> dict:
        return {"items": None, "generator": None, "next_url": None, "descent": None, "error": kind, "message": message}

    where = urls.display(source_url or "")
    if status is not None and not 200 <= status < 300:
        return failed("HTTP_STATUS", f"asking for {where}: status {status}")
    if not urls.valid_http(source_url):
        return failed("INVALID_URL", "a document needs an http or https address with a host and without a user")
    body = body or b""
    if len(body) > MAX_BYTES:
        return failed("TOO_LARGE", f"reading {where}: more than {MAX_BYTES} bytes")
    body = body.removeprefix(b"\xef\xbb\xbf")
    try:
        got = parse_json_feed(body, source_url) if looks_like_json(body) else parse_xml_feed(body, source_url)
    except NotFeed as e:
        hint = "; the document is HTML: discover its feeds first" if looks_like_html(body, content_type) else ""
        return failed("NOT_FEED", f"reading {where}: {e}{hint}")
    return got | {"descent": descent.to_record(descent.of_items(got["items"])), "error": None, "message": None}


def _parse(batches: Iterator, columns: tuple[str, ...], kind) -> Iterator:
    for b in batches:
        get = {n: b.column(n).to_pylist() for n in ("body", "source_url")}
        ct = b.column("content_type").to_pylist() if "content_type" in b.schema.names else [""] * b.num_rows
        st = b.column("status").to_pylist() if "status" in b.schema.names else [200] * b.num_rows
        for k in range(0, b.num_rows, 64):  # parsed documents are much larger than their rows
            got = [parse_document(*x) for x in zip(get["body"][k : k + 64], get["source_url"][k : k + 64], ct[k : k + 64], st[k : k + 64])]
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 64) for c in columns), pa.array(got, kind)], names=[*columns, "parsed"])


def parse(docs: DataFrame) -> DataFrame:
    """Documents with a struct ``parsed``; the body is left behind."""
    from pyspark.sql.pandas.types import to_arrow_type

    keep = tuple(c for c in docs.columns if c != "body")
    kind = T._parse_datatype_string(PARSED)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("parsed", kind)])
    return docs.mapInArrow(partial(_parse, columns=keep, kind=to_arrow_type(kind)), schema)


def items(parsed: DataFrame) -> DataFrame:
    """One row per item with ``page`` and ``pos``, and typed instants beside the texts."""
    keep = [*feed_keys(parsed), *(["page"] if "page" in parsed.columns else [])]
    out = parsed.where("parsed.error is null").select(*keep, F.posexplode("parsed.items").alias("pos", "item")).select(*keep, "pos", "item.*")
    return out.withColumns({"ts_published": dates.instant(F.col("date_published")), "ts_modified": dates.instant(F.col("date_modified"))})


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("parsed.error is not null").select(*[c for c in ("feed_idx", "crawl", "page", "source_url") if c in parsed.columns], "parsed.error", "parsed.message")


# Discovery ----------------------------------------------------------------------------------------------------------
def _discover(batches: Iterator, columns: tuple[str, ...], kind) -> Iterator:
    for b in batches:
        ct = b.column("content_type").to_pylist() if "content_type" in b.schema.names else [""] * b.num_rows
        links, errs, msgs = [], [], []
        for body, page, c in zip(b.column("body").to_pylist(), b.column("source_url").to_pylist(), ct):
            try:
                links.append(find_links(body, page, c))
                errs.append(None)
                msgs.append(None)
            except DiscoveryError as e:
                links.append(None)
                errs.append(e.kind)
                msgs.append(str(e))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(links, kind), pa.array(errs, pa.string()), pa.array(msgs, pa.string())], names=[*columns, "links", "error", "message"])


def discover(pages: DataFrame) -> DataFrame:
    """Pages with ``links`` (array), or an error and no links at all."""
    from pyspark.sql.pandas.types import to_arrow_type

    keep = tuple(c for c in pages.columns if c != "body")
    kind = T._parse_datatype_string(f"array<{LINK}>")
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("links", kind), T.StructField("error", T.StringType()), T.StructField("message", T.StringType())])
    return pages.mapInArrow(partial(_discover, columns=keep, kind=to_arrow_type(kind)), schema)


def links(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(*keys, F.inline("links"))


def first_link(found: DataFrame, *keys: str) -> DataFrame:
    """The only link that is ever followed: the first of each page."""
    return found.where(F.size("links") > 0).select(*keys, F.col("links")[0]["url"].alias("url"))


# Over items ---------------------------------------------------------------------------------------------------------
def keep_first(rows: DataFrame) -> DataFrame:
    """The first occurrence of each id of a feed in feed order, also within a page.

    An aggregation that combines before the shuffle, so an id with a third of all rows never gathers; null is an id like any other.
    """
    keys = feed_keys(rows)
    best = rows.select(*keys, "id", F.struct("page", "pos").alias("__at"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"))
    return best.groupBy(*keys, "id").agg(F.min_by("__row", "__at").alias("__row")).select("__row.*")


def in_period(rows: DataFrame, since: dt.datetime | None = None, until: dt.datetime | None = None, prefer_updated: bool = False) -> DataFrame:
    """Half-open period; undated items go as soon as there is a bound."""
    if since is not None and until is not None and since > until:
        raise ValueError("the period ends before it begins")
    return rows.where(dates.within(dates.effective(F.col("ts_published"), F.col("ts_modified"), prefer_updated), since, until))


def order_stop(parsed: DataFrame, since: dt.datetime, prefer_updated: bool = False, max_pages: int = MAX_PAGES) -> DataFrame:
    """``feed_idx, crawl, stop_page`` of the feeds that stop early: the first page after which dates in descending order have passed ``since``.

    Works on parsed documents, of which only the summaries travel: at most ``max_pages`` of a crawl meet, each of some 100 bytes,
    whatever the pages hold.  Repeated items count like any other; a document that is no feed counts for nothing, and of a page that a
    crawl holds more than once one counts, the one with the least hash of its summary.
    """
    floor = descent.bound(since)

    def stops(pages: pa.Array) -> pa.Array:
        return pa.array([descent.stop_page(((p["page"], descent.from_record(p["descent"])) for p in ps), floor, prefer_updated) for ps in pages.to_pylist()], pa.int32())

    keys = feed_keys(parsed)
    good = parsed.where((F.col("page") <= max_pages) & F.col("parsed.error").isNull()).select(*keys, "page", "parsed.descent")
    slim = good.groupBy(*keys, "page").agg(F.min_by("descent", F.xxhash64("descent")).alias("descent")).select(*keys, F.struct("page", "descent").alias("p"))
    per = slim.groupBy(*keys).agg(F.array_sort(F.collect_list("p"), lambda a, b: F.when(a["page"] < b["page"], -1).when(a["page"] > b["page"], 1).otherwise(0)).alias("pages"))
    return per.select(*keys, F.arrow_udf(stops, "int")("pages").alias("stop_page")).where("stop_page is not null")


def cut_after(rows: DataFrame, stop: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Rows up to each feed's stop page and the page limit."""
    return rows.join(stop, feed_keys(rows), "left").where(F.col("page") <= F.least(F.coalesce("stop_page", F.lit(max_pages)), F.lit(max_pages))).drop("stop_page")


def new_per_page(rows: DataFrame) -> DataFrame:
    """``feed_idx, crawl, page, new_items``: ids that no earlier item of the feed had."""
    keys = feed_keys(rows)
    first = rows.groupBy(*keys, "id").agg(F.min("page").alias("page")).groupBy(*keys, "page").agg(F.count("*").alias("new_items"))
    pages = rows.select(*keys, "page").distinct()
    return pages.join(first, [*keys, "page"], "left").select(*keys, "page", F.coalesce("new_items", F.lit(0)).alias("new_items"))


def guessed_pages(rows: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """``feed_idx, stop_page`` of feeds read by guessing page numbers: a page that adds nothing new ends them, as does one that is missing."""
    keys = feed_keys(rows)
    stale = new_per_page(rows).where("new_items = 0").select(*keys, "page")
    if missing is not None:
        stale = stale.unionByName(missing.select(*keys, "page"))
    return stale.groupBy(*keys).agg(F.min("page").alias("stop_page"))


# Pages of a static corpus -------------------------------------------------------------------------------------------------
def follow(pages: DataFrame, starts: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Pages reached from each start by next links: ``feed_idx, page, url``.

    ``pages``: ``url, next_url``; ``starts``: ``feed_idx, url``.  At most ``max_pages`` joins (page limit); a visited address
    ends a feed, so cycles end too.  Each step reads the pages table by one equi-join on the address.
    """
    from feedloom.session import materialize

    edges = pages.select(F.col("url").alias("from_url"), "next_url")
    at = starts.select("feed_idx", F.lit(1).alias("page"), "url", F.array("url").alias("seen"))
    out = at.select("feed_idx", "page", "url")
    front = materialize(at, "follow-1")
    for k in range(2, max_pages + 1):
        nxt = front.join(edges, front["url"] == edges["from_url"]).where("next_url is not null and next_url <> ''")
        nxt = nxt.where(~F.array_contains("seen", F.col("next_url"))).select("feed_idx", F.lit(k).alias("page"), F.col("next_url").alias("url"), F.array_append("seen", F.col("next_url")).alias("seen"))
        front = materialize(nxt, f"follow-{k}")
        if front.isEmpty():
            break
        out = out.unionByName(front.select("feed_idx", "page", "url"))
    return out


def before_first_error(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Items of feeds before the first one, in input order, that has an error.  One number reaches the driver and is pushed down."""
    bad = failed.agg(F.min("feed_idx")).first()[0]
    return rows if bad is None else rows.where(F.col("feed_idx") < bad)


def item_json(rows: DataFrame, fields: list[str]) -> Column:
    """An item as compact JSON with sorted keys and shortest numbers; absent fields are left out."""
    kind = rows.schema["attachments"].dataType
    inner = kind.elementType.names if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else []
    if "attachments" not in fields or "duration_in_seconds" not in inner:
        return F.to_json(F.struct(*fields))
    # The number is written here and its quotation marks taken away: no text can hold the name with plain quotation marks around it.
    texts = F.transform("attachments", lambda a: F.struct(*[(number_column(a[c]) if c == "duration_in_seconds" else a[c]).alias(c) for c in inner]))
    out = F.to_json(F.struct(*[texts.alias(c) if c == "attachments" else F.col(c) for c in fields]))
    return F.when(F.col("attachments").isNull(), out).otherwise(F.regexp_replace(out, r'"duration_in_seconds":"([^"]*)"', '"duration_in_seconds":$1'))


def as_output(rows: DataFrame, with_feed: bool = False) -> DataFrame:
    """``feed_idx, crawl, page, pos, value``: each item as a line of output."""
    return rows.select(*position(rows), item_json(rows, [c for c in ITEM_FIELDS if with_feed or c != "_feed"]).alias("value"))
