"""From addresses or documents to items, with the options of a reading job.

    items = FeedJob(since="2024-01-01", prefer_updated=True).from_documents(docs)
    lines = FeedJob(jq=".title", raw=True).lines(items)
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import parse_bound
from feedloom.operators import feeds
from feedloom.plans import jq as programs
from feedloom.schema import MAX_PAGES


class FeedError(RuntimeError):
    """The first feed, in input order, that failed; ``kind`` is its error class."""

    def __init__(self, feed_idx: int, kind: str, message: str):
        super().__init__(message)
        self.feed_idx, self.kind = feed_idx, kind


@dataclass
class FeedJob:
    since: str | dt.datetime | None = None
    until: str | dt.datetime | None = None
    prefer_updated: bool = False
    max_pages: int = MAX_PAGES
    discovery: bool = True
    user_agent: str | None = None
    jq: str = ""
    raw: bool = False
    with_feed: bool = False
    zone: str | None = "UTC"
    #: ``module:function`` that makes one request (``sources.http.Transport``) in place of the built-in one.
    transport: str | None = None
    #: Feeds that are read at once.
    at_once: int = 8

    def __post_init__(self):
        self.since = parse_bound(self.since, self.zone) if isinstance(self.since, str) and self.since else self.since or None
        self.until = parse_bound(self.until, self.zone) if isinstance(self.until, str) and self.until else self.until or None
        if self.max_pages < 1:
            raise ValueError("at least one of a feed's pages must be read")
        if self.since and self.until and self.since > self.until:
            raise ValueError("the period ends before it begins")
        if self.user_agent is not None and not self.user_agent.strip():
            raise ValueError("the user agent is blank")
        if self.raw and not self.jq:
            raise ValueError("bare texts come from a program only")
        if self.jq:
            programs.Program(self.jq)  # a wrong program fails before anything is read

    def _options(self) -> dict[str, str]:
        o = {"maxPages": str(self.max_pages), "discovery": str(self.discovery).lower(), "preferUpdated": str(self.prefer_updated).lower(), "atOnce": str(self.at_once)}
        if self.since:
            o["since"] = self.since.isoformat().replace("+00:00", "Z")
        return o | {k: v for k, v in (("userAgent", self.user_agent), ("transport", self.transport)) if v}

    def fetch(self, spark: SparkSession, addresses: list[str], **options: str) -> DataFrame:
        """Documents of live feeds."""
        from feedloom.sources import http

        http.register(spark)
        return spark.read.format("feeds").options(**self._options() | {"urls": json.dumps(addresses)} | options).load()

    def fetch_table(self, addresses: DataFrame, **options: str) -> DataFrame:
        """The same for addresses in a table ``feed_idx, url`` of any size; they stay on the executors."""
        from feedloom.sources import http

        return http.documents(addresses, self._options() | options)

    def parse(self, docs: DataFrame) -> DataFrame:
        """Items of single documents: no identity check across items, no pages; only the period."""
        return feeds.in_period(feeds.items(feeds.parse(docs)), self.since, self.until, self.prefer_updated)

    def from_documents(self, docs: DataFrame) -> DataFrame:
        """Items of feeds: pages up to the limit and the early stop, first occurrences, then the period.

        A document is parsed once: with a lower bound the parsed pages are written, since the stop is read off their summaries first.
        """
        from feedloom.session import materialize

        parsed = feeds.parse(docs.where(F.col("page") <= self.max_pages))
        if not self.since:
            return feeds.in_period(feeds.keep_first(feeds.items(parsed)), None, self.until, self.prefer_updated)
        parsed = materialize(parsed, "parsed")
        rows = feeds.cut_after(feeds.items(parsed), feeds.order_stop(parsed, self.since, self.prefer_updated, self.max_pages), self.max_pages)
        return feeds.in_period(feeds.keep_first(rows), self.since, self.until, self.prefer_updated)

    def lines(self, rows: DataFrame) -> DataFrame:
        """``feed_idx, crawl, page, pos, out_pos, value``: one line of output per row, not sorted."""
        if not self.jq:
            return feeds.as_output(rows, self.with_feed).withColumn("out_pos", F.lit(0))
        out = programs.apply(rows, self.jq, self.with_feed)
        return programs.raw(out) if self.raw else out

    def ordered(self, lines: DataFrame) -> DataFrame:
        return lines.orderBy(*feeds.position(lines))

    def run(self, spark: SparkSession, addresses: list[str], **options: str) -> Iterator[str]:
        """Lines in input order up to the first feed that failed, which is raised after them."""
        from feedloom.session import materialize

        docs = materialize(self.fetch(spark, addresses, **options), "documents")
        first = docs.where("error is not null").orderBy("feed_idx").select("feed_idx", "error", "message").first()
        good = docs.where("error is null").drop("error", "message")
        if first:
            good = good.where(F.col("feed_idx") < first.feed_idx)
        for r in self.ordered(self.lines(self.from_documents(good))).select("value").toLocalIterator():
            yield r.value
        if first:
            raise FeedError(first.feed_idx, first.error, first.message)


def write_lines(lines: DataFrame, path: str) -> None:
    """JSON Lines as files: range-partitioned by position, so the files in order are the output in order."""
    lines.orderBy(*feeds.position(lines)).select("value").write.text(path)
