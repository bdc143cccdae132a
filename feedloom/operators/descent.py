"""Dates in descending order that have passed a bound: summaries that join, page by page, live and in batch.

A summary of any stretch of entries is small, and two neighbouring ones make that of both, so neither a reader nor a
task ever holds more than summaries.  Entries count by their published date first and, apart, by their modified date
first; which of the two decides is settled when all is joined.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import add

from feedloom.schema import ORDER_SAMPLES

#: Seconds since 1970 and nanoseconds: exact, whatever the year.
Instant = tuple[int, int]


def exact(text: str | None) -> Instant | None:
    """The instant of a normalised RFC 3339 text."""
    if not text:
        return None
    rest = text[19:].lstrip(".0123456789")
    digits = text[20 : len(text) - len(rest)]
    when = dt.datetime.fromisoformat(text[:19] + ("+00:00" if rest == "Z" else rest))
    return (when - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(seconds=1), int(digits.ljust(9, "0") or 0)


def bound(t: dt.datetime) -> Instant:
    """A bound without zone means UTC."""
    t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    d = t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return d // dt.timedelta(seconds=1), t.microsecond * 1000


@dataclass(frozen=True)
class Slope:
    """How many dates a stretch has, its first and last, and whether none is later than one before it."""

    count: int = 0
    first: Instant | None = None
    last: Instant | None = None
    falls: bool = True

    def __add__(self, nxt: Slope) -> Slope:
        if not (self.count and nxt.count):
            return self if self.count else nxt
        return Slope(self.count + nxt.count, self.first, nxt.last, self.falls and nxt.falls and nxt.first <= self.last)

    def passed(self, since: Instant) -> bool:
        return self.count >= ORDER_SAMPLES and self.falls and self.last < since


@dataclass(frozen=True)
class Stretch:
    published: Slope = Slope()
    modified: Slope = Slope()
    late: bool = False  # something was published after it was modified

    def __add__(self, nxt: Stretch) -> Stretch:
        return Stretch(self.published + nxt.published, self.modified + nxt.modified, self.late or nxt.late)

    def passed(self, since: Instant, prefer_updated: bool) -> bool:
        by_modified = self.modified.passed(since)
        return by_modified if prefer_updated else self.published.passed(since) or (by_modified and not self.late)


def of_items(items: Iterable[dict]) -> Stretch:
    """Summary of one page's items in their order."""

    def one(item: dict) -> Stretch:
        a, b = exact(item["date_published"]), exact(item["date_modified"])
        dot = lambda t: Slope(1, t, t) if t else Slope()
        return Stretch(dot(a or b), dot(b or a), bool(a and b and a > b))

    return reduce(add, map(one, items), Stretch())


# As the record ``schema.DESCENT``, and back.
def to_record(s: Stretch) -> dict:
    return {"late": s.late, "slopes": [{"count": x.count, "falls": x.falls, "first": x.first, "last": x.last} for x in (s.published, s.modified)]}


def from_record(r: dict | None) -> Stretch:
    if r is None:
        return Stretch()
    pair = lambda v: None if v is None else tuple(v)
    return Stretch(*(Slope(x["count"], pair(x["first"]), pair(x["last"]), x["falls"]) for x in r["slopes"]), r["late"])


def stop_page(pages: Iterable[tuple[int, Stretch]], since: Instant, prefer_updated: bool = False) -> int | None:
    """The first page, in the given order, at whose end the dates have passed ``since``."""
    far = Stretch()
    for page, s in pages:
        far += s
        if far.passed(since, prefer_updated):
            return page
    return None
