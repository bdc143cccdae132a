"""Dates of feed entries: RFC 3339 texts kept as they were written, and instants to compare by.

The guard pattern comes before every cast, since a lax cast takes words and bare dates.
"""

from __future__ import annotations

import datetime as dt
import re
from email.utils import parsedate_to_datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
_RFC3339 = re.compile(RFC3339[1:-1])


# As columns
def instant(text: Column) -> Column:
    """Microsecond instant of an RFC 3339 text; null for anything else."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.regexp_replace(text, ",", ".")))


def nanos(text: Column) -> Column:
    """The three digits below a microsecond, so that (instant, nanos) orders exactly."""
    part = F.rpad(F.regexp_extract(text, r"[.,]([0-9]+)", 1), 9, "0")
    return F.when(text.rlike(RFC3339), F.substring(part, 7, 3).cast("int"))


def normalized(text: Column) -> Column:
    """The text with trailing zeros of the fraction trimmed and a zero offset as Z; null if it is no date."""
    point = F.regexp_replace(text, ",", ".")
    trimmed = F.regexp_replace(F.regexp_replace(point, r"(\.[0-9]{9})[0-9]+", "$1"), r"(\.[0-9]*?)0+(Z|[+-])", "$1$2")
    return F.when(instant(text).isNotNull(), F.regexp_replace(F.regexp_replace(trimmed, r"\.(Z|[+-])", "$1"), r"[+-]00:00$", "Z"))


def effective(published: Column, modified: Column, prefer_updated: bool = False) -> Column:
    a, b = (modified, published) if prefer_updated else (published, modified)
    return F.coalesce(a, b)


def within(t: Column, since: dt.datetime | None, until: dt.datetime | None) -> Column:
    """Half-open period.  Without bounds all rows stay; with one, undated rows go."""
    keep = F.lit(True)
    if since is not None:
        keep = keep & (t >= F.lit(since))
    if until is not None:
        keep = keep & (t < F.lit(until))
    return keep


# On the driver and inside parsers
def parse_bound(text: str, zone: str | None = "UTC") -> dt.datetime:
    """A bound of a period: RFC 3339, or a date meaning its midnight in the zone; no zone means that of this machine."""
    if _RFC3339.fullmatch(text):
        try:
            return dt.datetime.fromisoformat(text.replace(",", "."))
        except ValueError:
            pass
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        try:
            day = dt.datetime.fromisoformat(text)
            return day.replace(tzinfo=ZoneInfo(zone)) if zone else day.astimezone()
        except ValueError:
            pass
    raise ValueError(f"{text!r} is no time: neither RFC 3339 nor a date like 2024-01-31")


def normalize_text(text: str) -> str:
    """An RFC 3339 text in its short form; empty if it is none."""
    if not _RFC3339.fullmatch(text or ""):
        return ""
    head, frac, zone = re.fullmatch(r"(.{19})(?:[.,]([0-9]+))?(.+)", text).groups()
    try:
        dt.datetime.fromisoformat(head)
    except ValueError:
        return ""
    frac = (frac or "")[:9].rstrip("0")
    if zone != "Z" and (int(zone[1:3]) > 23 or int(zone[4:]) > 59):
        return ""
    return head + ("." + frac if frac else "") + ("Z" if zone in ("+00:00", "-00:00") else zone)


def feed_date(text: str | None) -> str:
    """A date of an XML feed (RFC 3339, ISO without colon in the offset, RFC 1123, a bare date) as RFC 3339; empty if it is none."""
    t = " ".join((text or "").split())
    if not t:
        return ""
    if got := normalize_text(t.replace(" ", "T", 1) if re.match(r"\d{4}-\d\d-\d\d ", t) else t):
        return got
    if m := re.fullmatch(r"(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d)(:\d\d)?(\.\d+)?)?\s*(Z|[+-]\d\d:?\d\d)?", t):
        zone = m[5] or "Z"
        if len(zone) == 5:
            zone = zone[:3] + ":" + zone[3:]
        return normalize_text(f"{m[1]}T{m[2] or '00:00'}{m[3] or ':00'}{m[4] or ''}{zone}")
    try:
        got = parsedate_to_datetime(t)
    except (ValueError, TypeError, IndexError):
        return ""
    if got.tzinfo is None:
        got = got.replace(tzinfo=dt.timezone.utc)
    return normalize_text(got.isoformat(timespec="seconds"))
