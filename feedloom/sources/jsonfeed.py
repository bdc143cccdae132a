"""JSON Feed 1.0 and 1.1 documents, decoded strictly: a value of the wrong type fails the document."""

from __future__ import annotations

import hashlib
import json

from feedloom.functions.dates import normalize_text
from feedloom.functions.numbers import number_text
from feedloom.functions.urls import resolve, without_fragment
from feedloom.operators.flatten import load_object

# The two versions that are read.
VERSIONS = ("https://jsonfeed.org/version/1", "https://jsonfeed.org/version/1.1")


class NotFeed(ValueError):
    pass


# Kinds of members: text, list of text, number, and records.
_AUTHOR = {"name": "s", "url": "s", "avatar": "s"}
_ATTACHMENT = {"url": "s", "mime_type": "s", "title": "s", "size_in_bytes": "i", "duration_in_seconds": "f"}
_ITEM = {k: "s" for k in "id url external_url title content_html content_text summary image banner_image date_published date_modified".split()} | {
    "authors": [_AUTHOR],
    "author": _AUTHOR,
    "tags": ["s"],
    "attachments": [_ATTACHMENT],
}
_FEED = {"version": "s", "title": "s", "home_page_url": "s", "next_url": "s", "authors": [_AUTHOR], "author": _AUTHOR, "items": [_ITEM]}


def _fit(value, kind, where: str):
    """The value as its kind; keys match without case, the last one wins; null is absence."""
    if value is None:
        return None
    if kind == "s":
        if isinstance(value, str):
            return value.encode("utf-8", "replace").decode()
    elif kind == "i":
        if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63:
            return value
    elif kind == "f":
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return float(value)
    elif isinstance(kind, list):
        if isinstance(value, list):
            return [_fit(v, kind[0], where) if v is not None else ("" if kind[0] == "s" else {}) for v in value]
    elif isinstance(value, dict):
        out = {}
        for k, v in value.items():
            name = k if k in kind else k.lower()
            if name in kind and v is not None:
                out[name] = _fit(v, kind[name], f"{where}.{name}")
        return out
    raise NotFeed(f"{where} has a value of the wrong type")


_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def _text(s: str) -> str:
    out = json.dumps(s, ensure_ascii=False)
    return "".join(_ESCAPES.get(c, c) for c in out) if any(c in out for c in _ESCAPES) else out


def _author(a: dict) -> str:
    return "{" + ",".join(f'"{k}":{_text(a[k])}' for k in ("name", "url", "avatar") if a.get(k)) + "}"


def generated_id(item: dict) -> str:
    """A name for an entry that has none: the digest of its compact JSON with all members in a fixed order."""

    def many(v, one):
        return "null" if v is None else "[" + ",".join(map(one, v)) + "]"

    def attachment(a: dict) -> str:
        return "{" + ",".join([*(f'"{k}":{_text(a.get(k) or "")}' for k in ("url", "mime_type", "title")), f'"size_in_bytes":{a.get("size_in_bytes") or 0}', f'"duration_in_seconds":{number_text(a.get("duration_in_seconds") or 0.0)}']) + "}"

    parts = [f'"{k}":{_text(item.get(k) or "")}' for k in list(_ITEM)[:11]]
    parts.append(f'"authors":{many(item.get("authors"), _author)}')
    parts.append('"author":' + (_author(item["author"]) if item.get("author") is not None else "null"))
    parts.append(f'"tags":{many(item.get("tags"), _text)}')
    parts.append(f'"attachments":{many(item.get("attachments"), attachment)}')
    return "urn:sha256:" + hashlib.sha256(("{" + ",".join(parts) + "}").encode()).hexdigest()


def attachment(a: dict) -> dict | None:
    """Without an address or a type it is dropped; sizes and durations below zero count as absent."""
    if not a.get("url") or not a.get("mime_type"):
        return None
    return {"url": a["url"], "mime_type": a["mime_type"], "title": a.get("title") or None, "size_in_bytes": max(0, a.get("size_in_bytes") or 0) or None, "duration_in_seconds": max(0.0, a.get("duration_in_seconds") or 0.0) or None}


def _authors(*choices) -> list[dict] | None:
    for c in choices:
        if isinstance(c, dict):
            c = [c]
        if c:
            return [{k: a.get(k) or None for k in _AUTHOR} for a in c]
    return None


def parse_json_feed(body: bytes, source_url: str) -> dict:
    """The parsed document; raises NotFeed."""
    raw = load_object(body)
    if raw is None:
        raise NotFeed("invalid JSON")
    feed = _fit(raw, _FEED, "feed")
    if feed.get("version") not in VERSIONS:
        raise NotFeed("JSON document is not a supported JSON Feed")
    info = {"title": feed.get("title") or None, "home_page_url": feed.get("home_page_url") or None, "feed_url": source_url}
    items = []
    for it in feed.get("items") or ():
        kept = [a for a in map(attachment, it.get("attachments") or ()) if a]
        out = {k: it.get(k) or None for k in ("url", "external_url", "title", "content_html", "content_text", "summary", "image", "banner_image")}
        out |= {
            "_feed": info,
            "id": it.get("id") or it.get("url") or generated_id(it),
            "date_published": normalize_text(it.get("date_published") or "") or None,
            "date_modified": normalize_text(it.get("date_modified") or "") or None,
            "authors": _authors(it.get("authors"), it.get("author"), feed.get("authors"), feed.get("author")),
            "tags": it.get("tags") or None,
            "attachments": kept or None,
        }
        items.append(out)
    nxt = resolve(source_url, feed.get("next_url"))
    return {"items": items, "generator": None, "next_url": without_fragment(nxt) or None if nxt else None}
