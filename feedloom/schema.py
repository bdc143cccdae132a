"""Schemas.  Item fields are declared in alphabetical order, which is the order of their keys in the output."""

from __future__ import annotations

ATTACHMENT = "struct<duration_in_seconds double, mime_type string, size_in_bytes bigint, title string, url string>"
AUTHOR = "struct<avatar string, name string, url string>"
FEED = "struct<feed_url string, home_page_url string, title string>"
ITEM = (
    f"struct<_feed {FEED}, attachments array<{ATTACHMENT}>, authors array<{AUTHOR}>, banner_image string, content_html string, content_text string, "
    "date_modified string, date_published string, external_url string, id string, image string, summary string, tags array<string>, title string, url string>"
)
#: What one document parses to.  ``error`` is null for a feed; ``descent`` is the summary of its items' dates (``operators.descent``).
DESCENT = "struct<late boolean, slopes array<struct<count int, falls boolean, first array<bigint>, last array<bigint>>>>"
PARSED = f"struct<items array<{ITEM}>, generator string, next_url string, descent {DESCENT}, error string, message string>"
LINK = "struct<pos int, url string, title string, type string>"
ITEM_FIELDS = "_feed attachments authors banner_image content_html content_text date_modified date_published external_url id image summary tags title url".split()
#: Documents above this size are refused.
MAX_BYTES = 32 << 20
MAX_DEPTH = 512
MAX_PAGES = 10
ORDER_SAMPLES = 5
