"""The operators as SQL functions.

    register(spark)
    SELECT f.url FROM pages, LATERAL feed_links(body, source_url, content_type) f
    SELECT inline(feed_parse(body, source_url).items) FROM docs
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import urls
from feedloom.operators.discovery import DiscoveryError, find_links, looks_like_html
from feedloom.operators.feeds import parse_document
from feedloom.plans.jq import Program, dumps
from feedloom.schema import PARSED


class FeedLinks:
    """Advertised feeds of a page; a page that can't be read has none."""

    def eval(self, body, page_url, content_type):
        try:
            found = find_links(bytes(body) if body is not None else None, page_url, content_type)
        except DiscoveryError:
            return
        for x in found:
            yield x["pos"], x["url"], x["title"], x["type"]


#: A program is read once, not for every row.
_program = lru_cache(maxsize=100)(Program)


class Jq:
    """Values of a program for one JSON text, in order."""

    def eval(self, item, program):
        if item is not None:
            for k, v in enumerate(_program(program).run(json.loads(item))):
                yield k, dumps(v)


def register(spark: SparkSession) -> None:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T._parse_datatype_string(PARSED))

    def is_html(body: pa.Array, content_type: pa.Array) -> pa.Array:
        return pa.array(list(map(looks_like_html, body.to_pylist(), content_type.to_pylist())), pa.bool_())

    def parsed(body: pa.Array, source_url: pa.Array) -> pa.Array:
        return pa.array(list(map(parse_document, body.to_pylist(), source_url.to_pylist())), kind)

    urls.register(spark)
    spark.udf.register("looks_like_html", F.arrow_udf(is_html, "boolean"))
    spark.udf.register("feed_parse", F.arrow_udf(parsed, PARSED))
    spark.udtf.register("feed_links", F.udtf(FeedLinks, returnType="pos int, url string, title string, type string"))
    spark.udtf.register("jq", F.udtf(Jq, returnType="out_pos int, value string"))
