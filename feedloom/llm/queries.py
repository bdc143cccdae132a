"""Queries of the problems tagged llm, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import markup, mixing, mojibake, site_lines, spans, tokens, truncation
from feedloom.session import table


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(table(spark, d, "items"), "item_row", ("summary", "content_text"))


def p3_method(spark: SparkSession, d: str) -> DataFrame:
    return truncation.method_judged(table(spark, d, "items"), "item_row", ("summary", "content_text")).where("truncated").select("item_row", "field")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("truncated").select("item_row", "field")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_truncated(spark, d))


def _site_lines(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.lines(table(spark, d, "items"), "item_row", "feed_idx", "content_html")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated(_site_lines(spark, d)).select(F.col("row_id").alias("item_row"), "line_no")


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    found = _site_lines(spark, d)
    return site_lines.removed(table(spark, d, "items"), site_lines.candidates(found).select("row_id", "line_no"), "item_row", "content_html")


GARBLED = ("title", "content_html")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    model, _ = mojibake.train_whole(table(spark, d, "documents"), "text", "doc_id")
    return mojibake.found(table(spark, d, "items"), "item_row", GARBLED, model)


def p5_validation(spark: SparkSession, d: str) -> DataFrame:
    _, report = mojibake.train_whole(table(spark, d, "documents"), "text", "doc_id", others=True)
    return spark.createDataFrame([tuple(report.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in report.items()))


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    model, _ = mojibake.train_whole(table(spark, d, "documents"), "text", "doc_id")
    return mojibake.restored(table(spark, d, "items"), "item_row", GARBLED, model)


MARKED = (("content_html", True), ("summary", False))


def p6_method(spark: SparkSession, d: str) -> DataFrame:
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    entry = F.struct("feed_idx", F.coalesce(own("id"), own("url"), F.concat(F.lit("\n"), F.col("item_row").cast("string"))))
    return markup.method_texts(table(spark, d, "items"), "item_row", F.try_parse_url(F.col("_feed.feed_url"), F.lit("HOST")), MARKED, entry=entry)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found_languages(table(spark, d, "items"), "item_row", MARKED)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.count(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_method(spark: SparkSession, d: str) -> DataFrame:
    return spans.method_classes(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.span_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return spans.classes(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(table(spark, d, "documents"))


QUERIES = {
    "p3_method": p3_method,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_cleaned": p4_cleaned,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p5_validation": p5_validation,
    "p6_method": p6_method,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p8_counts": p8_counts,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_method": p10_method,
    "p10_found": p10_found,
    "p10_classes": p10_classes,
    "p10_shares": p10_shares,
}

# Every run of 200 characters of every text.
_RUNS = """with d as (select doc_id, text, length(text) as n from documents where length(text) >= 200),
w as (select doc_id, n, i, md5(substr(text, cast(i as integer), 200)) as h from (select *, unnest(range(1, n - 198)) as i from d))"""

SQL = {
    "p10_found": f"""{_RUNS}, u as (select distinct doc_id, h from w), k as (select h from u group by h having count(*) > 1), v as (select u.* from u join k using (h))
select distinct a.doc_id as doc_a, b.doc_id as doc_b from v a join v b using (h) where a.doc_id < b.doc_id""",
    "p10_classes": f"""with recursive {_RUNS.removeprefix("with ")}, u as (select distinct doc_id, h from w), m as (select h, min(doc_id) as b from u group by h having count(*) > 1),
e as (select distinct doc_id as a, b from u join m using (h)), g as (select a, b from e union select b, a from e),
r(doc_id, c) as (select a, a from g union select r.doc_id, g.b from r join g on g.a = r.c)
select doc_id, coalesce(class_id, doc_id) as class_id from documents left join (select doc_id, min(c) as class_id from r group by doc_id) using (doc_id)""",
    "p10_shares": f"""{_RUNS}, k as (select h from w group by h having count(distinct doc_id) > 1), s as (select distinct doc_id, i from w join k using (h)),
c as (select doc_id, sum(least(200, i - coalesce(p, i - 200))) as m from (select *, lag(i) over (partition by doc_id order by i) as p from s) group by doc_id)
select doc_id, cast(coalesce(length(text), 0) as bigint) as n_chars, cast(coalesce(m, 0) as bigint) as shared_chars, case when length(text) > 0 then coalesce(m, 0) / length(text) else 0.0 end as share
from documents left join c using (doc_id)""",
    "p4_found": """
with l as (
  select item_row, feed_idx, cast(i - 1 as integer) as line_no,
    trim(regexp_replace(regexp_replace(a[i], '<[^>]*>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') as t
  from (select item_row, feed_idx, a, unnest(range(1, len(a) + 1)) as i
        from (select item_row, feed_idx, string_split(content_html, chr(10)) as a from items where content_html is not null))),
k as (select * from l where regexp_matches(t, '[\\p{L}\\p{Nd}\\p{Nl}\\p{No}]')),
f as (select feed_idx, t from k group by feed_idx, t having count(distinct item_row) >= 10)
select item_row, line_no from k join f using (feed_idx, t)""",
}
