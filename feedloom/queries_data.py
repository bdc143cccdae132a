"""Queries p1, p2 and p7 over the feed project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import flatten, instants, redelivery
from feedloom.session import scratch_path, table

FIELDS = ("date_published", "date_modified")


def _slim(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("item_row", "feed_idx", "batch_id", "id", "url")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _slim(spark, d)
    store = redelivery.replay(rows, scratch_path(spark, "deliveries"), redelivery.entry_key(), "item_row", "batch_id")
    return redelivery.copies(rows, store.winners(), redelivery.entry_key(), "item_row")


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    rows = _slim(spark, d)
    store = redelivery.replay(rows, scratch_path(spark, "deliveries"), redelivery.entry_key(), "item_row", "batch_id")
    return store.winners().select("item_row", "feed_idx", "id", "url")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    got = instants.normalized(table(spark, d, "items"), table(spark, d, "feeds"), "item_row", FIELDS)
    return got.where("not already").select("item_row", "field", "epoch_us")


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per field: values given, and those that became one instant."""
    items = table(spark, d, "items")
    got = instants.normalized(items, table(spark, d, "feeds"), "item_row", FIELDS).groupBy("field").agg(F.count("*").alias("instants"), F.count_if("already").alias("already"))
    given = items.agg(*[F.count_if(F.col(f) != "").alias(f) for f in FIELDS]).selectExpr(f"stack(2, {', '.join(f'{f!r}, `{f}`' for f in FIELDS)}) as (field, given)")
    return given.join(got, "field", "left").select("field", "given", F.coalesce("instants", F.lit(0)).alias("instants"), F.coalesce("already", F.lit(0)).alias("already"))


def _occ(spark: SparkSession, d: str) -> DataFrame:
    return flatten.occurrences(table(spark, d, "feed_pages").where("body is not null").select("page_row", "body"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    b = flatten.bridges(_occ(spark, d))
    return b.where("child in ('author', 'tag', 'attachment')").select(F.col("doc").alias("page_row"), "item_pos", "child", "child_pos")


def p7_nodes(spark: SparkSession, d: str) -> DataFrame:
    return flatten.nodes(_occ(spark, d)).select(F.hex("node").alias("node"), "canon", "occurrences")


def _p7_table(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = flatten.flat_tables(_occ(spark, d))[name].drop("node")
        return t.drop("child_pos") if name == "items" else t

    return run


def p7_item_tags(spark: SparkSession, d: str) -> DataFrame:
    return flatten.explode_members(table(spark, d, "items"), "item_row", "tags").select("item_row", "child_pos", F.col("tags").alias("tag"))


def p7_item_authors(spark: SparkSession, d: str) -> DataFrame:
    return flatten.explode_members(table(spark, d, "items"), "item_row", "authors").select("item_row", "child_pos", "name", "url", "avatar")


def p7_item_attachments(spark: SparkSession, d: str) -> DataFrame:
    return flatten.explode_members(table(spark, d, "items"), "item_row", "attachments").select("item_row", "child_pos", "url", "mime_type", "title", "size_in_bytes", "duration_in_seconds")


QUERIES = {
    "p1_found": p1_found,
    "p1_kept": p1_kept,
    "p2_found": p2_found,
    "p2_coverage": p2_coverage,
    "p7_found": p7_found,
    "p7_nodes": p7_nodes,
    **{f"p7_{n}": _p7_table(n) for n in ("items", "authors", "tags", "attachments")},
    "p7_item_tags": p7_item_tags,
    "p7_item_authors": p7_item_authors,
    "p7_item_attachments": p7_item_attachments,
}

_ITEM_TEXTS = "id url external_url title content_html content_text summary image banner_image date_published date_modified".split()
_IDENT = "coalesce(nullif(id, ''), nullif(url, ''))"


def _members(name: str, cols: str) -> str:
    return f"""
select item_row, cast(i - 1 as integer) as child_pos, {cols}
from (select item_row, {name} as a, unnest(range(1, len({name}) + 1)) as i from items where {name} is not null)
where a[i] is not null"""


# The objects in the bodies of feed_pages, in SQL: text of the body, a byte-order mark aside, then items, then their members' elements.
_BODIES = """with t as (select page_row, try(decode(case when hex(body) like 'EFBBBF%' then body[4:] else body end)) as s from feed_pages where body is not null),
j as (select page_row, cast(s as json) as j from t where coalesce(json_valid(s), false) and json_type(s) = 'OBJECT'),
i as (select page_row, cast(k as integer) as item_pos, json_extract(j, '$.items[' || k || ']') as it
  from (select page_row, j, unnest(range(cast(json_array_length(j, '$.items') as bigint))) as k from j where json_type(j, '$.items') = 'ARRAY')),
o as (select * from i where json_type(it) = 'OBJECT' and cast(it as varchar) <> '{}'),
m as (select page_row, item_pos, 'tag' as child, it -> '$.tags' as v from o union all select page_row, item_pos, 'attachment', it -> '$.attachments' from o
  union all select page_row, item_pos, 'authors', it -> '$.authors' from o union all select page_row, item_pos, 'author', it -> '$.author' from o),
e as (select page_row, item_pos, child, cast(k as integer) as child_pos, json_extract(v, '$[' || k || ']') as v
    from (select *, unnest(range(cast(json_array_length(v) as bigint))) as k from m where json_type(v) = 'ARRAY')
  union all select page_row, item_pos, child, 0, v from m where v is not null and json_type(v) <> 'ARRAY'),
f as (select * from e where cast(v as varchar) not in ('null', '""', '{}', '[]')),
c as (select page_row, item_pos, case child when 'authors' then 'author' else child end as child, child_pos, v from f x
  where child <> 'author' or not exists (select 1 from f y where y.child = 'authors' and y.page_row = x.page_row and y.item_pos = x.item_pos))
"""

# Problem 2 in SQL, with DuckDB's own zone data.
_CLOCK = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(?: ?([AaPp][Mm])\b)?"
#: One pattern for each kind of date, and the names of its groups.
_DATES = {
    "iso": ("([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})[Tt ,]+" + _CLOCK + "(.*)", "y m d h i s f half rest"),
    "compact": ("([0-9]{4})([0-9]{2})([0-9]{2})[Tt]?([0-9]{2})([0-9]{2})([0-9]{2})?(?:[.,]([0-9]+))?()(.*)", "y m d h i s f half rest"),
    "dots": (r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4}|[0-9]{2}),? " + _CLOCK + "(.*)", "d m y h i s f half rest"),
    "day_first": (r"(?:([A-Za-z]+)\.?,? )?([0-9]{1,2})[ -]([A-Za-z]+)\.?[ -]([0-9]{4}|[0-9]{2}),? " + _CLOCK + "(.*)", "w d m y h i s f half rest"),
    "month_first": (r"(?:([A-Za-z]+)\.?,? )?([A-Za-z]+)\.? ([0-9]{1,2}),? ([0-9]{4}),?(?: at)? " + _CLOCK + "(.*)", "w m d y h i s f half rest"),
    "ctime": ("([A-Za-z]+) ([A-Za-z]+) +([0-9]{1,2}) " + _CLOCK + "( [A-Za-z]+)? ([0-9]{4})", "w m d h i s f half rest y"),
}
_PARTS = "w y m d h i s f half rest".split()


def _dates_sql() -> str:
    """Parts of every value, for each pattern that fits it."""

    def of(kind: str, k: int) -> str:
        pattern, names = _DATES[kind]
        got = f"regexp_extract(x, '^{pattern}$', [{', '.join(repr(n) for n in names.split())}])"
        cols = ", ".join(f"g.{n} as {n}" if n in names.split() else f"'' as {n}" for n in _PARTS)
        return f"select item_row, field, x, z, {k} as k, {cols} from (select *, {got} as g from v where regexp_full_match(x, '{pattern}'))"

    return " union all ".join(of(kind, k) for k, kind in enumerate(_DATES))


_INSTANTS = f"""with v as (select item_row, field, trim(x) as x, time_zone as z from (select item_row, feed_idx, unnest(['date_published', 'date_modified']) as field, unnest([date_published, date_modified]) as x from items) left join feeds using (feed_idx) where x is not null),
a as ({_dates_sql()}),
b as (select * from a qualify row_number() over (partition by item_row, field order by k) = 1),
n as (select *, case when m <> '' and regexp_full_match(m, '[0-9]+') then try_cast(m as int) else list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(m[:3])) end as mo,
  case when len(y) = 2 then 2000 else 0 end + try_cast(y as int) as yr,
  case when half = '' then try_cast(h as int) when try_cast(h as int) between 1 and 12 then try_cast(h as int) % 12 + case when lower(half) = 'pm' then 12 else 0 end end as hr,
  try_cast(rpad(f[:6], 6, '0') as int) as us, trim(rest) as r from b),
t as (select *, try(make_timestamp(yr, mo, try_cast(d as int), hr, try_cast(i as int), case when s = '' then 0 else try_cast(s as int) end + us / 1000000.0)) as wall from n where hr < 24 and try_cast(i as int) < 60 and (s = '' or try_cast(s as int) < 60)),
w as (select *, case when r = '' then z when regexp_full_match(r, '\\[?[A-Za-z_+-]+(/[A-Za-z0-9_+-]+)+\\]?') then trim(r, '[]') end as zone,
  case when regexp_full_match(r, '[+-][0-9]{{2}}(:?[0-9]{{2}})?( ?\\([A-Za-z]+\\))?') then (case when r[1] = '-' then -1 else 1 end) * (try_cast(r[2:3] as int) * 60 + coalesce(try_cast(replace(r, ':', '')[4:5] as int), 0))
    else case lower(trim(r, '()[]')) when 'z' then 0 when 'gmt' then 0 when 'ut' then 0 when 'utc' then 0 when 'est' then -300 when 'edt' then -240 when 'cst' then -360 when 'cdt' then -300 when 'mst' then -420 when 'mdt' then -360 when 'pst' then -480 when 'pdt' then -420 end end as off
  from t where wall is not null and (w = '' or lower(w[:3]) = lower(dayname(wall)[:3]))),
q as (select *, try(timezone(zone, wall)) as t0 from w),
e as (select item_row, field, x, case when off is not null then epoch_us(wall) - cast(off as bigint) * 60000000
    when timezone(zone, t0) = wall and timezone(zone, t0 - interval 1 hour) <> wall and timezone(zone, t0 + interval 1 hour) <> wall and timezone(zone, t0 - interval 30 minute) <> wall and timezone(zone, t0 + interval 30 minute) <> wall then epoch_us(t0) end as epoch_us from q
  union all select item_row, field, x, try_cast(x as bigint) * case when len(x) <= 10 then 1000000 else 1000 end from v where regexp_full_match(x, '[0-9]{{9,10}}|[0-9]{{12,13}}')),
found as (select item_row, field, epoch_us, regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]+)?Z') as already from e where epoch_us is not null)"""


def _field(name: str, of: str = "v") -> str:
    return f"case when json_type({of}, '$.{name}') <> 'NULL' then {of} ->> '$.{name}' end as {name}"


SQL = {
    "p2_found": f"{_INSTANTS} select item_row, field, epoch_us from found where not already",
    "p2_coverage": f"""{_INSTANTS}, given as (select field, count(*) filter (where x <> '') as given from (select unnest(['date_published', 'date_modified']) as field, unnest([date_published, date_modified]) as x from items) group by field)
select field, any_value(given) as given, count(epoch_us) as instants, count(*) filter (where already) as already from given left join found using (field) group by field""",
    "p7_found": f"{_BODIES} select page_row, item_pos, child, child_pos from c",
    "p7_items": f"{_BODIES} select page_row, item_pos, {', '.join(_field(n, 'it') for n in _ITEM_TEXTS)} from o",
    "p7_authors": f"{_BODIES} select page_row, item_pos, child_pos, case when json_type(v) = 'VARCHAR' then v ->> '$' else v ->> '$.name' end as name, {_field('url')}, {_field('avatar')} from c where child = 'author'",
    "p7_tags": f"{_BODIES} select page_row, item_pos, child_pos, v ->> '$' as tag from c where child = 'tag'",
    "p7_attachments": f"""{_BODIES} select page_row, item_pos, child_pos, case when json_type(v) = 'VARCHAR' then v ->> '$' else v ->> '$.url' end as url, {_field('mime_type')}, {_field('title')},
  try_cast(v ->> '$.size_in_bytes' as bigint) as size_in_bytes, try_cast(v ->> '$.duration_in_seconds' as double) as duration_in_seconds from c where child = 'attachment'""",
    "p1_found": f"""
select item_row from (select item_row, {_IDENT} as k, min(item_row) over (partition by feed_idx, {_IDENT}) as first from items)
where k is not null and item_row <> first""",
    "p1_kept": f"""
select item_row, feed_idx, id, url from (select *, {_IDENT} as k, min(item_row) over (partition by feed_idx, {_IDENT}) as first from items)
where k is null or item_row = first""",
    "p7_item_tags": _members("tags", "a[i] as tag") + " and a[i] <> ''",
    "p7_item_authors": _members("authors", "a[i].name as name, a[i].url as url, a[i].avatar as avatar"),
    "p7_item_attachments": _members("attachments", "a[i].url as url, a[i].mime_type as mime_type, a[i].title as title, a[i].size_in_bytes as size_in_bytes, a[i].duration_in_seconds as duration_in_seconds"),
}
