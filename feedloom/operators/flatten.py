"""Nested JSON documents to flat tables by Merkle subtree identities.

One pass from the leaves up, whatever the depth: a value's identity is the hash of its kind and of its children's
identities, so equal subtrees have equal hashes wherever they occur and whatever order their keys have.  Each object
becomes a node whose text holds its own members and, in place of the objects inside it, their identities; a list within a list is a
node as well.  Identical nodes are stored once (``nodes``); every occurrence, at any depth and under any name, is a bridge
row with its number in the document, that of the occurrence it stands in, the parent's identity, and its ordinal (``bridges``).
From the nodes each document can be built again.

Kinds of children: ``feed`` (the document), ``item``, and an item's ``author``, ``tag`` and ``attachment``; every other object is
named by the member it is held in (``/media``).

Defined results: a body that isn't a JSON object gives no rows; nulls, empty strings and empty objects (and empty
lists) are no children but keep their place; a value given without a list has place 0; ``author`` counts only
where ``authors`` gives no child; members whose name starts with ``_`` give no authors, tags or attachments; numbers of any length or
size keep their digits; NaN and Infinity aren't JSON; of a name given twice the last value counts; unpaired surrogates become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRIDGE = "doc bigint, seq int, up int, item_pos int, child string, child_pos int, parent binary, node binary"
SCHEMA = f"{BRIDGE}, canon string"
#: An item's members and the kind of their values; ``author`` is read where ``authors`` gives none.
MEMBERS = {"authors": "author", "tags": "tag", "attachments": "attachment"}


# Reading --------------------------------------------------------------------------------------------------------
def _reject(x: str):
    raise ValueError(x)


def _whole(s: str):
    return int(s) if len(s) < 4000 else Decimal(s)


def _real(s: str):
    x = float(s)
    return x if abs(x) != float("inf") else Decimal(s)


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_NAMES = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _loads_deep(text: str):
    """JSON without recursion, for what is nested deeper than the standard library's reader goes.  ValueError as there."""

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def scalar(i: int):
        c = text[i : i + 1]
        if c == '"':
            return json.decoder.scanstring(text, i + 1, True)
        if c in _NAMES and c and text.startswith(_NAMES[c][0], i):
            return _NAMES[c][1], i + len(_NAMES[c][0])
        m = _NUMBER.match(text, i)
        if m is None:
            raise ValueError(f"no JSON at {i}")
        return (_real(m.group()) if m[2] or m[3] else _whole(m.group())), m.end()

    def name(i: int):
        if text[i : i + 1] != '"':
            raise ValueError(f"no name at {i}")
        k, i = json.decoder.scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"no value at {i}")
        return k, skip(i + 1)

    holders: list[tuple] = []  # open objects and lists, each with the name its next value gets
    i, done = skip(0), None
    while True:
        # A value begins at i.
        c = text[i : i + 1]
        if c in ("{", "["):
            new: dict | list = {} if c == "{" else []
            i = skip(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                key = None
                if c == "{":
                    key, i = name(i)
                holders.append((new, key))
                continue
            done, i = new, i + 1
        else:
            done, i = scalar(i)
        # It goes to its holder; what it completes goes on to the next one.
        while holders:
            holder, key = holders.pop()
            if isinstance(holder, dict):
                holder[key] = done
            else:
                holder.append(done)
            i = skip(i)
            c = text[i : i + 1]
            if c == ",":
                i, key = skip(i + 1), None
                if isinstance(holder, dict):
                    key, i = name(i)
                holders.append((holder, key))
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"unexpected text at {i}")
            done, i = holder, i + 1
        else:
            if skip(i) != len(text):
                raise ValueError("more than one value")
            return done


def loads(text: str):
    try:
        return json.loads(text, parse_constant=_reject, parse_int=_whole, parse_float=_real)
    except RecursionError:
        return _loads_deep(text)


def load_object(body: bytes | None) -> dict | None:
    """The JSON object in ``body``, a byte-order mark aside; None if it isn't one."""
    if not body:
        return None
    try:
        for bom, enc in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
            if body.startswith(bom):
                text = body[len(bom) :].decode(enc)
                break
        else:
            text = body.decode("utf-8")
        got = loads(text)
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


# Identities -----------------------------------------------------------------------------------------------------
def clean(s: str) -> str:
    return s.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in s) else s


def _text(x) -> str:
    return str(x) if isinstance(x, Decimal) else json.dumps(x, ensure_ascii=False)


def _digest(kind: bytes, *parts: bytes) -> bytes:
    return hashlib.blake2b(kind + b"".join(parts), digest_size=16).digest()


def _is_child(v) -> bool:
    return not (v is None or v == "" or (isinstance(v, (dict, list)) and not v))


class _Open:
    """A container whose children aren't all done.

    ``role``: ``feed``, ``items``, ``item``, ``list`` (of an item's authors, tags or attachments) or nothing; ``kinds``: what an item's members are
    called, or what a list's elements are; ``owner``: the node around a list that is none itself.
    """

    __slots__ = ("value", "keys", "name", "pos", "item", "role", "kinds", "owner", "seq", "ids", "texts", "rows")

    def __init__(self, value, name: str, pos: int):
        self.value, self.name, self.pos = value, name, pos
        self.keys = iter(sorted(value) if isinstance(value, dict) else range(len(value)))
        self.item, self.role, self.kinds, self.owner, self.seq = None, "", {}, self, 0
        self.ids: list[bytes] = []
        self.texts: list[str] = []
        self.rows: list[tuple] = []  # children that wait for this node's identity


def _kinds(item: dict) -> dict[str, str]:
    """Which members of an item give authors, tags and attachments."""
    v = item.get("authors")
    named = any(map(_is_child, v)) if isinstance(v, list) else _is_child(v)
    return MEMBERS if named else {"author": "author", **{m: k for m, k in MEMBERS.items() if m != "authors"}}


def _enter(x, top: _Open, key, n: int) -> _Open:
    """A container inside another one; ``n`` numbers the occurrences of a document."""
    listed = isinstance(top.value, list)
    new = _Open(x, top.name if listed else key, key if listed else 0)
    new.item, new.seq = top.item, n
    if top.role == "feed" and key == "items" and isinstance(x, list):
        new.role = "items"
    elif top.role == "items" and isinstance(x, dict):
        new.role, new.item, new.kinds = "item", key, _kinds(x)
    elif top.role == "item" and key in top.kinds and isinstance(x, list):
        new.role, new.kinds = "list", {"": top.kinds[key]}
    if isinstance(x, list) and not listed:
        new.owner = top.owner  # a list is part of the object it is a member of; a list in a list is a node
    return new


def _kind(top: _Open, key, x) -> str:
    """What a child is called."""
    if top.role == "list":
        return top.kinds[""]
    if top.role == "item" and key in top.kinds and not isinstance(x, list):
        return top.kinds[key]
    if top.role == "items" and isinstance(x, dict):
        return "item"
    return "/" + (top.name if isinstance(top.value, list) else key)


def subtrees(root) -> tuple[bytes, str, list[tuple]]:
    """Identity and text of a value, and (seq, up, item_pos, child, child_pos, parent, node, canon) of every occurrence in it but itself.

    Children are done before what holds them; nothing recurses, so depth is no limit, and no value is hashed twice.  The work and
    the rows grow with the document alone, however it is nested.
    """
    done: list[tuple] = []
    around = _Open([root], "", 0)
    stack, n = [around], 0
    while True:
        top = stack[-1]
        key = next(top.keys, None)
        if key is not None:
            x = top.value[key]
            if isinstance(x, (dict, list)):
                new = _enter(x, top, key, n)
                if top is around:
                    new.role, new.owner = "feed", new
                n += 1
                stack.append(new)
                continue
            text, listed = _text(x), False
            node = _digest(b"v", text.encode("utf-8", "surrogatepass"))
            if _is_child(x) and (kind := _kind(top, key, x))[0] != "/":
                top.owner.rows.append((n, top.owner.seq, top.item, kind, key if top.role == "list" else 0, node, clean(text)))
                n += 1
        else:
            own = stack.pop()
            if own is around:
                return own.ids[0], own.texts[0], done
            x, top, key = own.value, stack[-1], own.pos if isinstance(stack[-1].value, list) else own.name
            if isinstance(x, dict):
                names = [k.encode("utf-8", "surrogatepass") for k in sorted(x)]
                node = _digest(b"o", *(len(k).to_bytes(8, "big") + k + i for k, i in zip(names, own.ids)))
                text = "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{t}" for k, t in zip(sorted(x), own.texts)) + "}"
            else:
                node, text = _digest(b"a", *own.ids), "[" + ",".join(own.texts) + "]"
            listed = bool(x) and own.owner is own and top is not around
            if own.owner is own:
                done.extend((*r[:5], node, *r[5:]) for r in own.rows)
            if listed:
                kind = _kind(top, key, x)
                item = own.item if kind != "item" else key
                top.owner.rows.append((own.seq, top.owner.seq, item, kind, own.pos, node, clean(text)))
        top.ids.append(node)
        top.texts.append(f'{{"$node":"{node.hex()}"}}' if listed else text)


def identity(v) -> bytes:
    return subtrees(v)[0]


def rows_of(doc: int, feed: dict) -> Iterator[tuple]:
    root, text, rows = subtrees(feed)
    yield doc, 0, None, None, "feed", 0, None, root, clean(text)
    for r in rows:
        yield doc, *r


def _flatten(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.string()]
    for b in batches:
        rows: list[tuple] = []
        for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if (feed := load_object(body)) is not None:
                rows.extend(rows_of(doc, feed))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def occurrences(pages: DataFrame, doc: str = "page_row", body: str = "body") -> DataFrame:
    """Every object's occurrence with its canonical text: the input of both tables below."""
    return pages.select(F.col(doc).cast("bigint").alias("doc"), F.col(body).alias("body")).where("body is not null").mapInArrow(_flatten, SCHEMA)


def bridges(occ: DataFrame) -> DataFrame:
    """Parent-child links: document, occurrence and that around it, item place, kind and ordinal of the child, identities of parent and child."""
    return occ.select(*[f.split()[0] for f in BRIDGE.split(", ")])


def nodes(occ: DataFrame) -> DataFrame:
    """Identical objects once.  Equal identities have equal canonical texts, so any is the right one; counts combine before the shuffle."""
    return occ.groupBy("node").agg(F.min("canon").alias("canon"), F.count("*").alias("occurrences"))


def flat_tables(occ: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of items, authors, tags and attachments; children point at (page_row, item_pos)."""

    def of(kind: str, *cols) -> DataFrame:
        return occ.where(F.col("child") == kind).select(F.col("doc").alias("page_row"), "item_pos", "child_pos", F.hex("node").alias("node"), *cols)

    j = lambda k: F.get_json_object("canon", f"$.{k}").alias(k)
    plain = F.when(F.col("canon").startswith('"'), F.from_json(F.concat(F.lit("["), F.col("canon"), F.lit("]")), "array<string>")[0])
    texts = "id url external_url title content_html content_text summary image banner_image date_published date_modified".split()
    return {
        "items": of("item", *map(j, texts)),
        "authors": of("author", F.coalesce(plain, F.get_json_object("canon", "$.name")).alias("name"), j("url"), j("avatar")),
        "tags": of("tag", F.coalesce(plain, F.col("canon")).alias("tag")),
        "attachments": of("attachment", F.coalesce(plain, F.get_json_object("canon", "$.url")).alias("url"), j("mime_type"), j("title"), *(F.expr(f"try_cast(get_json_object(canon, '$.{c}') as {t})").alias(c) for c, t in (("size_in_bytes", "bigint"), ("duration_in_seconds", "double")))),
    }


def explode_members(items: DataFrame, row_id: str, member: str) -> DataFrame:
    """The same for arrays already decoded: one row per non-null element with its place and identity; JVM only."""
    x = items.select(row_id, F.posexplode(F.col(member)).alias("child_pos", "value")).where("value is not null")
    kind = items.schema[member].dataType.elementType.simpleString()
    if kind.startswith("struct"):
        x = x.select(row_id, "child_pos", F.sha2(F.to_json("value"), 256).alias("node"), "value.*")
        return x
    return x.where("value <> ''").select(row_id, "child_pos", F.sha2("value", 256).alias("node"), F.col("value").alias(member))
