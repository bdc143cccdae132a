"""Markup residue in text documents.

``method_texts`` takes away site templates and returns clean text of all fields: element subtrees are hashed from the leaves up,
counted per host in Spark, and subtrees that recur across many pages of a host are deleted before conversion.
Conversion keeps headings (``# ``), list items (``- ``), code (fenced or in backticks) and formulas (``$...$``).

Which markup languages a value contains can't follow from recurring subtrees, so ``languages`` reads the signs of
each language: paired emphasis, links, headings, lists, tables, commands, formulas.  Content of code elements counts
for nothing; sums of money, identifiers, paths, hash tags and comparisons are no markup.

Defined results: null and empty values contain nothing and convert to null and to an empty text; unclosed elements end with
the document; element names are taken without case; deliveries of one entry, and equal contents, are one page; rows without
a host form one host.  Only blocks that stand for themselves are template: void elements, words inside a block, headings, list
items and table cells are part of what they stand in, and go with it only.  Two elements are equal if their names, contents and what
they show are: the address and the stand-in text of a picture or other medium count, and the target of a link without a text.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CODE = frozenset("pre code samp kbd tt".split())
BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
ELEMENTS = BLOCK | VOID | RAW | CODE | frozenset(
    "a abbr acronym audio b bdi bdo big button caption center cite colgroup data datalist del details dfn dialog em font head i ins label legend map mark math meter noscript object "
    "optgroup option output picture progress q rp rt ruby s select small span strike strong sub summary sup svg table tbody template tfoot thead time u var video".split()
)
#: Pages of a host on which a subtree must recur to be template.
LEAST_PAGES = 10
#: Share of the host's pages on which it must recur besides.
LEAST_SHARE = 0.01
#: Blocks that are parts of a larger one, and blocks whose children may stand for themselves.
PARTS = frozenset("dd dt h1 h2 h3 h4 h5 h6 hr html body li td th tr".split())
HOLDERS = frozenset(["", *"address article aside body div fieldset figure footer form header html main nav section".split()])

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_SPACES = re.compile(r"[ \t\r\n\f]+")

# Signs of the languages ---------------------------------------------------------------------------------------
_HTML = re.compile(r"</?(?:" + "|".join(sorted(ELEMENTS | {"h[1-6]"}, key=len, reverse=True)) + r")(?=[\s/>])[^<>]*(?:>|$)|<!--|<!doctype|&(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});", re.I)
_CODE_ELEMENT = re.compile(r"<(pre|code|samp|kbd|tt)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_FENCE = re.compile(r"^(```+|~~~+)[^\n`]*\n.*?(?:^\1[ \t]*\r?$|\Z)", re.S | re.M)
_TICKS = re.compile(r"(?<![\\`])(`+)(?!`)[^\n]*?[^`\n]\1(?!`)|(?<![\\`])(`)[^`\n]+`(?!`)")

_WIKI = re.compile(
    r"\[\[[^\[\]\n]*[^\W\d_][^\[\]\n]*\]\]"  # internal link with a letter
    r"|(?<!')'''?(?=[^\s'])[^\n]*?[^\s']'''?(?!')"  # emphasis
    r"|\{\{[^{}\n][^{}]*\}\}"  # template
    r"|\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+[^\]\n]+)?\](?!\()"  # external link
    r"|^(={2,6})[ \t]*[^=\s][^\n]*?[ \t]*\1[ \t]*\r?$"  # heading
    r"|^\{\|[^\n]*$|^\|\}[ \t]*\r?$"  # table
    r"|<ref\b[^>]*>|<nowiki\b|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|^#REDIRECT\b",
    re.M,
)
_LATEX = re.compile(
    r"\\(?:begin|end)\{[A-Za-z]+\*?\}"
    r"|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"
    r"|\$\$[^$]*[\\^_{][^$]*\$\$"
    r"|(?<![\\$\w])\$(?![\s$\d])[^$\n]*[\\^_=+{][^$\n]*(?<![\s\\])\$(?![\w$])"
    r"|(?<![\\$\w])\$\d+[^$\n]*[\\^_{][^$\n]*(?<![\s\\])\$(?![\w$])"
    r"|\\\[[^\n]*?\\\]|\\\([^\n]*?\\\)"
)
_MARKDOWN = re.compile(
    r"!?\[[^\[\]\n]+\](?:\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)|\[[^\[\]\n]*\])"  # link or image, inline or by reference
    r"|(?<![\w*\\])\*\*\*?(?=[^\s*])[^\n]*?[^\s*]\*\*\*?(?![\w*])"
    r"|(?<![\w_\\])__(?=[^\s_])[^\n]*?[^\s_]__(?![\w_])"
    r"|(?<![\w~\\])~~(?=[^\s~])[^\n]*?[^\s~]~~(?![\w~])"
    r"|(?<![\w*\\])\*(?=[^\W_])[^*\n]*[^\W_]\*(?![\w*])"
    r"|^ {0,3}#{1,6}[ \t]+\S[^\n]*$"  # heading
    r"|^ {0,3}[*+-][ \t]+(?!\[\[)\S[^\n]*$"  # list
    r"|^ {0,3}>[ \t]+\S"  # quotation
    r"|^ {0,3}\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?[ \t]*)?\r?$"  # table
    r"|^ {0,3}\[[^\[\]\n]+\]:[ \t]+\S+",  # link definition
    re.M,
)


def languages(value: str | None, is_html: bool) -> list[str]:
    """Languages that occur in a value; for HTML fields ``html`` itself isn't listed."""
    if not value:
        return []
    out = []
    if not is_html and ("<" in value or "&" in value) and _HTML.search(value):
        out.append("html")
    text = value
    if "<" in text:
        text = _CODE_ELEMENT.sub(" ", text)
        if "<ref" in text or "<nowiki" in text:
            out.append("wiki")
        text = _TAG.sub("", text)
    if "&" in text:
        text = _html.unescape(text)
    bare = text
    if "`" in text or "~~~" in text:
        bare = _FENCE.sub("\n", text)
        bare = _TICKS.sub(" ", bare)
        if bare != text:
            out.append("markdown")
    if "markdown" not in out and _MARKDOWN.search(bare):
        out.append("markdown")
    if "wiki" not in out and _WIKI.search(bare):
        out.append("wiki")
    if ("\\" in bare or "$" in bare) and _LATEX.search(bare):
        out.append("latex")
    return sorted(out)


# Conversion ---------------------------------------------------------------------------------------------------
def _plain(text: str) -> str:
    """Markdown, wiki markup and LaTeX of one run of text to plain text with structure kept."""
    if not any(c in text for c in "*_~`[{='\\$#|>"):
        return text
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m.group())
        return f"\x00{len(held) - 1}\x00"

    t = _FENCE.sub(hold, text)
    t = _TICKS.sub(hold, t)
    t = re.sub(r"\$\$[^$]*\$\$|\\\[[^\n]*?\\\]|\\\([^\n]*?\\\)|\\begin\{(equation|align|math|displaymath)\*?\}.*?\\end\{\1\*?\}", lambda m: hold(_formula(m)), t, flags=re.S)
    t = re.sub(r"(?<![\\$\w])\$(?![\s$])[^$\n]*[\\^_{][^$\n]*\$(?![\w$])", hold, t)
    t = re.sub(r"\{\{[^{}]*\}\}", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", t)
    t = re.sub(r"!\[([^\[\]\n]*)\](?:\([^()\n]*\)|\[[^\[\]\n]*\])", r"\1", t)
    t = re.sub(r"\[([^\[\]\n]+)\](?:\([^()\n]*\)|\[[^\[\]\n]*\])", r"\1", t)
    t = re.sub(r"\[(?:https?|ftp)://[^\s\]]+[ \t]+([^\]\n]+)\]", r"\1", t)
    t = re.sub(r"^(={2,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", lambda m: "#" * (len(m[1]) - 1) + " " + m[2], t, flags=re.M)
    t = re.sub(r"(?<!')'''?(.+?)'''?(?!')", r"\1", t)
    t = re.sub(r"(?<![\w*])(\*{1,3})(?=[^\s*])([^\n]*?[^\s*])\1(?![\w*])", r"\2", t)
    t = re.sub(r"(?<![\w_])(_{1,3})(?=[^\s_])([^\n]*?[^\s_])\1(?![\w_])", r"\2", t)
    t = re.sub(r"~~(?=\S)([^\n]*?\S)~~", r"\1", t)
    t = re.sub(r"^( {0,3})[*+][ \t]+", r"\1- ", t, flags=re.M)
    t = re.sub(r"\\(?:cite|footnote|label|ref)\*?\{[^{}]*\}", "", t)
    t = re.sub(r"\\(?:textbf|textit|emph|underline|texttt|text)\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\(?:sub)*section\*?\{([^{}]*)\}", r"# \1", t)
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], t)


class _Formula:
    def __init__(self, s: str):
        self.s = s

    def group(self) -> str:
        return self.s


def _formula(m: re.Match) -> _Formula:
    s = m.group()
    s = re.sub(r"^\\begin\{[^}]*\}|\\end\{[^}]*\}$|^\$\$|\$\$$|^\\[\[(]|\\[\])]$", "", s).strip()
    return _Formula(f"${s}$")


class Node:
    __slots__ = ("tag", "kids", "key", "shows", "text")

    def __init__(self, tag: str, shows: str = ""):
        self.tag, self.kids, self.key, self.shows, self.text = tag, [], 0, shows, False


#: Attributes that are content themselves.
_SHOWN = re.compile(r"(?:^|\s)(src|srcset|alt|poster|data|href|value)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _shows(attrs: str) -> str:
    return "\x02".join(sorted(f"{m[1].lower()}={m[2] or m[3] or m[4] or ''}" for m in _SHOWN.finditer(attrs))) if "=" in attrs else ""


def tree(html: str) -> Node:
    """Element tree; closing tags close the nearest open element of their name, stray ones are dropped."""
    root = Node("")
    stack, opened = [root], {}
    pos, raw = 0, None
    while pos < len(html):
        if raw:
            m = re.compile(rf"</{raw}\s*>", re.I).search(html, pos)
            stack[-1].kids.append(html[pos : m.start() if m else len(html)])
            pos = m.end() if m else len(html)
            opened[raw] -= 1
            stack.pop()
            raw = None
            continue
        m = TOKEN.match(html, pos)
        pos = m.end()
        name = m.group(2)
        if name is None:
            s = m.group()
            if not s.startswith(("<!", "<?")):
                stack[-1].kids.append(s)
            continue
        name = name.lower()
        if m.group(1):
            if opened.get(name):
                while True:
                    n = stack.pop()
                    opened[n.tag] -= 1
                    if n.tag == name:
                        break
            continue
        n = Node(name, _shows(m.group(3)))
        stack[-1].kids.append(n)
        if name in VOID or m.group(3).rstrip().endswith("/"):
            continue
        stack.append(n)
        opened[name] = opened.get(name, 0) + 1
        if name in RAW:
            raw = name
    return root


def _post(root: Node) -> list[Node]:
    """Children before parents, without recursion."""
    out, work = [], [root]
    while work:
        n = work.pop()
        out.append(n)
        work.extend(k for k in n.kids if isinstance(k, Node))
    out.reverse()
    return out


def hash_subtrees(root: Node) -> list[int]:
    """Bottom-up identities of all elements; text counts with its spaces normalised, attributes where they are content."""
    import xxhash

    keys = []
    for n in _post(root):
        h = xxhash.xxh64(n.tag)
        for k in n.kids:
            if isinstance(k, Node):
                h.update(k.key.to_bytes(8, "big"))
            else:
                t = _SPACES.sub(" ", k).strip()
                if t:
                    h.update("\x01" + t)
                    n.text = True
            n.text |= isinstance(k, Node) and k.text
        if n.shows and not (n.tag == "a" and n.text):
            h.update("\x02" + n.shows)
        n.key = h.intdigest()
        if n is not root:
            keys.append(n.key)
    return keys


def standing(root: Node) -> list[tuple[Node, Node]]:
    """Parent and child for all elements that may be template: blocks, and other elements that fill a line of their own."""

    def edge(k, end: int) -> bool:
        """Whether what stands beside an element ends its line."""
        if isinstance(k, Node):
            return k.tag in BLOCK or k.tag in ("br", "hr")
        return k.strip() == "" and "\n" in k or k.strip(" \t")[end:][:1] in ("\n", "\r")

    out = []
    for p in _post(root):
        for i, n in enumerate(p.kids):
            if not isinstance(n, Node) or n.tag in VOID or n.tag in PARTS:
                continue
            alone = p.tag in HOLDERS and (i == 0 or edge(p.kids[i - 1], -1)) and (i == len(p.kids) - 1 or edge(p.kids[i + 1], 0))
            if n.tag in BLOCK or alone:
                out.append((p, n))
    return out


def prune(root: Node, gone: set[int]) -> int:
    """Take away the standing elements of ``gone``; how many elements went."""
    dead = {id(n) for _, n in standing(root) if n.key in gone}
    cut, work = 0, [(root, False)]
    while work:
        n, inside = work.pop()
        cut += inside
        work.extend((k, inside or id(k) in dead) for k in n.kids if isinstance(k, Node))
        n.kids = [k for k in n.kids if id(k) not in dead]
    return cut


_NO_TAG = re.compile(r"<(?!/?(?:" + "|".join(sorted(ELEMENTS, key=len, reverse=True)) + r")(?=[\s/>])[^<>]*>|!--|!doctype)", re.I)
_NO_REFERENCE = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});)")


def plain_tree(value: str) -> Node:
    """Element tree of a field meant as plain text: ``<`` and ``&`` that begin no tag, comment or reference are text."""
    return tree(_NO_TAG.sub("&lt;", _NO_REFERENCE.sub("&amp;", value)))


def to_text(root: Node, lined: bool = False) -> str:
    """Clean text: blocks on lines of their own, headings, list items, code and formulas kept.  ``lined``: line ends of the source end lines."""
    lines: list[str] = []
    cur: list[str] = []

    def flush(prefix: str = "") -> None:
        t = _SPACES.sub(" ", "".join(cur)).strip()
        cur.clear()
        if t:
            lines.append(prefix + t)

    def text_of(n: Node) -> str:
        return "".join(_html.unescape(k) for m in reversed(_post(n)) for k in m.kids if isinstance(k, str))

    work: list[tuple] = [("open", root)]
    prefix = [""]
    while work:
        what, n = work.pop()
        if what == "text":
            t = _plain(_html.unescape(n))
            if lined and "```" not in t:
                for i, p in enumerate(t.split("\n")):
                    if i:
                        flush(prefix[-1])
                    cur.append(p)
            elif "\n" in t and any(x in t for x in ("\n#", "\n- ", "\n*", "```")) or "```" in t:
                flush(prefix[-1])
                lines.extend(x for x in t.split("\n") if x.strip())
            else:
                parts = t.split("\n")
                for i, p in enumerate(parts):
                    if i:
                        cur.append(" ")
                    cur.append(p)
        elif what == "close":
            flush(prefix.pop())
        elif n.tag == "pre":
            flush(prefix[-1])
            lines.extend(["```", *text_of(n).strip("\n").split("\n"), "```"])
        elif n.tag in CODE:
            cur.append(f"`{text_of(n)}`")
        elif n.tag in ("script", "style", "template", "noscript"):
            pass
        elif n.tag in ("br", "hr"):
            flush(prefix[-1])
        else:
            block = n.tag in BLOCK
            if block:
                flush(prefix[-1])
                own = "#" * int(n.tag[1]) + " " if len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1] in "123456" else "- " if n.tag == "li" else "> " if n.tag == "blockquote" else ""
                prefix.append(own)
                work.append(("close", n))
            work.extend(("open", k) if isinstance(k, Node) else ("text", k) for k in reversed(n.kids))
    flush(prefix[-1])
    return "\n".join(lines)


# Spark ----------------------------------------------------------------------------------------------------------
def _languages(batches: Iterator, keep: str, fields: tuple[tuple[str, bool], ...]) -> Iterator:
    import pyarrow as pa

    for b in batches:
        ids = b.column(keep).to_pylist()
        row, field, found = [], [], []
        for f, is_html in fields:
            for i, v in zip(ids, b.column(f).to_pylist()):
                for lang in languages(v, is_html):
                    row.append(i)
                    field.append(f)
                    found.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(row, b.column(keep).type), pa.array(field, pa.string()), pa.array(found, pa.string())], names=[keep, "field", "markup"])


def found_languages(rows: DataFrame, row_id: str, fields: tuple[tuple[str, bool], ...]) -> DataFrame:
    """``row_id, field, markup``: a row for each markup language of each value.  ``fields``: names, and whether they are HTML."""
    kind = rows.schema[row_id].dataType.simpleString()
    return rows.select(row_id, *[f for f, _ in fields]).mapInArrow(partial(_languages, keep=row_id, fields=fields), f"`{row_id}` {kind}, field string, markup string")


def _read(value: str, is_html: bool) -> Node:
    root = tree(value) if is_html else plain_tree(value)
    hash_subtrees(root)
    return root


def _subtrees(batches: Iterator, fields: tuple[tuple[str, bool], ...]) -> Iterator:
    import numpy as np
    import pyarrow as pa

    signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
    for b in batches:
        host, key, page, entry = [], [], [], []
        hosts, entries = b.column("host").to_pylist(), b.column("entry").to_pylist()
        for f, is_html in fields:
            for h, v, e in zip(hosts, b.column(f).to_pylist(), entries):
                if not v or (f != fields[0][0] and "<" not in v):
                    continue  # what has no elements is no template
                root = _read(v, is_html)
                own = {root.key, *(n.key for _, n in standing(root))}  # with the page itself, by which pages are counted
                host.extend([h] * len(own))
                key.extend(own)
                page.extend([root.key] * len(own))
                entry.extend([e] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), signed(key), signed(page), pa.array(entry, pa.int64())], names=["host", "key", "page", "entry"])


def templates(pages: DataFrame, host, fields: tuple[tuple[str, bool], ...], entry, least: int = LEAST_PAGES, share: float = LEAST_SHARE) -> DataFrame:
    """``host, key, pages``: subtrees that recur on at least ``least`` pages of a host and the ``share`` of them; ``entry`` tells
    entries apart.  Pages are counted by entry and by content, and the lesser count holds."""
    from feedloom.session import materialize

    slim = pages.select(F.coalesce(host, F.lit("")).alias("host"), *[f for f, _ in fields], F.xxhash64(entry).alias("entry")).where(" or ".join(f"`{f}` <> ''" for f, _ in fields))
    found = materialize(slim.mapInArrow(partial(_subtrees, fields=fields), "host string, key bigint, page bigint, entry bigint"), "subtrees")
    count = F.least(F.count_distinct("page"), F.count_distinct("entry")).alias
    often = found.groupBy("host", "key").agg(count("pages")).where(F.col("pages") >= least)
    whole = found.where("key = page").groupBy("host").agg(count("all"))
    return often.join(whole, "host").where(F.col("pages") >= share * F.col("all")).drop("all")


#: Rows of template subtrees up to which a host's set travels with its pages by broadcast.
TEMPLATES_BROADCAST = 200_000


def _clean(batches: Iterator, keep: str, fields: tuple[tuple[str, bool], ...]) -> Iterator:
    import pyarrow as pa

    for b in batches:
        gone = [{g % 2**64 for g in x} if x else () for x in b.column("gone").to_pylist()]
        for f, is_html in fields:
            out, cut = [], []
            for v, dead in zip(b.column(f).to_pylist(), gone):
                if not v:
                    out.append(v)
                    cut.append(0)
                    continue
                root = _read(v, is_html)
                cut.append(prune(root, dead) if dead else 0)
                out.append(to_text(root, lined=not is_html))
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array([f] * len(out), pa.string()), pa.array(out, pa.string()), pa.array(cut, pa.int32())], names=[keep, "field", "text", "subtrees_removed"])


def method_texts(pages: DataFrame, row_id: str, host, fields: tuple[tuple[str, bool], ...], least: int = LEAST_PAGES, entry=None) -> DataFrame:
    """``row_id, field, text, subtrees_removed``: every value without its host's template, as clean text.  ``fields``: names, and whether they are
    HTML or meant as plain text; the first one is what a page is.  ``entry``: what rows of one entry have in common; without it each row is an entry.

    A host's set of templates holds at most 1 / ``LEAST_SHARE`` times what stands on a page on average, however many pages it has.
    """
    from feedloom.session import materialize

    hits = materialize(templates(pages, host, fields, F.col(row_id) if entry is None else entry, least).select("host", "key"), "templates")
    sets = hits.groupBy("host").agg(F.collect_set("key").alias("gone"))
    # Hosts are joined by shuffle once the sets of all of them grow past the bound.
    if hits.count() <= TEMPLATES_BROADCAST:
        sets = F.broadcast(sets)
    rows = pages.select(row_id, F.coalesce(host, F.lit("")).alias("host"), *[f for f, _ in fields])
    kind = pages.schema[row_id].dataType.simpleString()
    return rows.join(sets, "host", "left").drop("host").mapInArrow(partial(_clean, keep=row_id, fields=fields), f"`{row_id}` {kind}, field string, text string, subtrees_removed int")
