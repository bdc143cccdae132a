"""RSS 2.0, RDF/RSS 1.0 and Atom 1.0 documents: one namespace-aware pass with a stack of bases."""

from __future__ import annotations

import re
from html import escape
from xml.parsers import expat

from feedloom.functions.dates import feed_date
from feedloom.functions.urls import resolve, without_fragment
from feedloom.sources.jsonfeed import NotFeed

# Namespaces, and attributes that hold addresses.
ATOM = "http://www.w3.org/2005/Atom"
XML = "http://www.w3.org/XML/1998/namespace"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RSS1 = ("http://purl.org/rss/1.0/", "http://my.netscape.com/rdf/simple/0.9/", "http://channel.netscape.com/rdf/simple/0.9/")
DC = "http://purl.org/dc/elements/1.1/"
CONTENT = "http://purl.org/rss/1.0/modules/content/"
ITUNES = "http://www.itunes.com/dtds/podcast-1.0.dtd"
XHTML = "http://www.w3.org/1999/xhtml"
URI_ATTRIBUTES = frozenset("href src uri scheme action background cite codebase data longdesc poster profile usemap".split())
HTML_TYPES = frozenset(("html", "xhtml", "text/html", "application/xhtml+xml"))


class El:
    __slots__ = ("ns", "name", "attrs", "kids", "base")

    def __init__(self, ns: str, name: str, attrs: dict, base: str):
        self.ns, self.name, self.attrs, self.base, self.kids = ns, name, attrs, base, []

    def text(self) -> str:
        out, work = [], list(reversed(self.kids))
        while work:
            k = work.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                work.extend(reversed(k.kids))
        return "".join(out)

    def all(self, name: str, *spaces: str) -> list[El]:
        return [k for k in self.kids if isinstance(k, El) and k.name == name and k.ns in spaces]

    def first(self, name: str, *spaces: str) -> El | None:
        return next(iter(self.all(name, *spaces)), None)

    def value(self, name: str, *spaces: str) -> str:
        e = self.first(name, *spaces)
        return e.text().strip() if e is not None else ""


def to_utf8(body: bytes) -> bytes:
    """The document in UTF-8 without its declaration; the declared encoding or a byte-order mark decides."""
    for bom, enc in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(bom):
            body = body[len(bom) :]
            text = body.decode(enc, "strict")
            break
    else:
        m = re.match(rb"\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._:-]+)[\"']", body)
        enc = m[1].decode() if m else "utf-8"
        # Web practice: these labels mean the Windows code page.
        enc = {"iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252"}.get(enc.lower(), enc)
        try:
            text = body.decode(enc)
        except LookupError as e:
            raise NotFeed(f"unsupported encoding {enc}") from e
        except UnicodeDecodeError as e:
            if enc != "cp1252":
                raise NotFeed(f"invalid {enc}") from e
            text = body.decode("latin-1")
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", text, count=1)
    return text.encode("utf-8")


def read_tree(body: bytes, source_url: str) -> El:
    """Elements with resolved bases.  Raises NotFeed for anything that isn't well-formed."""
    try:
        data = to_utf8(body)
    except UnicodeDecodeError as e:
        raise NotFeed("invalid encoding") from e
    p = expat.ParserCreate(encoding="utf-8", namespace_separator=" ")
    p.buffer_text = True
    root = El("", "", {}, without_fragment(source_url))
    stack = [root]

    def split(name: str) -> tuple[str, str]:
        ns, _, local = name.rpartition(" ")
        return ns, local

    def start(name: str, attrs: dict) -> None:
        ns, local = split(name)
        base = stack[-1].base
        own = {}
        for k, v in attrs.items():
            a_ns, a = split(k)
            if a_ns == XML and a == "base":
                base = resolve(base, v)
            else:
                own[a if not a_ns else f"{a_ns} {a}"] = v
        el = El(ns, local, own, base)
        stack[-1].kids.append(el)
        stack.append(el)
        if len(stack) > 5000:
            raise NotFeed("nested too deeply")

    p.StartElementHandler = start
    p.EndElementHandler = lambda _: stack.pop()
    p.CharacterDataHandler = lambda s: stack[-1].kids.append(s)
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise NotFeed(str(e)) from e
    return next(k for k in root.kids if isinstance(k, El))


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|(<([A-Za-z][^\s/>]*))((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(>)", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(\s*=\s*)("[^"]*"|'[^']*'|[^\s"'>]+)""")
#: Elements whose content is text, whatever it looks like.
_TEXT_ONLY = frozenset("script style textarea title xmp iframe noembed noframes".split())


def rewrite_html(text: str, base: str) -> str:
    """HTML with the references of its tags resolved and written with entities, everything else as it was: comments, and what only looks like tags inside scripts and the like."""
    from html import unescape

    def attr(m: re.Match) -> str:
        name, raw = m[1], m[3]
        v = unescape(raw[1:-1] if raw[0] in "\"'" else raw)
        if name.lower() in URI_ATTRIBUTES:
            v = resolve(base, v)
        return f'{name.lower()}="{escape(v, quote=False).replace(chr(34), "&#34;")}"'

    out, at = [], 0
    while m := _TAG.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        out.append(m[1] + _ATTR.sub(attr, m[3]) + m[4] if m[1] else m[0])
        if m[1] and m[2].lower() in _TEXT_ONLY:
            end = re.compile(rf"</{m[2]}(?=[\s/>])", re.I).search(text, at)
            stop = end.start() if end else len(text)
            out.append(text[at:stop])
            at = stop
    return "".join(out) + text[at:]


def _inner_xml(el: El) -> str:
    """The markup inside an XHTML construct, references resolved; its single div is left out."""
    kids = el.kids
    solid = [k for k in kids if isinstance(k, El) or k.strip()]
    if len(solid) == 1 and isinstance(solid[0], El) and solid[0].name == "div":
        kids = solid[0].kids
    out: list[str] = []
    work: list = list(reversed(kids))
    while work:
        k = work.pop()
        if isinstance(k, tuple):
            out.append(k[0])
        elif isinstance(k, str):
            out.append(escape(k, quote=False))
        else:
            attrs = "".join(f' {a}="{escape(resolve(k.base, v) if a in URI_ATTRIBUTES else v)}"' for a, v in k.attrs.items() if " " not in a)
            if k.kids:
                out.append(f"<{k.name}{attrs}>")
                work.append((f"</{k.name}>",))
                work.extend(reversed(k.kids))
            else:
                out.append(f"<{k.name}{attrs}/>" if k.name in ("br", "img", "hr", "link", "meta", "input") else f"<{k.name}{attrs}></{k.name}>")
    return "".join(out).strip()


def _media(kind: str) -> str:
    return kind.partition(";")[0].strip().lower()


def _construct(el: El | None) -> str:
    """Text of an Atom construct."""
    if el is None:
        return ""
    kind = _media(el.attrs.get("type", "text"))
    if kind in ("xhtml", "application/xhtml+xml"):
        return _inner_xml(el)
    t = el.text().strip()
    return rewrite_html(t, el.base) if kind in ("html", "text/html") else t


def _person(el: El, source: str) -> dict:
    uri = el.first("uri", ATOM)
    return {"name": el.value("name", ATOM) or None, "url": resolve(source, resolve(uri.base, uri.text().strip())) or None if uri is not None else None, "avatar": None}


def _atom_link(el: El, rel: str) -> str:
    for k in el.all("link", ATOM):
        if (k.attrs.get("rel") or "alternate") == rel and k.attrs.get("href"):
            return resolve(k.base, k.attrs["href"])
    return ""


def _int(s: str) -> int | None:
    """Base-10 size above 0 that fits 64 bits."""
    return int(s) if re.fullmatch(r"[+-]?[0-9]+", s or "") and 0 < int(s) < 2**63 else None


def _enclosure(url: str, kind: str, length: str, source: str) -> dict | None:
    if not url or not kind:
        return None
    return {"url": resolve(source, url), "mime_type": kind, "title": None, "size_in_bytes": _int(length), "duration_in_seconds": None}


def _blank() -> dict:
    return dict.fromkeys(("url", "external_url", "title", "content_html", "content_text", "summary", "image", "banner_image", "date_published", "date_modified", "authors", "tags", "attachments"))


def _atom(feed: El, source: str) -> tuple[list[dict], str]:
    gen = feed.first("generator", ATOM)
    generator = (gen.attrs.get("uri") or gen.text().strip()) if gen is not None else ""
    info = {"title": _construct(feed.first("title", ATOM)) or None, "home_page_url": resolve(source, _atom_link(feed, "alternate")) or None, "feed_url": source}
    shared = [_person(a, source) for a in feed.all("author", ATOM)]
    items = []
    for e in feed.all("entry", ATOM):
        guid, link = e.value("id", ATOM), _atom_link(e, "alternate")
        if not guid and not link:
            continue
        summary = _construct(e.first("summary", ATOM))
        it = _blank()
        content = e.first("content", ATOM)
        html = text = ""
        if content is None:
            text = summary
        elif _media(content.attrs.get("type", "text")) in HTML_TYPES:
            html = _construct(content)
        else:
            text = content.text().strip()
        if not html and not text:
            text = summary
        encl = [_enclosure(resolve(k.base, k.attrs.get("href", "")), k.attrs.get("type", ""), k.attrs.get("length", ""), source) for k in e.all("link", ATOM) if k.attrs.get("rel") == "enclosure"]
        it |= {
            "_feed": info, "id": guid or resolve(source, link), "url": resolve(source, link) or None, "title": _construct(e.first("title", ATOM)) or None, "content_html": html or None,
            "content_text": text or None, "summary": summary or None, "date_published": feed_date(e.value("published", ATOM)) or None, "date_modified": feed_date(e.value("updated", ATOM)) or None,
            "authors": [_person(a, source) for a in e.all("author", ATOM)] or shared or None, "tags": [t for t in (c.attrs.get("label") or c.attrs.get("term", "") for c in e.all("category", ATOM)) if t] or None,
            "attachments": [a for a in encl if a] or None,
        }
        items.append(it)
    return items, generator


_MAIL = re.compile(r"\s*(\S+@\S+)\s*\((.+)\)\s*")


def _rss_people(el: El, ns: str) -> list[dict]:
    out = []
    for k in [*el.all("author", ns), *el.all("creator", DC), *([] if el.all("author", ns) or el.all("creator", DC) else el.all("author", ITUNES))]:
        t = k.text().strip()
        if t:
            m = _MAIL.fullmatch(t)
            out.append({"name": m[2].strip() if m else t, "url": None, "avatar": None})
    return out


def _rss(root: El, source: str) -> tuple[list[dict], str]:
    if root.name == "RDF":
        ns = next((k.ns for k in root.kids if isinstance(k, El) and k.name in ("channel", "item")), RSS1[0])
        channel, entries = root.first("channel", ns), root.all("item", ns)
    else:
        ns = root.ns
        channel = root.first("channel", ns)
        if channel is None:
            raise NotFeed("RSS without a channel")
        entries = channel.all("item", ns)
    ch = channel if channel is not None else El("", "channel", {}, source)
    info = {"title": ch.value("title", ns) or None, "home_page_url": resolve(source, ch.value("link", ns)) or None, "feed_url": source}
    shared = _rss_people(ch, ns) or [{"name": k.text().strip(), "url": None, "avatar": None} for k in ch.all("managingEditor", ns) if k.text().strip()]
    items = []
    for e in entries:
        guid = e.value("guid", ns)
        link = e.value("link", ns) or _atom_link(e, "alternate")
        if not guid and not link:
            continue
        desc = e.value("description", ns) or e.value("summary", ITUNES)
        dc = feed_date(e.value("date", DC))
        published = feed_date(e.value("pubDate", ns)) or dc
        image = e.first("image", ns)
        picture = e.first("image", ITUNES)
        src = (image.value("url", ns) or image.text().strip()) if image is not None else picture.attrs.get("href", "") if picture is not None else ""
        encl = [_enclosure(k.attrs.get("url", ""), k.attrs.get("type", ""), k.attrs.get("length", ""), source) for k in e.all("enclosure", ns)]
        it = _blank()
        it |= {
            "_feed": info, "id": guid or resolve(source, link), "url": resolve(source, link) or None, "title": e.value("title", ns) or None,
            "content_html": e.value("encoded", CONTENT) or e.value("content", ns) or desc or None, "summary": desc or None, "image": resolve(source, src) or None,
            "date_published": published or None, "date_modified": (feed_date(e.value("updated", ATOM)) or dc) or None, "authors": _rss_people(e, ns) or shared or None,
            "tags": [t for t in (k.text().strip() for k in [*e.all("category", ns), *e.all("subject", DC)]) if t] or None, "attachments": [a for a in encl if a] or None,
        }
        items.append(it)
    return items, ch.value("generator", ns)


def _next_link(root: El) -> str:
    """The first Atom link outside entries whose relations include next."""
    work = [root]
    while work:
        el = work.pop()
        if el.name in ("entry", "item"):
            continue
        if el.ns == ATOM and el.name == "link" and el.attrs.get("href") and "next" in el.attrs.get("rel", "").lower().split():
            return without_fragment(resolve(el.base, el.attrs["href"]))
        work.extend(k for k in reversed(el.kids) if isinstance(k, El))
    return ""


def parse_xml_feed(body: bytes, source_url: str) -> dict:
    root = read_tree(body, source_url)
    if root.ns == ATOM and root.name == "feed":
        items, generator = _atom(root, source_url)
    elif root.name == "rss" or (root.name == "RDF" and root.ns == RDF):
        items, generator = _rss(root, source_url)
    else:
        raise NotFeed(f"root element {root.name} is no feed")
    return {"items": items, "generator": generator or None, "next_url": _next_link(root) or None}
