"""URLs by RFC 3986: parse, resolve, canonicalise, validate.  Plain functions; ``columns`` has their Arrow-batched forms.

A reference that breaks the syntax (a bad percent escape, a control character, a bad port, ``:`` before a scheme) is unparsable; what that
means is said at each function.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache
from urllib.parse import parse_qsl, quote_plus, unquote

import pyarrow as pa

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", re.S)
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_HOST_OK = re.compile(r"[^\s\"<>\\^`{|}]*")
# Characters of a path and of a fragment that stay as they are.
_PATH_KEEP = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~!$&'()*+,;=:@/[]%"
_FRAGMENT_KEEP = _PATH_KEEP + "?"


@dataclass(frozen=True)
class Url:
    scheme: str = ""
    user: str | None = None
    host: str = ""  # with port and brackets, as written
    path: str = ""
    query: str | None = None
    fragment: str | None = None
    opaque: str = ""
    authority: bool = False

    @property
    def hostname(self) -> str:
        h = self.host
        if h.startswith("["):
            return h[1 : h.index("]")]
        return h.split(":", 1)[0]

    @property
    def port(self) -> str:
        h = self.host
        rest = h[h.index("]") + 1 :] if h.startswith("[") else h[len(self.hostname) :]
        return rest[1:]

    def text(self) -> str:
        out = f"{self.scheme}:" if self.scheme else ""
        if self.opaque:
            out += self.opaque
        else:
            if self.authority:
                out += "//" + (f"{self.user}@" if self.user is not None else "") + self.host
            p = _keep(self.path, _PATH_KEEP)
            if self.authority and p and not p.startswith("/"):
                p = "/" + p
            if not out and ":" in p.split("/", 1)[0]:
                p = "./" + p
            out += p
        if self.query is not None:
            out += "?" + self.query
        if self.fragment:
            out += "#" + _keep(self.fragment, _FRAGMENT_KEEP)
        return out


def _keep(s: str, ok: str) -> str:
    return "".join(c if c in ok else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in s)


@lru_cache(maxsize=20_000)
def parse(value: str) -> Url | None:
    """None if the text is no URL reference."""
    if _CONTROL.search(value):
        return None
    rest, _, fragment = value.partition("#")
    if _BAD_ESCAPE.search(fragment):
        return None
    frag = fragment or None
    scheme = ""
    if m := _SCHEME.fullmatch(rest):
        scheme, rest = m[1].lower(), m[2]
    elif rest.startswith(":"):
        return None
    rest, mark, query = rest.partition("?")
    q = query if mark else None
    if scheme and not rest.startswith("/"):
        if rest or q is not None:
            return Url(scheme=scheme, opaque=rest, query=q, fragment=frag) if rest else Url(scheme=scheme, query=q, fragment=frag)
        return Url(scheme=scheme, fragment=frag)
    if not scheme and ":" in rest.split("/", 1)[0]:
        return None
    user, host, authority = None, "", False
    if rest.startswith("//"):
        authority = True
        auth, slash, tail = rest[2:].partition("/")
        rest = slash + tail
        if "@" in auth:
            user, _, auth = auth.rpartition("@")
        host = auth
        if host.startswith("["):
            if "]" not in host:
                return None
            port = host[host.index("]") + 1 :]
            zone = host[1 : host.index("]")].partition("%")[2]
            if zone and not host[1 : host.index("]")].partition("%25")[1]:
                return None
        else:
            if _BAD_ESCAPE.search(host) or not _HOST_OK.fullmatch(host):
                return None
            name, mark, port = host.rpartition(":")
            port = ":" + port if mark else ""
            if mark and ":" in name:
                return None
        if port and not re.fullmatch(r":[0-9]*", port):
            return None
    if _BAD_ESCAPE.search(rest):
        return None
    return Url(scheme=scheme, user=user, host=host, path=rest, query=q, fragment=frag, authority=authority)


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for k, p in enumerate(parts):
        if p == ".":
            if k == len(parts) - 1:
                out.append("")
        elif p == "..":
            if len(out) > 1:
                out.pop()
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(p)
    s = "/".join(out)
    return s if s.startswith("/") or not path.startswith("/") else "/" + s


def join(base: Url, ref: Url) -> Url:
    """Reference resolution; an empty reference takes the base without its fragment."""
    if ref.scheme:
        return replace(ref, path=_dots(ref.path)) if ref.authority or ref.path else ref
    if ref.authority:
        return replace(ref, scheme=base.scheme, path=_dots(ref.path))
    if base.opaque and not ref.path:
        return replace(base, query=ref.query if ref.query is not None else base.query, fragment=ref.fragment)
    out = replace(ref, scheme=base.scheme, user=base.user, host=base.host, authority=base.authority)
    if not ref.path:
        return replace(out, path=base.path, query=ref.query if ref.query is not None else base.query)
    if ref.path.startswith("/"):
        return replace(out, path=_dots(ref.path))
    folder = base.path.rpartition("/")[0] + "/" if "/" in base.path else "/" if base.authority else ""
    return replace(out, path=_dots(folder + ref.path))


def resolve(base: str | None, ref: str | None) -> str:
    """Empty stays empty; an unparsable base or reference leaves the reference as it is."""
    if not ref:
        return ""
    b, r = parse(base or ""), parse(ref)
    return ref if b is None or r is None else join(b, r).text()


def without_fragment(value: str) -> str:
    u = parse(value)
    return value if u is None else replace(u, fragment=None).text()


def display(value: str) -> str:
    """Without user information, for messages."""
    u = parse(value)
    return "(no URL)" if u is None else replace(u, user=None).text()


def valid_http(value: str | None) -> bool:
    """Absolute http or https, a host name, no user information."""
    u = parse(value) if value else None
    return bool(u and u.scheme in ("http", "https") and u.authority and u.hostname and u.user is None)


#: Name (or the address part of an IPv6 literal), zone with the closing bracket, and port of an authority.
_HOST = re.compile(r"(\[[^\]%]*|[^:\[]*)((?:%[^\]]*)?\]?)(:[0-9]*)?")
_DEFAULT_PORTS = {"http": ":80", "https": ":443"}


def canonical(value: str) -> str:
    """Syntax- and scheme-based normalisation of RFC 3986 (6.2.2.1, 6.2.3), the form compared in discovery, without a fragment.

    Escapes stay as they are, as does the zone of an IPv6 address, which names an interface.
    """
    u = parse(value)
    if u is None:
        return value
    normal = {"fragment": None}
    if u.authority:
        name, zone, port = _HOST.fullmatch(u.host).groups("")
        normal["host"] = name.lower() + zone + ("" if port == _DEFAULT_PORTS.get(u.scheme) else port)
        normal["path"] = u.path or "/"
    return replace(u, **normal).text()


def candidate(base: str, href: str) -> str | None:
    """A discovered link's address; None where it can't be fetched."""
    b, r = parse(base), parse(href)
    if b is None or r is None:
        return None
    got = canonical(join(b, r).text())
    return got if valid_http(got) else None


def is_wordpress(generator: str | None) -> bool:
    u = parse((generator or "").strip())
    return bool(u and u.user is None and u.scheme in ("http", "https") and u.authority and u.hostname.lower() == "wordpress.org")


def wordpress_page(value: str) -> int:
    u = parse(value)
    for k, v in parse_qsl(u.query or "", keep_blank_values=True) if u else ():
        if k == "paged":
            return int(v) if re.fullmatch(r"\+?[0-9]+", v) and int(v) > 0 else 1
    return 1


def next_wordpress(value: str, page: int) -> str:
    """The address with ``paged`` one higher; the query is written anew in order of its keys."""
    u = parse(value)
    if u is None or page < 1:
        return ""
    pairs = [(k, v) for k, v in parse_qsl(u.query or "", keep_blank_values=True) if k != "paged"] + [("paged", str(page + 1))]
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in sorted(pairs, key=lambda kv: kv[0]))
    return replace(u, query=query, fragment=None).text()


def canonical_host(host: str) -> str:
    """One name for one host: addresses in short form, international names in ASCII, lower case, no final dot."""
    import ipaddress

    h = host.strip().rstrip(".") if not host.startswith("[") else host.strip("[]")
    try:
        return str(ipaddress.ip_address(h.partition("%")[0] if ":" in h else h)) + ("%" + h.partition("%")[2] if "%" in h else "")
    except ValueError:
        pass
    try:
        return h.encode("idna").decode().lower() if not h.isascii() else h.lower()
    except UnicodeError:
        return h.lower()


def path_words(href: str) -> str:
    """The decoded path of a reference, for hints."""
    u = parse(href)
    return unquote(u.path) if u else ""


# Columns --------------------------------------------------------------------------------------------------------
def columns():
    """Functions over whole Arrow batches: ``resolve_url(base, ref)``, ``canonical_url(u)``, ``display_url(u)``, ``valid_url(u)``, ``page_url(u)``.

    Null gives null, but no address is valid where there is none.
    """
    from pyspark.sql import functions as F

    def text(f, name):
        def batch(u: pa.Array) -> pa.Array:
            d = u.dictionary_encode()  # each distinct address once
            return pa.array([None if x is None else f(x) for x in d.dictionary.to_pylist()], pa.string()).take(d.indices)

        batch.__name__ = name
        return F.arrow_udf(batch, "string")

    def resolve_url(base: pa.Array, ref: pa.Array) -> pa.Array:
        return pa.array([None if r is None else resolve(b, r) for b, r in zip(base.to_pylist(), ref.to_pylist())], pa.string())

    def valid_url(u: pa.Array) -> pa.Array:
        return pa.array(list(map(valid_http, u.to_pylist())), pa.bool_())

    return {
        "resolve_url": F.arrow_udf(resolve_url, "string"),
        "canonical_url": text(canonical, "canonical_url"),
        "display_url": text(display, "display_url"),
        "valid_url": F.arrow_udf(valid_url, "boolean"),
        "page_url": text(without_fragment, "page_url"),
    }


def register(spark) -> None:
    """The same functions for SQL."""
    for name, f in columns().items():
        spark.udf.register(name, f)
