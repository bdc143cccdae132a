"""Per-item programs in jq's language.

A program is parsed once on the driver.  Where it consists of paths, literals, comparisons, alternatives, conditions,
selections, objects and a few functions over an item's fields it becomes Catalyst columns (``to_columns``);
everything else runs in an interpreter, in Arrow batches (``apply``).  Both give the same values.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Iterator
from functools import cmp_to_key, partial
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.numbers import number_text

# Lexer --------------------------------------------------------------------------------------------------------------
_LEX = re.compile(
    r"(?P<ws>\s+|\#[^\n]*)|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<str>\")|(?P<fmt>@[A-Za-z0-9_]+)|(?P<var>\$[A-Za-z_]\w*)"
    r"|(?P<field>\.[A-Za-z_]\w*)|(?P<word>[A-Za-z_]\w*)|(?P<op>\?//|//=|\|=|\+=|-=|\*=|/=|%=|==|!=|<=|>=|//|\.\.|[.\[\](){}|,:;=<>+\-*/%?])"
)


class JqSyntaxError(ValueError):
    def __init__(self, message: str):
        super().__init__(f"this is no jq program: {message}")


class JqError(ValueError):
    def __init__(self, value):
        self.value = value
        super().__init__(value if isinstance(value, str) else dumps(value))


class _Break(Exception):
    pass


def _lex(src: str) -> list[tuple[str, object]]:
    out, i = [], 0
    while i < len(src):
        m = _LEX.match(src, i)
        if m is None:
            raise JqSyntaxError(f"unexpected {src[i]!r}")
        kind = m.lastgroup
        if kind == "str":
            parts, i = _string(src, i + 1)
            out.append(("str", parts))
            continue
        if kind != "ws":
            out.append((kind, m.group()))
        i = m.end()
    out.append(("end", ""))
    return out


def _string(src: str, i: int) -> tuple[list, int]:
    """Pieces of a string literal; interpolated programs are nodes."""
    parts: list = []
    buf = ""
    while True:
        if i >= len(src):
            raise JqSyntaxError("unterminated string")
        c = src[i]
        if c == '"':
            if buf or not parts:
                parts.append(buf)
            return parts, i + 1
        if c == "\\":
            d = src[i + 1 : i + 2]
            if d == "(":
                depth, j, inside = 1, i + 2, False
                while depth:
                    if j >= len(src):
                        raise JqSyntaxError("unterminated interpolation")
                    if src[j] == '"' and src[j - 1] != "\\":
                        inside = not inside
                    if not inside:
                        depth += {"(": 1, ")": -1}.get(src[j], 0)
                    j += 1
                parts += [buf, parse(src[i + 2 : j - 1])]
                buf, i = "", j
                continue
            if d == "u":
                m = re.match(r"\\u([0-9A-Fa-f]{4})(?:\\u([dD][c-fC-F][0-9A-Fa-f]{2}))?", src[i:])
                if not m:
                    raise JqSyntaxError("invalid escape")
                buf += json.loads(f'"{m.group()}"') if m[2] or not 0xD800 <= int(m[1], 16) < 0xE000 else "\ufffd"
                i += m.end()
                continue
            if d not in '"\\/bfnrt' or not d:
                raise JqSyntaxError("invalid escape")
            buf += {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}.get(d, d)
            i += 2
            continue
        buf += c
        i += 1


# Parser: nodes are tuples --------------------------------------------------------------------------------------------
_LEVELS = [("//",), ("=", "|=", "+=", "-=", "*=", "/=", "%=", "//="), ("or",), ("and",), ("==", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%")]
_KEYWORDS = frozenset("def if then elif else end as reduce foreach try catch and or label import include __loc__".split())


class _Parser:
    def __init__(self, toks: list):
        self.t, self.i = toks, 0

    def peek(self, *values: str) -> bool:
        k, v = self.t[self.i]
        return k in ("op", "word") and v in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise JqSyntaxError(f"expected {value!r}, found {self.t[self.i][1]!r}")

    def kind(self, kind: str):
        if self.t[self.i][0] == kind:
            self.i += 1
            return self.t[self.i - 1][1]
        return None

    def pipe(self):
        if self.take("def"):
            name = self.kind("word")
            params = []
            if self.take("("):
                while True:
                    params.append(self.kind("word") or self.kind("var"))
                    if self.take(")"):
                        break
                    self.need(";")
            self.need(":")
            body = self.pipe()
            self.need(";")
            return ("def", name, params, body, self.pipe())
        left = self.comma()
        if self.take("as"):
            patterns = [self.pattern()]
            while self.take("?//"):
                patterns.append(self.pattern())
            self.need("|")
            return ("as", left, patterns, self.pipe())
        return ("pipe", left, self.pipe()) if self.take("|") else left

    def comma(self):
        left = self.binary(0)
        while self.take(","):
            left = ("comma", left, self.binary(0))
        return left

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.postfix()
        left = self.binary(level + 1)
        ops = _LEVELS[level]
        if level == 0:
            return ("alt", left, self.binary(0)) if self.take("//") else left
        while self.peek(*ops):
            op = self.t[self.i][1]
            self.i += 1
            left = ("bin", op, left, self.binary(level + 1))
            if level in (1, 4):
                if self.peek(*ops):
                    raise JqSyntaxError("operators can't be chained")
                break
        return left

    def pattern(self):
        if v := self.kind("var"):
            return ("var", v)
        if self.take("["):
            out = [self.pattern()]
            while self.take(","):
                out.append(self.pattern())
            self.need("]")
            return ("arr", out)
        self.need("{")
        out = []
        while True:
            if v := self.kind("var"):
                out.append((("lit", v[1:]), ("var", v) if not self.take(":") else self.pattern()))
            else:
                k = self.kind("word")
                key = ("lit", k) if k else ("fmtstr", None, self.kind("str"))
                self.need(":")
                out.append((key, self.pattern()))
            if self.take("}"):
                return ("obj", out)
            self.need(",")

    def postfix(self):
        e = self.term()
        while True:
            if f := self.kind("field"):
                e = ("index", e, ("lit", f[1:]))
            elif self.peek(".") and self.t[self.i + 1][0] == "str":
                self.i += 1
                e = ("index", e, ("fmtstr", None, self.kind("str")))
            elif self.peek(".") and self.t[self.i + 1] == ("op", "["):
                self.i += 1
            elif self.take("["):
                e = self.bracket(e)
            elif self.take("?"):
                e = ("try", e, None)
            else:
                return e

    def bracket(self, e):
        if self.take("]"):
            return ("iter", e)
        if self.take(":"):
            hi = self.pipe()
            self.need("]")
            return ("slice", e, None, hi)
        k = self.pipe()
        if self.take(":"):
            hi = None if self.peek("]") else self.pipe()
            self.need("]")
            return ("slice", e, k, hi)
        self.need("]")
        return ("index", e, k)

    def term(self):
        k, v = self.t[self.i]
        self.i += 1
        if k == "num":
            x = float(v)
            return ("lit", int(v) if re.fullmatch(r"\d+", v) else int(x) if x.is_integer() and abs(x) < 1e17 else x)
        if k == "str":
            return ("fmtstr", None, v)
        if k == "fmt":
            s = self.kind("str")
            return ("fmtstr", v, s) if s is not None else ("format", v)
        if k == "field":
            return ("index", ("id",), ("lit", v[1:]))
        if k == "var":
            return ("getvar", v)
        if k == "op":
            if v == ".":
                if self.t[self.i][0] == "str":
                    return ("index", ("id",), ("fmtstr", None, self.kind("str")))
                return ("id",)
            if v == "..":
                return ("call", "recurse", [])
            if v == "(":
                e = self.pipe()
                self.need(")")
                return e
            if v == "[":
                if self.take("]"):
                    return ("lit", [])
                e = self.pipe()
                self.need("]")
                return ("array", e)
            if v == "{":
                return self.object()
            if v == "-":
                return ("neg", self.postfix())
        if k == "word":
            if v == "if":
                return self.condition()
            if v == "try":
                body = self.postfix()
                return ("try", body, self.postfix() if self.take("catch") else None)
            if v in ("reduce", "foreach"):
                src = self.postfix()
                self.need("as")
                pat = self.pattern()
                self.need("(")
                args = [self.pipe()]
                while self.take(";"):
                    args.append(self.pipe())
                self.need(")")
                if len(args) not in ((2,) if v == "reduce" else (2, 3)):
                    raise JqSyntaxError(f"{v} has the wrong number of arguments")
                return (v, src, pat, args)
            if v == "label":
                name = self.kind("var")
                self.need("|")
                return ("label", name, self.pipe())
            if v == "def":
                self.i -= 1
                return self.pipe()
            if v in ("null", "true", "false"):
                return ("lit", {"true": True, "false": False}.get(v))
            if v not in _KEYWORDS:
                args = []
                if self.take("("):
                    args.append(self.pipe())
                    while self.take(";"):
                        args.append(self.pipe())
                    self.need(")")
                if v == "break":
                    return ("break", self.kind("var"))
                return ("call", v, args)
        raise JqSyntaxError(f"unexpected {v or 'end of program'!r}")

    def condition(self):
        test = self.pipe()
        self.need("then")
        yes = self.pipe()
        if self.take("elif"):
            return ("if", test, yes, self.condition())
        no = ("id",)
        if self.take("else"):
            no = self.pipe()
        self.need("end")
        return ("if", test, yes, no)

    def object(self):
        out = []
        while not self.take("}"):
            if out:
                self.need(",")
            k, v = self.t[self.i]
            self.i += 1
            if k == "var":
                out.append((("lit", v[1:]), ("getvar", v)))
                continue
            if k == "word":
                key = ("lit", v)
            elif k == "str":
                key = ("fmtstr", None, v)
            elif k == "fmt":
                key = ("fmtstr", v, self.kind("str"))
            elif k == "num":
                raise JqSyntaxError("an object key can't be a number")
            elif (k, v) == ("op", "("):
                key = self.pipe()
                self.need(")")
            else:
                raise JqSyntaxError(f"unexpected {v!r} in object")
            if self.take(":"):
                val = self.value()
            else:
                val = ("index", ("id",), key)
            out.append((key, val))
        return ("object", out)

    def value(self):
        left = self.binary(0)
        while self.take("|"):
            left = ("pipe", left, self.binary(0))
        return left


def parse(src: str):
    p = _Parser(_lex(src))
    if p.t[0][0] == "end":
        return ("id",)
    e = p.pipe()
    if p.t[p.i][0] != "end":
        raise JqSyntaxError(f"unexpected {p.t[p.i][1]!r}")
    return e


# Values ---------------------------------------------------------------------------------------------------------------
def dumps(v) -> str:
    """Compact JSON with sorted keys and shortest numbers."""
    odd: list[float] = []
    v = _finite(v, odd)
    return _written(v) if odd else json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _finite(v, odd: list):
    """Whole numbers as integers, NaN as null, infinity as the largest number; ``odd`` gets those that Python writes in another way."""
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            v = math.copysign(1.7976931348623157e308, v)
        if v.is_integer() and abs(v) < 2**53:
            return int(v)
        if "e" in repr(v):
            odd.append(v)
        return v
    if isinstance(v, list):
        return [_finite(x, odd) for x in v]
    if isinstance(v, dict):
        return {k: _finite(x, odd) for k, x in v.items()}
    return v


def _written(v) -> str:
    if isinstance(v, float):
        return number_text(v)
    if isinstance(v, list):
        return "[" + ",".join(map(_written, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_written(v[k])}" for k in sorted(v)) + "}"
    return json.dumps(v, ensure_ascii=False)


def _type(v) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


_ORDER = {"null": 0, "boolean": 1, "number": 3, "string": 4, "array": 5, "object": 6}


def _compare(a, b) -> int:
    ta, tb = _type(a), _type(b)
    if ta != tb:
        return _ORDER[ta] - _ORDER[tb]
    if ta == "array":
        for x, y in zip(a, b):
            if c := _compare(x, y):
                return c
        return len(a) - len(b)
    if ta == "object":
        ka, kb = sorted(a), sorted(b)
        if c := _compare(ka, kb):
            return c
        for k in ka:
            if c := _compare(a[k], b[k]):
                return c
        return 0
    return 0 if a is None or a == b else -1 if a < b else 1


_key = cmp_to_key(_compare)


def _true(v) -> bool:
    return v is not None and v is not False


def _arith(op: str, a, b):
    ta, tb = _type(a), _type(b)
    if op == "+":
        if a is None or b is None:
            return b if a is None else a
        if ta == tb and ta in ("number", "string", "array"):
            return a + b
        if ta == tb == "object":
            return a | b
    elif op == "-":
        if ta == tb == "number":
            return a - b
        if ta == tb == "array":
            return [x for x in a if not any(_compare(x, y) == 0 for y in b)]
    elif op == "*":
        if ta == tb == "number":
            return a * b
        if {ta, tb} == {"string", "number"}:
            s, n = (a, b) if ta == "string" else (b, a)
            return s * int(max(1, n)) if n > 0 else None
        if ta == tb == "object":
            return _merge(a, b)
    elif op == "/":
        if ta == tb == "number":
            if b == 0:
                raise JqError(f"{dumps(a)} and {dumps(b)} cannot be divided because the divisor is zero")
            return a // b if isinstance(a, int) and isinstance(b, int) and a % b == 0 else a / b
        if ta == tb == "string":
            return (a.split(b) if b else list(a)) if a else []
    elif op == "%":
        if ta == tb == "number":
            if int(b) == 0:
                raise JqError("cannot be divided because the divisor is zero")
            return int(math.fmod(int(a), int(b)))
    raise JqError(f"{ta} and {tb} cannot be combined by {op}")


def _merge(a: dict, b: dict) -> dict:
    return a | {k: _merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def _index(v, k):
    if v is None and (k is None or isinstance(k, (str, int, float, dict))):
        return None
    if isinstance(v, dict) and isinstance(k, str):
        return v.get(k)
    if isinstance(v, list) and isinstance(k, (int, float)) and not isinstance(k, bool):
        i = math.floor(k)
        return v[i] if -len(v) <= i < len(v) else None
    if isinstance(v, list) and isinstance(k, list):
        return [i for i in range(len(v)) if k and v[i : i + len(k)] == k]
    if isinstance(v, (list, str)) and isinstance(k, dict):
        return v[_bound(k.get("start"), math.floor) : _bound(k.get("end"), math.ceil)]
    raise JqError(f"cannot index {_type(v)} with {json.dumps(k)}")


def _bound(x, f):
    if x is None:
        return None
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise JqError("slice bounds must be numbers")
    return f(x)


def _format(name: str, v) -> str:
    def text(x) -> str:
        return x if isinstance(x, str) else dumps(x)

    if name in ("@text", "@json"):
        return text(v) if name == "@text" else dumps(v)
    if name in ("@tsv", "@csv", "@sh"):
        rows = v if isinstance(v, list) else [v] if name == "@sh" else None
        if rows is None:
            raise JqError(f"{_type(v)} cannot be formatted as {name[1:]}: not an array")
        out = []
        for x in rows:
            if isinstance(x, (list, dict)):
                raise JqError(f"{_type(x)} is not valid in a {name[1:]} row")
            if name == "@tsv":
                out.append("" if x is None else text(x).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r"))
            elif name == "@csv":
                out.append("" if x is None else '"' + x.replace('"', '""') + '"' if isinstance(x, str) else dumps(x))
            else:
                out.append("'" + x.replace("'", "'\\''") + "'" if isinstance(x, str) else dumps(x))
        return {"@tsv": "\t", "@csv": ",", "@sh": " "}[name].join(out)
    s = text(v)
    if name == "@html":
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("'", "&#39;").replace('"', "&quot;")
    if name == "@uri":
        return quote(s, safe="-_.~")
    if name == "@base64":
        return base64.b64encode(s.encode()).decode()
    if name == "@base64d":
        return base64.b64decode(s + "=" * (-len(s) % 4)).decode("utf-8", "replace")
    raise JqError(f"{name} is not a format")


def _paths(v, at=()) -> Iterator[tuple]:
    for k, x in enumerate(v) if isinstance(v, list) else v.items() if isinstance(v, dict) else ():
        yield (*at, k)
        yield from _paths(x, (*at, k))


def _set(v, path, f):
    """A copy with the value at ``path`` replaced by ``f`` of it."""
    if not path:
        return f(v)
    k = path[0]
    if isinstance(k, str):
        if v is not None and not isinstance(v, dict):
            raise JqError(f"cannot index {_type(v)} with {json.dumps(k)}")
        return {**(v or {}), k: _set((v or {}).get(k), path[1:], f)}
    if v is not None and not isinstance(v, list):
        raise JqError(f"cannot index {_type(v)} with number")
    out = list(v or [])
    i = int(k) + (len(out) if k < 0 else 0)
    if i < 0:
        raise JqError("out of bounds negative array index")
    out.extend([None] * (i + 1 - len(out)))
    out[i] = _set(out[i], path[1:], f)
    return out


def _delete(v, paths: list[tuple]):
    for p in sorted(paths, key=lambda p: _key(list(p)), reverse=True):
        v = _delete_one(v, p)
    return v


def _delete_one(v, p):
    if v is None or not p:
        return None
    k = p[0]
    if len(p) == 1:
        return {a: b for a, b in v.items() if a != k} if isinstance(v, dict) else [b for a, b in enumerate(v) if a != (k if k >= 0 else k + len(v))]
    if isinstance(v, dict) and k in v:
        return {**v, k: _delete_one(v[k], p[1:])}
    if isinstance(v, list) and -len(v) <= k < len(v):
        return [*v[:k], _delete_one(v[k], p[1:]), *v[k + 1 :]] if k != -1 else [*v[:-1], _delete_one(v[-1], p[1:])]
    return v


# Interpreter: every node maps a (path, value) to any number of them ---------------------------------------------------------
class Program:
    def __init__(self, src: str):
        self.src, self.tree = src, parse(src)
        self._check(self.tree, {}, frozenset())

    def run(self, value) -> Iterator:
        for _, v in self._eval(self.tree, (None, value), {}):
            yield v

    def _check(self, node, funcs: dict, names: frozenset) -> None:
        """Unknown functions and variables are found when the program is read, not when it runs."""
        kind = node[0]
        if kind == "getvar":
            if node[1] not in names and node[1] not in ("$ENV", "$__loc__"):
                raise JqSyntaxError(f"variable not defined: {node[1]}")
        elif kind == "call":
            if (node[1], len(node[2])) not in funcs and not (len(node[2]) == 0 and (node[1], -1) in funcs) and f"_{node[1]}_{len(node[2])}" not in _BUILTINS and (node[1], len(node[2])) not in _DEFS:
                raise JqSyntaxError(f"function not defined: {node[1]}/{len(node[2])}")
            for a in node[2]:
                self._check(a, funcs, names)
        elif kind == "def":
            inner = funcs | {(node[1], len(node[2])): 1}
            own = inner | {(p.lstrip("$"), 0): 1 for p in node[2]}
            self._check(node[3], own, names | {p for p in node[2] if p[0] == "$"})
            self._check(node[4], inner, names)
        elif kind == "as":
            self._check(node[1], funcs, names)
            self._check(node[3], funcs, names | {v for p in node[2] for v in _names(p)})
        elif kind in ("reduce", "foreach"):
            self._check(node[1], funcs, names)
            for a in node[3]:
                self._check(a, funcs, names | set(_names(node[2])))
        elif kind == "object":
            for k, v in node[1]:
                self._check(k, funcs, names)
                self._check(v, funcs, names)
        elif kind == "fmtstr":
            for p in node[2]:
                if not isinstance(p, str):
                    self._check(p, funcs, names)
        else:
            for x in node[1:]:
                if isinstance(x, tuple) and x and isinstance(x[0], str):
                    self._check(x, funcs, names)

    def _values(self, node, v, env) -> Iterator:
        for _, x in self._eval(node, (None, v), env):
            yield x

    def _step(self, pv, k):
        p, v = pv
        return (None if p is None else (*p, k), _index(v, k))

    def _eval(self, node, pv, env) -> Iterator:
        kind = node[0]
        v = pv[1]
        if kind == "id":
            yield pv
        elif kind == "lit":
            yield None, node[1]
        elif kind == "pipe":
            for x in self._eval(node[1], pv, env):
                yield from self._eval(node[2], x, env)
        elif kind == "comma":
            yield from self._eval(node[1], pv, env)
            yield from self._eval(node[2], pv, env)
        elif kind == "index":
            for k in self._values(node[2], v, env):
                for x in self._eval(node[1], pv, env):
                    yield self._step(x, k)
        elif kind == "slice":
            for hi in self._values(node[3], v, env) if node[3] else (None,):
                for lo in self._values(node[2], v, env) if node[2] else (None,):
                    for x in self._eval(node[1], pv, env):
                        if x[1] is None:
                            yield x
                            continue
                        if not isinstance(x[1], (list, str)):
                            raise JqError(f"cannot slice {_type(x[1])}")
                        yield self._step(x, {"start": lo, "end": hi})
        elif kind == "iter":
            for p, x in self._eval(node[1], pv, env):
                if isinstance(x, list):
                    yield from ((None if p is None else (*p, k), e) for k, e in enumerate(x))
                elif isinstance(x, dict):
                    yield from ((None if p is None else (*p, k), x[k]) for k in sorted(x))
                else:
                    raise JqError(f"cannot iterate over: {_type(x)}")
        elif kind == "array":
            yield None, list(self._values(node[1], v, env))
        elif kind == "object":
            yield from ((None, o) for o in self._object(node[1], v, env))
        elif kind == "neg":
            for x in self._values(node[1], v, env):
                if _type(x) != "number":
                    raise JqError(f"{_type(x)} cannot be negated")
                yield None, -x
        elif kind == "bin":
            yield from self._binary(node, pv, env)
        elif kind == "alt":
            found = False
            try:
                for x in self._eval(node[1], pv, env):
                    if _true(x[1]):
                        found = True
                        yield x
            except JqError:
                pass
            if not found:
                yield from self._eval(node[2], pv, env)
        elif kind == "if":
            for c in self._values(node[1], v, env):
                yield from self._eval(node[2] if _true(c) else node[3], pv, env)
        elif kind == "try":
            try:
                yield from self._eval(node[1], pv, env)
            except JqError as e:
                if node[2] is not None:
                    yield from self._eval(node[2], (None, e.value), env)
        elif kind == "getvar":
            yield None, {} if node[1] == "$ENV" else env[node[1]]
        elif kind == "as":
            for x in self._values(node[1], v, env):
                yield from self._as(node[2], x, node[3], pv, env)
        elif kind == "reduce":

            init = list(self._values(node[3][0], v, env))
            acc = init[-1] if init else None
            for x in self._values(node[1], v, env):
                for bound in self._bind(node[2], x, env):
                    got = list(self._values(node[3][1], acc, bound))
                    acc = got[-1] if got else None
            yield None, acc
        elif kind == "foreach":
            for acc in self._values(node[3][0], v, env):
                for x in self._values(node[1], v, env):
                    for bound in self._bind(node[2], x, env):
                        for acc in self._values(node[3][1], acc, bound):
                            if len(node[3]) > 2:
                                yield from self._eval(node[3][2], (None, acc), bound)
                            else:
                                yield None, acc
        elif kind == "def":
            env = {**env}
            env[node[1], len(node[2])] = (node[2], node[3], env)
            yield from self._eval(node[4], pv, env)
        elif kind == "format":
            yield None, _format(node[1], v)
        elif kind == "fmtstr":
            outs = [""]
            for p in node[2]:
                if isinstance(p, str):
                    outs = [o + p for o in outs]
                else:
                    outs = [o + (_format(node[1] or "@text", x)) for x in self._values(p, v, env) for o in outs]
            yield from ((None, o) for o in outs)
        elif kind == "label":
            mark = _Break()
            try:
                yield from self._eval(node[2], pv, {**env, ("label", node[1]): mark})
            except _Break as b:
                if b is not mark:
                    raise
        elif kind == "break":
            raise env["label", node[1]]
        elif kind == "call":
            yield from self._call(node[1], node[2], pv, env)
        else:  # pragma: no cover
            raise JqError(f"unknown node {kind}")

    def _object(self, members, v, env) -> Iterator[dict]:
        outs: list[dict] = [{}]
        for key, val in members:
            nxt = []
            for o in outs:
                for k in self._values(key, v, env):
                    if not isinstance(k, str):
                        raise JqError("object keys must be strings")
                    nxt.extend({**o, k: x} for x in self._values(val, v, env))
            outs = nxt
        yield from outs

    def _binary(self, node, pv, env) -> Iterator:
        _, op, left, right = node
        v = pv[1]
        if op in ("and", "or"):
            for a in self._values(left, v, env):
                if _true(a) == (op == "or"):
                    yield None, op == "or"
                else:
                    for b in self._values(right, v, env):
                        yield None, _true(b)
        elif op in ("=", "|=", "+=", "-=", "*=", "/=", "%=", "//="):
            paths = [p for p, _ in self._eval(left, ((), v), env)]
            if any(p is None for p in paths):
                raise JqError("invalid path expression")
            if op == "|=":
                out, gone = v, []
                for p in paths:
                    got: list = []

                    def update(x):
                        got[:] = list(self._values(right, x, env))[:1]
                        return got[0] if got else x

                    out = _set(out, p, update)
                    if not got:
                        gone.append(p)
                yield None, _delete(out, gone)
                return
            for b in self._values(right, v, env):
                out = v
                for p in paths:
                    out = _set(out, p, lambda x, b=b: b if op == "=" else (x if _true(x) else b) if op == "//=" else _arith(op[0], x, b))
                yield None, out
        else:
            for b in self._values(right, v, env):
                for a in self._values(left, v, env):
                    if op in ("==", "!=", "<", "<=", ">", ">="):
                        c = _compare(a, b)
                        yield None, {"==": c == 0, "!=": c != 0, "<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]
                    else:
                        yield None, _arith(op, a, b)

    def _bind(self, pat, x, env) -> Iterator[dict]:
        if pat[0] == "var":
            yield {**env, pat[1]: x}
        elif pat[0] == "arr":
            if x is not None and not isinstance(x, list):
                raise JqError(f"cannot index {_type(x)} with number")
            envs = [env]
            for k, p in enumerate(pat[1]):
                envs = [b for e in envs for b in self._bind(p, _index(x, k), e)]
            yield from envs
        else:
            envs = [env]
            for key, p in pat[1]:
                envs = [b for e in envs for k in self._values(key, x, e) for b in self._bind(p, _index(x, k), e)]
            yield from envs

    def _as(self, patterns, x, body, pv, env) -> Iterator:
        blank = {n: None for p in patterns for n in _names(p)} if len(patterns) > 1 else {}
        for k, p in enumerate(patterns):
            try:
                for bound in self._bind(p, x, {**env, **blank}):
                    yield from self._eval(body, pv, bound)
                return
            except JqError:
                if k == len(patterns) - 1:
                    raise

    def _call(self, name, args, pv, env) -> Iterator:
        f = env.get((name, len(args)))
        if f is None and (name, len(args)) in _DEFS:
            params, body = _DEFS[name, len(args)]
            f = (params, body, {})
        if f is not None:
            params, body, home = f
            if params is None:  # a parameter: its argument in its own place
                yield from self._eval(body, pv, home)
                return
            inner = {**home, (name, len(args)): f}
            plain = [inner]
            for p, a in zip(params, args):
                if p[0] == "$":
                    plain = [{**e, p: x, (p[1:], 0): (None, ("lit", x), {})} for e in plain for x in self._values(a, pv[1], env)]
                else:
                    plain = [{**e, (p, 0): (None, a, env)} for e in plain]
            for e in plain:
                yield from self._eval(body, pv, e)
            return
        try:
            yield from _BUILTINS[f"_{name}_{len(args)}"](self, pv, args, env)
        except (TypeError, AttributeError, IndexError, KeyError, OverflowError, ArithmeticError, re.error) as e:
            # A value of a kind the function can't take is an error of the program, which ``try`` catches.
            raise JqError(f"{name}/{len(args)} cannot be applied to: {_type(pv[1])} ({e})") from e


def _names(pat) -> Iterator[str]:
    if pat[0] == "var":
        yield pat[1]
    elif pat[0] == "arr":
        for p in pat[1]:
            yield from _names(p)
    else:
        for _, p in pat[1]:
            yield from _names(p)


# Functions --------------------------------------------------------------------------------------------------------------
_BUILTINS: dict = {}


def _fn(name: str, n: int = 0):
    def add(f):
        if n == 0:
            _BUILTINS[f"_{name}_0"] = lambda prog, pv, args, env: iter(((None, f(pv[1])),))
        else:

            def run(prog, pv, args, env):
                combos = [()]
                for a in reversed(args):
                    combos = [(x, *c) for c in combos for x in prog._values(a, pv[1], env)]
                for c in combos:
                    yield None, f(pv[1], *c)

            _BUILTINS[f"_{name}_{n}"] = run
        return f

    return add


def _raw(name: str, n: int):
    def add(f):
        _BUILTINS[f"_{name}_{n}"] = f
        return f

    return add


def _need(v, kind: str, what: str):
    if _type(v) != kind:
        raise JqError(f"{what} cannot be applied to: {_type(v)}")
    return v


@_raw("empty", 0)
def _empty(prog, pv, args, env):
    return iter(())


@_raw("error", 0)
def _error(prog, pv, args, env):
    raise JqError(pv[1])


@_raw("error", 1)
def _error1(prog, pv, args, env):
    for x in prog._values(args[0], pv[1], env):
        raise JqError(x)
    return iter(())


@_raw("path", 1)
def _path(prog, pv, args, env):
    for p, _ in prog._eval(args[0], ((), pv[1]), env):
        if p is None:
            raise JqError("invalid path expression")
        yield None, list(p)


@_raw("recurse", 0)
def _recurse(prog, pv, args, env):
    p, v = pv
    yield pv
    for k, x in enumerate(v) if isinstance(v, list) else ((k, v[k]) for k in sorted(v)) if isinstance(v, dict) else ():
        yield from _recurse(prog, (None if p is None else (*p, k), x), args, env)


@_raw("getpath", 1)
def _getpath(prog, pv, args, env):
    for path in prog._values(args[0], pv[1], env):
        _need(path, "array", "getpath")
        x = pv
        for k in path:
            x = prog._step(x, k) if x[1] is not None else (None if x[0] is None else (*x[0], k), None)
        yield x


@_raw("limit", 2)
def _limit(prog, pv, args, env):
    for n in prog._values(args[0], pv[1], env):
        if n > 0:
            for k, x in enumerate(prog._eval(args[1], pv, env)):
                yield x
                if k + 1 >= n:
                    break


@_raw("first", 1)
def _first(prog, pv, args, env):
    for x in prog._eval(args[0], pv, env):
        yield x
        return


@_raw("isempty", 1)
def _isempty(prog, pv, args, env):
    yield None, next(prog._eval(args[0], pv, env), None) is None


@_raw("range", 2)
def _range(prog, pv, args, env):
    for a in prog._values(args[0], pv[1], env):
        for b in prog._values(args[1], pv[1], env):
            while a < b:
                yield None, a
                a += 1


@_raw("sort_by", 1)
def _sort_by(prog, pv, args, env):
    v = _need(pv[1], "array", "sort_by")
    yield None, [x for _, x in sorted(((list(prog._values(args[0], x, env)), x) for x in v), key=lambda t: _key(t[0]))]


@_raw("group_by", 1)
def _group_by(prog, pv, args, env):
    out: list[list] = []
    last = None
    for k, x in sorted(((list(prog._values(args[0], x, env)), x) for x in _need(pv[1], "array", "group_by")), key=lambda t: _key(t[0])):
        if out and _compare(last, k) == 0:
            out[-1].append(x)
        else:
            out.append([x])
        last = k
    yield None, out


@_raw("splits", 1)
def _splits(prog, pv, args, env):
    for r in prog._values(args[0], pv[1], env):
        yield from ((None, s) for s in _re_split(pv[1], r, ""))


@_raw("splits", 2)
def _splits2(prog, pv, args, env):
    for f in prog._values(args[1], pv[1], env):
        for r in prog._values(args[0], pv[1], env):
            yield from ((None, s) for s in _re_split(pv[1], r, f))


_fn("not")(lambda v: not _true(v))
_fn("type")(_type)
_fn("tojson")(dumps)
_fn("tostring")(lambda v: v if isinstance(v, str) else dumps(v))
_fn("keys")(lambda v: sorted(v) if isinstance(v, dict) else list(range(len(_need(v, "array", "keys")))))
_BUILTINS["_keys_unsorted_0"] = _BUILTINS["_keys_0"]
_fn("sort")(lambda v: sorted(_need(v, "array", "sort"), key=_key))
_fn("reverse")(lambda v: [] if v is None else v[::-1] if isinstance(v, (list, str)) else _need(v, "array", "reverse"))
_fn("ascii_downcase")(lambda v: "".join(c.lower() if c.isascii() else c for c in _need(v, "string", "ascii_downcase")))
_fn("ascii_upcase")(lambda v: "".join(c.upper() if c.isascii() else c for c in _need(v, "string", "ascii_upcase")))
_fn("explode")(lambda v: [ord(c) for c in _need(v, "string", "explode")])
_fn("implode")(lambda v: "".join(map(chr, _need(v, "array", "implode"))))
_fn("floor")(lambda v: math.floor(_need(v, "number", "floor")))
_fn("ceil")(lambda v: math.ceil(_need(v, "number", "ceil")))
_fn("round")(lambda v: math.floor(abs(_need(v, "number", "round")) + 0.5) * (1 if v >= 0 else -1))
_fn("sqrt")(lambda v: math.sqrt(_need(v, "number", "sqrt")))
_fn("fabs")(lambda v: abs(float(_need(v, "number", "fabs"))))
_fn("abs")(lambda v: abs(_need(v, "number", "abs")))
_fn("significand")(lambda v: math.frexp(_need(v, "number", "significand"))[0] * 2)
_fn("trim")(lambda v: _need(v, "string", "trim").strip())
_fn("ltrim")(lambda v: _need(v, "string", "ltrim").lstrip())
_fn("rtrim")(lambda v: _need(v, "string", "rtrim").rstrip())
_fn("now")(lambda v: __import__("time").time())
_fn("infinite")(lambda v: math.inf)
_fn("nan")(lambda v: math.nan)
_fn("env")(lambda v: {})
_fn("pow", 2)(lambda v, a, b: a**b)
_fn("utf8bytelength")(lambda v: len(_need(v, "string", "utf8bytelength").encode()))
_fn("transpose")(lambda v: [[r[i] if i < len(r) else None for r in v] for i in range(max(map(len, v), default=0))])


@_fn("length")
def _length(v):
    if isinstance(v, bool):
        raise JqError("length cannot be applied to: boolean")
    return 0 if v is None else abs(v) if isinstance(v, (int, float)) else len(v)


@_fn("add")
def _add(v):
    out = None
    for x in v.values() if isinstance(v, dict) else _need(v, "array", "add"):
        out = _arith("+", out, x)
    return out


@_fn("tonumber")
def _tonumber(v):
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return v
    if isinstance(v, str):
        try:
            return int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v) else _need(None, "string", "tonumber")
        except (ValueError, JqError):
            pass
    raise JqError(f"tonumber cannot be applied to: {_type(v)}")


@_fn("fromjson")
def _fromjson(v):
    try:
        return json.loads(_need(v, "string", "fromjson"))
    except ValueError as e:
        raise JqError(f"fromjson cannot be applied: {e}") from e


@_fn("flatten")
def _flatten0(v):
    return _flat(v, math.inf)


@_fn("flatten", 1)
def _flatten1(v, n):
    return _flat(v, n)


def _flat(v, n):
    out = []
    for x in _need(v, "array", "flatten"):
        out.extend(_flat(x, n - 1) if isinstance(x, list) and n > 0 else [x])
    return out


@_fn("has", 1)
def _has(v, k):
    if isinstance(v, dict) and isinstance(k, str):
        return k in v
    if isinstance(v, list) and isinstance(k, int):
        return 0 <= k < len(v)
    raise JqError(f"cannot check whether {_type(v)} has a key of type {_type(k)}")


@_fn("contains", 1)
def _contains(a, b):
    if _type(a) != _type(b):
        raise JqError(f"{_type(a)} and {_type(b)} cannot have their containment checked")
    if isinstance(a, dict):
        return all(k in a and _type(a[k]) == _type(x) and _contains(a[k], x) for k, x in b.items())
    if isinstance(a, list):
        return all(any(_type(x) == _type(y) and _contains(x, y) for x in a) for y in b)
    if isinstance(a, str):
        return b in a
    return _compare(a, b) == 0


_fn("inside", 1)(lambda a, b: _contains(b, a))
_fn("startswith", 1)(lambda v, s: _need(v, "string", "startswith").startswith(_need(s, "string", "startswith")))
_fn("endswith", 1)(lambda v, s: _need(v, "string", "endswith").endswith(_need(s, "string", "endswith")))
_fn("ltrimstr", 1)(lambda v, s: v.removeprefix(s) if isinstance(v, str) and isinstance(s, str) else v)
_fn("rtrimstr", 1)(lambda v, s: v.removesuffix(s) if isinstance(v, str) and isinstance(s, str) and s else v)
_fn("join", 1)(lambda v, s: s.join("" if x is None else x if isinstance(x, str) else dumps(x) for x in _need(v, "array", "join")))
_fn("split", 1)(lambda v, s: _arith("/", _need(v, "string", "split"), _need(s, "string", "split")))
_fn("setpath", 2)(lambda v, p, x: _set(v, p, lambda _: x))
_fn("delpaths", 1)(lambda v, ps: _delete(v, [tuple(p) for p in ps]))
_fn("tojson")(dumps)


@_fn("indices", 1)
def _indices(v, k):
    if v is None or k is None:
        return None
    if isinstance(v, str):
        _need(k, "string", "indices")
        return [i for i in range(len(v)) if k and v.startswith(k, i)]
    if isinstance(k, list):
        return _index(v, k)
    return [i for i, x in enumerate(v) if _compare(x, k) == 0]


_fn("index", 1)(lambda v, k: None if not (r := _indices(v, k)) else r[0])
_fn("rindex", 1)(lambda v, k: None if not (r := _indices(v, k)) else r[-1])


def _regex(r: str, flags: str | None):
    f = 0
    for c in flags or "":
        f |= {"i": re.I, "x": re.X, "s": re.S, "g": 0, "n": 0, "l": 0, "p": re.S}.get(c, 0)
    try:
        return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", r), f)
    except re.error as e:
        raise JqError(f"invalid regular expression {r!r}: {e}") from e


def _matches(v, r, flags):
    rx = _regex(r, flags)
    hits = list(rx.finditer(_need(v, "string", "match")))
    if "g" not in (flags or ""):
        hits = hits[:1]
    named = {i: n for n, i in rx.groupindex.items()}
    return [
        {"offset": m.start(), "length": m.end() - m.start(), "string": m.group(), "captures": [{"offset": m.start(i), "length": len(m[i] or ""), "string": m[i], "name": named.get(i)} for i in range(1, rx.groups + 1)]}
        for m in hits
    ]


def _flags(x):
    return (x[0], x[1] if len(x) > 1 else None) if isinstance(x, list) else (x, None)


for _n in (1, 2):
    _fn("test", _n)(lambda v, r, f=None: bool(_matches(v, _flags(r)[0], f or _flags(r)[1])))

    def _match(prog, pv, args, env, n=_n):
        for r in prog._values(args[0], pv[1], env):
            for f in prog._values(args[1], pv[1], env) if n == 2 else (None,):
                yield from ((None, m) for m in _matches(pv[1], _flags(r)[0], f or _flags(r)[1]))

    _BUILTINS[f"_match_{_n}"] = _match

    def _capture(prog, pv, args, env, run=_match):
        for _, m in run(prog, pv, args, env):
            yield None, {c["name"]: c["string"] for c in m["captures"] if c["name"]}

    _BUILTINS[f"_capture_{_n}"] = _capture

    def _scan(prog, pv, args, env, n=_n):
        for r in prog._values(args[0], pv[1], env):
            for f in prog._values(args[1], pv[1], env) if n == 2 else ("",):
                for m in _matches(pv[1], r, "g" + (f or "")):
                    yield None, [c["string"] for c in m["captures"]] if m["captures"] else m["string"]

    _BUILTINS[f"_scan_{_n}"] = _scan


def _sub(prog, pv, args, env, every=False):
    for r in prog._values(args[0], pv[1], env):
        for f in prog._values(args[2], pv[1], env) if len(args) > 2 else ("",):
            s, outs, at = _need(pv[1], "string", "sub"), [""], 0
            for m in _matches(s, r, ("g" if every else "") + (f or "")):
                names = {c["name"]: c["string"] for c in m["captures"] if c["name"]}
                outs = [o + s[at : m["offset"]] + x for x in prog._values(args[1], names, env) for o in outs]
                at = m["offset"] + m["length"]
            yield from ((None, o + s[at:]) for o in outs)


for _n in (2, 3):
    _BUILTINS[f"_sub_{_n}"] = _sub
    _BUILTINS[f"_gsub_{_n}"] = partial(_sub, every=True)


def _re_split(v, r, f):
    return re.split(re.sub(r"\((?!\?)", "(?:", r), _need(v, "string", "split"), flags=re.I if "i" in (f or "") else 0)


_fn("split", 2)(_re_split)


def _instant(v):
    import datetime as dt

    if isinstance(v, list):
        return dt.datetime(v[0], v[1] + 1, *map(int, v[2:6]), tzinfo=dt.timezone.utc)
    return dt.datetime.fromtimestamp(_need(v, "number", "date"), dt.timezone.utc)


def _broken(d) -> list:
    return [d.year, d.month - 1, d.day, d.hour, d.minute, d.second, (d.weekday() + 1) % 7, d.timetuple().tm_yday - 1]


def _strptime(v, f):
    import datetime as dt

    try:
        d = dt.datetime.strptime(_need(v, "string", "strptime"), f)
    except ValueError as e:
        raise JqError(str(e)) from e
    return _broken((d if d.tzinfo else d.replace(tzinfo=dt.timezone.utc)).astimezone(dt.timezone.utc))


_fn("gmtime")(lambda v: _broken(_instant(v)))
_fn("mktime")(lambda v: int(_instant(_need(v, "array", "mktime")).timestamp()))
_fn("strftime", 1)(lambda v, f: _instant(v).strftime(f))
_fn("strptime", 1)(_strptime)
_fn("todate")(lambda v: _instant(v).strftime("%Y-%m-%dT%H:%M:%SZ"))
_fn("fromdate")(lambda v: int(_instant(_strptime(v, "%Y-%m-%dT%H:%M:%SZ")).timestamp()))
for _a, _b in (("fromdateiso8601", "fromdate"), ("todateiso8601", "todate")):
    _BUILTINS[f"_{_a}_0"] = _BUILTINS[f"_{_b}_0"]

#: Functions that are programs themselves.
_LIBRARY = {
    ("map", ("f",)): "[.[] | f]",
    ("select", ("f",)): "if f then . else empty end",
    ("recurse", ("f",)): "def r: ., (f | r); r",
    ("values", ()): "if . == null then empty else . end",
    ("nulls", ()): "if . == null then . else empty end",
    ("strings", ()): 'if type == "string" then . else empty end',
    ("numbers", ()): 'if type == "number" then . else empty end',
    ("booleans", ()): 'if type == "boolean" then . else empty end',
    ("arrays", ()): 'if type == "array" then . else empty end',
    ("objects", ()): 'if type == "object" then . else empty end',
    ("iterables", ()): 'if type == "array" or type == "object" then . else empty end',
    ("scalars", ()): 'if type == "array" or type == "object" then empty else . end',
    ("map_values", ("f",)): ".[] |= f",
    ("to_entries", ()): "[keys[] as $k | {key: $k, value: .[$k]}]",
    ("from_entries", ()): 'reduce .[] as $e ({}; . + {($e | if has("key") then .key elif has("k") then .k elif has("name") then .name elif has("Key") then .Key else null end | if type == "string" then . elif . == null then "null" else tojson end): ($e | if has("value") then .value elif has("v") then .v else .Value end)})',
    ("with_entries", ("f",)): "to_entries | map(f) | from_entries",
    ("paths", ()): "path(..) | if length > 0 then . else empty end",
    ("paths", ("f",)): "path(.. | if f then . else empty end) | if length > 0 then . else empty end",
    ("leaf_paths", ()): "paths(scalars)",
    ("del", ("f",)): "delpaths([path(f)])",
    ("toarray", ()): 'if type == "array" then . else [.] end',
    ("any", ()): "reduce .[] as $x (false; . or $x)",
    ("all", ()): "reduce .[] as $x (true; . and $x)",
    ("any", ("f",)): "reduce (.[] | f) as $x (false; . or $x)",
    ("all", ("f",)): "reduce (.[] | f) as $x (true; . and $x)",
    ("any", ("g", "f")): "isempty(first(g | f | if . then . else empty end)) | not",
    ("all", ("g", "f")): "isempty(first(g | f | if . then empty else true end))",
    ("unique", ()): "unique_by(.)",
    ("unique_by", ("f",)): "[group_by(f)[] | .[0]]",
    ("min", ()): "sort | .[0]",
    ("max", ()): "sort | .[-1]",
    ("min_by", ("f",)): "sort_by(f) | .[0]",
    ("max_by", ("f",)): "sort_by(f) | .[-1]",
    ("add", ("f",)): "reduce f as $x (null; . + $x)",
    ("first", ()): ".[0]",
    ("last", ()): ".[-1]",
    ("last", ("f",)): "reduce f as $x (null; $x)",
    ("nth", ("$n",)): ".[$n]",
    ("nth", ("$n", "f")): "last(limit($n + 1; f))",
    ("until", ("c", "u")): "def r: if c then . else (u | r) end; r",
    ("while", ("c", "u")): "def r: if c then ., (u | r) else empty end; r",
    ("repeat", ("f",)): "def r: ., (f | r); r",
    ("range", ("$n",)): "range(0; $n)",
    ("in", ("x",)): ". as $k | x | has($k)",
    ("walk", ("f",)): 'def w: if type == "object" then map_values(w) elif type == "array" then map(w) else . end | f; w',
    ("ascii", ()): "[.] | implode",
    ("tostream", ()): "path(def r: (.[]? | r), .; r) as $p | getpath($p) | reduce path(.[]?) as $q ([$p, .]; [$p + $q])",
    ("pick", ("f",)): ". as $v | reduce path(f) as $p (null; setpath($p; $v | getpath($p)))",
    ("combinations", ()): "if length == 0 then [] else .[0][] as $x | (.[1:] | combinations) as $w | [$x] + $w end",
}
_DEFS: dict = {}
for (_name, _params), _src in _LIBRARY.items():
    _DEFS[_name, len(_params)] = (list(_params), parse(_src))


# Catalyst -----------------------------------------------------------------------------------------------------------------
class NotColumns(Exception):
    """The program needs the interpreter."""


#: Text fields of an item; absent ones are null, as they are in the interpreter.
_TEXT = frozenset("banner_image content_html content_text date_modified date_published external_url id image summary title url".split())
_FEED = frozenset(("title", "home_page_url", "feed_url"))


def _scalar(node) -> Column:
    """A text-valued column, null for null."""
    if node[0] == "index" and node[2][0] == "lit":
        if node[1] == ("id",) and node[2][1] in _TEXT:
            return F.col(node[2][1])
        if node[1] == ("index", ("id",), ("lit", "_feed")) and node[2][1] in _FEED:
            return F.col(f"_feed.{node[2][1]}")
    if node[0] == "fmtstr" and node[1] is None and all(isinstance(p, str) for p in node[2]):
        return F.lit("".join(node[2]))
    if node[0] == "alt":
        return F.coalesce(_scalar(node[1]), _scalar(node[2]))
    if node == ("lit", None):
        return F.lit(None).cast("string")
    raise NotColumns


def _test(node) -> Column:
    """A boolean column that is never null."""
    if node[0] == "bin" and node[1] in ("and", "or"):
        a, b = _test(node[2]), _test(node[3])
        return a & b if node[1] == "and" else a | b
    if node[0] == "bin" and node[1] in ("==", "!="):
        same = _scalar(node[2]).eqNullSafe(_scalar(node[3]))
        return same if node[1] == "==" else ~same
    if node[0] == "pipe" and node[2] == ("call", "not", []):
        return ~_test(node[1])
    if node[0] == "call" and node[1] == "has" and len(node[2]) == 1 and node[2][0][0] == "fmtstr" and all(isinstance(p, str) for p in node[2][0][2]):
        name = "".join(node[2][0][2])
        return F.col(name).isNotNull() if name in _TEXT | {"tags", "authors", "attachments", "_feed"} else F.lit(False)
    if node[0] == "pipe" and node[1] == ("index", ("id",), ("lit", "tags")) and node[2][0] == "call" and node[2][1] == "index" and node[2][2][0][0] == "fmtstr":
        return F.coalesce(F.array_contains("tags", _scalar(node[2][2][0])), F.lit(False))
    return _scalar(node).isNotNull()


def to_columns(src: str) -> tuple[Column, Column]:
    """(condition, JSON text) of a program that Catalyst can run; raises NotColumns."""
    node = parse(src)
    keep = F.lit(True)
    while node[0] == "pipe" and node[1][0] == "call" and node[1][1] == "select" and len(node[1][2]) == 1:
        keep = keep & _test(node[1][2][0])
        node = node[2]
    if node[0] == "call" and node[1] == "select" and len(node[2]) == 1:
        keep, node = keep & _test(node[2][0]), ("id",)
    return keep, _json(node)


def _json(node) -> Column:
    if node == ("id",):
        return F.col("__item")
    if node[0] == "object":
        keys = [k[1] if k[0] == "lit" else "".join(k[2]) if k[0] == "fmtstr" and k[1] is None and all(isinstance(p, str) for p in k[2]) else None for k, _ in node[1]]
        if None in keys or len(set(keys)) < len(keys):
            raise NotColumns
        members = sorted(((k, _json(v)) for k, (_, v) in zip(keys, node[1])), key=lambda kv: kv[0])
        parts: list[Column] = [F.lit("{")]
        for n, (k, v) in enumerate(members):
            parts += [F.lit(("," if n else "") + json.dumps(k) + ":"), v]
        return F.concat(*parts, F.lit("}"))
    if node[0] == "pipe" and node[2] == ("format", "@tsv") and node[1][0] == "array":
        cells, work = [], [node[1][1]]
        while work:
            e = work.pop()
            if e[0] == "comma":
                work += [e[2], e[1]]
            else:
                x = F.coalesce(_scalar(e), F.lit(""))
                for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                    x = F.replace(x, F.lit(a), F.lit(b))
                cells.append(x)
        return _quoted(F.concat_ws("\t", *cells))
    return F.coalesce(_quoted(_scalar(node)), F.lit("null"))


def _quoted(c: Column) -> Column:
    """A text as JSON: the writer's own escapes, taken from a one-field record."""
    inner = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substring(inner, F.lit(6), F.length(inner) - 6))


def _interpret(batches: Iterator, program: Program, keys: tuple[str, ...]) -> Iterator:
    import pyarrow as pa

    for b in batches:
        at, pos, out = [], [], []
        for i, v in enumerate(b.column("__item").to_pylist()):
            for k, x in enumerate(program.run(json.loads(v))):
                at.append(i)
                pos.append(k)
                out.append(dumps(x))
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in keys), pa.array(pos, pa.int32()), pa.array(out, pa.string())], names=[*keys, "out_pos", "value"])


def apply(rows: DataFrame, src: str, with_feed: bool = True, keys: tuple[str, ...] | None = None, columns: bool = True) -> DataFrame:
    """``keys, out_pos, value``: the program's values for each item, as JSON; ``keys`` are those of its place if not given.  ``columns=False`` forces the interpreter."""
    from feedloom.operators.feeds import item_json, position
    from feedloom.schema import ITEM_FIELDS

    keys = keys or tuple(position(rows))

    program = Program(src)
    fields = [c for c in ITEM_FIELDS if with_feed or c != "_feed"]
    kept = rows if with_feed else rows.withColumn("_feed", F.lit(None).cast(rows.schema["_feed"].dataType))
    whole = kept.withColumn("__item", item_json(kept, fields))
    if columns:
        try:
            keep, value = to_columns(src)
            return whole.where(keep).select(*keys, F.lit(0).alias("out_pos"), value.alias("value"))
        except NotColumns:
            pass
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "out_pos int", "value string"])
    return whole.select(*keys, "__item").mapInArrow(partial(_interpret, program=program, keys=keys), schema)


def raw(rows: DataFrame) -> DataFrame:
    """Strings bare, everything else as JSON."""
    text = F.from_json(F.concat(F.lit("["), F.col("value"), F.lit("]")), "array<string>")[0]
    return rows.withColumn("value", F.when(F.col("value").startswith('"'), text).otherwise(F.col("value")))
