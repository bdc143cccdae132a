"""Text decoded with the wrong character encoding: find it and restore it where possible.

A smoothed character bigram model is trained on all clean records (counts are made in Spark).  Every word
with characters beyond ASCII is scored as it stands and through every candidate chain: encode with a code page, decode
as UTF-8 or with another code page, up to three times over.  The likeliest chain is accepted if its mean log
likelihood exceeds that of the word by a margin.  For the margin the records are parted into folds: the words of each are
judged by counts of the others, so that every word of every record is judged once by a model that hasn't counted its record.
The margin is the least one at which no more than ``FALSE_RATE`` of all these clean words change.  The same words, each garbled
by one chain, which its hash picks, tell how many are then found and how many restored (``validated``); training fails if too few of
those garbled through UTF-8 are found, and the others are tried only where they are to be reported.

Defined results: null and empty values aren't garbled; characters lost to U+FFFD and C1 control characters are garbled
and can't be restored on their own; numeric character references are read as the characters they name; text whose
chain isn't certain is left as it is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bigrams below this share of all counted ones are left to smoothing, so the model has at most 1 / LEAST_SHARE entries.
LEAST_SHARE = 1e-6
#: Folds of records; each is held out of the counts that judge its words.
HELD_OUT = 16
#: Words that one task judges.
AT_ONCE = 2500
#: Rate of clean words changed that validation allows, and the least margin whatever it finds.
FALSE_RATE, LEAST_MARGIN = 1e-4, 0.8
#: Share of held-out words garbled through UTF-8 that must be found, where there are ``ENOUGH`` to tell.
LEAST_RECALL, ENOUGH = 0.9, 1000
DEPTH = 3
#: All of a word beyond ASCII being valid UTF-8, with three characters or more, is evidence of its own: by chance that is rare.
#: Validation takes it into account.
VALID_UTF8 = 5.0
#: How much likelier a word's own chain must be than the chain of its value.
SLACK = 1.0

# Code pages that text is wrongly decoded with, and encodings it was really in.
WRONG = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp866", "koi8_r", "iso8859_2", "cp1254", "cp1253")
TRUE = ("cp1251", "shift_jis", "euc_jp", "koi8_r", "cp866", "cp1252", "cp1250", "mac_roman", "gb18030", "euc_kr")


@lru_cache(maxsize=None)
def _page(name: str) -> dict[int, int]:
    """Character to byte; undefined bytes stand for the control characters of the same number, as browsers have it."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out[ord(c)] = b
    for b in range(128, 160):
        out.setdefault(b, b)  # a text may mix a code page with plain Latin-1
    return out


@lru_cache(maxsize=None)
def _bytes(page: str) -> tuple[frozenset[str], dict[int, int]]:
    """Characters that have a byte, and the byte of each beyond ASCII."""
    table = _page(page) if page != "cp1252" else {o: o for o in range(128, 256)} | _page(page)
    return frozenset(map(chr, (*range(128), *table))), table


def _encode(text: str, page: str) -> bytes | None:
    known, table = _bytes(page)
    return text.translate(table).encode("latin-1") if known.issuperset(text) else None


@lru_cache(maxsize=None)
def _utf8_pattern(page: str) -> tuple[re.Pattern, dict[int, int]]:
    """Runs of characters that the code page makes of UTF-8 sequences."""
    table = dict(_page(page))
    if page == "cp1252":
        table |= {o: o for o in range(128, 256) if o not in table}
    by: dict[str, list[str]] = {"l2": [], "l3": [], "l4": [], "c": []}
    for o, b in table.items():
        kind = "c" if b < 0xC0 else "l2" if 0xC2 <= b < 0xE0 else "l3" if 0xE0 <= b < 0xF0 else "l4" if 0xF0 <= b < 0xF5 else None
        if kind:
            by[kind].append(re.escape(chr(o)))
    l2, l3, l4, c = ("[" + "".join(by[k]) + "]" for k in ("l2", "l3", "l4", "c"))
    return re.compile(f"(?:{l2}{c}|{l3}{c}{c}|{l4}{c}{c}{c})+"), table


def _as_utf8(word: str, page: str) -> str | None:
    pattern, table = _utf8_pattern(page)

    def back(m: re.Match) -> str:
        try:
            return m.group().translate(table).encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    out = pattern.sub(back, word)
    return out if out != word else None


def _whole(word: str, page: str) -> bool:
    """Whether valid sequences make up all characters beyond ASCII."""
    rest = _utf8_pattern(page)[0].sub("", word)
    return rest.isascii() and sum(c > "\x7f" for c in word) >= 3


def _decoded(raw: bytes) -> Iterator[tuple[str, str]]:
    for true in TRUE:
        try:
            yield true, raw.decode(true)
        except UnicodeDecodeError:
            continue


class _Seen(dict):
    """A model's pairs of characters, as they are met."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, key: tuple[str, str]) -> float:
        out = self[key] = self.model.pair(ord(key[0]), ord(key[1]))
        return out

    def __reduce__(self):
        return _Seen, (self.model,)


class Model:
    """log p(character | the one before), over pairs with a character beyond ASCII; unseen pairs get a floor by the first's count."""

    def __init__(self, pairs: dict[int, int]):
        first: dict[int, int] = {}
        second: dict[int, int] = {}
        total = 0
        for k, n in pairs.items():
            first[k >> 21] = first.get(k >> 21, 0) + n
            second[k & 0x1FFFFF] = second.get(k & 0x1FFFFF, 0) + n
            total += n
        self.logs = {k: math.log(0.9 * n / first[k >> 21] + 0.1 * second[k & 0x1FFFFF] / total) for k, n in pairs.items()}
        self.back = {c: math.log(0.1 * n / total) - 1.0 for c, n in second.items()}
        block: dict[int, int] = {}
        for c, n in second.items():
            block[c >> 7] = block.get(c >> 7, 0) + n
        #: A character that was never seen is as likely as one of its block.
        self.block = {k: math.log(0.1 * n / total / 128) - 1.0 for k, n in block.items()}
        self.unseen = math.log(0.1 / max(total, 10)) - 3.0
        self.margin = LEAST_MARGIN
        self.memo: dict[str, tuple[bool, str]] = {}
        self.seen = _Seen(self)

    def pair(self, a: int, z: int) -> float:
        """What a pair adds to a score; 0 only if it doesn't count."""
        if a < 128 and z < 128:
            return 0.0
        x = self.logs.get(a << 21 | z)
        if x is None:
            x = self.back[z] if z in self.back else self.block.get(z >> 7, self.unseen)
        return min(x, -1e-300)

    def score(self, word: str) -> float:
        """Mean over the pairs that count; words between spaces.  0 for plain ASCII."""
        if len(self.seen) > 200_000:
            self.seen.clear()
        t = f" {word} "
        got = list(map(self.seen.__getitem__, zip(t, t[1:])))
        n = len(got) - got.count(0.0)
        return sum(got) / n if n else -2.5

    def candidates(self, word: str) -> Iterator[tuple[str, str]]:
        for page in WRONG:
            if (c := _as_utf8(word, page)) is not None:
                yield f"{page}>utf_8", c
        if sum(ch > "\x7f" for ch in word) >= 3:
            made: dict[bytes, list[tuple[str, str]]] = {}
            for page in WRONG:
                raw = _encode(word, page)
                if raw is None:
                    continue
                if raw not in made:
                    made[raw] = list(_decoded(raw))
                for true, c in made[raw]:
                    if true != page and c != word:
                        yield f"{page}>{true}", c

    def best(self, word: str, depth: int = DEPTH) -> tuple[float, str, str] | None:
        """Gain, chain and text of the likeliest chain; a chain may be followed by others where the first decoded UTF-8."""
        own = self.score(word)
        top = None
        scores: dict[str, float] = {}  # many chains give the same text
        further: dict[str, tuple[float, str, str] | None] = {}
        for chain, c in self.candidates(word):
            utf8 = chain.endswith("utf_8")
            if not utf8 and _C1.search(c):
                continue
            if c not in scores:
                scores[c] = self.score(c)
            gain = scores[c] - own
            if utf8 and _whole(word, chain.partition(">")[0]):
                gain += VALID_UTF8
            if depth > 1 and utf8 and not c.isascii():
                if c not in further:
                    further[c] = self.best(c, depth - 1)
                if (more := further[c]) and more[0] > self.margin:
                    gain, chain, c = gain + more[0], f"{chain},{more[1]}", more[2]
            if top is None or gain > top[0]:
                top = (gain, chain, c)
        return top

    def repair(self, word: str) -> tuple[bool, str, str]:
        """Whether a word is garbled, its restored form, and the chain."""
        if (got := self.memo.get(word)) is not None:
            return got
        plain, garbled, chain = word, "�" in word, ""
        if "&#" in word:
            plain = re.sub(r"&#(x[0-9A-Fa-f]{2,5}|[0-9]{3,6});", _named, word)
        if not plain.isascii() and (top := self.best(plain)) and top[0] > self.margin:
            chain, plain, garbled = top[1], top[2], True
        if not garbled and any("\x80" <= c <= "\x9f" for c in plain):
            garbled = True
        out = (garbled, plain if garbled else word, chain)
        if len(word) <= 400:
            if len(self.memo) > 60_000:
                self.memo.clear()
            self.memo[word] = out
        return out

    def through(self, word: str, chain: str) -> str | None:
        """A word through one given chain."""
        c: str | None = re.sub(r"&#(x[0-9A-Fa-f]{2,5}|[0-9]{3,6});", _named, word)
        for step in chain.split(","):
            wrong, true = step.split(">")
            if true == "utf_8":
                c = _as_utf8(c, wrong)
            else:
                raw = _encode(c, wrong)
                try:
                    c = raw.decode(true) if raw is not None else None
                except UnicodeDecodeError:
                    c = None
            if c is None:
                return None
        return c


def _named(m: re.Match) -> str:
    n = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
    return chr(n) if 128 <= n < 0x110000 and not 0xD800 <= n < 0xE000 else m.group()


_C1 = re.compile("[\x80-\x9f]")
_WORD = re.compile(r"[^ \t\r\n<>]+")
_ODD = re.compile(r"[^\x00-\x7f]|&#")


def words(text: str) -> list[str]:
    """Words with something beyond ASCII."""
    return [w for w in _WORD.findall(text) if not w.isascii() or "&#" in w]


def check(text: str | None, model: Model) -> bool:
    return bool(text) and _ODD.search(text) is not None and any(model.repair(w)[0] for w in words(text))


def restore(text: str | None, model: Model) -> str | None:
    """Words are restored through the chain that most of the value's garbled words have, where it fits; else through their own."""
    if not text or not _ODD.search(text):
        return text
    seen: dict[str, int] = {}
    for w in words(text):
        if chain := model.repair(w)[2]:
            seen[chain] = seen.get(chain, 0) + 1
    main = max(sorted(seen), key=seen.__getitem__) if seen else ""

    def one(m: re.Match) -> str:
        w = m.group()
        if w.isascii() and "&#" not in w:
            return w
        bad, new, chain = model.repair(w)
        if main and chain != main and (bad or not main.endswith("utf_8")):
            c = model.through(w, main)
            if c is not None and model.score(c) > (model.score(new) - SLACK if bad else model.score(w)) and (not main.endswith("utf_8") or _utf8_pattern(main.partition(">")[0])[0].sub("", w).isascii()):
                return c
        return new

    return _WORD.sub(one, text)


# Spark ----------------------------------------------------------------------------------------------------------
def _pairs(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        for k in range(0, b.num_rows, 500):
            part = b.slice(k, 500)
            kept = [(f, t) for f, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t and not t.isascii() and "�" not in t]
            if not kept:
                continue
            c = np.frombuffer((" " + " ".join(t for _, t in kept) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            c = np.where((c == 10) | (c == 9) | (c == 13) | (c == 60) | (c == 62), 32, c)
            a, z = c[:-1], c[1:]
            fold = np.repeat(np.array([f for f, _ in kept], np.int64), [len(t) + 1 for _, t in kept])
            keys, n = np.unique((fold << 42 | a << 21 | z)[(a > 127) | (z > 127)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> 42).astype(np.int32)), pa.array(keys & (1 << 42) - 1), pa.array(n.astype(np.int64))], names=["fold", "pair", "n"])


def _clean_words(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        out: set[tuple[int, str]] = set()
        for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t and "�" not in t:
                out.update((f, w) for w in words(t))
        folds, found_ = zip(*sorted(out)) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int32()), pa.array(found_, pa.string())], names=["fold", "word"])


def garble(word: str, true: str, wrong: str) -> str | None:
    """What a reader sees who takes ``true`` for ``wrong``."""
    try:
        raw = word.encode(true)
    except UnicodeEncodeError:
        return None
    back = {b: chr(o) for o, b in reversed(_page(wrong).items())}
    return "".join(chr(x) if x < 128 else back.get(x, chr(x)) for x in raw)


#: Every chain that text can have gone through, UTF-8 first.
CHAINS = tuple(("utf-8", w) for w in WRONG) + tuple((t, w) for t in TRUE for w in WRONG if t != w)


def _trial(batches: Iterator, model, others: bool) -> Iterator:
    """Gains of clean words (``utf8`` is null), and of each garbled by one chain, which its hash picks among those that can be undone.

    Words whose chain doesn't begin with UTF-8 are garbled only if ``others``."""
    import pyarrow as pa
    import xxhash

    m = model.value
    for b in batches:
        utf8, gain, right = [], [], []
        for w in b.column(0).to_pylist():
            at = xxhash.xxh64_intdigest(w)
            turn = ((t, g) for k in range(len(CHAINS)) for t, x in (CHAINS[(at + k) % len(CHAINS)],) if (g := garble(w, t, x)) not in (None, w))
            for kind, text in ((None, w), *((t == "utf-8", g) for t, g in [next(turn, (None, None))] if g and (others or t == "utf-8"))):
                top = m.best(text)
                utf8.append(kind)
                gain.append(top[0] if top else None)
                right.append(bool(top) and top[2] == w)
        yield pa.RecordBatch.from_arrays([pa.array(utf8, pa.bool_()), pa.array(gain, pa.float64()), pa.array(right, pa.bool_())], names=["utf8", "gain", "right"])


@dataclass
class Tally:
    """Counts of the pairs by fold (a row for each pair), and of all pairs, rare ones included."""

    pairs: np.ndarray
    n: np.ndarray
    total: np.ndarray

    def model(self, out: int | None = None) -> Model:
        """Of all folds, or of all but one."""
        rest = [f for f in range(HELD_OUT) if f != out]
        n = self.n[:, rest].sum(axis=1)
        kept = n >= _floor(int(self.total[rest].sum()))
        return Model(dict(zip(self.pairs[kept].tolist(), n[kept].tolist())))


def _floor(total: int) -> int:
    return max(2, int(total * LEAST_SHARE))


def _tallied(clean: DataFrame) -> Tally:
    """Of ``fold, text``.  Only pairs that some model has reach the driver."""
    from feedloom.session import materialize

    counted = materialize(clean.mapInArrow(_pairs, "fold int, pair bigint, n bigint").groupBy("fold", "pair").agg(F.sum("n").alias("n")), "bigrams")
    by = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(HELD_OUT)]
    total = np.array([n or 0 for n in counted.agg(*by).first()], np.int64)
    every = sum(F.col(f"n{f}") for f in range(HELD_OUT))
    had = reduce(lambda x, y: x | y, (every - F.col(f"n{f}") >= _floor(int(total.sum() - total[f])) for f in range(HELD_OUT)), every >= _floor(int(total.sum())))
    got = counted.groupBy("pair").agg(*by).where(had).toArrow()
    return Tally(got.column("pair").to_numpy(), np.stack([got.column(f"n{f}").to_numpy() for f in range(HELD_OUT)], axis=1), total)


def _folds(clean: DataFrame, text: str, row_id: str) -> DataFrame:
    """``fold, text``; a record's hash is its fold."""
    return clean.select(F.pmod(F.xxhash64(row_id), F.lit(HELD_OUT)).cast("int").alias("fold"), F.col(text).alias("text"))


def _tried(clean: DataFrame, tally: Tally, folds: range, others: bool) -> DataFrame:
    """Gains of every word of the given folds, each by the model without its fold; a task has one of these models."""
    from feedloom.session import materialize

    spark = clean.sparkSession
    held = materialize(clean.where(F.col("fold").isin(*folds)).mapInArrow(_clean_words, "fold int, word string").distinct(), "words", "fold")
    n = {r.fold: r["count"] for r in held.groupBy("fold").count().collect()}
    parts = []
    for f in folds:
        bc = spark.sparkContext.broadcast(tally.model(f))
        # two partitions or more: a union puts single ones together, and one task would then have all models
        own = held.where(F.col("fold") == f).select("word").repartition(max(2, math.ceil(n.get(f, 0) / AT_ONCE)), "word")
        parts.append(own.mapInArrow(partial(_trial, model=bc, others=others), "utf8 boolean, gain double, right boolean"))
    return materialize(reduce(DataFrame.unionAll, parts), "gains")


def validated(model: Model, tried: DataFrame, others: bool) -> dict:
    """Sets the model's margin from the gains of held-out words, and reports both rates.  Of the gains only the share ``FALSE_RATE`` meets in one task."""
    clean, bad = tried.where("utf8 is null"), tried.where("utf8 is not null")
    words_ = clean.count()
    least = clean.where("gain is not null").orderBy(F.desc("gain")).limit(int(words_ * FALSE_RATE) + 1).agg(F.min("gain")).first()[0]
    if least is not None:
        model.margin = max(LEAST_MARGIN, least + 0.1)
    hit = F.coalesce(F.col("gain") > model.margin, F.lit(False))
    report = {"words": words_, "margin": model.margin, "false_rate": clean.where(hit).count() / words_ if words_ else 0.0}
    got = {r.utf8: r for r in bad.groupBy("utf8").agg(F.count("*").alias("n"), F.count_if(hit).alias("found"), F.count_if(hit & F.col("right")).alias("restored")).collect()}
    for name, r in (("utf8", got.get(True)), ("other", got.get(False)))[: 1 + others]:
        report |= {f"garbled_{name}": r.n if r else 0, f"found_{name}": r.found / r.n if r else 1.0, f"restored_{name}": r.restored / r.n if r else 1.0}
    if report["garbled_utf8"] >= ENOUGH and report["found_utf8"] < LEAST_RECALL:
        raise ValueError(f"the clean records don't tell garbled words from others: {report}")
    return report


def train_whole(clean: DataFrame, text: str, row_id: str, others: bool = False) -> tuple[Model, dict]:
    """Model of all clean records, its margin from every word of theirs, and the report.  No word is judged by counts of its own fold."""
    rows = _folds(clean, text, row_id)
    tally = _tallied(rows)
    model = tally.model()
    return model, validated(model, _tried(rows, tally, range(HELD_OUT), others), others)


def train(clean: DataFrame, text: str, row_id: str) -> tuple[Model, dict]:
    """The same of one fold alone: the model without fold 0, its margin from the words of that fold, and the report."""
    rows = _folds(clean, text, row_id)
    tally = _tallied(rows)
    model = tally.model(0)
    return model, validated(model, _tried(rows, tally, range(1), True), True)


def _found(batches: Iterator, model, keep: str, fields: tuple[str, ...]) -> Iterator:
    import pyarrow as pa

    m = model.value
    for b in batches:
        ids = b.column(keep).to_pylist()
        for f in fields:
            bad = [i for i, t in zip(ids, b.column(f).to_pylist()) if check(t, m)]
            yield pa.RecordBatch.from_arrays([pa.array(bad, b.column(keep).type), pa.array([f] * len(bad), pa.string())], names=[keep, "field"])


def _restored(batches: Iterator, model, keep: str, fields: tuple[str, ...]) -> Iterator:
    import pyarrow as pa

    m = model.value
    for b in batches:
        ids = b.column(keep).to_pylist()
        for f in fields:
            row, new, full = [], [], []
            for i, t in zip(ids, b.column(f).to_pylist()):
                if check(t, m):
                    r = restore(t, m)
                    row.append(i)
                    new.append(r)
                    full.append("�" not in r and not any("\x80" <= c <= "\x9f" for c in r) and r != t)
            yield pa.RecordBatch.from_arrays([pa.array(row, b.column(keep).type), pa.array([f] * len(row), pa.string()), pa.array(new, pa.string()), pa.array(full, pa.bool_())], names=[keep, "field", "restored", "complete"])


def found(rows: DataFrame, row_id: str, fields: tuple[str, ...], model: Model) -> DataFrame:
    """``row_id, field`` of every value with garbled text."""
    bc = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema[row_id].dataType.simpleString()
    return rows.select(row_id, *fields).mapInArrow(partial(_found, model=bc, keep=row_id, fields=fields), f"`{row_id}` {kind}, field string")


def restored(rows: DataFrame, row_id: str, fields: tuple[str, ...], model: Model) -> DataFrame:
    """The same with the restored text, and whether nothing garbled is left in it."""
    bc = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema[row_id].dataType.simpleString()
    return rows.select(row_id, *fields).mapInArrow(partial(_restored, model=bc, keep=row_id, fields=fields), f"`{row_id}` {kind}, field string, restored string, complete boolean")
