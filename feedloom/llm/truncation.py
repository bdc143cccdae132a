"""Text cut off by field limits or mid-transfer.

A stack automaton reads each value once: elements, brackets and quotation marks still open at its end, a broken
multibyte sequence, escape, reference or tag, a mark of omission.  What structure leaves undecided is a last phrase without
a terminator.  By the method alone (``method_judged``) the source's baseline decides it: it is cut where the source's values
seldom end without one.

A baseline of the source can't tell a heading from a cut sentence of the same source, which ``judged`` must.  It reads from
the corpus whether such a phrase is a whole (a heading, a list of links) or the start of a sentence: masked openings of phrases
are counted over all rows, by whether a terminator followed, and the longest known opening decides; where none is known,
the baseline does.  Counts and phrases meet in a join, so the table of openings is never cut nor collected, and a
verdict doesn't depend on the table's size but through the counts.

Defined results: null, empty and blank values aren't cut; a value that ends with a closing link, signature, tag or symbol is whole;
a value of one unknown phrase in a source that rarely ends with terminators is whole; a repeated row has the verdict of its like.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of openings, in tokens.
OPENINGS = (1, 2, 3, 4, 5, 6, 8, 10, 12)
#: An opening is known once it was seen this often.
LEAST_COUNT = 5
#: Share of openings with a terminator from which on a phrase must have one, and up to which it needs none.
CUT_FROM = 0.5
#: Share of a source's values without terminator up to which an unknown phrase without one is cut.
BASELINE = 0.35
#: A number before the final stop is suspect if the word before it was followed by numbers this often, and by one of this shape in at most this share.
NUMBERS, RARE = 20, 1 / 200

_TERMINAL = ".!?。！？｡؟।"
_CLOSERS = "\"'”’»“)]}」』）】›*_~`"
_TOKEN = re.compile(r"\d[\d.,:]*|[ァ-ヺー]+|[^\W\d_ぁ-んァ-ヺー一-鿿々]+(?:[’'][^\W\d_]+)*|[^\w\s]|[ぁ-ん一-鿿々_]")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»“)\]*_~`]*\s+|(?<=[。！？])[」』）]*\s*")
_OMISSION = re.compile(r"(?:…|\.\.\.+|\[(?:…|\.\.\.+)\]|\((?:…|\.\.\.+)\)|&hellip;|&#8230;)\s*(?:</[a-z0-9]+>\s*)*\Z", re.I)
_BROKEN = re.compile(r"(?:�+|(?<!\\)(?:\\\\)*\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|%[0-9A-Fa-f]{2}%[0-9A-Fa-f]?|(?:https?://\S*|%[0-9A-Fa-f]{2}\S*)%[0-9A-Fa-f]?)\Z")
_REFERENCE = re.compile(r"&(?:#[0-9xX]?[0-9A-Fa-f]*|[A-Za-z]{2,8})\Z")
_END_TAGS = re.compile(r"(?:\s*</[A-Za-z][A-Za-z0-9]*\s*>|\s*<(?:br|hr)\s*/?>)+\s*\Z", re.I)
_TAGS = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_BREAKS = re.compile(r"<(?:br|/p|/div|/li|/h[1-6]|p|div|li|h[1-6])\b[^<>]*>", re.I)
_WHOLE_END = re.compile(
    r"(?:https?://\S+"  # link
    r"|\S*</a>"
    r"|[—–-]{1,2}[  ]?(?:[^\W\d_][\w’'.-]*[  ]?){1,5}"  # signature
    r"|(?:#[\w-]+[  ]*)+"  # tags
    r"|\([^()\n]{1,60}\)|\[[^\[\]\n]{1,200}\](?:\([^()\n]*\)|\[[^\[\]\n]*\])?|\[\[[^\[\]\n]*\]\]|\{\{[^{}]*\}\}"
    r"|(?P<e>\*{1,3}|_{2,3}|~~|'{2,3}|`{1,3})[^\n]+(?P=e)"
    r"|\$[^$\n]+\$|\\\][^\n]*|\\\)|\\[A-Za-z]+\{[^{}]*\}(?:[ ]?\\?[A-Za-z]*\{[^{}]*\})*"
    r")\s*\Z"
)
_PAIRS = {"”": "“", "»": "«", "」": "「", "』": "『", "）": "（"}


def tokens(phrase: str, most: int = OPENINGS[-1] + 1) -> list[str]:
    out = []
    for m in _TOKEN.finditer(phrase):
        out.append(m.group())
        if len(out) >= most:
            break
    return out


def _fine(w: str, first: bool) -> str:
    c = w[0]
    if c.isdigit():
        return "0"
    if "ァ" <= c <= "ー":
        return "N"
    if c.isalpha() and c.isupper() and not first:
        return "N"
    return w


def _coarse(w: str, first: bool) -> str:
    f = _fine(w, False)
    return f if len(f) < 4 or first and f != "N" else "w"


def openings(toks: list[str]) -> Iterator[tuple[int, str, str]]:
    """Length, fine and coarse key of every opening of a phrase."""
    fine = [_fine(w, k == 0) for k, w in enumerate(toks)]
    coarse = [_coarse(w, False) for w in toks]
    for n in OPENINGS:
        if n > len(toks):
            return
        yield n, "f " + " ".join(fine[:n]), "c " + " ".join(coarse[:n])


def _visible(value: str) -> str:
    """Text of a value; block ends and breaks become line ends."""
    if "<" in value:
        value = _TAGS.sub("", _BREAKS.sub("\n", value))
    return value


def terminated(phrase: str) -> bool:
    t = phrase.rstrip()
    while t and t[-1] in _CLOSERS:
        t = t[:-1]
    return bool(t) and t[-1] in _TERMINAL


def phrases(value: str) -> list[tuple[str, bool, bool]]:
    """(phrase, it is the last of its line, it is the first of its line)."""
    out = []
    for line in _visible(value).split("\n"):
        parts = [p for p in _SENTENCE.split(line.strip()) if p.strip()]
        out.extend((p.strip(), k == len(parts) - 1, k == 0) for k, p in enumerate(parts))
    return out


_NUMBER_END = re.compile(r"(\w+)\s+(\d[\d.]*)\.\Z")


def _number_end(phrase: str) -> tuple[str, str] | None:
    """A phrase that ends with a number and a stop: the word before, and the number's shape."""
    if len(phrase) > 1 and phrase[-1] == "." and phrase[-2].isdigit() and (m := _NUMBER_END.search(phrase)):
        return m[1].lower(), re.sub(r"\d+", "0", m[2])
    return None


def _number_keys(word: str, shape: str) -> tuple[str, str]:
    return f"E {word}", f"e {word} {shape}"


def learn(value: str, seen: Counter, heading: bool = False) -> None:
    """Count a value's phrases: those with more text behind them, and last ones with a terminator, had one; lone lines without had none."""
    got = phrases(value)
    for k, (p, last, first) in enumerate(got):
        done = terminated(p) and not heading
        if not done and not (last and first):
            continue
        for _, f, c in openings(tokens(p)):
            seen[f, done] += 1
            seen[c, done] += 1
        if not last and (e := _number_end(p)):
            for key in _number_keys(*e):
                seen[key, True] += 1


_SIGN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)(?=[\s/>])[^<>]*>|[\"“«„「『”»」』()\[\]\n]", re.S)
#: Elements whose end tags HTML lets be left out, and those that have none.
_NO_END = frozenset("p li dt dd tr td th thead tbody tfoot colgroup option optgroup rp rt html head body area base br col embed hr img input link meta source track wbr".split())
_SMILEY = re.compile(r"[:;=8]['’]?-?[(\[]\Z")


def _open_at_end(value: str) -> tuple[bool, set[str]]:
    """Whether a tag is broken off, and what is still open: ``quote``, ``bracket``, ``element``.

    One stack over the whole value.  Quotations end with their line, brackets with their line or element; a closing sign without its
    opening one closes nothing, and a closing one of an outer pair ends the inner ones.
    """
    stack: list[str] = []
    for m in _SIGN.finditer(value):
        c = m.group()
        if name := m.group(2):
            name = "<" + name.lower()
            if m.group(1):
                if name in stack:
                    while stack.pop() != name:
                        pass
            elif name[1:] not in _NO_END and not c.endswith("/>"):
                stack.append(name)
        elif c == '"':
            # One sign opens and closes: it closes what it opened; else it opens at the start of a word, and elsewhere (inches) does nothing.
            before, after = value[m.start() - 1 : m.start()], value[m.end() : m.end() + 1]
            if c in stack and "<" not in "".join(stack[len(stack) - 1 - stack[::-1].index(c) :]):
                del stack[len(stack) - 1 - stack[::-1].index(c) :]
            elif (not before or before.isspace() or before in "([—–>") and after and not after.isspace():
                stack.append(c)
        elif c in "“«„「『":
            if c == "“" and stack and stack[-1] == "„":
                stack.pop()
            elif c == "«" and stack and stack[-1] == "»":
                stack.pop()
            else:
                stack.append(c)
        elif c in "([":
            if not _SMILEY.search(value, max(0, m.start() - 3), m.end()):
                stack.append(c)
        elif want := _PAIRS.get(c) or {")": "(", "]": "["}.get(c):
            # Not across the start of an element.
            inner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k] == want or stack[k][0] == "<"), -1)
            if inner >= 0 and stack[inner] == want:
                del stack[inner:]
        elif c == "\n":
            stack = [x for x in stack if x[0] == "<"]
    left = {"element" if x[0] == "<" else "bracket" if x in "([" else "quote" for x in stack}
    return value.rfind("<") > value.rfind(">") and bool(re.search(r"<[/!A-Za-z][^<>]*\Z", value)), left


def last_is_word(tail: str) -> bool:
    return tail[-1].isalnum() or tail[-1] in "/_.-"


#: Parts of a phrase kept for a later verdict.
_SEP = "\x1f"


def examine(value: str | None) -> tuple[str, str | None]:
    """Verdict by structure: ``cut``, ``whole``, ``closing`` (ends with a link, signature or tag that may itself be cut), or what remains to be asked:
    ``phrase`` (an unterminated one) or ``number`` (a stop after a number), with what there is to know of it."""
    if value is None or not value.strip():
        return "whole", None
    v = value.rstrip()
    if _OMISSION.search(v) or _BROKEN.search(v):
        return "cut", None
    broken, left = _open_at_end(v)
    quoting = "quote" in left
    if broken or "element" in left or (v.endswith("<") and not v.endswith(" <")):
        return "cut", None
    body = _END_TAGS.sub("", v) if v.endswith(">") else v
    lines = [x for x in _visible(body).split("\n") if x.strip()]
    parts = [p.strip() for p in _SENTENCE.split(lines[-1].strip()) if p.strip()] if lines else []
    if not parts:
        return "whole", None
    tail = parts[-1]
    if terminated(tail):
        if quoting or "bracket" in left:
            return "cut", None
        e = _number_end(tail)
        return ("number", _SEP.join(("n", *e))) if e else ("whole", None)
    if _REFERENCE.search(body):
        return "cut", None
    if _WHOLE_END.fullmatch(tail) and last_is_word(tail) and not v.endswith(">"):
        return "closing", None
    if _WHOLE_END.fullmatch(tail) or (body != v and body.endswith("</a>")) or v.endswith(("</a>", "/>", "</code>", "</pre>")):
        return "whole", None
    if not any(c.isalnum() for c in tail):
        # Only signs: an opening sign or a comma means that more was to come, any other symbol closes.
        return "cut" if tail[-1] in "“«„「『([{,;:–—-" else "whole", None
    last = tail[-1]
    if last in ",;:([{“«„「『、，；：–—-\\/@&=<|#$" or quoting:
        return "cut", None
    if not (last.isalnum() or last in _CLOSERS or last in "%°€$£№+"):
        return "whole", None
    if "bracket" in left:
        return "cut", None
    m = re.search(r"(?:https?://\S+|(?:[—–]|--)[  ](?:[A-ZÀ-ÝА-Я][\w’'-]*[  ]?){1,4}|(?:#[\w-]+[  ]*)+)\Z", tail)
    if m and m.start() and tail[: m.start()].rstrip()[-1:] in _TERMINAL:
        return "closing", None
    return "phrase", _SEP.join(("b" if len(parts) > 1 else "a", *tokens(tail)))


def questions(asked: str) -> list[tuple[int, bool, str]]:
    """Keys to look up for what ``examine`` left open: rank, whether the key is fine, and the key.  The whole phrase is among its openings, so one
    that is known as a whole decides by itself; so is the phrase without its last word, which may be a part of one."""
    kind, *rest = asked.split(_SEP)
    if kind == "n":
        return [(k + 1, True, key) for k, key in enumerate(_number_keys(*rest))]
    return [x for n, f, c in openings(rest) for x in ((n, True, f), (n, False, c))]


def _learn(batches: Iterator, fields: tuple[str, ...], headings: tuple[str, ...]) -> Iterator:
    import pyarrow as pa

    for b in batches:
        seen: Counter = Counter()
        for f in (*fields, *headings):
            for v in b.column(f).to_pylist():
                if v:
                    learn(v, seen, f in headings)
        keys = list({k for k, _ in seen})
        yield pa.RecordBatch.from_arrays(
            [_hashes(keys), pa.array([k.startswith("e ") for k in keys], pa.bool_()), pa.array([seen[k, True] for k in keys], pa.int64()), pa.array([seen[k, False] for k in keys], pa.int64())], names=["key", "rare", "yes", "no"]
        )


def _hashes(keys: list[str]):
    import numpy as np
    import pyarrow as pa
    import xxhash

    return pa.array(np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys)).view(np.int64))


def known(rows: DataFrame, fields: tuple[str, ...], headings: tuple[str, ...] = ()) -> DataFrame:
    """``key, yes, no``: openings counted over all rows, with and without a terminator behind, and numbers before one.  They combine before the shuffle."""
    counted = rows.select(*fields, *headings).mapInArrow(partial(_learn, fields=fields, headings=headings), "key bigint, rare boolean, yes bigint, no bigint")
    return counted.groupBy("key").agg(F.bool_or("rare").alias("rare"), F.sum("yes").alias("yes"), F.sum("no").alias("no")).where(F.col("rare") | (F.col("yes") + F.col("no") >= LEAST_COUNT)).drop("rare")


def _ask(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        texts = b.column(0).to_pylist()
        rows = [(i, *q) for i, t in enumerate(texts) for q in questions(t)]
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.bool_()), _hashes([r[3] for r in rows])], names=["asked", "rank", "fine", "key"])


def answers(got: DataFrame, counts: DataFrame) -> DataFrame:
    """``asked, answer``: each distinct phrase once, however many rows end with it; ``open`` where no opening of it is known."""
    asked = got.where("asked is not null").groupBy("asked").agg(F.lit(1).alias("one")).select("asked")
    hits = asked.mapInArrow(_ask, "asked string, rank int, fine boolean, key bigint").join(counts, "key", "left")
    number = F.col("asked").startswith("n")
    of = lambda rank: F.coalesce(F.sum(F.when(number & (F.col("rank") == rank), F.col("yes"))), F.lit(0))
    best = hits.groupBy("asked").agg(
        F.max_by(F.struct("yes", "no", "rank", "fine"), F.when((F.col("yes") + F.col("no") >= LEAST_COUNT) & ~number, F.struct("rank", "fine"))).alias("best"), of(1).alias("numbers"), of(2).alias("such")
    )
    share = F.col("best.yes") / (F.col("best.yes") + F.col("best.no"))
    behind = F.when(F.col("best").isNotNull() & (share < 0.05) & (F.col("best.rank") >= 4) & F.col("best.fine"), "whole").otherwise("cut")
    alone = F.when(F.col("best").isNull(), "open").when(share >= CUT_FROM, "cut").otherwise("whole")
    stop = F.when((F.col("numbers") >= NUMBERS) & (F.col("such") <= F.col("numbers") * RARE), "cut").otherwise("whole")
    return best.select("asked", F.when(number, stop).when(F.col("asked").startswith("b"), behind).otherwise(alone).alias("answer"))


def _examine(batches: Iterator, keep: str, scope: str, fields: tuple[str, ...]) -> Iterator:
    import pyarrow as pa

    for b in batches:
        ids, scopes = b.column(keep), b.column(scope)
        for f in fields:
            texts = b.column(f).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            take = pa.array(at, pa.int64())
            said = [examine(texts[i]) for i in at]
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), scopes.take(take), pa.array([f] * len(at), pa.string()), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.string()), pa.array([terminated(_END_TAGS.sub("", texts[i])) for i in at], pa.bool_()), pa.array([len(texts[i]) for i in at], pa.int64())],
                names=[keep, scope, "field", "verdict", "asked", "stopped", "size"],
            )


def examined(rows: DataFrame, row_id: str, fields: tuple[str, ...], scope: str = "feed_idx") -> DataFrame:
    """``row_id, scope, field, verdict, asked, stopped, size`` of every value that isn't blank: what the automaton says of it.  Written once."""
    from feedloom.session import materialize

    a, b = rows.schema[row_id].dataType.simpleString(), rows.schema[scope].dataType.simpleString()
    got = rows.select(row_id, scope, *fields).mapInArrow(partial(_examine, keep=row_id, scope=scope, fields=fields), f"`{row_id}` {a}, `{scope}` {b}, field string, verdict string, asked string, stopped boolean, size bigint")
    return materialize(got, "verdicts")


def _settled(got: DataFrame, row_id: str, scope: str) -> DataFrame:
    """``truncated`` for all verdicts: ``open`` by the source's baseline, ``closing`` by the field's limits."""
    base = got.groupBy(F.col(scope).alias("__s"), F.col("field").alias("__f")).agg((F.count_if(~F.col("stopped")) / F.count("*")).alias("bare"))
    unsure = got.where("verdict = 'open'").join(base, F.col(scope).eqNullSafe(F.col("__s")) & (F.col("field") == F.col("__f")), "left").select(row_id, scope, "field", (F.col("bare") <= BASELINE).alias("truncated"))
    # A link or signature at the end is cut only if the value has just the length at which this field is cut.
    limit = limits(got).select(F.col("field").alias("__f"), F.col("size").alias("__n"), F.lit(True).alias("at_limit"))
    closing = got.where("verdict = 'closing'").join(limit, (F.col("field") == F.col("__f")) & (F.col("size") == F.col("__n")), "left").select(row_id, scope, "field", F.coalesce("at_limit", F.lit(False)).alias("truncated"))
    clear = got.where("verdict in ('cut', 'whole')").select(row_id, scope, "field", (F.col("verdict") == "cut").alias("truncated"))
    return clear.unionByName(unsure).unionByName(closing)


def method_judged(rows: DataFrame, row_id: str, fields: tuple[str, ...], scope: str = "feed_idx") -> DataFrame:
    """``row_id, scope, field, truncated`` by the automaton and the source's baseline alone."""
    got = examined(rows, row_id, fields, scope)
    plain = F.when(F.col("verdict") == "number", "whole").when(F.col("verdict") == "phrase", "open").otherwise(F.col("verdict"))
    return _settled(got.withColumn("verdict", plain).drop("asked"), row_id, scope)


def judged(rows: DataFrame, row_id: str, fields: tuple[str, ...], scope: str = "feed_idx", headings: tuple[str, ...] = ("title",)) -> DataFrame:
    """``row_id, scope, field, truncated`` for every value that isn't blank."""
    from feedloom.session import materialize

    got = examined(rows, row_id, fields, scope)
    said = materialize(answers(got, known(rows, fields, headings)), "phrases")
    return _settled(got.join(said, "asked", "left").withColumn("verdict", F.coalesce("answer", "verdict")).drop("asked", "answer"), row_id, scope)


def limits(got: DataFrame) -> DataFrame:
    """``field, size``: lengths at which most values of a field are cut, so they are a limit of the field."""
    return got.groupBy("field", "size").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "cut").alias("cut")).where((F.col("cut") >= LEAST_COUNT) & (F.col("cut") * 2 >= F.col("n"))).select("field", "size", "cut", "n")


def rates(verdicts: DataFrame, scope: str = "feed_idx") -> DataFrame:
    """How often each source truncates each field."""
    return verdicts.groupBy(scope, "field").agg(F.count("*").alias("texts"), F.count_if("truncated").alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))
