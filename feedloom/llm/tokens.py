"""Encode a corpus with a public byte-level BPE tokenizer by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that ends the prefix's encoding (its *last token*).
Token ``t`` is the last token of ``b[:i]`` iff it is a suffix of it and the last token of ``b[:i-len(t)]`` followed
by ``t`` is encoded as just those two.  So the table of last tokens grows byte by byte: appending bytes never
changes earlier entries, an edit recomputes only from its place on, and walking back from the end gives the ids.
Texts are split into pieces by the tokenizer's own pattern first; tables of frequent pieces are kept per worker.

Defined results: null and empty texts have no ids (an empty list, never null); the strings of special tokens
are ordinary text; no special tokens are added.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabularies; a parameter everywhere, this is only the default.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids one worker keeps; past that the memo starts anew.
MEMO = 120_000


class PrefixTable:
    """Last tokens of all prefixes of one piece."""

    __slots__ = ("bpe", "data", "last")

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: entries of earlier prefixes stay as they are."""
        at = len(self.data)
        self.data += more
        self.bpe.extend(self.data, self.last, at)

    def replace(self, at: int, removed: int, inserted: bytes) -> None:
        """Entries before the edit are kept, those from it on are computed again."""
        del self.last[at:]
        self.data = self.data[:at] + inserted + self.data[at + removed :]
        self.bpe.extend(self.data, self.last, at)

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            t = self.last[i - 1]
            out.append(t)
            i -= self.bpe.size[t]
        out.reverse()
        return out


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.suffixes = {b[k:] for b in ranks for k in range(len(b))}
        self.whole: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain byte-pair merging; only for token pairs, which are short."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, t: int) -> bool:
        if (v := self.whole.get(t)) is None:
            v = self.whole[t] = self.merge(self.bytes[t]) == [t]
        return v

    def follows(self, a: int, t: int) -> bool:
        """Whether the bytes of ``a`` and ``t`` together are encoded as just these two."""
        if (v := self.pairs.get((a, t))) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            v = self.pairs[a, t] = self.merge(self.bytes[a] + self.bytes[t]) == [a, t]
        return v

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        ranks, suffixes = self.ranks, self.suffixes
        for i in range(start + 1, len(data) + 1):
            found = []
            k = 1
            while k <= i and (s := data[i - k : i]) in suffixes:
                if (t := ranks.get(s)) is not None:
                    found.append((k, t))
                k += 1
            for k, t in reversed(found):
                if self.stands(t) if k == i else self.follows(last[i - k - 1], t):
                    last.append(t)
                    break
            else:
                raise ValueError("a byte has no token")


class _Pieces(dict):
    """Ids of pieces as text; missing ones are computed."""

    def __init__(self, bpe: PrefixBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        t = self.bpe.ranks.get(data)
        ids = [t] if t is not None and self.bpe.stands(t) else PrefixTable(self.bpe, data).ids()
        if len(data) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """``vocabulary``: lines of a token in base64 and its id."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bpe = PrefixBPE(ranks)
        self.split = regex.compile(pattern).findall
        self.scan = regex.compile(pattern).finditer
        self.pieces = _Pieces(self.bpe)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))) if text else []


class EncodedText:
    """A text with its piece bounds and prefix tables: appends and edits re-encode only near the change."""

    def __init__(self, enc: Encoder, text: str = ""):
        self.enc, self.text = enc, text
        self.starts = [m.start() for m in enc.scan(text)]
        self.tables = [PrefixTable(enc.bpe, p.encode()) for p in enc.split(text)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, a: int, b: int, new: str) -> int:
        """Put ``new`` for ``text[a:b]``; returns how many pieces were encoded again."""
        import bisect

        k = max(0, bisect.bisect_right(self.starts, max(a - 1, 0)) - 2)  # the pattern looks one character ahead
        begin = self.starts[k] if self.starts else 0
        text = self.text[:a] + new + self.text[b:]
        shift, old = len(text) - len(self.text), {s: i for i, s in enumerate(self.starts)}
        starts, tables, done = self.starts[:k], self.tables[:k], 0
        rest: tuple[list[int], list[PrefixTable]] = ([], [])
        for m in self.enc.scan(text, begin):
            s = m.start()
            if s >= a + len(new) and (i := old.get(s - shift)) is not None and s - shift >= b:
                rest = [x + shift for x in self.starts[i:]], self.tables[i:]
                break
            starts.append(s)
            i = old.get(s)
            data = m.group().encode()
            if i is not None and s < a and data.startswith(self.tables[i].data):
                t = self.tables[i]  # the piece only grew: its table is continued
                t.append(data[len(t.data) :])
            else:
                t = PrefixTable(self.enc.bpe, data)
            tables.append(t)
            done += 1
        self.text, self.starts, self.tables = text, starts + rest[0], tables + rest[1]
        return done

    def ids(self) -> list[int]:
        return [t for p in self.tables for t in p.ids()]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(_read(path))


class Shipped:
    """A vocabulary on its way to the workers: read on the driver alone, so all have the same one.  A worker makes one encoder of it."""

    def __init__(self, spark: SparkSession, path: str):
        data = _read(path)
        self.digest, self.data = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    def encoder(self) -> Encoder:
        if self.digest not in _made:
            _made.clear()
            _made[self.digest] = Encoder(self.data.value)
        return _made[self.digest]


_made: dict[str, Encoder] = {}


def _ids(batches: Iterator, shipped: Shipped) -> Iterator:
    import numpy as np
    import pyarrow as pa

    enc = shipped.encoder()
    for b in batches:
        got = [enc.encode(t) for t in b.column(1).to_pylist()]
        offsets = np.zeros(len(got) + 1, np.int32)
        np.cumsum([len(x) for x in got], out=offsets[1:])
        flat = np.fromiter(chain.from_iterable(got), np.int32, int(offsets[-1]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])


def _counts(batches: Iterator, shipped: Shipped) -> Iterator:
    import pyarrow as pa

    enc = shipped.encoder()
    for b in batches:
        n = []
        for t in b.column(1).to_pylist():
            n.append(sum(map(len, map(enc.pieces.__getitem__, enc.split(t)))) if t else 0)
        rest = b.schema.names[2:]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(b.column(c) for c in rest)], names=["doc_id", "n_tokens", *rest])


def _path(folder: str | None, name: str) -> str:
    return os.path.join(folder or VOCABULARIES, name)


def encode(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: one row per document, no shuffle."""
    slim = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(partial(_ids, shipped=Shipped(docs.sparkSession, _path(folder, vocabulary))), "doc_id bigint, ids array<int>")


def count(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, doc: str = "doc_id", text: str = "text", keep: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` and a column to ``keep``; 0 for null and empty texts."""
    slim = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(keep)] if keep else []))
    more = f", `{keep}` {docs.schema[keep].dataType.simpleString()}" if keep else ""
    return slim.mapInArrow(partial(_counts, shipped=Shipped(docs.sparkSession, _path(folder, vocabulary))), "doc_id bigint, n_tokens bigint" + more)
