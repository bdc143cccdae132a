"""MinHash banding over word shingles: five words, similarity 0.8 or more.

Signatures are computed for a whole Arrow batch at once.  Colliding texts are linked to one representative of
their bucket, so a bucket with a third of all rows gives as many links as rows; each link is verified by exact Jaccard
similarity.  Members of a bucket that holds texts unlike its representative are compared with each other as well, in
blocks; buckets with the same members are compared once.  Classes are the connected components of the verified links.

A text of fewer than four different shingles is similar to another only if their shingles are the same: one shingle more
would leave at most three of four in common.  It gets one bucket, by all its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import materialize

WORDS, SIMILARITY = 5, 0.8
#: Bands and hashes per band: a pair of similarity 0.8 collides with probability 1 - (1 - 0.8^4)^12 > 0.998.
BANDS, ROWS = 12, 4
#: Bits of the filter of buckets, whatever the table's size (8 MB).  Where it is too small it lets more pass, never less.
FILTER_BITS = 1 << 26

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_words = _WordHash()


def shingle_hashes(word_lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles' hashes, and where each list's begin.  A list shorter than five words is one shingle."""
    sizes = np.fromiter((len(w) for w in word_lists), np.int64, len(word_lists))
    flat = np.fromiter((h for ws in word_lists for h in map(_words.__getitem__, ws)), np.uint64, int(sizes.sum()))
    # Pad every list to WORDS so that short ones have one shingle.
    room = np.maximum(sizes, WORDS)
    starts = np.concatenate([[0], np.cumsum(room)])
    padded = np.zeros(int(starts[-1]), np.uint64)
    if len(flat):
        own = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        padded[np.arange(len(flat)) + own] = flat
    if not len(padded):
        return padded, starts[:-1]
    acc = np.zeros(len(padded), np.uint64)  # wraps around on purpose
    for k in range(WORDS):
        shifted = np.zeros(len(padded), np.uint64)
        shifted[: len(padded) - k] = padded[k:]
        acc = _scramble(acc * np.uint64(31) + shifted + np.uint64(int(_MIX) * (k + 1) % 2**64))
    counts = room - WORDS + 1
    at = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
    return acc[at], np.concatenate([[0], np.cumsum(counts)[:-1]])


def _bands(h: np.ndarray, starts: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((n, bands), np.int64)
    if not n:
        return out
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(n, b, np.uint64)
            for r in range(rows):
                # Shingle hashes are scattered already, so one multiplication by an odd number makes an order of its own.
                seed = (b * rows + r + 1) * 0x632BE59BD9B4E019 % 2**64
                key = _scramble(key * np.uint64(31) + np.minimum.reduceat((h ^ np.uint64(seed)) * np.uint64(seed * 0xD1342543DE82EF95 % 2**64 | 1), starts))
            out[:, b] = key.view(np.int64)
    return out


def band_keys(word_lists: list[list[str]], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """int64 [texts, bands]."""
    return _bands(*(shingle_hashes(word_lists) if word_lists else (np.zeros(0, np.uint64), np.zeros(0, np.int64))), len(word_lists), bands, rows)


def bucket_lists(word_lists: list[list[str]], bands: int = BANDS, rows: int = ROWS):
    """Arrow list array: the buckets of every text; a bucket's number tells its band."""
    import pyarrow as pa

    n = len(word_lists)
    h, starts = shingle_hashes(word_lists) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keys = _bands(h, starts, n, bands, rows)
    counts = np.diff(np.append(starts, len(h)))
    # Four shingles or more can be fewer different ones only where words recur.
    odd = [k for k in np.flatnonzero(counts >= 4).tolist() if len(set(word_lists[k])) < 8]
    few = counts < 4
    few[odd] = [len(np.unique(h[starts[k] : starts[k] + counts[k]])) < 4 for k in odd]
    for k in np.flatnonzero(few).tolist():
        own = np.unique(h[starts[k] : starts[k] + counts[k]])
        keys[k, 0] = np.bitwise_xor.reduce(_scramble(own + np.uint64(len(own)))).view(np.int64)
    sizes = np.where(few, 1, bands)
    take = np.arange(bands)[None, :] < sizes[:, None]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys[take]))


def shingles(text: str) -> set:
    w = text.split()
    return set(zip(*(w[k:] for k in range(WORDS)))) if len(w) >= WORDS else {tuple(w)}


def similarity(x: set, y: set) -> float:
    same = len(x & y)
    return same / (len(x) + len(y) - same)


def alike(x: set, y: set) -> bool:
    """Whether two sets of shingles reach SIMILARITY; sizes too far apart can't."""
    a, b = len(x), len(y)
    return min(a, b) >= SIMILARITY * max(a, b) - 1e-9 and similarity(x, y) >= SIMILARITY


def jaccard(a: str, b: str) -> float:
    return similarity(shingles(a), shingles(b))


def _verify(batches: Iterator) -> Iterator:
    import pyarrow as pa

    last, own = None, set()  # a bucket's members come with the same representative
    for b in batches:
        ok = []
        for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist()):
            if y != last:
                last, own = y, shingles(y or "")
            ok.append(x is not None and y is not None and alike(shingles(x), own))
        yield b.select(["scope", "a", "b"]).append_column("ok", pa.array(ok, pa.bool_()))


def bucket_filter(buckets: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bits set for the buckets of a table; at most ``bits`` / 64 words reach the driver."""
    words = buckets.select(F.shiftright("bucket", 6).bitwiseAND(F.lit(bits // 64 - 1)).cast("int").alias("w"), F.expr("shiftleft(1L, cast(bucket & 63 as int))").alias("bit"))
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out


def _passing(batches: Iterator, words) -> Iterator:
    import pyarrow as pa

    known = words.value
    for b in batches:
        lists = b.column("buckets")
        flat = lists.flatten().to_numpy()
        hit = (known[(flat >> 6) & (len(known) - 1)] >> (flat & 63)) & 1 == 1
        keys = np.repeat(b.column("key").to_numpy(), lists.value_lengths().to_numpy())[hit]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(flat[hit])], names=["key", "bucket"])


def members(found: DataFrame) -> DataFrame:
    """``key, bucket`` of all buckets with more than one key, without repetitions; written once.  ``found``: ``key, buckets``.

    Most buckets have one key.  A bucket's least and greatest key are found first, in an aggregation that combines before its shuffle; a filter of those
    that differ then keeps nearly all other rows from travelling once more.  An exact join follows.
    """
    rows = found.select("key", F.explode("buckets").alias("bucket"))
    mixed = materialize(rows.groupBy("bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("bucket"), "mixed-buckets")
    words = found.sparkSession.sparkContext.broadcast(bucket_filter(mixed))
    passing = found.select("key", "buckets").mapInArrow(partial(_passing, words=words), "key bigint, bucket bigint").groupBy("key", "bucket").agg(F.lit(1).alias("one")).drop("one")
    return materialize(passing.join(mixed, "bucket", "left_semi").select("key", "bucket"), "bucket-members")


#: Texts up to which a block is compared pair by pair, without an index.
SMALL = 24
#: Texts and characters of a block; the blocks of a bucket meet two at a time, so a task holds at most twice as much.
BLOCK, BLOCK_CHARS = 4096, 1 << 22


def block_links(texts: list[str], near: list[bool], part: list[int]) -> list[tuple[int, int]]:
    """Pairs of places that connect just what all pairs of SIMILARITY connect.

    ``near``: texts known to be connected with each other.  Texts of equal ``part`` meet only if all parts are equal.  Prefix
    filter, rarest shingles first: of two similar texts, the first shingles of the shorter and of the longer have one in common.
    """
    root = list(range(len(texts)))
    known = [k for k, x in enumerate(near) if x]
    for k in known:
        root[k] = known[0]

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    across, out = len(set(part)) > 1, []
    if len(texts) <= SMALL:
        small = [shingles(t) for t in texts]
        for x in range(len(texts)):
            for y in range(x):
                if find(x) != find(y) and not (across and part[x] == part[y]) and alike(small[x], small[y]):
                    out.append((x, y))
                    root[find(x)] = find(y)
        return out
    hashes, starts = shingle_hashes([t.split() for t in texts])
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    sets = [np.unique(x) for x in np.split(rank[inverse], starts[1:])]
    index: dict[int, dict[int, list[int]]] = {}
    for x in sorted(range(len(texts)), key=lambda k: len(sets[k])):
        n, tried = len(sets[x]), set()
        firsts = sets[x].tolist()
        for t in firsts[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]:
            for r, ys in index.get(t, {}).items():
                for y in ys:
                    if find(r) == find(x):
                        break
                    if y not in tried and len(sets[y]) >= SIMILARITY * n - 1e-9 and not (across and part[x] == part[y]):
                        tried.add(y)
                        if jaccard(texts[x], texts[y]) >= SIMILARITY:
                            out.append((x, y))
                            root[find(x)] = find(y)
        for t in firsts[: n - int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * n - 1e-9)) + 1]:
            index.setdefault(t, {}).setdefault(find(x), []).append(x)
    return out


def _settle(batches: Iterator) -> Iterator:
    """Links of the members of each pair of blocks; rows come sorted by it, so one pair at a time is held, and small ones cost no call of their own."""
    from itertools import groupby

    import pyarrow as pa

    kind = None

    def rows():
        nonlocal kind
        for b in batches:
            kind = b.schema.field("scope").type
            yield from zip(*(b.column(c).to_pylist() for c in ("scope", "bucket", "i", "j", "key", "near", "part", "text")))

    def out(found: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (kind, pa.int64(), pa.int64()))], names=["scope", "a", "b"])

    found: list[tuple] = []
    for (scope, *_), group in groupby(rows(), key=lambda r: r[:4]):
        keys, near, part, texts = zip(*(r[4:] for r in group))
        found.extend((scope, keys[x], keys[y]) for x, y in block_links(list(texts), list(near), list(part)))
        if len(found) > 10_000:
            yield out(found)
            found = []
    if found:
        yield out(found)


def links(buckets: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``scope, a, b``: verified links that connect all members of a bucket that similar pairs connect.

    Members are compared with their bucket's least member first.  A bucket where all are similar to it is settled, as is
    a bucket of two; the members of any other are compared with each other, in blocks of at most ``block`` texts.

    ``buckets``: ``scope, key bigint, bucket bigint``; ``texts``: ``scope, key, text``, one row per key.
    """
    at = ["scope", "bucket"]
    kind = buckets.schema["scope"].dataType.simpleString()
    rep = buckets.groupBy(*at).agg(F.min("key").alias("b"), F.max("key").alias("top"), F.count("*").alias("n")).where("b <> top").drop("top")
    named = buckets.join(rep, at).where("key <> b")
    cand = named.select("scope", F.col("key").alias("a"), "b").distinct()
    ta = texts.select("scope", F.col("key").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select("scope", F.col("key").alias("b"), F.col("text").alias("text_b"))
    both = cand.join(ta, ["scope", "a"]).join(tb, ["scope", "b"]).select("scope", "a", "b", "text_a", "text_b")
    tried = materialize(both.mapInArrow(_verify, f"scope {kind}, a bigint, b bigint, ok boolean"), "bucket-tried")
    direct = tried.where("ok").drop("ok")

    failed = tried.where("not ok").select("scope", F.col("a").alias("key"), "b")
    unsettled = named.where("n > 2").join(failed, ["scope", "key", "b"], "left_semi").select(*at).distinct()
    near = direct.select("scope", F.col("a").alias("key"), "b", F.lit(True).alias("near"))
    rest = named.join(unsettled, at, "left_semi").join(near, ["scope", "key", "b"], "left").select(*at, "key", "n", F.coalesce("near", F.lit(False)).alias("near"))
    rest = materialize(rest, "bucket-rest")
    if rest.isEmpty():
        return direct
    sizes = rest.join(texts.select("scope", "key", F.char_length("text").alias("chars")), ["scope", "key"]).groupBy(*at)
    sizes = sizes.agg(F.ceil(F.greatest(F.count("*") / block, F.sum("chars") / BLOCK_CHARS)).cast("int").alias("blocks"), F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), "key")).alias(f"set{k}") for k in (0, 1)))
    # Of buckets with the same members, one is enough.
    sizes = sizes.groupBy("scope", "n", "set0", "set1").agg(F.min("bucket").alias("bucket"), F.max("blocks").alias("blocks")).select(*at, "blocks")
    parts = rest.drop("n").join(sizes, at).withColumn("part", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).select(*at, "i", "j", "key", "near", "part")
    met = parts.join(texts.select("scope", "key", "text"), ["scope", "key"]).repartition(*at, "i", "j").sortWithinPartitions(*at, "i", "j")
    more = met.select(*at, "i", "j", "key", "near", "part", "text").mapInArrow(_settle, f"scope {kind}, a bigint, b bigint")
    return direct.unionByName(more)


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """``scope, key, label``: every key that has a link, with the least key of its connected component.

    Labels are halved in distance each round (hooking to the least neighbour, then jumping to the label's label), so the
    rounds follow the logarithm of the longest path.  Every round is written to the shared folder.
    """
    both = edges.select("scope", F.col("a").alias("key"), F.col("b").alias("other"))
    both = materialize(both.unionByName(both.select("scope", F.col("other").alias("key"), F.col("key").alias("other"))).distinct(), f"{name}-edges")
    label = materialize(both.groupBy("scope", "key").agg(F.least(F.min("other"), F.first("key")).alias("label")), f"{name}-0")
    for k in range(1, rounds):
        near = both.join(label.select("scope", F.col("key").alias("other"), F.col("label").alias("seen")), ["scope", "other"]).groupBy("scope", "key").agg(F.min("seen").alias("seen"))
        step = label.join(near, ["scope", "key"]).select("scope", "key", F.least("label", "seen").alias("label"), F.col("label").alias("was"))
        jump = step.select("scope", F.col("key").alias("label"), F.col("label").alias("far"))
        nxt = step.join(jump, ["scope", "label"], "left").select("scope", "key", F.least("label", F.coalesce("far", "label")).alias("label"), "was")
        nxt = materialize(nxt, f"{name}-{k}")
        done = nxt.where("label <> was").isEmpty()
        label = nxt.drop("was")
        if done:
            return label
    raise RuntimeError("components did not settle")
