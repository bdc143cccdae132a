"""Long exact spans shared between records.

``method_classes`` is paragraph MinHash banding: bands tuned for recall at similarity 0.8, colliding paragraphs joined
to their bucket's representative, exact Jaccard, components.  It finds paragraphs that are nearly alike as wholes.  A
verbatim span may fill only a part of a paragraph or cross its end; the paragraphs are then unlike, and no banding finds
them all.  ``span_pairs`` therefore follows the plain rule exactly:

* Anchors: of every window of ``SPAN`` characters the least hash of a ``GRAM`` gram inside it (a MinHash of the
  window with one function).  Equal windows have equal anchors, so documents that share a span share an anchor.
* Anchors in one text only are dropped by a count that combines before the shuffle.
* For the rest, the ``SPAN - GRAM`` characters on either side decide exactly how far the common span reaches; only
  surroundings that share nearly a whole span meet, so an anchor that many texts have costs no pairs of its own.
* Copies of a whole text are one text until the end; equal surroundings are compared once, however many
  documents have them, so a text that fills a third of the table costs as much as one.

Defined results: null texts and texts shorter than ``SPAN`` share nothing; characters are Unicode code points; a span
repeated inside one document only isn't shared; the table's other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import minhash
from feedloom.session import materialize

SPAN, GRAM = 200, 100
SIDE, WINDOW = SPAN - GRAM, SPAN - GRAM + 1
#: Code points hashed at a time; longer texts are cut into overlapping pieces, which changes no anchor.
PIECE = 1 << 18

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_R = np.uint64(32)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _A) ^ b
    x ^= x >> _R
    x *= _B
    x ^= x >> _R
    return x


def _gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of every run of GRAM codes, by doubling."""
    h = codes.astype(np.uint64) * _B
    h ^= h >> _R
    size = 1
    while size * 2 <= GRAM:
        h = _join(h[:-size], h[size:])
        size *= 2
    return _join(h[: len(h) - (GRAM - size)], h[GRAM - size :]) if size < GRAM else h


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` of every run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some window of SPAN codes."""
    if len(codes) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(codes)
    least = _slide(h, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, np.uint64)
    reach = _slide(np.concatenate([pad, least, pad]), WINDOW, np.maximum)  # the greatest minimum of a window around each gram
    at = np.flatnonzero(h == reach)
    return at, h[at]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _pieces(n: int) -> Iterator[tuple[int, int]]:
    a = 0
    while True:
        b = min(n, a + PIECE)
        yield a, b
        if b == n:
            return
        a = b - SPAN + 1


def _anchors(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    def flush(part: list[tuple[int, int, int, np.ndarray]]):
        out = []
        for doc, own, shift, codes in part:
            at, h = anchors_of(codes)
            out.append((np.full(len(at), doc, np.int64), np.full(len(at), own, np.int64), (at + shift).astype(np.int32), h.view(np.int64)))
        doc, own, pos, key = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(own), pa.array(pos)], names=["key", "doc", "own", "pos"])

    for b in batches:
        part, size = [], 0
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text is None or len(text) < SPAN:
                continue
            own = int.from_bytes(hashlib.md5(text.encode("utf-8", "replace")).digest()[:8], "big", signed=True)
            codes = _codes(text)
            for x, y in _pieces(len(codes)):
                part.append((doc, own, x, codes[x:y]))
                size += y - x
            if size >= 4 * PIECE:
                yield flush(part)
                part, size = [], 0
        if part:
            yield flush(part)


def _contexts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        key, doc, pos, left, ctx = [], [], [], [], []
        for d, text, hits in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("hits").to_pylist()):
            for h in hits:
                p = h["pos"]
                a = max(0, p - SIDE)
                key.append(h["key"])
                doc.append(d)
                pos.append(p)
                left.append(p - a)
                ctx.append(text[a : p + GRAM + SIDE])
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(pos, pa.int32()), pa.array(left, pa.int32()), pa.array(ctx, pa.string())], names=["key", "doc", "pos", "left", "ctx"])


def reach(a: str, la: int, b: str, lb: int) -> tuple[int, int]:
    """How far the common span goes to the left of the anchor, and to the right of its first character; (0, 0) if the grams differ."""
    ga, gb = a[la : la + GRAM], b[lb : lb + GRAM]
    if ga != gb:
        return 0, 0
    r = GRAM
    ra, rb = a[la:], b[lb:]
    most = min(len(ra), len(rb))
    while r < most and ra[r] == rb[r]:
        r += 1
    n = 0
    most = min(la, lb)
    while n < most and a[la - 1 - n] == b[lb - 1 - n]:
        n += 1
    return n, r


def _compare(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        got = [reach(*x) for x in zip(*(b.column(c).to_pylist() for c in ("ctx_a", "left_a", "ctx_b", "left_b")))]
        t = pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("cid_a"), b.column("cid_b"), pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.int32())],
            names=["key", "cid_a", "cid_b", "l", "r"],
        )
        yield t.filter(pa.array([x[0] + x[1] >= SPAN for x in got], pa.bool_()))


def _slim(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.char_length("text") >= SPAN)


def copies(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, rep``: documents whose whole text occurs more than once, with the least document that has it."""
    hashed = materialize(_slim(docs, doc, text).select("doc", F.md5("text").alias("h")), "span-copies")
    rep = hashed.groupBy("h").agg(F.min("doc").alias("rep"), F.max("doc").alias("top")).where("rep <> top").select("h", "rep")
    return hashed.join(rep, "h").select("doc", "rep")


def contexts(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, doc, pos, left, ctx``: anchors that occur in more than one text, with their surroundings; one document for each text."""
    slim = _slim(docs, doc, text)
    # Copies of a text are one text from here on; they combine before the first shuffle.
    found = materialize(slim.mapInArrow(_anchors, "key bigint, doc bigint, own bigint, pos int").groupBy("key", "own", "pos").agg(F.min("doc").alias("doc")), "span-anchors")
    shared = found.groupBy("key").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("key")
    hits = found.join(shared, "key", "left_semi")
    per_doc = hits.groupBy("doc").agg(F.collect_set(F.struct("pos", "key")).alias("hits"))  # as many as the text has anchors
    return materialize(slim.join(per_doc, "doc").mapInArrow(_contexts, "key bigint, doc bigint, pos int, left int, ctx string"), "span-contexts")


def _windows(ctx: DataFrame, size: int, step: int) -> DataFrame:
    """Runs of ``size`` characters of the surroundings that hold the anchor, from every ``step``-th place: ``skip`` to the left of it."""
    reach = F.sequence(F.lit(0), F.lit(size - GRAM), F.lit(step))
    fits = F.filter(reach, lambda k: (F.col("left") >= k) & (F.char_length("ctx") - F.col("left") + k >= size))
    cut = F.substring(F.col("ctx"), F.col("left") - F.col("skip") + 1, F.lit(size))
    return ctx.withColumn("skip", F.explode(fits)).withColumns({"h1": F.xxhash64(cut), "h2": F.xxhash64(F.lit(1), cut)}).drop("ctx")


#: Surroundings meet only if they share SPAN - NEAR characters around the anchor.
NEAR = 10


def verified(ctx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surroundings with an id, and pairs of different surroundings of one anchor that reach SPAN together.

    Equal surroundings are one row, so copies never meet here.  A common span of SPAN characters holds, from one of every
    NEAR places, a common run of SPAN - NEAR around the anchor; only rows with such a run in common meet, so nearly every pair
    that is compared is one of the result, however many texts have the anchor itself.
    """
    named = ctx.withColumn("cid", F.xxhash64("ctx", "left"))
    one = materialize(named.groupBy("key", "cid").agg(F.first("ctx").alias("ctx"), F.first("left").alias("left")), "span-distinct")
    runs = _windows(one, SPAN - NEAR, NEAR)
    a = runs.select("key", "skip", "h1", "h2", F.col("cid").alias("cid_a"))
    b = runs.select("key", "skip", "h1", "h2", F.col("cid").alias("cid_b"))
    near = a.join(b, ["key", "skip", "h1", "h2"]).where("cid_a < cid_b").select("key", "cid_a", "cid_b").distinct()
    left = one.select("key", F.col("cid").alias("cid_a"), F.col("ctx").alias("ctx_a"), F.col("left").alias("left_a"))
    right = one.select("key", F.col("cid").alias("cid_b"), F.col("ctx").alias("ctx_b"), F.col("left").alias("left_b"))
    pairs = near.join(left, ["key", "cid_a"]).join(right, ["key", "cid_b"]).select("key", "cid_a", "cid_b", "ctx_a", "left_a", "ctx_b", "left_b")
    return named, materialize(pairs.mapInArrow(_compare, "key bigint, cid_a bigint, cid_b bigint, l int, r int"), "span-verified")


def text_pairs(named: DataFrame, good: DataFrame) -> DataFrame:
    """``rep_a < rep_b``: pairs of different texts that share a span."""
    who = named.select("key", "cid", "doc").distinct()
    a = who.select("key", F.col("cid").alias("cid_a"), F.col("doc").alias("x"))
    b = who.select("key", F.col("cid").alias("cid_b"), F.col("doc").alias("y"))
    across = good.join(a, ["key", "cid_a"]).join(b, ["key", "cid_b"]).select("x", "y")
    whole = named.where(F.char_length("ctx") >= SPAN).select("key", "cid", "doc").distinct()
    same = whole.select("key", "cid", F.col("doc").alias("x")).join(whole.select("key", "cid", F.col("doc").alias("y")), ["key", "cid"]).where("x < y").select("x", "y")
    return across.unionByName(same).where("x <> y").select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b")).distinct()


def span_pairs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_a < doc_b``: every pair of documents with a common verbatim span of at least SPAN characters."""
    named, good = verified(contexts(docs, doc, text))
    pairs = materialize(text_pairs(named, good), "span-pairs")
    group = materialize(copies(docs, doc, text), "span-groups")
    a = group.select(F.col("rep").alias("rep_a"), F.col("doc").alias("doc_a"))
    b = group.select(F.col("rep").alias("rep_b"), F.col("doc").alias("doc_b"))
    wide = pairs.join(a, "rep_a", "left").join(b, "rep_b", "left").select(F.coalesce("doc_a", "rep_a").alias("x"), F.coalesce("doc_b", "rep_b").alias("y"))
    inside = group.select("rep", F.col("doc").alias("x")).join(group.select("rep", F.col("doc").alias("y")), "rep").where("x < y").select("x", "y")
    both = wide.unionByName(inside)
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def classes(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id``: documents joined by shared spans, each with the least document of its class; one that shares nothing is a class of its own.

    The form for tables where pairs are too many: documents with the same surroundings of an anchor are linked to the least of them, copies of
    a text to their least document, so links are as many as rows, not as pairs.
    """
    named, good = verified(contexts(docs, doc, text))
    # Surroundings shorter than a span hold none, with whatever they are compared.
    who = named.where(F.char_length("ctx") >= SPAN).select("key", "cid", "doc")
    least = materialize(who.groupBy("key", "cid").agg(F.min("doc").alias("least")), "span-least")
    star = who.join(least, ["key", "cid"]).select(F.col("doc").alias("a"), F.col("least").alias("b"))
    ends = least.select("key", F.col("cid").alias("cid_a"), F.col("least").alias("a")), least.select("key", F.col("cid").alias("cid_b"), F.col("least").alias("b"))
    across = good.join(ends[0], ["key", "cid_a"]).join(ends[1], ["key", "cid_b"]).select("a", "b")
    same = copies(docs, doc, text).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    links = star.unionByName(across).unionByName(same).where("a <> b").select(F.lit(0).alias("scope"), "a", "b").distinct()
    label = minhash.components(materialize(links, "span-links"), "span-classes").select(F.col("key").alias("doc_id"), "label")
    return docs.select(F.col(doc).cast("bigint").alias("doc_id")).join(label, "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("class_id"))


def shares(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, shared_chars, share``: how much of each text lies in spans that occur in other documents too.

    No pairs are made: every run of SPAN characters around an anchor is counted by its hash (128 bits), and runs that occur in
    more than one text cover their place.
    """
    from pyspark.sql import Window

    ctx = contexts(docs, doc, text)
    runs = _windows(ctx, SPAN, 1)
    often = runs.groupBy("key", "skip", "h1", "h2").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 <> d1").select("key", "skip", "h1", "h2")
    spans = runs.join(often, ["key", "skip", "h1", "h2"], "left_semi").select("doc", (F.col("pos") - F.col("skip")).alias("s")).distinct()
    w = Window.partitionBy("doc").orderBy("s")  # as many rows as the text has characters
    covered = spans.withColumn("gap", F.col("s") - F.coalesce(F.lag("s").over(w), F.lit(-SPAN))).groupBy("doc").agg(F.sum(F.least(F.col("gap"), F.lit(SPAN))).cast("bigint").alias("shared"))
    group = copies(docs, doc, text).select("doc", F.lit(True).alias("copied"))
    sizes = docs.select(F.col(doc).cast("bigint").alias("doc"), F.coalesce(F.char_length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0).cast("bigint")))
    out = sizes.join(covered, "doc", "left").join(group, "doc", "left").select(F.col("doc").alias("doc_id"), "n_chars", shared.alias("shared_chars"))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))


# Paragraph MinHash banding ------------------------------------------------------------------------------------
PARAGRAPHS = "doc bigint, par_no int, key bigint, text string, buckets array<bigint>"


def _paragraphs(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import xxhash

    for b in batches:
        doc, no, key, text, words = [], [], [], [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for k, p in enumerate(t.split("\n")):
                w = p.split()
                if w:
                    doc.append(d)
                    no.append(k)
                    text.append(" ".join(w))
                    key.append(xxhash.xxh64_intdigest(text[-1]))
                    words.append(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(text, pa.string()), minhash.bucket_lists(words)],
            names=[f.split()[0] for f in PARAGRAPHS.split(", ")],
        )


def paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs with the buckets of their bands; written once."""
    slim = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).where("text is not null")
    return materialize(slim.mapInArrow(_paragraphs, PARAGRAPHS), "paragraphs")


def paragraph_links(found: DataFrame) -> DataFrame:
    """``scope, a, b``: verified links between different paragraphs, by the keys of their texts."""
    zero = F.lit(0).cast("bigint").alias("scope")
    members = minhash.members(found).select(zero, "key", "bucket")
    # One text for each key that is wanted, from the least document that has it: copies are told apart by numbers alone, before any text moves.
    least = found.groupBy("key").agg(F.min("doc").alias("doc")).join(members.select("key").distinct(), "key", "left_semi")
    texts = materialize(found.select("key", "doc", "text").join(least, ["key", "doc"]).groupBy("key").agg(F.first("text").alias("text")).select(zero, "key", "text"), "paragraph-texts")
    return materialize(minhash.links(members, texts), "paragraph-links")


def method_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, par_no, class_id, remove``: paragraphs that have a near-duplicate in some document; all but the first of a class can go."""
    found = paragraphs(docs, doc, text)
    labels = minhash.components(paragraph_links(found), "paragraph-classes")
    often = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    classed = often.join(labels.select("key", "label"), "key", "full").select("key", F.coalesce("label", "key").alias("class_id"))
    rows = found.select("doc", "par_no", "key").join(classed, "key")
    first = rows.groupBy("class_id").agg(F.min(F.struct("doc", "par_no")).alias("first"))
    return rows.join(first, "class_id").select(F.col("doc").alias("doc_id"), "par_no", "class_id", (F.struct("doc", "par_no") != F.col("first")).alias("remove"))
