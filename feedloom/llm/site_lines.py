"""Lines of the site itself that recur across one source's documents.

1. Every line's text is masked (numbers, dates, names) and hashed.  One pass over the documents, written once to the shared folder.
2. Masked lines are counted per source (an upper bound of their documents), before any text moves.  MinHash bands of the
   five-word shingles of each different masked line put it into buckets; they are clustered with exact verification, and clusters that pass the
   bound are counted in documents.
3. Lines of clusters with high document frequency are the candidates.  An exact count of the line's own text
   decides what ``repeated`` returns; ``removed`` takes out whole clusters.

Any line whose own text occurs in n documents has a masked form in at least n, so the clusters never lose a line
that the exact count would find.

Defined results: null documents have no lines; lines without a letter or digit don't count; a line repeated within one
document counts once; rows whose source is null are one source of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import minhash
from feedloom.session import materialize

#: Documents of a source from which on a line is repeated excessively.
LEAST_DOCUMENTS = 10

_TAG = re.compile(r"<[^>]*>")
_SPACE = re.compile(r"[ \t\r\n]+")
_WORD = re.compile(r"[^\W_]")
# Names of months and weekdays in the languages of feeds, which are masked as dates.
_DATES = (
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre lundi mardi mercredi jeudi vendredi samedi dimanche"
).split()
_DATE_WORDS = frozenset(_DATES)


class _Masked(dict):
    """A word's masked form: numbers to 0, dates to D, names (capitals, not after a sentence's end) to N."""

    def __missing__(self, w: str) -> str:
        if len(self) > 300_000:
            self.clear()
        core = w.strip(".,;:!?()[]{}«»“”„\"'—–-")
        low = core.lower()
        if any(c.isdigit() for c in core):
            m = w.replace(core, "0") if core else w
        elif low in _DATE_WORDS:
            m = w.replace(core, "D")
        elif core and core[0].isupper():
            m = w.replace(core, "N")
        else:
            m = w
        self[w] = m
        return m


_masked = _Masked()


def line_text(line: str) -> str:
    """What is left of a line without tags, with single spaces and trimmed ends."""
    if "<" in line:
        line = _TAG.sub("", line)
    return _SPACE.sub(" ", line).strip(" ")


def mask_words(text: str) -> list[str]:
    return list(map(_masked.__getitem__, text.split(" ")))


SCHEMA = "scope bigint, row_id bigint, line_no int, own bigint, masked bigint, text string"
#: Stands for the source of rows that have none.
NO_SCOPE = -(2**62)


def _lines(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh64_intdigest
    signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
    for b in batches:
        scope, row, no, own, masked, text = [], [], [], [], [], []
        for s, r, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if not html:
                continue
            for k, line in enumerate(html.split("\n")):
                t = line_text(line)
                if t and _WORD.search(t):
                    m = " ".join(mask_words(t))
                    scope.append(s)
                    row.append(r)
                    no.append(k)
                    own.append(digest(t))
                    masked.append(digest(m))
                    text.append(m)
        yield pa.RecordBatch.from_arrays([pa.array(scope, pa.int64()), pa.array(row, pa.int64()), pa.array(no, pa.int32()), signed(own), signed(masked), pa.array(text, pa.string())], names=[f.split()[0] for f in SCHEMA.split(", ")])


def lines(docs: DataFrame, row_id: str, scope: str, html: str) -> DataFrame:
    """All lines that count, with hashes of their text and of its masked form; written once."""
    slim = docs.select(F.coalesce(F.col(scope).cast("bigint"), F.lit(NO_SCOPE)).alias("scope"), F.col(row_id).cast("bigint").alias("row_id"), F.col(html).alias("html"))
    return materialize(slim.where("html <> ''").mapInArrow(_lines, SCHEMA), "site-lines")


def _buckets(batches: Iterator) -> Iterator:
    for b in batches:
        yield b.append_column("buckets", minhash.bucket_lists([t.split(" ") for t in b.column("text").to_pylist()]))


def clusters(found: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``scope, masked, cluster, documents``: masked lines whose near-duplicate cluster occurs in at least ``least`` documents."""
    at = ["scope", "masked"]
    counted = found.groupBy(*at).agg(F.count("*").alias("n"), F.min("row_id").alias("row_id"))
    # Each masked line once, from the least document that has it, however many have.
    one = found.select(*at, "row_id", "text").join(counted, [*at, "row_id"]).groupBy(*at).agg(F.first("n").alias("n"), F.first("text").alias("text"))
    groups = materialize(one.select("scope", F.col("masked").alias("key"), "n", "text").mapInArrow(_buckets, "scope bigint, key bigint, n bigint, text string, buckets array<bigint>"), "site-masks")
    buckets = groups.select("scope", "key", F.explode("buckets").alias("bucket"))
    # A bucket with one member links nothing.
    rep = buckets.groupBy("scope", "bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    members = materialize(buckets.join(rep, ["scope", "bucket"], "left_semi"), "site-buckets")
    texts = groups.select("scope", "key", "text").join(members.select("scope", "key").distinct(), ["scope", "key"], "left_semi")
    labels = minhash.components(materialize(minhash.links(members, texts), "site-links"), "site-classes")
    named = groups.select("scope", F.col("key").alias("masked"), "n").join(labels.select("scope", F.col("key").alias("masked"), "label"), at, "left")
    named = named.select(*at, "n", F.coalesce("label", "masked").alias("cluster"))
    # The sum over members bounds the documents from above; only clusters that pass it are counted exactly.
    total = named.groupBy("scope", "cluster").agg(F.sum("n").alias("upper")).where(F.col("upper") >= least)
    near = named.join(total, ["scope", "cluster"]).select(*at, "cluster")
    seen = (
        found.select(*at, "row_id")
        .join(near, at)
        .groupBy("scope", "cluster", "row_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("scope", "cluster")
        .agg(F.count("*").alias("documents"))
        .where(F.col("documents") >= least)
    )
    return near.join(seen, ["scope", "cluster"]).select(*at, "cluster", "documents")


def candidates(found: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Lines of frequent clusters."""
    return found.drop("text").join(clusters(found, least), ["scope", "masked"])


def repeated(found: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``row_id, line_no``: candidates whose own text occurs in at least ``least`` documents of the source."""
    c = materialize(candidates(found, least).select("scope", "row_id", "line_no", "own"), "site-candidates")
    often = c.groupBy("scope", "own", "row_id").agg(F.lit(1).alias("one")).groupBy("scope", "own").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return c.join(often, ["scope", "own"], "left_semi").select("row_id", "line_no")


def removed(docs: DataFrame, drop: DataFrame, row_id: str, html: str) -> DataFrame:
    """The documents without the lines named by ``drop`` (row_id, line_no).  A document's line numbers gather with it, no more."""
    gone = drop.groupBy(F.col("row_id").alias(row_id)).agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split(F.col(html), "\n"), lambda x, k: ~F.array_contains(F.col("gone"), k))
    return docs.select(row_id, html).join(gone, row_id, "left").select(row_id, F.when(F.col("gone").isNull(), F.col(html)).otherwise(F.array_join(kept, "\n")).alias(html), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"))
