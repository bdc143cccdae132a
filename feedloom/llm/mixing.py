"""Mix sources to target shares of the total size.

Sizes are tokens of a public tokenizer.  Every document of a source is expected to be used equally often, which gives
a whole number of copies and a fraction of one.  Fractions are rounded by pivotal dependent rounding: two
fractional documents exchange mass (copies times tokens) at random until one of them is integral, which keeps the
source's tokens and every document's expectation.  Each task rounds its own rows and leaves at most one fractional
document per source; these residuals combine through a reduction tree, so no source, however large, is
gathered anywhere.

Which documents exchange mass follows from their ids and from the numbers of documents alone, not from how rows fall into tasks, so a
mix can be made again on any cluster.

Defined results: documents whose source is null or not a target, and documents without tokens, take no part; no
document is used more than ``max_repeats`` times; a source with a target but no tokens gets nothing and its share
stays 0; without an explicit total the mix is the largest at which every source reaches its share.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm import tokens
from feedloom.session import materialize

#: Documents that one task of the first level rounds, on average, and residual-leaving tasks that one task of the next level takes up.
PER_TASK, FAN_IN = 100_000, 64
#: The targets are a configuration table; more rows than this are refused.
MOST_TARGETS = 10_000
ROW = "doc_id bigint, source string, n_tokens bigint, whole int, part double, copies int"


def _uniform(seed: int, a: int, b: int) -> float:
    h = hashlib.blake2b(f"{seed}:{a}:{b}".encode(), digest_size=8).digest()
    return int.from_bytes(h, "big") / 2.0**64


def settle(pa: float, na: int, pb: float, nb: int, u: float) -> tuple[float, float]:
    """New fractions of two documents; their mass stays, and one of them is 0 or 1."""
    up, down = min((1 - pa) * na, pb * nb), min(pa * na, (1 - pb) * nb)
    if u * (up + down) < down:
        full = (1 - pa) * na <= pb * nb
        return (1.0 if full else pa + up / na), (pb - up / nb if full else 0.0)
    empty = pa * na <= (1 - pb) * nb
    return (0.0 if empty else pa - down / na), (pb + down / nb if empty else 1.0)


def _round(batches: Iterator, seed: int, last: bool) -> Iterator:
    """Rows come out with copies; one per source of this task may come out with a fraction and no copies, unless ``last``."""
    import pyarrow as pa

    names = ["doc_id", "source", "n_tokens", "whole", "part", "copies"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int32()]
    held: dict[str, tuple[int, int, int, float]] = {}

    def out(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for b in batches:
        rows = []
        for doc, src, n, whole, p in zip(*(b.column(c).to_pylist() for c in names[:5])):
            if not 0.0 < p < 1.0:
                rows.append((doc, src, n, whole, 0.0, whole + round(p)))
                continue
            if (h := held.pop(src, None)) is None:
                held[src] = (doc, n, whole, p)
                continue
            hd, hn, hw, hp = h
            hp, p = settle(hp, hn, p, n, _uniform(seed, hd, doc))
            for d, m, w, q in ((hd, hn, hw, hp), (doc, n, whole, p)):
                if 1e-12 < q < 1 - 1e-12:
                    held[src] = (d, m, w, q)
                else:
                    rows.append((d, src, m, w, 0.0, w + round(q)))
        if rows:
            yield out(rows)
    if held:
        rows = []
        for src, (d, n, w, p) in held.items():
            rows.append((d, src, n, w, 0.0, w + int(_uniform(seed, d, -1) < p)) if last else (d, src, n, w, p, None))
        yield out(rows)


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> dict[str, tuple[float, int, float]]:
    """Source to (expected copies of each document, cap, target share).  One row per target reaches the driver."""
    have = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    want = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.collect() if r.source is not None}
    feasible = [cap * have[s] / w for s, (w, cap) in want.items() if w > 0 and have.get(s)]
    size = min(feasible, default=0.0) if total is None else total
    return {s: (min(float(cap), w * size / have[s]) if have.get(s) else 0.0, cap, w) for s, (w, cap) in want.items()}


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows spread by their ids, a source of any size evenly, and in order within each task.  A shuffle even into one task, so what comes before keeps its own."""
    return rows.repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "source")


def mixed(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, folder: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, copies``: the documents of the mix and how often each is used."""
    spark = docs.sparkSession
    if targets.count() > MOST_TARGETS:
        raise ValueError("too many targets")
    named = docs.select("doc_id", "source", "text").join(F.broadcast(targets.select("source").where("source is not null").distinct()), "source", "left_semi")
    sizes = materialize(tokens.count(named, folder, keep="source").where("n_tokens > 0"), "mix-sizes")
    how = plan(sizes, targets, total)
    rows = [(s, math.floor(e + 1e-9), max(0.0, e - math.floor(e + 1e-9))) for s, (e, _, _) in how.items()]
    table = spark.createDataFrame(rows or [("", 0, 0.0)], "source string, whole int, part double")
    todo = sizes.join(F.broadcast(table), "source").select("doc_id", "source", "n_tokens", "whole", F.when(F.col("part") < 1e-9, 0.0).otherwise(F.col("part")).alias("part"))
    done: list[DataFrame] = []
    tasks = math.ceil(sizes.count() / PER_TASK)
    todo = _dealt(todo, tasks + 1)
    level = 0
    while True:
        last = tasks == 1 and level > 0
        got = materialize(todo.mapInArrow(partial(_round, seed=seed + level, last=last), ROW), f"mix-level-{level}")
        done.append(got.where("copies is not null"))
        if last:
            break
        tasks = max(1, math.ceil(tasks / FAN_IN))
        left = got.where("copies is null").select("doc_id", "source", "n_tokens", "whole", "part")
        # The rows left are at most as many as tasks times sources.
        todo = _dealt(left, tasks)
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, tokens, actual_share, documents, most_copies`` of every target."""
    by = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    got = by.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # one row per source
    return targets.select("source", "target_share").join(got, "source", "left").select(
        "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies")
    )
