"""Messages delivered more than once: a store that keeps exactly one copy of each.

The store holds the winners in historical partitions and, beside them, an identifier index that names the
partitions a key may be in.  The index is cut into buckets by the key's hash.  A batch is merged in four steps:

1. the batch itself is reduced to one row per key (a ``min`` with map-side combine, so a key with a third of
   all rows never gathers in one task),
2. the buckets of the index that the batch's keys fall into, and no others, are joined with them; the partitions found are the affected ones,
3. only the affected partitions are read, united with the reduced batch and reduced again,
4. the new contents of exactly those partitions, and of partitions that are new, are written to folders of this
   attempt alone, and one manifest is published by a step that fails if its version is there already.  Readers follow the
   newest manifest, so they see the state before or after a merge and nothing between; a merge that died leaves only
   unreferenced folders, and doing it again writes to others.

The index gets one segment for each bucket a merge touches.  An entry may be out of date (its key has moved); that costs a
partition read in vain, never a copy missed.  A bucket of more than ``SEGMENTS`` segments is compacted, a partition of more than
``SEGMENTS`` folders is rewritten with the next merge; ``vacuum`` deletes what the newest manifest doesn't name.

Defined results: rows whose key is null (no identifier) are never copies and are all kept; the least of the order
column wins, null after all others; ties are broken by a hash of the whole row, so one row wins even if whole rows
repeat; an empty batch changes nothing but the version; a batch with a number (``batch=(stream, n)``) that was merged before changes nothing at
all; a row's columns travel in one struct, so their names can't clash with the store's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash of the key, and the partition it was put into by merge ``v``.
INDEX = "h bigint, home int, v int"
#: Buckets of the index, fixed when a store is made: about one for every million keys expected.
BUCKETS = 16
SEGMENTS = 8


def entry_key(scope: str = "feed_idx", id_col: str = "id", url_col: str = "url") -> Column:
    """The identifier of an entry within its feed: ``id``, or ``url`` where that is null or empty; null where there is neither."""
    ident = F.coalesce(F.when(F.col(id_col) != "", F.col(id_col)), F.when(F.col(url_col) != "", F.col(url_col)))
    return F.when(ident.isNotNull(), F.concat(F.coalesce(F.col(scope).cast("string"), F.lit("")), F.lit("\u0001"), ident))


def _packed(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """``key``, the row as one struct, and what decides between rows of a key."""
    rank = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("order"), F.xxhash64(*_hashable(rows)).alias("tie"))
    return rows.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), rank.alias("rank"))


def _least(packed: DataFrame, *more: str) -> DataFrame:
    """One row per key.  An aggregation, not a window: it combines before the shuffle, so a hot key stays small."""
    return packed.groupBy("key").agg(F.min_by(F.struct("row", "rank", *more), "rank").alias("r")).select("key", "r.*")


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per key, the least by ``order``; all rows without a key."""
    p = _packed(rows, key, order)
    return _least(p.where("key is not null")).select("row.*").unionByName(p.where("key is null").select("row.*"))


def _hashable(df: DataFrame) -> list[Column]:
    """Columns as something xxhash64 takes; maps and variants as JSON."""
    return [F.to_json(F.col(f"`{c}`")) if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in ((x, df.schema[x].dataType.simpleString()) for x in df.columns)]


@dataclass
class MergeReport:
    version: int
    affected: list[int] = field(default_factory=list)
    written: list[int] = field(default_factory=list)
    buckets: list[int] = field(default_factory=list)


class DeliveryStore:
    """Winners in partitions of ``home``: a function that makes an integer (the day, a range of batches) of a row, given ``col(name)``."""

    def __init__(self, spark: SparkSession, root: str, key: Column, order: str, home: Callable[[Callable[[str], Column]], Column], buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.order, self.home, self.buckets = spark, root.rstrip("/"), key, order, home, buckets
        self.jvm = spark.sparkContext._jvm
        self.fs_path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests -------------------------------------------------------------------------------------------
    def _manifest(self) -> dict:
        """The newest published state."""
        p = self.fs_path(f"{self.root}/manifest")
        if not self.fs.exists(p):
            return {"version": -1, "parts": {}, "index": {}, "loose": [], "streams": {}, "buckets": self.buckets}
        last = max(s.getPath().getName() for s in self.fs.listStatus(p))
        row = self.spark.read.text(f"{self.root}/manifest/{last}", wholetext=True).first()
        return json.loads(row[0])

    def _publish(self, m: dict) -> None:
        """The manifest appears whole or not at all, and the second of two writers of one version fails.

        On a local disk a hard link does that (on one without them, only for one writer at a time); elsewhere a rename that may not overwrite, which a file system for shared
        stores makes one step.  A store of objects without such a rename can't hold the manifests.
        """
        tmp, to = self.fs_path(f"{self.root}/tmp/{uuid.uuid4().hex}"), self.fs_path(f"{self.root}/manifest/{m['version']:09d}")
        self.fs.mkdirs(to.getParent())
        out = self.fs.create(tmp, False)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        try:
            if self.fs.getScheme() == "file":
                self._link(*(self.jvm.java.nio.file.Path.of(self.fs.makeQualified(p).toUri()) for p in (to, tmp)))
            else:
                fc = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                fc.rename(tmp, to, none)
        except Exception as e:  # noqa: BLE001
            if "AlreadyExists" in str(e):
                raise RuntimeError(f"version {m['version']} was published by another writer") from e
            raise
        finally:
            self.fs.delete(tmp, False)

    def _link(self, to, tmp) -> None:
        files = self.jvm.java.nio.file.Files
        try:
            files.createLink(to, tmp)
        except Exception as e:  # noqa: BLE001
            if "AlreadyExists" in str(e):
                raise
            # A disk without hard links: a move that may not overwrite, which is enough for one writer at a time.
            files.move(tmp, to, self.spark.sparkContext._gateway.new_array(self.jvm.java.nio.file.CopyOption, 0))

    # reading ---------------------------------------------------------------------------------------------
    def _load(self, m: dict, dirs: list[str]) -> DataFrame:
        from pyspark.sql import types as T

        return self.spark.read.schema(T.StructType.fromJson(m["schema"])).parquet(*dirs)

    def _segments(self, dirs: list[str]) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(*dirs)

    def winners(self) -> DataFrame:
        """All rows kept."""
        m = self._manifest()
        return self._load(m, [d for ds in m["parts"].values() for d in ds] + m["loose"]).select("row.*")

    # writing ---------------------------------------------------------------------------------------------
    def merge(self, batch: DataFrame, batch_no: tuple[str, int] | None = None) -> MergeReport:
        m = self._manifest()
        if batch_no and m["streams"].get(batch_no[0], -1) >= batch_no[1]:
            return MergeReport(m["version"])
        v = m["version"] + 1
        base = f"{self.root}/v{v:09d}-{uuid.uuid4().hex}"
        rows = _packed(batch, self.key, self.order).withColumn("home", F.coalesce(self.home_of("row"), F.lit(-1)))
        m["schema"] = m.get("schema") or rows.schema.jsonValue()
        n = m["buckets"]
        bucket = F.pmod("h", F.lit(n)).cast("int")
        # Rows without an identifier are no copies of anything: they go straight to the store.
        rows.where("key is null").write.parquet(f"{base}/loose")
        _least(rows.where("key is not null"), "home").select(*rows.columns).write.parquet(f"{base}/incoming")
        incoming = self._load(m, [f"{base}/incoming"])
        keys = incoming.select(F.xxhash64("key").alias("h"), "home")

        hit: list[int] = []
        affected: set[int] = set()
        if m["index"]:
            # Numbers of buckets and of partitions are all that reaches the driver.
            hit = sorted(r[0] for r in keys.select(bucket.alias("b")).distinct().collect())
            if dirs := [d for b in hit for d in m["index"].get(str(b), ())]:
                affected = {r[0] for r in self._segments(dirs).join(keys.select("h"), "h", "left_semi").select("home").distinct().collect()}
            affected |= {int(p) for p, ds in m["parts"].items() if len(ds) > SEGMENTS}
        new = incoming
        if dirs := [d for p, ds in m["parts"].items() if int(p) in affected for d in ds]:
            new = _least(incoming.unionByName(self._load(m, dirs)), "home").select(*rows.columns)
        # A winner lives in the partition of its own row, so a key may move when an older delivery arrives late.  Rows are put
        # together by partition first (large ones over several tasks), or every task would write a file into every partition.
        new.hint("rebalance", "home").withColumn("part", F.col("home")).write.partitionBy("part").parquet(f"{base}/rows")
        written = self._list_parts(f"{base}/rows")
        parts = {p: list(d) for p, d in m["parts"].items() if int(p) not in affected}
        for p in written:
            parts.setdefault(str(p), []).append(f"{base}/rows/part={p}")
        # Where the batch's keys are now: a key's winner may be the row that was there before, so both homes are kept.
        keys.select("h", "home", F.lit(v).alias("v"), bucket.alias("part")).hint("rebalance", "part").write.partitionBy("part").parquet(f"{base}/index")
        index = {b: list(d) for b, d in m["index"].items()}
        for b in self._list_parts(f"{base}/index"):
            index.setdefault(str(b), []).append(f"{base}/index/part={b}")
        for b, dirs in index.items():
            if len(dirs) > SEGMENTS:
                self._segments(dirs).groupBy("h", "home").agg(F.max("v").alias("v")).coalesce(1).write.parquet(f"{base}/compact/part={b}")
                index[b] = [f"{base}/compact/part={b}"]
        streams = m["streams"] | ({batch_no[0]: batch_no[1]} if batch_no else {})
        self._publish({"version": v, "parts": parts, "index": index, "loose": [*m["loose"], f"{base}/loose"], "schema": m["schema"], "streams": streams, "buckets": n})
        self.fs.delete(self.fs_path(f"{base}/incoming"), True)
        return MergeReport(v, sorted(affected), written, hit)

    def home_of(self, struct: str) -> Column:
        """The partition number, computed from the packed row."""
        return self.home(lambda c: F.col(f"{struct}.`{c}`")).cast("int")

    def _list_parts(self, path: str) -> list[int]:
        return sorted(int(s.getPath().getName().split("=")[1]) for s in self.fs.listStatus(self.fs_path(path)) if "=" in s.getPath().getName())

    def vacuum(self) -> None:
        """Delete what no reader of the newest manifest needs, whether it was published or not; a merge that is under way keeps its folders."""
        m = self._manifest()
        live = {d for kind in ("parts", "index") for ds in m[kind].values() for d in ds} | set(m["loose"])
        for attempt in self.fs.listStatus(self.fs_path(self.root)):
            name = attempt.getPath().getName()
            if not name.startswith("v") or int(name[1:10]) > m["version"]:
                continue
            base = f"{self.root}/{name}"
            if not any(d.startswith(f"{base}/") for d in live):
                self.fs.delete(attempt.getPath(), True)
                continue
            for folder in ("rows", "index", "compact"):
                if self.fs.exists(self.fs_path(f"{base}/{folder}")):
                    for p in self._list_parts(f"{base}/{folder}"):
                        if f"{base}/{folder}/part={p}" not in live:
                            self.fs.delete(self.fs_path(f"{base}/{folder}/part={p}"), True)
            self.fs.delete(self.fs_path(f"{base}/incoming"), True)


def replay(rows: DataFrame, root: str, key: Column, order: str, batch: str, per_part: int = 16, merges: int = 2) -> DeliveryStore:
    """Deliver a whole table to a new store: the first half of its batches at once, then the rest in ``merges`` equal steps.

    ``per_part`` batches share one historical partition, so their number follows the batches, not the rows.
    """
    spark = rows.sparkSession
    store = DeliveryStore(spark, root, key, order, lambda col: F.floor(col(batch) / per_part))
    lo, hi = rows.agg(F.min(batch), F.max(batch)).first()
    if lo is None:
        lo = hi = 0
    cuts = [lo + (hi + 1 - lo) * (merges + k) // (2 * merges) for k in range(merges + 1)]
    store.merge(rows.where((F.col(batch) < cuts[0]) | F.col(batch).isNull()))
    for a, b in zip(cuts, cuts[1:]):
        store.merge(rows.where((F.col(batch) >= a) & (F.col(batch) < b)))
    return store


def copies(rows: DataFrame, winners: DataFrame, key: Column, row_id: str) -> DataFrame:
    """The rows that a store didn't keep."""
    return rows.where(key.isNotNull()).select(row_id).join(winners.select(row_id), row_id, "left_anti")
