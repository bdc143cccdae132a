import random

from pyspark.sql import functions as F

from feedloom.operators.redelivery import DeliveryStore, copies, entry_key, keep_first, replay
from feedloom.session import scratch_path

SCHEMA = "item_row bigint, feed_idx int, batch_id bigint, id string, url string, key string, `row` string, home int"


def brute(rows):
    best = {}
    for r in rows:
        ident = r[3] or r[4]
        if ident:
            k = (r[1], ident)
            best[k] = min(best.get(k, r[0]), r[0])
    keep = {(k, v) for k, v in best.items()}
    return {r[0] for r in rows if not (r[3] or r[4]) or ((r[1], r[3] or r[4]), r[0]) in keep}


def make(n, seed):
    rng = random.Random(seed)
    # a third of all rows is one entry
    return [(i, rng.choice([0, 0, 1, None]), rng.choice([*range(9), None]), rng.choice(["a", "a", "b", "c", "", None, f"u{i}"]), rng.choice(["x", "", None]), "clash", None, 1) for i in range(n)]


def test_replay_against_brute_force(spark):
    for seed in range(2):
        rows = make(300, seed)
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, SCHEMA)
        store = replay(df, scratch_path(spark, "t"), entry_key(), "item_row", "batch_id", per_part=2)
        got = [r.item_row for r in store.winners().collect()]
        assert sorted(got) == sorted(brute(rows))
        assert store.winners().columns == df.columns
        lost = {r.item_row for r in copies(df, store.winners(), entry_key(), "item_row").collect()}
        assert lost == {r[0] for r in rows} - brute(rows)


def test_only_affected_partitions_are_written(spark):
    store = DeliveryStore(spark, scratch_path(spark, "t"), entry_key(), "item_row", lambda col: col("batch_id"))
    base = [(i, 0, i % 4, f"e{i}", None, "", "", 0) for i in range(40)]
    store.merge(spark.createDataFrame(base, SCHEMA))
    before = store._manifest()["parts"]
    report = store.merge(spark.createDataFrame([(100, 0, 9, "e1", None, "", "", 0), (101, 0, 9, "new", None, "", "", 0)], SCHEMA))
    after = store._manifest()["parts"]
    assert report.affected == [1] and report.written == [1, 9]
    assert {p for p in before if before[p] == after.get(p)} == {"0", "2", "3"}
    assert store.winners().count() == 41
    # an older delivery that comes late wins and moves the entry
    store.merge(spark.createDataFrame([(-1, 0, 2, "e1", None, "", "", 0)], SCHEMA))
    assert {r.item_row for r in store.winners().where("id = 'e1'").collect()} == {-1}
    store.vacuum()
    assert store.winners().count() == 41
    # one bucket of the index is read for one key
    report = store.merge(spark.createDataFrame([(200, 0, 9, "e5", None, "", "", 0)], SCHEMA))
    assert len(report.buckets) == 1 and store.winners().count() == 41


def test_repeats_ties_and_empty(spark):
    store = DeliveryStore(spark, scratch_path(spark, "t"), entry_key(), "item_row", lambda col: col("batch_id"))
    empty = spark.createDataFrame([], SCHEMA)
    store.merge(empty)
    assert store.winners().count() == 0
    same = [(1, 0, 0, "a", None, "", "", 0)] * 3 + [(1, 0, 0, "a", "other", "", "", 0), (2, 0, 0, None, None, "", "", 0), (2, 0, 0, None, None, "", "", 0), (None, 0, 0, "n", None, "", "", 0), (5, 0, 0, "n", None, "", "", 0)]
    store.merge(spark.createDataFrame(same, SCHEMA))
    store.merge(empty)
    got = [(r.item_row, r.id) for r in store.winners().collect()]
    assert sorted(got, key=str) == [(1, "a"), (2, None), (2, None), (5, "n")]
    assert keep_first(spark.createDataFrame(same, SCHEMA), entry_key(), "item_row").count() == 4
    assert keep_first(empty, entry_key(), "item_row").count() == 0


def test_a_merge_that_died_anywhere_can_be_done_again(spark, monkeypatch):
    """Killed after each of its writes in turn: readers see the old state, and the same batch then merges."""
    from pyspark.sql.readwriter import DataFrameWriter

    store = DeliveryStore(spark, scratch_path(spark, "t"), entry_key(), "item_row", lambda col: col("batch_id"))
    first = spark.createDataFrame([(k, 0, k % 3, f"e{k}", None, "", "", 0) for k in range(9)] + [(50, 0, 0, None, None, "", "", 0)], SCHEMA)
    store.merge(first)
    real, publish = DataFrameWriter.parquet, DeliveryStore._publish
    for k in range(5):
        batch = spark.createDataFrame([(-1 - k, 0, 1, "e1", None, "", "", 0), (100 + k, 0, 5, f"new{k}", None, "", "", 0), (200 + k, 0, 0, None, None, "", "", 0)], SCHEMA)
        before = sorted(r.item_row for r in store.winners().collect())
        done = []

        def dying(self, path, *a, **o):
            real(self, path, *a, **o)
            done.append(path)
            if len(done) > k:
                raise OSError("gone")

        def gone(self, m):
            raise OSError("gone")

        with monkeypatch.context() as mp:
            mp.setattr(DataFrameWriter, "parquet", dying) if k < 4 else mp.setattr(DeliveryStore, "_publish", gone)
            try:
                store.merge(batch, ("s", k))
                raise AssertionError("it should have died")
            except OSError:
                pass
        again = DeliveryStore(spark, store.root, entry_key(), "item_row", lambda col: col("batch_id"))
        assert sorted(r.item_row for r in again.winners().collect()) == before
        again.merge(batch, ("s", k))
        again.merge(batch, ("s", k))  # a batch that was merged changes nothing
        rows = [r.item_row for r in again.winners().collect()]
        assert sorted(rows) == sorted([x for x in before if x != min(b for b in before if b <= 1 and b != 0)] + [-1 - k, 100 + k, 200 + k])
    folders = {s.getPath().getName() for s in store.fs.listStatus(store.fs_path(store.root)) if s.getPath().getName().startswith("v")}
    store.vacuum()
    left = {s.getPath().getName() for s in store.fs.listStatus(store.fs_path(store.root)) if s.getPath().getName().startswith("v")}
    assert len(folders) == 11 and len(left) == 6  # the attempts that died are gone
    assert sorted(r.item_row for r in store.winners().collect()) == sorted(rows)


def test_the_second_writer_of_a_version_fails(spark):
    import pytest

    store = DeliveryStore(spark, scratch_path(spark, "t"), entry_key(), "item_row", lambda col: col("batch_id"))
    store.merge(spark.createDataFrame([(1, 0, 0, "a", None, "", "", 0)], SCHEMA))
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(store._manifest())

    # without hard links the next version is published all the same, and an old one isn't overwritten
    class Files:
        def __init__(self, real):
            self.createLink, self.move = self.refuse, real.move

        def refuse(self, *a):
            raise OSError("Operation not supported")

    class Jvm:
        def __init__(self, real):
            self.org, self.java = real.org, type("J", (), {"nio": type("N", (), {"file": type("F", (), {"Files": Files(real.java.nio.file.Files), "Path": real.java.nio.file.Path, "CopyOption": real.java.nio.file.CopyOption})})})

    store.jvm = Jvm(store.jvm)
    store.merge(spark.createDataFrame([(2, 0, 0, "b", None, "", "", 0)], SCHEMA))
    assert sorted(r.item_row for r in store.winners().collect()) == [1, 2]
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(store._manifest())


def test_many_merges_are_compacted(spark):
    store = DeliveryStore(spark, scratch_path(spark, "t"), entry_key(), "item_row", lambda col: col("batch_id"), buckets=2)
    for k in range(12):
        store.merge(spark.createDataFrame([(k, 0, 0, f"e{k}", None, "", "", 0), (20 + k, 0, 0, "same", None, "", "", 0)], SCHEMA))
    m = store._manifest()
    assert all(len(d) <= 8 for d in m["index"].values()) and all(len(d) <= 9 for d in m["parts"].values())
    assert sorted(r.item_row for r in store.winners().collect()) == [*range(12), 20]


def test_hot_key_stays_small(spark):
    """Partial aggregation comes before the exchange."""
    df = spark.range(1000).select(F.col("id").alias("item_row"), F.lit(0).alias("feed_idx"), F.lit(0).alias("batch_id"), F.lit("a").alias("id"), F.lit("").alias("url"))
    plan = keep_first(df, entry_key(), "item_row")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
