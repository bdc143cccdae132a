"""The batch transformations over streams of documents and deliveries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import feeds
from feedloom.operators.redelivery import DeliveryStore


def stream_items(docs: DataFrame, event_time: str = "fetched_at", lateness: str = "30 days") -> DataFrame:
    """Items of a stream of documents, each id of a feed once within the lateness.  Which copy stays is the order of arrival."""
    keep = docs.select("feed_idx", "page", "body", "source_url", "content_type", event_time).withWatermark(event_time, lateness)
    parsed = feeds.parse(keep).where("parsed.error is null").select("feed_idx", "page", event_time, F.posexplode("parsed.items").alias("pos", "item"))
    return parsed.select("feed_idx", "page", "pos", event_time, "item.*").dropDuplicatesWithinWatermark(["feed_idx", "id"])


def first_occurrences(docs_items: DataFrame) -> DataFrame:
    """Exact keep-first by feed, without a watermark: one small state for each id of a feed; within a batch the first by (page, pos) stays.

    The frames of an id are folded one by one, so an id with a third of all rows costs no more memory than another.
    """
    import pandas as pd

    schema = docs_items.schema

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = None
        for f in frames:
            best = pd.concat([f] if best is None else [best, f]).nsmallest(1, ["page", "pos"])
        if best is not None and not state.exists:
            state.update((True,))
            yield best

    return docs_items.groupBy("feed_idx", "id").applyInPandasWithState(step, schema, "seen boolean", "append", "NoTimeout")


def into_store(stream: DataFrame, store: DeliveryStore, checkpoint: str, name: str = "deliveries"):
    """Merge every micro-batch of deliveries into a store.  The batch's number is part of the manifest that publishes it, so a batch that is
    tried again, after whatever step it died, is merged once; ``name`` tells streams into one store apart and goes with their checkpoint."""
    return stream.writeStream.foreachBatch(lambda batch, n: store.merge(batch, (name, n)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 1) -> DataFrame:
    """A parquet table as a stream of its files, whether it is a file or a folder."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if is_file else reader.parquet(path)


def deliveries(spark: SparkSession, sf_dir: str, root: str, key: Column, order: str, home, *columns: str) -> DataFrame:
    """Winners of the items table delivered as a stream."""
    store = DeliveryStore(spark, root, key, order, home)
    into_store(read_table(spark, sf_dir, "items").select(*columns), store, f"{root}/checkpoint").awaitTermination()
    return store.winners()
