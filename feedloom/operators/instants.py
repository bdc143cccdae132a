"""Normalise timestamp columns of a table whose rows belong to feeds with known zones."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.timestamps import instants, zone_book

#: Rows of the zone table up to which it is broadcast; beyond, Spark joins by shuffle.
ZONES_BROADCAST = 100_000


def normalized(rows: DataFrame, feeds: DataFrame, row_id: str, fields: tuple[str, ...], scope: str = "feed_idx", zone: str = "time_zone") -> DataFrame:
    """``row_id, field, epoch_us bigint, already boolean`` for every value that denotes exactly one instant.

    ``already``: the text is written in the target form, so nothing had to be changed.  The texts of rows whose
    feed is unknown or has no zone count only if they carry their own zone.  Null, empty or impossible values give no row.
    """
    zones = feeds.select(F.col(scope).alias("__scope"), F.col(zone).alias("__zone"))
    # One row per feed; the count is a cheap read of the footers and decides the join.
    if feeds.count() <= ZONES_BROADCAST:
        zones = F.broadcast(zones)
    slim = rows.select(row_id, scope, *fields).where(" or ".join(f"`{f}` <> ''" for f in fields))
    joined = slim.join(zones, F.col(scope) == F.col("__scope"), "left").select(row_id, *fields, "__zone")
    kind = rows.schema[row_id].dataType.simpleString()
    book = rows.sparkSession.sparkContext.broadcast(zone_book())  # under 1 MB, of one version for all workers
    return joined.mapInArrow(partial(instants, fields=fields, zone="__zone", keep=row_id, book=book), f"`{row_id}` {kind}, field string, epoch_us bigint, already boolean")
