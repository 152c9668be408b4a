"""Numbered touch paths: every touch of a contact with its place in the contact's path.

``ROW_NUMBER() OVER (PARTITION BY contact_id ORDER BY ts, ...)`` brings a
contact's touches into one task.  Here the numbers come from prefix sums:

1. touches are range-partitioned by (contact, ts, channel, id), so a busy
   contact's path runs over several partitions, in order; the partitioned rows
   are written with the number of their partition;
2. a touch is numbered within (partition, contact);
3. the counts per (contact, partition), one small row each, are summed up over
   the partitions before: the offset that turns the numbers of step 2 into
   places in the whole path.

An order's touches are the first n of its contact's path, where n is the place
of the last touch on or before the booking day.  So a path is stored once per
contact, an order is (contact, n), its first touch is place 1 and its last is
place n: no pair of order and touch is formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import day_ceiling
from revlens.operators.attribution import as_of, booking_days
from revlens.session import written

ORDER = ["ts", "touch_type", "touch_id"]


def touch_index(touches: DataFrame, partitions: int | None = None) -> DataFrame:
    """``touches`` with a contact and an instant, and ``touch_no``: 1, 2, ... per contact by instant, channel (NULL first), id.

    Equal rows get different numbers.  ``partitions``: of the range
    partitioning, the shuffle partitions of the session unless given.
    """
    known = touches.where(F.col("contact_id").isNotNull() & F.col("ts").isNotNull())
    n = partitions or int(touches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(known.repartitionByRange(n, "contact_id", *ORDER).withColumn("_part", F.spark_partition_id()), "touch-ranges")
    here = Window.partitionBy("_part", "contact_id").orderBy(*ORDER)
    before = Window.partitionBy("contact_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("contact_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = written(counts.select("contact_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "touch-offsets")
    numbered = placed.withColumn("_no", F.row_number().over(here))
    return numbered.join(offsets, ["contact_id", "_part"]).select(*touches.columns, (F.col("_before") + F.col("_no")).cast("bigint").alias("touch_no"))


def path_lengths(won: DataFrame, indexed: DataFrame) -> DataFrame:
    """Won sales with a qualifying touch, and ``touches``: how long a prefix of their contact's path is theirs."""
    last = indexed.groupBy("contact_id", day_ceiling("ts").alias("day")).agg(F.max("touch_no").alias("touches"))
    at = as_of(booking_days(won), last, ["contact_id"], [], [], ["touches"]).select("contact_id", F.col("day").alias("booked_at"), "touches")
    return won.join(at, ["contact_id", "booked_at"]).select(*won.columns, "touches")


def order_path_ends(won: DataFrame, touches: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per won sale with a touch: its columns, ``touches``, and id, instant and channel of its first and last touch."""
    won = written(won, "won_sales")
    indexed = written(touch_index(touches, partitions), "touch-index")
    rows = path_lengths(won, indexed)
    end = lambda name: indexed.select("contact_id", F.col("touch_no").alias(f"_{name}"), F.col("touch_id").alias(f"{name}_touch_id"),
                                      F.col("ts").alias(f"{name}_touch_ts"), F.col("touch_type").alias(f"{name}_touch_type"))
    first = end("first").where(F.col("_first") == 1).drop("_first")
    return (rows.join(first, "contact_id")
                .withColumn("_last", F.col("touches")).join(end("last"), ["contact_id", "_last"]).drop("_last")
                .select(*won.columns, "touches", *[f"{p}_touch_{c}" for p in ("first", "last") for c in ("id", "ts", "type")]))
