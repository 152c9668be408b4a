"""Staged tables that are really stored, bucketed by their join keys.

``SELECT * INTO x_stg`` keeps a copy of the cleaned table.  Here that copy is a
bucketed table in the session catalog, its files in the shared folder: rows are
dealt over ``buckets`` files by the hash of the key and sorted by it.  Tables
stored by the same key with the same number of buckets join without a shuffle
on either side, each bucket with its partner, as often as they are read.

Storing shuffles a table once, so it pays from the second join on.  All rows of
one key are in one bucket: store by keys that are nearly unique (lead_id,
opportunity_id, order_id), not by contact or channel.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import scratch_path
from revlens.sources.marts import write_table


class StagedStore:
    """Bucketed copies of staged tables, by name.  ``buckets``: the shuffle partitions of the session unless given."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._run = uuid.uuid4().hex[:12]
        self._tables: dict[str, str] = {}

    def store(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """Write ``df`` by ``key`` (one file a bucket) and return the stored table.  NULL keys are rows like any other."""
        table = f"{re.sub(r'[^a-z0-9_]', '_', name.lower())}_{self._run}"
        dealt = df.repartition(self.buckets, key)  # as the buckets are, so that a task writes one file and not one a bucket
        write_table(dealt, scratch_path(self.spark, name), bucket=(self.buckets, [key]), table=table)
        self._tables[name] = table
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.table(self._tables[name])

    def drop(self) -> None:
        """Forget the tables; their files go with the application's other scratch files."""
        for table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()


def store_deals(store: StagedStore, leads: DataFrame, opportunities: DataFrame, sales: DataFrame) -> None:
    """Store what the sale -> opportunity -> lead chain reads.

    leads_stg by lead_id; opportunities_stg and sales_stg by opportunity_id;
    and deals_stg, every opportunity with its sales (NULL without one), by
    lead_id: the first link of the chain, joined bucket by bucket.
    """
    store.store("leads_stg", leads, "lead_id")
    o = store.store("opportunities_stg", opportunities, "opportunity_id")
    s = store.store("sales_stg", sales, "opportunity_id").withColumnRenamed("opportunity_id", "_opp").withColumn("_sold", F.lit(True))
    deals = o.join(s, o.opportunity_id == s._opp, "left").withColumn("has_sale", F.col("_sold").isNotNull())
    store.store("deals_stg", deals.drop("_opp", "_sold"), "lead_id")


def stored_won_sales(store: StagedStore) -> DataFrame:
    """order_id, sale_amount, booked_at, contact_id of won sales, from the stored tables without a shuffle."""
    won = store["deals_stg"].where((F.col("win_flag") == 1) & F.col("has_sale"))
    return won.join(store["leads_stg"].select("lead_id", "contact_id"), "lead_id").select(
        "order_id", F.col("booked_amount").alias("sale_amount"), "booked_at", "contact_id")


def stored_lead_base(store: StagedStore) -> DataFrame:
    """``funnel.lead_base`` from the stored tables without a shuffle."""
    lead = store["leads_stg"].select("lead_id", F.col("source").alias("lead_source"), "created_at",
                                     F.col("mql_flag").alias("mql_status"), F.col("sql_flag").alias("sql_status"))
    deal = store["deals_stg"].select(F.col("lead_id").alias("_lead"), "opportunity_id", "stage", F.col("amount").alias("pipeline_amount"),
                                     "win_flag", "order_id", F.col("booked_amount").alias("revenue"))
    return lead.join(deal, lead.lead_id == deal._lead, "left").drop("_lead")
