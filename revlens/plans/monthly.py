"""Monthly marts refreshed by month.

A monthly report is a sum over its month's detail rows, so a change in one
month's rows concerns that month's partition alone.  ``MonthlyMart`` keeps, next
to the mart, one line of statistics a month (rows and a checksum of all detail
rows).  A refresh compares them in one aggregate over the details, recomputes
the months that differ, and overwrites their partitions; the files of the other
months are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import written

MONTH = "month_start"


class MonthlyMart:
    """A report under ``path``, a partition a month.

    ``build`` makes the report from detail rows that have a ``month_start``; it
    must give the months of its input, each from that month's rows alone.  A
    NULL month is a month.
    """

    def __init__(self, spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.build, self._schema = spark, path.rstrip("/"), build, None
        self._known: DataFrame | None = None

    def _statistics(self, details: DataFrame) -> DataFrame:
        """month_start, rows, sum: of a 64-bit hash of every row, so the order of rows does not matter and repeated rows do."""
        digest = F.xxhash64(*[F.col(c) for c in details.columns]).cast("decimal(38,0)")
        return details.groupBy(MONTH).agg(F.count(F.lit(1)).alias("rows"), F.sum(digest).alias("sum"))

    def refresh(self, details: DataFrame) -> list:
        """Bring the mart up to ``details``; returns the months that were written, in order."""
        now = written(self._statistics(details), "month-statistics")
        if self._known is None:
            changed = now
        else:
            old = self._known.select(F.col(MONTH).alias("_m"), F.col("rows").alias("_rows"), F.col("sum").alias("_sum"))
            same = now[MONTH].eqNullSafe(old["_m"]) & (now["rows"] == old["_rows"]) & now["sum"].eqNullSafe(old["_sum"])
            changed = now.join(old, same, "left_anti")
        months = [r[0] for r in changed.select(MONTH).collect()]  # one value a month
        if months or self._schema is None:
            wanted = F.col(MONTH).isin([m for m in months if m is not None])
            rows = details.where(wanted | F.col(MONTH).isNull() if None in months else wanted)
            report = written(self.build(rows), "changed-months")
            self._schema = report.schema
            report.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(self.path)
        self._known = now
        return sorted(months, key=lambda m: (m is not None, m))

    def read(self) -> DataFrame:
        """The report of the months that have detail rows now."""
        stored = self.spark.read.schema(self._schema).parquet(self.path)
        live = self._known.select(F.col(MONTH).alias("_m"))
        return stored.join(live, stored[MONTH].eqNullSafe(live["_m"]), "left_semi")
