"""Keep one row per key over data that arrives in batches.

``dedup.keep_one`` ranks a whole table.  A ``WinnerTable`` stores the winners,
dealt over ``parts`` directories by the hash of the key; a batch is reduced to
its own winners, meets the stored winners of the parts it touches (the others
are pruned, not read), and replaces those parts alone.  The order is total (ties
go to the remaining columns), so batches may come in any order, overlap or be
repeated: the table always holds what one pass over all rows would keep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators.dedup import keep_one
from revlens.session import written


class WinnerTable:
    """Winners by ``keys`` in the order of ``order_by`` (and ``tie_break``), stored under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: Sequence[str], order_by: str, descending: bool,
                 tie_break: Sequence[str] = (), parts: int = 64):
        self.spark, self.path, self.schema, self.keys, self.parts = spark, path, schema, list(keys), parts
        self._keep = lambda df: keep_one(df, self.keys, order_by, descending, list(tie_break))
        self._columns = [f.name for f in schema.fields]

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _stored(self) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        return self.spark.read.schema(f"{schema}, _part int").parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        """Replace the parts that occur in ``rows``, a file each: every part is one task's."""
        rows.repartition(self.parts, "_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(self.path)

    def merge(self, batch: DataFrame) -> None:
        """Take a batch in.  Merging one again, after a failure half-way or by mistake, changes nothing."""
        new = written(self._keep(batch.select(*self._columns)).withColumn("_part", self._part()), "batch-winners")
        touched = [r[0] for r in new.select("_part").distinct().collect()]  # ``parts`` numbers at most
        if not touched:
            if not self._exists():
                self._write(new)
            return
        if self._exists():
            old = self._stored().where(F.col("_part").isin(touched))
            both = self._keep(old.unionByName(new).select(*self._columns))
            new = written(both.withColumn("_part", self._part()), "merged-winners")  # written apart before what it reads is replaced
        self._write(new)

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        """The winners so far."""
        return self._stored().select(*self._columns)
