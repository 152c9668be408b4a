"""Sinks: staged tables and report marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from revlens.session import written


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), bucket: tuple[int, Sequence[str]] | None = None,
                table: str | None = None) -> None:
    """Write a staged table or a mart (``SELECT ... INTO``).

    ``partition_by`` gives directory partitions (prune by month, say);
    ``bucket=(n, keys)`` with ``table`` writes a bucketed catalog table so a
    later join on ``keys`` needs no shuffle of this side.
    """
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket:
        n, keys = bucket
        w = w.bucketBy(n, *keys).sortBy(*keys)
        w.option("path", path).saveAsTable(table or path.rstrip("/").rsplit("/", 1)[-1])
        return
    w.save(path)


# Rows of one exported file, about.
FILE_ROWS = 100_000


def export_report(df: DataFrame, path: str, fmt: str = "csv", order_by: Sequence[str] = ()) -> None:
    """Export a result as files with a header that, in the order of their names, are the rows by ``order_by`` (else by all columns).

    The result is written in parallel and its rows counted; it is then cut into
    ranges of about ``FILE_ROWS`` rows, each sorted and written by a task of its
    own.  A report thus is one file, a detail table as many as it needs.
    """
    report = written(df, "report")
    files = max(1, -(-report.count() // FILE_ROWS))
    order = list(order_by or df.columns)
    write_table(report.repartitionByRange(files, *order).sortWithinPartitions(*order), path, fmt=fmt)


def read_back(spark: SparkSession, path: str, fmt: str = "csv", schema=None) -> DataFrame:
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)
