"""Catalog over a user's own raw CRM tables.

    cat = load_crm(spark, {"sales": "s3://bucket/crm/sales", "leads": ..., ...})
    report = attribution.single_touch_by_channel(
        attribution.first_touch(won_sales_of(cat), touches_from(cat)))

Each raw table is registered as given (Parquet by default, or CSV with a
header); the staged ``*_stg`` tables are the staging pipelines applied to
them, exactly as for the benchmark adapter.  Tables that are not supplied
are simply absent; ``subscriptions`` has no staging script and is used as
given (``subscriptions_stg``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.operators import attribution as A
from revlens.operators import staging as stg
from revlens.sources.catalog import Catalog
from revlens.sources.schemas import STAGED, raw_types


def load_crm(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet",
             schemas: Mapping[str, Mapping[str, T.DataType]] | None = None) -> Catalog:
    """Register raw tables from ``paths`` and their staged versions.

    CSV files hold text only, so their columns get the declared raw types
    (``sources.schemas.raw_types``, or ``schemas[table]``); dates and amounts
    that a staging pipeline converts stay text for it.  A CSV table without a
    declared schema is refused.
    """
    cat = Catalog(spark)
    for name, path in paths.items():
        if name not in stg.PIPELINES:
            raise KeyError(f"unknown raw table {name!r}; known: {sorted(stg.PIPELINES)}")
        types = (schemas or {}).get(name)
        if fmt == "csv" and types is None:
            if f"{name}_stg" not in STAGED:
                raise ValueError(f"a CSV table needs a schema: pass schemas[{name!r}]")
            types = raw_types(name)
        cat.register(name, _reader(spark, path, fmt, types))
    stg.register_staged(cat, paths)
    return cat


def _reader(spark: SparkSession, path: str, fmt: str, types: Mapping[str, T.DataType] | None):
    def load() -> DataFrame:
        r = spark.read.format(fmt)
        df = (r.option("header", True) if fmt == "csv" else r).load(path)
        return df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in (types or {}) else F.col(f"`{c}`") for c in df.columns])
    return load


def won_sales_of(cat: Catalog) -> DataFrame:
    """Won sales with contact from a catalog's staged sales, opportunities and leads."""
    return A.won_sales(cat["sales_stg"], cat["opportunities_stg"], cat["leads_stg"])
