"""Name -> DataFrame catalog over raw and staged tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    """Lazily resolved tables.

    Each entry is a zero-argument factory so that nothing is read until an
    operator asks for it, and a query only scans the tables it uses.
    ``dbo.sales_stg`` and ``sales_stg`` name the same table.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._factories: dict[str, Callable[[], DataFrame]] = {}
        self._frames: dict[str, DataFrame] = {}

    @staticmethod
    def _norm(name: str) -> str:
        name = name.strip().lower()
        return name.split(".", 1)[1] if name.startswith("dbo.") else name

    def register(self, name: str, factory: Callable[[], DataFrame] | DataFrame) -> None:
        key = self._norm(name)
        if isinstance(factory, DataFrame):
            frame = factory
            factory = lambda: frame
        self._factories[key] = factory
        self._frames.pop(key, None)

    def __contains__(self, name: str) -> bool:
        return self._norm(name) in self._factories

    def __getitem__(self, name: str) -> DataFrame:
        key = self._norm(name)
        if key not in self._frames:
            if key not in self._factories:
                raise KeyError(f"unknown table {name!r}; known: {sorted(self._factories)}")
            self._frames[key] = self._factories[key]()
        return self._frames[key]

    def names(self) -> list[str]:
        return sorted(self._factories)

    def read_parquet(self, name: str, path: str, schema=None) -> None:
        """Register a Parquet table; with ``schema`` no inference happens."""
        def load():
            reader = self.spark.read
            if schema is not None:
                reader = reader.schema(schema)
            return reader.parquet(path)
        self.register(name, load)
