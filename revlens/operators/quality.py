"""Data-quality operators: duplicate keys, invalid values, domains, rejects, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.operators.dedup import keep_one
from revlens.session import written
from revlens.sources.schemas import dictionary_rows

# Fixed value from the contact cleaning script: a valid email is x@y.com.
VALID_EMAIL_PATTERN = "%@%.com"

# Raw tables whose pipeline de-duplicates.
STAGING_SHUFFLES = {"crm_contacts", "leads"}


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once (``key IN (... HAVING COUNT(*) > 1)``).

    Key counts are a hash aggregate with map-side combine.  The repeated keys
    are written and joined back, so the semi join has a shuffle on both sides
    and AQE splits the rows of a hot key over several tasks.
    """
    keys = list(keys)
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)
    return df.join(written(again, "repeated-keys"), keys, "left_semi")


def duplicate_keys(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per check: name, keys that occur more than once, and the rows that have them."""
    parts = []
    for name, (df, keys) in tables.items():
        n = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        parts.append(n.agg(F.count(F.lit(1)).alias("repeated_keys"), F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows"))
                      .select(F.lit(name).alias("check"), "repeated_keys", "rows"))
    return _union(parts)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedup_preview(df: DataFrame, keys: Sequence[str], order_by: str, descending: bool,
                  tie_break: Sequence[str] | None = None) -> DataFrame:
    """Rows a keep-one de-duplication removes (the ``rn > 1`` rows).

    Only rows of repeated keys can go, so the difference is taken on those.
    Rows without a key form one group, as in the ranking.
    """
    keys = list(keys)
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*[F.col(k).alias(f"_{k}") for k in keys])
    again = written(again, "repeated-keys")
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(again[f"_{k}"])
    rows = written(df.join(again, same, "left_semi"), "repeated-rows")
    return rows.exceptAll(keep_one(rows, keys, order_by, descending, tie_break).select(*df.columns))


def invalid_emails(contacts: DataFrame, pattern: str = VALID_EMAIL_PATTERN) -> DataFrame:
    """Contacts whose email is NULL or does not match ``pattern``."""
    e = F.col("email")
    return contacts.where(e.isNull() | ~e.like(pattern))


def domain_values(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct values of columns with their row counts: column, value, rows.

    The columns are unpivoted, so one aggregate over the table counts them all.
    """
    pairs = [x for c in cols for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    long = df.select(F.stack(F.lit(len(cols)), *pairs).alias("column", "value"))
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def distinct_count(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """One row: COUNT(DISTINCT col)."""
    return df.agg(F.count_distinct(col).alias(name or f"distinct_{col}_count"))


def lookup_key(df: DataFrame, col: str, value) -> DataFrame:
    """Rows of one key (a filter that the scan gets where the column is stored as such)."""
    return df.where(F.col(col) == F.lit(value))


def rejects(raw: DataFrame, converted: Mapping[str, Column]) -> DataFrame:
    """Per column: values of ``raw`` that its conversion turns to NULL (column, rejected).

    One projection and one global count over the raw table: no join, so rows
    without a key and repeated keys count once each.
    """
    cols = list(converted)
    flags = raw.select(*[(F.col(f"`{c}`").isNotNull() & converted[c].isNull()).alias(f"_{i}") for i, c in enumerate(cols)])
    counted = flags.agg(*[F.count_if(f"_{i}").alias(f"_{i}") for i in range(len(cols))])
    return counted.select(F.stack(F.lit(len(cols)), *[x for i, c in enumerate(cols) for x in (F.lit(c), F.col(f"_{i}"))]).alias("column", "rejected"))


def table_rejects(tables: Mapping[str, tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """``rejects`` of several tables: table, column, rejected."""
    return _union([rejects(raw, exprs).select(F.lit(t).alias("table"), "column", "rejected") for t, (raw, exprs) in tables.items()])


def observed_rejects(stage, raw: DataFrame, converted: Mapping[str, Column], name: str) -> tuple[DataFrame, dict[str, int]]:
    """Stage a raw table, written, and count its rejects in the same scan.

    ``stage`` is the table's pipeline.  The counts are metrics of the job that
    writes (``DataFrame.observe``): column -> values that its conversion turned
    to NULL.  Spark counts the metrics of a task that is run again before a
    shuffle twice, so the observed job has none: a pipeline with a shuffle
    (de-duplication) reads the raw rows from the observed job's table.
    """
    seen = Observation(f"{name}-rejects")
    rows = raw.observe(seen, *[F.count_if(F.col(f"`{c}`").isNotNull() & e.isNull()).alias(c) for c, e in converted.items()])
    if STAGING_SHUFFLES.intersection([name]):
        staged = written(stage(written(rows, f"{name}-raw")), f"{name}-staged")
    else:
        staged = written(stage(rows), f"{name}-staged")
    return staged, {c: int(seen.get[c]) for c in converted}


def distinct_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Exact COUNT(DISTINCT c) of every column at once: column, distinct_values.

    COUNT(DISTINCT a), COUNT(DISTINCT b), ... would multiply every row by the
    number of columns inside one aggregate and keep all their values in its
    keys.  Here the columns are unpivoted to (column, value), values are made
    distinct with a partial aggregate, and what is left is counted per column:
    two shuffles, the second of one row a task and column.

    Values are compared as text that is unique within a type: -0.0 and 0.0 are
    one value, as in COUNT(DISTINCT); nested values go through JSON.
    """
    types = dict(df.dtypes)
    cols = list(cols or df.columns)

    def text(c: str) -> Column:
        col, kind = F.col("`" + c.replace("`", "``") + "`"), types[c]
        if kind in ("double", "float"):
            col = F.when(col == 0, F.lit(0.0)).otherwise(col)
        if kind == "binary":
            return F.hex(col)
        return F.to_json(F.struct(col)) if kind.startswith(("struct", "array", "map")) else col.cast("string")

    long = df.select(F.stack(F.lit(len(cols)), *[x for i, c in enumerate(cols) for x in (F.lit(i), F.when(F.col("`" + c.replace("`", "``") + "`").isNotNull(), text(c)))]).alias("_i", "_v"))
    counted = long.distinct().groupBy("_i").agg(F.count("_v").alias("distinct_values"))
    return counted.select(F.element_at(F.array(*map(F.lit, cols)), F.col("_i") + 1).alias("column"), "distinct_values")


def profile(df: DataFrame, table: str, keys: Sequence[str] = (), estimate_distinct: bool = False, exact_distinct: bool = False) -> DataFrame:
    """Column profile in one pass over the table.

    table, column, type, is_key, rows, nulls, min, max; with
    ``estimate_distinct`` also approx_distinct, a HyperLogLog estimate
    (2% error), so the profile stays a single aggregation at any size; with
    ``exact_distinct`` also distinct_values, from a second pass
    (``distinct_counts``).
    """
    cols = df.columns
    named = [F.col("`" + c.replace("`", "``") + "`") for c in cols]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, col in enumerate(named):
        aggs += [F.count_if(col.isNull()).alias(f"_n{i}"), F.min(col).cast("string").alias(f"_lo{i}"), F.max(col).cast("string").alias(f"_hi{i}")]
        if estimate_distinct:
            aggs.append(F.approx_count_distinct(col, 0.02).alias(f"_d{i}"))
    types, keyset = dict(df.dtypes), set(keys)
    extra = ["approx_distinct"] if estimate_distinct else []
    cells = [x for i, c in enumerate(cols) for x in (
        F.lit(c), F.lit(types[c]), F.lit(c in keyset), F.col(f"_n{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}"), *([F.col(f"_d{i}")] if extra else []))]
    long = df.agg(*aggs).select("rows", F.stack(F.lit(len(cols)), *cells).alias("column", "type", "is_key", "nulls", "min", "max", *extra))
    out = long.select(F.lit(table).alias("table"), "column", "type", "is_key", "rows", "nulls", "min", "max", *extra)
    if exact_distinct:
        out = out.join(distinct_counts(df), "column", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)).cast("bigint"))
    return out


def data_dictionary(spark: SparkSession) -> DataFrame:
    """(table, column, type, is_key) of the declared staged schemas."""
    schema = T.StructType([T.StructField("table", T.StringType()),
                           T.StructField("column", T.StringType()),
                           T.StructField("declared_type", T.StringType()),
                           T.StructField("declared_key", T.BooleanType())])
    return spark.createDataFrame(dictionary_rows(), schema)


def profile_with_dictionary(df: DataFrame, table: str, keys: Sequence[str] = ()) -> DataFrame:
    """Profile joined to the declared dictionary (declared vs actual type)."""
    d = data_dictionary(df.sparkSession).where(F.col("table") == table).drop("table")
    return profile(df, table, keys, exact_distinct=True).join(F.broadcast(d), "column", "left")
