"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A text's shingles are its runs of five white-space-separated words (the whole
sequence if it has fewer).  Each is hashed to 48 bits; the sketch is the k
smallest distinct hashes, ascending.  Sketches of parts merge to the sketch of
the whole: the k smallest of their union.  From sketches alone follow
estimates of resemblance (the share of the union's k smallest that both have),
distinct shingles ((k - 1) / the k-th smallest, as a share of the hash range)
and containment.  Sketches of fewer than k hashes hold every shingle, so their
estimates are exact.

Defined results: null and empty texts have an empty sketch, "" as fingerprint,
and likeness 1 to another empty one, 0 to any other; equal texts have equal
fingerprints; repeated rows each get a row; null ids come after all others in
descending order; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Hashes kept: a standard error of sqrt(J (1 - J) / K), at most 0.045.
K = 128
SHINGLE_WORDS = 5
HASH_BITS = 48
SEPARATOR = r"[\x20\x09-\x0D]+"


def with_sketch(df: DataFrame, text_col: str, out: str, k: int = K, words: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` with the sketch of ``text_col`` as an ascending array of longs."""
    w, h = f"__{out}_words", f"__{out}_hashes"
    count = F.size(F.col(w))
    gram = lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(F.col(w), i, words)), 64 - HASH_BITS)
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(count - (words - 1), F.lit(1))), gram)
    split = df.withColumn(w, F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), SEPARATOR), ""))
    hashed = split.withColumn(h, F.when(count > 0, hashes).otherwise(F.array().cast("array<bigint>")))
    return hashed.withColumn(out, F.slice(F.sort_array(F.array_distinct(F.col(h))), 1, k)).drop(w, h)


def text_of(sketch: Column) -> Column:
    """The sketch as a string: 8 base64 characters a hash."""
    hexes = F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), HASH_BITS // 4, "0")), "")
    return F.translate(F.base64(F.unhex(hexes)), "\r\n", "")  # without line breaks


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two shingle sets."""
    lowest = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), lowest))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(lowest), F.lit(1)))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below k)."""
    top = F.element_at(sketch, k)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * F.lit(2.0 ** HASH_BITS) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    share = resemblance(a, b, k) * distinct_shingles(union, k) / F.greatest(distinct_shingles(a, k), F.lit(1.0))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def merge(parts: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    Hashes are made distinct with a partial aggregate and ranked with a
    per-task limit, so a key with a third of all parts is no single task's
    load, and at most k hashes are gathered per key.
    """
    hashes = parts.select(key, F.explode_outer(sketch).alias("h")).distinct()
    rank = Window.partitionBy(key).orderBy(F.col("h").asc_nulls_last())
    low = hashes.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k)
    return low.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def _buckets(ids: DataFrame, n: int) -> list:
    """At most n ascending upper bounds of id ranges of about equal size."""
    got = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] if n > 1 else []
    return sorted(set(got or []))


def _bucket_of(bounds: list) -> Column:
    """How many bounds lie below the id: found in two steps of about sqrt(n) comparisons. -1 without an id."""
    below = F.lit(0)
    if bounds:
        step = math.isqrt(len(bounds)) + 1
        every, heads = F.lit(np.array(bounds, np.int64)), F.lit(np.array(bounds[step - 1::step], np.int64))
        rows = F.size(F.filter(heads, lambda x: x < F.col("id")))
        below = rows * step + F.size(F.filter(F.slice(every, rows * step + 1, step), lambda x: x < F.col("id")))
    return F.when(F.col("id").isNull(), F.lit(-1)).otherwise(below)


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, ghost, id, text, next_text) for windows over documents in descending id order, next of the last = the first.

    Ids are cut into ranges, a few per shuffle partition, from quantiles; each
    range is one window group.  The first rows of a range also go, as ghosts,
    behind the last row of the range before it, so every row finds its
    successor in its own group.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", _bucket_of(_buckets(rows.select("id"), n)))
    tops = sorted(((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("id").alias("top")).collect()), reverse=True)  # n + 1 rows at most
    follow = [(tops[(i + 1) % len(tops)][0], tops[(i + 1) % len(tops)][1], tops[i][0]) for i in range(len(tops))]
    heads = F.broadcast(spark.createDataFrame(follow, "b int, top bigint, to int"))
    sent = rows.join(heads, (rows["bucket"] == heads["b"]) & rows["id"].eqNullSafe(heads["top"]), "left")
    here = F.struct(F.col("bucket"), F.lit(0).alias("ghost"))
    there = F.struct(F.col("to").alias("bucket"), F.lit(1).alias("ghost"))
    placed = sent.select("id", "text", F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("p"))
    placed = placed.select("id", "text", F.col("p.bucket").alias("bucket"), F.col("p.ghost").alias("ghost"))
    return placed.withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("bucket").orderBy("ghost", F.col("id").desc_nulls_last(), "text")


def compare_with_edit(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the sketches of the text, of its edited text (its last third replaced by the start of the next document) and of the next document."""
    beside = beside_next(docs, id_col, text_col)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = with_sketch(beside, "text", "sketch", k).withColumn("next_sketch", F.lead("sketch").over(_order())).filter("ghost = 0")
    rows = rows.select("id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return with_sketch(rows, "edited", "edited_sketch", k).withColumnRenamed("id", id_col)


def digest(found: DataFrame, k: int = K, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``compare_with_edit``'s rows."""
    return found.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of(F.col("sketch")).alias("fingerprint"),
        text_of(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"), F.round(distinct_shingles(F.col("sketch"), k), 1).alias("distinct_shingles"))
