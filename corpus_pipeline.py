"""From raw documents to packed training sequences, stage by stage.

Every stage calls one operator of ``revlens.llm`` on all rows the stage before
it kept, and its decisions take effect:

1. language_id     documents without a letter, or of no language with any evidence, go
2. near_dedup      of each group of linked SimHash fingerprints the smallest doc_id stays
3. decontaminate   documents that hold benchmark windows in 1/20 of their words or more go
4. secret_scan     every secret found is replaced by a mark, n_chars follows
5. pack            the documents' tokens in sequences of at most 2048

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.llm import decontaminate, language_id, packing, secret_scan, simhash
from revlens.session import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return language_id.keep_identified(docs, model, least=0.25)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("decontaminate", remove_benchmark),
    ("secret_scan", mask_secrets),
    ("pack", pack),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the table ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
