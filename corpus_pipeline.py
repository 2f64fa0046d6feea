"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes all that the stage before it kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import decontaminate, line_dedup, minhash, mixing, quality
from sievewright.llm._common import stored, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line passages; those of which nothing is left go."""
    cut = line_dedup.dedup_lines(docs)
    text, n_lines, n_removed = map(F.col, cut.columns[-3:])
    cut = cut.where((n_removed == 0) | (n_removed < n_lines))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*(F.when(n_removed > 0, changed[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of ``copies`` of each (``copies_`` where the table has such a column)."""
    taken = mixing.mix_sources(docs, keep=True)
    return taken.withColumnRenamed(taken.columns[-1], unused(docs, "copies")[0])


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near dedup", near_dedup),
    ("decontamination", without_benchmark),
    ("mixing", mix),
]

#: Order MinHash and the SimHash windows have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
