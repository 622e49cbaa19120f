"""A corpus pipeline over ``documents``: language, copies, secrets, mixture, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again. A null or empty text
has no letter and goes in the first stage; what else a table holds (null ids, sources or languages,
repeated rows, further columns) passes as the operators define it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logmill.llm import language, mixing, ngram_join, packing, secret_scan
from logmill.llm.common import scratch, table
from logmill.session import configure


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the predicted language; documents without one (``und``) go."""
    machines = language.learn(docs)
    # a document travels as one column, so that its own columns cannot clash with the new ones
    found = language.predicted(docs.select(F.struct("*").alias("doc_"), "text"), machines, ("doc_",))
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select(
        F.col("doc_").withField("lang", F.col("lang_pred")).alias("doc_")
    ).select("doc_.*")


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows."""
    return secret_scan.cleaned(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document of the mix."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identified), ("near_copies", unique), ("secrets", without_secrets), ("mixture", mixture), ("packing", packed),
]

#: Learned machines and digests decide, which SQL cannot express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
