"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds a document
and its tokens, a delete takes them away, a revised count does both. A batch is reduced to one row per
key before it is written (partial aggregation), so the ledger grows with keys and batches, not documents.

Commits are idempotent: a batch is appended with its id and the digest of the attempt; readers take one
attempt of each batch, so a batch that is delivered or retried twice counts once. ``compacted`` replaces
a ledger by one that holds the totals and the ids of what they contain.

Edge cases: null and empty texts have 0 tokens and count as documents; null source or language is a key
of its own; a null id never revises or deletes another row; keys whose documents are all gone stay with
0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logmill.llm.common import batched, lasting, per_batch, scratch, stored, word_count

KEYS = ["source", "lang", "version"]
#: Splits text before the merges of byte-level BPE (a fixed value of the public rank files).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEDGER = "batch string, attempt string, source string, lang string, version string, documents bigint, tokens bigint"


def bpe_counter(spark: SparkSession, ranks: str) -> Callable[[pa.Array], list[int]]:
    """Counts tokens of a byte-level BPE; the rank file (a path Spark can read) travels to the workers."""
    file = spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(ranks).select("content").first()[0]))
    key = uuid.uuid4().hex

    def make():
        import tiktoken

        pairs = (line.split() for line in file.value.splitlines())
        return tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}
        )

    def count(texts: pa.Array) -> list[int]:
        encoding = lasting(f"bpe {ranks}", key, make)  # its tables are large: one for all tasks of a worker
        return [len(encoding.encode_ordinary(t.as_py() or "")) for t in texts]

    return count


def measured(docs: DataFrame, count: Callable[[pa.Array], list[int]], version: str, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, source, lang, and the text) with version and tokens; the text goes."""
    batched(docs.sparkSession)
    rows = docs.select("doc_id", "source", "lang", F.col(text).alias("text"))
    return per_batch(
        rows,
        lambda b: {**{c: b.column(c) for c in ("doc_id", "source", "lang")}, "version": [version] * b.num_rows,
                   "tokens": count(b.column("text"))},
        "doc_id bigint, source string, lang string, version string, tokens bigint",
    )


def delta(rows: DataFrame, sign: int = 1, tokens: Column | None = None) -> DataFrame:
    """Signed rows (source, lang, version, documents, tokens) that insert or delete ``rows``."""
    count = F.col("tokens") if tokens is None else tokens
    return rows.select(*KEYS, F.lit(sign).cast("bigint").alias("documents"), (sign * count).cast("bigint").alias("tokens"))


def revision(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that turn the counts ``before`` into ``after`` (both doc_id, source, lang, version, tokens)."""
    return delta(before, -1).union(delta(after))


def commit(ledger: str, batch: str, signed: DataFrame) -> None:
    """Append a batch of signed rows under its id. Doing so again changes no total."""
    totals = signed.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    totals.select(F.lit(batch).alias("batch"), F.lit(uuid.uuid4().hex).alias("attempt"), *KEYS, "documents", "tokens").write.mode(
        "append"
    ).parquet(ledger)


def totals(spark: SparkSession, ledger: str) -> DataFrame:
    """source, lang, version, documents and tokens of all committed batches."""
    rows = spark.read.schema(LEDGER).parquet(ledger)
    one = rows.groupBy("batch").agg(F.min("attempt").alias("attempt"))
    return rows.join(one, ["batch", "attempt"]).groupBy(*KEYS).agg(
        F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")
    )


def first_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (with doc_id and digest) with ``later``: an equal text has a smaller id."""
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("first_"))
    return rows.join(least, "digest").withColumn(
        "later", F.coalesce(F.col("doc_id") > F.col("first_"), F.col("first_").isNotNull())
    ).drop("first_")


def corpus_rollup(docs: DataFrame, ranks: str, version: str) -> DataFrame:
    """Totals after three batches over the whole table: every document is inserted, later copies of equal
    texts are deleted, and documents with repeated lines get the counts of their distinct lines. Counted
    are words and the tokens of ``ranks``. The second batch is delivered twice."""
    spark = batched(docs.sparkSession)
    lines = F.split("text", "\n")
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
    ).withColumn("fewer", F.when(F.size(F.array_distinct(lines)) < F.size(lines), F.array_join(F.array_distinct(lines), "\n")))
    count = bpe_counter(spark, ranks)

    def both(b: pa.RecordBatch) -> dict:
        changed = [k for k, t in enumerate(b.column("fewer")) if t.is_valid]
        again = dict(zip(changed, count(b.column("fewer").take(pa.array(changed, pa.int64())))))
        return {
            **{c: b.column(c) for c in ("doc_id", "source", "lang", "digest", "words", "new_words")},
            "bpe": count(b.column("text")), "new_bpe": [again.get(k) for k in range(b.num_rows)],
        }

    counted = per_batch(
        texts.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"),
                     word_count(F.col("text")).alias("words"),
                     F.when(F.col("fewer").isNotNull(), word_count(F.col("fewer"))).alias("new_words"), "text", "fewer"),
        both,
        "doc_id bigint, source string, lang string, digest string, words bigint, new_words bigint, bpe bigint, new_bpe bigint",
    )
    rows = stored(first_copies(stored(counted, "counts")), "counts")

    def versions(words: str, bpe: str) -> Column:
        return F.inline(F.array(
            F.struct(F.lit("words").alias("version"), F.col(words).alias("tokens")),
            F.struct(F.lit(version).alias("version"), F.col(bpe).alias("tokens")),
        ))

    old = rows.select("doc_id", "source", "lang", "later", (F.col("new_words").isNotNull()).alias("revised"), versions("words", "bpe"))
    new = rows.filter("not later and new_words is not null").select("doc_id", "source", "lang", versions("new_words", "new_bpe"))
    ledger = scratch(spark, "token-ledger")
    commit(ledger, "load", delta(old))
    for _ in range(2):
        commit(ledger, "copies", delta(old.filter("later"), -1))
    commit(ledger, "lines", revision(old.filter("not later and revised"), new))
    return totals(spark, ledger)


def compacted(spark: SparkSession, ledger: str, name: str = "snapshot") -> str:
    """A new ledger with the same totals in one batch; batches already in it must not be sent again."""
    path = scratch(spark, "token-ledger")
    commit(path, name, totals(spark, ledger))
    return path
