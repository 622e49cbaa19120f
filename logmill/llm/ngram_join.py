"""N-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row per class of equal documents and a column per n-gram (hashed to 64
bits). Its product with its transpose holds the overlaps. Only blocks that can reach the similarity
are worked out: each row keeps the columns of its prefix, the rarest ``n - ceil(t * n) + 1`` n-grams in
one global order, since two rows with similarity t must meet there; products below the bounds given by
the set sizes and marks are discarded; what is left is accumulated over all columns (``linking``). The
order is by the counts of a table of fixed size over all documents, so passages that many documents
share stand last; any order gives the same result.

Edge cases: null and empty texts and those without words have an empty set and are linked with
nothing; with fewer words than the width the whole sequence is one n-gram; repeated rows are linked
with each other; a document without id belongs to its component but cannot name it (null if no member
has an id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logmill.llm.common import WORD, batched, columns_of
from logmill.llm.linking import bitmap, class_of, grouped
from logmill.llm.shingles import shingle_sets, shingled

#: The rule for near copies of word shingles: five words, a similarity of 0.8 or more.
WIDTH, PERCENT = 5, 80
#: Counters of the column order, and the parts they are summed in.
SLOT_BITS, PART_BITS = 20, 10


def column_levels(texts: DataFrame, width: int) -> bytes:
    """A byte per slot: its rank by how often n-grams of that slot occur, in steps of a quarter power of 2."""
    parts = 1 << PART_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for _, _, found, _ in shingled(batch.column(0), width):
                slots += np.bincount((found & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64), minlength=1 << SLOT_BITS)
        while slots.any():  # two bytes a counter, and more rows for what exceeds them
            low = np.minimum(slots, 65_535)
            slots -= low
            rows = low.astype("<u2").reshape(parts, -1)
            full = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([rows[k].tobytes() for k in full], pa.binary())], ["part", "counts"]
            )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts.as_buffer(), "<u2").astype(np.int64)
        if sums:
            levels = [np.round(4 * np.log2(np.maximum(v, 1))).astype(np.uint8).tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    counted = texts.select("text").mapInArrow(count, "part int, counts binary")
    rows = counted.repartition("part").mapInArrow(total, "part int, levels binary").collect()  # a megabyte
    table = np.zeros((parts, 1 << (SLOT_BITS - PART_BITS)), np.uint8)
    for part, levels in rows:
        table[part] = np.frombuffer(levels, np.uint8)
    return table.tobytes()


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, digest and label (see ``grouped``) of every document."""
    spark = batched(docs.sparkSession)
    levels = spark.sparkContext.broadcast(column_levels(columns_of(docs, text="string"), width))

    def keyed(batch: pa.RecordBatch) -> dict:
        rank = np.frombuffer(levels.value, np.uint8)
        out: dict[str, list] = {"n": [], "cls": [], "marks": [], "keys": []}
        for grams in shingle_sets(batch.column(1), width):
            n = len(grams)
            prefix = n - (percent * n + 99) // 100 + 1 if n else 0
            order = np.lexsort((grams, rank[(grams & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)]))[:prefix]
            out["n"].append(n)
            out["cls"].append(class_of(grams))
            out["marks"].append(bitmap(grams))
            out["keys"].append(grams[order].view(np.int64))
        return {"doc_id": batch.column(0), **out}

    return grouped(docs, width, percent, keyed, prefixes=True)


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component: the one with the smallest id (null last; of equal rows, one).
    Documents without words are linked with nothing and stay. All columns are kept."""
    found = ngram_components(docs, width, percent)
    keep = (
        found.filter("n_shingles > 0").groupBy("label")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("one"))
        .select(F.coalesce(F.col("one.doc_id").cast("string"), F.lit("")).alias("id_"), F.col("one.digest").alias("digest_"))
    )
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct("*").alias("doc_"), F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")).alias("id_"),
        F.xxhash64(text).alias("digest_"), F.coalesce(text.rlike(WORD), F.lit(False)).alias("words_"),
    )
    twin = Window.partitionBy("id_", "digest_").orderBy(F.lit(0))
    chosen = (
        rows.filter("words_").join(keep, ["id_", "digest_"]).withColumn("twin_", F.row_number().over(twin)).filter("twin_ = 1")
    )
    return chosen.select("doc_.*").union(rows.filter("not words_").select("doc_.*"))
