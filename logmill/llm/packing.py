"""Packing into optimal length buckets.

The global histogram of lengths (one row per distinct length, so its size follows the longest document
and not the number of documents) goes to the driver. Dynamic programming over it finds the bucket
boundaries with the least padding; the recurrence is a lower envelope of lines, so it is linear in the
distinct lengths per bucket. Batches of at most ``budget`` padded tokens form inside each bucket, in a
fixed shuffled order; a document longer than the budget is a batch of its own.

Edge cases: null and empty texts have length 0 and go to the first bucket; null and repeated ids are
rows like any other; an empty table gives no rows; with fewer distinct lengths than buckets each length
is a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logmill.llm.common import columns_of, order_key, running_total, stored, word_count

BUCKETS, BUDGET = 8, 16_384


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper lengths of the buckets, ascending. ``histogram``: (length, documents). Among equal costs the
    earliest split wins."""
    histogram = sorted(histogram)
    lengths, upto = [0], [0]
    for length, count in histogram:
        lengths.append(length)
        upto.append(upto[-1] + count)
    n = len(histogram)
    if not n:
        return []
    cost: list[int | None] = [None] + [lengths[j] * upto[j] for j in range(1, n + 1)]
    splits = []
    for used in range(2, min(buckets, n) + 1):
        lines: list[tuple[int, int, int]] = []  # slope, value at 0, split; slopes fall
        at, now, split = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(used, n + 1):
            i = j - 1
            new = (-upto[i], cost[i], i)
            while len(lines) >= 2 and (
                (new[1] - lines[-2][1]) * (lines[-2][0] - lines[-1][0])
                <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - new[0])
            ):
                lines.pop()
            lines.append(new)
            at = min(at, len(lines) - 1)
            x = lengths[j]
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] < lines[at][0] * x + lines[at][1]:
                at += 1
            now[j] = lines[at][0] * x + lines[at][1] + x * upto[j]
            split[j] = lines[at][2]
        splits.append(split)
        cost = now
    ends, j = [n], n
    for split in reversed(splits):
        j = split[j]
        ends.append(j)
    return [lengths[e] for e in reversed(ends)]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), bucket_len, batch (from 0 in its bucket), slot (from 0 in its
    batch) and padding of every document."""
    counted = stored(
        columns_of(docs, doc_id="bigint", text="string").select("doc_id", word_count(F.col("text")).alias("n_tokens")),
        "packing",
    )
    histogram = [(r[0], r[1]) for r in counted.groupBy("n_tokens").count().collect()]
    ends = optimal_boundaries(histogram, buckets) or [0]
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[k], k).otherwise(bucket)
    length = F.element_at(F.array(*(F.lit(e).cast("bigint") for e in ends)), F.col("bucket") + 1)
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1))
    placed = running_total(
        counted.withColumn("bucket", bucket.cast("int")).withColumn("bucket_len", length)
        .withColumn("order_", order_key("doc_id")).withColumn("one_", F.lit(1).cast("bigint")),
        ["bucket"], "order_", ["doc_id", "n_tokens"], "one_", "place_",
    ).withColumn("room_", room).withColumn("place_", F.col("place_") - 1)
    return placed.select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        F.floor(F.col("place_") / F.col("room_")).cast("bigint").alias("batch"),
        (F.col("place_") % F.col("room_")).cast("bigint").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
