"""MinHash fingerprints: many universal hash permutations over word shingles, in numpy.

A fingerprint holds, for each permutation ``x -> a*x + b mod 2**64`` (a odd), sixteen bits of the
mixed smallest value over the text's five-word shingles. The share of equal places estimates the
Jaccard similarity of the shingle sets. ``near_duplicates`` joins bands of the fingerprints in Spark
and verifies each candidate by the true Jaccard similarity.

Edge cases: null is the empty text; texts without words share one fingerprint (all zero bits) and
count as alike; documents follow each other by ascending doc_id, equal ids by text, the last is
followed by the first (a single one by itself); a document without id follows none and is followed by
the empty text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logmill.llm.common import arrow_schema, batched, columns_of, per_batch
from logmill.llm.linking import bitmap, class_of, grouped
from logmill.llm.shingles import mixed, shingle_sets, shingled

WIDTH, PERMUTATIONS, BAND_ROWS = 5, 128, 4
_random = np.random.default_rng(97)
_A = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signatures(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """(texts, PERMUTATIONS) of 16-bit places."""
    out = np.zeros((len(texts), PERMUTATIONS), np.uint16)
    for at, to, found, first in shingled(texts, width):
        full = np.flatnonzero(np.diff(first))
        if not len(full):
            continue
        least = np.empty((len(full), PERMUTATIONS), np.uint64)
        for p in range(PERMUTATIONS):
            least[:, p] = np.minimum.reduceat(found * _A[p] + _B[p], first[:-1][full])
        out[at + full] = mixed(least).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, row by row."""
    return (a == b).mean(axis=1)


def hexed(rows: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in rows]


EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def with_successors(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_), each partition in id order and ended by the next partition's first document.

    Id ranges of about equal row counts are fixed first, as many as shuffle partitions; their first ids
    come to the driver. The first document of a range also goes to the range before, marked ``next_``
    (from the first range to the last). Texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    bounds = np.unique(np.array(
        docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * parts))).first()[0] or [], np.int64
    ))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right").astype(np.int32))

    firsts = dict(
        docs.filter("doc_id is not null").select("doc_id", range_of("doc_id").alias("range"))
        .groupBy("range").agg(F.min("doc_id")).collect()
    )
    used = sorted(firsts)
    before = {firsts[r]: used[k - 1] for k, r in enumerate(used)}

    @F.pandas_udf("array<int>")
    def ranges_of(ids: pd.Series) -> pd.Series:
        home = np.searchsorted(bounds, ids.to_numpy(np.int64), "right")
        return pd.Series([[int(r), before[i]] if i in before else [int(r)] for i, r in zip(ids.tolist(), home)])

    # pandas would turn ids beside nulls to floats and round them; rows without id go round the ranges
    known = docs.filter("doc_id is not null").select("doc_id", "text", F.posexplode(ranges_of("doc_id")).alias("place_", "range_"))
    rest = docs.filter("doc_id is null").select(
        "doc_id", "text", F.lit(0).alias("place_"), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int").alias("range_")
    )
    return (
        known.unionByName(rest)
        .repartitionById(parts, "range_")
        .select("doc_id", "text", (F.col("place_") > 0).alias("next_"))
        .sortWithinPartitions("next_", "doc_id", "text")
    )


def _digest(rows: list[tuple[int | None, str, str]]) -> dict[str, list]:
    texts = [text for _, text, _ in rows]
    edited = []
    for _, text, after in rows:
        cut = len(text) // 4
        edited.append(text[: len(text) - cut] + after[:cut])
    own = signatures(pa.array([*texts, rows[-1][2]], pa.large_string()))
    following = own[1:].copy()
    alone = [k for k, row in enumerate(rows) if row[0] is None]
    following[alone] = 0
    changed = signatures(pa.array(edited, pa.large_string()))
    own = own[:-1]
    return {
        "doc_id": [i for i, _, _ in rows], "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": hexed(own), "edited_fingerprint": hexed(changed),
        "near_edited": likeness(own, changed), "near_next": likeness(own, following),
    }


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form (the last quarter of the code points replaced
    by the beginning of the next document), with their likeness and that to the next document."""
    batched(docs.sparkSession)
    schema, arrow = arrow_schema(docs.sparkSession, EDITED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = []
            for i, text, after in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if i is None:
                    rows.append((None, text, ""))
                    continue
                if held is not None:
                    rows.append((*held, text))
                held = None if after else (i, text)
            if rows:
                found = _digest(rows)
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    texts = columns_of(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return with_successors(texts).mapInArrow(run, schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every text."""
    batched(docs.sparkSession)
    return per_batch(
        columns_of(docs, doc_id="bigint", text="string"),
        lambda b: {"doc_id": b.column(0), "fingerprint": hexed(signatures(b.column(1)))},
        "doc_id bigint, fingerprint string",
    )


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: documents that share a band of their fingerprints and whose
    shingle sets have a Jaccard similarity of at least ``percent`` are linked."""

    def keyed(batch: pa.RecordBatch) -> dict:
        sets = list(shingle_sets(batch.column(1), WIDTH))
        places = signatures(batch.column(1)).astype(np.uint64)
        bands = []
        for k in range(0, PERMUTATIONS, BAND_ROWS):
            key = np.full(len(places), k, np.uint64)
            for j in range(BAND_ROWS):
                key = mixed(key + places[:, k + j] + np.uint64(1))
            bands.append(key.view(np.int64))
        bands = np.stack(bands, axis=1)
        return {
            "doc_id": batch.column(0), "n": [len(s) for s in sets], "cls": [class_of(s) for s in sets],
            "marks": [bitmap(s) for s in sets], "keys": [b if len(s) else b[:0] for s, b in zip(sets, bands)],
        }

    return grouped(docs, WIDTH, percent, keyed)
