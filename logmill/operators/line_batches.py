"""Greedy batching of ordered pieces of any number: the distributed form of ``functions.batching``.

The only state of greedy batching is where the open batch starts. A document is cut into spans of its
characters. What a span does to the state depends only on which of its first pieces opens a batch, and those
lie within one budget of the span's beginning, so the map is a short list:

1. each span follows its batch starts (found by binary search over running lengths) from each piece that
   may be the first one, and gives the last start and the number of batches (one task per span);
2. the maps are applied along the document, one row per span;
3. each span numbers its pieces, given the open batch at its beginning and the batches before it.

Documents of one span, which are most, need the last step only. No task holds more than a span, and the result is that of the fold over all pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: Characters of a document in a span.
SPAN = 1 << 22
LONGS = ArrayType(LongType())


def _edges(table: pa.Table | pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where the groups of ``keys`` (never null) begin in sorted rows, and the number of rows."""
    change = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        column = table.column(k)
        change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows in tables that hold groups of ``keys`` whole, from batches that are sorted by them. A table is
    a batch, and the rows of a group that began before it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _edges(batch, keys)[-2]  # the last group may go on in the next batch
        if held and last != tuple(batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if at:
            yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()
            held = []
        held.append(batch.slice(at))
        last = tuple(batch.column(k)[-1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_group(
    df: DataFrame, keys: list[str], order: str, fn: Callable[[pa.Table, list[int]], pa.Table], schema: StructType, deal: list[str] | None = None,
) -> DataFrame:
    """``fn`` of tables of whole groups of ``keys`` by ``order`` and of the places where the groups begin (and end); groups
    with equal ``deal`` columns (the keys, if not given) are in one task. ``fn`` must bring the columns of ``schema``."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _whole_groups(batches, keys):
            yield from fn(groups, _edges(groups, keys)).select(arrow.names).cast(arrow).to_batches()

    return df.repartition(*(deal or keys)).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def _numpy(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).fill_null(0).to_numpy() for c in names]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), pa.int64()))


def _next(start: np.ndarray, upto: np.ndarray, wide: int) -> np.ndarray:
    """The piece that opens the next batch, if each opens one; the number of pieces means none does."""
    return np.maximum(np.searchsorted(upto, start + wide, "right"), np.arange(1, len(start) + 1))


def span_map(start: np.ndarray, upto: np.ndarray, wide: int, span: int, size: int) -> tuple[np.ndarray, ...]:
    """Of each piece that may open the span's first batch: its end, the last start from there, and how many batches open."""
    following = np.append(_next(start, upto, wide), len(start))
    first = 1 if span == 0 else max(1, int(np.searchsorted(start, span * size + wide)))
    at, count = np.arange(first), np.ones(first, np.int64)
    while True:
        to = following[at]
        open_ = to < len(start)
        if not open_.any():
            return upto[:first], start[at], count
        at = np.where(open_, to, at)
        count += open_


def numbered(start: np.ndarray, upto: np.ndarray, wide: int, entry: int | None, before: int) -> np.ndarray:
    """The batch of each piece of a span, given the start of the open batch (None: none is open)."""
    following = _next(start, upto, wide)
    at = 0 if entry is None else int(np.searchsorted(upto, entry + wide, "right"))
    opens = np.zeros(len(start), np.int64)
    while at < len(start):
        opens[at] = 1
        at = int(following[at])
    return before - 1 + np.cumsum(opens)


def batch_numbers(pieces: DataFrame, key: str, size: int = SPAN) -> DataFrame:
    """``pieces`` with ``batch_index``, from 0 in every document.

    Needed are ``start`` and ``upto`` (the running characters of a document before a piece and after it
    and the separator that follows it) and ``wide`` (budget and separator, one number per document). Pieces
    are not empty.
    """
    spanned = pieces.withColumn("span_", F.floor(F.col("start") / size))
    kind = pieces.schema[key]
    # a document of one span has no open batch to be told of
    longer = pieces.filter(F.col("start") >= size).select(key).distinct()

    def mapped(groups: pa.Table, edges: list[int]) -> pa.Table:
        start, upto, wide, span = _numpy(groups, "start", "upto", "wide", "span_")
        found = [span_map(start[a:b], upto[a:b], int(wide[a]), int(span[a]), size) for a, b in zip(edges, edges[1:])]
        out = groups.select([key, "span_", "wide"]).take(pa.array(edges[:-1], pa.int64()))
        for name, values in zip(("ends", "exits", "counts"), zip(*found)):
            out = out.append_column(name, _lists(values))
        return out

    maps = by_group(spanned.select(key, "span_", "start", "upto", "wide").join(longer, key, "left_semi"), [key, "span_"], "start", mapped, StructType([
        kind, StructField("span_", LongType()), StructField("wide", LongType()), StructField("ends", LONGS),
        StructField("exits", LONGS), StructField("counts", LONGS),
    ]))

    def chained(groups: pa.Table, edges: list[int]) -> pa.Table:
        entries, befores = [], []
        for a, b in zip(edges, edges[1:]):
            entry, before = None, 0
            for k in range(a, b):
                entries.append(entry)
                befores.append(before)
                wide, ends, exits, counts = (groups.column(c)[k] for c in ("wide", "ends", "exits", "counts"))
                at = 0 if entry is None else int(np.searchsorted(ends.values.to_numpy(), entry + wide.as_py(), "right"))
                if at < len(ends):
                    entry, before = exits[at].as_py(), before + counts[at].as_py()
        return groups.select([key, "span_"]).append_column("entry", pa.array(entries, pa.int64())).append_column(
            "before", pa.array(befores, pa.int64())
        )

    entries = by_group(maps, [key], "span_", chained, StructType([
        kind, StructField("span_", LongType()), StructField("entry", LongType()), StructField("before", LongType()),
    ]))

    def given(groups: pa.Table, edges: list[int]) -> pa.Table:
        start, upto, wide = _numpy(groups, "start", "upto", "wide")
        told = start < 0
        found = []
        for a, b in zip(edges, edges[1:]):
            entry, before = None, 0
            if told[a]:
                entry, before = (groups.column(c)[a].as_py() for c in ("entry", "before"))
                a += 1
            found.append(numbered(start[a:b], upto[a:b], int(wide[a]), entry, before))
        own = groups.filter(pa.array(~told)) if told.any() else groups
        return own.append_column("batch_index", pa.array(np.concatenate(found), pa.int64()))

    # a span's entry comes as a row before its pieces; a document of one span has none
    both = spanned.unionByName(entries.withColumn("start", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    schema = StructType([*pieces.schema.fields, StructField("batch_index", LongType())])
    return by_group(both, [key, "span_"], "start", given, schema)


def batch_texts(numbers: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """key, ``keep``, batch_index and content: the pieces (``content``) of each batch, joined by ``sep``. A batch is
    bounded by its budget, or is one piece."""
    rows = numbers.groupBy(key, *keep, "batch_index", "sep").agg(F.array_sort(F.collect_list(F.struct("start", "content"))).alias("parts"))
    return rows.select(
        key, *keep, "batch_index", F.expr("array_join(transform(parts, p -> p.content), sep)").alias("content")
    )
