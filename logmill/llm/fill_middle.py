"""Fill-in-middle documents as a pyarrow.compute pipeline.

Each batch of whole texts is split into a list of units (a word with the white space before it, or the
white space at the end), the lists are flattened with their parent indices, each unit gets its ordinal in
its document, the units of a role (before, in or after the middle) are filtered out, rebuilt as lists and
joined to one piece per document. Texts are worked on as UTF-8 bytes: units begin and end at ASCII white
space, and the byte that marks their ends occurs in no UTF-8 text.

The cuts and the form are drawn from the digest of ``<seed>:<doc_id>``, so reruns and lost tasks agree. No
row leaves its task. ``restored`` is the exact inverse: the marks do not occur in the texts that are
rearranged.

Edge cases: a null text is the empty one; empty texts and texts that hold a mark stay as they are (plain),
as does a text of white space alone if its draw says so (it is one unit); a document without id draws from
``<seed>:``; equal ids draw alike; repeated rows give repeated rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from logmill.llm.common import arrow_schema, batched, columns_of

UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
END = b"\xff"
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Share of texts that are rearranged, and of these that begin with the suffix and then the prefix; per cent.
RATE, SPM = 50, 80
SEED = 42
#: The pieces of a rearranged text in their order.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_NOTHING = pa.scalar(b"", pa.binary())


def draws(seed: int) -> list[Column]:
    """Four numbers below 2**32 from the digest of ``<seed>:<doc_id>``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def _modulo(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """All units of a batch, their documents' places in it, and their ordinals in them."""
    marked = pc.replace_substring_regex(texts, UNIT, rb"\0" + END)
    lists = pc.split_pattern(marked, END)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(pc.binary_length(flat), 0)  # after the last mark stands nothing
    flat, parent = flat.filter(real), parent.filter(real)
    places = parent.to_numpy()
    first = np.searchsorted(places, places)  # of each unit's document
    return flat, parent, pa.array(np.arange(len(places)) - first)


def _joined(flat: pa.Array, counts: pa.Array) -> pa.Array:
    """Pieces of ``counts`` units each."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts.to_numpy())]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, flat), _NOTHING)


def _length(pieces: pa.Array) -> pa.Array:
    return pc.utf8_length(pieces.cast(pa.string())).cast(pa.int64())


def middles(batch: pa.RecordBatch, rate: int, spm: int) -> pa.RecordBatch:
    """``SCHEMA`` of a batch (doc_id, text, h1, h2, h3, h4)."""
    texts = batch.column("text").cast(pa.binary()).fill_null(b"")
    h1, h2, h3, h4 = (batch.column(f"h{k}") for k in range(1, 5))
    flat, parent, ordinal = units(texts)
    n = pa.array(np.bincount(parent.to_numpy(), minlength=len(texts)), pa.int64())
    one, two = (_modulo(h, pc.add(n, 1)) for h in (h1, h2))
    low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    role = pc.add(
        pc.greater_equal(ordinal, pc.take(low, parent)).cast(pa.int8()), pc.greater_equal(ordinal, pc.take(high, parent)).cast(pa.int8())
    )
    counts = (low, pc.subtract(high, low), pc.subtract(n, high))
    before, middle, after = (_joined(flat.filter(pc.equal(role, k)), counts[k]) for k in range(3))
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_modulo(h3, pa.scalar(100, pa.int64())), rate))
    for mark in MARKS:
        plain = pc.or_(plain, pc.match_substring(texts, mark.encode()))
    last = pc.less(_modulo(h4, pa.scalar(100, pa.int64())), spm)
    form = pc.if_else(plain, "plain", pc.if_else(last, "spm", "psm"))
    piece = {PREFIX: before, SUFFIX: after, MIDDLE: middle}
    output = texts
    for name, order in ORDERS.items():
        parts = [x for mark in order for x in (pa.scalar(mark.encode(), pa.binary()), piece[mark])]
        output = pc.if_else(pc.equal(form, name), pc.binary_join_element_wise(*parts, _NOTHING), output)
    nothing = pa.scalar(None, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), n, form, pc.if_else(plain, nothing, _length(before)), pc.if_else(plain, nothing, _length(middle)),
         output.cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts from which ``middles`` made ``output``."""
    whole = output.cast(pa.binary())
    for name, order in ORDERS.items():
        at = pc.indices_nonzero(pc.equal(form, name))
        rest, piece, before = whole.take(at), {}, ""
        for mark in order:
            cut = pc.split_pattern(rest, mark.encode(), max_splits=1)
            piece[before], rest, before = pc.list_element(cut, 0), pc.list_element(cut, 1), mark
        piece[before] = rest
        texts = pc.binary_join_element_wise(piece[PREFIX], piece[MIDDLE], piece[SUFFIX], _NOTHING)
        whole = pc.replace_with_mask(whole, pc.equal(form, name), texts)
    return whole.cast(pa.string())


def transformed(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output."""
    spark = batched(docs.sparkSession)
    fields, arrow = arrow_schema(spark, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield middles(batch, rate, spm).cast(arrow)

    rows = columns_of(docs, doc_id="bigint", text="string")
    return rows.select("doc_id", "text", *draws(seed)).mapInArrow(run, fields)


def restored(made: DataFrame) -> DataFrame:
    """``made`` (with output and form, and any other columns) with ``text``, the exact text of each row."""
    spark = batched(made.sparkSession)
    kept = [c for c in made.columns if c != "text"]
    made = made.select(*(F.col(f"`{c}`") for c in kept))
    fields, arrow = arrow_schema(spark, made.withColumn("text", F.lit("")).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text = rebuilt(batch.column("output"), batch.column("form"))
                yield pa.RecordBatch.from_arrays([*batch.columns, text], names=arrow.names).cast(arrow)

    return made.mapInArrow(run, fields)
