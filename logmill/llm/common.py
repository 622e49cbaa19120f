"""Helpers of the training-data operators: tables, the shared folder, running totals, Arrow batches."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from types import ModuleType
from typing import TypeVar

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import logmill.llm
from logmill.session import configure, run_folder

# the functions go to the workers themselves, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(logmill.llm)

T = TypeVar("T")
#: Words as the contracts name them: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Slices of an ordered group; each is summed in a task of its own.
SLICES = 1_024
ARROW_ROWS, ARROW_BYTES = 1_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame, **types: str) -> DataFrame:
    """Just the named columns, cast; whatever else a table brings cannot clash with an operator's own."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()))


@lru_cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="logmill-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. Only a local session (tests) may go without that
    setting; it gets a temporary folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and re.match(r"local(\[|$)", context.master):
        return f"{_own_folder(context.applicationId)}/{name}-{uuid.uuid4().hex}"
    return run_folder(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: the plan ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batched(spark: SparkSession) -> SparkSession:
    """Session settings for operators that hand whole texts to Arrow: batches bounded in rows and bytes."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def arrow_schema(spark: SparkSession, schema: str | StructType) -> tuple[StructType, pa.Schema]:
    fields = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    return fields, to_arrow_schema(fields)


def per_batch(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """``fn`` maps a record batch to a dict of columns; batches stay as small as they came."""
    fields, arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[f.name], f.type) if not isinstance(found[f.name], pa.Array)
                     else found[f.name].cast(f.type) for f in arrow],
                    schema=arrow,
                )

    return df.mapInArrow(run, fields)


def lasting(name: str, key: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, once in a worker process for each ``key`` (the newest of a ``name`` stays).

    Functions travel by value, so their own globals last for one task only."""
    held = sys.modules.setdefault("logmill_lasting", ModuleType("logmill_lasting")).__dict__
    if held.get(name, ("",))[0] != key:
        held[name] = (key, make())
    return held[name][1]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(column: str) -> Column:
    """A fixed shuffled order: the digest of the id."""
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")))


def running_total(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to this row in the group ``keys`` (never null), by ``order``
    (a hex digest) and ``ties``.

    The digest's first digits cut each group into slices of about equal size. Slices are totalled by
    partial aggregation, the totals are summed along the group (at most ``SLICES`` rows each), and
    rows are summed inside their slice: a group with a third of all rows spreads over many tasks.
    """
    sliced = df.withColumn("slice_", (F.conv(F.substring(order, 1, 4), 16, 10).cast("int") / (65_536 // SLICES)).cast("int"))
    along = Window.partitionBy(*keys).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "slice_").agg(F.sum(value).alias("total_"))
        .select(*keys, "slice_", F.coalesce(F.sum("total_").over(along), F.lit(0)).alias("offset_"))
    )
    inside = Window.partitionBy(*keys, "slice_").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(offsets, [*keys, "slice_"])
        .withColumn(name, F.col("offset_") + F.sum(value).over(inside))
        .drop("slice_", "offset_")
    )


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str, slots: int = 64) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for each ``key`` of theirs.

    A key may have a third of all rows: they are dealt over ``slots`` by ``by``, each present slot of a key gets
    its fact first, and rows meet it by key and slot."""
    dealt = rows.withColumn("slot_", F.pmod(F.xxhash64(F.lit(slots), by), F.lit(slots)).cast("int"))
    present = dealt.select(key, "slot_").distinct().join(facts, key)
    return dealt.join(present, [key, "slot_"]).drop("slot_")
