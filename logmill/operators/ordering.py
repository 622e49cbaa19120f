"""Running sums over ordered groups whose size is not bounded.

A plain window puts a whole group into one task. Here a group is cut into ranges of its order
column: ranges are totalled first (partial aggregation), the totals are summed along the group
(one row per range), and the rows are summed inside their range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGE = 4_096


def extreme_rows(df: DataFrame, keys: list[str], order: str, newest: bool = False) -> DataFrame:
    """The row of each group with the smallest (``newest``: greatest) ``order``, a number that is unique
    in its group.

    The aggregation sees numbers only, so it stays a hash aggregation; texts come by an equi-join.
    """
    columns = [*keys, order]
    best = df.groupBy(*keys).agg((F.max if newest else F.min)(order).alias(order)).toDF(*(f"best_{c}" for c in columns))
    same = [F.col(c).eqNullSafe(F.col(f"best_{c}")) for c in columns]
    return df.join(best, same).drop(*best.columns)


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    name: str,
    descending: bool = False,
    size: int = RANGE,
    whole: str | None = None,
    ranged: bool = False,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over this and all earlier rows of the group, and ``whole`` (if
    given): over all its rows.

    ``order`` is an integer column, unique within its group. ``ranged``: ``df`` has ranges of it as ``range_``, and
    if it is dealt by them, it stays as it is. ``df`` is worked out twice; what ``value`` does not need
    is left out of the first.
    """
    rows = df if ranged else df.withColumn("range_", F.floor(F.col(order) / size))
    rows = rows.withColumn("value_", value)
    totals = rows.groupBy(*keys, "range_").agg(F.sum("value_").alias("total_"))
    along = Window.partitionBy(*keys).orderBy(F.desc("range_") if descending else F.asc("range_"))
    offsets = totals.select(
        *keys,
        "range_",
        (F.sum("total_").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("total_")).alias(
            "offset_"
        ),
        *([F.sum("total_").over(Window.partitionBy(*keys)).alias(whole)] if whole else []),
    )
    inside = Window.partitionBy(*keys, "range_").orderBy(
        F.desc(order) if descending else F.asc(order)
    )
    summed = F.sum("value_").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.join(offsets, [*keys, "range_"])
    return joined.withColumn(name, F.col("offset_") + summed).drop("range_", "value_", "offset_")
