"""Mixing sources to target weights by weighted fair queueing.

Every document stands in its source's queue in a fixed shuffled order, up to ``REPEATS`` times (the
queue starts again when it ends). An entry's virtual finish time is the source's words up to and
including it, divided by the source's target. All queues are merged by finish time and cut where the
total budget is reached: range bins find the cut, finer ones inside its bin narrow it, and rows are
put in exact order only in the one fine bin that holds it.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source of its own,
after all others; null and repeated ids are rows like any other (identical rows are interchangeable);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from logmill.llm.common import columns_of, order_key, running_total, stored, word_count

#: How often the mix may take one document.
REPEATS = 3
#: Range bins per unit of virtual time (times from 2 on share the last bin), and fine bins in each.
BINS = 4_096
SOURCE_KEY = "coalesce(concat('s', source), '~')"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a row number, written once: texts are read a single time."""
    sized = columns_of(docs, doc_id="bigint", source="string", text="string").select(
        "doc_id", "source", word_count(F.col("text")).alias("size")
    )
    return stored(sized.withColumn("row_", F.monotonically_increasing_id()), "mixing").withColumn("source_key_", F.expr(SOURCE_KEY))


def source_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_key_").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))


def weights_by_rank(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The given weights, repeating, for sources in code-point order, null last (one row per source)."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))


def targets(sizes: DataFrame, budget: int) -> DataFrame:
    """Add ``target``: the budget shared by weight, no source above ``REPEATS`` times its size; what
    stops there is shared again among the rest until none is above. The driver sees two sums a round."""
    cap = F.lit(REPEATS) * F.col("source_size")
    level = None
    full = F.lit(False)
    while True:
        rest = sizes.agg(
            F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        if not rest["weight"]:
            return sizes.withColumn("target", cap.cast("double"))
        next_level = float(budget - (rest["capped"] or 0)) / float(rest["weight"])
        if next_level == level:
            break
        level = next_level
        full = F.col("weight") * F.lit(level) > cap
    return sizes.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def _cut(entries: DataFrame, bins: str, room: int) -> tuple[int, int] | None:
    """The bin in which the sizes exceed ``room``, and the sizes before it; null if all fit."""
    along = Window.orderBy(bins).rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        entries.groupBy(bins).agg(F.sum("size").alias("size"))  # at most 2 * BINS + 1 rows
        .withColumn("upto", F.sum("size").over(along)).filter(F.col("upto") > room).orderBy(bins).first()
    )
    return cut and (cut[bins], cut["upto"] - cut["size"])


def mixed(rows: DataFrame, weighted: DataFrame) -> DataFrame:
    """``rows`` of ``measured`` with source_size, target and taken; ``weighted`` has a weight for each
    source_key_ with its source_size. The budget is all words there are."""
    budget = weighted.agg(F.sum("source_size")).first()[0] or 0
    aimed = targets(weighted, budget).select("source_key_", "source_size", "target")
    # few rows, one per source; AQE picks the join by their true size
    queued = running_total(
        rows.filter("size > 0").withColumn("order_", order_key("doc_id")),
        ["source_key_"], "order_", ["size", "row_"], "size", "run_",
    ).join(aimed, "source_key_")
    entries = (
        queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("pass_"))
        .withColumn("finish_", (F.col("pass_") * F.col("source_size") + F.col("run_")).cast("double") / F.col("target"))
        .withColumn("bin_", F.least(F.floor(F.col("finish_") * BINS), F.lit(2 * BINS)))
        .select("row_", "size", "source_key_", "order_", "finish_", "bin_")
    )
    entries = stored(entries, "mixing-queue")
    cut = _cut(entries, "bin_", budget)
    if cut is None:
        kept = entries
    else:
        at, spent = cut
        inside = entries.filter(F.col("bin_") == at).withColumn(
            "fine_", F.least(F.floor((F.col("finish_") * BINS - F.col("bin_")) * BINS), F.lit(BINS))
        )
        fine, before = _cut(inside, "fine_", budget - spent)
        order = Window.orderBy("finish_", "source_key_", "order_", "size", "row_").rowsBetween(Window.unboundedPreceding, 0)
        edge = (
            inside.filter(F.col("fine_") == fine)
            .withColumn("upto", F.sum("size").over(order) + F.lit(spent + before)).filter(F.col("upto") <= budget)
        )
        kept = entries.filter(F.col("bin_") < at).unionByName(
            inside.filter(F.col("fine_") < fine).drop("fine_")
        ).unionByName(edge.drop("fine_", "upto"))
    taken = kept.groupBy("row_").agg(F.sum("size").alias("taken"))
    return (
        rows.join(aimed, "source_key_").join(taken, "row_", "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document."""
    rows = measured(docs)
    return mixed(rows, weights_by_rank(source_sizes(rows), weights))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: the documents, each as often as it is taken."""
    taken = mix(docs, weights).filter("taken > 0").select(
        "doc_id", "size", F.expr(SOURCE_KEY).alias("source_key_"), (F.col("taken") / F.col("size")).cast("int").alias("times_")
    )
    keyed = docs.select(
        F.struct("*").alias("doc_"), word_count(F.col("text")).alias("size_"), F.expr(SOURCE_KEY).alias("source_key_"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_"),
    )
    keys = ["id_", "source_key_", "size_"]
    # equal ids, sources and sizes (repeated rows) are matched one to one
    twin = Window.partitionBy(*keys).orderBy(F.lit(0))
    chosen = taken.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_"), "source_key_", F.col("size").alias("size_"), "times_"
    ).withColumn("twin_", F.row_number().over(twin))
    return (
        keyed.withColumn("twin_", F.row_number().over(twin)).join(chosen, [*keys, "twin_"])
        .withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times_"))))
        .select("doc_.*")
    )
