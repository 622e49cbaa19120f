"""Line tables: the form for sources delivered line by line or too large for one row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from logmill.functions.fingerprint import fingerprint
from logmill.functions.severity import text_severity
from logmill.functions.text import normalize_line, redact, text_lines, trim_space
from logmill.operators.ordering import RANGE, running_sum
from logmill.plans.catalog import Profile
from logmill.plans.extract import BUILD_MARKER, CONTEXT_LINES, OMITTED, source_label, start_level


def to_lines(docs: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """Explode a text column to ``(key, line_no from 1, line)``."""
    rows = docs.select(key, F.posexplode(text_lines(F.col(text))).alias("pos", "line"))
    return rows.select(key, (F.col("pos") + 1).alias("line_no"), "line")


def clean_lines(lines: DataFrame) -> DataFrame:
    """Right-trim, widen tabs and redact every line of a line table."""
    return lines.withColumn("line", redact(normalize_line(F.col("line"))))


def line_measures(lines: DataFrame) -> DataFrame:
    """Severity and fingerprint of single lines, the stateless per-line form."""
    return clean_lines(lines).select(
        "*",
        text_severity(F.lit("UNKNOWN"), F.col("line")).alias("severity"),
        fingerprint(F.col("line")).alias("fingerprint"),
    )


def numbered_blocks(lines: DataFrame, key: str = "doc_id", size: int = RANGE) -> DataFrame:
    """``(key, block, first, last, level, content)`` of lines with ``level`` (not null where a block starts) and
    ``preamble`` (the level of the lines before the first start; null: they belong to no block).

    Block numbers are running counts of start lines; no document is held in one task.
    """
    opens = F.when(F.col("level").isNotNull(), 1).otherwise(0)
    numbered = running_sum(lines, [key], "line_no", opens, "block", size=size, whole="blocks_")
    joined = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]
        ),
        "\n",
    )
    # a preamble needs a block after it
    return numbered.filter("block > 0 or preamble is not null and blocks_ > 0").groupBy(key, "block").agg(
        (F.min("line_no") - 1).alias("first"),
        F.max("line_no").alias("last"),
        F.coalesce(F.max("level"), F.max("preamble")).alias("level"),
        joined.alias("content"),
    )


def block_events(
    lines: DataFrame, profile: Profile, key: str = "doc_id", size: int = RANGE
) -> DataFrame:
    """Events of a block profile from a line table of clean, trimmed documents."""
    preamble = profile.parser["preamble_severity"] if profile.parser.get("include_preamble", False) else None
    marked = lines.withColumn("level", start_level(F.col("line"), profile.parser)).withColumn(
        "preamble", F.lit(preamble).cast("string")
    )
    return numbered_blocks(marked, key, size).select(
        key,
        "first",
        source_label(F.col("first"), F.col("last")).alias("source"),
        text_severity(F.col("level"), F.col("content")).alias("severity"),
        "content",
        fingerprint(F.col("content")).alias("fingerprint"),
    )


def context_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines within two of an error word, with a flag where skipped lines precede.

    Each hit marks the line numbers it keeps and those right after a kept line; marks are merged
    per line and joined by line, so no document has to sit in one task.
    """
    reach = range(-CONTEXT_LINES, CONTEXT_LINES + 2)
    marks = F.array(
        *[
            F.struct(
                (F.col("line_no") + d).alias("line_no"),
                F.lit(d <= CONTEXT_LINES).alias("kept"),
                F.lit(d > -CONTEXT_LINES).alias("led"),
            )
            for d in reach
        ]
    )
    hits = lines.filter(F.col("line").rlike(BUILD_MARKER)).select(key, F.explode(marks).alias("m"))
    near = hits.groupBy(key, F.col("m.line_no").alias("line_no")).agg(
        F.max("m.kept").alias("kept"), F.max("m.led").alias("led")
    )
    kept = lines.join(near.filter("kept"), [key, "line_no"])
    return kept.select(
        key, "line_no", "line", ((F.col("line_no") > 1) & ~F.col("led")).alias("gap_before")
    )


def join_context(context: DataFrame, key: str = "doc_id") -> DataFrame:
    """One text per document from its kept lines, a note in place of every skipped run."""
    line = F.concat(F.when(F.col("gap_before"), OMITTED + "\n").otherwise(""), F.col("line"))
    pieces = context.withColumn("piece", line).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "piece"))).alias("pieces")
    )
    return pieces.select(
        key, F.array_join(F.transform("pieces", lambda p: p["piece"]), "\n").alias("content")
    )


def last_rows(df: DataFrame, keys: Iterable[str], order: str, count: int) -> DataFrame:
    """Last ``count`` rows of every group; Spark keeps only ``count`` per task before the shuffle."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("rank_", F.row_number().over(latest)).filter(F.col("rank_") <= count).drop("rank_")


__all__ = [
    "block_events", "clean_lines", "context_lines", "join_context", "last_rows", "line_measures",
    "numbered_blocks", "to_lines", "trim_space",
]
