"""Corpus-wide tables over parsed or prepared documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logmill.functions.severity import is_important
from logmill.operators.prepare import event_groups, reduction_percent
from logmill.plans.catalog import Profile
from logmill.session import written


def templates(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every fingerprint of the corpus with total repeats, documents and its first example.

    Documents are deduplicated inside their row and written once. Counts and the first document (a
    numeric ``key``) are partially aggregated in hash tables: at most one row per fingerprint and task
    is shuffled. The example comes by an equi-join on fingerprint and document, which no template skews.
    """
    rows = written(event_groups(parsed, key).select(key, "fingerprint", "repeats", "content"), "template-rows")
    counted = rows.groupBy("fingerprint").agg(
        F.sum("repeats").alias("total_repeats"), F.count(F.lit(1)).alias("documents"), F.min(key).alias(key)
    )
    # a document has a fingerprint once
    return rows.select(key, "fingerprint", F.col("content").alias("example")).join(counted, [key, "fingerprint"]).select(
        "fingerprint", "total_repeats", "documents", "example"
    )


def severity_histogram(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("events"))


def important_share(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(is_important(F.col("severity"))).alias("important_events"),
    )


def totals(summary: DataFrame, rollup: bool = False) -> DataFrame:
    """Roll-up of document summaries by format and variant."""
    keys = ["detected_format", "selected_variant"]
    grouped = summary.rollup(*keys) if rollup else summary.groupBy(*keys)
    return grouped.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("original_chars").alias("chars_before"),
        F.sum("normalized_chars").alias("chars_after"),
        F.sum("event_count").alias("events"),
        F.sum("important_events").alias("important_events"),
        F.sum("duplicate_count").alias("duplicates"),
        F.sum("batch_count").alias("batches"),
        F.count_if(~F.col("normalized")).alias("fallbacks"),
    )


def review(summary: DataFrame, name: Column | str = "name") -> DataFrame:
    """Per-file review line: size before and after, counts and batches."""
    return summary.select(
        F.col(name).alias("file") if isinstance(name, str) else name.alias("file"),
        "detected_format", "original_chars", "normalized_chars", "event_count",
        "important_events", "duplicate_count", "batch_count",
        F.round(reduction_percent(F.col("original_chars"), F.col("normalized_chars")), 4).alias(
            "reduction_percent"
        ),
    )


def catalog_table(spark: SparkSession, profiles: Iterable[Profile]) -> DataFrame:
    """The catalog as a table of ids, kinds, scores, applications and ranks."""
    rows = [
        (i, p.id, p.record_kind, p.kind, p.score, p.label, p.catalog_rank)
        for i, p in enumerate(profiles)
    ]
    return spark.createDataFrame(
        rows,
        "ordinal int, id string, record_kind string, parser_kind string, score int, "
        "application string, catalog_rank int",
    )


def format_usage(outcomes: DataFrame, profiles: Iterable[Profile]) -> DataFrame:
    """Documents per format id with the application and rank of the catalog."""
    catalog = catalog_table(outcomes.sparkSession, profiles)
    used = outcomes.filter("supported").select(F.explode("format_ids").alias("id"))
    counted = used.groupBy("id").agg(F.count(F.lit(1)).alias("documents"))
    return counted.join(catalog, "id").select(
        "id", "application", "catalog_rank", "documents"
    )


def ambiguous(outcomes: DataFrame) -> DataFrame:
    """Documents that do not have exactly one format id."""
    return outcomes.filter(F.size("format_ids") != 1)


def golden_mismatches(outcomes: DataFrame, expected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Expected against detected formats; rows that differ (missing documents included)."""
    joined = expected.join(outcomes.select(key, "detected_format"), key, "left")
    return joined.filter(~F.col("detected_format").eqNullSafe(F.col("expected_format")))


def coverage_counts(coverage: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of covered / partial / raw sources (unknown words count only in the total)."""
    status = F.trim("coverage")
    return coverage.groupBy(*(by or [])).agg(
        F.count_if(status == "covered").alias("covered"),
        F.count_if(status == "partial").alias("partial"),
        F.count_if(status == "raw").alias("raw"),
        F.count(F.lit(1)).alias("total"),
    )


def coverage_gaps(coverage: DataFrame, ranks: int | None = None) -> DataFrame:
    """Ranks from 1 to ``ranks`` (without it, to the number of rows) that are missing or repeated, and
    ranks outside."""
    ranks = coverage.count() if ranks is None else ranks
    wanted = coverage.sparkSession.range(1, ranks + 1).withColumnRenamed("id", "rank")
    present = coverage.groupBy(F.col("rank").cast("bigint").alias("rank")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    joined = wanted.join(present, "rank", "full_outer")
    outside = (F.col("rank") < 1) | (F.col("rank") > ranks)
    return joined.select("rank", F.coalesce("rows", F.lit(0)).alias("rows")).filter(
        (F.col("rows") != 1) | outside
    )


def coverage_report(coverage: DataFrame) -> DataFrame:
    """Report lines by rank."""
    line = F.concat_ws(" | ", F.col("rank").cast("string"), "volume", "application", "coverage",
                       "adapter_or_gap")
    return coverage.select("rank", F.concat(F.lit("| "), line, F.lit(" |")).alias("line")).orderBy("rank")
