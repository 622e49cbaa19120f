"""Deduplicate, render, choose the smaller variant and batch: one summary row per document.

Deduplication sorts (hash, fingerprint, position) inside the document's row: n log n, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from logmill.functions.batching import MIN_BUDGET, event_batch_count, event_batches, raw_batch_count, raw_batches
from logmill.functions.severity import is_important
from logmill.functions.text import cached, let, sealed, token_estimate
from logmill.operators.parse import format_label, parse
from logmill.plans.catalog import BUILT_IN, Profile

GROUP = "struct<first:int,source:string,severity:string,content:string,fingerprint:string,repeats:bigint>"


def deduplicate(events: Column) -> Column:
    """First event of every fingerprint with its repeat count, in first-seen order."""

    def grouped(ev: Column) -> Column:
        keys = F.sort_array(
            F.transform(
                ev,
                lambda e, i: F.struct(
                    F.xxhash64(e["fingerprint"]).alias("h"),
                    e["fingerprint"].alias("f"),
                    i.alias("i"),
                ),
            )
        )

        def heads(s: Column) -> Column:
            opens = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda i: (i == 0) | (F.get(s, i)["f"] != F.get(s, i - 1)["f"]),
            )

            def counted(starts: Column) -> Column:
                return F.transform(
                    starts,
                    lambda p, k: F.struct(
                        F.get(s, p)["i"].alias("first"),
                        (F.coalesce(F.get(starts, k + 1), F.size(s)) - p)
                        .cast("bigint")
                        .alias("repeats"),
                    ),
                )

            return F.sort_array(let(opens, counted))

        return F.transform(
            let(keys, heads),
            lambda g: F.struct(
                g["first"].cast("int").alias("first"),
                F.get(ev, g["first"])["source"].alias("source"),
                F.get(ev, g["first"])["severity"].alias("severity"),
                F.get(ev, g["first"])["content"].alias("content"),
                F.get(ev, g["first"])["fingerprint"].alias("fingerprint"),
                g["repeats"].alias("repeats"),
            ),
        )

    return F.when(F.size(events) == 0, F.array().cast(f"array<{GROUP}>")).otherwise(
        let(events, grouped)
    )


def render_event(source: Column, severity: Column, repeats: Column, content: Column) -> Column:
    times = F.when(
        repeats > 1, F.concat(F.lit(" · repeated "), repeats, F.lit(" times"))
    ).otherwise("")
    return F.concat(
        F.lit("["), source, F.lit(" · "), severity, times, F.lit("]\n"), content
    )


def rendered(groups: Column) -> Column:
    return F.transform(
        groups, lambda g: render_event(g["source"], g["severity"], g["repeats"], g["content"])
    )


def rendered_lengths(groups: Column) -> Column:
    """The lengths of ``rendered``, without making the texts."""
    def one(g: Column) -> Column:
        return F.length(render_event(g["source"], g["severity"], g["repeats"], F.lit(""))) + F.length(g["content"])

    return F.transform(groups, one)


def event_groups(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per distinct fingerprint of a document, with its first event and repeat count."""
    rows = parsed.select(key, F.explode(deduplicate(F.col("events"))).alias("g"))
    return rows.select(
        key,
        F.col("g.first").alias("first_seq"),
        "g.source", "g.severity", "g.content", "g.fingerprint", "g.repeats",
    )


def _batches() -> Column:
    budget = F.col("budget")
    return F.when(
        F.col("raw_text").isNotNull(), raw_batches(F.col("raw_text"), budget)
    ).otherwise(event_batches(F.col("rendered"), budget))


def prepare(
    docs: DataFrame,
    batch_chars: Column | int = 12_000,
    profiles: Iterable[Profile] = BUILT_IN,
    text: str = "text",
    parity: bool = False,
) -> DataFrame:
    """Summary, previews and batches of every document.

    Unknown documents fall back to raw batches. They are redacted like all others unless
    ``parity`` asks for the unredacted input there.
    """
    budget = F.lit(batch_chars) if isinstance(batch_chars, int) else batch_chars
    budget = F.greatest(budget.cast("int"), F.lit(MIN_BUDGET))
    kept = [c for c in docs.columns if c not in (text, "clean")]
    parsed = parse(docs.withColumn("budget", budget), profiles, text)
    staged = parsed.withColumn("groups", cached(("groups",), lambda: deduplicate(F.col("events"))))
    staged = staged.withColumn("rendered", cached(("rendered",), lambda: rendered(F.col("groups"))))
    staged = staged.withColumn("parsed_text", F.array_join("rendered", "\n\n"))
    supported = F.col("supported")
    fallback_name = text if parity else "clean"
    fallback = F.col(fallback_name)
    use_raw = supported & (F.length("clean") < F.length("parsed_text"))
    staged = staged.withColumn("use_raw", use_raw)
    # the one text to cut into raw batches: unknown documents or those where raw is smaller
    staged = staged.withColumn(
        "raw_text", F.when(~supported, fallback).when(F.col("use_raw"), F.col("clean"))
    )
    original = F.length(text)
    batches = cached(("batches",), _batches)
    selected = (
        F.when(~supported, original)
        .when(F.col("use_raw"), F.length("clean"))
        .otherwise(F.length("parsed_text"))
    )
    important = F.size(F.filter("events", lambda e: is_important(e["severity"])))
    columns = {
        "clean": F.col("clean"),
        "detected_format": format_label(F.col("format_ids"), supported),
        "original_chars": original.cast("bigint"),
        "normalized_chars": F.when(supported, F.length("parsed_text")).otherwise(original).cast("bigint"),
        "event_count": F.when(supported, F.size("events")).otherwise(1).cast("bigint"),
        "important_events": F.when(supported, important).otherwise(0).cast("bigint"),
        "duplicate_count": F.when(supported, F.size("events") - F.size("groups"))
        .otherwise(0)
        .cast("bigint"),
        "estimated_tokens": token_estimate(selected),
        "selected_variant": F.when(supported & ~F.col("use_raw"), "Parsed").otherwise("Raw"),
        "batches": batches,
        "raw_preview": fallback if parity else F.col("clean"),
        "parsed_preview": F.when(supported, F.col("parsed_text")).otherwise(fallback),
        "normalized": supported,
    }
    return sealed(staged, kept, columns)


def summarized(
    docs: DataFrame,
    batch_chars: Column | int = 12_000,
    profiles: Iterable[Profile] = BUILT_IN,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """``summary(prepare(docs))`` from lengths: no event is rendered and no batch is cut."""
    budget = F.lit(batch_chars) if isinstance(batch_chars, int) else batch_chars
    budget = F.greatest(budget.cast("int"), F.lit(MIN_BUDGET))
    parsed = parse(docs.select(key, F.col(text).alias("text")).withColumn("budget", budget), profiles)
    staged = parsed.withColumn("groups", cached(("groups",), lambda: deduplicate(F.col("events"))))
    staged = staged.withColumn("lengths", cached(("lengths",), lambda: rendered_lengths(F.col("groups"))))
    joined = F.aggregate("lengths", F.lit(0), lambda a, n: a + n) + F.greatest(2 * F.size("lengths") - 2, F.lit(0))
    staged = staged.withColumn("parsed_chars", joined)
    supported, clean = F.col("supported"), F.length("clean")
    raw = ~supported | (clean < F.col("parsed_chars"))
    original = F.length("text")
    selected = F.when(~supported, original).when(raw, clean).otherwise(F.col("parsed_chars"))
    important = F.size(F.filter("events", lambda e: is_important(e["severity"])))

    def counted(value: Column, other: Column | int) -> Column:
        return F.when(supported, value).otherwise(other).cast("bigint")

    batches = cached(("batch_count",), lambda: F.when(
        ~F.col("supported") | (F.length("clean") < F.col("parsed_chars")), raw_batch_count(F.col("clean"), F.col("budget"))
    ).otherwise(event_batch_count(F.col("lengths"), F.col("budget"))))
    return sealed(staged, [key], {
        "detected_format": format_label(F.col("format_ids"), supported),
        "original_chars": original.cast("bigint"),
        "normalized_chars": counted(F.col("parsed_chars"), original),
        "event_count": counted(F.size("events"), 1),
        "important_events": counted(important, 0),
        "duplicate_count": counted(F.size("events") - F.size("groups"), 0),
        "estimated_tokens": token_estimate(selected),
        "selected_variant": F.when(raw, "Raw").otherwise("Parsed"),
        "batch_count": batches.cast("bigint"),
        "normalized": supported,
    })


def summary(prepared: DataFrame, key: str = "doc_id") -> DataFrame:
    """The metadata columns of prepared documents with the batch count, without any text."""
    return prepared.select(
        key, "detected_format", "original_chars", "normalized_chars", "event_count",
        "important_events", "duplicate_count", "estimated_tokens", "selected_variant",
        F.size("batches").cast("bigint").alias("batch_count"), "normalized",
    )


def batch_rows(prepared: DataFrame, key: str = "doc_id") -> DataFrame:
    return prepared.select(
        key,
        F.col("selected_variant").alias("variant"),
        F.posexplode("batches").alias("batch_index", "content"),
    )


def prepare_raw(
    docs: DataFrame,
    char_budget: Column | int,
    profiles: Iterable[Profile] = BUILT_IN,
    text: str = "text",
    parity: bool = False,
) -> DataFrame:
    """Preparation switched off: one raw batch, or an error row above the character budget."""
    limit = F.lit(char_budget) if isinstance(char_budget, int) else char_budget
    kept = [c for c in docs.columns if c != text]
    parsed = parse(docs.withColumn("char_limit", limit), profiles, text)
    staged = parsed.withColumn("groups", cached(("groups",), lambda: deduplicate(F.col("events"))))
    size = F.length(text)
    fits = size <= F.col("char_limit")
    raw = F.col(text) if parity else F.col("clean")
    message = F.concat(
        F.lit("Raw log has "), size, F.lit(" characters but the current limit is "),
        F.col("char_limit"), F.lit(". Raise the limit or enable normalization."),
    )
    return staged.select(
        *kept,
        F.lit("raw (preparation disabled)").alias("detected_format"),
        size.cast("bigint").alias("original_chars"),
        token_estimate(size).alias("estimated_tokens"),
        F.when(fits, F.array(raw)).alias("batches"),
        F.when(
            fits,
            F.when(F.col("supported"), F.array_join(rendered(F.col("groups")), "\n\n")).otherwise(raw),
        ).alias("parsed_preview"),
        F.when(~fits, message).alias("error"),
    )


def reduction_percent(raw_chars: Column, parsed_chars: Column) -> Column:
    return F.when(raw_chars == 0, F.lit(0.0)).otherwise((1 - parsed_chars / raw_chars) * 100)


def preview(prepared: DataFrame, key: str = "doc_id") -> DataFrame:
    """All batches of a document in order, a separator line between them."""
    line = "\n\n--- next batch ---\n\n"
    return prepared.select(key, F.array_join("batches", line).alias("payload"))


__all__ = [
    "batch_rows", "deduplicate", "event_groups", "prepare", "prepare_raw", "preview",
    "reduction_percent", "render_event", "rendered", "rendered_lengths", "summarized", "summary",
]
