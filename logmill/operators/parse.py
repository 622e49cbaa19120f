"""Documents to parsed documents and to event rows. No operator here moves rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from logmill.functions.records import json_records, with_fields
from logmill.functions.severity import severity_rank
from logmill.functions.text import cached, let, sanitized, sealed, trim_space
from logmill.plans.catalog import BUILT_IN, Profile, profiles_json
from logmill.plans.detect import best_format
from logmill.plans.extract import EVENT, has_content, json_events, text_events


def _checked(event: Column, fmt: Column, free: list[str]) -> Column:
    """Whether one JSON record gave a usable event."""
    good = event.isNotNull() & has_content(event)
    if free:
        good = event.isNotNull() & (has_content(event) | fmt.isin(*free))
    return F.coalesce(good, F.lit(False))


def _records() -> Column:
    return F.transform(json_records(F.col("trimmed")), with_fields)


def _formats(profiles: list[Profile]) -> Column:
    of_text = F.array(best_format(profiles, "text", F.col("trimmed")))
    of_records = F.transform(
        F.col("records"), lambda r: best_format(profiles, "json", F.to_json(r["value"]), r)
    )
    return F.when(F.col("records").isNull(), of_text).otherwise(of_records)


def _found(profiles: list[Profile]) -> Column:
    fmt = F.get(F.col("formats"), F.lit(0))
    return (
        F.when(
            F.col("records").isNotNull(),
            json_events(profiles, F.col("formats"), F.col("records")),
        )
        .when(fmt.isNotNull(), text_events(profiles, fmt, F.col("trimmed")))
        .otherwise(F.array().cast(f"array<{EVENT}>"))
    )


def _outcome(profiles: list[Profile]) -> Column:
    fmt = F.get(F.col("formats"), F.lit(0))
    no_content = [p.id for p in profiles if not p.require_content]
    no_events = [p.id for p in profiles if not p.require_events]

    def json_outcome(formats: Column, found: Column) -> Column:
        flags = F.transform(found, lambda e, i: _checked(e, F.get(formats, i), no_content))
        bad = F.array_position(flags, F.lit(False))
        good = F.when(bad == 0, F.size(found)).otherwise(bad - 1).cast("int")
        return let(
            good,
            lambda n: F.struct(
                F.array_distinct(F.slice(formats, F.lit(1), n)).alias("format_ids"),
                ((n == F.size(found)) & (n > 0)).alias("supported"),
            ),
        )

    full = F.forall(F.col("found"), lambda e: has_content(e))
    some = F.size("found") > 0
    if no_content:
        full = full | fmt.isin(*no_content)
    if no_events:
        some = some | fmt.isin(*no_events)
    text_outcome = F.struct(
        F.array_compact(F.col("formats")).alias("format_ids"),
        (fmt.isNotNull() & some & full).alias("supported"),
    )
    return F.when(
        F.col("records").isNotNull(),
        let(F.col("formats"), lambda fs: let(F.col("found"), lambda ev: json_outcome(fs, ev))),
    ).otherwise(text_outcome)


_PARTS = {"formats": _formats, "found": _found, "outcome": _outcome}


def compiled(part: str, profiles: Iterable[Profile]) -> Column:
    """The named column for a catalog, built once per catalog."""
    profiles = list(profiles)
    return cached((part, profiles_json(profiles)), lambda: _PARTS[part](profiles))


def detect(docs: DataFrame, profiles: Iterable[Profile] = BUILT_IN, text: str = "text") -> DataFrame:
    """Add ``clean`` (sanitized text), ``trimmed``, ``records`` and ``formats``.

    ``records`` (value and fields of each JSON record) is NULL for text documents. ``formats`` holds the best format id of the text, or of
    each JSON record; NULL entries matched nothing.
    """
    staged = (
        docs.withColumn("clean", cached(("clean", text), lambda: sanitized(F.col(text))))
        .withColumn("trimmed", trim_space(F.col("clean")))
        .withColumn("records", cached(("records",), _records))
    )
    added = {"formats": compiled("formats", profiles)}
    added = {c: F.col(c) for c in ("clean", "trimmed", "records")} | added
    return sealed(staged, [c for c in docs.columns if c not in added], added)


def parse(docs: DataFrame, profiles: Iterable[Profile] = BUILT_IN, text: str = "text") -> DataFrame:
    """Add ``clean``, ``format_ids``, ``supported`` and ``events`` to every document.

    A document is supported when it has events and all of them have content; one JSON record
    without a format or content makes the whole document unsupported, and ``format_ids`` then
    lists the ids met before it.
    """
    profiles = list(profiles)
    staged = detect(docs, profiles, text)
    staged = staged.withColumn("found", compiled("found", profiles))
    staged = staged.withColumn("outcome", compiled("outcome", profiles))
    supported = F.coalesce(F.col("outcome.supported"), F.lit(False))
    added = {
        "clean": F.col("clean"),
        "format_ids": F.col("outcome.format_ids"),
        "supported": supported,
        "events": F.when(supported, F.col("found")).otherwise(F.array().cast(f"array<{EVENT}>")),
    }
    return sealed(staged, [c for c in docs.columns if c not in added], added)


def format_label(format_ids: Column, supported: Column) -> Column:
    joined = F.concat_ws(" + ", format_ids)
    raw = F.when(F.size(format_ids) > 0, F.concat(joined, F.lit(" -> raw"))).otherwise(
        F.lit("unknown -> raw")
    )
    return F.when(supported, joined).otherwise(raw)


def outcomes(docs: DataFrame, key: str = "doc_id", profiles: Iterable[Profile] = BUILT_IN) -> DataFrame:
    """One row per document: ordered format ids, support and label."""
    parsed = parse(docs, profiles)
    return parsed.select(
        key, "format_ids", "supported",
        F.size("events").alias("event_count"),
        format_label(F.col("format_ids"), F.col("supported")).alias("detected_format"),
    )


def event_rows(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Explode parsed documents to one row per event, ``seq`` from 0 in document order."""
    rows = parsed.select(key, F.posexplode("events").alias("seq", "event"))
    return rows.select(
        key, "seq", "event.source", "event.severity", "event.content", "event.fingerprint",
        severity_rank(F.col("event.severity")).alias("severity_rank"),
    )


def events(docs: DataFrame, key: str = "doc_id", profiles: Iterable[Profile] = BUILT_IN) -> DataFrame:
    return event_rows(parse(docs, profiles), key)
