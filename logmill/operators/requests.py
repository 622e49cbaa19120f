"""Preparation requests as a table: one response row and one audit row per request.

Bad requests become rows with an error code; nothing raises.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from logmill.functions.batching import clamp_budget, raw_batches
from logmill.functions.text import sealed, token_estimate
from logmill.operators.prepare import prepare, reduction_percent
from logmill.plans.catalog import BUILT_IN, Profile

# Modes and messages of the request contract.
MODES = ("auto", "raw", "parsed", "compare")
DEFAULT_LIMIT = 10 * 1024 * 1024
FALLBACK_WARNING = "Unknown format: returned Raw fallback."
CLIENT = "mcp-client"
TOOL = "prepare_log"

REQUEST = (
    "request_id string, path string, text string, name string, mode string, batch_index int, "
    "batch_chars int, save_artifacts boolean, client string"
)


def clamp_limit(requested: Column | int | None) -> Column:
    """Input limit in bytes: 10 MiB by default, between 1 KiB and 100 MiB."""
    value = F.lit(requested) if not isinstance(requested, Column) else requested
    return F.least(
        F.greatest(F.coalesce(value.cast("bigint"), F.lit(DEFAULT_LIMIT)), F.lit(1_024)),
        F.lit(100 * 1024 * 1024),
    )


def validate(requests: DataFrame, limit: Column | int | None = None) -> DataFrame:
    """Add ``input_name`` and, for requests that cannot run, ``error_code`` and ``message``."""
    limit = clamp_limit(limit)
    has_path, has_text = F.col("path").isNotNull(), F.col("text").isNotNull()
    mode = F.lower(F.coalesce("mode", F.lit("auto")))
    rejected = (
        F.when(has_path == has_text, "provide exactly one of path or text")
        .when(has_text & (F.col("text") == ""), "input is empty")
        .when(
            has_text & (F.octet_length("text") > limit),
            F.concat(F.lit("inline text exceeds "), limit, F.lit(" bytes")),
        )
    )
    base = F.regexp_extract("path", r"([^/]+)/*$", 1)
    name = F.coalesce(
        F.when(has_path, F.nullif(base, F.lit(""))), F.col("name"),
        F.when(rejected.isNull(), F.lit("inline.log")).otherwise(F.lit("input")),
    )
    checked = requests.withColumn("rejected_", rejected)
    bad_mode = ~mode.isin(*MODES)
    return checked.select(
        *requests.columns,
        mode.alias("requested_mode"),
        name.alias("input_name"),
        F.when(F.col("rejected_").isNotNull(), "input_rejected")
        .when(bad_mode, "invalid_mode")
        .alias("error_code"),
        F.coalesce(
            "rejected_", F.when(bad_mode, "mode must be auto, raw, parsed, or compare")
        ).alias("message"),
    )


def attach_files(checked: DataFrame, files: DataFrame) -> DataFrame:
    """Fill ``text`` of path requests from loaded files ``(path, text, error)``. A path that is no file
    but has files below it is a folder."""
    found = files.select(
        "path", F.col("text").alias("file_text"), F.col("error").alias("file_error")
    ).withColumn("found_", F.lit(True))
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    folders = (
        files.select(F.explode(above).alias("folder_")).distinct().withColumn("is_folder_", F.lit(True))
    )
    joined = checked.join(found, "path", "left").join(
        folders, F.regexp_replace(F.col("path"), "/+$", "") == F.col("folder_"), "left"
    )
    missing = F.col("path").isNotNull() & F.col("found_").isNull()
    error = (
        F.when(missing & F.col("is_folder_").isNotNull(), "path is not a regular file")
        .when(missing, "cannot resolve path").otherwise(F.col("file_error"))
    )
    failed = F.col("error_code").isNull() & F.col("path").isNotNull() & error.isNotNull()
    return joined.select(
        *[c for c in checked.columns if c not in ("text", "error_code", "message")],
        F.coalesce("text", "file_text").alias("text"),
        F.when(failed, "input_rejected").otherwise(F.col("error_code")).alias("error_code"),
        F.when(failed, error).otherwise(F.col("message")).alias("message"),
    )


def respond(
    requests: DataFrame,
    files: DataFrame | None = None,
    profiles: Iterable[Profile] = BUILT_IN,
    limit: Column | int | None = None,
    parity: bool = False,
) -> DataFrame:
    """Answer every request with the wanted batch and its measures. Without ``files`` no path resolves."""
    checked = validate(requests, limit)
    if files is None:
        lost = F.col("error_code").isNull() & F.col("path").isNotNull()
        checked = checked.withColumns({
            "message": F.when(lost, "cannot resolve path").otherwise(F.col("message")),
            "error_code": F.when(lost, "input_rejected").otherwise(F.col("error_code")),
        })
    else:
        checked = attach_files(checked, files)
    ready = checked.withColumn("budget_", clamp_budget(F.col("batch_chars")))
    usable = ready.withColumn(
        "text", F.when(F.col("error_code").isNull(), F.col("text")).otherwise(F.lit(""))
    )
    prepared = prepare(usable, F.col("budget_"), profiles, parity=parity)
    mode = F.col("requested_mode")
    sent = (
        F.when(mode == "auto", F.col("selected_variant"))
        .when(mode == "raw", "Raw")
        .when(mode == "compare", "Compare")
        .otherwise(F.when(F.col("normalized"), "Parsed").otherwise("Raw fallback"))
    )
    need_raw = mode.isin("raw", "compare") | ((mode == "parsed") & ~F.col("normalized"))
    need_parsed = (mode == "compare") | ((mode == "parsed") & F.col("normalized"))
    none = F.array().cast("array<string>")
    staged = prepared.select(
        "*",
        sent.alias("sent_variant"),
        F.when(need_raw, raw_batches(F.col("clean"), F.col("budget_"))).otherwise(none).alias("raws"),
        F.when(need_parsed, raw_batches(F.col("parsed_preview"), F.col("budget_")))
        .otherwise(none)
        .alias("parses"),
    )
    at = F.coalesce("batch_index", F.lit(0))
    chosen = (
        F.when(F.col("sent_variant") == "Compare", none)
        .when(mode == "auto", F.col("batches"))
        .when(need_raw, F.col("raws"))
        .otherwise(F.col("parses"))
    )
    compare = mode == "compare"
    count = F.when(compare, F.greatest(F.size("raws"), F.size("parses"))).otherwise(F.size("chosen"))
    raw_chars, parsed_chars = F.length("clean"), F.length("parsed_preview")
    numbered = staged.withColumn("chosen", chosen).select(
        "*", count.alias("batch_count"), at.alias("at")
    )
    outside = F.col("error_code").isNull() & (
        (F.col("at") >= F.col("batch_count")) | (F.col("at") < 0)
    )
    code = F.when(outside, "batch_out_of_range").otherwise(F.col("error_code"))
    message = F.when(
        outside,
        F.concat(F.lit("batch_index "), F.col("at"), F.lit(" is outside 0.."), F.col("batch_count")),
    ).otherwise(F.col("message"))
    content = F.when(~compare, F.get("chosen", F.col("at")))
    raw_content = F.when(compare, F.get("raws", F.col("at")))
    parsed_content = F.when(compare, F.get("parses", F.col("at")))
    size = F.coalesce(
        F.length(content),
        F.coalesce(F.length(raw_content), F.lit(0)) + F.coalesce(F.length(parsed_content), F.lit(0)),
    )
    ok = code.isNull()

    def when_ok(c: Column) -> Column:
        return F.when(ok, c)

    columns = {
        "contract_version": F.lit(1),
        "status": F.when(~ok, "error").when(F.col("normalized"), "ok").otherwise("raw_fallback"),
        "detected_format": when_ok(F.col("detected_format")),
        "sent_variant": when_ok(F.col("sent_variant")),
        "raw_chars": when_ok(raw_chars.cast("bigint")),
        "parsed_chars": when_ok(parsed_chars.cast("bigint")),
        "raw_tokens_estimate": when_ok(token_estimate(raw_chars)),
        "parsed_tokens_estimate": when_ok(token_estimate(parsed_chars)),
        "reduction_percent": when_ok(reduction_percent(raw_chars, parsed_chars)),
        "event_count": when_ok(F.col("event_count")),
        "important_events": when_ok(F.col("important_events")),
        "duplicates_removed": when_ok(F.col("duplicate_count")),
        "batch_index": when_ok(F.col("at").cast("bigint")),
        "batch_count": when_ok(F.col("batch_count").cast("bigint")),
        "batch_chars": when_ok(size.cast("bigint")),
        "batch_tokens_estimate": when_ok(token_estimate(size)),
        "content": when_ok(content),
        "raw_content": when_ok(raw_content),
        "parsed_content": when_ok(parsed_content),
        "warnings": F.when(
            ok & (F.col("sent_variant") == "Raw fallback"), F.array(F.lit(FALLBACK_WARNING))
        ).otherwise(none),
        "error_code": code,
        "message": message,
    }
    base = F.nullif(F.regexp_extract("path", r"([^/]+)/*$", 1), F.lit(""))
    numbered = numbered.withColumn(
        "input_name",
        F.when(code.isNotNull(), F.coalesce("name", base, F.lit("input"))).otherwise(
            F.col("input_name")
        ),
    )
    return sealed(
        numbered, ["request_id", "input_name", "requested_mode", "client", "save_artifacts",
                   "raw_preview", "parsed_preview"], columns
    )


def audit_rows(responses: DataFrame, duration_ms: Column | None = None, tool: str = TOOL) -> DataFrame:
    """The metadata-only audit row of every response; it holds no log text."""
    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    return responses.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"),
        "request_id",
        F.coalesce("client", F.lit(CLIENT)).alias("client"),
        F.lit(tool).alias("tool"),
        "input_name",
        F.coalesce("detected_format", F.lit("unknown")).alias("detected_format"),
        "status",
        number("raw_chars").alias("raw_chars"),
        number("parsed_chars").alias("parsed_chars"),
        number("raw_tokens_estimate").alias("raw_tokens"),
        number("parsed_tokens_estimate").alias("parsed_tokens"),
        F.coalesce("sent_variant", F.lit("none")).alias("sent_variant"),
        number("event_count").alias("events"),
        number("important_events").alias("important_events"),
        number("duplicates_removed").alias("duplicates"),
        number("batch_count").alias("batches"),
        (F.lit(0) if duration_ms is None else duration_ms).cast("bigint").alias("duration_ms"),
        "error_code",
    )


def public_columns(responses: DataFrame) -> DataFrame:
    """The response contract: no previews, no request-only columns."""
    return responses.drop("client", "save_artifacts", "raw_preview", "parsed_preview")
