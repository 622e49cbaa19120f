"""Writers. Every writer appends files through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logmill.functions.text import safe_name
from logmill.operators.corpus import review


def write_audit(rows: DataFrame, path: str) -> None:
    """Append metadata-only audit rows as JSON lines."""
    rows.write.mode("append").json(path)


def artifact_rows(responses: DataFrame, parity: bool = False) -> DataFrame:
    """Raw and parsed text of the requests that asked for artifacts, under safe names."""
    wanted = responses.filter(F.coalesce("save_artifacts", F.lit(False)) & F.col("error_code").isNull())
    both = F.array(
        F.struct(F.lit("raw").alias("kind"), F.col("raw_preview").alias("text")),
        F.struct(F.lit("parsed").alias("kind"), F.col("parsed_preview").alias("text")),
    )
    rows = wanted.select(
        safe_name(F.col("request_id")).alias("request_id"),
        safe_name(F.col("input_name")).alias("input_name"),
        F.explode(both).alias("a"),
    )
    return rows.select(
        "request_id",
        F.col("a.kind").alias("kind"),
        F.concat("input_name", F.lit("."), F.col("a.kind"), F.lit(".log")).alias("name"),
        F.col("a.text").alias("text"),
    )


def write_artifacts(responses: DataFrame, path: str) -> None:
    artifact_rows(responses).write.mode("append").partitionBy("kind").parquet(path)


def write_folders(rows: DataFrame, path: str, folders: list[str]) -> None:
    """Text files in a new folder, one in each folder of ``folders``. What a file costs to make, not its size, is what
    such writing takes: the folders are dealt over all cores, and each task puts its files in their place itself."""
    dealt = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *folders)
    dealt.write.partitionBy(*folders).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def report_text(prepared: DataFrame, key: str = "doc_id") -> DataFrame:
    """Review report of every prepared document: raw, parsed and sent batches."""
    numbered = F.transform(
        F.col("batches"),
        lambda b, i: F.concat(
            F.lit("### Batch "), i + 1, F.lit("\n\n```text\n"), b, F.lit("\n```")
        ),
    )
    report = F.concat(
        F.lit("# "), F.col("name"),
        F.lit("\n\nFormat: `"), F.col("detected_format"), F.lit("` · chars "),
        F.col("original_chars"), F.lit("→"), F.col("normalized_chars"),
        F.lit(" · events "), F.col("event_count"), F.lit(" · important "), F.col("important_events"),
        F.lit(" · duplicates "), F.col("duplicate_count"), F.lit(" · batches "), F.size("batches"),
        F.lit("\n\n## Raw\n\n```text\n"), F.col("raw_preview"),
        F.lit("\n```\n\n## Parsed\n\n```text\n"), F.col("parsed_preview"),
        F.lit("\n```\n\n## Sent batches\n\n"), F.array_join(numbered, "\n\n"), F.lit("\n"),
    )
    return prepared.select(key, "name", report.alias("report"))


def write_review(prepared: DataFrame, path: str, key: str = "doc_id") -> None:
    """Summary table and per-file reports."""
    counted = prepared.withColumn("batch_count", F.size("batches").cast("bigint"))
    review(counted).write.mode("overwrite").json(f"{path}/summary")
    report_text(prepared, key).write.mode("overwrite").parquet(f"{path}/reports")


def write_responses(responses: DataFrame, path: str) -> DataFrame:
    """Write responses once; audit rows, artifacts and answers are then read from the table."""
    responses.write.mode("append").parquet(path)
    return responses.sparkSession.read.schema(responses.schema).parquet(path)


def draft_envelopes(drafts: DataFrame) -> DataFrame:
    """JSON envelope of every validated draft answer."""
    envelope = F.struct(
        F.lit(1).alias("metadata_version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
        F.col("source_log"), F.col("provider"), F.col("model"), F.col("sample_chars_sent"),
        F.col("model_answer"), F.col("validated_schema"),
    )
    return drafts.select("id", F.to_json(envelope).alias("value"))


def write_draft_envelopes(drafts: DataFrame, path: str) -> None:
    draft_envelopes(drafts).select("value").write.mode("append").text(path)
