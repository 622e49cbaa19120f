"""Streaming line ingest, dedup, windows and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from logmill.functions.fingerprint import fingerprint
from logmill.functions.severity import is_important, text_severity
from logmill.functions.text import normalize_line, redact
from logmill.sources.keyed_table import KeyedTable


def line_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Text files as a stream of ``(source, line)``."""
    lines = spark.readStream.option("pathGlobFilter", glob).text(path)
    return lines.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("line"))


def measured(lines: DataFrame, level: Column | None = None) -> DataFrame:
    """Clean every line and add severity and fingerprint. Stateless."""
    clean = lines.withColumn("line", redact(normalize_line(F.col("line"))))
    level = F.lit("UNKNOWN") if level is None else level
    return clean.withColumn("severity", text_severity(level, F.col("line"))).withColumn(
        "fingerprint", fingerprint(F.col("line"))
    )


def first_of_template(
    lines: DataFrame, time: str = "event_time", delay: str = "10 minutes", keys=("source", "fingerprint")
) -> DataFrame:
    """Drop repeats of a template seen within the watermark delay."""
    return lines.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def window_counts(
    lines: DataFrame,
    time: str = "event_time",
    delay: str = "10 minutes",
    length: str = "1 hour",
    slide: str | None = None,
    by: tuple = ("severity",),
) -> DataFrame:
    """Events and important events per tumbling or sliding window; late rows are dropped."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    counted = lines.withWatermark(time, delay).groupBy(span, *by).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(is_important(F.col("severity"))).alias("important_events"),
    )
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *by, "events", "important_events",
    )


def partial_sessions(
    lines: DataFrame,
    key: str,
    time: str = "event_time",
    delay: str = "10 minutes",
    gap: str = "30 minutes",
) -> DataFrame:
    """Events of a source by ranges of time as long as the gap, for update mode.

    Two events of a range are nearer than the gap, so a range is part of one session. A busy source has one
    row per range, whatever its number of events.
    """
    counted = lines.withWatermark(time, delay).groupBy(F.window(time, gap), key).agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("events"),
        F.count_if(is_important(F.col("severity"))).alias("important_events"),
    )
    return counted.select(
        key, F.col("window.start").alias("range_start"), "first", "last", "events", "important_events"
    )


def merged_sessions(partial: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of partial ones: an interval belongs to the session before it unless it begins a gap or more
    after that session's last event. Sessions still open are included."""
    along = Window.partitionBy(key).orderBy("first")
    width = F.expr(f"interval {gap}")
    opens = F.coalesce(F.col("first") >= F.lag("last").over(along) + width, F.lit(True))
    numbered = partial.withColumn("opens", opens.cast("int")).withColumn("session", F.sum("opens").over(along))
    merged = numbered.groupBy(key, "session").agg(
        F.min("first").alias("session_start"), (F.max("last") + width).alias("session_end"),
        F.sum("events").alias("events"), F.sum("important_events").alias("important_events"),
    )
    return merged.drop("session")


def template_counts(lines: DataFrame) -> DataFrame:
    """Running template table, for update mode."""
    return lines.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("total_repeats"), F.min("line").alias("example")
    )


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to parquet files and stop when the available input is used up."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _by_batch(path: str, form: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the batch's own folder makes a repeated batch harmless.
        batch.write.format(form).mode("overwrite").save(f"{path}/batch={batch_id}")

    return write


def audit_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audit rows as JSON lines, one folder per micro-batch."""
    return (
        rows.writeStream.foreachBatch(_by_batch(path, "json"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def updates_to_files(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Changed rows of a streaming aggregation, a step of a keyed table per micro-batch. A repeated batch
    commits its step again."""
    table = KeyedTable(stream.sparkSession, path, keys)

    def step(batch: DataFrame, batch_id: int) -> None:
        table.put(batch, batch_id, again=True)

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current table from the written updates: the newest row of every key, from a few merged folders."""
    return KeyedTable(spark, path, keys).rows()


def latest_templates(spark: SparkSession, path: str) -> DataFrame:
    """Current template table."""
    return latest(spark, path, ["fingerprint"])
