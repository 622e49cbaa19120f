"""Text files as line tables: one file is read by as many tasks as it has splits.

Rows come in order within a split, so a line's number is that of the lines in earlier splits of its file plus
its place in its own. The rows are written once with their split and place; counts per split and their
running sums along a file (one row per split) give the rest. Results are those of whole files read by
``files.read_logs`` and taken apart by ``operators.line_prepare.raw_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logmill.operators.line_prepare import PIECE
from logmill.session import written
from logmill.sources.files import plain_path, under_roots


def read_lines(spark: SparkSession, path: str | list[str], roots: list[str] | None = None, glob: str = "*", recursive: bool = True) -> DataFrame:
    """``(path, line_no, line, chars)`` of all files; lines end at CRLF, CR or LF, and ``chars`` counts their end.

    Spark's scans skip empty files, here as in ``files.read_logs``. Files outside the roots are left out. Bytes that are not
    UTF-8 are replaced, as by Spark's text reader; ``files.read_logs`` reports such files instead.
    """
    options = {"pathGlobFilter": glob, "recursiveFileLookup": str(recursive).lower()}
    rows = spark.read.options(**options).option("lineSep", "\n").text(path)
    named = plain_path(F.col("_metadata.file_path"))
    read = rows.select(
        named.alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("bytes"),
        F.explode(F.regexp_extract_all(F.concat("value", F.lit("\n")), F.lit(PIECE), F.lit(0))).alias("piece"),
    )
    read = read.withColumn("place", F.monotonically_increasing_id())
    if roots:
        read = read.filter(under_roots(F.col("path"), roots))
    # read only once: the places of a second scan might be dealt otherwise
    read = written(read, "read-lines")
    splits = read.groupBy("path", "split").agg(
        F.min("place").alias("from"), F.count(F.lit(1)).alias("count"), F.sum(F.octet_length("piece")).alias("own"), F.max("bytes").alias("bytes"),
    )
    along = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("path")
    known = splits.select(
        "path", "split", "from", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("before"), F.sum("count").over(file).alias("lines"),
        (F.sum("own").over(file) > F.max("bytes").over(file)).alias("unended"),
    )
    numbered = read.join(known, ["path", "split"])
    number = F.col("before") + F.col("place") - F.col("from") + 1
    # the line end that was put behind a file's last line may not be there
    chars = F.length("piece") - F.when(F.col("unended") & (number == F.col("lines")), 1).otherwise(0)
    return numbered.select("path", number.alias("line_no"), F.rtrim("piece", F.lit("\r\n")).alias("line"), chars.cast("bigint").alias("chars"))
