"""File readers. Bad files become rows with an error, never an exception."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logmill.operators.requests import clamp_limit

SESSION_LIMIT = 20 * 1024 * 1024
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp")
COVERAGE = (
    "rank int, volume string, application string, coverage string, adapter_or_gap string"
)


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path as the readers' ``path`` column spells it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    named = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub("^file:/+", "/", named)


def under_roots(path: Column, roots: list[str]) -> Column:
    """Whole-component prefix test against a list of allowed roots."""
    out = F.lit(False)
    for root in roots:
        root = root.rstrip("/") or "/"
        prefix = root if root == "/" else root + "/"
        out = out | (path == root) | F.startswith(path, F.lit(prefix))
    return out


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route(path: Column) -> Column:
    """``image`` for picture files (left to other tools), ``log`` for everything else."""
    return F.when(suffix(path).isin(*IMAGE_SUFFIXES), "image").otherwise("log")


def file_name(path: Column) -> Column:
    return F.coalesce(
        F.nullif(F.regexp_extract(path, r"([^/]+)/*$", 1), F.lit("")), F.lit("input.log")
    )


def read_logs(
    spark: SparkSession,
    path: str | list[str],
    limit: int | None = None,
    roots: list[str] | None = None,
    glob: str = "*",
    recursive: bool = True,
) -> DataFrame:
    """Whole log files as ``(path, name, length, text, error)``.

    The length is file metadata: content over the limit is not decoded.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )
    cap = clamp_limit(limit)
    named = plain_path(F.col("path"))
    allowed = under_roots(named, roots) if roots else F.lit(True)
    fits = F.col("length") <= cap
    # The length test reaches the scan: content over the limit is never read.
    small = files.filter(fits).select(
        named.alias("path"), "length", F.col("content").cast("string").alias("content"),
        F.when(~allowed, "path is outside the allowed roots").alias("outside"),
    )
    large = files.filter(~fits).select(
        named.alias("path"), "length", F.lit(None).cast("string").alias("text"),
        F.when(~allowed, "path is outside the allowed roots")
        .otherwise(F.concat(F.lit("file exceeds "), cap, F.lit(" bytes")))
        .alias("error"),
    )
    error = F.coalesce(
        "outside", F.when(~F.is_valid_utf8("content"), "file is not valid UTF-8")
    )
    read = small.withColumn("error", error).select(
        "path", "length", F.when(F.col("error").isNull(), F.col("content")).alias("text"), "error"
    )
    return read.unionByName(large).select(
        "path", file_name(F.col("path")).alias("name"), "length", "text", "error"
    )


def read_profile_files(spark: SparkSession, path: str) -> DataFrame:
    """Profile files of a directory as ``(path, text)``."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return files.select(plain_path(F.input_file_name()).alias("path"), F.col("value").alias("text"))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=COVERAGE)


def documents_from(files: DataFrame) -> DataFrame:
    """Readable log files as documents keyed by path."""
    return files.filter(F.col("error").isNull() & (route(F.col("path")) == "log")).select(
        F.col("path").alias("doc_id"), "name", "text"
    )


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, as its own file system says."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
