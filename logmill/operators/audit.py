"""Independent audit: raw lines against the events that were rendered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logmill.functions.fingerprint import audit_signature
from logmill.functions.severity import LABELS, raw_line_level
from logmill.functions.text import fold, is_blank, let, mask_pii, text_lines, trim_space_end
from logmill.session import written

# The event header of a rendered report and the words of a priority line.
HEADER = (
    r"^\[(?:line|lines|JSON item) [^\]\n]+ · (CRITICAL|ERROR|WARNING|INFO|UNKNOWN)"
    r"(?: · repeated (\d+) times)?\]\n"
)
PRIORITY = r"(?i)error|warn|fail|fatal|critical|exception|panic|denied|invalid"
PARSED_SECTION = "## Parsed\n\n```text\n"


def parsed_section(report: Column) -> Column:
    """The parsed block of a rendered review report: from its first heading to the next fence."""
    at = F.locate(PARSED_SECTION, report)
    after = F.substring(report, at + F.lit(len(PARSED_SECTION)), F.length(report))
    return F.when(at > 0, F.substring_index(after, "\n```", 1))


def read_report(rendered: Column) -> Column:
    """Rendered text back to ``array<struct<level, repeats, content>>``."""
    mark = "\u001e"
    parts = F.split(F.regexp_replace(rendered, "(?m)" + HEADER, f"{mark}$1{mark}$2{mark}"), mark)

    def events(cut: Column) -> Column:
        count = F.floor((F.size(cut) - 1) / 3).cast("int")
        indexes = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
            F.array().cast("array<int>")
        )

        def one(i: Column) -> Column:
            repeats = F.get(cut, i * 3 + 2).try_cast("bigint")
            return F.struct(
                F.get(cut, i * 3 + 1).alias("level"),
                F.coalesce(repeats, F.lit(1)).alias("repeats"),
                trim_space_end(F.get(cut, i * 3 + 3)).alias("content"),
            )

        return F.transform(indexes, one)

    return let(parts, events)


def report_events(rendered: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    staged = rendered.select(key, F.explode(read_report(F.col(text))).alias("e"))
    return staged.select(key, "e.level", "e.repeats", "e.content")


def both_sides(
    docs: DataFrame, raw: Column, rendered: Column, key: str = "doc_id"
) -> DataFrame:
    """Raw lines and re-read events of every document as ``(key, side, text, level, n)``; a document
    without either has one row of nulls.

    Both sides come out of one pass over the document's row.
    """
    lines = F.transform(
        F.filter(F.transform(text_lines(raw), trim_space_end), lambda x: x != ""),
        lambda x: F.struct(
            F.lit("raw").alias("side"), x.alias("text"), raw_line_level(x).alias("level"),
            F.lit(1).cast("bigint").alias("n"),
        ),
    )
    parsed = F.transform(
        read_report(rendered),
        lambda e: F.struct(
            F.lit("parsed").alias("side"), e["content"].alias("text"), e["level"].alias("level"),
            e["repeats"].alias("n"),
        ),
    )
    rows = docs.select(key, F.explode_outer(F.concat(lines, parsed)).alias("r"))
    return rows.select(key, "r.side", "r.text", "r.level", "r.n")


def _count(side: str) -> Column:
    return F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).alias(f"{side}_n")


def _missing() -> Column:
    return F.sum(F.greatest(F.col("raw_n") - F.col("parsed_n"), F.lit(0)))


def _extra() -> Column:
    return F.sum(F.greatest(F.col("parsed_n") - F.col("raw_n"), F.lit(0)))


def signature_differences(sides: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: signatures missing from, and extra in, the parsed side (as multisets).

    Summing both sides per signature is the full outer join of their counts in one shuffle.
    """
    both = sides.groupBy(key, audit_signature(F.col("text")).alias("signature")).agg(
        _count("raw"), _count("parsed")
    )
    return both.groupBy(key).agg(
        F.sum("raw_n").alias("raw_events"),
        F.sum("parsed_n").alias("parsed_events"),
        _missing().alias("missing_signatures"),
        _extra().alias("extra_signatures"),
    )


def severity_differences(sides: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document and level: events on both sides."""
    return sides.filter(F.col("level").isNotNull()).groupBy(key, "level").agg(_count("raw"), _count("parsed"))


def hashed(sides: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, side, n, level and two 64-bit hashes of the signature of every event: all that comparing needs."""
    signature = audit_signature(F.col("text"))
    return sides.select(key, "side", "n", "level", F.xxhash64(signature).alias("h0"), F.xxhash64(F.lit(1), signature).alias("h1"))


def multisets(hashes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document (of ``hashed`` rows): events of both sides, whether their signatures agree as multisets and
    whether their levels do.

    A multiset is compared by sums: each event adds the four halves of the hashes of its signature, so that
    equal multisets have equal sums and others differ in one of them (128 bits). Sums are partial
    aggregations: a row per document and task is shuffled, and no signature.
    """
    halves = [half for h in ("h0", "h1") for half in (F.col(h).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]

    def total(side: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, value)), F.lit(0))

    n = F.col("n")
    sums = [n, *(n * half for half in halves), *(F.when(F.col("level") == level, n).otherwise(0) for level in LABELS)]
    rows = hashes.groupBy(key).agg(*(total(side, v).alias(f"{side}_{k}") for side in ("raw", "parsed") for k, v in enumerate(sums)))

    def agree(places: range) -> Column:
        return fold(*(F.col(f"raw_{k}") == F.col(f"parsed_{k}") for k in places), op=lambda x, y: x & y)

    first = 1 + len(halves)
    return rows.select(
        key, F.col("raw_0").alias("raw_events"), F.col("parsed_0").alias("parsed_events"),
        agree(range(first)).alias("equal"), agree(range(first, len(sums))).alias("severity_ok"),
    )


def verdicts(sides: DataFrame, key: str = "doc_id") -> DataFrame:
    """OK when event count, signatures and severities agree, else REVIEW.

    The documents are prepared once; a few numbers of each event are written. Documents whose multisets agree are
    done, and only the events of the others are counted by signature.
    """
    events = written(hashed(sides, key), "signatures")
    compared = written(multisets(events, key), "multisets")
    other = events.join(compared.filter("not equal").select(key), key, "left_semi")
    both = other.groupBy(key, "h0", "h1").agg(_count("raw"), _count("parsed"))
    spelled = both.groupBy(key).agg(_missing().alias("missing_signatures"), _extra().alias("extra_signatures"))
    rows = compared.join(spelled, key, "left").select(
        key, "raw_events", "parsed_events", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("missing_signatures", "extra_signatures")),
        "severity_ok",
    )
    events_ok = F.col("raw_events") == F.col("parsed_events")
    signatures_ok = (F.col("missing_signatures") == 0) & (F.col("extra_signatures") == 0)
    return rows.select(
        key, "raw_events", "parsed_events", "missing_signatures", "extra_signatures",
        events_ok.alias("events_ok"), signatures_ok.alias("signatures_ok"), "severity_ok",
        F.when(events_ok & signatures_ok & F.col("severity_ok"), "OK").otherwise("REVIEW").alias(
            "status"
        ),
    )


def corpus_result(verdict: DataFrame) -> DataFrame:
    return verdict.agg(
        F.count_if(F.col("status") == "OK").alias("ok"),
        F.count_if(F.col("status") == "REVIEW").alias("review"),
    )


def priority_sample(
    lines: DataFrame, group: str, order: list[str], limit: int = 40, line: str = "line"
) -> DataFrame:
    """Up to ``limit`` lines per group: first half error-like lines, the rest others.

    Ranks at most ``limit`` are kept per task before the shuffle; the priority count needed to
    size the second part comes from the ranked rows themselves.
    """
    half = limit // 2
    flagged = lines.withColumn("priority", F.col(line).rlike(PRIORITY))
    within = Window.partitionBy(group, "priority").orderBy(*order)
    ranked = flagged.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= limit)
    found = F.sum(
        F.when(F.col("priority") & (F.col("rank") <= half), 1).otherwise(0)
    ).over(Window.partitionBy(group))
    chosen = ranked.withColumn("taken", found).filter(
        F.when(F.col("priority"), F.col("rank") <= half).otherwise(
            F.col("rank") <= limit - F.col("taken")
        )
    )
    return chosen.filter(~is_blank(F.col(line))).select(
        group, *order, "priority", "rank", mask_pii(F.col(line)).alias(line)
    )
