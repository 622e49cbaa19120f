"""URL filters by association rules, in DataFrame and Spark ML operations only.

A URL becomes a set of tokens: scheme, host labels, path segments (digits as #) and query names. FP-growth
over the labelled URLs mines token combinations that imply "bad"; rules below the support or confidence
go, and so does a rule that contains another at least as sure. A rule stands in an inverted index under
its rarest token, so a URL only meets rules that it shares this token with. URLs with equal token sets
are judged once. Before mining, tokens that can be part of no lasting rule are pruned and tokens that always
occur together are folded into one, so a URL of any length is mined in time (``mined``).

Fixed rules (allow or block a host with its subdomains under a path) come first; the longest that fits
decides, else the mined rules: block if one matches, allow if none does.

Edge cases: a null URL or one without "://" has empty host and path, fits no rule, has no tokens and is
allowed; null and repeated page ids are rows like any other; without labelled bad URLs no rule is mined;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from logmill.llm.common import columns_of, stored

#: Least share of the labelled rows, least number of them, and least confidence of a rule.
MIN_SUPPORT, LEAST, MIN_CONFIDENCE = 0.002, 5, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)"
BAD = "bad"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parted(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    url = F.coalesce("url", F.lit(""))
    return columns_of(pages, page_id="bigint", url="string").select(
        "page_id", "url", F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, PARTS, 2).alias("path"),
    )


def tokens() -> Column:
    """The sorted distinct tokens of a row with url, host and path."""
    url = F.coalesce("url", F.lit(""))
    lower = F.translate("path", UPPER, LOWER)

    def named(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    return F.array_sort(F.array_distinct(F.concat(
        named("s:", F.array(F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        named("h:", F.split("host", r"[.:]")),
        named("p:", F.split(F.regexp_replace(lower, r"\d+", "#"), "/")),
        named("q:", F.transform(F.split(F.regexp_extract(url, PARTS, 3), "&"), lambda x: F.substring_index(x, "=", 1))),
    )))


def ruled(parts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add rule (null if none fits) and ruling, of the longest rule that fits."""
    name, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        name, ruling = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(ruling)
    return parts.withColumn("rule", name).withColumn("ruling", ruling)


def _folded(rows: DataFrame, floor: int) -> DataFrame:
    """token, named, freq and hits (rows that are bad) of the tokens that occur in ``floor`` bad rows or more.

    Tokens of exactly the same rows are folded: all but the smallest are only other names of it. Row sets are
    compared by their size and 128 bits: sums of the halves of two hashes of the rows."""
    hashes = [F.xxhash64("row_"), F.xxhash64(F.lit(1), "row_")]
    halves = [half for h in hashes for half in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    each = rows.select(F.explode("tokens").alias("token"), "bad", *(h.alias(f"s{k}") for k, h in enumerate(halves)))
    sums = [f"s{k}" for k in range(len(halves))]
    counted = each.groupBy("token").agg(
        F.count("*").alias("freq"), F.count_if("bad").alias("hits"), *(F.sum(c).alias(c) for c in sums)
    ).filter(F.col("hits") >= floor)
    named = counted.groupBy("freq", *sums).agg(F.min("token").alias("named"))
    return counted.join(named, ["freq", *sums]).select("token", "named", "freq", "hits")


def mined(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, least: int = LEAST,
) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_tokens, rarest, confidence, support) that imply bad, of rows with tokens and bad (boolean), and
    the tokens that stand for each other: token, named (the one in the rules).

    A rule holds in ``least`` bad rows at least, however few rows there are. FP-growth only sees what can be part of
    a rule that stays: tokens that occur so often with bad, one of those that always occur together, and none
    that only occurs with bad (it is a rule of its own, and a longer rule with it would go). So the number of
    tokens of a URL does not multiply its token sets."""
    rows = stored(labelled.select("tokens", "bad").withColumn("row_", F.monotonically_increasing_id()), "url-rows")
    count = rows.count()
    floor = max(least, math.ceil(min_support * count))
    tokens_ = stored(_folded(rows, floor), "url-tokens")
    names = tokens_.select("token", "named")
    singles = tokens_.filter("token = named").select("token", "freq", "hits")
    sure = singles.filter("hits = freq").select(
        F.array("token").alias("rule_tokens"), F.lit(1.0).alias("confidence"), (F.col("hits") / F.lit(max(count, 1))).alias("support"),
    )
    kept = singles.filter("hits < freq").select("token")
    items = stored(
        rows.select("row_", "bad", F.explode("tokens").alias("token")).join(kept, "token").groupBy("row_", "bad")
        .agg(F.collect_list("token").alias("items"))
        .select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "url-items",
    )
    given = items.count()
    rules = sure
    if given:
        model = FPGrowth(minSupport=min((floor - 0.5) / given, 1.0), minConfidence=min_confidence).fit(items)
        rules = rules.union(
            model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
            .select(F.array_sort("antecedent"), "confidence", F.col("support") * given / max(count, 1))
        )
    rules = stored(rules, "url-rules")
    keyed = stored(
        rules.select("*", F.explode("rule_tokens").alias("token")).join(singles, "token")
        .groupBy("rule_tokens", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest")),
        "url-rules",
    )
    wider = keyed.select(
        F.col("rarest").alias("token"), F.col("rule_tokens").alias("less"), F.col("confidence").alias("surer")
    )
    implied = (
        keyed.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("token")).join(wider, "token")
        .filter((F.size("less") < F.size("rule_tokens")) & (F.col("surer") >= F.col("confidence"))
                & (F.size(F.array_except("less", "rule_tokens")) == 0))
        .select("rule_tokens").distinct()
    )
    return keyed.join(implied, "rule_tokens", "left_anti"), names


def matched(sets: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """For each distinct token set of ``sets`` (tokens) that a rule matches: its confidence."""
    named = (
        sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(names, "token")
        .groupBy("tokens").agg(F.collect_set("named").alias("held"))
    )
    return (
        named.select("tokens", "held", F.explode("held").alias("rarest"))
        .join(rules.select("rarest", "rule_tokens", "confidence"), "rarest")
        .filter(F.size(F.array_except("rule_tokens", "held")) == 0)
        .groupBy("tokens").agg(F.max("confidence").alias("confidence"))
    )


def judged(pages: DataFrame, labels: DataFrame, rules: list[Rule], **limits: float) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence (of the mined rule; null if none matched).

    Labelled are pages that a fixed rule decides, and others whose id has a row in ``labels`` (bad: of low
    quality or toxic)."""
    parts = ruled(parted(pages), rules).withColumn("tokens", tokens())
    known = columns_of(labels, doc_id="bigint", quality="int", toxic="int").groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("labelled")
    )
    labelled = (
        parts.filter(F.size("tokens") > 0).join(known.withColumnRenamed("doc_id", "page_id"), "page_id", "left")
        .select("tokens", F.when(F.col("ruling").isNotNull(), F.col("ruling") == "block").otherwise(F.col("labelled")).alias("bad"))
        .filter("bad is not null")
    )
    found = matched(parts, *mined(labelled, **limits))
    return parts.join(found, "tokens", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruling", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"),
    )
