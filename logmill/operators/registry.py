"""The profile catalog as data: reading, checking, merging, overriding and looking up profiles.

A catalog becomes compiled columns, so the profiles that are taken come to the driver. All checks, and the
merging of any number of files, are table operations.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logmill.functions.text import regex
from logmill.operators.ordering import extreme_rows
from logmill.operators.parse import outcomes, parse
from logmill.plans.catalog import (
    BUILT_IN, FALLBACK, SCHEMA_VERSION, Profile, parse_profiles, profiles_json,
)
from logmill.session import run_folder

# Limits and word sets of the profile contract.
MAX_PROFILES = 100
MAX_ID = 80
MAX_REGEX_BYTES = 2_000
MAX_FIELDS = 64
DELIMITERS = ("whitespace", "tab", "comma", "pipe")

CONDITION = "struct<kind:string,value:string>"
PARSER = (
    "struct<kind:string,start_regex:string,severity:string,preamble_severity:string,"
    "include_preamble:boolean,severity_capture:string,default_severity:string,delimiter:string,"
    "fields:string,severity_rules:array<struct<field:string,values:array<string>,severity:string>>>"
)
FORMAT = (
    f"struct<id:string,record_kind:string,detect:struct<`all`:array<{CONDITION}>,"
    f"`any`:array<{CONDITION}>>,parser:{PARSER},application:string,catalog_rank:int>"
)
FILE = f"struct<schema_version:int,fallback:string,formats:array<{FORMAT}>>"


def read_formats(files: DataFrame) -> DataFrame:
    """Profile files ``(path, text)`` to one row per format, ``position`` from 0."""
    parsed = files.withColumn("file", F.from_json("text", FILE))
    rows = parsed.select(
        "path",
        F.col("file.schema_version").alias("schema_version"),
        F.col("file.fallback").alias("fallback"),
        F.size("file.formats").alias("format_count"),
        F.posexplode_outer("file.formats").alias("position", "format"),
    )
    return rows.select("*", F.col("format.id").alias("id"))


def bad_pattern(pattern: Column) -> Column:
    """Too long, or refused by the regex engine that detection and extraction run on."""
    rewritten = F.concat(F.lit(regex("")), F.replace(pattern, F.lit("(?P<"), F.lit("(?<")))
    compiled = F.try_reflect(
        F.lit("java.util.regex.Pattern"), F.lit("matches"), F.coalesce(rewritten, F.lit("")), F.lit("")
    )
    return (F.octet_length(pattern) > MAX_REGEX_BYTES) | (pattern.isNotNull() & compiled.isNull())


def violations(formats: DataFrame) -> DataFrame:
    """All rule violations of a format table as ``(path, id, problem)``."""
    fmt, parser = F.col("format"), F.col("format.parser")
    conditions = F.concat(
        F.coalesce(fmt["detect"]["all"], F.array().cast(f"array<{CONDITION}>")),
        F.coalesce(fmt["detect"]["any"], F.array().cast(f"array<{CONDITION}>")),
    )
    fields = F.from_json(parser["fields"], "array<string>")
    rules = F.coalesce(
        parser["severity_rules"],
        F.array().cast("array<struct<field:string,values:array<string>,severity:string>>"),
    )
    per_id = F.count(F.lit(1)).over(Window.partitionBy("path", "id"))
    delimited = parser["kind"] == "delimited_lines"
    blocks = parser["kind"].isin("text_blocks", "line_blocks")
    staged = formats.withColumn("same_id", per_id).withColumn(
        "patterns",
        F.concat(
            F.transform(
                F.filter(conditions, lambda c: c["kind"] == "regex"), lambda c: c["value"]
            ),
            F.when(blocks, F.array(parser["start_regex"])).otherwise(
                F.array().cast("array<string>")
            ),
        ),
    )
    bad_condition = F.exists(
        conditions,
        lambda c: ~(
            (c["kind"] == "regex")
            | ((c["kind"] == "path_exists") & F.startswith(c["value"], F.lit("$.")))
        ),
    )
    bad_rule = F.exists(
        rules,
        lambda r: ~F.array_contains(fields, r["field"])
        | (F.size(r["values"]) == 0)
        | (F.trim(r["severity"]) == ""),
    )

    def when(test: Column, text: str, with_id: bool = True) -> Column:
        message = F.concat(F.lit(text + ": "), F.col("id")) if with_id else F.lit(text)
        return F.when(F.coalesce(test, F.lit(False)), message)

    id_ok = F.col("id").rlike(rf"^[a-z0-9-]{{1,{MAX_ID}}}\z")
    problems = F.array_compact(
        F.array(
            when(
                F.col("format_count").isNull() | (F.col("schema_version") != SCHEMA_VERSION)
                | (F.col("fallback") != FALLBACK),
                "expected schema_version 3 and raw fallback", False,
            ),
            when((F.col("format_count") < 1) | (F.col("format_count") > MAX_PROFILES),
                 "formats must contain 1..100 items", False),
            when(~id_ok, "invalid format id"),
            when(F.col("same_id") > 1, "duplicate format id"),
            when(~fmt["record_kind"].isin("text", "json"), "invalid record kind"),
            when(F.size(conditions) == 0, "empty detector"),
            when(bad_condition, "invalid detector in"),
            when((parser["kind"] == "json_fields") & (fmt["record_kind"] != "json"),
                 "json parser on text format"),
            when(delimited & ~parser["delimiter"].isin(*DELIMITERS), "unsupported delimiter"),
            when(delimited & ~F.size(fields).between(1, MAX_FIELDS),
                 "delimited fields must contain 1..64 items"),
            when(delimited & bad_rule, "invalid severity rule"),
        )
    )
    named = staged.select("path", "id", F.explode(problems).alias("problem"))
    patterns = staged.select("path", "id", F.explode("patterns").alias("pattern"))
    regexes = patterns.filter(bad_pattern(F.col("pattern"))).select(
        "path", "id", F.concat(F.lit("invalid regex: "), F.left("pattern", F.lit(80))).alias("problem")
    )
    return named.unionByName(regexes)


def merge_single(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates ``(path, id)`` of one-format files, accepted in path order.

    A file is rejected when its id exists already or an earlier file brought it.
    """
    owner = candidates.groupBy("id").agg(F.min("path").alias("owner"))
    known = existing.select("id").distinct().withColumn("known", F.lit(True))
    joined = candidates.join(owner, "id").join(known, "id", "left")
    accepted = F.col("known").isNull() & (F.col("path") == F.col("owner"))
    return joined.select(
        "path", "id", accepted.alias("accepted"),
        F.when(~accepted, F.concat(F.lit("format id already exists: "), F.col("id"))).alias("reason"),
    )


def merge_files(existing: DataFrame, formats: DataFrame) -> DataFrame:
    """Files of any number of formats ``(path, position, id)`` in path order, each taken or rejected whole:
    ``(path, accepted, reason)``.

    A file is rejected when one of its ids exists or an earlier accepted file brought it. Per round, a
    file is accepted when it is the first undecided one for all its ids, then what clashes with accepted
    files is rejected; the first undecided file is always decided. Rounds are written to the shared folder.
    """
    spark = formats.sparkSession
    root = run_folder(spark, "merge")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    known = existing.select("id").distinct()
    files = kept(formats.select("path", "position", "id"), "files")
    clashing = files.join(known, "id", "left_semi").select("path").distinct()
    undecided = kept(files.join(clashing, "path", "left_anti").select("path", "id").distinct(), "undecided-0")
    accepted, n = undecided.limit(0), 0
    while not undecided.isEmpty():
        n += 1
        first = undecided.groupBy("id").agg(F.min("path").alias("first"))
        later = undecided.join(first, "id").filter(F.col("path") != F.col("first")).select("path").distinct()
        chosen = kept(undecided.join(later, "path", "left_anti"), f"accepted-{n}")
        left = undecided.join(chosen.select("path").distinct(), "path", "left_anti")
        lost = left.join(chosen.select("id"), "id", "left_semi").select("path").distinct()
        undecided = kept(left.join(lost, "path", "left_anti"), f"undecided-{n}")
        accepted = accepted.unionByName(chosen)
    owners = accepted.select("id", F.col("path").alias("owner")).unionByName(
        known.select("id", F.lit("").alias("owner"))
    )
    reasons = (
        files.join(accepted.select("path").distinct(), "path", "left_anti").join(owners, "id")
        .filter(F.col("owner") < F.col("path")).groupBy("path")
        .agg(F.min(F.struct("position", "id")).alias("clash"))
    )
    return files.select("path").distinct().join(reasons, "path", "left").select(
        "path", F.col("clash").isNull().alias("accepted"),
        F.concat(F.lit("format id already exists: "), F.col("clash.id")).alias("reason"),
    )


def apply_overrides(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace catalog rows ``(id, ordinal, application, body)`` by id, in place."""
    new = overrides.select(
        "id", F.col("application").alias("new_application"), F.col("body").alias("new_body")
    ).withColumn("replaced", F.lit(True))
    joined = catalog.join(new, "id", "left")
    hit = F.col("replaced").isNotNull()
    return joined.select(
        "id", "ordinal",
        F.when(hit, F.coalesce("new_application", "id")).otherwise(F.col("application")).alias("application"),
        F.when(hit, F.col("new_body")).otherwise(F.col("body")).alias("body"),
        F.when(hit, F.lit("override")).otherwise(F.col("origin")).alias("origin"),
    )


def unknown_overrides(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    return overrides.join(catalog, "id", "left_anti").select(
        "id", F.concat(F.lit("override: unknown profile: "), F.col("id")).alias("reason")
    )


def active(catalog: DataFrame, disabled: DataFrame) -> DataFrame:
    return catalog.join(disabled.select("id"), "id", "left_anti")


def profile_summary(catalog: DataFrame, disabled: DataFrame) -> DataFrame:
    """Every profile with origin and whether it is active, by id."""
    off = disabled.select("id").distinct().withColumn("off", F.lit(True))
    return catalog.join(off, "id", "left").select(
        "id", F.coalesce("application", "id").alias("application"), "origin",
        F.col("off").isNull().alias("active"),
    ).orderBy("id")


def status(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_if(F.col("origin") == "built-in").alias("built_in"),
        F.count_if(F.col("origin") == "user").alias("user"),
        F.count_if(F.col("origin") == "override").alias("overrides"),
        F.count_if("active").alias("active"),
    )


def lookup(sources: dict[str, DataFrame]) -> DataFrame:
    """First stored body of every id over sources in order of precedence."""
    parts = [
        df.select("id", "body", F.lit(i).alias("priority"), F.lit(name).alias("found_in"))
        for i, (name, df) in enumerate(sources.items())
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return extreme_rows(union, ["id"], "priority").select("id", "body", "found_in")


def install(stored: DataFrame, drafts: DataFrame) -> DataFrame:
    """Drafts ``(id, body)`` whose id is not stored yet; the others are refused with a reason."""
    known = stored.select("id").distinct().withColumn("known", F.lit(True))
    joined = drafts.join(known, "id", "left")
    return joined.select(
        "id", "body", F.col("known").isNull().alias("installed"),
        F.when(F.col("known").isNotNull(), F.concat(F.lit("schema already exists: "), F.col("id"))).alias("reason"),
    )


def upsert(stored: DataFrame, newer: DataFrame) -> DataFrame:
    """Overwrite by id: the highest ``version`` of every id."""
    union = stored.select("id", "body", "version").unionByName(newer.select("id", "body", "version"))
    return extreme_rows(union, ["id"], "version", newest=True)


def restore_defaults(states: DataFrame, base: DataFrame) -> DataFrame:
    """State ``(id, origin, body, disabled)`` with nothing disabled and no overrides: an overridden profile
    gets its version in ``base`` (id, origin, body) again."""
    columns = ["id", "origin", "body"]
    overridden = F.col("origin") == "override"
    back = base.select(*columns).join(states.filter(overridden).select("id"), "id", "left_semi")
    return states.filter(~overridden).select(*columns).unionByName(back).withColumn("disabled", F.lit(False))


def update_gate(target: Column, supported: Column, format_ids: Column) -> Column:
    """``struct<decision, reason>`` of a log offered as the sample of a profile update."""
    hit = F.array_contains(format_ids, target)
    decision = (
        F.when(~supported, "confirm").when(hit, "accept").otherwise("reject")
    )
    reason = F.when(
        supported & ~hit,
        F.concat(F.lit("wrong update log: selected "), target, F.lit(", detected "),
                 F.concat_ws(" + ", format_ids)),
    )
    return F.struct(decision.alias("decision"), reason.alias("reason"))


def uncovered(docs: DataFrame, key: str = "doc_id", profiles: Iterable[Profile] = BUILT_IN) -> DataFrame:
    """Documents no profile covers: the corpus that needs new profiles."""
    return outcomes(docs, key, profiles).filter(~F.col("supported")).select(key, "detected_format")


def problems(profiles: list[Profile]) -> list[str]:
    """Violations of a small draft, via the same table rules."""
    spark = SparkSession.getActiveSession()
    files = spark.createDataFrame([("draft", profiles_json(profiles))], "path string, text string")
    rows = violations(read_formats(files)).collect()  # as many as the given draft has
    return sorted(r["problem"] for r in rows)


def validate_draft(
    draft: list[Profile], samples: DataFrame, key: str = "doc_id", target: str | None = None
) -> DataFrame:
    """Outcome of every sample under the draft alone: ids, events and a verdict.

    A new draft must not reuse a built-in id; an update (``target``) has exactly one format, which
    takes the target's id.
    """
    error = None
    if target is not None:
        if len(draft) != 1:
            error = "an update must contain exactly one format"
        else:
            draft = [draft[0].with_id(target)]
    else:
        taken = {p.id for p in BUILT_IN}
        clash = next((p.id for p in draft if p.id in taken), None)
        error = f"built-in format id already exists: {clash}" if clash else None
    found = [] if error else problems(draft)
    error = error or (found[0] if found else None)
    if error:
        return samples.select(
            key, F.array().cast("array<string>").alias("format_ids"), F.lit(0).alias("event_count"),
            F.lit(error).alias("error"),
        )
    text = "schema does not parse the supplied sample"
    if target is not None:
        text = "updated " + text
    parsed = parse(samples, draft)
    good = F.col("supported") & (F.size("events") > 0)
    return parsed.select(
        key, "format_ids", F.size("events").alias("event_count"),
        F.when(~good, F.lit(text)).alias("error"),
    )


class Registry:
    """Active profiles after user files, overrides and disabled ids, with a status report."""

    def __init__(self, profiles: list[Profile], rejections: DataFrame | None, origins: dict[str, str],
                 disabled: set[str]):
        self.all = profiles
        #: place, path and message of every rejected file
        self.rejections = rejections
        self.origins = origins
        self.disabled = disabled

    @property
    def profiles(self) -> list[Profile]:
        return [p for p in self.all if p.id not in self.disabled]

    @property
    def rejected(self) -> list[str]:
        if self.rejections is None:
            return []
        return [r["message"] for r in self.rejections.orderBy("place", "path").select("message").collect()]

    def summary(self) -> list[tuple[str, str, str, bool]]:
        return sorted(
            (p.id, p.label, self.origins[p.id], p.id not in self.disabled) for p in self.all
        )


def _rejection(place: int, prefix: str = "") -> list[Column]:
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return [F.lit(place).alias("place"), "path", F.concat(F.lit(prefix), name, F.lit(": "), F.col("reason")).alias("message")]


def _checked(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Format rows of the valid files, and path and reason of the others."""
    formats = read_formats(files)
    bad = violations(formats).groupBy("path").agg(F.min("problem").alias("reason"))
    return formats.join(bad, "path", "left_anti"), bad


def _profiles_of(files: DataFrame, paths: DataFrame) -> list[list[Profile]]:
    """The profiles of the files that were taken, by path: a catalog becomes columns, so these come to the driver."""
    rows = files.join(paths.select("path"), "path", "left_semi").select("path", "text").collect()
    return [parse_profiles(row["text"]) for row in sorted(rows, key=lambda r: r["path"])]


def load_registry(
    user_files: DataFrame | None = None,
    override_files: DataFrame | None = None,
    disabled: Iterable[str] = (),
    base: Iterable[Profile] = BUILT_IN,
) -> Registry:
    """Merge profile files ``(path, text)`` over the base catalog, in path order.

    A user file is taken whole or rejected whole; an override file holds one known profile, and the last of a
    profile counts. Checks and merging are table operations over all files; only taken ones are collected.
    """
    spark = SparkSession.active()
    merged = list(base)
    origins = {p.id: "built-in" for p in merged}
    rejections = []
    if user_files is not None:
        valid, bad = _checked(user_files)
        known = spark.createDataFrame([(i,) for i in origins], "id string")
        taken = merge_files(known, valid.select("path", "position", "id"))
        for draft in _profiles_of(user_files, taken.filter("accepted")):
            merged += draft
            origins.update({p.id: "user" for p in draft})
        rejections += [bad.select(*_rejection(0)), taken.filter("not accepted").select(*_rejection(1))]
    if override_files is not None:
        valid, bad = _checked(override_files)
        known = spark.createDataFrame([(i,) for i in origins], "id string")
        one = valid.filter("format_count = 1")
        several = valid.filter("format_count <> 1").select("path").distinct()
        newest = one.join(known, "id").groupBy("id").agg(F.max("path").alias("path"))
        for draft in _profiles_of(override_files, newest):
            merged = [draft[0] if p.id == draft[0].id else p for p in merged]
            origins[draft[0].id] = "override"
        rejections += [
            bad.select(*_rejection(2)),
            several.withColumn("reason", F.lit("override must contain exactly one format")).select(*_rejection(3, "override: ")),
            one.join(known, "id", "left_anti").withColumn("reason", F.concat(F.lit("unknown profile: "), "id")).select(*_rejection(3, "override: ")),
        ]
    found = None
    for part in rejections:
        found = part if found is None else found.unionByName(part)
    return Registry(merged, found, origins, set(disabled))
