"""Compile profile detectors to one CASE expression.

Profiles are tried from the highest score down (later catalog rows first on equal scores), so the
first match is the best format and evaluation stops there. A built-in regex is preceded by a plain
substring test on texts that it requires (``required``), which is far cheaper than the regex itself. Where the
first characters of the text's lines are known (``openers``), a regex tied to line starts is tested on them before that.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from logmill.functions.records import path_exists
from logmill.functions.text import fold, regex
from logmill.plans.catalog import Profile
from logmill.plans.required import REQUIRED, STARTS


def openers(lines: Column) -> Column:
    """The different first characters of an array of lines, in one text; an empty line gives its end."""
    return F.array_join(F.array_distinct(F.transform(lines, lambda x: F.when(x == "", "\n").otherwise(F.left(x, F.lit(1))))), "")


def regex_condition(text: Column, pattern: str, first: Column | None = None) -> Column:
    tests = [text.rlike(regex(pattern))]
    required = REQUIRED.get(pattern, ())
    if required:
        tests.insert(0, fold(*[F.contains(text, F.lit(t)) for t in required], op=lambda a, b: a | b))
    if first is not None and pattern in STARTS:
        tests.insert(0, first.rlike(STARTS[pattern]))
    return fold(*tests, op=lambda a, b: a & b)


def condition(kind: str, value: str, text: Column, record: Column | None, first: Column | None = None) -> Column:
    if kind == "path_exists":
        return path_exists(record["fields"], value) if record is not None else F.lit(False)
    if kind == "regex":
        return regex_condition(text, value, first)
    return F.lit(False)


def detector(profile: Profile, text: Column, record: Column | None = None, first: Column | None = None) -> Column:
    tests = [condition(k, v, text, record, first) for k, v in profile.all]
    if profile.any:
        options = [condition(k, v, text, record, first) for k, v in profile.any]
        tests.append(fold(*options, op=lambda a, b: a | b))
    return fold(*tests, op=lambda a, b: a & b)


def by_preference(profiles: Iterable[Profile], record_kind: str) -> list[Profile]:
    ranked = [(p.score, i, p) for i, p in enumerate(profiles) if p.record_kind == record_kind]
    return [p for _, _, p in sorted(ranked, key=lambda r: (-r[0], -r[1]))]


def best_format(
    profiles: Iterable[Profile], record_kind: str, text: Column, record: Column | None = None, first: Column | None = None
) -> Column:
    """Id of the best matching profile, NULL when none matches. ``first``: the ``openers`` of the text's lines."""
    out = None
    for profile in by_preference(profiles, record_kind):
        test = detector(profile, text, record, first)
        out = F.when(test, profile.id) if out is None else out.when(test, profile.id)
    return F.lit(None).cast("string") if out is None else out


def matching_formats(
    profiles: Iterable[Profile], record_kind: str, text: Column, record: Column | None = None
) -> Column:
    """All matching profile ids with their scores, best first (for ambiguity reports)."""
    ranked = by_preference(profiles, record_kind)
    rows = [
        F.when(detector(p, text, record), F.struct(F.lit(p.id).alias("id"), F.lit(p.score).alias("score")))
        for p in ranked
    ]
    return F.array_compact(F.array(*rows))
