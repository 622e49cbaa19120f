"""Compile profile parsers to columns: document text (or JSON records) to an event array.

Everything happens inside the document's row, so splitting a corpus into events moves no data
between executors.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from logmill.functions.fingerprint import fingerprint
from logmill.functions.records import first_value, path_or_null_word
from logmill.functions.severity import (
    http_status, json_severity, rule_severity, starts_with_level, text_severity,
)
from logmill.functions.text import (
    WS, collapse_space, fold, is_blank, let, non_empty, regex, text_lines, trim_space, words,
)
from logmill.plans.catalog import Profile

TEXT_EVENT = "struct<first:int,last:int,level:string,content:string>"
EVENT = "struct<source:string,severity:string,content:string,fingerprint:string>"

# Words that keep a build line, lines kept around it, and the omission note.
BUILD_MARKER = (
    "(?i)error|failed|failure|exit code|no such file|not found|denied|timeout|canceled"
)
CONTEXT_LINES = 2
OMITTED = "… omitted successful BuildKit steps …"
NO_TIMESTAMP = "no timestamp"


def _no_events() -> Column:
    return F.array().cast(f"array<{TEXT_EVENT}>")


def _indexes(size: Column) -> Column:
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def _event(first: Column, last: Column, level: Column, content: Column) -> Column:
    return F.struct(
        first.cast("int").alias("first"),
        last.cast("int").alias("last"),
        level.alias("level"),
        content.alias("content"),
    )


def capture_index(pattern: str, name: str) -> int | None:
    return re.compile(pattern).groupindex.get(name) if name else None


def start_level(line: Column, parser: dict) -> Column:
    """Level word of a line that opens a block (the default level if it names none), else NULL."""
    pattern = regex(parser["start_regex"])
    if parser["kind"] == "text_blocks":
        return F.when(line.rlike(pattern), F.lit(parser["severity"]))
    default = F.lit(parser["default_severity"])
    group = capture_index(parser["start_regex"], parser.get("severity_capture", ""))
    opens = F.when(line.rlike(pattern), default)
    if group is None:
        return opens
    return F.coalesce(non_empty(F.regexp_extract(line, pattern, group)), opens)


def _line_levels(lines: Column, parser: dict) -> Column:
    return F.transform(lines, lambda x: start_level(x, parser))


def _block_levels(lines: Column, fmt: Column, profiles: list[Profile]) -> Column:
    groups: dict[tuple, list[str]] = defaultdict(list)
    parsers = {}
    for p in profiles:
        key = tuple(sorted((k, v) for k, v in p.parser.items() if "preamble" not in k))
        groups[key].append(p.id)
        parsers[key] = p.parser
    out = None
    for key, ids in groups.items():
        levels = _line_levels(lines, parsers[key])
        out = F.when(fmt.isin(*ids), levels) if out is None else out.when(fmt.isin(*ids), levels)
    return out


def blocks(lines: Column, levels: Column, preamble: Column) -> Column:
    """Blocks from each start line to the next; lines before the first start only if a preamble
    level is given."""

    def cut(ls: Column, lv: Column, starts: Column) -> Column:
        size = F.size(ls)

        def block(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), size)
            text = F.array_join(F.slice(ls, start + 1, end - start), "\n")
            return _event(start, end, F.get(lv, start), text)

        head = F.get(starts, F.lit(0))
        before = F.when(
            preamble.isNotNull() & (head > 0),
            F.array(_event(F.lit(0), head, preamble, F.array_join(F.slice(ls, 1, head), "\n"))),
        ).otherwise(_no_events())
        return F.concat(before, F.transform(starts, block))

    def with_starts(ls: Column, lv: Column) -> Column:
        starts = F.filter(_indexes(F.size(lv)), lambda i: F.get(lv, i).isNotNull())
        return let(starts, lambda s: F.when(F.size(s) > 0, cut(ls, lv, s)).otherwise(_no_events()))

    return let(lines, lambda ls: let(levels, lambda lv: with_starts(ls, lv)))


def context_filter(lines: Column) -> Column:
    """One ERROR event of the lines near an error word, skipped runs replaced by a note."""

    def near(hits: Column, i: Column) -> Column:
        around = [F.get(hits, i + d) for d in range(-CONTEXT_LINES, CONTEXT_LINES + 1)]
        return F.coalesce(fold(*[F.coalesce(h, F.lit(False)) for h in around], op=lambda a, b: a | b))

    def joined(ls: Column, keep: Column) -> Column:
        kept = F.filter(_indexes(F.size(ls)), lambda i: F.get(keep, i))
        noted = F.transform(
            kept,
            lambda i: F.concat(
                F.when((i > 0) & ~F.get(keep, i - 1), F.lit(OMITTED + "\n")).otherwise(""),
                F.get(ls, i),
            ),
        )
        return let(
            F.array_join(noted, "\n"),
            lambda text: F.when(
                text != "", F.array(_event(F.lit(0), F.size(ls), F.lit("ERROR"), text))
            ).otherwise(_no_events()),
        )

    def marked(ls: Column) -> Column:
        hits = F.transform(ls, lambda x: x.rlike(BUILD_MARKER))
        return let(
            hits,
            lambda h: let(
                F.transform(_indexes(F.size(h)), lambda i: near(h, i)), lambda k: joined(ls, k)
            ),
        )

    return let(lines, marked)


def _split_fields(line: Column, delimiter: str) -> Column:
    if delimiter == "whitespace":
        return words(line)
    return F.split(line, {"tab": "\t", "comma": ",", "pipe": r"\|"}[delimiter])


def delimited_events(lines: Column, parser: dict) -> Column:
    """One event per line with enough fields, content ``field=value ...``."""
    fields = parser["fields"]
    rules = parser.get("severity_rules", [])
    first_of = {name: fields.index(name) for name in fields}

    def row(values: Column, i: Column) -> Column:
        by_name = {name: F.get(values, F.lit(k)) for name, k in first_of.items()}
        level = rule_severity(by_name, rules, parser["default_severity"])
        pairs = [F.concat(F.lit(f"{f}="), F.get(values, F.lit(k))) for k, f in enumerate(fields)]
        return _event(i, i + 1, level, F.concat_ws(" ", *pairs))

    def rows(ls: Column) -> Column:
        cut = F.transform(
            ls,
            lambda x, i: let(
                _split_fields(x, parser["delimiter"]),
                lambda v: F.when(F.size(v) >= len(fields), row(v, i)),
            ),
        )
        return F.array_compact(cut)

    return let(lines, rows)


def source_label(first: Column, last: Column) -> Column:
    return F.when(first + 1 == last, F.concat(F.lit("line "), last)).otherwise(
        F.concat(F.lit("lines "), first + 1, F.lit("-"), last)
    )


def _finish(event: Column) -> Column:
    return F.struct(
        source_label(event["first"], event["last"]).alias("source"),
        text_severity(event["level"], event["content"]).alias("severity"),
        event["content"].alias("content"),
        fingerprint(event["content"]).alias("fingerprint"),
    )


def text_events(profiles: Iterable[Profile], fmt: Column, text: Column) -> Column:
    """Events of a trimmed text document of the detected format (empty array if none)."""
    by_kind: dict[str, list[Profile]] = defaultdict(list)
    for p in profiles:
        if p.record_kind == "text":
            by_kind[p.kind].append(p)

    def cut(lines: Column) -> Column:
        branches = []
        whole = by_kind["whole_text"]
        if whole:
            level = None
            for severity in dict.fromkeys(p.parser["severity"] for p in whole):
                ids = [p.id for p in whole if p.parser["severity"] == severity]
                test = fmt.isin(*ids)
                level = F.when(test, severity) if level is None else level.when(test, severity)
            event = _event(F.lit(0), F.size(lines), level, text)
            branches.append((fmt.isin(*[p.id for p in whole]), F.array(event)))
        cuts = by_kind["line_blocks"] + by_kind["text_blocks"]
        if cuts:
            preamble = F.lit(None).cast("string")
            for p in by_kind["text_blocks"]:
                if p.parser["include_preamble"]:
                    preamble = F.when(fmt == p.id, p.parser["preamble_severity"]).otherwise(preamble)
            events = blocks(lines, _block_levels(lines, fmt, cuts), preamble)
            branches.append((fmt.isin(*[p.id for p in cuts]), events))
        for p in by_kind["buildkit"]:
            branches.append((fmt == p.id, context_filter(lines)))
        for p in by_kind["delimited_lines"]:
            branches.append((fmt == p.id, delimited_events(lines, p.parser)))
        out = None
        for test, events in branches:
            out = F.when(test, events) if out is None else out.when(test, events)
        return _no_events() if out is None else out.otherwise(_no_events())

    return F.transform(let(text_lines(text), cut), _finish)


class FieldReader:
    """Path lookups in one record's field map; equal lookups share one column."""

    def __init__(self, fields: Column):
        self.fields = fields
        self.found: dict[tuple, Column] = {}

    def first(self, paths: list[str]) -> Column:
        key = ("first", *paths)
        if key not in self.found:
            self.found[key] = first_value(self.fields, paths)
        return self.found[key]

    def key_part(self, path: str) -> Column:
        key = ("key", path)
        if key not in self.found:
            self.found[key] = path_or_null_word(self.fields, path)
        return self.found[key]


def json_parts(profile: Profile, read: FieldReader) -> Column:
    """What a json_fields profile takes from a record, before severity and rendering."""
    spec = profile.parser
    labelled = [
        F.concat(F.lit(f["label"] + "="), read.first(f["paths"])) if f["label"] else read.first(f["paths"])
        for f in spec["fields"]
    ]
    keys = [read.key_part(path) for path in spec["fingerprint_paths"]]
    return F.struct(
        F.coalesce(read.first(spec["timestamp_paths"]), F.lit(NO_TIMESTAMP)).alias("stamp"),
        F.coalesce(read.first(spec["severity_paths"]), F.lit(spec["default_severity"])).alias("level"),
        read.first(spec["status_paths"]).alias("status"),
        F.lit(spec["nonzero_status_is_error"]).alias("nonzero"),
        F.lit(spec["status_from_text"]).alias("from_text"),
        F.concat_ws(" ", *labelled).alias("message"),
        F.concat_ws("|", *keys).alias("keys"),
        F.lit(spec["normalize_fingerprint_digits"]).alias("digits"),
        F.lit(spec["source_suffix"]).alias("suffix"),
    )


def json_event(parts: Column, item: Column) -> Column:
    """The event of the parts taken from record number ``item``."""
    message = parts["message"]
    numeric = F.when(
        parts["status"].rlike(r"^\+?[0-9]{1,18}$"), parts["status"].try_cast("bigint")
    )
    status = F.coalesce(numeric, F.when(parts["from_text"], http_status(message)))
    severity = let(status, lambda s: json_severity(parts["level"], s, parts["nonzero"], message))
    key = F.coalesce(non_empty(parts["keys"]), message)

    def event(sev: Column) -> Column:
        level = F.when(starts_with_level(message), "").otherwise(sev)
        return F.struct(
            F.concat(F.lit("JSON item "), item, parts["suffix"]).alias("source"),
            sev.alias("severity"),
            collapse_space(F.concat_ws(" ", parts["stamp"], level, message)).alias("content"),
            let(key, lambda k: F.when(parts["digits"], fingerprint(k)).otherwise(k)).alias(
                "fingerprint"
            ),
        )

    return let(severity, event)


def record_event(profiles: Iterable[Profile], fmt: Column, record: Column, number: Column) -> Column:
    """The event of one JSON record (value and fields) of format ``fmt``, NULL if no profile reads it."""
    usable = [p for p in profiles if p.record_kind == "json" and p.kind == "json_fields"]
    if not usable:
        return F.lit(None).cast(EVENT)
    read = FieldReader(record["fields"])

    def parts(name: Column) -> Column:
        out = None
        for p in usable:
            taken = json_parts(p, read)
            out = F.when(name == p.id, taken) if out is None else out.when(name == p.id, taken)
        return out

    taken = let(fmt, parts)
    return let(taken, lambda t: F.when(t.isNotNull(), json_event(t, number.cast("string"))))


def json_events(profiles: Iterable[Profile], formats: Column, records: Column) -> Column:
    """Events of JSON records, given the format id of every record."""
    profiles = list(profiles)
    return F.transform(records, lambda r, i: record_event(profiles, F.get(formats, i), r, i + 1))


def has_content(event: Column) -> Column:
    return ~is_blank(event["content"])


__all__ = [
    "EVENT", "WS", "blocks", "context_filter", "delimited_events", "has_content", "json_events",
    "source_label", "start_level", "text_events", "trim_space",
]
