"""Preparation of line tables: ``prepare`` for documents of any size.

A document is the rows ``(key, line_no from 1, line, chars)`` of a table, in any order and number; ``chars`` is
the line's length with its line end (``raw_lines`` and ``sources.lines`` make such tables). Every step is a
join, an aggregation or a window over ranges of lines, so a document spreads over many tasks:

- bounds of the trimmed text and its size: sums and extremes per range, then per document;
- detection: a document of up to ``STEP`` lines is judged as a text, by the best profile first. Of longer ones, windows of
  ``STEP`` lines that overlap by ``OVERLAP`` are matched against all conditions of the catalog, and the bits are OR-ed. A condition is found if its match spans at most ``OVERLAP``
  lines, or as many as lie in a window; conditions tied to the text's ends count in the first or last window;
- JSON lines: each line is parsed alone and once; one bad record spoils the document, which is a minimum over the
  numbers of bad records. A JSON array of any size is cut into its records at the commas outside strings and inner
  brackets (no JSON string goes over a line end, so the depth at a line is a running sum), and each record is parsed alone
  like a line; it is one exactly if all of them parse. A JSON object is one record;
- blocks and fields: by ``operators.lines``; deduplication: one aggregation by fingerprint;
- variant: by sums of lengths, no text is built for it; batches: ``operators.line_batches``.

The results equal those of ``operators.prepare`` (all texts redacted).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from logmill.functions.batching import MIN_BUDGET
from logmill.functions.fingerprint import fingerprint
from logmill.functions.records import JSON_START, strict_json, with_fields
from logmill.functions.severity import CONTENT_RULES, _lookup, TEXT_LEVELS, is_important, text_severity
from logmill.functions.text import WHITE_SPACE, is_blank, let, normalize_line, redact, token_estimate
from logmill.operators.line_batches import SPAN, batch_numbers, batch_texts
from logmill.operators.lines import context_lines, join_context, numbered_blocks
from logmill.operators.ordering import RANGE, running_sum
from logmill.operators.parse import format_label
from logmill.operators.prepare import render_event
from logmill.plans.catalog import BUILT_IN, Profile
from logmill.plans.detect import best_format, by_preference, openers, regex_condition
from logmill.plans.extract import delimited_events, has_content, record_event, source_label, start_level
from logmill.session import written

#: Lines of a detection window and how many of them it shares with the next.
STEP, OVERLAP = 128, 32
#: Bits of one number of the condition vector.
WORD = 60
#: A JSON string, and a piece of a line: up to a bracket or comma outside strings, or the rest. A quote that opens no string is a piece.
STRING = r'"(?:[^"\\]++|\\.)*+"'
_INNER = rf'(?:{STRING}|[^"\[\]{{}},]++)'
JSON_PIECE = rf'{_INNER}*+[\[\]{{}},]|{_INNER}++|"'
#: Places of the parts of a line: the line number times this, and the part's number.
PARTS = 1 << 31
#: A line with its end. What a line has read is never given back: a text of one long line is passed once.
PIECE = r"[^\r\n]*+(?:\r\n|\r|\n)|[^\r\n]++"


def raw_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The line table of a text column: lines end at CRLF, CR or LF; an empty text is one line of no characters."""
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0))
    rows = docs.select(key, F.posexplode_outer(pieces).alias("at", "piece"))
    piece = F.coalesce("piece", F.lit(""))
    return rows.select(
        key, (F.coalesce("at", F.lit(0)) + 1).cast("bigint").alias("line_no"),
        F.rtrim(piece, F.lit("\r\n")).alias("line"), F.length(piece).cast("bigint").alias("chars"),
    )


@dataclass(frozen=True)
class Table:
    """A cleaned line table and what is known of its documents."""

    key: str
    #: key, range_, line_no, line (clean)
    lines: DataFrame
    #: key, range_ and the document's facts: original, clean_chars, first, last, opening, closing (code points)
    ranges: DataFrame

    #: key, range_, at (line number from 0), line and count (of lines) of the trimmed documents
    body: DataFrame

    def facts(self) -> DataFrame:
        return self.ranges.drop("range_").distinct()


def _body(rows: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    rows = rows.join(ranges.select(key, "range_", "first", "last"), [key, "range_"])
    at = F.col("line_no") - F.col("first")
    line = F.when(at == 0, F.ltrim("line", F.lit(WHITE_SPACE))).otherwise(F.col("line"))
    return rows.filter("line_no between first and last").select(
        key, "range_", at.alias("at"), line.alias("line"), (F.col("last") - F.col("first") + 1).alias("count")
    )


def _code(char: Column) -> Column:
    return F.shiftleft(F.col("line_no"), 21) + F.ascii(char)


def cleaned(lines: DataFrame, key: str = "doc_id") -> Table:
    """Lines trimmed, widened and redacted once, and the facts that every later step needs."""
    line = redact(normalize_line(F.col("line")))
    rows = written(lines.select(
        key, F.floor((F.col("line_no") - 1) / RANGE).alias("range_"), "line_no", line.alias("line"), "chars"
    ), "clean-lines")
    filled = F.col("line") != ""
    opens = F.ltrim("line", F.lit(WHITE_SPACE))
    ranges = rows.groupBy(key, "range_").agg(
        F.sum("chars").alias("original"), F.sum(F.length("line")).alias("chars"), F.max("line_no").alias("count"),
        F.min(F.when(filled, F.col("line_no"))).alias("first"), F.max(F.when(filled, F.col("line_no"))).alias("last"),
        F.min(F.when(filled, _code(opens))).alias("opening"), F.max(F.when(filled, _code(F.right("line", F.lit(1))))).alias("closing"),
    )
    ranges = written(ranges, "line-ranges")
    facts = ranges.groupBy(key).agg(
        F.sum("original").alias("original"), (F.sum("chars") + F.max("count") - 1).alias("clean_chars"), F.min("first").alias("first"),
        F.max("last").alias("last"), F.min("opening").bitwiseAND((1 << 21) - 1).alias("opening"),
        F.max("closing").bitwiseAND((1 << 21) - 1).alias("closing"),
    )
    ranges = written(ranges.select(key, "range_").join(facts, key), "line-facts")
    rows = rows.drop("chars")
    return Table(key, rows, ranges, written(_body(rows, ranges, key), "line-body"))


# --- detection ---------------------------------------------------------------------------------


def _windows(body: DataFrame, key: str) -> DataFrame:
    """key, window, final (whether it is the last), text and its openers: each line is in its window and, if it is one of the
    first, in the one before."""
    own = F.floor(F.col("at") / STEP)
    both = F.when((F.col("at") % STEP < OVERLAP) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    end = F.floor((F.col("count") - 1) / STEP)
    rows = body.select(key, F.explode(both).alias("window"), "at", "line", end.alias("end"))
    parts = rows.groupBy(key, "window").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts"), F.max("end").alias("end"))
    final = (F.col("window") == F.col("end")).alias("final")
    rows = parts.select(key, "window", final, F.transform("parts", lambda p: p["line"]).alias("lines"))
    return rows.select(key, "window", "final", F.array_join("lines", "\n").alias("text"), openers(F.col("lines")).alias("first"))


def _conditions(profiles: Iterable[Profile]) -> list[str]:
    """The distinct patterns of the text profiles, then those of the content rules, if a whole text may need them."""
    profiles = list(profiles)
    text = [v for p in profiles if p.record_kind == "text" for kind, v in (*p.all, *p.any) if kind == "regex"]
    known = {word for label, words in TEXT_LEVELS.items() for word in (label, *words)}
    ruled = any(p.kind == "whole_text" and p.parser["severity"].upper() not in known for p in profiles)
    return list(dict.fromkeys([*text, *(pattern for pattern, _ in CONTENT_RULES if ruled)]))


def _words(patterns: list[str]) -> list[Column]:
    """Bit vectors of the conditions that hold in a window."""
    out = []
    for at in range(0, len(patterns), WORD):
        word = F.lit(0).cast("bigint")
        for k, pattern in enumerate(patterns[at : at + WORD]):
            rule = pattern in dict(CONTENT_RULES)
            hit = F.col("text").rlike(pattern) if rule else regex_condition(F.col("text"), pattern, F.col("first"))
            if r"\A" in pattern:
                hit = hit & (F.col("window") == 0)
            if not rule and (r"\z" in pattern or r"\Z" in pattern):
                hit = hit & F.col("final")
            word = word + F.when(hit, F.lit(1 << k).cast("bigint")).otherwise(0)
        out.append(F.bit_or(word).alias(f"w{at // WORD}"))
    return out


def _held(patterns: list[str]) -> dict[str, Column]:
    return {p: F.col(f"w{k // WORD}").bitwiseAND(1 << (k % WORD)) != 0 for k, p in enumerate(patterns)}


def _rule(held: dict[str, Column]) -> Column:
    rule = F.lit("UNKNOWN")
    for pattern, label in reversed(CONTENT_RULES):
        if pattern in held:
            rule = F.when(held[pattern], label).otherwise(rule)
    return rule


def _text_formats(table: Table, profiles: list[Profile]) -> DataFrame:
    """key, fmt and rule (the severity by content rules) of the text documents that are not empty."""
    key, patterns = table.key, _conditions(profiles)
    # one window: a text, for which the first match decides; its lines are dealt by the key once, for the join and the window
    whole = _windows(table.body.filter(F.col("count") <= STEP).join(table.ranges.select(key), key, "left_semi"), key)
    rules = {pattern: F.col("text").rlike(pattern) for pattern, _ in CONTENT_RULES if pattern in patterns}
    short = whole.select(key, best_format(profiles, "text", F.col("text"), first=F.col("first")).alias("fmt"), _rule(rules).alias("rule"))
    body = table.body.filter(F.col("count") > STEP).join(table.ranges.select(key, "range_"), [key, "range_"])
    words = _windows(body, key).groupBy(key).agg(*_words(patterns))
    held = _held(patterns)

    def test(kind: str, value: str) -> Column:
        return held[value] if kind == "regex" else F.lit(False)

    fmt = None
    for p in by_preference(profiles, "text"):
        found = F.lit(True)
        for condition in p.all:
            found = found & test(*condition)
        if p.any:
            some = F.lit(False)
            for condition in p.any:
                some = some | test(*condition)
            found = found & some
        fmt = F.when(found, p.id) if fmt is None else fmt.when(found, p.id)
    long = words.select(key, (F.lit(None).cast("string") if fmt is None else fmt).alias("fmt"), _rule(held).alias("rule"))
    return short.unionByName(long)


# --- events ------------------------------------------------------------------------------------

EVENTS = ("first", "source", "severity", "content", "fingerprint", "good", "chars")


def _event(key: str, first: Column, source: Column, severity: Column, content: Column, prints: Column | None = None, *more: Column) -> list[Column]:
    return [
        F.col(key), first.cast("bigint").alias("first"), source.alias("source"), severity.alias("severity"), content.alias("content"),
        (fingerprint(content) if prints is None else prints).alias("fingerprint"), (~is_blank(content)).alias("good"),
        F.length(content).cast("bigint").alias("chars"), *more,
    ]


def _marks(profiles: list[Profile]) -> list[Column]:
    """``level`` (of a line that opens a block in its document's format) and ``preamble``."""
    level, preamble = F.lit(None).cast("string"), F.lit(None).cast("string")
    seen: dict[tuple, tuple[dict, list[str]]] = {}
    for p in profiles:
        same = tuple(sorted((k, str(v)) for k, v in p.parser.items() if "preamble" not in k))
        seen.setdefault(same, (p.parser, []))[1].append(p.id)
        if p.kind == "text_blocks" and p.parser["include_preamble"]:
            preamble = F.when(F.col("fmt") == p.id, p.parser["preamble_severity"]).otherwise(preamble)
    for parser, ids in seen.values():
        level = F.when(F.col("fmt").isin(*ids), start_level(F.col("line"), parser)).otherwise(level)
    return [level.alias("level"), preamble.alias("preamble")]


def _block_rows(body: DataFrame, key: str) -> DataFrame:
    """Blocks of each document by the start lines of its format."""
    blocks = numbered_blocks(body.select(key, (F.col("at") + 1).alias("line_no"), "line", "level", "preamble"), key)
    return blocks.select(*_event(
        key, F.col("first"), source_label(F.col("first"), F.col("last")), text_severity(F.col("level"), F.col("content")), F.col("content")
    ))


def _field_rows(body: DataFrame, key: str, profiles: list[Profile]) -> DataFrame:
    event = None
    for p in profiles:
        found = F.get(delimited_events(F.array("line"), p.parser), F.lit(0))
        event = F.when(F.col("fmt") == p.id, found) if event is None else event.when(F.col("fmt") == p.id, found)
    rows = body.withColumn("event", event).filter("event is not null")
    at, content = F.col("at"), F.col("event.content")
    return rows.select(*_event(key, at, source_label(at, at + 1), text_severity(F.col("event.level"), content), content))


def _context_rows(body: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    kept = join_context(context_lines(body.select(key, (F.col("at") + 1).alias("line_no"), "line"), key), key)
    rows = kept.filter("content <> ''").join(facts.select(key, (F.col("last") - F.col("first") + 1).alias("count")), key)
    content = F.col("content")
    return rows.select(*_event(key, F.lit(0), source_label(F.lit(0), F.col("count")), text_severity(F.lit("ERROR"), content), content))


def _whole_rows(table: Table, body: DataFrame, formats: DataFrame, profiles: list[Profile]) -> DataFrame:
    """The one event of a whole_text document: its size is known, its content stays in the line table."""
    key, level = table.key, None
    for p in profiles:
        level = F.when(F.col("fmt") == p.id, p.parser["severity"]) if level is None else level.when(F.col("fmt") == p.id, p.parser["severity"])
    sizes = body.groupBy(key, "range_").agg(F.sum(F.length("line") + 1).alias("size")).groupBy(key).agg(F.sum("size").alias("size"))
    rows = formats.filter(F.col("fmt").isin(*(p.id for p in profiles))).join(sizes, key).join(table.facts().select(key, "first", "last"), key)
    count = F.col("last") - F.col("first") + 1
    return rows.select(
        key, F.lit(0).cast("bigint").alias("first"), source_label(F.lit(0), count).alias("source"),
        F.coalesce(_lookup(level, TEXT_LEVELS), F.col("rule")).alias("severity"), F.lit(None).cast("string").alias("content"),
        F.lit("").alias("fingerprint"), F.lit(True).alias("good"), (F.col("size") - 1).alias("chars"),
    )


def _text_events(table: Table, formats: DataFrame, profiles: list[Profile]) -> DataFrame:
    key, by_kind = table.key, {}
    for p in profiles:
        if p.record_kind == "text":
            by_kind.setdefault(p.kind, []).append(p)
    blocks = by_kind.get("line_blocks", []) + by_kind.get("text_blocks", [])

    ranges = table.ranges.join(formats.select(key, "fmt"), key).select(key, "range_", "fmt")  # a row per range: the join deals hot documents
    typed = table.body.join(ranges, [key, "range_"])
    typed = written(typed.select(key, "range_", "at", "line", "fmt", *_marks(blocks)), "text-lines")

    def body(kind: list[Profile]) -> DataFrame:
        return typed.filter(F.col("fmt").isin(*(p.id for p in kind)))

    parts = []
    if blocks:
        parts.append(_block_rows(body(blocks), key))
    if by_kind.get("delimited_lines"):
        parts.append(_field_rows(body(by_kind["delimited_lines"]), key, by_kind["delimited_lines"]))
    if by_kind.get("buildkit"):
        parts.append(_context_rows(body(by_kind["buildkit"]), table.facts(), key))
    if by_kind.get("whole_text"):
        parts.append(_whole_rows(table, body(by_kind["whole_text"]), formats, by_kind["whole_text"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- JSON documents ----------------------------------------------------------------------------


def _json_line_documents(table: Table) -> DataFrame:
    """The documents of two lines or more, blank ones apart, that all begin like JSON values, and whose first line is one."""
    line = F.col("line")
    return table.body.filter("line <> ''").groupBy(table.key).agg(
        F.count(F.lit(1)).alias("records"), F.bool_and(line.rlike(JSON_START)).alias("json"),
        F.bool_and(F.when(F.col("at") == 0, strict_json(line).isNotNull())).alias("opens"),
    ).filter("records > 1 and json and opens").select(table.key)


def _container_lines(table: Table, others: DataFrame) -> DataFrame:
    """The lines of the documents that begin and end like one JSON array (``listed``) or object, with the depth of brackets
    before them, if it comes back to 0 at the end of the document, and at no line end before. Not those of ``others``."""
    key = table.key
    likely = table.ranges.filter("opening = ascii('[') and closing = ascii(']') or opening = ascii('{') and closing = ascii('}')")
    likely = likely.join(others, key, "left_anti").select(key, "range_", (F.col("opening") == F.ascii(F.lit("["))).alias("listed"))
    bare = F.regexp_replace("line", F.lit(STRING), F.lit(""))
    change = F.length(F.translate(bare, "]}", "")) - F.length(F.translate(bare, "[{", ""))
    rows = table.body.join(likely, [key, "range_"]).withColumn("change", change.cast("bigint"))
    rows = running_sum(rows, [key], "at", F.col("change"), "after", ranged=True)
    rows = written(rows.select(key, "at", "line", "count", "listed", "after", (F.col("after") - F.col("change")).alias("depth")), "container-lines")
    closed = F.when(F.col("at") == F.col("count") - 1, F.col("after") == 0).otherwise(F.col("after") > 0)
    nested = rows.groupBy(key).agg(F.bool_and(closed).alias("nested")).filter("nested").select(key)
    return rows.join(nested, key, "left_semi").drop("after")


def _container_records(lines: DataFrame, key: str) -> DataFrame:
    """key, number (from 1) and line (the text) of the records of ``_container_lines``: the parts of an array between its
    own commas, or an object; an array without records has one blank text. No document is held in one task."""
    pieces = lines.select(key, "at", "count", "listed", "depth", F.posexplode(F.regexp_extract_all("line", F.lit(JSON_PIECE), F.lit(0))).alias("k", "piece"))
    end = F.right("piece", F.lit(1))
    step = F.when(end.isin("[", "{"), 1).when(end.isin("]", "}"), -1).otherwise(0)
    along = Window.partitionBy(key, "at").orderBy("k")
    pieces = pieces.withColumn("depth", F.col("depth") + F.sum(step).over(along))
    pieces = pieces.withColumn("cut", F.when(F.col("listed") & (end == ",") & (F.col("depth") == 1), 1).otherwise(0))
    pieces = pieces.withColumn("part", F.sum("cut").over(along) - F.col("cut"))
    parts = pieces.groupBy(key, "at", "part", "count", "listed").agg(
        F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("pieces"), F.max("cut").cast("bigint").alias("cut"),
        F.count_if(F.col("depth") <= 0).alias("outside"),
    )
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    parts = parts.select(key, "at", "part", "count", "listed", "cut", "outside", text.alias("text"))
    # without the comma, and the brackets of the array
    head = F.when(F.col("listed") & (F.col("at") == 0) & (F.col("part") == 0), 1).otherwise(0)
    tail = F.when((F.col("cut") == 1) | F.col("listed") & (F.col("at") == F.col("count") - 1), 1).otherwise(0)
    parts = written(parts.select(
        key, (F.col("at").cast("bigint") * PARTS + F.col("part")).alias("place"), "cut", "outside",
        F.col("text").substr(head + 1, F.length("text") - head - tail).alias("text"),
    ), "container-parts")
    # the one bracket outside is the last
    sound = parts.groupBy(key).agg(F.sum("outside").alias("outside")).filter("outside = 1").select(key)
    numbered = running_sum(parts.drop("outside").join(sound, key, "left_semi"), [key], "place", F.col("cut"), "upto", size=RANGE * PARTS)
    records = numbered.withColumn("number", F.col("upto") - F.col("cut") + 1).groupBy(key, "number").agg(
        F.array_sort(F.collect_list(F.struct("place", "text"))).alias("parts")
    )
    return records.select(key, "number", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("line"))


def _line_records(table: Table, own: DataFrame) -> DataFrame:
    """key, number and line of the filled lines of documents of JSON lines: records are numbered by a running count."""
    key = table.key
    ranges = table.ranges.join(own, key).select(key, "range_")
    filled = F.when(F.col("line") != "", 1).otherwise(0)  # before the join: the sums need no text
    rows = table.body.select(key, "range_", "at", "line", filled.alias("filled")).join(ranges, [key, "range_"])
    rows = running_sum(rows, [key], "at", F.col("filled"), "number", ranged=True).filter("line <> ''")
    return rows.select(key, "number", "line")


def _json_outcomes(table: Table, profiles: list[Profile]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents of JSON lines and those that are one JSON array or object, their outcomes and events."""
    key = table.key
    # a document whose first line is a JSON value, and not its only one, is no single value
    own = written(_json_line_documents(table), "json-line-keys")
    whole = written(_container_records(_container_lines(table, own), key), "container-records")
    empty = whole.groupBy(key).agg(
        (F.max("number") == 1).alias("one"), F.bool_and(F.col("line").rlike(r"^[ \t\r\n]*$")).alias("blank")
    ).filter("one and blank").select(key)
    keys, outcomes, events = _record_outcomes(_line_records(table, own).unionByName(whole), key, profiles)
    none = empty.select(key, F.array().cast("array<string>").alias("format_ids"), F.lit(False).alias("supported"))
    return keys.union(empty), outcomes.unionByName(none), events


def _record_outcomes(rows: DataFrame, key: str, profiles: list[Profile]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents whose records (key, number, line) all are JSON values, their outcomes and events."""
    rows = rows.withColumn("record", let(strict_json(F.col("line")), with_fields))
    rows = rows.withColumn("fmt", best_format(profiles, "json", F.to_json(F.col("record.value")), F.col("record")))
    rows = rows.withColumn("event", record_event(profiles, F.col("fmt"), F.col("record"), F.col("number")))
    free = [p.id for p in profiles if not p.require_content]
    good = F.col("event").isNotNull() & has_content(F.col("event"))
    if free:
        good = good | (F.col("event").isNotNull() & F.col("fmt").isin(*free))
    value = F.col("record.value").isNotNull().alias("value")
    rows = written(rows.select(key, "number", "fmt", "event", F.coalesce(good, F.lit(False)).alias("good"), value), "json-lines")
    keys = written(rows.groupBy(key).agg(F.bool_and("value").alias("json")).filter("json").select(key), "json-keys")
    rows = rows.join(keys, key, "left_semi")
    bad = rows.groupBy(key).agg(F.min(F.when(~F.col("good"), F.col("number"))).alias("bad"))
    firsts = rows.groupBy(key, "fmt").agg(F.min("number").alias("number")).join(bad, key)
    named = firsts.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(
            F.col("fmt").isNotNull() & (F.col("number") < F.coalesce("bad", F.col("number") + 1)), F.struct("number", "fmt")
        ))).alias("ids"), F.first("bad").isNull().alias("supported"),
    )
    outcomes = named.select(key, F.transform("ids", lambda i: i["fmt"]).alias("format_ids"), "supported")
    events = rows.filter("good").join(bad.filter("bad is null").select(key), key).select(*_event(
        key, F.col("number"), F.col("event.source"), F.col("event.severity"), F.col("event.content"), F.col("event.fingerprint")
    ))
    return keys, outcomes, events


# --- outcome, groups and variants --------------------------------------------------------------


@dataclass(frozen=True)
class Prepared:
    """What ``prepare_lines`` knows, written tables all."""

    table: Table
    #: key, detected_format, original_chars, normalized_chars, event_count, important_events, duplicate_count,
    #: estimated_tokens, selected_variant, normalized
    documents: DataFrame
    #: key, first, source, severity, content (null: the whole text), fingerprint, repeats, chars (rendered)
    groups: DataFrame
    budget: int

    def batches(self, size: int = SPAN) -> DataFrame:
        return _batches(self, size)

    def summary(self, batches: DataFrame | None = None) -> DataFrame:
        """The columns of ``prepare.summary``, with the number of batches of each document (of ``batches``, or counted
        by the places of their pieces, without any text)."""
        key = self.table.key
        if batches is None:
            places = written(_pieces(self).select(key, "start", "upto", "wide"), "places")
            counts = batch_numbers(places, key).groupBy(key).agg((F.max("batch_index") + 1).alias("batch_count"))
        else:
            counts = batches.groupBy(key).agg(F.count(F.lit(1)).alias("batch_count"))
        rows = self.documents.join(counts, key, "left").withColumn("batch_count", F.coalesce("batch_count", F.lit(0)).cast("bigint"))
        return rows.select(
            key, "detected_format", "original_chars", "normalized_chars", "event_count", "important_events", "duplicate_count",
            "estimated_tokens", "selected_variant", "batch_count", "normalized",
        )


def prepare_lines(
    lines: DataFrame, batch_chars: int = 12_000, profiles: Iterable[Profile] = BUILT_IN, key: str = "doc_id",
) -> Prepared:
    """Detection, events, deduplication and variant of every document of a line table."""
    profiles = list(profiles)
    table = cleaned(lines, key)
    records, record_ids, record_events = _json_outcomes(table, profiles)
    rest = replace(table, ranges=written(table.ranges.join(records, key, "left_anti"), "text-facts"))
    formats = written(_text_formats(rest, profiles), "formats")
    text_rows = written(_text_events(rest, formats.filter("fmt is not null"), profiles), "line-events")

    counts = text_rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.bool_and("good").alias("full"))
    no_content = [p.id for p in profiles if not p.require_content]
    no_events = [p.id for p in profiles if not p.require_events]
    full, some = F.coalesce("full", F.lit(True)), F.coalesce("count", F.lit(0)) > 0
    if no_content:
        full = full | F.col("fmt").isin(*no_content)
    if no_events:
        some = some | F.col("fmt").isin(*no_events)
    text_ids = formats.join(counts, key, "left").select(
        key, F.array_compact(F.array("fmt")).alias("format_ids"), (F.col("fmt").isNotNull() & some & full).alias("supported")
    )
    outcomes = written(text_ids.unionByName(record_ids), "outcomes")
    events = text_rows.unionByName(record_events)
    events = events.join(outcomes.filter("supported").select(key), key)
    groups = written(_groups(events, key), "line-groups")
    return Prepared(table, written(_documents(table, outcomes, groups), "line-documents"), groups, max(batch_chars, MIN_BUDGET))


def _groups(events: DataFrame, key: str) -> DataFrame:
    """The first event of each fingerprint of a document with its repeats; important counts all of them."""
    events = written(events.drop("good"), "supported-events")
    counted = events.groupBy(key, "fingerprint").agg(
        F.min("first").alias("first"), F.count(F.lit(1)).alias("repeats"),
        F.count_if(is_important(F.col("severity"))).alias("important"),
    )
    rows = events.join(counted.drop("fingerprint"), [key, "first"])
    head = render_event(F.col("source"), F.col("severity"), F.col("repeats"), F.lit(""))
    return rows.select(
        key, "first", "source", "severity", "content", "fingerprint", "repeats", "important",
        (F.length(head) + F.col("chars")).cast("bigint").alias("chars"),
    )


def _documents(table: Table, outcomes: DataFrame, groups: DataFrame) -> DataFrame:
    key = table.key
    sums = groups.groupBy(key).agg(
        F.sum("repeats").alias("events"), F.sum("important").alias("important"), F.count(F.lit(1)).alias("groups"),
        (F.sum("chars") + 2 * F.count(F.lit(1)) - 2).alias("parsed_chars"),
    )
    rows = table.facts().join(outcomes, key, "left").join(sums, key, "left")
    supported = F.coalesce("supported", F.lit(False))
    parsed = F.coalesce("parsed_chars", F.lit(0))
    raw = ~supported | (F.col("clean_chars") < parsed)
    chosen = F.when(~supported, F.col("original")).when(raw, F.col("clean_chars")).otherwise(parsed)
    ids = F.coalesce("format_ids", F.array().cast("array<string>"))

    def counted(value: Column, other: Column | int) -> Column:
        return F.when(supported, F.coalesce(value, F.lit(0))).otherwise(other).cast("bigint")

    return rows.select(
        key, format_label(ids, supported).alias("detected_format"), F.col("original").cast("bigint").alias("original_chars"),
        counted(parsed, F.col("original")).alias("normalized_chars"), counted(F.col("events"), 1).alias("event_count"),
        counted(F.col("important"), 0).alias("important_events"),
        counted(F.col("events") - F.col("groups"), 0).alias("duplicate_count"), token_estimate(chosen).alias("estimated_tokens"),
        F.when(raw, "Raw").otherwise("Parsed").alias("selected_variant"), supported.alias("normalized"),
    )


# --- batches -----------------------------------------------------------------------------------


def _raw_pieces(table: Table, keys: DataFrame, budget: int) -> DataFrame:
    """Lines with their ends, cut at the budget; the running length of the lines gives every piece its place."""
    key = table.key
    ranges = table.ranges.join(keys, key).select(key, "range_", F.col("clean_chars"))
    size = (F.length("line") + 1).cast("bigint")  # before the join: the sums need no text
    rows = table.lines.select(key, "range_", "line_no", "line", size.alias("size")).join(ranges, [key, "range_"])
    rows = running_sum(rows, [key], "line_no", F.col("size"), "to", ranged=True)
    # the last line has no end
    text = F.when(F.col("to") > F.col("clean_chars"), F.col("line")).otherwise(F.concat("line", F.lit("\n")))
    start = F.col("to") - F.length("line") - 1
    cut = F.when(F.length("text") > budget, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{budget}}}"), F.lit(0))).otherwise(F.array("text"))
    pieces = rows.select(key, start.alias("line_start"), text.alias("text")).filter("text <> ''").select(
        key, "line_start", F.posexplode(cut).alias("k", "content")
    )
    start = (F.col("line_start") + F.col("k").cast("bigint") * budget).alias("start")
    return pieces.select(key, start, "content").select(
        key, "start", (F.col("start") + F.length("content")).alias("upto"), F.lit(budget).cast("bigint").alias("wide"),
        F.lit("").alias("sep"), F.lit("Raw").alias("variant"), "content",
    )


def _event_pieces(prepared: Prepared, keys: DataFrame, budget: int) -> DataFrame:
    table, sep = prepared.table, "\n\n"
    key = table.key
    groups = prepared.groups.join(keys, key)
    rows = running_sum(groups, [key], "first", F.col("chars") + len(sep), "upto")
    missing = rows.filter("content is null").select(key)
    lines = table.body.join(table.ranges.join(missing, key).select(key, "range_"), [key, "range_"])
    texts = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts")).select(
        key, F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("whole")
    )
    rows = rows.filter("content is not null").unionByName(rows.filter("content is null").drop("content").join(
        texts.withColumnRenamed("whole", "content"), key
    ))
    content = render_event(F.col("source"), F.col("severity"), F.col("repeats"), F.col("content"))
    return rows.select(
        key, (F.col("upto") - F.col("chars") - len(sep)).alias("start"), "upto", F.lit(budget + len(sep)).cast("bigint").alias("wide"),
        F.lit(sep).alias("sep"), F.lit("Parsed").alias("variant"), content.alias("content"),
    )


def _pieces(prepared: Prepared) -> DataFrame:
    """What the batches of every document are made of."""
    key, budget = prepared.table.key, prepared.budget
    raw = prepared.documents.filter("selected_variant = 'Raw'").select(key)
    parsed = prepared.documents.filter("selected_variant = 'Parsed'").select(key)
    return _raw_pieces(prepared.table, raw, budget).unionByName(_event_pieces(prepared, parsed, budget))


def _batches(prepared: Prepared, size: int = SPAN) -> DataFrame:
    """key, variant, batch_index and content of every batch."""
    key = prepared.table.key
    return batch_texts(batch_numbers(written(_pieces(prepared), "pieces"), key, size), key, ["variant"])


__all__ = ["Prepared", "Table", "cleaned", "prepare_lines", "raw_lines"]
