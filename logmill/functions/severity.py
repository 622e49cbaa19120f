"""Severity columns. Labels: CRITICAL, ERROR, WARNING, INFO, UNKNOWN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logmill.functions.text import ascii_lower, let, non_empty, trim_space, words

LABELS = ("CRITICAL", "ERROR", "WARNING", "INFO", "UNKNOWN")
IMPORTANT = ("CRITICAL", "ERROR", "WARNING")

# Level words of text logs and of JSON logs (digits are syslog priorities).
TEXT_LEVELS = {
    "CRITICAL": ("F", "ALERT", "CRIT", "FATAL", "CRITICAL", "PANIC"),
    "ERROR": ("E", "ERROR", "ERR", "SEVERE"),
    "WARNING": ("W", "WARN", "WARNING"),
    "INFO": ("I", "D", "V", "INFO", "NOTICE", "DEBUG", "TRACE"),
}
JSON_LEVELS = {
    "CRITICAL": ("0", "1", "2", "F", "ALERT", "CRIT", "FATAL", "CRITICAL", "PANIC"),
    "ERROR": ("3", "E", "ERROR", "ERR", "SEVERE"),
    "WARNING": ("4", "W", "WARNING", "WARN"),
    "INFO": ("5", "6", "7", "I", "D", "INFO", "NOTICE", "DEBUG", "TRACE"),
}
# Content rules tried in order when the level word decides nothing.
CONTENT_RULES = (
    (r"(?i)panic|fatal", "CRITICAL"),
    (r"(?i)error|failed|failure|refused|not found", "ERROR"),
    (r"(?i)warn", "WARNING"),
    (r'"\s+[45]\d{2}(?:\s|\z)', "ERROR"),
    (r"(?i)(?:^|\s)(?:info|notice|debug|trace)(?:\z|\s)", "INFO"),
)
# Level words that make a separate level label redundant.
LEADING_LEVEL = r"^(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)"


def _lookup(level: Column, table: dict) -> Column:
    pairs = [F.lit(x) for label, group in table.items() for word in group for x in (word, label)]
    return F.try_element_at(F.create_map(*pairs), F.upper(level))


def text_severity(level: Column, content: Column) -> Column:
    """Severity of a text event from its level word, else from its content."""
    rules = F.when(content.rlike(CONTENT_RULES[0][0]), CONTENT_RULES[0][1])
    for pattern, label in CONTENT_RULES[1:]:
        rules = rules.when(content.rlike(pattern), label)
    return F.coalesce(_lookup(level, TEXT_LEVELS), rules, F.lit("UNKNOWN"))


def level_word_severity(level: Column) -> Column:
    """Severity of a JSON level value alone."""
    return F.coalesce(_lookup(level, JSON_LEVELS), F.lit("UNKNOWN"))


def json_severity(
    level: Column, status: Column, nonzero_is_error: Column, message: Column
) -> Column:
    """Status first, then the level value, then words of the message."""

    def from_message(lower: Column) -> Column:
        def has(*terms):
            out = F.contains(lower, F.lit(terms[0]))
            for term in terms[1:]:
                out = out | F.contains(lower, F.lit(term))
            return out

        return (
            F.when(has("panic", "fatal"), "CRITICAL")
            .when(has("error", "failed"), "ERROR")
            .when(has("warn"), "WARNING")
            .when(status.isNotNull() | has("info"), "INFO")
            .otherwise("UNKNOWN")
        )

    by_status = (
        F.when(nonzero_is_error & (status != 0), "ERROR")
        .when(status >= 500, "CRITICAL")
        .when(status >= 400, "ERROR")
    )
    return F.coalesce(
        by_status,
        _lookup(level, JSON_LEVELS),
        let(F.lower(message), from_message),
    )


def rule_severity(values: dict[str, Column], rules: list[dict], default: str) -> Column:
    """First field-value rule that holds (ASCII case ignored), else the default level."""
    out = F.lit(default)
    for rule in reversed(rules):
        wanted = [v.lower() for v in rule["values"]]
        out = F.when(ascii_lower(values[rule["field"]]).isin(*wanted), rule["severity"]).otherwise(out)
    return out


def http_status(text: Column) -> Column:
    """First token that reads as an integer from 100 to 599."""
    numbers = F.transform(
        F.filter(words(text), lambda t: t.rlike(r"^\+?0*[0-9]{1,18}$")),
        lambda t: t.try_cast("bigint"),
    )
    return F.get(F.filter(numbers, lambda n: n.between(100, 599)), F.lit(0))


def starts_with_level(text: Column) -> Column:
    return trim_space(text).rlike(LEADING_LEVEL)


def is_important(severity: Column) -> Column:
    return severity.isin(*IMPORTANT)


def severity_rank(severity: Column) -> Column:
    out = F.when(severity == LABELS[0], 0)
    for rank, label in enumerate(LABELS[1:-1], start=1):
        out = out.when(severity == label, rank)
    return out.otherwise(len(LABELS) - 1)


# Level spellings searched by the independent line classifier, first hit wins.
RAW_LEVELS = (
    r"(?i)\[(fatal|critical|panic|error|err|severe|warning|warn|info|notice|debug|trace)\]",
    r"(?i)^\d\d-\d\d .*?\s([VDIWEF])\s",
    r"(?i)^\d{4}-\d\d-\d\d .*?,\s*(Info|Warning|Error)\s+CBS",
    r"(?i)\s(FATAL|CRITICAL|PANIC|ERROR|ERR|SEVERE|WARNING|WARN|INFO|NOTICE|DEBUG|TRACE)\s",
)
RAW_LEVEL_MAP = {
    "CRITICAL": ("F", "FATAL", "CRITICAL", "PANIC"),
    "ERROR": ("E", "ERROR", "ERR", "SEVERE"),
    "WARNING": ("W", "WARN", "WARNING"),
    "INFO": ("I", "D", "V", "INFO", "NOTICE", "DEBUG", "TRACE"),
}


def raw_line_level(line: Column) -> Column:
    """Second, independent severity of a raw line, used only for auditing."""
    found = F.coalesce(
        *[non_empty(F.regexp_extract(line, p, 1)) for p in RAW_LEVELS], F.lit("")
    )
    by_content = F.when(line.rlike(CONTENT_RULES[0][0]), CONTENT_RULES[0][1])
    for pattern, label in CONTENT_RULES[1:3]:
        by_content = by_content.when(line.rlike(pattern), label)
    return F.coalesce(_lookup(found, RAW_LEVEL_MAP), by_content, F.lit("UNKNOWN"))
