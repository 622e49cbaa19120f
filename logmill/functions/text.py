"""Text columns: lines, Unicode trimming, sanitizing, redaction, sampling and truncation."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\p{IsWhite_Space}]"
NOT_WS = r"[^\p{IsWhite_Space}]"

# Secret markers, in the order they are applied, and the replacement.
MARKERS = ("Bearer ", "api_key=", "apikey=", "password=", "token=")
REDACTED = "[REDACTED]"


_CACHE: WeakKeyDictionary[SparkContext, dict[tuple, Column]] = WeakKeyDictionary()
#: Columns kept for one context; user catalogs come and go, so the oldest leave.
CACHED = 64


def cached(key: tuple, build: Callable[[], Column]) -> Column:
    """A column that depends only on ``key``, built once per context (large trees take a while)."""
    own = _CACHE.setdefault(SparkSession.active().sparkContext, {})
    if key not in own:
        own[key] = build()
        if len(own) > CACHED:
            del own[next(iter(own))]
    return own[key]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` so that ``body`` may use it many times but it is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def non_empty(text: Column) -> Column:
    """NULL for empty text. (``nullif`` would evaluate its argument twice.)"""
    return let(text, lambda t: F.when(t != "", t))


def sealed(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """Select ``keep`` plus computed columns behind a generator.

    Filters on the results are not pushed through it, so costly expressions are never copied into
    a predicate and evaluated again there.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    out = df.select(*keep, F.explode(F.array(packed)).alias("sealed_"))
    return out.select(*keep, *[F.col(f"sealed_.{name}").alias(name) for name in columns])


def regex(pattern: str) -> str:
    """A pattern for Spark: multi-line anchors, LF as the only line end, Java group syntax."""
    return "(?md)" + pattern.replace("(?P<", "(?<")


def fold(*columns: Column, op) -> Column:
    out = columns[0]
    for column in columns[1:]:
        out = op(out, column)
    return out


def text_lines(text: Column) -> Column:
    """Lines of LF text; a final line end opens no further line, empty text has no lines."""
    body = F.when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def trim_space_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE_SPACE))


def words(text: Column) -> Column:
    """Tokens between runs of white space; blank text has none."""
    tokens = F.split(trim_space(text), WS + "+")
    return F.filter(tokens, lambda t: t != "")


def collapse_space(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, WS + "+", " "))


def is_blank(text: Column) -> Column:
    return trim_space(text) == ""


def lf_text(text: Column) -> Column:
    crlf, cr, line_end = F.lit("\r\n"), F.lit("\r"), F.lit("\n")
    return F.when(
        F.contains(text, cr), F.replace(F.replace(text, crlf, line_end), cr, line_end)
    ).otherwise(text)


def widen_tabs(text: Column) -> Column:
    return F.when(
        F.contains(text, F.lit("\t")), F.replace(text, F.lit("\t"), F.lit("    "))
    ).otherwise(text)


def normalize_line(line: Column) -> Column:
    return widen_tabs(trim_space_end(line))


def normalize_newlines(text: Column) -> Column:
    """CRLF/CR to LF, every line right-trimmed, tabs widened, no final line end.

    ASCII text without a blank before a line end has nothing to trim and is not taken apart.
    """

    def trimmed(t: Column) -> Column:
        blanks = " \t\x0b\x0c"
        before_end = [F.contains(t, F.lit(b + "\n")) | F.endswith(t, F.lit(b)) for b in blanks]
        plain = (F.octet_length(t) == F.length(t)) & ~fold(*before_end, op=lambda a, b: a | b)
        body = F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t)
        return F.when(plain, body).otherwise(
            F.array_join(F.transform(text_lines(t), trim_space_end), "\n")
        )

    return let(let(lf_text(text), trimmed), widen_tabs)


def redact(text: Column) -> Column:
    """Replace the value after the first hit of each marker on every line."""

    def marked(lower: Column) -> Column:
        hits = [F.contains(lower, F.lit(m.lower())) for m in MARKERS]
        return fold(*hits, op=lambda a, b: a | b)

    def replaced(t: Column) -> Column:
        for marker in MARKERS:
            pattern = rf"(?md)^([^\n]*?(?i:{marker})){NOT_WS}*"
            t = F.regexp_replace(t, pattern, "$1[REDACTED]")
        return t

    return let(text, lambda t: F.when(let(F.lower(t), marked), replaced(t)).otherwise(t))


def redact_all(text: Column) -> Column:
    """Replace the (non-empty) value after every hit of every marker."""
    pattern = "(?i)(" + "|".join(MARKERS) + ")" + NOT_WS + "+"
    return F.regexp_replace(text, pattern, "$1[REDACTED]")


def redact_extended(text: Column) -> Column:
    """Opt-in rule for assignments with spaces or quotes (``token = "x"``)."""
    pattern = r"""(?i)\b(api_?key|password|secret|token)(\s*[:=]\s*)("[^"\n]*"|'[^'\n]*'|[^\s"',;]+)"""
    return F.regexp_replace(text, pattern, "$1$2[REDACTED]")


def sanitized(text: Column) -> Column:
    return redact(normalize_newlines(text))


def mask_literals(text: Column, secrets: list[str], limit: int | None = None) -> Column:
    """Replace known secret strings; with a ``limit``, keep that many characters."""
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    return text if limit is None else F.left(text, F.lit(limit))


def scrub_paths(text: Column, places: dict[str, str]) -> Column:
    """Replace literal paths by placeholders, in the given order."""
    for path, placeholder in places.items():
        text = F.replace(text, F.lit(path), F.lit(placeholder))
    return text


# Personal-data patterns (Unicode words and digits) and their placeholders.
PII = (
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "<EMAIL>"),
)


def mask_pii(line: Column) -> Column:
    for pattern, placeholder in PII:
        line = F.regexp_replace(line, "(?U)" + pattern, placeholder)
    return trim_space_end(line)


def ascii_lower(text: Column) -> Column:
    """Lower-case ASCII letters only (``lower`` also folds other scripts)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower))


def token_estimate(chars: Column) -> Column:
    """ceil(chars / 3) in integers."""
    return F.floor((chars + 2) / 3).cast("bigint")


def tail_chars(text: Column, count: Column | int) -> Column:
    count = F.lit(count) if isinstance(count, int) else count
    return F.when(count <= 0, F.lit("")).otherwise(F.right(text, count))


HEAD_CUT = "[document head truncated]\n"


def keep_tail(text: Column, limit: int) -> Column:
    """Text within ``limit`` characters, else a note and its tail; the note counts."""
    room = max(limit - len(HEAD_CUT), 0)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.lit(HEAD_CUT), tail_chars(text, room))
    )


MIDDLE_CUT = "\n[...middle omitted...]\n"


def bounded_sample(text: Column, limit: int) -> Column:
    """First and last half of a 1,000 to 5,000 character budget."""
    limit = min(max(limit, 1_000), 5_000)
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.left(text, F.lit(half)), F.lit(MIDDLE_CUT), F.right(text, F.lit(half)))
    )


def safe_name(name: Column) -> Column:
    """File-name form: 80 characters of ``[A-Za-z0-9._-]``, ``input`` when empty."""
    cleaned = F.regexp_replace(F.left(name, F.lit(80)), r"[^A-Za-z0-9._-]", "_")
    return F.coalesce(non_empty(cleaned), F.lit("input"))


def first_line(text: Column, limit: int | None = 120) -> Column:
    line = F.coalesce(F.get(text_lines(text), F.lit(0)), F.lit("ok"))
    return line if limit is None else F.left(line, F.lit(limit))
