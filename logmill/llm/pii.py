"""Personal data: base patterns, and offset-preserving deobfuscation before they are tried again.

Transducers rewrite a text step by step and remember for every character which source characters it
stands for: homoglyphs and invisible characters, spelled digits, "at" and "dot" in disguise. The base
patterns run on the rewritten text; what they find is mapped back to source offsets and added, if it
uses something rewritten or taken out and reaches outside the base spans (which stay). Only texts in which
a trigger stands are rewritten.

A bare "at" counts only together with a spelled or bracketed dot ("look at example.org" is no address);
number words are read in runs of number words, and of number words and figures together, spelled or
hidden dots between them allowed. A run is rewritten if it can hold an identifier at all (``DIGITS`` digits
or ``DOTS`` dots); the base patterns decide whether it does. Each reading (none, words only, words and
figures) has a tape of its own, so that a number word beside an identifier hides nothing.

Edge cases: null is the empty text; a text without spans gets 0, the digest of the empty string and an
empty list; null and repeated ids are rows like any other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from logmill.llm.common import batched, columns_of, per_batch
from logmill.llm.spans import Cover, Span, digest, listed

KINDS = ("email", "ip", "card", "phone")
# the fewest digits of a phone or card number, the dots of an IP
DIGITS, DOTS = 10, 3
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# a match can only begin where a run of digits begins: the look-behind changes no match, only the time
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# fixed values: letters that look like ASCII letters (Cyrillic, then Greek), and number words
LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijshdqwABEKMHOPCTYXIJS"))
LOOKALIKE |= dict(zip("οαινρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaivpuABEZHIKMNOPTYX"))
NUMBER_WORDS = (
    ("zero", "oh", "null", "cero", "zéro"), ("one", "eins", "uno", "un"), ("two", "zwei", "zwo", "dos", "deux"),
    ("three", "drei", "tres", "trois"), ("four", "vier", "cuatro", "quatre"), ("five", "fünf", "cinco", "cinq"),
    ("six", "sechs", "seis"), ("seven", "sieben", "siete", "sept"), ("eight", "acht", "ocho", "huit"),
    ("nine", "neun", "nueve", "neuf"),
)
DIGIT = {word: str(n) for n, words in enumerate(NUMBER_WORDS) for word in words}
_WORDS = "|".join(sorted(DIGIT, key=len, reverse=True))
_WORD = re.compile(rf"(?i)(?<!\w)(?:{_WORDS})(?!\w)")
_NUMBER = re.compile(rf"{_WORD.pattern}|[0-9]+")
_PLUS = re.compile(r"(?i)(?:\+|(?<!\w)plus)[\s-]*\Z")
_OPEN, _CLOSE = r"\s*[(\[{]\s*", r"\s*[)\]}]\s*"
HIDDEN_DOT = re.compile(rf"(?i){_OPEN}(?:dot|punkt|punto|point|\.){_CLOSE}|\s+(?:dot|punkt|punto)\s+")
HIDDEN_AT = re.compile(rf"(?i){_OPEN}(?:at|arroba|arobase|@){_CLOSE}|\s+@\s*|@\s+")
_DOT = rf"(?:{HIDDEN_DOT.pattern[4:]}|\.)"
ADDRESS = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*"
    rf"(?P<at>{HIDDEN_AT.pattern[4:]}|\s+at\s+|@)[A-Za-z0-9-]+(?P<rest>(?:{_DOT}[A-Za-z0-9-]+)+)"
)
HIDDEN_IP = re.compile(rf"(?i)(?<![0-9])[0-9]+(?:{_DOT}[0-9]+){{3}}")
_ANY_DOT = re.compile(rf"(?i){_DOT}")
# what may stand between two numbers of a run: a spelled or hidden dot, or signs that the base patterns take
_RUN_DOT = re.compile(r"(?i)[\s-]*[(\[{]\s*(?:dot|punkt|punto|point|\.)\s*[)\]}][\s-]*|[\s-]+(?:dot|punkt|punto)[\s-]+")
_RUN_GAP = re.compile(r"[\s().-]+")
_NEXT = r"[^0-9A-Za-z]+(?:(?:dot|punkt|punto|point)[^0-9A-Za-z]+)?"
TRIGGER = (
    r"[\x{0370}-\x{052F}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{FF01}-\x{FF5E}\x{1D400}-\x{1D7FF}]|"
    r"(?i:\b(?:" + _WORDS + r")" + _NEXT + r"(?:" + _WORDS + r"|[0-9]))|(?i:[0-9]" + _NEXT + r"(?:" + _WORDS + r"))|"
    r"(?i:[(\[{]\s*(?:at|arroba|arobase|@|dot|punkt|punto|point|\.)\s*[)\]}])|(?i:\s(?:dot|punkt|punto)\s)|\s@|@\s"
)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """From each @ to the left as far as the local part may reach, to the right by pattern."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind; those that fail its test are dropped, without another try."""
    found = _emails(text)
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((*m.span(), "phone"))
    return found


class Tape:
    """A rewritten text; ``spans[k]`` are the source offsets of its character k, ``new[k]`` tells whether
    that character was rewritten."""

    def __init__(self, text: str):
        self.text, self.spans, self.new = text, [(k, k + 1) for k in range(len(text))], [False] * len(text)

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by the given text, for disjoint changes in order."""
        text, spans, new, at = [], [], [], 0
        for start, end, by in changes:
            text += [self.text[at:start], by]
            spans += self.spans[at:start] + [(self.spans[start][0], self.spans[end - 1][1])] * len(by)
            new += self.new[at:start] + [True] * len(by)
            at = end
        self.text = "".join([*text, self.text[at:]])
        self.spans, self.new = spans + self.spans[at:], new + self.new[at:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.spans[start][0], self.spans[end - 1][1]


def _plain(c: str) -> str | None:
    """The ASCII character that c stands for, '' for an invisible one, None for any other."""
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    n = ord(c)
    if 0x200B <= n <= 0x200F or n in (0x2060, 0xFEFF):
        return ""
    if 0xFF01 <= n <= 0xFF5E or 0x1D400 <= n <= 0x1D7FF:
        return unicodedata.normalize("NFKC", c)
    return None


def _digit(word: str) -> str:
    # case folding also meets the letters that a regex without case takes for i, k and s
    return DIGIT[word.casefold().replace("i\u0307", "i").replace("ı", "i")]


def _spelled(text: str, number: re.Pattern) -> list[tuple[int, int, str]]:
    """The changes that write digits for the number words in all runs of ``number`` that may be identifiers."""
    changes, run, gaps = [], [], []
    ips = Cover([s for s in base_spans(text) if s[2] == "ip"])

    def closed() -> None:
        words = sum(m[0][0].isalpha() for m in run)
        digits = words + sum(len(m[0]) for m in run if not m[0][0].isalpha())
        if not words and not any(by == "." != text[a:b] for a, b, by in gaps):
            return
        if digits < DIGITS and sum("." in by for *_, by in gaps) < DOTS:
            return
        plus = _PLUS.search(text, max(run[0].start() - 64, 0), run[0].start())
        if plus and text[plus.start() : run[0].start()] != "+":
            changes.append((*plus.span(), "+"))
        for m, gap in zip(run, [*gaps, None]):
            if m[0][0].isalpha():  # what joins it to the next number goes with a word
                to = gap[1] if gap else m.end()
                changes.append((m.start(), to, _digit(m[0]) + (gap[2] if gap else "")))
            elif gap and text[gap[0] : gap[1]] != gap[2]:
                # and with a figure's last digit
                changes.append((m.end() - 1, gap[1], m[0][-1] + gap[2]))

    for m in number.finditer(text):
        if run:
            a, b = run[-1].end(), m.start()
            gap = None
            if _RUN_DOT.fullmatch(text, a, b):
                gap = (a, b, ".")
            elif _RUN_GAP.fullmatch(text, a, b):
                figures = [x for x in (run[-1], m) if not x[0][0].isalpha()]
                loose = all(c in "-" or c.isspace() for c in text[a:b])
                # words are joined to each other, one sign apart also to figures, but not to a whole IP
                close = b - a == 1 and all(ips.clear(*x.span()) for x in figures)
                # longer figures keep what stands between them
                long = len(figures) == 2 and any(len(x[0]) > 1 for x in figures)
                gap = (a, b, "" if loose and (not figures or close and not long) else text[a:b])
            if gap:
                run.append(m)
                gaps.append(gap)
                continue
            closed()
        run, gaps = [m], []
    if run:
        closed()
    return changes


def _plainly(text: str) -> Tape:
    """Lookalikes by the letters that they stand for, without invisible characters."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite([(k, k + 1, by) for k, c in enumerate(text) if ord(c) > 0x36F and (by := _plain(c)) is not None])
    return tape


def _dotted(tape: Tape) -> Tape:
    """Hidden "at" and dots of addresses, then hidden dots of IPs, by their signs."""
    changes = []
    for m in ADDRESS.finditer(tape.text):
        bare = m["at"].strip().lower() == "at"
        hidden = any(d[0] != "." for d in _ANY_DOT.finditer(m["rest"]))
        tail = re.split(r"\W", m["rest"])[-1]
        if (bare and not hidden) or not (tail.isalpha() and len(tail) >= 2):
            continue
        dots = [(d.start(), d.end(), ".") for a, b in ((m.start(), m.start("at")), m.span("rest"))
                for d in _ANY_DOT.finditer(tape.text, a, b) if d[0] != "."]
        changes += sorted(dots + [(*m.span("at"), "@")] * (m["at"] != "@"))
    tape.rewrite(changes)
    changes = []
    for m in HIDDEN_IP.finditer(tape.text):
        changes += [(d.start(), d.end(), ".") for d in _ANY_DOT.finditer(tape.text, *m.span()) if d[0] != "."]
    tape.rewrite(changes)
    return tape


def deobfuscated(text: str) -> list[Tape]:
    """The text without disguises: number words as they stand, and where it makes a difference as digits by
    runs of words and by runs of words and figures."""
    tapes = [_plainly(text)]
    known = [[]]
    for number in (_WORD, _NUMBER):
        changes = _spelled(tapes[0].text, number)
        if changes not in known:
            known.append(changes)
            tape = _plainly(text)
            tape.rewrite(changes)
            tapes.append(tape)
    return [_dotted(tape) for tape in tapes]


def added_spans(text: str, base: list[Span]) -> list[Span]:
    cover, added = Cover(base), {}
    for tape in deobfuscated(text):
        for start, end, kind in base_spans(tape.text):
            span = tape.source(start, end)
            # characters that were taken out leave no mark on the tape, but a longer source
            if (any(tape.new[start:end]) or span[1] - span[0] > end - start) and not cover.holds(*span):
                added[*span, kind] = None
    return list(added)


def _find(batch: pa.RecordBatch) -> dict[str, list]:
    texts = batch.column(1).fill_null("")
    some = pc.match_substring_regex(texts, "[@0-9]").to_pylist()
    hidden = pc.match_substring_regex(texts, TRIGGER).to_pylist()
    found = []
    for k in range(len(texts)):
        text = texts[k].as_py() if some[k] or hidden[k] else ""
        base = base_spans(text) if some[k] else []
        found.append((base, base + added_spans(text, base) if hidden[k] else base))
    return {
        "doc_id": batch.column(0),
        **{f"n_{kind}": [sum(s[2] == kind for s in base) for base, _ in found] for kind in KINDS},
        "base_sha256": [digest(base, KINDS) for base, _ in found],
        "spans": [listed(every, KINDS) for _, every in found],
    }


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and digest, and all spans of every document."""
    batched(docs.sparkSession)
    return per_batch(
        columns_of(docs, doc_id="bigint", text="string"), _find,
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    )
