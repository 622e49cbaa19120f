"""Found spans and their digests, shared by the scanners."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

Span = tuple[int, int, str]  # start, end (exclusive), kind; in code points


def listed(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], kinds.index(x[2]), x[1])))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(listed(spans, kinds).encode()).hexdigest()


class Cover:
    """The union of spans; tells in logarithmic time whether another span is clear of it or lies inside."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for start, end, *_ in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def clear(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k == 0 or self.ends[k - 1] <= start

    def left(self, start: int, end: int) -> list[tuple[int, int]]:
        """The parts of a span that the union leaves."""
        found, k = [], max(bisect_right(self.starts, start) - 1, 0)
        while start < end and k < len(self.starts) and self.starts[k] < end:
            if start < self.starts[k]:
                found.append((start, self.starts[k]))
            start = max(start, self.ends[k])
            k += 1
        return [*found, (start, end)] if start < end else found

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and end <= self.ends[k - 1]


def blanked(text: str, spans: list[Span]) -> str:
    """The text with every span (overlaps joined) replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
