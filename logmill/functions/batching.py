"""Greedy batching of ordered pieces inside one row.

The fold carries only the running length and the batch starts, so appending costs one copy per
batch (not per piece), and the batch texts are cut from the piece array afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logmill.functions.text import let

MIN_BUDGET = 3_000
DEFAULT_BUDGET = 12_000
MAX_BUDGET = 50_000


def clamp_budget(requested: Column) -> Column:
    return F.least(
        F.greatest(F.coalesce(requested, F.lit(DEFAULT_BUDGET)), F.lit(MIN_BUDGET)),
        F.lit(MAX_BUDGET),
    ).cast("int")


def input_budget(max_input_chars: Column) -> Column:
    """Batch budget of an interactive session: four fifths of the input limit, 3,000 at least."""
    return F.greatest(F.lit(MIN_BUDGET), F.floor(max_input_chars * 4 / 5)).cast("int")


def _starts(lengths: Column, budget: Column, sep: int) -> Column:
    """0-based indexes of the pieces that open a batch."""
    none = F.array().cast("array<int>")

    def step(state: Column, length: Column) -> Column:
        size, index, starts = state["size"], state["index"], state["starts"]
        opens = (index == 0) | ((size > 0) & (size + length + sep > budget))
        return F.struct(
            F.when(opens, length).otherwise(
                size + length + F.when(size > 0, F.lit(sep)).otherwise(0)
            ).cast("bigint").alias("size"),
            (index + 1).cast("int").alias("index"),
            F.when(opens, F.concat(starts, F.array(index))).otherwise(starts).alias("starts"),
        )

    zero = F.struct(
        F.lit(0).cast("bigint").alias("size"),
        F.lit(0).cast("int").alias("index"),
        none.alias("starts"),
    )
    return F.aggregate(lengths, zero, step, lambda s: s["starts"])


def greedy_batches(pieces: Column, budget: Column, sep: str) -> Column:
    """Join consecutive pieces while ``joined length <= budget``; a piece is never split."""

    def cut(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(x))

        def slices(starts: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(p))
                return F.array_join(F.slice(p, start + 1, end - start), sep)

            return F.transform(starts, one)

        return F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(
            let(_starts(lengths, budget, len(sep)), slices)
        )

    return let(pieces, cut)


def event_batch_count(lengths: Column, budget: Column) -> Column:
    """The number of ``event_batches`` of rendered events of these lengths."""
    return F.when(F.size(lengths) == 0, 0).otherwise(let(lengths, lambda x: F.size(_starts(x, budget, 2))))


def raw_batch_count(text: Column, budget: Column) -> Column:
    """The number of ``raw_batches`` of a text, from the lengths of its lines."""

    def cut(length: Column) -> Column:
        full = F.floor((length - 1) / budget).cast("int")  # pieces of budget size before the last one
        return F.when(length <= budget, F.array(length)).otherwise(
            F.concat(F.array_repeat(budget, full), F.array(length - full * budget))
        )

    def lengths(t: Column) -> Column:
        ended = F.endswith(t, F.lit("\n"))
        lines = F.split(F.when(ended, F.left(t, F.length(t) - 1)).otherwise(t), "\n")

        def with_ends(ls: Column) -> Column:
            own = F.transform(ls, lambda x, i: F.length(x) + F.when((i < F.size(ls) - 1) | ended, 1).otherwise(0))
            return let(own, lambda n: F.when(F.exists(n, lambda x: x > budget), F.flatten(F.transform(n, cut))).otherwise(n))

        return let(lines, with_ends)

    return F.when(text == "", 0).otherwise(let(text, lambda t: F.size(_starts(lengths(t), budget, 0))))


def event_batches(rendered: Column, budget: Column) -> Column:
    """Batches of rendered events, a blank line between them."""
    return F.filter(greedy_batches(rendered, budget, "\n\n"), lambda b: b != "")


def raw_batches(text: Column, budget: Column) -> Column:
    """Batches of raw text by lines (line ends kept); longer lines are cut at the budget."""

    chunk = F.concat(F.lit("(?s).{1,"), budget.cast("string"), F.lit("}"))

    def cut_long(kept: Column) -> Column:
        def cut(line: Column) -> Column:
            return F.when(
                F.length(line) > budget, F.regexp_extract_all(line, chunk, F.lit(0))
            ).otherwise(F.array(line))

        return F.when(
            F.exists(kept, lambda x: F.length(x) > budget), F.flatten(F.transform(kept, cut))
        ).otherwise(kept)

    def with_ends(lines: Column, ended: Column) -> Column:
        last = F.size(lines) - 1
        return F.transform(
            lines, lambda x, i: F.when((i < last) | ended, F.concat(x, F.lit("\n"))).otherwise(x)
        )

    def pieces(t: Column) -> Column:
        ended = F.endswith(t, F.lit("\n"))
        body = F.when(ended, F.left(t, F.length(t) - 1)).otherwise(t)
        return let(let(F.split(body, "\n"), lambda ls: with_ends(ls, ended)), cut_long)

    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        let(text, lambda t: greedy_batches(pieces(t), budget, ""))
    )
