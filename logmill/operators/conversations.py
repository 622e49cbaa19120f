"""Conversation tables: history budgets, trimming, titles and the latest question."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logmill.functions.text import first_line, is_blank, tail_chars
from logmill.operators.lines import last_rows
from logmill.operators.ordering import RANGE, extreme_rows, running_sum

# The note before a shortened message, the smallest budget, the kept history.
EARLIER_CUT = "[earlier text truncated]\n"
MIN_HISTORY = 1_000
KEPT_MESSAGES = 100
TITLE_CHARS = 28


def bounded_history(
    messages: DataFrame,
    max_chars: int,
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    size: int = RANGE,
) -> DataFrame:
    """Newest messages that fit the character budget; the one crossing it keeps only its tail.

    The sum from the newest message backwards is taken range by range, so one very long
    conversation does not land in one task.
    """
    budget = max(max_chars, MIN_HISTORY)
    chars = F.length(text)
    summed = running_sum(
        messages, [conv], turn, chars, "through_", descending=True, size=size
    ).withColumn("left_", F.lit(budget) - (F.col("through_") - chars))
    room = F.col("left_").cast("int")
    cut = F.when(room <= len(EARLIER_CUT), tail_chars(F.col(text), room)).otherwise(
        F.concat(F.lit(EARLIER_CUT), tail_chars(F.col(text), room - len(EARLIER_CUT)))
    )
    kept = summed.filter(F.col("left_") > 0)
    return kept.withColumn(
        text, F.when(chars <= F.col("left_"), F.col(text)).otherwise(cut)
    ).drop("through_", "left_")


def latest_message(
    messages: DataFrame, role: str = "user", conv: str = "conv_id", turn: str = "turn",
    text: str = "text",
) -> DataFrame:
    return extreme_rows(messages.filter(F.col("role") == role).select(conv, turn, text), [conv], turn, newest=True)


def trim_history(
    messages: DataFrame, count: int = KEPT_MESSAGES, conv: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    return last_rows(messages, [conv], turn, count)


def titles(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text"
) -> DataFrame:
    """Title from the first line of the first question, unless that line is blank."""
    asked = messages.filter(F.col("role") == "user").select(conv, turn, F.col(text).alias("question"))
    first = extreme_rows(asked, [conv], turn)
    line = first_line(F.trim("question"), TITLE_CHARS)
    numbered = F.concat(F.lit("Chat "), F.col(conv))
    return first.select(conv, F.when(is_blank(line), numbered).otherwise(line).alias("title"))
