"""Multi-line blocks of a stream, assembled in keyed state.

The state key is a group of sources and a range of line numbers, so a busy source spreads over many tasks. A group is
one source, or, if ``groups`` is given, one of so many shares of them by hash: that is for sources whose lines are
numbered together, where a range has many sources of a few lines each, and ``size`` lines at most in all. A key keeps
the lines of one open block of each of its sources at most; lines are appended, and when a block is closed, the open
ones of its group are written again.
Of each range of a source come

- ``block`` rows: blocks that a later start line of the range has closed,
- ``head`` rows: lines before the first start of the range, which continue a block of an earlier one,
- a ``tail`` row: the last block of the range, when its newest line is ``timeout_seconds`` older than the
  newest line of all sources (an event-time timer; a later range or nothing continues it).

``assembled`` joins heads to the tails before them, two rows or so for each range, and takes what is still open from the
state itself. The lines of one source must arrive in order over micro-batches, as a tailed file delivers them;
lines that are later than the timeout are dropped as late. State, output and offsets are checkpointed by
Spark: a restarted query goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from logmill.functions.fingerprint import fingerprint
from logmill.functions.severity import text_severity
from logmill.operators.ordering import RANGE, running_sum
from logmill.plans.catalog import Profile
from logmill.plans.extract import start_level

PIECES = StructType([
    StructField("origin", StringType()), StructField("range_", LongType()), StructField("kind", StringType()),
    StructField("first", LongType()), StructField("last", LongType()), StructField("level", StringType()), StructField("content", StringType()),
])
#: State variables: the lines of the open blocks, and the newest line of each source and whether a block of it is open.
OPEN, NEWEST = "open", "newest"
OPEN_LINE = StructType([
    StructField("line_no", LongType()), StructField("level", StringType()), StructField("line", StringType()), StructField("origin", StringType()),
])
NEWEST_MS = StructType([StructField("origin", StringType()), StructField("ms", LongType()), StructField("opened", BooleanType())])
#: The stores of keyed state variables and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Assembler(StatefulProcessor):
    """Pieces of one range of the sources of a group. Lines come with the level of those that open a block. The timer
    of a key is the least of its sources' newest lines."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState(OPEN, OPEN_LINE)
        self.newest = handle.getListState(NEWEST, NEWEST_MS)

    @staticmethod
    def _piece(origin: str | None, range_: int, kind: str, lines: list[tuple]) -> tuple:
        numbers, levels, texts, *_ = zip(*lines)
        return origin, range_, kind, numbers[0], numbers[-1], None if kind == "head" else levels[0], "\n".join(texts)

    def _held(self) -> dict[str | None, list[tuple]]:
        """The open lines of each source."""
        held: dict[str | None, list[tuple]] = {}
        for row in self.open.get():
            held.setdefault(row[3], []).append(tuple(row))
        return held

    def _told(self, before: dict[str | None, tuple], after: dict[str | None, tuple]) -> None:
        """Keep what is known of the sources, and the timer."""
        if after == before:
            return
        self.newest.put([(o, *known) for o, known in after.items()]) if after else self.newest.clear()
        old, new = (min((ms for ms, _ in known.values()), default=None) for known in (before, after))
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        # every use of the state is a call to the executor: of a key each variable is read and written once
        lines = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        origins = lines["origin"].tolist() if "origin" in lines else [key[0]] * len(lines)
        before = {o: (ms, opened) for o, ms, opened in self.newest.get() or ()}
        held = None
        out, new, known = [], {}, dict(before)  # new: by source, the lines since its last start, or since the batch began
        closed = set()  # sources whose block in the state is closed
        for origin, line_no, level, line, ms in zip(
            origins, lines["line_no"].tolist(), lines["level"].tolist(), lines["line"].tolist(), lines["ms"].tolist()
        ):
            origin = origin if isinstance(origin, str) else None
            newest, opened = known.get(origin, (0, False))
            if isinstance(level, str):
                own = new.pop(origin, ())
                if opened:
                    kept = ()
                    if origin not in closed and before.get(origin, (0, False))[1]:
                        held = self._held() if held is None else held
                        kept = held.pop(origin)
                        closed.add(origin)
                    out.append(self._piece(origin, key[1], "block", [*kept, *own]))
                elif own:
                    out.append(self._piece(origin, key[1], "head", own))
                opened = True
            else:
                level = None
            new.setdefault(origin, []).append((line_no, level, line, origin))
            known[origin] = (int(ms) if ms is not None and ms > newest else newest, opened)
        out += [self._piece(o, key[1], "head", own) for o, own in new.items() if not known[o][1]]
        added = [row for o, own in new.items() if known[o][1] for row in own]
        if closed:
            self.open.put([*(row for own in held.values() for row in own), *added])
        elif added:
            self.open.appendList(added) if any(opened for _, opened in before.values()) else self.open.put(added)
        self._told(before, known)
        if out:
            yield pd.DataFrame(out, columns=PIECES.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        at, upto = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        known = {o: (ms, opened) for o, ms, opened in self.newest.get()}
        rest = {o: (ms, opened) for o, (ms, opened) in known.items() if ms > at and ms >= upto}
        held = self._held()
        out = [self._piece(o, key[1], "tail", held.pop(o)) for o in known if o not in rest and o in held]
        if out:
            lines = [row for own in held.values() for row in own]
            self.open.put(lines) if lines else self.open.clear()
            yield pd.DataFrame(out, columns=PIECES.names)
        self.newest.put([(o, *r) for o, r in rest.items()]) if rest else self.newest.clear()
        if rest:  # the expired timer is deleted by Spark
            self.handle.registerTimer(min(ms for ms, _ in rest.values()))

    def close(self) -> None:
        pass


def pieces(lines: DataFrame, profile: Profile, timeout_seconds: int, size: int = RANGE, groups: int | None = None) -> DataFrame:
    """``PIECES`` of a stream of lines (origin, line_no, line, event_time)."""
    group = F.col("origin") if groups is None else F.pmod(F.xxhash64("origin"), F.lit(groups))
    marked = lines.withWatermark("event_time", f"{timeout_seconds} seconds").select(
        group.alias("group_"), "origin", F.floor(F.col("line_no") / size).alias("range_"), F.col("line_no").cast("bigint").alias("line_no"), "line",
        start_level(F.col("line"), profile.parser).alias("level"), F.unix_millis("event_time").alias("ms"), "event_time",
    )
    return marked.groupBy("group_", "range_").transformWithStateInPandas(
        _Assembler(), PIECES, outputMode="Append", timeMode="EventTime"
    )


def block_stream(
    lines: DataFrame, profile: Profile, path: str, checkpoint: str, timeout_seconds: int = 300, size: int = RANGE,
    groups: int | None = None,
) -> StreamingQuery:
    """Append the pieces of a stream to ``path``, until the input at hand is used up."""
    spark, name = lines.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)  # taken over by the query when it starts
    try:
        return (
            pieces(lines, profile, timeout_seconds, size, groups).writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def open_pieces(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``tail`` pieces of the blocks that are open in the state of a stopped stream."""
    state = spark.read.format("statestore").option("stateVarName", OPEN).load(checkpoint)
    rows = state.select("key.range_", "list_element.*")
    held = rows.groupBy("origin", "range_").agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.max("level").alias("level"),
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"),
    )
    return held.select(
        "origin", "range_", F.lit("tail").alias("kind"), "first", "last", "level",
        F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"),
    )


def assembled(spark: SparkSession, path: str, checkpoint: str, profile: Profile) -> DataFrame:
    """All blocks of a stopped stream, open ones included: origin, first, last, severity, content, fingerprint."""
    written = spark.read.schema(PIECES).parquet(path)
    whole = written.filter("kind = 'block'").select("origin", "first", "last", "level", "content")
    parts = written.filter("kind <> 'block'").unionByName(open_pieces(spark, checkpoint))
    starts = F.when(F.col("kind") == "tail", 1).otherwise(0)
    numbered = running_sum(parts, ["origin"], "first", starts, "block")
    joined = numbered.groupBy("origin", "block").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("level").alias("level"),
        F.array_sort(F.collect_list(F.struct("first", "content"))).alias("parts"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["content"]), "\n").alias("content")
    if profile.parser.get("include_preamble", False):
        level = F.when(F.col("block") == 0, profile.parser["preamble_severity"]).otherwise(F.col("level"))
        joined = joined.withColumn("level", level)
        # a preamble needs a block after it
        started = whole.select("origin").union(parts.filter("kind = 'tail'").select("origin")).distinct()
        joined = joined.join(started, "origin", "left_semi")
    else:
        joined = joined.filter("block > 0")
    rows = whole.unionByName(joined.select("origin", "first", "last", "level", text))
    return rows.select(
        "origin", (F.col("first") - 1).alias("first"), "last", text_severity(F.col("level"), F.col("content")).alias("severity"),
        "content", fingerprint(F.col("content")).alias("fingerprint"),
    )
