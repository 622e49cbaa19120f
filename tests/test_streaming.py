import json
import os
from datetime import datetime, timedelta

import pandas as pd
import pytest

from logmill.operators import registry
from logmill.operators.lines import block_events
from logmill.operators.profile_store import ProfileStore
from logmill.plans.catalog import Profile
from logmill.queries import STREAM_PROFILE
from logmill.session import run_folder
from logmill.sources.keyed_table import Conflict, KeyedTable
from logmill.streaming import blocks as sb, lines as sl

START = datetime(2026, 1, 1)
SCHEMA = "origin string, line_no bigint, line string, event_time timestamp"


def write_batches(folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        text = "\n".join(json.dumps({"origin": o, "line_no": n, "line": x, "event_time": (START + timedelta(seconds=t)).isoformat()})
                         for o, n, x, t in rows)
        add_file(folder, i, text)


def add_file(folder, i, text):
    path = folder / f"{i:03d}.json"
    path.write_text(text + "\n")
    os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in this order


def stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def block_rows(n=120):
    rows = []
    for k in range(1, n + 1):
        level = "ERROR" if k % 9 == 0 else "WARN" if k % 7 == 0 else "INFO"
        rows.append(("hot", k, f"[{k}] {level} line {k}", k))
    rows += [("cold", k, f"[{k}] {'ERROR' if k == 2 else 'INFO'} c", k) for k in range(1, 5)]
    rows += [("bare", k, f"[{k}] INFO c", k) for k in range(1, 3)]
    return sorted(rows, key=lambda r: r[3])


def run_blocks(spark, folder, root, profile=STREAM_PROFILE, timeout=10_000, size=8):
    query = sb.block_stream(stream(spark, folder), profile, f"{root}/pieces", f"{root}/checkpoint", timeout, size)
    query.awaitTermination()
    assert query.exception() is None
    return query


def blocks_of(spark, root, profile=STREAM_PROFILE):
    rows = sb.assembled(spark, f"{root}/pieces", f"{root}/checkpoint", profile)
    return sorted(map(tuple, rows.select("origin", "first", "severity", "content").collect()))


def one_batch(spark, rows, profile=STREAM_PROFILE):
    lines = spark.createDataFrame([(o, n, x, START) for o, n, x, _ in rows], SCHEMA)
    return sorted(map(tuple, block_events(lines, profile, "origin").select("origin", "first", "severity", "content").collect()))


def test_blocks_over_batches_and_restarts_equal_one_batch(spark, tmp_path):
    """Small line ranges, so blocks cross ranges, batches and a restart of the query."""
    rows = block_rows()
    parts = [rows[i:i + 14] for i in range(0, len(rows), 14)]
    write_batches(tmp_path / "in", parts[:5])
    root = run_folder(spark, "test-blocks")
    first = run_blocks(spark, tmp_path / "in", root)
    assert first.lastProgress["batchId"] >= 4
    assert blocks_of(spark, root) == one_batch(spark, [r for p in parts[:5] for r in p])
    for k, part in enumerate(parts[5:], start=5):
        add_file(tmp_path / "in", k, "\n".join(json.dumps(
            {"origin": o, "line_no": n, "line": x, "event_time": (START + timedelta(seconds=t)).isoformat()}) for o, n, x, t in part))
    second = run_blocks(spark, tmp_path / "in", root)
    assert second.lastProgress["batchId"] > first.lastProgress["batchId"]
    assert blocks_of(spark, root) == one_batch(spark, rows)
    kinds = {r.kind for r in spark.read.schema(sb.PIECES).parquet(f"{root}/pieces").collect()}
    assert {"block", "head"} <= kinds


def test_preamble_of_a_stream(spark, tmp_path):
    profile = Profile("p", "text", (("regex", "x"),), (), {
        "kind": "text_blocks", "start_regex": r"^\[\d+\] ERROR", "severity": "ERROR", "include_preamble": True, "preamble_severity": "INFO"})
    rows = block_rows(40)
    write_batches(tmp_path / "in", [rows[i:i + 9] for i in range(0, len(rows), 9)])
    root = run_folder(spark, "test-preamble")
    run_blocks(spark, tmp_path / "in", root, profile)
    assert blocks_of(spark, root, profile) == one_batch(spark, rows, profile)


def test_open_block_closes_after_timeout(spark, tmp_path):
    write_batches(tmp_path / "in", [
        [("a", 1, "[1] ERROR x", 0), ("a", 2, "[2] INFO y", 1)], [("b", 1, "[1] WARN z", 100)], [("b", 2, "[2] INFO w", 101)],
    ])
    root = run_folder(spark, "test-timeout")
    run_blocks(spark, tmp_path / "in", root, timeout=60)
    pieces = spark.read.schema(sb.PIECES).parquet(f"{root}/pieces").collect()
    assert [(r.origin, r.kind, r.content) for r in pieces] == [("a", "tail", "[1] ERROR x\n[2] INFO y")]
    assert [(r.origin, r.content) for r in sb.open_pieces(spark, f"{root}/checkpoint").collect()] == [("b", "[1] WARN z\n[2] INFO w")]
    assert [r[3] for r in blocks_of(spark, root)] == ["[1] ERROR x\n[2] INFO y", "[1] WARN z\n[2] INFO w"]


LINE_SCHEMA = "source string, line string, event_time timestamp"


def line_batches(folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        text = "\n".join(json.dumps({"source": s, "line": x, "event_time": (START + timedelta(minutes=t)).isoformat()}) for s, x, t in rows)
        add_file(folder, i, text)


def test_windows_drop_late_rows(spark, tmp_path):
    line_batches(tmp_path / "in", [
        [("a", "error 1", 5), ("a", "fine", 10)], [("a", "error 2", 200)], [("a", "ok", 201)], [("a", "error late", 6), ("a", "error 3", 210)],
        [("a", "x", 500)],
    ])
    lines = sl.measured(stream(spark, tmp_path / "in", LINE_SCHEMA))
    root = run_folder(spark, "test-windows")
    sl.to_files(sl.window_counts(lines, length="1 hour"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{root}/out").filter("severity = 'ERROR'").orderBy("window_start").collect()
    assert [(r.events, r.important_events) for r in rows] == [(1, 1), (2, 2)]


def test_dedup_and_templates_over_batches(spark, tmp_path):
    line_batches(tmp_path / "in", [
        [("a", "disk 1 full", 1), ("a", "disk 2 full", 2)], [("a", "disk 3 full", 3), ("b", "disk 4 full", 3)], [("a", "ok", 4)],
    ])
    lines = sl.measured(stream(spark, tmp_path / "in", LINE_SCHEMA))
    root = run_folder(spark, "test-dedup")
    sl.to_files(sl.first_of_template(lines, delay="1 hour"), f"{root}/out", f"{root}/c1").awaitTermination()
    assert sorted((r.source, r.fingerprint) for r in spark.read.parquet(f"{root}/out").collect()) == [
        ("a", "disk # full"), ("a", "ok"), ("b", "disk # full")]
    sl.updates_to_files(sl.template_counts(lines), f"{root}/t", f"{root}/c2", ["fingerprint"]).awaitTermination()
    assert {r.fingerprint: r.total_repeats for r in sl.latest_templates(spark, f"{root}/t").collect()} == {
        "disk # full": 4, "ok": 1}


def test_sessions_over_batches(spark, tmp_path):
    line_batches(tmp_path / "in", [
        [("a", "error 1", 0), ("a", "ok", 29), ("b", "ok", 5)], [("a", "ok", 58), ("a", "ok", 59 + 60)], [("b", "warn", 35), ("b", "ok", 64)],
    ])
    lines = sl.measured(stream(spark, tmp_path / "in", LINE_SCHEMA))
    root = run_folder(spark, "test-sessions")
    keys = ["source", "range_start"]
    partial = sl.partial_sessions(lines, "source", delay="1 day", gap="30 minutes")
    sl.updates_to_files(partial, f"{root}/out", f"{root}/c", keys).awaitTermination()
    rows = sl.merged_sessions(sl.latest(spark, f"{root}/out", keys), "source", gap="30 minutes").collect()

    def minutes(t):
        return (t - START) / timedelta(minutes=1)

    got = sorted((r.source, minutes(r.session_start), minutes(r.session_end), r.events, r.important_events) for r in rows)
    # an event exactly a gap after the last one opens a session
    assert got == [("a", 0, 88, 3, 1), ("a", 119, 149, 1, 0), ("b", 5, 35, 1, 0), ("b", 35, 94, 2, 1)]


def test_a_keyed_table_of_many_steps_is_read_from_few_folders(spark):
    table = KeyedTable(spark, run_folder(spark, "test-keyed"), ["k"], fan=3)
    want = {}
    for step in range(29):
        rows = [(k, step * 100 + k) for k in range(step % 4, 12, 4)]
        want.update(dict(rows))
        table.put(spark.createDataFrame(rows, "k int, v int").coalesce(1), step)
        assert len(table.manifest().folders) <= 2 * 4
    assert {r.k: r.v for r in table.rows().collect()} == want
    assert {r.k: r.v for r in table.rows(0).collect()} == {0: 0, 4: 4, 8: 8}
    with pytest.raises(Conflict):
        table.put(spark.createDataFrame([(1, 1)], "k int, v int"), 28)
    table.put(spark.createDataFrame([(99, 1)], "k int, v int"), 28, again=True)
    got = {r.k: r.v for r in table.rows().collect()}
    assert got[99] == 1 and got[0] != want[0]  # step 28 is replaced


def test_two_writers_of_a_profile_store(spark):
    root = run_folder(spark, "test-store")
    one, two = ProfileStore(spark, root), ProfileStore(spark, root)

    def drafts(*ids):
        return spark.createDataFrame([(i, f"app {i}", f"body {i}") for i in ids], "id string, application string, body string")

    assert one.state().count() == 0 and one.install(drafts("a", "b")) == 0
    pinned, tried = one.state(0), []

    def slow(state):
        """While this writer works, the other one commits."""
        if not tried:
            tried.append(two.install(drafts("c"), origin="other"))
        return registry.install(state, drafts("c", "d")).filter("installed").selectExpr("id", "'slow' as origin", "id as application", "body", "false as disabled")

    assert one.change(slow) == 2 and tried == [1]
    state = {r.id: r.origin for r in two.state().collect()}
    assert state == {"a": "user", "b": "user", "c": "other", "d": "slow"}  # c was refused on the state it lost to
    assert {r.id for r in pinned.collect()} == {"a", "b"}  # a reader keeps its version
    with pytest.raises(Conflict):
        one.table.put(pinned, 1)
    two.override(drafts("b", "nobody"))
    two.disable(drafts("a", "b"))
    assert {(r.id, r.origin, r.disabled) for r in one.state().collect()} == {
        ("a", "user", True), ("b", "override", True), ("c", "other", False), ("d", "slow", False)}
    one.restore_defaults(one.state(0))
    assert {(r.id, r.origin, r.disabled) for r in two.state().collect()} == {
        ("a", "user", False), ("b", "user", False), ("c", "other", False), ("d", "slow", False)}


def test_text_ingest_and_audit_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text("password=a b\nWARN c  \n")
    lines = sl.measured(sl.line_stream(spark, str(tmp_path / "in")))
    root = run_folder(spark, "test-lines")
    rows = lines.select("source", "line", "severity")
    sl.audit_stream(rows, f"{root}/audit", f"{root}/c").awaitTermination()
    got = sorted((r.source, r.line, r.severity) for r in spark.read.json(f"{root}/audit").collect())
    assert got == [("x.log", "WARN c", "WARNING"), ("x.log", "password=[REDACTED] b", "UNKNOWN")]
    sl.audit_stream(rows, f"{root}/audit", f"{root}/c").awaitTermination()
    assert spark.read.json(f"{root}/audit").count() == 2


@pytest.mark.parametrize("name", ["stream_lines", "stream_windows", "stream_templates"])
def test_streams_read_a_table_in_parts(spark, tmp_path, name):
    from logmill.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    single, parts = (sorted(map(repr, QUERIES[name](spark, d).collect())) for d in (sf, str(tmp_path)))
    assert single and single == parts


def test_blocks_use_the_state_a_few_times_per_range():
    """Closing many blocks in a batch makes no call to the state for each of them."""
    calls = []

    class Value:
        def __init__(self):
            self.rows = None

        def __getattr__(self, name):
            calls.append(name)
            return {
                "exists": lambda: bool(self.rows), "get": lambda: self.rows, "put": self._set, "update": self._set,
                "appendList": lambda new: self._set([*self.rows, *new]), "clear": lambda: self._set(None),
            }[name]

        def _set(self, rows):
            self.rows = rows

    class Handle:
        timers = []
        getListState = getValueState = lambda self, name, schema: Value()
        listTimers = lambda self: calls.append("listTimers") or iter(list(self.timers))
        registerTimer = lambda self, at: calls.append("registerTimer") or self.timers.append(at)
        deleteTimer = lambda self, at: calls.append("deleteTimer") or self.timers.remove(at)

    assembler, handle = sb._Assembler(), Handle()
    assembler.init(handle)
    out = []
    for start in (1, 101):
        rows = [(n, "WARN" if n % 2 == 0 else None, f"[{n}] x", n) for n in range(start, start + 100)]
        calls.clear()
        out += list(assembler.handleInputRows(("o", 0), iter([pd.DataFrame(rows, columns=["line_no", "level", "line", "ms"])]), None))
        assert len(calls) <= 8
        assert handle.timers == [rows[-1][-1]]
    kinds = pd.concat(out)
    assert kinds["kind"].tolist() == ["head"] + ["block"] * 99
    assert kinds["content"].tolist()[1:] == [f"[{n}] x\n[{n + 1}] x" for n in range(2, 200, 2)]
    assert [n for n, *_ in assembler.open.rows] == [200]


def test_groups_of_sources_equal_single_sources(spark, tmp_path):
    """Sources numbered together share a key; blocks cross ranges, batches and a restart."""
    rows = [(f"s{k * k % 13}" if k % 11 else None, k, f"[{k}] {'ERROR' if k % 7 == 0 else 'WARN' if k % 5 == 0 else 'INFO'} line", k) for k in range(1, 200)]
    parts = [rows[i:i + 40] for i in range(0, len(rows), 40)]
    write_batches(tmp_path / "in", parts[:3])
    root = run_folder(spark, "test-groups")

    def run():
        sb.block_stream(stream(spark, tmp_path / "in"), STREAM_PROFILE, f"{root}/pieces", f"{root}/checkpoint", 10_000, 64, 2).awaitTermination()

    run()
    for k, part in enumerate(parts[3:], start=3):
        add_file(tmp_path / "in", k, "\n".join(json.dumps(
            {"origin": o, "line_no": n, "line": x, "event_time": (START + timedelta(seconds=t)).isoformat()}) for o, n, x, t in part))
    run()
    found = sb.assembled(spark, f"{root}/pieces", f"{root}/checkpoint", STREAM_PROFILE).select("origin", "first", "severity", "content").collect()
    named = sorted(tuple(r) for r in found if r.origin is not None)
    assert named == one_batch(spark, [r for r in rows if r[0] is not None])
    assert len(found) > len(named) > 50


def test_a_group_of_sources_uses_the_state_a_few_times():
    class Value:
        rows = None

        def __getattr__(self, name):
            calls.append(name)
            return {
                "get": lambda: list(self.rows or ()), "put": self._set, "appendList": lambda new: self._set([*self.rows, *new]), "clear": lambda: self._set(None),
            }[name]

        def _set(self, rows):
            self.rows = rows

    class Handle:
        timers = []
        getListState = lambda self, name, schema: Value()
        registerTimer = lambda self, at: calls.append("registerTimer") or self.timers.append(at)
        deleteTimer = lambda self, at: calls.append("deleteTimer") or self.timers.remove(at)

    class Expired:
        getExpiryTimeInMs = lambda self: 5
        getCurrentWatermarkInMs = lambda self: 205

    calls, assembler, handle, out = [], sb._Assembler(), Handle(), []
    assembler.init(handle)
    columns = ["origin", "line_no", "level", "line", "ms"]
    for start, sources in ((0, 400), (400, 200)):  # the second batch has half of the sources
        rows = [(f"s{k}", start + k, "WARN" if k % 2 else None, f"[{start + k}]", start + k + 5) for k in range(sources)]
        calls.clear()
        out += list(assembler.handleInputRows((0, 0), iter([pd.DataFrame(rows, columns=columns)]), None))
        assert len(calls) <= 8
        assert handle.timers == [5 if start == 0 else 205]
    kinds = pd.concat(out)
    assert kinds.groupby("kind").size().to_dict() == {"block": 100, "head": 300}
    assert set(kinds[kinds["kind"] == "block"]["content"]) == {f"[{k}]" for k in range(1, 200, 2)}
    assert sorted(n for n, *_ in assembler.open.rows) == [*range(201, 400, 2), *range(401, 600, 2)]
    # only the sources whose newest line is older than the watermark are closed
    handle.timers.clear()
    assert list(assembler.handleExpiredTimer((0, 0), Expired(), Expired())) == [] and handle.timers == [205]
    Expired.getExpiryTimeInMs, Expired.getCurrentWatermarkInMs = (lambda self: 205), (lambda self: 300)
    handle.timers.clear()
    tails = pd.concat(assembler.handleExpiredTimer((0, 0), Expired(), Expired()))
    assert set(tails["kind"]) == {"tail"} and sorted(tails["first"]) == list(range(201, 295, 2)) and handle.timers == [300]
    assert sorted(n for n, *_ in assembler.open.rows) == [*range(295, 400, 2), *range(401, 600, 2)]
