"""Line tables against the in-row form, plain Python and whole-file reads."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logmill.functions.severity import CONTENT_RULES
from logmill.functions.text import redact
from logmill.operators import line_batches as lb, line_prepare as lp, prepare as pp
from logmill.operators.lines import numbered_blocks
from logmill.plans.catalog import BUILT_IN, Profile
from logmill.plans.profile_texts import profile_corpus
from logmill.plans.synth import corpus_sql, log_corpus, owner_lines
from logmill.session import written
from logmill.sources.files import qualified, read_logs
from logmill.sources.lines import read_lines

SF = "/root/testdata/sf0.001"
RECORD = '{{"insertId":"{0}","severity":"INFO","textPayload":"a {0}"}}'
ODD = [
    "", "\n", "\n\n", " \n\t\n", "x", "\r\n a\r b\r\n\r\n", "  x  \n\n", "y" * 10_000 + "\nz", "[1,\n2]", "[]", "5\n6", '{"a":1}\n{"b":2}\n',
    '{"a":1}\n\n nope', "\n\n " + "\n".join(RECORD.format(k) for k in (200, 404, 500)) + "\n",
    RECORD.format(1) + '\n{"insertId":"2"}\n' + RECORD.format(3), "[" + RECORD.format(1) + ",\n " + RECORD.format(2) + "\n]",
    RECORD.format(7), "\n" * 500 + "Traceback (most recent call last):\n a\nValueError: b" + "\n" * 600,
    "[]\nerror: no such object: x\n", "é" * 4_000 + "\x85\n z\t\t|\n", "#1 [1/2] RUN x\n" * 300 + "#2 ERROR: failed to solve: y\n" + "#3 z\n" * 9,
    "2 123456789012 eni-1a 1 2 3 4 5 6 7 8 9 REJECT OK\nshort\n2 123456789012 eni-1a 1 2 3 4 5 6 7 8 9 ACCEPT OK",
    "   Compiling a\nerror[E0308]: b\n  --> src/a.rs:1:2\n   |\nerror[E0309]: c\n  --> src/a.rs:3:4",
]


def same(spark, docs, budget=3_000, profiles=BUILT_IN, size=lb.SPAN):
    whole = written(pp.prepare(docs, budget, profiles), "test-whole")
    lines = lp.prepare_lines(lp.raw_lines(docs), budget, profiles)
    batches = lines.batches(size).cache()
    assert sorted(map(tuple, lines.summary(batches).collect())) == sorted(map(tuple, pp.summary(whole).collect()))
    columns = ["doc_id", "variant", "batch_index", "content"]
    want = sorted(map(tuple, pp.batch_rows(whole).select(*columns).collect()))
    assert sorted(map(tuple, batches.select(*columns).collect())) == want
    return lines


def test_prepared_lines_equal_prepared_rows(spark, docs):
    odd = docs(*ODD).select("doc_id", "text")
    same(spark, odd.union(log_corpus(spark, SF).select("doc_id", "text")), size=20_000)


def test_a_document_over_many_ranges(spark, monkeypatch):
    """Far more lines than a range, so every step deals the document over tasks."""
    from logmill.operators import ordering

    monkeypatch.setattr(lp, "RANGE", 64)
    rng = random.Random(1)
    names = ["kafka.server.KafkaApis", "kafka.log.Log"]
    rows = [
        f"[2026-01-0{k % 9 + 1} 10:00:00,{k % 1000}] {rng.choice(['INFO', 'ERROR', 'WARN'])} broker {k % 700} took {'x' * rng.randint(0, 90)} ({names[k % 2]})"
        + ("\n\tat frame" * rng.randint(0, 3)) for k in range(6_000)
    ]
    docs = spark.createDataFrame([(1, "\n".join(rows)), (2, "\n".join(r[1:] for r in rows))], "doc_id bigint, text string")
    lines = same(spark, docs, size=9_000)
    assert lines.table.ranges.filter("doc_id = 1").count() > 100
    assert ordering.RANGE > 64


def test_conditions_across_lines(spark, docs):
    far = "a start\n" + "\n" * (lp.OVERLAP - 3) + "end b"
    own = Profile("far", "text", (("regex", r"start\s+end"),), (), {"kind": "whole_text", "severity": "ERROR"})
    texts = ["pad\n" * k + far for k in (0, 1, lp.STEP - 3, lp.STEP - 1, lp.STEP, 3 * lp.STEP - lp.OVERLAP)]
    lines = same(spark, docs(*texts, "start no end").select("doc_id", "text"), profiles=[own])
    assert lines.documents.filter("normalized").count() == len(texts)
    ends = [
        Profile("head", "text", (("regex", r"\Afirst"),), (), {"kind": "whole_text", "severity": "INFO"}),
        Profile("tail", "text", (("regex", r"last\z"),), (), {"kind": "whole_text", "severity": "INFO"}),
    ]
    pad = "x\n" * 400
    lines = same(spark, docs(f"first\n{pad}", f"{pad}first", f"{pad}last\n\n", f"last\n{pad}").select("doc_id", "text"), profiles=ends)
    assert [r.detected_format for r in lines.documents.orderBy("doc_id").collect()] == ["head", "unknown -> raw", "tail", "unknown -> raw"]


def test_profiles_without_content_or_events(spark, docs):
    blank = Profile("blank", "text", (("regex", "^mark"),), (), {
        "kind": "delimited_lines", "delimiter": "tab", "fields": ["a", "b", "c"], "severity_rules": [], "default_severity": "INFO",
    }, require_events=False)
    same(spark, docs("mark\nno fields", "mark 1\tb\tc\nmark 2\tb\tc\nx", "other").select("doc_id", "text"), profiles=[*BUILT_IN, blank])


def fold(lengths, budget, sep):
    """Batch of each piece, one after the other."""
    out, size = [], None
    for n in lengths:
        if size is None or size + sep + n > budget:
            out.append((out[-1] if out else -1) + 1)
            size = n
        else:
            out.append(out[-1])
            size += sep + n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_batch_numbers_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for doc in range(7):
        budget, sep = rng.choice([3, 10, 40, 400]), rng.choice([0, 2])
        kinds = [lambda: 1, lambda: rng.randint(1, 12), lambda: rng.choice([1, 5, 90, 1_500])]
        lengths = [rng.choice(kinds[: 1 + doc % 3])() for _ in range(rng.choice([1, 3, 400]))]
        at = 0
        for n, k in zip(lengths, fold(lengths, budget, sep)):
            rows.append((doc, at, at + n + sep, budget + sep, f"p{at}"))
            want[doc, at] = k
            at += n + sep
    rng.shuffle(rows)
    pieces = spark.createDataFrame(rows, "doc bigint, start bigint, upto bigint, wide bigint, content string")
    got = lb.batch_numbers(pieces, "doc", size=rng.choice([64, 700, 10_000])).collect()
    assert {(r.doc, r.start): r.batch_index for r in got} == want
    assert all(r.content == f"p{r.start}" for r in got) and len(got) == len(rows)


def test_groups_reach_python_whole_and_many_at_once():
    groups = [k for k in range(900) for _ in range(1 if k % 90 else 250)]
    batches = pa.Table.from_pydict({"k": groups, "n": list(range(len(groups)))}).to_batches(max_chunksize=100)
    tables = list(lb._whole_groups(iter(batches), ["k"]))
    assert [n for t in tables for n in t.column("n").to_pylist()] == list(range(len(groups)))
    seen = [k for t in tables for k in sorted(set(t.column("k").to_pylist()))]
    assert seen == list(range(900)) and len(tables) < 60
    assert all([t.column("k")[a].as_py() for a in lb._edges(t, ["k"])[:-1]] == sorted(set(t.column("k").to_pylist())) for t in tables)


def test_documents_of_one_span_need_one_step(spark):
    rows = [(d, 10 * k, 10 * k + 10, 25) for d in range(40) for k in range(30)]
    pieces = written(spark.createDataFrame(rows, "doc bigint, start bigint, upto bigint, wide bigint"), "test-pieces")
    numbers = lb.batch_numbers(pieces, "doc")
    assert {(r.doc, r.start): r.batch_index for r in numbers.collect()} == {(d, s): s // 10 // 2 for d, s, *_ in rows}
    assert "EmptyRelation" in numbers._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_a_body_is_joined_once_and_blocks_are_made_once(spark, docs):
    lines = lp.prepare_lines(lp.raw_lines(docs(*ODD).select("doc_id", "text")), 3_000)
    assert "Join" not in lines.table.body._jdf.queryExecution().executedPlan().toString()
    marked = written(spark.createDataFrame(
        [(1, 1, "head", None, "INFO"), (1, 2, "a", "ERROR", "INFO"), (1, 3, "b", None, "INFO"), (2, 1, "no start", None, "INFO"), (3, 1, "c", None, None)],
        "doc_id bigint, line_no bigint, line string, level string, preamble string"), "test-marked")
    blocks = numbered_blocks(marked)
    assert sorted(map(tuple, blocks.collect())) == [(1, 0, 0, 1, "INFO", "head"), (1, 1, 1, 3, "ERROR", "a\nb")]
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1


def test_long_lines_are_read_few_times(spark, docs):
    """A text is lowered once for all markers, documents of one window are judged by the best profile first and dealt once,
    and raw lines stay where their ranges were dealt."""
    texts = docs("x" * 5_000, "Traceback (most recent call last):\n a\nValueError: b", *("npm ERR! x\n" + "y\n" * k for k in (lp.STEP - 2, lp.STEP - 1, lp.STEP)))
    plan = texts.select(redact(F.col("text")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") == 1
    lines = same(spark, texts.select("doc_id", "text"))
    assert [r.detected_format for r in lines.documents.orderBy("doc_id").collect()][1:] == ["python-traceback"] + ["npm-cli-error"] * 3
    keys = lines.documents.select("doc_id")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = lp._raw_pieces(lines.table, keys, 3_000)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert "Exchange" not in "".join(plan[plan.index("Window [sum(value_"):].split("SortMergeJoin")[:2])


def test_summaries_count_batches_without_texts(spark, docs, monkeypatch):
    lines = lp.prepare_lines(lp.raw_lines(docs(*ODD).select("doc_id", "text")), 3_000)
    want = sorted(map(tuple, lines.summary(lines.batches()).collect()))
    monkeypatch.setattr(lp, "batch_texts", None)
    assert sorted(map(tuple, lines.summary().collect())) == want


def test_json_lines_that_only_begin_like_json(spark, docs):
    texts = ['{"a":1}\n2 x\n', '2 x\n{"a":1}', "10.0.0.1 - -\n10.0.0.2 - -", RECORD.format(1) + "\n\n" + RECORD.format(2), RECORD.format(1) + "\n" + RECORD.format(2) + "\n[1"]
    lines = same(spark, docs(*texts).select("doc_id", "text"))
    assert [r.doc_id for r in lines.documents.filter("normalized").collect()] == [3]


def test_content_rules_are_matched_for_whole_texts_that_need_them(spark, docs):
    assert not set(dict(CONTENT_RULES)) & set(lp._conditions(BUILT_IN))
    own = Profile("odd", "text", (("regex", "^mark"),), (), {"kind": "whole_text", "severity": "ODD"})
    lines = same(spark, docs("mark\nit failed", "mark\nwarned").select("doc_id", "text"), profiles=[*BUILT_IN, own])
    assert sorted(r.severity for r in lines.groups.collect()) == ["ERROR", "WARNING"]


def test_events_of_a_small_file_are_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    assert profile_corpus(spark, SF).rdd.getNumPartitions() == cores > 1


def test_owner_lines_are_the_lines_of_owner_documents(spark):
    for style in ("mixed", "cloud", "compiler"):
        docs = spark.sql(corpus_sql("spark", style, SF, by="owner"))
        want = sorted(map(tuple, lp.raw_lines(docs).collect()))
        assert sorted(map(tuple, owner_lines(spark, SF, style).collect())) == want


def test_files_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(2)
    ends = ["\n", "\r\n", "\r", "\n\n"]
    texts = {"a.log": "".join("w" * rng.randint(0, 60) + rng.choice(ends) for _ in range(4_000)), "b.log": "é\r", "c.log": "", "d.log": "x\ny",
             "e.log": "one\r\ntwo\r\n", "f.log": "\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    root = qualified(spark, str(tmp_path))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = read_lines(spark, root).cache()
        rows = sorted((r.path[len(root) + 1 :], r.line_no, r.line, r.chars) for r in got.collect())
        assert spark.read.option("lineSep", "\n").text(root).select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    whole = read_logs(spark, root).select(F.col("path").alias("doc_id"), "text")
    assert rows == sorted((r.doc_id[len(root) + 1 :], r.line_no, r.line, r.chars) for r in lp.raw_lines(whole).collect())
    assert {r.path for r in read_lines(spark, root, roots=[f"{root}/b.log", f"{root}/c.log"]).collect()} == {f"{root}/b.log"}


CONTAINERS = [
    "[]", "[ \n ]", "[\n" + ",\n".join(RECORD.format(k) for k in range(40)) + "\n]", "[" + ",".join(RECORD.format(k) for k in range(300)) + "]",
    '{"insertId":"1",\n"severity":"INFO",\n "textPayload":"a [b], {c} \\" , ] d"\n}', '[{"insertId":"1","severity":"INFO","textPayload":"] , ["},\n5]',
    "[" + RECORD.format(1) + ",]", "[," + RECORD.format(1) + "]", "[" + RECORD.format(1) + "]\n[" + RECORD.format(2) + "]", RECORD.format(1) + ",\n" + RECORD.format(2),
    '[1"]', '["a]', '[1\n2]', '["a\nb"]', '{"a":[}\n]}', '[{"a":1]}', "[1]]", "[[1]", "[1],\n[2]", '[{"a":[1,[2,\n3],{"b":[4,\n{}]}]},\n[5,6]\n]', '["\\\\",\n"\\\\\\"]"]',
    "[2026-01-01] x\n[2026-01-02] y [z]", '{"a":1}\n{"b":2}\n{"c"}', "[tru\ne]", '[1, 2, // 3\n4]', "[ ]", '["\\ ,"]', "[" + RECORD.format(1) + ",\n\n\n" + RECORD.format(2) + "\n\n]\n",
]


def test_json_containers_are_cut_into_their_records(spark, docs):
    lines = same(spark, docs(*CONTAINERS).select("doc_id", "text"))
    events = {r.doc_id: r.n for r in lines.groups.groupBy("doc_id").agg(F.sum("repeats").alias("n")).collect()}
    assert events[2] == 40 and events[3] == 300 and events[4] == 1 and events[27] == 2


def test_a_json_array_of_any_size_is_read_as_one(spark, docs):
    """Larger than a row of 10 MiB: an array of one line, one of many lines, an object, and text that only looks like an array."""
    records = [RECORD.format("x" * 9_000 + str(k)) for k in range(700)]
    big = "[" + ",".join(records) + "]"
    assert len(big) > 10 << 20
    texts = [big, "[\n" + ",\n".join(records) + "\n]", '{"insertId":"1","severity":"INFO","textPayload":"a",\n"list":' + big + "}", big[:-1] + ",]"]
    lines = lp.prepare_lines(lp.raw_lines(docs(*texts).select("doc_id", "text")), 12_000)
    got = {r.doc_id: (r.detected_format, r.event_count) for r in lines.documents.collect()}
    label = got[0][0]
    assert "raw" not in label and got == {0: (label, 700), 1: (label, 700), 2: (label, 1), 3: ("unknown -> raw", 1)}
