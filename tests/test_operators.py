import json

from pyspark.sql import functions as F

from logmill.functions import text as tx
from logmill.operators import (
    audit, conversations as cv, corpus, lines as ln, parse as ps, prepare as pp, prompts, registry as rg,
    requests as rq,
)
from logmill.operators.ordering import extreme_rows, running_sum
from logmill.plans.catalog import BUILT_IN, Profile, parse_profiles, profiles_json
from logmill.queries import QUERIES
from logmill.session import run_folder
from logmill.sources import files, sinks


def by_id(name):
    return next(p for p in BUILT_IN if p.id == name)


def test_running_sum_matches_brute_force(spark):
    rows = [("hot", i, i % 7) for i in range(500)] + [("cold", i * 3, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, o bigint, v int")
    for descending in (False, True):
        got = {(r.k, r.o): r.s for r in running_sum(df, ["k"], "o", F.col("v"), "s", descending, size=16).collect()}
        for key in ("hot", "cold"):
            total = 0
            for k, o, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1], reverse=descending):
                total += v
                assert got[(k, o)] == total


def test_line_table_blocks_equal_in_row_blocks(docs):
    broker = "\r\n".join(
        f"[2026-01-01] {'ERROR' if i % 3 else 'INFO'} Kafka n{i} (kafka.server.X)" + ("\n\tat y" if i % 5 == 0 else "")
        for i in range(300))
    rust = "start\n" + "\n".join(f"error[E0{100 + i}]: bad\n  --> a.rs:{i}:1\n |" for i in range(40))
    for profile, text in (("kafka-broker-log4j", broker), ("cargo-rustc-error", rust)):
        table = docs(text, "no start at all\nx")
        lines = ln.to_lines(table.select("doc_id", tx.trim_space(tx.sanitized(F.col("text"))).alias("t")), "t")
        cut = ln.block_events(lines, by_id(profile), size=8)
        cols = ["doc_id", "source", "severity", "content", "fingerprint"]
        assert sorted(cut.select(cols).collect()) == sorted(ps.events(table).select(cols).collect())


def test_context_lines_equal_in_row_filter(docs):
    text = "\n".join(f"#{i} {'ERROR: x' if i in (0, 17, 18, 40) else 'step'}" for i in range(60)) + "\nERROR: failed to solve: z"
    table = docs(text)
    lines = ln.to_lines(table, "text")
    joined = ln.join_context(ln.context_lines(lines)).first().content
    assert joined == ps.events(table).first().content


def plain_history(messages, limit):
    left, out = max(limit, 1000), []
    for turn, text in reversed(messages):
        if left == 0:
            break
        if len(text) > left:
            note = cv.EARLIER_CUT
            text = text[len(text) - left:] if left <= len(note) else note + text[len(text) - (left - len(note)):]
        left -= len(text)
        out.append((turn, text))
    return out[::-1]


def test_bounded_history(spark):
    chats = {
        1: ["a" * 300] * 6, 2: ["b" * 5000], 3: ["c" * 990, "d" * 5, "e" * 990], 4: ["x", "y"],
        5: ["f" * 50, "g" * 1000, "h" * 0], 6: ["q" * 30, "i" * 985],
    }
    rows = [(c, t, "user", m) for c, ms in chats.items() for t, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {}
    for r in cv.bounded_history(df, 10, size=2).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.text))
    assert got == {c: plain_history(list(enumerate(ms)), 10) for c, ms in chats.items()}


def test_titles_and_trim(spark):
    rows = [(1, t, "user", f"m{t}\nrest") for t in range(120)] + [(2, 0, "user", " \n x"), (3, 0, "user", "z" * 40)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert cv.trim_history(df).filter("conv_id = 1").agg(F.min("turn"), F.count("*")).first() == (20, 100)
    assert cv.latest_message(df).filter("conv_id = 1").first().text == "m119\nrest"
    titles = {r.conv_id: r.title for r in cv.titles(df).collect()}
    assert titles[1] == "m0" and titles[3] == "z" * 28


def test_prompts_sections_and_answers(spark, docs):
    prepared = pp.prepare(docs("tiny unknown", "\n".join("word " * 50 for _ in range(40))), 3_000)
    rows = prompts.map_prompts(prepared).orderBy("doc_id", "batch_index").collect()
    assert rows[0].prompt == prompts.INSTRUCTION + "\n\ntiny unknown"
    assert rows[1].prompt.startswith("Log batch 1/") and rows[1].batch_total == len(rows) - 1
    answers = spark.createDataFrame(
        [(0, "CAUSE: a\nfix: b\nVerify:  c \nFIX: d"), (1, " plain text "), (2, "cause:\nx")], "i int, t string")
    got = [r.s for r in answers.orderBy("i").select(prompts.sections(F.col("t")).alias("s")).collect()]
    assert [tuple(s) for s in got] == [("a", "d", "c"), ("plain text", "", ""), ("cause:\nx", "", "")]
    body = {"output": [{"content": [{"type": "r"}]}, {"content": [{"text": "hi"}]}], "usage": {"input_tokens": 3}}
    shapes = [("responses", body), ("messages", {"content": [{"text": "m"}], "usage": {"prompt_tokens": 9}}),
              ("local", {"output": [{"type": "reasoning", "content": "no"}, {"type": "message", "content": " y "}],
                         "stats": {"input_tokens": 1, "total_output_tokens": 2}}), ("chat", {})]
    table = spark.createDataFrame([(i, p, json.dumps(b)) for i, (p, b) in enumerate(shapes)], "i int, p string, b string")
    out = [r.a for r in table.orderBy("i").select(prompts.answer(F.col("p"), F.col("b")).alias("a")).collect()]
    assert [(a.text, a.input_tokens, a.output_tokens) for a in out] == [
        ("hi", 3, None), ("m", None, None), ("y", 1, 2), (None, None, None)]
    line = spark.range(1).select(prompts.usage_line(
        F.lit(1000), F.lit(500), F.lit(1.0), F.lit(2.0), F.lit(12.34), F.lit(0.5)).alias("u")).first().u
    assert line == "Request 1000 tokens · Response 500 tokens · ≈$0.0020 · 12.3 tok/s · TTFT 0.50s"


def test_payload_shapes(spark):
    row = spark.range(1).select(*[
        prompts.payload(p, F.lit("gpt-5-a"), F.lit("sys"), F.lit("assistant"), F.lit('q"\n'), F.lit(9)).alias(p)
        for p in prompts.PROTOCOLS]).first()
    got = {p: json.loads(row[p]) for p in prompts.PROTOCOLS}
    assert got["responses"]["reasoning"] == {"effort": "low"} and got["responses"]["store"] is False
    assert got["chat"]["messages"][1] == {"role": "assistant", "content": 'q"\n'}
    assert got["generate_content"]["contents"][0] == {"role": "model", "parts": [{"text": 'q"\n'}]}
    assert got["messages"]["messages"][0]["content"][0]["type"] == "text"
    assert got["local"]["system_prompt"] == "sys"


def test_requests(spark, docs):
    log = "\n".join(f"02-09 07:08:09.101  1  2 E Tag: boom {i}" for i in range(50))
    rows = [
        ("a", None, log, None, None, None, None, True, None), ("b", None, log, "n.log", "RAW", None, 1, False, None),
        ("c", None, "who knows", None, "parsed", None, None, None, "cli"), ("d", None, log, None, "compare", 5, None, None, None),
        ("e", "/x", "y", None, None, None, None, None, None), ("f", None, "", None, None, None, None, None, None),
        ("g", None, log, None, "nope", None, None, None, None), ("h", "/r/a.log", None, None, None, None, None, None, None),
        ("i", "/r/none.log", None, None, None, None, None, None, None), ("j", None, "x" * 2000, None, None, None, None, None, None),
    ]
    loaded = spark.createDataFrame([("/r/a.log", log, None)], "path string, text string, error string")
    out = rq.respond(spark.createDataFrame(rows, rq.REQUEST), loaded, limit=1024 * 1).cache()
    got = {r.request_id: r for r in out.collect()}
    big = rq.respond(spark.createDataFrame(rows, rq.REQUEST), loaded).cache()
    ok = {r.request_id: r for r in big.collect()}
    assert got["j"].message == "inline text exceeds 1024 bytes" and ok["j"].status == "raw_fallback"
    assert ok["a"].sent_variant == "Parsed" and ok["a"].duplicates_removed == 49 and ok["a"].input_name == "inline.log"
    assert ok["b"].content == log and ok["b"].batch_count == 1
    assert ok["c"].sent_variant == "Raw fallback" and ok["c"].warnings == [rq.FALLBACK_WARNING]
    assert ok["d"].error_code == "batch_out_of_range" and ok["d"].message == "batch_index 5 is outside 0..1"
    assert ok["e"].error_code == ok["f"].error_code == ok["i"].error_code == "input_rejected"
    assert ok["g"].error_code == "invalid_mode" and ok["h"].input_name == "a.log" and ok["h"].status == "ok"
    rows = rq.audit_rows(big).collect()
    assert len(rows) == 10 and {r.client for r in rows} == {"mcp-client", "cli"}
    assert not {"content", "text"} & set(rows[0].asDict())
    kinds = {r.kind: r.name for r in sinks.artifact_rows(big).collect()}
    assert kinds == {"raw": "inline.log.raw.log", "parsed": "inline.log.parsed.log"}


def test_audit_of_own_rendering(docs):
    same = "\n".join(f"02-09 07:08:09.101  1  2 {'E' if i % 2 else 'I'} Tag: boom {i}" for i in range(20))
    both = docs(same, same + "\n continued")
    prepared = pp.prepare(both, 3_000)
    sides = audit.both_sides(prepared, tx.trim_space(F.col("clean")), F.col("parsed_preview")).cache()
    got = {r.doc_id: r for r in audit.verdicts(sides).collect()}
    assert got[0].status == "OK" and got[0].raw_events == got[0].parsed_events == 20
    assert got[1].status == "REVIEW" and got[1].missing_signatures > 0
    assert audit.corpus_result(audit.verdicts(sides)).first() == (1, 1)
    report = sinks.report_text(prepared).withColumn("p", audit.parsed_section(F.col("report")))
    assert report.filter("doc_id = 0").first().p == prepared.filter("doc_id = 0").first().parsed_preview
    groups = pp.event_groups(ps.parse(docs(same)))
    assert groups.agg(F.sum("repeats")).first()[0] == 20
    assert corpus.templates(ps.parse(docs(same, same))).agg(F.sum("total_repeats"), F.max("documents")).first() == (40, 2)


def plain_choose(lines, limit):
    import re
    hot = [x for x in lines if re.search(audit.PRIORITY, x)]
    cold = [x for x in lines if not re.search(audit.PRIORITY, x)]
    picked = hot[: limit // 2] + cold[: limit - min(len(hot), limit // 2)]
    return [x for x in picked if x.strip()]


def test_priority_sample(spark):
    groups = {"a": [f"error {i}" for i in range(9)] + [f"n{i}" for i in range(9)], "b": ["x", "", "warn"], "c": ["q"] * 20}
    rows = [(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, i bigint, line string")
    got = {g: [] for g in groups}
    for r in audit.priority_sample(df, "g", ["i"], 6).orderBy("g", F.desc("priority"), "i").collect():
        got[r.g].append(r.line)
    assert got == {g: plain_choose(xs, 6) for g, xs in groups.items()}


USER = Profile("my-app", "text", (("regex", "^APP "),), (), {"kind": "whole_text", "severity": "ERROR"})


def profile_file(profiles, **changes):
    raw = json.loads(profiles_json(profiles))
    raw.update(changes)
    return json.dumps(raw)


def test_registry_merge_overrides_and_disable(spark):
    user = spark.createDataFrame([
        ("/s/a.json", profile_file([USER])), ("/s/b.json", profile_file([USER])),
        ("/s/c.json", profile_file([USER.with_id("spark")])), ("/s/d.json", "not json"),
        ("/s/e.json", profile_file([USER.with_id("other")], schema_version=2)),
        ("/s/f.json", profile_file([USER.with_id("Bad Id")])),
    ], "path string, text string")
    changed = Profile("spark", "text", (("regex", "^SPK "),), (), {"kind": "whole_text", "severity": "WARN"}, application="New")
    over = spark.createDataFrame([
        ("/o/a.json", profile_file([changed])), ("/o/b.json", profile_file([USER.with_id("nobody")])),
        ("/o/c.json", profile_file([USER, USER.with_id("two")])),
    ], "path string, text string")
    reg = rg.load_registry(user, over, disabled=["hdfs"])
    assert len(reg.all) == len(BUILT_IN) + 1 and len(reg.profiles) == len(BUILT_IN)
    assert [p.id for p in reg.all].index("spark") == [p.id for p in BUILT_IN].index("spark")
    summary = {r[0]: r for r in reg.summary()}
    assert summary["spark"] == ("spark", "New", "override", True) and summary["hdfs"][3] is False
    assert summary["my-app"][2] == "user"
    text = "\n".join(reg.rejected)
    for part in ("b.json: format id already exists: my-app", "c.json: format id already exists: spark", "d.json", "e.json: expected",
                 "f.json: invalid format id", "unknown profile: nobody", "exactly one format"):
        assert part in text


def test_built_in_catalog_is_valid_and_round_trips(spark):
    assert rg.problems(list(BUILT_IN)) == []
    assert parse_profiles(profiles_json(list(BUILT_IN))) == list(BUILT_IN)
    broken = Profile("x", "text", (("regex", "(" ),), (), {"kind": "whole_text", "severity": "E"})
    assert rg.problems([broken])[0].startswith("invalid regex")
    for pattern, good in (("^[a[b]", False), ("^(?P<level>[A-Z]+) ", True), ("a++b", True)):
        only = Profile("x", "text", (("regex", pattern),), (), {"kind": "whole_text", "severity": "E"})
        assert (rg.problems([only]) == []) is good
    long = Profile("x", "text", (("regex", "a" * 2001),), (), {"kind": "whole_text", "severity": "E"})
    assert rg.problems([long])[0].startswith("invalid regex")


def test_draft_validation(docs):
    sample = docs("APP down", "other")
    rows = {r.doc_id: r for r in rg.validate_draft([USER], sample).collect()}
    assert rows[0].event_count == 1 and rows[0].error is None and rows[0].format_ids == ["my-app"]
    assert rows[1].error == "schema does not parse the supplied sample"
    clash = rg.validate_draft([USER.with_id("spark")], sample).first()
    assert clash.error == "built-in format id already exists: spark"
    update = rg.validate_draft([USER], sample, target="spark")
    assert update.filter("doc_id = 0").first().format_ids == ["spark"]
    assert "exactly one" in rg.validate_draft([USER, USER], sample, target="spark").first().error


def test_file_scan(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "inner").mkdir()
    (tmp_path / "in" / "a.log").write_text("fatal: not a git repository\n")
    (tmp_path / "in" / "sub" / "b.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "in" / "big.log").write_text("x" * 2000)
    (tmp_path / "in" / "shot.PNG").write_text("img")
    (tmp_path / "inner" / "c.log").write_text("c")
    got = {r.name: r for r in files.read_logs(spark, str(tmp_path), limit=1, roots=[str(tmp_path / "in")]).collect()}
    assert got["a.log"].text.startswith("fatal") and got["a.log"].error is None
    assert got["b.txt"].error == "file is not valid UTF-8" and got["b.txt"].text is None
    assert got["big.log"].error == "file exceeds 1024 bytes"
    assert got["c.log"].error == "path is outside the allowed roots"
    docs = files.documents_from(files.read_logs(spark, str(tmp_path / "in")))
    assert sorted(r.name for r in docs.select("name").collect()) == ["a.log", "big.log"]
    assert ps.outcomes(docs).filter("detected_format = 'git-cli-error'").count() == 1


def test_profile_and_coverage_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "u.json").write_text(profile_file([USER]))
    (tmp_path / "p" / "skip.txt").write_text("no")
    reg = rg.load_registry(files.read_profile_files(spark, str(tmp_path / "p")))
    assert reg.profiles[-1].id == "my-app" and not reg.rejected
    (tmp_path / "c.csv").write_text("rank,volume,application,coverage,adapter_or_gap\n1,high,A,covered,x\n2,high,B,raw,\n2,low,C,partial,\n")
    table = files.read_coverage(spark, str(tmp_path / "c.csv"))
    assert corpus.coverage_counts(table).first() == (1, 1, 1, 3)
    assert sorted((r.rank, r["rows"]) for r in corpus.coverage_gaps(table, 3).collect()) == [(2, 2), (3, 0)]
    assert corpus.coverage_report(table).first().line == "| 1 | high | A | covered | x |"


def test_sinks(spark, docs, tmp_path):
    prepared = pp.prepare(docs("fatal: not a git repository", "x"), 3_000)
    sinks.write_review(prepared, str(tmp_path / "review"))
    assert spark.read.json(str(tmp_path / "review" / "summary")).count() == 2
    assert spark.read.parquet(str(tmp_path / "review" / "reports")).count() == 2
    rows = spark.createDataFrame([("a", None, "hi", None, None, None, None, True, None)], rq.REQUEST)
    out = rq.respond(rows)
    for _ in range(2):
        sinks.write_audit(rq.audit_rows(out), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    sinks.write_artifacts(out, str(tmp_path / "art"))
    assert spark.read.parquet(str(tmp_path / "art")).count() == 2
    drafts = spark.createDataFrame([("i", "a.log", "p", "m", 5, "ans", "{}")],
                                   "id string, source_log string, provider string, model string, "
                                   "sample_chars_sent int, model_answer string, validated_schema string")
    sinks.write_draft_envelopes(drafts, str(tmp_path / "env"))
    assert spark.read.json(str(tmp_path / "env")).first().metadata_version == 1


def test_no_shuffle_in_preparation(docs):
    plan = pp.summary(pp.prepare(docs("a"), 3_000))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_extreme_rows(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), (None, 2, "z"), (None, 5, None), ("b", 7, "w")]
    df = spark.createDataFrame(rows, "k string, o bigint, v string")
    assert sorted(map(tuple, extreme_rows(df, ["k"], "o").collect()), key=repr) == sorted([rows[0], rows[2], rows[4]], key=repr)
    assert sorted(map(tuple, extreme_rows(df, ["k"], "o", newest=True).collect()), key=repr) == sorted([rows[1], rows[3], rows[4]], key=repr)


def test_no_sort_aggregate_over_texts(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("corpus_templates", "latest_questions", "conversation_titles", "profile_lookup", "profile_restore", "stream_templates"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan, name


def test_multisets_count_repeats(spark):
    def side(doc, name, *events):
        return [(doc, name, text, level, n) for text, level, n in events]

    a, b = ("one 1", "INFO"), ("two", "ERROR")
    rows = [
        *side(1, "raw", (*a, 1), (*a, 1), (*b, 1)), *side(1, "parsed", ("ONE 27", "INFO", 2), (*b, 1)),
        *side(2, "raw", (*a, 1), (*a, 1), (*b, 1)), *side(2, "parsed", (*a, 1), (*b, 2)),
        *side(3, "raw", (*a, 1)), *side(3, "parsed", ("one 1", "WARNING", 1)), (4, None, None, None, None),
    ]
    sides = spark.createDataFrame(rows, "doc_id bigint, side string, text string, level string, n bigint")
    got = {r.doc_id: (r.raw_events, r.parsed_events, r.equal, r.severity_ok) for r in audit.multisets(audit.hashed(sides)).collect()}
    assert got == {1: (3, 3, True, True), 2: (3, 3, False, False), 3: (1, 1, True, False), 4: (0, 0, True, True)}


def test_summaries_without_texts_equal_those_of_prepared_documents(docs):
    odd = docs("", "\n", "a\n\n", "x" * 9_000 + "\ny", "é" * 3_000 + "\n" + "z" * 2_999 + "\n", "y\n" * 4_000,
               "\n".join(f"02-09 07:08:09.101  1  2 {'E' if i % 2 else 'I'} Tag: boom {chr(97 + i % 26) * (i % 90)}" for i in range(300)))
    for budget in (3_000, 12_000):
        want = sorted(map(tuple, pp.summary(pp.prepare(odd, budget)).collect()))
        assert sorted(map(tuple, pp.summarized(odd, budget).collect())) == want


def test_registry_of_very_many_files(spark):
    """More files than any list on the driver should hold; what clashes is refused by table operations."""
    raw = profile_file([USER])
    rows = spark.range(12_000).select(
        F.format_string("/s/%06d.json", "id").alias("path"), F.replace(F.lit(raw), F.lit('"my-app"'), F.concat(F.lit('"p'), F.col("id") % 5, F.lit('"'))).alias("text")
    )
    reg = rg.load_registry(rows)
    assert [p.id for p in reg.all[len(BUILT_IN) :]] == [f"p{k}" for k in range(5)]
    assert reg.rejections.count() == 11_995


def test_folders_are_written_by_many_tasks_and_whole(spark):
    """Rows of one partition: the folders are dealt over the tasks, rows of a folder stay in one file."""
    rows = spark.range(40).coalesce(1).selectExpr("id % 20 as k", "if(id % 20 = 3, null, id % 3) as j", "concat('t', id % 20) as value")
    path = run_folder(spark, "test-folders")
    sinks.write_folders(rows, path, ["k", "j"])
    read = spark.read.text(path, recursiveFileLookup=True).select("value", F.input_file_name().alias("file"))
    assert sorted(r.value for r in read.collect()) == sorted(f"t{k % 20}" for k in range(40))
    names = [r.file.rsplit("/", 1)[1] for r in read.select("file").distinct().collect()]
    assert len({n.split("-")[1] for n in names}) > 1
    assert read.groupBy(F.regexp_extract("file", "(k=.*)/", 1).alias("folder")).agg(F.count_distinct("file").alias("n")).filter("n > 1").count() == 0


def test_path_requests_scan_the_files_once(spark, tmp_path):
    """The answers are joined from files that were read once, whatever the number of joins."""
    spark.createDataFrame([(k, f"Supplier{k}", 1.5) for k in range(1, 9)], "s_suppkey bigint, s_name string, s_acctbal double").write.parquet(
        str(tmp_path / "supplier.parquet")
    )
    answers = QUERIES["path_requests"](spark, str(tmp_path))
    assert not [f for f in answers.inputFiles() if "supplier-logs" in f]
    assert answers.count() == 8
