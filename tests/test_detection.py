import re

from pyspark.sql import functions as F

from logmill.operators.corpus import ambiguous, format_usage, golden_mismatches
from logmill.operators.parse import events, outcomes, parse
from logmill.plans.catalog import BUILT_IN, Profile
from logmill.plans.detect import openers, regex_condition
from logmill.plans.required import REQUIRED, STARTS
from tests.samples import SAMPLES, UNKNOWN


def test_every_profile_has_a_sample():
    assert {p.id for p in BUILT_IN} == {name for name, _ in SAMPLES}


def test_every_sample_gets_its_format(spark, docs):
    expected = spark.createDataFrame(
        [(i, name) for i, (name, _) in enumerate(SAMPLES)], "doc_id bigint, expected_format string"
    )
    found = outcomes(docs(*[text for _, text in SAMPLES])).cache()
    assert golden_mismatches(found, expected).collect() == []
    assert found.filter("event_count = 0 or not supported").count() == 0
    assert ambiguous(found).count() == 0
    assert format_usage(found, BUILT_IN).count() == len(BUILT_IN)


def test_required_texts_never_exclude_a_match():
    checked = 0
    for profile in BUILT_IN:
        for kind, pattern in profile.all + profile.any:
            if kind != "regex":
                continue
            texts = REQUIRED.get(pattern, ())
            for _, sample in SAMPLES:
                if texts and re.search(pattern, sample, re.M):
                    checked += 1
                    assert any(t in sample for t in texts), (pattern, texts)
    assert checked > 60


def test_first_characters_never_exclude_a_match(spark, docs):
    checked = 0
    for pattern, first in STARTS.items():
        for _, sample in SAMPLES:
            for match in re.finditer(pattern, sample, re.M):
                checked += 1
                assert re.match(first, match[0]), (pattern, first)
    assert checked > 40
    texts = [text for _, text in SAMPLES] + ["\n" + text for _, text in SAMPLES] + ["\n\n  at x", "a\n\n\tat x", "é\n \n=> b", ""]
    rows = docs(*texts).withColumn("first", openers(F.split("text", "\n")))
    text = F.col("text")
    wrong = [F.count_if(regex_condition(text, p) != regex_condition(text, p, F.col("first"))).alias(f"p{k}") for k, p in enumerate(STARTS)]
    assert set(rows.agg(*wrong).first()) == {0}


def test_unknown_documents_fall_back(docs):
    rows = {r.doc_id: r for r in outcomes(docs(*UNKNOWN)).collect()}
    assert all(r.detected_format == "unknown -> raw" and not r.supported for r in rows.values())


def test_one_bad_record_spoils_the_document(docs):
    good = '{"insertId":"1","textPayload":"a"}'
    rows = outcomes(docs(f"[{good},{{}},{good}]", f"{good}\n\n{good}\n", f"{good} {good}", f"[{good}]x")).collect()
    by_doc = {r.doc_id: r for r in rows}
    assert by_doc[0].detected_format == "gcp-text-payload -> raw" and not by_doc[0].supported
    assert by_doc[1].supported and by_doc[1].event_count == 2
    assert by_doc[2].detected_format == "unknown -> raw"
    assert by_doc[3].detected_format == "unknown -> raw"


def test_equal_scores_take_the_later_profile(docs):
    both = '{"insertId":"1","textPayload":"x","httpRequest":{"status":200}}'
    assert outcomes(docs(both)).first().detected_format == "gcp-text-payload"
    user = Profile("mine", "text", (("regex", "^npm ERR!"),), (), {"kind": "whole_text", "severity": "WARN"})
    row = events(docs("npm ERR! x"), profiles=[*BUILT_IN, user]).first()
    assert row.severity == "WARNING"
    assert outcomes(docs("npm ERR! x"), profiles=[*BUILT_IN, user]).first().detected_format == "mine"


def severities(docs, *texts):
    rows = events(docs(*texts)).orderBy("doc_id", "seq").collect()
    return [(r.source, r.severity, r.content) for r in rows]


def test_json_events(docs):
    sample = dict(SAMPLES)
    rows = severities(docs, sample["mongodb-json-log"], sample["gcp-http-request"],
                      sample["gcp-proto-payload-audit"], sample["gcp-text-payload"],
                      sample["gcp-json-payload"], sample["elastic-ecs-server-json"])
    assert rows == [
        ("JSON item 1 / MongoDB", "WARNING", '2026 WARNING NET slow 12 attr={"a":2,"b":1}'),
        ("JSON item 1", "CRITICAL", "no timestamp CRITICAL GET /x status=502"),
        ("JSON item 1 / protoPayload", "ERROR", "no timestamp ERROR s m"),
        ("JSON item 1 / textPayload", "ERROR", "no timestamp ERROR GET / 404 done"),
        ("JSON item 1 / jsonPayload", "INFO", "no timestamp INFO all fine"),
        ("JSON item 1 / Elastic ECS", "ERROR", "t ERROR m dataset=elasticsearch.server"),
    ]


def test_json_nulls_and_duplicate_keys(docs):
    text = '{"insertId":"1","severity":null,"httpRequest":{"status":200,"requestUrl":null,"requestUrl":"/b"}}'
    row = events(docs(text)).first()
    assert row.content == "no timestamp INFO /b status=200"
    assert row.fingerprint == "null|/b|200"


def test_level_word_in_message_hides_label(docs):
    row = events(docs('{"insertId":"1","textPayload":"WARN  disk   full"}')).first()
    assert (row.severity, row.content) == ("WARNING", "no timestamp WARN disk full")


def test_block_events(docs):
    rows = severities(docs, dict(SAMPLES)["cargo-rustc-error"], dict(SAMPLES)["kafka-broker-log4j"],
                      dict(SAMPLES)["mysql-error-log"], dict(SAMPLES)["nginx-access"])
    assert rows[0] == ("line 1", "INFO", "Compiling demo")
    assert rows[1][:2] == ("lines 2-5", "ERROR")
    assert rows[2] == ("lines 1-2", "ERROR", "[2026-01-01] ERROR [Broker id=1] x (kafka.server.KafkaApis)\n    at y")
    assert rows[3][1] == "ERROR"  # "Note" is no level word: the content decides
    assert rows[4][1] == "ERROR"  # access status 503


def test_leading_lines_without_start_are_dropped(docs):
    text = "x\n02-09 07:08:09.101  1  2 E Tag: a\n  more\n02-09 07:08:09.102  1  2 I Tag: b"
    assert [(s, v) for s, v, _ in severities(docs, text)] == [("lines 2-3", "ERROR"), ("line 4", "INFO")]


def test_build_context_and_flow_lines(docs):
    build = "\n".join(["#1 a", "#2 b", "#3 c", "#4 d", "#5 ERROR: x", "#6 e", "#7 f", "#8 g", "ERROR: failed to solve: y"])
    (row,) = severities(docs, build)
    assert row[0] == "lines 1-9"
    assert row[2].startswith("… omitted successful BuildKit steps …\n#3 c\n#4 d\n#5 ERROR: x")
    flow = dict(SAMPLES)["aws-vpc-flow-default"]
    rows = severities(docs, f"{flow}\nshort line\n\n" + flow.replace("REJECT OK", "- SKIPDATA"))
    assert [(s, v) for s, v, _ in rows] == [("line 1", "ERROR"), ("line 4", "WARNING")]
    assert rows[0][2].endswith("action=REJECT log-status=OK")


def test_validation_flags_can_be_off(docs):
    loose = Profile("loose", "text", (("regex", "^zz"),), (),
                    {"kind": "line_blocks", "start_regex": "^never", "severity_capture": "",
                     "default_severity": "INFO"}, require_events=False)
    row = parse(docs("zz"), [loose]).select("supported", F.size("events").alias("n")).first()
    assert row.supported and row.n == 0
