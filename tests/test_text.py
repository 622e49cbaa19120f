from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from logmill.functions import batching, fingerprint as fp, severity as sv, text as tx
from logmill.functions.records import json_records, strict_json
from logmill.operators.prepare import batch_rows, deduplicate, prepare, prepare_raw, summary

SPACE = set(tx.WHITE_SPACE)
QUICK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def apply(spark, values, build, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def lines_of(text):
    if text == "":
        return []
    return (text[:-1] if text.endswith("\n") else text).split("\n")


def plain_normalize(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")

    def rstrip(line):
        while line and line[-1] in SPACE:
            line = line[:-1]
        return line

    return "\n".join(rstrip(x).replace("\t", "    ") for x in lines_of(text))


def plain_redact(line):
    for marker in tx.MARKERS:
        start = line.lower().find(marker.lower())
        if start >= 0:
            begin = start + len(marker)
            end = next((i for i in range(begin, len(line)) if line[i] in SPACE), len(line))
            line = line[:begin] + "[REDACTED]" + line[end:]
    return line


TEXTS = [
    "", "\n", "\n\n", "a", "a\n", "a \t\nb  \n\nc", "x\r\ny\rz\r", "\ta\tb\t", "é \n ü\t",
    "password=abc d password=e", "Bearer x\nAPI_KEY=1 apikey=2 token=", "BEARER  y", "Token=x y\tz",
    "no secrets here", "bearer token=abc", "a\x0b\nb\x0c", "😀 password=😀😀 x",
]


def test_normalize_and_redact_match_brute_force(spark):
    assert apply(spark, TEXTS, tx.normalize_newlines) == [plain_normalize(t) for t in TEXTS]
    want = ["\n".join(plain_redact(x) for x in plain_normalize(t).split("\n")) for t in TEXTS]
    assert apply(spark, TEXTS, tx.sanitized) == want


@QUICK
@given(st.lists(st.text(alphabet="ab \t\r\n é=pasword", max_size=60), min_size=20, max_size=40))
def test_sanitized_random(spark, texts):
    want = ["\n".join(plain_redact(x) for x in plain_normalize(t).split("\n")) for t in texts]
    assert apply(spark, texts, tx.sanitized) == want


def test_truncation(spark):
    long = "x" * 700 + "y" * 700
    assert apply(spark, ["short", long], lambda c: tx.keep_tail(c, 100)) == [
        "short", tx.HEAD_CUT + "y" * (100 - len(tx.HEAD_CUT))]
    sample = apply(spark, [long], lambda c: tx.bounded_sample(c, 10))[0]
    assert sample == "x" * 500 + tx.MIDDLE_CUT + "y" * 500
    assert apply(spark, ["a/b c", "", "x" * 99], tx.safe_name) == ["a_b_c", "input", "x" * 80]
    assert apply(spark, ["", "a", "abcd"], lambda c: tx.token_estimate(F.length(c))) == [0, 1, 2]


def test_masks(spark):
    line = "10.0.0.1 a.b@c.org 123e4567-e89b-42d3-a456-426614174000  "
    assert apply(spark, [line], tx.mask_pii) == ["<IP> <EMAIL> <UUID>"]
    assert apply(spark, ["josé@mail.example.org, jürgen@büro.de x1.1.1.1 a@b.orgé"], tx.mask_pii) == [
        "<EMAIL>, <EMAIL> x1.1.1.1 a@b.orgé"]
    assert apply(spark, ["k=s3 s3"], lambda c: tx.mask_literals(c, ["s3", ""])) == ["k=[REDACTED] [REDACTED]"]
    assert apply(spark, ['token = "x" and password=y'], tx.redact_extended) == [
        "token = [REDACTED] and password=[REDACTED]"]


def test_severity_tables(spark):
    unknown = lambda c: sv.text_severity(F.lit("UNKNOWN"), c)
    texts = ["kernel PANIC", "it failed", "warned", '"GET /" 404 x', "an info line", "information", "Error"]
    assert apply(spark, texts, unknown) == [
        "CRITICAL", "ERROR", "WARNING", "ERROR", "INFO", "UNKNOWN", "ERROR"]
    levels = ["v", "f", "severe", "3", "7", "note", "warning"]
    assert apply(spark, levels, lambda c: sv.text_severity(c, F.lit(""))) == [
        "INFO", "CRITICAL", "ERROR", "UNKNOWN", "UNKNOWN", "UNKNOWN", "WARNING"]
    assert apply(spark, levels, sv.level_word_severity) == [
        "UNKNOWN", "CRITICAL", "ERROR", "ERROR", "INFO", "UNKNOWN", "WARNING"]
    assert apply(spark, ["a 99 +200 500", "x 0404 y", "none", "99999999999999999999"], sv.http_status) == [
        200, 404, None, None]
    raw = ["x [error] y", "03-17 16:13:38.8 1 2 D tag", "2026-02-16 11:12:10, Info    CBS x", "a WARN b", "odd"]
    assert apply(spark, raw, sv.raw_line_level) == ["ERROR", "INFO", "INFO", "WARNING", "UNKNOWN"]


def test_fingerprints(spark):
    assert apply(spark, ["Abc 12 3É", "x9y", "K١"], fp.fingerprint) == ["abc # #É", "x#y", "k١"]
    assert apply(spark, ["PASSWORD=a1 Token=b É9 "], fp.audit_signature) == ["password=[redacted] token=[redacted] é#"]


STRICT = {
    '{"a":1}': True, '{"a":1} x': False, "2 123 x": False, "[]": True, "[]\nerror: x": False, "": False,
    "1],[2": False, "1]": False, '"s"': True, "1,2": False, '{"a":1}}': False, " [1, 2] ": True, "nul": False,
    '{"a":1,"a":2}': True, "1} , {": False, "true": True, "abc": False, "-1": True,
}


def test_strict_json(spark):
    got = apply(spark, list(STRICT), lambda c: strict_json(c).isNotNull())
    assert dict(zip(STRICT, got)) == STRICT
    docs = ['[1,{"a":2}]', '{"a":1}', '1\n\n2', "1", '{"a":1}\nx', "[]", '{"a":1}\n{"b":2}\n']
    counts = apply(spark, docs, lambda c: F.size(json_records(c)))
    assert [None if n in (-1, None) else n for n in counts] == [2, 1, 2, None, None, 0, 2]


def plain_raw_batches(text, budget):
    out, cur, lines = [], "", lines_of(text)
    for i, line in enumerate(lines):
        last = i == len(lines) - 1
        line += "" if last and not text.endswith("\n") else "\n"
        if cur and len(cur) + len(line) > budget:
            out.append(cur)
            cur = ""
        if len(line) > budget:
            for ch in line:
                if len(cur) == budget:
                    out.append(cur)
                    cur = ""
                cur += ch
        else:
            cur += line
    return out + ([cur] if cur else [])


def plain_event_batches(pieces, budget):
    out, cur = [], ""
    for p in pieces:
        if cur and len(cur) + len(p) + 2 > budget:
            out.append(cur)
            cur = ""
        cur += ("\n\n" if cur else "") + p
    return out + ([cur] if cur else [])


@QUICK
@given(st.lists(st.text(alphabet="ab\n😀", max_size=90), min_size=15, max_size=30), st.integers(1, 12))
def test_raw_batches_random(spark, texts, budget):
    got = apply(spark, texts, lambda c: batching.raw_batches(c, F.lit(budget)))
    assert got == [plain_raw_batches(t, budget) for t in texts]
    assert ["".join(g) for g in got] == texts


@QUICK
@given(st.lists(st.lists(st.text(alphabet="xy", min_size=1, max_size=9), max_size=12), min_size=10, max_size=20),
       st.integers(1, 25))
def test_event_batches_random(spark, groups, budget):
    got = apply(spark, groups, lambda c: batching.event_batches(c, F.lit(budget)), "v array<string>")
    assert got == [plain_event_batches(g, budget) for g in groups]


def test_budget_clamp(spark):
    got = apply(spark, [None, 1, 4_000, 90_000], batching.clamp_budget, "v int")
    assert got == [12_000, 3_000, 4_000, 50_000]


@QUICK
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=20), min_size=5, max_size=15))
def test_deduplicate_random(spark, groups):
    rows = [(i, [("s%d" % j, "INFO", f"c{j}", f) for j, f in enumerate(g)]) for i, g in enumerate(groups)]
    df = spark.createDataFrame(
        rows, "i int, v array<struct<source:string,severity:string,content:string,fingerprint:string>>")
    got = [r.out for r in df.select("i", deduplicate(F.col("v")).alias("out")).orderBy("i").collect()]
    for g, out in zip(groups, got):
        assert [(x.fingerprint, x.first, x.repeats) for x in out] == [
            (f, g.index(f), g.count(f)) for f in dict.fromkeys(g)]


def test_prepare_variants(docs):
    raw_better = "fatal: not a git repository (or any parent): .git"
    repeated = "\n".join(f"03-17 16:13:38.{i:03d}  1  2 E Tag: boom {i}" for i in range(30))
    unknown = "hello password=secret \nworld"
    got = {r.doc_id: r for r in prepare(docs(raw_better, repeated, unknown), 3_000).collect()}
    assert got[0].selected_variant == "Raw" and got[0].batches == [raw_better]
    assert got[1].selected_variant == "Parsed" and got[1].duplicate_count == 29
    assert "repeated 30 times" in got[1].parsed_preview and got[1].important_events == 30
    assert got[2].detected_format == "unknown -> raw" and got[2].batches == ["hello password=[REDACTED]\nworld"]
    assert got[2].original_chars == len(unknown) and not got[2].normalized
    same = prepare(docs(unknown), 3_000, parity=True).first()
    assert same.batches == [unknown] and same.parsed_preview == unknown


def test_prepare_raw(docs):
    rows = {r.doc_id: r for r in prepare_raw(docs("short", "x" * 50), 20).collect()}
    assert rows[0].batches == ["short"] and rows[0].error is None
    assert rows[1].batches is None and rows[1].error.startswith("Raw log has 50 characters")


def test_batches_respect_budget(docs):
    text = "\n".join(f"03-17 16:13:38.{i % 1000:03d}  1  2 E Tag: {'abcdefghij'[i % 10] * (i % 90)} z" for i in range(900))
    prepared = prepare(docs(text), 3_000)
    sizes = [len(r.content) for r in batch_rows(prepared).collect()]
    assert sizes and max(sizes) <= 3_000
    assert summary(prepared).first().batch_count == len(sizes)


def test_large_documents_stay_linear(docs):
    prose = "\n".join("word " * (i % 30) for i in range(40_000))
    log = "\n".join(f"02-09 07:08:09.101  1  2 E Tag: {'xy'[i % 2] * (i % 400)}{i % 3 * 'z'}" for i in range(20_000))
    got = {r.doc_id: r for r in prepare(docs(prose, log), 3_000).collect()}
    clean = plain_normalize(prose)
    assert got[0].batches == plain_raw_batches(clean, 3_000)
    assert got[1].event_count == 20_000 and "".join(got[1].batches)
    lines = log.split("\n")
    kinds = {fp_text(x) for x in lines}
    assert got[1].duplicate_count == 20_000 - len(kinds)


def fp_text(text):
    import re
    return re.sub("[0-9]+", "#", text.lower())
