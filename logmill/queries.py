"""The registered queries: every operator applied to whole tables, or to corpora made from them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from logmill.functions import batching, fingerprint as fp, records, severity, text as tx
from logmill.operators import (
    audit, conversations, corpus, line_prepare as lp, lines as ln, parse as ps, prepare as pp, prompts, registry, requests,
)
from logmill.operators.ordering import RANGE, extreme_rows
from logmill.operators.profile_store import ProfileStore
from logmill.plans import extract
from logmill.plans.catalog import BUILT_IN, Profile
from logmill.plans.detect import matching_formats
from logmill.plans.profile_texts import profile_corpus
from logmill.plans.synth import documents, log_corpus, order_corpus, owner_lines, spread
from logmill.session import configure, run_folder, written
from logmill.sources import files, lines as ls, sinks
from logmill.streaming import blocks as sb, lines as sl

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SMALL_BUDGET = 3_000

ORDER_PROFILE = Profile(
    "pipe-orders", "text",
    (("regex", r"^\d+\|[OFP]\|\d+\|\d-"),), (("regex", "URGENT|HIGH|MEDIUM|LOW|NOT SPECIFIED"),),
    {"kind": "delimited_lines", "delimiter": "pipe",
     "fields": ["order", "status", "price", "priority"],
     "severity_rules": [
         {"field": "status", "values": ["p"], "severity": "ERROR"},
         {"field": "priority", "values": ["1-URGENT", "2-HIGH"], "severity": "WARNING"},
     ],
     "default_severity": "INFO"},
)
COMMA_PROFILE = Profile(
    "comma-orders", "text", (("regex", r"^\d+,[OFP],\d+,\d-"),), ORDER_PROFILE.any,
    {**ORDER_PROFILE.parser, "delimiter": "comma"},
)


def by_id(profile_id: str) -> Profile:
    return next(p for p in BUILT_IN if p.id == profile_id)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sources and requests -------------------------------------------------------------------

def supplier_files(spark, sf_dir) -> str:
    """A folder with one log file per supplier: short, over 1 KiB, or not UTF-8."""
    root = run_folder(spark, "supplier-logs")
    kind = F.col("s_suppkey") % 7
    line = F.concat(F.lit("note "), F.col("s_name"), F.lit(" balance "), F.floor("s_acctbal"))
    text = (
        F.when(kind == 1, F.concat(line, F.repeat(F.lit("x"), 1_100)))
        .when(kind == 2, F.concat(line, F.unhex(F.lit("FF")).cast("string"))).otherwise(line)
    )
    rows = table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_suppkey") % 5 == 4, "out").otherwise("in").alias("place"),
        F.col("s_suppkey").alias("supplier"), text.alias("value"),
    )
    sinks.write_folders(rows, root, ["place", "supplier"])
    return files.qualified(spark, root)


def supplier_of(path: F.Column) -> F.Column:
    return F.regexp_extract(path, "supplier=([0-9]+)", 1).cast("bigint").alias("supplier")


@query
def file_scan(spark, sf_dir):
    """Whole-file scan of a folder with allowed roots, a size limit and the UTF-8 check."""
    root = supplier_files(spark, sf_dir)
    read = files.read_logs(spark, root, limit=1_024, roots=[f"{root}/place=in"])
    return read.select(supplier_of(F.col("path")), "length", "text", "error")


@query
def path_requests(spark, sf_dir):
    """Requests for files: found, missing, folders, outside the roots, too large, not UTF-8."""
    root = supplier_files(spark, sf_dir)
    loaded = written(files.read_logs(spark, root, limit=1_024, roots=[f"{root}/place=in"]), "supplier-texts")
    kind = F.col("supplier") % 7
    found = loaded.select(supplier_of(F.col("path")), "path")
    path = (
        F.when(kind == 3, F.concat("path", F.lit(".old")))
        .when(kind == 4, F.regexp_replace("path", "/[^/]+$", "/")).otherwise(F.col("path"))
    )
    asked = found.select(
        F.col("supplier").cast("string").alias("request_id"), path.alias("path"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("name"),
        F.when(kind == 5, "best").otherwise("raw").alias("mode"), F.lit(None).cast("int").alias("batch_index"),
        F.lit(4_000).alias("batch_chars"), F.lit(False).alias("save_artifacts"),
        F.lit(None).cast("string").alias("client"),
    )
    return requests.respond(asked, files=loaded, limit=1_024).select(
        "request_id", "error_code", "message", "raw_chars", "content"
    )


@query
def coverage_files(spark, sf_dir):
    """A coverage list written as CSV and read back."""
    root = run_folder(spark, "coverage")
    coverage_table(spark, sf_dir).write.option("header", True).csv(root)
    return files.read_coverage(spark, root)


def profile_rows(spark, sf_dir) -> DataFrame:
    """Files of many profiles: the parts of one brand and last digit of size."""
    name = F.concat(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-")), F.lit("-"), F.col("p_size") % 10)
    pid = F.concat(F.lit("p-"), F.lower(F.regexp_replace("p_type", "[^A-Za-z0-9]+", "-")), F.lit("-"), F.col("p_size"))
    return table(spark, sf_dir, "part").select(name.alias("file"), "p_partkey", pid.alias("id"))


@query
def profile_files(spark, sf_dir):
    """Profile files written to a folder, read back as formats."""
    root = run_folder(spark, "profiles")
    grouped = profile_rows(spark, sf_dir).groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "id"))).alias("parts")
    )
    grouped.select(
        "file", F.lit(3).alias("schema_version"), F.lit("raw").alias("fallback"),
        F.transform("parts", lambda p: F.struct(p["id"].alias("id"), F.lit("text").alias("record_kind"))).alias("formats"),
    ).write.partitionBy("file").json(root)
    rows = registry.read_formats(files.read_profile_files(spark, root))
    return rows.select(
        F.regexp_extract("path", "file=([^/]+)/", 1).alias("file"), F.col("position").cast("bigint").alias("position"),
        "id", F.col("format_count").cast("bigint").alias("format_count"),
    )


@query
def profile_file_merge(spark, sf_dir):
    """Files of many profiles taken or rejected whole, in path order."""
    rows = profile_rows(spark, sf_dir).select(F.col("file").alias("path"), F.col("p_partkey").alias("position"), "id")
    existing = rows.filter("position % 97 = 1").select(F.concat("id", F.lit("")).alias("id"))
    return registry.merge_files(existing.filter(F.endswith("id", F.lit("7"))), rows)


def page_paths(spark, sf_dir) -> DataFrame:
    """Server paths of the pages: host and path of the url as folders."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", "/"), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", "url", path.alias("path"))


@query
def path_routes(spark, sf_dir):
    """Allowed-root test, suffix and route of page paths."""
    roots = ["/m.ththth.example.net", "/ththre.example.com/fr"]
    path = F.col("path")
    return page_paths(spark, sf_dir).select(
        "page_id", files.suffix(path).alias("suffix"), files.route(path).alias("route"),
        files.under_roots(path, roots).alias("allowed"),
    )


@query
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query
def json_containers(spark, sf_dir):
    """JSON documents and their record counts; text documents have none."""
    docs = log_corpus(spark, sf_dir)
    found = tx.sealed(docs, ["doc_id"], {"records": records.json_records(tx.trim_space(F.col("text")))})
    return found.select(
        "doc_id", F.col("records").isNotNull().alias("is_json"),
        F.when(F.col("records").isNull(), 0).otherwise(F.size("records")).cast("bigint").alias("records"),
    )


def request_table(spark, sf_dir) -> DataFrame:
    """One request per corpus document: all modes, page numbers, budgets and bad requests."""
    d = F.col("doc_id")
    user = F.floor(d / 1_000_000)
    mode = F.element_at(
        F.array(*[F.lit(m) for m in ("auto", "RAW", "parsed", "compare", "auto", "best")]),
        (user % 6 + 1).cast("int"),
    )
    return log_corpus(spark, sf_dir).select(
        F.concat(F.lit("r"), d).alias("request_id"),
        F.when(user % 23 == 5, F.lit("/logs/x.log")).alias("path"),
        F.when(user % 29 == 7, "").when(user % 31 == 8, F.lit(None)).otherwise(F.col("text")).alias("text"),
        F.when(user % 3 != 0, F.col("name")).alias("name"),
        F.when(user % 7 != 3, mode).alias("mode"),
        F.when(user % 5 == 2, 1).alias("batch_index"),
        F.when(user % 2 == 0, 1_000).otherwise(F.lit(4_000)).alias("batch_chars"),
        (user % 4 == 1).alias("save_artifacts"),
        F.lit(None).cast("string").alias("client"),
    )


@query
def request_validation(spark, sf_dir):
    return requests.validate(request_table(spark, sf_dir)).select(
        "request_id", "requested_mode", "input_name", "error_code", "message"
    )


@query
def request_responses(spark, sf_dir):
    """Mode selection, paging and measures of every request."""
    out = requests.public_columns(requests.respond(request_table(spark, sf_dir)))
    return out.select(
        "request_id", "input_name", "requested_mode", "status", "detected_format", "sent_variant",
        "raw_chars", "parsed_chars", "raw_tokens_estimate", "parsed_tokens_estimate",
        F.round("reduction_percent", 4).alias("reduction_percent"),
        "event_count", "important_events", "duplicates_removed", "batch_index", "batch_count",
        "batch_chars", "batch_tokens_estimate", "content", "raw_content", "parsed_content",
        F.array_join("warnings", ";").alias("warnings"), "error_code", "message",
    )


@query
def audit_log(spark, sf_dir):
    """Audit rows appended as JSON lines and read back."""
    path = run_folder(spark, "audit")
    sinks.write_audit(requests.audit_rows(requests.respond(request_table(spark, sf_dir))), path)
    schema = (
        "timestamp string, request_id string, client string, tool string, input_name string, "
        "detected_format string, status string, raw_chars bigint, parsed_chars bigint, "
        "raw_tokens bigint, parsed_tokens bigint, sent_variant string, events bigint, "
        "important_events bigint, duplicates bigint, batches bigint, duration_ms bigint, "
        "error_code string"
    )
    return spark.read.schema(schema).json(path).drop("timestamp", "duration_ms")


@query
def artifacts(spark, sf_dir):
    """Raw and parsed artifacts of the requests that asked for them."""
    return sinks.artifact_rows(requests.respond(request_table(spark, sf_dir)))


# --- normalization ----------------------------------------------------------------------------

@query
def normalized_text(spark, sf_dir):
    docs = documents(spark, sf_dir, marked=True)
    return docs.select("doc_id", tx.normalize_newlines(F.col("text")).alias("text"))


@query
def sanitized_text(spark, sf_dir):
    docs = documents(spark, sf_dir, marked=True)
    return docs.select("doc_id", tx.sanitized(F.col("text")).alias("text"))


def marked_lines(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir, marked=True)
    return ln.to_lines(docs.select("doc_id", tx.lf_text(F.col("text")).alias("text")), "text")


@query
def masked_lines(spark, sf_dir):
    """Personal data, known secrets and paths masked in every line."""
    line = F.col("line")
    return marked_lines(spark, sf_dir).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"),
        tx.mask_pii(line).alias("pii"),
        tx.mask_literals(line, ["s3cret", "abc.def"]).alias("masked"),
        tx.scrub_paths(line, {"mail.example.org": "<HOST>", "123e4567": "<ID>"}).alias("scrubbed"),
        tx.redact_all(line).alias("redacted"),
        tx.redact_extended(line).alias("extended"),
    )


@query
def collapsed_text(spark, sf_dir):
    docs = documents(spark, sf_dir, marked=True)
    return docs.select("doc_id", tx.collapse_space(F.col("text")).alias("text"))


@query
def text_measures(spark, sf_dir):
    """Characters, token estimate, tail, sample and first line of every document."""
    t = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", F.length(t).cast("bigint").alias("chars"),
        tx.token_estimate(F.length(t)).alias("tokens"),
        tx.keep_tail(t, 500).alias("tail"),
        tx.bounded_sample(t, 1_500).alias("sample"),
        tx.first_line(t).alias("first_line"),
    )


# --- lines ------------------------------------------------------------------------------------

@query
def line_severity(spark, sf_dir):
    """Severity, fingerprint, audit signature and raw level of every corpus line."""
    docs = log_corpus(spark, sf_dir)
    lines = ln.to_lines(docs.select("doc_id", tx.lf_text(F.col("text")).alias("text")), "text")
    raw = lines.select(
        "doc_id", "line_no",
        severity.raw_line_level(F.col("line")).alias("raw_level"),
        fp.audit_signature(F.col("line")).alias("signature"),
        severity.http_status(F.col("line")).alias("http_status"),
        "line",
    )
    return ln.line_measures(raw).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "severity", "fingerprint",
        "raw_level", "signature", "http_status",
    )


LEVEL_WORDS = (
    "0", "1", "2", "3", "4", "5", "6", "7", "8", "", "F", "alert", "Crit", "FATAL", "critical", "PANIC", "E", "error", "Err", "SEVERE",
    "w", "WARN", "Warning", "I", "d", "info", "NOTICE", "Debug", "TRACE", "V", "verbose", "emerg", "ERRORS", "Tracer",
)


@query
def level_words(spark, sf_dir):
    """JSON level lookup and leading-level test of words in the tables."""
    word = F.get(F.array(*map(F.lit, LEVEL_WORDS)), (F.col("o_orderkey") % len(LEVEL_WORDS)).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", word.alias("word"),
        severity.level_word_severity(word).alias("severity"),
        severity.starts_with_level(
            F.concat(F.when(F.col("o_orderstatus") == "P", "  ").otherwise("x"), word, F.lit(" "), F.col("o_orderpriority"))
        ).alias("leading_level"),
    )


def broker_lines(spark, sf_dir) -> DataFrame:
    docs = log_corpus(spark, sf_dir, "broker")
    clean = docs.select("doc_id", tx.trim_space(tx.sanitized(F.col("text"))).alias("text"))
    return ln.to_lines(clean, "text").withColumn("line_no", F.col("line_no").cast("bigint"))


@query
def broker_blocks(spark, sf_dir):
    """Block events from a line table, by running counts of start lines."""
    return ln.block_events(broker_lines(spark, sf_dir), by_id("kafka-broker-log4j")).drop("first")


@query
def compiler_blocks(spark, sf_dir):
    docs = log_corpus(spark, sf_dir, "compiler")
    clean = docs.select("doc_id", tx.trim_space(tx.sanitized(F.col("text"))).alias("text"))
    lines = ln.to_lines(clean, "text").withColumn("line_no", F.col("line_no").cast("bigint"))
    return ln.block_events(lines, by_id("cargo-rustc-error")).drop("first")


@query
def build_context(spark, sf_dir):
    """Lines around error words of build logs, from a line table."""
    docs = log_corpus(spark, sf_dir, "build")
    lines = ln.to_lines(docs.select("doc_id", tx.sanitized(F.col("text")).alias("text")), "text")
    return ln.join_context(ln.context_lines(lines))


# --- whole preparation of line tables -----------------------------------------------------------

def _line_batches(prepared: lp.Prepared) -> DataFrame:
    return prepared.batches().select("doc_id", "variant", "batch_index", "content")


@query
def line_summary(spark, sf_dir):
    """All events of an owner as one document: detection to variant choice and batches, without a row for it."""
    prepared = lp.prepare_lines(owner_lines(spark, sf_dir), SMALL_BUDGET)
    return prepared.summary()


@query
def line_batches(spark, sf_dir):
    """The batches of these documents."""
    return _line_batches(lp.prepare_lines(owner_lines(spark, sf_dir), SMALL_BUDGET))


@query
def line_groups(spark, sf_dir):
    """Their distinct events with repeat counts (a whole-text event keeps its text in the line table)."""
    groups = lp.prepare_lines(owner_lines(spark, sf_dir), SMALL_BUDGET).groups
    return groups.filter("content is not null").select("doc_id", "source", "severity", "content", "fingerprint", "repeats")


@query
def line_page_batches(spark, sf_dir):
    """Raw batches of web pages from their line tables; most lines are longer than the budget."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return _line_batches(lp.prepare_lines(lp.raw_lines(pages), SMALL_BUDGET))


@query
def file_lines(spark, sf_dir):
    """Line tables of files that several tasks read: numbers by counts per split."""
    root = run_folder(spark, "page-files")
    pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 3).alias("part"), F.regexp_replace("html", "[\r\n]", F.lit(" ")).alias("value")
    )
    pages.write.partitionBy("part").text(root)
    lines = ls.read_lines(spark, files.qualified(spark, root))
    part = F.regexp_extract("path", "part=([0-9])", 1).cast("bigint").alias("part")
    by_file = lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("chars").alias("chars"), F.count_distinct("line_no").alias("numbers"),
        F.max("line_no").alias("last"),
    )
    wrong = (F.col("numbers") != F.col("lines")) | (F.col("last") != F.col("lines"))
    return by_file.groupBy(part).agg(
        F.sum("lines").alias("lines"), F.sum("chars").alias("chars"), F.count_if(wrong).alias("misnumbered"),
    )


# --- detection and events -----------------------------------------------------------------------

@query
def detected_formats(spark, sf_dir):
    """Best format, support and label of every corpus document."""
    return ps.outcomes(log_corpus(spark, sf_dir)).select(
        "doc_id", F.array_join("format_ids", ",").alias("format_ids"), "supported",
        F.col("event_count").cast("bigint").alias("event_count"), "detected_format",
    )


@query
def profile_detections(spark, sf_dir):
    """Documents in the grammar of every built-in profile: the format, and where and how severe its events are."""
    parsed = ps.parse(profile_corpus(spark, sf_dir))
    return parsed.select(
        "doc_id", F.array_join("format_ids", ",").alias("format_ids"), "supported",
        F.array_join(F.col("events.source"), "; ").alias("sources"),
        F.array_join(F.col("events.severity"), ",").alias("severities"),
    )


@query
def format_candidates(spark, sf_dir):
    """Every matching text profile with its score."""
    docs = log_corpus(spark, sf_dir)
    clean = docs.select("doc_id", tx.trim_space(tx.sanitized(F.col("text"))).alias("trimmed"))
    found = tx.sealed(clean, ["doc_id"], {"m": matching_formats(BUILT_IN, "text", F.col("trimmed"))})
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.id", "m.score")


def corpus_events(style: str) -> Query:
    def run(spark, sf_dir):
        return ps.events(log_corpus(spark, sf_dir, style)).withColumn(
            "seq", F.col("seq").cast("bigint")
        )

    return run


for _style in ("broker", "journal", "cloud", "flow", "access", "build", "compiler", "trace"):
    _fn = corpus_events(_style)
    _fn.__name__ = f"{_style}_events"
    query(_fn)


@query
def log_events(spark, sf_dir):
    """Events of the mixed corpus."""
    return corpus_events("mixed")(spark, sf_dir)


@query
def severity_counts(spark, sf_dir):
    return corpus.severity_histogram(ps.events(log_corpus(spark, sf_dir)), ["doc_id"])


@query
def important_counts(spark, sf_dir):
    return corpus.important_share(ps.events(log_corpus(spark, sf_dir)), ["doc_id"])


@query
def event_groups(spark, sf_dir):
    """Deduplicated events with their repeat counts."""
    return pp.event_groups(ps.parse(log_corpus(spark, sf_dir))).withColumn(
        "first_seq", F.col("first_seq").cast("bigint")
    )


@query
def corpus_templates(spark, sf_dir):
    """Templates of the whole corpus."""
    return corpus.templates(ps.parse(log_corpus(spark, sf_dir)))


@query
def line_templates(spark, sf_dir):
    """Repeated lines of the prose documents as templates."""
    lines = ln.to_lines(documents(spark, sf_dir).select("doc_id", "text"), "text")
    return lines.select("doc_id", fp.fingerprint(F.col("line")).alias("fingerprint")).groupBy(
        "doc_id", "fingerprint"
    ).agg(F.count(F.lit(1)).alias("n")).groupBy("fingerprint").agg(
        F.sum("n").alias("total_repeats"), F.count(F.lit(1)).alias("documents")
    )


# --- preparation -------------------------------------------------------------------------------

def prepared_corpus(spark, sf_dir, budget: int = SMALL_BUDGET) -> DataFrame:
    return pp.prepare(log_corpus(spark, sf_dir), budget)


def prepared_documents(spark, sf_dir) -> DataFrame:
    return pp.prepare(documents(spark, sf_dir).select("doc_id", "text"), SMALL_BUDGET)


def prepared_pages(spark, sf_dir) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages")).select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text")
    )
    return pp.prepare(pages, SMALL_BUDGET)


def long_index(df: DataFrame) -> DataFrame:
    return df.withColumn("batch_index", F.col("batch_index").cast("bigint"))


@query
def prepared_summary(spark, sf_dir):
    """Flagship: detection, events, dedup, variant choice and batches of every document."""
    return pp.summarized(log_corpus(spark, sf_dir), SMALL_BUDGET)


@query
def prepared_batches(spark, sf_dir):
    return long_index(pp.batch_rows(prepared_corpus(spark, sf_dir)))


@query
def document_summary(spark, sf_dir):
    return pp.summarized(documents(spark, sf_dir).select("doc_id", "text"), SMALL_BUDGET)


@query
def document_batches(spark, sf_dir):
    return long_index(pp.batch_rows(prepared_documents(spark, sf_dir)))


@query
def page_batches(spark, sf_dir):
    """Raw batches of web pages, whose lines are often longer than the budget."""
    return long_index(pp.batch_rows(prepared_pages(spark, sf_dir)))


@query
def parsed_previews(spark, sf_dir):
    return prepared_corpus(spark, sf_dir).select("doc_id", "parsed_preview")


@query
def batch_previews(spark, sf_dir):
    return pp.preview(prepared_corpus(spark, sf_dir))


@query
def raw_preparation(spark, sf_dir):
    """Preparation switched off, with the character limit of a session."""
    limit = batching.input_budget(F.lit(4_000))
    return pp.prepare_raw(log_corpus(spark, sf_dir), limit).select(
        "doc_id", "detected_format", "original_chars", "estimated_tokens",
        F.array_join("batches", "").alias("content"), "parsed_preview", "error",
    )


@query
def corpus_totals(spark, sf_dir):
    return corpus.totals(pp.summary(prepared_corpus(spark, sf_dir)), rollup=True)


@query
def corpus_review(spark, sf_dir):
    prepared = prepared_corpus(spark, sf_dir, 12_000)
    lines = prepared.select("*", F.size("batches").cast("bigint").alias("batch_count"))
    return corpus.review(lines)


@query
def review_reports(spark, sf_dir):
    return sinks.report_text(prepared_corpus(spark, sf_dir)).select("doc_id", "report")


# --- prompts and conversations -------------------------------------------------------------------

def chats(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query
def history_within_budget(spark, sf_dir):
    return conversations.bounded_history(chats(spark, sf_dir), 1_000)


@query
def latest_questions(spark, sf_dir):
    return conversations.latest_message(chats(spark, sf_dir))


@query
def recent_messages(spark, sf_dir):
    return conversations.trim_history(chats(spark, sf_dir), 3)


@query
def kept_messages(spark, sf_dir):
    return conversations.trim_history(chats(spark, sf_dir))


@query
def conversation_titles(spark, sf_dir):
    return conversations.titles(chats(spark, sf_dir))


@query
def batch_prompts(spark, sf_dir):
    return long_index(prompts.map_prompts(prepared_documents(spark, sf_dir))).withColumn(
        "batch_total", F.col("batch_total").cast("bigint")
    )


@query
def announcements(spark, sf_dir):
    return prompts.announcement(prepared_corpus(spark, sf_dir))


@query
def synthesis_prompts(spark, sf_dir):
    """One reduce prompt per conversation over its assistant answers in turn order."""
    findings = chats(spark, sf_dir).filter("role = 'assistant'").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("batch_index"),
        F.col("text").alias("finding"),
    )
    return prompts.synthesis_prompts(findings)


@query
def request_costs(spark, sf_dir):
    """Cost ceilings and usage lines of conversation messages."""
    price_in = (F.col("turn") % 3) * F.lit(0.5)
    price_out = (F.col("turn") % 2) * F.lit(2.0)
    tokens_out = F.when(F.col("turn") % 5 != 4, F.col("turn") * 100 + 7)
    tokens_in = tx.token_estimate(F.length("text"))
    speed = F.when(F.col("turn") % 4 != 3, F.col("turn") + F.lit(0.5))
    first = F.when(F.col("turn") % 6 != 5, F.col("turn") + F.lit(0.25))
    return chats(spark, sf_dir).select(
        "conv_id", "turn",
        F.round(prompts.max_cost(F.length("text"), F.lit(1_500), price_in, price_out), 9).alias("max_cost"),
        prompts.usage_line(tokens_in, tokens_out, price_in, price_out, speed, first).alias("usage"),
    )


def answer_texts(spark, sf_dir) -> DataFrame:
    """Messages with section lines and JSON put around them."""
    t = F.col("text")
    nl = F.lit("\n")
    marked = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("  cause: "), t, nl, F.lit("FIX: do x "), nl, F.lit("Verify: run y"), nl, F.lit("fix: last")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("see {\"a\": 1, \"b\": {\"c\": 2}} done"), nl, t))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("} nothing {"), t))
        .otherwise(t)
    )
    return chats(spark, sf_dir).select("conv_id", "turn", "role", marked.alias("text"))


@query
def answer_sections(spark, sf_dir):
    rows = answer_texts(spark, sf_dir).select("conv_id", "turn", prompts.sections(F.col("text")).alias("s"))
    return rows.select("conv_id", "turn", "s.cause", "s.fix", "s.verify")


@query
def answer_json(spark, sf_dir):
    rows = answer_texts(spark, sf_dir).select("conv_id", "turn", prompts.extract_json(F.col("text")).alias("j"))
    return rows.select("conv_id", "turn", "j.json", "j.error")


@query
def request_payloads(spark, sf_dir):
    """Request bodies of every message in all shapes; the body is read back to compare fields."""
    bodies = F.array(*(
        F.struct(
            F.lit(protocol).alias("protocol"),
            prompts.payload(
                protocol, F.lit("gpt-5-x"), F.lit("Be brief."), F.col("role"), F.col("text"), F.lit(1_500)
            ).alias("body"),
        ) for protocol in prompts.PROTOCOLS
    ))
    out = chats(spark, sf_dir).select("conv_id", "turn", F.inline(bodies))
    paths = {
        "responses": "$.input[0].content[0].text", "chat": "$.messages[1].content",
        "local": "$.input", "generate_content": "$.contents[0].parts[0].text",
        "messages": "$.messages[0].content[0].text",
    }
    content = F.coalesce(*[
        F.when(F.col("protocol") == p, F.get_json_object("body", path)) for p, path in paths.items()
    ])
    return out.select("conv_id", "turn", "protocol", "body", content.alias("content"),
                      F.get_json_object("body", "$.model").alias("model"))


def responses(spark, sf_dir) -> DataFrame:
    """Stored provider responses made from messages: one shape per turn."""
    t, n = F.col("text"), F.length("text")
    user = F.col("turn")
    shapes = [
        F.to_json(F.struct(F.array(F.struct(F.array(F.struct(t.alias("text"))).alias("content"))).alias("output"),
                           F.struct(n.alias("input_tokens"), user.alias("output_tokens")).alias("usage"))),
        F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices"),
                           F.struct(n.alias("prompt_tokens"), user.alias("completion_tokens")).alias("usage"))),
        F.to_json(F.struct(F.array(F.struct(F.lit("message").alias("type"), F.concat(t, F.lit(" ")).alias("content"))).alias("output"),
                           F.struct(n.alias("input_tokens"), user.alias("total_output_tokens")).alias("stats"))),
        F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(t.alias("text"))).alias("parts")).alias("content"))).alias("candidates"),
                           F.struct(n.alias("promptTokenCount"), user.alias("candidatesTokenCount")).alias("usageMetadata"))),
        F.to_json(F.struct(F.array(F.struct(t.alias("text"))).alias("content"),
                           F.struct(n.alias("input_tokens"), user.alias("output_tokens")).alias("usage"))),
        F.lit('{"error":{"message":"bad s3cret"}}'),
    ]
    names = [*prompts.PROTOCOLS, "chat"]
    pick = (F.col("conv_id") + user) % len(shapes)
    body, protocol = F.lit(None), F.lit(None)
    for i, (shape, name) in enumerate(zip(shapes, names)):
        body = F.when(pick == i, shape).otherwise(body)
        protocol = F.when(pick == i, F.lit(name)).otherwise(protocol)
    status = F.when(pick < 5, 200).when(user % 2 == 0, 429).otherwise(401)
    return chats(spark, sf_dir).select(
        "conv_id", "turn", protocol.alias("protocol"), body.alias("body"), status.alias("status")
    )


@query
def stored_answers(spark, sf_dir):
    rows = responses(spark, sf_dir)
    answered = tx.sealed(rows, ["conv_id", "turn", "status", "body"],
                         {"a": prompts.answer(F.col("protocol"), F.col("body"))})
    return answered.select(
        "conv_id", "turn", "a.text", "a.input_tokens", "a.output_tokens", "a.error",
        prompts.response_outcome(F.col("status")).alias("outcome"),
        F.when(F.col("status") >= 300, prompts.api_error(F.col("status"), F.col("body"), ["s3cret"])).alias("api_error"),
    )


def model_listings(spark, sf_dir) -> DataFrame:
    """Model listings made from part rows: one listing per brand, size range and provider."""
    name = F.concat(F.lit("m-"), F.lower("p_type"), F.lit("-"), F.col("p_size"))
    able = F.when(F.col("p_size") % 3 != 0, F.array(F.lit("generateContent"))).otherwise(F.array(F.lit("embed")))
    kind = F.when(F.col("p_size") % 2 == 0, "llm").otherwise("embedding")
    rows = table(spark, sf_dir, "part").select(
        "p_brand", F.floor(F.col("p_partkey") / 1000).alias("part_range"),
        F.struct(F.concat(F.lit("models/"), name).alias("name"), able.alias("supportedGenerationMethods"),
                 kind.alias("type"), name.alias("key")).alias("m"),
        F.struct(name.alias("id")).alias("d"),
    )
    grouped = rows.groupBy("p_brand", "part_range").agg(
        F.collect_list("m").alias("models"), F.collect_list("d").alias("data")
    )
    provider = F.explode(F.array(F.lit("generate_content"), F.lit("local"), F.lit("listed")))
    return grouped.select(provider.alias("provider"), F.to_json(F.struct("models", "data")).alias("body"))


@query
def listed_models(spark, sf_dir):
    return prompts.model_names(model_listings(spark, sf_dir))


# --- catalog as data ---------------------------------------------------------------------------

def part_profiles(spark, sf_dir) -> DataFrame:
    """A profile per part: stored bodies keyed by an id that several parts share."""
    pid = F.concat(F.lit("p-"), F.lower("p_type"), F.lit("-"), F.col("p_size"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey"), pid.alias("id"), F.concat(F.lit("user/"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"), F.lit(".json")).alias("path"),
        F.col("p_name").alias("application"), F.col("p_brand").alias("body"),
        F.col("p_partkey").alias("version"), F.col("p_size"),
    )


def base_profiles(spark, sf_dir) -> DataFrame:
    """The oldest profile of every id, as the installed catalog."""
    return extreme_rows(part_profiles(spark, sf_dir), ["id"], "p_partkey").select(
        "id", F.col("p_partkey").alias("ordinal"), "application", "body", "p_size"
    ).withColumn("origin", F.when(F.col("p_size") % 2 == 0, "built-in").otherwise("user"))


def newest_profiles(spark, sf_dir) -> DataFrame:
    """The newest profile of ids with a size divisible by five: overrides."""
    sized = part_profiles(spark, sf_dir).filter("p_size % 5 = 0")
    return extreme_rows(sized, ["id"], "p_partkey", newest=True).select("id", "application", "body")


def disabled_profiles(spark, sf_dir) -> DataFrame:
    return base_profiles(spark, sf_dir).filter("p_size % 7 = 0").select("id")


@query
def profile_violations(spark, sf_dir):
    """Rule violations of one profile file per part, most of them broken in some way."""
    s = F.col("p_size") % 10
    fmt = F.struct(
        F.when(s == 1, F.upper("id")).otherwise(F.col("id")).alias("id"),
        F.when(s == 2, "xml").otherwise("text").alias("record_kind"),
        F.struct(
            F.when(s == 3, F.array().cast("array<struct<kind:string,value:string>>")).otherwise(
                F.array(F.struct(F.when(s == 4, "glob").otherwise("regex").alias("kind"),
                                 F.when(s == 5, "(open").otherwise("^x").alias("value")))
            ).alias("all"),
            F.array().cast("array<struct<kind:string,value:string>>").alias("any"),
        ).alias("detect"),
        F.struct(
            F.when(s == 6, "json_fields").otherwise("delimited_lines").alias("kind"),
            F.when(s == 7, "semicolon").otherwise("comma").alias("delimiter"),
            F.array(F.lit("a"), F.lit("b")).alias("fields"),
            F.array(F.struct(F.when(s == 8, "z").otherwise("a").alias("field"),
                             F.array(F.lit("v")).alias("values"), F.lit("ERROR").alias("severity"))).alias("severity_rules"),
        ).alias("parser"),
    )
    file = F.struct(F.when(s == 9, 2).otherwise(3).alias("schema_version"), F.lit("raw").alias("fallback"),
                    F.array(fmt).alias("formats"))
    rows = part_profiles(spark, sf_dir).select("path", F.to_json(file).alias("text"))
    return registry.violations(registry.read_formats(rows))


@query
def profile_merge(spark, sf_dir):
    existing = part_profiles(spark, sf_dir).filter("p_size = 1").select("id")
    return registry.merge_single(existing, part_profiles(spark, sf_dir).select("path", "id"))


@query
def profile_overrides(spark, sf_dir):
    return registry.apply_overrides(base_profiles(spark, sf_dir), newest_profiles(spark, sf_dir))


@query
def unknown_overrides(spark, sf_dir):
    """Overrides of profiles that were disabled and removed from the catalog."""
    left = registry.active(base_profiles(spark, sf_dir), disabled_profiles(spark, sf_dir))
    return registry.unknown_overrides(left, newest_profiles(spark, sf_dir))


@query
def active_profiles(spark, sf_dir):
    return registry.active(base_profiles(spark, sf_dir), disabled_profiles(spark, sf_dir)).select("id", "body")


@query
def profile_listing(spark, sf_dir):
    return registry.profile_summary(base_profiles(spark, sf_dir), disabled_profiles(spark, sf_dir))


@query
def registry_status(spark, sf_dir):
    merged = registry.apply_overrides(base_profiles(spark, sf_dir), newest_profiles(spark, sf_dir))
    return registry.status(registry.profile_summary(merged, disabled_profiles(spark, sf_dir)))


@query
def profile_lookup(spark, sf_dir):
    base = base_profiles(spark, sf_dir)
    return registry.lookup({
        "active": registry.active(base, disabled_profiles(spark, sf_dir)),
        "override": newest_profiles(spark, sf_dir),
        "base": base,
    })


@query
def profile_install(spark, sf_dir):
    drafts = newest_profiles(spark, sf_dir).withColumn("id", F.regexp_replace("id", "-10$", "-new"))
    return registry.install(base_profiles(spark, sf_dir), drafts)


@query
def profile_upsert(spark, sf_dir):
    rows = part_profiles(spark, sf_dir)
    return registry.upsert(rows.filter("p_partkey % 2 = 0"), rows.filter("p_partkey % 2 = 1"))


@query
def profile_restore(spark, sf_dir):
    base = base_profiles(spark, sf_dir)
    states = registry.apply_overrides(base, newest_profiles(spark, sf_dir)).select(
        "id", "origin", "body", F.lit(True).alias("disabled")
    )
    return registry.restore_defaults(states, base)


@query
def profile_store(spark, sf_dir):
    """The versioned store after installs, overrides, disabled profiles and a second round of installs."""
    store = ProfileStore(spark, run_folder(spark, "profile-store"))
    base, newest = base_profiles(spark, sf_dir), newest_profiles(spark, sf_dir)
    store.install(base.filter("origin = 'built-in'"), "built-in")
    store.install(base, "user")
    store.override(newest)
    store.disable(disabled_profiles(spark, sf_dir))
    store.install(newest.withColumn("id", F.regexp_replace("id", "-10$", "-new")), "draft")
    return store.state()


@query
def draft_validation(spark, sf_dir):
    """A user profile tried on the order documents."""
    return registry.validate_draft([ORDER_PROFILE], order_corpus(spark, sf_dir)).select(
        "doc_id", F.array_join("format_ids", ",").alias("format_ids"),
        F.col("event_count").cast("bigint").alias("event_count"), "error",
    )


@query
def update_validation(spark, sf_dir):
    """The same draft as an update of a built-in profile, tried on the mixed corpus."""
    return registry.validate_draft(
        [ORDER_PROFILE], log_corpus(spark, sf_dir), target="nginx-access"
    ).select("doc_id", F.col("event_count").cast("bigint").alias("event_count"), "error")


@query
def update_gates(spark, sf_dir):
    out = ps.outcomes(log_corpus(spark, sf_dir)).withColumn(
        "g", registry.update_gate(F.lit("kafka-broker-log4j"), F.col("supported"), F.col("format_ids"))
    )
    return out.select("doc_id", "g.decision", "g.reason")


@query
def uncovered_documents(spark, sf_dir):
    return registry.uncovered(log_corpus(spark, sf_dir))


@query
def order_events(spark, sf_dir):
    """Built-in profiles plus a user profile over pipe-delimited documents."""
    return ps.events(order_corpus(spark, sf_dir), profiles=[*BUILT_IN, ORDER_PROFILE]).withColumn(
        "seq", F.col("seq").cast("bigint")
    )


@query
def comma_order_events(spark, sf_dir):
    """The same with commas, and both user profiles to choose from."""
    docs = order_corpus(spark, sf_dir).withColumn("text", F.replace("text", F.lit("|"), F.lit(",")))
    return ps.events(docs, profiles=[*BUILT_IN, ORDER_PROFILE, COMMA_PROFILE]).withColumn("seq", F.col("seq").cast("bigint"))


@query
def tab_order_events(spark, sf_dir):
    """Fields between tabs, taken from lines as they are (sanitizing a document widens its tabs)."""
    parser = {**ORDER_PROFILE.parser, "delimiter": "tab"}
    lines = tx.text_lines(F.replace("text", F.lit("|"), F.lit("\t")))
    rows = order_corpus(spark, sf_dir).select("doc_id", F.explode(extract.delimited_events(lines, parser)).alias("e"))
    return rows.select("doc_id", F.col("e.first").cast("bigint").alias("first"), "e.level", "e.content")


@query
def format_usage(spark, sf_dir):
    return corpus.format_usage(ps.outcomes(log_corpus(spark, sf_dir)), BUILT_IN)


def coverage_table(spark, sf_dir) -> DataFrame:
    """A coverage list made from the parts."""
    size = F.col("p_size") % 4
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + F.when(F.col("p_size") == 13, 1).otherwise(0)).alias("rank"),
        F.concat(F.lit("tier-"), F.col("p_size") % 5).alias("volume"),
        F.col("p_name").alias("application"),
        F.when(size == 0, "covered").when(size == 1, "partial").when(size == 2, "raw").otherwise("n/a").alias("coverage"),
        F.col("p_type").alias("adapter_or_gap"),
    )


@query
def coverage_counts(spark, sf_dir):
    return corpus.coverage_counts(coverage_table(spark, sf_dir), ["volume"])


@query
def coverage_gaps(spark, sf_dir):
    return corpus.coverage_gaps(coverage_table(spark, sf_dir))


@query
def coverage_report(spark, sf_dir):
    return corpus.coverage_report(coverage_table(spark, sf_dir))


@query
def draft_envelopes(spark, sf_dir):
    """Envelopes of draft answers; the time stamp is left out of the comparison."""
    drafts = answer_texts(spark, sf_dir).select(
        F.concat("conv_id", F.lit("-"), "turn").alias("id"), F.lit("a.log").alias("source_log"),
        F.lit("p").alias("provider"), F.lit("m").alias("model"), F.length("text").alias("sample_chars_sent"),
        F.col("text").alias("model_answer"), F.lit("{}").alias("validated_schema"),
    )
    rows = sinks.draft_envelopes(drafts)
    names = ("metadata_version", "source_log", "provider", "model", "model_answer", "validated_schema")
    return rows.select("id", *(F.get_json_object("value", f"$.{n}").alias(n) for n in names),
                       F.get_json_object("value", "$.sample_chars_sent").cast("bigint").alias("sample_chars_sent"))


# --- audit and sampling ---------------------------------------------------------------------------

def sides_of(docs: DataFrame) -> DataFrame:
    """Raw lines and re-read rendered events; unsupported documents have no events."""
    return audit.both_sides(pp.prepare(docs, SMALL_BUDGET), tx.trim_space(F.col("clean")), F.col("parsed_preview"))


def audit_sides(spark, sf_dir) -> DataFrame:
    return sides_of(log_corpus(spark, sf_dir))


@query
def report_events(spark, sf_dir):
    """Events read back from rendered text, totalled by document and level."""
    prepared = prepared_corpus(spark, sf_dir).filter("normalized")  # only these have rendered events
    return audit.report_events(prepared, "parsed_preview").groupBy("doc_id", "level").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("repeats").alias("events"),
        F.sum(F.length("content")).alias("chars"),
    )


@query
def parsed_sections(spark, sf_dir):
    """The parsed block of every review report."""
    reports = sinks.report_text(prepared_corpus(spark, sf_dir))
    return reports.select("doc_id", audit.parsed_section(F.col("report")).alias("parsed"))


@query
def audit_signatures(spark, sf_dir):
    return audit.signature_differences(audit_sides(spark, sf_dir))


@query
def audit_levels(spark, sf_dir):
    return audit.severity_differences(audit_sides(spark, sf_dir))


@query
def audit_verdicts(spark, sf_dir):
    return audit.verdicts(audit_sides(spark, sf_dir))


@query
def audit_result(spark, sf_dir):
    return audit.corpus_result(audit.verdicts(audit_sides(spark, sf_dir)))


@query
def priority_lines(spark, sf_dir):
    """Forty lines per source, error-like ones first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", tx.lf_text(F.col("text")).alias("text"))
    rows = docs.select("source", "doc_id", F.posexplode(tx.text_lines(F.col("text"))).alias("pos", "line"))
    keyed = rows.select("source", "doc_id", F.col("pos").cast("bigint").alias("line_no"), "line")
    return audit.priority_sample(keyed, "source", ["doc_id", "line_no"]).select(
        "source", "doc_id", "line_no", "priority", F.col("rank").cast("bigint").alias("rank"), "line"
    )


EXPECTED = {
    "broker": "kafka-broker-log4j", "journal": "systemd-journal-json", "flow": "aws-vpc-flow-default",
    "access": "nginx-access", "build": "docker-buildkit-error", "compiler": "cargo-rustc-error",
    "trace": "python-traceback",
}


@query
def golden_mismatches(spark, sf_dir):
    """Documents whose detected format differs from the one their style stands for."""
    docs = log_corpus(spark, sf_dir)
    style, want = F.col("style"), F.lit("unknown -> raw")
    for name, label in EXPECTED.items():
        want = F.when(style == name, label).otherwise(want)
    expected = docs.select("doc_id", want.alias("expected_format"))
    return corpus.golden_mismatches(ps.outcomes(docs), expected).select(
        "doc_id", "expected_format", "detected_format"
    )


@query
def ambiguous_documents(spark, sf_dir):
    return corpus.ambiguous(ps.outcomes(log_corpus(spark, sf_dir))).select("doc_id", "detected_format")


# --- streaming ------------------------------------------------------------------------------------

def event_stream(spark, sf_dir) -> DataFrame:
    """The events table as a stream of log lines."""
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    if files.is_folder(spark, f"{sf_dir}/events.parquet"):
        rows = reader.parquet(f"{sf_dir}/events.parquet")
    else:  # a stream reads folders: of this one, just the table's file
        rows = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    cents = F.floor(F.col("value") * 100).cast("bigint")
    line = F.concat(F.lit("["), F.col("event_id"), F.lit("] "), level, F.lit(" "), F.col("event_type"),
                    F.lit(" value "), cents, F.lit(" token=t"), F.col("user_id"), F.lit("\t"))
    return rows.select(
        "event_id", F.col("user_id").cast("string").alias("source"),
        F.col("ts").cast("timestamp").alias("event_time"), level.alias("level"), line.alias("line"),
    )


def updated(spark, stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The current rows of an aggregation in update mode, those still open included."""
    root = run_folder(spark, name)
    sl.updates_to_files(stream, f"{root}/out", f"{root}/checkpoint", keys).awaitTermination()
    return sl.latest(spark, f"{root}/out", keys)


WINDOW = ["window_start", "window_end", "severity"]


def drained(spark, stream: DataFrame, name: str) -> DataFrame:
    root = run_folder(spark, name)
    sl.to_files(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query
def stream_lines(spark, sf_dir):
    """Streaming ingest with redaction, severity and fingerprint."""
    lines = sl.measured(event_stream(spark, sf_dir), F.col("level"))
    return drained(spark, lines.select("event_id", "line", "severity", "fingerprint"), "lines")


@query
def stream_first_templates(spark, sf_dir):
    """First line of every template within the watermark."""
    lines = sl.measured(event_stream(spark, sf_dir), F.col("level"))
    first = sl.first_of_template(lines, delay="60 days")
    return drained(spark, first.select("source", "fingerprint"), "dedup")


@query
def stream_windows(spark, sf_dir):
    """Severity counts per day, of the windows still open too."""
    lines = sl.measured(event_stream(spark, sf_dir), F.col("level"))
    return updated(spark, sl.window_counts(lines, length="1 day"), "windows", WINDOW)


@query
def stream_sliding(spark, sf_dir):
    lines = sl.measured(event_stream(spark, sf_dir), F.col("level"))
    return updated(spark, sl.window_counts(lines, length="1 day", slide="12 hours"), "sliding", WINDOW)


@query
def stream_sessions(spark, sf_dir):
    """All sessions, open ones too: partial sessions kept by the stream, merged as intervals."""
    lines = sl.measured(event_stream(spark, sf_dir), F.col("level"))
    partial = sl.partial_sessions(lines, "source", gap="1 day")
    return sl.merged_sessions(updated(spark, partial, "sessions", ["source", "range_start"]), "source", gap="1 day")


@query
def stream_templates(spark, sf_dir):
    """Template table kept by a streaming aggregation in update mode."""
    counts = sl.template_counts(sl.measured(event_stream(spark, sf_dir), F.col("level")))
    return updated(spark, counts, "templates", ["fingerprint"])


@query
def stream_audit(spark, sf_dir):
    """Streaming audit rows, one folder of JSON lines per micro-batch."""
    root = run_folder(spark, "stream-audit")
    lines = sl.measured(event_stream(spark, sf_dir), F.col("level"))
    rows = lines.select("event_id", "source", "severity", F.length("line").cast("bigint").alias("chars"))
    sl.audit_stream(rows, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).json(f"{root}/out").drop("batch")


STREAM_PROFILE = Profile(
    "stream-blocks", "text", (("regex", "^START"),), (),
    {"kind": "line_blocks", "start_regex": r"^\[\d+\] (?P<level>ERROR|WARN)", "severity_capture": "level",
     "default_severity": "UNKNOWN"},
)


@query
def stream_blocks(spark, sf_dir):
    """Blocks opened by ERROR/WARN lines of a source, assembled over micro-batches."""
    root = run_folder(spark, "blocks")
    lines = event_stream(spark, sf_dir).select(
        F.col("source").alias("origin"), F.col("event_id").alias("line_no"), tx.normalize_line(F.col("line")).alias("line"), "event_time"
    )
    timeout = int(timedelta(days=90).total_seconds())
    # lines are numbered across all sources, so a source has few lines in a range of numbers, and a group of sources a bounded number
    size, groups = 64 * RANGE, 64
    sb.block_stream(lines, STREAM_PROFILE, f"{root}/pieces", f"{root}/checkpoint", timeout, size, groups).awaitTermination()
    done = sb.assembled(spark, f"{root}/pieces", f"{root}/checkpoint", STREAM_PROFILE)
    return done.select("origin", "first", "severity", "content", "fingerprint")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["prepared_summary"](spark, sf_dir)


