"""Check SQL by registered query name."""

from __future__ import annotations

import oracles as o
from logmill.functions.severity import JSON_LEVELS

from logmill.operators.audit import PRIORITY
from logmill.operators.prompts import INSTRUCTION, SYNTHESIS
from logmill.plans.catalog import BUILT_IN
from logmill.plans.extract import BUILD_MARKER, OMITTED
from logmill.plans.synth import STYLES
from logmill.queries import COMMA_PROFILE, EXPECTED, ORDER_PROFILE

q, NL = o.q, o.NL
MIX = o.corpus()
MIXED = o.pipeline(MIX)
PREP = o.prepared(MIX, 3000)
DOCS = o.prepared("select doc_id, text from documents", 3000)
PAGES = o.prepared("select page_id as doc_id, html as text from pages", 3000)
MARKED = o.marked_sql()
RANK = ("case severity when 'CRITICAL' then 0 when 'ERROR' then 1 when 'WARNING' then 2 "
        "when 'INFO' then 3 else 4 end as severity_rank")
EVENTS = f" select doc_id, seq, source, severity, content, fingerprint, {RANK} from ev"
IMPORTANT = "severity in ('CRITICAL','ERROR','WARNING')"

ORACLES: dict[str, str] = {}

# --- sources and requests
PATHS = "(select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') as path from pages)"
ORACLES["path_routes"] = f"""
select page_id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) as suffix,
  case when lower(regexp_extract(path, '\\.([^./]+)$', 1)) in ('png','jpg','jpeg','webp') then 'image' else 'log' end as route,
  path = '/m.ththth.example.net' or starts_with(path, '/m.ththth.example.net/')
   or path = '/ththre.example.com/fr' or starts_with(path, '/ththre.example.com/fr/') as allowed
from {PATHS}"""
ORACLES["safe_names"] = """
select page_id, coalesce(nullif(regexp_replace(url[1:80], '[^A-Za-z0-9._-]', '_', 'g'), ''), 'input') as name from pages"""
ORACLES["json_containers"] = MIXED + """
select t.doc_id, t.is_json, coalesce(r.n, 0) as records from typed t
left join (select doc_id, count(*) as n from recs group by doc_id) r using (doc_id)"""

REQ = f"""(select 'r' || doc_id as request_id, doc_id, name, text, doc_id // 1000000 as u from ({MIX}))"""
REQUESTS = f"""(select request_id, doc_id, u,
  case when u % 23 = 5 then '/logs/x.log' end as path,
  case when u % 29 = 7 then '' when u % 31 = 8 then null else text end as text,
  case when u % 3 <> 0 then name end as name,
  case when u % 7 <> 3 then ['auto','RAW','parsed','compare','auto','best'][(u % 6 + 1)::int] end as mode,
  case when u % 5 = 2 then 1 end as batch_index,
  case when u % 2 = 0 then 1000 else 4000 end as batch_chars, u % 4 = 1 as save_artifacts from {REQ})"""
CHECKED = f"""(select *, lower(coalesce(mode, 'auto')) as requested_mode,
   case when (path is null) = (text is null) then 'provide exactly one of path or text'
     when text = '' then 'input is empty' end as rejected,
   lower(coalesce(mode, 'auto')) not in ('auto','raw','parsed','compare') as bad_mode from {REQUESTS})"""
ORACLES["request_validation"] = f"""
select request_id, requested_mode,
  coalesce(case when path is not null then 'x.log' end, name, case when rejected is null then 'inline.log' else 'input' end) as input_name,
  case when rejected is not null then 'input_rejected' when bad_mode then 'invalid_mode' end as error_code,
  coalesce(rejected, case when bad_mode then 'mode must be auto, raw, parsed, or compare' end) as message
from {CHECKED}"""


def responses() -> str:
    """Per-request responses: both budgets are batched for all usable requests, then picked."""
    docs = f"select doc_id, case when rejected is null and not bad_mode then coalesce(text, '') else '' end as text from {CHECKED}"
    parts = []
    for b in (3000, 4000):
        parts += [
            o.greedy_ctes(f"raw{b}", o.raw_pieces("all_clean", b), str(b), 0),
            o.greedy_ctes(f"par{b}", o.raw_pieces("all_parsed", b), str(b), 0),
            o.greedy_ctes(f"evb{b}", "select g.doc_id, g.pos, len(g.rendered) as len, g.rendered as txt from groups g join ch using (doc_id) where ch.pick = 'P'", str(b), 2),
        ]
    unions = " union all ".join(
        f"select doc_id, {b} as budget, '{kind}' as kind, batch, txt from {name}{b}"
        for b in (3000, 4000) for kind, name in (("raw", "raw"), ("parsed", "par"), ("event", "evb")))
    return o.pipeline(docs) + f""",
ch as materialized (select l.doc_id, l.detected_format, l.supported, c.clean, coalesce(t.parsed_text, c.clean) as preview,
    case when not l.supported or len(c.clean) < len(t.parsed_text) then 'R' else 'P' end as pick
  from labelled l join cleaned c using (doc_id) left join texts t using (doc_id)),
all_clean as (select doc_id, clean as txt from ch),
all_parsed as (select doc_id, preview as txt from ch),
{','.join(parts)},
allb as materialized ({unions}),
counts as (select doc_id, count(*) as event_count, count(*) filter (where {IMPORTANT}) as important_events,
    count(*) - count(distinct fingerprint) as duplicate_count from ev group by doc_id),
rq as (select r.*, ch.*exclude(doc_id), coalesce(n.event_count, 1) as event_count,
    coalesce(n.important_events, 0) as important_events, coalesce(n.duplicate_count, 0) as duplicate_count,
    case when r.batch_chars = 1000 then 3000 else 4000 end as budget, coalesce(batch_index, 0) as idx,
    rejected is null and not bad_mode as usable,
    case requested_mode when 'auto' then case when pick = 'P' then 'Parsed' else 'Raw' end when 'raw' then 'Raw'
      when 'compare' then 'Compare' else case when supported then 'Parsed' else 'Raw fallback' end end as sent_variant,
    case requested_mode when 'auto' then case when pick = 'P' then 'event' else 'raw' end when 'raw' then 'raw'
      when 'parsed' then case when supported then 'parsed' else 'raw' end end as kind
  from {CHECKED} r join ch on ch.doc_id = r.doc_id left join counts n on n.doc_id = r.doc_id),
sizes as (select doc_id, budget, kind, count(*) as n from allb group by all),
rs as (select rq.*, b.txt as content, rb.txt as raw_content, pb.txt as parsed_content,
    case when requested_mode = 'compare' then greatest(coalesce(sr.n, 0), coalesce(sp.n, 0)) else coalesce(s.n, 0) end as batch_count
  from rq left join allb b on b.doc_id = rq.doc_id and b.budget = rq.budget and b.kind = rq.kind and b.batch = rq.idx
  left join allb rb on rb.doc_id = rq.doc_id and rb.budget = rq.budget and rb.kind = 'raw' and rb.batch = rq.idx and requested_mode = 'compare'
  left join allb pb on pb.doc_id = rq.doc_id and pb.budget = rq.budget and pb.kind = 'parsed' and pb.batch = rq.idx and requested_mode = 'compare'
  left join sizes s on s.doc_id = rq.doc_id and s.budget = rq.budget and s.kind = rq.kind
  left join sizes sr on sr.doc_id = rq.doc_id and sr.budget = rq.budget and sr.kind = 'raw'
  left join sizes sp on sp.doc_id = rq.doc_id and sp.budget = rq.budget and sp.kind = 'parsed'),
ok as (select *, case when rejected is not null then 'input_rejected' when bad_mode then 'invalid_mode'
    when path is not null then 'input_rejected' when idx >= batch_count then 'batch_out_of_range' end as error_code,
    coalesce(rejected, case when bad_mode then 'mode must be auto, raw, parsed, or compare' end,
      case when path is not null then 'cannot resolve path' when idx >= batch_count then 'batch_index ' || idx || ' is outside 0..' || batch_count end) as message,
    coalesce(len(content), coalesce(len(raw_content), 0) + coalesce(len(parsed_content), 0)) as size from rs),
resp as (select *, error_code is null as good,
   case when error_code is not null then coalesce(name, case when path is not null then 'x.log' end, 'input')
     else coalesce(case when path is not null then 'x.log' end, name, 'inline.log') end as input_name,
   case when error_code is not null then 'error' when supported then 'ok' else 'raw_fallback' end as status from ok)"""


RESP = responses()


def good(expr: str, name: str) -> str:
    return f"case when good then {expr} end as {name}"


ORACLES["request_responses"] = RESP + f"""
select request_id, input_name, requested_mode, status, {good('detected_format', 'detected_format')},
  {good('sent_variant', 'sent_variant')}, {good('len(clean)', 'raw_chars')}, {good('len(preview)', 'parsed_chars')},
  {good(o.tokens('len(clean)'), 'raw_tokens_estimate')}, {good(o.tokens('len(preview)'), 'parsed_tokens_estimate')},
  {good("round(case when len(clean) = 0 then 0.0 else (1 - len(preview) / len(clean)) * 100 end, 4)", 'reduction_percent')},
  {good('event_count', 'event_count')}, {good('important_events', 'important_events')}, {good('duplicate_count', 'duplicates_removed')},
  {good('idx', 'batch_index')}, {good('batch_count', 'batch_count')}, {good('size', 'batch_chars')},
  {good(o.tokens('size'), 'batch_tokens_estimate')}, {good('content', 'content')}, {good('raw_content', 'raw_content')},
  {good('parsed_content', 'parsed_content')},
  case when good and sent_variant = 'Raw fallback' then 'Unknown format: returned Raw fallback.' else '' end as warnings,
  error_code, message from resp"""
ORACLES["audit_log"] = RESP + f"""
select request_id, 'mcp-client' as client, 'prepare_log' as tool, input_name,
  coalesce({good('detected_format', 'x')[:-5]}, 'unknown') as detected_format, status,
  case when good then len(clean) else 0 end as raw_chars, case when good then len(preview) else 0 end as parsed_chars,
  case when good then {o.tokens('len(clean)')} else 0 end as raw_tokens, case when good then {o.tokens('len(preview)')} else 0 end as parsed_tokens,
  case when good then sent_variant else 'none' end as sent_variant, case when good then event_count else 0 end as events,
  case when good then important_events else 0 end as important_events, case when good then duplicate_count else 0 end as duplicates,
  case when good then batch_count else 0 end as batches, error_code from resp"""
ORACLES["artifacts"] = RESP + """
select request_id, k.part as kind, input_name || '.' || k.part || '.log' as name, case k.part when 'raw' then clean else preview end as text
from resp, (values ('raw'), ('parsed')) as k(part) where save_artifacts and good"""

# One file per supplier: a line and its end, written and read whole.
FILES = """(select s_suppkey as k, s_suppkey % 5 = 4 as outside, s_suppkey % 7 as kind,
  'note ' || s_name || ' balance ' || cast(floor(s_acctbal) as bigint) as line, octet_length(encode('note ' || s_name || ' balance ' || cast(floor(s_acctbal) as bigint))) + 1 as bytes from supplier)"""
ORACLES["file_scan"] = f"""
select k as supplier, bytes + case kind when 1 then 1100 when 2 then 1 else 0 end as length,
  case when not outside and kind not in (1, 2) then line || {NL} end as text,
  case when outside then 'path is outside the allowed roots' when kind = 1 then 'file exceeds 1024 bytes'
    when kind = 2 then 'file is not valid UTF-8' end as error from {FILES}"""
ORACLES["path_requests"] = f"""
with f as (select *, case when kind = 5 then 'invalid_mode' when kind < 5 and kind > 0 or outside then 'input_rejected' end as code from {FILES})
select cast(k as varchar) as request_id, code as error_code,
  case when kind = 5 then 'mode must be auto, raw, parsed, or compare' when kind = 3 then 'cannot resolve path'
    when kind = 4 then 'path is not a regular file' when outside then 'path is outside the allowed roots'
    when kind = 1 then 'file exceeds 1024 bytes' when kind = 2 then 'file is not valid UTF-8' end as message,
  case when code is null then len({o.rtrim('line')}) end as raw_chars, case when code is null then {o.rtrim('line')} end as content
from f"""

# --- normalization
CLEAN_M = "with " + o.clean_ctes(MARKED)
PLAIN = f"""with docs as ({MARKED}), dl as (select doc_id, {o.lines_of('t')} as arr from (select doc_id, {o.lf('text')} as t from docs)),
pl as (select doc_id, i as line_no, arr[i] as line from dl, unnest(generate_series(1, len(arr))) as g(i))"""
ORACLES["normalized_text"] = PLAIN + f"""
select d.doc_id, coalesce(string_agg(replace({o.rtrim('line')}, chr(9), '    '), {NL} order by line_no), '') as text
from docs d left join pl using (doc_id) group by d.doc_id"""
ORACLES["sanitized_text"] = CLEAN_M + " select doc_id, clean as text from cleaned"
EXT = r"""(?i)\b(api_?key|password|secret|token)(\s*[:=]\s*)("[^"\n]*"|'[^'\n]*'|[^\s"',;]+)"""
ORACLES["masked_lines"] = PLAIN + f"""
select doc_id, line_no, {o.pii('line')} as pii,
  replace(replace(line, 's3cret', '[REDACTED]'), 'abc.def', '[REDACTED]') as masked,
  replace(replace(line, 'mail.example.org', '<HOST>'), '123e4567', '<ID>') as scrubbed,
  {o.redact_all('line')} as redacted,
  regexp_replace(line, {q(EXT)}, {q(chr(92) + '1' + chr(92) + '2[REDACTED]')}, 'g') as extended
from pl"""
ORACLES["collapsed_text"] = f"""with docs as ({MARKED})
select doc_id, {o.trim(f"regexp_replace(text, {q(o.W + '+')}, ' ', 'g')")} as text from docs"""
ORACLES["text_measures"] = f"""
select doc_id, len(text) as chars, {o.tokens('len(text)')} as tokens,
  case when len(text) <= 500 then text else '[document head truncated]' || {NL} || right(text, {500 - 26}) end as tail,
  case when len(text) <= 1500 then text else text[1:750] || {NL} || '[...middle omitted...]' || {NL} || right(text, 750) end as sample,
  coalesce({o.lines_of('text')}[1], 'ok')[1:120] as first_line
from documents"""

# --- lines
RAW_LINES = f"""with docs as ({MIX}), dl as (select doc_id, {o.lines_of('t')} as arr from (select doc_id, {o.lf('text')} as t from docs)),
pl as (select doc_id, i as line_no, arr[i] as raw from dl, unnest(generate_series(1, len(arr))) as g(i)),
cl as (select doc_id, line_no, raw, {o.redact(f"replace({o.rtrim('raw')}, chr(9), '    ')")} as line from pl)"""
ORACLES["line_severity"] = RAW_LINES + f"""
select doc_id, line_no, {o.text_severity("'UNKNOWN'", 'line')} as severity, {o.fingerprint('line')} as fingerprint,
  {o.raw_line_level('raw')} as raw_level, {o.signature('raw')} as signature, {o.http_status('raw')} as http_status from cl"""
# fixed values: word, severity as a JSON level, whether a line may lead with it
_level_words = """0 CRITICAL n,1 CRITICAL n,2 CRITICAL n,3 ERROR n,4 WARNING n,5 INFO n,6 INFO n,7 INFO n,8 UNKNOWN n, UNKNOWN n,
F CRITICAL n,alert CRITICAL n,Crit CRITICAL n,FATAL CRITICAL y,critical CRITICAL n,PANIC CRITICAL n,E ERROR n,error ERROR n,Err ERROR n,
SEVERE ERROR n,w WARNING n,WARN WARNING y,Warning WARNING n,I INFO n,d INFO n,info INFO n,NOTICE INFO n,Debug INFO n,TRACE INFO y,
V UNKNOWN n,verbose UNKNOWN n,emerg UNKNOWN n,ERRORS UNKNOWN y,Tracer UNKNOWN n""".replace("\n", "").split(",")
_level_rows = ", ".join(f"({k}, {q(w)}, {q(s)}, {str(y == 'y').lower()})" for k, (w, s, y) in enumerate(x.split(" ") for x in _level_words))
ORACLES["level_words"] = f"""
select o_orderkey, w.word, w.severity, o_orderstatus = 'P' and w.leads as leading_level
from orders join (values {_level_rows}) as w(k, word, severity, leads) on o_orderkey % {len(_level_words)} = w.k"""


def block_oracle(style: str) -> str:
    return o.pipeline(o.corpus(style)) + " select doc_id, source, severity, content, fingerprint from all_events"


ORACLES["broker_blocks"] = block_oracle("broker")
ORACLES["compiler_blocks"] = block_oracle("compiler")
ORACLES["build_context"] = "with " + o.clean_ctes(o.corpus("build")) + f""",
h as (select *, max(case when regexp_matches(line, {q(BUILD_MARKER)}) then 1 else 0 end)
   over (partition by doc_id order by line_no rows between 2 preceding and 2 following) as keep from cl),
k as (select *, lag(keep) over (partition by doc_id order by line_no) as before from h)
select doc_id, string_agg(case when before = 0 then {q(OMITTED)} || {NL} else '' end || line, {NL} order by line_no) as content
from k where keep = 1 group by doc_id"""

# --- detection and events
ORACLES["detected_formats"] = MIXED + """
select l.doc_id, replace(l.ids, ' + ', ',') as format_ids, l.supported,
  case when l.supported then p.n_events else 0 end as event_count, l.detected_format
from labelled l left join per_doc p using (doc_id)"""
# What the grammar of each profile gives, in the order in which events take turns.
PROFILE_RESULTS = """
cargo-rustc-error|line 1; lines 2-4; lines 5-6|INFO,ERROR,ERROR
rustc-clippy-short-diagnostic|line 1; lines 2-3|WARNING,ERROR
docker-cli-error|lines 1-2|ERROR
docker-buildkit-error|lines 1-4|ERROR
gcc-compiler|line 1|ERROR
gpp-compiler|line 1|ERROR
git-cli-error|line 1|CRITICAL
javac-compiler|line 1|ERROR
java-exception|lines 1-2|ERROR
node-exception|lines 1-2|ERROR
npm-cli-error|lines 1-2|ERROR
postgres-client-error|line 1|ERROR
python-traceback|lines 1-3|ERROR
shell-command-not-found|line 1|ERROR
browser-chromium-v8-stack|lines 1-2|ERROR
browser-firefox-stack|lines 1-2|ERROR
browser-safari-webkit-stack|lines 1-3|ERROR
browser-console-security|line 1|ERROR
browser-minified-v8-stack|lines 1-2|ERROR
react-browser-error|line 1|ERROR
vue-browser-error|line 1|ERROR
angular-browser-error|line 1|ERROR
dotnet-exception|lines 1-2|ERROR
msbuild-diagnostic|line 1|ERROR
go-panic|lines 1-4|CRITICAL
go-test-failure|lines 1-2|ERROR
kubernetes-events|line 1|WARNING
kubernetes-prefixed-pod-log|line 1; lines 2-3|UNKNOWN,ERROR
nginx-error|line 1; line 2|CRITICAL,INFO
nginx-access|line 1; line 2|ERROR,UNKNOWN
mysql-error-log|line 1; line 2|WARNING,UNKNOWN
redis-log|line 1; line 2|UNKNOWN,ERROR
mongodb-json-log|JSON item 1 / MongoDB; JSON item 2 / MongoDB|WARNING,CRITICAL
systemd-journal-short|line 1; line 2|UNKNOWN,ERROR
systemd-journal-json|JSON item 1 / journal|CRITICAL
native-asan|line 1|CRITICAL
native-gdb-backtrace|lines 1-2|CRITICAL
native-crash|line 1|CRITICAL
android-logcat|lines 1-2; line 3|WARNING,INFO
apache-error-log|line 1; line 2|INFO,ERROR
bgl-ras|line 1; line 2|CRITICAL,INFO
hadoop|lines 1-2; line 3|WARNING,CRITICAL
hdfs|line 1; line 2|INFO,ERROR
healthapp|line 1; line 2|UNKNOWN,WARNING
hpc-failure|line 1; line 2|ERROR,UNKNOWN
linux-syslog|line 1; line 2|UNKNOWN,CRITICAL
mac-unified-syslog|line 1|UNKNOWN
openssh-auth|line 1; line 2|UNKNOWN,ERROR
openstack|line 1; line 2|INFO,WARNING
proxifier|line 1; line 2|ERROR,UNKNOWN
spark|line 1; line 2|WARNING,INFO
thunderbird-ras|line 1|UNKNOWN
windows-cbs|line 1; line 2|WARNING,INFO
zookeeper|line 1; line 2|WARNING,INFO
prometheus-logfmt|line 1; line 2|ERROR,INFO
aws-vpc-flow-default|line 1; line 3; line 4|ERROR,WARNING,INFO
kafka-broker-log4j|lines 1-2; line 3|ERROR,INFO
opensearch-application-log|line 1|WARNING
rabbitmq-plaintext|line 1; line 2|ERROR,INFO
elastic-ecs-server-json|JSON item 1 / Elastic ECS|WARNING
gcp-http-request|JSON item 1|CRITICAL
gcp-proto-payload-audit|JSON item 1 / protoPayload|ERROR
gcp-text-payload|JSON item 1 / textPayload|ERROR
gcp-json-payload|JSON item 1 / jsonPayload|INFO
""".split("\n")[1:-1]
_results = ", ".join(f"({k}, " + ", ".join(map(q, row.split("|"))) + ")" for k, row in enumerate(PROFILE_RESULTS))
ORACLES["profile_detections"] = f"""
select event_id as doc_id, r.id as format_ids, true as supported, r.sources, r.severities
from events join (values {_results}) as r(k, id, sources, severities) on event_id % {len(PROFILE_RESULTS)} = r.k"""
ORACLES["format_candidates"] = "with " + o.clean_ctes(MIX) + " " + " union all ".join(
    f"select doc_id, {q(p.id)} as id, {p.score} as score from cleaned where {o.detector(p, 'trimmed')}"
    for p in BUILT_IN if p.record_kind == "text")
for style in ("broker", "journal", "cloud", "flow", "access", "build", "compiler", "trace"):
    ORACLES[f"{style}_events"] = o.pipeline(o.corpus(style)) + EVENTS
ORACLES["log_events"] = MIXED + EVENTS
ORACLES["severity_counts"] = MIXED + " select doc_id, severity, count(*) as events from ev group by all"
ORACLES["important_counts"] = MIXED + f" select doc_id, count(*) as events, count(*) filter (where {IMPORTANT}) as important_events from ev group by doc_id"
ORACLES["event_groups"] = MIXED + " select doc_id, first_seq, source, severity, content, fingerprint, repeats from groups"
ORACLES["corpus_templates"] = MIXED + """
select fingerprint, cast(sum(repeats) as bigint) as total_repeats, count(*) as documents,
  arg_min(content, doc_id * 10000000 + first_seq) as example from groups group by fingerprint"""
ORACLES["line_templates"] = f"""
with l as (select doc_id, unnest({o.lines_of('text')}) as line from documents),
d as (select doc_id, {o.fingerprint('line')} as fingerprint, count(*) as n from l group by all)
select fingerprint, cast(sum(n) as bigint) as total_repeats, count(*) as documents from d group by fingerprint"""

# --- preparation
ORACLES["prepared_summary"] = PREP + " select * from summary"
ORACLES["prepared_batches"] = PREP + " select * from batches"
ORACLES["document_summary"] = DOCS + " select * from summary"
ORACLES["document_batches"] = DOCS + " select * from batches"
ORACLES["page_batches"] = PAGES + " select * from batches"
OWNERS = o.prepared(o.corpus_sql("duckdb", by="owner"), 3000)
ORACLES["line_summary"] = OWNERS + " select * from summary"
ORACLES["line_batches"] = OWNERS + " select * from batches"
ORACLES["line_groups"] = OWNERS + """ select doc_id, source, severity, content, fingerprint, repeats from groups
  where doc_id % 9 <> 8"""
ORACLES["line_page_batches"] = PAGES + " select * from batches"
ORACLES["file_lines"] = """
select page_id % 3 as part, count(*) as lines, cast(sum(len(html) + 1) as bigint) as chars, cast(0 as bigint) as misnumbered from pages group by 1"""
ORACLES["parsed_previews"] = PREP + " select doc_id, case when supported then parsed_text else clean end as parsed_preview from choice"
ORACLES["batch_previews"] = PREP + f"""
select doc_id, string_agg(content, {NL}||{NL}||'--- next batch ---'||{NL}||{NL} order by batch_index) as payload from batches group by doc_id"""
ORACLES["raw_preparation"] = MIXED + f"""
select l.doc_id, 'raw (preparation disabled)' as detected_format, len(c.text) as original_chars,
  {o.tokens('len(c.text)')} as estimated_tokens, case when len(c.text) <= 3200 then c.clean end as content,
  case when len(c.text) <= 3200 then case when l.supported then t.parsed_text else c.clean end end as parsed_preview,
  case when len(c.text) > 3200 then 'Raw log has ' || len(c.text) || ' characters but the current limit is 3200. Raise the limit or enable normalization.' end as error
from labelled l join cleaned c using (doc_id) left join texts t using (doc_id)"""
TOTALS = """count(*) as documents, cast(sum(original_chars) as bigint) as chars_before,
  cast(sum(normalized_chars) as bigint) as chars_after, cast(sum(event_count) as bigint) as events,
  cast(sum(important_events) as bigint) as important_events, cast(sum(duplicate_count) as bigint) as duplicates,
  cast(sum(batch_count) as bigint) as batches, count(*) filter (where not normalized) as fallbacks"""
ORACLES["corpus_totals"] = PREP + f" select detected_format, selected_variant, {TOTALS} from summary group by rollup (detected_format, selected_variant)"
ORACLES["corpus_review"] = o.prepared(MIX, 12000) + """
select 'log-' || doc_id || '.log' as file, detected_format, original_chars, normalized_chars, event_count, important_events,
  duplicate_count, batch_count, round(case when original_chars = 0 then 0.0 else (1 - normalized_chars / original_chars) * 100 end, 4) as reduction_percent
from summary"""
ORACLES["review_reports"] = PREP + f""",
bt as (select doc_id, string_agg('### Batch ' || (batch_index + 1) || {NL}||{NL}||'```text'||{NL} || content || {NL}||'```', {NL}||{NL} order by batch_index) as b from batches group by doc_id)
select s.doc_id, '# log-' || s.doc_id || '.log' || {NL}||{NL} || 'Format: `' || s.detected_format || '` · chars ' || original_chars || '→' || normalized_chars
  || ' · events ' || event_count || ' · important ' || important_events || ' · duplicates ' || duplicate_count || ' · batches ' || batch_count
  || {NL}||{NL}||'## Raw'||{NL}||{NL}||'```text'||{NL} || c.clean || {NL}||'```'||{NL}||{NL}||'## Parsed'||{NL}||{NL}||'```text'||{NL}
  || case when c.supported then c.parsed_text else c.clean end || {NL}||'```'||{NL}||{NL}||'## Sent batches'||{NL}||{NL} || coalesce(bt.b, '') || {NL} as report
from summary s join choice c using (doc_id) left join bt using (doc_id)"""

# --- prompts and conversations
ORACLES["history_within_budget"] = f"""
with s as (select *, cast(1000 - (sum(len(text)) over (partition by conv_id order by turn desc) - len(text)) as bigint) as room from conversations)
select conv_id, turn, role, case when len(text) <= room then text when room <= 25 then right(text, room)
  else '[earlier text truncated]' || {NL} || right(text, room - 25) end as text from s where room > 0"""
ORACLES["latest_questions"] = """
select conv_id, max(turn) as turn, arg_max(text, turn) as text from conversations where role = 'user' group by conv_id"""
for name, n in (("recent_messages", 3), ("kept_messages", 100)):
    ORACLES[name] = f"select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= {n}"
ORACLES["conversation_titles"] = f"""
with f as (select conv_id, trim(arg_min(text, turn), ' ') as question from conversations where role = 'user' group by conv_id),
t as (select conv_id, coalesce({o.lines_of('question')}[1], 'ok')[1:28] as title from f)
select conv_id, case when {o.trim('title')} = '' then 'Chat ' || conv_id else title end as title from t"""
ORACLES["batch_prompts"] = DOCS + f"""
select b.doc_id, b.batch_index, s.batch_count as batch_total,
  case when s.batch_count > 1 then 'Log batch ' || (b.batch_index + 1) || '/' || s.batch_count || ':' || {NL}||{NL} else '' end
  || {q(INSTRUCTION)} || {NL}||{NL} || b.content as prompt
from batches b join summary s using (doc_id)"""
ORACLES["announcements"] = PREP + """
select doc_id, 'Analyze log-' || doc_id || '.log: ' || event_count || ' events, ' || duplicate_count || ' duplicates removed, ' || batch_count || ' batches.' as message from summary"""
ORACLES["synthesis_prompts"] = f"""
select conv_id as doc_id, {q(SYNTHESIS)} || string_agg(text, {NL}||{NL} order by turn) as prompt
from conversations where role = 'assistant' group by all"""
ORACLES["request_costs"] = f"""
select conv_id, turn, round(case when turn % 3 > 0 or turn % 2 > 0 then {o.tokens('len(text)')} * ((turn % 3) * 0.5::double) / 1000000.0::double
   + 1500 * ((turn % 2) * 2.0::double) / 1000000.0::double end, 9) as max_cost,
  'Request ' || {o.tokens('len(text)')} || ' tokens · Response ' || coalesce(cast(case when turn % 5 <> 4 then turn * 100 + 7 end as varchar), '?') || ' tokens'
  || case when turn % 5 <> 4 and (turn % 3 > 0 or turn % 2 > 0) then printf(' · ≈$%.4f', {o.tokens('len(text)')} * ((turn % 3) * 0.5::double) / 1000000.0::double
       + (turn * 100 + 7) * ((turn % 2) * 2.0::double) / 1000000.0::double) else '' end
  || case when turn % 4 <> 3 then ' · ' || turn || '.5 tok/s' else '' end
  || case when turn % 6 <> 5 then ' · TTFT ' || turn || '.25s' else '' end as usage
from conversations"""
ANSWERS = f"""(select conv_id, turn, text as orig, case turn % 4
  when 0 then '  cause: ' || text || {NL} || 'FIX: do x ' || {NL} || 'Verify: run y' || {NL} || 'fix: last'
  when 1 then 'see {{"a": 1, "b": {{"c": 2}}}} done' || {NL} || text
  when 2 then '}} nothing {{' || text else text end as text from conversations)"""
ORACLES["answer_sections"] = f"""
select conv_id, turn, case when turn % 4 = 0 then {o.trim(o.lines_of('orig') + '[1]')} else {o.trim('text')} end as cause,
  case when turn % 4 = 0 then 'last' else '' end as fix, case when turn % 4 = 0 then 'run y' else '' end as verify
from {ANSWERS}"""
ORACLES["answer_json"] = f"""
with a as (select conv_id, turn, text, instr(text, '{{') as s,
  case when instr(text, '}}') > 0 then len(text) - instr(reverse(text), '}}') + 1 end as e from {ANSWERS})
select conv_id, turn, case when s > 0 and e > s then text[s:e] end as json,
  case when s = 0 then 'provider returned no JSON object' when e is null then 'provider returned incomplete JSON'
    when s >= e then 'provider returned invalid JSON bounds' end as error from a"""
ORACLES["request_payloads"] = """
select conv_id, turn, protocol, text as content, case when protocol <> 'generate_content' then 'gpt-5-x' end as model,
  case protocol
  when 'responses' then '{"model":"gpt-5-x","instructions":"Be brief.","input":[{"role":"' || role || '","content":[{"type":"input_text","text":'
    || t || '}]}],"max_output_tokens":1500,"store":false,"reasoning":{"effort":"low"}}'
  when 'chat' then '{"model":"gpt-5-x","messages":[{"role":"system","content":"Be brief."},{"role":"' || role || '","content":' || t || '}],"max_tokens":1500}'
  when 'local' then '{"model":"gpt-5-x","input":' || t || ',"system_prompt":"Be brief.","max_output_tokens":1500,"store":false}'
  when 'generate_content' then '{"systemInstruction":{"parts":[{"text":"Be brief."}]},"contents":[{"role":"' || case role when 'assistant' then 'model' else 'user' end
    || '","parts":[{"text":' || t || '}]}],"generationConfig":{"maxOutputTokens":1500}}'
  else '{"model":"gpt-5-x","system":"Be brief.","messages":[{"role":"' || case role when 'assistant' then 'assistant' else 'user' end
    || '","content":[{"type":"text","text":' || t || '}]}],"max_tokens":1500}' end as body
from (select *, cast(to_json(text) as varchar) as t from conversations), (values ('responses'), ('chat'), ('local'), ('generate_content'), ('messages')) as p(protocol)"""
ORACLES["stored_answers"] = """
with p as (select *, (conv_id + turn) % 6 as pick from conversations)
select conv_id, turn, case when pick = 2 then trim(text, ' ' || chr(10) || chr(9)) when pick < 5 then text end as text, case when pick < 5 then len(text) end as input_tokens,
  case when pick < 5 then turn end as output_tokens, case when pick = 5 then 'response contained no text' end as error,
  case when pick < 5 then 'ok' when turn % 2 = 0 then 'transient' else 'final' end as outcome,
  case when pick = 5 then 'HTTP ' || case when turn % 2 = 0 then 429 else 401 end || ': bad [REDACTED]' end as api_error from p"""
ORACLES["listed_models"] = """
with n as (select p_size, 'm-' || lower(p_type) || '-' || p_size as name from part)
select distinct provider, name as model from n, (values ('generate_content'), ('local'), ('listed')) as p(provider)
where provider = 'listed' or (provider = 'local' and p_size % 2 = 0) or (provider = 'generate_content' and p_size % 3 <> 0)"""

# --- catalog as data
PARTS = """(select p_partkey, 'p-' || lower(p_type) || '-' || p_size as id, 'user/' || lpad(cast(p_partkey as varchar), 12, '0') || '.json' as path,
  p_name as application, p_brand as body, p_partkey as version, p_size from part)"""
CATALOG = f"""parts as {PARTS},
base as (select id, min(p_partkey) as ordinal, arg_min(application, p_partkey) as application, arg_min(body, p_partkey) as body,
   min(p_size) as p_size, case when min(p_size) % 2 = 0 then 'built-in' else 'user' end as origin from parts group by id),
newest as (select id, arg_max(application, p_partkey) as application, arg_max(body, p_partkey) as body from parts where p_size % 5 = 0 group by id),
disabled as (select id from base where p_size % 7 = 0),
over as (select b.id, b.ordinal, coalesce(n.application, b.application) as application, coalesce(n.body, b.body) as body,
   case when n.id is not null then 'override' else b.origin end as origin from base b left join newest n using (id))"""
W_CAT = "with " + CATALOG
PROBLEMS = {
    1: "'invalid format id: ' || upper(id)", 2: "'invalid record kind: ' || id", 3: "'empty detector: ' || id",
    4: "'invalid detector in: ' || id", 5: "'invalid regex: (open'", 6: "'json parser on text format: ' || id",
    7: "'unsupported delimiter: ' || id", 8: "'invalid severity rule: ' || id",
    9: "'expected schema_version 3 and raw fallback'",
}
ORACLES["profile_violations"] = f"""with p as {PARTS}
select path, case when p_size % 10 = 1 then upper(id) else id end as id, case p_size % 10 {' '.join(f'when {k} then {v}' for k, v in PROBLEMS.items())} end as problem
from p where p_size % 10 > 0
union all select path, id, 'invalid format id: ' || id from p where p_size % 10 <> 1 and not regexp_matches(id, '^[a-z0-9-]+$')"""
ORACLES["profile_merge"] = f"""with p as {PARTS}, f as (select id, min(path) as owner, bool_or(p_size = 1) as known from p group by id)
select p.path, p.id, not known and p.path = owner as accepted,
  case when known or p.path <> owner then 'format id already exists: ' || p.id end as reason from p join f using (id)"""
ORACLES["profile_overrides"] = W_CAT + " select id, ordinal, application, body, origin from over"
ORACLES["unknown_overrides"] = W_CAT + """
select id, 'override: unknown profile: ' || id as reason from newest where id not in (select id from base where id not in (select id from disabled))"""
ORACLES["active_profiles"] = W_CAT + " select id, body from base where id not in (select id from disabled)"
ORACLES["profile_listing"] = W_CAT + " select id, application, origin, id not in (select id from disabled) as active from base"
ORACLES["registry_status"] = W_CAT + """
select count(*) filter (where origin = 'built-in') as built_in, count(*) filter (where origin = 'user') as user,
  count(*) filter (where origin = 'override') as overrides, count(*) filter (where id not in (select id from disabled)) as active from over"""
ORACLES["profile_lookup"] = W_CAT + """
select b.id, case when d.id is null then b.body when n.id is not null then n.body else b.body end as body,
  case when d.id is null then 'active' when n.id is not null then 'override' else 'base' end as found_in
from base b left join disabled d using (id) left join newest n using (id)"""
ORACLES["profile_install"] = W_CAT + """, dr as (select regexp_replace(id, '-10$', '-new') as id, body from newest)
select d.id, d.body, b.id is null as installed, case when b.id is not null then 'schema already exists: ' || d.id end as reason
from dr d left join base b using (id)"""
ORACLES["profile_store"] = W_CAT + """
select b.id, case when n.id is not null then 'override' else b.origin end as origin,
  case when n.id is not null then coalesce(n.application, b.id) else b.application end as application,
  case when n.id is not null then n.body else b.body end as body, b.id in (select id from disabled) as disabled
from base b left join newest n using (id)
union all
select regexp_replace(id, '-10$', '-new') as id, 'draft', application, body, false from newest where id like '%-10'"""
ORACLES["profile_upsert"] = W_CAT + " select id, arg_max(body, version) as body, max(version) as version from parts group by id"
ORACLES["profile_restore"] = W_CAT + " select id, origin, body, false as disabled from base"
ORDERS = o.order_corpus_sql("duckdb")
ORACLES["draft_validation"] = o.pipeline(ORDERS, [ORDER_PROFILE]) + """
select l.doc_id, l.ids as format_ids, case when l.supported then p.n_events else 0 end as event_count,
  case when not l.supported then 'schema does not parse the supplied sample' end as error
from labelled l left join per_doc p using (doc_id)"""
ORACLES["update_validation"] = o.pipeline(MIX, [ORDER_PROFILE]) + """
select l.doc_id, case when l.supported then p.n_events else 0 end as event_count,
  case when not l.supported then 'updated schema does not parse the supplied sample' end as error
from labelled l left join per_doc p using (doc_id)"""
ORACLES["update_gates"] = MIXED + """
select doc_id, case when not supported then 'confirm' when ids = 'kafka-broker-log4j' then 'accept' else 'reject' end as decision,
  case when supported and ids <> 'kafka-broker-log4j' then 'wrong update log: selected kafka-broker-log4j, detected ' || ids end as reason from labelled"""
ORACLES["uncovered_documents"] = MIXED + " select doc_id, detected_format from labelled where not supported"
ORACLES["order_events"] = o.pipeline(ORDERS, [*BUILT_IN, ORDER_PROFILE]) + EVENTS
ORACLES["comma_order_events"] = o.pipeline(
    f"select doc_id, replace(text, '|', ',') as text from ({ORDERS})", [*BUILT_IN, ORDER_PROFILE, COMMA_PROFILE]) + EVENTS
ORACLES["tab_order_events"] = f"""
with l as (select doc_id, string_split(text, {NL}) as ls from ({ORDERS})),
r as (select doc_id, i - 1 as first, string_split(ls[i], '|') as f from l, unnest(generate_series(1, len(ls))) as g(i))
select doc_id, first, case when f[2] = 'P' then 'ERROR' when f[4] in ('1-URGENT', '2-HIGH') then 'WARNING' else 'INFO' end as level,
  'order=' || f[1] || ' status=' || f[2] || ' price=' || f[3] || ' priority=' || f[4] as content
from r where len(f) >= 4"""
CATALOG_ROWS = ", ".join(
    f"({q(p.id)}, {q(p.label)}, {p.catalog_rank if p.catalog_rank is not None else 'null'})" for p in BUILT_IN)
ORACLES["format_usage"] = MIXED + f"""
, used as (select doc_id, unnest(string_split(ids, ' + ')) as id from labelled where supported)
select u.id, c.application, cast(c.rank as integer) as catalog_rank, count(*) as documents from used u
join (values {CATALOG_ROWS}) as c(id, application, rank) on c.id = u.id group by all"""
COVER = """(select p_partkey + case when p_size = 13 then 1 else 0 end as rank, 'tier-' || (p_size % 5) as volume, p_name as application,
  case p_size % 4 when 0 then 'covered' when 1 then 'partial' when 2 then 'raw' else 'n/a' end as coverage, p_type as adapter_or_gap from part)"""
ORACLES["coverage_counts"] = f"""
select volume, count(*) filter (where coverage = 'covered') as covered, count(*) filter (where coverage = 'partial') as partial,
  count(*) filter (where coverage = 'raw') as raw, count(*) as total from {COVER} group by volume"""
ORACLES["coverage_gaps"] = f"""
with c as (select rank, count(*) as n from {COVER} group by rank), w as (select unnest(generate_series(1, (select count(*) from part))) as rank)
select coalesce(w.rank, c.rank) as rank, coalesce(c.n, 0) as rows from w full outer join c on w.rank = c.rank
where coalesce(c.n, 0) <> 1 or w.rank is null"""
ORACLES["coverage_report"] = f"select rank, '| ' || concat_ws(' | ', rank, volume, application, coverage, adapter_or_gap) || ' |' as line from {COVER}"
ORACLES["draft_envelopes"] = f"select conv_id || '-' || turn as id, text as model_answer, len(text) as sample_chars_sent, '1' as metadata_version, 'a.log' as source_log, 'p' as provider, 'm' as model, '{{}}' as validated_schema from {ANSWERS}"

ORACLES["coverage_files"] = f"select * from {COVER}"
PROFILE_ROWS = """(select lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g')) || '-' || (p_size % 10) as file, p_partkey,
  'p-' || lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g')) || '-' || p_size as id from part)"""
ORACLES["profile_files"] = f"""
select file, row_number() over (partition by file order by p_partkey) - 1 as position, id,
  count(*) over (partition by file) as format_count from {PROFILE_ROWS}"""
# One file after the other; the ids taken so far travel along.
ORACLES["profile_file_merge"] = f"""
with recursive p as materialized {PROFILE_ROWS},
f as materialized (select file, row_number() over (order by file) as n, list(id order by p_partkey) as ids from p group by file),
step(n, file, taken, clash) as (
  select 0::bigint, null::varchar, (select coalesce(list(distinct id), []) from p where p_partkey % 97 = 1 and suffix(id, '7')), null::varchar
  union all
  select f.n, f.file, case when len(list_filter(f.ids, lambda x: list_contains(s.taken, x))) = 0 then list_concat(s.taken, f.ids) else s.taken end,
    list_filter(f.ids, lambda x: list_contains(s.taken, x))[1]
  from step s join f on f.n = s.n + 1)
select file as path, clash is null as accepted, 'format id already exists: ' || clash as reason from step where n > 0"""

# --- audit and sampling
SIDES = PREP + f""",
raw_side as (select c.doc_id, {o.rtrim('l')} as line from (select doc_id, unnest({o.lines_of('trimmed')}) as l from cleaned) c),
raws as (select doc_id, {o.signature('line')} as sig, {o.raw_line_level('line')} as level from raw_side where line <> ''),
pars as (select doc_id, {o.signature(o.rtrim('content'))} as sig, severity as level, repeats, content from groups),
sigs as (select coalesce(r.doc_id, p.doc_id) as doc_id, coalesce(r.n, 0) as raw_n, coalesce(p.n, 0) as parsed_n
  from (select doc_id, sig, count(*) as n from raws group by all) r
  full outer join (select doc_id, sig, sum(repeats) as n from pars group by all) p on r.doc_id = p.doc_id and r.sig = p.sig),
sg as (select doc_id, cast(sum(raw_n) as bigint) as raw_events, cast(sum(parsed_n) as bigint) as parsed_events,
   cast(sum(greatest(raw_n - parsed_n, 0)) as bigint) as missing_signatures,
   cast(sum(greatest(parsed_n - raw_n, 0)) as bigint) as extra_signatures from sigs group by doc_id),
lvs as (select coalesce(r.doc_id, p.doc_id) as doc_id, coalesce(r.level, p.level) as level, coalesce(r.n, 0) as raw_n, cast(coalesce(p.n, 0) as bigint) as parsed_n
  from (select doc_id, level, count(*) as n from raws group by all) r
  full outer join (select doc_id, level, sum(repeats) as n from pars group by all) p on r.doc_id = p.doc_id and r.level = p.level),
lo as (select doc_id, bool_and(raw_n = parsed_n) as severity_ok from lvs group by doc_id),
vd as (select s.*, raw_events = parsed_events as events_ok, missing_signatures = 0 and extra_signatures = 0 as signatures_ok, severity_ok,
   case when raw_events = parsed_events and missing_signatures = 0 and extra_signatures = 0 and severity_ok then 'OK' else 'REVIEW' end as status
  from sg s join lo using (doc_id))"""
ORACLES["report_events"] = PREP + f"""
select doc_id, severity as level, count(*) as groups, cast(sum(repeats) as bigint) as events,
  cast(sum(len({o.rtrim('content')})) as bigint) as chars from groups group by all"""
ORACLES["parsed_sections"] = PREP + f"""
select doc_id, string_split(case when supported then parsed_text else clean end, {NL} || '```')[1] as parsed from choice"""
ORACLES["audit_signatures"] = SIDES + " select * from sg"
ORACLES["audit_levels"] = SIDES + " select * from lvs"
ORACLES["audit_verdicts"] = SIDES + " select * from vd"
ORACLES["audit_result"] = SIDES + " select count(*) filter (where status = 'OK') as ok, count(*) filter (where status = 'REVIEW') as review from vd"
ORACLES["priority_lines"] = f"""
with dl as (select doc_id, source, {o.lines_of('t')} as arr from (select doc_id, source, {o.lf('text')} as t from documents)),
l as (select source, doc_id, i - 1 as line_no, arr[i] as line from dl, unnest(generate_series(1, len(arr))) as g(i)),
r as (select *, regexp_matches(line, {q(PRIORITY)}) as priority from l),
k as (select *, row_number() over (partition by source, priority order by doc_id, line_no) as rank,
   count(*) filter (where priority) over (partition by source) as found from r)
select source, doc_id, line_no, priority, rank, {o.pii('line')} as line from k
where (case when priority then rank <= 20 else rank <= 40 - least(found, 20) end) and {o.trim('line')} <> ''"""
WANT = " ".join(f"when {STYLES.index(s)} then {q(f)}" for s, f in EXPECTED.items())
STYLE_NO = f"(doc_id // 1000000) % {len(STYLES)}"
ORACLES["golden_mismatches"] = MIXED + f"""
select * from (select doc_id, case {STYLE_NO} {WANT} else 'unknown -> raw' end as expected_format, detected_format from labelled)
where detected_format <> expected_format"""
ORACLES["ambiguous_documents"] = MIXED + " select doc_id, detected_format from labelled where ids = '' or contains(ids, ' + ')"

# --- streaming
STREAM = f"""s0 as (select event_id, cast(user_id as varchar) as source, ts as event_time,
   case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end as level,
   concat('[', event_id, '] ', case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end, ' ', event_type,
     ' value ', cast(floor(value * 100) as bigint), ' token=t', user_id, chr(9)) as raw from events),
s1 as (select *, {o.redact(f"replace({o.rtrim('raw')}, chr(9), '    ')")} as line, replace({o.rtrim('raw')}, chr(9), '    ') as plain from s0),
s as (select *, {o.text_severity('level', 'line')} as severity, {o.fingerprint('line')} as fingerprint from s1)"""
ORACLES["stream_lines"] = f"with {STREAM} select event_id, line, severity, fingerprint from s"
ORACLES["stream_first_templates"] = f"with {STREAM} select distinct source, fingerprint from s"


def windows(hours: int, slide: int) -> str:
    starts = hours // slide
    return f"""with {STREAM}, w as (select severity, time_bucket(interval '{slide} hours', event_time, timestamp '1970-01-01') - interval '1 hour' * ({slide} * i) as window_start
  from s, unnest(generate_series(0, {starts - 1})) as g(i))
select window_start, window_start + interval '{hours} hours' as window_end, severity, count(*) as events,
  count(*) filter (where {IMPORTANT}) as important_events from w group by window_start, severity"""


ORACLES["stream_windows"] = windows(24, 24)
ORACLES["stream_sliding"] = windows(24, 12)
ORACLES["stream_sessions"] = f"""with {STREAM},
g as (select *, case when event_time >= lag(event_time) over (partition by source order by event_time) + interval '1 day' then 1 else 0 end as opens from s),
h as (select *, sum(opens) over (partition by source order by event_time, event_id) as sess from g),
a as (select source, sess, min(event_time) as session_start, max(event_time) + interval '1 day' as session_end, count(*) as events,
   count(*) filter (where {IMPORTANT}) as important_events from h group by source, sess)
select source, session_start, session_end, events, important_events from a"""
ORACLES["stream_templates"] = f"with {STREAM} select fingerprint, count(*) as total_repeats, min(line) as example from s group by fingerprint"
ORACLES["stream_audit"] = f"with {STREAM} select event_id, source, severity, len(line) as chars from s"
ORACLES["stream_blocks"] = f"""with {STREAM},
b as (select *, regexp_extract(plain, '^\\[\\d+\\] (ERROR|WARN)', 1) as lev from s),
c as (select *, count(nullif(lev, '')) over (partition by source order by event_id) as blk from b),
d as (select source as origin, blk, min(event_id) - 1 as first, max(lev) as lev, string_agg(plain, {NL} order by event_id) as content
  from c where blk > 0 group by source, blk)
select origin, first, {o.text_severity('lev', 'content')} as severity, content, {o.fingerprint('content')} as fingerprint from d"""
