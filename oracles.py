"""DuckDB SQL for the same results: a second, relational formulation of every operator.

The Spark side works on arrays inside a document's row; here the same semantics are spelled with
line tables, window functions, joins and recursive queries over the given tables.
"""

from __future__ import annotations

from collections import defaultdict

from logmill.functions.severity import CONTENT_RULES, JSON_LEVELS, RAW_LEVEL_MAP, RAW_LEVELS, TEXT_LEVELS
from logmill.functions.text import MARKERS
from logmill.plans.catalog import BUILT_IN, Profile
from logmill.plans.detect import by_preference
from logmill.plans.extract import BUILD_MARKER, NO_TIMESTAMP, OMITTED, capture_index
from logmill.plans.synth import corpus_sql, marked_sql, order_corpus_sql

W = r"[\s\x{0B}\x{85}\p{Z}]"
NW = r"[^\s\x{0B}\x{85}\p{Z}]"
NL = "chr(10)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return q("(?m-s)" + pattern)


def rtrim(x: str) -> str:
    return f"regexp_replace({x}, {q(W + '+$')}, '')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + W + '+|' + W + '+$')}, '', 'g')"


def lf(x: str) -> str:
    return f"replace(replace({x}, chr(13)||chr(10), {NL}), chr(13), {NL})"


def lines_of(x: str) -> str:
    """LF text to a list of lines without a trailing empty one."""
    cut = f"case when suffix({x}, {NL}) then {x}[1:len({x})-1] else {x} end"
    return f"case when {x} = '' then []::varchar[] else string_split({cut}, {NL}) end"


def redact(x: str) -> str:
    for marker in MARKERS:
        x = f"regexp_replace({x}, {q(f'^(.*?(?i:{marker})){NW}*')}, {q(chr(92) + '1[REDACTED]')})"
    return x


def redact_all(x: str) -> str:
    pattern = "(?i)(" + "|".join(MARKERS) + ")" + NW + "+"
    return f"regexp_replace({x}, {q(pattern)}, {q(chr(92) + '1[REDACTED]')}, 'g')"


def ascii_lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def fingerprint(x: str) -> str:
    return f"regexp_replace({ascii_lower(x)}, '[0-9]+', '#', 'g')"


def signature(x: str) -> str:
    return f"regexp_replace({rtrim(f'lower({redact_all(x)})')}, '[0-9]+', '#', 'g')"


def pii(x: str) -> str:
    """Unicode words spelled out. The neighbours of a hit stand in groups, so each rule runs twice to
    reach hits that share a neighbour; an address starts at the first word character of its run."""
    word = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
    before, after = f"(^|[^{word}])", f"([^{word}]|$)"
    digits = r"\p{Nd}{1,3}"
    hexes = r"[0-9a-fA-F]"
    rules = [
        (rf"{before}{digits}\.{digits}\.{digits}\.{digits}{after}", r"\1<IP>\2"),
        (rf"{before}{hexes}{{8}}-{hexes}{{4}}-[1-5]{hexes}{{3}}-[89abAB]{hexes}{{3}}-{hexes}{{12}}{after}", r"\1<UUID>\2"),
        (rf"[{word}][{word}.+-]*@[{word}.-]+\.[A-Za-z]{{2,}}{after}", r"<EMAIL>\1"),
    ]
    for pattern, label in rules:
        for _ in range(2):
            x = f"regexp_replace({x}, {q(pattern)}, {q(label)}, 'g')"
    return rtrim(x)


def tokens(x: str) -> str:
    return f"(({x} + 2) // 3)"


def _lookup(x: str, table: dict) -> str:
    parts = " ".join(
        f"when upper({x}) in ({', '.join(q(v) for v in values)}) then '{label}'"
        for label, values in table.items()
    )
    return f"case {parts} end"


def text_severity(level: str, content: str) -> str:
    rules = " ".join(f"when regexp_matches({content}, {q(p)}) then '{s}'" for p, s in CONTENT_RULES)
    return f"coalesce({_lookup(level, TEXT_LEVELS)}, case {rules} else 'UNKNOWN' end)"


def raw_line_level(line: str) -> str:
    found = ", ".join(f"nullif(regexp_extract({line}, {q(p)}, 1), '')" for p in RAW_LEVELS)
    rules = " ".join(
        f"when regexp_matches({line}, {q(p)}) then '{s}'" for p, s in CONTENT_RULES[:3]
    )
    level = f"coalesce({found}, '')"
    return f"coalesce({_lookup(level, RAW_LEVEL_MAP)}, case {rules} else 'UNKNOWN' end)"


# --- JSON -----------------------------------------------------------------------------------

def _key(k: str) -> str:
    return '."' + k + '"'


def at(rec: str, path: str) -> str:
    rest = path[2:]
    literal = q("$" + _key(rest))
    if "." not in rest:
        return f"json_extract({rec}, {literal})"
    nested = q("$" + "".join(_key(k) for k in rest.split(".")))
    return f"coalesce(json_extract({rec}, {literal}), json_extract({rec}, {nested}))"


def at_text(rec: str, path: str) -> str:
    return f"json_extract_string({at(rec, path)}, '$')"


def first_value(rec: str, paths) -> str:
    if not paths:
        return "cast(null as varchar)"
    parts = [f"nullif(nullif(nullif({at_text(rec, p)}, ''), 'null'), '{{}}')" for p in paths]
    return f"coalesce({', '.join(parts)})"


def or_null_word(rec: str, path: str) -> str:
    v = at(rec, path)
    return f"case when {v} is null then null else coalesce({at_text(rec, path)}, 'null') end"


def cond(kind: str, value: str, text: str, rec: str | None) -> str:
    if kind == "path_exists":
        return f"({at(rec, value)} is not null)" if rec else "false"
    return f"regexp_matches({text}, {rx(value)})"


def detector(p: Profile, text: str, rec: str | None = None) -> str:
    parts = [cond(k, v, text, rec) for k, v in p.all]
    if p.any:
        parts.append("(" + " or ".join(cond(k, v, text, rec) for k, v in p.any) + ")")
    return "(" + " and ".join(parts) + ")"


def best_format(profiles, kind: str, text: str, rec: str | None = None) -> str:
    ranked = by_preference(profiles, kind)
    if not ranked:
        return "cast(null as varchar)"
    return "case " + " ".join(f"when {detector(p, text, rec)} then {q(p.id)}" for p in ranked) + " end"


def _json_columns(profiles) -> dict[str, str]:
    """SQL CASE expressions over (fmt, rec) for message, status, level text, stamp, keys, suffix."""
    specs = [(p.id, p.parser) for p in profiles if p.kind == "json_fields"]

    def pick(build, default="null"):
        if not specs:
            return "cast(null as varchar)" if default == "null" else default
        return "case fmt " + " ".join(f"when {q(i)} then {build(s)}" for i, s in specs) + f" else {default} end"

    def message(s):
        parts = [
            (f"{q(f['label'] + '=')} || " if f["label"] else "") + first_value("rec", f["paths"])
            for f in s["fields"]
        ]
        return f"concat_ws(' ', {', '.join(parts)})"

    def keys(s):
        return f"concat_ws('|', {', '.join(or_null_word('rec', p) for p in s['fingerprint_paths'])})"

    return {
        "message": pick(message),
        "status_text": pick(lambda s: first_value("rec", s["status_paths"])),
        "from_text": pick(lambda s: str(s["status_from_text"]).lower(), "false"),
        "nonzero": pick(lambda s: str(s["nonzero_status_is_error"]).lower(), "false"),
        "level_text": pick(lambda s: f"coalesce({first_value('rec', s['severity_paths'])}, {q(s['default_severity'])})"),
        "stamp": pick(lambda s: f"coalesce({first_value('rec', s['timestamp_paths'])}, {q(NO_TIMESTAMP)})"),
        "keys": pick(keys),
        "digits": pick(lambda s: str(s["normalize_fingerprint_digits"]).lower(), "false"),
        "suffix": pick(lambda s: q(s["source_suffix"])),
    }


def http_status(msg: str) -> str:
    toks = f"list_filter(string_split_regex({msg}, {q(W + '+')}), lambda t: regexp_matches(t, '^\\+?[0-9]+$'))"
    nums = f"list_transform({toks}, lambda t: try_cast(t as bigint))"
    return f"list_filter({nums}, lambda n: n between 100 and 599)[1]"


# --- the whole pipeline as CTEs ---------------------------------------------------------------

def clean_ctes(docs: str) -> str:
    """``docs`` -> ``cl`` (line table) and ``cleaned(doc_id, text, clean, trimmed)``."""
    return f"""
docs as materialized ({docs}),
dl as (select doc_id, {lines_of('t')} as arr from (select doc_id, {lf('text')} as t from docs)),
cl as (select doc_id, i as line_no, {redact(f"replace({rtrim('arr[i]')}, chr(9), '    ')")} as line
       from dl, unnest(generate_series(1, len(arr))) as g(i)),
joined as (select doc_id, string_agg(line, {NL} order by line_no) as clean from cl group by doc_id),
cleaned as materialized (select d.doc_id, d.text, coalesce(j.clean, '') as clean,
    {trim("coalesce(j.clean, '')")} as trimmed
  from docs d left join joined j using (doc_id))"""


def format_ctes(profiles) -> str:
    """-> ``typed(doc_id, ..., is_json, fmt)`` and ``recs(doc_id, n, rec, fmt)``."""
    return f"""
kind as (select *, json_valid(trimmed) and regexp_matches(trimmed, '^[\\[{{]') as one,
    list_filter({lines_of('trimmed')}, lambda l: {trim('l')} <> '') as nonblank from cleaned),
kinds as materialized (select *, one or (len(nonblank) > 1 and
    len(list_filter(nonblank, lambda l: not json_valid(l))) = 0) as is_json from kind),
recs0 as (
  select doc_id, i as n, items[i] as rec from
    (select doc_id, case when not one then list_transform(nonblank, lambda l: cast(l as json))
       when starts_with(trimmed, '[') then cast(cast(trimmed as json) as json[])
       else [cast(trimmed as json)] end as items from kinds where is_json),
    unnest(generate_series(1, len(items))) as g(i)),
recs as materialized (select doc_id, n, rec,
    {best_format(profiles, 'json', 'cast(rec as varchar)', 'rec')} as fmt from recs0),
typed as materialized (select *, case when not is_json then
    {best_format(profiles, 'text', 'trimmed')} end as fmt from kinds)"""


def event_ctes(profiles) -> str:
    """-> ``all_events(doc_id, seq, source, severity, content, fingerprint)`` of all documents
    (supported or not), and ``result(doc_id, supported, label)``."""
    by_kind = defaultdict(list)
    for p in profiles:
        if p.record_kind == "text":
            by_kind[p.kind].append(p)

    def ids(ps):
        return ", ".join(q(p.id) for p in ps) or "''"

    block = by_kind["line_blocks"] + by_kind["text_blocks"]
    levels = []
    for p in block:
        pattern = p.parser["start_regex"]
        hit = f"regexp_matches(line, {rx(pattern)})"
        if p.kind == "text_blocks":
            value = q(p.parser["severity"])
        else:
            group = capture_index(pattern, p.parser["severity_capture"])
            default = q(p.parser["default_severity"])
            value = default if group is None else (
                f"coalesce(nullif(regexp_extract(line, {rx(pattern)}, {group}), ''), {default})")
        levels.append(f"when {q(p.id)} then case when {hit} then {value} end")
    level = ("case fmt " + " ".join(levels) + " end") if levels else "cast(null as varchar)"
    pre = [p for p in by_kind["text_blocks"] if p.parser["include_preamble"]]
    pre_level = "case fmt " + " ".join(
        f"when {q(p.id)} then {q(p.parser['preamble_severity'])}" for p in pre) + " end" if pre else "'INFO'"
    whole_level = "case fmt " + " ".join(
        f"when {q(p.id)} then {q(p.parser['severity'])}" for p in by_kind["whole_text"]) + " end" \
        if by_kind["whole_text"] else "''"
    delimited = []
    for p in by_kind["delimited_lines"]:
        s = p.parser
        split = {"whitespace": f"list_filter(string_split_regex(line, {q(W + '+')}), lambda t: t <> '')",
                 "tab": "string_split(line, chr(9))", "comma": "string_split(line, ',')",
                 "pipe": "string_split(line, '|')"}[s["delimiter"]]
        pairs = ", ".join(f"{q(f + '=')} || v[{i}]" for i, f in enumerate(s["fields"], 1))
        rules = " ".join(
            f"when upper(v[{s['fields'].index(r['field']) + 1}]) in ({', '.join(q(x.upper()) for x in r['values'])}) then {q(r['severity'])}"
            for r in s["severity_rules"])
        lev = f"case {rules} else {q(s['default_severity'])} end" if rules else q(s["default_severity"])
        delimited.append(f"""
  union all select doc_id, n, n - 1, n, {lev}, concat_ws(' ', {pairs}) from
    (select doc_id, n, {split} as v from tl where fmt = {q(p.id)}) where len(v) >= {len(s['fields'])}""")
    c = _json_columns(profiles)
    return f"""
tl as materialized (select doc_id, fmt, i as n, len(arr) as total, arr[i] as line from
    (select doc_id, fmt, {lines_of('trimmed')} as arr from typed where fmt is not null),
    unnest(generate_series(1, len(arr))) as g(i)),
lv as (select *, {level} as level from tl where fmt in ({ids(block)})),
bl as (select *, count(level) over (partition by doc_id order by n) as blk,
    count(level) over (partition by doc_id) as starts from lv),
hit as (select *, max(case when regexp_matches(line, {q(BUILD_MARKER)}) then 1 else 0 end)
    over (partition by doc_id order by n rows between 2 preceding and 2 following) as keep
  from tl where fmt in ({ids(by_kind['buildkit'])})),
kept as (select *, lag(keep) over (partition by doc_id order by n) as before from hit),
text_raw(doc_id, ord, first, last, level, content) as (
  select doc_id, blk, min(n) - 1, max(n),
    case when blk = 0 then min({pre_level}) else min(level) end,
    string_agg(line, {NL} order by n) from bl
  where starts > 0 and (blk > 0 or fmt in ({ids(pre)})) group by doc_id, blk
  union all select doc_id, 1, 0, len({lines_of('trimmed')}), {whole_level}, trimmed from typed
    where fmt in ({ids(by_kind['whole_text'])})
  union all select doc_id, 1, 0, max(total), 'ERROR',
    string_agg(case when before = 0 then {q(OMITTED)} || {NL} else '' end || line, {NL} order by n)
    from kept where keep = 1 group by doc_id{''.join(delimited)}),
text_events as (select doc_id, row_number() over (partition by doc_id order by ord) - 1 as seq,
    case when first + 1 = last then 'line ' || last else 'lines ' || (first + 1) || '-' || last end as source,
    {text_severity('level', 'content')} as severity, content, {fingerprint('content')} as fingerprint
  from text_raw),
jm as (select doc_id, n, fmt, rec, {c['message']} as message, {c['status_text']} as status_text,
    {c['from_text']} as from_text, {c['nonzero']} as nonzero, {c['level_text']} as level_text,
    {c['stamp']} as stamp, {c['keys']} as keys, {c['digits']} as digits, {c['suffix']} as suffix
  from recs where fmt is not null),
js as (select *, coalesce(case when regexp_matches(status_text, '^\\+?[0-9]+$') then try_cast(status_text as bigint) end,
    case when from_text then {http_status('message')} end) as status, {ascii_lower('message')} as low from jm),
jv as (select *, case when nonzero and status <> 0 then 'ERROR' when status >= 500 then 'CRITICAL'
    when status >= 400 then 'ERROR' else coalesce({_lookup('level_text', JSON_LEVELS)},
      case when contains(low, 'panic') or contains(low, 'fatal') then 'CRITICAL'
        when contains(low, 'error') or contains(low, 'failed') then 'ERROR'
        when contains(low, 'warn') then 'WARNING'
        when status is not null or contains(low, 'info') then 'INFO' else 'UNKNOWN' end) end as severity from js),
jk as (select *, coalesce(nullif(keys, ''), message) as key from jv),
json_events as (select doc_id, n - 1 as seq, 'JSON item ' || n || suffix as source, severity,
    {trim(f"regexp_replace(concat_ws(' ', stamp, case when regexp_matches({trim('message')}, '^(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)') then '' else severity end, message), {q(W + '+')}, ' ', 'g')")} as content,
    case when digits then {fingerprint('key')} else key end as fingerprint from jk),
all_events as materialized (select * from text_events union all select * from json_events),
per_doc as (select doc_id, count(*) as n_events, bool_and({trim('content')} <> '') as full from all_events group by doc_id),
bad as (select r.doc_id, min(r.n) as at from recs r left join json_events e on r.doc_id = e.doc_id and r.n = e.seq + 1
   where r.fmt is null or e.doc_id is null or {trim('e.content')} = '' group by r.doc_id),
seen as (select r.doc_id, r.fmt, min(r.n) as n from recs r left join bad b using (doc_id)
   where b.at is null or r.n < b.at group by r.doc_id, r.fmt),
jlabel as (select doc_id, string_agg(fmt, ' + ' order by n) as ids from seen group by doc_id),
result as materialized (select t.doc_id, t.is_json, coalesce(case when t.is_json then j.ids else t.fmt end, '') as ids,
    coalesce(case when t.is_json then b.doc_id is null and p.n_events > 0
      else t.fmt is not null and p.n_events > 0 and p.full end, false) as supported
  from typed t left join per_doc p using (doc_id) left join jlabel j using (doc_id) left join bad b using (doc_id)),
labelled as (select *, case when supported then ids when ids = '' then 'unknown -> raw'
    else ids || ' -> raw' end as detected_format from result),
ev as materialized (select e.* from all_events e join result r using (doc_id) where r.supported)"""


def group_ctes() -> str:
    """-> ``groups`` (deduplicated, rendered events) and ``texts`` (rendered documents)."""
    return f"""
grp as (select doc_id, fingerprint, min(seq) as first_seq, count(*) as repeats from ev group by doc_id, fingerprint),
groups as materialized (select g.doc_id, g.first_seq, e.source, e.severity, e.content, g.fingerprint, g.repeats,
    row_number() over (partition by g.doc_id order by g.first_seq) as pos,
    '[' || e.source || ' · ' || e.severity || case when g.repeats > 1 then ' · repeated ' || g.repeats || ' times' else '' end
      || ']' || {NL} || e.content as rendered
  from grp g join ev e on g.doc_id = e.doc_id and g.first_seq = e.seq),
texts as materialized (select doc_id, string_agg(rendered, {NL}||{NL} order by pos) as parsed_text from groups group by doc_id)"""


def greedy_ctes(name: str, pieces: str, budget: str, sep: int) -> str:
    """Greedy batches of ``pieces(doc_id, pos from 1, len, txt, budget)`` -> ``{name}(doc_id, batch, txt)``."""
    joiner = f"{NL}||{NL}" if sep else "''"
    return f"""
{name}_p as materialized ({pieces}),
{name}_w as (
  select doc_id, pos, len as size, 0 as batch from {name}_p where pos = 1
  union all
  select p.doc_id, p.pos,
    case when w.size + p.len + {sep} > {budget} then p.len else w.size + p.len + {sep} end,
    case when w.size + p.len + {sep} > {budget} then w.batch + 1 else w.batch end
  from {name}_w w join {name}_p p on p.doc_id = w.doc_id and p.pos = w.pos + 1),
{name} as materialized (select w.doc_id, w.batch, string_agg(p.txt, {joiner} order by p.pos) as txt
  from {name}_w w join {name}_p p using (doc_id, pos) group by w.doc_id, w.batch)"""


def raw_pieces(source: str, budget: int) -> str:
    """Pieces of ``source(doc_id, txt)``: lines with their line end, long ones cut at the budget."""
    return f"""
select doc_id, row_number() over (partition by doc_id order by i, c) as pos,
  line[c * {budget} + 1 : (c + 1) * {budget}] as txt, len(line[c * {budget} + 1 : (c + 1) * {budget}]) as len
from (select doc_id, i, c, line from
  (select doc_id, i, case when i < len(arr) or suffix(txt, {NL}) then arr[i] || {NL} else arr[i] end as line
   from (select doc_id, txt, {lines_of('txt')} as arr from {source}), unnest(generate_series(1, len(arr))) as g(i)),
  unnest(generate_series(0, (len(line) - 1) // {budget})) as h(c))"""


def pipeline(docs: str, profiles=BUILT_IN) -> str:
    return (
        "with recursive " + clean_ctes(docs) + "," + format_ctes(profiles) + ","
        + event_ctes(profiles) + "," + group_ctes()
    )


def corpus(style: str = "mixed") -> str:
    return corpus_sql("duckdb", style)


def prepared(docs: str, budget: int, profiles=BUILT_IN) -> str:
    """-> ``summary`` and ``batches(doc_id, variant, batch_index, content)``."""
    budget = max(budget, 3000)
    return pipeline(docs, profiles) + f""",
choice as materialized (select l.doc_id, l.detected_format, l.supported, c.text, c.clean, t.parsed_text,
    case when not l.supported then 'F' when len(c.clean) < len(t.parsed_text) then 'R' else 'P' end as pick
  from labelled l join cleaned c using (doc_id) left join texts t using (doc_id)),
raw_in as (select doc_id, clean as txt from choice where pick <> 'P'),
{greedy_ctes('rb', raw_pieces('raw_in', budget), str(budget), 0)},
{greedy_ctes('eb', "select g.doc_id, g.pos, len(g.rendered) as len, g.rendered as txt from groups g join choice c using (doc_id) where c.pick = 'P'", str(budget), 2)},
batches as materialized (select b.doc_id, case when c.pick = 'P' then 'Parsed' else 'Raw' end as variant,
    cast(b.batch as bigint) as batch_index, b.txt as content
  from (select * from rb union all select * from eb) b join choice c using (doc_id)),
counts as (select doc_id, count(*) as event_count,
    count(*) filter (where severity in ('CRITICAL','ERROR','WARNING')) as important_events,
    count(*) - count(distinct fingerprint) as duplicate_count from ev group by doc_id),
summary as (select c.doc_id, c.detected_format, len(c.text) as original_chars,
    case when c.supported then len(c.parsed_text) else len(c.text) end as normalized_chars,
    coalesce(n.event_count, 1) as event_count, coalesce(n.important_events, 0) as important_events,
    coalesce(n.duplicate_count, 0) as duplicate_count,
    {tokens("case c.pick when 'F' then len(c.text) when 'R' then len(c.clean) else len(c.parsed_text) end")} as estimated_tokens,
    case when c.pick = 'P' then 'Parsed' else 'Raw' end as selected_variant,
    coalesce(b.n, 0) as batch_count, c.supported as normalized
  from choice c left join counts n using (doc_id)
  left join (select doc_id, count(*) as n from batches group by doc_id) b using (doc_id))"""
