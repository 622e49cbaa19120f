"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logmill.llm import (
    alignment, fill_middle, fingerprints, language, mixing, neighbours, ngram_join, packing, pii, secret_scan, simhash, token_counts,
    url_filter,
)
from logmill.llm.common import WORD, table
from logmill.session import configure

#: The rank file of the token counts and the version it stands for.
RANKS, RANKS_VERSION = "file:///opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_50k"
#: The two tokenizers whose tokens are aligned.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
URL_RULES = [
    url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(configure(spark), sf_dir, "documents")


def op1_source_mix(spark, sf_dir):
    """Words that the mix of all sources takes of each document."""
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op2_language(spark, sf_dir):
    """The language of every text, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir)
    machines = language.learn(docs.filter(~held_out()))
    return language.predicted(docs, machines).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_secrets(spark, sf_dir):
    """Secrets in every text."""
    return secret_scan.scan(documents(spark, sf_dir))


def op4_url_verdicts(spark, sf_dir):
    """A verdict for every page."""
    return url_filter.judged(table(configure(spark), sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op5_neighbours(spark, sf_dir):
    """The ten nearest vectors found for every hundredth vector."""
    return neighbours.search(table(configure(spark), sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_ngram_components(spark, sf_dir):
    """Documents linked by a Jaccard similarity of at least 0.85 of their four-word shingles."""
    return ngram_join.ngram_components(documents(spark, sf_dir), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op7_length_buckets(spark, sf_dir):
    """Bucket, batch and slot of every document."""
    return packing.pack(documents(spark, sf_dir))


def op8_token_rollup(spark, sf_dir):
    """Token totals by source, language and tokenizer version after inserts, deletes and revisions."""
    return token_counts.corpus_rollup(documents(spark, sf_dir), RANKS, RANKS_VERSION)


def op9_fingerprints(spark, sf_dir):
    """Fingerprints of every text and of its edited form."""
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op10_personal_data(spark, sf_dir):
    """Personal data in every text."""
    return pii.find(documents(spark, sf_dir))


def op11_fill_middle(spark, sf_dir):
    """Digests of every text rearranged for filling in its middle, and of the text rebuilt from that."""
    made = fill_middle.restored(fill_middle.transformed(documents(spark, sf_dir)))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("text", 256).alias("restored_sha256"),
    )


def op12_alignment(spark, sf_dir):
    """How the tokens of two tokenizers line up in every text."""
    return alignment.aligned(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE)


def op13_simhash(spark, sf_dir):
    """SimHash fingerprints of every text and the documents within three bits of each other."""
    return simhash.near_components(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_source_mix, op2_language, op3_secrets, op4_url_verdicts, op5_neighbours, op6_ngram_components,
        op7_length_buckets, op8_token_rollup, op9_fingerprints, op10_personal_data, op11_fill_middle, op12_alignment,
        op13_simhash,
    )
}

_COUNT = f"coalesce(len(regexp_extract_all(text, '{WORD}')), 0)"

ORACLES: dict[str, str] = {}

# Weighted fair queueing over one global order; the shares are found round by round until they stand.
ORACLES["op1_source_mix"] = f"""
with recursive sized as (
  select doc_id, source, {_COUNT} as size, coalesce('s' || source, '~') as k,
         md5(coalesce(cast(doc_id as varchar), '')) as o from documents),
sizes as (
  select k, sum(size)::bigint as s, (row_number() over (order by any_value(source) is null, any_value(source)) - 1) % 3 + 1 as w
  from sized group by k),
level(n, l) as (
  select 0, cast((select sum(s) from sizes) as double) / cast((select sum(w) from sizes) as double)
  union all
  select n + 1, x from (select n, l, (
      select cast((select sum(s) from sizes) - coalesce(sum(case when w * level.l > 3 * s then 3 * s end), 0) as double)
             / cast(sum(case when not w * level.l > 3 * s then w end) as double) from sizes) as x from level) where x <> l),
share as (
  select k, s, case when w * l > 3 * s then cast(3 * s as double) else w * l end as t
  from sizes, (select l from level order by n desc limit 1)),
queue as (
  select *, sum(size) over (partition by k order by o, size rows unbounded preceding) as run from sized where size > 0),
entries as (
  select q.*, pass, cast(pass * s + run as double) / t as finish from queue q join share using (k), range(3) as p(pass)),
taken as (
  select doc_id, k, size, pass from (
    select *, sum(size) over (order by finish, k, o, size, pass rows unbounded preceding) as upto from entries)
  where upto <= (select sum(s) from sizes)),
per_doc as (select doc_id, k, size, sum(size) as taken from taken group by doc_id, k, size)
select d.doc_id, d.size::bigint as size, s.s as source_size, s.t as target, coalesce(p.taken, 0)::bigint as taken
from sized d join share s using (k) left join per_doc p on d.doc_id = p.doc_id and d.k = p.k and d.size = p.size
"""


def _packing_sql(buckets: int, budget: int) -> str:
    """Dynamic programming as one query per bucket; among equal costs the earliest split."""
    steps = ["d1 as materialized (select j, l * c as cost, 0 as split from h)"]
    for k in range(2, buckets + 1):
        steps.append(
            f"d{k} as materialized (select j, min(cost) as cost, min_by(i, (cost, i)) as split from ("
            f"select h.j, g.j as i, d.cost + h.l * (h.c - g.c) as cost from h join h g on g.j < h.j join d{k - 1} d on d.j = g.j) group by j)"
        )
    ends = [f"e{buckets} as (select max(j) as j from h)"]
    for k in range(buckets, 1, -1):
        ends.append(f"e{k - 1} as (select split as j from d{k} join e{k} using (j))")
    every = " union all ".join(f"select {k - 1} as bucket, l from e{k} join h using (j)" for k in range(1, buckets + 1))
    return f"""
with counted as (select doc_id, {_COUNT}::bigint as n from documents),
h as materialized (
  select n as l, row_number() over (order by n) as j, sum(count(*)) over (order by n)::bigint as c from counted group by n),
{", ".join(steps)}, {", ".join(ends)}, ends as ({every}),
put as (select doc_id, n, (select min(bucket) from ends where l >= n) as bucket from counted),
placed as (
  select doc_id, n, p.bucket, l, greatest({budget} // greatest(l, 1), 1) as room,
         row_number() over (partition by p.bucket order by md5(coalesce(cast(doc_id as varchar), '')), doc_id, n) - 1 as place
  from put p join ends using (bucket))
select doc_id, n as n_tokens, bucket::int as bucket, l as bucket_len, (place // room)::bigint as batch,
       (place % room)::bigint as slot, l - n as padding from placed
"""


ORACLES["op7_length_buckets"] = _packing_sql(packing.BUCKETS, packing.BUDGET)

# All pairs with a common shingle, then the smallest id within reach.
ORACLES["op6_ngram_components"] = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w
  from documents),
sets as materialized (
  select doc_id, case when len(w) > 3 then list_distinct([w[i:i+3] for i in range(1, len(w) - 2)]) when len(w) > 0 then [w] else [] end as s
  from words),
grams as materialized (select doc_id, len(s) as n, unnest(s) as g from sets where len(s) > 0),
links as materialized (
  select a.doc_id as a, b.doc_id as b from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
  group by 1, 2, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as component_id
from sets
"""

ORACLES["op11_fill_middle"] = r"""
with cut as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as d,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents),
drawn as (
  select doc_id, t, u, len(u) as n, cast('0x' || d[1:8] as bigint) as h1, cast('0x' || d[9:16] as bigint) as h2,
         cast('0x' || d[17:24] as bigint) as h3, cast('0x' || d[25:32] as bigint) as h4 from cut),
formed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
         case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
              when h4 % 100 < 80 then 'spm' else 'psm' end as form from drawn),
pieces as (
  select *, array_to_string(u[1:lo], '') as p, array_to_string(u[lo+1:hi], '') as m, array_to_string(u[hi+1:n], '') as s from formed)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars,
       case when form <> 'plain' then length(m) end::bigint as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from pieces
"""
