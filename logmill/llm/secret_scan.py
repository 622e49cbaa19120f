"""Secret scans: base patterns, and candidates scored by automata learned from labelled credentials.

A first pass over the texts finds the labelled credentials, which are the values of base spans, and ordinary
words; a second one finds the candidates: all other runs of credential characters, and what base spans leave
of a run, from the length of the shortest labelled credential on. All labelled credentials of a kind, and all ordinary words,
make one probabilistic automaton each (``automata``). Ordinary are the runs that stand in two different
texts at least: unlabelled credentials, being nearly all
distinct, do not get in, however many there are. All runs of all texts are counted. Only where no run recurs, those of letters alone without
a capital inside count as ordinary. A candidate is added as a span of the kind
that fits best, if its likelihood is typical of that kind (``SLACK`` below the lowest score of labelled
credentials that the automaton had not seen at most) and exceeds that of ordinary words by ``MARGIN`` a symbol. All candidates are scored; what is left of
a run is also read without the one sign that joins it to the base span.

Edge cases: null is the empty text; a text without spans gets 0, the digest of the empty string and an
empty list; kinds without at least ``FEWEST`` labelled credentials add nothing; null and repeated ids
are rows like any other; an empty table gives no rows; other columns are ignored (kept by ``cleaned``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from logmill.llm.automata import Automaton, learned as automata_of
from logmill.llm.common import arrow_schema, batched, columns_of, per_batch, running_total, stored
from logmill.llm.spans import Cover, Span, blanked, digest, listed

KINDS = ("assign", "access", "hex")
FEWEST, MARGIN, SLACK = 10, 0.3, 0.1
#: Candidates whose verdict a worker remembers.
KNOWN = 100_000
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
ODD = re.compile(r"[0-9]|[a-z][A-Z]")
SIGNS = "+/_.=-"
SCANNED = "labelled array<struct<kind:string,value:string>>, copy bigint, ordinary string"


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential): leftmost matches of each kind; those too short are dropped."""
    found = [(*m.span(), "assign", m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]


def _offered(text: str, cover: Cover) -> str:
    """The different runs outside the base spans, all of them, a line each: one string takes less room than many."""
    if cover.starts:
        return "\n".join({m[0] for m in RUN.finditer(text) if cover.clear(*m.span())})
    return "\n".join(set(RUN.findall(text)))


def _based(texts: pa.Array) -> Iterator[tuple[str, list[tuple[int, int, str, str]]]]:
    """Each text with its base spans."""
    hits = pc.match_substring_regex(texts, r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}").to_pylist()
    for text, hit in zip(texts.to_pylist(), hits):
        yield text, base_spans(text) if hit else []


def _scan(batch: pa.RecordBatch) -> dict[str, list]:
    out: dict[str, list] = {name: [] for name in ("labelled", "copy", "ordinary")}
    for text, base in _based(batch.column(0).fill_null("")):
        out["labelled"].append([{"kind": kind, "value": v} for _, _, kind, v in base])
        out["copy"].append(int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True))
        out["ordinary"].append(_offered(text, Cover(base)))
    return out


@dataclass
class Models:
    """For each kind its automaton and the lowest score of unseen credentials; the automaton of ordinary words; the least
    length of a candidate."""

    kinds: dict[str, tuple[Automaton, float]]
    plain: Automaton | None
    least: int

    def __post_init__(self) -> None:
        self.run, self.known = re.compile(f"[A-Za-z0-9+/_.=-]{{{self.least},}}"), {}

    def kind(self, value: str) -> str | None:
        """The kind of credential that the value fits, if any."""
        if value not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            scores = {k: m.score(value) for k, (m, _) in self.kinds.items()}
            best = max(scores, key=scores.get)
            fits = scores[best] >= self.kinds[best][1] - SLACK
            if fits and self.plain:
                fits = scores[best] >= self.plain.score(value) + MARGIN
            self.known[value] = best if fits else None
        return self.known[value]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        added = []
        if not self.kinds:
            return added
        cover = Cover(base)
        for m in self.run.finditer(text):
            if cover.clear(*m.span()):
                if kind := self.kind(m[0]):
                    added.append((*m.span(), kind))
                continue
            for start, end in cover.left(*m.span()):
                # the sign beside a base span may join the two or belong to the credential
                inner = start + (start > m.start() and text[start] in SIGNS), end - (end < m.end() and text[end - 1] in SIGNS)
                for a, b in dict.fromkeys((inner, (inner[0], end), (start, inner[1]), (start, end))):
                    if b - a >= self.least and (kind := self.kind(text[a:b])):
                        added.append((a, b, kind))
                        break
        return added


def run_counts(ordinary: DataFrame) -> DataFrame:
    """value and texts: in how many different texts each run stands, of ``ordinary``: (copy, ordinary), the digest of a text
    and its runs. A text goes once through the shuffle, its runs are counted before the next one."""
    texts = ordinary.groupBy("copy").agg(F.min("ordinary").alias("ordinary"))
    runs = texts.filter("ordinary <> ''").select(F.explode(F.split("ordinary", "\n")).alias("value"))
    return runs.groupBy("value").agg(F.count(F.lit(1)).alias("texts"))


def learned(labelled: DataFrame, runs: DataFrame) -> Models:
    """The models of ``labelled``: (kind, value) and ``runs`` (``run_counts``), of all of them. The driver gets the counts that
    the automata are made of."""
    spark = labelled.sparkSession
    own = labelled.filter(F.col("kind").isin(*KINDS)).distinct().withColumn("one", F.lit(1)).withColumn("order", F.md5("value"))
    ranked = running_total(own, ["kind"], "order", ["value"], "one", "rank")
    own = stored(ranked.select("kind", "value", (F.col("rank") % 2).cast("string").alias("half")), "labelled")
    sizes = own.groupBy("kind").agg(F.count(F.lit(1)), F.min(F.length("value"))).collect()
    least = {kind: length for kind, n, length in sizes if n >= FEWEST}
    own = own.filter(F.col("kind").isin(*least))
    words = runs.filter("texts > 1")
    if words.isEmpty():
        words = runs.filter(~F.col("value").rlike(ODD.pattern))
    # of a kind, all credentials, and each half of them
    names = F.explode(F.array(F.col("kind"), F.concat("kind", "half"))).alias("name")
    automata = automata_of(stored(own.select(names, "value").unionByName(words.select(F.lit("").alias("name"), "value")), "strings"))
    fields, arrow = arrow_schema(spark, "kind string, score double")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(column.to_pylist() for column in batch.columns)))
            score = [automata[kind + "10"[int(half)]].score(value) for kind, value, half in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow[0].type), pa.array(score, arrow[1].type)], schema=arrow)

    # what a credential that was not learned scores at least: each half by the automaton of the other
    lowest = dict(map(tuple, own.mapInArrow(scores, fields).groupBy("kind").agg(F.min("score")).collect()))
    kinds = {kind: (automata[kind], lowest[kind]) for kind in KINDS if kind in least}
    return Models(kinds, automata.get(""), min(least.values(), default=1))


def _models(docs: DataFrame) -> Models:
    batched(docs.sparkSession)
    found = stored(per_batch(columns_of(docs, text="string"), _scan, SCANNED), "secrets")
    return learned(found.select(F.inline("labelled")), stored(run_counts(found.select("copy", "ordinary")), "runs"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and digest, and all spans of every document."""
    models = _models(docs)

    def judge(batch: pa.RecordBatch) -> dict[str, list]:
        spans = []
        for text, base in _based(batch.column(1).fill_null("")):
            own = [x[:3] for x in base]
            spans.append((own, own + models.added(text, own)))
        return {
            "doc_id": batch.column(0),
            **{f"n_{k}": [sum(s[2] == k for s in own) for own, _ in spans] for k in KINDS},
            "base_sha256": [digest(own, KINDS) for own, _ in spans],
            "spans": [listed(every, KINDS) for _, every in spans],
        }

    return per_batch(
        columns_of(docs, doc_id="bigint", text="string"), judge,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars, if there, follows."""
    models = _models(docs)

    def clean(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, out = batch.column(1), []
        for given, (text, base) in zip(texts, _based(texts.fill_null(""))):
            own = [x[:3] for x in base]
            spans = own + models.added(text, own)
            out.append(blanked(text, spans) if spans else given.as_py())
        return {"doc_": batch.column(0), "text_": out}

    # a document travels as one column, whatever its own columns are called
    held = docs.select(F.struct("*").alias("doc_"), F.col("text").cast("string").alias("text_"))
    new = F.col("doc_").withField("text", F.col("text_"))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length("text_").cast(docs.schema["n_chars"].dataType))
    return per_batch(held, clean, held.schema).select(new.alias("doc_")).select("doc_.*")
