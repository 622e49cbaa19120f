"""Language identification by hierarchical discrimination.

First the language family is predicted, then one-versus-one linear support vector machines tell the
languages of that family apart. Features are hashed letter n-grams (bytes of the lower-case text, two
and three long) of the whole text, damped and scaled to length one. Families are fixed for well-known
codes; any other code is a family of its own.

The machines are fitted on a bounded sample of labelled rows: at most ``SAMPLE`` rows, shared equally by
the languages and taken by a digest of the text, so the same rows give the same machines. Copies of a
text count once, also in the share that is taken of a language, and at least the ``FEWEST`` smallest digests
of each language stay; the driver gets at most twice ``SAMPLE`` rows and
twice ``FEWEST`` a language.

Edge cases: null texts and texts without a letter get ``und`` and score 0, as does every text when there
is nothing to learn from; with one language all other texts get that language; null and repeated ids are
rows like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from logmill.llm.common import batched, columns_of, per_batch
from logmill.llm.shingles import pieces

SAMPLE, FEWEST, BUCKETS = 2_400, 8, 4_096
ROUNDS, PENALTY = 120, 1e-4
UNKNOWN = "und"
# fixed values: families of language codes
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indic": "hi ur bn pa mr gu ne si",
    "dravidian": "ta te kn ml",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he am mt",
    "iranian": "fa ps ku tg",
    "sinitic": "zh yue",
    "austronesian": "id ms tl jv",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = np.zeros(256, np.uint8) + 32
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def features(texts: pa.Array) -> np.ndarray:
    """(texts, BUCKETS) float32."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for at, to, data, offsets in pieces(texts):
        for a in range(0, to - at, 64):
            own = offsets[a : a + 65]
            letters = _LETTER[data[own[0] : own[-1]]]
            doc = np.repeat(np.arange(len(own) - 1), np.diff(own))
            keep = np.ones(len(letters), bool)
            keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
            letters, doc = letters[keep].astype(np.uint32), doc[keep]
            if not len(letters):
                continue
            counts = np.zeros((len(own) - 1) * BUCKETS, np.int64)
            for width in (2, 3):
                code = np.full(max(len(letters) - width + 1, 0), width, np.uint32)
                for k in range(width):
                    code = code * np.uint32(257) + letters[k : k + len(code)]
                inside = doc[: len(code)] == doc[width - 1 :]
                slot = (code[inside] * np.uint32(2654435761)) >> np.uint32(20)
                counts += np.bincount(doc[: len(code)][inside] * BUCKETS + slot, minlength=len(counts))
            out[at + a : at + a + len(own) - 1] = np.log1p(counts).reshape(-1, BUCKETS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def fitted(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, classes weighted equally."""
    y = np.where(positive, 1, -1).astype(np.float32)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x.shape[1], np.float32)
    ahead, step = w.copy(), np.float32(0.2)
    for k in range(ROUNDS):
        gap = np.maximum(1 - y * (x @ ahead), 0)
        slope = -2 * (x.T @ (share * y * gap)) + PENALTY * ahead
        new = ahead - step * slope
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Machines:
    """A linear machine for each family against the rest, and for each pair of languages in a family."""

    languages: list[str]
    families: list[str]
    family_weights: np.ndarray
    pairs: list[tuple[int, int]]
    pair_weights: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and a score for each row. The score is the smaller of the two certainties."""
        n, k = len(x), len(self.languages)
        member = np.array([self.families.index(FAMILY.get(c, c)) for c in self.languages])
        margins = x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]
        family = margins.argmax(axis=1)
        rest = np.sort(margins, axis=1)
        sure = _certainty(rest[:, -1] - rest[:, -2]) if len(self.families) > 1 else np.ones(n)
        votes = np.where(member[None, :] == family[:, None], 0.0, -1e6)
        least = np.zeros((n, k))
        if self.pairs:
            duel = x @ self.pair_weights[:, :-1].T + self.pair_weights[:, -1]
            for j, (a, b) in enumerate(self.pairs):
                won = duel[:, j] > 0
                # votes decide; the margins, scaled below one vote, break ties
                tie = np.tanh(duel[:, j]) / (4 * k)
                votes[:, a] += won + tie
                votes[:, b] += ~won - tie
            best = votes.argmax(axis=1)
            least = np.full(n, np.inf)
            for j, (a, b) in enumerate(self.pairs):
                least = np.where((best == a) | (best == b), np.minimum(least, np.abs(2 * duel[:, j])), least)
        else:
            best = votes.argmax(axis=1)
            least = np.full(n, np.inf)
        return [self.languages[b] for b in best], np.minimum(sure, _certainty(least))


def _certainty(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.minimum(margin, 30)))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Machines | None:
    """Machines of (text, lang) rows, null languages left out."""
    batched(labelled.sparkSession)
    rows = columns_of(labelled, text="string", lang="string").filter("lang is not null and text is not null")
    rows = rows.withColumn("digest", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    digests = rows.select("lang", "digest").distinct()
    counts = dict(digests.groupBy("lang").count().collect())
    if not counts:
        return None
    place = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    least = dict(
        digests.withColumn("place", place).filter(F.col("place") <= FEWEST).groupBy("lang").agg(F.max("digest")).collect()
    )
    each = max(sample // len(counts), 1)
    upto = F.lit(0)
    for lang, n in sorted(counts.items()):
        upto = F.when(F.col("lang") == lang, max(int(min(1.0, each / n) * (1 << 30)) - 1, least[lang])).otherwise(upto)
    chosen = (
        rows.filter(F.col("digest") <= upto).groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
        .orderBy("digest", "lang").limit(2 * (sample + FEWEST * len(counts)))
    )
    found = per_batch(
        chosen.select("text", "lang"),
        lambda b: {"lang": b.column(1), "x": [row.tobytes() for row in features(b.column(0)).astype(np.float16)]},
        "lang string, x binary",
    ).toPandas().sort_values(["lang", "x"]).groupby("lang").head(max(2 * each, FEWEST))
    x = np.stack([np.frombuffer(v, np.float16) for v in found["x"]]).astype(np.float32)
    lang = found["lang"].to_numpy()
    languages = sorted(set(lang))
    family = np.array([FAMILY.get(c, c) for c in lang])
    families = sorted(set(family))
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2)
             if FAMILY.get(languages[a], languages[a]) == FAMILY.get(languages[b], languages[b])]
    return Machines(
        languages, families,
        np.stack([fitted(x, family == f) for f in families] if len(families) > 1 else [np.zeros(BUCKETS + 1, np.float32)]),
        pairs,
        np.stack([fitted(x[m], lang[m] == languages[a]) for a, b in pairs for m in [np.isin(lang, [languages[a], languages[b]])]]
                 or [np.zeros(BUCKETS + 1, np.float32)]),
    )


def _predicted(texts: pa.Array, machines: Machines | None) -> tuple[list[str], np.ndarray]:
    texts = texts.fill_null("")
    lettered = np.array(pc.match_substring_regex(texts, r"\p{L}").to_pylist(), bool)
    if machines is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    lang, score = machines.predict(features(texts))
    return [c if ok else UNKNOWN for c, ok in zip(lang, lettered)], np.where(lettered, score, 0.0)


def predicted(docs: DataFrame, machines: Machines | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` (others than the two new ones) with lang_pred and score; only the text is looked at."""
    batched(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batch: pa.RecordBatch) -> dict:
        lang, score = _predicted(batch.column("text_").cast(pa.string()), machines)
        return {**{c: batch.column(c) for c in keep}, "lang_pred": lang, "score": score}

    return per_batch(docs.select(*kept, F.col("text").alias("text_")), run, schema)
