"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from logmill.llm import (  # noqa: E402
    automata, fingerprints, language, mixing, neighbours, ngram_join, packing, pii, queries, secret_scan, shingles,
    token_counts, url_filter,
)

from logmill.llm.spans import Cover  # noqa: E402

SF = "/root/testdata/sf0.001"
AWKWARD = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, bucket int, row int, cls int, order_ string, score int, lang_pred string, text_ int, doc_ int, `a.b` int"
LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Null columns, an empty and a very long text, equal ids, repeated rows, names that clash."""
    more = (1, 1, 1, 1, 1, "x", 1, "xx", 1, 1, 1)
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a", *more),
        (1, "one two three four five six seven eight nine ten", "en", "a", *more),
        (2, None, None, None, *more), (3, "", "en", "b", *more), (4, LONG, "de", "b", *more),
        (None, "no id here but words", "en", None, *more), (5, "  \t\n ", "fr", "a", *more),
        (6, "12345 67890 !!!", None, "c", *more), (7, "one", "en", "c", *more), (7, "two", "de", "c", *more),
    ]
    return spark.createDataFrame(rows, AWKWARD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], AWKWARD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()


def test_shingles_are_those_of_the_words():
    texts = ["A b\tc d  e", "a B c d e f", None, "", " ", "x", "a b c d e", "a b c d", "é a b c d e " * 30]
    mine = list(shingles.shingle_sets(pa.array(texts), 4))
    for x, a in zip(mine, texts):
        assert len(x) == len(shingle_set(a, 4))
        for y, b in zip(mine, texts):
            assert len(np.intersect1d(x, y)) == len(shingle_set(a, 4) & shingle_set(b, 4))
    shifted = pa.array(["zz", *texts])[1:]
    assert all((x == y).all() for x, y in zip(mine, shingles.shingle_sets(shifted, 4)))


def test_mix(spark, docs, odd, none):
    rows = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert r.taken in {0, r.size, 2 * r.size, 3 * r.size}
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(taken.values()) <= sum(r.size for r in rows)
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mixture(docs).count() == sum(r.taken // r.size for r in rows if r.size)
    found = mixing.mix(odd).collect()
    assert len(found) == 10 and all(r.taken == 0 for r in found if not r.size)
    assert mixing.mixture(odd).columns == odd.columns
    assert mixing.mix(none).count() == mixing.mixture(none).count() == 0


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 100, 2), ("c", 5, 3)], "source string, source_size bigint, weight int")
    got = {r.source: r.target for r in mixing.targets(sizes, 115).collect()}
    assert got["c"] == 15 and got["a"] == 30 and got["b"] == pytest.approx(70)


def test_language(spark, docs, odd, none):
    held = queries.held_out()
    machines = language.learn(docs.filter(~held))
    rows = language.predicted(docs, machines, ("doc_id", "lang")).filter(held).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    got = language.predicted(odd, machines).collect()
    assert len(got) == 10 and sum(r.lang_pred == "und" for r in got) == 4  # null, empty, blank, no letter
    assert language.learn(none) is None
    assert {r.lang_pred for r in language.predicted(odd, None).collect()} == {"und"}
    assert language.predicted(none, machines).count() == 0
    hot = docs.union(docs.filter("doc_id = 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(9_000)))).drop("copy"))
    again = language.predicted(docs, language.learn(hot.filter(~held)), ("doc_id", "lang")).filter(held).collect()
    assert np.mean([r.lang == r.lang_pred for r in again]) > 0.95
    one = language.learn(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in language.predicted(docs, one).collect()} == {"en"}


def test_language_of_repeated_rows(spark):
    """More rows than the sample, nearly all of them copies of a few texts."""
    texts = [(lang, t) for lang, words_ in (("en", "the house stands near this green river"), ("de", "das haus steht am grünen fluss"),
                                            ("fi", "talo seisoo vihreän joen rannalla")) for t in (words_, words_ + " " + words_[:9], words_[4:])]
    df = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id bigint, text string, lang string")
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10_000)))).drop("copy")
    got = language.predicted(df, language.learn(copies), ("doc_id", "lang")).collect()
    assert all(r.lang == r.lang_pred for r in got)
    equal = copies.filter("doc_id = 0")
    assert {r.lang_pred for r in language.predicted(df, language.learn(equal)).collect()} == {"en"}
    few = spark.range(60).select(F.concat(F.lit("x"), F.col("id") % 20).alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    assert len(language.learn(few, sample=20).languages) == 20


BASE = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    found = [(m.start(), 0, "assign", m.end()) for m in BASE.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_secrets(spark, docs, odd, none):
    extra = spark.createDataFrame(
        [(900 + k, t) for k, t in enumerate([
            "PassWord: 'abc' passwd=abcdefg", "Secret = \"" + "0a" * 20 + '"', "ſecret=abcdefgh api_key:apikey=abcdef",
            "AKIA" + "A1" * 8 + " AKIASHORT", "é" * 5 + "f" * 24, None, "",
        ])], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").union(extra)
    texts = {r.doc_id: r.text or "" for r in every.collect()}
    rows = secret_scan.scan(every).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert r.n_assign + r.n_access + r.n_hex == len(base)
    for r in secret_scan.cleaned(docs).collect():
        assert not plain_secrets(r.text) and r.n_chars == len(r.text)
    assert secret_scan.scan(odd).count() == 10 and secret_scan.cleaned(odd).columns == odd.columns
    assert secret_scan.scan(none).count() == 0


def keys_of(seed, n, length, letters):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), length)) for _ in range(n)]


MIXED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
PROSE = ["ordinary words of the archive stand in every single document", "internationalization and responsibilities recur everywhere"]


def plain_automaton(strings):
    """The merged automaton's language model, worked out from the strings each state has taken in."""
    model = automata.Automaton(strings)
    counts = [Counter() for _ in model.states]
    ends = Counter()
    for text in strings:
        at = 0
        for char in text:
            counts[at][char] += 1
            at = model.states[at].to[automata.symbols(char)]
        ends[at] += 1
    return model, counts, ends


def test_merged_states_hold_what_their_strings_bring():
    rng = np.random.default_rng(3)
    strings = ["ab" * int(rng.integers(1, 6)) + "-" + "".join(rng.choice(list("0123456789"), 3)) for _ in range(120)]
    model, counts, ends = plain_automaton(strings)
    assert model.size < len({s[:k] for s in strings for k in range(len(s) + 1)})
    reached = {0} | {t for s in model.states for t in s.to.values()}
    for k in reached:
        s = model.states[k]
        if not counts[k] and not ends[k]:
            continue
        assert {c: n for held in s.chars.values() for c, n in held.items()} == counts[k] and s.ends == ends[k]
        assert s.visits == sum(counts[k].values()) + ends[k]
        assert s.times == {c: sum(held.values()) for c, held in s.chars.items()}

    def score(text):
        at, total = 0, 0.0
        for char in text:
            s, c = model.states[at], automata.symbols(char)
            size, n = automata.SIZES.get(c, 1), s.times[c]
            total += np.log(n / s.visits * (counts[at][char] + automata.BACK_OFF / size) / (n + automata.BACK_OFF))
            at = s.to[c]
        return (total + np.log(max(ends[at] / model.states[at].visits, automata.UNSEEN))) / (len(text) + 1)

    for text in strings[:20]:
        assert model.score(text) == pytest.approx(score(text))


def test_literals_of_a_format_are_learned(spark):
    """A format with a fixed head: other heads before the same kind of characters do not fit."""
    rows = [(k, f'token="ghp_{v}"') for k, v in enumerate(keys_of(1, 200, 36, MIXED))] + [(1_000 + k, PROSE[k % 2]) for k in range(50)]
    heads = ["ghp_", "xyz_", "kkm_", "GHP_"]
    rows += [(2_000 + 100 * h + k, f"seen {head}{v} there") for h, head in enumerate(heads) for k, v in enumerate(keys_of(7 + h, 20, 36, MIXED))]
    found = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    shares = [np.mean([found[2_000 + 100 * h + k] != "" for k in range(20)]) for h in range(4)]
    assert shares[0] > 0.9 and shares[1:] == [0, 0, 0]


def test_unlabelled_credentials_do_not_train_ordinary_words(spark):
    labelled, bare = keys_of(1, 60, 32, MIXED), keys_of(2, 600, 32, MIXED)
    rows = [(k, f"{PROSE[k % 2]} password={v}") for k, v in enumerate(labelled)]
    rows += [(1000 + k, f"{v} stood first, {PROSE[k % 2]}") for k, v in enumerate(bare)]
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = sum(got[1000 + k] == "assign:0:32" for k in range(600))
    assert found >= 0.95 * 600
    assert all(got[k].count(",") == 0 for k in range(60))


@pytest.mark.parametrize("letters, length, part", [
    (MIXED, 12, 12), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 20, 20), ("abcdefghijklmnopqrstuvwxyz", 20, 4), ("0123456789_", 9, 9),
])
def test_candidates_of_any_length_and_letters(spark, letters, length, part):
    labelled, bare = (["-".join(re.findall("." * part, v)) for v in keys_of(seed, n, length, letters)] for seed, n in ((3, 60), (4, 100)))
    length = len(bare[0])
    rows = [(k, f"{PROSE[k % 2]} token: {v}") for k, v in enumerate(labelled)]
    rows += [(1000 + k, f"{PROSE[k % 2]} {v}") for k, v in enumerate(bare)]
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    at = [len(PROSE[k % 2]) + 1 for k in range(100)]
    assert sum(got[1000 + k] == f"assign:{at[k]}:{at[k] + length}" for k in range(100)) >= 90


def test_the_rest_of_a_run_beside_a_base_span(spark):
    labelled, bare = keys_of(5, 60, 40, MIXED + "/+"), keys_of(6, 100, 40, MIXED + "/+")
    rows = [(k, f"{PROSE[k % 2]} secret={v}") for k, v in enumerate(labelled)]
    rows += [(1000 + k, f"AKIA{'A1' * 8}/{v}") for k, v in enumerate(bare)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan(df).collect()}
    assert sum(got[1000 + k] == "access:0:20,assign:21:61" for k in range(100)) >= 90
    texts = [r.text for r in secret_scan.cleaned(df).filter("doc_id >= 1000").collect()]
    assert sum(t == "[ACCESS]/[ASSIGN]" for t in texts) >= 90


def test_cover_left():
    rng = np.random.default_rng(7)
    for _ in range(300):
        spans = [(int(a), int(a + n), "x") for a, n in zip(rng.integers(0, 60, 5), rng.integers(1, 9, 5))][: rng.integers(0, 6)]
        start, end = sorted(map(int, rng.integers(0, 70, 2)))
        inside = {k for s, e, _ in spans for k in range(s, e)}
        assert [k for s, e in Cover(spans).left(start, end) for k in range(s, e)] == [k for k in range(start, end) if k not in inside]


def test_automata_tell_formats_apart():
    rng = np.random.default_rng(1)
    keys = ["AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16)) for _ in range(200)]
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(200)]
    words_ = ["".join(rng.choice(list("etaoinshrdlu"), 18)) for _ in range(200)]
    models = [automata.Automaton(x[:150]) for x in (keys, hexes, words_)]
    for k, group in enumerate((keys, hexes, words_)):
        best = [max(range(3), key=lambda j: models[j].score(s)) for s in group[150:]]
        assert np.mean([b == k for b in best]) > 0.95
    assert all(m.size < 200 for m in models)


def test_urls(spark):
    schema = "page_id bigint, url string, host int, tokens int"
    rows = [(k, f"http://bad-{k % 2}.shop.org/x/{k}", 1, 1) for k in range(40)] + [(100 + k, f"https://fine.org/x/{k}", 1, 1) for k in range(60)]
    rows += [(200, None, 1, 1), (201, "no scheme", 1, 1), (202, "http://A.Example.com/en/1", 1, 1), (203, "http://www.example.com/en/", 1, 1),
             (204, "ftp://notcom/", 1, 1), (205, "http://x.net/es/?q", 1, 1), (205, "http://x.net/es", 1, 1), (None, "http://x.net/fr/#a", 1, 1),
             (206, "http://bad-1.shop.org", 1, 1)]
    pages = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(k, 1, 1) for k in range(20)] + [(100 + k, 1, 0) for k in range(30)] + [(None, None, None)], "doc_id bigint, quality int, toxic int")
    got = {(r.page_id, r.path): r for r in url_filter.judged(pages, labels, queries.URL_RULES, min_support=0.05).collect()}
    assert len(got) == len(rows)
    assert all(got[k, f"/x/{k}"].verdict == "block" for k in range(40)) and all(got[100 + k, f"/x/{k}"].verdict == "allow" for k in range(60))
    assert got[200, ""].host == got[201, ""].host == "" and got[201, ""].verdict == "allow"
    assert (got[202, "/en/1"].rule, got[202, "/en/1"].host) == ("example.com/en/", "a.example.com")
    assert got[203, "/en/"].rule == "www.example.com/en/" and got[203, "/en/"].verdict == "allow"
    assert got[205, "/es/"].rule == "net/es/" and got[205, "/es"].rule is None and got[None, "/fr/"].verdict == "block"
    assert got[206, ""].verdict == "block"
    empty = url_filter.judged(pages.limit(0), labels.limit(0), queries.URL_RULES)
    assert empty.count() == 0


def test_mined_rules_against_brute_force(spark):
    rng = np.random.default_rng(5)
    sets = [sorted({f"t{v}" for v in rng.integers(0, 6, 4)}) for _ in range(200)]
    sets = [[*s, "t6"] if "t3" in s else s for s in sets]  # always with t3
    bad = ["t1" in s and "t2" in s or rng.random() < 0.1 for s in sets]
    sets = [sorted([*s, "t7"]) if b and k % 3 else s for k, (s, b) in enumerate(zip(sets, bad))]  # only with bad
    df = spark.createDataFrame(list(zip(sets, map(bool, bad))), "tokens array<string>, bad boolean")
    rules, names = url_filter.mined(df, 0.05, 0.7)
    known = {}
    for r in names.collect():
        known.setdefault(r.named, []).append(r.token)
    from itertools import combinations, product
    got = {tuple(sorted(x)): r.confidence for r in rules.collect() for x in product(*(known[t] for t in r.rule_tokens))}
    assert sorted(known["t3"]) == ["t3", "t6"]
    every, wanted = {}, {}
    for size in range(1, 6):
        for combo in combinations([f"t{k}" for k in range(8)], size):
            has = [b for s, b in zip(sets, bad) if set(combo) <= set(s)]
            if has and sum(has) / 200 >= 0.05 and sum(has) / len(has) >= 0.7:
                every[combo] = sum(has) / len(has)
    for combo, conf in every.items():
        if not any(set(o) < set(combo) and c >= conf for o, c in every.items()):
            wanted[combo] = conf
    assert got == pytest.approx(wanted)


def test_urls_of_many_segments(spark):
    """Token sets must not multiply: long URLs on few and on many pages, alike and nearly alike."""
    def url(*segments):
        return "http://long.org/" + "/".join(f"s{k:03d}x".replace("0", "o").replace("1", "i").replace("2", "z").translate(str.maketrans("3456789", "abcdefg")) for k in segments)

    one = [(k, url(*range(100)) if k == 0 else f"http://site{'abcdef'[k]}.org/p") for k in range(6)]
    rows = one + [(10 + k, url(*range(100)) + "/end") for k in range(12)] + [(30 + k, url(*range(k, 100 + k))) for k in range(40)]
    rows += [(200 + k, "http://long.org/fine/" + "abcdefgh"[k % 8]) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(k, int(k < 200 and k not in range(1, 6))) for k, _ in rows], "doc_id bigint, toxic int").withColumn("quality", F.lit(1))
    few = url_filter.judged(pages.filter("page_id < 6"), labels, []).collect()
    assert {r.verdict for r in few} == {"allow"}  # one page makes no rule
    found = url_filter.judged(pages, labels, []).collect()
    assert {r.verdict for r in found if 10 <= r.page_id < 100} == {"block"}
    assert {r.verdict for r in found if r.page_id >= 200} == {"allow"}


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 10, (20, 8))
    rows = [(k, list(map(float, centres[k % 20] + rng.normal(0, 1, 8))), 0) for k in range(1500)]
    rows += [(2000 + k, [1.0] * 8, 0) for k in range(30)]  # one vector many times
    rows += [(3000, None, 0), (3100, [0.0] * 8, 0), (3200, [1.0, float("nan")] * 4, 0), (3300, [1.0, None] * 4, 0), (3400, [], 0),
             (4000, [1.0, 2.0], 0), (4001, [1.0, 2.5], 0), (5000, rows[0][1], 0), (5000, rows[0][1], 0), (None, rows[3][1], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, row int")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    fine = [(i, np.array(v)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    hit = total = 0
    for i, v in ((i, v) for i, v in fine if i is not None and i % 100 == 0 and i != 5000):
        order = sorted((float(np.sqrt(((w - v) ** 2).sum())), j if j is not None else 1 << 60) for j, w in fine if len(w) == len(v) and w is not v)[:10]
        assert len(got[i]) == len(order)
        hit += len({j for _, j in order} & {j if j is not None else 1 << 60 for j, _ in got[i]})
        total += len(order)
        assert [s for _, s in got[i]] == sorted(s for _, s in got[i])
    assert hit / total >= 0.9 and not {3000, 3100, 3200, 3300, 3400} & set(got)
    assert [x[0] for x in got[4000]] == [4001] and len(got[5000]) == 20
    router = neighbours.fit(neighbours.usable(df))
    assert router.probes < router.weights[3].size / 2  # clustered vectors need few parts
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def components(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return Counter((i, len(sets[k]), least.get(top(k))) for k, (i, _) in enumerate(rows))


def edited(rng, base, share):
    return " ".join(w if rng.random() > share else f"w{rng.integers(99999)}" for w in base.split())


def near_copies(seed=3):
    rng = np.random.default_rng(seed)
    common = " ".join(f"c{k}" for k in range(60))
    rows = []
    for _ in range(6):
        base = " ".join(f"v{rng.integers(9999)}" for _ in range(200))
        rows += [edited(rng, base, share) for share in rng.choice([0, 0.01, 0.02, 0.04], 20)] + [base]
    rows += [common + " " + " ".join(f"u{rng.integers(99999)}" for _ in range(rng.integers(1, 200))) for _ in range(40)]
    rows += ["a b", "A  b", "a b c d e f g h", "a b c d e f g h i", "", " ", None]
    return [(k * 7 % 1000 + 1000 * (k % 2), t) for k, t in enumerate(rows)] + [(None, rows[0]), (None, rows[25]), (3, rows[3]), (3, rows[3])]


@pytest.mark.parametrize("percent", [85, 60])
def test_ngram_join(spark, percent, odd, none):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, 4, percent).collect())
    wanted = components(rows, 4, percent)
    assert got == wanted
    if percent == 85:
        kept = ngram_join.deduplicated(df, 4, percent)
        full = sum(1 for _, t in rows if not words(t))
        groups = {c for (_, n, c) in wanted if n}
        assert kept.count() == len(groups) + full
        assert {r.doc_id for r in kept.collect() if words(r.text)} == groups
        default = {c for (_, n, c) in components(rows, 5, 80) if n}
        assert {r.doc_id for r in ngram_join.deduplicated(df).collect() if words(r.text)} == default
        assert ngram_join.ngram_components(odd).count() == 10 and ngram_join.deduplicated(odd).columns == odd.columns
        assert ngram_join.ngram_components(none).count() == ngram_join.deduplicated(none).count() == 0


def test_optimal_boundaries():
    rng = np.random.default_rng(4)
    from itertools import combinations
    for _ in range(60):
        histogram = [(int(x), int(rng.integers(1, 9))) for x in np.unique(rng.integers(0, 60, rng.integers(1, 9)))]
        for k in (1, 2, 3, 4):
            ends = packing.optimal_boundaries(histogram, k)
            cost = lambda e: sum(c * min(x for x in e if x >= n) for n, c in histogram)
            lengths = [n for n, _ in histogram]
            best = min(cost((*c, lengths[-1])) for c in combinations(lengths[:-1], min(k, len(lengths)) - 1))
            assert cost(ends) == best and len(ends) == min(k, len(lengths))
    assert packing.optimal_boundaries([], 3) == []


def test_packing(spark, docs, odd, none):
    for df, n in ((docs, 200), (odd, 10), (none, 0)):
        rows = packing.pack(df, buckets=4, budget=2_000).collect()
        assert len(rows) == n
        batches = Counter((r.bucket, r.batch) for r in rows)
        for r in rows:
            assert r.padding == r.bucket_len - r.n_tokens >= 0 and 0 <= r.slot < batches[r.bucket, r.batch]
            assert batches[r.bucket, r.batch] * r.bucket_len <= 2_000 or batches[r.bucket, r.batch] == 1 or not r.bucket_len


def test_token_rollup(spark, docs, odd, none):
    import base64
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS[7:], "rb"))}
    bpe = tiktoken.Encoding("x", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, odd):
        rows, least = df.collect(), {}
        for r in rows:
            if r.doc_id is not None:
                least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
        want = {}
        for r in rows:
            for version in ("words", "bpe"):
                want.setdefault((r.source, r.lang, version), [0, 0])
            t = r.text or ""
            if t in least and (r.doc_id is None or r.doc_id > least[t]):
                continue
            t = "\n".join(dict.fromkeys(t.split("\n")))
            for version, n in (("words", len(words(t))), ("bpe", len(bpe.encode_ordinary(t)))):
                want[r.source, r.lang, version][0] += 1
                want[r.source, r.lang, version][1] += n
        got = {(r.source, r.lang, r.version): [r.documents, r.tokens] for r in token_counts.corpus_rollup(df, queries.RANKS, "bpe").collect()}
        assert got == want
    assert token_counts.corpus_rollup(none, queries.RANKS, "bpe").count() == 0


def test_commits_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v", 1, 5), ("a", None, "v", 1, 7)], "source string, lang string, version string, documents bigint, tokens bigint")
    ledger = str(tmp_path / "ledger")
    for batch in ("b1", "b1", "b2"):
        token_counts.commit(ledger, batch, rows)
    got = {(r.source, r.lang): (r.documents, r.tokens) for r in token_counts.totals(spark, ledger).collect()}
    assert got == {("a", "en"): (2, 10), ("a", None): (2, 14)}
    again = token_counts.compacted(spark, ledger)
    assert sorted(map(repr, token_counts.totals(spark, again).collect())) == sorted(map(repr, token_counts.totals(spark, ledger).collect()))


def test_fingerprints(spark, docs, odd, none):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(text)
        a, b, c = (shingle_set(t, 5) for t in (text, new, after))
        assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 0.2 and abs(got[i].near_next - len(a & c) / len(a | c)) < 0.2
    same = {}
    for i, text in rows:
        assert same.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    found = fingerprints.edited_fingerprints(odd).collect()
    assert len(found) == 10 and fingerprints.edited_fingerprints(none).count() == 0
    assert [r.edited_sha256 for r in found if r.doc_id is None] == [hashlib.sha256(b"no id here but ").hexdigest()]
    single = fingerprints.edited_fingerprints(docs.limit(1)).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    assert fingerprints.fingerprints(odd).count() == 10


def test_large_ids_beside_null_ids(spark):
    ids = [(1 << 62) + 3 * k for k in range(300)]
    rows = [(i, f"text number {k} of many words " * 4) for k, i in enumerate(ids)] + [(None, f"no id {k}") for k in range(50)]
    rows = [rows[k] for k in np.random.default_rng(9).permutation(len(rows))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    texts, want = dict(r for r in rows if r[0] is not None), Counter()
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(text) // 4
        want[i, hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()] += 1
    for i, text in rows:
        if i is None:
            want[None, hashlib.sha256(text[: len(text) - len(text) // 4].encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprints.edited_fingerprints(df).collect()) == want


def test_banded_near_duplicates(spark):
    rows = [r for r in near_copies() if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in fingerprints.near_duplicates(df).collect())
    wanted = components(rows, 5, 80)
    assert sum((got & wanted).values()) >= 0.97 * len(rows)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_personal_data(spark, docs, odd, none):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find(docs).collect():
        base = plain_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base) and r.spans == ",".join(base)
    assert pii.find(odd).count() == 10 and pii.find(none).count() == 0


def test_base_patterns_on_random_text():
    rng = np.random.default_rng(8)
    for _ in range(4000):
        text = "".join(rng.choice(list("ab@@..-+ 0123456789()é"), rng.integers(0, 40)))
        assert sorted(pii.base_spans(text)) == sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in plain_pii(text))), text
        got = [(s, e, k) for s, e, k, _ in secret_scan.base_spans(text)]
        assert sorted(got) == sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in plain_secrets(text)))


@pytest.mark.parametrize("text, kind, value", [
    ("write to john dot doe at example dot com now", "email", "john dot doe at example dot com"),
    ("mail jane [at] site [dot] org!", "email", "jane [at] site [dot] org"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("ｊｏｅ＠ｍａｉｌ．ｃｏｍ", "email", "ｊｏｅ＠ｍａｉｌ．ｃｏｍ"),
    ("ip 192[.]168[.]1[.]10", "ip", "192[.]168[.]1[.]10"),
    ("call plus one two three four five six seven eight nine zero one.", "phone", "plus one two three four five six seven eight nine zero one"),
    ("host one nine two dot one six eight dot one dot two zero", "ip", "one nine two dot one six eight dot one dot two zero"),
    ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
])
def test_disguises(text, kind, value):
    found = pii.added_spans(text, pii.base_spans(text))
    assert [(k, text[s:e]) for s, e, k in found] == [(kind, value)]


@pytest.mark.parametrize("text, kind, value, base", [
    ("to john@exa\u200bmple.com", "email", "john@exa\u200bmple.com", []),
    ("card 4111\u200b1111\u20601111\ufeff1111.", "card", "4111\u200b1111\u20601111\ufeff1111", []),
    ("ip 10.0\u200b.0.1", "ip", "10.0\u200b.0.1", []),
    ("call +1 415\u200d 555 0199", "phone", "+1 415\u200d 555 0199", []),
    ("jоhn@example.com", "email", "jоhn@example.com", ["hn@example.com"]),
    ("john@example.cоm", "email", "john@example.cоm", ["john@example.c"]),
    ("ip 9.８.1.2.3.4", "ip", "9.８.1.2", ["1.2.3.4"]),
])
def test_hits_beyond_base_spans(text, kind, value, base):
    own = pii.base_spans(text)
    assert [text[s:e] for s, e, _ in own] == base
    assert [(k, text[s:e]) for s, e, k in pii.added_spans(text, own)] == [(kind, value)]


@pytest.mark.parametrize("text, kind, value", [
    ("host one two seven dot zero dot zero dot one", "ip", "one two seven dot zero dot zero dot one"),
    ("host one two seven[.]zero[.]zero [dot] one", "ip", "one two seven[.]zero[.]zero [dot] one"),
    ("host one nine 2 dot 1 six eight dot 10 dot one", "ip", "one nine 2 dot 1 six eight dot 10 dot one"),
    ("eins.zwei.drei.vier", "ip", "eins.zwei.drei.vier"),
    ("call +1 four one five 555 0199", "phone", "+1 four one five 555 0199"),
    ("call plus 1 (four one five) 555-0199", "phone", "plus 1 (four one five) 555-0199"),
    ("pay 4111 1111 one one one one 1111", "card", "4111 1111 one one one one 1111"),
    ("pay four 111 one 111 one 111 one 111", "card", "four 111 one 111 one 111 one 111"),
    ("card two  4111 1111 1111 one one one one", "card", "4111 1111 1111 one one one one"),
    ("page one 4111\u200b 1111 1111 1111", "card", "4111\u200b 1111 1111 1111"),
    ("ſix dot FIVE dot fıve dot oh", "ip", "ſix dot FIVE dot fıve dot oh"),
])
def test_short_runs_of_number_words(text, kind, value):
    assert pii._find(pa.record_batch([pa.array([1]), pa.array([text])], ["doc_id", "text"]))["spans"] == [
        f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"]


@pytest.mark.parametrize("text", [
    "host one 10.0.0.1 is up", "one 4111 1111 1111 1111", "two or 3 of 10", "one two three 4 5 6", "version one.two.3", "null null 0 0",
    "meet at five 10 2024", "one. 2 three. 4 five.",
])
def test_number_words_beside_figures_add_nothing(text):
    assert pii.added_spans(text, pii.base_spans(text)) == []


def test_base_spans_are_not_added_again():
    for text in ("\u200bjohn@example.com", "one-two@example.com \u200b", "john@example.com\u200b"):
        assert pii.added_spans(text, pii.base_spans(text)) == []


@pytest.mark.parametrize("text", ["look at example.com now", "one two three", "meet me at the dot", "привет мир", "a @ b", "one dot two three four five six seven eight", "punkt eins zwei"])
def test_clean_texts_stay_clean(text):
    assert pii.added_spans(text, pii.base_spans(text)) == []


def test_cover():
    rng = np.random.default_rng(6)
    for _ in range(300):
        spans = [(int(a), int(a + n), "x") for a, n in zip(rng.integers(0, 60, 5), rng.integers(1, 9, 5))][: rng.integers(0, 6)]
        cover = Cover(spans)
        for a in range(70):
            assert cover.clear(a, a + 3) == all(a + 3 <= s or a >= e for s, e, _ in spans)


def test_cut_inside_one_bin(spark):
    """Very many small documents whose finish times crowd round the cut."""
    rows = [(k, " ".join(["w"] * (1 + k % 3)), "ab"[k % 5 == 0]) for k in range(6_000)] + [(9_000, "v " * 40_000, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).collect()
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    taken = sum(r.taken for r in got)
    assert len(got) == len(rows) and total - largest < taken <= total and all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, odd, none, stage):
    got = stage(spark, odd, SF)
    assert "bucket_len" in got.columns or got.columns == odd.columns
    assert got.count() > 0 and stage(spark, none, SF).count() == 0


def test_pipeline(spark, docs, tmp_path):
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        if name != "packing":
            assert after.columns == docs.columns
            after.write.parquet(str(tmp_path / name))
            after = spark.read.parquet(str(tmp_path / name))
        rows, old = after.collect(), before.collect()
        if name == "language":
            assert {r.doc_id for r in rows} == {r.doc_id for r in old if re.search(r"[^\W\d_]", r.text or "")}
        if name == "near_copies":
            assert {r.doc_id for r in rows} == {c for _, n, c in components([(r.doc_id, r.text) for r in old], 5, 80)}
        if name == "secrets":
            assert len(rows) == len(old) and not any(plain_secrets(r.text) for r in rows)
        if name == "mixture":
            taken = {r.doc_id: r.taken // r.size for r in mixing.mix(before).collect() if r.taken}
            assert Counter(r.doc_id for r in rows) == taken
        if name == "packing":
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in old)
        before = after
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows))


def test_all_runs_of_all_texts_are_counted(spark):
    """Texts with more runs than a few, equal texts once, runs in base spans never."""
    rng = np.random.default_rng(5)
    words = keys_of(5, 60, 9, "abcdefghijklm") + keys_of(6, 60, 20, "abcdefghijklm")
    texts = [" ".join(rng.choice(words, 80)) + (" token=abcdefghijklm" if k % 3 == 0 else "") for k in range(30)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:10] + ["", None]], "text string")
    found = secret_scan.per_batch(df, secret_scan._scan, secret_scan.SCANNED)
    counts = {r.value: r.texts for r in secret_scan.run_counts(found.select("copy", "ordinary")).collect()}
    assert counts == Counter(w for t in set(texts) for w in set(t.replace(" token=abcdefghijklm", "").split()))


def tree_automaton(strings):
    """The automaton of all strings, from one sorted pass."""
    rows = sorted(("", automata.symbols(v), v) for v in strings)
    made = automata.Automaton.of_nodes([node[1:] for node in automata._tree(rows, {"": 2})], 2)
    return made.recounted(made.counts(strings))


@pytest.mark.parametrize("dealt", ["true", "false"])
def test_automata_learn_from_all_strings(spark, dealt):
    """All labelled credentials and all recurring runs, more than a few hundred of each, in one task or many."""
    keys, words = ["gh_" + v for v in keys_of(11, 900, 20, MIXED)], keys_of(12, 700, 8, "abcdefghijklm") + keys_of(13, 300, 20, "abcdefghijklm")
    labelled = spark.createDataFrame([("assign", v) for v in keys + keys[:50]] + [("hex", "f" * 24)], "kind string, value string")
    runs = spark.createDataFrame([(w, 2 + k % 5) for k, w in enumerate(words)] + [(f"once{k}", 1) for k in range(99)], "value string, texts bigint")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, dealt)
        models = secret_scan.learned(labelled, runs)
    finally:
        spark.conf.set(name, before)
    assert list(models.kinds) == ["assign"] and models.least == 23
    model, lowest = models.kinds["assign"]
    plain = tree_automaton(keys)
    assert sum(s.ends for s in model.states) == len(keys) and sum(s.ends for s in models.plain.states) == len(words)
    assert [model.score(v) for v in keys + words] == pytest.approx([plain.score(v) for v in keys + words])
    ranked = sorted(keys, key=lambda v: hashlib.md5(v.encode()).hexdigest())
    halves = ranked[::2], ranked[1::2]
    assert lowest == pytest.approx(min(min(map(tree_automaton(half).score, other)) for half, other in (halves, halves[::-1])))


def test_rare_nodes_of_a_tree_are_no_states_and_all_strings_count(spark):
    """Of more strings than a tree has nodes for, each counts, and the literal that all share is learned."""
    rng = np.random.default_rng(14)
    values = sorted({"AB-" + "".join(rng.choice(list("0123456789abcdef"), 12)) for _ in range(5_000)})
    rows = spark.createDataFrame([("x", v) for v in values] + [("y", v[::-1]) for v in values[:40]], "name string, value string").repartition(5)
    found = automata.learned(rows)
    assert {k: sum(s.ends for s in a.states) for k, a in found.items()} == {"x": len(values), "y": 40}
    assert sum(sum(s.times.values()) for s in found["x"].states) == sum(map(len, values))
    assert min(map(found["x"].score, values[::50])) > max(found["x"].score("XY-" + v[3:]) for v in values[::50])
