"""Fill-in-middle, token alignment and SimHash against brute force, and on awkward rows."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from logmill.llm import alignment, fill_middle, queries, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"
AWKWARD = "doc_id bigint, text string, n int, form string, output string, fp int, pairs int, row_ int, held int, `a.b` int"
LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Null columns, empty and very long texts, equal ids, repeated rows, names that clash."""
    more = (1, "x", "y", 1, 1, 1, 1, 1)
    texts = [
        (1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (4, LONG),
        (None, "no id here but words"), (None, None), (5, "  \t\n "), (6, "a <P> mark"), (7, "<S"), (8, "é😀ｆ日本 é\r\n ende "),
        (9, "one"), (1 << 62, "ONE"), (10, "▁ sign <s> and <|endoftext|> and <0x41>"), (11, "x" * 5_000), (12, "\x00\x1c\x85  z"),
    ]
    return spark.createDataFrame([(i, t, *more) for i, t in texts], AWKWARD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], AWKWARD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def key(row):
    return repr(row)


def plain_middle(i, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark, docs, odd, none):
    rng = random.Random(5)
    signs = [" ", "\t", "\n", "\x0b", "a", "é", "😀", "<P>", "<", "P>", "<S", "M>", "x"]
    made = [(k, "".join(rng.choices(signs, k=rng.randint(0, 14)))) for k in range(2_000)]
    for df in (docs.select("doc_id", "text"), odd, spark.createDataFrame(made, "doc_id bigint, text string")):
        got = fill_middle.transformed(df)
        want = [plain_middle(*r) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
        back = fill_middle.restored(got).select("doc_id", "text").collect()
        assert sorted(map(tuple, back), key=key) == sorted(((i, t or "") for i, t in df.select("doc_id", "text").collect()), key=key)
    forms = Counter(r.form for r in fill_middle.transformed(docs).collect())
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 0
    assert fill_middle.transformed(none).count() == fill_middle.restored(fill_middle.transformed(none)).count() == 0
    every = fill_middle.transformed(docs, rate=100, spm=0, seed=7)
    assert {r.form for r in every.collect() if "<" not in r.output[3:] or r.form != "plain"} <= {"psm", "plain"}


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(Path(queries.BYTE_BPE).read_bytes(), Path(queries.PIECE_BPE).read_bytes())


def plain_alignment(both, text):
    """Whole texts, byte ends from the decoded bytes alone."""
    if not text:
        return None
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    ends = []
    for ids, table in ((a, both.a_bytes), (b, both.b_bytes)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        at, own = 0, []
        for i in ids:
            at += len(table[i])
            own.append(at)
        ends.append(own)
    groups, links, i, j = [], [], 0, 0
    place = [{end: k + 1 for k, end in enumerate(own)} for own in ends]
    for end in sorted(place[0].keys() & place[1].keys()):
        x, y = place[0][end], place[1][end]
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        links.append((a[x - 1], b[y - 1]))
        i, j = x, y
    return len(a), len(b), ";".join(groups), links


def plain_rows(both, rows):
    found = [(i, plain_alignment(both, t)) for i, t in rows]
    counts = Counter(p for _, f in found if f for p in f[3])
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    for i, f in found:
        if f is None:
            yield i, 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, groups, links = f
            best = sum(counts[p] == top[p[1]] for p in links)
            digest = hashlib.sha256(groups.encode()).hexdigest()
            yield i, a, b, groups.count(";") + 1, len(links), best, sum(counts[p] for p in links), digest


def test_chunks_align_as_the_whole_text(both):
    rng = random.Random(3)
    signs = [*"ab  \t\n\r'sé😀ｆ▁日<0x41>|\x1c\x85\xa0́\x00İ", "<s>", "<|endoftext|>", "'re", " 123", "\r\n"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 25))) for _ in range(4_000)]
    assert both.separable
    odd = 0
    for text, parts in zip(texts, both.entries(texts)):
        got = parts and (sum(p[0] for p in parts), sum(p[1] for p in parts), ";".join(p[2] for p in parts),
                         [(x >> 32, x & 0xFFFFFFFF) for p in parts for x in p[3]])
        assert got == plain_alignment(both, text)
        odd += got is None
    assert 0 < odd < len(texts)


def test_alignment(spark, docs, odd, none, both):
    for df in (docs.filter("doc_id < 120"), odd):
        got = alignment.aligned(df, queries.BYTE_BPE, queries.PIECE_BPE)
        want = list(plain_rows(both, df.select("doc_id", "text").collect()))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert alignment.aligned(none, queries.BYTE_BPE, queries.PIECE_BPE).count() == 0


def plain_fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(max(len(words) - width + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(rows, bits=3):
    """All pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    return [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, prints, plain_classes([i for i, _ in rows], prints, bits))]


def plain_classes(ids, prints, bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in range(len(prints)):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= bits:
                parent[find(x)] = find(y)
    least = {}
    for x, i in enumerate(ids):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [least.get(find(x)) for x in range(len(prints))]


def test_simhash(spark, docs, odd, none):
    few = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = few.collect()
    got = simhash.near_components(few.withColumn("fp", F.lit("clash")))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_near(rows), key=key)
    assert simhash.near_components(none).count() == 0
    assert [simhash.fingerprint(b"A b\tC"), simhash.fingerprint(b"a b")] == [plain_fingerprint("a B c"), plain_fingerprint("A b")]
    jvm = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint(b"A  b\nc") == jvm % (1 << 64)
    long = docs.limit(1).select(F.lit(LONG).alias("text")).first().text
    assert simhash.fingerprint(long.encode()) == plain_fingerprint(long)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_simhash_links_of_dense_groups(spark, monkeypatch, bits):
    """Clouds of fingerprints around a few centres; small salts, so that large buckets are dealt out."""
    monkeypatch.setattr(simhash, "SALTED", 16)
    rng = random.Random(bits)
    prints = {0, (1 << 64) - 1}
    for centre in (0, rng.getrandbits(64), rng.getrandbits(64)):
        loose = rng.sample(range(64), 14)
        for _ in range(220):
            prints.add(centre ^ sum(1 << b for b in rng.sample(loose, rng.randint(0, 7))))
    prints = sorted(prints) + [rng.getrandbits(64) for _ in range(200)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(p, 1 + k % 5) for k, p in enumerate(signed)], "fp bigint, docs bigint")
    found = simhash.links(classes, bits).collect()
    assert all(((a ^ b) % (1 << 64)).bit_count() <= bits for a, b in found)
    at = {p: k for k, p in enumerate(signed)}
    parent = list(range(len(prints)))
    for _ in range(len(prints)):
        changed = False
        for a, b in found:
            low = min(parent[at[a]], parent[at[b]])
            changed |= parent[at[a]] != low or parent[at[b]] != low
            parent[at[a]] = parent[at[b]] = low
        if not changed:
            break
    assert parent == plain_classes(list(range(len(prints))), prints, bits)


def test_token_counter_is_made_once_for_a_worker(spark, tmp_path):
    """Tasks of a worker share the tables of the tokenizer."""
    import base64
    import os

    from logmill.llm import token_counts
    from logmill.llm.common import per_batch

    (tmp_path / "ranks").write_text("\n".join(f"{base64.b64encode(bytes([k])).decode()} {k}" for k in range(256)) + "\n")
    count = token_counts.bpe_counter(spark, str(tmp_path / "ranks"))

    def probe(batch):
        n = count(batch.column("text"))
        return {"pid": [os.getpid()], "at": [id(sys.modules["logmill_lasting"].__dict__[f"bpe {tmp_path / 'ranks'}"][1])], "n": [sum(n)]}

    rows = per_batch(spark.range(0, 32, 1, 32).selectExpr("concat('t', id) as text"), probe, "pid bigint, at bigint, n bigint").collect()
    assert sum(r.n for r in rows) == 10 * 2 + 22 * 3
    assert len({(r.pid, r.at) for r in rows}) == len({r.pid for r in rows})
