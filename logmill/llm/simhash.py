"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a bit for each bit of the shingles' XXH64 values that is set in more than half of them;
documents with equal fingerprints form a class and all further work is on classes. Each class has a row in
a table of its Hamming distances to ``PIVOTS`` reference fingerprints. By the triangle inequality no
coordinate of two fingerprints that are ``bits`` apart differs by more than ``bits``: pairs with a larger
difference are discarded on the tables alone, and the Hamming distance of the survivors is worked out.

Which pairs meet at all: the 64 bits are cut into twice as many blocks as bits may differ, so linked
fingerprints agree in half of the blocks at least. Each class is filed under its bits in every such choice of
blocks (20 keys of about 32 bits for 3 differing bits; pivot coordinates are no keys, as nearly all of them are
within 12 of 32). Buckets of one class go at once. Then two rounds keep dense groups from meeting all with
all: in each bucket the class with most documents is compared with all others, and only classes that are in
different components after that are paired, large buckets dealt over salts. A pair meets at the first
choice of blocks it agrees in and nowhere else. No bucket has a cap.

Edge cases: null texts, empty ones and those without words have the fingerprint zero and are linked like any
other; a text with fewer words than the width is one shingle; repeated rows and equal texts are linked; a document
without id belongs to its component but cannot name it (null if no member has an id); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logmill.llm.common import batched, columns_of, per_batch, spread_join, stored
from logmill.llm.linking import components

WIDTH, BITS, SEED = 3, 3, 42
PIVOTS = 32
#: References: fixed random 64-bit numbers.
REFERENCES = [int(x) for x in np.random.default_rng(1309).integers(-(1 << 63), (1 << 63) - 1, PIVOTS, dtype=np.int64)]
TABLES = [f"t{k}" for k in range(PIVOTS // 8)]
#: Shingles that are unpacked to bits at once, and classes of a bucket for each salt.
STEP, SALTED = 1 << 16, 128
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Unsigned; ``text`` is UTF-8. Words are compared with A-Z in lower case."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    count = max(len(words) - width + 1, 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, STEP):
        hashes = np.array([
            xxhash.xxh64_intdigest(b" ".join(words[j : j + width]), SEED) for j in range(at, min(at + STEP, count))
        ], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (a signed long) of every whole text."""
    batched(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
        return {"doc_id": batch.column(0), "fp": np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)}

    return per_batch(columns_of(docs, doc_id="bigint", text="string"), run, "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks(bits: int) -> list[int]:
    """Masks of the blocks: twice as many as bits may differ, of nearly equal width."""
    edges = [64 * k // (2 * bits) for k in range(2 * bits + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _keys(fp: Column, bits: int) -> Column:
    """Of each choice of half of the blocks: its number as a bit set, all blocks up to its last, and the bits."""
    masks = blocks(bits)
    return F.array(*(
        F.struct(
            F.lit(sum(1 << k for k in chosen)).alias("chosen"), F.lit((2 << chosen[-1]) - 1).alias("upto"),
            fp.bitwiseAND(F.lit(_signed(sum(masks[k] for k in chosen)))).alias("held"),
        ) for chosen in combinations(range(2 * bits), bits)
    ))


def pivot_tables(fp: Column) -> list[Column]:
    """The distances to all references, eight in a long."""
    def distance(p: int) -> Column:
        return F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("bigint")

    return [
        sum((F.shiftleft(distance(p), 8 * j) for j, p in enumerate(REFERENCES[8 * k : 8 * k + 8])), F.lit(0).cast("bigint")).alias(t)
        for k, t in enumerate(TABLES)
    ]


def _near_all_pivots(bits: int) -> Column:
    """No coordinate of a and b differs by more than ``bits``."""
    def coordinate(side: str, t: str, j: int) -> Column:
        return F.shiftrightunsigned(F.col(f"{side}.{t}"), 8 * j).bitwiseAND(127)

    near = F.lit(True)
    for t in TABLES:
        for j in range(8):
            near = near & (F.abs(coordinate("a", t, j) - coordinate("b", t, j)) <= bits)
    return near


def _first_meeting(bits: int) -> Column:
    """The blocks that a and b agree in begin with those of the bucket."""
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    agree = sum(
        (F.when(apart.bitwiseAND(F.lit(_signed(m))) == 0, 1 << k).otherwise(0) for k, m in enumerate(blocks(bits))), F.lit(0)
    )
    return agree.bitwiseAND(F.col("a.upto")) == F.col("a.chosen")


def _apart(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def _star_links(postings: DataFrame, bits: int) -> DataFrame:
    """(a, b): each class of a bucket and the bucket's class with most documents, if they are near."""
    lead = postings.groupBy("chosen", "held").agg(F.max(F.struct("docs", "fp", *TABLES)).alias("top"))
    lead = lead.select("chosen", "held", "top.fp", *(f"top.{t}" for t in TABLES))
    met = postings.alias("a").join(lead.alias("b"), (F.expr(
        "a.chosen = b.chosen and a.held = b.held and a.fp <> b.fp"
    )) & _near_all_pivots(bits))
    pairs = met.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b"))
    return pairs.filter(_apart("a", "b") <= bits).distinct()


def _rest_links(postings: DataFrame, labels: DataFrame, bits: int) -> DataFrame:
    """(a, b): near classes of a bucket that are in different components."""
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = postings.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    bucket = ["chosen", "held"]
    split = named.groupBy(*bucket).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
    rest = stored(named.join(split.filter("lo < hi").select(*bucket, "size"), bucket), "open")
    salts = F.floor(F.col("size") / SALTED) + 1
    a = rest.withColumn("salt", F.pmod(F.xxhash64("fp"), salts)).repartition(parts, *bucket, "salt")
    b = rest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).repartition(parts, *bucket, "salt")
    meet = F.expr("a.chosen = b.chosen and a.held = b.held and a.salt = b.salt and a.fp < b.fp and a.label <> b.label")
    pairs = a.alias("a").join(b.alias("b"), meet & _first_meeting(bits) & _near_all_pivots(bits))
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).filter(_apart("a", "b") <= bits)


def links(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) of classes (fp, docs): near pairs that connect whatever all near pairs connect."""
    filed = classes.select("fp", F.explode(_keys(F.col("fp"), bits)).alias("k")).select("fp", "k.*")
    shared = filed.groupBy("chosen", "held").agg(F.count("*").alias("size")).filter("size > 1").select("chosen", "held")
    met = filed.join(shared, ["chosen", "held"], "left_semi").join(classes, "fp")
    postings = stored(met.select("chosen", "upto", "held", "fp", "docs", *pivot_tables(F.col("fp"))), "postings")
    stars = stored(_star_links(postings, bits), "links")
    return stars.union(stored(_rest_links(postings, components(stars), bits), "links"))


def near_components(docs: DataFrame, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    rows = stored(fingerprints(docs, width), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs")), "classes")
    labels = components(links(classes.select("fp", "docs"), bits))
    named = classes.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(least, "label").select("fp", "component_id")
    return spread_join(rows, named, "fp", "doc_id").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
