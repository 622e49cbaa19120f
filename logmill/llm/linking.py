"""Exact linking of documents by the Jaccard similarity of their shingle sets.

Documents with equal sets form a class; all work is on classes. Candidates share a bucket. Two rounds
keep the pairs few without losing a link:

1. In each bucket every class is paired with the bucket's most central class, never all with all.
   Verified pairs are joined to components.
2. Two classes of a bucket that are still in different components are paired at their first common key, if their
   sizes, 1,024-bit marks and the key's places leave the needed overlap possible; then the keys they share are
   counted. Pairs within a component need no test: they cannot change it. So a large group of near copies costs
   its size and not the square of it, and a pair is one row however many keys it shares.

Verification intersects the whole sets. Sets are made again from the texts, for the classes of possible
pairs only, each from one of its texts. A bit table of fixed size (``FILTER_BITS``) over text digests tells
workers which texts; its false hits cost time only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logmill.llm.common import batched, columns_of, per_batch, spread_join, stored
from logmill.llm.shingles import mixed, shingle_sets

MARK_WORDS = 16
MARKS = [f"m{k}" for k in range(MARK_WORDS)]
FILTER_BITS = 25
#: Rows of a bucket for each salt, and earlier keys that tell whether two classes have met.
SALTED, BEFORE = 128, 4
ROWS = "doc_id bigint, n bigint, cls bigint, marks array<bigint>, keys array<bigint>, digest bigint"


def class_of(grams: np.ndarray) -> int:
    """The identity of a set: 64 bits of its members and size."""
    total = np.add.reduce(mixed(grams + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) if len(grams) else np.uint64(0)
    return int(mixed(np.array([total], np.uint64) + np.uint64(len(grams)))[0].astype(np.int64))


def bitmap(grams: np.ndarray) -> np.ndarray:
    words = np.zeros(MARK_WORDS, np.uint64)
    slot = grams >> np.uint64(54)
    np.bitwise_or.at(words, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return words.view(np.int64)


def _possible(percent: int) -> Column:
    """Sizes and marks of a and b allow the similarity: each mark that only one set has is a member
    that the other lacks."""
    n, m = F.col("a.n"), F.col("b.n")
    sizes = (100 * n >= percent * m) & (100 * m >= percent * n)

    def lacking(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"{x}.{m}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{m}")))) for m in MARKS), F.lit(0))

    overlap = F.least(n - lacking("a", "b"), m - lacking("b", "a"))
    return sizes & ((100 + percent) * overlap >= percent * (n + m))


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for every vertex of ``edges`` (a, b) the smallest vertex it is connected with.

    Smallest-neighbour labels with pointer jumping; each round is written to the shared folder."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("v", "u"), "edges")
    labels = stored(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = stored(
            lower.join(jump, "label", "left").select("v", "old", F.coalesce(F.least("label", "far"), "label").alias("label")), "labels"
        )
        if not new.filter("label <> old").limit(1).count():
            return new.select("v", "label")
        labels = new.select("v", "label")


def _sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(cls, grams): the sorted set, eight bytes a member, of each wanted (cls, digest of one of its texts)."""
    slot = F.col("digest").bitwiseAND((1 << FILTER_BITS) - 1)
    words = (
        wanted.groupBy(F.shiftright(slot, 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(digest & 63 as int))")).alias("bits")).toPandas()
    )
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            digest = batch.column(1).to_numpy().view(np.uint64)
            at = digest & np.uint64((1 << FILTER_BITS) - 1)
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            rows = np.flatnonzero(bits[word] & bit)
            rows = rows[np.sort(np.unique(digest[rows], return_index=True)[1])]
            texts = batch.column(0).take(pa.array(rows))
            ids, grams = [], []
            for found in shingle_sets(texts, width):
                if len(found):
                    ids.append(class_of(found))
                    grams.append(found.tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.binary())], ["cls", "grams"])

    found = docs.select("text", F.xxhash64("text").alias("digest")).mapInArrow(run, "cls bigint, grams binary")
    return stored(found.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.any_value("grams").alias("grams")), "sets")


def _verified(texts: DataFrame, width: int, pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("cls").join(info.select("cls", "digest"), "cls")
    sets = _sets(texts, width, stored(wanted, "wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                common = int(np.count_nonzero(q[at] == p))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # by b first: many pairs may share one a, and rows that carry a set are heavy enough for AQE to split
    joined = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
    return stored(joined.mapInArrow(run, "a bigint, b bigint"), "links")


def _open(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, cls, pos, label, size) of the buckets whose classes are not all in one component."""
    joined = postings.join(labels.withColumnRenamed("v", "cls"), "cls", "left").select(
        "bucket", "cls", "pos", F.coalesce("label", "cls").alias("label")
    )
    split = joined.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
    return joined.join(split.filter("lo < hi").select("bucket", "size"), "bucket")


def _rest_pairs(rest: DataFrame, percent: int, prefixes: bool) -> DataFrame:
    """(a, b) of different components that share a bucket and may reach the similarity.

    Each class lists its keys in one global order, so two classes are paired at their first common key only:
    where they share one of the ``BEFORE`` keys before it, they have met there or earlier. (Keys of buckets that are
    not open are common to no two components.) For prefixes nothing is common before that key, so what follows it
    in both sets must leave the needed overlap. In a large bucket one side is dealt by salt and the other goes to
    every salt, so many tasks share it."""
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = Window.partitionBy("cls").orderBy("pos")
    before = F.array_compact(F.array(*(F.lag("bucket", k).over(own) for k in range(1, BEFORE + 1))))
    salts = F.floor(F.col("size") / SALTED) + 1
    rest = rest.withColumn("before", before)
    a = rest.withColumn("salt", F.pmod(F.xxhash64("cls"), salts)).repartition(parts, "bucket", "salt")
    b = rest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).repartition(parts, "bucket", "salt")
    meet = F.expr("a.bucket = b.bucket and a.salt = b.salt and a.cls < b.cls and a.label <> b.label")
    meet = meet & ~F.arrays_overlap("a.before", "b.before")
    if prefixes:
        n, m = F.col("a.n"), F.col("b.n")
        meet = meet & ((100 + percent) * F.least(n - F.col("a.pos"), m - F.col("b.pos")) >= percent * (n + m))
    return a.alias("a").join(b.alias("b"), meet & _possible(percent)).select(
        F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), F.col("a.n").alias("n"), F.col("b.n").alias("m")
    ).distinct()


def _with_common(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """``pairs`` with ``common``: the number of keys (cls, keys) that both classes have."""
    a, b = (keys.select(F.col("cls").alias(c), F.col("keys").alias(f"{c}_keys")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b")
    return both.select(*pairs.columns, F.size(F.array_intersect("a_keys", "b_keys")).alias("common"))


def _enough(percent: int) -> Column:
    """The common keys of two prefixes (of all but ``ceil(t * n) - 1`` members) leave the overlap possible:
    what is common beyond them lies outside the prefix that ends first."""
    outside = F.greatest(*(F.floor((percent * F.col(c) + 99) / 100) - 1 for c in ("n", "m")))
    return (100 + percent) * (F.col("common") + outside) >= percent * (F.col("n") + F.col("m"))


def _star_pairs(postings: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """(a, b, common buckets) of each class of a bucket with the bucket's most central one.

    The class that shares most of its keys is the likeliest original of a group of copies. It is found
    by one number (shared keys, then some bits of the class), so that partial sums stay in hash tables."""
    ranked = postings.join(
        info.select("cls", F.expr("(least(degree, 8388607) << 40) | (cls & 1099511627775)").alias("rank")), "cls"
    )
    top = ranked.groupBy("bucket").agg(F.max("rank").alias("rank"))
    lead = ranked.join(top, ["bucket", "rank"]).select("bucket", F.col("cls").alias("lead"))
    pairs = (
        postings.join(lead, "bucket").filter("cls <> lead")
        .groupBy(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).agg(F.count("*").alias("common"))
    )
    a, b = (info.select(F.col("cls").alias(c), F.struct("cls", "n", *MARKS).alias(f"{c}_")) for c in "ab")
    return (
        pairs.join(a, "a").join(b, "b").select("common", F.col("a_").alias("a"), F.col("b_").alias("b"))
        .filter(_possible(percent))
        .select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), F.col("a.n").alias("n"), F.col("b.n").alias("m"), "common")
    )


def grouped(
    docs: DataFrame, width: int, percent: int, keyed: Callable[[pa.RecordBatch], dict], prefixes: bool = False
) -> DataFrame:
    """doc_id, n_shingles, component_id, digest (of the text) and label (null for an empty set) of every document;
    ``keyed`` makes ``ROWS`` of (doc_id, text). ``prefixes``: the keys are the first members in one global
    order, as many as the similarity asks for, so pairs with too few common keys need no verification."""
    batched(docs.sparkSession)
    texts = columns_of(docs, doc_id="bigint", text="string")
    rows = stored(per_batch(
        texts.withColumn("digest", F.xxhash64("text")), lambda b: {**keyed(b), "digest": b.column(2)}, ROWS
    ), "classes")
    held = rows.filter("n > 0")
    first = held.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"))
    postings = held.select(F.posexplode("keys").alias("pos", "bucket"), "cls")
    shared = postings.groupBy("bucket").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter("a < z").select("bucket")
    postings = stored(postings.join(shared, "bucket", "left_semi").distinct(), "postings")
    degree = postings.groupBy("cls").agg(F.count("*").alias("degree"))
    info = stored(
        held.select("cls", "n", "marks", "digest").join(degree, "cls").groupBy("cls")
        .agg(*(F.any_value(c).alias(c) for c in ("n", "marks", "degree")), F.min("digest").alias("digest"))
        .select("cls", "n", "degree", "digest", *(F.col("marks")[k].alias(m) for k, m in enumerate(MARKS))), "candidates",
    )
    enough = _enough(percent) if prefixes else F.lit(True)
    stars = stored(_star_pairs(postings, info, percent).filter(enough).select("a", "b"), "pairs")
    links = _verified(texts, width, stars, info, percent)
    rest = _open(postings, components(links)).join(info.drop("degree", "digest"), "cls")
    pairs = _rest_pairs(stored(rest, "open"), percent, prefixes).join(stars, ["a", "b"], "left_anti")
    if prefixes:
        wanted = stored(pairs, "met")
        some = wanted.select(F.col("a").alias("cls")).union(wanted.select("b")).distinct()
        pairs = _with_common(wanted, held.select("cls", "keys").join(some, "cls", "left_semi").dropDuplicates(["cls"])).filter(enough)
    pairs = stored(pairs.select("a", "b"), "pairs")
    labels = components(links.union(_verified(texts, width, pairs, info, percent)))

    named = first.join(labels.withColumnRenamed("v", "cls"), "cls", "left").select(
        "cls", "doc_id", F.coalesce("label", "cls").alias("label")
    )
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "label").select("cls", "label", "component_id")
    full = spread_join(held.select("doc_id", "n", "digest", "cls"), named, "cls", "doc_id")
    empty = rows.filter("n = 0").select("doc_id", "n", "digest", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("label"))
    return full.select("doc_id", "n", "digest", "component_id", "label").union(empty).withColumnRenamed("n", "n_shingles")
