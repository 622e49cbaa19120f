"""Alignment of the tokens of two tokenizers, a byte-level BPE (A) and a sentencepiece BPE (B).

Spans: the character offsets of the ``tokenizers`` library and the begin and end of each piece in
sentencepiece's proto give the token ends as coarse cuts. Two kinds of tokens need more: several A tokens
may share one multibyte character, and byte-fallback tokens of B have no span of their own; their ends follow
from their decoded bytes. A text counts only if the joined bytes of both sides are a space and the text.

A text is cut before each space that follows a non-space character, and a worker aligns a chunk once as long
as it keeps it (chunks met lately, a bounded number). That is exact if no merge crosses such a cut: A splits by the byte-level pattern and has no
normalizer, B has the identity normalizer, adds the space in front and has no piece with a space after
another character. Other tokenizers, and texts with a chunk that does not decode to itself, are aligned as
wholes. Ends of chunks are common ends, so the groups of a text are those of its chunks in turn.

Links are counted over the corpus by id pair: each document brings its distinct pairs with their number,
written to the shared folder, and pair counts are sums over these (partial aggregation, at most a row per
pair and task). They are joined back to the documents' pairs; Spark broadcasts the pair table if its stored
size is below the session's threshold and otherwise joins by sort, splitting hot pairs.

Edge cases: texts that are null or empty, or whose bytes come back changed, have no tokens: zeros and '' for
the digest; strings of special tokens are plain text; repeated rows count each; a document without id is a
row like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from logmill.llm.common import arrow_schema, batched, columns_of, lasting, stored

#: Where no token of either side crosses: before a space after a non-space character.
CUT = re.compile(r"(?<=\S)(?= )")
SPACE = "▁"
#: White space before a space, where the cut is not valid (fixed values: what Python takes for white space).
BEFORE_SPACE = [chr(c) + " " for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Chunks that a worker keeps (twice), the longest of them, chunks that are encoded as one text, and characters
#: that are aligned at once.
KEPT, LONGEST, TOGETHER, PIECE = 3 << 16, 64, 64, 1 << 16
#: Token ids of a pair are one number: A's above, B's in the low bits.
LOW = 32
ROWS = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<bigint>, times array<bigint>"
)
#: Numbers of tokens of A and B, the groups as text, and the id pairs of the links (one for each group, as
#: no token is empty). None stands for a text whose bytes changed.
Entry = tuple[int, int, str, tuple[int, ...]]


def byte_of() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else
    the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, from the bytes of their files."""

    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        table = byte_of()
        self.a_bytes = {i: bytes(table[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.fallback = np.array([self.b.is_byte(i) for i in range(self.b.vocab_size())])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if own else p.replace(SPACE, " ").encode() for p, own in zip(pieces, self.fallback)
        ]
        spec, model = json.loads(a), sentencepiece_model_pb2.ModelProto.FromString(b)
        split, norm = spec["pre_tokenizer"] or {}, model.normalizer_spec
        self.separable = (
            spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not any(SPACE in p.lstrip(SPACE) for p, own in zip(pieces, self.fallback) if not own)
        )
        self.a_lengths, self.b_lengths = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(x) for x in self.b_bytes])
        for i, x in self.a_bytes.items():
            self.a_lengths[i] = len(x)
        self.text = [str(i) for i in range(max(len(self.a_lengths), len(self.b_lengths)))]
        self.kept: dict[str, Entry | None] = {}
        self.older: dict[str, Entry | None] = {}

    def _ends(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Byte ends of tokens: their spans' ends, but where a token shares its last character with the next one
        (``own`` marks others without a span) what the decoded bytes up to it add up to."""
        refined = own.copy()
        refined[:-1] |= starts[1:] < ends[:-1]
        return np.where(refined, np.cumsum(lengths[ids]), ends)

    def align(self, chunks: list[str]) -> list[Entry | None]:
        """Of each chunk, without its space. Where they are joined the cuts are valid."""
        pieces, at = [], 0
        while at < len(chunks):
            pieces.append(" " + " ".join(chunks[at : at + TOGETHER]))
            at += TOGETHER
        text = "".join(pieces)
        whole = text.encode()
        sizes = np.array([len(p) for p in pieces])
        if len(whole) == len(text):
            at = np.arange(len(text) + 1)
        else:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        before = np.cumsum(sizes) - sizes
        coded = self.a.encode_batch(pieces, add_special_tokens=False)
        a = np.array([i for c in coded for i in c.ids], np.int64)
        spans = [c.offsets for c in coded]
        shift = np.repeat(before, [len(x) for x in spans])
        starts, ends = (np.array([x[k] for y in spans for x in y], np.int64) + shift for k in range(2))
        # sentencepiece's spans are in bytes of the text without the space
        protos = self.b.encode([p[1:] for p in pieces], return_type="proto", num_threads=1)
        found = [(p.id, p.begin, p.end) for x in protos for p in x.pieces]
        b = np.array([x[0] for x in found], np.int64)
        shift = np.repeat(at[before], [len(x.pieces) for x in protos])
        b_starts, b_ends = (np.array([x[k] for x in found], np.int64) + shift + 1 for k in (1, 2))
        a_list, b_list = a.tolist(), b.tolist()
        if b"".join([self.a_bytes[i] for i in a_list]) != whole or b"".join([self.b_bytes[i] for i in b_list]) != whole:
            return [self.align([c])[0] for c in chunks] if len(chunks) > 1 else [None]
        a_ends = self._ends(a, at[starts], at[ends], self.a_lengths, np.zeros(len(a), bool))
        b_ends = self._ends(b, b_starts, b_ends, self.b_lengths, self.fallback[b])
        # no token is empty, so both are strictly increasing
        _, at_a, at_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        links = (a[at_a] << LOW | b[at_b]).tolist()
        last = np.searchsorted(a_ends[at_a], np.cumsum([len(c.encode()) + 1 for c in chunks])) + 1  # groups up to each chunk's end
        to_a, to_b = at_a + 1, at_b + 1
        counts = [np.diff(to[last - 1], prepend=0).tolist() for to in (to_a, to_b)]
        a_text, b_text = [self.text[i] for i in a_list], [self.text[i] for i in b_list]
        to_a, to_b = to_a.tolist(), to_b.tolist()
        groups = [
            f"{a_text[i]}|{b_text[j]}" if to_i - i == 1 == to_j - j else f"{','.join(a_text[i:to_i])}|{','.join(b_text[j:to_j])}"
            for i, to_i, j, to_j in zip([0, *to_a], to_a, [0, *to_b], to_b)
        ]
        last = last.tolist()
        return [
            (n, m, ";".join(groups[i:to]), tuple(links[i:to])) for n, m, i, to in zip(*counts, [0, *last], last)
        ]

    def _aligned(self, chunks: list[str]) -> Iterator[Entry | None]:
        """Together in pieces of many chunks, but a chunk that ends in white space or has none stands alone."""
        alone = [not self.separable or not c or c[-1].isspace() for c in chunks]
        at = 0
        while at < len(chunks):
            to, size = at, 0
            while to < len(chunks) and size < PIECE and not alone[to]:
                size += len(chunks[to])
                to += 1
            to = max(to, at + 1)
            yield from self.align(chunks[at:to])
            at = to

    def _found(self, chunks: Iterable[str]) -> dict[str, Entry | None]:
        """An entry of each chunk; those met lately are kept, in two generations."""
        found, new, again = {}, [], []
        for c in dict.fromkeys(chunks):
            if c in self.kept:
                found[c] = self.kept[c]
            elif c in self.older:
                found[c] = self.older[c]
                again.append(c)
            else:
                new.append(c)
        found.update(zip(new, self._aligned(new)))
        if len(self.kept) > KEPT:
            self.kept, self.older = {}, self.kept
        self.kept.update((c, found[c]) for c in chain(again, new) if len(c) <= LONGEST)
        return found

    def cut(self, text: str) -> list[str]:
        """The chunks of a text without the space before each."""
        if not self.separable:
            return [text]
        if text[0] == " " or any(pair in text for pair in BEFORE_SPACE):
            return [c[1:] for c in CUT.split(" " + text)]
        return text.split(" ")

    def entries(self, texts: list[str]) -> Iterator[list[Entry] | None]:
        """The entries whose sequence is each (not empty) text; None: its bytes changed."""
        cut = [self.cut(t) for t in texts]
        found = self._found(chain.from_iterable(cut))
        for text, chunks in zip(texts, cut):
            parts = [found[c] for c in chunks]
            if None in parts:  # the whole may still decode to itself
                parts = self.align([text])
            yield None if None in parts else parts


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), pa.int64()))


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``ROWS`` of every document; the files are read where this runs and travel to the workers."""
    spark = batched(docs.sparkSession)
    files = _file(a_path), _file(b_path)
    digest = hashlib.sha256(b"|".join(files)).hexdigest()
    files = spark.sparkContext.broadcast(files)
    fields, arrow = arrow_schema(spark, ROWS)

    def one(batch: pa.RecordBatch, both: Aligner) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        held = [k for k, t in enumerate(texts) if t]
        numbers, digests = np.zeros((4, len(texts)), np.int64), [""] * len(texts)
        pairs, times = ([np.zeros(0, np.int64)] * len(texts) for _ in range(2))
        for k, parts in zip(held, both.entries([texts[k] for k in held])):
            if parts:
                a, b, groups, links = zip(*parts)
                ids = np.fromiter(chain.from_iterable(links), np.int64)
                pairs[k], times[k] = np.unique(ids, return_counts=True)
                numbers[:, k] = sum(a), sum(b), len(ids), len(ids)
                digests[k] = hashlib.sha256(";".join(groups).encode()).hexdigest()
        return pa.RecordBatch.from_arrays([
            batch.column(0), *(pa.array(x) for x in numbers), pa.array(digests, pa.string()), _lists(pairs), _lists(times),
        ], names=arrow.names).cast(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = lasting("aligner", digest, lambda: Aligner(*files.value))
        gc.disable()  # no cycles arise here, and looking for them among the kept entries takes a fifth of the time
        try:
            for batch in batches:
                if batch.num_rows:
                    yield one(batch, both)
        finally:
            gc.enable()

    return columns_of(docs, doc_id="bigint", text="string").mapInArrow(run, fields)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, held (its links in the corpus) and best (its B id is linked with no A id more often)."""
    counts = rows.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(
        F.sum("times").alias("held")
    )
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND((1 << LOW) - 1)), "pairs")
    top = counts.groupBy("b").agg(F.max("held").alias("top"))
    return counts.join(top, "b").select("pair", "held", (F.col("held") == F.col("top")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    rows = stored(token_groups(docs, a_path, b_path).withColumn("row_", F.monotonically_increasing_id()), "token-groups")
    facts = stored(pair_counts(rows), "pair-counts")
    links = rows.select("row_", F.inline(F.arrays_zip("pairs", "times"))).join(facts, F.col("pairs") == F.col("pair"))
    sums = links.groupBy("row_").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum")
    )
    return rows.join(sums, "row_", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")),
        "groups_sha256",
    )
