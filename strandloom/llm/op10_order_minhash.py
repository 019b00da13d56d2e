"""Order MinHash fingerprints of documents, sensitive to edit distance.

A text's k-mers of code points are numbered by occurrence, so that repeats count, and hashed with their numbers. The
hash deals each numbered k-mer to one of ``slots`` slots; a slot selects its ``tuple_size`` smallest hashes, puts their
k-mers back in the order of the text, and hashes that tuple. Equal slots need the same k-mers in the same order, which
is what tells an edit from a permutation. One pass over the text serves all slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, parts, strings_of

K, SLOTS, TUPLE = 8, 32, 2
#: Bytes of text that a range of ids is meant to hold, and the least number of ranges; the driver holds one id of each.
RANGE_BYTES, RANGES = 512_000_000, 1024
HOLD = 512


def kmer_hashes(text: str, k: int) -> np.ndarray:
    """A hash of each k-mer of code points; the whole text if it is shorter, none if it is empty.

    The hash of 2j code points is made of two hashes of j, so a k-mer takes about log2(k) passes.
    """
    if not text:
        return np.zeros(0, np.uint64)
    part = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    k = min(k, len(part))
    n = len(part) - k + 1
    total, done, width = None, 0, 1
    while True:
        if k & width:
            here = part[done : done + n]
            total = here.copy() if total is None else total * np.uint64(0x9E3779B97F4A7C15) + here
            done += width
        if done == k:
            break
        part = part[:-width] * np.uint64(0x100000001B3 + 2 * width) + part[width:]
        width *= 2
    total += np.uint64(k)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total


def signature(text: str, k: int = K, slots: int = SLOTS, size: int = TUPLE) -> np.ndarray:
    """The hash of each slot's tuple (uint32); 0 marks a slot without k-mers.

    The slot of a numbered k-mer is the high part of its hash, so sorted hashes are sorted by slot.
    """
    kmers = kmer_hashes(text, k)
    n = len(kmers)
    out = np.zeros(slots, np.uint32)
    if not n:
        return out
    value = mix64(kmers)
    low = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    packed = (kmers & ~low) | np.arange(n, dtype=np.uint64)
    packed.sort()  # equal k-mers together, in text order
    again = np.flatnonzero((packed[1:] ^ packed[:-1]) <= low) + 1  # places that repeat the k-mer before
    if len(again):
        new = np.ones(n, bool)
        new[again] = False
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        at = (packed[again] & low).astype(np.int64)
        number = (again - start[again]).astype(np.uint64)
        value[at] = mix64(kmers[at] ^ (number * np.uint64(0x9E3779B97F4A7C15)))
    if n > 24 * slots * size:  # the smallest of a slot are almost surely below this; if not, all are looked at
        few = np.flatnonzero(value * np.uint64(slots) < np.uint64(int(2.0**64 * 12 * slots * size / n)))
        order = few[np.argsort(value[few])]
        edges = np.searchsorted(value[order], bounds(slots))
        if np.diff(edges).min() < size:
            order = None
    else:
        order = None
    if order is None:
        order = np.argsort(value)
        edges = np.searchsorted(value[order], bounds(slots))
    start, many = edges[:-1], np.diff(edges)
    pick = start[:, None] + np.arange(size)
    held = np.arange(size) < many[:, None]
    at = np.where(held, order[np.minimum(pick, len(order) - 1)], n)
    at.sort(axis=1)  # text order within the slot
    of = np.append(kmers, np.uint64(0))
    total = np.zeros(slots, np.uint64)
    for r in range(size):
        total = np.where(at[:, r] < n, mix64(total * np.uint64(0x9E3779B97F4A7C15) + of[at[:, r]] + np.uint64(1)), total)
    filled = many > 0
    out[filled] = np.maximum((total[filled] >> np.uint64(32)).astype(np.uint32), 1)
    return out


@lru_cache(maxsize=8)
def bounds(slots: int) -> np.ndarray:
    """The first hash of each slot, and the last hash there is."""
    return np.array([-(-(i << 64) // slots) for i in range(slots)] + [2**64 - 1], np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots among those that either text fills; 1 for two empty texts."""
    either = (a | b) != 0
    n = int(either.sum())
    return float(((a == b) & either).sum() / n) if n else 1.0


def text_of(signature_: np.ndarray) -> str:
    return signature_.astype(">u4").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """The last third of the code points (rounded down) replaced by as many of the next text's first, or all of them."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def order_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K, slots: int = SLOTS, size: int = TUPLE) -> DataFrame:
    """``doc_id, fingerprint``: the Order MinHash of every row's text. Null and empty texts have all slots empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_of(signature(t, k, slots, size)) for t in strings_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows ``part, halo, doc_id, text``, dealt by part and sorted so that each row's successor is the row below it.

    Order: doc_id descending, nulls last, ties by a hash of the text, then by text. ``part`` numbers ranges of that
    order; each range ends with a copy (halo) of the first row of the next one that has rows, the last with the very
    first row. The texts move once. Ranges are cut at quantiles of doc_id, as many as the bytes ask for; an id (or null)
    that has more rows or bytes than a range should is a range of its own, cut further by the hash of the text into as
    many parts as its bytes ask for. Ranges and parts together are a few for each range's worth of bytes.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total, size = slim.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = ranges or parts(size, RANGE_BYTES, RANGES)
    cuts = {max(-(1 << 63), min(int(x), (1 << 63) - 1)) for x in slim.where("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)}
    many = slim.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    many = many.where((F.col("n") > max(64, 2 * total // ranges)) | ((F.col("n") > 1) & (F.col("bytes") > 2 * RANGE_BYTES)))
    hot = {r.doc_id: max(1, parts(r.bytes * ranges, max(1, size)).bit_length()) for r in many.collect()}  # fewer than the ranges
    cuts |= {x for i in hot if i is not None for x in (i, i + 1) if x < 1 << 63}
    cuts = sorted(cuts, reverse=True)
    dealt = slim.withColumn("part", F.lit(0))
    if cuts:  # how many cuts are above the id, found by halving
        cut = F.array(*[F.lit(x).cast("long") for x in cuts])
        for step in (1 << i for i in reversed(range(len(cuts).bit_length()))):
            at = F.col("part") + step
            dealt = dealt.withColumn("part", F.when((at <= len(cuts)) & (F.element_at(cut, F.least(at, F.lit(len(cuts)))) > F.col("doc_id")), at).otherwise(F.col("part")))
    of_id = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.col("part")).cast("long")
    dealt = dealt.withColumn("tie", F.xxhash64("text"))
    bits = F.broadcast(docs.sparkSession.createDataFrame([*hot.items()], "hot_id long, bits int"))  # a row a hot id
    dealt = dealt.join(bits, F.col("doc_id").eqNullSafe(F.col("hot_id")), "left")
    within = F.when(F.col("bits").isNotNull(), F.expr("shiftright(tie, 64 - bits) + shiftleft(1L, bits - 1)")).otherwise(F.lit(0))
    dealt = dealt.withColumn("part", of_id * (1 << max(hot.values(), default=0)) + within).drop("hot_id", "bits")
    begins = dealt.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "tie")).alias("x")).select("part", "x.*").collect()  # a row a range
    if not begins:
        return dealt.select("part", F.lit(False).alias("halo"), "doc_id", "text")
    begins.sort()
    to = [(None if r.none else ~r.down, r.tie, before.part) for before, r in zip(begins, begins[1:] + begins[:1], strict=True)]
    halos = F.broadcast(docs.sparkSession.createDataFrame(to, "halo_id long, halo_tie long, halo_part long"))  # a row a range
    copies = dealt.join(halos, F.col("doc_id").eqNullSafe(F.col("halo_id")) & (F.col("tie") == F.col("halo_tie")), "left")
    both = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("halo")), F.struct(F.col("halo_part").alias("part"), F.lit(True).alias("halo")))
    spread = copies.select("doc_id", "tie", "text", F.explode(F.filter(both, lambda x: x["part"].isNotNull())).alias("x")).select("x.part", "x.halo", "doc_id", "tie", "text")
    return spread.repartition("part").sortWithinPartitions("part", "halo", F.desc_nulls_last("doc_id"), "tie", "text").drop("tie")


def compare_with_next(docs: DataFrame, k: int = K, slots: int = SLOTS, size: int = TUPLE) -> DataFrame:
    """Fingerprints of every row's text, of its edited text, and their likeness to each other and to the next row's.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next row is
    the next by descending doc_id (nulls last, ties by a hash of the text, then by text), after the last the first; a
    lone row follows itself.
    Null texts count as empty; two empty texts are alike (1). An empty table gives an empty result. One row and its
    successor are in memory at a time, beside the batch that carries them.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
        edited = edited_text(text, following)
        changed = own if edited == text else signature(edited, k, slots, size)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), sha, text_of(own), text_of(changed), likeness(own, changed), likeness(own, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        before = None  # part, doc_id, text and signature of the row above
        for batch in batches:
            for part, halo, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if before and (before[0] != part):
                    before = None
                if halo and not before:
                    continue  # another copy: the row above has its successor
                own = before[3] if before and before[2] == text else signature(text, k, slots, size)
                if before:
                    rows.append(row(before[1], before[2], before[3], text, own))
                before = None if halo else (part, doc_id, text, own)
                if len(rows) >= HOLD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).select("part", "halo", "doc_id", "text").mapInArrow(run, schema)


def op10_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Contract digest of compare_with_next over all documents."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
