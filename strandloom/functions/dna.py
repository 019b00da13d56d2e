"""Scalar functions on DNA strings, as Catalyst expressions only.

A k-mer is a string over ACGT; string order is base order. All functions take and return columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: Seed of the k-mer hash, and the integer whose hash at Spark's own seed (42) is that seed.
MURMUR_SEED, SEED_PREIMAGE = 3735928559, 654641884


def clean(seq: Column) -> Column:
    """Upper case, N as A (S-02)."""
    return F.translate(F.upper(seq), "N", "A")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    """S-01."""
    return F.reverse(complement(seq))


def kmer_at(seq: Column, i: Column, k: int) -> Column:
    """The k-mer that starts at position i, counted from 1 (S-03)."""
    return seq.substr(i, F.lit(k))


def shift_append(kmer: Column, base: Column) -> Column:
    """The next k-mer: first base dropped, one appended (S-04)."""
    return F.concat(kmer.substr(F.lit(2), F.length(kmer) - 1), base)


def reverse_edge_base(kmer: Column) -> Column:
    """The base by which the neighbour's other strand comes back: complement of the first (S-10)."""
    return complement(kmer.substr(F.lit(1), F.lit(1)))


def pack(kmer: Column) -> Column:
    """Two bits a base in a bigint, for k up to 31 (S-02)."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def unpack(packed: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(packed.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def packed_words(kmer: Column) -> Column:
    """Four left-aligned 32-bit words of two bits a base, each little-endian: the bytes that are hashed (k up to 64)."""
    digits = F.rpad(F.translate(kmer, "ACGT", "0123"), 64, "0")
    word = []
    for w in range(4):
        h = F.lpad(F.conv(F.substring(digits, 16 * w + 1, 16), 4, 16), 8, "0")
        word += [F.substring(h, at, 2) for at in (7, 5, 3, 1)]
    return F.unhex(F.concat(*word))


def murmur3(kmer: Column) -> Column:
    """Unsigned 32-bit murmur3 of the packed k-mer (S-08): Spark's hash chains columns by taking one's as next seed."""
    return F.hash(F.lit(SEED_PREIMAGE), packed_words(kmer)).bitwiseAND(F.lit(0xFFFFFFFF))


def is_canonical(kmer: Column, mode: str = "lex") -> Column:
    """Whether a k-mer stands for itself and its reverse complement: the smaller, or the one of smaller hash (S-09)."""
    other = reverse_complement(kmer)
    if mode == "lex":
        return kmer <= other
    if mode == "murmur3":
        a, b = murmur3(kmer), murmur3(other)
        return (a < b) | ((a == b) & (kmer <= other))
    raise ValueError(f"canonical form must be 'lex' or 'murmur3', not {mode!r}")


def canonical(kmer: Column, mode: str = "lex") -> Column:
    if mode == "lex":
        return F.least(kmer, reverse_complement(kmer))
    return F.when(is_canonical(kmer, mode), kmer).otherwise(reverse_complement(kmer))


def pmers(seq: Column, p: int) -> Column:
    """All p-mers of a sequence in order (S-05)."""
    return F.transform(F.sequence(F.lit(1), F.length(seq) - p + 1), lambda i: seq.substr(i, F.lit(p)))


def canonical_pmers(seq: Column, p: int) -> Column:
    """For each place, the smaller of the p-mer and its reverse complement."""
    return F.transform(pmers(seq, p), lambda x: F.least(x, reverse_complement(x)))


def minimizer(kmer: Column, p: int) -> Column:
    """The smallest p-mer on both strands (S-07)."""
    return F.array_min(canonical_pmers(kmer, p))


def minimizer_of(kmer: Column, other: Column, k: int, p: int) -> Column:
    """The same from a k-mer and its reverse complement in columns of their own: generated code, without lambdas."""
    places = [x.substr(i, p) for x in (kmer, other) for i in range(1, k - p + 2)]
    return F.least(*places)


def partition_id(pmer: Column, p: int, n: int) -> Column:
    """Partition of a p-mer: its bases from last to first as digits, in base 3, modulo n (S-06)."""
    total = F.lit(0).cast("bigint")
    for i in range(p, 0, -1):
        total = total * 3 + (F.instr(F.lit(BASES), pmer.substr(F.lit(i), F.lit(1))) - 1)
    return total % n


def default_p(k: int) -> int:
    return 11 if k <= 27 else 19
