"""From reads to k-mers and super-k-mers; all of it is narrow, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed as B
from ..functions.dna import default_p, reverse_complement


def check_k(k: int, read_length: int | None = None) -> None:
    if k < 2 or (read_length is not None and k > read_length):
        raise ValueError(f"k must be between 2 and the read length, not {k}")


def kmer_occurrences(reads: DataFrame, k: int) -> DataFrame:
    """P-01: every k-mer of every read with its right (``post``) and left (``pre``) base, null at the read's ends."""
    check_k(k)
    keys = [c for c in reads.columns if c != "seq"]
    n = F.length("seq") - k + 1
    at = reads.where(n > 0).select(*keys, "seq", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    seq, i = F.col("seq"), F.col("i")
    return at.select(
        *keys,
        i.cast("bigint").alias("i"),
        seq.substr(i, F.lit(k)).alias("kmer"),
        F.when(i <= F.length("seq") - k, seq.substr(i + k, F.lit(1))).alias("post"),
        F.when(i > 1, seq.substr(i - 1, F.lit(1))).alias("pre"),
    )


#: Bases that a task's kernel works on at once; a longer read is a batch of its own.
KERNEL_BASES = 1 << 20
CODES = np.zeros(256, np.int64)
CODES[[ord(b) for b in B.BASES]] = range(4)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row (of fewer at the end), by minima over spans that double."""
    least, span = values, 1
    while span < width:
        step = min(span, width - span)
        further = least.copy()
        np.minimum(least[: len(least) - step], least[step:], out=further[: max(0, len(least) - step)])
        least, span = further, span + step
    return least


def runs_of(data: np.ndarray, ends: np.ndarray, k: int, p: int, n_parts: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of k-mers of one partition in reads that lie one after the other: ``read, start`` (from 0)``, n_kmers, pid``.

    Numbers of p-mers of both strands are built base by base for all places at once; a read's last p - 1 places have
    numbers that reach into the next one, which no k-mer of the read looks at.
    """
    codes = CODES[data]
    n = len(codes) - p + 1
    there, back = np.zeros(max(n, 0), np.int64), np.zeros(max(n, 0), np.int64)
    for j in range(p):
        there = there << 2 | codes[j : j + n]
        back |= 3 - codes[j : j + n] << 2 * j
    least = sliding_minimum(np.minimum(there, back), k - p + 1)
    begins = np.concatenate([[0], ends[:-1]])
    kmers = np.maximum(ends - begins - k + 1, 0)  # of each read
    read = np.repeat(np.arange(len(ends)), kmers)
    first = np.cumsum(kmers) - kmers
    start = np.arange(len(read)) - first[read]
    smallest = least[begins[read] + start]
    # partitions of the places where the minimizer changes; those between have the same
    new = np.ones(len(read), bool)
    new[1:] = (smallest[1:] != smallest[:-1]) | (start[1:] == 0)
    at = np.flatnonzero(new)
    pid = np.zeros(len(at), np.int64)
    for j in range(p):  # the first base is the lowest digit in base 3
        pid = (pid * 3 + (smallest[at] >> 2 * j & 3)) % n_parts
    parts = np.ones(len(at), bool)
    parts[1:] = (pid[1:] != pid[:-1]) | (start[at[1:]] == 0)
    at, pid = at[parts], pid[parts]
    return read[at], start[at], np.diff(np.append(at, len(read))), pid


def superkmers(reads: DataFrame, k: int, p: int | None = None, n_parts: int = 512) -> DataFrame:
    """P-02, W-03: maximal runs of k-mers of one read with the same partition: ``start`` (from 1), ``n_kmers, pid``.

    Partitions come from the smallest p-mer on both strands. A run begins where a place's partition differs from the
    one before it. Runs of a batch of reads are found together, on the bytes of their Arrow buffer.
    """
    check_k(k)
    p = p or default_p(k)
    if not 0 < p <= min(k, B.WORD):
        raise ValueError(f"p must be between 1 and {min(k, B.WORD)}, not {p}")
    keys = [c for c in reads.columns if c != "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq = batch.column(len(keys)).cast(pa.large_binary())
            bounds = np.frombuffer(seq.buffers()[1], np.int64, len(seq) + 1, 8 * seq.offset)
            data, lo = np.frombuffer(seq.buffers()[2] or b"", np.uint8), 0
            while lo < len(seq):
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + KERNEL_BASES, "right")) - 1)
                read, start, n_kmers, pid = runs_of(data[bounds[lo] : bounds[hi]], bounds[lo + 1 : hi + 1] - bounds[lo], k, p, n_parts)
                some = batch.slice(lo, hi - lo).take(pa.array(read))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(start + 1), pa.array(n_kmers), pa.array(pid)], [*some.schema.names, "start", "n_kmers", "pid"])
                lo = hi

    held = reads.where(F.length("seq") >= k).select(*keys, "seq")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    return held.mapInArrow(run, f"{schema}, start long, n_kmers long, pid long")


def superkmer_sequences(runs: DataFrame, k: int) -> DataFrame:
    """P-03: the runs with their bases, one more on each side where the read goes on (``has_left, has_right``).

    The last of several runs of a read is stored reverse-complemented, so that its only neighbour is on the right.
    """
    keys = [c for c in runs.columns if c not in ("seq", "start", "n_kmers", "pid")]
    left = (F.col("start") > 1).cast("int")
    right = (F.col("start") + F.col("n_kmers") + k - 1 <= F.length("seq")).cast("int")
    piece = F.col("seq").substr((F.col("start") - left).cast("int"), (F.col("n_kmers") + k - 1 + left + right).cast("int"))
    turned = (left == 1) & (right == 0)
    return runs.select(
        *keys, "start", "n_kmers", "pid",
        F.when(turned, False).otherwise(left == 1).alias("has_left"),
        F.when(turned, True).otherwise(right == 1).alias("has_right"),
        turned.alias("reversed"),
        F.when(turned, reverse_complement(piece)).otherwise(piece).alias("piece"),
    )


def piece_occurrences(pieces: DataFrame, k: int) -> DataFrame:
    """The k-mers of stored pieces with their neighbours: what kmer_occurrences finds in the reads, but for strands.

    The base on either side of a piece is a neighbour, not part of a k-mer. Pieces that were turned are turned back, so
    that k-mers which are their own reverse complement get their neighbours on the sides that they have in the reads.
    ``pid`` and no other column is kept.
    """
    turned = F.col("reversed")
    left = F.when(turned, F.col("has_right")).otherwise(F.col("has_left")).cast("int")
    right = F.when(turned, F.col("has_left")).otherwise(F.col("has_right")).cast("int")
    piece = F.when(turned, reverse_complement(F.col("piece"))).otherwise(F.col("piece"))
    held = pieces.select("pid", piece.alias("piece"), left.alias("left"), (F.length("piece") - k + 1 - left - right).alias("n")).where("n > 0")
    at = held.select("pid", "piece", "left", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    i, piece = F.col("i") + F.col("left"), F.col("piece")
    return at.select("pid", piece.substr(i, F.lit(k)).alias("kmer"), F.when(i <= F.length(piece) - k, piece.substr(i + k, F.lit(1))).alias("post"), F.when(i > 1, piece.substr(i - 1, F.lit(1))).alias("pre"))


#: Flags in the first byte of a packed piece; its low five bits say how many bases the last word has.
HAS_LEFT, HAS_RIGHT, TURNED = 128, 64, 32


def packed_pieces(pieces: DataFrame) -> DataFrame:
    """SNK-02: ``pid, data``: a piece (not empty) as bytes, one of flags, then two bits a base in words of 31 bases.

    Words take eight bytes, the last one as many as its bases ask for.
    """
    n, d = F.length("piece"), B.digits(F.col("piece"))
    flags = sum((F.when(F.col(c), bit).otherwise(0) for c, bit in (("has_right", HAS_RIGHT), ("reversed", TURNED))), F.when(F.col("has_left"), HAS_LEFT).otherwise(0))
    head = F.lpad(F.hex(flags + (n - 1) % B.WORD + 1), 2, "0")
    word = lambda i: F.lpad(F.conv(d.substr(i, F.lit(B.WORD)), 4, 16), (2 * F.ceil(F.least(n - i + 1, F.lit(B.WORD)) / 4)).cast("int"), F.lit("0"))
    return pieces.where(n > 0).select("pid", F.unhex(F.concat(head, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(B.WORD)), word), ""))).alias("data"))


def _opened(packed: DataFrame) -> DataFrame:
    """``pid, flags, words, length`` of packed pieces: words as of a read, with zeros behind the last base."""
    head = F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int")
    rows = packed.select("pid", "data", head.alias("flags"), F.ceil((F.octet_length("data") - 1) / 8).cast("int").alias("n"))
    last = F.col("flags").bitwiseAND(F.lit(31))
    number = lambda i: F.conv(F.hex(F.substring(F.col("data"), i * 8 + 2, F.lit(8))), 16, 10).cast("bigint")
    filled = lambda i: F.when(i == F.col("n"), F.lit(0).cast("bigint")).when(i < F.col("n") - 1, number(i)).otherwise(F.call_function("shiftleft", number(i), (F.lit(B.WORD) - last) * 2))
    words = F.transform(F.sequence(F.lit(0), F.col("n")), filled)
    return rows.select("pid", "flags", words.alias("words"), ((F.col("n") - 1) * B.WORD + last).alias("length"))


def unpacked_pieces(packed: DataFrame) -> DataFrame:
    """The pieces again: ``pid, has_left, has_right, reversed, piece``."""
    text = F.array_join(F.transform("words", lambda w: B.unpack(w, B.WORD)), "")
    flag = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) != 0
    return _opened(packed).select("pid", flag(HAS_LEFT).alias("has_left"), flag(HAS_RIGHT).alias("has_right"), flag(TURNED).alias("reversed"), F.substring(text, F.lit(1), F.col("length")).alias("piece"))


def packed_piece_occurrences(packed: DataFrame, k: int) -> DataFrame:
    """What piece_occurrences finds, by shifts on the packed bytes: ``pid, x, y`` (keys of the k-mer and its reverse complement)``, post, pre`` (0 to 3)."""
    flag = lambda bit: (F.col("flags").bitwiseAND(F.lit(bit)) != 0).cast("int")
    held = _opened(packed).select("pid", "words", "length", flag(HAS_LEFT).alias("left"), flag(HAS_RIGHT).alias("right"), flag(TURNED).alias("turned"))
    held = held.withColumn("n", F.col("length") - k + 1 - F.col("left") - F.col("right")).where("n > 0")
    at = held.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1)).alias("i")).withColumn("i", F.col("i") + F.col("left"))
    i, words = F.col("i"), F.col("words")
    post = F.when(i + k < F.col("length"), B.read_window(words, i + k, 1)[0])
    pre = F.when(i > 0, B.read_window(words, F.greatest(i - 1, F.lit(0)), 1)[0])
    at = at.select("pid", "turned", B.key_of(B.read_window(words, i, k)).alias("a"), post.alias("after"), pre.alias("before")).withColumn("b", B.reverse_complement(F.col("a"), k))
    # in the read's own direction, so that k-mers which are their own reverse complement keep their sides
    own = F.col("turned") == 0
    return at.select("pid", F.when(own, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(own, F.col("b")).otherwise(F.col("a")).alias("y"), F.when(own, F.col("after")).otherwise(3 - F.col("before")).alias("post"), F.when(own, F.col("before")).otherwise(3 - F.col("after")).alias("pre"))
