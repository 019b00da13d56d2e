"""Vertices of the bidirected de Bruijn graph: counting, filters, classes, ids, statistics.

Slots ``oA..oT`` count the bases that follow the canonical k-mer, ``iA..iT`` those that follow its reverse complement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import packed as B
from ..functions.dna import BASES, complement, default_p, is_canonical, reverse_complement
from .kmers import check_k, kmer_occurrences, packed_piece_occurrences, packed_pieces, piece_occurrences, superkmer_sequences, superkmers, unpacked_pieces
from .numbering import numbered

OUT, IN = [f"o{b}" for b in BASES], [f"i{b}" for b in BASES]
SLOTS = OUT + IN


def coverage() -> Column:
    return sum((F.col(c) for c in SLOTS[1:]), F.col(SLOTS[0]))


def edge_counts(occurrences: DataFrame, mode: str = "lex", by: tuple[str, ...] = ()) -> DataFrame:
    """A-01, A-02: ``kmer`` (canonical), eight counters and ``cov``, their sum. Partial sums precede the one shuffle.

    ``by`` names columns that follow from the k-mer and are grouped on as well, such as the partition that rows are
    dealt by already.
    """
    kmer = F.col("kmer")
    same = is_canonical(kmer, mode)
    sided = occurrences.select(
        *by,
        F.when(same, kmer).otherwise(reverse_complement(kmer)).alias("kmer"),
        F.when(same, F.col("post")).otherwise(complement(F.col("pre"))).alias("out"),
        F.when(same, complement(F.col("pre"))).otherwise(F.col("post")).alias("in"),
    )
    counts = [F.count(F.when(F.col(side) == b, 1)).alias(f"{side[0]}{b}") for side in ("out", "in") for b in BASES]
    return sided.groupBy(*by, "kmer").agg(*counts).withColumn("cov", coverage())


def count_reads(reads: DataFrame, k: int, mode: str = "lex", packed: bool = False) -> DataFrame:
    """A-01 of reads (``seq``): the same as edge_counts of their occurrences, counted by packed k-mers.

    Both strands of a read are turned to words of 31 bases once; a k-mer and its reverse complement are then cut from
    them by shifts, and the smaller is the canonical one. ``packed`` keeps ``kmer`` a key (functions/packed.py).
    """
    check_k(k)
    if mode != "lex":
        counted = edge_counts(kmer_occurrences(reads.select("seq"), k), mode)
        return B.packed(counted, k) if packed else counted
    length = F.length("seq")
    d = B.digits(F.col("seq"))
    back = F.translate(F.reverse("seq"), "ACGT", "3210")
    held = reads.where(length >= k).select(B.read_words(d, length).alias("there"), B.read_words(back, length).alias("back"), length.alias("length"))
    at = held.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - k)).alias("i"))
    i, there, length = F.col("i"), F.col("there"), F.col("length")
    x, y = B.read_window(there, i, k), B.read_window(F.col("back"), length - i - k, k)
    post = F.when(i + k < length, B.read_window(there, i + k, 1)[0])
    pre = F.when(i > 0, B.read_window(there, F.greatest(i - 1, F.lit(0)), 1)[0])
    counted = count_keys(at.select(B.key_of(x).alias("x"), B.key_of(y).alias("y"), post.alias("post"), pre.alias("pre")), k)
    return counted if packed else B.unpacked(counted, k)


def count_keys(occurrences: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """edge_counts of keys: ``x, y`` (a k-mer and its reverse complement)``, post, pre`` (0 to 3, or null)."""
    same = B.not_above(F.col("x"), F.col("y"), k)
    sided = occurrences.select(*by, F.when(same, F.col("x")).otherwise(F.col("y")).alias("kmer"), F.when(same, F.col("post")).otherwise(3 - F.col("pre")).alias("out"), F.when(same, 3 - F.col("pre")).otherwise(F.col("post")).alias("in"))
    counts = [F.count(F.when(F.col(side) == code, 1)).alias(f"{side[0]}{b}") for side in ("out", "in") for code, b in enumerate(BASES)]
    return sided.groupBy(*by, "kmer").agg(*counts).withColumn("cov", coverage())


def count_superkmers(reads: DataFrame, k: int, p: int | None = None, n_parts: int = 512, mode: str = "lex", packed: bool = False) -> DataFrame:
    """A-01 by way of super-k-mers (P-02, P-03): ``pid`` and the columns of edge_counts.

    What is shuffled is a piece of a read for each run of k-mers of one partition, at two bits a base, not a row for
    each k-mer; all occurrences of a k-mer meet in its partition, and are counted there without another shuffle.
    """
    pieces = superkmer_sequences(superkmers(reads.select("seq"), k, p, n_parts), k)
    return count_pieces(packed_pieces(pieces), k, mode, packed)


def count_pieces(pieces: DataFrame, k: int, mode: str = "lex", packed: bool = False) -> DataFrame:
    """The same from packed pieces (``pid, data``) that are at hand, such as those of files."""
    dealt = pieces.select("pid", "data").repartition("pid")
    if mode != "lex":
        counted = edge_counts(piece_occurrences(unpacked_pieces(dealt), k), mode, ("pid",))
        return B.packed(counted, k) if packed else counted
    counted = count_keys(packed_piece_occurrences(dealt, k), k, ("pid",))
    return counted if packed else B.unpacked(counted, k)


def filter_vertices(vertices: DataFrame, cutoff: int = 1) -> DataFrame:
    """F-02: the sum of the counters reaches the cutoff; k-mers without neighbours always go."""
    return vertices.where(F.col("cov") >= max(1, cutoff))


def degree(slots: list[str], cutoff: int) -> Column:
    return sum((F.when(F.col(c) >= cutoff, 1).otherwise(0) for c in slots[1:]), F.when(F.col(slots[0]) >= cutoff, 1).otherwise(0)).cast("bigint")


def classify(vertices: DataFrame, cutoff: int = 1) -> DataFrame:
    """F-03: adds ``out_deg, in_deg, cls``; vertices without a valid edge are dropped.

    ``linear`` has one valid edge on either side; everything else is a ``junction``, dead ends too.
    """
    both = vertices.withColumn("out_deg", degree(OUT, cutoff)).withColumn("in_deg", degree(IN, cutoff)).where("out_deg > 0 or in_deg > 0")
    return both.withColumn("cls", F.when((F.col("out_deg") == 1) & (F.col("in_deg") == 1), "linear").otherwise("junction"))


def junctions(classified: DataFrame) -> DataFrame:
    """P-05."""
    return classified.where("cls = 'junction'")


def only_base(slots: list[str], cutoff: int) -> Column:
    """The base of the first valid slot of one side."""
    return F.coalesce(*[F.when(F.col(c) >= cutoff, F.lit(c[1])) for c in slots])


def linears(classified: DataFrame, cutoff: int = 1) -> DataFrame:
    """P-05: linear vertices with the one base on either side, ``post_base`` and ``pre_base``."""
    return classified.where("cls = 'linear'").select("kmer", only_base(OUT, cutoff).alias("post_base"), only_base(IN, cutoff).alias("pre_base"))


def with_partition(vertices: DataFrame, k: int, n_parts: int = 512, p: int | None = None) -> DataFrame:
    """S-07: the logical partition of each k-mer, by shifts on its key."""
    p = p or default_p(k)
    key = F.col("kmer") if B.is_packed(vertices) else B.pack(F.col("kmer"), k)
    strands = vertices.withColumn("_x", key).withColumn("_y", B.reverse_complement(F.col("_x"), k))
    smallest = strands.withColumn("_min", B.minimizer(F.col("_x"), F.col("_y"), k, p))
    # never null: a join's test for nulls would carry the whole expression below it, again and again
    pid = F.coalesce(B.partition_id(F.col("_min"), p, n_parts), F.lit(0).cast("bigint"))
    return smallest.withColumn("pid", pid).drop("_x", "_y", "_min")


def vertex_ids(classified: DataFrame, k: int, n_parts: int = 512, p: int | None = None) -> DataFrame:
    """W-01, W-02, O-01: ``vid`` from 0 within the partition, junctions first, then in k-mer order; ``gid`` over all.

    Rows are numbered by ranges of that order, whose sizes follow the data; a partition's first number, a table of at
    most ``n_parts`` rows, is what is broadcast.
    """
    parts = with_partition(classified, k, n_parts, p).select("kmer", "cls", "pid")
    every = numbered(parts, "pid", "cls", "kmer", name="gid")
    first = every.groupBy("pid").agg(F.min("gid").alias("first"))
    return every.join(F.broadcast(first), "pid").select("kmer", "cls", "pid", (F.col("gid") - F.col("first")).alias("vid"), "gid")


def sorted_vertices(vertices: DataFrame, k: int, n_parts: int = 512, p: int | None = None) -> DataFrame:
    """A-03, O-01: vertices dealt by partition and sorted by k-mer within it."""
    return with_partition(vertices, k, n_parts, p).repartition("pid").sortWithinPartitions("pid", "kmer")


def statistics(classified: DataFrame, cutoff: int = 1) -> DataFrame:
    """A-04, A-06: one row of totals."""
    edges = sum((F.when(F.col(c) >= cutoff, F.col(c)).otherwise(0) for c in SLOTS[1:]), F.when(F.col("oA") >= cutoff, F.col("oA")).otherwise(0))
    return classified.agg(
        F.count("*").alias("vertices"),
        F.count(F.when(F.col("cls") == "junction", 1)).alias("junctions"),
        F.count(F.when(F.col("cls") == "linear", 1)).alias("linear"),
        F.coalesce(F.sum(edges), F.lit(0)).cast("bigint").alias("edge_total"),
        F.coalesce(F.sum(F.col("out_deg") + F.col("in_deg")), F.lit(0)).cast("bigint").alias("edge_slots"),
        F.coalesce(F.max(F.greatest(*SLOTS)), F.lit(0)).cast("bigint").alias("largest_counter"),
    )


def partition_statistics(vertices: DataFrame, k: int, n_parts: int = 512, p: int | None = None) -> DataFrame:
    """A-06: rows and coverage of each partition."""
    return with_partition(vertices, k, n_parts, p).groupBy("pid").agg(F.count("*").alias("vertices"), F.sum("cov").alias("cov"))


def degree_histogram(classified: DataFrame) -> DataFrame:
    """A-04: vertices by degrees."""
    return classified.groupBy("out_deg", "in_deg").agg(F.count("*").alias("n"))


def degree_statistics(vertices: DataFrame, cutoff: int = 1) -> DataFrame:
    """Vertices and coverage by their smaller and larger degree: the same for any choice of canonical strand."""
    rows = classify(filter_vertices(vertices, cutoff), cutoff)
    low, high = F.least("out_deg", "in_deg"), F.greatest("out_deg", "in_deg")
    return rows.groupBy(low.alias("low"), high.alias("high")).agg(F.count("*").alias("n"), F.sum("cov").alias("cov"))


def observed(vertices: DataFrame, name: str = "graph") -> tuple[DataFrame, Observation]:
    """A-04: ``vertices`` and what is counted of them while whatever is done with them runs, without a pass of its own.

    Of the observation, ``get`` has ``vertices, edge_total`` (the sum of the counters)``, edge_slots`` (counters above 0)
    and ``largest_counter`` as soon as one action over the rows has ended.
    """
    watch = Observation(name)
    slots = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in SLOTS[1:]), F.when(F.col(SLOTS[0]) > 0, 1).otherwise(0))
    metrics = (F.count(F.lit(1)).alias("vertices"), F.coalesce(F.sum(coverage()), F.lit(0)).alias("edge_total"), F.coalesce(F.sum(slots), F.lit(0)).alias("edge_slots"), F.coalesce(F.max(F.greatest(*SLOTS)), F.lit(0)).alias("largest_counter"))
    return vertices.observe(watch, *metrics), watch
