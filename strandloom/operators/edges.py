"""Edges between vertices: unpivoting, neighbours, reciprocity, lookups.

``strand`` 0 is the canonical k-mer, 1 its reverse complement; ``base`` is what follows it on that strand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packed as B
from ..functions.dna import BASES, is_canonical, reverse_complement, reverse_edge_base, shift_append
from .vertices import SLOTS, coverage


def branches(vertices: DataFrame, cutoff: int = 1) -> DataFrame:
    """P-06, F-05: one row for each valid slot: ``kmer, strand, base, cnt``."""
    slot = F.array(*[F.struct(F.lit(0 if c[0] == "o" else 1).cast("bigint").alias("strand"), F.lit(c[1]).alias("base"), F.col(c).alias("cnt")) for c in SLOTS])
    valid = F.filter(slot, lambda s: s["cnt"] >= cutoff)
    return vertices.select("kmer", F.explode(valid).alias("s")).select("kmer", "s.strand", "s.base", "s.cnt")


def oriented(kmer: str = "kmer", strand: str = "strand") -> F.Column:
    return F.when(F.col(strand) == 0, F.col(kmer)).otherwise(reverse_complement(F.col(kmer)))


def oriented_edges(vertices: DataFrame, k: int, cutoff: int = 1) -> DataFrame:
    """J-05 on keys: ``kmer, strand, code, cnt, z`` (the k-mer on its strand)``, node`` (what follows it)``, nb, nb_strand`` (that
    one's vertex)``, back`` (the base by which the other strand of ``node`` comes back); bases are 0 to 3.

    A vertex is turned once; its neighbours and their reverse complements are shifts of that.
    """
    slot = F.array(*[F.struct(F.lit(int(c[0] == "i")).cast("bigint").alias("strand"), F.lit(BASES.index(c[1])).alias("code"), F.col(c).alias("cnt")) for c in SLOTS])
    rows = vertices.select("kmer", B.reverse_complement(F.col("kmer"), k).alias("_rc"), F.filter(slot, lambda s: s["cnt"] >= cutoff).alias("s"))
    rows = rows.select("kmer", "_rc", F.explode("s").alias("s")).select("kmer", "_rc", "s.*")
    there = F.col("strand") == 0
    rows = rows.select("kmer", "strand", "code", "cnt", F.when(there, F.col("kmer")).otherwise(F.col("_rc")).alias("z"), F.when(there, F.col("_rc")).otherwise(F.col("kmer")).alias("_y"))
    rows = rows.select("kmer", "strand", "code", "cnt", "z", (3 - B.first_code(F.col("z"), k)).alias("back"), B.shift_append(F.col("z"), F.col("code"), k).alias("node"), B.prepend(F.col("_y"), 3 - F.col("code"), k).alias("_y"))
    rows = rows.withColumn("_same", B.not_above(F.col("node"), F.col("_y"), k))
    nb = F.when(F.col("_same"), F.col("node")).otherwise(F.col("_y"))
    return rows.select("kmer", "strand", "code", "cnt", "z", "node", nb.alias("nb"), F.when(F.col("_same"), 0).otherwise(1).cast("bigint").alias("nb_strand"), "back")


def packed_edges(vertices: DataFrame, k: int, cutoff: int = 1) -> DataFrame:
    """J-05 on keys: ``kmer, strand, base, nb, nb_strand, cnt, back``."""
    return oriented_edges(vertices, k, cutoff).select("kmer", "strand", B.base(F.col("code")).alias("base"), "nb", "nb_strand", "cnt", B.base(F.col("back")).alias("back"))


def edges(vertices: DataFrame, cutoff: int = 1, mode: str = "lex", k: int | None = None) -> DataFrame:
    """J-05: branches with their neighbour ``nb``, on strand ``nb_strand``. With ``k``, by way of keys; ``nb`` is of the kind of ``kmer``."""
    if k and mode == "lex":
        found = packed_edges(B.packed(vertices, k), k, cutoff).drop("back")
        return found if B.is_packed(vertices) else B.unpacked(found, k, "kmer", "nb")
    rows = branches(vertices, cutoff).withColumn("_x", oriented())
    rows = rows.withColumn("_y", shift_append(F.col("_x"), F.col("base"))).withColumn("_same", is_canonical(F.col("_y"), mode))
    nb = F.when(F.col("_same"), F.col("_y")).otherwise(reverse_complement(F.col("_y")))
    return rows.select("kmer", "strand", "base", nb.alias("nb"), F.when(F.col("_same"), 0).otherwise(1).cast("bigint").alias("nb_strand"), "cnt")


def reciprocal_edges(vertices: DataFrame, cutoff: int = 1, mode: str = "lex", k: int | None = None) -> DataFrame:
    """J-01: edges whose neighbour exists and has the edge back, as a left-semi join on the partner's slot."""
    if k and mode == "lex":
        all_edges = packed_edges(B.packed(vertices, k), k, cutoff)
        want = all_edges.withColumn("want_strand", 1 - F.col("nb_strand")).withColumnRenamed("back", "want_base")
    else:
        all_edges = edges(vertices, cutoff, mode)
        want = all_edges.withColumn("want_strand", 1 - F.col("nb_strand")).withColumn("want_base", reverse_edge_base(oriented()))
    there = all_edges.select(F.col("kmer").alias("t_kmer"), F.col("strand").alias("t_strand"), F.col("base").alias("t_base"))
    same = (F.col("nb") == F.col("t_kmer")) & (F.col("want_strand") == F.col("t_strand")) & (F.col("want_base") == F.col("t_base"))
    found = want.join(there, same, "left_semi").select("kmer", "strand", "base", "nb", "nb_strand", "cnt")
    return B.unpacked(found, k, "kmer", "nb") if k and mode == "lex" and not B.is_packed(vertices) else found


def prune_unreciprocated(vertices: DataFrame, cutoff: int = 1, mode: str = "lex", k: int | None = None) -> DataFrame:
    """The effect of J-01 on vertices: counters of edges without a partner become 0 (none do, if k is odd)."""
    kept = reciprocal_edges(vertices, cutoff, mode, k)
    slot = [F.coalesce(F.sum(F.when((F.col("strand") == (0 if c[0] == "o" else 1)) & (F.col("base") == c[1]), F.col("cnt"))), F.lit(0)).cast("bigint").alias(c) for c in SLOTS]
    return kept.groupBy("kmer").agg(*slot).withColumn("cov", coverage())


def lookup(kmers: DataFrame, vertices: DataFrame) -> DataFrame:
    """J-02: the vertices of a table of canonical k-mers, null columns where there is none."""
    return kmers.join(vertices, "kmer", "left")


def neighbour_ids(edge_table: DataFrame, ids: DataFrame) -> DataFrame:
    """J-03: both ends' dense ids of each edge."""
    own = ids.select("kmer", F.col("gid").alias("id"))
    other = ids.select(F.col("kmer").alias("nb"), F.col("gid").alias("nb_id"))
    return edge_table.join(own, "kmer").join(other, "nb").select("kmer", "strand", "base", "id", "nb_id", "nb_strand", "cnt")


def neighbour_array(edge_ids: DataFrame) -> DataFrame:
    """J-03: ``id, nbs``, the neighbours' ids by slot (out A, C, G, T, in A, C, G, T), null where there is none."""
    at = F.col("strand") * 4 + F.instr(F.lit(BASES), F.col("base")) - 1
    slot = [F.max(F.when(F.col("at") == i, F.col("nb_id"))) for i in range(8)]
    return edge_ids.withColumn("at", at).groupBy("id").agg(F.array(*slot).alias("nbs"))
