"""Sources of reads: ``rid?, seq`` or any key columns beside ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import clean

#: Characters outside ACGTacgt that a read may have.
MOST_AMBIGUOUS = 5
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_BASES = "ACGTACGTACGTACGTACGTACGTAC"


def passes(seq: Column, read_length: int | None) -> Column:
    """F-01: exactly the read length (any, if None) and few enough ambiguous characters."""
    few = F.length(F.regexp_replace(seq, "[ACGTacgt]", "")) <= MOST_AMBIGUOUS
    return few & (F.length(seq) == read_length) if read_length else few & (F.length(seq) > 0)


def filter_reads(reads: DataFrame, read_length: int | None = None, ambiguous: str = "drop") -> DataFrame:
    """Reads that pass F-01, in upper case with N as A. Other letters drop the read, or count as A (``'as_a'``)."""
    kept = reads.where(passes(F.col("seq"), read_length)).withColumn("seq", clean(F.col("seq")))
    if ambiguous == "as_a":
        return kept.withColumn("seq", F.regexp_replace("seq", "[^ACGT]", "A"))
    if ambiguous != "drop":
        raise ValueError("ambiguous must be 'drop' or 'as_a'")
    return kept.where(~F.col("seq").rlike("[^ACGT]"))


def read_lines(spark: SparkSession, path: str, read_length: int | None = None, ambiguous: str = "drop") -> DataFrame:
    """SRC-01: every line is a candidate; headers and qualities fail F-01 by their letters or length."""
    return filter_reads(spark.read.text(path).select(F.col("value").alias("seq")), read_length, ambiguous)


def _records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """SRC-03: ``lines`` of each record, split at the mark at a line's start; records may span splits of a file.

    Lines may end with a carriage return. A file's first record has its mark before it, the others' was the separator.
    """
    rows = spark.read.option("lineSep", f"\n{mark}").text(path)
    record = F.regexp_replace(F.regexp_replace(F.col("value"), f"^{mark}", ""), r"[\r\n]+$", "")
    return rows.select(record.alias("record")).where("record <> ''").select(F.split("record", "\r*\n").alias("lines"))


def read_fasta(spark: SparkSession, path: str, read_length: int | None = None, ambiguous: str = "drop") -> DataFrame:
    """SRC-02: ``name, seq``; a record's sequence lines are joined."""
    lines = F.col("lines")
    rows = _records(spark, path, ">").select(F.element_at(lines, 1).alias("name"), F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 1), "").alias("seq"))
    return filter_reads(rows, read_length, ambiguous)


def read_fastq(spark: SparkSession, path: str, read_length: int | None = None, ambiguous: str = "drop") -> DataFrame:
    """SRC-02: ``name, seq`` of records of four lines or of several lines of sequence and of quality.

    A quality line may begin with ``@``, and what follows is then a piece of its own. It is told from a record by what
    a record has: a line or more of letters alone, then one that begins with ``+``, then no more characters of quality
    than of sequence. (Of records of four lines such a piece is a single line. Of longer ones a quality would have to
    hold a line that begins with ``@``, one of letters alone and one that begins with ``+``, in that order.)
    """
    rows = _records(spark, path, "@")
    places = F.transform("lines", lambda line, i: F.when((i > 1) & line.startswith("+"), i))
    rows = rows.withColumn("plus", F.array_min(places)).where("plus is not null")
    bases = F.slice("lines", F.lit(2), F.col("plus") - 1)
    quality = F.slice("lines", F.col("plus") + 2, F.size("lines"))
    rows = rows.select(F.element_at("lines", 1).alias("name"), bases.alias("bases"), F.array_join(bases, "").alias("seq"), F.array_join(quality, "").alias("quality"))
    whole = F.forall("bases", lambda line: line.rlike("^[A-Za-z.*-]*$")) & (F.length("quality") <= F.length("seq"))
    return filter_reads(rows.where(whole).select("name", "seq"), read_length, ambiguous)


def spread(df: DataFrame, least: int = 1) -> DataFrame:
    """``df`` in as many partitions as there are cores, or so many times that, at least: a file of one row group would be one task's work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < least * cores else df


def reads_from_text(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", read_length: int = 64, stride: int = 32, anchored: bool = False) -> DataFrame:
    """Reads derived from prose: letters become bases, and every ``stride`` bases a read begins (``pos`` from 1).

    ``anchored`` adds a read that ends with the text, shorter texts being reads of their own, so that no letter is left out.
    """
    dna = F.translate(F.regexp_replace(F.lower(F.col(text)), "[^a-z]", ""), LETTERS, LETTER_BASES)
    rows = spread(df.select(*keys, text)).select(*keys, dna.alias("dna"))
    last = F.length("dna") - read_length + 1
    if anchored:
        rows = rows.where(F.length("dna") > 0)
        at = F.when(last < 1, F.array(F.lit(1))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(stride)), F.array(F.greatest(last, F.lit(1))))))
    else:
        rows = rows.where(F.length("dna") >= read_length)
        at = F.sequence(F.lit(1), last, F.lit(stride))
    rows = rows.select(*keys, "dna", F.explode(at).alias("pos"))
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.col("dna").substr(F.col("pos"), F.lit(read_length)).alias("seq"))
