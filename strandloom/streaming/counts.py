"""Vertex counts of a stream of lines: the batch operators on an unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kmers import kmer_occurrences
from ..operators.vertices import edge_counts
from ..sources.reads import filter_reads


def stream_edge_counts(lines: DataFrame, k: int, read_length: int | None = None, mode: str = "lex") -> DataFrame:
    """A-01 over a streaming DataFrame of text lines (``value``); write it in update or complete mode.

    State is one row of counters for each k-mer seen; it has no watermark, as any later read may add to any k-mer.
    """
    reads = filter_reads(lines.select(F.col("value").alias("seq")), read_length)
    return edge_counts(kmer_occurrences(reads, k), mode)
