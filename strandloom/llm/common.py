"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where checkpoints go on a single machine when neither the session nor its context names a folder (tests).
FALLBACK_CHECKPOINTS = "/tmp/checkpoints/strandloom"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's; on a cluster it has to be named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or FALLBACK_CHECKPOINTS)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage; survives the loss of executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with a number of its own for each row; the same at every reading of what lies in files."""
    return df.withColumn(name, F.monotonically_increasing_id())


def parts(n_items: int, per_part: int, least: int = 1) -> int:
    """How many buckets hold ``n_items`` at about ``per_part`` each."""
    return max(least, -(-n_items // per_part))


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def strings_of(column: pa.Array) -> list[str]:
    """The strings of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def by_size(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``limit`` characters or bytes; a longer text is a run of its own."""
    lo = size = 0
    for hi, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, hi
            lo, size = hi, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
