"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, parts

#: Edges that one task is meant to hold.
TASK_EDGES = 200_000


def _shape(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of an edge; label is the smallest node that can be reached.

    Edges may repeat, point either way or be loops; a loop gives its node no row of its own unless another edge has
    it. Rows with a null end are ignored. Each round is written to the checkpoint folder, and the loop ends when a
    round changes nothing, after about the logarithm of the number of nodes. Minima are combined before the shuffle,
    and a hub's edges are an ordinary skewed join. Edges are dealt to as many tasks as they are many: the few that one
    task holds are not shuffled.
    """
    now = checkpointed(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    shape = _shape(now)
    while shape[0]:
        tasks = parts(shape[0], TASK_EDGES)
        now = now.coalesce(tasks)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(2 * tasks if tasks > 1 else 1)
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(lowest.select("u", F.col("m").alias("v")))
        now = checkpointed((small.coalesce(1) if tasks == 1 else small).distinct())
        before, shape = shape, _shape(now)
        if shape == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
