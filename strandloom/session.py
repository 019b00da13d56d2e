"""Session settings and checkpoints of the assembler."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Where checkpoints go on a single machine when neither the session nor its context names a folder.
FALLBACK_CHECKPOINTS = "/tmp/checkpoints/strandloom"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A session for one machine. Joins are broadcast only by measured sizes: tables of checkpoints have no statistics."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("strandloom").config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints; on a cluster it has to be named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or FALLBACK_CHECKPOINTS)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and cut the lineage; survives the loss of executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
