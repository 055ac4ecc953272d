"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session may go without and gets a folder of its own; a cluster may not."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df, computed once into a table of its own, in the shared folder unless it is named: for large frames, as columns are packed and read alone."""
    folder = folder or f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps: it does so once the driver's JVM has collected what held them, which on a cluster may take until long after a job of many steps."""
    spark._jvm.System.gc()


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of a job's own steps, once nothing reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a counted side up to which it is broadcast.
MOST_BROADCAST = 50_000


def few(df: DataFrame, most: int = MOST_BROADCAST) -> bool:
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, to be broadcast if it was counted to have at most `most` rows, and else to meet by sorting."""
    return F.broadcast(df) if few(df, most) else df.hint("merge")


#: Rows of a few columns that a task takes.
ROWS_OF_A_TASK = 300_000


def dealt(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """df by the hash of cols, in a partition for each ROWS_OF_A_TASK of about `rows` rows.

    Shuffle blocks that Spark puts together by their packed size unfold to a gigabyte in the task that joins or
    groups them; these stay as small as they are, whatever the table.
    """
    return df.repartition(max(1, -(-rows // ROWS_OF_A_TASK)), *cols)
