"""Streaming sources and jobs that run until what is there has been read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_folder


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder: as a pattern, either will do."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drain(df: DataFrame) -> DataFrame:
    """Runs an append stream to its present end into Parquet in the shared folder and returns what it wrote."""
    spark, at = df.sparkSession, place(df.sparkSession)
    q = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def drain_batches(df: DataFrame, work: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Runs work on each micro-batch; its rows are written under the batch's number, so a repeated batch replaces itself.

    With mode complete or update the last batch's rows are the result.
    """
    spark, at = df.sparkSession, place(df.sparkSession)

    def each(rows: DataFrame, number: int) -> None:
        target = f"{at}/out/batch={number if mode == 'append' else 0}"
        work(rows).write.mode("overwrite").parquet(target)

    q = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


def once(events: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Each (keys) once within the time that a repeat may be late; works on streams and static tables."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def turn_output(turns: DataFrame) -> DataFrame:
    """Live turns worth sending: 0.2 s or more, with text or a speaker; mood is calm unless known; embeds tells if long enough."""
    length = F.col("end_s") - F.col("start_s")
    kept = turns.where((length >= 0.2) & ((F.trim(F.coalesce("text", F.lit(""))) != "") | F.col("speaker").isNotNull()))
    return kept.withColumns({"mood": F.coalesce("mood", F.lit("calm")), "embeds": length >= 1.0})


#: Seconds of a pooled voice beyond which more says nothing new.
ENOUGH_S = 8.0


def pooled_voices(turns: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """session, row_id, at, vec, dur (a stream or a static table) -> session, row_id, voice, pooled_s, pooled.

    Each turn joins the nearest voice that its session has heard, or is a new one; pooled and pooled_s are the
    voice's centroid and seconds with this turn. A session's voices are forgotten after idle_ms without turns.
    """
    from .folds import batch, pool_speech, stream

    start = ([], [], [])
    state = "flat array<double>, turns array<long>, seconds array<double>"
    made = stream(turns, pool_speech, start, "array<double>", state, idle_ms=idle_ms) if turns.isStreaming else batch(turns, pool_speech, start, "array<double>")
    return made.select("session", "row_id", F.get("value", F.lit(0)).cast("long").alias("voice"), F.get("value", F.lit(1)).alias("pooled_s"), F.slice("value", 3, F.size("value") - 2).alias("pooled"))
