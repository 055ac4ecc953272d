"""Ranks over whole tables, without one task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def global_ranks(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows with the rank, from 1, of each by the columns or orders given, which no two rows may share.

    Rows are dealt to ranges of the order and sorted within them, and put down, so that a task run again meets the
    same rows. A row's rank is its place in its range after the counts of the ranges before; a count per partition
    is all that the driver sees. Nulls stand where the order puts them. An empty table stays empty.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = dealt.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = sorted(tuple(r) for r in placed.groupBy("_range").count().collect())
    before = [0, *accumulate(n for _, n in counts)]
    starts = rows.sparkSession.createDataFrame([(p, before[i]) for i, (p, _) in enumerate(counts)], "_range int, _before long")
    ranked = placed.join(F.broadcast(starts), "_range")  # a row per partition
    return ranked.withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")
