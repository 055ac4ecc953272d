"""Vector arithmetic on array columns, without Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalized(a: Column) -> Column:
    """The vector over its norm; the norm is computed once per row. Zero vectors give null."""
    both = F.transform(F.array(F.struct(a.alias("v"), norm(a).alias("n"))), lambda p: F.when(p["n"] > 0, F.transform(p["v"], lambda x: x / p["n"])))
    return F.get(both, F.lit(0))


def scaled_sum(a: Column, b: Column, factor: Column) -> Column:
    """a + factor * b."""
    return F.zip_with(a, b, lambda x, y: x + factor * y)


def weighted_centroid(rows: DataFrame, key: str, vec: str = "vec", weight: str = "reliability") -> DataFrame:
    """(key, centroid): the normalised weighted sum of each key's vectors, summed by dimension before it is shuffled."""
    parts = rows.select(key, F.col(weight).alias("_w"), F.posexplode(vec).alias("_i", "_x"))
    sums = parts.groupBy(key, "_i").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"))
    whole = sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_s"))), lambda p: p["_s"]).alias("_v"))
    return whole.select(key, normalized(F.col("_v")).alias("centroid"))


def mean_direction(rows: DataFrame, keys: list[str], vec: str, size: int, tasks: int) -> DataFrame:
    """keys, centroid: as weighted_centroid with equal weights, for many keys of few vectors each, all of `size` numbers.

    There is a sum per dimension, so a vector stays one row; rows go to the task of their key once, in `tasks` tasks.
    """
    sums = rows.select(*keys, vec).repartition(tasks, *keys).groupBy(*keys).agg(*(F.sum(F.get(vec, F.lit(i))).alias(f"_{i}") for i in range(size)))
    return sums.select(*keys, normalized(F.array(*(F.col(f"_{i}") for i in range(size)))).alias("centroid"))
