"""Helpers that several of the operators use: checkpoints, bounded lookups, prefix sums, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, and a word, as the contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared spark.checkpoint.dir. A local session may go without and gets a folder of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder, without its lineage."""
    shared_root(df.sparkSession)
    return df.checkpoint()


#: Narrow rows (a few numbers each) that a task takes.
ROWS_OF_A_TASK = 100_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, of which about `rows` narrow rows are counted, in a partition for each ROWS_OF_A_TASK of them, without a shuffle.

    Rounds over small tables then do not pay for all of the session's partitions; where one partition is enough,
    joins, windows and sums after it need no shuffle.
    """
    return df.coalesce(max(1, -(-rows // ROWS_OF_A_TASK)))


def n_words(text: Column) -> Column:
    """Words in a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash52(*cols: Column) -> Column:
    """A long of 52 bits from md5 of the columns as text, the same in any SQL engine that has md5."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def lookup(big: DataFrame, small: DataFrame, on: list[str], by: str, max_rows: int = 10_000, salts: int = 32) -> DataFrame:
    """Inner join of big to a table with one row per key, whatever the skew of big's keys.

    small is broadcast only if it is counted to hold at most max_rows rows. Otherwise each of its rows is
    dealt to `salts` sub-keys and big's rows choose one of them by the column `by`, so that a hot key meets in many
    tasks, and a task that is run again deals its rows in the same way.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return mine.join(salted, [*on, "_salt"]).drop("_salt")


def running_before(df: DataFrame, keys: list[str], bucket: str, order: list, values: dict[str, str]) -> DataFrame:
    """Adds, for each {out: column} of values, the sum over the rows that come before within keys.

    Rows are ordered by (bucket, *order). Sums of each bucket are taken first, so a task never sorts more than
    one bucket, however many rows a key has. keys and bucket may not be null; df should be cheap to read twice.
    """
    within = [*keys, bucket]
    sums = df.groupBy(*within).agg(*(F.sum(c).alias(f"_{out}") for out, c in values.items()))
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*within, *(F.coalesce(F.sum(f"_{out}").over(over), F.lit(0)).alias(f"_{out}") for out in values))
    local = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({out: F.coalesce(F.sum(c).over(local), F.lit(0)) for out, c in values.items()})
    joined = rows.join(bases, within)
    return joined.withColumns({out: F.col(out) + F.col(f"_{out}") for out in values}).drop(*(f"_{out}" for out in values))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for each node that has an edge.

    Rounds of large-star and small-star: every round joins each node to the smallest of its neighbours, first
    those above it, then those below it, until nothing changes. A node's minimum is pre-aggregated; those of hubs,
    of which there are 2,000 at most, are broadcast, so that a hub's edges stay where they are. Every round is
    checkpointed to the shared folder, in as many partitions as its edges need.
    """

    def star(pairs: DataFrame, n: int) -> DataFrame:
        lowest = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        hubs = F.broadcast(lowest.where(F.col("n") > max(1000, n // 1000)).select("u", "m"))
        rest = pairs.join(hubs.select("u"), "u", "left_anti").join(lowest.select("u", "m"), "u")
        return pairs.join(hubs, "u").unionByName(rest)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())

    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = state(now)
    now = sized(now, was[0])
    for _ in range(max_rounds):
        if not was[0]:
            break
        n = 2 * was[0]
        both = sized(now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v"))), n)
        large = sized(star(both, was[0]), n).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), was[0])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = checkpointed(sized(sized(small, n).where("a <> b").distinct(), n))
        if (state_now := state(now)) == was:
            break
        was, now = state_now, sized(now, state_now[0])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops.withColumn("component", F.col("node")))


def whole_groups(batches, keys: list[str]):
    """Frames that hold whole groups only, from batches of rows sorted by keys (as mapInPandas passes them)."""
    import pandas as pd

    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = ~pdf.duplicated(keys).to_numpy()
        if held and (pdf[keys].iloc[0] == held[-1][keys].iloc[-1]).all():
            new[0] = False
        starts = new.nonzero()[0]
        if len(starts):
            head = pdf.iloc[: starts[-1]]
            out = [*held, head] if len(head) else held
            if out:
                yield pd.concat(out, ignore_index=True)
            held = []
        held.append(pdf.iloc[starts[-1] :] if len(starts) else pdf)
    if held:
        yield pd.concat(held, ignore_index=True)
