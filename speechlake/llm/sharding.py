"""Shards of near-equal bytes by size-weighted sampled splitters."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, running_before

#: Splitters per group of the two-level search.
GROUP = 64
#: Most splitters; ranges that stay large are subdivided instead.
MOST_SPLITTERS = 16_384


def sort_key():
    """Text hash, then doc_id, as hex: equal texts stand together and a large group can still be cut by doc_id."""
    return F.concat(F.lpad(F.hex(F.xxhash64(F.coalesce("text", F.lit("")))), 16, "0"), F.lpad(F.hex(F.coalesce("doc_id", F.lit(-1))), 16, "0"))


def shard(rows: DataFrame, n_shards: int, key: str = "key", size: str = "size", seed: int = 1, per_shard: int = 64) -> DataFrame:
    """rows with shard (0 to n_shards - 1) and slot (from 0 without gaps), the shards' sizes near equal.

    Law `bytes`. Keys are drawn with a probability that follows their size, about max(64 per shard, sqrt(rows))
    of them and MOST_SPLITTERS at most; sorted, they are the splitters that cut the keys into small ranges of
    about equal size. A range with many more rows than the mean is subdivided by a hash. Exact sizes of the
    ranges are summed up, so each record knows the bytes before it and goes to the shard that its middle byte
    falls in: a shard is off by one record's size at most. Each task sorts one range only.

    rows should be narrow and cheap to read twice (checkpointed), with key (string) and size (positive) not
    null. Equal keys get any order among themselves; an empty table gives no rows. Extra columns pass through;
    those named shard or slot are replaced, and names that start with an underscore are reserved.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    wanted = min(MOST_SPLITTERS, max(per_shard * n_shards, math.isqrt(n)))
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = sorted(r[0] for r in rows.where(u < F.col(size) * (wanted / max(total, 1))).select(key).distinct().collect())
    groups = [drawn[i : i + GROUP] for i in range(0, len(drawn), GROUP)]
    tops = F.from_json(F.lit(json.dumps([g[0] for g in groups[1:]])), "array<string>")
    all_groups = F.from_json(F.lit(json.dumps(groups or [[]])), "array<array<string>>")
    group = F.size(F.filter(tops, lambda x: x <= F.col(key)))
    within = F.size(F.filter(F.element_at(all_groups, F.col("_group") + 1), lambda x: x <= F.col(key)))
    ranged = rows.withColumn("_group", group).withColumn("_range", F.col("_group") * GROUP + within).drop("_group")
    most = max(1024, 4 * n // max(wanted, 1))
    parts = ranged.groupBy("_range").agg(F.ceil(F.count("*") / most).alias("_parts"))  # a row per range: MOST_SPLITTERS bounds it
    ranged = ranged.join(F.broadcast(parts), "_range")
    ranged = ranged.withColumn("_bucket", F.col("_range").cast("long") * (1 << 31) + F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.col("_parts"))).drop("_range", "_parts")
    placed = running_before(ranged.withColumn("_one", F.lit(1)), [], "_bucket", [key], {"_bytes": size, "_row": "_one"})
    middle = F.col("_bytes") + F.shiftright(F.col(size), 1)
    placed = placed.withColumn("shard", F.least(F.floor(middle * (n_shards / max(total, 1))), F.lit(n_shards - 1)).cast("int"))
    placed = checkpointed(placed.drop("_one", "_bucket", "_bytes"))
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # a row per shard
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_row") - F.col("_first")).drop("_row", "_first")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, on: str = "doc_id") -> None:
    """Writes docs as Parquet, a folder per shard, each file in slot order; a shard is split over several files."""
    rows = docs.join(placed.select(on, "shard", "slot"), on)
    rows.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sampled_splitters(spark, sf_dir: str, n_shards: int = 40) -> DataFrame:
    """Shard and slot of every document by law `bytes`; null texts are empty, equal texts lie side by side."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = checkpointed(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), sort_key().alias("key")))
    placed = shard(rows, n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
