"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, hash52, lookup, n_words, running_before

#: Expected copies are counted in units of 2**-24, so that their prefix sums are exact.
UNIT_BITS = 24


def source_targets(rows: DataFrame, size: str, cycle: int = 3, max_repeats: int = 3) -> DataFrame:
    """One row per source: source_key, n_rows, source_size, target.

    Sources in code point order, null last, weigh 1..cycle, repeating. Their targets share the sum of all sizes
    by weight; none exceeds max_repeats times its source's size, and what is over goes to the others by weight.
    The common level is found in one pass: with sources ordered by limit / weight, it is the largest value of
    (total - limits before) / (all weights - weights before). A source of size 0 has target 0.
    """
    stats = rows.groupBy(source_key(), "source").agg(F.count("*").alias("n_rows"), F.sum(size).alias("source_size"))
    stats = stats.withColumns({"weight": (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % cycle + 1, "limit": F.col("source_size") * max_repeats})
    before = Window.orderBy(F.col("limit") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    stats = stats.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return stats.select("source_key", "n_rows", "source_size", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def source_key():
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key")


def mix(rows: DataFrame, size: str, targets: DataFrame | None = None, seed: int = 1, bucket_rows: int = 256) -> DataFrame:
    """rows with source_size, target and copies: how often the mix takes each row.

    Each row of a source expects target / source_size copies. They are summed up along the source, one offset
    per source (from md5 of seed and source) is added, and a row is taken once for each whole number that its
    share crosses. A source is dealt by a hash of doc_id to buckets of about max(bucket_rows, sqrt(rows)) rows;
    within them rows go by size, up and down in turn, so that large and small rows are taken in proportion.
    Prefix sums go by bucket, so that a hot source never meets in one task.

    rows needs doc_id, source and the size column (not null). Equal rows get the same or neighbouring shares;
    empty tables give empty results; a source with size 0 gets no copies. Extra columns pass through; those
    named source_size, target or copies are replaced, and names that start with an underscore are reserved (put
    rows of unknown columns into a struct, as `mixed_documents` does). Reruns agree: nothing depends on partitions.
    """
    targets = checkpointed(source_targets(rows, size) if targets is None else targets)
    one = 1 << UNIT_BITS
    per_bucket = F.greatest(F.lit(bucket_rows), F.floor(F.sqrt("n_rows")))
    plan = targets.select(
        F.col("source_key").alias("_source"),
        F.greatest(F.lit(1), F.ceil(F.col("n_rows") / per_bucket)).alias("_buckets"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") * float(one) / F.col("source_size"))).otherwise(0).cast("long").alias("_share"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "source_key")), 1, 6), 16, 10).cast("long").alias("_offset"),
        "source_size",
        "target",
    )
    keyed = rows.drop("source_size", "target", "copies").withColumn("_source", source_key())
    keyed = lookup(keyed.withColumn("_hash", hash52(F.col("doc_id"))), plan, ["_source"], "_hash")
    keyed = keyed.withColumn("_bucket", F.col("_hash") % F.col("_buckets"))
    snake = F.when(F.col("_bucket") % 2 == 0, F.col(size)).otherwise(-F.col(size))
    placed = running_before(keyed, ["_source"], "_bucket", [snake, "_hash", "doc_id"], {"_before": "_share"})
    crossed = F.shiftright(F.col("_before") + F.col("_share") + F.col("_offset"), UNIT_BITS) - F.shiftright(F.col("_before") + F.col("_offset"), UNIT_BITS)
    return placed.withColumn("copies", crossed).drop("_source", "_buckets", "_share", "_offset", "_hash", "_bucket", "_before")


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as copies says, with copy (from 0, in place of a column of that name)."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Rows of docs as often as the mix by words takes them, with their own columns only, whatever their names.

    Null and empty texts have no words: they expect as many copies as their source's other rows. Repeated rows and
    ties are taken one by one; an empty table stays empty.
    """
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    return emit(mix(rows, "size")).select("_doc.*")


def op1_systematic_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents by words: what it takes of each. Null texts have size 0, null sources come last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = checkpointed(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return mix(rows, "size").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH rows AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS k, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
stats AS (
  SELECT k, source, count(*) AS n_rows, sum(size)::BIGINT AS source_size FROM rows GROUP BY k, source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w, source_size * 3 AS lim FROM stats),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS lev
  FROM weighed WINDOW b AS (ORDER BY lim::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT k, n_rows, source_size, least(lim::DOUBLE, max(lev) OVER () * w) AS target FROM levels),
plan AS (
  SELECT k, source_size, target,
         greatest(1, ceil(n_rows / greatest(256, floor(sqrt(n_rows)))))::BIGINT AS buckets,
         CASE WHEN source_size > 0 THEN floor(target * 16777216.0 / source_size)::BIGINT ELSE 0 END AS share,
         ('0x' || substr(md5('1|' || k), 1, 6))::BIGINT AS off
  FROM targets),
keyed AS (
  SELECT r.doc_id, r.k, r.size, p.source_size, p.target, p.share, p.off,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h, p.buckets
  FROM rows r JOIN plan p USING (k)),
summed AS (
  SELECT *, coalesce(sum(share) OVER (PARTITION BY k ORDER BY h % buckets,
              CASE WHEN (h % buckets) % 2 = 0 THEN size ELSE -size END, h, doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef
  FROM keyed)
SELECT doc_id, size, source_size, target, size * (((bef + share + off) >> 24) - ((bef + off) >> 24)) AS taken FROM summed
"""
