"""Work on rows in order: windows where one can say it, folds over a clip's rows where none can."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import is_protocol, word_list
from ..functions.steps import baseline_tone, cut_chunk
from .folds import fold_rows


def next_edges(rows: DataFrame, keys: list[str], order: list[str], node: str, *more: str) -> DataFrame:
    """(src, dst) of each row and the next one in order, with more columns of the next one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.select(F.lag(node).over(w).alias("src"), F.col(node).alias("dst"), *more).where("src IS NOT NULL")


def lap_deltas(laps: DataFrame, by: str = "edge") -> DataFrame:
    """Laps with prev_s, next_s and delta; by='number' only compares laps whose numbers follow each other."""
    w = Window.partitionBy("session_key", "driver_number").orderBy("lap_number")
    out = laps.withColumns({"prev_s": F.lag("duration_s").over(w), "next_s": F.lead("duration_s").over(w), "_n": F.lag("lap_number").over(w)})
    if by == "number":
        out = out.withColumn("prev_s", F.when(F.col("_n") == F.col("lap_number") - 1, F.col("prev_s")))
    return out.drop("_n").withColumn("delta", F.col("duration_s") - F.col("prev_s"))


def sentiment_groups(utterances: DataFrame, max_gap: float = 2.0, min_words: int = 6) -> DataFrame:
    """utterance_id, group: turns that are judged as one; the group is its first utterance's idx.

    A turn joins the group before it if the speaker is the same, the gap is small, the group is still short
    and neither it nor the turn before is procedure talk. The word count starts anew with each group, so this is a
    fold over the clip's turns in order.
    """
    rows = utterances.select("clip_id", "utterance_id", "idx", F.coalesce("local_label", F.lit("")).alias("who"), "start_s", "end_s", F.size(word_list(F.col("text"))).alias("n"), is_protocol(F.col("text")).alias("proto"))

    def step(state: tuple, x) -> tuple[tuple, int]:
        group, words, who, end, proto = state
        if group is not None and not x.proto and not proto and x.who == who and x.start_s - end <= max_gap and words < min_words:
            words += x.n
        else:
            group, words = x.idx, x.n
        return (group, words, x.who, x.end_s, x.proto), group

    return fold_rows(rows, ["clip_id"], ["idx", "utterance_id"], step, (None, 0, None, 0.0, True), ["utterance_id"], "`group` long")


def context_prefix(utterances: DataFrame, n: int = 2, short: int = 4) -> DataFrame:
    """Utterances with judged: a short text after the n texts before it, and used_context."""
    w = Window.partitionBy("clip_id").orderBy("idx")
    lead = F.array_join(F.filter(F.array(*(F.trim(F.coalesce(F.lag("text", i).over(w), F.lit(""))) for i in range(n, 0, -1))), lambda x: x != ""), " ")
    out = utterances.withColumns({"_lead": lead, "_short": F.size(word_list(F.col("text"))) < short})
    used = F.col("_short") & (F.col("_lead") != "")
    return out.withColumns({"used_context": used, "judged": F.when(used, F.concat_ws(" ", "_lead", F.trim("text"))).otherwise(F.trim("text"))}).drop("_lead", "_short")


def tone_with_baseline(features: DataFrame) -> DataFrame:
    """session, feature_id, tone: each reading against a running mean of the session's calm ones.

    What counts as calm depends on the mean so far, so this is a fold. The mean starts at the first calm reading.
    """
    return fold_rows(features, ["session"], ["at", "feature_id"], baseline_tone, (0, 0.0, 0.0, 0.0), ["feature_id"], "tone string")


def split_halves(segments: DataFrame, floor_s: float = 3.0) -> DataFrame:
    """Segments with half a or b by summed length, of keys that have two segments and floor_s seconds at least."""
    key = Window.partitionBy("clip_id", "label")
    order = key.orderBy("start_s", "turn_id").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end_s") - F.col("start_s")
    out = segments.withColumns({"_all": F.sum(length).over(key), "_n": F.count("*").over(key), "_before": F.coalesce(F.sum(length).over(order), F.lit(0.0))})
    out = out.where((F.col("_all") >= floor_s) & (F.col("_n") >= 2)).withColumn("half", F.when(F.col("_before") < F.col("_all") / 2, "a").otherwise("b"))
    both = F.size(F.collect_set("half").over(key)) == 2
    return out.withColumn("_both", both).where("_both").drop("_all", "_n", "_before", "_both")


def select_segments(segments: DataFrame, target: float, floor: float) -> DataFrame:
    """Per clip and label the best segments by rank until they reach target seconds; none if all are under floor."""
    key = Window.partitionBy("clip_id", "label")
    order = key.orderBy(F.desc("rank"), "start_s", "turn_id").rowsBetween(Window.unboundedPreceding, -1)
    out = segments.withColumn("_before", F.coalesce(F.sum("dur").over(order), F.lit(0.0))).where(F.col("_before") < target)
    return out.withColumn("_taken", F.sum("dur").over(key)).where(F.col("_taken") >= floor).drop("_before", "_taken")


def share(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    whole = F.sum(col).over(Window.partitionBy(*keys))
    return df.withColumn("share", F.when(whole != 0, F.col(col) / whole))


def cut_chunks(rms: DataFrame) -> DataFrame:
    """session, sample_id, chunk: a chunk ends at a sample after a pause once it is long enough, or at its longest."""
    return fold_rows(rms, ["session"], ["at", "sample_id"], cut_chunk, (0, None, False, None), ["sample_id"], "chunk long")


def truncate_blocks(blocks: DataFrame, key: str, most: int) -> DataFrame:
    """key, body: a key's blocks in order, two line ends between, as many whole ones as fit; all if all fit."""
    w = Window.partitionBy(key).orderBy("rank")
    size = F.length("block") + 2
    out = blocks.withColumns({"_upto": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(size).over(Window.partitionBy(key)) - 2})
    kept = out.where((F.col("_all") <= most) | (F.col("_upto") <= most))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "\n\n").alias("body"))


def interleave(a: DataFrame, b: DataFrame, key: str, limit: int) -> DataFrame:
    """a1, b1, a2, b2, ... per key; both have rank (from 1). Adds place (from 1)."""
    both = a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("rank", "_s"))).where(F.col("place") <= limit).drop("_s")
