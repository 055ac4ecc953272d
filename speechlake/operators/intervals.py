"""Interval work on words, turns and speech regions.

All joins are equi-joins on the clip and a time bucket, so that a long clip does not make a quadratic group.
Tables have clip_id, start_s and end_s; intervals are half-open. A turn's order is (start_s, turn_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params


def bucketed(df: DataFrame, width: float, start: Column, end: Column) -> DataFrame:
    """A row per bucket of `width` seconds that [start, end] touches."""
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))))


def overlap_join(left: DataFrame, right: DataFrame, width: float, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """Pairs of rows with the same keys whose intervals overlap; right's columns get the prefix r_.

    A pair is kept in the bucket where its overlap begins, so no pair comes twice and none needs a distinct.
    """
    r = bucketed(right, width, F.col("start_s"), F.col("end_s")).select(*(F.col(c).alias(f"r_{c}") for c in [*right.columns, "_bucket"]))
    lft = bucketed(left, width, F.col("start_s"), F.col("end_s"))
    on = [F.col(k) == F.col(f"r_{k}") for k in keys]
    begins = F.floor(F.greatest("start_s", "r_start_s") / width)
    cond = (F.col("_bucket") == F.col("r__bucket")) & (F.col("start_s") < F.col("r_end_s")) & (F.col("r_start_s") < F.col("end_s")) & (begins == F.col("_bucket"))
    for c in on:
        cond = cond & c
    return lft.join(r, cond).drop("_bucket", "r__bucket", *(f"r_{k}" for k in keys))


def merge_intervals(df: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Unions of intervals that overlap or lie at most gap apart: keys, start_s, end_s."""
    order = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    prior = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_prior", prior).withColumn("_new", F.when(F.col("_prior").isNull() | (F.col("start_s") - F.col("_prior") > gap), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("_island")


def merge_adjacent(turns: DataFrame, gap: float) -> DataFrame:
    """Turns of one label that follow each other, no other label between, with at most gap seconds between.

    Gaps and islands: within a run of one label, a new island starts where a start exceeds all earlier ends
    of the run by more than gap. Other columns come from the island's first turn.
    """
    order = Window.partitionBy("clip_id").orderBy("start_s", "turn_id")
    runs = turns.withColumn("_run", F.sum(F.when(F.lag("label").over(order) == F.col("label"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("clip_id", "_run").orderBy("start_s", "turn_id")
    prior = F.max("end_s").over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_prior", prior).withColumn("_new", F.when(F.col("start_s") - F.col("_prior") > gap, 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("clip_id", "_run", "_island").agg(F.min(F.struct("start_s", "turn_id")).alias("_first"), F.first("label").alias("label"), F.max("end_s").alias("end_s")).select("clip_id", "_first.turn_id", "label", "_first.start_s", "end_s")


def drop_phantoms(turns: DataFrame, tol: float = 0.3, ratio: float = 0.6) -> DataFrame:
    """Without turns that start within tol seconds of a longer one of another label and last under ratio of it."""
    keyed = turns.withColumn("_b", F.floor(F.col("start_s") / 1.0))
    near = keyed.select("clip_id", F.col("label").alias("o_label"), F.col("start_s").alias("o_start"), (F.col("end_s") - F.col("start_s")).alias("o_len"), F.explode(F.array(F.col("_b") - 1, "_b", F.col("_b") + 1)).alias("_b"))
    length = F.col("end_s") - F.col("start_s")
    close = (F.col("o_start") >= F.col("start_s") - tol) & (F.col("o_start") <= F.col("start_s") + tol)
    cond = [keyed["clip_id"] == near["clip_id"], keyed["_b"] == near["_b"], F.col("o_label") != F.col("label"), close, F.col("o_len") > length, length < ratio * F.col("o_len")]
    return keyed.join(near, cond, "left_anti").drop("_b")


def flag_overlaps(turns: DataFrame, others: DataFrame, width: float) -> DataFrame:
    """turns with is_overlap: whether a turn of another label in others overlaps."""
    hits = overlap_join(turns.select("clip_id", "turn_id", "label", "start_s", "end_s"), others.select("clip_id", "label", "start_s", "end_s"), width).where("label <> r_label").select("clip_id", "turn_id").distinct()
    return turns.join(hits.withColumn("is_overlap", F.lit(True)), ["clip_id", "turn_id"], "left").withColumn("is_overlap", F.coalesce("is_overlap", F.lit(False)))


def nearest_edge(points: DataFrame, edges: DataFrame, at: str, tol: float) -> DataFrame:
    """points with _edge: the edge of the clip nearest to column at, within tol, the smaller one of two; else null."""
    width = max(tol * 2, 1e-3)
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    e = edges.select(F.col("clip_id").alias("_c"), "edge", F.explode(F.sequence(F.floor((F.col("edge") - tol) / width), F.floor((F.col("edge") + tol) / width))).alias("_eb")).distinct()
    near = p.join(e, (F.col("clip_id") == F.col("_c")) & (F.col("_b") == F.col("_eb")) & (F.abs(F.col("edge") - F.col(at)) <= tol))
    best = near.groupBy("clip_id", "turn_id").agg(F.min_by("edge", F.struct(F.abs(F.col("edge") - F.col(at)), "edge")).alias("_edge"))
    return points.join(best, ["clip_id", "turn_id"], "left")


def snap(turns: DataFrame, regions: DataFrame, tol: float) -> DataFrame:
    """Turn edges moved to the nearest edge of a speech region within tol; snapped tells if either was."""
    edges = regions.select("clip_id", F.explode(F.array("start_s", "end_s")).alias("edge")).distinct()
    one = nearest_edge(turns, edges, "start_s", tol).withColumnRenamed("_edge", "_s")
    two = nearest_edge(one, edges, "end_s", tol).withColumnRenamed("_edge", "_e")
    start, end = F.coalesce("_s", "start_s"), F.coalesce("_e", "end_s")
    moved = two.withColumns({"snapped": F.col("_s").isNotNull() | F.col("_e").isNotNull(), "_start": start, "_end": F.when(end <= start, start + 0.05).otherwise(end)})
    return moved.withColumns({"start_s": F.col("_start"), "end_s": F.col("_end")}).drop("_s", "_e", "_start", "_end")


def clean_turns(raw: DataFrame, regions: DataFrame, width: float, p: Params = DEFAULTS) -> DataFrame:
    """Turns ready for attribution, with idx, is_overlap, snapped and too_short.

    Long turns lose onset phantoms, are merged, flagged for overlap among themselves, snapped, and go if
    they end up too short. Short turns stay as they are, flagged where they lie in another label's long turn.
    """
    length = F.col("end_s") - F.col("start_s")
    base = raw.select("clip_id", "turn_id", "label", "start_s", "end_s")
    long = merge_adjacent(drop_phantoms(base.where(length >= p.min_turn_s)), p.merge_gap_s)
    long = snap(flag_overlaps(long, long, width), regions, p.snap_tol_s).where(length >= p.min_turn_s).withColumn("too_short", F.lit(False))
    short = flag_overlaps(base.where(length < p.min_turn_s), long, width).withColumns({"snapped": F.lit(False), "too_short": F.lit(True)})
    order = Window.partitionBy("clip_id").orderBy("start_s", "too_short", "turn_id")
    return long.unionByName(short).withColumn("idx", (F.row_number().over(order) - 1).cast("long"))


def nearest_turn(points: DataFrame, turns: DataFrame) -> DataFrame:
    """clip_id, word_id -> the turn whose middle is nearest, the earliest of equals; a sorted pass each way."""
    mids = turns.groupBy("clip_id", ((F.col("start_s") + F.col("end_s")) / 2).alias("at")).agg(F.min(F.struct("start_s", "turn_id", "label")).alias("turn"))
    both = mids.select("clip_id", "at", "turn", F.lit(None).cast("long").alias("word_id")).unionByName(points.select("clip_id", ((F.col("start_s") + F.col("end_s")) / 2).alias("at"), F.lit(None).cast(mids.schema["turn"].dataType).alias("turn"), "word_id"))
    mark = F.when(F.col("turn").isNotNull(), F.struct("at", "turn"))
    up, down = (Window.partitionBy("clip_id").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("at"), F.desc("at")))
    near = both.withColumns({"_l": F.last(mark, True).over(up), "_r": F.last(mark, True).over(down)}).where("word_id IS NOT NULL")
    gap_l, gap_r = F.col("at") - F.col("_l.at"), F.col("_r.at") - F.col("at")
    best = F.when(F.col("_l").isNull(), F.col("_r.turn")).when(F.col("_r").isNull(), F.col("_l.turn")).when(gap_l < gap_r, F.col("_l.turn")).when(gap_r < gap_l, F.col("_r.turn")).otherwise(F.least("_l.turn", "_r.turn"))
    return near.select("clip_id", "word_id", best.alias("turn"))


def assign_words(words: DataFrame, turns: DataFrame, width: float = 10.0) -> DataFrame:
    """words with speaker (label), speaker_conf and in_overlap.

    The turn with the largest overlap wins, the earliest of equals; its share of the word is the confidence.
    Words that no turn touches get the turn with the nearest middle and confidence 0, or SPEAKER_00 in clips
    without turns.
    """
    t = turns if "is_overlap" in turns.columns else turns.withColumn("is_overlap", F.lit(False))
    pairs = overlap_join(words.select("clip_id", "word_id", "start_s", "end_s"), t.select("clip_id", "turn_id", "label", "start_s", "end_s", "is_overlap"), width)
    share = F.least("end_s", "r_end_s") - F.greatest("start_s", "r_start_s")
    best = pairs.groupBy("clip_id", "word_id").agg(F.min(F.struct((-share).alias("o"), "r_start_s", "r_turn_id", "r_label", "r_is_overlap", (F.col("end_s") - F.col("start_s")).alias("d"))).alias("_b"))
    found = words.join(best, ["clip_id", "word_id"], "left")
    rest = nearest_turn(found.where("_b IS NULL"), t)
    out = found.join(rest, ["clip_id", "word_id"], "left")
    conf = F.when(F.col("_b").isNotNull(), F.least(F.lit(1.0), -F.col("_b.o") / F.greatest(F.col("_b.d"), F.lit(1e-6)))).otherwise(0.0)
    return out.withColumns({"speaker": F.coalesce("_b.r_label", "turn.label", F.lit("SPEAKER_00")), "speaker_conf": conf, "in_overlap": F.coalesce("_b.r_is_overlap", F.lit(False))}).drop("_b", "turn")


def smooth(words: DataFrame, min_conf: float) -> DataFrame:
    """Words of low confidence between two equal neighbours of another label take theirs.

    A word that was smoothed counts as its neighbour's left label, so in a run of candidates only the odd ones
    change.
    """
    order = Window.partitionBy("clip_id").orderBy("start_s", "word_id")
    before, after = F.lag("speaker").over(order), F.lead("speaker").over(order)
    raw = words.withColumns({"_before": before, "_raw": F.coalesce((F.col("speaker") != before) & (before == after) & (F.col("speaker_conf") < min_conf), F.lit(False)), "_n": F.row_number().over(order)})
    runs = raw.withColumn("_last", F.max(F.when(~F.col("_raw"), F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    odd = F.col("_raw") & ((F.col("_n") - F.coalesce("_last", F.lit(0))) % 2 == 1)
    return runs.withColumns({"smoothed": odd, "speaker": F.when(odd, F.col("_before")).otherwise(F.col("speaker"))}).drop("_before", "_raw", "_n", "_last")


def regroup(words: DataFrame, gap: float) -> DataFrame:
    """words with utt: a new utterance at a change of speaker, or after . ? ! 。 ؟ and a pause over gap."""
    order = Window.partitionBy("clip_id").orderBy("start_s", "word_id")
    closed = F.lag("word").over(order).rlike(r"[.?!。؟]\s*$") & (F.col("start_s") - F.lag("end_s").over(order) > gap)
    new = F.when((F.lag("speaker").over(order) != F.col("speaker")) | closed, 1).otherwise(0)
    return words.withColumn("_new", new).withColumn("utt", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def finalize(words: DataFrame) -> DataFrame:
    """clip_id, utt, speaker, start_s, end_s, text, n_words, confidence, speaker_conf, overlap_ratio."""
    return words.groupBy("clip_id", "utt").agg(
        F.first("speaker").alias("speaker"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_s", "word_id", "word"))), lambda w: w["word"]), " ").alias("text"),
        F.count("*").alias("n_words"), F.avg("probability").alias("confidence"), F.avg("speaker_conf").alias("speaker_conf"), F.avg(F.col("in_overlap").cast("double")).alias("overlap_ratio"),
    )


def interruptions(turns: DataFrame, width: float) -> DataFrame:
    """clip_id, label, n: turns of the label that start strictly inside another label's turn."""
    points = turns.select("clip_id", "turn_id", "label", "start_s").withColumn("_b", F.floor(F.col("start_s") / width))
    spans = bucketed(turns.select("clip_id", F.col("label").alias("o_label"), "start_s", "end_s"), width, F.col("start_s"), F.col("end_s")).select(F.col("clip_id").alias("_c"), "o_label", F.col("start_s").alias("o_start"), F.col("end_s").alias("o_end"), "_bucket")
    cond = (F.col("clip_id") == F.col("_c")) & (F.col("_b") == F.col("_bucket")) & (F.col("label") != F.col("o_label")) & (F.col("o_start") < F.col("start_s")) & (F.col("start_s") < F.col("o_end"))
    hit = points.join(spans, cond, "left_semi").groupBy("clip_id", "label").agg(F.count("*").alias("n"))
    return turns.select("clip_id", "label").distinct().join(hit, ["clip_id", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def inside(points: DataFrame, regions: DataFrame, at: str, width: float, how: str) -> DataFrame:
    """points whose column at lies in a region of their clip (how = left_semi), or in none (left_anti)."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    r = bucketed(regions.select("clip_id", "start_s", "end_s"), width, F.col("start_s"), F.col("end_s")).select(F.col("clip_id").alias("_c"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), "_bucket")
    return p.join(r, (F.col("clip_id") == F.col("_c")) & (F.col("_b") == F.col("_bucket")) & (F.col(at) >= F.col("_s")) & (F.col(at) < F.col("_e")), how).drop("_b")


def tag_frames(frames: DataFrame, regions: DataFrame, width: float) -> DataFrame:
    """frames with in_speech. Regions of a clip may not overlap each other (see merge_intervals)."""
    hits = inside(frames.select("clip_id", "frame_id", "at_s"), regions, "at_s", width, "left_semi").select("clip_id", "frame_id")
    return frames.join(hits.withColumn("in_speech", F.lit(True)), ["clip_id", "frame_id"], "left").withColumn("in_speech", F.coalesce("in_speech", F.lit(False)))
