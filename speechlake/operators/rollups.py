"""Aggregations over clips, speakers, utterances, frames and laps. Each aggregates before it joins, so nothing fans out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import band_label
from ..params import DEFAULTS, Params
from .folds import fold_rows


def race_list(races: DataFrame, clips: DataFrame) -> DataFrame:
    """All races, those without clips too: n_clips, n_complete, avg_sentiment."""
    per = clips.groupBy("race_id").agg(F.count("*").alias("n_clips"), F.count_if(F.col("status") == "COMPLETE").alias("n_complete"), F.avg("sentiment_score").alias("avg_sentiment"))
    return races.select("race_id", "name").join(per, "race_id", "left").withColumns({"n_clips": F.coalesce("n_clips", F.lit(0)), "n_complete": F.coalesce("n_complete", F.lit(0))})


def race_speakers(clip_speakers: DataFrame, clips: DataFrame, profiles: DataFrame) -> DataFrame:
    """race_id, profile_id, name: distinct clips, speech, mean match."""
    rows = clip_speakers.where("profile_id IS NOT NULL").join(clips.select("clip_id", "race_id"), "clip_id")
    per = rows.groupBy("race_id", "profile_id").agg(F.countDistinct("clip_id").alias("n_clips"), F.sum("speech_s").alias("speech_s"), F.avg("match_score").alias("avg_match"))
    return per.join(profiles.select("profile_id", "name"), "profile_id")


def race_voices(clip_speakers: DataFrame, clips: DataFrame, utterances: DataFrame, profiles: DataFrame) -> DataFrame:
    """Voices of each race, named or grouped: speech and utterance figures, each summed by itself, and the share of talk."""
    of = clips.select("clip_id", "race_id")
    voice = F.coalesce(F.concat(F.lit("p"), "profile_id"), F.concat(F.lit("c"), "cluster_id")).alias("voice")
    speech = clip_speakers.select("clip_id", voice, "profile_id", "speech_s").where("voice IS NOT NULL").join(of, "clip_id").groupBy("race_id", "voice").agg(F.max("profile_id").alias("profile_id"), F.sum("speech_s").alias("speech_s"), F.countDistinct("clip_id").alias("n_clips"))
    said = utterances.select("clip_id", voice, "sentiment_score", "mood").where("voice IS NOT NULL").join(of, "clip_id").groupBy("race_id", "voice").agg(F.count("*").alias("n_utterances"), F.avg("sentiment_score").alias("avg_sentiment"), F.count_if(F.col("mood") == "stressed").alias("n_stressed"))
    rows = speech.join(said, ["race_id", "voice"], "left").join(profiles.select("profile_id", "name"), "profile_id", "left")
    whole = F.sum("speech_s").over(Window.partitionBy("race_id"))
    return rows.withColumns({"n_utterances": F.coalesce("n_utterances", F.lit(0)), "n_stressed": F.coalesce("n_stressed", F.lit(0)), "talk_share": F.when(whole > 0, F.col("speech_s") / whole)})


def race_totals(clips: DataFrame, voices: DataFrame) -> DataFrame:
    """race_id: clips, complete ones, speech of the voices, or where that is 0 the clips' durations."""
    c = clips.groupBy("race_id").agg(F.count("*").alias("n_clips"), F.count_if(F.col("status") == "COMPLETE").alias("n_complete"), F.sum("duration_s").alias("_duration"))
    v = voices.groupBy("race_id").agg(F.sum("speech_s").alias("_speech"), F.count("*").alias("n_voices"))
    rows = c.join(v, "race_id", "left")
    return rows.select("race_id", "n_clips", "n_complete", F.coalesce("n_voices", F.lit(0)).alias("n_voices"), F.coalesce(F.nullif(F.col("_speech"), F.lit(0.0)), "_duration").alias("speech_s"))


def histogram(rows: DataFrame, keys: list[str], col: str, kind: str) -> DataFrame:
    return rows.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("value")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))


def race_histograms(clips: DataFrame, utterances: DataFrame) -> DataFrame:
    """race_id, kind (language, grade, mood), value, n."""
    moods = utterances.select("clip_id", "mood").join(clips.select("clip_id", "race_id"), "clip_id")
    out = histogram(clips, ["race_id"], "language", "language")
    return out.unionByName(histogram(clips, ["race_id"], "grade", "grade")).unionByName(histogram(moods, ["race_id"], "mood", "mood"))


def compare_speakers(profiles: DataFrame, utterances: DataFrame, clip_speakers: DataFrame) -> DataFrame:
    """Per profile: utterances, clips, mean sentiment, most frequent mood (the lowest of equals), mean share of talk."""
    said = utterances.where("profile_id IS NOT NULL").groupBy("profile_id").agg(F.count("*").alias("n_utterances"), F.countDistinct("clip_id").alias("n_clips"), F.round(F.avg(F.col("sentiment_score").cast("decimal(18,6)")), 2).cast("double").alias("avg_sentiment"), F.mode("mood", True).alias("mood"))
    whole = F.sum("speech_s").over(Window.partitionBy("clip_id"))
    shares = clip_speakers.withColumn("share", F.col("speech_s") / whole).where("profile_id IS NOT NULL").groupBy("profile_id").agg(F.avg("share").alias("talk_share"))
    return profiles.select("profile_id", "name").join(said, "profile_id", "left").join(shares, "profile_id", "left").withColumns({"n_utterances": F.coalesce("n_utterances", F.lit(0)), "n_clips": F.coalesce("n_clips", F.lit(0))})


def clip_sentiment(utterances: DataFrame) -> DataFrame:
    """Mean sentiment weighted by seconds (0.1 at least), its label, the most frequent mood."""
    w = F.greatest(F.lit(0.1), F.col("speech_s"))
    per = utterances.where("sentiment_score IS NOT NULL").groupBy("clip_id").agg((F.sum(w * F.col("sentiment_score")) / F.sum(w)).alias("score"), F.mode("mood", True).alias("mood"))
    return per.withColumn("label", band_label(F.round("score", 10)))


def clip_speaker_stats(turns: DataFrame) -> DataFrame:
    """clip_id, label: speech, longest turn, overlapped seconds, share of the clip's talk (a total of 0 counts as 1)."""
    length = F.col("end_s") - F.col("start_s")
    per = turns.groupBy("clip_id", "label").agg(F.sum(length).alias("speech_s"), F.max(length).alias("longest_s"), F.sum(F.when(F.col("is_overlap"), length).otherwise(0.0)).alias("overlap_s"))
    whole = F.sum("speech_s").over(Window.partitionBy("clip_id"))
    return per.withColumn("talk_share", F.col("speech_s") / F.when(whole == 0, 1.0).otherwise(whole))


def clip_quality(frames: DataFrame, frame_s: float = 1.0, p: Params = DEFAULTS) -> DataFrame:
    """Per clip from tagged frames: snr_db, clipping and silence ratio, speech seconds, offset. Noise of 0.1 s or less does not count."""

    def mean(x, of=None):
        """The mean from an exact sum, the same in whatever order rows meet."""
        kept = x if of is None else F.when(of, x)
        return F.sum(kept.cast("decimal(20,12)")).cast("double") / F.count(kept)

    power = F.col("amp") * F.col("amp")
    per = frames.groupBy("clip_id").agg(
        mean(power, F.col("in_speech")).alias("_sp"), mean(power, ~F.col("in_speech")).alias("_ns"), F.count_if(~F.col("in_speech")).alias("_nn"),
        F.avg((F.abs("amp") >= p.clipping).cast("double")).alias("clipping_ratio"), (1 - F.avg(F.col("in_speech").cast("double"))).alias("silence_ratio"), (F.count_if("in_speech") * frame_s).alias("speech_s"), mean(F.col("amp")).alias("dc_offset"),
    )
    return per.select("clip_id", snr(F.coalesce("_sp", F.lit(1e-12)), F.when(F.col("_nn") * frame_s > 0.1, F.col("_ns")).otherwise(1e-12)).alias("snr_db"), "clipping_ratio", "silence_ratio", "speech_s", "dc_offset")


def snr(speech, noise):
    ratio = F.greatest(speech, F.lit(1e-12)) / F.greatest(noise, F.lit(1e-12))
    return F.least(F.lit(60.0), F.greatest(F.lit(-20.0), 10 * F.log10(ratio)))


def rolloff(bins: DataFrame, q: float = 0.99) -> DataFrame:
    """clip_id, bin: the first bin up to which magnitudes sum to a share q of all."""
    whole = F.sum("magnitude").over(Window.partitionBy("clip_id"))
    upto = F.sum("magnitude").over(Window.partitionBy("clip_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return bins.withColumns({"_all": whole, "_upto": upto}).where(F.col("_upto") >= q * F.col("_all")).groupBy("clip_id").agg(F.min("bin").alias("bin"))


def peaks(frames: DataFrame, n: int) -> DataFrame:
    """clip_id, bucket, peak: the largest amplitude in each of n equal stretches, over the clip's largest. Edges are rounded half up."""
    w = Window.partitionBy("clip_id").orderBy("at_s", "frame_id")
    placed = frames.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy("clip_id"))})
    # bucket b holds round(b * size) <= i < round((b + 1) * size)
    guess = F.floor(F.col("_i") * n / F.col("_n"))
    bucket = F.greatest(*(F.when(F.floor((guess + d) * F.col("_n") / n + 0.5) <= F.col("_i"), guess + d).otherwise(0) for d in (-1, 0, 1)))
    per = placed.withColumn("bucket", F.least(bucket, F.lit(n - 1))).groupBy("clip_id", "bucket").agg(F.max(F.abs("amp")).alias("_p"))
    top = F.max("_p").over(Window.partitionBy("clip_id"))
    return per.select("clip_id", F.col("bucket").cast("long").alias("bucket"), F.when(top > 0, F.col("_p") / top).otherwise(F.col("_p")).alias("peak"))


def pace(laps: DataFrame) -> DataFrame:
    """session_key, driver_number: laps, fastest, upper median, slowest of the timed laps."""
    timed = laps.where("duration_s IS NOT NULL").groupBy("session_key", "driver_number").agg(F.count("*").alias("n_laps"), F.min("duration_s").alias("fastest"), F.max("duration_s").alias("slowest"), F.array_sort(F.collect_list("duration_s")).alias("_d"))
    return timed.withColumn("median", F.element_at("_d", (F.floor(F.size("_d") / 2) + 1).cast("int"))).drop("_d")


def lap_notes(laps: DataFrame) -> DataFrame:
    """Laps with the best and worst earlier split, and the distance to the best."""
    prior = Window.partitionBy("session_key", "driver_number").orderBy("lap_number").rowsBetween(Window.unboundedPreceding, -1)
    out = laps.withColumns({"best_before": F.min("duration_s").over(prior), "worst_before": F.max("duration_s").over(prior)})
    return out.withColumn("to_best", F.col("duration_s") - F.col("best_before"))


def montage(clip_speakers: DataFrame, turns: DataFrame, min_turn: float = 0.4, per_clip: float = 25.0, total: float = 75.0) -> DataFrame:
    """cluster_id, clip_id, turn_id, dur: turns taken greedily by reliability, then length, under both caps of seconds.

    What does not fit is skipped and the next tried, which no window can say; each cluster's candidates are
    folded in order. Only turns that could ever be taken are candidates: under the caps by themselves.
    """
    length = F.col("end_s") - F.col("start_s")
    ok = turns.where(~F.col("is_overlap")).where((length >= min_turn) & (length <= min(per_clip, total)))
    rows = clip_speakers.where("cluster_id IS NOT NULL").join(ok.withColumn("dur", length), ["clip_id", "local_label"])
    rows = rows.select("cluster_id", "clip_id", "turn_id", "dur", F.coalesce(-F.col("reliability"), F.lit(1.0)).alias("r"), (-F.col("dur")).alias("d"))

    def take(state: tuple, x) -> tuple[tuple, bool]:
        taken, used = state
        fits = taken + x.dur <= total and used.get(x.clip_id, 0.0) + x.dur <= per_clip
        if fits:
            taken, used[x.clip_id] = taken + x.dur, used.get(x.clip_id, 0.0) + x.dur
        return (taken, used), fits

    return fold_rows(rows, ["cluster_id"], ["r", "d", "clip_id", "turn_id"], take, (0.0, {}), ["clip_id", "turn_id", "dur"], "fits boolean").where("fits").drop("fits")


def clip_warnings(measures: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """clip_id, warnings: names of all rules that a clip breaks, in a fixed order; a measure that is null warns of nothing.

    measures: clip_id, overlap_ratio, n_labels, smooth_rate, language_confidence, grade, least_reliability, least_speech_s.
    """
    c = F.col
    rules = [
        ("HIGH_OVERLAP", c("overlap_ratio") > p.overlap_warn), ("SPEAKER_COUNT_AT_CEILING", c("n_labels") >= p.most_speakers), ("HIGH_SMOOTH_RATE", c("smooth_rate") > p.smooth_warn),
        ("LOW_LANGUAGE_CONFIDENCE", c("language_confidence") < p.language_warn), ("POOR_AUDIO_QUALITY", c("grade") == "poor"), ("LOW_RELIABILITY_EMBEDDING", c("least_reliability") < p.reliability_fair), ("SPEAKER_TOO_SHORT", c("least_speech_s") < p.embed_floor_s),
    ]
    return measures.select("clip_id", F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules))).alias("warnings"))


def stage_stats(runs: DataFrame) -> DataFrame:
    """stage, outcome, version: n, mean_s, p50_s, p95_s, max_s of the seconds of all runs.

    runs: outcome, version, timings (JSON of stage -> seconds). Percentiles are taken over whole milliseconds, so
    that what a group gathers is bounded by the range of its times and not by its runs.
    """
    rows = runs.select("outcome", "version", F.explode(F.from_json("timings", "map<string,double>")).alias("stage", "s")).where("s IS NOT NULL")
    ms = F.round(F.col("s") * 1000).cast("long")
    per = rows.groupBy("stage", "outcome", "version").agg(F.count("*").alias("n"), F.avg("s").alias("mean_s"), F.percentile(ms, F.array(F.lit(0.5), F.lit(0.95))).alias("_p"), F.max("s").alias("max_s"))
    return per.withColumns({"p50_s": F.get("_p", F.lit(0)) / 1000, "p95_s": F.get("_p", F.lit(1)) / 1000}).drop("_p")


def driver_timeline(laps: DataFrame, said: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """session_key, driver_number, body: a driver's laps with their times and what was said on them, under a line of pace.

    said: session_key, driver_number, lap_number, speech_id, text, mood. With a range (first, last) all its laps are
    shown, else those with speech only.
    """
    key = ["session_key", "driver_number"]
    w = Window.partitionBy(*key).orderBy("lap_number")
    before = F.when(F.lag("lap_number").over(w) == F.col("lap_number") - 1, F.lag("duration_s").over(w))
    tone = F.coalesce(F.concat(F.lit(" ("), "mood", F.lit(")")), F.lit(""))
    quote = F.concat(F.lit("    ["), "speech_id", F.lit("]"), tone, F.lit(' "'), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), F.lit('"'))
    quotes = said.select(*key, "lap_number", F.struct("speech_id", quote.alias("q")).alias("q")).groupBy(*key, "lap_number").agg(F.transform(F.sort_array(F.collect_set("q")), lambda x: x["q"]).alias("quotes"))
    rows = laps.withColumn("_prev", before).join(quotes, [*key, "lap_number"], "left")
    change = F.when(F.col("_prev").isNotNull(), F.concat(F.lit(" ("), F.format_string("%+.1f", F.col("duration_s") - F.col("_prev")), F.lit("s)"))).otherwise("")
    time = F.when(F.col("duration_s").isNotNull(), F.concat(F.lit(": "), F.format_string("%.1f", "duration_s"), F.lit("s"), change)).otherwise("")
    line = F.concat_ws("\n", F.concat(F.lit("  lap "), F.col("lap_number").cast("string"), time), F.array_join(F.col("quotes"), "\n"))
    shown = F.col("quotes").isNotNull() if first is None and last is None else F.coalesce(F.col("lap_number") >= F.lit(first), F.lit(True)) & F.coalesce(F.col("lap_number") <= F.lit(last), F.lit(True))
    blocks = rows.where(shown).groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lap_number", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    of = pace(laps)
    head = laps.groupBy(*key).agg(F.count("*").alias("n")).join(of, key, "left")
    at = lambda name, c: F.coalesce(F.concat(F.lit(f" | {name} "), F.format_string("%.1f", c), F.lit("s")), F.lit(""))
    top = F.concat(F.col("n").cast("string"), F.lit(" laps"), *(F.when(F.col("n_laps").isNotNull(), at(x, x)).otherwise("") for x in ("fastest", "median", "slowest")))
    return head.join(blocks, key, "left").select(*key, F.concat_ws("\n", top, F.coalesce("lines", F.lit("  (no radio landed on any lap in this session)"))).alias("body"))
