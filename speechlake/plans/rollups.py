"""Queries that aggregate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scoring import quality_grade, reliability, reliability_band
from ..operators import intervals as iv
from ..operators import rollups as r
from .intervals import ASSIGN, HOURS, SMOOTH, attributed, rounded
from .registry import query


@query("a01_race_list", """SELECT r.race_id, r.name, count(c.clip_id) AS n_clips, count(*) FILTER (c.status = 'COMPLETE') AS n_complete, round(avg(c.sentiment_score), 6) AS avg_sentiment
  FROM v_races r LEFT JOIN v_clips c ON c.race_id = r.race_id GROUP BY r.race_id, r.name""")
def a01(t):
    return rounded(r.race_list(t.v_races, t.v_clips), "avg_sentiment")


@query("a02_race_speakers", """SELECT c.race_id, s.profile_id, p.name, count(DISTINCT s.clip_id) AS n_clips, round(sum(s.speech_s), 6) AS speech_s, round(avg(s.match_score), 6) AS avg_match
  FROM v_clip_speakers s JOIN v_clips c USING (clip_id) JOIN v_profiles_named p ON p.profile_id = s.profile_id GROUP BY ALL""")
def a02(t):
    return rounded(r.race_speakers(t.v_clip_speakers, t.v_clips, t.v_profiles_named), "speech_s", "avg_match")


VOICES = """sp AS (SELECT race_id, coalesce('p' || profile_id, 'c' || cluster_id) AS voice, max(profile_id) AS profile_id, sum(speech_s) AS speech_s, count(DISTINCT clip_id) AS n_clips FROM v_clip_speakers JOIN v_clips USING (clip_id) WHERE coalesce(profile_id, cluster_id) IS NOT NULL GROUP BY 1, 2),
  ut AS (SELECT race_id, coalesce('p' || profile_id, 'c' || cluster_id) AS voice, count(*) AS n_utterances, avg(u.sentiment_score) AS avg_sentiment, count(*) FILTER (mood = 'stressed') AS n_stressed FROM v_speech_utt u JOIN v_clips USING (clip_id) WHERE coalesce(profile_id, cluster_id) IS NOT NULL GROUP BY 1, 2),
  voices AS (SELECT sp.race_id, sp.voice, sp.profile_id, p.name, sp.speech_s, sp.n_clips, coalesce(n_utterances, 0) AS n_utterances, avg_sentiment, coalesce(n_stressed, 0) AS n_stressed, sp.speech_s / nullif(sum(sp.speech_s) OVER (PARTITION BY sp.race_id), 0) AS talk_share
    FROM sp LEFT JOIN ut ON sp.race_id = ut.race_id AND sp.voice = ut.voice LEFT JOIN v_profiles_named p ON p.profile_id = sp.profile_id)"""


@query("a03_race_voices", f"WITH {VOICES} SELECT * REPLACE (round(speech_s, 6) AS speech_s, round(avg_sentiment, 6) AS avg_sentiment, round(talk_share, 8) AS talk_share) FROM voices")
def a03(t):
    return rounded(r.race_voices(t.v_clip_speakers, t.v_clips, t.v_speech_utt, t.v_profiles_named), "speech_s", "avg_sentiment").withColumn("talk_share", F.round("talk_share", 8))


@query("a04_race_totals", f"""WITH {VOICES} SELECT c.race_id, n_clips, n_complete, coalesce(n_voices, 0) AS n_voices, round(coalesce(nullif(sp, 0), dur), 6) AS speech_s
  FROM (SELECT race_id, count(*) AS n_clips, count(*) FILTER (status = 'COMPLETE') AS n_complete, sum(duration_s) AS dur FROM v_clips GROUP BY 1) c LEFT JOIN (SELECT race_id, sum(speech_s) AS sp, count(*) AS n_voices FROM voices GROUP BY 1) v ON c.race_id = v.race_id""")
def a04(t):
    return rounded(r.race_totals(t.v_clips, r.race_voices(t.v_clip_speakers, t.v_clips, t.v_speech_utt, t.v_profiles_named)), "speech_s")


@query("a05_race_histograms", """SELECT race_id, 'language' AS kind, language AS value, count(*) AS n FROM v_clips GROUP BY ALL UNION ALL SELECT race_id, 'grade', grade, count(*) FROM v_clips WHERE grade IS NOT NULL GROUP BY ALL
  UNION ALL SELECT race_id, 'mood', mood, count(*) FROM v_speech_utt JOIN v_clips USING (clip_id) WHERE mood IS NOT NULL GROUP BY ALL""")
def a05(t):
    return r.race_histograms(t.v_clips, t.v_speech_utt)


@query("a06_compare_speakers", """WITH m AS (SELECT profile_id, mood FROM (SELECT profile_id, mood, row_number() OVER (PARTITION BY profile_id ORDER BY count(*) DESC, mood) AS n FROM v_speech_utt WHERE profile_id IS NOT NULL AND mood IS NOT NULL GROUP BY profile_id, mood) WHERE n = 1),
  u AS (SELECT profile_id, count(*) AS n_utterances, count(DISTINCT clip_id) AS n_clips, round(sum(sentiment_score::DECIMAL(18,6)) / count(*), 2)::DOUBLE AS avg_sentiment FROM v_speech_utt WHERE profile_id IS NOT NULL GROUP BY 1),
  s AS (SELECT profile_id, avg(share) AS talk_share FROM (SELECT profile_id, speech_s / sum(speech_s) OVER (PARTITION BY clip_id) AS share FROM v_clip_speakers) WHERE profile_id IS NOT NULL GROUP BY 1)
  SELECT p.profile_id, p.name, coalesce(n_utterances, 0) AS n_utterances, coalesce(n_clips, 0) AS n_clips, avg_sentiment, mood, round(talk_share, 6) AS talk_share FROM v_profiles_named p LEFT JOIN u USING (profile_id) LEFT JOIN m USING (profile_id) LEFT JOIN s USING (profile_id)""")
def a06(t):
    return rounded(r.compare_speakers(t.v_profiles_named, t.v_speech_utt, t.v_clip_speakers), "talk_share")


@query("a07_ops_stats", "SELECT 'clips' AS kind, status AS value, count(*) AS n FROM v_clips GROUP BY ALL UNION ALL SELECT 'matches', match_result, count(*) FROM v_clip_speakers GROUP BY ALL")
def a07(t):
    return r.histogram(t.v_clips, [], "status", "clips").unionByName(r.histogram(t.v_clip_speakers, [], "match_result", "matches"))


@query("a08_clip_sentiment", """WITH m AS (SELECT clip_id, mood FROM (SELECT clip_id, mood, row_number() OVER (PARTITION BY clip_id ORDER BY count(*) DESC, mood) AS n FROM v_speech_utt WHERE mood IS NOT NULL GROUP BY clip_id, mood) WHERE n = 1),
  s AS (SELECT clip_id, round(sum(greatest(0.1, speech_s) * sentiment_score) / sum(greatest(0.1, speech_s)), 10) AS score FROM v_speech_utt GROUP BY 1)
  SELECT clip_id, score, mood, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS label FROM s LEFT JOIN m USING (clip_id)""")
def a08(t):
    return r.clip_sentiment(t.v_speech_utt).withColumn("score", F.round("score", 10))


@query("a09_clip_speaker_stats", """WITH f AS (SELECT *, EXISTS (SELECT 1 FROM v_turns b WHERE a.clip_id = b.clip_id AND a.label <> b.label AND a.start_s < b.end_s AND b.start_s < a.end_s) AS ov FROM v_turns a),
  s AS (SELECT clip_id, label, sum(end_s - start_s) AS sp, max(end_s - start_s) AS lg, sum(CASE WHEN ov THEN end_s - start_s ELSE 0 END) AS os FROM f GROUP BY ALL)
  SELECT clip_id, label, round(sp, 4) AS speech_s, round(lg, 4) AS longest_s, round(os, 4) AS overlap_s, round(sp / CASE WHEN sum(sp) OVER (PARTITION BY clip_id) = 0 THEN 1 ELSE sum(sp) OVER (PARTITION BY clip_id) END, 6) AS talk_share FROM s""")
def a09(t):
    made = r.clip_speaker_stats(iv.flag_overlaps(t.v_turns, t.v_turns, HOURS))
    return made.withColumns({c: F.round(c, 4) for c in ("speech_s", "longest_s", "overlap_s")}).withColumn("talk_share", F.round("talk_share", 6))


TAGGED = "tagged AS (SELECT *, EXISTS (SELECT 1 FROM v_vad v WHERE v.clip_id = f.clip_id AND f.at_s >= v.start_s AND f.at_s < v.end_s) AS in_speech FROM v_frames f)"


@query("a11_clip_quality", f"""WITH {TAGGED}, q AS (SELECT clip_id, sum((amp * amp)::DECIMAL(20, 12)) FILTER (in_speech)::DOUBLE / nullif(count(*) FILTER (in_speech), 0) AS sp, sum((amp * amp)::DECIMAL(20, 12)) FILTER (NOT in_speech)::DOUBLE / nullif(count(*) FILTER (NOT in_speech), 0) AS ns, count(*) FILTER (NOT in_speech) AS nn, avg((abs(amp) >= 0.99)::INT::DOUBLE) AS c, avg(in_speech::INT::DOUBLE) AS i, count(*) FILTER (in_speech) AS n, sum(amp::DECIMAL(20, 12))::DOUBLE / count(*) AS dc FROM tagged GROUP BY 1)
  SELECT clip_id, round(least(60, greatest(-20, 10 * log10(greatest(coalesce(sp, 1e-12), 1e-12) / greatest(CASE WHEN nn > 0.1 THEN ns ELSE 1e-12 END, 1e-12)))), 6) AS snr_db, round(c, 6) AS clipping_ratio, round(1 - i, 6) AS silence_ratio, n::DOUBLE AS speech_s, round(dc, 6) AS dc_offset FROM q""")
def a11(t):
    return rounded(r.clip_quality(iv.tag_frames(t.v_frames, t.v_vad, HOURS)), "snr_db", "clipping_ratio", "silence_ratio", "dc_offset")


@query("a12_speaker_quality", """WITH f AS (SELECT user_id AS clip_id, event_type AS label, ((event_id * 7919) % 2001 - 1000) / 1000.0::DOUBLE AS amp FROM events),
  n AS (SELECT clip_id, avg(amp * amp) AS noise FROM f WHERE label = 'view' GROUP BY 1)
  SELECT clip_id, label, count(*) AS n, round(least(60, greatest(-20, 10 * log10(greatest(avg(amp * amp), 1e-12) / greatest(coalesce(any_value(noise), 1e-12), 1e-12)))), 6) AS snr_db, round(avg((abs(amp) >= 0.99)::INT::DOUBLE), 6) AS clipping_ratio FROM f LEFT JOIN n USING (clip_id) WHERE label <> 'view' GROUP BY ALL""")
def a12(t):
    """Quality per speaker against the clip's noise floor."""
    f = t.events.selectExpr("user_id AS clip_id", "event_type AS label", "((event_id * 7919) % 2001 - 1000) / 1000D AS amp")
    noise = f.where("label = 'view'").groupBy("clip_id").agg(F.avg(F.pow("amp", 2)).alias("noise"))
    per = f.where("label <> 'view'").groupBy("clip_id", "label").agg(F.count("*").alias("n"), F.avg(F.pow("amp", 2)).alias("p"), F.avg((F.abs("amp") >= 0.99).cast("double")).alias("clipping_ratio"))
    made = per.join(noise, "clip_id", "left").withColumn("snr_db", r.snr(F.col("p"), F.coalesce("noise", F.lit(1e-12)))).drop("p", "noise")
    return rounded(made, "snr_db", "clipping_ratio")


@query("a13_rolloff", """WITH b AS (SELECT user_id AS clip_id, event_id % 64 AS bin, sum((value * 100)::BIGINT)::BIGINT AS m FROM events GROUP BY ALL),
  c AS (SELECT *, sum(m) OVER (PARTITION BY clip_id ORDER BY bin) AS u, sum(m) OVER (PARTITION BY clip_id) AS a FROM b) SELECT clip_id, min(bin) AS bin FROM c WHERE u >= 0.99::DOUBLE * a GROUP BY 1""")
def a13(t):
    bins = t.events.groupBy(F.col("user_id").alias("clip_id"), (F.col("event_id") % 64).alias("bin")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("magnitude"))
    return r.rolloff(bins)


@query("a14_peaks", """WITH i AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY at_s, frame_id) - 1 AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM v_frames),
  b AS (SELECT clip_id, k AS bucket, max(abs(amp)) AS p FROM i JOIN range(16) v(k) ON i >= floor(k * n / 16.0 + 0.5) AND i < floor((k + 1) * n / 16.0 + 0.5) GROUP BY ALL)
  SELECT clip_id, bucket, round(p / max(p) OVER (PARTITION BY clip_id), 6) AS peak FROM b""")
def a14(t):
    return rounded(r.peaks(t.v_frames, 16), "peak")


#: Measures of clips, each from the tables that have them.
MEASURES = f"""f AS (SELECT *, EXISTS (SELECT 1 FROM v_turns b WHERE a.clip_id = b.clip_id AND a.label <> b.label AND a.start_s < b.end_s AND b.start_s < a.end_s) AS ov FROM v_turns a),
  s AS (SELECT clip_id, round(sum(CASE WHEN ov THEN end_s - start_s ELSE 0 END) / sum(end_s - start_s), 6) AS overlap_ratio, count(DISTINCT label) AS n_labels FROM f GROUP BY 1), {ASSIGN}, {SMOOTH},
  sm AS (SELECT clip_id, avg(smoothed::INT::DOUBLE) AS smooth_rate FROM smoothed_words GROUP BY 1), sp AS (SELECT clip_id, min(reliability) AS least_reliability, min(speech_s) AS least_speech_s FROM v_clip_speakers GROUP BY 1),
  ids AS (SELECT clip_id FROM v_clips UNION SELECT clip_id FROM s UNION SELECT clip_id FROM sm)"""


def measures(t):
    f = iv.flag_overlaps(t.v_turns, t.v_turns, HOURS).withColumn("d", F.col("end_s") - F.col("start_s"))
    s = f.groupBy("clip_id").agg(F.round(F.sum(F.when(F.col("is_overlap"), F.col("d")).otherwise(0.0)) / F.sum("d"), 6).alias("overlap_ratio"), F.countDistinct("label").alias("n_labels"))
    sm = attributed(t).groupBy("clip_id").agg(F.avg(F.col("smoothed").cast("double")).alias("smooth_rate"))
    sp = t.v_clip_speakers.groupBy("clip_id").agg(F.min("reliability").alias("least_reliability"), F.min("speech_s").alias("least_speech_s"))
    clips = t.v_clips.select("clip_id", "grade", ((F.col("clip_id") * 37) % 100 / 100).alias("language_confidence"))
    return clips.join(s, "clip_id", "full").join(sm, "clip_id", "full").join(sp, "clip_id", "left")


@query("a15_clip_warnings", f"""WITH {MEASURES} SELECT clip_id, list_filter([CASE WHEN overlap_ratio > 0.3 THEN 'HIGH_OVERLAP' END, CASE WHEN n_labels >= 5 THEN 'SPEAKER_COUNT_AT_CEILING' END, CASE WHEN smooth_rate > 0.05 THEN 'HIGH_SMOOTH_RATE' END, CASE WHEN c.clip_id * 37 % 100 < 50 THEN 'LOW_LANGUAGE_CONFIDENCE' END,
    CASE WHEN grade = 'poor' THEN 'POOR_AUDIO_QUALITY' END, CASE WHEN least_reliability < 0.45 THEN 'LOW_RELIABILITY_EMBEDDING' END, CASE WHEN least_speech_s < 1.5 THEN 'SPEAKER_TOO_SHORT' END], lambda x: x IS NOT NULL) AS warnings
  FROM ids LEFT JOIN v_clips c USING (clip_id) LEFT JOIN s USING (clip_id) LEFT JOIN sm USING (clip_id) LEFT JOIN sp USING (clip_id)""")
def a15(t):
    """All seven warnings of every clip."""
    return r.clip_warnings(measures(t))


@query("a16_coverage", "SELECT clip_id, round(sum(CASE WHEN profile_id IS NOT NULL THEN speech_s ELSE 0 END) / nullif(sum(speech_s), 0), 6) AS named, round(sum(CASE WHEN profile_id IS NULL AND cluster_id IS NOT NULL THEN speech_s ELSE 0 END) / nullif(sum(speech_s), 0), 6) AS grouped, count(*) AS n_speakers FROM v_clip_speakers GROUP BY 1")
def a16(t):
    """Share of a clip's speech that has a name, or a group."""
    s, whole = F.col("speech_s"), F.nullif(F.sum("speech_s"), F.lit(0.0))
    named = F.sum(F.when(F.col("profile_id").isNotNull(), s).otherwise(0.0)) / whole
    grouped = F.sum(F.when(F.col("profile_id").isNull() & F.col("cluster_id").isNotNull(), s).otherwise(0.0)) / whole
    return rounded(t.v_clip_speakers.groupBy("clip_id").agg(named.alias("named"), grouped.alias("grouped"), F.count("*").alias("n_speakers")), "named", "grouped")


@query("a17_tone_summary", """WITH m AS (SELECT clip_id, mood FROM (SELECT clip_id, mood, row_number() OVER (PARTITION BY clip_id ORDER BY count(*) DESC, mood) AS n FROM v_speech_utt WHERE mood IS NOT NULL GROUP BY clip_id, mood) WHERE n = 1)
  SELECT u.clip_id, round(avg(sentiment_score), 6) AS avg_sentiment, count(*) FILTER (u.mood = 'stressed') AS n_stressed, count(*) FILTER (sentiment <> text_sentiment) AS n_disagree, any_value(m.mood) AS mood FROM v_speech_utt u LEFT JOIN m USING (clip_id) GROUP BY 1""")
def a17(t):
    u = t.v_speech_utt
    return rounded(u.groupBy("clip_id").agg(F.avg("sentiment_score").alias("avg_sentiment"), F.count_if(F.col("mood") == "stressed").alias("n_stressed"), F.count_if(F.col("sentiment") != F.col("text_sentiment")).alias("n_disagree"), F.mode("mood", True).alias("mood")), "avg_sentiment")


@query("a18_attribution_split", "SELECT race_id, count(*) AS n, round(avg((profile_id IS NOT NULL)::INT::DOUBLE), 6) AS named, round(avg((profile_id IS NULL AND cluster_id IS NOT NULL)::INT::DOUBLE), 6) AS grouped, round(avg((profile_id IS NULL AND cluster_id IS NULL)::INT::DOUBLE), 6) AS unattributed FROM v_speech_utt JOIN v_clips USING (clip_id) GROUP BY 1")
def a18(t):
    p, c = F.col("profile_id").isNotNull(), F.col("cluster_id").isNotNull()
    share = lambda x: F.round(F.avg(x.cast("double")), 6)
    return t.v_speech_utt.join(t.v_clips.select("clip_id", "race_id"), "clip_id").groupBy("race_id").agg(F.count("*").alias("n"), share(p).alias("named"), share(~p & c).alias("grouped"), share(~p & ~c).alias("unattributed"))


@query("a19_live_groups", "SELECT clip_id, coalesce('p' || profile_id, 'c' || cluster_id, 'unclustered') AS voice, count(*) AS n_turns, count(*) FILTER (match_result = 'confident') AS n_confident, list(local_label ORDER BY local_label) AS turns FROM v_clip_speakers GROUP BY ALL")
def a19(t):
    voice = F.coalesce(F.concat(F.lit("p"), "profile_id"), F.concat(F.lit("c"), "cluster_id"), F.lit("unclustered")).alias("voice")
    return t.v_clip_speakers.groupBy("clip_id", voice).agg(F.count("*").alias("n_turns"), F.count_if(F.col("match_result") == "confident").alias("n_confident"), F.sort_array(F.collect_list("local_label")).alias("turns"))


@query("a20_pace", "SELECT session_key, driver_number, count(*) AS n_laps, min(duration_s) AS fastest, max(duration_s) AS slowest, list(duration_s ORDER BY duration_s)[count(*) // 2 + 1] AS median FROM v_laps WHERE duration_s IS NOT NULL GROUP BY ALL")
def a20(t):
    return r.pace(t.v_laps)


@query("a21_lap_notes", "SELECT session_key, driver_number, lap_number, min(duration_s) OVER w AS best_before, max(duration_s) OVER w AS worst_before, duration_s - min(duration_s) OVER w AS to_best FROM v_laps WINDOW w AS (PARTITION BY session_key, driver_number ORDER BY lap_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def a21(t):
    return r.lap_notes(t.v_laps).select("session_key", "driver_number", "lap_number", "best_before", "worst_before", "to_best")


@query("a22_event_counts", "SELECT event_type, count(*) AS n_read, count(*) FILTER (value < 20) AS n_declined FROM events GROUP BY 1")
def a22(t):
    """Events by type, read and declined."""
    return t.events.groupBy("event_type").agg(F.count("*").alias("n_read"), F.count_if(F.col("value") < 20).alias("n_declined"))


@query("a24_roster", """WITH s AS (SELECT session_key, circuit, year FROM v_sessions ORDER BY year DESC, session_key LIMIT 40)
  SELECT s.session_key, s.circuit, s.year, count(DISTINCT d.driver_number) AS n_drivers, string_agg(DISTINCT d.name, ', ' ORDER BY d.name) AS drivers, count(DISTINCT r.race_id) AS n_races FROM s LEFT JOIN v_drivers d USING (session_key) LEFT JOIN v_races r ON r.session_key = s.session_key AND r.race_id = d.driver_number GROUP BY ALL""")
def a24(t):
    """The latest 40 sessions with their drivers and races."""
    s = t.v_sessions.orderBy(F.desc("year"), "session_key").limit(40)
    d = t.v_drivers.groupBy("session_key").agg(F.countDistinct("driver_number").alias("n_drivers"), F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("drivers"))
    races = t.v_races.where("session_key IS NOT NULL").groupBy("session_key").agg(F.countDistinct("race_id").alias("n_races"))
    return s.join(d, "session_key", "left").join(races, "session_key", "left").select("session_key", "circuit", "year", F.coalesce("n_drivers", F.lit(0)).alias("n_drivers"), "drivers", F.coalesce("n_races", F.lit(0)).alias("n_races"))


@query("a25_stage_stats", """WITH x AS (SELECT json_extract_string(props, '$.k') AS outcome, 'v' || event_id % 3 AS version, s.stage, round(value * s.f, 3) AS s FROM events, (VALUES ('TRANSCRIBING', 1.0::DOUBLE), ('DIARIZING', 2.0::DOUBLE), ('EMBEDDING', 3.0::DOUBLE)) s(stage, f) WHERE s.stage <> 'EMBEDDING' OR event_id % 2 = 0)
  SELECT stage, outcome, version, count(*) AS n, round(avg(s), 9) AS mean_s, round(quantile_cont(round(s * 1000), 0.5) / 1000, 6) AS p50_s, round(quantile_cont(round(s * 1000), 0.95) / 1000, 6) AS p95_s, round(max(s), 6) AS max_s FROM x GROUP BY ALL""")
def a25(t):
    """Seconds by stage, outcome and model version, from the recorded maps of runs."""
    v = lambda f: F.round(F.col("value") * f, 3)
    made = F.to_json(F.struct(v(1.0).alias("TRANSCRIBING"), v(2.0).alias("DIARIZING"), F.when(F.col("event_id") % 2 == 0, v(3.0)).alias("EMBEDDING")))
    runs = t.events.select(F.get_json_object("props", "$.k").alias("outcome"), F.concat(F.lit("v"), F.col("event_id") % 3).alias("version"), made.alias("timings"))
    return rounded(r.stage_stats(runs), "p50_s", "p95_s", "max_s").withColumn("mean_s", F.round("mean_s", 9))


def montage_turns(t):
    return t.v_clip_speakers.selectExpr("clip_id", "local_label", "clip_id * 100 + local_label AS turn_id", "0D AS start_s", "speech_s * 0.5D AS end_s", "part % 5 = 0 AS is_overlap")


@query("a26_montage", """WITH RECURSIVE c AS (SELECT cluster_id, s.clip_id, clip_id * 100 + local_label AS turn_id, speech_s * 0.5::DOUBLE AS dur, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(-reliability, 1.0), -(speech_s * 0.5::DOUBLE), clip_id, clip_id * 100 + local_label) AS k
    FROM v_clip_speakers s WHERE cluster_id IS NOT NULL AND part % 5 <> 0 AND speech_s * 0.5::DOUBLE >= 0.4::DOUBLE AND speech_s * 0.5::DOUBLE <= 25),
  f AS (SELECT DISTINCT cluster_id, 0::BIGINT AS clip_id, 0::BIGINT AS turn_id, 0::DOUBLE AS dur, 0::BIGINT AS k, false AS fits, 0::DOUBLE AS t, []::STRUCT(c BIGINT, d DOUBLE)[] AS p FROM c
    UNION ALL SELECT cluster_id, clip_id, turn_id, dur, k, fits, CASE WHEN fits THEN t + dur ELSE t END, CASE WHEN fits THEN list_append(p, {'c': clip_id, 'd': dur}) ELSE p END
    FROM (SELECT c.*, f.t, f.p, f.t + c.dur <= 75 AND coalesce(list_sum([x.d for x in f.p if x.c = c.clip_id]), 0) + c.dur <= 25 AS fits FROM f JOIN c ON c.cluster_id = f.cluster_id AND c.k = f.k + 1))
  SELECT cluster_id, clip_id, turn_id, dur FROM f WHERE fits""")
def a26(t):
    return r.montage(t.v_clip_speakers.select("clip_id", "local_label", "cluster_id", "reliability"), montage_turns(t))


@query("a27_merge_preview", """WITH p AS (SELECT profile_id, count(*) AS n, sum(speech_s) AS s FROM v_enrollments GROUP BY 1)
  SELECT a.profile_id AS src, b.profile_id AS dst, a.n + b.n AS n_enrollments, a.s AS speech_added, a.s + b.s AS speech_s FROM p a JOIN p b ON b.profile_id = a.profile_id + 1""")
def a27(t):
    """What merging a profile into the next would add."""
    p = t.v_enrollments.groupBy("profile_id").agg(F.count("*").alias("n"), F.sum("speech_s").alias("s"))
    q = p.select((F.col("profile_id") - 1).alias("profile_id"), F.col("n").alias("n2"), F.col("s").alias("s2"))
    return p.join(q, "profile_id").select(F.col("profile_id").alias("src"), (F.col("profile_id") + 1).alias("dst"), (F.col("n") + F.col("n2")).alias("n_enrollments"), F.col("s").alias("speech_added"), (F.col("s") + F.col("s2")).alias("speech_s"))


@query("a28_filing_progress", "SELECT race_id, count(*) AS n_filed, count(*) FILTER (status = 'QUEUED') AS n_waiting, round(avg((status <> 'QUEUED')::INT::DOUBLE), 6) AS processed, count(*) FILTER (needs_review) AS n_flagged FROM v_clips GROUP BY 1")
def a28(t):
    q = F.col("status") == "QUEUED"
    return t.v_clips.groupBy("race_id").agg(F.count("*").alias("n_filed"), F.count_if(q).alias("n_waiting"), F.round(F.avg((~q).cast("double")), 6).alias("processed"), F.count_if("needs_review").alias("n_flagged"))
