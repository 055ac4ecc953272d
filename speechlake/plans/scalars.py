"""Queries of predicates, scores and filters."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import scoring as s
from ..functions.filters import filter_rows, page
from .intervals import rounded
from .registry import query

#: Measures of a recording per event, for the rules below.
PROBES = """SELECT event_id, (floor(value * 100)::BIGINT * 37 % 500000) / 100.0::DOUBLE AS dur, (floor(value * 100)::BIGINT * 37 % 500000) / 100.0::DOUBLE * (0.8 + event_id % 5 * 0.1) AS header, event_id % 11 <> 0 AS audio,
  (event_id % 31)::DOUBLE AS snr, (event_id % 7) / 100.0::DOUBLE AS clip, (3000 + event_id * 13 % 2000)::DOUBLE AS bw, (event_id % 10) / 10.0::DOUBLE AS flat, (event_id % 17) / 10.0::DOUBLE AS voiced, (event_id % 60) / 10.0::DOUBLE AS rate, (event_id * 7 % 60)::DOUBLE AS pstd, (event_id * 31 % 201 - 100) / 100.0::DOUBLE AS score FROM events"""


def probes(t):
    return t.events.selectExpr(
        "event_id", "cast(floor(value * 100) AS bigint) * 37 % 500000 / 100D AS dur", "cast(floor(value * 100) AS bigint) * 37 % 500000 / 100D * (0.8D + event_id % 5 * 0.1D) AS header", "event_id % 11 <> 0 AS audio",
        "cast(event_id % 31 AS double) AS snr", "event_id % 7 / 100D AS clip", "cast(3000 + event_id * 13 % 2000 AS double) AS bw", "event_id % 10 / 10D AS flat", "event_id % 17 / 10D AS voiced", "event_id % 60 / 10D AS rate", "cast(event_id * 7 % 60 AS double) AS pstd", "(event_id * 31 % 201 - 100) / 100D AS score",
    )


C = F.col


@query("p01_validate", f"""WITH p AS ({PROBES}), c AS (SELECT *, CASE WHEN NOT audio THEN 'NO_AUDIO_STREAM' WHEN dur > 3600 THEN 'TOO_LONG' WHEN dur < 0.5 THEN 'TOO_SHORT' WHEN header <> 0 AND abs(header - dur) / greatest(dur, 1e-6) > 0.10 THEN 'CORRUPT' ELSE 'OK' END AS code FROM p)
  SELECT event_id, code, CASE WHEN code IN ('OK', 'CORRUPT') AND dur > 60 THEN ['ABOVE_TARGET_DURATION'] ELSE []::VARCHAR[] END AS warnings FROM c""")
def p01(t):
    code, warnings = s.validation(C("audio"), C("dur"), C("header"))
    return probes(t).select("event_id", code.alias("code"), warnings.alias("warnings"))


@query("p02_speech_gate", f"SELECT event_id, CASE WHEN rate >= 0.5 THEN 'OK' WHEN flat < 0.4 THEN 'NO_SPEECH_DETECTED' ELSE 'INSUFFICIENT_SPEECH' END AS gate FROM ({PROBES})")
def p02(t):
    return probes(t).select("event_id", s.speech_gate(C("rate"), C("flat")).alias("gate"))


@query("p03_grade", f"SELECT event_id, CASE WHEN snr >= 18 AND clip <= 0.02 AND bw >= 3400 THEN 'good' WHEN snr >= 10 THEN 'fair' ELSE 'poor' END AS grade FROM ({PROBES})")
def p03(t):
    return probes(t).select("event_id", s.quality_grade(C("snr"), C("clip"), C("bw")).alias("grade"))


REL = "sqrt(least(1, rate / 8)) * (0.5 + 0.5 * (0.5 * greatest(0, least(1, (snr - 5) / 20)) + 0.3 * (1 - least(1, clip * 20)) + 0.2 * greatest(0, least(1, (bw - 3000) / 5000))))"


@query("p04_reliability", f"SELECT event_id, round({REL}, 6) AS reliability FROM ({PROBES})")
def p04(t):
    return rounded(probes(t).select("event_id", s.reliability(C("rate"), C("snr"), C("clip"), C("bw")).alias("reliability")), "reliability")


@query("p05_band", f"SELECT event_id, CASE WHEN r >= 0.75 THEN 'good' WHEN r >= 0.45 THEN 'fair' WHEN r >= 0.2 THEN 'poor' ELSE 'unusable' END AS band FROM (SELECT *, {REL} AS r FROM ({PROBES}))")
def p05(t):
    return probes(t).select("event_id", s.reliability_band(s.reliability(C("rate"), C("snr"), C("clip"), C("bw"))).alias("band"))


@query("p06_parse_time", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts)) WHEN 2 THEN epoch_us(date_trunc('second', ts)) - 7200000000 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN epoch_us(ts) ELSE epoch_us(date_trunc('day', ts)) END AS at_us FROM events""")
def p06(t):
    base, iso = C("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = C("event_id") % 7
    text = F.when(k == 0, iso).when(k == 1, F.concat(iso, F.lit("Z"))).when(k == 2, F.concat(iso, F.lit("+02:00"))).when(k == 3, "").when(k == 4, "soon").when(k == 5, F.date_format(base, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.date_format(base, "yyyy-MM-dd"))
    return t.events.select("event_id", F.unix_micros(s.parse_time(text)).alias("at_us"))


@query("p07_segment_rank", f"WITH q AS (SELECT event_id, dur, 0.6 * greatest(0, least(1, (snr - 5) / 20)) + 0.4 * (1 - least(1, clip * 20)) AS quality FROM ({PROBES})) SELECT event_id, round(quality, 6) AS quality, round(dur * (0.5 + 0.5 * quality), 5) AS rank FROM q")
def p07(t):
    q = s.segment_quality(C("snr"), C("clip"))
    return probes(t).select("event_id", F.round(q, 6).alias("quality"), F.round(C("dur") * (0.5 + 0.5 * q), 5).alias("rank"))


@F.pandas_udf(DoubleType())
def compression(text: pd.Series) -> pd.Series:
    """Length of a text's bytes over their zlib-compressed length."""
    raw = text.fillna("").map(str.encode)
    return raw.map(len) / raw.map(lambda b: max(len(zlib.compress(b)), 1))


def hallucinations(text: Column, no_speech: Column, logprob: Column) -> Column:
    """Reasons to distrust a recognised segment."""
    low = F.lower(F.trim(text))
    return F.array_compact(F.array(F.when((no_speech > 0.85) & (logprob < -0.9), "no_speech"), F.when((F.length(low) > 12) & (compression(low) > 2.4), "repetitive"), F.when(low.isin(*s.BOILERPLATE), "boilerplate")))


@query("p08_hallucination_rules", """SELECT utterance_id, (utterance_id % 100) / 100.0 > 0.85 AND -(utterance_id % 17) / 10.0 < -0.9 AS no_speech, lower(trim(CASE WHEN utterance_id % 9 = 0 THEN ' Thank you. ' ELSE text END)) IN ('thank you.', 'thanks for watching!', 'you', 'bye.', 'subtitles by the amara.org community', '♪') AS boilerplate FROM v_utterances""")
def p08(t):
    u = t.v_utterances.withColumn("text", F.when(C("utterance_id") % 9 == 0, " Thank you. ").otherwise(C("text")))
    why = hallucinations(C("text"), C("utterance_id") % 100 / 100, -(C("utterance_id") % 17) / 10)
    return u.select("utterance_id", F.array_contains(why, "no_speech").alias("no_speech"), F.array_contains(why, "boilerplate").alias("boilerplate"))


@query("p08_repetitive")
def p08_repetitive(t):
    """Texts that zlib shrinks too well, which SQL cannot say."""
    text = F.when(C("utterance_id") % 9 == 0, F.repeat(F.lit("go go "), 12)).otherwise(C("text"))
    return t.v_utterances.select("utterance_id", F.array_contains(hallucinations(text, F.lit(0.0), F.lit(0.0)), "repetitive").alias("repetitive"))


PHRASES = ", ".join(f"'{p}'" for p in s.PROTOCOL_PHRASES)
TOKENS = ", ".join(f"'{p}'" for p in s.PROTOCOL_TOKENS)
#: A phrase, or procedure talk here and there, so that the rules have something to find.
SAID_SQL = "CASE utterance_id % 60 WHEN 0 THEN 'Box, box!' WHEN 1 THEN 'Copy that.' WHEN 2 THEN 'ok yes' WHEN 3 THEN '...' ELSE text END"
PROTOCOL_SQL = f"""len(regexp_extract_all(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g'), '\\S+')) = 0 OR array_to_string(regexp_extract_all(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g'), '\\S+'), ' ') IN ({PHRASES})
  OR len(list_filter(regexp_extract_all(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g'), '\\S+'), lambda w: w NOT IN ({TOKENS}))) = 0"""


def said(t):
    k = C("utterance_id") % 60
    return t.v_phrases.withColumn("x", F.when(k == 0, "Box, box!").when(k == 1, "Copy that.").when(k == 2, "ok yes").when(k == 3, "...").otherwise(C("text")))


@query("p09_protocol", f"SELECT utterance_id, {PROTOCOL_SQL} AS protocol FROM (SELECT utterance_id, {SAID_SQL} AS x FROM v_phrases)")
def p09(t):
    return said(t).select("utterance_id", s.is_protocol(C("x")).alias("protocol"))


LABELS = ["Positive", "LABEL_0", "label_1", "LABEL_2", "Very Negative", " neutral ", "Very Positive"]
LABEL_SQL = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS)) + " END"


def labelled(t):
    return probes(t).withColumn("lbl", F.element_at(F.lit(LABELS), (C("event_id") % 7 + 1).cast("int")))


@query("p10_signed", f"""WITH l AS (SELECT event_id, score, replace(lower(trim({LABEL_SQL})), '_', ' ') AS x FROM ({PROBES})), n AS (SELECT event_id, abs(score) AS a, CASE WHEN x = 'label 0' THEN 'negative' WHEN x = 'label 1' THEN 'neutral' WHEN x = 'label 2' THEN 'positive' WHEN contains(x, 'negative') THEN 'negative' WHEN contains(x, 'positive') THEN 'positive' ELSE 'neutral' END AS label FROM l)
  SELECT event_id, label, CASE label WHEN 'positive' THEN a WHEN 'negative' THEN -a ELSE 0 END AS signed FROM n""")
def p10(t):
    return labelled(t).select("event_id", s.plain_label(C("lbl")).alias("label"), s.signed_score(C("lbl"), F.abs("score")).alias("signed"))


@query("p11_band_label", f"SELECT event_id, CASE WHEN score > 0.20 THEN 'positive' WHEN score < -0.20 THEN 'negative' ELSE 'neutral' END AS label FROM ({PROBES})")
def p11(t):
    return probes(t).select("event_id", s.band_label(C("score")).alias("label"))


MOOD = "CASE event_id % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'stressed' WHEN 2 THEN 'tired' END"


@query("p12_fuse", f"""WITH f AS (SELECT event_id, CASE WHEN mood IS NULL THEN score ELSE greatest(-1, least(1, score + CASE mood WHEN 'stressed' THEN -0.18 WHEN 'tired' THEN -0.10 ELSE 0.03 END)) END AS fused FROM (SELECT event_id, score, {MOOD} AS mood FROM ({PROBES})))
  SELECT event_id, CASE WHEN round(fused, 9) > 0.2 THEN 'positive' WHEN round(fused, 9) < -0.2 THEN 'negative' ELSE 'neutral' END AS label, round(fused, 3) AS score FROM f""")
def p12(t):
    fused = s.fused_score(C("score"), F.expr("CASE event_id % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'stressed' WHEN 2 THEN 'tired' END"))
    return probes(t).select("event_id", s.band_label(F.round(fused, 9)).alias("label"), F.round(fused, 3).alias("score"))


@query("p13_tone", f"""SELECT event_id, CASE WHEN voiced < 0.15 THEN 'calm' WHEN rate < 1.8 AND pstd < 15 THEN 'tired' WHEN rate > 3.8 OR pstd > 40 THEN 'stressed' ELSE 'calm' END AS tone,
  CASE WHEN voiced < 0.15 THEN 'calm' WHEN rate < 3 * 0.55 AND pstd < 25 * 0.6 THEN 'tired' WHEN rate > 3 * 1.45 OR pstd > 25 * 1.8 THEN 'stressed' ELSE 'calm' END AS own_tone FROM ({PROBES})""")
def p13(t):
    base = {"n": F.lit(4), "pitch_mean": F.lit(180.0), "pitch_std": F.lit(25.0), "rate": F.lit(3.0)}
    return probes(t).select("event_id", s.tone(C("voiced"), C("rate"), C("pstd")).alias("tone"), s.tone(C("voiced"), C("rate"), C("pstd"), base).alias("own_tone"))


@query("p14_too_short", "SELECT utterance_id, n_words < 6 AS too_short FROM v_phrases")
def p14(t):
    return t.v_phrases.select("utterance_id", s.too_short(C("text"), 6).alias("too_short"))


@query("p15_filter", "SELECT utterance_id FROM v_speech_utt WHERE mood = 'stressed' AND sentiment = 'negative' AND cluster_id IS NOT NULL AND text ILIKE '%part 1%'")
def p15(t):
    return filter_rows(t.v_speech_utt, mood="stressed", sentiment="negative", has_cluster=True, text="part 1").select("utterance_id")


ARGS = "CASE event_id % 8 WHEN 0 THEN ' None ' WHEN 1 THEN 'null' WHEN 2 THEN NULL WHEN 3 THEN 'N/A' WHEN 4 THEN 'calls that sound Stressed' WHEN 5 THEN 'a distressed voice' WHEN 6 THEN 'fatigued or calm' ELSE event_type END"


@query("p16_clean_args", f"""SELECT event_id, x IS NULL OR lower(trim(x)) IN ('', 'null', 'none', 'undefined', 'nil', 'n/a', 'na', '-') AS absent,
  CASE WHEN regexp_matches(x, '(?i)\\b(stressed|stress|stressful)\\b') THEN 'stressed' WHEN regexp_matches(x, '(?i)\\b(calm|relaxed)\\b') THEN 'calm' WHEN regexp_matches(x, '(?i)\\b(tired|fatigued|exhausted)\\b') THEN 'tired' END AS tone FROM (SELECT event_id, {ARGS} AS x FROM events)""")
def p16(t):
    e = t.events.selectExpr("event_id", f"{ARGS} AS x")
    return e.select("event_id", s.is_placeholder(C("x")).alias("absent"), s.tone_word(C("x")).alias("tone"))


@query("p17_list_clips", "WITH f AS (SELECT * FROM v_clips WHERE status = 'COMPLETE' AND needs_review AND filename ILIKE '%1%') SELECT clip_id, filename, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, clip_id LIMIT 20 OFFSET 5")
def p17(t):
    found = filter_rows(t.v_clips, status="COMPLETE", needs_review=True, filename="1")
    return page(found, [F.desc("created_at"), "clip_id"], 20, 5).select("clip_id", "filename", F.lit(found.count()).alias("total"))


@query("p18_moments", "SELECT clip_id, utterance_id, n FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY idx) AS n FROM v_speech_utt WHERE trim(text) <> '' AND (text_sentiment <> sentiment OR coalesce(profile_id, cluster_id) IS NULL OR mood = 'stressed')) WHERE n <= 8")
def p18(t):
    u = t.v_speech_utt.where("trim(text) <> '' AND (text_sentiment <> sentiment OR coalesce(profile_id, cluster_id) IS NULL OR mood = 'stressed')")
    return u.withColumn("n", F.row_number().over(Window.partitionBy("clip_id").orderBy("idx"))).where("n <= 8").select("clip_id", "utterance_id", "n")


@query("p19_needs_review", """SELECT clip_id, bool_or(match_result IN ('suggested', 'abstained')) AS unsure, bool_or(reliability < 0.45) AS weak, bool_or(match_result IN ('suggested', 'abstained') OR reliability < 0.45) OR any_value(grade) = 'poor' AS needs_review FROM v_clip_speakers JOIN v_clips USING (clip_id) GROUP BY 1""")
def p19(t):
    unsure, weak = C("match_result").isin("suggested", "abstained"), C("reliability") < 0.45
    per = t.v_clip_speakers.groupBy("clip_id").agg(F.bool_or(unsure).alias("unsure"), F.bool_or(weak).alias("weak"))
    made = per.join(t.v_clips.select("clip_id", "grade"), "clip_id")
    return made.select("clip_id", "unsure", "weak", (C("unsure") | C("weak") | (C("grade") == "poor")).alias("needs_review"))


@query("p20_name_search", "SELECT 'profile' AS kind, profile_id AS id, name FROM v_profiles_named WHERE name ILIKE '%0_1%' UNION ALL SELECT 'race', race_id, name FROM v_races WHERE name ILIKE '%0_1%'")
def p20(t):
    p = filter_rows(t.v_profiles_named, name="0_1").select(F.lit("profile").alias("kind"), C("profile_id").alias("id"), "name")
    return p.unionByName(filter_rows(t.v_races, name="0_1").select(F.lit("race").alias("kind"), C("race_id").alias("id"), "name"))


@query("p21_tone_phrase", "SELECT utterance_id, concat_ws(', ', 'voice reads ' || mood, 'words read ' || sentiment || ' (' || CASE WHEN sentiment_score < 0 THEN '-' ELSE '+' END || printf('%.2f', abs(sentiment_score)) || ')', CASE WHEN text_sentiment <> sentiment THEN 'text alone reads ' || text_sentiment END) AS phrase FROM v_speech_utt")
def p21(t):
    return t.v_speech_utt.select("utterance_id", s.tone_phrase(C("mood"), C("sentiment"), C("sentiment_score"), C("text_sentiment")).alias("phrase"))


@query("p22_corrections", "SELECT actor, seq, action, object FROM v_audit WHERE action = 'purchase' AND day > '2024-01-20' AND day <= '2024-01-27'")
def p22(t):
    """Corrections of the seven days before a date."""
    return t.v_audit.where("action = 'purchase' AND day > date_sub(date'2024-01-27', 7) AND day <= date'2024-01-27'").select("actor", "seq", "action", "object")


@query("p23_flagged", "SELECT clip_id, arg_max(utterance_id, idx) AS newest, count(*) AS n FROM v_speech_utt WHERE CASE WHEN sentiment IS NOT NULL AND clip_id % 2 = 0 THEN sentiment = 'negative' ELSE mood IS NOT NULL AND mood <> 'calm' END GROUP BY 1")
def p23(t):
    """Turns that read negative (by mood, where no sentiment is known) and the newest of each clip."""
    known = F.when(C("clip_id") % 2 == 0, C("sentiment"))
    flag = F.when(known.isNotNull(), known == "negative").otherwise(C("mood").isNotNull() & (C("mood") != "calm"))
    return t.v_speech_utt.where(flag).groupBy("clip_id").agg(F.max_by("utterance_id", "idx").alias("newest"), F.count("*").alias("n"))


@query("p24_unclaimed_clusters", "SELECT cluster_id, count(*) AS n_members, sum(speech_s) AS speech_s FROM v_clip_speakers WHERE cluster_id IS NOT NULL AND cluster_id % 3 <> 0 GROUP BY 1 ORDER BY 3 DESC, 1")
def p24(t):
    return t.v_clip_speakers.where("cluster_id IS NOT NULL AND cluster_id % 3 <> 0").groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.sum("speech_s").alias("speech_s")).orderBy(F.desc("speech_s"), "cluster_id")


@query("p25_cohesion_band", f"SELECT event_id, CASE WHEN flat >= 0.7 THEN 'tight' WHEN flat >= 0.5 THEN 'fair' ELSE 'loose' END AS band, flat < 0.55 AS low FROM ({PROBES})")
def p25(t):
    x = C("flat")
    return probes(t).select("event_id", F.when(x >= 0.7, "tight").when(x >= 0.5, "fair").otherwise("loose").alias("band"), (x < 0.55).alias("low"))


@query("p26_analyses", "SELECT call_id, mood, recorded_s FROM v_radio WHERE session_key = 3 AND analyzed_s IS NOT NULL AND error IS NULL")
def p26(t):
    return t.v_radio.where("session_key = 3 AND analyzed_s IS NOT NULL AND error IS NULL").select("call_id", "mood", "recorded_s")
