"""Queries on words, turns and regions, and the attributed transcript."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..params import DEFAULTS as P
from .registry import query

#: Bucket widths that suit the seconds of words and the hours of the event-shaped turns.
WORDS, HOURS = 10.0, 6 * 3600.0
#: Round to what sums in any order agree on.
R = 6

ASSIGN = """pairs AS (SELECT w.clip_id, w.word_id, t.label, t.start_s AS ts, t.turn_id, least(w.end_s, t.end_s) - greatest(w.start_s, t.start_s) AS ov, w.end_s - w.start_s AS d
    FROM v_words w JOIN v_word_turns t ON w.clip_id = t.clip_id AND w.start_s < t.end_s AND t.start_s < w.end_s),
  best AS (SELECT clip_id, word_id, label, least(1.0, ov / greatest(d, 1e-6)) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, word_id ORDER BY ov DESC, ts, turn_id) AS n FROM pairs) WHERE n = 1),
  lost AS (SELECT w.clip_id, w.word_id, (w.start_s + w.end_s) / 2 AS mid FROM v_words w ANTI JOIN best b ON w.clip_id = b.clip_id AND w.word_id = b.word_id),
  near AS (SELECT clip_id, word_id, label FROM (SELECT l.clip_id, l.word_id, t.label, row_number() OVER (PARTITION BY l.clip_id, l.word_id ORDER BY abs((t.start_s + t.end_s) / 2 - l.mid), t.start_s, t.turn_id) AS n
    FROM lost l JOIN v_word_turns t ON l.clip_id = t.clip_id) WHERE n = 1),
  assigned AS (SELECT w.*, coalesce(b.label, n.label, 'SPEAKER_00') AS speaker, coalesce(b.conf, 0) AS speaker_conf FROM v_words w LEFT JOIN best b ON w.clip_id = b.clip_id AND w.word_id = b.word_id LEFT JOIN near n ON w.clip_id = n.clip_id AND w.word_id = n.word_id)"""
SMOOTH = """raws AS (SELECT *, lag(speaker) OVER o AS bef, coalesce(speaker <> lag(speaker) OVER o AND lag(speaker) OVER o = lead(speaker) OVER o AND speaker_conf < 0.6, false) AS raw, row_number() OVER o AS n FROM assigned WINDOW o AS (PARTITION BY clip_id ORDER BY start_s, word_id)),
  odd AS (SELECT *, raw AND (n - coalesce(max(CASE WHEN NOT raw THEN n END) OVER (PARTITION BY clip_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS smoothed FROM raws),
  smoothed_words AS (SELECT * EXCLUDE (speaker, bef, raw, n), CASE WHEN smoothed THEN bef ELSE speaker END AS speaker FROM odd)"""
REGROUP = r"""flags AS (SELECT *, CASE WHEN lag(speaker) OVER o <> speaker OR (regexp_matches(lag(word) OVER o, '[.?!。؟]\s*$') AND start_s - lag(end_s) OVER o > 0.35) THEN 1 ELSE 0 END AS new FROM smoothed_words WINDOW o AS (PARTITION BY clip_id ORDER BY start_s, word_id)),
  grouped AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY start_s, word_id ROWS UNBOUNDED PRECEDING)::BIGINT AS utt FROM flags)"""
FINAL = """SELECT clip_id, utt, any_value(speaker) AS speaker, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s, string_agg(word, ' ' ORDER BY start_s, word_id) AS text, count(*) AS n_words,
  round(avg(probability), 6) AS confidence, round(avg(speaker_conf), 6) AS speaker_conf FROM grouped GROUP BY clip_id, utt"""


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, R) for c in cols})


def attributed(t):
    return iv.smooth(iv.assign_words(t.v_words, t.v_word_turns, WORDS), P.smooth_conf)


@query("transcript", f"WITH {ASSIGN}, {SMOOTH}, {REGROUP} {FINAL}")
def transcript(t):
    """Words to turns, smoothed, regrouped into utterances."""
    made = iv.finalize(iv.regroup(attributed(t), P.utterance_gap_s)).drop("overlap_ratio")
    return rounded(made, "start_s", "end_s", "confidence", "speaker_conf")


@query("j01_word_turn", f"WITH {ASSIGN} SELECT clip_id, word_id, speaker, round(speaker_conf, 6) AS speaker_conf FROM assigned")
def j01(t):
    return rounded(iv.assign_words(t.v_words, t.v_word_turns, WORDS).select("clip_id", "word_id", "speaker", "speaker_conf"), "speaker_conf")


@query("j02_nearest_turn", """WITH pts AS (SELECT clip_id, word_id, (start_s + end_s) / 2 AS mid FROM v_words)
  SELECT clip_id, word_id, label FROM (SELECT p.clip_id, p.word_id, t.label, row_number() OVER (PARTITION BY p.clip_id, p.word_id ORDER BY abs((t.start_s + t.end_s) / 2 - p.mid), t.start_s, t.turn_id) AS n FROM pts p JOIN v_word_turns t ON p.clip_id = t.clip_id) WHERE n = 1""")
def j02(t):
    return iv.nearest_turn(t.v_words, t.v_word_turns).select("clip_id", "word_id", "turn.label")


@query("j03_phantoms", """SELECT clip_id, turn_id FROM v_word_turns a WHERE NOT EXISTS (SELECT 1 FROM v_word_turns b WHERE a.clip_id = b.clip_id AND a.label <> b.label AND b.start_s >= a.start_s - 0.3::DOUBLE AND b.start_s <= a.start_s + 0.3::DOUBLE
  AND b.end_s - b.start_s > a.end_s - a.start_s AND a.end_s - a.start_s < 0.6::DOUBLE * (b.end_s - b.start_s))""")
def j03(t):
    return iv.drop_phantoms(t.v_word_turns).select("clip_id", "turn_id")


@query("j04_overlap_flag", """SELECT clip_id, turn_id, EXISTS (SELECT 1 FROM v_turns b WHERE a.clip_id = b.clip_id AND a.label <> b.label AND a.start_s < b.end_s AND b.start_s < a.end_s) AS is_overlap FROM v_turns a""")
def j04(t):
    return iv.flag_overlaps(t.v_turns, t.v_turns, HOURS).select("clip_id", "turn_id", "is_overlap")


@query("j05_short_overlap", """WITH s AS (SELECT * FROM v_turns WHERE end_s - start_s < 6000), l AS (SELECT * FROM v_turns WHERE end_s - start_s >= 6000)
  SELECT clip_id, turn_id, EXISTS (SELECT 1 FROM l WHERE s.clip_id = l.clip_id AND s.label <> l.label AND s.start_s < l.end_s AND l.start_s < s.end_s) AS is_overlap FROM s""")
def j05(t):
    short, long = t.v_turns.where("end_s - start_s < 6000"), t.v_turns.where("end_s - start_s >= 6000")
    return iv.flag_overlaps(short, long, HOURS).select("clip_id", "turn_id", "is_overlap")


SNAP_TOL = 3600.0


@query("j06_snap", """WITH edges AS (SELECT clip_id, start_s AS e FROM v_vad UNION SELECT clip_id, end_s FROM v_vad),
  s AS (SELECT clip_id, turn_id, e FROM (SELECT t.clip_id, turn_id, e, row_number() OVER (PARTITION BY t.clip_id, turn_id ORDER BY abs(e - start_s), e) AS n FROM v_turns t JOIN edges USING (clip_id) WHERE abs(e - start_s) <= 3600) WHERE n = 1),
  d AS (SELECT clip_id, turn_id, e FROM (SELECT t.clip_id, turn_id, e, row_number() OVER (PARTITION BY t.clip_id, turn_id ORDER BY abs(e - end_s), e) AS n FROM v_turns t JOIN edges USING (clip_id) WHERE abs(e - end_s) <= 3600) WHERE n = 1),
  m AS (SELECT clip_id, turn_id, coalesce(s.e, start_s) AS a, coalesce(d.e, end_s) AS b, s.e IS NOT NULL OR d.e IS NOT NULL AS snapped FROM v_turns LEFT JOIN s USING (clip_id, turn_id) LEFT JOIN d USING (clip_id, turn_id))
  SELECT clip_id, turn_id, round(a, 6) AS start_s, round(CASE WHEN b <= a THEN a + 0.05 ELSE b END, 6) AS end_s, snapped FROM m""")
def j06(t):
    return rounded(iv.snap(t.v_turns, t.v_vad, SNAP_TOL).select("clip_id", "turn_id", "start_s", "end_s", "snapped"), "start_s", "end_s")


@query("j07_interruptions", """SELECT clip_id, label, count(*) FILTER (EXISTS (SELECT 1 FROM v_turns b WHERE a.clip_id = b.clip_id AND a.label <> b.label AND b.start_s < a.start_s AND a.start_s < b.end_s)) AS n FROM v_turns a GROUP BY clip_id, label""")
def j07(t):
    return iv.interruptions(t.v_turns, HOURS)


@query("j08_drop_words", """SELECT clip_id, word_id FROM v_words w WHERE NOT EXISTS (SELECT 1 FROM v_utterances s WHERE s.clip_id = w.clip_id AND s.utterance_id % 3 = 0 AND w.start_s >= s.start_s + 1 AND w.start_s < s.end_s)""")
def j08(t):
    bad = t.v_utterances.where("utterance_id % 3 = 0").selectExpr("clip_id", "start_s + 1 AS start_s", "end_s")
    return iv.inside(t.v_words, bad, "start_s", WORDS, "left_anti").select("clip_id", "word_id")


@query("j09_tag_frames", "SELECT clip_id, frame_id, EXISTS (SELECT 1 FROM v_vad v WHERE v.clip_id = f.clip_id AND f.at_s >= v.start_s AND f.at_s < v.end_s) AS in_speech FROM v_frames f")
def j09(t):
    return iv.tag_frames(t.v_frames, t.v_vad, HOURS).select("clip_id", "frame_id", "in_speech")


MERGED = """m_runs AS (SELECT *, sum(CASE WHEN pl = label THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY start_s, turn_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(label) OVER (PARTITION BY clip_id ORDER BY start_s, turn_id) AS pl FROM {src})),
  m_marks AS (SELECT *, max(end_s) OVER (PARTITION BY clip_id, run ORDER BY start_s, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM m_runs),
  m_isl AS (SELECT *, sum(CASE WHEN start_s - prior > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, run ORDER BY start_s, turn_id ROWS UNBOUNDED PRECEDING) AS isl FROM m_marks),
  merged AS (SELECT clip_id, arg_min(turn_id, {{'s': start_s, 't': turn_id}}) AS turn_id, any_value(label) AS label, min(start_s) AS start_s, max(end_s) AS end_s FROM m_isl GROUP BY clip_id, run, isl)"""


@query("w04_merge_adjacent", "WITH " + MERGED.format(src="v_turns", gap="7200") + " SELECT clip_id, turn_id, label, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM merged")
def w04(t):
    return rounded(iv.merge_adjacent(t.v_turns, 7200.0), "start_s", "end_s")


@query("w05_smooth", f"WITH {ASSIGN}, {SMOOTH} SELECT clip_id, word_id, speaker, smoothed FROM smoothed_words")
def w05(t):
    return attributed(t).select("clip_id", "word_id", "speaker", "smoothed")


@query("w06_regroup", f"WITH {ASSIGN}, {SMOOTH}, {REGROUP} SELECT clip_id, word_id, utt FROM grouped")
def w06(t):
    return iv.regroup(attributed(t), P.utterance_gap_s).select("clip_id", "word_id", "utt")


@query("a10_finalize", """SELECT clip_id, idx AS utt, any_value(local_label) AS speaker, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s, string_agg(word, ' ' ORDER BY start_s, word_id) AS text, count(*) AS n_words,
  round(avg(probability), 6) AS confidence, round(avg(probability - 0.1), 6) AS speaker_conf, round(avg(CASE WHEN word_ix % 4 = 0 THEN 1.0 ELSE 0.0 END), 6) AS overlap_ratio FROM v_words GROUP BY clip_id, idx""")
def a10(t):
    words = t.v_words.withColumns({"utt": F.col("idx"), "speaker": F.col("local_label"), "speaker_conf": F.col("probability") - 0.1, "in_overlap": F.col("word_ix") % 4 == 0})
    return rounded(iv.finalize(words), "start_s", "end_s", "confidence", "speaker_conf", "overlap_ratio")


@query("w18_clean_turns", """WITH raw AS (SELECT * FROM v_word_turns), lng AS (SELECT * FROM raw WHERE end_s - start_s >= 0.4::DOUBLE), vad AS (SELECT clip_id, start_s + 0.2::DOUBLE AS start_s, end_s FROM v_utterances),
  kept AS (SELECT * FROM lng a WHERE NOT EXISTS (SELECT 1 FROM lng b WHERE a.clip_id = b.clip_id AND a.label <> b.label AND b.start_s >= a.start_s - 0.3::DOUBLE AND b.start_s <= a.start_s + 0.3::DOUBLE AND b.end_s - b.start_s > a.end_s - a.start_s AND a.end_s - a.start_s < 0.6::DOUBLE * (b.end_s - b.start_s))),
  """ + MERGED.format(src="kept", gap="0.6::DOUBLE") + """,
  flagged AS (SELECT *, EXISTS (SELECT 1 FROM merged b WHERE a.clip_id = b.clip_id AND a.label <> b.label AND a.start_s < b.end_s AND b.start_s < a.end_s) AS is_overlap FROM merged a),
  edges AS (SELECT clip_id, start_s AS e FROM vad UNION SELECT clip_id, end_s FROM vad),
  s AS (SELECT clip_id, turn_id, e FROM (SELECT t.clip_id, turn_id, e, row_number() OVER (PARTITION BY t.clip_id, turn_id ORDER BY abs(e - start_s), e) AS n FROM flagged t JOIN edges USING (clip_id) WHERE abs(e - start_s) <= 0.15::DOUBLE) WHERE n = 1),
  d AS (SELECT clip_id, turn_id, e FROM (SELECT t.clip_id, turn_id, e, row_number() OVER (PARTITION BY t.clip_id, turn_id ORDER BY abs(e - end_s), e) AS n FROM flagged t JOIN edges USING (clip_id) WHERE abs(e - end_s) <= 0.15::DOUBLE) WHERE n = 1),
  m AS (SELECT clip_id, turn_id, label, is_overlap, coalesce(s.e, start_s) AS a, coalesce(d.e, end_s) AS b, s.e IS NOT NULL OR d.e IS NOT NULL AS snapped FROM flagged LEFT JOIN s USING (clip_id, turn_id) LEFT JOIN d USING (clip_id, turn_id)),
  longs AS (SELECT * FROM (SELECT clip_id, turn_id, label, is_overlap, a AS start_s, CASE WHEN b <= a THEN a + 0.05::DOUBLE ELSE b END AS end_s, snapped, false AS too_short FROM m) WHERE end_s - start_s >= 0.4::DOUBLE),
  shorts AS (SELECT clip_id, turn_id, label, EXISTS (SELECT 1 FROM longs b WHERE a.clip_id = b.clip_id AND a.label <> b.label AND a.start_s < b.end_s AND b.start_s < a.end_s) AS is_overlap, start_s, end_s, false AS snapped, true AS too_short FROM raw a WHERE end_s - start_s < 0.4::DOUBLE)
  SELECT clip_id, turn_id, label, is_overlap, snapped, too_short, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, row_number() OVER (PARTITION BY clip_id ORDER BY start_s, too_short, turn_id) - 1 AS idx FROM (SELECT * FROM longs UNION ALL SELECT * FROM shorts)""")
def w18(t):
    regions = t.v_utterances.selectExpr("clip_id", "start_s + 0.2D AS start_s", "end_s")
    return rounded(iv.clean_turns(t.v_word_turns, regions, WORDS), "start_s", "end_s")
