"""Queries of rows in order, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.filters import page, topk_per_key
from ..functions.scoring import band_label
from ..functions.citations import cited_ids
from ..operators import sequences as q
from ..operators.ranks import global_ranks
from .intervals import rounded
from .registry import query
from .scalars import PROBES, PROTOCOL_SQL, probes

C = F.col


@query("w01_utterance_next", "SELECT * FROM (SELECT lag(utterance_id) OVER (PARTITION BY clip_id ORDER BY idx) AS src, utterance_id AS dst FROM v_utterances) WHERE src IS NOT NULL")
def w01(t):
    return q.next_edges(t.v_utterances, ["clip_id"], ["idx"], "utterance_id")


def lap_ids(t):
    return t.v_laps.withColumn("lap_id", F.concat_ws("-", "session_key", "driver_number", "lap_number"))


@query("w02_lap_next", "SELECT * FROM (SELECT lag(id) OVER w AS src, id AS dst FROM (SELECT *, session_key || '-' || driver_number || '-' || lap_number AS id FROM v_laps) WINDOW w AS (PARTITION BY session_key, driver_number ORDER BY lap_number)) WHERE src IS NOT NULL")
def w02(t):
    return q.next_edges(lap_ids(t), ["session_key", "driver_number"], ["lap_number"], "lap_id")


@query("w03_lap_deltas", "SELECT session_key, driver_number, lap_number, lag(duration_s) OVER w AS prev_s, lead(duration_s) OVER w AS next_s, duration_s - lag(duration_s) OVER w AS delta FROM v_laps WINDOW w AS (PARTITION BY session_key, driver_number ORDER BY lap_number)")
def w03(t):
    return q.lap_deltas(t.v_laps).select("session_key", "driver_number", "lap_number", "prev_s", "next_s", "delta")


@query("w03_lap_deltas_by_number", """WITH l AS (SELECT * FROM v_laps WHERE lap_number % 4 <> 3) SELECT session_key, driver_number, lap_number, CASE WHEN lag(lap_number) OVER w = lap_number - 1 THEN lag(duration_s) OVER w END AS prev_s FROM l WINDOW w AS (PARTITION BY session_key, driver_number ORDER BY lap_number)""")
def w03_number(t):
    return q.lap_deltas(t.v_laps.where("lap_number % 4 <> 3"), "number").select("session_key", "driver_number", "lap_number", "prev_s")


GROUPS = f"""WITH RECURSIVE s AS (SELECT clip_id, utterance_id, idx, local_label, start_s, end_s, n_words AS n, {PROTOCOL_SQL.replace('(x)', '(text)')} AS proto, row_number() OVER (PARTITION BY clip_id ORDER BY idx) AS k FROM (SELECT * REPLACE (CASE WHEN idx % 3 = 2 THEN local_label ELSE 'driver' END AS local_label) FROM v_phrases)),
  f AS (SELECT clip_id, utterance_id, k, idx AS grp, n AS words, local_label, end_s, proto FROM s WHERE k = 1
    UNION ALL SELECT clip_id, utterance_id, k, CASE WHEN j THEN grp ELSE idx END, CASE WHEN j THEN words + n ELSE n END, local_label, end_s, proto
    FROM (SELECT s.*, f.grp, f.words, NOT s.proto AND NOT f.proto AND s.local_label = f.local_label AND s.start_s - f.end_s <= 2.0::DOUBLE AND f.words < 6 AS j FROM f JOIN s ON s.clip_id = f.clip_id AND s.k = f.k + 1))
  SELECT clip_id, utterance_id, grp AS "group" FROM f"""


@query("w07_sentiment_groups", GROUPS)
def w07(t):
    u = t.v_phrases.withColumn("local_label", F.when(C("idx") % 3 == 2, C("local_label")).otherwise("driver"))
    return q.sentiment_groups(u)


@query("w08_context_prefix", """WITH l AS (SELECT *, array_to_string(list_filter([trim(coalesce(lag(text, 2) OVER w, '')), trim(coalesce(lag(text, 1) OVER w, ''))], lambda x: x <> ''), ' ') AS lead_in FROM v_phrases WINDOW w AS (PARTITION BY clip_id ORDER BY idx))
  SELECT utterance_id, n_words < 4 AND lead_in <> '' AS used_context, CASE WHEN n_words < 4 AND lead_in <> '' THEN lead_in || ' ' || trim(text) ELSE trim(text) END AS judged FROM l""")
def w08(t):
    return q.context_prefix(t.v_phrases).select("utterance_id", "used_context", "judged")


@query("w09_fan_out", """WITH g AS (SELECT *, clip_id * 10 + local_label // 2 AS gid FROM v_speech_utt), v AS (SELECT gid, round(avg(sentiment_score) * CASE WHEN gid % 2 = 0 THEN 0.6 ELSE 1 END, 6) AS score FROM g GROUP BY gid)
  SELECT utterance_id, score, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS label FROM g JOIN v USING (gid)""")
def w09(t):
    """A group's verdict for all its members, damped where context was used."""
    u = t.v_speech_utt.withColumn("gid", C("clip_id") * 10 + F.floor(C("local_label") / 2))
    v = u.groupBy("gid").agg(F.avg("sentiment_score").alias("a")).withColumn("score", F.round(C("a") * F.when(C("gid") % 2 == 0, 0.6).otherwise(1.0), 6))
    return u.join(v, "gid").select("utterance_id", "score", band_label(C("score")).alias("label"))


def features(t):
    return probes(t).join(t.events.select("event_id", "user_id", "ts"), "event_id").select(C("user_id").alias("session"), C("ts").alias("at"), C("event_id").alias("feature_id"), "voiced", "rate", (100 + C("snr")).alias("pitch_mean"), C("pstd").alias("pitch_std"))



def tone_sql(rows: str) -> str:
    """SQL for the tone of rows (session, row_id, k from 1, voiced, rate, pm, ps) against the session's calm ones."""
    return f"""WITH RECURSIVE s AS ({rows}),
  f AS (SELECT DISTINCT session, 0::BIGINT AS row_id, 0::BIGINT AS k, '' AS read, 0::BIGINT AS n, 0::DOUBLE AS mean, 0::DOUBLE AS sd, 0::DOUBLE AS br FROM s
    UNION ALL SELECT session, row_id, k, read, CASE WHEN read = 'calm' THEN n + 1 ELSE n END, CASE WHEN read <> 'calm' THEN mean WHEN n = 0 THEN pm ELSE mean + 0.2::DOUBLE * (pm - mean) END,
      CASE WHEN read <> 'calm' THEN sd WHEN n = 0 THEN ps ELSE sd + 0.2::DOUBLE * (ps - sd) END, CASE WHEN read <> 'calm' THEN br WHEN n = 0 THEN rate ELSE br + 0.2::DOUBLE * (rate - br) END
    FROM (SELECT s.*, f.n, f.mean, f.sd, f.br, CASE WHEN voiced < 0.15::DOUBLE THEN 'calm' WHEN f.n >= 3 AND f.mean > 0 THEN CASE WHEN rate < f.br * 0.55::DOUBLE AND ps < f.sd * 0.6::DOUBLE THEN 'tired' WHEN rate > f.br * 1.45::DOUBLE OR ps > f.sd * 1.8::DOUBLE THEN 'stressed' ELSE 'calm' END
        WHEN rate < 1.8::DOUBLE AND ps < 15 THEN 'tired' WHEN rate > 3.8::DOUBLE OR ps > 40 THEN 'stressed' ELSE 'calm' END AS read FROM f JOIN s ON s.session = f.session AND s.k = f.k + 1))
  """


def chunk_sql(rows: str) -> str:
    """SQL for the chunk of rows (session, row_id, k from 1, tm, rms)."""
    return f"""WITH RECURSIVE s AS ({rows}),
  f AS (SELECT DISTINCT session, 0::BIGINT AS row_id, 0::BIGINT AS k, 0::BIGINT AS chunk, 0::BIGINT AS next, NULL::DOUBLE AS since, false AS spoke, NULL::DOUBLE AS quiet FROM s
    UNION ALL SELECT session, row_id, k, chunk, chunk + cut::INT, CASE WHEN NOT cut THEN began END, spoke AND NOT cut, CASE WHEN NOT cut THEN quiet END
    FROM (SELECT *, (tm - began >= 1.2::DOUBLE AND spoke AND coalesce(tm - quiet >= 0.6::DOUBLE, false)) OR tm - began >= 12 AS cut
      FROM (SELECT s.*, f.next AS chunk, coalesce(f.since, s.tm) AS began, f.spoke OR s.rms > 0.02::DOUBLE AS spoke, CASE WHEN s.rms <= 0.02::DOUBLE THEN coalesce(f.quiet, s.tm) END AS quiet FROM f JOIN s ON s.session = f.session AND s.k = f.k + 1)))
  """


@query("w10_tone_baseline", tone_sql(f"SELECT user_id AS session, event_id AS row_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, voiced, rate, 100 + snr AS pm, pstd AS ps FROM ({PROBES}) JOIN (SELECT event_id, user_id, ts FROM events) USING (event_id)") + "SELECT session, row_id AS feature_id, read AS tone FROM f WHERE k > 0")
def w10(t):
    return q.tone_with_baseline(features(t))


@query("w11_split_halves", """WITH s AS (SELECT *, end_s - start_s AS d FROM v_turns), a AS (SELECT *, sum(d) OVER k AS al, count(*) OVER k AS n, coalesce(sum(d) OVER (PARTITION BY clip_id, label ORDER BY start_s, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM s WINDOW k AS (PARTITION BY clip_id, label)),
  h AS (SELECT *, CASE WHEN bef < al / 2 THEN 'a' ELSE 'b' END AS half FROM a WHERE al >= 3 AND n >= 2) SELECT clip_id, turn_id, half FROM (SELECT *, count(DISTINCT half) OVER (PARTITION BY clip_id, label) AS k FROM h) WHERE k = 2""")
def w11(t):
    return q.split_halves(t.v_turns).select("clip_id", "turn_id", "half")


@query("w12_select_segments", """WITH s AS (SELECT *, end_s - start_s AS d, (end_s - start_s) * (0.5 + 0.5 * (turn_id % 10) / 10.0) AS rank FROM v_turns),
  b AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY clip_id, label ORDER BY rank DESC, start_s, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM s) SELECT clip_id, turn_id FROM (SELECT *, sum(d) OVER (PARTITION BY clip_id, label) AS tk FROM b WHERE bef < 80000) WHERE tk >= 15000""")
def w12(t):
    s = t.v_turns.withColumn("dur", C("end_s") - C("start_s")).withColumn("rank", C("dur") * (0.5 + 0.5 * (C("turn_id") % 10) / 10.0))
    return q.select_segments(s, 80000.0, 15000.0).select("clip_id", "turn_id")


@query("w13_outliers", """WITH s AS (SELECT vec_id, profile_id, list_inner_product(vec, centroid) AS sim FROM v_enrollments JOIN v_centroids USING (profile_id)), m AS (SELECT *, avg(sim) OVER p AS a, stddev_pop(sim) OVER p AS sd, count(*) OVER p AS n FROM s WINDOW p AS (PARTITION BY profile_id))
  SELECT vec_id, profile_id, round(sim, 6) AS sim, n >= 4 AND sim < a - 2 * sd AND sim < 0.5 AS is_outlier FROM m""")
def w13(t):
    from ..operators.identity import flag_outliers

    return rounded(flag_outliers(t.v_enrollments).select("vec_id", "profile_id", "sim", "is_outlier"), "sim")


@query("w14_lap_splits", "SELECT user_id, event_id, epoch_us(ts) // 1000000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000 AS split_s FROM events")
def w14(t):
    at = F.unix_seconds(C("ts").cast("timestamp"))
    return t.events.select("user_id", "event_id", (at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("split_s"))


def rms(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(C("user_id").alias("session"), C("event_id").alias("sample_id"), (F.row_number().over(w) * 0.25).alias("at"), F.when(C("event_id") % 5 < 2, 0.05).otherwise(0.01).alias("rms"))


@query("w15_cut_chunks", chunk_sql("SELECT user_id AS session, event_id AS row_id, k, k * 0.25::DOUBLE AS tm, CASE WHEN event_id % 5 < 2 THEN 0.05 ELSE 0.01 END::DOUBLE AS rms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)") + "SELECT session, row_id AS sample_id, chunk FROM f WHERE k > 0")
def w15(t):
    return q.cut_chunks(rms(t))


@query("w16_share", "SELECT clip_id, local_label, round(speech_s / nullif(sum(speech_s) OVER (PARTITION BY clip_id), 0), 8) AS share FROM v_clip_speakers")
def w16(t):
    return q.share(t.v_clip_speakers, "speech_s", ["clip_id"]).select("clip_id", "local_label", F.round("share", 8).alias("share"))


@query("w17_leg_ranks", "SELECT source, speech_id, rank FROM (SELECT source, doc_id AS speech_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 200")
def w17(t):
    d = t.documents.select("source", C("doc_id").alias("speech_id"), "n_chars")
    return topk_per_key(d, "source", [F.desc("n_chars"), "speech_id"], 200).select("source", "speech_id", "rank")


@query("k01_page", "SELECT clip_id, created_at, (SELECT count(*) FROM v_clips) AS total FROM v_clips ORDER BY created_at DESC, clip_id LIMIT 25 OFFSET 50")
def k01(t):
    return page(t.v_clips, [F.desc("created_at"), "clip_id"], 25, 50).select("clip_id", "created_at", F.lit(t.v_clips.count()).alias("total"))


@query("k02_topk_per_key", "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def k02(t):
    return topk_per_key(t.events, "user_id", [F.desc("value"), "event_id"], 5).select("user_id", "event_id", "rank")


@query("k03_interleave", """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank, 0 AS s FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank, 1 AS s FROM events WHERE event_type = 'click')
  SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank, s) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE place <= 10""")
def k03(t):
    leg = lambda kind: t.events.where(C("event_type") == kind).select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")).alias("rank"))
    return q.interleave(leg("view"), leg("click"), "user_id", 10).select("user_id", "event_id", "place")


@query("k04_truncate_blocks", """WITH b AS (SELECT clip_id, idx, text, sum(length(text) + 2) OVER (PARTITION BY clip_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS upto, sum(length(text) + 2) OVER (PARTITION BY clip_id) - 2 AS al FROM v_utterances)
  SELECT clip_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS body FROM b WHERE al <= 1500 OR upto <= 1500 GROUP BY 1""")
def k04(t):
    return q.truncate_blocks(t.v_utterances.select("clip_id", C("idx").alias("rank"), C("text").alias("block")), "clip_id", 1500)


@query("k05_cited_ids", r"SELECT utterance_id, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS ids FROM (SELECT utterance_id, regexp_extract_all(answer, '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b') AS ids FROM v_answers)")
def k05(t):
    """The speech that an answer cites, each id once, in the order of first appearance."""
    return t.v_answers.select("utterance_id", cited_ids(C("answer")).alias("ids"))


@query("k06_union_speech", "SELECT 'utterance' AS kind, utterance_id::VARCHAR AS speech_id, text FROM v_speech_utt WHERE trim(text) <> '' UNION ALL SELECT 'radio', call_id, text FROM v_radio WHERE error IS NULL AND analyzed_s IS NOT NULL")
def k06(t):
    a = t.v_speech_utt.where("trim(text) <> ''").select(F.lit("utterance").alias("kind"), C("utterance_id").cast("string").alias("speech_id"), "text")
    return a.unionByName(t.v_radio.where("error IS NULL AND analyzed_s IS NOT NULL").select(F.lit("radio").alias("kind"), C("call_id").alias("speech_id"), "text"))


@query("k07_outer_ranks", "SELECT coalesce(a.id, b.id) AS id, a.r AS rank_a, b.r AS rank_b FROM (SELECT event_id AS id, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events WHERE event_type = 'view' AND value > 100) a FULL JOIN (SELECT event_id AS id, row_number() OVER (ORDER BY value, event_id) AS r FROM events WHERE value > 150) b ON a.id = b.id")
def k07(t):
    """Two ranked lists side by side; an id that only one has keeps null in the other."""
    leg = lambda d, name, *order: global_ranks(d.select(C("event_id").alias("id"), "value"), list(order), name).drop("value")
    a = leg(t.events.where("event_type = 'view' AND value > 100"), "rank_a", F.desc("value"), "id")
    return a.join(leg(t.events.where("value > 150"), "rank_b", "value", "id"), "id", "full")
