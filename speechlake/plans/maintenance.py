"""Queries of table maintenance, exports, adjudication and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.citations import citations
from ..operators import maintenance as m
from .registry import query

C = F.col


@query("s01_typed_scan", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_totalprice > 1000")
def s01(t):
    """A typed scan with a date and a price pushed to it."""
    from ..sources.tables import read

    return read(t.spark, t.folder, "orders").where("o_orderdate >= date'1996-01-01' AND o_totalprice > 1000").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("s02_speech", "SELECT utterance_id::VARCHAR AS speech_id, 'utterance' AS kind, r.session_key, u.text FROM v_speech_utt u JOIN v_clips c USING (clip_id) LEFT JOIN v_races r USING (race_id) WHERE status = 'COMPLETE' AND trim(u.text) <> '' UNION ALL SELECT call_id, 'radio', session_key, text FROM v_radio WHERE error IS NULL AND analyzed_s IS NOT NULL AND trim(text) <> ''")
def s02(t):
    done = t.v_clips.where("status = 'COMPLETE'").select("clip_id", "race_id").join(t.v_races.select("race_id", "session_key"), "race_id", "left")
    u = t.v_speech_utt.where("trim(text) <> ''").join(done, "clip_id").select(C("utterance_id").cast("string").alias("speech_id"), F.lit("utterance").alias("kind"), "session_key", "text")
    return u.unionByName(t.v_radio.where("error IS NULL AND analyzed_s IS NOT NULL AND trim(text) <> ''").select(C("call_id").alias("speech_id"), F.lit("radio").alias("kind"), "session_key", "text"))


@query("s03_ingest", """WITH b AS (SELECT *, sha256(coalesce(content, '')) AS sha FROM v_incoming WHERE batch = 1), old AS (SELECT sha256(coalesce(content, '')) AS sha, arg_min(race, file_id) AS old_race FROM v_incoming WHERE batch = 2 GROUP BY 1),
  f AS (SELECT sha, min(file_id) AS first_id, arg_min(race, file_id) AS first_race FROM b GROUP BY 1)
  SELECT file_id, sha, CASE WHEN old_race IS NULL AND file_id = first_id THEN 'new' WHEN race IS NOT NULL AND race IS DISTINCT FROM coalesce(old_race, first_race) THEN 'moved' ELSE 'duplicate' END AS outcome FROM b JOIN f USING (sha) LEFT JOIN old USING (sha)""")
def s03(t):
    """All documents as files, against a state that knows the contents of the other batch."""
    old = t.v_incoming.where("batch = 2").groupBy(F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha")).agg(F.min_by("race", "file_id").alias("race"))
    return m.ingest(t.v_incoming.where("batch = 1"), old)


def base(t):
    return t.customer.where("c_custkey % 3 <> 0").select("c_custkey", F.when(C("c_custkey") % 5 != 0, C("c_name")).alias("c_name"), C("c_nationkey").cast("long").alias("c_nationkey"))


def fresh(t):
    return t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), C("c_nationkey").cast("long").alias("c_nationkey"))


UP = "b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS c_name, c_nationkey::BIGINT AS c_nationkey FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, upper(c_name) AS c_name, c_nationkey::BIGINT AS c_nationkey FROM customer WHERE c_custkey % 2 = 0)"


@query("s04_upsert", f"WITH {UP} SELECT coalesce(b.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE b.c_name END AS c_name, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_nationkey ELSE b.c_nationkey END AS c_nationkey FROM b FULL JOIN n ON b.c_custkey = n.c_custkey")
def s04(t):
    return m.upsert(base(t), fresh(t), ["c_custkey"], ["c_name", "c_nationkey"])


@query("s05_insert_missing", f"WITH {UP} SELECT * FROM b UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM b)")
def s05(t):
    return m.insert_missing(base(t), fresh(t), ["c_custkey"])


@query("s06_upsert_fill", f"WITH {UP} SELECT coalesce(b.c_custkey, n.c_custkey) AS c_custkey, coalesce(b.c_name, n.c_name) AS c_name, coalesce(b.c_nationkey, n.c_nationkey) AS c_nationkey FROM b FULL JOIN n ON b.c_custkey = n.c_custkey")
def s06(t):
    return m.upsert(base(t), fresh(t), ["c_custkey"], ["c_name", "c_nationkey"], fill_only=True)


@query("s07_split_cached", "SELECT call_id, CASE WHEN analyzed_s IS NOT NULL AND error IS NULL AND driver_number % 10 <> 0 THEN 'cached' ELSE 'work' END AS list FROM v_radio")
def s07(t):
    """Calls whose analysis can be used again, and those to do; some are forced."""
    ok = C("analyzed_s").isNotNull() & C("error").isNull() & (C("driver_number") % 10 != 0)
    return t.v_radio.select("call_id", F.when(ok, "cached").otherwise("work").alias("list"))


@query("s08_replace_derived", "SELECT clip_id, local_label, speech_s FROM v_clip_speakers WHERE clip_id % 4 <> 0 UNION ALL SELECT clip_id, local_label + 100, speech_s * 2 FROM v_clip_speakers WHERE clip_id % 4 = 0 AND local_label = 1")
def s08(t):
    table = t.v_clip_speakers.select("clip_id", "local_label", "speech_s")
    new = table.where("local_label = 1").select("clip_id", (C("local_label") + 100).alias("local_label"), (C("speech_s") * 2).alias("speech_s"))
    return m.replace_derived(table, new, t.v_clips.where("clip_id % 4 = 0").select("clip_id"))


def read_events(t, source, shift):
    return t.events.where(C("event_id") % 3 == shift).select((C("event_id") % 200).alias("speech_id"), "event_type", F.lit(source).alias("source"), "value").groupBy("speech_id", "event_type", "source").agg(F.max("value").alias("score"))


@query("s09_replace_source", """WITH e AS (SELECT event_id % 200 AS speech_id, event_type, CASE event_id % 3 WHEN 0 THEN 'hand' WHEN 1 THEN 'model' ELSE 'new' END AS s, max(value) AS score FROM events GROUP BY ALL),
  b AS (SELECT speech_id, event_type, 'hand' AS source, score, 0 AS n FROM e WHERE s = 'hand' UNION ALL SELECT speech_id, event_type, 'model', score, 1 FROM e WHERE s = 'new')
  SELECT speech_id, event_type, source, score FROM (SELECT *, row_number() OVER (PARTITION BY speech_id, event_type ORDER BY n, score DESC, source) AS r FROM b) WHERE r = 1""")
def s09(t):
    old = read_events(t, "hand", 0).unionByName(read_events(t, "model", 1))
    return m.replace_source(old, read_events(t, "model", 2), "model")


@query("s10_delete_clips", """SELECT c.clip_id, status = 'REJECTED' AS deleted, CASE WHEN status = 'REJECTED' THEN ns + nu END AS receipt_rows, CASE WHEN status = 'REJECTED' THEN 'asked for' END AS reason, CASE WHEN status = 'REJECTED' THEN 0 ELSE ns END AS speakers_left, CASE WHEN status = 'REJECTED' THEN 0 ELSE nu END AS utterances_left
  FROM (SELECT *, (SELECT count(*) FROM v_clip_speakers s WHERE s.clip_id = c.clip_id) AS ns, (SELECT count(*) FROM v_speech_utt u WHERE u.clip_id = c.clip_id) AS nu FROM v_clips c) c""")
def s10(t):
    """What is left of every clip after some were deleted, and the receipts of these."""
    tables = {"speakers_left": t.v_clip_speakers.select("clip_id"), "utterances_left": t.v_speech_utt.select("clip_id")}
    left, receipts = m.delete_clips(tables, t.v_clips.where("status = 'REJECTED'").select("clip_id"), "asked for")
    out = t.v_clips.select("clip_id").join(receipts.withColumnRenamed("n_rows", "receipt_rows"), "clip_id", "left").withColumn("deleted", C("reason").isNotNull())
    for name, rows in left.items():
        out = out.join(rows.groupBy("clip_id").agg(F.count("*").alias(name)), "clip_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@query("s10_delete_races", """WITH d AS (SELECT race_id, race_id % 10 = 3 AS wc FROM v_races WHERE race_id % 5 = 3), c AS (SELECT clip_id, c.race_id, wc FROM v_clips c LEFT JOIN d USING (race_id))
  SELECT clip_id, CASE WHEN wc IS NULL THEN race_id END AS race_id, CASE WHEN wc THEN 'deleted' WHEN NOT wc THEN 'without race' ELSE 'kept' END AS state, CASE WHEN wc THEN (SELECT count(*) FROM v_clip_speakers s WHERE s.clip_id = c.clip_id) END AS receipt_rows FROM c""")
def s10_races(t):
    """Races deleted with their clips, or without."""
    ids = t.v_races.where("race_id % 5 = 3").select("race_id", (C("race_id") % 10 == 3).alias("with_clips"))
    _, clips, _, receipts = m.delete_races(t.v_races, t.v_clips.select("clip_id", "race_id"), {"speakers": t.v_clip_speakers.select("clip_id")}, ids, "race deleted")
    gone = receipts.select("clip_id", F.lit(None).cast("long").alias("race_id"), F.lit("deleted").alias("state"), C("n_rows").alias("receipt_rows"))
    return clips.select("clip_id", "race_id", F.when(C("race_id").isNull(), "without race").otherwise("kept").alias("state"), F.lit(None).cast("long").alias("receipt_rows")).unionByName(gone)


def stamp_sql(x: str, dot: str) -> str:
    return f"lpad((floor({x})::BIGINT // 3600)::VARCHAR, 2, '0') || ':' || lpad((floor({x})::BIGINT // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((floor({x})::BIGINT % 60)::VARCHAR, 2, '0') || '{dot}' || lpad(floor(({x} - floor({x})) * 1000)::BIGINT::VARCHAR, 3, '0')"


NL = "chr(10)"


@query("s11_srt", f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY idx) AS k FROM v_utterances) SELECT clip_id, string_agg(k || {NL} || {stamp_sql('start_s', ',')} || ' --> ' || {stamp_sql('end_s', ',')} || {NL} || local_label || ': ' || text || {NL}, {NL} ORDER BY idx) AS body FROM n GROUP BY 1")
def s11(t):
    return m.to_srt(t.v_utterances)


@query("s12_vtt", f"SELECT clip_id, 'WEBVTT' || {NL} || {NL} || string_agg({stamp_sql('start_s', '.')} || ' --> ' || {stamp_sql('end_s', '.')} || {NL} || '<v ' || local_label || '>' || text || {NL}, {NL} ORDER BY idx) AS body FROM v_utterances GROUP BY 1")
def s12(t):
    return m.to_vtt(t.v_utterances)


@query("s13_txt", f"SELECT clip_id, string_agg(local_label || ': ' || text, {NL} ORDER BY idx) AS body FROM v_utterances GROUP BY 1")
def s13(t):
    return m.to_txt(t.v_utterances)


@query("s14_rttm", f"SELECT clip_id, string_agg('SPEAKER ' || clip_id || ' 1 ' || printf('%.3f', start_s) || ' ' || printf('%.3f', end_s - start_s) || ' <NA> <NA> ' || replace(label, ' ', '_') || ' <NA> <NA>', {NL} ORDER BY turn_id) AS body FROM (SELECT clip_id, turn_id, replace(label, 'a', 'a ') AS label, floor(start_s) % 10000 AS start_s, floor(start_s) % 10000 + turn_id % 64 / 8.0 AS end_s FROM v_turns) GROUP BY 1")
def s14(t):
    turns = t.v_turns.select("clip_id", "turn_id", F.replace(C("label"), F.lit("a"), F.lit("a ")).alias("label"), (F.floor("start_s") % 10000).cast("double").alias("start_s"), (F.floor("start_s") % 10000 + C("turn_id") % 64 / 8.0).alias("end_s"))
    return m.to_rttm(turns)


@query("s15_json_documents", """SELECT c.clip_id, status, grade, duration_s, CASE WHEN grade = 'poor' THEN ['POOR_AUDIO_QUALITY'] ELSE [] END AS warnings, coalesce(len(us), 0) AS n_utterances, us[1] AS first_text, coalesce(len(ss), 0) AS n_speakers, coalesce(ss, []) AS labels, coalesce(pr, []) AS profiles FROM v_clips c
  LEFT JOIN (SELECT clip_id, list(text ORDER BY idx) AS us FROM v_speech_utt GROUP BY 1) u USING (clip_id) LEFT JOIN (SELECT clip_id, list(local_label::VARCHAR ORDER BY local_label::VARCHAR) AS ss, list(coalesce(profile_id, 0) ORDER BY local_label::VARCHAR) AS pr FROM v_clip_speakers GROUP BY 1) s USING (clip_id)""")
def s15(t):
    """The nested documents, read back from their JSON."""
    warnings = t.v_clips.select("clip_id", F.array_compact(F.array(F.when(C("grade") == "poor", "POOR_AUDIO_QUALITY"))).alias("warnings"))
    docs = m.nested_documents(t.v_clips, t.v_speech_utt, t.v_clip_speakers, warnings)
    schema = "status string, quality struct<grade:string,duration_s:double>, warnings array<string>, utterances array<struct<idx:bigint,text:string>>, speakers map<string,struct<profile_id:bigint>>"
    back = docs.select("clip_id", F.from_json("doc", schema).alias("d"))
    labels = F.coalesce(F.sort_array(F.map_keys("d.speakers")), F.array().cast("array<string>"))
    return back.select(
        "clip_id", "d.status", "d.quality.grade", "d.quality.duration_s", "d.warnings", F.coalesce(F.size("d.utterances"), F.lit(0)).alias("n_utterances"), F.try_element_at("d.utterances", F.lit(1))["text"].alias("first_text"),
        F.size(labels).alias("n_speakers"), labels.alias("labels"), F.transform(labels, lambda k: F.coalesce(F.try_element_at("d.speakers", k)["profile_id"], F.lit(0))).alias("profiles"),
    )


@query("s16_clip_result", """WITH ids AS (SELECT clip_id, status, grade FROM v_clips), rg AS (SELECT clip_id, count(*) AS n_regions FROM v_vad GROUP BY 1), tn AS (SELECT clip_id, count(*) AS n_turns FROM v_turns GROUP BY 1), tr AS (SELECT clip_id, arg_max(text, idx) AS transcript, count(*) AS n_utterances FROM v_utterances GROUP BY 1),
  w AS (SELECT clip_id, count(*) AS n_words, arg_min(word, {'s': start_s, 'w': word_id}) AS first_word FROM v_words GROUP BY 1), sp AS (SELECT clip_id, list(coalesce(p.name, '?') ORDER BY local_label) AS names FROM v_clip_speakers LEFT JOIN v_profiles_named p USING (profile_id) GROUP BY 1),
  rn AS (SELECT user_id AS clip_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS run_outcome, arg_max(json_extract(props, '$.k')::DOUBLE, {'t': ts, 'e': event_id}) AS run_k FROM events GROUP BY 1)
  SELECT clip_id, status, grade, coalesce(n_regions, 0) AS n_regions, coalesce(n_turns, 0) AS n_turns, transcript, coalesce(n_utterances, 0) AS n_utterances, coalesce(n_words, 0) AS n_words, first_word, coalesce(names, []) AS names, run_outcome, run_k FROM ids LEFT JOIN rg USING (clip_id) LEFT JOIN tn USING (clip_id) LEFT JOIN tr USING (clip_id) LEFT JOIN w USING (clip_id) LEFT JOIN sp USING (clip_id) LEFT JOIN rn USING (clip_id)""")
def s16(t):
    """Every clip's result document, seen by its parts."""
    runs = t.events.select(C("user_id").alias("clip_id"), C("event_id").alias("run_id"), C("ts").alias("at"), C("event_type").alias("outcome"), C("props").alias("timings"))
    transcripts = t.v_utterances.select("clip_id", C("idx").alias("version"), C("text").alias("transcript"))
    d = m.clip_results(t.v_clips, t.v_vad, t.v_turns, transcripts, t.v_utterances, t.v_words, t.v_clip_speakers, t.v_profiles_named, runs)
    n = lambda c, name: F.coalesce(F.size(c), F.lit(0)).alias(name)
    names = F.coalesce(F.transform("speakers", lambda x: F.coalesce(x["name"], F.lit("?"))), F.array().cast("array<string>"))
    return d.select("clip_id", "status", "quality.grade", n("regions", "n_regions"), n("turns", "n_turns"), "transcript", n("utterances", "n_utterances"), n("words", "n_words"), F.try_element_at("words", F.lit(1))["word"].alias("first_word"), names.alias("names"), C("run.outcome").alias("run_outcome"), F.try_element_at("run.timings", F.lit("k")).alias("run_k"))


TYPES = ["overtake", "pit_stop", "yellow_flag"]
VERDICTS = r"""vd AS (SELECT batch_id, batch_size, unnest(from_json(j, '["JSON"]')) AS v FROM (SELECT batch_id, batch_size, CASE WHEN json_valid(j) THEN j END AS j FROM (SELECT *, regexp_extract(reply, '(?s)\[.*\]', 0) AS j FROM v_replies))),
  vx AS (SELECT batch_id, batch_size, try_cast(v->>'$.n' AS INT) AS n, trim(v->>'$.event') AS event, try_cast(coalesce(v->>'$.confidence', '0') AS DOUBLE) AS confidence, nullif(trim(v->>'$.other_car'), '') AS other_car, substr(nullif(trim(v->>'$.why'), ''), 1, 200) AS why FROM vd),
  verdicts AS (SELECT * EXCLUDE (batch_size) FROM vx WHERE event IN ('overtake', 'pit_stop', 'yellow_flag') AND n BETWEEN 1 AND batch_size AND confidence >= 0.6::DOUBLE)"""


@query("l01_prompts", r"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY local_label ORDER BY utterance_id) - 1 AS i FROM v_utterances)
  SELECT local_label, i // 10 AS batch, 'Judge.' || chr(10) || chr(10) || 'Lines:' || chr(10) || string_agg((i % 10 + 1) || '. ' || trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY i) AS prompt, count(*) AS n_lines FROM n GROUP BY 1, 2""")
def l01(t):
    return m.prompt_batches(t.v_utterances.select("local_label", C("utterance_id").alias("idx"), "text"), ["local_label"], 10, "Judge.")


@query("l02_parse_verdicts", f"WITH {VERDICTS} SELECT * FROM verdicts")
def l02(t):
    return m.parse_verdicts(t.v_replies, TYPES)


@query("l03_attach", f"WITH {VERDICTS} SELECT utterance_id, event, confidence AS score FROM verdicts JOIN v_utterances ON utterance_id = batch_id + n - 1")
def l03(t):
    """Verdicts on the lines that they name: a reply to a turn counts from that turn on."""
    said = m.parse_verdicts(t.v_replies, TYPES).withColumn("utterance_id", C("batch_id") + C("n") - 1)
    return said.join(t.v_utterances.select("utterance_id"), "utterance_id").select("utterance_id", "event", C("confidence").alias("score"))


@query("l04_unread", r"SELECT batch_id % 10 AS shard, count(*) AS n_batches, count(*) FILTER (NOT coalesce(CASE WHEN json_valid(j) THEN json_array_length(j) END, 0) > 0) AS n_unread FROM (SELECT batch_id, regexp_extract(reply, '(?s)\[.*\]', 0) AS j FROM v_replies) GROUP BY 1")
def l04(t):
    """Batches whose reply could not be read are counted."""
    read = F.from_json(F.regexp_extract("reply", r"(?s)\[.*\]", 0), "array<struct<n:int>>")
    rows = t.v_replies.withColumn("ok", F.coalesce(F.size(read) > 0, F.lit(False)))
    return rows.groupBy((C("batch_id") % 10).alias("shard")).agg(F.count("*").alias("n_batches"), F.count_if(~C("ok")).alias("n_unread"))


@query("l05_store_verdicts", f"""WITH {VERDICTS}, x AS (SELECT batch_id AS speech_id, event, confidence, other_car FROM verdicts), tg AS (SELECT speech_id, min(n) AS target FROM (SELECT DISTINCT speech_id, regexp_extract(other_car, '[0-9]+')::BIGINT AS n FROM x WHERE other_car IS NOT NULL) k JOIN v_drivers d ON d.session_key = speech_id % 10 AND d.driver_number = n GROUP BY 1 HAVING count(*) = 1),
  b AS (SELECT event_id % 200 AS speech_id, event_type, 'hand' AS source, max(value) AS score, NULL::BIGINT AS target, 0 AS k FROM events WHERE event_id % 3 = 0 GROUP BY ALL UNION ALL SELECT speech_id, event, 'model', confidence, target, 1 FROM x LEFT JOIN tg USING (speech_id))
  SELECT speech_id, event_type, source, score, target FROM (SELECT *, row_number() OVER (PARTITION BY speech_id, event_type ORDER BY k, score DESC, source) AS r FROM b) WHERE r = 1""")
def l05(t):
    """Verdicts as events of the model's source, with the driver that the other car names, beside those read by hand."""
    verdicts = m.parse_verdicts(t.v_replies, TYPES).select(C("batch_id").alias("speech_id"), "event", "confidence", "other_car", F.lit("said").alias("text"))
    cars = t.v_drivers.select(F.concat(F.lit("car "), "driver_number").alias("alias"), F.lit("driver").alias("entity_type"), C("driver_number").cast("string").alias("entity_key")).distinct()
    sessions = t.v_replies.select(C("batch_id").alias("speech_id"), (C("batch_id") % 10).alias("session_key"))
    old = read_events(t, "hand", 0).withColumn("target", F.lit(None).cast("long"))
    return m.store_verdicts(verdicts, cars, sessions, t.v_drivers, old, "model")


@query("l06_citations", r"SELECT utterance_id, CASE WHEN len(ids) > 0 THEN list_filter(ids, lambda x, i: list_position(ids, x) = i) ELSE list_filter(consulted, lambda x, i: list_position(consulted, x) = i)[1:6] END AS cited FROM (SELECT *, regexp_extract_all(answer, '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b') AS ids FROM v_answers)")
def l06(t):
    """What an answer cites, else the first six of its sources."""
    return t.v_answers.select("utterance_id", citations(C("answer"), C("consulted")).alias("cited"))


CHAIN = """WITH RECURSIVE f AS (SELECT DISTINCT actor, 0::BIGINT AS seq, '' AS prev_hash, 'start' AS row_hash FROM v_audit
    UNION ALL SELECT a.actor, a.seq, f.row_hash, sha256(concat_ws('|', f.row_hash, at_s, a.actor, action, object, before, after)) FROM f JOIN v_audit a ON a.actor = f.actor AND a.seq = f.seq + 1)
  """


@query("h01_chain", CHAIN + "SELECT * FROM f WHERE seq > 0")
def h01(t):
    return m.chain(t.v_audit).select("actor", "seq", "prev_hash", "row_hash")


@query("h02_verify_chain", CHAIN.rstrip() + """, log AS (SELECT a.* REPLACE (CASE WHEN seq = 5 AND actor % 7 = 0 THEN 'another' ELSE object END AS object), prev_hash, row_hash FROM v_audit a JOIN f USING (actor, seq)),
  ok AS (SELECT *, prev_hash = coalesce(lag(row_hash) OVER (PARTITION BY actor ORDER BY seq), 'start') AND row_hash = sha256(concat_ws('|', prev_hash, at_s, actor, action, object, before, after)) AS ok FROM log)
  SELECT actor, count(*) AS n, min(seq) FILTER (NOT ok) AS first_break FROM ok GROUP BY 1""")
def h02(t):
    """Chains in which one row of some actors was changed afterwards."""
    log = m.chain(t.v_audit)
    changed = log.withColumn("object", F.when((C("seq") == 5) & (C("actor") % 7 == 0), "another").otherwise(C("object")))
    return m.verify_chain(changed)


@query("h03_corrections_report", "SELECT before, after, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS rate FROM v_audit WHERE action = 'purchase' GROUP BY 1, 2")
def h03(t):
    """How often a correction went from what to what."""
    c = t.v_audit.where("action = 'purchase'").groupBy("before", "after").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return c.withColumn("rate", F.round(C("n") / F.sum("n").over(Window.partitionBy()), 9))


@query("h04_receipts_check", "SELECT CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 20 <> 0 THEN 'deleted without receipt' WHEN o_orderkey % 15 = 0 AND o_orderkey % 10 <> 0 THEN 'receipt but present' ELSE 'ok' END AS state, count(*) AS n FROM orders GROUP BY 1")
def h04(t):
    """Deleted clips against their receipts, both ways."""
    clips = t.orders.select(C("o_orderkey").alias("clip_id"))
    after = clips.where("clip_id % 10 <> 0").withColumn("present", F.lit(True))
    receipts = clips.where("clip_id % 20 = 0 OR clip_id % 15 = 0 AND clip_id % 10 <> 0").withColumn("receipt", F.lit(True))
    both = clips.join(after, "clip_id", "left").join(receipts, "clip_id", "left").na.fill(False, ["present", "receipt"])
    state = F.when(~C("present") & ~C("receipt"), "deleted without receipt").when(C("present") & C("receipt"), "receipt but present").otherwise("ok")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
