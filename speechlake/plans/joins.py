"""Queries that join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context
from ..operators import joins as j
from ..operators.shared import MOST_BROADCAST, dealt
from .graph import DONE, EDGE_SQL, END_SQL
from .registry import query

C = F.col
DAY = 86400.0


def calls(t):
    return t.v_radio.withColumnsRenamed({"call_id": "speech_id", "recorded_s": "at_s"})


def good_calls(t):
    return calls(t).where("error IS NULL AND analyzed_s IS NOT NULL")


@query("j10_during_lap", "SELECT call_id AS speech_id, r.session_key, r.driver_number, lap_number FROM v_radio r JOIN v_laps l ON r.session_key = l.session_key AND r.driver_number = l.driver_number AND recorded_s >= start_s - 86400 AND recorded_s < start_s + duration_s + 86400 WHERE duration_s IS NOT NULL")
def j10(t):
    return j.during_lap(calls(t), t.v_laps, DAY, 30 * DAY)


@query("j11_speech_ts", """SELECT u.utterance_id::VARCHAR AS speech_id, r.session_key, d.driver_number, epoch(c.created_at::TIMESTAMP)::BIGINT + u.idx AS at_s FROM v_speech_utt u JOIN v_clips c USING (clip_id) JOIN v_races r USING (race_id) JOIN v_drivers d ON d.profile_id = u.profile_id AND d.session_key = r.session_key WHERE c.status = 'COMPLETE'
  UNION ALL SELECT call_id, session_key, driver_number, recorded_s FROM v_radio WHERE error IS NULL AND analyzed_s IS NOT NULL""")
def j11(t):
    return j.speech_times(t.v_speech_utt, t.v_clips, t.v_races, t.v_drivers, good_calls(t))


@query("j12_resolve_speaker", """SELECT u.utterance_id, coalesce(u.profile_id, s.profile_id) AS profile_id, p.name FROM (SELECT utterance_id, clip_id, local_label, CASE WHEN utterance_id % 2 = 0 THEN profile_id END AS profile_id FROM v_speech_utt) u
  LEFT JOIN v_clip_speakers s ON s.clip_id = u.clip_id AND s.local_label = u.local_label LEFT JOIN v_profiles_named p ON p.profile_id = coalesce(u.profile_id, s.profile_id)""")
def j12(t):
    u = t.v_speech_utt.select("utterance_id", "clip_id", "local_label", F.when(C("utterance_id") % 2 == 0, C("profile_id")).alias("own"))
    s = t.v_clip_speakers.select("clip_id", "local_label", "profile_id")
    got = u.join(s, ["clip_id", "local_label"], "left").select("utterance_id", F.coalesce("own", "profile_id").alias("profile_id"))
    return got.join(t.v_profiles_named.select("profile_id", "name"), "profile_id", "left")


@query("j13_resolve_radio", "SELECT call_id, d.name AS driver, s.name AS session, s.circuit FROM v_radio r LEFT JOIN v_drivers d ON d.session_key = r.session_key AND d.driver_number = r.driver_number LEFT JOIN v_sessions s ON s.session_key = r.session_key")
def j13(t):
    d = t.v_drivers.select("session_key", "driver_number", C("name").alias("driver"))
    s = t.v_sessions.select("session_key", C("name").alias("session"), "circuit")
    radio, n = t.v_radio, t.customer.count()
    if n <= MOST_BROADCAST:
        found = radio.join(F.broadcast(d), ["session_key", "driver_number"], "left")
    else:
        rows = t.lineitem.count()  # a call at most for each
        found = dealt(radio, rows, "session_key", "driver_number").join(dealt(d, rows, "session_key", "driver_number").hint("merge"), ["session_key", "driver_number"], "left")
    return found.join(s, "session_key", "left").select("call_id", "driver", "session", "circuit")


@query("j14_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def j14(t):
    return j.latest(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("j15_talked_with", "SELECT a.profile_id AS a, b.profile_id AS b, count(*) AS n FROM v_clip_speakers a JOIN v_clip_speakers b ON a.clip_id = b.clip_id AND a.profile_id < b.profile_id JOIN v_clips c ON c.clip_id = a.clip_id WHERE c.status = 'COMPLETE' GROUP BY 1, 2")
def j15(t):
    return j.talked_with(t.v_clip_speakers, t.v_clips)


def spoken(t):
    """Texts that name parts, words of parts and nations."""
    nation = t.nation.select("n_nationkey", "n_name")
    return t.part.join(F.broadcast(nation), C("p_partkey") % 25 == C("n_nationkey")).select(C("p_partkey").alias("speech_id"), F.concat(F.lit("We saw the "), F.upper("p_name"), F.lit(", near "), "n_name", F.lit(".")).alias("text"), (C("p_partkey") % 10).alias("session_key"))


SPOKEN = "spoken AS (SELECT p_partkey AS speech_id, 'we saw the ' || lower(p_name) || ', near ' || lower(n_name) || '.' AS text, p_partkey % 10 AS session_key, lower(p_name) AS part, lower(n_name) AS nation FROM part JOIN nation ON p_partkey % 25 = n_nationkey)"
#: The whole name is the longest alias at its place, so its first word is not found apart.
FOUND = "found AS (SELECT DISTINCT speech_id, a.entity_type, a.entity_key FROM spoken JOIN v_aliases a ON a.alias = part OR a.alias = nation)"


@query("j16_mentions", f"WITH {SPOKEN}, {FOUND} SELECT * FROM found")
def j16(t):
    return j.mentions(spoken(t), t.v_aliases)


def driver_mentions(t):
    found = j.mentions(spoken(t), t.v_aliases).where("entity_type = 'nation'").withColumn("entity_type", F.lit("driver"))
    return j.session_drivers(found, spoken(t), t.v_drivers)


DRIVERS = f"{SPOKEN}, {FOUND}, named AS (SELECT speech_id, session_key, d.driver_number, d.name FROM found JOIN spoken USING (speech_id) JOIN v_drivers d USING (session_key) WHERE entity_type = 'nation' AND d.driver_number = entity_key::BIGINT)"


@query("j17_driver_mentions", f"WITH {DRIVERS} SELECT * FROM named")
def j17(t):
    return driver_mentions(t).select("speech_id", "session_key", "driver_number", "name")


@query("j18_target_driver", f"WITH {DRIVERS} SELECT s.speech_id, target FROM spoken s LEFT JOIN (SELECT speech_id, min(driver_number) AS target FROM named GROUP BY 1 HAVING count(DISTINCT driver_number) = 1) USING (speech_id)")
def j18(t):
    return spoken(t).select("speech_id").join(j.target_driver(driver_mentions(t)), "speech_id", "left")


@query("j19_unread", "SELECT doc_id AS speech_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j19(t):
    """Speech that has no label yet."""
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti").withColumnRenamed("doc_id", "speech_id")


@query("j20_land_edges", "SELECT l_orderkey AS src, l_suppkey AS dst FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def j20(t):
    edges = t.lineitem.select(C("l_orderkey").alias("src"), C("l_suppkey").alias("dst"))
    return j.land_edges(edges, t.orders.where("o_orderstatus = 'F'").select(C("o_orderkey").alias("key")), t.supplier.where("s_suppkey % 2 = 0").select(C("s_suppkey").alias("key")))


def call_anchors(t, speech):
    """Every call and utterance of the drivers and races whose number 50 divides, in order."""
    from pyspark.sql import Window

    order = Window.partitionBy("whose").orderBy("kind", "spot", "speech_id")
    return speech.where("whose % 50 = 0").select("speech_id", F.row_number().over(order).alias("rank"), C("whose").alias("request_id"))


#: All speech with its own facts and place; what surrounds asked speech (a: speech_id, request_id, rank), as `expanded`.
SPEECH = f"""{DONE}, sp AS (SELECT utterance_id::VARCHAR AS speech_id, 'utterance' AS kind, done.text, mood, sentiment, done.sentiment_score, text_sentiment, profile_id, NULL::BIGINT AS driver_number, NULL::BIGINT AS session_key, done.race_id AS whose, 'clip:' || clip_id AS line, idx AS spot, epoch(created_at::TIMESTAMP)::BIGINT AS newest FROM done JOIN (SELECT clip_id, created_at FROM v_clips) USING (clip_id)
    UNION ALL SELECT call_id, 'radio_call', text, mood, NULL, NULL, NULL, NULL, driver_number, session_key, driver_number, 'driver:' || driver_number, recorded_s, recorded_s FROM calls)"""
AROUND = f"""near AS (SELECT *, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text FROM sp WINDOW w AS (PARTITION BY line ORDER BY spot, speech_id)),
  voice AS (SELECT profile_id, min(driver_number) AS voice_driver FROM v_drivers WHERE profile_id IS NOT NULL GROUP BY 1),
  lp AS (SELECT session_key || '-' || driver_number || '-' || lap_number AS key, lap_number, duration_s, lag(duration_s) OVER (PARTITION BY session_key, driver_number ORDER BY lap_number) AS prev_s FROM v_laps),
  lf AS (SELECT DISTINCT src AS speech_id, lap_number, duration_s, prev_s FROM ({EDGE_SQL["DURING_LAP"]}) JOIN lp ON dst = key),
  ms AS (SELECT DISTINCT src AS speech_id, split_part(dst, ':', 1) AS kind, coalesce(d.name, substr(dst, instr(dst, ':') + 1)) AS name FROM ({EDGE_SQL["MENTIONS"]}) LEFT JOIN v_drivers d ON dst = 'driver:' || d.driver_number WHERE dst IN (SELECT key FROM ({END_SQL["Entity"]}))),
  mn AS (SELECT speech_id, string_agg(name || ' (' || kind || ')', ', ' ORDER BY kind, name) AS mentions FROM ms GROUP BY 1),
  tg AS (SELECT speech_id, event_type, min(name) AS driver FROM ev JOIN v_drivers ON target = driver_number GROUP BY 1, 2),
  expanded AS (SELECT a.request_id, a.rank, n.speech_id, n.kind, n.text, n.mood, n.sentiment, n.sentiment_score, n.text_sentiment, p.name AS speaker, d.name AS driver, d.team_key::VARCHAR AS team, s.name AS session, s.year, s.circuit, prev_text, next_text, mentions
    FROM a JOIN near n USING (speech_id) LEFT JOIN v_profiles_named p ON p.profile_id = n.profile_id LEFT JOIN voice v ON v.profile_id = n.profile_id LEFT JOIN v_drivers d ON d.driver_number = coalesce(n.driver_number, voice_driver) LEFT JOIN v_sessions s ON s.session_key = n.session_key LEFT JOIN mn USING (speech_id))"""
EXPANDED = f"{SPEECH}, a AS (SELECT speech_id, whose AS request_id, row_number() OVER (PARTITION BY whose ORDER BY kind, spot, speech_id) AS rank FROM sp WHERE whose % 50 = 0), {AROUND}"


@query("j21_expand", f"""WITH {EXPANDED}, l AS (SELECT speech_id, count(*) AS n_laps, min(lap_number) AS first_lap FROM lf GROUP BY 1), e AS (SELECT speech_id, string_agg(event_type || printf(' %.2f', score), ', ' ORDER BY event_type, score) AS events FROM (SELECT DISTINCT speech_id, event_type, score, family FROM ev) GROUP BY 1), g AS (SELECT speech_id, string_agg(event_type || ' ' || driver, ', ' ORDER BY event_type) AS targets FROM tg GROUP BY 1)
  SELECT request_id, rank, speech_id, kind, text, speaker, driver, team, session, prev_text, next_text, coalesce(n_laps, 0) AS n_laps, first_lap, mentions, events, targets FROM expanded LEFT JOIN l USING (speech_id) LEFT JOIN e USING (speech_id) LEFT JOIN g USING (speech_id)""")
def j21(t):
    """Anchors with all that the graph knows around them, one walk away."""
    rows = expanded(t)
    joined = lambda name, of: F.when(F.size(name) > 0, F.array_join(F.transform(name, of), ", ")).alias(name)
    return rows.select(
        "request_id", "rank", "speech_id", "kind", "text", "speaker", "driver", "team", "session", "prev_text", "next_text", F.greatest(F.size("laps"), F.lit(0)).cast("long").alias("n_laps"), F.try_element_at("laps", F.lit(1))["lap_number"].alias("first_lap"),
        joined("mentions", lambda m: F.concat(m["name"], F.lit(" ("), m["kind"], F.lit(")"))), joined("events", lambda e: F.concat(e["event_type"], F.format_string(" %.2f", e["score"]))), joined("targets", lambda x: F.concat(x["event_type"], F.lit(" "), x["driver"])),
    )


def expanded(t):
    from ..operators.shared import stored

    speech = stored(context.speech_lines(t))
    return context.expand(t, call_anchors(t, speech), speech)


@query("j22_resolve", """WITH ids AS (SELECT call_id AS speech_id FROM v_radio WHERE driver_number % 50 = 0), g AS (SELECT call_id AS speech_id, text, 'graph' AS via FROM v_radio WHERE error IS NULL AND analyzed_s IS NOT NULL)
  SELECT speech_id, coalesce(g.text, r.text) AS text, coalesce(via, 'table') AS via FROM ids LEFT JOIN g USING (speech_id) LEFT JOIN (SELECT call_id AS speech_id, text FROM v_radio) r USING (speech_id)""")
def j22(t):
    """Facts from the graph's tables first; what is not there comes from the calls themselves."""
    ids = calls(t).where("driver_number % 50 = 0").select("speech_id")
    graph = good_calls(t).join(ids, "speech_id", "left_semi").select("speech_id", "text", F.lit("graph").alias("via"))
    rest = ids.join(graph, "speech_id", "left_anti")
    return graph.unionByName(calls(t).join(rest, "speech_id", "left_semi").select("speech_id", "text", F.lit("table").alias("via")))


@query("j23_spoken_by", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (trim(c_name) <> '' AND (contains(lower(trim(c_name)), 'customer#00000001') OR contains('customer#00000001', lower(trim(c_name))))) OR (trim(n_name) <> '' AND (contains(lower(trim(n_name)), 'customer#00000001') OR contains('customer#00000001', lower(trim(n_name)))))")
def j23(t):
    rows = t.customer.join(F.broadcast(t.nation), C("c_nationkey") == C("n_nationkey"))
    return j.spoken_by(rows, ["c_name", "n_name"], " Customer#00000001").select("c_custkey")


@query("j24_inherit", """WITH v AS (SELECT clip_id, local_label AS idx, coalesce(cluster_id, profile_id) % 3 AS voice, profile_id FROM v_clip_speakers), n AS (SELECT clip_id, voice, arg_max(profile_id, idx) AS p FROM v WHERE profile_id IS NOT NULL AND voice IS NOT NULL GROUP BY 1, 2)
  SELECT v.clip_id, idx, coalesce(profile_id, p) AS profile_id, profile_id IS NULL AND p IS NOT NULL AS inherited FROM v LEFT JOIN n ON v.clip_id = n.clip_id AND v.voice = n.voice""")
def j24(t):
    v = t.v_clip_speakers.select("clip_id", C("local_label").alias("idx"), (F.coalesce("cluster_id", "profile_id") % 3).alias("voice"), "profile_id")
    return j.inherit_identity(v).select("clip_id", "idx", "profile_id", "inherited")


@query("j25_profile_clips", "SELECT s.profile_id, s.clip_id, c.filename, c.created_at, s.speech_s FROM v_clip_speakers s JOIN v_clips c USING (clip_id) WHERE s.profile_id IS NOT NULL")
def j25(t):
    return t.v_clip_speakers.where("profile_id IS NOT NULL").join(t.v_clips.select("clip_id", "filename", "created_at"), "clip_id").select("profile_id", "clip_id", "filename", "created_at", "speech_s")


@query("j26_resolve_names", "SELECT token, s_suppkey AS id FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN '  ' || upper('supplier#' || lpad((c_custkey % 15)::VARCHAR, 9, '0')) ELSE c_name END AS token, c_custkey FROM customer) LEFT JOIN supplier ON lower(trim(token)) = lower(s_name)")
def j26(t):
    tokens = t.customer.select(F.when(C("c_custkey") % 3 == 0, F.concat(F.lit("  "), F.upper(F.concat(F.lit("supplier#"), F.lpad((C("c_custkey") % 15).cast("string"), 9, "0"))))).otherwise(C("c_name")).alias("token"))
    return j.resolve_names(tokens, t.supplier.select(C("s_suppkey").alias("id"), C("s_name").alias("name")))
