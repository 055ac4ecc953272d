"""The adapters' views as SQL, for queries that another engine runs over the same tables."""

from __future__ import annotations

import re



def uuid_of(x: str) -> str:
    return rf"regexp_replace(md5(({x})::VARCHAR), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


VIEWS = {
    "v_utterances": r"""SELECT conv_id * 1000 + turn AS utterance_id, conv_id AS clip_id, turn AS idx, role AS local_label, text, n_words,
        0.4::DOUBLE * prior + 0.5::DOUBLE * turn AS start_s, 0.4::DOUBLE * prior + 0.5::DOUBLE * turn + 0.4::DOUBLE * n_words AS end_s
      FROM (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
            FROM (SELECT *, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_words FROM conversations))""",
    "v_phrases": r"""SELECT utterance_id * 10000 + pos AS utterance_id, clip_id, idx * 10000 + pos AS idx, local_label, text, n_words, start_s + 0.4::DOUBLE * prior + 0.25::DOUBLE * pos AS start_s, start_s + 0.4::DOUBLE * prior + 0.25::DOUBLE * pos + 0.4::DOUBLE * n_words AS end_s
      FROM (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY utterance_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
            FROM (SELECT utterance_id, clip_id, idx, local_label, start_s, text, pos, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_words
                  FROM (SELECT utterance_id, clip_id, idx, local_label, start_s, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS pos FROM (SELECT * REPLACE (NULL AS text), regexp_split_to_array(text, '[.,!?;:]+') AS ps FROM v_utterances)))
            WHERE n_words > 0)""",
    "v_words": r"""SELECT clip_id, idx, word_ix, idx * 100000 + word_ix AS word_id, word, local_label,
        start_s + 0.4::DOUBLE * word_ix AS start_s, start_s + 0.4::DOUBLE * word_ix + 0.35::DOUBLE AS end_s, 0.5::DOUBLE + ((word_ix * 37) % 50) / 100.0::DOUBLE AS probability
      FROM (SELECT clip_id, idx, local_label, start_s, unnest(ws) AS word, generate_subscripts(ws, 1)::INT - 1 AS word_ix
            FROM (SELECT *, regexp_extract_all(text, '\S+') AS ws FROM v_utterances))""",
    "v_word_turns": """SELECT clip_id, idx * 1000000 AS turn_id, local_label AS label, start_s + 0.3::DOUBLE AS start_s, end_s + 0.3::DOUBLE AS end_s FROM v_utterances
      UNION ALL SELECT clip_id, idx * 1000000 + word_ix + 1, 'interjection', start_s + 0.1::DOUBLE, start_s + 0.3::DOUBLE FROM v_words WHERE word_ix % 5 = 4""",
    "v_turns": "SELECT user_id AS clip_id, event_id AS turn_id, event_type AS label, epoch_us(ts) / 1000000.0::DOUBLE AS start_s, epoch_us(ts) / 1000000.0::DOUBLE + 600.0::DOUBLE * value AS end_s FROM events",
    "v_vad": """SELECT clip_id, min(start_s) AS start_s, max(end_s) AS end_s FROM (
        SELECT *, sum(CASE WHEN prior IS NULL OR start_s - prior > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT *, max(end_s) OVER (PARTITION BY clip_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (
            SELECT user_id AS clip_id, epoch_us(ts) / 1000000.0::DOUBLE AS start_s, epoch_us(ts) / 1000000.0::DOUBLE + 300.0::DOUBLE * value AS end_s FROM events WHERE event_type IN ('view', 'click'))))
      GROUP BY clip_id, island""",
    "v_frames": "SELECT user_id AS clip_id, event_id AS frame_id, epoch_us(ts) / 1000000.0::DOUBLE AS at_s, ((event_id * 7919) % 2001 - 1000) / 1000.0::DOUBLE AS amp FROM events",
    "v_clips": """SELECT o_orderkey AS clip_id, o_custkey AS race_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'REJECTED' ELSE 'QUEUED' END AS status,
        floor(o_totalprice * 100)::BIGINT % 200000 / 100000.0::DOUBLE - 1 AS sentiment_score, 'clip_' || o_orderkey AS filename, o_orderkey % 7 = 0 AS needs_review,
        CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'es' END AS language, (10 + o_orderkey % 50)::DOUBLE AS duration_s,
        CASE o_orderkey % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'fair' WHEN 2 THEN 'poor' END AS grade FROM orders""",
    "v_clip_speakers": """SELECT l_orderkey AS clip_id, l_linenumber::BIGINT AS local_label, CASE WHEN l_returnflag = 'A' THEN l_suppkey END AS profile_id, CASE WHEN l_returnflag = 'N' THEN l_suppkey END AS cluster_id,
        l_quantity::DOUBLE AS speech_s, round(l_discount * 10, 1)::DOUBLE AS reliability,
        CASE round(l_tax * 100)::BIGINT % 4 WHEN 0 THEN 'confident' WHEN 1 THEN 'suggested' WHEN 2 THEN 'unknown' ELSE 'abstained' END AS match_result,
        (l_partkey % 100)::DOUBLE / 100 AS match_score, l_partkey AS part, l_shipdate AS shipped
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem) WHERE nth = 1""",
    "v_speech_utt": """SELECT clip_id * 10 + local_label AS utterance_id, clip_id, local_label AS idx, local_label, profile_id, cluster_id, speech_s, 'words of part ' || part AS text,
        CASE part % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'stressed' WHEN 2 THEN 'tired' END AS mood, (part * 31 % 201 - 100) / 100.0::DOUBLE AS sentiment_score, (part * 57 % 201 - 100) / 100.0::DOUBLE AS text_score,
        CASE WHEN part * 31 % 201 - 100 > 20 THEN 'positive' WHEN part * 31 % 201 - 100 < -20 THEN 'negative' ELSE 'neutral' END AS sentiment,
        CASE WHEN part * 57 % 201 - 100 > 20 THEN 'positive' WHEN part * 57 % 201 - 100 < -20 THEN 'negative' ELSE 'neutral' END AS text_sentiment FROM v_clip_speakers""",
    "v_laps": """SELECT o_custkey % 10 AS session_key, o_custkey AS driver_number, lap_number, at_s AS start_s, least(nxt - at_s, 90 * 86400)::DOUBLE AS duration_s
      FROM (SELECT o_custkey, row_number() OVER w AS lap_number, epoch(o_orderdate::TIMESTAMP)::BIGINT AS at_s, epoch((lead(o_orderdate) OVER w)::TIMESTAMP)::BIGINT AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""",
    "v_radio": """SELECT o_custkey || '-' || o_orderkey || '-' || l_partkey || '-' || strftime(l_shipdate, '%Y%m%d') AS call_id, o_custkey % 10 AS session_key, o_custkey AS driver_number,
        epoch(l_shipdate::TIMESTAMP)::BIGINT AS recorded_s, p_name AS text, CASE WHEN l_partkey % 17 = 0 THEN 'failed' END AS error, CASE WHEN l_partkey % 13 <> 0 THEN epoch(l_shipdate::TIMESTAMP)::BIGINT + 60 END AS analyzed_s,
        CASE l_partkey % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'stressed' WHEN 2 THEN 'tired' END AS mood
      FROM (SELECT DISTINCT o_custkey, o_orderkey, l_partkey, l_shipdate, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "v_drivers": "SELECT c_custkey % 10 AS session_key, c_custkey AS driver_number, c_name AS name, c_nationkey AS team_key, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 100 + 1 END AS profile_id FROM customer",
    "v_sessions": "SELECT n_nationkey::BIGINT AS session_key, n_name AS circuit, 'Session ' || n_nationkey AS name, 2015 + n_nationkey % 5 AS year, n_regionkey AS country_key FROM nation WHERE n_nationkey < 10",
    "v_races": "SELECT c_custkey AS race_id, 'Race ' || c_custkey AS name, CASE WHEN c_custkey % 4 <> 3 THEN c_custkey % 10 END AS session_key FROM customer",
    "v_profiles_named": "SELECT s_suppkey AS profile_id, s_name AS name, s_nationkey AS nation_key, CASE WHEN s_suppkey % 5 = 0 THEN 'claimed' ELSE 'confirmed' END AS status FROM supplier",
    "v_voices": """SELECT vec_id, label, list_transform(m, lambda x: x / n) AS voice, (0.5 + vec_id % 9)::DOUBLE AS speech_s, (vec_id % 30)::DOUBLE AS snr_db, (4000 + vec_id % 5 * 1000)::DOUBLE AS bandwidth_hz
      FROM (SELECT *, sqrt(list_inner_product(m, m)) AS n FROM (
        SELECT e.vec_id, e.label::BIGINT AS label, list_transform(list_zip(a.anchor, e.embedding::DOUBLE[]), lambda p: p[1] + (0.5 + 0.5 * (e.vec_id % 5))::DOUBLE * p[2]) AS m
        FROM embeddings e JOIN (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS anchor FROM embeddings GROUP BY label) a ON e.label = a.label))""",
    "v_reliable": """SELECT *, sqrt(least(1, speech_s / 8)) * (0.5 + 0.5 * (0.5 * greatest(0, least(1, (snr_db - 5) / 20)) + 0.3 + 0.2 * greatest(0, least(1, (bandwidth_hz - 3000) / 5000)))) AS reliability FROM v_voices""",
    "v_enrollments": "SELECT vec_id, label AS profile_id, voice AS vec, speech_s, reliability FROM v_reliable WHERE vec_id % 2 = 0",
    "v_queries": "SELECT vec_id AS query_id, label AS true_label, voice AS vec, speech_s, reliability FROM v_reliable WHERE vec_id % 2 = 1",
    "v_exemplars": "SELECT vec_id AS exemplar_id, CASE WHEN label = 9 THEN 'none' ELSE 'type_' || label END AS event_type, voice AS vec FROM v_voices WHERE vec_id < 40",
    "v_speech_vectors": "SELECT vec_id AS speech_id, voice AS vec, vec_id % 11 + 2 AS n_words, label FROM v_voices",
    "v_centroids": """SELECT profile_id, list_transform(s, lambda x: x / sqrt(list_inner_product(s, s))) AS centroid FROM (
        SELECT profile_id, list(sx ORDER BY i) AS s FROM (SELECT profile_id, i, sum(reliability * x) AS sx FROM (SELECT profile_id, reliability, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v_enrollments) GROUP BY profile_id, i) GROUP BY profile_id)""",
    "v_docs": "SELECT doc_id AS speech_id, text, source, lang, regexp_extract(source, '[0-9]+$')::BIGINT AS session_key, CASE doc_id % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'stressed' WHEN 2 THEN 'tired' END AS mood FROM documents",
    "v_aliases": """SELECT DISTINCT lower(p_name) AS alias, 'part' AS entity_type, lower(p_name) AS entity_key FROM part
      UNION ALL SELECT DISTINCT lower(split_part(p_name, ' ', 1)), 'word', lower(split_part(p_name, ' ', 1)) FROM part
      UNION ALL SELECT lower(n_name), 'nation', n_nationkey::VARCHAR FROM nation""",
    "v_graph_aliases": "SELECT alias, entity_type, CASE entity_type WHEN 'driver' THEN (n * 7)::VARCHAR WHEN 'team' THEN n::VARCHAR ELSE n_name END AS entity_key FROM (SELECT alias, length(alias) AS n, CASE length(alias) % 3 WHEN 0 THEN 'driver' WHEN 1 THEN 'team' ELSE 'circuit' END AS entity_type FROM (SELECT DISTINCT lower(p_name) AS alias FROM part)) LEFT JOIN nation ON n_nationkey = n % 12",
    "v_incoming": """SELECT 1 AS batch, doc_id AS file_id, text AS content, source AS race FROM documents
      UNION ALL SELECT 2, doc_id + 1000000000, text, source || '-b' FROM documents WHERE doc_id % 3 = 0""",
    "v_replies": r"""SELECT utterance_id AS batch_id, 5 AS batch_size, CASE WHEN utterance_id % 7 = 0 THEN 'sorry, ' || text WHEN utterance_id % 7 = 3 THEN '[{"n": 1, "event": "overtake" broken'
      ELSE 'Here: ```json [{"n": ' || utterance_id % 8 || ', "event": "' || CASE utterance_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'overtake' WHEN 2 THEN 'pit_stop' WHEN 3 THEN 'invented' ELSE 'yellow_flag' END || '", "confidence": ' || utterance_id % 11 / 10.0::DOUBLE || ', "other_car": " car ' || utterance_id % 20 || ' ", "why": "' || regexp_replace(text, '[^A-Za-z ]', ' ', 'g') || '"}, {"n": 2, "event": "overtake", "confidence": 0.9}]``` done' END AS reply
      FROM v_utterances""",
    "v_answers": f"""SELECT utterance_id, CASE WHEN utterance_id % 3 = 0 THEN text ELSE text || ' [' || {uuid_of("utterance_id")} || '] and ' || upper({uuid_of("utterance_id - 1")}) || ', again ' || {uuid_of("utterance_id")} || '; not ' || {uuid_of("utterance_id + 1")} || 'f' END AS answer,
        [{", ".join(uuid_of(f"utterance_id + {i}") for i in (0, 1, 1, 2, 3, 4, 5, 6, 7))}] AS consulted FROM v_utterances""",
    "v_audit": "SELECT user_id AS actor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS action, epoch_us(ts) // 1000000 AS at_s, 'object-' || event_id AS object, strftime(ts, '%Y-%m-%d') AS day, (event_id % 3)::VARCHAR AS before, (event_id % 4)::VARCHAR AS after FROM events",
}


def with_views(sql: str) -> str:
    """The SQL with the views that it names, and those that they name, before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    return f"WITH {'RECURSIVE ' * recursive}{head}{',' + body[4 + 10 * recursive :] if body.upper().startswith('WITH') else chr(10) + body}"
