"""Queries of retrieval over tables of requests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import context, search
from ..operators import joins as j
from ..operators import retrieval as r
from ..operators import sequences as q
from .intervals import rounded
from .joins import AROUND, EXPANDED, SPEECH, expanded
from .registry import query

C = F.col
#: Requests by structured terms: all of, any of, none of, a phrase.
TERMS = [
    (1, 1, "all", "the", 0), (1, 2, "all", "was", 0), (2, 1, "any", "der", 0), (2, 1, "any", "les", 0), (2, 2, "none", "dans", 0), (3, 1, "phrase", "of", 0), (3, 1, "phrase", "the", 1),
    (4, 1, "all", "with", 0), (4, 2, "phrase", "in", 0), (4, 2, "phrase", "the", 1), (4, 3, "none", "from", 0),
]
TERM_SQL = "terms(request_id, clause_id, kind, term, off) AS (VALUES " + ", ".join(f"({a}, {b}, '{k}', '{x}', {o})" for a, b, k, x, o in TERMS) + ")"
POST_SQL = r"toks AS (SELECT speech_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM v_docs), post AS (SELECT speech_id, token, list(pos ORDER BY pos) AS positions FROM (SELECT speech_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM toks) GROUP BY 1, 2)"
MATCH_SQL = f"""{POST_SQL}, {TERM_SQL}, hits AS (SELECT * FROM post JOIN terms ON token = term),
  single AS (SELECT DISTINCT request_id, speech_id, clause_id FROM hits WHERE kind IN ('all', 'any')),
  st AS (SELECT request_id, speech_id, clause_id, off, unnest(positions) - off AS s FROM hits WHERE kind = 'phrase'),
  phrase AS (SELECT DISTINCT request_id, speech_id, clause_id FROM (SELECT request_id, speech_id, clause_id, s, count(DISTINCT off) AS n FROM st GROUP BY ALL) p WHERE n = (SELECT count(DISTINCT off) FROM terms t WHERE t.request_id = p.request_id AND t.clause_id = p.clause_id)),
  met AS (SELECT request_id, speech_id FROM (SELECT * FROM single UNION ALL SELECT * FROM phrase) m GROUP BY 1, 2 HAVING count(DISTINCT clause_id) = (SELECT count(DISTINCT clause_id) FROM terms t WHERE t.request_id = m.request_id AND kind <> 'none')),
  matched AS (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.kind = 'none' AND h.request_id = m.request_id AND h.speech_id = m.speech_id)),
  freq AS (SELECT m.request_id, m.speech_id, sum(len(positions))::BIGINT AS score FROM matched m JOIN hits h USING (request_id, speech_id) WHERE h.kind <> 'none' GROUP BY 1, 2)"""


def terms(t):
    return t.spark.createDataFrame(TERMS, "request_id long, clause_id long, kind string, term string, offset int")


def index_of(t):
    """The postings of the requests' terms alone, kept for the several uses of a search."""
    from ..operators.shared import checkpointed

    return checkpointed(r.postings(t.v_docs, terms(t)))


def few(t):
    return F.broadcast(terms(t))  # eleven rows


def matched(t):
    return r.match(r.postings(t.v_docs, terms(t)), few(t))


def by_count(t):
    """Matches with how often their terms occur."""
    index, wanted = index_of(t), F.broadcast(terms(t).where("kind <> 'none'"))
    n = index.join(wanted, index["token"] == wanted["term"]).groupBy("request_id", "speech_id").agg(F.sum(F.size("positions")).alias("score"))
    return r.match(index, few(t)).join(n, ["request_id", "speech_id"])


@query("r01_postings", f"WITH {POST_SQL} SELECT speech_id, token, len(positions) AS n, positions[1] AS first_pos FROM post")
def r01(t):
    return r.postings(t.v_docs).select("speech_id", "token", F.size("positions").alias("n"), F.element_at("positions", 1).alias("first_pos"))


@query("r02_match", f"WITH {MATCH_SQL} SELECT * FROM matched")
def r02(t):
    return matched(t)


def stored_index(t):
    """An index in two segments: the second brings what the first lacked or had in an older wording."""
    import uuid

    from ..operators.shared import shared_folder
    from ..operators.text_index import TextIndex

    index = TextIndex(t.spark, f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}")
    said = t.v_docs.select("speech_id", "text")
    older = F.when(C("speech_id") % 3 == 0, F.concat(F.lit("the was of the "), C("text"))).otherwise(C("text"))
    index.append(0, said.where("speech_id % 3 <> 2").withColumn("text", older))
    index.append(1, said.where("speech_id % 3 <> 1"))
    return index


@query("r02_stored_index", f"WITH {MATCH_SQL} SELECT * FROM matched")
def r02_stored(t):
    """The same matches from the stored index, of which the parts of the terms are read."""
    from ..operators.shared import stored

    return r.match(stored(stored_index(t).lookup(terms(t))), few(t))


COVER_SQL = f"""{POST_SQL}, {TERM_SQL}, wt AS (SELECT request_id, term, row_number() OVER (PARTITION BY request_id ORDER BY term) AS slot, count(*) OVER (PARTITION BY request_id) AS k FROM (SELECT DISTINCT request_id, term FROM terms WHERE kind <> 'none')),
  ps AS (SELECT request_id, speech_id, slot, k, unnest(positions) AS pos FROM post JOIN wt ON token = term),
  ls AS (SELECT request_id, speech_id, pos, k, {", ".join(f"max(CASE WHEN slot = {i} THEN pos END) OVER w AS l{i}" for i in (1, 2, 3))} FROM ps WINDOW w AS (PARTITION BY request_id, speech_id ORDER BY pos)),
  cv AS (SELECT request_id, speech_id, k, least(l1, l2, l3) AS b, min(pos) AS e FROM ls WHERE l1 IS NOT NULL AND (k < 2 OR l2 IS NOT NULL) AND (k < 3 OR l3 IS NOT NULL) GROUP BY ALL),
  cover AS (SELECT request_id, speech_id, sum(0.1::DOUBLE / (1 + (e - b + 1 - k))) AS rank FROM cv GROUP BY 1, 2)"""


@query("r03_cover_rank", f"WITH {COVER_SQL} SELECT request_id, speech_id, round(rank, 6) AS rank FROM cover")
def r03(t):
    return rounded(r.cover_rank(r.postings(t.v_docs, terms(t)), terms(t)), "rank")


@query("r03_merged_index", f"WITH {COVER_SQL} SELECT request_id, speech_id, round(rank, 6) AS rank FROM cover")
def r03_merged(t):
    """The same ranks from the stored index once its segments are merged."""
    from ..operators.shared import stored

    index = stored_index(t)
    index.merge(2)
    return rounded(r.cover_rank(stored(index.lookup(terms(t))), terms(t), counted=True), "rank")


@query("r04_keyword_search", f"WITH {MATCH_SQL}, rk AS (SELECT f.*, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, speech_id) AS rk FROM freq f JOIN v_docs d USING (speech_id) WHERE d.mood = 'calm') SELECT * FROM rk WHERE rk <= 20")
def r04(t):
    rows = by_count(t).join(t.v_docs.where("mood = 'calm'").select("speech_id"), "speech_id", "left_semi")
    return r.ranked(rows, "score", 20).select("request_id", "speech_id", "score", "rk")


VEC_SQL = "reqs AS (SELECT speech_id AS request_id, vec FROM v_speech_vectors WHERE speech_id % 50 = 0), vs AS (SELECT request_id, s.speech_id, list_inner_product(q.vec, s.vec) AS sim FROM v_speech_vectors s CROSS JOIN reqs q)"


def vector_requests(t):
    """Searches: the vectors whose id 50 divides, against all vectors."""
    return t.v_speech_vectors.where("speech_id % 50 = 0").select(C("speech_id").alias("request_id"), "vec")


def vector_leg(t, cap, only=None):
    """The speech nearest to each request; only: the speech (speech_id) that filters leave."""
    return r.nearest(vector_requests(t), t.v_speech_vectors.select("speech_id", "vec"), cap, only)


@query("r05_semantic_search", f"WITH {VEC_SQL} SELECT request_id, speech_id, round(sim, 6) AS sim, rk FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sim DESC, speech_id) AS rk FROM vs) WHERE rk <= 20")
def r05(t):
    return rounded(vector_leg(t, 20).select("request_id", "speech_id", "sim", "rk"), "sim")


@query("r06_hybrid", f"""WITH {MATCH_SQL}, {COVER_SQL.split(TERM_SQL + ", ")[1]}, {VEC_SQL}, ok AS (SELECT speech_id FROM v_docs WHERE mood = 'calm'),
  a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sim DESC, speech_id) AS rk FROM vs JOIN ok USING (speech_id)) WHERE rk <= 200),
  b AS (SELECT * FROM (SELECT q.request_id, c.speech_id, row_number() OVER (PARTITION BY q.request_id ORDER BY round(rank, 9) DESC, c.speech_id) AS rk FROM matched m JOIN cover c USING (request_id, speech_id) JOIN ok USING (speech_id) JOIN reqs q ON (q.request_id // 50) % 4 + 1 = m.request_id) WHERE rk <= 200)
  SELECT coalesce(a.request_id, b.request_id) AS request_id, coalesce(a.speech_id, b.speech_id) AS speech_id, round(coalesce(1.0::DOUBLE / (60 + a.rk), 0) + coalesce(1.0::DOUBLE / (60 + b.rk), 0), 9) AS score FROM a FULL JOIN b ON a.request_id = b.request_id AND a.speech_id = b.speech_id""")
def r06(t):
    """Requests of words and a vector: text leg (matches by how near their words stand) and vector leg, both over calm speech alone, 200 of each, fused by reciprocal rank."""
    calm = t.v_docs.where("mood = 'calm'").select("speech_id")
    index = index_of(t)
    found = r.match(index, few(t)).join(r.cover_rank(index, terms(t)), ["request_id", "speech_id"]).join(calm, "speech_id", "left_semi")
    # requests of the same words share a text leg: it is ranked and cut once for them all
    text = r.ranked(found.withColumn("rank", F.round("rank", 9)), "rank", 200).withColumnRenamed("request_id", "words")
    asks = vector_requests(t).select("request_id", (F.floor(C("request_id") / 50) % 4 + 1).alias("words"))
    return r.fuse(vector_leg(t, 200, calm), text.join(asks, "words")).select("request_id", "speech_id", F.round("score", 9).alias("score"))


@query("r07_radio_search", """SELECT call_id AS speech_id, score, rk FROM (SELECT call_id, score, row_number() OVER (ORDER BY score DESC, call_id) AS rk FROM (SELECT call_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x IN ('red', 'steel', 'small'))) AS score FROM v_radio WHERE error IS NULL AND analyzed_s IS NOT NULL AND mood = 'stressed') WHERE score > 0) WHERE rk <= 50""")
def r07(t):
    """Analysed calls of a mood by any of some words."""
    calls = t.v_radio.where("error IS NULL AND analyzed_s IS NOT NULL AND mood = 'stressed'").select(C("call_id").alias("speech_id"), "text")
    words = t.spark.createDataFrame([("red",), ("steel",), ("small",)], "term string")
    hits = r.postings(calls, words).groupBy("speech_id").agg(F.sum(F.size("positions")).alias("score")).withColumn("request_id", F.lit(1))
    return r.ranked(hits, "score", 50).select("speech_id", "score", "rk")


TONE = r"CASE WHEN regexp_matches({x}, '(?i)\b(stressed|stress|stressful)\b') THEN 'stressed' WHEN regexp_matches({x}, '(?i)\b(calm|relaxed)\b') THEN 'calm' WHEN regexp_matches({x}, '(?i)\b(tired|fatigued|exhausted)\b') THEN 'tired' END"
SAME = "a.mood IS NOT DISTINCT FROM x.mood AND a.profile_id IS NOT DISTINCT FROM x.profile_id"
SPLIT = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
#: Anchors of asked (request_id, topic, mood, profile_id, over) as anchored; topics have four words at most here.
ANCHORED = f"""tw AS (SELECT topic, mood, profile_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS slot, len(ws) AS k FROM (SELECT *, list_distinct({SPLIT.format(x="topic")}) AS ws FROM (SELECT DISTINCT topic, mood, profile_id FROM asked WHERE topic IS NOT NULL))),
  po AS (SELECT speech_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT speech_id, {SPLIT.format(x="text")} AS ts FROM sp)),
  ps AS (SELECT topic, mood, profile_id, speech_id, slot, k, pos FROM po JOIN tw ON token = term),
  ls AS (SELECT topic, mood, profile_id, speech_id, pos, k, {", ".join(f"max(CASE WHEN slot = {i} THEN pos END) OVER w AS l{i}" for i in (1, 2, 3, 4))} FROM ps WINDOW w AS (PARTITION BY topic, mood, profile_id, speech_id ORDER BY pos)),
  cv AS (SELECT topic, mood, profile_id, speech_id, k, least(l1, l2, l3, l4) AS b, min(pos) AS e FROM ls WHERE l1 IS NOT NULL AND (k < 2 OR l2 IS NOT NULL) AND (k < 3 OR l3 IS NOT NULL) AND (k < 4 OR l4 IS NOT NULL) GROUP BY ALL),
  co AS (SELECT topic, mood, profile_id, speech_id, sum(0.1::DOUBLE / (1 + (e - b + 1 - k))) AS score FROM cv GROUP BY ALL),
  tr AS (SELECT co.*, kind, row_number() OVER (PARTITION BY co.topic, co.mood, co.profile_id, kind ORDER BY round(score, 9) DESC, co.speech_id) AS rk FROM co JOIN sp USING (speech_id) WHERE (co.mood IS NULL OR co.mood = sp.mood) AND (co.profile_id IS NULL OR co.profile_id = sp.profile_id)),
  said AS (SELECT request_id, a.mood, over, 'topic' AS via, speech_id, kind, rk FROM asked a JOIN tr x ON a.topic = x.topic AND {SAME} WHERE rk <= over),
  toned AS (SELECT request_id, mood, profile_id, over, 'tone' AS via FROM asked WHERE topic IS NULL AND mood IS NOT NULL
    UNION ALL SELECT request_id, m, profile_id, over, 'fallback' FROM (SELECT *, {TONE.format(x="topic")} AS m FROM asked a WHERE topic IS NOT NULL AND mood IS NULL AND profile_id IS NULL AND NOT EXISTS (SELECT 1 FROM tr x WHERE a.topic = x.topic AND {SAME})) WHERE m IS NOT NULL),
  nw AS (SELECT mood, NULL::BIGINT AS profile_id, speech_id, kind, row_number() OVER (PARTITION BY mood, kind ORDER BY newest DESC NULLS LAST, CASE WHEN kind = 'utterance' THEN spot END, speech_id) AS rk FROM sp WHERE mood IS NOT NULL
    UNION ALL SELECT mood, profile_id, speech_id, kind, row_number() OVER (PARTITION BY mood, profile_id ORDER BY newest DESC NULLS LAST, spot, speech_id) FROM sp WHERE kind = 'utterance' AND profile_id IS NOT NULL AND mood IS NOT NULL),
  latest AS (SELECT request_id, a.mood, over, via, speech_id, kind, rk FROM toned a JOIN nw x ON {SAME} WHERE rk <= over),
  anchored AS (SELECT request_id, via, mood, rank, speech_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rk, kind DESC) AS rank FROM (SELECT * FROM said UNION ALL SELECT * FROM latest)) WHERE rank <= over)"""


def spoken_lines(t):
    """All speech, computed once for the several uses of a search."""
    from ..operators.shared import stored

    return stored(context.speech_lines(t))


@query("r08_browse_mood", f"WITH {SPEECH}, asked AS (SELECT m AS request_id, NULL::VARCHAR AS topic, m AS mood, NULL::BIGINT AS profile_id, 30 AS over FROM (VALUES ('calm'), ('stressed'), ('tired')) v(m)), {ANCHORED} SELECT mood, speech_id, rank AS place FROM anchored")
def r08(t):
    """The newest speech of each mood, utterances and calls in turn."""
    asked = t.spark.createDataFrame([(m, None, m, None, 30) for m in search.MOODS], "request_id string, topic string, mood string, profile_id long, over int")
    return search.anchors(asked, spoken_lines(t)).select("mood", "speech_id", C("rank").alias("place"))


R09_ASKED = "asked AS (SELECT p_partkey AS request_id, CASE p_partkey // 10 % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 3 THEN 'words of part ' || p_partkey END AS topic, CASE p_partkey // 10 % 3 WHEN 1 THEN 'stressed' WHEN 2 THEN 'calm' END AS mood, CASE WHEN p_partkey // 10 % 5 = 0 THEN p_partkey % 100 + 1 END AS profile_id, 10 AS over FROM part WHERE p_partkey % 10 = 0)"


def anchor_requests(t):
    """Requests made of every tenth part: by its name, its first word, a tone alone or what is said of it; some with a tone, some with a speaker."""
    kind = "cast(p_partkey / 10 AS bigint)"
    return t.part.where("p_partkey % 10 = 0").selectExpr(
        "p_partkey AS request_id", f"CASE {kind} % 4 WHEN 0 THEN p_name WHEN 1 THEN substring_index(p_name, ' ', 1) WHEN 3 THEN concat('words of part ', p_partkey) END AS topic",
        f"CASE {kind} % 3 WHEN 1 THEN 'stressed' WHEN 2 THEN 'calm' END AS mood", f"CASE WHEN {kind} % 5 = 0 THEN p_partkey % 100 + 1 END AS profile_id", "10 AS over",
    )


@query("r09_anchor", f"WITH {SPEECH}, {R09_ASKED}, {ANCHORED} SELECT request_id, via, rank, speech_id FROM anchored")
def r09(t):
    """Anchors of a table of requests by topic and tone with a speaker filter, both kinds of speech fused by rank."""
    return search.anchors(anchor_requests(t), spoken_lines(t)).select("request_id", "via", "rank", "speech_id")


ABSENT = "{x} IS NULL OR lower(trim({x})) IN ('', 'null', 'none', 'undefined', 'nil', 'n/a', 'na', '-')"
R10_ASKED = f"""raw AS (SELECT user_id AS request_id, x, CASE x % 7 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN ' None ' WHEN 2 THEN 'which calls sound stressed' WHEN 3 THEN ' ' || p_name WHEN 4 THEN 'n/a' WHEN 5 THEN 'words of part' ELSE 'anyone tired' END AS query,
      CASE x % 5 WHEN 1 THEN ' Calm' WHEN 2 THEN 'null' WHEN 3 THEN 'tired' WHEN 4 THEN CASE WHEN x % 3 = 0 THEN 'angry' END END AS mood, CASE x % 4 WHEN 1 THEN 'none' WHEN 2 THEN 'customer#00000000' || x % 10 WHEN 3 THEN 'Supplier#000000001 of the team' END AS spoken_by, x % 40 - 3 AS lim
    FROM (SELECT user_id, max(event_id) AS x FROM events GROUP BY 1) LEFT JOIN part ON p_partkey = x % 200 + 1),
  clean AS (SELECT request_id, CASE WHEN NOT ({ABSENT.format(x="query")}) THEN trim(query) END AS topic, CASE WHEN NOT ({ABSENT.format(x="mood")}) THEN lower(trim(mood)) END AS mood, CASE WHEN NOT ({ABSENT.format(x="spoken_by")}) THEN lower(trim(spoken_by)) END AS who, greatest(1, least(25, coalesce(nullif(lim, 0), 8))) AS most FROM raw),
  judged AS (SELECT *, CASE WHEN mood NOT IN ('calm', 'stressed', 'tired') THEN 'tone' WHEN topic IS NULL AND mood IS NULL THEN 'empty' END AS refused FROM clean),
  asked AS (SELECT request_id, topic, mood, NULL::BIGINT AS profile_id, CASE WHEN who IS NULL THEN most ELSE 6 * most END AS over FROM judged WHERE refused IS NULL)"""
BRIEF = r"""'[' || speech_id || '] ' || coalesce(driver, speaker, 'unidentified speaker') || coalesce(', ' || session, '') || coalesce(', lap ' || fl, '') || coalesce(', voice reads ' || mood, '') || ': "' || CASE WHEN length(f) > 160 THEN rtrim(substr(f, 1, 159)) || '…' ELSE f END || '"'"""
NAMED = " OR ".join(f"coalesce(trim({c}) <> '' AND (contains(lower(trim({c})), who) OR contains(who, lower(trim({c})))), false)" for c in ("driver", "speaker", "team"))


def search_requests(t):
    """A request of every user: topics, words for nothing, tones in words or as labels, names in parts or with more around, limits out of bounds."""
    asks = t.events.groupBy("user_id").agg(F.max("event_id").alias("x")).join(t.part.select("p_partkey", "p_name"), C("p_partkey") == C("x") % 200 + 1, "left")
    return asks.selectExpr(
        "user_id AS request_id",
        "CASE x % 7 WHEN 0 THEN substring_index(p_name, ' ', 1) WHEN 1 THEN ' None ' WHEN 2 THEN 'which calls sound stressed' WHEN 3 THEN concat(' ', p_name) WHEN 4 THEN 'n/a' WHEN 5 THEN 'words of part' ELSE 'anyone tired' END AS query",
        "CASE x % 5 WHEN 1 THEN ' Calm' WHEN 2 THEN 'null' WHEN 3 THEN 'tired' WHEN 4 THEN CASE WHEN x % 3 = 0 THEN 'angry' END END AS mood",
        "CASE x % 4 WHEN 1 THEN 'none' WHEN 2 THEN concat('customer#00000000', x % 10) WHEN 3 THEN 'Supplier#000000001 of the team' END AS spoken_by", "x % 40 - 3 AS `limit`",
    )


@query("r10_search_requests", rf"""WITH {SPEECH}, {R10_ASKED}, {ANCHORED}, a AS (SELECT request_id, speech_id, rank FROM anchored), {AROUND},
  fl AS (SELECT speech_id, min(lap_number) AS fl FROM lf GROUP BY 1),
  hits AS (SELECT e.*, via, fl, most, trim(regexp_replace(coalesce(e.text, ''), '\s+', ' ', 'g')) AS f, row_number() OVER (PARTITION BY e.request_id ORDER BY e.rank) AS place FROM expanded e JOIN anchored an ON an.request_id = e.request_id AND an.rank = e.rank JOIN judged j ON j.request_id = e.request_id LEFT JOIN fl ON fl.speech_id = e.speech_id WHERE who IS NULL OR {NAMED})
  SELECT request_id, 'found' AS status, via, place, speech_id, {BRIEF} AS line FROM hits WHERE place <= most
  UNION ALL SELECT request_id, coalesce(refused, CASE WHEN request_id IN (SELECT request_id FROM anchored) THEN 'nobody' ELSE 'nothing' END), NULL, NULL, NULL, NULL FROM judged WHERE request_id NOT IN (SELECT request_id FROM hits)""")
def r10(t):
    """The whole search for a table of requests: cleaned, anchored, filled up by tone, expanded, filtered by speaker, cut, told in lines."""
    speech = spoken_lines(t)
    return search.search(search_requests(t), speech, lambda ids: context.neighbourhood(t, ids, speech))


#: An expanded anchor as the lines that are shown of it; what is missing is left out.
BLOCKS = """lt AS (SELECT speech_id, string_agg('  lap ' || lap_number || ': ' || printf('%.1f', duration_s) || 's' || coalesce(' (' || printf('%+.1f', duration_s - prev_s) || 's vs previous)', ''), chr(10) ORDER BY lap_number, duration_s, prev_s NULLS FIRST) AS lines FROM lf GROUP BY 1),
  el AS (SELECT e.speech_id, string_agg('  on track: reads as ' || replace(event_type, '_', ' ') || coalesce(', involving ' || driver, '') || printf(' (%.2f)', score), chr(10) ORDER BY event_type, score, family) AS seen FROM (SELECT DISTINCT speech_id, event_type, score, family FROM ev) e LEFT JOIN tg USING (speech_id, event_type) GROUP BY 1),
  toneof AS (SELECT *, concat_ws(', ', 'voice reads ' || mood, 'words read ' || sentiment || coalesce(' (' || printf('%+.2f', sentiment_score) || ')', ''), CASE WHEN text_sentiment <> sentiment THEN 'text alone reads ' || text_sentiment END) AS tone FROM expanded),
  blocks AS (SELECT e.request_id, e.rank, concat_ws(chr(10), '[' || e.speech_id || '] ' || concat_ws(' | ', CASE WHEN session IS NOT NULL THEN concat_ws(' ', session, year::VARCHAR) ELSE circuit END, coalesce(driver, speaker, 'unidentified speaker') || coalesce(' (' || team || ')', '')), CASE WHEN tone <> '' THEN '  tone: ' || tone END, '  "' || trim(e.text) || '"', lt.lines, el.seen, '  mentions: ' || e.mentions, '  before: "' || trim(e.prev_text) || '"', '  after: "' || trim(e.next_text) || '"') AS block FROM toneof e LEFT JOIN lt USING (speech_id) LEFT JOIN el USING (speech_id)),
  sized AS (SELECT *, sum(length(block) + 2) OVER (PARTITION BY request_id ORDER BY rank) AS upto, sum(length(block) + 2) OVER (PARTITION BY request_id) - 2 AS total FROM blocks)"""
BODY = "SELECT request_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS body FROM sized WHERE total <= {n} OR upto <= {n} GROUP BY 1"


@query("r11_render_context", f"WITH {EXPANDED}, {BLOCKS} {BODY.format(n=4000)}")
def r11(t):
    return q.truncate_blocks(r.block(expanded(t)).select("request_id", "rank", "block"), "request_id", 4000)


@query("r12_render_brief", rf"WITH {EXPANDED}, fl AS (SELECT speech_id, min(lap_number) AS fl FROM lf GROUP BY 1), e AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS f FROM expanded) SELECT request_id, rank, {BRIEF} AS line FROM e LEFT JOIN fl USING (speech_id)")
def r12(t):
    return r.brief(expanded(t)).select("request_id", "rank", "line")


@query("r13_driver_timeline", """WITH l AS (SELECT *, CASE WHEN lag(lap_number) OVER w = lap_number - 1 THEN lag(duration_s) OVER w END AS prev_s FROM v_laps WINDOW w AS (PARTITION BY session_key, driver_number ORDER BY lap_number)),
  s AS (SELECT DISTINCT l.session_key, l.driver_number, lap_number, call_id, r.text, mood FROM v_laps l JOIN v_radio r ON r.session_key = l.session_key AND r.driver_number = l.driver_number AND recorded_s >= start_s - 86400 AND recorded_s < start_s + duration_s + 86400 WHERE error IS NULL AND analyzed_s IS NOT NULL AND duration_s IS NOT NULL),
  q AS (SELECT session_key, driver_number, lap_number, string_agg('    [' || call_id || ']' || coalesce(' (' || mood || ')', '') || ' "' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || '"', chr(10) ORDER BY call_id) AS quotes FROM s GROUP BY ALL),
  b AS (SELECT session_key, driver_number, string_agg('  lap ' || lap_number || coalesce(': ' || printf('%.1f', duration_s) || 's' || coalesce(' (' || printf('%+.1f', duration_s - prev_s) || 's)', ''), '') || chr(10) || quotes, chr(10) ORDER BY lap_number) AS lines FROM l JOIN q USING (session_key, driver_number, lap_number) GROUP BY ALL),
  h AS (SELECT session_key, driver_number, count(*) || ' laps' || coalesce(' | fastest ' || printf('%.1f', min(duration_s)) || 's | median ' || printf('%.1f', (list(duration_s ORDER BY duration_s) FILTER (duration_s IS NOT NULL))[count(duration_s) // 2 + 1]) || 's | slowest ' || printf('%.1f', max(duration_s)) || 's', '') AS head FROM v_laps GROUP BY ALL)
  SELECT session_key, driver_number, head || chr(10) || coalesce(lines, '  (no radio landed on any lap in this session)') AS body FROM h LEFT JOIN b USING (session_key, driver_number)""")
def r13(t):
    """Every driver's laps with what was said on them, under the pace of all laps."""
    from ..operators.rollups import driver_timeline
    from .joins import DAY, good_calls

    calls = good_calls(t)
    said = j.during_lap(calls, t.v_laps, DAY, 30 * DAY).join(calls.select("speech_id", "text", "mood"), "speech_id")
    return driver_timeline(t.v_laps, said)


@query("r14_graph_context", f"""WITH {SPEECH}, {R09_ASKED}, {ANCHORED}, a AS (SELECT request_id, speech_id, rank FROM anchored UNION ALL SELECT -whose, speech_id, row_number() OVER (PARTITION BY whose ORDER BY newest DESC, speech_id) FROM sp WHERE kind = 'radio_call' AND whose % 50 = 0), {AROUND}, {BLOCKS}
  SELECT request_id, body, (SELECT count(*) FROM blocks b WHERE b.request_id = x.request_id) AS n_anchors FROM ({BODY.format(n=1200)}) x""")
def r14(t):
    """Anchors, searched or given by id (negative requests: all calls of a driver), expanded and rendered as evidence."""
    from ..operators.shared import stored

    speech = spoken_lines(t)
    given = speech.where("kind = 'radio_call' AND whose % 50 = 0").select((-C("whose")).alias("request_id"), F.row_number().over(Window.partitionBy("whose").orderBy(F.desc("newest"), "speech_id")).alias("rank"), "speech_id")
    found = search.anchors(anchor_requests(t), speech).select("request_id", "rank", "speech_id").unionByName(given)
    blocks = stored(r.block(context.expand(t, stored(found), speech)).select("request_id", "rank", "block"))
    return q.truncate_blocks(blocks, "request_id", 1200).join(blocks.groupBy("request_id").agg(F.count("*").alias("n_anchors")), "request_id")
