"""Queries of voice identity and of vectors that read events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import mean_direction, weighted_centroid
from ..operators import identity as v
from .intervals import rounded
from .registry import query

C = F.col


def profiles(t):
    return v.centroids(t.v_enrollments)


@query("v01_centroids", "SELECT profile_id, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM v_centroids")
def v01(t):
    return profiles(t).select("profile_id", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


SIMS = "sims AS (SELECT query_id, profile_id, list_inner_product(vec, centroid) AS sim FROM v_queries CROSS JOIN v_centroids), knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, profile_id) AS rank FROM sims) WHERE rank <= 10)"


@query("v02_knn_profiles", f"WITH {SIMS} SELECT query_id, profile_id, round(sim, 6) AS sim, rank FROM knn")
def v02(t):
    return rounded(v.knn(t.v_queries, profiles(t)).select("query_id", "profile_id", "sim", "rank"), "sim")


IDENTIFIED = f"""{SIMS}, per AS (SELECT query_id, max(profile_id) FILTER (rank = 1) AS top, max(sim) FILTER (rank = 1) AS score, max(profile_id) FILTER (rank = 2) AS sid, coalesce(max(sim) FILTER (rank = 2), 0) AS second, count(*) FILTER (rank > 1) AS n, avg(sim) FILTER (rank > 1) AS mean, stddev_pop(sim) FILTER (rank > 1) AS sd FROM knn GROUP BY 1),
  z AS (SELECT q.query_id, q.true_label, q.reliability, q.speech_s, top, score, sid, score - second AS margin, CASE WHEN n >= 3 THEN (score - mean) / greatest(sd, 0.05) END AS z, 0.55 + 0.1 * (1 - reliability) AS lim FROM v_queries q LEFT JOIN per USING (query_id)),
  sure AS (SELECT *, score >= lim AND margin >= 0.04 AND (z IS NULL OR z >= 1.5) AS sure FROM z),
  identified AS (SELECT *, CASE WHEN score IS NULL THEN 'unknown' WHEN sure AND reliability >= 0.45 THEN 'confident' WHEN sure THEN 'suggested' WHEN score >= lim - 0.08 THEN 'suggested' ELSE 'unknown' END AS result FROM sure)"""


@query("v03_identify", f"WITH {IDENTIFIED} SELECT query_id, result, CASE WHEN result <> 'unknown' THEN top END AS profile_id, CASE WHEN result <> 'unknown' THEN sid ELSE top END AS runner_up, round(score, 6) AS score, round(margin, 6) AS margin, round(z, 5) AS z FROM identified")
def v03(t):
    return rounded(v.identify(t.v_queries, profiles(t)), "score", "margin").withColumn("z", F.round("z", 5))


FLAGGED = """own AS (SELECT e.*, list_inner_product(vec, centroid) AS sim FROM v_enrollments e JOIN v_centroids USING (profile_id)), fl AS (SELECT *, count(*) OVER p >= 4 AND sim < avg(sim) OVER p - 2 * stddev_pop(sim) OVER p AND sim < 0.5 AS bad FROM own WINDOW p AS (PARTITION BY profile_id))"""


@query("v04_recompute_profiles", f"""WITH {FLAGGED}, s AS (SELECT profile_id, count(*) AS n_enrollments, count(*) FILTER (bad) AS n_outliers, avg(sim) AS cohesion, sum(speech_s) AS speech_s, avg(reliability) AS mean_reliability FROM fl GROUP BY 1)
  SELECT p.i AS profile_id, coalesce(n_enrollments, 0) AS n_enrollments, coalesce(n_outliers, 0) AS n_outliers, round(cohesion, 6) AS cohesion, coalesce(speech_s, 0) AS speech_s, round(mean_reliability, 6) AS mean_reliability FROM (SELECT DISTINCT label::BIGINT AS i FROM embeddings UNION SELECT 99) p LEFT JOIN s ON s.profile_id = p.i""")
def v04(t):
    ids = t.embeddings.select(C("label").cast("long").alias("profile_id")).union(t.embeddings.select(F.lit(99).cast("long"))).distinct()
    return rounded(v.recompute_profiles(ids, t.v_enrollments).drop("centroid"), "cohesion", "mean_reliability")


@query("v05_enroll", """WITH e AS (SELECT profile_id, vec, reliability FROM v_enrollments UNION ALL SELECT true_label, vec, reliability FROM v_queries WHERE query_id % 5 <> 3), s AS (SELECT profile_id, i, sum(reliability * x) AS sx FROM (SELECT profile_id, reliability, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM e) GROUP BY 1, 2)
  SELECT profile_id, round(max(sx) / sqrt(sum(sx * sx)), 6) AS largest, (SELECT count(*) FROM e WHERE e.profile_id = s.profile_id) AS n FROM s GROUP BY 1""")
def v05(t):
    """New enrollments join the old ones; those without a reliability are refused."""
    new = t.v_queries.select(C("true_label").alias("profile_id"), "vec", F.when(C("query_id") % 5 != 3, C("reliability")).alias("reliability"))
    every = t.v_enrollments.select("profile_id", "vec", "reliability").unionByName(new.where("reliability >= 0"))
    n = every.groupBy("profile_id").agg(F.count("*").alias("n"))
    return rounded(v.centroids(every).join(n, "profile_id").select("profile_id", F.array_max("centroid").alias("largest"), "n"), "largest")


@query("v06_auto_enroll", f"WITH {IDENTIFIED} SELECT query_id, top AS profile_id FROM identified JOIN v_profiles_named p ON p.profile_id = top AND p.status = 'confirmed' WHERE result = 'confident' AND reliability >= 0.75 AND score >= 0.85")
def v06(t):
    return v.auto_enroll(v.identify(t.v_queries, profiles(t)), t.v_queries, t.v_profiles_named)


@query("v07_corrections", """WITH c AS (SELECT clip_id, local_label, CASE WHEN clip_id % 12 = 11 THEN ' New Voice ' || clip_id % 5 ELSE upper('supplier#') || lpad((clip_id % 10 + 1)::VARCHAR, 9, '0') END AS name FROM v_clip_speakers WHERE match_result <> 'confident'),
  fresh AS (SELECT low, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY low) AS id FROM (SELECT DISTINCT lower(trim(name)) AS low FROM c) WHERE low NOT IN (SELECT lower(s_name) FROM supplier)),
  ids AS (SELECT lower(s_name) AS low, min(s_suppkey) AS id FROM supplier GROUP BY 1 UNION ALL SELECT * FROM fresh), g AS (SELECT clip_id, local_label, id FROM c JOIN ids ON low = lower(trim(name)))
  SELECT clip_id, local_label, coalesce(id, s.profile_id) AS profile_id, CASE WHEN id IS NOT NULL THEN 'confident' ELSE match_result END AS match_result, CASE WHEN id IS NULL THEN s.cluster_id END AS cluster_id, id IS NOT NULL AS is_manual,
    CASE WHEN id IS NOT NULL AND NOT coalesce(reliability >= 0.45, false) THEN 'reliability too low' END AS skipped, (SELECT count(*) FROM v_speech_utt u WHERE u.clip_id = s.clip_id AND u.local_label = s.local_label AND coalesce(id, u.profile_id) IS NOT DISTINCT FROM coalesce(id, s.profile_id)) AS n_utterances FROM v_clip_speakers s LEFT JOIN g USING (clip_id, local_label)""")
def v07(t):
    """Names given by hand to all speakers that are not sure: profiles made where needed, rows set, utterances moved, enrollments refused with a reason."""
    name = F.when(C("clip_id") % 12 == 11, F.concat(F.lit(" New Voice "), C("clip_id") % 5)).otherwise(F.concat(F.lit("SUPPLIER#"), F.lpad((C("clip_id") % 10 + 1).cast("string"), 9, "0")))
    given = t.v_clip_speakers.where("match_result <> 'confident'").select("clip_id", "local_label", name.alias("name"))
    speakers = t.v_clip_speakers.select("clip_id", "local_label", "profile_id", "cluster_id", "reliability", "match_result")
    out = v.apply_corrections(given, speakers, t.v_speech_utt.select("utterance_id", "clip_id", "local_label", "profile_id"), t.supplier.select(C("s_suppkey").alias("id"), C("s_name").alias("name")))
    moved = out["utterances"].groupBy("clip_id", "local_label", "profile_id").agg(F.count("*").alias("n_utterances"))
    skipped = out["enrollments"].select("clip_id", "local_label", "skipped")
    s = out["speakers"].join(skipped, ["clip_id", "local_label"], "left")
    m = moved.select(C("clip_id").alias("c"), C("local_label").alias("l"), C("profile_id").alias("p"), "n_utterances")
    s = s.join(m, (C("clip_id") == C("c")) & (C("local_label") == C("l")) & C("profile_id").eqNullSafe(C("p")), "left")
    return s.select("clip_id", "local_label", "profile_id", "match_result", "cluster_id", "is_manual", "skipped", F.coalesce("n_utterances", F.lit(0)).alias("n_utterances"))


def start_clusters(t):
    """A cluster per profile, founded by all of its enrollments."""
    seeds = t.v_enrollments
    base = weighted_centroid(seeds, "profile_id")
    sums = seeds.groupBy("profile_id").agg(F.sum(C("reliability") * C("speech_s")).alias("weight"), F.count("*").alias("n_members"), F.sum("speech_s").alias("speech_s"))
    return base.join(sums, "profile_id").withColumnRenamed("profile_id", "cluster_id")


START = """seeds AS (SELECT * FROM v_enrollments), sx AS (SELECT profile_id, i, sum(reliability * x) AS sx FROM (SELECT profile_id, reliability, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM seeds) GROUP BY 1, 2),
  cl AS (SELECT profile_id AS cluster_id, list_transform(s, lambda x: x / sqrt(list_inner_product(s, s))) AS centroid FROM (SELECT profile_id, list(sx ORDER BY i) AS s FROM sx GROUP BY 1)),
  h AS (SELECT query_id, cluster_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cluster_id) AS r FROM (SELECT query_id, cluster_id, list_inner_product(vec, centroid) AS sim FROM v_queries CROSS JOIN cl)),
  t AS (SELECT query_id, max(cluster_id) FILTER (r = 1) AS c, max(sim) FILTER (r = 1) AS sim, coalesce(max(sim) FILTER (r = 2), 0) AS second FROM h GROUP BY 1)"""


@query("v08_assign_clusters", f"WITH {START} SELECT query_id, CASE WHEN sim >= 0.52 THEN c ELSE -query_id END AS cluster_id, sim >= 0.52 AS hit, sim >= 0.52 AND sim - second >= 0.04 AS teaches FROM t")
def v08(t):
    return v.assign_clusters(t.v_queries.select("query_id", "vec", "speech_s", "reliability"), start_clusters(t))[0]


@query("v08_updated_clusters", f"""WITH {START}, a AS (SELECT query_id, CASE WHEN sim >= 0.52 THEN c ELSE -query_id END AS cluster_id, sim >= 0.52 AS hit, sim >= 0.52 AND sim - second >= 0.04 AS teaches FROM t),
  parts AS (SELECT profile_id AS cluster_id, centroid AS vec, sum(reliability * s.speech_s) AS w, true AS moves, count(*) AS n, sum(s.speech_s) AS speech_s FROM seeds s JOIN (SELECT cluster_id AS profile_id, centroid FROM cl) USING (profile_id) GROUP BY 1, 2
    UNION ALL SELECT a.cluster_id, q.vec, greatest(reliability * speech_s, 1e-6), teaches OR NOT hit, 1, speech_s FROM a JOIN v_queries q USING (query_id)),
  mv AS (SELECT cluster_id, max(sx) / sqrt(sum(sx * sx)) AS largest FROM (SELECT cluster_id, i, sum(w * x) AS sx FROM (SELECT cluster_id, w, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM parts WHERE moves) GROUP BY 1, 2) GROUP BY 1)
  SELECT cluster_id, sum(n)::BIGINT AS n_members, sum(speech_s) AS speech_s, round(sum(CASE WHEN moves THEN w ELSE 0 END), 6) AS weight, round(any_value(largest), 6) AS largest FROM parts JOIN mv USING (cluster_id) GROUP BY 1""")
def v08_updated(t):
    """The clusters after the batch: members, speech and weight, the centroid's largest number."""
    made = v.assign_clusters(t.v_queries.select("query_id", "vec", "speech_s", "reliability"), start_clusters(t))[1]
    return rounded(made.select("cluster_id", "n_members", "speech_s", "weight", F.array_max("centroid").alias("largest")), "weight", "largest")


def small_clusters(t):
    """Clusters of the voices of one label and one level of noise."""
    rows = t.v_voices.select((C("label") * 5 + C("vec_id") % 5).alias("cluster_id"), C("voice").alias("vec"), "speech_s")
    weights = rows.groupBy("cluster_id").agg(F.sum("speech_s").alias("weight"))
    return weighted_centroid(rows, "cluster_id", "vec", "speech_s").join(weights, "cluster_id")


def consolidate_sql(rounds: int = 8) -> str:
    """Rounds of mutual nearest merges, written out; the data settle in fewer."""
    out = """WITH c0 AS MATERIALIZED (SELECT cluster_id, list_transform(s, lambda x: x / sqrt(list_inner_product(s, s))) AS centroid, weight FROM (SELECT cluster_id, list(sx ORDER BY i) AS s FROM (
      SELECT cluster_id, i, sum(speech_s * x) AS sx FROM (SELECT label * 5 + vec_id % 5 AS cluster_id, speech_s, unnest(voice) AS x, generate_subscripts(voice, 1) AS i FROM v_voices) GROUP BY 1, 2) GROUP BY 1)
      JOIN (SELECT label * 5 + vec_id % 5 AS cluster_id, sum(speech_s) AS weight FROM v_voices GROUP BY 1) USING (cluster_id)),
    n0 AS (SELECT cluster_id, cluster_id AS survivor FROM c0)"""
    for k in range(rounds):
        out += f""",
    b{k} AS MATERIALIZED (SELECT a, b, wa, wb FROM (SELECT x.cluster_id AS a, y.cluster_id AS b, x.weight AS wa, y.weight AS wb, list_inner_product(x.centroid, y.centroid) AS sim, row_number() OVER (PARTITION BY x.cluster_id ORDER BY list_inner_product(x.centroid, y.centroid) DESC, y.cluster_id) AS r
      FROM c{k} x JOIN c{k} y ON x.cluster_id <> y.cluster_id) WHERE r = 1 AND sim >= 0.62),
    m{k} AS MATERIALIZED (SELECT p.a AS loser, p.b AS winner FROM b{k} p JOIN b{k} q ON p.a = q.b AND p.b = q.a WHERE p.wa < p.wb OR (p.wa = p.wb AND p.a > p.b)),
    n{k + 1} AS MATERIALIZED (SELECT cluster_id, coalesce(winner, survivor) AS survivor FROM n{k} LEFT JOIN m{k} ON loser = survivor),
    g{k} AS MATERIALIZED (SELECT coalesce(winner, cluster_id) AS cluster_id, centroid, weight FROM c{k} LEFT JOIN m{k} ON loser = cluster_id),
    c{k + 1} AS MATERIALIZED (SELECT cluster_id, list_transform(s, lambda x: x / sqrt(list_inner_product(s, s))) AS centroid, weight FROM (SELECT cluster_id, list(sx ORDER BY i) AS s FROM (
      SELECT cluster_id, i, sum(weight * x) AS sx FROM (SELECT cluster_id, weight, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM g{k}) GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT cluster_id, sum(weight) AS weight FROM g{k} GROUP BY 1) USING (cluster_id))"""
    return out + f" SELECT * FROM n{rounds}"


@query("v09_consolidate", consolidate_sql())
def v09(t):
    return v.consolidate(small_clusters(t))


@query("v10_promote", f"""WITH {START}, m AS (SELECT query_id, CASE WHEN sim >= 0.52 THEN c ELSE -query_id END AS cluster_id FROM t), mm AS (SELECT * FROM m JOIN v_queries USING (query_id) WHERE cluster_id % 2 <> 0),
  ids AS (SELECT cluster_id, 'Voice ' || cluster_id AS name, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY lower('Voice ' || cluster_id)) AS profile_id FROM (SELECT DISTINCT cluster_id FROM mm)),
  en AS (SELECT profile_id, vec, reliability, speech_s FROM mm JOIN ids USING (cluster_id) WHERE reliability >= 0.45),
  ct AS (SELECT profile_id, list_transform(s, lambda x: x / sqrt(list_inner_product(s, s))) AS centroid FROM (SELECT profile_id, list(sx ORDER BY i) AS s FROM (SELECT profile_id, i, sum(reliability * x) AS sx FROM (SELECT profile_id, reliability, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM en) GROUP BY 1, 2) GROUP BY 1)),
  f AS (SELECT profile_id, count(*) AS n_enrollments, avg(list_inner_product(vec, centroid)) AS cohesion, sum(speech_s) AS speech_s FROM en JOIN ct USING (profile_id) GROUP BY 1)
  SELECT profile_id, name, cluster_id, coalesce(n_enrollments, 0) AS n_enrollments, round(cohesion, 6) AS cohesion, coalesce(f.speech_s, 0) AS speech_s, (SELECT count(*) FROM mm WHERE mm.cluster_id = ids.cluster_id) AS n_members, (SELECT count(*) FROM mm WHERE mm.cluster_id = ids.cluster_id) AS n_utterances FROM ids LEFT JOIN f USING (profile_id)""")
def v10(t):
    """Clusters of voices that become profiles: their members and utterances repointed, the reliable ones enrolled, facts computed."""
    from ..operators.shared import checkpointed

    rows = v.assign_clusters(t.v_queries.select("query_id", "vec", "speech_s", "reliability"), start_clusters(t))[0].select("query_id", "cluster_id").join(t.v_queries, "query_id")
    members = checkpointed(rows.select(C("query_id").alias("member_id"), "cluster_id", F.lit(None).cast("long").alias("profile_id"), "vec", "reliability", "speech_s"))
    chosen = members.where("cluster_id % 2 <> 0").select("cluster_id", F.concat(F.lit("Voice "), "cluster_id").alias("name")).distinct()
    said = members.select((C("member_id") * 10).alias("utterance_id"), "member_id", F.lit(None).cast("long").alias("profile_id"))
    out = v.promote_clusters(chosen, members, said, t.supplier.select(C("s_suppkey").alias("id"), C("s_name").alias("name")))
    n = lambda df, name: df.where("profile_id IS NOT NULL").groupBy("profile_id").agg(F.count("*").alias(name))
    made = out["profiles"].join(n(out["members"], "n_members"), "profile_id", "left").join(n(out["utterances"], "n_utterances"), "profile_id", "left")
    return rounded(made, "cohesion").select("profile_id", "name", "cluster_id", "n_enrollments", "cohesion", "speech_s", "n_members", "n_utterances")


@query("v11_merge_profiles", "SELECT utterance_id, CASE WHEN profile_id % 3 = 0 THEN profile_id - profile_id % 10 WHEN profile_id % 7 = 0 THEN NULL ELSE profile_id END AS profile_id FROM v_speech_utt")
def v11(t):
    """Profiles merged into others, or deleted, by a map of the profiles concerned."""
    p = t.v_speech_utt.select("profile_id").where("profile_id IS NOT NULL").distinct()
    table = p.where("profile_id % 3 = 0").select("profile_id", (C("profile_id") - C("profile_id") % 10).alias("into"), F.lit(False).alias("gone")).unionByName(p.where("profile_id % 3 <> 0 AND profile_id % 7 = 0").select("profile_id", F.lit(None).cast("long").alias("into"), F.lit(True).alias("gone")))
    out = t.v_speech_utt.join(table, "profile_id", "left")
    return out.select("utterance_id", F.when(F.coalesce("gone", F.lit(False)), F.lit(None)).otherwise(F.coalesce("into", "profile_id")).alias("profile_id"))


CALIBRATION = FLAGGED + """, ok AS (SELECT * FROM fl WHERE NOT bad), r AS (SELECT * FROM ok WHERE profile_id IN (SELECT profile_id FROM ok GROUP BY 1 HAVING count(*) >= 2)), s AS (SELECT profile_id, list(sx ORDER BY i) AS total FROM (SELECT profile_id, i, sum(reliability * x) AS sx FROM (SELECT profile_id, reliability, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM r) GROUP BY 1, 2) GROUP BY 1),
  g AS (SELECT vec_id, profile_id, vec, list_transform(list_zip(total, vec), lambda p: p[1] - reliability * p[2]) AS rest FROM r JOIN s USING (profile_id)),
  scores AS (SELECT 'genuine' AS kind, vec_id, profile_id, list_inner_product(vec, rest) / sqrt(list_inner_product(rest, rest)) AS score FROM g UNION ALL SELECT 'impostor', r.vec_id, s.profile_id, list_inner_product(vec, total) / sqrt(list_inner_product(total, total)) FROM r JOIN s ON r.profile_id <> s.profile_id)"""


@query("v12_calibration_scores", f"WITH {CALIBRATION} SELECT kind, vec_id, profile_id, round(score, 6) AS score FROM scores")
def v12(t):
    return rounded(v.calibration_scores(t.v_enrollments), "score")


EER = f"""{CALIBRATION}, ends AS (SELECT min(score) AS low, (max(score) - min(score)) / 499 AS step FROM scores), grid AS (SELECT i, low + i * step AS th FROM range(500) t(i), ends), b AS (SELECT kind, least(499, floor((score - low) / step + 1e-9)::BIGINT) AS j FROM scores, ends),
  rates AS (SELECT i, th, (SELECT count(*) FROM b WHERE kind = 'impostor' AND j >= i) / (SELECT count(*) FROM b WHERE kind = 'impostor')::DOUBLE AS far, (SELECT count(*) FROM b WHERE kind = 'genuine' AND j < i) / (SELECT count(*) FROM b WHERE kind = 'genuine')::DOUBLE AS frr FROM grid)"""


@query("v13_equal_error_rate", f"WITH {EER} SELECT round(th, 6) AS threshold, round(far, 6) AS far, round(frr, 6) AS frr, round((far + frr) / 2, 6) AS eer FROM rates ORDER BY round(abs(far - frr), 12), i LIMIT 1")
def v13(t):
    return rounded(v.equal_error_rate(v.calibration_scores(t.v_enrollments)), "threshold", "far", "frr", "eer")


@query("v14_calibration_report", f"""WITH {EER}, best AS (SELECT th, (far + frr) / 2 AS eer FROM rates ORDER BY round(abs(far - frr), 12), i LIMIT 1), firsts AS (SELECT kind, score, row_number() OVER (PARTITION BY kind ORDER BY vec_id, profile_id) AS n FROM scores),
  m AS (SELECT count(DISTINCT profile_id) AS n_profiles, count(*) FILTER (kind = 'genuine') AS n_genuine, count(*) FILTER (kind = 'impostor') AS n_impostor, avg(score) FILTER (kind = 'genuine') AS gm, avg(score) FILTER (kind = 'impostor') AS im FROM scores)
  SELECT n_profiles, n_genuine, n_impostor, round(gm, 6) AS genuine_mean, round(im, 6) AS impostor_mean, round(gm - im, 6) AS separation, round(eer, 6) AS eer, round(th, 6) AS eer_threshold, round(th + 0.03::DOUBLE, 6) AS suggested_id, round(th + 0.08::DOUBLE, 6) AS suggested_verify,
    (SELECT list(round(score, 5) ORDER BY n) FROM firsts WHERE kind = 'genuine' AND n <= 500) AS genuine_scores, (SELECT list(round(score, 5) ORDER BY n) FROM firsts WHERE kind = 'impostor' AND n <= 500) AS impostor_scores FROM m, best""")
def v14(t):
    made = rounded(v.calibration_report(t.v_enrollments), "genuine_mean", "impostor_mean", "separation", "eer", "eer_threshold", "suggested_id", "suggested_verify")
    return made.withColumns({c: F.transform(c, lambda x: F.round(x, 5)) for c in ("genuine_scores", "impostor_scores")})


#: Halves of a clip's label by summed length (W11), each with the mean voice of its turns.
HALVES = """hs AS (SELECT *, end_s - start_s AS d FROM v_turns), ha AS (SELECT *, sum(d) OVER k AS al, count(*) OVER k AS n, coalesce(sum(d) OVER (PARTITION BY clip_id, label ORDER BY start_s, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM hs WINDOW k AS (PARTITION BY clip_id, label)),
  hh AS (SELECT * FROM (SELECT *, count(DISTINCT half) OVER (PARTITION BY clip_id, label) AS k FROM (SELECT *, CASE WHEN bef < al / 2 THEN 'a' ELSE 'b' END AS half FROM ha WHERE al >= 3 AND n >= 2)) WHERE k = 2),
  hv AS (SELECT clip_id, label, half, list(sx ORDER BY i) AS s FROM (SELECT clip_id, h.label, half, i, sum(x) AS sx FROM hh h JOIN (SELECT vec_id, unnest(voice) AS x, generate_subscripts(voice, 1) AS i FROM v_voices) w ON w.vec_id = h.turn_id % (SELECT count(*) FROM v_voices) GROUP BY ALL) GROUP BY ALL),
  ag AS (SELECT a.clip_id, a.label, list_inner_product(a.s, b.s) / sqrt(list_inner_product(a.s, a.s)) / sqrt(list_inner_product(b.s, b.s)) AS g FROM hv a JOIN hv b ON a.clip_id = b.clip_id AND a.label = b.label AND a.half = 'a' AND b.half = 'b')"""


#: Turns with their vectors that one task sums.
TURNS_OF_A_TASK = 100_000


@query("v15_split_half", f"WITH {HALVES} SELECT clip_id, label, round(g, 6) AS agreement, round(CASE WHEN g < 0.6 THEN greatest(0, least(1, g / 0.6)) ELSE 1 END, 6) AS factor FROM ag")
def v15(t):
    """Agreement of the voices of the two halves of a clip's label, and the discount where they differ."""
    from ..operators.sequences import split_halves

    n, size = t.v_voices.agg(F.count("*"), F.coalesce(F.max(F.size("voice")), F.lit(0))).first()
    turns = split_halves(t.v_turns).withColumn("vec_id", C("turn_id") % n).join(t.v_voices.where(F.size("voice") > 0).select("vec_id", C("voice").alias("vec")), "vec_id")
    tasks = max(1, -(-t.v_turns.count() // TURNS_OF_A_TASK))
    made = mean_direction(turns, ["clip_id", "label", "half"], "vec", size, tasks).withColumnRenamed("centroid", "vec")
    return rounded(v.split_half_discount(made), "agreement", "factor")


SCORED = "scored AS (SELECT speech_id, event_type, max(list_inner_product(s.vec, e.vec)) AS score FROM v_speech_vectors s CROSS JOIN v_exemplars e GROUP BY 1, 2)"


def scored(t):
    return v.score_events(t.v_speech_vectors, t.v_exemplars)


@query("v16_score_events", f"WITH {SCORED} SELECT speech_id, event_type, round(score, 6) AS score FROM scored")
def v16(t):
    return rounded(scored(t), "score")


READ = f"""{SCORED}, rk AS (SELECT *, row_number() OVER (PARTITION BY speech_id ORDER BY score DESC, event_type) AS r FROM scored WHERE event_type <> 'none'),
  p AS (SELECT speech_id, max(event_type) FILTER (r = 1) AS event_type, max(score) FILTER (r = 1) AS score, coalesce(max(score) FILTER (r = 2), 0) AS second FROM rk GROUP BY 1),
  m AS (SELECT p.*, score - greatest(second, coalesce((SELECT n.score FROM scored n WHERE n.speech_id = p.speech_id AND n.event_type = 'none'), 0)) AS margin, n_words FROM p JOIN v_speech_vectors USING (speech_id)),
  rd AS (SELECT speech_id, event_type, score, margin FROM m WHERE score >= 0.6 AND margin >= 0.05 AND n_words >= 6)"""


@query("v17_classify_events", f"WITH {READ} SELECT speech_id, event_type, round(score, 6) AS score, round(margin, 6) AS margin FROM rd")
def v17(t):
    return rounded(v.classify_events(scored(t), t.v_speech_vectors), "score", "margin")


@query("v18_event_candidates", f"WITH {SCORED} SELECT speech_id, round(max(score), 6) AS score FROM scored WHERE event_type <> 'none' GROUP BY 1 HAVING max(score) >= 0.42")
def v18(t):
    return rounded(scored(t).where("event_type <> 'none'").groupBy("speech_id").agg(F.max("score").alias("score")).where("score >= 0.42"), "score")


@query("v19_extract_events", f"""WITH {READ}, b AS (SELECT event_id % 400 AS speech_id, 'type_' || event_id % 5 AS event_type, CASE event_id % 3 WHEN 0 THEN 'hand' ELSE 'similarity' END AS source, max(value) AS score, NULL::BIGINT AS target, 0 AS k FROM events GROUP BY ALL),
  un AS (SELECT speech_id FROM v_speech_vectors WHERE speech_id NOT IN (SELECT doc_id FROM labels)),
  al AS (SELECT * FROM b WHERE source = 'hand' OR speech_id NOT IN (SELECT speech_id FROM un) UNION ALL SELECT r.speech_id, r.event_type, 'similarity', r.score, CASE WHEN s.label % 2 = 0 THEN s.label END, 1 FROM rd r JOIN un USING (speech_id) JOIN v_speech_vectors s USING (speech_id)),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY speech_id, event_type ORDER BY k, score DESC, source) AS n FROM al) WHERE n = 1)
  SELECT speech_id, event_type, source, round(score, 6) AS score, target, count(*) OVER (PARTITION BY event_type, source) AS n_of_type FROM kept""")
def v19(t):
    """Unread speech scored, classified, given its target and stored beside the events that are there, with counts by type and source."""
    from pyspark.sql import Window

    old = t.events.select((C("event_id") % 400).alias("speech_id"), F.concat(F.lit("type_"), C("event_id") % 5).alias("event_type"), F.when(C("event_id") % 3 == 0, "hand").otherwise("similarity").alias("source"), "value")
    old = old.groupBy("speech_id", "event_type", "source").agg(F.max("value").alias("score")).withColumn("target", F.lit(None).cast("long"))
    targets = t.v_speech_vectors.select("speech_id", F.when(C("label") % 2 == 0, C("label")).alias("target"))
    out = v.extract_events(t.v_speech_vectors, t.labels.select(C("doc_id").alias("speech_id")), t.v_exemplars, targets, old, "similarity")
    return rounded(out, "score").withColumn("n_of_type", F.count("*").over(Window.partitionBy("event_type", "source")))


@query("v20_needs_vector", "SELECT call_id FROM v_radio WHERE error IS NULL AND analyzed_s IS NOT NULL AND mood IS NULL ORDER BY recorded_s, call_id LIMIT 100")
def v20(t):
    """The next hundred analysed calls that lack a reading."""
    return t.v_radio.where("error IS NULL AND analyzed_s IS NOT NULL AND mood IS NULL").orderBy("recorded_s", "call_id").limit(100).select("call_id")
