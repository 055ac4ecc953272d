"""Voice identity: centroids, matching that abstains, clusters and calibration.

Vectors are normalised arrays of doubles, so a dot product is a cosine. Profiles and exemplars are curated and
few; they are broadcast where their number has been checked, else joined by salted keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalized, weighted_centroid
from ..params import DEFAULTS, Params

#: Profiles up to which every query's comparison with all of them is one broadcast.
MOST_PROFILES = 20_000
#: Tasks that queries of one block of profiles are dealt to.
SALTS = 64


def centroids(enrollments: DataFrame) -> DataFrame:
    return weighted_centroid(enrollments, "profile_id")


def _met(queries: DataFrame, profiles: DataFrame, key: str, vec: str, limit: int) -> tuple[DataFrame, int]:
    """Queries beside the profiles in sorted blocks (an array column, _set), and the number of blocks.

    The profiles are counted: up to limit they travel as one broadcast row; beyond it they go in several blocks
    by hash, each of bounded size, which are salted so that queries meet a block in many tasks.
    """
    blocks = max(1, -(-profiles.count() // limit))
    block = profiles.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block")).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vec).alias("v")))).alias("_set"))
    spread = queries.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    if blocks == 1:
        return spread.join(F.broadcast(block), "_block"), blocks
    salted = block.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")).join(salted, ["_block", "_salt"]).drop("_salt"), blocks


def similarities(queries: DataFrame, profiles: DataFrame, key: str, vec: str = "centroid", limit: int = MOST_PROFILES) -> DataFrame:
    """Every query (query_id, vec) against a stated set of profile vectors: query_id, key, sim."""
    met, _ = _met(queries, profiles, key, vec, limit)
    scored = F.transform("_set", lambda p: F.struct(p["k"].alias(key), dot(F.col("vec"), p["v"]).alias("sim")))
    return met.select("query_id", F.explode(scored).alias("x")).select("query_id", "x.*")


def knn(queries: DataFrame, profiles: DataFrame, key: str = "profile_id", k: int = 10, others: bool = False, limit: int = MOST_PROFILES) -> DataFrame:
    """query_id, key, sim, rank: the k most similar profiles, ties by key; others: not the query's own id.

    The best k of a block are taken within the query's row; only where there are several blocks do they meet again.
    """
    met, blocks = _met(queries, profiles, key, "centroid", limit)
    pool = F.filter("_set", lambda p: p["k"] != F.col("query_id")) if others else F.col("_set")
    scored = F.transform(pool, lambda p: F.struct(dot(F.col("vec"), p["v"]).alias("sim"), (-p["k"]).alias("nk")))
    best = met.select("query_id", F.posexplode(F.slice(F.sort_array(scored, False), 1, k)).alias("_p", "x")).select("query_id", (-F.col("x.nk")).alias(key), "x.sim", (F.col("_p") + 1).alias("rank"))
    if blocks == 1:
        return best
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), key)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def identify(queries: DataFrame, profiles: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """query_id, result, profile_id, score, margin, z, runner_up: a match, a suggestion, unknown or abstained.

    The threshold rises as the query's reliability falls; the best must lead the second and, with three more
    hits, stand out of them. An unreliable match is only suggested. Without a vector there is no answer.
    """
    hits = knn(queries.where("vec IS NOT NULL"), profiles)
    per = hits.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("profile_id"))).alias("top_id"), F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("profile_id"))).alias("second_id"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("sim"))), F.lit(0.0)).alias("second"),
        F.count_if(F.col("rank") > 1).alias("cohort"), F.avg(F.when(F.col("rank") > 1, F.col("sim"))).alias("mean"), F.stddev_pop(F.when(F.col("rank") > 1, F.col("sim"))).alias("sd"),
    )
    rows = queries.join(per, "query_id", "left")
    z = F.when(F.col("cohort") >= 3, (F.col("score") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(0.05)))
    limit = p.id_threshold + p.id_penalty * (1 - F.col("reliability"))
    margin = F.col("score") - F.col("second")
    sure = (F.col("score") >= limit) & (margin >= p.id_margin) & (z.isNull() | (z >= p.id_z))
    result = (
        F.when(F.col("vec").isNull(), "abstained").when(F.col("score").isNull(), "unknown")
        .when(sure & (F.col("reliability") >= p.reliability_fair), "confident").when(sure, "suggested").when(F.col("score") >= limit - p.id_suggest, "suggested").otherwise("unknown")
    )
    out = rows.withColumns({"result": result, "margin": margin, "z": z})
    known = F.col("result").isin("confident", "suggested")
    return out.select("query_id", "result", F.when(known, F.col("top_id")).alias("profile_id"), "score", "margin", "z", F.when(known, F.col("second_id")).when(F.col("result") == "unknown", F.col("top_id")).alias("runner_up"))


def flag_outliers(enrollments: DataFrame) -> DataFrame:
    """Enrollments with sim to their profile's centroid and is_outlier: far below the others, and low."""
    own = enrollments.join(centroids(enrollments), "profile_id").withColumn("sim", dot(F.col("vec"), F.col("centroid")))
    w = Window.partitionBy("profile_id")
    far = (F.count("*").over(w) >= 4) & (F.col("sim") < F.avg("sim").over(w) - 2 * F.stddev_pop("sim").over(w)) & (F.col("sim") < 0.5)
    return own.withColumn("is_outlier", far).drop("centroid")


def recompute_profiles(profiles: DataFrame, enrollments: DataFrame) -> DataFrame:
    """profile_id, n_enrollments, n_outliers, cohesion, speech_s, mean_reliability, centroid; zeros and nulls for empty ones."""
    flagged = flag_outliers(enrollments)
    per = flagged.groupBy("profile_id").agg(F.count("*").alias("n_enrollments"), F.count_if("is_outlier").alias("n_outliers"), F.avg("sim").alias("cohesion"), F.sum("speech_s").alias("speech_s"), F.avg("reliability").alias("mean_reliability"))
    rows = profiles.select("profile_id").join(per, "profile_id", "left").join(centroids(enrollments), "profile_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_enrollments", "n_outliers", "speech_s")})


def calibration_scores(enrollments: DataFrame) -> DataFrame:
    """kind (genuine, impostor), vec_id, profile_id, score; profiles with two enrollments, if three have them. Outliers are left out.

    Genuine: against the centroid of the profile's other enrollments, which is the sum less the own part.
    Impostor: against all other profiles' centroids.
    """
    sound = flag_outliers(enrollments).where("NOT is_outlier").select(enrollments.columns)
    rows = sound.withColumn("_n", F.count("*").over(Window.partitionBy("profile_id"))).where("_n >= 2").drop("_n")
    parts = rows.select("profile_id", "reliability", F.posexplode("vec").alias("_i", "_x"))
    sums = parts.groupBy("profile_id", "_i").agg(F.sum(F.col("reliability") * F.col("_x")).alias("_s"))
    whole = sums.groupBy("profile_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_s"))), lambda p: p["_s"]).alias("total"))
    enough = F.lit(whole.limit(3).count() >= 3)
    less = rows.join(whole, "profile_id").withColumn("rest", normalized(F.zip_with("total", "vec", lambda s, x: s - F.col("reliability") * x)))
    genuine = less.where(enough).select(F.lit("genuine").alias("kind"), "vec_id", "profile_id", dot(F.col("vec"), F.col("rest")).alias("score"))
    every = whole.select("profile_id", normalized(F.col("total")).alias("centroid"))
    all_sims = similarities(rows.select(F.col("vec_id").alias("query_id"), "vec"), every, "profile_id")
    own = rows.select(F.col("vec_id").alias("query_id"), F.col("profile_id").alias("own"))
    impostor = all_sims.join(own, "query_id").where("profile_id <> own").where(enough).select(F.lit("impostor").alias("kind"), F.col("query_id").alias("vec_id"), "profile_id", F.col("sim").alias("score"))
    return genuine.unionByName(impostor)


def equal_error_rate(scores: DataFrame, steps: int = 500) -> DataFrame:
    """threshold, far, frr, eer at the first of `steps` even thresholds, from the lowest score to the highest, where both rates are closest.

    Scores are binned to the grid and counted; running sums over the bins give both rates, whatever the number
    of scores. Without scores of both kinds: threshold 0.5, eer 1.
    """
    low, high, g, m = scores.agg(F.min("score"), F.max("score"), F.count_if(F.col("kind") == "genuine"), F.count_if(F.col("kind") == "impostor")).first()
    if not g or not m:
        return scores.sparkSession.range(1).select(F.lit(0.5).alias("threshold"), F.lit(1.0).alias("far"), F.lit(1.0).alias("frr"), F.lit(1.0).alias("eer"))
    step = max(high - low, 1e-12) / (steps - 1)
    grid = scores.sparkSession.range(steps).select(F.col("id").alias("i"), (F.lit(low) + F.col("id") * step).alias("threshold"))
    # the last grid index at or under the score
    bin_of = F.least(F.lit(steps - 1), F.floor((F.col("score") - low) / step + 1e-9)).cast("long")
    counts = scores.groupBy(bin_of.alias("i")).agg(F.count_if(F.col("kind") == "genuine").alias("g"), F.count_if(F.col("kind") == "impostor").alias("m"))
    both = grid.join(counts, "i", "left").na.fill(0, ["g", "m"])
    upto = Window.partitionBy(F.lit(1)).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # a row per threshold
    rates = both.withColumns({"frr": F.coalesce(F.sum("g").over(upto), F.lit(0)) / g, "far": 1 - F.coalesce(F.sum("m").over(upto), F.lit(0)) / m})
    best = rates.agg(F.min_by(F.struct("threshold", "far", "frr"), F.struct(F.round(F.abs(F.col("far") - F.col("frr")), 12), "i")).alias("x")).select("x.*")
    return best.withColumn("eer", (F.col("far") + F.col("frr")) / 2)


def calibration_report(enrollments: DataFrame, shown: int = 500) -> DataFrame:
    """One row: numbers and means of both kinds of score, their separation, the equal error rate, suggested thresholds, and the first scores of each kind."""
    from .shared import checkpointed

    scores = checkpointed(calibration_scores(enrollments))
    of = lambda kind: F.col("kind") == kind
    sums = scores.agg(
        F.countDistinct("profile_id").alias("n_profiles"), F.count_if(of("genuine")).alias("n_genuine"), F.count_if(of("impostor")).alias("n_impostor"),
        F.avg(F.when(of("genuine"), F.col("score"))).alias("genuine_mean"), F.avg(F.when(of("impostor"), F.col("score"))).alias("impostor_mean"),
    ).withColumn("separation", F.col("genuine_mean") - F.col("impostor_mean"))
    first = scores.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("vec_id", "profile_id"))).where(F.col("_n") <= shown)
    pick = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(of(kind), F.struct("_n", "score")))), lambda x: x["score"]).alias(f"{kind}_scores")
    rate = equal_error_rate(scores).select("eer", F.col("threshold").alias("eer_threshold"), (F.col("threshold") + 0.03).alias("suggested_id"), (F.col("threshold") + 0.08).alias("suggested_verify"))
    # three tables of one row
    return sums.withColumn("_k", F.lit(1)).join(F.broadcast(rate.withColumn("_k", F.lit(1))), "_k").join(F.broadcast(first.agg(pick("genuine"), pick("impostor")).withColumn("_k", F.lit(1))), "_k").drop("_k")


def auto_enroll(identified: DataFrame, queries: DataFrame, profiles: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """query_id, profile_id: matches good enough to enroll by themselves: sure, reliable, close, of a confirmed profile. profiles: profile_id, status."""
    sure = identified.where((F.col("result") == "confident") & (F.col("score") >= p.auto_match)).join(queries.where(F.col("reliability") >= p.auto_reliability).select("query_id"), "query_id", "left_semi")
    return sure.join(profiles.where("status = 'confirmed'").select("profile_id"), "profile_id", "left_semi").select("query_id", "profile_id")


def name_profiles(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """profiles (id, name) with a row for each name in names that none has in any case; new ids go on from the largest, by name."""
    low = F.lower(F.trim("name"))
    new = names.select(low.alias("_low"), "name").where("_low <> ''").join(profiles.select(low.alias("_low")), "_low", "left_anti").groupBy("_low").agg(F.min(F.trim("name")).alias("name"))
    last = profiles.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    order = Window.partitionBy(F.lit(1)).orderBy("_low")  # new names of one batch, given by hand
    return profiles.select("id", "name").unionByName(new.select((F.row_number().over(order) + last).cast("long").alias("id"), "name"))


def apply_corrections(corrections: DataFrame, speakers: DataFrame, utterances: DataFrame, profiles: DataFrame, p: Params = DEFAULTS) -> dict[str, DataFrame]:
    """State after names given by hand: profiles, speakers, utterances, and enrollments with the reason of those skipped.

    corrections: clip_id, local_label, name. Names are matched in any case and new ones become profiles; the rows are
    then sure and manual, their cluster is cleared and their utterances follow.
    """
    known = name_profiles(corrections, profiles)
    ids = known.groupBy(F.lower(F.trim("name")).alias("_low")).agg(F.min("id").alias("_id"))
    given = corrections.withColumn("_low", F.lower(F.trim("name"))).where("_low <> ''").join(ids, "_low").select("clip_id", "local_label", "_id")
    keys = ["clip_id", "local_label"]
    rows = speakers.join(given, keys, "left")
    hit = F.col("_id").isNotNull()
    changed = rows.withColumns({"profile_id": F.coalesce("_id", "profile_id"), "match_result": F.when(hit, "confident").otherwise(F.col("match_result")), "cluster_id": F.when(~hit, F.col("cluster_id")), "is_manual": hit})
    said = utterances.join(given, keys, "left").withColumn("profile_id", F.coalesce("_id", "profile_id")).select(utterances.columns)
    enrolled = rows.where(hit).select(*keys, F.col("_id").alias("profile_id"), F.when(~F.coalesce(F.col("reliability") >= p.reliability_fair, F.lit(False)), "reliability too low").alias("skipped"))
    return {"profiles": known, "speakers": changed.select(*speakers.columns, "is_manual"), "utterances": said, "enrollments": enrolled}


def promote_clusters(chosen: DataFrame, members: DataFrame, utterances: DataFrame, profiles: DataFrame, p: Params = DEFAULTS) -> dict[str, DataFrame]:
    """State after clusters became profiles: profiles (with their facts recomputed), enrollments, members, utterances.

    chosen: cluster_id, name. members: member_id, cluster_id, profile_id, vec, reliability, speech_s. utterances: utterance_id, member_id,
    profile_id. Utterances are found through the members while these still hold their cluster.
    """
    named = name_profiles(chosen, profiles)
    ids = named.groupBy(F.lower(F.trim("name")).alias("_low")).agg(F.max("id").alias("_id"))
    into = chosen.withColumn("_low", F.lower(F.trim("name"))).join(ids, "_low").select("cluster_id", "_id", "name")
    before = members.join(into.select("cluster_id", "_id"), "cluster_id", "left")
    hit = F.col("_id").isNotNull()
    said = utterances.join(before.where(hit).select("member_id", "_id"), "member_id", "left").withColumn("profile_id", F.coalesce("_id", "profile_id")).select(utterances.columns)
    enrolled = before.where(hit & F.col("vec").isNotNull() & (F.col("reliability") >= p.reliability_fair)).select(F.col("_id").alias("profile_id"), "member_id", "vec", "reliability", "speech_s")
    after = before.withColumns({"profile_id": F.coalesce("_id", "profile_id"), "cluster_id": F.when(~hit, F.col("cluster_id"))}).select(members.columns)
    facts = recompute_profiles(into.select(F.col("_id").alias("profile_id")).distinct(), enrolled)
    return {"profiles": into.select(F.col("_id").alias("profile_id"), "name", "cluster_id").join(facts, "profile_id"), "enrollments": enrolled, "members": after, "utterances": said}


def split_half_discount(halves: DataFrame, suspect: float = 0.60) -> DataFrame:
    """clip_id, label, agreement, factor: the cosine of the voices of both halves, and the discount of reliability where they differ.

    halves: clip_id, label, half (a or b), vec.
    """
    both = halves.groupBy("clip_id", "label").agg(F.max(F.when(F.col("half") == "a", F.col("vec"))).alias("a"), F.max(F.when(F.col("half") == "b", F.col("vec"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    s = dot(F.col("a"), F.col("b"))
    return both.select("clip_id", "label", s.alias("agreement"), F.when(s < suspect, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s / suspect))).otherwise(1.0).alias("factor"))


def extract_events(speech: DataFrame, read: DataFrame, exemplars: DataFrame, targets: DataFrame, events: DataFrame, source: str, p: Params = DEFAULTS) -> DataFrame:
    """events (speech_id, event_type, source, score, target) after reading all speech that is not in read.

    Scored, classified, given the only driver that its text names (targets: speech_id, target), and put in place of
    the source's earlier rows of that speech; of a (speech, type) the row that was there first stays.
    """
    unread = speech.join(read.select("speech_id"), "speech_id", "left_anti")
    found = classify_events(score_events(unread, exemplars), unread, p).join(targets, "speech_id", "left")
    new = found.select("speech_id", "event_type", F.lit(source).alias("source"), "score", "target")
    old = events.select(new.columns)
    others = old.where(F.col("source") != source)
    mine = old.where(F.col("source") == source).join(unread.select("speech_id"), "speech_id", "left_anti")
    w = Window.partitionBy("speech_id", "event_type").orderBy("_new", F.desc("score"), "source")
    both = others.unionByName(mine).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def assign_clusters(batch: DataFrame, clusters: DataFrame, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(assignments, updated clusters) of a batch of voices without a name, against the clusters at its start.

    batch: query_id, vec, speech_s, reliability. clusters: cluster_id, centroid, weight, n_members, speech_s.
    A hit moves its cluster by its weight unless a second one is about as near; then it only counts. A voice
    that is near none founds a cluster, whose id is its query_id, negated.
    """
    hits = knn(batch, clusters, "cluster_id", 2).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("cluster_id"))).alias("cluster_id"), F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("sim"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("sim"))), F.lit(0.0)).alias("second"))
    rows = batch.join(hits, "query_id", "left")
    hit = F.coalesce(F.col("sim") >= p.cluster_threshold, F.lit(False))
    weight = F.greatest(F.col("reliability") * F.col("speech_s"), F.lit(1e-6))
    rows = rows.withColumns({"hit": hit, "w": weight, "teaches": hit & (F.col("sim") - F.col("second") >= p.cluster_margin), "cluster_id": F.when(hit, F.col("cluster_id")).otherwise(-F.col("query_id"))})
    old = clusters.select("cluster_id", F.col("centroid").alias("vec"), F.col("weight").alias("w"), F.lit(True).alias("teaches"), F.col("n_members").alias("n"), "speech_s")
    parts = old.unionByName(rows.select("cluster_id", "vec", "w", (F.col("teaches") | ~F.col("hit")).alias("teaches"), F.lit(1).cast("long").alias("n"), "speech_s"))
    moved = weighted_centroid(parts.where("teaches"), "cluster_id", "vec", "w")
    sums = parts.groupBy("cluster_id").agg(F.sum("n").alias("n_members"), F.sum("speech_s").alias("speech_s"), F.sum(F.when(F.col("teaches"), F.col("w")).otherwise(0.0)).alias("weight"))
    return rows.select("query_id", "cluster_id", "hit", "teaches"), moved.join(sums, "cluster_id")


#: Clusters that one task brings to their end.
FEW_CLUSTERS = 2_000


def merged_to_the_end(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """cluster_id, centroid, weight of few clusters -> cluster_id, into: rounds of mutual nearest pairs until none is left.

    Similarities are kept from round to round; only those of a survivor are computed anew.
    """
    pdf = pdf.sort_values("cluster_id")
    ids, w = pdf["cluster_id"].to_numpy(), pdf["weight"].to_numpy(float)
    c = np.array(pdf["centroid"].tolist(), float).reshape(len(ids), -1)
    into, live = np.arange(len(ids)), np.ones(len(ids), bool)
    sims = c @ c.T
    np.fill_diagonal(sims, -np.inf)
    while live.any():
        near = sims.argmax(axis=1)  # the smaller id of equals
        i = np.flatnonzero(live & (sims[np.arange(len(ids)), near] >= least))
        i = i[near[near[i]] == i]
        loses = i[(w[i] < w[near[i]]) | ((w[i] == w[near[i]]) & (i > near[i]))]
        if not len(loses):
            break
        keeps = near[loses]
        sums = c[keeps] * w[keeps, None] + c[loses] * w[loses, None]
        c[keeps] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        w[keeps] += w[loses]
        live[loses] = False
        into[loses] = keeps
        sims[keeps] = c[keeps] @ c.T
        sims[:, keeps] = sims[keeps].T
        sims[keeps, keeps] = -np.inf
        sims[~live] = -np.inf
        sims[:, ~live] = -np.inf
    while (into[into] != into).any():
        into = into[into]
    return pd.DataFrame({"cluster_id": ids, "into": ids[into]})


def consolidate(clusters: DataFrame, p: Params = DEFAULTS, few: int = FEW_CLUSTERS) -> DataFrame:
    """cluster_id -> survivor, after merging the clusters that are one voice.

    In each round all pairs that are each other's nearest at cluster_merge or more merge, the heavier one surviving;
    rounds go on until there is no such pair, however many they are. Every cluster's nearest is kept between rounds:
    only survivors, and clusters whose nearest took part in a merge, look at all others again, the rest look at the
    survivors. Rounds are checkpointed. Once no more than few clusters are left, which are counted, one task
    takes the same rounds to their end.
    """
    from .shared import checkpointed

    query = lambda df: df.select(F.col("cluster_id").alias("query_id"), F.col("centroid").alias("vec"))
    nearest = lambda of, among: knn(query(of), among, "cluster_id", 1, others=True).select("query_id", "cluster_id", "sim")
    now = checkpointed(clusters.select("cluster_id", "centroid", "weight"))
    names = now.select("cluster_id", F.col("cluster_id").alias("survivor"))
    near = None
    while now.count() > few:
        near = checkpointed(nearest(now, now)) if near is None else near
        best = near.where(F.col("sim") >= p.cluster_merge).join(now.select(F.col("cluster_id").alias("query_id"), "weight"), "query_id")
        back = best.select(F.col("query_id").alias("cluster_id"), F.col("cluster_id").alias("query_id"), F.col("weight").alias("other"))
        mutual = best.join(back, ["query_id", "cluster_id"])
        loses = (F.col("weight") < F.col("other")) | ((F.col("weight") == F.col("other")) & (F.col("query_id") > F.col("cluster_id")))
        merged = checkpointed(mutual.where(loses).select(F.col("query_id").alias("cluster_id"), F.col("cluster_id").alias("into")))
        if merged.isEmpty():
            return names
        names = checkpointed(names.join(merged.toDF("survivor", "into"), "survivor", "left").select("cluster_id", F.coalesce("into", "survivor").alias("survivor")))
        moved = now.join(merged, "cluster_id", "left").withColumn("cluster_id", F.coalesce("into", "cluster_id"))
        now = checkpointed(weighted_centroid(moved.withColumnRenamed("centroid", "vec"), "cluster_id", "vec", "weight").join(moved.groupBy("cluster_id").agg(F.sum("weight").alias("weight")), "cluster_id"))
        part = merged.select("cluster_id").union(merged.select("into"))
        left = near.join(part.select(F.col("cluster_id").alias("query_id")), "query_id", "left_anti")
        stays = checkpointed(left.join(part, "cluster_id", "left_anti"))
        again = now.join(stays.select(F.col("query_id").alias("cluster_id")), "cluster_id", "left_anti")
        fresh = now.join(merged.select(F.col("into").alias("cluster_id")).distinct(), "cluster_id", "left_semi")
        others = now.join(stays.select(F.col("query_id").alias("cluster_id")), "cluster_id", "left_semi")
        either = stays.unionByName(nearest(others, fresh))
        kept = either.groupBy("query_id").agg(F.max(F.struct("sim", (-F.col("cluster_id")).alias("_c"))).alias("x")).select("query_id", (-F.col("x._c")).alias("cluster_id"), "x.sim")
        near = checkpointed(kept.unionByName(nearest(again, now)))
    last = now.groupBy().applyInPandas(lambda pdf: merged_to_the_end(pdf, p.cluster_merge), "cluster_id long, into long")
    return names.join(last.toDF("survivor", "into"), "survivor", "left").select("cluster_id", F.coalesce("into", "survivor").alias("survivor"))


def score_events(speech: DataFrame, exemplars: DataFrame, limit: int = MOST_PROFILES) -> DataFrame:
    """speech_id, event_type, score: the best exemplar of each type, the none type too.

    The best of each type is taken within the speech's row; rows meet again only where exemplars fill several blocks.
    """
    kinds = sorted(r[0] for r in exemplars.select("event_type").distinct().collect())  # a fixed taxonomy
    keyed = exemplars.select(F.struct("event_type", "exemplar_id").alias("k"), "vec")
    met, blocks = _met(speech.select(F.col("speech_id").alias("query_id"), F.col("vec").alias("mine")), keyed, "k", "vec", limit)
    scored = F.transform("_set", lambda p: F.struct(p["k"]["event_type"].alias("t"), dot(F.col("mine"), p["v"]).alias("sim")))

    def top(kind: str) -> Column:
        return F.array_max(F.transform(F.filter("_s", lambda p: p["t"] == kind), lambda p: p["sim"]))

    best = F.array(*(F.struct(F.lit(k).alias("event_type"), top(k).alias("score")) for k in kinds)) if kinds else F.array().cast("array<struct<event_type:string,score:double>>")
    rows = met.select("query_id", scored.alias("_s")).select(F.col("query_id").alias("speech_id"), F.explode(best).alias("x")).select("speech_id", "x.*").where("score IS NOT NULL")
    return rows if blocks == 1 else rows.groupBy("speech_id", "event_type").agg(F.max("score").alias("score"))


def classify_events(scores: DataFrame, speech: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """speech_id, event_type, score, margin: read events only. None anchors compete as runner-up; short texts are not read."""
    w = Window.partitionBy("speech_id").orderBy(F.desc("score"), "event_type")
    typed = scores.where("event_type <> 'none'").withColumn("_r", F.row_number().over(w))
    per = typed.groupBy("speech_id").agg(F.max(F.when(F.col("_r") == 1, F.col("event_type"))).alias("event_type"), F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("score"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    none = scores.where("event_type = 'none'").select("speech_id", F.col("score").alias("none"))
    rows = per.join(none, "speech_id", "left").join(speech.select("speech_id", "n_words"), "speech_id")
    rows = rows.withColumn("margin", F.col("score") - F.greatest("second", F.coalesce("none", F.lit(0.0))))
    return rows.where((F.col("score") >= p.event_floor) & (F.col("margin") >= p.event_margin) & (F.col("n_words") >= p.event_min_words)).select("speech_id", "event_type", "score", "margin")
