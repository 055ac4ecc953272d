"""Joins of speech with laps, speakers, drivers, aliases and each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import bucketed
from .shared import MOST_BROADCAST


def during_lap(speech: DataFrame, laps: DataFrame, tol: float, width: float) -> DataFrame:
    """(speech_id, session_key, driver_number, lap_number): speech at [start - tol, end + tol) of a lap of its driver.

    Speech at a boundary belongs to both laps. Joined on the driver and a time bucket.
    """
    timed = laps.where("duration_s IS NOT NULL").withColumns({"_s": F.col("start_s") - tol, "_e": F.col("start_s") + F.col("duration_s") + tol})
    spans = bucketed(timed, width, F.col("_s"), F.col("_e")).select("session_key", "driver_number", "lap_number", "_s", "_e", "_bucket")
    points = speech.withColumn("_bucket", F.floor(F.col("at_s") / width))
    return points.join(spans, ["session_key", "driver_number", "_bucket"]).where("at_s >= _s AND at_s < _e").select("speech_id", "session_key", "driver_number", "lap_number")


def latest(df: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """The last row of each key by the columns at, found with partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_x")).select(*keys, "_x.*")


def clip_pairs(clip_speakers: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip_id, a, b, n): pairs of profiles, a < b, with how many pairs of their speaker rows share the finished clip.

    Rows are counted per clip and profile before the pairs are made.
    """
    done = clips.where("status = 'COMPLETE'").select("clip_id")
    per = clip_speakers.where("profile_id IS NOT NULL").join(done, "clip_id").groupBy("clip_id", "profile_id").agg(F.count("*").alias("m"))
    other = per.select("clip_id", F.col("profile_id").alias("b"), F.col("m").alias("k"))
    return per.join(other, "clip_id").where("profile_id < b").select("clip_id", F.col("profile_id").alias("a"), "b", (F.col("m") * F.col("k")).alias("n"))


def talked_with(clip_speakers: DataFrame, clips: DataFrame) -> DataFrame:
    """(a, b, n): pairs of profiles, a < b, with how many pairs of their speaker rows share a finished clip."""
    return clip_pairs(clip_speakers, clips).groupBy("a", "b").agg(F.sum("n").alias("n"))



def mentions(speech: DataFrame, aliases: DataFrame, most_broadcast: int = MOST_BROADCAST, salts: int = 16) -> DataFrame:
    """(speech_id, entity_type, entity_key) for every alias that a text names, each once.

    Whole words, any case; at a position the longest alias wins and the scan goes on behind it. A text's runs of
    as many words as aliases have, with what stands between them, meet the aliases by equality, so the vocabulary
    may have any size: runs that begin with no alias's first word are left out first, and a frequent one is dealt
    to several tasks. Only hits that overlap others are put side by side (leftmost). Aliases count from their first to
    their last word character; those without any, and empty texts, name nothing. speech_id may not be null.
    """
    parts = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+|\W+"), F.lit(0))
    alias = F.regexp_replace(F.lower("alias"), r"(?U)^\W+|\W+$", "")
    table = aliases.select(alias.alias("alias"), "entity_type", "entity_key").where("alias <> ''")
    names = table.select("alias").distinct().withColumns({"first": F.element_at(parts(F.col("alias")), 1), "n": ((F.size(parts(F.col("alias"))) + 1) / 2).cast("int")})
    lengths = sorted(r[0] for r in names.select("n").distinct().collect())
    few = names.limit(most_broadcast + 1).count() <= most_broadcast
    firsts = names.select("first").distinct()
    firsts = F.broadcast(firsts) if few or firsts.limit(most_broadcast + 1).count() <= most_broadcast else firsts.hint("merge")
    longest = 2 * lengths[-1] - 1 if lengths else 1
    cut = parts(F.col("text"))
    places = F.transform(cut, lambda x, i: F.struct(i.alias("pos"), x.alias("first"), F.slice(F.col("_p"), i + 1, F.lit(longest)).alias("ahead")))
    words = F.filter(places, lambda x: x["first"].rlike(r"(?U)^\w"))
    at = speech.select("speech_id", "text", cut.alias("_p")).select("speech_id", F.explode(words).alias("x")).select("speech_id", "x.*")
    at = at.join(firsts, "first", "left_semi")
    runs = F.array(*(F.when(F.size("ahead") >= 2 * n - 1, F.struct(F.lit(n).alias("n"), F.array_join(F.slice("ahead", 1, 2 * n - 1), "").alias("alias"))) for n in lengths))
    runs = F.array_compact(runs) if lengths else F.array().cast("array<struct<n:int,alias:string>>")
    grams = at.select("speech_id", "pos", F.explode(runs).alias("r")).select("speech_id", "pos", "r.n", "r.alias")
    known = names.select("alias")
    if few:
        hits = grams.join(F.broadcast(known), "alias")
    else:
        dealt = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hits = grams.withColumn("_salt", F.pmod(F.xxhash64("speech_id", "pos"), F.lit(salts)).cast("int")).join(dealt.hint("merge"), ["alias", "_salt"]).drop("_salt")

    kept = leftmost(hits).distinct()
    small = F.broadcast(table) if table.limit(most_broadcast + 1).count() <= most_broadcast else table.hint("merge")
    return kept.join(small, "alias").select("speech_id", "entity_type", "entity_key").distinct()


def leftmost(hits: DataFrame) -> DataFrame:
    """speech_id, alias of the hits (speech_id, pos, n words, alias) that stand: from the left, the longest at a place first, none within another.

    A hit that begins behind all hits before it starts a run; hits that are a run by themselves stand. Longer runs
    are settled one by one, in time that grows with their hits times the different aliases that stand in them.
    """
    order = Window.partitionBy("speech_id").orderBy("pos", F.desc("n"))
    end = F.col("pos") + 2 * F.col("n") - 1
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("_new", (reached.isNull() | (F.col("pos") >= reached)).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sized = runs.groupBy("speech_id", "_run").agg(F.sort_array(F.collect_list(F.struct("pos", (-F.col("n")).alias("_n"), "alias"))).alias("_hits"))

    def stand(so_far, x):
        after = F.struct((x["pos"] - 2 * x["_n"] - 1).alias("free"), F.array_union(so_far["kept"], F.array(x["alias"])).alias("kept"))
        return F.when(x["pos"] >= so_far["free"], after).otherwise(so_far)

    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("kept"))
    settled = F.when(F.size("_hits") == 1, F.transform("_hits", lambda x: x["alias"])).otherwise(F.aggregate("_hits", start, stand, lambda x: x["kept"]))
    return sized.select("speech_id", F.explode(settled).alias("alias"))


def session_drivers(mentioned: DataFrame, speech: DataFrame, drivers: DataFrame) -> DataFrame:
    """Named drivers as the session of the speech has them: speech_id, session_key, driver_number, name; other numbers name nobody."""
    found = mentioned.where("entity_type = 'driver'").where(F.col("entity_key").rlike("^[0-9]{1,18}$"))
    keyed = found.join(speech.select("speech_id", "session_key"), "speech_id").where("session_key IS NOT NULL").withColumn("driver_number", F.col("entity_key").cast("long"))
    # Spark's estimate of a table's size says little about its rows in memory: a million drivers pass for a small side
    return keyed.join(drivers.select("session_key", "driver_number", "name").hint("merge"), ["session_key", "driver_number"]).select("speech_id", "session_key", "driver_number", "name")


def speech_times(utterances: DataFrame, clips: DataFrame, races: DataFrame, drivers: DataFrame, calls: DataFrame) -> DataFrame:
    """speech_id, session_key, driver_number, at_s: an utterance by its finished clip's time and place in it, a call by its own."""
    return utterance_times(utterances, clips, races, drivers).drop("clip_id").unionByName(calls.select("speech_id", "session_key", "driver_number", "at_s"))


def utterance_times(utterances: DataFrame, clips: DataFrame, races: DataFrame, drivers: DataFrame) -> DataFrame:
    """speech_id, clip_id, session_key, driver_number, at_s of the utterances alone."""
    u = utterances.select("utterance_id", "clip_id", "idx", "profile_id").where("profile_id IS NOT NULL")
    c = clips.where("status = 'COMPLETE'").select("clip_id", "race_id", "created_at").join(races.select("race_id", "session_key"), "race_id")
    said = u.join(c, "clip_id").join(drivers.select("session_key", "driver_number", "profile_id"), ["session_key", "profile_id"])
    return said.select(F.col("utterance_id").cast("string").alias("speech_id"), "clip_id", "session_key", "driver_number", (F.unix_seconds(F.col("created_at").cast("timestamp")) + F.col("idx")).alias("at_s"))


def target_driver(mentioned: DataFrame) -> DataFrame:
    """speech_id -> the only driver named; nothing where several are, or none."""
    return mentioned.groupBy("speech_id").agg(F.countDistinct("driver_number").alias("n"), F.min("driver_number").alias("target")).where("n = 1").drop("n")


def land_edges(edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) whose both ends exist. Nodes: key."""
    return edges.join(src_nodes.select(F.col("key").alias("src")), "src", "left_semi").join(dst_nodes.select(F.col("key").alias("dst")), "dst", "left_semi")


def inherit_identity(turns: DataFrame) -> DataFrame:
    """Turns without a profile take the newest one of their voice cluster in the clip (inherited)."""
    newest = turns.where("profile_id IS NOT NULL AND voice IS NOT NULL").groupBy("clip_id", "voice").agg(F.max_by("profile_id", "idx").alias("_p"))
    out = turns.join(newest, ["clip_id", "voice"], "left")
    return out.withColumn("inherited", F.col("profile_id").isNull() & F.col("_p").isNotNull()).withColumn("profile_id", F.coalesce("profile_id", "_p")).drop("_p")


def spoken_by(rows: DataFrame, cols: list[str], who: str) -> DataFrame:
    """Rows in which one of the columns contains the name, or the name contains it; empty columns say nothing."""
    want = F.lower(F.trim(F.lit(who)))
    test = F.lit(False)
    for c in cols:
        low = F.lower(F.trim(F.col(c)))
        test = test | F.coalesce((low != "") & (F.contains(low, want) | F.contains(want, low)), F.lit(False))
    return rows.where(test)


def resolve_names(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """token -> id of the same name in any case; null where none is. names: id, name; the lowest id of equal names."""
    one = names.groupBy(F.lower("name").alias("_n")).agg(F.min("id").alias("id"))
    return tokens.withColumn("_n", F.lower(F.trim("token"))).join(one, "_n", "left").drop("_n")
