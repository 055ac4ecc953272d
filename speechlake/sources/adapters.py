"""The domain's tables, shaped from the general tables of a data folder.

Each view is a DataFrame built on first use; `Tables(spark, folder).v_clips` and so on.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import normalized, scaled_sum
from ..operators.shared import MOST_BROADCAST, dealt, few


class Tables:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made, self._given = spark, folder, {}, {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def replaced(self, **frames: DataFrame) -> Tables:
        """The same tables, with these in place of the tables or views of their names; other views are built on them."""
        out = Tables(self.spark, self.folder)
        out._made.update(frames)
        out._given = frames
        return out

    def stored(self, names, folder: str) -> Tables:
        """The same tables and what was put in their place, with the views of these names written below folder and read from there; later ones are made of the written ones."""
        made, chain = {}, copy.copy(self)
        for name in names:
            chain._made = {**self._made, **made}
            getattr(chain, name).write.mode("overwrite").parquet(f"{folder}/{name}")
            made[name] = self.spark.read.parquet(f"{folder}/{name}")
        return self.replaced(**{**self._given, **made})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = VIEWS[name](self) if name in VIEWS else self.raw(name)
        return self._made[name]


def utterances(t: Tables) -> DataFrame:
    """One row per conversation turn, words of 0.4 s, half a second between turns."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    u = t.conversations.withColumn("n_words", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("long"))
    u = u.withColumn("prior", F.coalesce(F.sum("n_words").over(before), F.lit(0)))
    return u.selectExpr(
        "conv_id * 1000 + turn AS utterance_id", "conv_id AS clip_id", "turn AS idx", "role AS local_label", "text", "n_words",
        "0.4D * prior + 0.5D * turn AS start_s", "0.4D * prior + 0.5D * turn + 0.4D * n_words AS end_s",
    )


def phrases(t: Tables) -> DataFrame:
    """Utterances cut into their phrases, all of them: short turns with a pause of a quarter second between."""
    u = t.v_utterances.select("utterance_id", "clip_id", "idx", "local_label", "start_s", F.posexplode(F.split("text", "[.,!?;:]+", -1)).alias("pos", "text"))
    u = u.withColumn("n_words", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("long")).where("n_words > 0")
    before = Window.partitionBy("utterance_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("prior", F.coalesce(F.sum("n_words").over(before), F.lit(0)))
    start = "start_s + 0.4D * prior + 0.25D * pos"
    return u.selectExpr("utterance_id * 10000 + pos AS utterance_id", "clip_id", "idx * 10000 + pos AS idx", "local_label", "text", "n_words", f"{start} AS start_s", f"{start} + 0.4D * n_words AS end_s")


def words(t: Tables) -> DataFrame:
    w = t.v_utterances.select("clip_id", "idx", "local_label", "start_s", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("word_ix", "word"))
    return w.selectExpr(
        "clip_id", "idx", "word_ix", "(idx * 100000L + word_ix) AS word_id", "word", "local_label",
        "start_s + 0.4D * word_ix AS start_s", "start_s + 0.4D * word_ix + 0.35D AS end_s", "0.5D + ((word_ix * 37) % 50) / 100D AS probability",
    )


def word_turns(t: Tables) -> DataFrame:
    own = t.v_utterances.selectExpr("clip_id", "idx * 1000000L AS turn_id", "local_label AS label", "start_s + 0.3D AS start_s", "end_s + 0.3D AS end_s")
    said = t.v_words.where("word_ix % 5 = 4").selectExpr("clip_id", "idx * 1000000L + word_ix + 1 AS turn_id", "'interjection' AS label", "start_s + 0.1D AS start_s", "start_s + 0.3D AS end_s")
    return own.unionByName(said)


def turns(t: Tables) -> DataFrame:
    return t.events.selectExpr("user_id AS clip_id", "event_id AS turn_id", "event_type AS label", "unix_micros(cast(ts AS timestamp)) / 1000000D AS start_s", "unix_micros(cast(ts AS timestamp)) / 1000000D + 600D * value AS end_s")


def vad(t: Tables) -> DataFrame:
    """Speech regions: views and clicks of 300 * value seconds, overlapping ones merged."""
    from ..operators.intervals import merge_intervals

    parts = t.events.where("event_type IN ('view', 'click')").selectExpr("user_id AS clip_id", "unix_micros(cast(ts AS timestamp)) / 1000000D AS start_s", "unix_micros(cast(ts AS timestamp)) / 1000000D + 300D * value AS end_s")
    return merge_intervals(parts, ["clip_id"], 0.0)


def frames(t: Tables) -> DataFrame:
    return t.events.selectExpr("user_id AS clip_id", "event_id AS frame_id", "unix_micros(cast(ts AS timestamp)) / 1000000D AS at_s", "((event_id * 7919) % 2001 - 1000) / 1000D AS amp")


def clips(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS clip_id", "o_custkey AS race_id", "o_orderdate AS created_at", "CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'REJECTED' ELSE 'QUEUED' END AS status",
        "cast(floor(o_totalprice * 100) AS bigint) % 200000 / 100000D - 1D AS sentiment_score", "concat('clip_', o_orderkey) AS filename", "o_orderkey % 7 = 0 AS needs_review",
        "CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'es' END AS language", "10D + o_orderkey % 50 AS duration_s",
        "CASE o_orderkey % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'fair' WHEN 2 THEN 'poor' END AS grade",
    )


def clip_speakers(t: Tables) -> DataFrame:
    return speakers_of(dealt(t.lineitem, t.lineitem.count(), "l_orderkey").withColumn("nth", nth_line()).where("nth = 1"))


def nth_line():
    """A line's place among the lines of its number; the first one is a clip's speaker."""
    return F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))


def speakers_of(lines: DataFrame, *more: str) -> DataFrame:
    return lines.selectExpr(
        "l_orderkey AS clip_id", "cast(l_linenumber AS bigint) AS local_label", "CASE WHEN l_returnflag = 'A' THEN l_suppkey END AS profile_id", "CASE WHEN l_returnflag = 'N' THEN l_suppkey END AS cluster_id",
        "cast(l_quantity AS double) AS speech_s", "cast(round(l_discount * 10, 1) AS double) AS reliability",
        "CASE cast(round(l_tax * 100) AS bigint) % 4 WHEN 0 THEN 'confident' WHEN 1 THEN 'suggested' WHEN 2 THEN 'unknown' ELSE 'abstained' END AS match_result",
        "cast(l_partkey % 100 AS double) / 100D AS match_score", "l_partkey AS part", "l_shipdate AS shipped", *more,
    )


def speech_utt(t: Tables) -> DataFrame:
    """An utterance per clip speaker, with mood and two sentiments."""
    return utterances_of(t.v_clip_speakers)


def utterances_of(speakers: DataFrame, *more: str) -> DataFrame:
    return speakers.selectExpr(
        "clip_id * 10 + local_label AS utterance_id", "clip_id", "local_label AS idx", "local_label", "profile_id", "cluster_id", "speech_s", "concat('words of part ', part) AS text",
        "CASE part % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'stressed' WHEN 2 THEN 'tired' END AS mood", "(part * 31 % 201 - 100) / 100D AS sentiment_score", "(part * 57 % 201 - 100) / 100D AS text_score",
        "CASE WHEN part * 31 % 201 - 100 > 20 THEN 'positive' WHEN part * 31 % 201 - 100 < -20 THEN 'negative' ELSE 'neutral' END AS sentiment",
        "CASE WHEN part * 57 % 201 - 100 > 20 THEN 'positive' WHEN part * 57 % 201 - 100 < -20 THEN 'negative' ELSE 'neutral' END AS text_sentiment", *more,
    )


def done_utt(t: Tables) -> DataFrame:
    """The utterances of finished clips, with their race."""
    return t.v_speech_utt.join(t.v_clips.where("status = 'COMPLETE'").select("clip_id", "race_id"), "clip_id")


def laps(t: Tables) -> DataFrame:
    """Orders of a customer in turn; a lap lasts to the next one, 90 days at most."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t.orders.select("o_custkey", F.row_number().over(order).cast("long").alias("lap_number"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"), F.unix_seconds(F.lead("o_orderdate").over(order).cast("timestamp")).alias("next"))
    return o.selectExpr("o_custkey % 10 AS session_key", "o_custkey AS driver_number", "lap_number", "at AS start_s", "cast(least(next - at, 90 * 86400) AS double) AS duration_s")


def radio(t: Tables) -> DataFrame:
    """Calls are distinct; each table is made so before the join, on few columns, so that names are not carried through it."""
    lines = t.lineitem.count()
    n_parts = t.part.count()
    said = dealt(t.lineitem.select("l_orderkey", "l_partkey", "l_shipdate"), lines, "l_orderkey").distinct()
    ordered = dealt(t.orders.select("o_orderkey", "o_custkey"), lines, "o_orderkey").distinct()
    calls = said.join(ordered.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    names = t.part.select("p_partkey", "p_name").distinct()
    if n_parts <= MOST_BROADCAST:
        calls = calls.join(F.broadcast(names), F.col("l_partkey") == F.col("p_partkey"))
    else:
        calls = dealt(calls, lines, "l_partkey").join(dealt(names, lines, "p_partkey").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    return calls_of(calls)


def calls_of(lines: DataFrame, *more: str) -> DataFrame:
    return lines.selectExpr(
        "concat(o_custkey, '-', o_orderkey, '-', l_partkey, '-', date_format(l_shipdate, 'yyyyMMdd')) AS call_id", "o_custkey % 10 AS session_key", "o_custkey AS driver_number",
        "unix_seconds(cast(l_shipdate AS timestamp)) AS recorded_s", "p_name AS text", "CASE WHEN l_partkey % 17 = 0 THEN 'failed' END AS error", "CASE WHEN l_partkey % 13 <> 0 THEN unix_seconds(cast(l_shipdate AS timestamp)) + 60 END AS analyzed_s",
        "CASE l_partkey % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'stressed' WHEN 2 THEN 'tired' END AS mood", *more,
    )


def arrived_lines(t: Tables, orders: DataFrame) -> DataFrame:
    """The lines of these orders, moved once, as the utterances that they would be with their order: a line speaks if it is its clip speaker's, and calls if it is a call's."""
    lines, keys = t.lineitem, orders.select(F.col("o_orderkey").alias("l_orderkey"))
    if few(keys):
        lines = lines.join(F.broadcast(keys), "l_orderkey", "left_semi")
    n = lines.count()
    own = dealt(lines, n, "l_orderkey").withColumn("speaks", nth_line() == 1)
    ordered = dealt(orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), n, "o_orderkey")
    call = Window.partitionBy("l_orderkey", "o_custkey", "l_partkey", "l_shipdate").orderBy("l_linenumber")
    met = own.join(ordered.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("calls", F.row_number().over(call) == 1)
    ordered = ("o_custkey", "o_orderstatus", "speaks", "calls")
    said = utterances_of(speakers_of(met, *ordered), "part", "shipped", *ordered)
    return said.select("clip_id", "utterance_id", "idx", "profile_id", F.when(F.col("speaks"), F.col("text")).alias("text"), "mood", "sentiment_score", "text_score", "part", "shipped", *ordered)


def drivers(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey % 10 AS session_key", "c_custkey AS driver_number", "c_name AS name", "c_nationkey AS team_key", "CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 100 + 1 END AS profile_id")


def sessions(t: Tables) -> DataFrame:
    """Ten sessions, each held at a nation as its circuit."""
    return t.nation.where("n_nationkey < 10").selectExpr("cast(n_nationkey AS bigint) AS session_key", "n_name AS circuit", "concat('Session ', n_nationkey) AS name", "2015 + n_nationkey % 5 AS year", "n_regionkey AS country_key")


def races(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey AS race_id", "concat('Race ', c_custkey) AS name", "CASE WHEN c_custkey % 4 <> 3 THEN c_custkey % 10 END AS session_key")


def profiles_named(t: Tables) -> DataFrame:
    return t.supplier.selectExpr("s_suppkey AS profile_id", "s_name AS name", "s_nationkey AS nation_key", "CASE WHEN s_suppkey % 5 = 0 THEN 'claimed' ELSE 'confirmed' END AS status")


def voices(t: Tables) -> DataFrame:
    """Each label's first embedding with noise that grows with vec_id modulo 5."""
    e = t.embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    anchor = e.groupBy("label").agg(F.min_by("e", "vec_id").alias("anchor"))
    v = e.join(F.broadcast(anchor), "label")  # ten labels
    mixed = scaled_sum(F.col("anchor"), F.col("e"), 0.5 + 0.5 * (F.col("vec_id") % 5))
    return v.select(
        "vec_id", "label", normalized(mixed).alias("voice"), (0.5 + F.col("vec_id") % 9).alias("speech_s"), (F.col("vec_id") % 30).cast("double").alias("snr_db"),
        (4000 + F.col("vec_id") % 5 * 1000).cast("double").alias("bandwidth_hz"),
    )


def enrollments(t: Tables) -> DataFrame:
    from ..functions.scoring import reliability

    v = t.v_voices.where("vec_id % 2 = 0")
    return v.select("vec_id", F.col("label").alias("profile_id"), F.col("voice").alias("vec"), "speech_s", reliability(F.col("speech_s"), F.col("snr_db"), F.lit(0.0), F.col("bandwidth_hz")).alias("reliability"))


def queries_of_voices(t: Tables) -> DataFrame:
    from ..functions.scoring import reliability

    v = t.v_voices.where("vec_id % 2 = 1")
    return v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("true_label"), F.col("voice").alias("vec"), "speech_s", reliability(F.col("speech_s"), F.col("snr_db"), F.lit(0.0), F.col("bandwidth_hz")).alias("reliability"))


def exemplars(t: Tables) -> DataFrame:
    return t.v_voices.where("vec_id < 40").select(F.col("vec_id").alias("exemplar_id"), F.when(F.col("label") == 9, "none").otherwise(F.concat(F.lit("type_"), F.col("label"))).alias("event_type"), F.col("voice").alias("vec"))


def speech_vectors(t: Tables) -> DataFrame:
    return t.v_voices.select(F.col("vec_id").alias("speech_id"), F.col("voice").alias("vec"), (F.col("vec_id") % 11 + 2).alias("n_words"), "label")


def docs(t: Tables) -> DataFrame:
    return t.documents.selectExpr("doc_id AS speech_id", "text", "source", "lang", "cast(regexp_extract(source, '[0-9]+$', 0) AS bigint) AS session_key", "CASE doc_id % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'stressed' WHEN 2 THEN 'tired' END AS mood")


def aliases(t: Tables) -> DataFrame:
    names = t.part.selectExpr("lower(p_name) AS alias", "'part' AS entity_type", "lower(p_name) AS entity_key").distinct()
    firsts = t.part.selectExpr("lower(substring_index(p_name, ' ', 1)) AS alias", "'word' AS entity_type", "lower(substring_index(p_name, ' ', 1)) AS entity_key").distinct()
    nations = t.nation.selectExpr("lower(n_name) AS alias", "'nation' AS entity_type", "cast(n_nationkey AS string) AS entity_key")
    return names.unionByName(firsts).unionByName(nations)


def graph_aliases(t: Tables) -> DataFrame:
    """Part names as names of drivers, teams and circuits, by their length."""
    names = t.part.select(F.lower("p_name").alias("alias")).distinct().withColumn("n", F.length("alias"))
    kinds = names.selectExpr("alias", "n", "CASE n % 3 WHEN 0 THEN 'driver' WHEN 1 THEN 'team' ELSE 'circuit' END AS entity_type")
    nations = t.nation.selectExpr("n_nationkey AS k", "n_name")
    return kinds.join(F.broadcast(nations), F.col("k") == F.col("n") % 12, "left").selectExpr("alias", "entity_type", "CASE entity_type WHEN 'driver' THEN cast(n * 7 AS string) WHEN 'team' THEN cast(n AS string) ELSE n_name END AS entity_key")


def incoming(t: Tables) -> DataFrame:
    """Two batches of files: all documents, then every third again for another race."""
    first = t.documents.selectExpr("1 AS batch", "doc_id AS file_id", "text AS content", "source AS race")
    return first.unionByName(t.documents.where("doc_id % 3 = 0").selectExpr("2 AS batch", "doc_id + 1000000000L AS file_id", "text AS content", "concat(source, '-b') AS race"))


def replies(t: Tables) -> DataFrame:
    """A model's reply to every turn: an array in prose, every seventh broken, one line each of several kinds, the whole text as its reason."""
    return t.v_utterances.selectExpr("utterance_id AS batch_id", "5 AS batch_size", """CASE WHEN utterance_id % 7 = 0 THEN concat('sorry, ', text)
        WHEN utterance_id % 7 = 3 THEN concat('[{"n": 1, "event": "overtake"', ' broken')
        ELSE concat('Here: ```json [', '{"n": ', utterance_id % 8, ', "event": "', CASE utterance_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'overtake' WHEN 2 THEN 'pit_stop' WHEN 3 THEN 'invented' ELSE 'yellow_flag' END, '", "confidence": ', utterance_id % 11 / 10.0D, ', "other_car": " car ', utterance_id % 20, ' ", "why": "', regexp_replace(text, '[^A-Za-z ]', ' '), '"}',
        ', {"n": 2, "event": "overtake", "confidence": 0.9}]``` done') END AS reply""")


def uuid_of(x: str) -> str:
    """A number as an id of the usual form, in SQL."""
    return f"regexp_replace(md5(cast({x} AS string)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')"


def answers(t: Tables) -> DataFrame:
    """An answer for each turn, with ids in any case, repeated ones, one that runs on, or none; and the ids that were consulted."""
    own, before = uuid_of("utterance_id"), uuid_of("utterance_id - 1")
    said = f"concat(text, ' [', {own}, '] and ', upper({before}), ', again ', {own}, '; not ', {uuid_of('utterance_id + 1')}, 'f')"
    consulted = ", ".join(uuid_of(f"utterance_id + {i}") for i in (0, 1, 1, 2, 3, 4, 5, 6, 7))
    return t.v_utterances.selectExpr("utterance_id", f"CASE WHEN utterance_id % 3 = 0 THEN text ELSE {said} END AS answer", f"array({consulted}) AS consulted")


def audit(t: Tables) -> DataFrame:
    """Actions of an actor in turn."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(F.col("user_id").alias("actor"), F.row_number().over(order).cast("long").alias("seq"), F.col("event_type").alias("action"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"), F.concat(F.lit("object-"), F.col("event_id")).alias("object"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 3).cast("string").alias("before"), (F.col("event_id") % 4).cast("string").alias("after"))


VIEWS = {
    "v_utterances": utterances, "v_phrases": phrases, "v_words": words, "v_word_turns": word_turns, "v_turns": turns, "v_vad": vad, "v_frames": frames,
    "v_clips": clips, "v_clip_speakers": clip_speakers, "v_speech_utt": speech_utt, "v_done_utt": done_utt, "v_laps": laps, "v_radio": radio, "v_drivers": drivers, "v_sessions": sessions, "v_races": races,
    "v_profiles_named": profiles_named, "v_voices": voices, "v_enrollments": enrollments, "v_queries": queries_of_voices, "v_exemplars": exemplars, "v_speech_vectors": speech_vectors,
    "v_docs": docs, "v_aliases": aliases, "v_graph_aliases": graph_aliases, "v_incoming": incoming, "v_replies": replies, "v_answers": answers, "v_audit": audit,
}
