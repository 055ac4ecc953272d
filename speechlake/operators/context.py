"""What the graph knows around pieces of speech: typed walks over its edges, each hop gathered before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph as g
from . import joins as j
from .shared import stored

C = F.col


def speech_lines(t) -> DataFrame:
    """All speech of finished clips and analysed calls with its own facts, and the line and place where it stands.

    speech_id, kind, text, mood, sentiments, profile_id (utterances), driver_number and session_key (calls), race_id
    or the driver as `whose`, line and spot (its order in a clip, or among its driver's calls), newest.
    """
    none = lambda kind: F.lit(None).cast(kind)
    u = t.v_speech_utt.join(g.finished(t).select("clip_id", "race_id", "created_at"), "clip_id").select(
        C("utterance_id").cast("string").alias("speech_id"), F.lit("utterance").alias("kind"), "text", "mood", "sentiment", "sentiment_score", "text_sentiment", "profile_id",
        none("long").alias("driver_number"), none("long").alias("session_key"), C("race_id").alias("whose"), F.concat(F.lit("clip:"), "clip_id").alias("line"), C("idx").alias("spot"), F.unix_seconds(C("created_at").cast("timestamp")).alias("newest"),
    )
    c = g.good_calls(t).select(
        C("call_id").alias("speech_id"), F.lit("radio_call").alias("kind"), "text", "mood", none("string").alias("sentiment"), none("double").alias("sentiment_score"), none("string").alias("text_sentiment"), none("long").alias("profile_id"),
        "driver_number", "session_key", C("driver_number").alias("whose"), F.concat(F.lit("driver:"), "driver_number").alias("line"), C("recorded_s").alias("spot"), C("recorded_s").alias("newest"),
    )
    return u.unionByName(c)


def gathered(edges: DataFrame, name: str, *cols) -> DataFrame:
    """speech_id and an ordered array of its distinct facts of one kind."""
    return edges.groupBy("speech_id").agg(F.sort_array(F.collect_set(F.struct(*cols))).alias(name))


def neighbourhood(t, ids: DataFrame, speech: DataFrame | None = None) -> DataFrame:
    """One row per speech of ids (speech_id, distinct) that the graph has, with everything one walk away.

    speaker; driver (direct for a call, over the voice for an utterance: the smallest number where a voice has
    several), driver_name and team; session and year; the texts before and after in its line; laps with the time of
    the lap before; mentions (kind, name), events (type, score, family) and targets (event_type, driver). A kind's
    edges are cut to the asked speech and gathered to one row per speech before they are joined, so that kinds don't
    multiply each other; what is missing is null.
    """
    asked = lambda df: df.join(ids, "speech_id", "left_semi")
    speech = stored(speech_lines(t)) if speech is None else speech
    around = Window.partitionBy("line").orderBy("spot", "speech_id")
    lines = asked(speech).select("line").distinct()
    own = stored(asked(speech.join(lines, "line", "left_semi").withColumns({"prev_text": F.lag("text").over(around), "next_text": F.lead("text").over(around)})))
    # every kind of fact below is made of the asked speech alone: clips, calls and their texts are not read again
    said = own.where("kind = 'utterance'").withColumns({"clip_id": F.substring_index("line", ":", -1).cast("long"), "race_id": C("whose")})
    calls = own.where("kind = 'radio_call'")

    voices = t.v_drivers.where("profile_id IS NOT NULL").groupBy("profile_id").agg(F.min("driver_number").alias("voice_driver"))
    drivers = t.v_drivers.groupBy("driver_number").agg(F.max("name").alias("driver_name"), F.max(C("team_key").cast("string")).alias("team"))
    speakers = t.v_profiles_named.select("profile_id", C("name").alias("speaker"))
    sessions = t.v_sessions.select("session_key", C("name").alias("session"), "year", "circuit")
    who = own.join(speakers, "profile_id", "left").join(voices, "profile_id", "left").withColumn("driver_number", F.coalesce("driver_number", "voice_driver"))
    who = who.join(drivers, "driver_number", "left").withColumn("driver", C("driver_name")).join(sessions, "session_key", "left")

    numbers = t.v_drivers.select("session_key", "driver_number", "profile_id")
    sessions_of = t.v_races.select("race_id", C("session_key").alias("_session"))
    timed = said.where("profile_id IS NOT NULL").select("speech_id", "race_id", "profile_id", (C("newest") + C("spot")).alias("at_s")).join(sessions_of, "race_id").withColumnRenamed("_session", "session_key")
    said_at = timed.join(numbers, ["session_key", "profile_id"]).select("speech_id", "session_key", "driver_number", "at_s").unionByName(calls.select("speech_id", "session_key", "driver_number", C("spot").alias("at_s")))
    said_at = stored(said_at)
    driven = t.v_laps.join(said_at.select("driver_number").distinct(), "driver_number", "left_semi")  # goes below the window over orders
    w = Window.partitionBy("session_key", "driver_number").orderBy("lap_number")
    laps = stored(driven.select("session_key", "driver_number", "lap_number", "start_s", "duration_s", F.lag("duration_s").over(w).alias("prev_s")))
    on_laps = j.during_lap(said_at, laps, 86400.0, 30 * 86400.0).join(laps.drop("start_s"), ["session_key", "driver_number", "lap_number"])

    texts = calls.select("speech_id", "session_key", "text").unionByName(said.join(sessions_of, "race_id", "left").select("speech_id", C("_session").alias("session_key"), "text"))
    named = g.mentions_of(t, texts).join(g.entities(t), C("dst") == C("key"), "left_semi").select(C("src").alias("speech_id"), F.substring_index("dst", ":", 1).alias("kind"), F.expr("substring(dst, instr(dst, ':') + 1)").alias("entity"))
    by_number = drivers.select(C("driver_number").cast("string").alias("entity"), F.lit("driver").alias("kind"), "driver_name")
    named = named.join(by_number, ["kind", "entity"], "left").withColumn("name", F.coalesce("driver_name", "entity"))

    events = stored(g.events_of(said.withColumn("idx", C("spot"))))
    targets = events.where("target IS NOT NULL").join(drivers, C("target") == C("driver_number")).select("speech_id", "event_type", C("driver_name").alias("driver"))
    out = who.select("speech_id", "kind", "text", "mood", "sentiment", "sentiment_score", "text_sentiment", "speaker", "driver", "driver_name", "team", "session", "year", "circuit", "prev_text", "next_text")
    for more in (gathered(on_laps, "laps", "lap_number", "duration_s", "prev_s"), gathered(named, "mentions", "kind", "name"), gathered(events, "events", "event_type", "score", "family"), gathered(targets, "targets", "event_type", "driver")):
        out = out.join(more, "speech_id", "left")
    return out


def expand(t, anchors: DataFrame, speech: DataFrame | None = None) -> DataFrame:
    """anchors (request_id, rank, speech_id) with the neighbourhood of each; speech that the graph lacks is left out."""
    return anchors.join(neighbourhood(t, anchors.select("speech_id").distinct(), speech), "speech_id")
