"""Keyword, vector and fused retrieval over tables of requests.

A request is rows of query_terms: request_id, clause_id, kind (all, any, none, phrase), term, offset. Ranks
have the speech id as tie-break, so reruns agree.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import tone_phrase
from .nearness import nearest_of
from .shared import ROWS_OF_A_TASK, dealt

NOT_WORD = r"[^\p{L}\p{N}]+"
#: Characters of the texts whose words one task groups.
CHARS_OF_A_TASK = 8_000_000


def words() -> Column:
    """The lower-cased runs of letters and digits of text, with what stands before the first and after the last, which is empty."""
    return F.split(F.lower("text"), NOT_WORD)


def postings(speech: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """speech_id, token, positions (from 0): lower-cased runs of letters and digits, no stemming.

    With only (term), the rows of these tokens; the others are left out before anything is shuffled. Without, whole
    texts move by their id and are cut and grouped where they arrive, in tasks of about CHARS_OF_A_TASK, so that
    words are not shuffled one by one and a task's words stay in its memory.
    """
    if only is None:
        size = speech.agg(F.count(F.lit(1)), F.sum(F.length("text").cast("long"))).first()
        speech = speech.select("speech_id", "text").repartition(max(1, -(-(size[1] or 0) // CHARS_OF_A_TASK), -(-size[0] // ROWS_OF_A_TASK)), "speech_id")
    tokens = F.filter(words(), lambda x: x != "")
    rows = speech.select("speech_id", F.posexplode(tokens).alias("pos", "token"))
    if only is not None:
        few = only.select(F.col("term").alias("token")).distinct()
        rows = rows.join(F.broadcast(few) if few.limit(10_001).count() <= 10_000 else few, "token", "left_semi")
    return rows.groupBy("speech_id", "token").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def match(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(request_id, speech_id) that meet every all, any and phrase clause and no none clause."""
    hits = index.join(terms, index["token"] == terms["term"])
    positive = hits.where("kind <> 'none'")
    single = positive.where("kind <> 'phrase'").select("request_id", "speech_id", "clause_id").distinct()
    starts = positive.where("kind = 'phrase'").select("request_id", "speech_id", "clause_id", "offset", F.explode("positions").alias("pos"))
    lengths = terms.where("kind = 'phrase'").groupBy("request_id", "clause_id").agg(F.countDistinct("offset").alias("len"))
    phrase = starts.groupBy("request_id", "speech_id", "clause_id", (F.col("pos") - F.col("offset")).alias("start")).agg(F.countDistinct("offset").alias("n")).join(lengths, ["request_id", "clause_id"]).where("n = len").select("request_id", "speech_id", "clause_id").distinct()
    needed = terms.where("kind <> 'none'").groupBy("request_id").agg(F.countDistinct("clause_id").alias("need"))
    met = single.unionByName(phrase).groupBy("request_id", "speech_id").agg(F.countDistinct("clause_id").alias("met")).join(needed, "request_id").where("met = need")
    banned = hits.where("kind = 'none'").select("request_id", "speech_id").distinct()
    return met.select("request_id", "speech_id").join(banned, ["request_id", "speech_id"], "left_anti")


def cover_rank(index: DataFrame, terms: DataFrame, counted: bool = False) -> DataFrame:
    """request_id, speech_id, rank: for each place where all terms of the request end, 0.1 over 1 plus the strangers within.

    A cover ends at a position of one term and begins at the latest earlier position by which all others have
    come; covers that hold another are left out. counted: for an index that costs little to read twice; its
    positions are counted first and dealt to tasks by their number, so that what a task sorts stays in its memory.
    """
    of_request = Window.partitionBy("request_id")
    wanted = terms.where("kind <> 'none'").select("request_id", "term").distinct()
    wanted = wanted.withColumns({"slot": F.row_number().over(of_request.orderBy("term")), "n_terms": F.count("*").over(of_request)})
    slots, rows = wanted.agg(F.max("slot"), F.count("*")).first()
    wanted = F.broadcast(wanted) if rows <= 10_000 else wanted
    at = index.join(wanted, index["token"] == wanted["term"]).select("request_id", "speech_id", "slot", "n_terms", "positions")
    if counted:
        at = dealt(at, at.agg(F.sum(F.size("positions"))).first()[0] or 0, "request_id", "speech_id")
    return covers(at.select("request_id", "speech_id", "slot", "n_terms", F.explode("positions").alias("pos")), slots or 1)


def covers(at: DataFrame, slots: int) -> DataFrame:
    """request_id, speech_id, slot, n_terms, pos (each place of each term, slots from 1 to at most slots) -> rank."""
    doc = Window.partitionBy("request_id", "speech_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # the last position of each term so far
    last = F.array_compact(F.array(*(F.last(F.when(F.col("slot") == i + 1, F.col("pos")), ignorenulls=True).over(doc) for i in range(slots))))
    found = at.withColumn("_last", last).where(F.size("_last") == F.col("n_terms")).select("request_id", "speech_id", "pos", "n_terms", F.array_min("_last").alias("begin"))
    minimal = found.groupBy("request_id", "speech_id", "begin").agg(F.min("pos").alias("end"), F.first("n_terms").alias("n_terms"))
    return minimal.groupBy("request_id", "speech_id").agg(F.sum(0.1 / (1 + (F.col("end") - F.col("begin") + 1 - F.col("n_terms")))).alias("rank"))


def ranked(rows: DataFrame, score: str, cap: int) -> DataFrame:
    """rows with rk: their rank per request by score, cap at most (the cap is the leg's length)."""
    w = Window.partitionBy("request_id").orderBy(F.desc(score), "speech_id")
    return rows.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= cap)


#: Speech rows that meet the requests in one group.
SPEECH_OF_A_GROUP = 10_000


def nearest(requests: DataFrame, speech: DataFrame, cap: int, only: DataFrame | None = None, most: int = 10_000, share: int = SPEECH_OF_A_GROUP) -> DataFrame:
    """request_id, speech_id, sim, rk: the cap speech rows nearest to each request (request_id, vec), ties by id.

    All speech (speech_id, vec) is compared with all requests: both are counted and dealt by hash to groups of about
    `share` rows and `most` requests, and a group gives the best cap of its own rows, so that rows for single pairs
    are never made. Pairs without a cosine (null vectors or components, lengths that differ) rank last. only: speech
    ids that filters leave.
    """
    rows = (speech if only is None else speech.join(only, "speech_id", "left_semi")).select("speech_id", "vec")
    parts, blocks = (max(1, -(-df.count() // n)) for df, n in ((rows, share), (requests, most)))
    dealt = lambda df, key, mine, n, other, m: df.withColumns({mine: F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    left = dealt(rows, "speech_id", "_part", parts, "_block", blocks).groupBy("_part", "_block")
    right = dealt(requests.select(F.col("request_id").alias("request_id"), F.col("vec").alias("vec")), "request_id", "_block", blocks, "_part", parts).groupBy("_part", "_block")
    types = {**dict(rows.dtypes), **dict(requests.dtypes)}

    def best(own: pa.Table, asks: pa.Table) -> pa.Table:
        return nearest_of(own, asks, cap)

    sims = left.cogroup(right).applyInArrow(best, f"request_id {types['request_id']}, speech_id {types['speech_id']}, sim double")
    return ranked(sims, "sim", cap)


def fuse(a: DataFrame, b: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal ranks of two legs added: request_id, speech_id, score; a leg that lacks a row adds nothing."""
    left, right = a.select("request_id", "speech_id", F.col("rk").alias("ra")), b.select("request_id", "speech_id", F.col("rk").alias("rb"))
    both = left.join(right, ["request_id", "speech_id"], "full")
    return both.withColumn("score", F.coalesce(1.0 / (k + F.col("ra")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("rb")), F.lit(0.0)))


def clipped(text: Column, most: int = 160) -> Column:
    """Text with single blanks, cut with an ellipsis to most characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def brief(rows: DataFrame) -> DataFrame:
    """One line per hit: id, who, where, lap, how the voice reads, a clipped quote; what is missing is left out."""
    who = F.coalesce("driver", "speaker", F.lit("unidentified speaker"))
    part = lambda before, c: F.coalesce(F.concat(F.lit(before), c.cast("string")), F.lit(""))
    lap = F.try_element_at("laps", F.lit(1))["lap_number"]
    line = F.concat(F.lit("["), "speech_id", F.lit("] "), who, part(", ", F.col("session")), part(", lap ", lap), part(", voice reads ", F.col("mood")), F.lit(': "'), clipped(F.col("text")), F.lit('"'))
    return rows.withColumn("line", line)


def block(rows: DataFrame) -> DataFrame:
    """The lines of one piece of evidence: head, tone, quote, laps with their change, events, mentions, before and after."""
    team = F.coalesce(F.concat(F.lit(" ("), "team", F.lit(")")), F.lit(""))
    who = F.concat(F.coalesce("driver", "speaker", F.lit("unidentified speaker")), team)
    head = F.concat_ws(" | ", F.when(F.col("session").isNotNull(), F.concat_ws(" ", "session", F.col("year").cast("string"))).otherwise(F.col("circuit")), who)
    tone = tone_phrase(F.col("mood"), F.col("sentiment"), F.col("sentiment_score"), F.col("text_sentiment"))

    def lap_line(x: Column) -> Column:
        change = F.concat(F.lit(" ("), F.format_string("%+.1f", x["duration_s"] - x["prev_s"]), F.lit("s vs previous)"))
        return F.concat(F.lit("  lap "), x["lap_number"].cast("string"), F.lit(": "), F.format_string("%.1f", x["duration_s"]), F.lit("s"), F.when(x["prev_s"].isNotNull(), change).otherwise(""))

    def event_line(x: Column) -> Column:
        of = F.filter("targets", lambda y: y["event_type"] == x["event_type"])
        meant = F.coalesce(F.concat(F.lit(", involving "), F.try_element_at(of, F.lit(1))["driver"]), F.lit(""))
        return F.concat(F.lit("  on track: reads as "), F.translate(x["event_type"], "_", " "), meant, F.format_string(" (%.2f)", x["score"]))

    quote = lambda label, c: F.concat(F.lit(label + '"'), F.trim(c), F.lit('"'))
    listed = lambda name, line: F.when(F.size(name) > 0, F.array_join(F.transform(name, line), "\n"))
    named = F.array_join(F.transform("mentions", lambda m: F.concat(m["name"], F.lit(" ("), m["kind"], F.lit(")"))), ", ")
    lines = F.concat_ws("\n", F.concat(F.lit("["), "speech_id", F.lit("] "), head), F.when(tone != "", F.concat(F.lit("  tone: "), tone)), quote("  ", F.col("text")), listed("laps", lap_line), listed("events", event_line), F.when(F.size("mentions") > 0, F.concat(F.lit("  mentions: "), named)), quote("  before: ", F.col("prev_text")), quote("  after: ", F.col("next_text")))
    return rows.withColumn("block", lines)
