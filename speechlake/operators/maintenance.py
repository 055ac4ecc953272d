"""Ingest, upserts, replacement, deletion, exports, adjudication tables and audit chains."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from .folds import fold_rows

C = F.col


def ingest(incoming: DataFrame, clips: DataFrame) -> DataFrame:
    """file_id, sha, outcome: new, duplicate, or moved (a duplicate that names another race).

    Within a batch the smallest file_id of a content is the first. Contents are compared by hash; a hash with
    very many files is grouped before it is joined.
    """
    rows = incoming.withColumn("sha", F.sha2(F.coalesce("content", F.lit("")), 256))
    first = rows.groupBy("sha").agg(F.min("file_id").alias("first_id"), F.min_by("race", "file_id").alias("first_race"))
    known = first.join(clips.select("sha", F.col("race").alias("old_race")), "sha", "left")
    met = rows.join(known, "sha")
    owner = F.coalesce("old_race", "first_race")
    new = C("old_race").isNull() & (C("file_id") == C("first_id"))
    return met.select("file_id", "sha", F.when(new, "new").when(C("race").isNotNull() & ~C("race").eqNullSafe(owner), "moved").otherwise("duplicate").alias("outcome"))


def upsert(base: DataFrame, new: DataFrame, keys: list[str], cols: list[str], fill_only: bool = False) -> DataFrame:
    """base with new's rows: overwritten where the key is there, added where not. fill_only keeps what is not null."""
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in cols), F.lit(True).alias("_hit"))
    both = base.join(n, keys, "full")
    old = lambda c: F.coalesce(c, f"_{c}")
    pick = (lambda c: old(c)) if fill_only else (lambda c: F.when(C("_hit"), C(f"_{c}")).otherwise(C(c)))
    return both.select(*keys, *(pick(c).alias(c) if c in cols else C(c) for c in base.columns if c not in keys))


def insert_missing(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti").select(base.columns))


def replace_derived(table: DataFrame, new: DataFrame, ids: DataFrame, key: str = "clip_id") -> DataFrame:
    """table with all rows of the given ids replaced by new ones; doing it twice changes nothing."""
    return table.join(ids.select(key), key, "left_anti").select(table.columns).unionByName(new.join(ids.select(key), key, "left_semi").select(table.columns))


def replace_source(events: DataFrame, new: DataFrame, source: str, per_source: bool = False) -> DataFrame:
    """Events of one source replaced; of a (speech, type), the row that was there first stays."""
    kept = events.where(C("source") != source).withColumn("_new", F.lit(0))
    both = kept.unionByName(new.withColumn("_new", F.lit(1)))
    keys = ["speech_id", "event_type", *(["source"] if per_source else [])]
    w = Window.partitionBy(*keys).orderBy("_new", F.desc("score"), "source")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def delete_clips(tables: dict[str, DataFrame], ids: DataFrame, reason: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the clips, receipts: clip_id, n_rows, reason). Every table has clip_id."""
    left = {name: df.join(ids, "clip_id", "left_anti") for name, df in tables.items()}
    counts = None
    for df in tables.values():
        n = df.groupBy("clip_id").agg(F.count("*").alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    receipts = ids.join(counts.groupBy("clip_id").agg(F.sum("n").alias("n_rows")), "clip_id", "left").select("clip_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(reason).alias("reason"))
    return left, receipts


def delete_races(races: DataFrame, clips: DataFrame, tables: dict[str, DataFrame], ids: DataFrame, reason: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], DataFrame]:
    """(races, clips, tables, receipts) without the races of ids (race_id, with_clips).

    Where with_clips is set, the race's clips go with all their rows, each with a receipt; else they stay without a race.
    """
    marked = clips.join(ids.select("race_id", "with_clips"), "race_id", "left")
    gone = marked.where("with_clips").select("clip_id")
    left, receipts = delete_clips(tables, gone, reason)
    kept = marked.where("NOT coalesce(with_clips, false)").withColumn("race_id", F.when(C("with_clips").isNull(), C("race_id"))).select(clips.columns)
    return races.join(ids.select("race_id"), "race_id", "left_anti"), kept, left, receipts


def stamp(seconds: Column, dot: str) -> Column:
    """HH:MM:SS and cut (not rounded) thousandths."""
    whole = F.floor(seconds)
    ms = F.floor((seconds - whole) * 1000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.floor(whole / 3600)), F.lit(":"), two(F.floor(whole / 60) % 60), F.lit(":"), two(whole % 60), F.lit(dot), F.lpad(ms.cast("string"), 3, "0"))


def lines_of(rows: DataFrame, line: Column, between: str, order: str = "idx") -> DataFrame:
    """clip_id, body: a clip's lines in order."""
    made = rows.withColumn("_line", line).groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct(order, "_line"))).alias("_l"))
    return made.select("clip_id", F.array_join(F.transform("_l", lambda x: x["_line"]), between).alias("body"))


def to_srt(u: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("clip_id").orderBy("idx")).cast("string")
    line = F.concat(C("_n"), F.lit("\n"), stamp(C("start_s"), ","), F.lit(" --> "), stamp(C("end_s"), ","), F.lit("\n"), "local_label", F.lit(": "), "text", F.lit("\n"))
    return lines_of(u.withColumn("_n", number), line, "\n")


def to_vtt(u: DataFrame) -> DataFrame:
    line = F.concat(stamp(C("start_s"), "."), F.lit(" --> "), stamp(C("end_s"), "."), F.lit("\n<v "), "local_label", F.lit(">"), "text", F.lit("\n"))
    body = lines_of(u, line, "\n")
    return body.withColumn("body", F.concat(F.lit("WEBVTT\n\n"), "body"))


def to_txt(u: DataFrame) -> DataFrame:
    return lines_of(u, F.concat_ws(": ", "local_label", "text"), "\n")


def to_rttm(turns: DataFrame) -> DataFrame:
    line = F.concat(F.lit("SPEAKER "), C("clip_id").cast("string"), F.lit(" 1 "), F.format_string("%.3f", "start_s"), F.lit(" "), F.format_string("%.3f", C("end_s") - C("start_s")), F.lit(" <NA> <NA> "), F.replace(C("label"), F.lit(" "), F.lit("_")), F.lit(" <NA> <NA>"))
    return lines_of(turns, line, "\n", "turn_id")


def write_text(bodies: DataFrame, folder: str) -> None:
    """One folder of text files per clip."""
    bodies.select("body", "clip_id").write.mode("overwrite").partitionBy("clip_id").text(folder)


def nested_documents(clips: DataFrame, utterances: DataFrame, speakers: DataFrame, warnings: DataFrame) -> DataFrame:
    """clip_id, doc: a clip with its quality, warnings, speakers by label and utterances as JSON; each child gathered by itself."""
    u = utterances.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("idx", "local_label", "text", "mood"))).alias("utterances"))
    facts = F.struct("profile_id", "cluster_id", "match_result", "speech_s", "reliability")
    s = speakers.groupBy("clip_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(C("local_label").cast("string").alias("k"), facts.alias("v"))))).alias("speakers"))
    rows = clips.join(u, "clip_id", "left").join(s, "clip_id", "left").join(warnings.select("clip_id", "warnings"), "clip_id", "left")
    return rows.select("clip_id", F.to_json(F.struct("clip_id", "status", "language", F.struct("grade", "duration_s").alias("quality"), "warnings", "speakers", "utterances")).alias("doc"))


def clip_results(clips: DataFrame, regions: DataFrame, turns: DataFrame, transcripts: DataFrame, utterances: DataFrame, words: DataFrame, speakers: DataFrame, profiles: DataFrame, runs: DataFrame) -> DataFrame:
    """A row per clip with all that was made of it: clip, quality, regions, turns, latest transcript, utterances, words, named speakers, latest run decoded.

    Each child is gathered by clip before it is joined, so nothing fans out; embeddings stay behind.
    """

    def of(rows: DataFrame, name: str, *cols: str) -> DataFrame:
        return rows.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    newest = lambda rows, at, *cols: rows.groupBy("clip_id").agg(*(F.max_by(c, F.struct(*at)).alias(c) for c in cols))
    named = speakers.join(profiles.select("profile_id", "name"), "profile_id", "left")
    run = newest(runs, ["at", "run_id"], "run_id", "outcome", "timings").select("clip_id", F.struct("run_id", "outcome", F.from_json("timings", "map<string,double>").alias("timings")).alias("run"))
    parts = [
        of(regions, "regions", "start_s", "end_s"), of(turns, "turns", "start_s", "turn_id", "label", "end_s"), newest(transcripts, ["version"], "transcript"), of(utterances, "utterances", "idx", "local_label", "text"),
        of(words, "words", "start_s", "word_id", "word"), of(named, "speakers", "local_label", "profile_id", "name", "match_result", "speech_s"), run,
    ]
    out = clips.select("clip_id", "status", F.struct("grade", "duration_s").alias("quality"))
    for part in parts:
        out = out.join(part, "clip_id", "left")
    return out


# L: tables around a model that judges lines


def prompt_batches(lines: DataFrame, keys: list[str], n: int, header: str) -> DataFrame:
    """keys, batch, prompt, n_lines: lines in order, n to a batch, numbered, with single blanks."""
    order = Window.partitionBy(*keys).orderBy("idx")
    rows = lines.withColumn("_i", F.row_number().over(order) - 1).withColumns({"batch": F.floor(C("_i") / n), "_no": C("_i") % n + 1})
    line = F.concat(C("_no").cast("string"), F.lit(". "), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    made = rows.withColumn("_line", line).groupBy(*keys, "batch").agg(F.sort_array(F.collect_list(F.struct("_no", "_line"))).alias("_l"))
    return made.select(*keys, "batch", F.concat(F.lit(f"{header}\n\nLines:\n"), F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")).alias("prompt"), F.size("_l").alias("n_lines"))


def parse_verdicts(replies: DataFrame, types: list[str], p: Params = DEFAULTS) -> DataFrame:
    """batch_id, n, event, confidence, other_car, why: what a reply's outermost array says and may be used.

    Unknown events, places outside the batch and low confidence are left out; an unreadable reply gives nothing.
    """
    schema = "array<struct<n:string,event:string,confidence:string,other_car:string,why:string>>"
    parsed = F.from_json(F.regexp_extract("reply", r"(?s)\[.*\]", 0), schema, {"mode": "PERMISSIVE"})
    rows = replies.select("batch_id", "batch_size", F.explode(parsed).alias("v")).select("batch_id", "batch_size", "v.*")
    rows = rows.withColumns({"n": F.expr("try_cast(n AS int)"), "confidence": F.expr("try_cast(coalesce(confidence, '0') AS double)"), "event": F.trim("event")})
    good = rows.where(C("event").isin(*types) & C("n").between(1, C("batch_size")) & (C("confidence") >= p.verdict_confidence))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return good.select("batch_id", "n", "event", "confidence", text("other_car").alias("other_car"), F.substring(text("why"), 1, 200).alias("why"))


def store_verdicts(verdicts: DataFrame, aliases: DataFrame, sessions: DataFrame, drivers: DataFrame, events: DataFrame, source: str) -> DataFrame:
    """events (speech_id, event_type, source, score, target) with the verdicts in place of the source's.

    verdicts: speech_id, text, event, confidence, other_car. The target is the only driver that the other car and the text
    name together, in the session of the speech (sessions: speech_id, session_key).
    """
    from .joins import mentions, session_drivers, target_driver

    said = verdicts.select("speech_id", F.concat_ws(" ", "other_car", "text").alias("text")).groupBy("speech_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set("text"))).alias("text"))
    targets = target_driver(session_drivers(mentions(said, aliases), sessions, drivers))
    new = verdicts.join(targets, "speech_id", "left").select("speech_id", C("event").alias("event_type"), F.lit(source).alias("source"), C("confidence").alias("score"), "target")
    return replace_source(events.select(new.columns), new, source)


# H: chains of hashes


def chain(events: DataFrame, seed: str = "start") -> DataFrame:
    """Events with prev_hash and row_hash, chained per actor by seq. A hash needs the one before: a fold."""
    body = F.concat_ws("|", C("at_s").cast("string"), C("actor").cast("string"), "action", "object", "before", "after")

    def step(state: tuple, x) -> tuple[tuple, tuple]:
        made = hashlib.sha256(f"{state[0]}|{x.body}".encode()).hexdigest()
        return (made,), (state[0], made)

    rows = events.withColumn("body", body)
    return fold_rows(rows, ["actor"], ["seq"], step, (seed,), [c for c in events.columns if c != "actor"], "prev_hash string, row_hash string").select(*events.columns, "prev_hash", "row_hash")


def verify_chain(log: DataFrame, seed: str = "start") -> DataFrame:
    """actor, n, first_break: the first seq whose link or own hash is wrong; null where all hold."""
    w = Window.partitionBy("actor").orderBy("seq")
    body = F.concat_ws("|", C("prev_hash"), C("at_s").cast("string"), C("actor").cast("string"), "action", "object", "before", "after")
    ok = (C("prev_hash") == F.coalesce(F.lag("row_hash").over(w), F.lit(seed))) & (C("row_hash") == F.sha2(body, 256))
    return log.withColumn("_ok", ok).groupBy("actor").agg(F.count("*").alias("n"), F.min(F.when(~C("_ok"), C("seq"))).alias("first_break"))
