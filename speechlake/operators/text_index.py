"""An inverted index that is stored, grows by segments and is read by the terms that are asked."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import words

C = F.col
#: A block: a token, the numbers of the texts of a chunk that have it, ascending, and where they have it, text by text;
#: a text's last position p stands as -1 - p. A row without token has the ids of the chunk's texts by their numbers.
BLOCKS = "token string, chunk long, docs array<int>, positions array<int>, ids array<{kind}>"
FOUND = "speech_id {kind}, token string, positions array<int>"
#: Terms up to this number go into the scan as values, so that row groups without them are passed over.
MOST_VALUES = 200
#: Bytes of what is known of the texts of all chunks, up to which it is broadcast.
MOST_BYTES = 16_000_000
#: Words from which a chunk is full; a text counts as so many more, so that chunks of short texts stay small, too.
WORDS_OF_A_CHUNK, WORDS_OF_A_TEXT = 2_500_000, 100
#: Blocks of a batch that a task gives back.
BLOCKS_OF_A_BATCH = 50_000


def blocks_of(texts: pa.Table, chunk: int) -> pa.Table:
    """The blocks and ids of the texts (speech_id, words) of one chunk; a text's number is its row."""
    ids, lists = (texts[name].combine_chunks() for name in ("speech_id", "words"))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    docs = np.repeat(np.arange(len(lists), dtype=np.int32), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    said = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes]  # what stands before the first and after the last word is cut off empty
    codes, docs = codes[said], docs[said]
    starts = np.flatnonzero(np.diff(docs, prepend=-1))
    places = np.arange(len(docs), dtype=np.int32) - np.repeat(starts, np.diff(starts, append=len(docs))).astype(np.int32)
    order = np.argsort(codes, kind="stable")
    codes, docs, places = codes[order], docs[order], places[order]
    new = np.diff(codes, prepend=-1) != 0
    posting = np.flatnonzero(new | (np.diff(docs, prepend=-1) != 0))
    last = np.append(posting, len(docs))[1:] - 1
    places[last] = -1 - places[last]
    block = np.flatnonzero(new)
    # the row of the ids comes last
    lists_of = lambda values, at: pa.ListArray.from_arrays(pa.array(np.append(at, [len(values)] * 2).astype(np.int32)), pa.array(values))
    tokens = coded.dictionary.take(pa.array(np.append(codes[block], -1), mask=np.append(np.zeros(len(block), bool), True)))
    of_ids = pa.ListArray.from_arrays(pa.array([0] * (len(block) + 1) + [len(ids)], pa.int32(), mask=np.append(np.ones(len(block), bool), [False, False])), ids)
    columns = [tokens, pa.array(np.full(len(block) + 1, chunk, np.int64)), lists_of(docs[posting], np.flatnonzero(new[posting])), lists_of(places, block), of_ids]
    return pa.table(columns, names=["token", "chunk", "docs", "positions", "ids"])


def packed(batches: Iterator[pa.RecordBatch], most: int = WORDS_OF_A_CHUNK) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's texts (speech_id, words), which are put into chunks of about `most` words as they come."""
    chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

    def full():
        return blocks_of(pa.Table.from_batches(held), chunk).to_batches(max_chunksize=BLOCKS_OF_A_BATCH)

    for batch in batches:
        counts = np.cumsum(pc.fill_null(pc.list_value_length(batch["words"]), 0).to_numpy(zero_copy_only=False) + WORDS_OF_A_TEXT)
        at = 0
        while at < len(counts):
            # up to the text that fills the chunk
            before = counts[at - 1] if at else 0
            end = min(int(np.searchsorted(counts, before + most - size)) + 1, len(counts))
            held.append(batch.slice(at, end - at))
            size += int(counts[end - 1] - before)
            at = end
            if size >= most:
                yield from full()
                chunk, held, size = chunk + 1, [], 0
    if held:
        yield from full()


def part_of(positions: str, ends: str, i: Column) -> Column:
    """The places of a block's posting i, where ends has how many places there are up to the last of each posting."""
    start = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
    return F.slice(positions, start + 1, F.get(ends, i) - start)


class TextIndex:
    """Postings of speech below a folder, by the hash of the token and sorted by it in each file.

    A segment is a batch of speech, numbered upwards. Its speech takes the place of what earlier segments have of
    the same ids, whatever its text, so an empty or null text takes speech out. Segments count once they are noted,
    after their rows are there; one that is written again replaces itself. merge puts all of them into one; files of
    merged segments stay until somebody deletes them. Ids stand once in a batch and are not null.

    Texts are numbered within chunks of some million words, as they are read. A token's postings in a chunk are one
    row, its block, so that words and postings are not moved one by one. Each chunk has a row with the ids of its
    numbers; in a merged segment, those of replaced speech are null.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 32, kind: str = "long", most: int = WORDS_OF_A_CHUNK):
        self.spark, self.folder, self.parts, self.kind, self.most = spark, folder, parts, kind, most
        # the tables are there from the start, without rows
        for table, schema in (("notes", "covers int"), ("replaced", "speech_id {kind}, of int"), ("postings", BLOCKS)):
            at = f"{folder}/{table}/segment=-1" + ("/part=-1" if table == "postings" else "")
            spark.createDataFrame([], schema.format(kind=kind)).write.mode("ignore").parquet(at)

    def part(self, token):
        return F.pmod(F.xxhash64(token), F.lit(self.parts)).cast("int")

    def live(self, before: int | None = None) -> list[int]:
        """The numbers of the segments that count, or counted when only those before a number were there."""
        noted = self.spark.read.schema("covers int, segment int").parquet(f"{self.folder}/notes")
        rows = [r for r in noted.collect() if before is None or r.segment < before]  # one row per segment and one per merged segment
        return sorted({r.segment for r in rows} - {r.covers for r in rows if r.covers is not None})

    def table(self, name: str, schema: str, live: list[int]) -> DataFrame:
        return self.spark.read.schema(f"{schema}, segment int").parquet(f"{self.folder}/{name}").where(C("segment").isin(live))

    def append(self, segment: int, speech: DataFrame) -> None:
        """Adds speech (speech_id, text) as a segment; what it replaces of the segments before it is noted with it."""
        speech = speech.select(C("speech_id").cast(self.kind), "text")
        made = speech.select("speech_id", words().alias("words")).mapInArrow(partial(packed, most=self.most), BLOCKS.format(kind=self.kind))
        known = self.numbers(self.live(segment)).join(speech.select("speech_id"), "speech_id", "left_semi")
        self.write(segment, made, known.select("speech_id", C("segment").alias("of")), [])

    def merge(self, segment: int) -> None:
        """Puts all segments before this number into one; what was replaced is gone from it.

        Chunks stay as they are and follow those of the segment before; blocks lose the numbers of replaced speech.
        """
        live = self.live(segment)
        first, at = F.lit(0), 0
        for number, chunk in sorted(self.rows(live).where("part = -1").groupBy("segment").agg(F.max("chunk")).collect()):  # one row per segment
            first, at = F.when(C("segment") == number, at).otherwise(first), at + chunk + 1
        speech = self.present(live)
        gone = self.of_chunk(speech, C("speech_id").isNull(), "gone", 1).where(F.exists("gone", lambda x: x))
        rows = self.rows(live).where("part >= 0").join(gone, ["segment", "chunk"], "left")
        ends = F.filter(F.sequence(F.lit(1), F.size("positions")), lambda i: F.get("positions", i - 1) < 0)
        stay = F.filter(F.sequence(F.lit(0), F.size("docs") - 1), lambda i: ~F.get("gone", F.get("docs", i)))
        rows = rows.withColumns({"ends": F.when(C("gone").isNotNull(), ends), "stay": F.when(C("gone").isNotNull(), stay)}).where("stay IS NULL OR size(stay) > 0")
        some = "stay IS NOT NULL AND size(stay) < size(docs)"
        left = {
            "docs": F.when(F.expr(some), F.transform("stay", lambda i: F.get("docs", i))).otherwise(C("docs")),
            "positions": F.when(F.expr(some), F.flatten(F.transform("stay", lambda i: part_of("positions", "ends", i)))).otherwise(C("positions")),
        }
        blocks = rows.withColumns(left).withColumn("ids", F.lit(None).cast(f"array<{self.kind}>"))
        ids = self.of_chunk(speech, C("speech_id"), "ids", 8).withColumns({"token": F.lit(None).cast("string"), "docs": F.array().cast("array<int>"), "positions": F.array().cast("array<int>")})
        both = (df.select("token", (first + C("chunk")).alias("chunk"), "docs", "positions", "ids") for df in (blocks, ids))
        self.write(segment, next(both).unionByName(next(both)), self.spark.createDataFrame([], f"speech_id {self.kind}, of int"), live)

    def write(self, segment: int, rows: DataFrame, replaced: DataFrame, covers: list[int]) -> None:
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.folder}/{name}/segment={segment}")
        made = rows.withColumn("part", F.when(C("token").isNull(), -1).otherwise(self.part("token"))).hint("rebalance", "part")
        made.sortWithinPartitions("part", "token").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/postings/segment={segment}")
        put(replaced, "replaced")
        put(self.spark.createDataFrame([(c,) for c in covers or [None]], "covers int").coalesce(1), "notes")

    def rows(self, live: list[int]) -> DataFrame:
        """Blocks, and, in part -1, ids."""
        return self.table("postings", f"{BLOCKS.format(kind=self.kind)}, part int", live)

    def numbers(self, live: list[int]) -> DataFrame:
        """segment, chunk, doc, speech_id."""
        return self.rows(live).where("part = -1").select("segment", "chunk", F.posexplode("ids").alias("doc", "speech_id"))

    def present(self, live: list[int]) -> DataFrame:
        """numbers; the id is null where a later segment has replaced the speech."""
        speech = self.numbers(live)
        if len(live) > 1:
            replaced = self.table("replaced", f"speech_id {self.kind}, of int", live).select("speech_id", C("of").alias("segment"), F.lit(True).alias("old")).distinct()
            speech = speech.join(replaced, ["speech_id", "segment"], "left").withColumn("speech_id", F.when(C("old").isNull(), C("speech_id")))
        return speech.select("segment", "chunk", "doc", "speech_id")

    def of_chunk(self, speech: DataFrame, what: Column, name: str, width: int) -> DataFrame:
        """segment, chunk and an array of what is known of each number, in their order; width: its bytes, as it is broadcast only if it was counted to be small."""
        rows = speech.groupBy("segment", "chunk").agg(F.sort_array(F.collect_list(F.struct("doc", what.alias("what"))))["what"].alias(name))
        return F.broadcast(rows) if speech.count() * width <= MOST_BYTES else rows.hint("merge")

    def lookup(self, terms: DataFrame) -> DataFrame:
        """speech_id, token, positions of the terms (term), as retrieval.postings gives them; files of other parts are not read."""
        live = self.live()
        asked = terms.select(C("term").alias("token")).where("token IS NOT NULL").distinct()
        parts = [r[0] for r in asked.select(self.part("token")).distinct().collect()]  # at most self.parts
        if not live or not parts:
            return self.spark.createDataFrame([], FOUND.format(kind=self.kind))
        rows = self.rows(live).where(C("part").isin(parts))
        few = [r[0] for r in asked.limit(MOST_VALUES + 1).collect()]
        if len(few) <= MOST_VALUES:
            rows = rows.where(C("token").isin(few))
        else:
            rows = rows.join(F.broadcast(asked) if asked.limit(10_001).count() <= 10_000 else asked, "token", "left_semi")
        ids = self.of_chunk(self.present(live), C("speech_id"), "ids", 8)
        rows = rows.drop("ids").join(ids, ["segment", "chunk"]).withColumn("ends", F.filter(F.sequence(F.lit(1), F.size("positions")), lambda i: F.get("positions", i - 1) < 0))
        plain = lambda i: F.transform(part_of("positions", "ends", i), lambda p: F.greatest(p, -1 - p))
        named = F.transform("docs", lambda doc, i: F.struct(F.get("ids", doc).alias("speech_id"), plain(i).alias("positions")))
        return rows.select("token", F.inline(named)).where("speech_id IS NOT NULL").select("speech_id", "token", "positions")
