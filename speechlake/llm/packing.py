"""Best-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import collections
import math
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS_OF_A_TASK, checkpointed, hash52, running_before, shared_folder, sized
from .tokens import batches, encoder


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids with end_id, cut if over capacity.

    Only longer documents are cut, into pieces of capacity ids; the first piece takes what is over. Null
    text is empty and gives one piece with end_id alone. Repeated rows are documents of their own.
    """
    ending = struct.pack("<I", end_id)

    def cut(rows):
        for pdf in rows:
            for first, texts in batches(pdf["text"].tolist(), 8_000_000):
                made = []
                for doc_id, ids in zip(pdf["doc_id"].iloc[first : first + len(texts)].tolist(), encoder(tokenizer).encode(texts)):
                    ids += ending
                    n = len(ids) // 4
                    ends = [n] if n <= capacity else range((n - 1) % capacity + 1, n + 1, capacity)
                    at = 0
                    for i, end in enumerate(ends):
                        own = ids[at * 4 : end * 4]
                        made.append((None if pd.isna(doc_id) else int(doc_id), i, at, end - at, zlib.crc32(own), *([list(struct.unpack(f"<{end - at}I", own))] if with_ids else [])))
                        at = end
                out = pd.DataFrame(made, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def bands(capacity: int) -> list[tuple[int, int]]:
    """(low, high]: the lengths of each superstep, from long to short: those of which 1, 2, 3 or 4 fill a sequence, then 5 to 9, 10 to 19, ..."""
    out, k = [], 1
    while k <= capacity:
        last = k if k < 5 else 2 * k - 1
        out.append((capacity // (last + 1), capacity // k))
        k = last + 1
    return [(low, high) for low, high in out if low < high]


def heights(slots: dict[int, int], docs: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """size -> (height before its slots, height after them, documents of that length that find a slot).

    A sweep goes from large sizes to small ones; slots are put on a pile, and each document takes the topmost, which is
    the smallest slot that fits it. So a slot and the document that takes it lie at the same height.
    """
    out, height = {}, 0
    for size in sorted({*slots, *docs}, reverse=True):
        top = height + slots.get(size, 0)
        taken = min(docs.get(size, 0), top)
        out[size] = (height, top, taken)
        height = top - taken
    return out


class Sequences:
    """The state between supersteps: what is placed, in tables in the shared folder, and the gaps of open sequences.

    Documents of a length are told apart by their rank; those with the smallest ranks are placed first, so a length's
    state is how many are. To the driver come counts per size, at most one per token of the capacity.
    """

    def __init__(self, docs: DataFrame, counts: dict[int, int], capacity: int):
        self.docs, self.counts, self.capacity = docs, counts, capacity
        self.spark = docs.sparkSession
        self.folder = shared_folder(self.spark, "packing")
        self.done = dict.fromkeys(counts, 0)
        self.opened = self.step = 0
        self.gaps, self.sizes = None, {}

    def left(self, low: int, high: int) -> dict[int, int]:
        return {n: c - self.done[n] for n, c in self.counts.items() if low < n <= high and c > self.done[n]}

    def read(self, docs: dict[int, int]) -> int:
        """Documents of these lengths, placed ones too: so many rows a superstep reads."""
        return sum(self.counts[n] for n in docs)

    def table(self, rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(rows, schema))  # a row per size

    def place(self, placed: DataFrame, n: int) -> None:
        """Writes the n rows that a superstep placed (length, rank, sequence, gap before, offset) and the gaps after it."""
        self.step += 1
        at = f"{self.folder}/placed/step={self.step}"
        sized(placed.select("length", "rank", "sequence", "gap", "offset"), n).write.parquet(at)
        used = sized(self.spark.read.schema("length long, rank long, sequence long, gap long, offset long").parquet(at), n).groupBy("sequence").agg(F.sum("length").alias("used"), F.first("gap").alias("gap"))
        least = min((n for n, c in self.counts.items() if c > self.done[n]), default=self.capacity + 1)
        if self.gaps is None:
            now = used.select("sequence", (F.col("gap") - F.col("used")).alias("gap"))
        else:
            now = self.gaps.join(used.drop("gap"), "sequence", "full").select("sequence", (F.coalesce("gap", F.lit(self.capacity)) - F.coalesce("used", F.lit(0))).alias("gap"))
        path = f"{self.folder}/gaps-{self.step}"
        n += sum(self.sizes.values())
        sized(now.where(F.col("gap") >= least), n).write.parquet(path)
        self.gaps = sized(self.spark.read.schema("sequence long, gap long").parquet(path), n)
        self.sizes = {r[0]: r[1] for r in self.gaps.groupBy("gap").count().collect()}

    def sweep(self, low: int, high: int) -> bool:
        """A superstep: the documents of a band to the gaps that fit them best, each gap seen as one or more slots; false if none fits.

        A gap gives a slot of its own size, then smaller ones that leave room for the longest document of the
        band in each before, so that whichever are taken, all fit.
        """
        docs = self.left(low, high)
        if not docs or not self.sizes:
            return False
        small, big = min(docs), max(docs)
        open_gaps = sum(c for g, c in self.sizes.items() if g >= small)
        most = 1 + 2 * sum(docs.values()) // max(open_gaps, 1)
        slots: collections.Counter = collections.Counter()
        for gap, c in self.sizes.items():
            for j in range(min(most, (gap - small) // big + 1) if gap >= small else 0):
                slots[gap - j * big] += c
        plan = heights(slots, docs)
        if not any(taken for _, _, taken in plan.values()):
            return False
        # a slot is taken if the pile later sinks below it
        sinks, later = {}, plan[min(plan)][1] + 1
        for size in sorted(plan):
            later = min(later, plan[size][1] - plan[size][2])
            sinks[size] = later
        rows = self.table([(k, a, b, n, sinks[k], self.done.get(k, 0)) for k, (a, b, n) in plan.items()], "size long, height long, top long, taken long, sinks long, done long")
        tries = F.least(F.lit(most), F.floor((F.col("gap") - small) / big) + 1)
        n, found = sum(slots.values()), sum(taken for _, _, taken in plan.values())
        offered = sized(self.gaps, max(n, sum(self.sizes.values()))).where(F.col("gap") >= small).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), tries - 1))).withColumn("size", F.col("gap") - F.col("j") * big)
        wide = max(1, math.isqrt(n))
        offered = offered.withColumns({"bucket": F.pmod(F.xxhash64("sequence"), F.lit(wide)), "one": F.lit(1)})
        offered = running_before(offered, ["size"], "bucket", ["sequence", "j"], {"nth": "one"}).join(rows, "size").withColumn("level", F.col("height") + F.col("nth") + 1)
        free = offered.where(F.col("level") > F.col("sinks")).select("level", "size", F.lit(0).alias("kind"), F.struct("sequence", "gap", "j").alias("slot"), F.lit(None).cast("long").alias("rank"))
        mine = sized(self.docs, self.read(docs)).where(F.col("length").between(small, big)).join(rows, F.col("length") == F.col("size")).where((F.col("rank") >= F.col("done")) & (F.col("rank") < F.col("done") + F.col("taken")))
        mine = mine.select((F.col("top") - (F.col("rank") - F.col("done"))).alias("level"), "size", F.lit(1).alias("kind"), F.lit(None).cast("struct<sequence:bigint,gap:bigint,j:bigint>").alias("slot"), "rank")
        # at a height there are a slot and a document of any size at most
        pile = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
        met = sized(free.unionByName(mine), max(n, sum(self.sizes.values())) + self.read(docs)).withColumn("slot", F.lag("slot").over(pile)).where("kind = 1").select(F.col("size").alias("length"), "rank", "slot.*")
        within = Window.partitionBy("sequence").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
        placed = met.withColumn("offset", F.lit(self.capacity) - F.col("gap") + F.coalesce(F.sum("length").over(within), F.lit(0)))
        for size, (_, _, taken) in plan.items():
            if taken:
                self.done[size] += taken
        self.place(placed, found)
        return True

    def open(self, low: int, high: int) -> None:
        """New sequences for the documents of a band that no gap fits: in order of length, as many to each as surely fit."""
        docs = self.left(low, high)
        if not docs:
            return
        rows, base, of = [], {}, {}
        for size in sorted(docs, reverse=True):
            k = self.capacity // size
            if k not in of:
                of[k] = self.opened
                self.opened += -(-sum(c for x, c in docs.items() if self.capacity // x == k) // k)
            rows.append((size, k, of[k], base.get(k, 0), self.done[size]))
            base[k] = base.get(k, 0) + docs[size]
        plan = self.table(rows, "size long, k long, first long, base long, done long")
        nth = F.col("base") + F.col("rank") - F.col("done")
        n = sum(docs.values())
        mine = sized(self.docs, self.read(docs)).where(F.col("length").between(min(docs), max(docs))).join(plan, F.col("length") == F.col("size")).where("rank >= done").select("length", "rank", (F.col("first") + F.floor(nth / F.col("k"))).alias("sequence"), (nth % F.col("k")).alias("j"), F.lit(self.capacity).cast("long").alias("gap"))
        within = Window.partitionBy("sequence").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
        placed = mine.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
        for size in docs:
            self.done[size] = self.counts[size]
        self.place(placed, n)

    def placed(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/placed") if self.step else self.spark.createDataFrame([], "length long, rank long, sequence long, offset long")
        return rows.select("length", F.col("rank").alias("_rank"), F.col("sequence").alias("sequence_id"), "offset")


def pack(rows: DataFrame, capacity: int, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """rows (with length from 1 to capacity) with sequence_id and offset: best fit in supersteps, longest first.

    Each superstep takes the documents of a band of lengths. They and the gaps of the open sequences, in order of size
    and rank, meet in a successor sweep: every document takes the smallest gap that fits it and that no longer one has
    taken. Gaps become smaller and the sweep is repeated until it places nothing; what is left opens sequences. The
    number of supersteps goes with the logarithm of capacity. Ranks come from sums by length and hash bucket, so
    that a length which a third of all rows share is spread over many tasks.

    rows should be narrow and cheap to read twice (checkpointed). Equal rows are packed each; an empty table stays
    empty. Columns named sequence_id or offset are replaced; names that start with an underscore are reserved.
    """
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    n = sum(counts.values())
    keyed = rows.drop("sequence_id", "offset").withColumns({"_hash": hash52(*(F.col(c) for c in order)), "_one": F.lit(1)})
    keyed = keyed.withColumn("_bucket", F.col("_hash") % max(1, n // max(256, math.isqrt(n))))
    ranked = checkpointed(running_before(keyed, ["length"], "_bucket", ["_hash", *order], {"_rank": "_one"}).drop("_hash", "_one", "_bucket"))
    # range-sorted by length, in few files: a superstep reads its band only
    folder = shared_folder(rows.sparkSession, "packing-docs")
    narrow = ranked.select(F.col("length").cast("long").alias("length"), F.col("_rank").cast("long").alias("rank"))
    narrow.repartitionByRange(max(1, -(-n // ROWS_OF_A_TASK)), "length", "rank").sortWithinPartitions("length", "rank").write.parquet(folder)
    state = Sequences(rows.sparkSession.read.schema("length long, rank long").parquet(folder), counts, capacity)
    for low, high in bands(capacity):
        while state.sweep(low, high):
            pass
        state.open(low, high)
    return ranked.join(state.placed(), ["length", "_rank"]).select(*(c for c in rows.columns if c not in ("sequence_id", "offset")), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> sequence_id, ids (each at most capacity long), lengths of the pieces in turn."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    made = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return made.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: F.size(p["ids"])).alias("lengths"))


def packed_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """The pieces of docs (doc_id, text; other columns are not read) with their sequences and places.

    Null and empty texts are a piece with the end alone; very long ones are cut; repeated rows are packed each.
    """
    import public_tokenizers

    rows = checkpointed(pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end_id, capacity))
    return pack(rows, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
