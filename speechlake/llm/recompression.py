"""Passages that repeat across documents, found by recompression: rounds that name runs and pairs of words."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder
from .shingles import BASE, PLACES, U, mix, word_hashes
from .tokens import batches

#: Words of a window.
WINDOW = 50
#: Rounds of recompression (each leaves about three quarters of the symbols), and those that also name runs.
ROUNDS, RUN_ROUNDS = 7, (0, 4)
#: Bytes of text that are parsed at once, if no single text is longer.
PART_BYTES = 2_000_000
#: Where a symbol's context ends if it reaches beyond its text.
OUT = np.int64(1) << 40


@dataclass
class Symbols:
    """Symbols of texts laid end to end, with a mark between any two texts.

    low and high bound a symbol's context: the words that decide where it begins and ends. Wherever the same words
    stand, in whatever text, the same symbol stands among them. `mark` tells the marks, which no text shares.
    """

    name: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mark: np.ndarray

    @classmethod
    def of_words(cls, words: np.ndarray, firsts: np.ndarray) -> Symbols:
        """A symbol for each word; firsts: numbers of the words with which texts begin."""
        at, n = np.append(firsts, len(words)), np.arange(len(words))
        name, low, high = np.insert(words, at, U(0)), np.insert(n, at, -OUT), np.insert(n + 1, at, OUT)
        mark = np.zeros(len(name), bool)
        mark[at + np.arange(len(at))] = True
        name[mark] = np.arange(mark.sum(), dtype=U)  # no two beside each other are equal; never named further
        return cls(name, low, high, mark)

    def with_runs(self) -> Symbols:
        """Each run of one symbol becomes a symbol, named by what is repeated and how often.

        Where a run ends is known only with both of its neighbours, so the context takes them in.
        """
        at = np.flatnonzero(np.append(True, (self.name[1:] != self.name[:-1]) | self.mark[1:] | self.mark[:-1]))
        times = np.diff(np.append(at, len(self.name)))
        last = at + times - 1
        with np.errstate(over="ignore"):
            name = np.where(times > 1, mix(self.name[at] * U(PLACES[2]) + times.astype(U)), self.name[at])
        low = np.minimum(self.low[at], self.low[np.maximum(at - 1, 0)])
        high = np.maximum(self.high[last], self.high[np.minimum(last + 1, len(self.name) - 1)])
        return Symbols(name, low, high, self.mark[at])

    def with_pairs(self, turn: int) -> Symbols:
        """Each left symbol before a right one becomes, with it, a symbol, named by both. A hash of name and round tells sides.

        The two decide this by themselves. A symbol that stays alone does so because of its neighbour on its own side.
        """
        n = len(self.name)
        is_left = (mix(self.name ^ U(PLACES[3] + turn)) & U(1)).astype(bool) & ~self.mark
        is_right = ~is_left & ~self.mark
        first = np.append(is_left[:-1] & is_right[1:], False)
        second = np.append(False, first[:-1])
        name, low, high = self.name.copy(), self.low.copy(), self.high.copy()
        i = np.flatnonzero(first)
        with np.errstate(over="ignore"):
            name[i] = mix(self.name[i] * U(PLACES[0]) + self.name[i + 1] * U(PLACES[1]) + U(turn))
        i = np.flatnonzero(is_left)  # a pair's second, or what keeps it from being one
        low[i], high[i] = np.minimum(self.low[i], self.low[np.minimum(i + 1, n - 1)]), np.maximum(self.high[i], self.high[np.minimum(i + 1, n - 1)])
        i = np.flatnonzero(is_right & ~second)
        low[i], high[i] = np.minimum(self.low[i], self.low[i - 1]), np.maximum(self.high[i], self.high[i - 1])
        low[self.mark], high[self.mark] = -OUT, OUT
        stays = ~second
        return Symbols(name[stays], low[stays], high[stays], self.mark[stays])


def recompressed(words: np.ndarray, firsts: np.ndarray, window: int = WINDOW) -> Symbols:
    """The symbols after all rounds whose context fits into a window."""
    now = Symbols.of_words(words, firsts)
    for turn in range(ROUNDS):
        if turn in RUN_ROUNDS:
            now = now.with_runs()
        now = now.with_pairs(turn)
    fits = ~now.mark & (now.low >= 0) & (now.high <= len(words)) & (now.high - now.low <= window)
    return Symbols(now.name[fits], now.low[fits], now.high[fits], now.mark[fits])


def held(symbols: Symbols, n: int, window: int) -> np.ndarray:
    """How many of the symbols' contexts lie within the window that begins at each of n words."""
    change = np.bincount(np.maximum(symbols.high - window, 0), minlength=n + 1) - np.bincount(symbols.low + 1, minlength=n + 1)
    return np.cumsum(change)[:n]


def sums_of(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the windows that begin at each word with enough words after it: a long and an int, of two polynomials."""
    n = max(0, len(words) - window + 1)
    out = []
    with np.errstate(over="ignore"):
        for i, base in enumerate((BASE, PLACES[4])):
            powers, inverse = np.full(len(words), base, U), np.full(len(words), pow(base, -1, 1 << 64), U)
            powers[:1] = inverse[:1] = 1
            np.cumprod(powers, out=powers)
            np.cumprod(inverse, out=inverse)
            sums = np.append(U(0), np.cumsum((mix(words ^ U(PLACES[3])) if i else words) * powers))
            out.append(mix((sums[window:] - sums[: n + window][: len(sums) - window]) * inverse[:n]) if n else np.zeros(0, U))
    return out[0].view(np.int64), (out[1] >> U(32)).astype(np.uint32).view(np.int32)


class Parts:
    """Texts of a part: their words, the numbers of their first words, and which words begin a window."""

    def __init__(self, texts: list[str], window: int):
        self.texts, self.window = texts, window
        self.owner, self.words, _ = word_hashes(texts)
        self.counts = np.bincount(self.owner, minlength=len(texts))
        self.firsts = np.cumsum(self.counts) - self.counts
        self.begins = np.arange(len(self.words)) + window <= (self.firsts + self.counts)[self.owner]

    def range_of(self, i: int) -> slice:
        return slice(self.firsts[i], self.firsts[i] + self.counts[i])

    def words_of(self, i: int) -> list[bytes]:
        return self.texts[i].encode("utf-8", "surrogatepass").split()

    def symbols(self) -> Symbols:
        return recompressed(self.words, self.firsts[self.counts > 0], self.window)


def signed(numbers: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(numbers).view(np.int64)


def parsed_texts(window: int):
    """For mapInArrow: id, text_key, text -> words, hash of all words joined, name of the whole, names of its symbols, blind.

    A text is blind if one of its windows holds no symbol, so that names alone can't rule the window out.
    """

    def work(rows):
        for batch in rows:
            for first, texts in batches(batch.column("text").to_pylist(), PART_BYTES):
                part = Parts(texts, window)
                symbols = part.symbols()
                owner = part.owner[symbols.low]
                blind = np.bincount(part.owner[part.begins & (held(symbols, len(part.words), window) == 0)], minlength=len(texts)) > 0
                order = np.lexsort((symbols.name, owner))
                owner, name = owner[order], symbols.name[order]
                new = np.append(True, (owner[1:] != owner[:-1]) | (name[1:] != name[:-1]))[: len(name)]
                owner, name = owner[new], signed(name[new])
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                whole = [b" ".join(part.words_of(i)) for i in range(len(texts))]
                n = len(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[first : first + n], batch.column("text_key")[first : first + n], pa.array(part.counts, pa.int64()),
                    pa.array([hashlib.sha256(w).hexdigest() for w in whole]), pa.array([hashlib.blake2b(w, digest_size=16).digest() for w in whole], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(name, pa.int64())), pa.array(blind),
                ], ["doc_id", "text_key", "n_words", "kept_sha256", "whole", "names", "blind"])

    return work


def windows_to_verify(window: int):
    """For mapInArrow: doc_id, whole, text, late, early -> digests of the windows that may be late, and of those only early.

    late and early hold the names of the text's symbols that also stand in a document before, or after, this one. A
    window's words can stand in one before it only if all names within it do. The text goes on only with the first.
    """

    def work(rows):
        for batch in rows:
            late, early = (batch.column(c).to_pylist() for c in ("late", "early"))
            for first, texts in batches(batch.column("text").to_pylist(), PART_BYTES):
                part, n = Parts(texts, window), len(texts)
                symbols, total = part.symbols(), len(part.words)
                owner = part.owner[symbols.low]
                ends = np.searchsorted(owner, np.arange(n + 1))
                may = []
                for lists in (late, early):
                    apart = np.ones(len(owner), bool)
                    for i in range(n):
                        if lists[first + i]:
                            apart[ends[i] : ends[i + 1]] = ~np.isin(signed(symbols.name[ends[i] : ends[i + 1]]), np.array(lists[first + i], np.int64))
                    missing = Symbols(symbols.name[apart], symbols.low[apart], symbols.high[apart], symbols.mark[apart])
                    may.append(part.begins & (held(missing, total, window) == 0))
                a, b = sums_of(part.words, window)
                some = np.bincount(part.owner[may[0]], minlength=n) > 0
                columns = [batch.column("doc_id")[first : first + n], batch.column("whole")[first : first + n], pa.array([t if s else None for t, s in zip(texts, some)], pa.string())]
                for at in (np.flatnonzero(may[0]), np.flatnonzero(may[1] & ~may[0])):
                    order = np.lexsort((b[at], a[at], part.owner[at]))
                    at = at[order]
                    new = np.append(True, (a[at][1:] != a[at][:-1]) | (b[at][1:] != b[at][:-1]) | (part.owner[at][1:] != part.owner[at][:-1]))[: len(at)]
                    at = at[new]
                    offsets = pa.array(np.searchsorted(part.owner[at], np.arange(n + 1)), pa.int32())
                    columns += [pa.ListArray.from_arrays(offsets, pa.array(a[at])), pa.ListArray.from_arrays(offsets, pa.array(b[at]))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "whole", "text", "late_a", "late_b", "early_a", "early_b"])

    return work


def covered(begins: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that begins at one of the marked words."""
    change = np.append(begins, False).astype(np.int64)
    change[window:] -= begins[: max(0, len(begins) + 1 - window)]
    return np.cumsum(change)[: len(begins)] > 0


def without_repeats(window: int, with_text: bool):
    """For mapInArrow: doc_id, whole, text, a, b (digests of windows to remove) -> what is left of the text."""

    def work(rows):
        for batch in rows:
            gone = [batch.column(c).to_pylist() for c in ("a", "b")]
            for first, texts in batches(batch.column("text").to_pylist(), PART_BYTES):
                part, removed, kept = Parts(texts, window), [], []
                for i in range(len(texts)):
                    a, b = sums_of(part.words[part.range_of(i)], window)
                    ga, gb = (np.array(g[first + i], k) for g, k in zip(gone, (np.int64, np.int32)))
                    order = np.lexsort((gb, ga))
                    ga, gb = ga[order], gb[order]
                    at = np.minimum(np.searchsorted(ga, a), len(ga) - 1)
                    off = covered(np.append((ga[at] == a) & (gb[at] == b), np.zeros(window - 1, bool)), window)
                    removed.append(int(off.sum()))
                    kept.append(b" ".join(compress(part.words_of(i), (~off).tolist())))
                n = len(texts)
                columns = [batch.column("doc_id")[first : first + n], batch.column("whole")[first : first + n], pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                if with_text:
                    columns.append(pa.array([k.decode("utf-8", "replace") for k in kept]))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "whole", "removed", "left_sha256", "kept_text"][: len(columns)])

    return work


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a table in the shared folder."""
    spark, schema = df.sparkSession, df.schema
    folder = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def drop_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, text -> doc_id, n_words, n_removed, kept_sha256, and with_text what is left of changed texts (kept_text).

    A word goes if it lies in a window of so many consecutive words whose words also follow each other in a document
    with a smaller doc_id, judged on the whole input. Words are runs other than 0x20 and 0x09-0x0D.

    1. Every text is recompressed. Names are digests of what they stand for, so that they agree everywhere without
       an exchange: equal passages hold the same symbols, apart from some at their ends. The last name of all stands
       for the whole text; a text whose whole stands in a document before goes as a whole and takes no further part.
    2. Names meet across all documents with the smallest and the largest doc_id that they stand in; a window all of
       whose names are shared in one direction is a candidate (and any window without a name of its own, as in runs).
    3. Candidates are verified by digests of all their words (96 bits), counted with the smallest doc_id over all
       documents; those found in a smaller one are removed.

    So nothing is lost to the rounds' choices: names only spare windows from step 3. Names and digests are
    pre-aggregated to one row each before documents meet them, so common ones come back by a plain join whose large
    side can be split.

    Null and empty texts have no words; texts shorter than a window stay; a null doc_id comes before and after none,
    so its text stays and removes nothing; rows of one doc_id don't remove each other's words; equal rows have equal
    results, one each; an empty table gives none. Other columns aren't used. A task holds about PART_BYTES of text,
    or one longer text.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    base = written(keyed.mapInArrow(parsed_texts(window), "doc_id long, text_key long, n_words long, kept_sha256 string, whole binary, names array<long>, blind boolean"), "parsed")
    known = base.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    row = F.struct("doc_id", "text_key")
    single = written(known.groupBy("whole").agg(F.min_by(F.struct("doc_id", "text_key", "names", "blind"), row).alias("row"), F.max("doc_id").alias("last")).select("whole", "row.*", "last"), "single")

    named = single.select("doc_id", F.explode("names").alias("name"))
    shared = written(named.groupBy("name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "shared")
    met = named.join(shared, "name")
    lists = met.groupBy("doc_id").agg(F.collect_list(F.when(F.col("first") < F.col("doc_id"), F.col("name"))).alias("late"), F.collect_list(F.when(F.col("last") > F.col("doc_id"), F.col("name"))).alias("early"))
    asked = single.select("doc_id", "text_key", "whole", "blind").join(lists, "doc_id", "left").where("blind or late is not null").drop("blind")
    found = written(keyed.join(asked, ["doc_id", "text_key"]).mapInArrow(windows_to_verify(window), "doc_id long, whole binary, text string, late_a array<long>, late_b array<int>, early_a array<long>, early_b array<int>"), "windows")
    each = lambda kind: found.select("doc_id", F.explode(F.arrays_zip(F.col(f"{kind}_a").alias("a"), F.col(f"{kind}_b").alias("b"))).alias("w")).select("doc_id", "w.a", "w.b")
    late = each("late")
    firsts = written(late.union(each("early")).groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "firsts")
    gone = late.join(firsts, ["a", "b"]).where("first < doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("w")).select("doc_id", F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    changed = "removed long, left_sha256 string" + ", kept_text string" * with_text
    decided = found.where("text is not null").select("doc_id", "whole", "text").join(gone, "doc_id").mapInArrow(without_repeats(window, with_text), "doc_id long, whole binary, " + changed).dropDuplicates(["doc_id", "whole"])

    copied = single.where("doc_id < last").select("whole", F.col("doc_id").alias("first"))
    nothing = [F.col("n_words").alias("removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("left_sha256"), *([F.lit("").alias("kept_text")] if with_text else [])]
    copies = known.select("doc_id", "whole", "n_words").join(copied, "whole").where("doc_id > first").select("doc_id", "whole", *nothing).distinct()
    result = base.select("doc_id", "whole", "n_words", "kept_sha256").join(decided.unionByName(copies), ["doc_id", "whole"], "left")
    return result.select("doc_id", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left_sha256", "kept_sha256").alias("kept_sha256"), *(["kept_text"] if with_text else []))


def op13_recompression(spark, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words or more that stand in a document before; odd rows as in `drop_repeats`."""
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, r, words, unnest(range(1, len(words) - 48)) AS i FROM d),
w AS (SELECT doc_id, r, i, sha256(array_to_string(words[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
c AS (SELECT r, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM w JOIN f USING (h) WHERE first < doc_id GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""
