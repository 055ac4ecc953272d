"""Near duplicates by BagMinHash: weighted signatures, bands, and verified multiset overlap."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, whole_groups
from .shingles import U, mix, overlaps, shingle_sets
from .tokens import batches

WORDS, SIMILARITY = 5, 0.8
#: Components of a signature; bands of so many rows each (21 * 6 = 126 of them are banded).
SLOTS, BANDS, ROWS = 128, 21, 6
#: Rows of a bucket that are compared at once.
BLOCK = 512
GOLDEN = 0x9E3779B97F4A7C15


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signatures (n, slots) of n weighted sets given as (owner, element, whole weight).

    Weights are discretised into blocks (0, 1], (1, 2], (2, 4], (4, 8], ... Every element has an independent
    Poisson process for each block, with a rate of the block's width per slot, the same in all sets. A point of
    it has a time, a slot and a place within the block, all from hashes; it counts for a set if the set's
    weight reaches its place. A slot's value is the identity of its earliest point, and two sets agree in a slot
    with a probability of their weighted Jaccard similarity. Points are only drawn up to a time by which
    all slots are likely filled; sets where one is not are drawn again up to twice that time.
    """
    total = np.bincount(owner, weight, n)
    out = np.zeros((n, slots), U)
    todo, factor = np.flatnonzero(total > 0), 1.0
    while len(todo):
        chosen = np.zeros(n, bool)
        chosen[todo] = True
        use = chosen[owner]
        best = np.full(n * slots, np.inf)
        limit = np.zeros(n)
        limit[todo] = factor * (np.log(slots) + 4) / total[todo]
        points = list(_points(owner[use], element[use], weight[use], limit, slots))
        for slot, time, _ in points:
            np.minimum.at(best, slot, time)
        flat = out.reshape(-1)
        for slot, time, name in points:
            first = time == best[slot]
            flat[slot[first]] = name[first]
        todo = todo[np.isinf(best.reshape(n, slots)[todo]).any(axis=1)]
        factor *= 2
    return out


def _points(owner, element, weight, limit, slots):
    """(slot of its set, time, identity) of all points up to the limit of their sets, in steps of one per process."""
    block = 0
    while len(owner):
        low, high = (0, 1) if block == 0 else (1 << (block - 1), 1 << block)
        has = weight > low
        owner, element, weight = owner[has], element[has], weight[has]
        d, w, time = owner, weight, np.zeros(len(owner))
        with np.errstate(over="ignore"):
            seed = mix(element + U(GOLDEN * (block + 1) & (1 << 64) - 1))
            step = 0
            while len(d):
                step += 1
                x = mix(seed + U(GOLDEN * step & (1 << 64) - 1))
                time = time - np.log(((x >> U(24)) + U(1)).astype(np.float64) * 2.0**-40) / (slots * (high - low))
                within = time <= limit[d]
                d, w, time, seed, x = d[within], w[within], time[within], seed[within], x[within]
                y = mix(x)
                counts = low + (high - low) * ((y >> U(40)).astype(np.float64) * 2.0**-24) < w
                if counts.any():
                    yield d[counts] * slots + (y & U(slots - 1)).astype(np.int64)[counts], time[counts], x[counts]
        block += 1


def bands(signed: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (the band's number is in it)."""
    with np.errstate(over="ignore"):
        rows = signed[:, : BANDS * ROWS].reshape(len(signed), BANDS, ROWS)
        key = np.zeros(rows.shape[:2], U) + (np.arange(BANDS, dtype=U) + U(1)) * U(GOLDEN)
        for i in range(ROWS):
            key = mix(key + rows[:, :, i])
    return key.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text) and bands, null for a text without a word."""

    def of(rows):
        for pdf in rows:
            for first, texts in batches(pdf["text"].tolist()):
                owner, element, times = shingle_sets(texts, WORDS)
                signed = signatures(owner, element, times, len(texts))
                some = np.bincount(owner, minlength=len(texts)) > 0
                keys = bands(signed)
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[first : first + len(texts)].astype("Int64"),
                    "digest": [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts],
                    "bands": [keys[i] if some[i] else None for i in range(len(texts))],
                })

    return docs.select("doc_id", "text").mapInPandas(of, "doc_id long, digest binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' shingles overlap by SIMILARITY or more. texts: doc_id, text.

    A b with many pairs is dealt to a part for each BLOCK of them, so that a large group meets its text in many tasks.
    """
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(parts, "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    hot = checkpointed(parts.where("parts > 1"))  # a row per BLOCK pairs at most
    dealt = pairs.join(F.broadcast(hot) if hot.count() <= 10_000 else hot, "b", "left")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part"))

    def check(rows):
        for pdf in rows:
            at = 0
            for first, mine in batches(pdf["text_a"].tolist(), 500_000):
                part = pdf.iloc[first : first + len(mine)]
                ok = overlaps(mine, [t or "" for t in part["text_b"]]) >= SIMILARITY
                yield part.loc[ok, ["a", "b"]]
                at += len(mine)

    return dealt.join(left, "a").join(right, ["b", "part"]).select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def other_links(rows: DataFrame) -> DataFrame:
    """(a, b) of one bucket but different labels whose shingles overlap enough. rows: key, node, label, bands, text.

    In each bucket the rows of its largest label need no comparison among themselves; all others meet all
    rows. Both are cut into blocks of about BLOCK rows, and a task holds two blocks at a time. A pair is
    compared, exactly, in the first band that it shares only.
    """
    labels = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    sizes = labels.groupBy("key").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"))
    sizes = checkpointed(sizes.select("key", "main", F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("rests")))
    mixed = rows.join(sizes, "key").withColumn("side", F.when(F.col("label") == F.col("main"), 0).otherwise(1))
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks"))
    rest = F.pmod(F.xxhash64("node", F.lit(5)), F.col("rests"))
    columns = ["node", "label", "bands", "text", "side"]
    as_any = mixed.select("key", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("rest"), F.lit(0).alias("role"), *columns)
    as_rest = mixed.where("side = 1").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), rest.alias("rest"), F.lit(1).alias("role"), *columns)
    keys = ["key", "block", "rest"]

    def compare(batch_rows):
        for pdf in whole_groups(batch_rows, keys):
            cuts = np.append(np.flatnonzero(~pdf.duplicated(keys)), len(pdf))
            found = [pair for i, j in zip(cuts[:-1], cuts[1:]) for pair in links_of_bucket(pdf.iloc[i:j])]
            yield pd.DataFrame(found, columns=["a", "b"])

    both = as_any.unionByName(as_rest)
    return both.repartition(*keys).sortWithinPartitions(*keys, "role").mapInPandas(compare, "a long, b long").distinct()


def links_of_bucket(rows: pd.DataFrame) -> list[tuple[int, int]]:
    """Links between the rows with role 1 and those with role 0 of one bucket."""
    node, label, role, side = (rows[c].to_numpy() for c in ("node", "label", "role", "side"))
    mine, others = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
    if not len(mine) or not len(others):
        return []
    keys = np.stack(rows["bands"].tolist())
    band = int(np.argmax(keys[0] == rows["key"].iloc[0]))
    owner, shingle, times = shingle_sets([t or "" for t in rows["text"]], WORDS)
    _, number = np.unique(shingle, return_inverse=True)
    first = np.searchsorted(owner, np.arange(len(rows) + 1))
    total = np.add.reduceat(times, first[:-1])
    held = np.zeros(number.max() + 1, np.int64)
    out = []
    for k in mine:
        ok = (label[others] != label[k]) & ((side[others] == 0) | (node[others] < node[k])) & ~(keys[others, :band] == keys[k, :band]).any(axis=1)
        # an overlap of SIMILARITY needs sizes as close
        near = others[ok]
        near = near[(total[near] >= SIMILARITY * total[k]) & (total[k] >= SIMILARITY * total[near])]
        if not len(near):
            continue
        own = slice(first[k], first[k + 1])
        held[number[own]] = times[own]
        sizes = first[near + 1] - first[near]
        begin = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(begin, sizes) + np.repeat(first[near], sizes)
        common = np.add.reduceat(np.minimum(times[at], held[number[at]]), begin)
        held[number[own]] = 0
        alike = common >= SIMILARITY * (total[k] + total[near] - common)
        out += [(max(node[k], x), min(node[k], x)) for x in node[near[alike]]]
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_copies, kept for every row of docs (doc_id, text).

    class_id is the smallest doc_id that is reached over links; two texts are linked when their multisets of
    5-word shingles have a Jaccard similarity of 0.8 or more. kept: doc_id = class_id. n_copies: rows with
    the very same text.

    Equal texts become one node first. Its signature's bands are its keys; in each bucket all nodes are paired
    with the smallest one and verified on whole texts. What lands in a class need not be compared again: only
    nodes of a bucket that are then in different classes are, in blocks. So a large group costs rows, not
    pairs, unless its members differ. Missed are only pairs that share no band (0.2 % at a similarity of 0.8,
    less above).

    Null and empty texts, and those without a word, link with nothing. Texts of under five words are one
    shingle. Rows with a null doc_id stay by themselves (class_id null, kept). Rows that share a doc_id are
    one document and get a row each. An empty table gives no rows; extra columns are not read.
    """
    signed = checkpointed(sign(docs))
    nodes = signed.where("bands is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
    nodes = checkpointed(nodes)
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    centers = checkpointed(keyed.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n"))
    bucketed = checkpointed(keyed.join(centers, "key"))
    pairs = bucketed.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    involved = bucketed.select(F.col("node").alias("doc_id")).distinct()
    texts = checkpointed(docs.select("doc_id", "text").join(involved, "doc_id"))
    links = checkpointed(verified(checkpointed(pairs), texts))
    label = components(links)
    labelled = bucketed.join(label.withColumnRenamed("component", "label"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    split = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high and n > 2").select("key")
    rows = labelled.join(split, "key").join(nodes.select("node", "bands"), "node").join(texts.withColumnRenamed("doc_id", "node"), "node")
    more = checkpointed(other_links(checkpointed(rows)))
    every = components(links.union(more))
    classes = nodes.join(every, "node", "left").select("digest", "n_copies", F.coalesce("component", "node").alias("class_id"))
    found = signed.select("doc_id", "digest").join(checkpointed(classes), "digest", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return found.select("doc_id", class_id.alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: one row of each class stays, the one with its smallest doc_id.

    Repeated rows (of one doc_id and one text) become one; a doc_id that stays keeps each of its different texts.
    Rows with a null doc_id all stay, as do empty texts and those without a word. An empty table stays empty;
    other columns pass through whatever their names.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", F.md5("text").alias("digest")).join(kept, "doc_id")
    one = rows.groupBy("doc_id", "digest").agg(F.first("doc").alias("doc")).select("doc.*")
    return one.unionByName(docs.where("doc_id is null"))


def op8_bag_minhash(spark, sf_dir: str) -> DataFrame:
    """Class, copies and verdict of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
