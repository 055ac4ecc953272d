"""Hard negatives of anchors by integer scores, found with Fagin's threshold algorithm."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Depth of the first step of sorted access; each later step is as deep as all before it.
FIRST_DEPTH = 16
#: Rows of a block and anchors of a chunk: what one task holds at a time.
MOST_ROWS, LEAST_ROWS, BLOCKS, MOST_ANCHORS = 32_768, 1_024, 24, 8_192


class Block:
    """Some vectors of one width, with a list of them per dimension, sorted by that component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(vectors.T, self.order, axis=1)
        self.most = int(np.abs(vectors).max(initial=0))
        self.floats = vectors.astype(np.float64)
        self.accessed = 0

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products, exact: in floats while they stay below 2 ** 53, in Python's integers beyond 2 ** 63."""
        bound = len(anchor) * self.most * int(np.abs(anchor).max(initial=0))
        if bound < 1 << 53:
            return (self.floats[at] @ anchor.astype(np.float64)).astype(np.int64)
        kind = np.int64 if bound < 1 << 63 else object
        return self.vectors[at].astype(kind) @ anchor.astype(kind)

    def search(self, anchor: np.ndarray, wanted: np.ndarray, windows: list[tuple], k: int) -> list[list[tuple[int, int]]]:
        """For each window (low, high) of scores, its first k wanted rows as (score, id), higher scores first, then ids.

        Sorted access goes down every list whose component the anchor has, from the top for a positive one, from
        the bottom for a negative one. Each row met is scored by random access. The threshold, the score of a row
        with the components just reached, bounds all rows not met: the search ends once it lies strictly below
        every window's k-th score, or below the window itself where fewer were found, or once every row was met.
        """
        n, up, down = len(self.ids), np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        dims = np.concatenate([up, down])
        met = np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, n_met, best = 0, 0, []
        while n_met < n:
            to = min(n, 2 * depth or FIRST_DEPTH) if len(dims) else n
            if len(dims):
                new = np.zeros(n, bool)
                new[self.order[up, depth:to].ravel()] = True
                new[self.order[down, n - to : n - depth].ravel()] = True
                new &= ~met
            else:  # every score is 0, so that no threshold is below any
                new = ~met
            met |= new
            at = np.flatnonzero(new)
            n_met += len(at)
            self.accessed += len(at)
            at = at[wanted[at]]
            ids, scores = np.concatenate([ids, self.ids[at]]), np.concatenate([scores, self.scores(at, anchor)])
            depth = to
            best, done = [], True
            reached = np.concatenate([self.sorted[up, depth - 1], self.sorted[down, n - depth]])
            threshold = sum(a * x for a, x in zip(anchor[dims].tolist(), reached.tolist()))
            for low, high in windows:
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                first = inside[np.lexsort((ids[inside], -scores[inside]))[:k]]
                best.append([(int(scores[i]), int(ids[i])) for i in first])
                done &= threshold < (best[-1][-1][0] if len(first) == k else low)
            if done:
                break
        return best or [[] for _ in windows]


def blocks_of(rows: pd.DataFrame) -> dict[int, Block]:
    """A block for each width of vector."""
    found = {}
    for width, part in rows.groupby(rows["vector"].map(len)):
        found[width] = Block(part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), np.stack(part["vector"].to_numpy()).reshape(len(part), width).astype(np.int64))
    return found


#: Any score.
ANY = (float("-inf"), float("inf"))


def best_positives(k: int):
    """For applyInPandas: each anchor's first k rows of its label in a block."""

    def work(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        blocks, out = blocks_of(rows), []
        for a in anchors.itertuples():
            if block := blocks.get(len(a.vector)):
                wanted = (block.labels == a.label) & (block.ids != a.vec_id)
                (found,) = block.search(np.asarray(a.vector, np.int64), wanted, [ANY], k)
                out += [(a.vec_id, a.mark, i, s) for s, i in found]
        return pd.DataFrame(out, columns=["anchor_id", "mark", "positive_id", "positive_score"])

    return work


def best_negatives(k: int, low: int, high: int):
    """For applyInPandas: for each anchor and positive, the first k rows of other labels in its window in a block."""

    def work(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        blocks, out = blocks_of(rows), []
        for a in anchors.itertuples():
            block = blocks.get(len(a.vector))
            windows = [(-(-low * int(s) // 100), high * int(s) // 100) for s in a.positive_scores]
            places = [i for i, (x, y) in enumerate(windows) if x <= y]
            if block and places:
                found = block.search(np.asarray(a.vector, np.int64), block.labels != a.label, [windows[i] for i in places], k)
                out += [(a.vec_id, a.mark, i, n, s) for i, f in zip(places, found) for s, n in f]
        return pd.DataFrame(out, columns=["anchor_id", "mark", "place", "negative_id", "negative_score"])

    return work


def first(rows: DataFrame, keys: list[str], score: str, tie: str, k: int, rank: str) -> DataFrame:
    """The first k rows of keys by score, then the smaller tie, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, most_rows: int = MOST_ROWS) -> DataFrame:
    """vec_id, label, vector array<long> -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first rows of the same label and another vec_id; its negatives for a positive
    the first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    Scores are inner products, ties go to the smaller vec_id.

    All rows are dealt by hash to blocks, whatever their labels, so a hot label is in no task's way; anchors, the
    stated queries, go to every block in chunks. A block's first k hold all that can be among the first k of all,
    so merging them is exact and a task holds one block and one chunk. Rows with a null id, label, vector or
    component take no part; rows that are wholly equal count once; vectors of different widths have no score; an
    empty table gives no rows; other columns of the input aren't used. Scores beyond 63 bits raise an error.
    """
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall(F.coalesce("vector", F.array().cast("array<bigint>")), lambda x: x.isNotNull())
    given = rows.where(whole).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<bigint>"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    base = checkpointed(given.distinct().withColumn("mark", F.xxhash64("vec_id", "label", "vector")))
    n, n_anchors = base.agg(F.count("*"), F.count_if("is_anchor")).first()
    n_blocks = max(1, -(-n // min(most_rows, max(LEAST_ROWS, -(-n // BLOCKS)))))
    n_chunks = max(1, -(-n_anchors // MOST_ANCHORS))
    block, chunk = F.pmod("mark", F.lit(n_blocks)), F.pmod(F.xxhash64("mark"), F.lit(n_chunks))

    def dealt(df: DataFrame, own: dict, to: str, copies: int) -> DataFrame:
        return df.withColumns(own).withColumn(to, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))).repartition(n_blocks * n_chunks, "block", "chunk").groupBy("block", "chunk")

    vectors = dealt(base.select("vec_id", "label", "vector", "mark"), {"block": block}, "chunk", n_chunks)
    anchors = base.where("is_anchor").select(*(F.col(c).alias(c) for c in ("vec_id", "label", "vector", "mark")))
    found = vectors.cogroup(dealt(anchors, {"chunk": chunk}, "block", n_blocks)).applyInPandas(best_positives(positives), "anchor_id long, mark long, positive_id long, positive_score long")
    top = checkpointed(first(found, ["anchor_id", "mark"], "positive_score", "positive_id", positives, "place"))
    listed = top.groupBy(F.col("anchor_id").alias("vec_id"), "mark").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("positive_scores"))
    asked = dealt(anchors.join(listed, ["vec_id", "mark"]), {"chunk": chunk}, "block", n_blocks)
    found = vectors.cogroup(asked).applyInPandas(best_negatives(negatives, low, high), "anchor_id long, mark long, place int, negative_id long, negative_score long")
    ranked = first(found, ["anchor_id", "mark", "place"], "negative_score", "negative_id", negatives, "rank").withColumn("place", F.col("place") + 1)
    return ranked.join(top, ["anchor_id", "mark", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def quantised(rows: DataFrame, steps: int = 256) -> DataFrame:
    """vec_id, label, embedding -> vec_id, label, vector: floor(steps * x) of each component, as a double.

    Rows with a null label or vector or with a null or non-finite component are left out.
    """
    known = F.coalesce("embedding", F.array().cast("array<float>"))
    fine = F.forall(known, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    return good.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.lit(steps) * x.cast("double")).cast("long")).alias("vector"))


def op12_threshold(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all; where vec_id is divisible by 7, the label is one further.

    Nulls, equal rows, widths, ties, empty tables and other columns: as in `mine`.
    """
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(quantised(moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id,
         CAST(list_dot_product(a.vector, b.vector) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.vector) = len(b.vector) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  WHERE 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
