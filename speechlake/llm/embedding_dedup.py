"""Near-duplicate vectors by spherical-cap filters."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, whole_groups

COSINE = 0.9
#: Vectors that share a filter by chance, on average, and filters that a linked pair shares, on average.
CHANCE, SHARED = 8, 30
#: Independent codes that the filters are dealt to; one code alone leaves some vectors with few filters.
CODES = 16
#: Rows of a filter that are compared with each other at once.
BLOCK = 1024


def plan(n: int, cosine: float = COSINE) -> tuple[float, int]:
    """(height of a cap in standard deviations, words per half of each code) for n vectors.

    A cap catches a random vector with a probability of CHANCE / n. A vector's neighbour at the cosine is
    caught by a cap that catches the vector with the probability of a normal variable correlated so; there
    are as many caps as a linked pair needs to share SHARED of them; two halves' words make their square.
    """
    normal = NormalDist()
    caught = min(0.01, CHANCE / max(n, 1))
    height = normal.inv_cdf(1 - caught)
    both = 1 - normal.cdf((height - cosine * (height + 1 / height)) / math.sqrt(1 - cosine**2))
    return height, math.ceil(math.sqrt(SHARED / both / caught / CODES))


@functools.lru_cache(maxsize=4 * CODES)
def code(dim: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random rotation, and words for either half of the rotated vector; a filter is one word of each."""
    rng = np.random.default_rng([seed, dim])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    halves = []
    for size in (dim // 2, dim - dim // 2):
        w = rng.standard_normal((words, max(size, 1)))[:, :size]
        norms = np.linalg.norm(w, axis=1, keepdims=True)
        halves.append(w / np.where(norms > 0, norms, 1) * math.sqrt(size / dim))
    return turn, *halves


def filters(unit: np.ndarray, height: float, words: int) -> list[np.ndarray]:
    """For each unit vector, the ascending numbers of all filters whose direction it exceeds by the height.

    List decoding: the score of a filter is the sum of its halves' scores, so a half's word is only tried
    if it reaches the threshold with the other half's best.
    """
    dim = unit.shape[1]
    t = height / math.sqrt(dim)
    rows, found = [], []
    for c in range(CODES):
        turn, first, second = code(dim, words, c)
        turned = unit @ turn
        a, b = turned[:, : dim // 2] @ first.T, turned[:, dim // 2 :] @ second.T
        row, i = np.nonzero(a >= t - b.max(axis=1, keepdims=True))
        row_b, j = np.nonzero(b >= t - a.max(axis=1, keepdims=True))
        per = np.bincount(row_b, minlength=len(unit))
        begin = np.cumsum(per) - per
        # every tried word of the first half with each of the second in the same row
        times = per[row]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, i = np.repeat(row, times), np.repeat(i, times)
        j = j[begin[row] + nth]
        hit = a[row, i] + b[row, j] >= t
        rows.append(row[hit])
        found.append((c * words + i[hit]) * words + j[hit])
    row, number = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((number, row))
    return np.split(number[order], np.cumsum(np.bincount(row, minlength=len(unit)))[:-1])


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def links_of_group(node, times, unit, lists, role_a, role_b, out) -> None:
    """Adds (node, links, smallest of its local component) for the pairs between two blocks of one filter.

    A pair counts at the smallest filter that both vectors exceed only. role_a and role_b: the blocks' rows;
    the same array for a block with itself.
    """
    number, held = lists
    match = (unit[role_a] @ unit[role_b].T) >= COSINE
    same = role_a is role_b
    if same:
        np.fill_diagonal(match, False)
    if not match.any():
        return
    low = np.full(len(node), -1)
    # the smaller common filters of a matched pair
    rows_a, rows_b = np.flatnonzero(match.any(axis=1)), np.flatnonzero(match.any(axis=0))
    earlier = [h[h < number] for h in held]
    ids = np.unique(np.concatenate([earlier[role_a[i]] for i in rows_a] + [earlier[role_b[j]] for j in rows_b]))
    new = match.copy()
    if len(ids):
        def grid(rows):
            g = np.zeros((len(rows), len(ids)), np.float32)
            for k, r in enumerate(rows):
                g[k, np.searchsorted(ids, earlier[r])] = 1
            return g

        new[np.ix_(rows_a, rows_b)] &= (grid(role_a[rows_a]) @ grid(role_b[rows_b]).T) == 0
    count_a = new @ times[role_b]
    count_b = None if same else times[role_a] @ new
    label_a, label_b = node[role_a].copy(), node[role_b].copy()
    big = np.iinfo(np.int64).max
    while True:
        from_b = np.minimum(label_a, np.where(match, label_b[None, :], big).min(axis=1))
        from_a = np.minimum(label_b, np.where(match, from_b[:, None], big).min(axis=0))
        if same:
            from_a = from_b = np.minimum(from_a, from_b)
        if (from_b == label_a).all() and (from_a == label_b).all():
            break
        label_a, label_b = from_b, from_a
    out.append(pd.DataFrame({"node": node[role_a], "links": count_a, "low": label_a})[(match.any(axis=1))])
    if not same:
        out.append(pd.DataFrame({"node": node[role_b], "links": count_b, "low": label_b})[(match.any(axis=0))])


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: vectors linked at a cosine of 0.9 or more.

    Equal vectors become one node first. Each node is list-decoded to the filters (random product codes) whose
    direction it exceeds; nodes meet by filter and every pair there is verified in double precision, counted at
    its smallest common filter. The number of filters grows with the number of vectors, so that a vector
    meets about as many others by chance at any size. A filter with many nodes is cut into blocks, of which a
    task holds two; links are counted there, and what is handed on grows with rows, not pairs. Pairs below
    the cosine are never linked; a pair at 0.9 that shares no filter is missed (about one in 1,000).

    Null or zero vectors and those with null or non-finite components link with nothing, nor do vectors of
    different lengths or rows without vec_id. Repeated rows are vectors of their own. Extra columns are not
    read; an empty table gives no rows.
    """
    narrow = bool("float" in dict(rows.dtypes)[vector])
    kind = np.float32 if narrow else np.float64
    base = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    base = base.withColumn("key", F.when(usable(F.col("vector")) & F.col("vec_id").isNotNull(), F.md5(F.col("vector").cast("string"))))
    nodes = base.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"), F.first("vector").alias("vector"))
    height, words = plan(rows.count())

    def decode(batches):
        for pdf in batches:
            raw = [np.asarray(v, np.float64) for v in pdf["vector"]]
            found: list = [None] * len(raw)
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                by_dim.setdefault(len(v), []).append(i)
            for dim, own in by_dim.items():
                for part in (own[k : k + 500] for k in range(0, len(own), 500)):
                    unit = np.stack([unit_of(raw[i]) for i in part])
                    for i, f in zip(part, filters(unit, height, words)):
                        found[i] = f + (dim << 44)
            yield pd.DataFrame({"key": pdf["key"], "node": pdf["node"], "times": pdf["times"], "vector": [v.astype(kind).tobytes() for v in raw], "filters": found})

    decoded = checkpointed(nodes.mapInPandas(decode, "key string, node long, times long, vector binary, filters array<long>"))
    met = decoded.select("node", "times", "vector", F.col("filters").alias("held"), F.explode("filters").alias("filter"))
    hot = checkpointed(met.groupBy("filter").count().where(F.col("count") > BLOCK).select("filter", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    spread = met.join(hot, "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    keys = ["filter", "low", "high"]

    def compare(batches):
        for pdf in whole_groups(batches, keys):
            out: list[pd.DataFrame] = []
            cuts = np.append(np.flatnonzero(~pdf.duplicated(keys)), len(pdf))
            number, low, high, block = (pdf[c].to_numpy() for c in ("filter", "low", "high", "block"))
            node, times, vectors, held = pdf["node"].to_numpy(), pdf["times"].to_numpy(), pdf["vector"].tolist(), pdf["held"].tolist()
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j - i < 2:
                    continue
                unit = np.stack([unit_of(np.frombuffer(v, kind).astype(np.float64)) for v in vectors[i:j]])
                if low[i] == high[i]:
                    a = b = np.arange(j - i)
                else:
                    a, b = np.flatnonzero(block[i:j] == low[i]), np.flatnonzero(block[i:j] == high[i])
                if len(a) and len(b):
                    links_of_group(node[i:j], times[i:j], unit, (number[i], held[i:j]), a, b, out)
            if out:
                yield pd.concat(out)

    found = checkpointed(spread.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "node long, links long, low long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")).where("a <> b"))
    facts = decoded.select("key", "node", "times").join(counts, "node", "left").join(joined, "node", "left")
    facts = checkpointed(facts.select("key", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    result = base.select("vec_id", "key").join(facts, "key", "left")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def unit_of(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def op7_spherical_caps(spark, sf_dir: str) -> DataFrame:
    """All rows of embeddings, whatever their labels."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
