"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder
from .shingles import U, mix, word_hashes
from .tokens import batches

#: A word has units of its own (embeddings and a bias) from this count and this share of all training tokens on;
#: the others share a unit with those that end alike.
LEAST_COUNT, LEAST_SHARE, BUCKETS = 16, 2.0**-15, 512
#: Words before that predict the next; numbers per embedding.
CONTEXT, DIM = 3, 16
#: Noise units and noise groups of a training batch, tokens in it, and the step size.
NOISE, NOISE_GROUPS, BATCH, RATE = 32, 12, 4096, 0.15
#: Bytes of text that a copy learns from in a round, and of a chunk, whose words a task holds at once.
UNIT_BYTES, CHUNK_BYTES = 1_600_000, 16_000_000
#: Small tables are learnt in several passes, towards LEAST tokens.
LEAST, MOST_PASSES = 8_000_000, 16
#: Numbers of the model that are averaged at once.
BLOCK = 65_536


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word hash, bucket, is end) of every token, A-Z lower-cased; each text closes with an end."""
    owner, words, tail = word_hashes(texts, lower=True)
    n = len(words) + len(texts)
    at = np.arange(len(words)) + owner
    end = np.ones(n, bool)
    end[at] = False
    doc = np.repeat(np.arange(len(texts)), np.bincount(owner, minlength=len(texts)) + 1)
    hashes, bucket = np.zeros(n, np.int64), np.zeros(n, np.int64)
    hashes[at] = words.view(np.int64)
    bucket[at] = (mix(tail.astype(U)) % U(BUCKETS)).astype(np.int64)
    return doc, hashes, bucket, end


@dataclass
class Vocabulary:
    """Statistics of the training tokens, and the network's units: the end, the words above the threshold, the buckets.

    Units are numbered by falling count and cut into about the square root of their number of groups with about
    equal shares of the tokens, so that a token's probability is that of its group times that within the group.
    """

    top: np.ndarray  # hashes of the words with a unit, ascending
    top_counts: np.ndarray
    bucket_tokens: np.ndarray  # without the words that have a unit
    bucket_once: np.ndarray
    n_tokens: int
    n_types: int
    n_docs: int

    def __post_init__(self):
        counts = np.concatenate([[self.n_docs], self.top_counts, self.bucket_tokens])
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.end_unit, self.top_unit, self.bucket_unit = number[0], number[1 : 1 + len(self.top)], number[1 + len(self.top) :]
        self.bucket_of = np.full(len(order), -1)
        self.bucket_of[self.bucket_unit] = np.arange(BUCKETS)
        weights = counts[order] + 0.5
        self.shares = weights / weights.sum()
        groups = math.isqrt(len(order) - 1) + 1
        place = np.minimum((np.cumsum(self.shares) - self.shares / 2) * groups, groups - 1).astype(np.int64)
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        self.bounds = np.append(starts, len(order))
        self.group = np.repeat(np.arange(len(starts)), np.diff(self.bounds))

    def units(self, hashes: np.ndarray, bucket: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.bucket_unit[bucket]
        if len(self.top):
            i = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            out = np.where(self.top[i] == hashes, self.top_unit[i], out)
        return np.where(end, self.end_unit, out)

    def within(self, unit: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Natural log of a token's share of its unit. A bucket leaves what Good and Turing give to words never seen."""
        b = self.bucket_of[unit]
        total = self.bucket_tokens[b]
        unseen = np.where(total > 0, (self.bucket_once[b] + 0.5) / (total + 1), 1.0)
        seen = (1 - unseen) * count / np.maximum(total, 1)
        return np.where(b >= 0, np.log(np.where(count > 0, np.maximum(seen, 1e-300), unseen)), 0.0)

    def dtype(self) -> str:
        return "<u2" if len(self.shares) <= 1 << 16 else "<u4"


def contexts(unit: np.ndarray, doc: np.ndarray, end_unit: int) -> np.ndarray:
    """The units of the CONTEXT tokens before each token of its text; the end stands before the text."""
    out = np.full((CONTEXT, len(unit)), end_unit, np.int64)
    for i in range(CONTEXT):
        k = i + 1
        out[i, k:] = np.where(doc[k:] == doc[:-k], unit[:-k], end_unit)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.exp(-np.clip(x, -30, 30))
    x += 1
    return np.divide(1, x, out=x)


class LogBilinear:
    """Prediction = sum over places of weight[place] * context[unit]; a unit's score = prediction . target[unit] + bias[unit].

    Groups have scores of their own, from the same prediction.
    """

    def __init__(self, vocab: Vocabulary, flat: np.ndarray | None = None, seed: int = 1):
        self.vocab = vocab
        n, g = len(vocab.shares), len(vocab.bounds) - 1
        self.group_shares = np.add.reduceat(vocab.shares, vocab.bounds[:-1])
        self.shapes = {"context": (n, DIM), "target": (n, DIM), "bias": (n,), "head": (g, DIM), "head_bias": (g,), "weight": (CONTEXT, DIM)}
        if flat is None:
            rng = np.random.default_rng(seed)
            draw = lambda k: rng.normal(0, 0.3, (k, DIM)).astype(np.float32)
            self.p = {"context": draw(n), "target": draw(n), "bias": np.log(vocab.shares).astype(np.float32), "head": draw(g), "head_bias": np.log(self.group_shares).astype(np.float32), "weight": np.full((CONTEXT, DIM), 1 / CONTEXT, np.float32)}
        else:
            cuts = np.cumsum([math.prod(s) for s in self.shapes.values()])[:-1]
            self.p = {k: x.reshape(s) for (k, s), x in zip(self.shapes.items(), np.split(flat, cuts))}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in self.shapes]).astype(np.float32)

    def predict(self, before: np.ndarray) -> np.ndarray:
        return sum(self.p["context"][c] * w for c, w in zip(before, self.p["weight"]))

    def log_probs(self, before: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each unit after its context, normalised over all units."""
        out, bounds, p = np.empty(len(unit)), self.vocab.bounds, self.p

        def own_log(scores: np.ndarray, own: np.ndarray) -> np.ndarray:
            if not safe:
                scores -= scores.max(axis=1, keepdims=True)
            mine = scores[np.arange(len(own)), own].astype(np.float64)
            np.exp(scores, out=scores)
            return mine - np.log(scores @ np.ones(scores.shape[1], np.float32))

        longest = math.sqrt(max((p[k] * p[k]).sum(axis=1).max() for k in ("head", "target")))
        steepest = max(np.abs(p[k]).max() for k in ("head_bias", "bias"))
        for i in range(0, len(unit), 65_536):
            q, w = self.predict(before[:, i : i + 65_536]), unit[i : i + 65_536]
            g = self.vocab.group[w]
            # no score can overflow or vanish then
            safe = math.sqrt((q * q).sum(axis=1).max()) * longest + steepest < 60
            made = own_log(q @ p["head"].T + p["head_bias"], g)
            order = np.argsort(g, kind="stable")
            cuts = np.searchsorted(g[order], np.arange(len(bounds)))
            for k in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(bounds) > 1)):
                rows, a, b = order[cuts[k] : cuts[k + 1]], bounds[k], bounds[k + 1]
                made[rows] += own_log(q[rows] @ p["target"][a:b].T + p["bias"][a:b], w[rows] - a)
            out[i : i + 65_536] = made
        return out

    def train(self, before: np.ndarray, unit: np.ndarray, rng: np.random.Generator, squares: dict) -> None:
        """One pass of noise-contrastive estimation: each token's unit against NOISE units, its group against NOISE_GROUPS."""
        p, group = self.p, self.vocab.group
        pairs = []
        for of, bias, shares, k in (("target", "bias", self.vocab.shares, NOISE), ("head", "head_bias", self.group_shares, NOISE_GROUPS)):
            pairs.append((of, bias, np.cumsum(shares), np.log(k * shares).astype(np.float32), k))
        for i in range(0, len(unit), BATCH):
            b, w = before[:, i : i + BATCH], unit[i : i + BATCH]
            held = [p["context"][c] for c in b]
            q = sum(h * x for h, x in zip(held, p["weight"]))
            dq, grads = 0, {}
            for of, bias, cumulative, odds, k in pairs:
                v = np.minimum(np.searchsorted(cumulative, rng.random(k)), len(cumulative) - 1)
                own = w if of == "target" else group[w]
                # 1 - sigmoid for the true ones, sigmoid for the noise
                true = p[of][own]
                up = sigmoid(odds[own] - np.einsum("ij,ij->i", q, true) - p[bias][own])
                down = sigmoid(q @ p[of][v].T + p[bias][v] - odds[v])
                true *= up[:, None]
                true -= down @ p[of][v]
                dq = dq + true
                grads[of], grads[bias] = spread(own, up[:, None] * q, len(p[of])), np.bincount(own, up, len(p[of]))
                np.add.at(grads[of], v, -(down.T @ q))
                np.add.at(grads[bias], v, -down.sum(axis=0))
            grads["context"] = spread(b.reshape(-1), np.concatenate([dq * x for x in p["weight"]]), len(p["context"]))
            grads["weight"] = np.stack([np.einsum("ij,ij->j", dq, h) for h in held])
            for name, g in grads.items():
                g = np.asarray(g, np.float32) * np.float32(1 / len(w))
                squares[name] += g * g
                g *= np.float32(RATE)
                g /= np.sqrt(squares[name])
                p[name] += g


def spread(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row."""
    out = np.empty((n, values.shape[1]), np.float32)
    for i, column in enumerate(np.ascontiguousarray(values.T, np.float64)):
        out[:, i] = np.bincount(rows, column, n)
    return out


def plan(n_bytes: int) -> tuple[int, int, int]:
    """(copies, rounds, chunks), by the bytes of all texts alone; a round is made of whole chunks."""
    units = max(1, math.ceil(n_bytes / UNIT_BYTES))
    copies = math.isqrt(units)
    rounds = math.ceil(units / copies)
    return copies, rounds, rounds * max(1, round(copies * UNIT_BYTES / CHUNK_BYTES))


def with_chunk(docs: DataFrame, chunks: int) -> DataFrame:
    """doc_id, has_id, text, held_out (crc32 of doc_id as text, modulo 7, is 2; false for null), key and chunk, from a hash."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"), F.xxhash64("doc_id", "text").alias("key"))
    return rows.withColumn("chunk", F.pmod("key", F.lit(chunks)).cast("int"))


def runs(frames, column: str):
    """(value, rows) for each run of equal values of a column, over frames sorted by it; a run may come in parts."""
    for pdf in frames:
        of = pdf[column].to_numpy()
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
        for a, b in zip(cuts, [*cuts[1:], len(of)]):
            yield of[a], pdf.iloc[a:b]


def count_words(docs: DataFrame, chunks: int, folder: str) -> DataFrame:
    """chunk, word, bucket, count (over all training tokens), first: the words of each chunk, written to folder.

    A chunk counts its own words first; only its distinct ones are shuffled, by word, to get their total. A
    word has a row per chunk at most, so that no frequent word makes a hot key.
    """

    def distinct(word, bucket, n):
        order = np.argsort(word, kind="stable")
        word, bucket, n = word[order], bucket[order], n[order]
        at = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, int)
        return word[at], bucket[at], np.add.reduceat(n, at) if len(at) else n

    def count(frames):
        held: list[tuple[np.ndarray, ...]] = []
        now = None

        def counted():
            word, bucket, n = distinct(*(np.concatenate(x) for x in zip(*held)))
            for i in range(0, len(word), 100_000):
                yield pd.DataFrame({"chunk": np.int32(now), "word": word[i : i + 100_000], "bucket": bucket[i : i + 100_000].astype(np.int16), "n": n[i : i + 100_000]})

        for chunk, pdf in runs(frames, "chunk"):
            if chunk != now and held:
                yield from counted()
                held = []
            now = chunk
            out = pdf["held_out"].to_numpy(bool)
            for first, texts in batches(pdf["text"].tolist()):
                doc, word, bucket, end = tokens_of(texts)
                learn = ~out[first : first + len(texts)][doc]
                held.append(distinct(word[~end], bucket[~end], learn[~end].astype(np.int64)))
                if sum(len(x[0]) for x in held) > 1_000_000:
                    held = [distinct(*(np.concatenate(x) for x in zip(*held)))]
        if held:
            yield from counted()

    local = docs.select("chunk", "held_out", "text").repartition(chunks, "chunk").sortWithinPartitions("chunk").mapInPandas(count, "chunk int, word long, bucket short, n long")
    of_word = Window.partitionBy("word")
    total = local.select("chunk", "word", "bucket", F.sum("n").over(of_word).alias("count"), (F.row_number().over(of_word.orderBy("chunk")) == 1).alias("first"))
    total.write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def vocabulary(words: DataFrame, n_docs: int) -> Vocabulary:
    """Statistics of the training tokens. To the driver come a row per bucket and the words above the threshold.

    A word needs a share of LEAST_SHARE, so there are 32,768 of them at most, whatever the input.
    """
    seen = words.where("first and count > 0").select("word", "bucket", "count")
    tokens, once = np.zeros(BUCKETS), np.zeros(BUCKETS)
    n_types = 0
    for bucket, t, o, types in seen.groupBy("bucket").agg(F.sum("count"), F.count_if(F.col("count") == 1), F.count("*")).collect():
        tokens[bucket], once[bucket] = t, o
        n_types += types
    n_tokens = int(tokens.sum()) + n_docs
    least = max(LEAST_COUNT, math.ceil(n_tokens * LEAST_SHARE))
    top = sorted((r[0], r[2], r[1]) for r in seen.where(F.col("count") >= least).collect())
    for _, count, bucket in top:
        tokens[bucket] -= count
    return Vocabulary(np.array([t[0] for t in top], np.int64), np.array([t[1] for t in top], float), tokens, once, n_tokens, n_types + (n_docs > 0), n_docs)


def encode(docs: DataFrame, words: DataFrame, vocab: Vocabulary, chunks: int, copies: int, rounds: int, folder: str) -> DataFrame:
    """A row per document, written to folder: what needs no network (counts, base_score, inner: the log of the
    tokens' shares of their units), the units of its tokens, and its round and copy in training.

    A chunk's words come before its texts in one sorted partition: a task holds the words of one chunk and a few
    texts at a time.
    """
    floor, kind = vocab.n_tokens + vocab.n_types + 1, vocab.dtype()

    def of_texts(pdf: pd.DataFrame, known: pd.Index, counts: np.ndarray):
        for first, texts in batches(pdf["text"].tolist()):
            n = len(texts)
            part = pdf.iloc[first : first + n]
            doc, word, bucket, end = tokens_of(texts)
            count = np.full(len(word), vocab.n_docs)
            count[~end] = counts[known.get_indexer(word[~end])]
            unit = vocab.units(word, bucket, end)
            each = np.split(unit.astype(kind), np.cumsum(np.bincount(doc, minlength=n))[:-1])
            yield pd.DataFrame({
                "doc_id": part["doc_id"], "has_id": part["has_id"], "held_out": part["held_out"], "n_tokens": np.bincount(doc, minlength=n), "n_known": np.bincount(doc, count > 0, n).astype(np.int64),
                "base_score": np.bincount(doc, np.log10((count + 1) / floor), n), "inner": np.bincount(doc, vocab.within(unit, count), n), "units": [x.tobytes() for x in each],
                "key": part["key"], "copy": part["key"] // chunks % copies, "round": part["chunk"] % rounds,
            })

    def made(frames):
        now, held, known, counts = None, [], None, None
        for chunk, pdf in runs(frames, "chunk"):
            if chunk != now:
                now, held, known = chunk, [], None
            text = pdf["is_text"].to_numpy(bool)
            if not text.all():
                held.append(pdf.loc[~text, ["word", "count"]].to_numpy(np.int64))
            if text.any():
                if known is None:
                    own = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
                    known, counts = pd.Index(own[:, 0]), own[:, 1]
                yield from of_texts(pdf[text], known, counts)

    no = lambda kind, name: F.lit(0).cast(kind).alias(name)
    mine = docs.select("chunk", F.lit(True).alias("is_text"), no("long", "word"), no("long", "count"), "doc_id", "has_id", "held_out", "key", "text")
    theirs = words.select("chunk", F.lit(False).alias("is_text"), "word", "count", no("long", "doc_id"), F.lit(False).alias("has_id"), F.lit(False).alias("held_out"), no("long", "key"), F.lit("").alias("text"))
    both = theirs.unionByName(mine).repartition(chunks, "chunk").sortWithinPartitions("chunk", "is_text")
    schema = "doc_id long, has_id boolean, held_out boolean, n_tokens long, n_known long, base_score double, inner double, units binary, key long, copy long, round int"
    both.mapInPandas(made, schema).write.partitionBy("round").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def unpacked(rows, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, unit, contexts) of the tokens of packed texts."""
    unit = np.frombuffer(b"".join(rows), vocab.dtype()).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) // np.dtype(vocab.dtype()).itemsize for r in rows])
    return doc, unit, contexts(unit, doc, vocab.end_unit)


def train(encoded: DataFrame, vocab: Vocabulary, rounds: int) -> np.ndarray:
    """The model's numbers, learnt from all training texts in rounds.

    In a round each copy starts from the last mean, of the numbers and of their step sizes, and learns its share
    of the round's texts; the copies are then averaged by their tokens, in blocks on the cluster, and one state
    comes to the driver. Shares hold about UNIT_BYTES of text; copies and rounds both grow with the square root of
    the input, so that all tokens are learnt from and the model is the same however the table is cut into files.
    """
    start = LogBilinear(vocab).flat()
    if not vocab.n_tokens:
        return start
    passes = min(MOST_PASSES, max(1, math.ceil(LEAST / vocab.n_tokens)))
    state = np.concatenate([start, np.full(len(start), 1e-6, np.float32)])

    def learner(turn: int, state: np.ndarray):
        def learn(pdf):
            pdf = pdf.sort_values(["key", "units"])
            _, unit, before = unpacked(pdf["units"].tolist(), vocab)
            numbers, of_squares = np.split(state.copy(), 2)
            model, squares = LogBilinear(vocab, numbers), LogBilinear(vocab, of_squares).p
            copy = int(pdf["copy"].iloc[0])
            rng = np.random.default_rng([2, turn, copy])
            for _ in range(passes):
                order = rng.permutation(len(unit))
                model.train(before[:, order], unit[order], rng, squares)
            done = np.concatenate([model.flat(), LogBilinear(vocab, of_squares).flat()])
            cuts = range(0, len(done), BLOCK)
            return pd.DataFrame({"copy": copy, "n": len(unit), "block": [c // BLOCK for c in cuts], "part": [done[c : c + BLOCK].tobytes() for c in cuts]})

        return learn

    def mean(pdf):  # added in the copies' order, so that rounding is the same each time
        pdf = pdf.sort_values("copy")
        total = sum(np.frombuffer(p, np.float32).astype(np.float64) * n for p, n in zip(pdf["part"], pdf["n"]))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [(total / pdf["n"].sum()).astype(np.float32).tobytes()]})

    for turn in range(rounds):
        mine = encoded.where((F.col("round") == turn) & ~F.col("held_out")).select("copy", "key", "units")
        learnt = mine.groupBy("copy").applyInPandas(learner(turn, state), "copy long, n long, block int, part binary")
        blocks = learnt.groupBy("block").applyInPandas(mean, "block int, part binary").collect()
        if blocks:
            state = np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(blocks, key=lambda r: r["block"])])
    return state[: len(start)]


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document (doc_id, text).

    Every training word above a threshold (a count of 16 and 1 / 32,768 of the tokens) is a unit with embeddings
    and a bias of its own; the others share units by their last bytes. A log-bilinear network predicts the unit
    from those before; it is trained on all training texts with noise-contrastive estimation and normalised when
    scoring, over the groups and within the group. Within a shared unit, a word has its share of all training
    tokens there, and one share is left to words never seen. So the probabilities of all known words and of an
    unknown word per shared unit add up to 1.

    Counts are exact over all training tokens. Nothing depends on how the table is cut into partitions. Null and
    empty texts have one token, the end; very long ones are read whole. Without any training document the
    probabilities are the network's start. Repeated rows are scored each; extra columns are not read; an empty
    table gives no rows.
    """
    spark = documents.sparkSession
    n_bytes, n_docs = with_chunk(documents, 1).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    copies, rounds, chunks = plan(n_bytes)
    docs = with_chunk(documents, chunks)
    words = count_words(docs, chunks, shared_folder(spark, "words"))
    vocab = vocabulary(words, n_docs)
    encoded = encode(docs, words.select("chunk", "word", "count"), vocab, chunks, copies, rounds, shared_folder(spark, "units"))
    flat = train(encoded, vocab, rounds)

    def scored(frames):
        model = LogBilinear(vocab, flat)
        for pdf in frames:
            size = pdf["units"].map(len).cumsum() // 500_000
            for _, part in pdf.groupby(size, sort=False):
                n = len(part)
                doc, unit, before = unpacked(part["units"].tolist(), vocab)
                logs = np.bincount(doc, model.log_probs(before, unit), n) + part["inner"].to_numpy()
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").where(part["has_id"]), "held_out": part["held_out"], "n_tokens": part["n_tokens"], "n_known": part["n_known"],
                    "train_tokens": vocab.n_tokens, "base_score": part["base_score"], "score": logs / np.log(10),
                })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return encoded.select("doc_id", "has_id", "held_out", "n_tokens", "n_known", "base_score", "inner", "units").mapInPandas(scored, schema)


def op9_log_bilinear(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from all that are not held out."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
