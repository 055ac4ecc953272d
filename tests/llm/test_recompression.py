"""Repeated passages: consistent symbols, digests of windows, and removal against brute force."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pytest

from speechlake.llm import recompression
from speechlake.llm.shingles import word_hashes

DOCS = "doc_id long, text string, names string, first long"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows: list[tuple], window: int) -> list[tuple]:
    first: dict = {}
    split = [(i, words_of(t)) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        off = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                off |= set(range(k, k + window))
        out.append((i, len(w), len(off), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in off).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_with_repeats(seed: int, n: int) -> list[tuple]:
    """Plain texts, copies, edits, shared passages of all lengths about a window, runs, periods and odd rows."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    text = lambda k: rng.choice(vocabulary, k).tolist()
    passages = [text(k) for k in (48, 49, 50, 51, 60, 120)] + [["of"] * 70, ["a", "b"] * 40, ["x", "y", "z"] * 30]
    rows: list = []
    for i in range(n):
        w = text(int(rng.integers(0, 200)))
        for _ in range(int(rng.integers(0, 3))):
            at, p = int(rng.integers(0, len(w) + 1)), passages[int(rng.integers(len(passages)))]
            w[at:at] = p[: int(rng.integers(45, len(p) + 1))]
        rows.append((i * 3, " ".join(w)))
    for i in range(n // 4):  # copies and edited copies
        w = words_of(rows[int(rng.integers(n))][1])
        for _ in range(int(rng.integers(0, 4))):
            if w:
                w[int(rng.integers(len(w)))] = "edit"
        rows.append((10_000 + i if i % 2 else i * 3 + 1, "\n".join(w) + "  "))
    rows += [(20_000, None), (20_001, ""), (20_002, " \t"), (None, rows[5][1]), (20_003, "of " * 3000), (20_004, "of " * 2000), (20_005, "é " * 60), (20_006, "é  " * 60), rows[7], rows[7], (rows[8][0], rows[9][1])]
    return rows


@pytest.mark.parametrize("window", [50, 12])
def test_repeats_as_brute_force(spark, window):
    rows = rows_with_repeats(40, 120)
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], DOCS)
    got = recompression.drop_repeats(docs, window).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, window)
    assert recompression.drop_repeats(docs.limit(0), window).count() == 0


def test_what_is_left_of_changed_texts(spark):
    rows = rows_with_repeats(41, 30)
    got = recompression.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50, with_text=True).collect()
    assert any(r.n_removed for r in got)
    for r in got:
        assert (r.kept_text is None) == (r.n_removed == 0)
        if r.kept_text is not None:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and len(words_of(r.kept_text)) == r.n_words - r.n_removed


def test_equal_passages_hold_equal_symbols():
    """Every symbol whose context lies within a shared passage stands in both texts, at the same place of it."""
    rng = np.random.default_rng(42)
    for passage in ([f"p{k}" for k in rng.integers(0, 30, 200)], ["r"] * 90 + ["s", "t"] * 50, [f"q{k}" for k in rng.integers(0, 2, 150)]):
        found = []
        for _ in range(4):
            before, after = ([str(rng.choice(["r", "s", "q0", "q1", "p3", "z"])) for _ in range(int(rng.integers(0, 40)))] for _ in range(2))
            _, words, _ = word_hashes([" ".join(before + passage + after)])
            s = recompression.recompressed(words, np.array([0]))
            inside = (s.low >= len(before)) & (s.high <= len(before) + len(passage))
            found.append(collections.Counter(zip(s.name[inside].tolist(), (s.low[inside] - len(before)).tolist(), (s.high[inside] - len(before)).tolist())))
        assert all(f == found[0] for f in found)


def test_window_digests_follow_words():
    _, words, _ = word_hashes(["a b c d a b c e a b"])
    a, b = recompression.sums_of(words, 3)
    assert len(a) == 8 and (a[0], b[0]) == (a[4], b[4]) and len(set(zip(a.tolist(), b.tolist()))) == 7
    assert len(recompression.sums_of(words, 11)[0]) == 0 == len(recompression.sums_of(words[:0], 3)[0])
    assert recompression.covered(np.array([True, False, False, False, True, False, False, False]), 3).tolist() == [True] * 3 + [False] + [True] * 3 + [False]
