"""Hard negatives: the threshold algorithm against brute force, and where it stops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.llm import negatives

ROWS = "vec_id long, label int, embedding array<float>, mark string"


def brute(rows: list[tuple], every: int) -> set:
    """(anchor, positive, rank, negative, scores) of integer vectors."""
    out, rows = [], sorted({(i, l, tuple(v)) for i, l, v in rows})
    for i, label, v in rows:
        if i % every:
            continue
        scored = sorted((-int(np.dot(np.array(v, object), np.array(u, object))), j, m) for j, m, u in rows if len(u) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            fit = [(t, k) for t, k, m in scored if m != label and -80 * s <= -100 * t <= -100 * s]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit[:5])]
    return set(out)


@pytest.mark.parametrize("most_rows", [32_768, 37])
def test_hard_negatives_as_brute_force(spark, monkeypatch, most_rows):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 16)
    rng = np.random.default_rng(30)
    centers = rng.standard_normal((4, 6))
    x = centers[rng.integers(0, 4, 300)] + 0.3 * rng.standard_normal((300, 6))
    x[50:90] = np.round(x[50:90] * 2) / 2  # ties
    rows = [(i, int(rng.integers(0, 5)) if i % 3 else 0, [float(np.float32(v)) for v in r], "m") for i, r in enumerate(x)]
    rows += [rows[7], rows[20], (20, 3, rows[21][2], "m"), (400, 1, [0.0] * 6, "m"), (500, None, rows[1][2], "m"), (600, 1, None, "m"), (700, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0], "m")]
    rows += [(800, 1, [float("nan")] * 6, "m"), (900, 1, [float("inf")] * 6, "m"), (1000, 2, [], "m"), (1001, 2, [], "m"), (1002, 3, [], "m"), (1010, 1, [1.0, 2.0], "m"), (1011, 1, [2.0, 1.0], "m"), (1012, 2, [1.5, 1.5], "m"), (None, 1, rows[1][2], "m"), (2000, 4, [3e4] * 6, "m")]
    good = [(i, l, [int(np.floor(256 * e)) for e in v]) for i, l, v, _ in rows if i is not None and l is not None and v is not None and all(e is not None and np.isfinite(e) for e in v)]
    got = negatives.mine(negatives.quantised(spark.createDataFrame(rows, ROWS)), F.col("vec_id") % 20 == 0, most_rows=most_rows).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(good, 20)


def test_search_stops_at_the_threshold():
    rng = np.random.default_rng(31)
    x = rng.integers(-50, 50, (4000, 4))
    x[:20] = 1000 + rng.integers(0, 9, (20, 4))
    block = negatives.Block(np.arange(4000), np.zeros(4000, int), x)
    a = np.array([3, 1, 2, 5])
    (found,) = block.search(a, np.ones(4000, bool), [negatives.ANY], 5)
    scores = x @ a
    assert found == [(int(scores[i]), int(i)) for i in np.lexsort((np.arange(4000), -scores))[:5]]
    assert block.accessed < 200


def test_large_components_are_exact():
    x = np.array([[2**31, 2**31 - 1], [2**31 - 1, 2**31], [2**40, 1]])
    block = negatives.Block(np.arange(3), np.zeros(3, int), x)
    (found,) = block.search(np.array([2**31 - 1, 2**31 + 1]), np.ones(3, bool), [negatives.ANY], 3)
    assert dict((i, s) for s, i in found) == {i: int(x[i][0]) * (2**31 - 1) + int(x[i][1]) * (2**31 + 1) for i in range(3)}


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], ROWS)
    assert negatives.mine(negatives.quantised(empty), F.col("vec_id") % 20 == 0).count() == 0
