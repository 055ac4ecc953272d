"""Searches by vectors against brute force."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np

from speechlake.operators import retrieval as r

NAN = float("nan")


def brute(requests, speech, cap):
    """request -> [(speech, sim)], in the order of Spark: no number first, then by size, null last, ties by id."""
    out = {}
    for q, x in requests:
        sims = []
        for i, y in speech:
            if x is None or y is None or len(x) != len(y) or None in x or None in y:
                sims.append((2, 0.0, i, None))
                continue
            s = 0.0
            for a, b in zip(x, y):
                s += a * b
            sims.append((0, 0.0, i, s) if math.isnan(s) else (1, -s, i, s))
        out[q] = [(i, s) for _, _, i, s in sorted(sims, key=lambda z: z[:3])[:cap]]
    return out


def same(got, want):
    """Ids in order, and cosines to the last bit."""
    return got.keys() == want.keys() and all([i for i, _ in got[q]] == [i for i, _ in want[q]] and all(a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b)) for (_, a), (_, b) in zip(got[q], want[q])) for q in want)


def test_nearest_is_brute_force_for_odd_vectors_and_copies(spark):
    rng = np.random.default_rng(7)
    speech = [(i, rng.standard_normal(6).tolist()) for i in range(120)]
    speech += [(200 + i, speech[3][1]) for i in range(30)] + [(300, None), (301, []), (302, [1.0, 2.0]), (303, [None] + [1.0] * 5), (304, [NAN] + [0.5] * 5), (305, [math.inf, -math.inf] + [0.0] * 4), (306, [0.0] * 6)]
    requests = [(50 * i, speech[i][1]) for i in (1, 2, 3)] + [(1000, None), (1001, [1.0, 1.0]), (1002, [NAN] * 6), (1003, []), (1004, [0.0] * 6), (1005, [None] * 6)]
    left = spark.createDataFrame(requests, "request_id long, vec array<double>")
    right = spark.createDataFrame(speech, "speech_id long, vec array<double>").repartition(3)
    for cap, most, share in ((5, 4, 40), (20, 100, 1000), (200, 3, 17)):
        rows = r.nearest(left, right, cap, most=most, share=share).orderBy("request_id", "rk").collect()
        got = {}
        for x in rows:
            got.setdefault(x.request_id, []).append((x.speech_id, x.sim))
        assert same(got, brute(requests, speech, cap)), cap
    only = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "speech_id long")
    few = {x.speech_id for x in r.nearest(left, right, 9, only, most=4, share=40).collect()}
    assert few and all(i % 3 == 0 for i in few)


def test_pairs_never_become_rows_of_the_plan(spark):
    """A row for each pair of a request and speech made the search's tasks grow with the square of the table."""
    left = spark.range(3).selectExpr("id AS request_id", "array(1D, 2D) AS vec")
    right = spark.range(40).selectExpr("id AS speech_id", "array(1D, cast(id AS double)) AS vec")
    plan = r.nearest(left, right, 2, most=2, share=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "_set" not in plan and "CoGroupsInArrow" in plan


def test_text_leg_is_ranked_before_requests_join_it(spark):
    """A request's words are asked by many: matches are cut to 200 before they are given to each of them."""
    from speechlake.plans.catalogue import QUERIES

    plan = QUERIES["r06_hybrid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "Join Inner, (words" in x)
    below = [x for x in itertools.takewhile(lambda x: depth(x) > depth(lines[at]), lines[at + 1 :])]
    assert any(re.search(r"row_number\(\).*rank#\d+ DESC", x) for x in below)
