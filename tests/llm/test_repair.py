"""Conversation repair: the auction against plain dynamic programming, pieces against wholes, the query against brute force."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from speechlake.llm import repair

TURNS = "conv_id long, turn long, role string, text string, extra string"


def cheapest(signature: str) -> tuple[int, str]:
    """Least (cost, audit) by a table over rows and states, forward."""
    at = {0: (0, "")}
    for c in [*signature, None]:
        for _ in range(2):  # inserts before the row, or at the end
            for q, (cost, audit) in list(at.items()):
                to = {0: 2, 1: 2, 2: 3, 3: 2}[q]
                at[to] = min(at.get(to, (10**9, "")), (cost + 2, audit + "I"))
        if c is None:
            break
        new: dict = {}

        def put(q, cost, audit):
            new[q] = min(new.get(q, (10**9, "")), (cost, audit))

        for q, (cost, audit) in at.items():
            put(q, cost + 3, audit + "D")
            if c not in "bd":
                more = c.isupper()
                put({0: 2, 1: 2, 2: 3, 3: 2}[q], cost + 2 + more, audit + "R")
                if c.lower() in {0: "su", 1: "u", 2: "a", 3: "u"}[q]:
                    put("-sua".index(c.lower()), cost + more, audit + "K")
        at = new
    return min(at[q] for q in (0, 3) if q in at)


def signatures(n: int, longest: int):
    rng = np.random.default_rng(20)
    for _ in range(n):
        yield "".join(rng.choice(list("bdsuaxSUAX"), int(rng.integers(0, longest)), p=[0.06, 0.06, 0.06, 0.25, 0.25, 0.06, 0.06, 0.1, 0.06, 0.04]))


def test_auction_finds_the_cheapest_and_least():
    for s in [*signatures(1500, 14), *signatures(60, 200), "u" * 300, "a" * 300, "d" * 200, "ua" * 200, "x" * 100]:
        assert repair.repair(s) == cheapest(s), s


@pytest.mark.parametrize("size", [1, 3, 40])
def test_pieces_join_to_the_whole(size):
    for s in [*signatures(300, 30), *signatures(20, 200)]:
        parts = [s[i : i + size] for i in range(0, len(s), size)]
        if not parts:
            continue
        cost, exits = repair.piece_exits([repair.piece_costs(p) for p in parts])
        state, out = 0, ""
        for p, e in zip(parts, exits):
            ways, ends = repair.piece_ways(p, e)
            out, state = out + ways[state], ends[state]
        assert (cost, out + repair.TAILS[state]) == cheapest(s), s


def brute(rows: list[tuple]) -> dict:
    """The contract over (conv_id, turn, role, text) rows, after damage."""
    ids = {r[0] for r in rows}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
        by[c] += [(t, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for c in ids:
        here = sorted(by[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marks = set(), ""
        for _, role, text in here:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            letter = role[:1] if role[:1] in set("sua") else "x"
            marks += "b" if not shown else "d" if (role, text) in seen else letter if shown[-1] in ".!?" else letter.upper()
            seen.add((role, text))
        turns = [t for t, _, _ in here if t is not None]
        cost, audit = cheapest(marks)
        lines, state, k = [], 0, 0
        for e in audit:
            role, text = (None, None) if e == "I" else here[k][1:]
            k += e != "I"
            if e in "IR":
                state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                lines.append(f"{'user' if state == 2 else 'assistant'}:{'' if e == 'I' else text}")
            elif e == "K":
                state = "-sua".index(role[0])
                lines.append(f"{role}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(here, here[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, marks.count("b"), marks.count("d"), sum(m in "SUAX" for m in marks), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("piece_bits", [12, 2])
def test_repair_as_brute_force(spark, monkeypatch, piece_bits):
    monkeypatch.setattr(repair, "PIECE_BITS", piece_bits)
    rng = np.random.default_rng(21)
    texts = ["Hi.", "ok", "so?\n", "", " \t", "x!", "é…", "a.b"]
    rows = [(int(rng.integers(0, 40)), int(rng.integers(0, 12)), str(rng.choice(["user", "assistant", "system", "tool"], p=[0.4, 0.4, 0.1, 0.1])), str(rng.choice(texts))) for _ in range(300)]
    rows += [(50, None, "user", "q."), (50, None, None, None), (50, 3, "", "x."), (None, 1, "user", "lone."), (None, None, "assistant", "y"), (51, 0, "user", "z" * 300_000), (52, 5, "system", None)]
    rows += [(60, t, "user" if t % 3 else "assistant", f"t{t % 40}.") for t in range(200)] + [(61, 7, "user", "same.")] * 30
    df = spark.createDataFrame([(*r, "e") for r in rows], TURNS).withColumn("at", repair.F.lit("clash"))
    want = brute(rows)
    got = repair.repaired(repair.damaged(df), df, digest=True).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[f] for f in FIELDS) == want[r.conv_id], (r.conv_id, r.audit)
    made = collections.defaultdict(list)
    for r in sorted(repair.repaired(repair.damaged(df), df).collect(), key=lambda r: r.place):
        made[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(made[c]).encode()).hexdigest() == w[-1] for c, w in want.items())


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.repaired(repair.damaged(empty), empty, digest=True).count() == 0
    assert repair.repaired(repair.damaged(empty), empty).count() == 0


def test_repair_query_as_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in repair.op11_auction_repair(spark, sf).collect()}
    assert got == brute(rows)
