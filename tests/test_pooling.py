"""Pooled voices of long sessions."""

from __future__ import annotations

import time
from types import SimpleNamespace

import numpy as np

from speechlake.functions.steps import pool_speech


def test_a_turn_costs_no_copy_of_all_voices():
    """4,000 turns of as many voices, by a plain loop; all voices were copied to lists and back at every turn."""
    x = np.random.default_rng(5).standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[3000:3100] = x[:100]
    state, out, began = ([], [], []), [], time.process_time()
    for vec in x:
        state, said = pool_speech(state, SimpleNamespace(vec=vec, dur=1.0))
        out.append(int(said[0]))
    assert time.process_time() - began < 20
    known, turns, want = np.zeros((4000, 64)), [], []
    for vec in x:
        sims = known[: len(turns)] @ vec
        at = int(sims.argmax()) if turns and sims.max() >= 0.52 else len(turns)
        if at == len(turns):
            turns.append(0)
            known[at] = vec
        else:
            mean = (known[at] * turns[at] + vec) / (turns[at] + 1)
            known[at] = mean / np.linalg.norm(mean)
        turns[at] += 1
        want.append(at)
    assert out == want and state[1] == turns and max(turns) > 1


def test_state_goes_on_from_its_flat_form():
    """What the store holds between batches is lists; the rows after it are as if there had been one batch."""
    rows = [SimpleNamespace(vec=v, dur=1.0) for v in ([1.0, 0.0], [0.0, 1.0], [0.8, 0.6], [0.28, 0.96])]
    start = ([], [], [])
    state, whole = start, []
    for row in rows:
        state, said = pool_speech(state, row)
        whole.append(said)
    assert start == ([], [], [])
    state, parts = start, []
    for row in rows:
        state, said = pool_speech(state, row)
        state = (state[0].flat(), state[1], state[2])
        parts.append(said)
    assert parts == whole
