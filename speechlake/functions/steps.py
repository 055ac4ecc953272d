"""Rules of live sessions that go row by row: each step takes (state, row) and gives (state, output)."""

from __future__ import annotations

import numpy as np

from ..params import DEFAULTS


def lock_language(state: tuple, row) -> tuple[tuple, str | None]:
    """state (language, chunks so far): adopts a language said with 0.6 or more, on the first chunk and every sixth."""
    language, n = state
    n += 1
    if (language is None or n == 1 or n % 6 == 0) and row.prob > 0.6:
        language = row.detected
    return (language, n), language


def baseline_tone(state: tuple, row) -> tuple[tuple, str]:
    """state (calm readings, pitch mean, pitch deviation, rate): tone against the session's calm speech so far."""
    n, mean, std, rate = state
    p = DEFAULTS
    if n >= p.tone_calm_least and mean > 0:
        slow, flat, fast, lively = rate * p.tone_slow_x, std * p.tone_flat_x, rate * p.tone_fast_x, std * p.tone_lively_x
    else:
        slow, flat, fast, lively = p.tone_slow, p.tone_flat, p.tone_fast, p.tone_lively
    if row.voiced < p.tone_voiced_s:
        read = "calm"
    else:
        read = "tired" if row.rate < slow and row.pitch_std < flat else "stressed" if row.rate > fast or row.pitch_std > lively else "calm"
    if read == "calm":
        new = (row.pitch_mean, row.pitch_std, row.rate)
        mean, std, rate = new if n == 0 else tuple(a + 0.2 * (b - a) for a, b in zip((mean, std, rate), new))
        n += 1
    return (n, mean, std, rate), read


class Vectors:
    """Vectors of one length that grow in place: a row more costs no copy of those before, on average."""

    def __init__(self, flat, n: int, size: int):
        self.n = n
        self.held = np.zeros((max(16, 2 * n), size))
        if n:
            self.held[:n] = np.asarray(flat, float).reshape(n, -1)

    @property
    def rows(self) -> np.ndarray:
        return self.held[: self.n]

    def add(self, vec: np.ndarray) -> None:
        if self.n == len(self.held):
            self.held = np.vstack([self.held, np.zeros_like(self.held)])
        self.held[self.n] = vec
        self.n += 1

    def flat(self) -> list[float]:
        return self.rows.ravel().tolist()


def pool_speech(state: tuple, row, threshold: float = 0.52) -> tuple[tuple, list[float]]:
    """state (centroids, turns and seconds per voice): [voice, seconds so far, *centroid] of the session's voice that is nearest.

    A turn near none is a new voice; voices keep their number. A centroid is the normalised mean of itself, as often
    as it has had turns, and the new turn. Centroids are flat at first and Vectors from then on; the state changes in
    place, so that a turn costs one comparison with each voice and nothing else grows with them.
    """
    known, turns, seconds = state
    vec = np.asarray(row.vec, float)
    if not isinstance(known, Vectors):
        known, turns, seconds = Vectors(known, len(turns), len(vec)), list(turns), list(seconds)
    sims = known.rows @ vec
    at = int(np.argmax(sims)) if len(sims) else 0
    if len(sims) and sims[at] >= threshold:
        mean = (known.rows[at] * turns[at] + vec) / (turns[at] + 1)
        known.rows[at] = mean / max(float(np.linalg.norm(mean)), 1e-6)
        turns[at] += 1
        seconds[at] += float(row.dur)
    else:
        at = len(turns)
        known.add(vec)
        turns.append(1)
        seconds.append(float(row.dur))
    return (known, turns, seconds), [float(at), seconds[at], *known.rows[at].tolist()]


def cut_chunk(state: tuple, row, threshold: float = 0.02, pause: float = 0.6, least: float = 1.2, most: float = 12.0) -> tuple[tuple, int]:
    """state (chunk, since, spoke, quiet since): the chunk of a sample; it ends after a pause, or at its longest."""
    chunk, since, spoke, quiet = state
    loud = row.rms > threshold
    since = row.at if since is None else since
    spoke = spoke or loud
    quiet = None if loud else row.at if quiet is None else quiet
    out = chunk
    if (row.at - since >= least and spoke and quiet is not None and row.at - quiet >= pause) or row.at - since >= most:
        chunk, since, spoke, quiet = chunk + 1, None, False, None
    return (chunk, since, spoke, quiet), out
