"""The vectors nearest to others within one group of rows, as array arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cosines that are held at a time.
PAIRS = 4_000_000


def by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (places, matrix) of the vectors without a null; places of the others are in none."""
    flat = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(flat), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.flatten()  # null vectors have no values in it
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    if values.null_count:
        holed = np.searchsorted(starts, np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)), side="right") - 1
        # of equal starts the last one has the value
        sizes[holed] = -1
    x = values.to_numpy(zero_copy_only=False).astype(float)
    out = {}
    for n in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == n)
        out[int(n)] = at, x[starts[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0))
    return out


def nearest_of(own: pa.Table, asks: pa.Table, k: int) -> pa.Table:
    """own (speech_id, vec), asks (request_id, vec) -> request_id, speech_id, sim: the k rows of own with the largest sims, ties by id.

    Matrix products find the rows that may be among them; their sims are then summed component by component, so that
    they do not depend on where a row stands. Sims that are no number come first, missing ones last, as in Spark's order.
    """
    own = own.take(pc.array_sort_indices(own["speech_id"].combine_chunks(), order="ascending")) if own.num_rows else own
    rows = by_length(own["vec"])
    asked, found, sims = [], [], []

    def give(r, c, s):
        asked.append(r)
        found.append(c)
        sims.append(s)

    left = np.ones(asks.num_rows, bool)
    for n, (at, q) in by_length(asks["vec"]).items():
        left[at] = False
        here, v = rows.get(n, (np.zeros(0, int), np.zeros((0, n))))
        rest = np.setdiff1d(np.arange(own.num_rows), here, assume_unique=True)[:k]
        if len(rest):
            give(np.repeat(at, len(rest)), np.tile(rest, len(at)), np.full(len(at) * len(rest), None, object))
        step = max(1, PAIRS // max(1, len(here)))
        for i in range(0, len(at) if len(here) else 0, step):
            r, c, s = best_pairs(q[i : i + step], v, k)
            give(at[i : i + step][r], here[c], s.astype(object))
    lone, first = np.flatnonzero(left), np.arange(min(k, own.num_rows))
    give(np.repeat(lone, len(first)), np.tile(first, len(lone)), np.full(len(lone) * len(first), None, object))
    pick = lambda column, places: column.combine_chunks().take(pa.array(np.concatenate(places).astype(np.int64)))
    made = pa.array(np.concatenate(sims), pa.float64(), from_pandas=False)
    return pa.table({"request_id": pick(asks["request_id"], asked), "speech_id": pick(own["speech_id"], found), "sim": made})


def best_pairs(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, sim) of the k rows of v with the largest dot product with each row of q, ties by place."""
    with np.errstate(all="ignore"):
        near = q @ v.T
        may = ~np.isfinite(near)
        near[may] = np.inf
        if k < len(v):
            size = np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)).max()
            least = np.partition(near, len(v) - k, axis=1)[:, len(v) - k] - 1e-12 * max(1, v.shape[1]) * size
            # infinite ones may be no number; all of their row are looked at
            may |= ~(near < np.where(np.isfinite(least), least, -np.inf)[:, None])
        else:
            may[:] = True
        r, c = np.nonzero(may)
        s = np.zeros(len(r))
        for x, y in zip(q.T, v.T):
            s += x[r] * y[c]
        order = np.lexsort((c, -np.where(np.isnan(s), 0, s), ~np.isnan(s), r))
        r, c, s = r[order], c[order], s[order]
        kept = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
    return r[kept], c[kept], s[kept]
