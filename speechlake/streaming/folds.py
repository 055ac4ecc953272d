"""Sequential rules of live sessions (functions.steps) over a session's rows in order.

`batch` runs a step over a static DataFrame, `stream` over a streaming one with the state kept by Spark; both
give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.steps import Vectors, baseline_tone, cut_chunk, lock_language, pool_speech
from ..operators.folds import fold_rows

__all__ = ["baseline_tone", "batch", "cut_chunk", "lock_language", "pool_speech", "stream"]


def _run(step: Callable, state: tuple, pdf: pd.DataFrame, order: list[str]) -> tuple[tuple, list]:
    out = []
    for row in pdf.sort_values(order).itertuples(index=False):
        state, value = step(state, row)
        out.append((row.session, row.row_id, value))
    return state, out


def batch(df: DataFrame, step: Callable, start: tuple, schema: str, order: tuple[str, ...] = ("at", "row_id")) -> DataFrame:
    """df: session, row_id, at, ... -> session, row_id, value."""
    return fold_rows(df, ["session"], list(order), step, start, ["row_id"], f"value {schema}")


def stream(df: DataFrame, step: Callable, start: tuple, schema: str, state_schema: str, order: tuple[str, ...] = ("at", "row_id"), idle_ms: int | None = 3_600_000) -> DataFrame:
    """As batch, over a stream; a session's state goes after idle_ms without rows.

    A run that ends with what is there now needs idle_ms=None: with a timeout, Spark keeps making empty batches.
    """
    names = ["session", "row_id", "value"]

    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(columns=names)
            return
        rows = pd.concat(list(frames))
        held = tuple(_plain(x) for x in state.get) if state.exists else start
        held, out = _run(step, held, rows, list(order))
        state.update(tuple(_flat(x) for x in held))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    return df.groupBy("session").applyInPandasWithState(update, f"session long, row_id long, value {schema}", state_schema, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def _plain(x):
    return list(x) if isinstance(x, (list, np.ndarray)) else x


def _flat(x):
    return x.flat() if isinstance(x, Vectors) else x
