"""Recurrences over rows in order, where what a row says depends on what was said of all rows before it."""

from __future__ import annotations

import copy
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def fold_rows(rows: DataFrame, keys: list[str], order: list[str], step: Callable, start: tuple, keep: list[str], out: str) -> DataFrame:
    """keys, keep and the columns out (as DDL): what step says of each row, its key's rows taken in order.

    step takes (state, row) and gives (state, value), or a tuple of values where out has several columns; start is
    the state before a key's first row. Rows are sorted within partitions and streamed through a task in batches,
    with the state carried from batch to batch: time is linear in a key's rows and memory is one batch, however
    many rows a key has. keys may not be null.
    """
    made = [f.name for f in StructType.fromDDL(out).fields]
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (*keys, *keep)), out])
    names = [*keys, *keep, *made]

    def run(frames):
        last, state = None, None
        for pdf in frames:
            said = []
            for row, key in zip(pdf.itertuples(index=False), zip(*(pdf[k] for k in keys))):
                if key != last:
                    last, state = key, copy.deepcopy(start)
                state, value = step(state, row)
                said.append(value)
            res = pdf[[*keys, *keep]].copy()
            for i, name in enumerate(made):
                res[name] = pd.Series([v[i] for v in said] if len(made) > 1 else said, index=res.index, dtype=object)
            yield res[names]

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
