"""Optional filters and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that are searched for a part of their text; others are compared.
SEARCHED = ("text", "filename", "name")


def filter_rows(df: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every filter that is given (None is none). A searched text takes % and _ as SQL does.

    has_x=True or False asks whether x_id is known.
    """
    for name, value in wanted.items():
        if value is None:
            continue
        if name.startswith("has_"):
            known = F.col(f"{name[4:]}_id").isNotNull()
            df = df.where(known if value else ~known)
        elif name in SEARCHED:
            df = df.where(F.col(name).ilike(f"%{value}%"))
        else:
            df = df.where(F.col(name) == value)
    return df


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def topk_per_key(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key, with rank from 1."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
