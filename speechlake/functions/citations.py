"""Ids of speech that an answer cites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A UUID in any case, not part of a longer word.
SPEECH_ID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"


def cited_ids(text: Column) -> Column:
    """The ids in a text, each spelling once, in the order of first appearance; none for a null text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPEECH_ID), F.lit(0)))


def citations(answer: Column, sources: Column, most: int = 6) -> Column:
    """What an answer cites, else the first few of the ids that it was given, each once."""
    cited = cited_ids(answer)
    given = F.slice(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))), 1, most)
    return F.when(F.size(cited) > 0, cited).otherwise(given)
