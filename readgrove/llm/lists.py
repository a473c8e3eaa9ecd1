"""Joins against lists of ids whose size is counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a narrow list that a join sends whole to every executor, some tens of MB.
LIST_ROWS = 500_000


def counted(ids: DataFrame, limit: int = LIST_ROWS) -> DataFrame:
    """The list with a broadcast hint if its counted rows allow it, else for a shuffled join."""
    return F.broadcast(ids) if ids.count() <= limit else ids.hint("merge")
