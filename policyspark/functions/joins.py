"""Join sides with a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows up to which a side is broadcast; beyond it the join is a merge.
BROADCAST_ROWS = 200_000


def side(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``rows`` with the hint that its size asks for; at most ``most`` + 1 rows are counted (BROADCAST_ROWS by default)."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("merge")
