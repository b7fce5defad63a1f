"""Joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def bounded(frame: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a derived table for broadcast only when its row count is small.

    The table is kept in executor storage, so measuring it does not compute it
    twice. Beyond the bound the unhinted table is returned and the join shuffles
    (adaptive execution splits skewed partitions).
    """
    kept = frame.persist()
    if kept.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(kept)
    return kept


def join_bounded(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    return big.join(bounded(small, max_rows), list(keys), how)


def require_unique(frame: DataFrame, keys: Sequence[str], name: str) -> None:
    """Raise when a join side that must hold one row per key does not."""
    duplicate = frame.groupBy(*keys).count().where("count > 1").limit(1)
    if not duplicate.isEmpty():
        raise ValueError(f"{name} has more than one row per {tuple(keys)}")
