"""Work per row on every core, whatever the files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows out by ``keys`` before work that costs much for each of them.

    The splits of a source say little about its rows (a file may be one row group), so they are always dealt. The
    planner sizes the tasks by the bytes that were shuffled: they become more as the input grows, a key with very many
    rows is split, and small inputs stay in few tasks. Nothing but the speed depends on it."""
    return df.hint("rebalance", *keys)
