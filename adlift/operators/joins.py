"""Joining per-group statistics back to rows.

Statistics tables keyed by a low-cardinality column (a category, a fold, a
feature name) must not be shuffle-joined: hash partitioning on four
category values would route every row to four reducer tasks.  They are
broadcast instead — explicitly when their size is bounded by construction
(``join_bounded``), or after a row-count check with a shuffle join beyond the
bound (``join_small``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest statistics table broadcast after a check (rows; each row is a few numbers).
MAX_BROADCAST_ROWS = 200_000


def join_bounded(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Broadcast join with a table whose row count is bounded by construction
    (folds, feature lists, fixed category lists, hash buckets)."""
    return big.join(F.broadcast(small), on, how)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join a statistics table of unknown size: it is computed once and
    checkpointed to the shared folder (lineage cut, no recomputation), its
    rows are counted, and it is broadcast only within ``max_rows``; beyond
    that the join shuffles and AQE splits skewed partitions."""
    from adlift.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(small.sparkSession)
    small = small.checkpoint(eager=True)
    if small.count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
