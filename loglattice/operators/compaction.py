"""History compaction, rollback and expiry: which rows of a table stay.

Nothing is deleted row by row. The rows that stay are a query, and tables are
partitioned by stretches of blocks, so that a rewrite touches only the stretches
that change (``operators.tables``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.functions.types import ORDER
from loglattice.operators.latest import latest_by_bucket

#: Blocks below the head that compaction leaves alone.
MARGIN = 1000


def window(lower: int, head: int, interval: int, margin: int = MARGIN) -> tuple[int, int] | None:
    """The blocks above the first and up to the second that may be compacted, or None."""
    if interval <= 0 or head <= margin or head - margin <= lower:
        return None
    return lower, head - margin


def compacted(log: DataFrame, keys: list[str], interval: int, head: int, lower: int = 0, margin: int = MARGIN) -> DataFrame:
    """The rows of a history that stay: outside the window all, inside of each key and stretch the newest.

    The keep-set is small and keyed by position, so both joins are on keys; a
    row is dropped if its key is in the window and it is not kept.
    """
    span = window(lower, head, interval, margin)
    if span is None:
        return log
    inside = (F.col("block_number") > span[0]) & (F.col("block_number") <= span[1])
    keep = latest_by_bucket(log.where(inside).select(*keys, *ORDER), keys, interval)
    dropped = log.where(inside).select(*keys, *ORDER).join(keep, [*keys, *ORDER], "left_anti").distinct()
    return log.join(dropped, [*keys, *ORDER], "left_anti").select(*log.columns)


def rolled_back(rows: DataFrame, block: int, chain_id: int | None = None) -> DataFrame:
    """The rows at or below a block; of other chains all."""
    keep = F.col("block_number") <= block
    if chain_id is not None and "chain_id" in rows.columns:
        keep = keep | (F.col("chain_id") != chain_id)
    return rows.where(keep)


def truncated(sync: DataFrame, block: int, chain_id: int) -> DataFrame:
    """Checkpoints of a chain below a block are dropped."""
    return sync.where((F.col("chain_id") != chain_id) | (F.col("last_block") >= block))


def unexpired(rows: DataFrame, now, days: int = 7, time: str = "ts") -> DataFrame:
    """Rows of the last days up to ``now`` (a timestamp or a column)."""
    end = now if hasattr(now, "isNull") else F.lit(now)
    return rows.where(F.col(time) >= end - F.expr(f"INTERVAL {int(days)} DAYS"))


def collapsed(rows: DataFrame, sign: str = "sign") -> DataFrame:
    """Rows whose signs do not cancel: rollback by appending the negated row."""
    own = [c for c in rows.columns if c != sign]
    return rows.groupBy(*own).agg(F.sum(sign).alias(sign)).where(F.col(sign) > 0)


def negated(rows: DataFrame, block: int, sign: str = "sign") -> DataFrame:
    """What to append so that everything above a block collapses."""
    return rows.where(F.col("block_number") > block).withColumn(sign, -F.col(sign))
