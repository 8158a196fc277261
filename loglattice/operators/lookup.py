"""Keyed lookups of events in state, routing, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.operators.latest import latest

#: A side is broadcast only if a count has shown it to have at most so many rows.
BROADCAST_ROWS = 100_000


def read_set(events: DataFrame, *keys: Column | str) -> DataFrame:
    """The distinct keys that a batch touches."""
    return events.select(*keys).distinct()


def lookup(events: DataFrame, history: DataFrame, keys: list[str], prefix: str = "state_") -> DataFrame:
    """Each event with the newest state of its key; ``found`` is false for keys without any.

    The state is cut to the batch's keys first (a semi join that Spark may do by
    a runtime filter), so its aggregation is no larger than the batch.
    """
    touched = history.join(read_set(events, *keys), keys, "left_semi")
    state = latest(touched, keys)
    renamed = state.select(*keys, *[F.col(f"`{c}`").alias(prefix + c) for c in state.columns if c not in keys], F.lit(True).alias("_found"))
    return events.join(renamed, keys, "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def in_set(rows: DataFrame, column: str, values: DataFrame | list, lower: bool = True) -> DataFrame:
    """Rows whose value is in a set; none means any. A list is a predicate of the scan, a table a semi join.

    The table is broadcast only where a count shows that it is small.
    """
    shown = F.lower(column) if lower else F.col(column)
    if isinstance(values, list):
        return rows.where(shown.isin(*[v.lower() if lower else v for v in values])) if values else rows
    name = values.columns[0]
    known = values.select((F.lower(name) if lower else F.col(name)).alias("_member")).distinct()
    if values.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return rows.join(known, shown == F.col("_member"), "left_semi")


def route(rows: DataFrame, exact: DataFrame, general: DataFrame, address: str = "address", event: str = "event_name") -> DataFrame:
    """Adds the table of an (address, event), or else of the event."""
    own = exact.select(F.col(address), F.col(event), F.col("table").alias("_own"))
    any_ = general.select(F.col(event), F.col("table").alias("_any"))
    return rows.join(own, [address, event], "left").join(any_, [event], "left").withColumn("table", F.coalesce("_own", "_any")).drop("_own", "_any")


def known_absent(keys: DataFrame, tombstones: DataFrame, on: list[str]) -> DataFrame:
    """Keys that no lookup has found absent before."""
    return keys.join(tombstones, on, "left_anti")


def ceil_block(blocks: DataFrame, block: int) -> DataFrame:
    """The first block there is at or behind a number, and the last of all: a gap up to the last is known to be empty."""
    number = F.col("block_number")
    return blocks.agg(F.min(F.when(number >= block, number)).alias("ceil_block"), F.max(number).alias("last_block"))


def common_ancestor(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Of two chains (number, hash) the last block they share before their hashes first differ, and how many they share.

    Heights that only one chain has are passed over; ``ancestor`` is null where nothing is shared.
    """
    met = ours.join(theirs.select("number", F.col("hash").alias("_other")), "number")
    parted = met.agg(F.min(F.when(~F.col("hash").eqNullSafe(F.col("_other")), F.col("number")))).first()[0]
    shared = met if parted is None else met.where(F.col("number") < parted)
    return shared.agg(F.max("number").alias("ancestor"), F.count("*").alias("shared"))
