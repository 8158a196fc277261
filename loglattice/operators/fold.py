"""Folding events into keyed state: declarative sums, ordered folds, and user folds.

Commutative folds are aggregations. An ordered fold sorts the rows of a key
inside a partition and streams them through a Python function; rows are never
gathered: state is one value a key, so a key of any size takes bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions import u256
from loglattice.functions.dec256 import truncated
from loglattice.functions.types import ORDER
from loglattice.operators.latest import position

if TYPE_CHECKING:
    from loglattice.plans.project import StateSpec

ZERO_ADDRESS = bytes(20)


def transfer_positions(transfers: DataFrame, sender: str = "from", receiver: str = "to", value: str = "value") -> DataFrame:
    """Totals in and out, transfers, and the last position of each address.

    Transfers from and to the zero address count on one side only; one to
    oneself counts twice. One pass: a value is cut into limbs once, each transfer
    gives its two sides, and a hash aggregation sums them in the map tasks.
    """
    sides = F.array(
        F.struct(F.col(f"`{sender}`").alias("address"), F.lit(False).alias("received")),
        F.struct(F.col(f"`{receiver}`").alias("address"), F.lit(True).alias("received")),
    )
    where = ["block_number", "transaction_index", "log_index", "block_timestamp"]
    cut = transfers.select(F.col(f"`{sender}`"), F.col(f"`{receiver}`"), u256.limbs(F.col(f"`{value}`")).alias("limbs"), position(transfers, ORDER).alias("at"), *where)
    flat = cut.select(F.inline(sides), "limbs", "at", *where).where(F.col("address") != F.lit(ZERO_ADDRESS))

    def total(received: bool) -> list[Column]:
        side = F.col("received") if received else ~F.col("received")
        return [F.sum(F.when(side, F.col(f"limbs.l{k}")).otherwise(F.lit(0))) for k in range(u256.LIMBS)]

    sums = {f"{name}{k}": c for name, received in (("in", True), ("out", False)) for k, c in enumerate(total(received))}
    found = flat.groupBy("address").agg(*[c.alias(n) for n, c in sums.items()], F.count("*").alias("transfer_count"), *[F.max_by(c, "at").alias(c) for c in where])
    whole = {name: u256.from_limbs([F.col(f"{name}{k}") for k in range(u256.LIMBS)]) for name in ("in", "out")}
    return found.select(
        "address", whole["in"].alias("total_in"), whole["out"].alias("total_out"), "transfer_count", F.col("block_number").alias("updated_at_block"), F.col("block_timestamp").alias("updated_at"), *ORDER
    )


def balance(total_in: Column, total_out: Column) -> Column:
    """In less out, as a signed number in decimal."""
    return u256.to_signed_text(u256.sub(total_in, total_out))


#: What a fold stamps from the event it is at, where the schema has the field and the step does not give it.
STAMPS = {
    "block_number": "block_number", "updated_at_block": "block_number", "block_timestamp": "block_timestamp", "updated_at": "block_timestamp",
    "transaction_index": "transaction_index", "tx_index": "transaction_index", "log_index": "log_index",
}


def stamp(state: dict, row: dict, kinds: dict[str, T.DataType]) -> dict:
    """The position and the time of the event; a time field that is a number gets milliseconds since 1970."""
    for name, source in STAMPS.items():
        if name in kinds and source in row:
            value = row[source]
            if isinstance(value, datetime) and isinstance(kinds[name], T.LongType):
                value = int(value.replace(tzinfo=value.tzinfo or UTC).timestamp() * 1000)
            state[name] = value
    return state


def ordered_fold(
    rows: DataFrame, keys: list[str], step: Callable[[dict | None, dict], dict], schema: str | T.StructType, every: bool = False, order: tuple[str, ...] = ORDER, before: DataFrame | None = None, columnar: bool = False
) -> DataFrame:
    """``step(state, row)`` over the rows of each key in order; the last state of each key, or every state.

    ``schema`` names the keys and the fields of a state. A step gets None for a
    key's first row, or the key's row of ``before``; keys without rows give
    nothing. ``columnar``: a step gets the rows of a key within an Arrow batch at
    once, as a record batch. All rows of a key stand in one partition, one at a
    time; the state is stamped (``STAMPS``) with the last event.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names, kinds = schema.fieldNames(), {f.name: f.dataType for f in schema.fields}
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    fields, given = [n for n in names if n not in keys], rows.columns
    if before is not None:  # the state before is the first row of its key
        held = before.select(*[F.col(f"`{k}`") for k in keys], F.struct(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) for n in fields]).alias("_held"))
        rows = held.unionByName(rows.withColumn("_held", F.lit(None).cast(held.schema["_held"].dataType)), allowMissingColumns=True)
        first = [F.col("_held").isNull()]
    else:
        first = []

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        own = list(zip(*[batch.column(k).to_pylist() for k in map(batch.schema.get_field_index, keys)], strict=True))
        start = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or own[k] != own[start]:
                yield start, k
                start = k

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, moved = None, None, False
        for batch in batches:
            out = []
            for start, end in runs(batch):
                part = batch.slice(start, end - start)
                records = part.to_pylist()
                key = tuple(records[0][k] for k in keys)
                if key != now:
                    if moved and not every:
                        out.append(dict(zip(keys, now, strict=True)) | state)
                    now, state, moved = key, None, False
                if records[0].get("_held") is not None:
                    state, records, part = dict(records[0]["_held"]), records[1:], part.slice(1)
                if columnar and records:
                    state, moved = stamp(dict(step(state, part.select(given))), records[-1], kinds), True
                    records = records[-1:] if every else []
                for row in records:
                    if not columnar:
                        state, moved = stamp(dict(step(state, row)), row, kinds), True
                    if every:
                        out.append({k: row[k] for k in keys} | state)
            if out:
                yield _rows(out)
        if moved and not every:
            yield _rows([dict(zip(keys, now, strict=True)) | state])

    def _rows(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], arrow.field(n).type) for n in names], names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *first, *order).mapInArrow(work, schema)


def state_fold(state: StateSpec, table: str, keys: dict[str, str], step: Callable[[dict | None, dict], dict], columnar: bool = False) -> Callable[[DataFrame, dict[str, DataFrame]], DataFrame]:
    """The processor of a state that folds one event's rows: ``keys`` names the event's column of each key."""

    def process(before: DataFrame, events: dict[str, DataFrame]) -> DataFrame:
        rows = events[table]
        for key, column in keys.items():
            rows = rows.withColumn(key, F.col(f"`{column}`"))
        return ordered_fold(rows, list(state.key), step, state.schema, before=before, columnar=columnar)

    return process


def weighted_average(quantity: int, price: int, amount: int, average: int) -> int:
    """The average price after buying, cut towards zero; the old one if nothing is held."""
    held = quantity + amount
    return truncated(quantity * price + amount * average, held) if held else average


def trade_step(state: dict | None, row: dict) -> dict:
    """Buying moves the average price, selling realises the difference; whole numbers."""
    state = dict(state or {"amount": 0, "average": 0, "realised": 0, "trades": 0})
    quantity, price = row["quantity"], row["price"]
    if quantity >= 0:
        state["average"] = weighted_average(quantity, price, state["amount"], state["average"])
    else:
        state["realised"] += -quantity * (price - state["average"])
    state["amount"] += quantity
    state["trades"] += 1
    return state
