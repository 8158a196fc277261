"""Contract types and state-field types as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from loglattice.functions.signature import Kind

#: 256-bit numbers are 32 bytes, most significant first, so that they sort as numbers.
WORD = T.BinaryType()

STATE_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint": T.DecimalType(20, 0),
    "uint64": T.DecimalType(20, 0),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "int": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "time": T.TimestampType(),
    "address": T.BinaryType(),
    "hash": T.BinaryType(),
    "uint256": WORD,
    "decimal": T.DecimalType(38, 18),
    "decimal256": WORD,
    "bytes": T.BinaryType(),
}


def event_type(kind: Kind) -> T.DataType:
    """The Spark type of a contract type: arrays, tuples as structs, numbers and bytes as BINARY."""
    if kind.element:
        return T.ArrayType(event_type(kind.element))
    if kind.fields:
        return T.StructType([T.StructField(name, event_type(own)) for name, own in kind.fields])
    return {"bool": T.BooleanType(), "string": T.StringType()}.get(kind.base, T.BinaryType())


def state_type(kind: str) -> T.DataType:
    """The Spark type of a state field; ``[]T`` is an array, ``*T`` may be null, others are text."""
    if kind.startswith("[]") and kind != "[]byte":
        return T.ArrayType(state_type(kind[2:]))
    if kind == "[]byte":
        return T.BinaryType()
    return STATE_TYPES.get(kind.lstrip("*").lower(), T.StringType())


METADATA: dict[str, T.DataType] = {
    "chain_id": T.LongType(),
    "block_number": T.LongType(),
    "block_timestamp": T.TimestampType(),
    "block_hash": T.StringType(),
    "contract_address": T.BinaryType(),
    "transaction_hash": T.BinaryType(),
    "transaction_index": T.LongType(),
    "log_index": T.LongType(),
}
ALWAYS = ("block_number", "block_timestamp", "transaction_index", "log_index")
ORDER = ("block_number", "transaction_index", "log_index")
