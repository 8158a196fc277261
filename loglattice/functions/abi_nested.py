"""Tuples and nested dynamic types: an Arrow function over the data of whole batches.

Offsets are counted from where the enclosing tuple, array or event begins. The
rules are those of ``abi``: an offset is a multiple of 32 within the data, a
length fits into 31 bits, and a value that breaks a rule makes the whole
argument null.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loglattice.functions.signature import Kind
from loglattice.functions.types import event_type

WORD = 32
MOST = (1 << 31) - 1


class Broken(ValueError):
    """A value that is not valid."""


def number_at(data: bytes, at: int) -> int:
    if at + WORD > len(data):
        raise Broken
    found = int.from_bytes(data[at : at + WORD], "big")
    if found > MOST:
        raise Broken
    return found


def place(data: bytes, base: int, at: int) -> int:
    """Where the offset word at ``at`` points to."""
    offset = number_at(data, at)
    if offset % WORD or base + offset > len(data):
        raise Broken
    return base + offset


def members(kinds: list[Kind], data: bytes, base: int) -> list:
    """Values whose heads stand one behind the other from ``base`` on."""
    out, at = [], base
    for kind in kinds:
        out.append(value_at(kind, data, place(data, base, at) if kind.dynamic else at))
        at += WORD * kind.words
    return out


def value_at(kind: Kind, data: bytes, at: int):
    """The value that begins at a byte."""
    if kind.element:
        n = kind.length
        if n is None:
            n, at = number_at(data, at), at + WORD
        if n * kind.element.words * WORD > len(data) - at:
            raise Broken
        return members([kind.element] * n, data, at)
    if kind.fields:
        return dict(zip((name for name, _ in kind.fields), members([own for _, own in kind.fields], data, at), strict=True))
    if kind.base in ("string", "bytes"):
        n = number_at(data, at)
        raw = data[at + WORD : at + WORD + n]
        if len(raw) < n:
            raise Broken
        return raw.decode("utf-8", "replace") if kind.base == "string" else raw
    word = data[at : at + WORD]
    if len(word) < WORD:
        raise Broken
    if kind.base == "address":
        return word[12:]
    if kind.base == "bool":
        if any(word[:-1]) or word[-1] > 1:
            raise Broken
        return word[-1] == 1
    fixed = re.match(r"^bytes(\d+)$", kind.base)
    return word[: int(fixed.group(1))] if fixed else word


def nested_at(data: Column, kind: Kind, head: int) -> Column:
    """The value of an argument whose head begins at a word of the event's data; null if it is not valid."""
    spark_type = event_type(kind)
    arrow_type = to_arrow_type(spark_type)

    def one(raw: bytes | None):
        try:
            return None if raw is None else value_at(kind, raw, place(raw, 0, WORD * head) if kind.dynamic else WORD * head)
        except Broken:
            return None

    return F.arrow_udf(lambda values: pa.array(map(one, values.to_pylist()), arrow_type), spark_type)(data)


def text_of(kind: Kind, value):
    """A value as JSON shows it: numbers as quoted digits, bytes as 0x text, tuples as objects."""
    if value is None:
        return None
    if kind.element:
        return [text_of(kind.element, v) for v in value]
    if kind.fields:
        return {name: text_of(own, value[name]) for name, own in kind.fields}
    if kind.base in ("bool", "string"):
        return value
    if kind.base.startswith(("uint", "int")):
        return str(int.from_bytes(value, "big", signed=kind.base[0] == "i"))
    return "0x" + value.hex()


def shown_type(kind: Kind):
    """The Spark type of ``shown``."""
    from pyspark.sql import types as T

    if kind.element:
        return T.ArrayType(shown_type(kind.element))
    if kind.fields:
        return T.StructType([T.StructField(name, shown_type(own)) for name, own in kind.fields])
    return T.BooleanType() if kind.base == "bool" else T.StringType()


def shown(value: Column, kind: Kind) -> Column:
    """A nested value with the texts that JSON is to show."""
    spark_type = shown_type(kind)
    arrow_type = to_arrow_type(spark_type)
    return F.arrow_udf(lambda values: pa.array((text_of(kind, v) for v in values.to_pylist()), arrow_type), spark_type)(value)


def value_of(kind: Kind, given):
    """The value that ``text_of`` shows so."""
    if given is None:
        raise Broken
    if kind.element:
        if kind.length not in (None, len(given)):
            raise Broken
        return [value_of(kind.element, v) for v in given]
    if kind.fields:
        return {name: value_of(own, given[name]) for name, own in kind.fields}
    if kind.base in ("bool", "string"):
        return given
    try:
        if kind.base.startswith(("uint", "int")):
            return int(given).to_bytes(WORD, "big", signed=kind.base[0] == "i")
        return bytes.fromhex(given.removeprefix("0x"))
    except (ValueError, OverflowError) as wrong:
        raise Broken from wrong


def read(value: Column, kind: Kind) -> Column:
    """A value out of the texts of ``shown``; null if one of them is not valid."""
    spark_type = event_type(kind)
    arrow_type = to_arrow_type(spark_type)

    def one(given):
        try:
            return value_of(kind, given)
        except Broken:
            return None

    return F.arrow_udf(lambda values: pa.array(map(one, values.to_pylist()), arrow_type), spark_type)(value)
