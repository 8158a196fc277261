"""Hexadecimal text and topic words as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_bytes(text: Column) -> Column:
    """Bytes of hexadecimal text: a prefix 0x may stand before it, an odd number of
    digits gets a leading 0, and reading stops at the first other character. Null is empty."""
    # unhex puts the 0 before an odd number of digits itself.
    return F.unhex(F.regexp_extract(F.coalesce(text, F.lit("")), r"^(?:0[xX])?([0-9a-fA-F]*)", 1))


def hex_text(value: Column) -> Column:
    """Lower-case digits behind 0x."""
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def fixed(value: Column, n: int) -> Column:
    """Exactly n bytes: zeros to the right, or cut."""
    return F.substring(F.rpad(value, n, F.lit(b"\x00")), 1, n)


def word(topic: Column) -> Column:
    """A topic as 32 bytes: zeros to the left, or its last 32."""
    raw = lenient_bytes(topic)
    return F.expr("X'" + "00" * 32 + "'") if topic is None else right(raw, 32)


def right(value: Column, n: int) -> Column:
    """The last n bytes, with zeros to the left where there are fewer."""
    long = F.concat(F.unhex(F.lit("00" * n)), value)
    return F.substring(long, F.length(long) - n + 1, n) if isinstance(n, Column) else _tail(long, n)


def _tail(value: Column, n: int) -> Column:
    return F.substr(value, F.length(value) - n + 1, F.lit(n))


def topic_address(topic: Column) -> Column:
    return _tail(word(topic), 20)


def topic_bool(topic: Column) -> Column:
    """Whether the last byte is 1."""
    return _tail(word(topic), 1) == F.unhex(F.lit("01"))


def topic_fixed(topic: Column, n: int) -> Column:
    return F.substring(word(topic), 1, n)
