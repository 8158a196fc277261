"""Unsigned and signed 256-bit integers as 32 bytes, most significant first.

Comparison, minimum, maximum, grouping and joins are those of BINARY, which sorts
as the numbers do. Sums are built in: each limb is a long column that is summed
with map-side combining, and the eight sums are carried once a group. All other
arithmetic and text are Arrow functions over the limbs of whole batches
(``functions.limbs``), and neighbouring ones share one passage to Python. All
results are modulo 2^256.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.functions import limbs as cells_

BYTES, LIMBS = 32, 8
MODULUS = 1 << 256
SIGN = 1 << 255


def pack(value: int) -> bytes:
    return (value % MODULUS).to_bytes(BYTES, "big")


def unpack(value: bytes) -> int:
    return int.from_bytes(value, "big")


def signed(value: bytes) -> int:
    number = unpack(value)
    return number - MODULUS if number >= SIGN else number


def literal(value: int) -> Column:
    return F.unhex(F.lit(pack(value).hex()))


def from_long(value: Column) -> Column:
    """A long, sign-extended."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(F.when(value < 0, F.lit("F" * 48)).otherwise(F.lit("0" * 48)), digits))


def _arrow(f: Callable[..., pa.Array], kind: str = "binary") -> Callable[..., Column]:
    """An Arrow function that is made where it is called, so that importing needs no session."""
    return lambda *columns: F.arrow_udf(f, kind)(*columns)


add = _arrow(cells_.binary(cells_.add))
sub = _arrow(cells_.binary(cells_.subtract))
mul = _arrow(cells_.binary(cells_.multiply))
bit_and = _arrow(cells_.binary(lambda a, b: a & b))
bit_or = _arrow(cells_.binary(lambda a, b: a | b))
bit_xor = _arrow(cells_.binary(lambda a, b: a ^ b))
bit_not = _arrow(cells_.binary(cells_.invert))
negate = _arrow(cells_.binary(cells_.negate))


def add_overflows(a: Column, b: Column) -> Column:
    return add(a, b) < a


def sub_overflows(a: Column, b: Column) -> Column:
    return a < b


#: Limbs as a struct of longs, and back from the sums of a group.
LIMB_STRUCT = "struct<" + ", ".join(f"l{k}: bigint" for k in range(LIMBS)) + ">"


def _limbs(values: pa.Array) -> pa.Array:
    rows, null = cells_.matrix(values).astype(np.int64), cells_.missing(values)
    fields = [pa.array(row, pa.int64(), mask=null) for row in rows]
    return pa.StructArray.from_arrays(fields, [f"l{k}" for k in range(LIMBS)])


def _carried(values: pa.Array) -> pa.Array:
    """The number of limbs that may be negative or too large; the last carry is dropped."""
    rows = [values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(LIMBS)]
    out, carry = np.zeros((LIMBS, len(values)), np.uint64), np.zeros(len(values), np.int64)
    for k, row in enumerate(rows):
        total = row + carry
        out[k], carry = (total & 0xFFFFFFFF).astype(np.uint64), total >> 32
    return cells_.packed(out)


def limbs(value: Column) -> Column:
    """A struct of eight longs, the least significant 32 bits first."""
    return F.arrow_udf(_limbs, LIMB_STRUCT)(value)


def from_limbs(sums: list[Column]) -> Column:
    """Limbs, which may be negative or too large, to a number: carries run upwards."""
    return F.arrow_udf(_carried, "binary")(F.struct(*[s.cast("long").alias(f"l{k}") for k, s in enumerate(sums)]))


def limb_sums(value: Column) -> list[Column]:
    """The sums over a group of the limbs of a struct of ``limbs``; up to 2^31 rows a group."""
    return [F.coalesce(F.sum(value[f"l{k}"]), F.lit(0)) for k in range(LIMBS)]


def sum_of(value: Column) -> Column:
    """The sum over a group; up to 2^31 rows a group."""
    return from_limbs(limb_sums(limbs(value)))


def is_zero(a: Column) -> Column:
    return a == literal(0)


def fits_long(a: Column) -> Column:
    """Whether the number is below 2^64."""
    return F.substring(a, 1, 24) == F.unhex(F.lit("00" * 24))


def _text(values: pa.Array) -> pa.Array:
    return pa.array(cells_.texts(cells_.matrix(values)), pa.string(), mask=cells_.missing(values))


def _signed_text(values: pa.Array) -> pa.Array:
    size, below = cells_.magnitude(cells_.matrix(values))
    shown = [f"-{t}" if b else t for t, b in zip(cells_.texts(size), below.tolist(), strict=True)]
    return pa.array(shown, pa.string(), mask=cells_.missing(values))


#: Decimal digits, and those of two's complement.
to_text = _arrow(_text, "string")
to_signed_text = _arrow(_signed_text, "string")


def _each(f: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """A function of the values of an array column."""

    def over(lists: pa.Array) -> pa.Array:
        shown = f(lists.flatten())
        ends = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), shown, mask=lists.is_null() if lists.null_count else None)

    return over


#: The same of arrays of numbers.
texts = _arrow(_each(_text), "array<string>")
signed_texts = _arrow(_each(_signed_text), "array<string>")


def parse(text: str) -> int:
    """Digits with ``_`` and ``,`` between them and a ``+`` before them; raises beyond the range."""
    bare = text.strip().replace("_", "").replace(",", "").removeprefix("+")
    if not bare.isdecimal() or not bare.isascii():
        raise ValueError(f"not an unsigned number: {text!r}")
    if (value := int(bare)) >= MODULUS:
        raise ValueError(f"beyond 256 bits: {text!r}")
    return value


#: Quotient and remainder; 0 where the divisor is 0.
div = _arrow(cells_.binary(lambda a, b: cells_.divide(a, b)[0]))
mod = _arrow(cells_.binary(lambda a, b: cells_.divide(a, b)[1]))


def div_by(a: Column, divisor: int) -> Column:
    """The quotient by a constant, which is not 0."""
    if divisor <= 0:
        raise ZeroDivisionError("a constant divisor is above 0")
    if divisor >= MODULUS:
        return F.when(a.isNotNull(), literal(0))

    def over(a: np.ndarray) -> np.ndarray:
        found = cells_.divide_by(a, divisor)
        return cells_.of_whole([x // divisor for x in cells_.whole(a)]) if found is None else found

    return F.arrow_udf(cells_.binary(over), "binary")(a)


def _shift(left: bool) -> Callable[[Column, Column], Column]:
    def over(values: pa.Array, by: pa.Array) -> pa.Array:
        places = pc.fill_null(by.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        return cells_.packed(cells_.shift(cells_.matrix(values), places, left), cells_.missing(values, by))

    return lambda a, by: F.arrow_udf(over, "binary")(a, by.cast("long"))


shift_left, shift_right = _shift(True), _shift(False)


def from_text(text: Column) -> Column:
    """Parsed numbers; null where the text is none."""

    def number(value: str | None) -> bytes | None:
        try:
            return None if value is None else pack(parse(value))
        except ValueError:
            return None

    return F.arrow_udf(lambda values: pa.array(map(number, values.to_pylist()), pa.binary()), "binary")(text)
