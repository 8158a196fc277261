"""Signed decimals of 256 bits with a fixed scale, as 32 bytes of the scaled integer.

Every operation gives null where the result is not representable or the divisor
is zero; ``all_stand`` tells of a whole group whether that happened. They are
Arrow functions on the limbs of whole batches, since Spark's own decimals lose
digits beyond 38.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.functions import limbs as cells_
from loglattice.functions import u256

SCALE, MOST_SCALE = 18, 76
LOW, HIGH = -u256.SIGN, u256.SIGN - 1


def parse(text: str, scale: int = SCALE) -> int:
    """The scaled integer of ``1,234.56``, ``1.234,56``, ``1_000`` or ``1 000``.

    The last of a full stop and a comma is the decimal sign; a comma alone is
    one unless it parts groups of three. More digits behind it than the scale
    has, or a number beyond the range, raise ValueError.
    """
    bare = text.strip()
    sign = -1 if bare[:1] == "-" else 1
    bare = bare[1:] if bare[:1] in ("+", "-") else bare
    dot, comma = bare.rfind("."), bare.rfind(",")
    grouped = re.fullmatch(r"\d{1,3}(,\d{3})+", bare) is not None
    at = max(dot, comma) if dot >= 0 and comma >= 0 else dot if dot >= 0 else -1 if grouped else comma
    whole, fraction = (bare[:at], bare[at + 1 :]) if at >= 0 else (bare, "")
    if at >= 0 and dot >= 0 and comma < 0 and bare.count(".") > 1:
        whole = whole.replace(".", "")
    clean = re.compile(r"[\s_.,]")
    whole, fraction = clean.sub("", whole), re.sub(r"[\s_]", "", fraction)
    if not re.fullmatch(r"\d*", whole) or not re.fullmatch(r"\d*", fraction) or not whole + fraction:
        raise ValueError(f"not a decimal: {text!r}")
    if len(fraction) > scale:
        raise ValueError(f"more than {scale} digits behind the decimal sign: {text!r}")
    value = sign * int((whole or "0") + fraction.ljust(scale, "0"))
    if not LOW <= value <= HIGH:
        raise ValueError(f"beyond the range: {text!r}")
    return value


def to_string(value: int, scale: int = SCALE) -> str:
    """Digits without trailing zeros behind the decimal sign; never ``-0``."""
    whole, rest = divmod(abs(value), 10**scale)
    fraction = str(rest).rjust(scale, "0").rstrip("0") if scale else ""
    return ("-" if value < 0 else "") + str(whole) + ("." + fraction if fraction else "")


def literal(text: str, scale: int = SCALE) -> Column:
    return u256.literal(parse(text, scale))


def order_key(a: Column) -> Column:
    """Bytes that sort as the signed numbers do."""
    return F.arrow_udf(cells_.binary(_flipped), "binary")(a)


def _flipped(a: np.ndarray) -> np.ndarray:
    out = a.copy()
    out[-1] ^= np.uint64(1 << 31)
    return out


def _signed(f: Callable[..., tuple[np.ndarray, np.ndarray]]) -> Callable[..., Column]:
    """``f`` of matrices gives a matrix and which of its values stand; the others, and nulls, are null."""

    def over(*arrays: pa.Array) -> pa.Array:
        value, good = f(*map(cells_.matrix, arrays))
        return cells_.packed(value, cells_.missing(*arrays) | ~good)

    return lambda *columns: F.arrow_udf(over, "binary")(*columns)


def _sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = cells_.add(a, b)
    return total, (cells_.negative(a) != cells_.negative(b)) | (cells_.negative(total) == cells_.negative(a))


def _difference(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = cells_.subtract(a, b)
    return total, (cells_.negative(a) == cells_.negative(b)) | (cells_.negative(total) == cells_.negative(a))


def _opposite(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, below = cells_.magnitude(a)
    return cells_.signed(size, ~below & size.any(axis=0))


def _size(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, below = cells_.magnitude(a)
    return cells_.signed(size, np.zeros_like(below))


add, sub, neg, absolute = _signed(_sum), _signed(_difference), _signed(_opposite), _signed(_size)


def truncated(a: int, b: int) -> int:
    """The quotient, cut towards zero."""
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def mul(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The product of sixteen limbs, and its quotient by the unit cut towards zero."""

    def over(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (x, low), (y, other) = cells_.magnitude(a), cells_.magnitude(b)
        return cells_.signed(cells_.divide_by(cells_.multiply(x, y, 2 * cells_.LIMBS), 10**scale), low != other)

    return _signed(over)(a, b)


def div(a: Column, b: Column, scale: int = SCALE) -> Column:
    def over(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (x, low), (y, other) = cells_.magnitude(a), cells_.magnitude(b)
        unit = np.broadcast_to(cells_.of_whole([10**scale]), x.shape)
        wide = np.zeros((2 * cells_.LIMBS, y.shape[1]), np.uint64)
        wide[: cells_.LIMBS] = y
        found, _ = cells_.divide(cells_.multiply(x, unit, 2 * cells_.LIMBS), wide)
        value, good = cells_.signed(found, low != other)
        return value, good & y.any(axis=0)

    return _signed(over)(a, b)


def mod(a: Column, b: Column) -> Column:
    """The remainder, with the sign of the dividend."""

    def over(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (x, low), (y, _) = cells_.magnitude(a), cells_.magnitude(b)
        value, good = cells_.signed(cells_.divide(x, y)[1], low)
        return value, good & y.any(axis=0)

    return _signed(over)(a, b)


def to_text(a: Column, scale: int = SCALE) -> Column:
    """Digits without trailing zeros behind the decimal sign; never ``-0``."""

    def over(values: pa.Array) -> pa.Array:
        size, below = cells_.magnitude(cells_.matrix(values))
        shown = [to_string(-x if b else x, scale) for x, b in zip(cells_.whole(size), below.tolist(), strict=True)]
        return pa.array(shown, pa.string(), mask=cells_.missing(values))

    return F.arrow_udf(over, "string")(a)


def from_decimal(value: Column, scale: int = SCALE) -> Column:
    """A Spark decimal, by its text; null beyond the range or the scale."""

    def number(text: str | None) -> bytes | None:
        try:
            return None if text is None else u256.pack(parse(text, scale))
        except ValueError:
            return None

    return F.arrow_udf(lambda values: pa.array(map(number, values.to_pylist()), pa.binary()), "binary")(value.cast("string"))


def from_integer_bytes(value: Column, little: bool = False) -> Column:
    """Two's complement of 1 to 32 bytes, of either byte order, as a scaled integer; null for any other length."""

    def number(raw: bytes | None) -> bytes | None:
        return u256.pack(int.from_bytes(raw, "little" if little else "big", signed=True)) if raw and len(raw) <= u256.BYTES else None

    return F.arrow_udf(lambda values: pa.array(map(number, values.to_pylist()), pa.binary()), "binary")(value)


def to_integer_bytes(value: Column, little: bool = False) -> Column:
    """The 32 bytes of the scaled integer in either byte order."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(value), F.lit("(..)"), F.lit(1))), "")) if little else value


def all_stand(value: Column, *arguments: Column) -> Column:
    """Over a group: whether no operation failed, that is, gave null for arguments that are not null."""
    given = F.lit(True)
    for one in arguments:
        given = given & one.isNotNull()
    return F.bool_and(value.isNotNull() | ~given)
