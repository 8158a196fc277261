"""256-bit numbers of an Arrow batch as a NumPy matrix of limbs.

A batch of BINARY(32) values, most significant byte first, is a matrix with one
row a limb, the least significant first; a limb has 32 bits and stands in an
unsigned 64-bit cell, so that sums and halves of products have room. Every
operation works on whole rows of the matrix and leaves out limbs that no value
of the batch has. Nulls are zero here; ``packed`` puts them back.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMBS, BITS = 8, 32
MASK = np.uint64(0xFFFFFFFF)
SHIFT = np.uint64(32)
#: The largest divisor whose remainder, moved up by a limb, still fits a cell.
SMALL = 1 << 32


def matrix(values: pa.Array, limbs: int = LIMBS) -> np.ndarray:
    """(limbs, n) cells of a binary array; values of another length than 32 bytes are an error."""
    whole = pc.fill_null(values, bytes(4 * LIMBS)) if values.null_count else values
    fixed = whole.cast(pa.binary(4 * LIMBS))
    raw = np.frombuffer(fixed.buffers()[1] or b"", ">u4", count=LIMBS * (len(fixed) + fixed.offset))[LIMBS * fixed.offset :]
    out = np.zeros((limbs, len(fixed)), np.uint64)
    out[:LIMBS] = raw.reshape(len(fixed), LIMBS).T[::-1]
    return out


def packed(cells: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The binary array of the low eight limbs, null where asked."""
    n = cells.shape[1]
    raw = np.ascontiguousarray(cells[:LIMBS][::-1].T.astype(">u4"))
    ends = np.arange(n + 1, dtype=np.int32) * (4 * LIMBS)
    valid = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])


def missing(*arrays: pa.Array) -> np.ndarray:
    out = np.zeros(len(arrays[0]), bool)
    for one in arrays:
        if one.null_count:
            out |= one.is_null().to_numpy(zero_copy_only=False)
    return out


def used(cells: np.ndarray) -> list[int]:
    """The limbs that any value has."""
    return np.flatnonzero(cells.any(axis=1)).tolist()


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, carry = np.empty_like(a), np.zeros(a.shape[1], np.uint64)
    for k in range(len(a)):
        total = a[k] + b[k] + carry
        out[k], carry = total & MASK, total >> SHIFT
    return out


def invert(a: np.ndarray) -> np.ndarray:
    return a ^ MASK


def negate(a: np.ndarray) -> np.ndarray:
    one = np.zeros_like(a)
    one[0] = 1
    return add(invert(a), one)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return add(a, negate(b))


def multiply(a: np.ndarray, b: np.ndarray, limbs: int = LIMBS) -> np.ndarray:
    """The low ``limbs`` limbs of the product."""
    out = np.zeros((limbs + 1, a.shape[1]), np.uint64)
    for i in used(a):
        for j in used(b):
            if i + j < limbs:
                product = a[i] * b[j]
                out[i + j] += product & MASK
                out[i + j + 1] += product >> SHIFT
    carry = np.zeros(a.shape[1], np.uint64)
    for k in range(limbs):
        total = out[k] + carry
        out[k], carry = total & MASK, total >> SHIFT
    return out[:limbs]


def divide_small(a: np.ndarray, divisor: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Quotient and remainder by divisors from 1 to 2^32."""
    divisor = np.asarray(divisor, np.uint64)
    out, rest = np.zeros_like(a), np.zeros(a.shape[1], np.uint64)
    for k in range(len(a))[::-1]:
        part = rest << SHIFT | a[k]
        out[k], rest = part // divisor, part % divisor
    return out, rest


def factors(divisor: int) -> list[int] | None:
    """Numbers up to 2^32 whose product is the divisor, or None."""
    found: list[int] = []
    for unit in (10**9, 2**31, 10, 2, 3, 5, 7):
        while divisor % unit == 0 and divisor >= SMALL:
            found.append(unit)
            divisor //= unit
    return [*found, divisor] if divisor <= SMALL else None


def divide_by(a: np.ndarray, divisor: int) -> np.ndarray | None:
    """The quotient by a constant, one small factor after the other; None if it has large ones."""
    parts = factors(divisor)
    if parts is None:
        return None
    for part in parts:
        a, _ = divide_small(a, part)
    return a


def whole(cells: np.ndarray) -> list[int]:
    """Python's integers."""
    raw = np.ascontiguousarray(cells.T.astype("<u4")).tobytes()
    size = 4 * len(cells)
    return [int.from_bytes(raw[at : at + size], "little") for at in range(0, len(raw), size)]


def of_whole(values: list[int], limbs: int = LIMBS) -> np.ndarray:
    raw = b"".join(v.to_bytes(4 * limbs, "little") for v in values)
    return np.frombuffer(raw, "<u4").reshape(len(values), limbs).T.astype(np.uint64)


def divide(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quotient and remainder, both 0 where the divisor is 0.

    Divisors below 2^32 go limb by limb, pairs below 2^64 in one step; only what
    is left is divided as Python's integers.
    """
    quotient, remainder = np.zeros_like(a), np.zeros_like(a)
    high_a, high_b = a[2:].any(axis=0), b[2:].any(axis=0)
    small = ~high_b & (b[1] == 0)
    some = np.flatnonzero(small & (b[0] > 0))
    if len(some):
        quotient[:, some], remainder[0, some] = divide_small(a[:, some], b[0, some])
    word = np.flatnonzero(~high_a & ~high_b & ~small)
    if len(word):
        x, y = a[1, word] << SHIFT | a[0, word], b[1, word] << SHIFT | b[0, word]
        for out, value in ((quotient, x // y), (remainder, x % y)):
            out[0, word], out[1, word] = value & MASK, value >> SHIFT
    large = np.flatnonzero(~small & (high_a | high_b))
    if len(large):
        pairs = [divmod(x, y) for x, y in zip(whole(a[:, large]), whole(b[:, large]), strict=True)]
        quotient[:, large] = of_whole([q for q, _ in pairs], len(a))
        remainder[:, large] = of_whole([r for _, r in pairs], len(a))
    return quotient, remainder


def shift(a: np.ndarray, by: np.ndarray, left: bool) -> np.ndarray:
    """Each value moved by its own number of bits; 256 and more give 0, a negative number is an error."""
    if (by < 0).any():
        raise ValueError("a shift is not negative")
    by = np.minimum(by, BITS * LIMBS).astype(np.int64)
    limb, bit = by // BITS, (by % BITS).astype(np.uint64)
    n, out = np.arange(a.shape[1]), np.zeros_like(a)
    wide = np.zeros((3 * LIMBS + 2, a.shape[1]), np.uint64)
    wide[LIMBS + 1 : 2 * LIMBS + 1] = a
    for k in range(LIMBS):
        at = k + LIMBS + 1 + (-limb if left else limb)
        near, far = wide[at, n], wide[at - 1 if left else at + 1, n]
        if left:
            out[k] = (near << bit | far >> (SHIFT - bit)) & MASK
        else:
            out[k] = (near | far << SHIFT) >> bit & MASK
    return out


def negative(a: np.ndarray) -> np.ndarray:
    return a[LIMBS - 1] >> np.uint64(BITS - 1) == 1


def magnitude(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The absolute values of two's complement, and which are negative."""
    below = negative(a)
    return np.where(below, negate(a), a), below


def signed(cells: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two's complement of magnitudes of any number of limbs, and which of them fit."""
    low = cells[:LIMBS]
    value = np.where(below, negate(low), low)
    zero = ~cells.any(axis=0)
    fits = ~cells[LIMBS:].any(axis=0) & (zero | (negative(value) == below))
    return value, fits


def texts(cells: np.ndarray) -> list[str]:
    """Decimal digits; numbers below 2^64 by one conversion of the batch."""
    if not cells[2:].any():
        return list(map(str, (cells[1] << SHIFT | cells[0]).tolist()))
    return list(map(str, whole(cells)))


def binary(f: Callable[..., np.ndarray]) -> Callable[..., pa.Array]:
    """A function of matrices as one of arrays; null where an argument is."""

    def over(*arrays: pa.Array) -> pa.Array:
        return packed(f(*map(matrix, arrays)), missing(*arrays))

    return over
