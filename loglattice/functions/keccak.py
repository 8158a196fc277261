"""Keccak-256 at plan time: topic hashes of event signatures. Rows never pass through here."""

from __future__ import annotations

LANES, RATE = 25, 136
MASK = (1 << 64) - 1


def _round_constants() -> list[int]:
    """From the degree-8 shift register of the sponge's definition."""
    state, found = 1, []
    for _ in range(24):
        constant = 0
        for j in range(7):
            if state & 1:
                constant |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        found.append(constant)
    return found


def _offsets() -> list[int]:
    found, x, y = [0] * LANES, 1, 0
    for t in range(24):
        found[x + 5 * y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return found


ROUNDS, OFFSETS = _round_constants(), _offsets()


def _turn(lane: int, by: int) -> int:
    return (lane << by | lane >> (64 - by)) & MASK if by else lane


def _permute(a: list[int]) -> list[int]:
    for constant in ROUNDS:
        parity = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
        mixed = [parity[(x - 1) % 5] ^ _turn(parity[(x + 1) % 5], 1) for x in range(5)]
        moved = [0] * LANES
        for x in range(5):
            for y in range(5):
                moved[y + 5 * ((2 * x + 3 * y) % 5)] = _turn(a[x + 5 * y] ^ mixed[x], OFFSETS[x + 5 * y])
        a = [moved[i] ^ (~moved[i - i % 5 + (i + 1) % 5] & moved[i - i % 5 + (i + 2) % 5]) for i in range(LANES)]
        a[0] ^= constant
    return a


def keccak256(data: bytes) -> bytes:
    """The 32-byte digest, with the padding from before the SHA-3 standard."""
    padded = bytearray(data + b"\x01")
    padded += bytes(-len(padded) % RATE)
    padded[-1] |= 0x80
    state = [0] * LANES
    for at in range(0, len(padded), RATE):
        for k in range(RATE // 8):
            state[k] ^= int.from_bytes(padded[at + 8 * k : at + 8 * k + 8], "little")
        state = _permute(state)
    return b"".join(lane.to_bytes(8, "little") for lane in state[:4])
