"""Lossless WebP as a media column: a full decoder, and the encoder that stores payloads.

The decoder reads RIFF/VP8L: prefix codes (simple and normal, with meta codes),
back-references with the near-distance map, the colour cache, and the predictor,
cross-colour, subtract-green and colour-indexing transforms, and gives ARGB
pixels; ``pixel_column`` does so for any column of such images. Images whose one
prefix-code group has only green literals are decoded by the same tables, four
symbols a step, with NumPy; any other image by the general loop.

The encoder stores one byte a pixel, as grey, in images of 64 pixels a row and at
most 16,384 rows; longer payloads take several images in a row. Each image takes
the form that suits its samples (``form_of``):

    palette     up to 16 values: colour indexing, several pixels a byte
    cache       a single row: colour cache and a prefix code of its own
    predictor   half of the samples equal the one above: predictor, short code for 0
    references  shrunk to a sixth by repeats: back-references, codes of their own
    cross       a quarter are no ASCII: cross-colour in place of subtract-green, flat code
    plain       else: subtract-green, one fixed code (short codes for the frequent bytes of prose)

The form depends on the samples alone, so equal payloads have equal stored bytes.

Defined results: a null text counts as empty, and an empty payload is 64 zero
bytes; texts of any length are stored whole; repeated rows give repeated
results; a damaged or cut stream raises ValueError (``pixel_column`` can give
null instead); further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import text_slices

WIDTH, MOST_ROWS, UNIT = 64, 1 << 14, 64

# Fixed values of the lossless WebP bitstream.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES = 24
DISTANCE_CODES = 40
CACHE_FACTOR = 0x1E35A7BD
# Near distances by code, fixed by the format: columns to the left (to the right if negative) and rows up.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, COLOUR_INDEXING = range(4)
#: The predictor mode of the pixel above, and the bits of the largest block.
TOP, BLOCK_BITS = 2, 9


class Bits:
    """Reads bits from the least significant on."""

    def __init__(self, data: bytes):
        self.value, self.at, self.size = int.from_bytes(data[:4096], "little"), 0, 8 * len(data)
        self.data, self.base = data, 0

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the stream ends too early")
        if self.at < self.base or self.at + n - self.base > 8 * 4096:
            byte = self.at // 8
            self.value, self.base = int.from_bytes(self.data[byte : byte + 4096], "little"), 8 * byte
        found = self.value >> (self.at - self.base) & ((1 << n) - 1)
        self.at += n
        return found


def canonical(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """(symbol, code with its first bit lowest) of each symbol that has a length."""
    code, last, found = 0, 0, []
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        found.append((symbol, int(f"{code:0{n}b}"[::-1], 2)))
        code, last = code + 1, n
    if found and len(found) > 1 and code != 1 << last:
        raise ValueError("a prefix code is not complete")
    return found


class PrefixCode:
    """A table from the next bits to (symbol, length)."""

    def __init__(self, lengths: tuple[int, ...]):
        found = canonical(lengths)
        if not found:
            found, lengths = [(0, 0)], (1,)
        self.lengths, self.spans = lengths, np.array(lengths, np.uint8)
        self.only = found[0][0] if len(found) == 1 else None
        if self.only is None:
            self.most = max(lengths)
            self.symbols, self.sizes = np.zeros(1 << self.most, np.int32), np.zeros(1 << self.most, np.uint8)
            for symbol, code in found:
                n = lengths[symbol]
                self.symbols[code :: 1 << n], self.sizes[code :: 1 << n] = symbol, n
            self.table = list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        n = min(self.most, bits.size - bits.at)
        symbol, used = self.table[bits.read(n)]
        if used > n:
            raise ValueError("the stream ends too early")
        bits.at -= n - used
        return symbol


@lru_cache(maxsize=64)
def prefix_code(lengths: tuple[int, ...]) -> PrefixCode:
    return PrefixCode(lengths)


@lru_cache(maxsize=8)
def steps(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 16 bits: how many bits up to four whole symbols take, their number, and they."""
    code = prefix_code(lengths)
    window = np.arange(1 << 16, dtype=np.int64)
    used, count, symbols = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros((1 << 16, 4), np.uint8)
    for k in range(4):
        at = window >> used & ((1 << code.most) - 1)
        size = code.sizes[at]
        fits = (count == k) & (used + size <= 16)
        symbols[fits, k] = code.symbols[at[fits]]
        used[fits] += size[fits]
        count[fits] += 1
    return used.astype(np.uint8), count.astype(np.uint8), symbols


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        lengths = [0] * max(alphabet, 256)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return prefix_code(tuple(lengths))
    own = [0] * 19
    for symbol in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[symbol] = bits.read(3)
    code = prefix_code(tuple(own))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, last = [], 8
    while len(lengths) < alphabet and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths.append(symbol)
            last = symbol or last
        else:
            value, extra, least = ((last, 2, 3), (0, 3, 3), (0, 7, 11))[symbol - 16]
            lengths += [value] * (least + bits.read(extra))
    if len(lengths) > alphabet:
        raise ValueError("more code lengths than symbols")
    return prefix_code(tuple(lengths + [0] * (alphabet - len(lengths))))


def read_run(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def near_distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    left, up = NEAR[code - 1]
    return max(1, up * width + left)


#: The last codes read: their alphabets, the bits they were read from, and they.
_LAST: dict[tuple, tuple[int, int, list[list[PrefixCode]]]] = {}


def read_groups(bits: Bits, alphabets: tuple[int, ...], groups: int) -> list[list[PrefixCode]]:
    """The codes of each group; those of an equal header are not parsed again."""
    begun = bits.at
    if last := _LAST.get((alphabets, groups)):
        n, value, codes = last
        if begun + n <= bits.size and bits.read(n) == value:
            return codes
        bits.at = begun
    codes = [[read_code(bits, n) for n in alphabets] for _ in range(groups)]
    n = bits.at - begun
    if n < 8 * 2048:
        bits.at = begun
        _LAST[alphabets, groups] = n, bits.read(n), codes
    return codes


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded ARGB pixels, flat."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, which, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        which = (read_image(bits, across, -(-height >> shift), False) >> 8 & 0xFFFF).tolist()
        groups = max(which) + 1
    alphabets = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    codes = read_groups(bits, alphabets, groups)
    total = width * height
    green, *rest = codes[0]
    if groups == 1 and not cache_bits and not any(green.lengths[256:]) and all(code.only is not None for code in rest[:3]):
        high = rest[2].only << 24 | rest[0].only << 16 | rest[1].only
        return read_literals(bits, green, total).astype(np.uint32) << 8 | np.uint32(high)
    pixels: list[int] = []
    cache = [0] * (1 << cache_bits)
    cached = 0
    while len(pixels) < total:
        at = len(pixels)
        group = codes[which[(at // width >> shift) * across + (at % width >> shift)]] if which else codes[0]
        symbol = group[0].read(bits)
        if symbol < 256:
            red, blue, alpha = (code.read(bits) for code in group[1:4])
            pixels.append(alpha << 24 | red << 16 | symbol << 8 | blue)
        elif symbol < 256 + LENGTH_CODES:
            run = read_run(bits, symbol - 256)
            distance = near_distance(read_run(bits, group[4].read(bits)), width)
            if distance > at or at + run > total:
                raise ValueError("a back-reference leaves the image")
            again = pixels[at - distance : at - distance + run]
            pixels += again if len(again) == run else (again * (run // len(again) + 1))[:run]
        else:
            while cached < at:
                cache[(pixels[cached] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[cached]
                cached += 1
            pixels.append(cache[symbol - 256 - LENGTH_CODES])
    return np.array(pixels, np.uint32)


def read_literals(bits: Bits, code: PrefixCode, total: int) -> np.ndarray:
    """The next ``total`` symbols of one code."""
    if code.only is not None:
        return np.full(total, code.only, np.uint8)
    used, count, symbols = steps(code.lengths)
    first = bits.at // 8
    raw = np.frombuffer(bits.data[first : first + (total * code.most + 7) // 8 + 1] + bytes(4), np.uint8).astype(np.uint32)
    wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    windows = (wide[:, None] >> _EIGHT).astype(np.uint16).ravel()
    one = used[windows]
    beyond = np.arange(len(one), dtype=np.int32) + one
    np.minimum(beyond, len(one) - 1, out=beyond)
    hop = (one + one[beyond]).tobytes()  # two windows a step
    at, path, end = bits.at - 8 * first, [], 8 * min(len(raw) - 4, len(bits.data) - first)
    visit = path.append
    while at < end:  # what is read beyond the last symbol is cut off below
        visit(at)
        at += hop[at]
    path = np.array(path, np.int64)
    path = np.stack([path, np.minimum(path + one[path], len(one) - 1)], axis=1).ravel()
    seen = windows[path]
    out = symbols[seen][_FOUR < count[seen][:, None]][:total]
    bits.at += int(code.spans[out].sum(dtype=np.int64))
    if len(out) < total or bits.at > bits.size:
        raise ValueError("the stream ends too early")
    return out


_FOUR, _EIGHT = np.arange(4, dtype=np.uint8), np.arange(8, dtype=np.uint32)


def _average(a: int, b: int) -> int:
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def _parts(pixel: int) -> tuple[int, int, int, int]:
    return pixel >> 24, pixel >> 16 & 255, pixel >> 8 & 255, pixel & 255


def _whole(parts) -> int:
    a, r, g, b = parts
    return a << 24 | r << 16 | g << 8 | b


def _clamp(x: int) -> int:
    return min(255, max(0, x))


def predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The prediction of a pixel from those beside and above it."""
    if mode == 11:
        grows = sum(abs(c - t) - abs(c - x) for c, t, x in zip(_parts(corner), _parts(top), _parts(left), strict=True))
        return left if grows < 0 else top
    if mode == 12:
        return _whole(_clamp(x + t - c) for x, t, c in zip(_parts(left), _parts(top), _parts(corner), strict=True))
    if mode == 13:
        return _whole(_clamp(m + int((m - c) / 2)) for m, c in zip(_parts(_average(left, top)), _parts(corner), strict=True))
    return (
        lambda: 0xFF000000,
        lambda: left,
        lambda: top,
        lambda: right,
        lambda: corner,
        lambda: _average(_average(left, right), top),
        lambda: _average(left, corner),
        lambda: _average(left, top),
        lambda: _average(corner, top),
        lambda: _average(top, right),
        lambda: _average(_average(left, corner), _average(top, right)),
        *[lambda: 0xFF000000] * 5,
    )[mode]()


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def undo_predictor(pixels: np.ndarray, width: int, height: int, shift: int, modes: np.ndarray) -> np.ndarray:
    if ((modes >> 8 & 15) == TOP).all():  # sums along the first row, then down the columns
        parts = (pixels.reshape(height, width)[:, :, None] >> np.array([24, 16, 8, 0], np.uint32) & 255).astype(np.uint8)
        parts[0, 0, 0] += 255
        parts[0] = np.cumsum(parts[0], axis=0, dtype=np.uint8)
        whole = np.cumsum(parts, axis=0, dtype=np.uint8).astype(np.uint32)
        return (whole[:, :, 0] << 24 | whole[:, :, 1] << 16 | whole[:, :, 2] << 8 | whole[:, :, 3]).ravel()
    flat, across = pixels.tolist(), -(-width >> shift)
    chosen = (modes >> 8 & 15).tolist()
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if y == 0:
                guess = flat[at - 1] if x else 0xFF000000
            elif x == 0:
                guess = flat[at - width]
            else:
                mode = chosen[(y >> shift) * across + (x >> shift)]
                guess = predict(mode, flat[at - 1], flat[at - width], flat[at - width + 1], flat[at - width - 1])
            flat[at] = _add(flat[at], guess)
    return np.array(flat, np.uint32)


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, shift: int, blocks: np.ndarray) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    block = blocks[(y >> shift) * -(-width >> shift) + (x >> shift)]
    signed = lambda v: (v & 255).astype(np.uint8).astype(np.int8).astype(np.int32)
    green = signed(pixels >> 8)
    red = (pixels >> 16 & 255).astype(np.int32) + (signed(block) * green >> 5)
    blue = (pixels & 255).astype(np.int32) + (signed(block >> 8) * green >> 5) + (signed(block >> 16) * signed(red) >> 5)
    return pixels & np.uint32(0xFF00FF00) | (red & 255).astype(np.uint32) << 16 | (blue & 255).astype(np.uint32)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 255
    return pixels & np.uint32(0xFF00FF00) | ((pixels >> 16 & 255) + green & 255) << 16 | (pixels & 255) + green & 255


def undo_colour_indexing(pixels: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    bundle = palette_bits(len(palette))
    wide = np.zeros(256, np.uint32)
    wide[: len(palette)] = palette
    if not bundle:
        return wide[pixels >> 8 & 255]
    each, across = 8 >> bundle, -(-width >> bundle)
    packed = (pixels >> 8 & 255).reshape(height, across)
    places = np.arange(1 << bundle, dtype=np.uint32) * each
    index = (packed[:, :, None] >> places & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    return wide[index].ravel()


def palette_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels, (height, width) of unsigned 32 bits, of one lossless WebP image."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP image")
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    full, height = bits.read(14) + 1, bits.read(14) + 1
    opaque = not bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    width, undo, seen = full, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is given twice")
        seen.add(kind)
        if kind == SUBTRACT_GREEN:
            undo.append(undo_subtract_green)
        elif kind == COLOUR_INDEXING:
            colours = read_image(bits, bits.read(8) + 1, 1, False)
            parts = np.cumsum(colours[:, None] >> np.array([24, 16, 8, 0], np.uint32) & 255, axis=0).astype(np.uint32) & 255
            palette = parts[:, 0] << 24 | parts[:, 1] << 16 | parts[:, 2] << 8 | parts[:, 3]
            undo.append(lambda p, w=width, c=palette: undo_colour_indexing(p, w, height, c))
            width = -(-width >> palette_bits(len(palette)))
        else:
            shift = bits.read(3) + 2
            blocks = read_image(bits, -(-width >> shift), -(-height >> shift), False)
            how = undo_predictor if kind == PREDICTOR else undo_cross_colour
            undo.append(lambda p, w=width, s=shift, b=blocks, f=how: f(p, w, height, s, b))
    pixels = read_image(bits, width, height, True)
    for step in reversed(undo):
        pixels = step(pixels)
    if opaque:
        pixels = pixels | np.uint32(0xFF000000)
    return pixels.reshape(height, full)


def decode_all(data: bytes) -> Iterator[np.ndarray]:
    """The images of a media value, one after the other."""
    while data:
        size = 8 + struct.unpack("<I", data[4:8])[0]
        yield decode(data[:size])
        data = data[size:]


class Writer:
    """Writes bits from the least significant on; whole stretches of them become bytes, so that long streams stay cheap."""

    def __init__(self):
        self.value = self.n = self.held = 0
        self.parts: list[bytes] = []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.held
        self.held += n
        self.n += n
        if self.held >= 4096:
            self.parts.append((self.value & ((1 << 4096) - 1)).to_bytes(512, "little"))
            self.value, self.held = self.value >> 4096, self.held - 4096

    def done(self) -> bytes:
        """All bits, the last byte filled up with zeros."""
        return b"".join(self.parts) + self.value.to_bytes((self.held + 7) // 8, "little")


#: Bytes with codes of 4, of 6 and of 9 bits; all others have 10.
FREQUENT = {4: b" etanoir", 6: b"hsdlucmpfgwbv.\n,", 9: b"\xc3\xa9\xa8\xa4\xb6\xbcABCDEGHIOTWSkyzqx'"}


#: Literal codes that whole images are written with: of prose, of residuals that are mostly 0, and flat.
def literal_lengths(kind: str) -> tuple[int, ...]:
    if kind == "flat":
        lengths = [8] * 256
    elif kind == "residual":
        lengths = [1, 8, *[9] * 254]
    else:
        lengths = [10] * 256
        for n, symbols in FREQUENT.items():
            for symbol in symbols:
                lengths[symbol] = n
    return tuple(lengths + [0] * LENGTH_CODES)


@lru_cache(maxsize=3)
def literal_code(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of the 256 literals."""
    lengths = literal_lengths(kind)
    codes = np.zeros(256, np.uint64)
    for symbol, code in canonical(lengths):
        codes[symbol] = code
    return codes, np.array(lengths[:256], np.int64)


def huffman(counts: list[int], most: int = 15) -> list[int]:
    """Code lengths of the symbols that occur, at most ``most``."""
    while True:
        heap = [(n, k, (k,)) for k, n in enumerate(counts) if n]
        lengths = [0] * len(counts)
        heapq.heapify(heap)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
        while len(heap) > 1:
            (a, i, own), (b, j, other) = heapq.heappop(heap), heapq.heappop(heap)
            for symbol in (*own, *other):
                lengths[symbol] += 1
            heapq.heappush(heap, (a + b, min(i, j), own + other))
        if max(lengths) <= most:
            return lengths
        counts = [n and n // 2 + 1 for n in counts]  # flatter, until it fits


def put_code(out: Writer, lengths: list[int] | tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Writes a prefix code; (code, length) by symbol, where one symbol alone takes no bits."""
    some = [s for s, n in enumerate(lengths) if n]
    if len(some) <= 1 and (not some or some[0] < 256):
        symbol = some[0] if some else 0
        out.put(1, 1)
        out.put(0, 1)
        out.put(1, 1)
        out.put(symbol, 8)
        return {symbol: (0, 0)}
    if len(some) == 1:  # beyond the simple form: a second one makes the code whole
        lengths = list(lengths)
        lengths[0] = 1
        some = [0, some[0]]
    own = [4] * 13 + [5] * 6
    out.put(0, 1)
    out.put(len(CODE_LENGTH_ORDER) - 4, 4)
    for symbol in CODE_LENGTH_ORDER:
        out.put(own[symbol], 3)
    out.put(0, 1)
    small = dict(canonical(tuple(own)))
    at = 0
    while at < len(lengths):
        run = at
        while run < len(lengths) and not lengths[run]:
            run += 1
        zeros = min(run - at, 138)
        if zeros >= 11:
            out.put(small[18], own[18])
            out.put(zeros - 11, 7)
        elif zeros >= 3:
            out.put(small[17], own[17])
            out.put(zeros - 3, 3)
        else:
            zeros = 1
            out.put(small[lengths[at]], own[lengths[at]])
        at += zeros
    return {symbol: (code, lengths[symbol]) for symbol, code in canonical(tuple(lengths))}


def put_constants(out: Writer, *symbols: int) -> None:
    """Prefix codes of one symbol each."""
    for symbol in symbols:
        put_code(out, [int(s == symbol) for s in range(symbol + 1)])


def put_blocks(out: Writer, kind: int, red: int, green: int, blue: int) -> None:
    """A transform whose blocks are all alike: an image that takes no bits but its codes."""
    out.put(1, 1)
    out.put(kind, 2)
    out.put(BLOCK_BITS - 2, 3)
    out.put(0, 1)  # no colour cache
    put_constants(out, green, red, blue, 255, 0)


def put_number(out: Writer, code: dict[int, tuple[int, int]], base: int, value: int) -> None:
    """A length or a distance from 1 on: the symbol of its stretch, and the bits behind it."""
    symbol, extra, rest = stretch(value)
    out.put(*code[base + symbol])
    out.put(rest, extra)


def stretch(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their value) of a length or a distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    extra = value.bit_length() - 2
    return 2 * extra + 2 + (value >> extra & 1), extra, value & ((1 << extra) - 1)


LONGEST, FARTHEST, SEEN = 4096, (1 << 20) - len(NEAR), 8


def repeats(raw: bytes) -> list[int | tuple[int, int]]:
    """The samples as literals and (length, distance) of what came before, greedily."""
    seen: dict[bytes, int] = {}
    out: list[int | tuple[int, int]] = []
    at, n = 0, len(raw)
    while at < n:
        key = raw[at : at + SEEN]
        before = seen.get(key)
        seen[key] = at
        if before is None or len(key) < SEEN or at - before > FARTHEST:
            out.append(raw[at])
            at += 1
            continue
        run, most = SEEN, min(LONGEST, n - at)
        while run < most:  # in steps that double, then bytewise
            step = min(run, most - run)
            if raw[before + run : before + run + step] == raw[at + run : at + run + step]:
                run += step
            else:
                while raw[before + run] == raw[at + run]:
                    run += 1
                break
        out.append((run, at - before))
        for k in range(at + 4, at + run, 4):
            seen[raw[k : k + SEEN]] = k
        at += run
    return out


def form_of(samples: np.ndarray) -> str:
    """The form that an image is stored in; it depends on the samples alone."""
    if np.count_nonzero(np.bincount(samples, minlength=256)) <= 16:
        return "palette"
    if len(samples) == WIDTH:
        return "cache"
    if 2 * np.count_nonzero(samples[WIDTH:] == samples[:-WIDTH]) >= len(samples):
        return "predictor"
    if len(samples) >= 16 * WIDTH and 6 * len(zlib.compress(samples.tobytes(), 1)) <= len(samples):
        return "references"
    return "cross" if 4 * np.count_nonzero(samples >= 128) >= len(samples) else "plain"


def encode_rows(samples: np.ndarray) -> bytes:
    """One image of 64 samples a row."""
    kind = form_of(samples)
    out = Writer()
    out.put(WIDTH - 1, 14)
    out.put(len(samples) // WIDTH - 1, 14)
    out.put(0, 1)  # no alpha in use
    out.put(0, 3)
    if kind == "palette":
        samples = _palette(out, samples)
    elif kind == "cross":  # red and blue less 32 / 32 of green
        put_blocks(out, CROSS_COLOUR, 0, 32, 32)
    else:
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
    if kind == "predictor":
        put_blocks(out, PREDICTOR, 0, TOP, 0)
        rows = samples.reshape(-1, WIDTH)
        above = np.concatenate([np.concatenate([[0], rows[0, :-1]])[None], rows[:-1]]).astype(np.uint8)
        samples = (rows - above).ravel()
    out.put(0, 1)  # no more transforms
    if kind == "cache":
        return _finished(_cached(out, samples.tolist()), b"")
    out.put(0, 1)  # no colour cache
    out.put(0, 1)  # one group of codes
    if kind == "references":
        return _finished(_referred(out, samples.tobytes()), b"")
    alpha = 0 if kind == "predictor" else 255
    if kind == "palette" and not samples.any():
        put_constants(out, 0, 0, 0, alpha, 0)
        return _finished(out, b"")
    literals = {"predictor": "residual", "plain": "prose"}.get(kind, "flat")
    put_code(out, literal_lengths(literals))
    put_constants(out, 0, 0, alpha, 0)
    return _finished(out, samples, *literal_code(literals))


def _palette(out: Writer, samples: np.ndarray) -> np.ndarray:
    """Writes the palette; several pixels as one."""
    values, place = np.unique(samples, return_inverse=True)
    out.put(1, 1)
    out.put(COLOUR_INDEXING, 2)
    out.put(len(values) - 1, 8)
    out.put(0, 1)  # no colour cache
    differ = np.diff(values.astype(np.int64), prepend=0).tolist()
    counts, alphas = [0] * (256 + LENGTH_CODES), [0] * 256
    for k, d in enumerate(differ):
        counts[d] += 1
        alphas[0 if k else 255] += 1
    codes = [put_code(out, huffman(c)) for c in (counts, counts[:256], counts[:256], alphas)]
    put_constants(out, 0)
    for k, d in enumerate(differ):
        for code, symbol in zip(codes, (d, d, d, 0 if k else 255), strict=True):
            out.put(*code[symbol])
    bundle = palette_bits(len(values))
    each = 8 >> bundle
    return (place.reshape(-1, 1 << bundle) << np.arange(1 << bundle) * each).sum(axis=1).astype(np.uint8)


CACHE_BITS = 4


def _cached(out: Writer, samples: list[int]) -> Writer:
    """Literals, and places of a colour cache."""
    cache, tokens = [0] * (1 << CACHE_BITS), []
    for value in samples:
        pixel = 0xFF000000 | value << 8
        at = (pixel * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - CACHE_BITS)
        tokens.append(256 + LENGTH_CODES + at if cache[at] == pixel else value)
        cache[at] = pixel
    out.put(1, 1)
    out.put(CACHE_BITS, 4)
    out.put(0, 1)  # one group of codes
    counts = [0] * (256 + LENGTH_CODES + (1 << CACHE_BITS))
    for token in tokens:
        counts[token] += 1
    code = put_code(out, huffman(counts))
    put_constants(out, 0, 0, 255, 0)
    for token in tokens:
        out.put(*code[token])
    return out


def _referred(out: Writer, raw: bytes) -> Writer:
    """Literals and back-references; distances by their plain codes."""
    tokens = repeats(raw)
    counts, far = [0] * (256 + LENGTH_CODES), [0] * DISTANCE_CODES
    for token in tokens:
        if isinstance(token, int):
            counts[token] += 1
        else:
            counts[256 + stretch(token[0])[0]] += 1
            far[stretch(token[1] + len(NEAR))[0]] += 1
    code = put_code(out, huffman(counts))
    put_constants(out, 0, 0, 255)
    distances = put_code(out, huffman(far) if any(far) else far)
    for token in tokens:
        if isinstance(token, int):
            out.put(*code[token])
        else:
            put_number(out, code, 256, token[0])
            put_number(out, distances, 0, token[1] + len(NEAR))
    return out


def _finished(first: Writer, samples: np.ndarray | bytes, codes: np.ndarray | None = None, sizes: np.ndarray | None = None) -> bytes:
    """The image file: what was written, and the literals behind it."""
    front, bits = first.done(), first.n
    if len(samples):
        n = sizes[samples]
        ends = np.cumsum(n)
        at = ends - n + bits
        word = at >> 4
        value = codes[samples] << (at & 15).astype(np.uint64)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sums = np.add.reduceat(value, starts)
        words = np.zeros((bits + int(ends[-1]) + 15) // 16 + 2, np.uint64)
        words[word[starts]] = sums & np.uint64(0xFFFF)
        words[word[starts] + 1] += sums >> np.uint64(16)
        stream = bytearray(words.astype("<u2").tobytes()[: (bits + int(ends[-1]) + 7) // 8])
        shared = int.from_bytes(stream[: len(front)], "little") | int.from_bytes(front, "little")
        stream[: len(front)] = shared.to_bytes(len(front), "little")
        front = bytes(stream)
    body = b"\x2f" + front
    body += bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def encode(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as images one after the other."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    samples = np.frombuffer(payload, np.uint8)
    step = WIDTH * MOST_ROWS
    return b"".join(encode_rows(samples[a : a + step]) for a in range(0, len(samples), step))


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def feature(pixels: np.ndarray) -> str:
    """Mean and spread of the luminance, and its eight-bin histogram, in whole numbers."""
    grey = pixels >> 8 & 255
    n, total = grey.size, int(grey.sum(dtype=np.uint64))
    square = int((grey.astype(np.uint64) ** 2).sum(dtype=np.uint64))
    bins = np.bincount(grey.ravel() >> 5, minlength=8)
    return f"{1000 * total // n}:{1000 * (n * square - total * total) // (n * n)}:" + ",".join(map(str, bins.tolist()))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEDIA_SCHEMA = SCHEMA + ", media binary"


def pixels_of(media: bytes) -> np.ndarray:
    """The pixels of a media value: its images, of one width, one below the other."""
    images = list(decode_all(media))
    if not images:
        raise ValueError("no image")
    return images[0] if len(images) == 1 else np.concatenate(images)


def pixel_column(df: DataFrame, column: str = "media", strict: bool = True) -> Column:
    """The pixels of a column of lossless WebP values: width, height and ARGB as little-endian unsigned 32-bit numbers, row by row.

    Null for a null value; a damaged one fails the query, or is null if not ``strict``.
    """

    def one(value: bytes | None) -> dict | None:
        try:
            pixels = None if value is None else pixels_of(value)
        except ValueError:
            if strict:
                raise
            pixels = None
        return None if pixels is None else {"width": pixels.shape[1], "height": pixels.shape[0], "argb": pixels.astype("<u4").tobytes()}

    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary())])
    return F.arrow_udf(lambda values: pa.array([one(v.as_py()) for v in values], kind), "struct<width: int, height: int, argb: binary>")(df[column])


def media_column(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Store each text of ``docs`` (doc_id, text) as lossless WebP, read it back and describe it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_slices(batch.column(1)):
                out = [describe(text, with_media) for text in texts]
                columns = [batch.column(0).slice(a, len(texts))]
                for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_media)):
                    columns.append(pa.array([x[k] for x in out], kind))
                names = [field.strip().split()[0] for field in (MEDIA_SCHEMA if with_media else SCHEMA).split(",")]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, MEDIA_SCHEMA if with_media else SCHEMA)


def describe(text: str | None, with_media: bool = False) -> tuple:
    n, payload = padded(text)
    media = encode(payload)
    pixels = pixels_of(media)
    back = (pixels >> 8).astype(np.uint8).tobytes()
    return (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels), *([media] if with_media else []))
