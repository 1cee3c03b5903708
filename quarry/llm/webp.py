"""Lossless WebP media columns: a full decoder, and a writer that uses what the decoder reads.

The decoder reads the lossless bit stream: prefix codes (one group or many, chosen by an entropy image), back-references with the
two-dimensional distance codes, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms. A symbol's
place depends on all before it; so with one group the step from every bit to the next pixel is worked out at once by table, and then the
steps are followed from the first one. Many files are read side by side instead: each array operation takes a step in all of them.

The writer stores pixels by prefix codes from their frequencies, back-references for repeated runs, and (beside the predictor or none) a
colour cache where that is shorter by entropy. Its transforms vary as those of images from many writers do, by the payload's CRC-32: a predictor per block; cross-colour
multipliers per block, or the palette if there are 256 colours at most; subtract-green; or none, or the palette. So equal payloads have equal
streams.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType

from quarry.llm.common import arrow_batches, mix, text_pieces

#: Fixed value: the order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Distance codes 1 to 120: the pixels nearby, by distance; of equals, the higher row, then the right one.
NEARBY = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))
MOST_SIDE = 16384


_EIGHT = np.arange(8, dtype=np.uint64)


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self.size:
            raise ValueError("the stream ends early")
        i, shift = divmod(self.at, 8)
        self.at += n
        return (int.from_bytes(self.data[i : i + (shift + n + 7) // 8], "little") >> shift) & ((1 << n) - 1)

    def peek(self, n: int, at: int | None = None) -> int:
        """Up to ``n`` bits, zeros beyond the end."""
        i, shift = divmod(self.at if at is None else at, 8)
        return (int.from_bytes(self.data[i : i + (shift + n + 7) // 8], "little") >> shift) & ((1 << n) - 1)

    def array(self, n: int) -> np.ndarray:
        """The next ``n`` bits as an array."""
        if self.at + n > self.size:
            raise ValueError("the stream ends early")
        i, shift = divmod(self.at, 8)
        self.at += n
        return np.unpackbits(np.frombuffer(self.data, np.uint8, (shift + n + 7) // 8, i), bitorder="little")[shift : shift + n]


@lru_cache(16)
def _turned(width: int) -> np.ndarray:
    """The numbers below 2**width with their bits turned round."""
    return _TURNED[: 1 << width] >> (16 - width)


_TURNED = np.zeros(1 << 16, np.int64)
for _k in range(16):
    _TURNED |= ((np.arange(1 << 16) >> _k) & 1) << (15 - _k)


class Code:
    """A canonical prefix code from the lengths of its symbols."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if len(used) < 2:  # takes no bits
            self.width, self.only = 0, int(used[0]) if len(used) else 0
            self.symbols, self.lengths = np.array([self.only], np.int16), np.zeros(1, np.uint8)
            return
        sizes = lengths[used]
        self.width = int(sizes.max())
        if int((1 << (self.width - sizes)).sum()) != 1 << self.width:
            raise ValueError("a prefix code is not complete")
        order = np.argsort(sizes, kind="stable")
        shares = 1 << (self.width - sizes[order])
        turned = _turned(self.width)  # by the next ``width`` bits
        self.symbols, self.lengths = (np.repeat(x[order].astype(kind), shares).take(turned) for x, kind in ((used, np.int16), (sizes, np.uint8)))  # small tables

    @classmethod
    def known(cls, width: int, symbols: np.ndarray, lengths: np.ndarray) -> Code:
        """The code of which the tables are made already."""
        code = cls.__new__(cls)
        code.width, code.only, code.symbols, code.lengths = width, 0, symbols, lengths
        return code

    def next(self, bits: Bits) -> int:
        if not self.width:
            return self.only
        k = bits.peek(self.width)
        bits.at += int(self.lengths[k])
        if bits.at > bits.size:
            raise ValueError("the stream ends early")
        return int(self.symbols[k])


@lru_cache(256)
def _steps_code(n: int, value: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The code for code lengths, whose own ``n`` lengths stand in ``value`` by 3 bits: symbols and lengths by the next bits, the number of these
    bits, and the symbol of a code without bits."""
    lengths = np.zeros(19, np.int64)
    for k in range(n):
        lengths[LENGTH_ORDER[k]] = (value >> 3 * k) & 7
    code = Code(lengths)
    return code.symbols.astype(np.int64), code.lengths.astype(np.int64), code.width, code.only if not code.width else 0


@lru_cache(4096)
def _few(alphabet: int, *symbols: int) -> Code:
    """The code of one or two symbols."""
    lengths = np.zeros(alphabet, np.int64)
    lengths[list(symbols)] = 1
    return Code(lengths)


#: Bits behind a step of the code lengths, and the least number of lengths that it stands for.
_EXTRA, _LEAST = np.array([0] * 16 + [2, 3, 7]), np.array([1] * 16 + [3, 3, 11])


def _code_at_once(bits: Bits, alphabet: int, key: tuple, size: int = 512) -> Code | None:
    """The code whose lengths stand next: all steps from every bit are worked out, then followed. None where lengths are repeated or go on for long."""
    first, shift = divmod(bits.at, 8)
    part = bits.data[first : first + size // 8 + 9] + b"\0" * 16
    ahead = (np.ndarray((size // 8 + 1,), "<u8", part, strides=(1,))[:, None] >> _EIGHT).view(np.int64).reshape(-1)[shift : shift + size] if len(part) > size // 8 + 16 else None
    if ahead is None:
        return None
    k = ahead & ((1 << key[2]) - 1)
    symbol, n = key[0].take(k), key[1].take(k)
    extra = _EXTRA.take(symbol)
    times = _LEAST.take(symbol) + ((ahead >> n) & ((1 << extra) - 1))
    steps, counts, place, at, path = memoryview(n + extra), memoryview(times), 0, 0, []
    while at < alphabet and place < size:
        path.append(place)
        at += counts[place]
        place += steps[place]
    on = np.array(path)
    found = symbol[on]
    if at < alphabet and size < 2048:
        return _code_at_once(bits, alphabet, key, 2048)
    if at != alphabet or (found == 16).any() or bits.at + place > bits.size:
        return None
    bits.at += place
    return _code(np.repeat(np.where(found < 16, found, 0).astype(np.uint8), times[on]).tobytes())


@lru_cache(64)
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8).astype(np.int64))


def read_code(bits: Bits, alphabet: int) -> Code:
    k = bits.peek(19)
    if k & 5 == 5 and bits.at + 19 <= bits.size:  # one or two symbols of 8 bits
        bits.at += 19 if k & 2 else 11
        return _few(alphabet, k >> 3 & 255, k >> 11) if k & 2 else _few(alphabet, k >> 3 & 255)
    if bits.read(1):  # one or two symbols
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        return _few(alphabet, first, bits.read(8)) if two else _few(alphabet, first)
    n = 4 + bits.read(4)
    key = _steps_code(n, bits.read(3 * n))
    most = alphabet
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
        if most > alphabet:
            raise ValueError("too many code lengths")
    symbols, sizes, width, only = key
    if 0 < width < 6 and most == alphabet and (code := _code_at_once(bits, alphabet, key)):
        return code
    symbols, sizes, lengths = symbols.tolist(), sizes.tolist(), np.zeros(alphabet, np.int64)
    at, last, mask = 0, 8, (1 << width) - 1
    ahead, place = bits.peek(2048), 0
    found: list[int] = []
    while at < alphabet and most:
        most -= 1
        if place > 2000:
            bits.at += place
            ahead, place = bits.peek(2048), 0
        k = (ahead >> place) & mask
        s = symbols[k] if width else only
        place += sizes[k] if width else 0
        if s < 16:
            found.append(s)
            at += 1
            last = s or last
            continue
        extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
        times = least + ((ahead >> place) & ((1 << extra) - 1))
        place += extra
        found += [last if s == 16 else 0] * times
        at += times
    bits.at += place
    if bits.at > bits.size:
        raise ValueError("the stream ends early")
    if at > alphabet:
        raise ValueError("a run of code lengths is too long")
    lengths[:at] = found
    return Code(lengths)


def _number(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _group(bits: Bits, cache_bits: int) -> list[Code]:
    green = read_code(bits, 256 + 24 + ((1 << cache_bits) if cache_bits else 0))
    start = bits.at
    red = read_code(bits, 256)
    n, there = bits.at - start, bits.at
    bits.at = start
    written = bits.peek(n)
    bits.at = there
    if there + n <= bits.size and bits.peek(n) == written:  # the same bits make the same code
        blue, bits.at = red, there + n
    else:
        blue = read_code(bits, 256)
    return [green, red, blue, read_code(bits, 256), read_code(bits, 40)]


def _image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Pixels as ARGB (uint32) of an entropy-coded image; ``top``: it may have an entropy image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, block = None, 0
    if top and bits.read(1):
        block = bits.read(3) + 2
        meta = ((_image(bits, -(-width >> block), -(-height >> block), False) >> 8) & 0xFFFF).reshape(-(-height >> block), -1)
    groups = [_group(bits, cache_bits) for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    n = width * height
    if meta is None:
        return _one_group(bits, groups[0], n, width, cache_bits)
    out = np.zeros(n, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift, at, wide = 32 - cache_bits, 0, meta.tolist()
    while at < n:
        y, x = divmod(at, width)
        group = groups[wide[y >> block][x >> block]]
        s = group[0].next(bits)
        if s < 256:
            r, b, a = group[1].next(bits), group[2].next(bits), group[3].next(bits)
            out[at] = pixel = a << 24 | r << 16 | s << 8 | b
            if cache:
                cache[(0x1E35A7BD * pixel & 0xFFFFFFFF) >> shift] = pixel
            at += 1
        elif s < 256 + 24:
            length = _number(bits, s - 256)
            code = _number(bits, group[4].next(bits))
            back = code - 120 if code > 120 else max(1, NEARBY[code - 1][0] + NEARBY[code - 1][1] * width)
            if back > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + length):  # may overlap itself
                out[k] = pixel = int(out[k - back])
                if cache:
                    cache[(0x1E35A7BD * pixel & 0xFFFFFFFF) >> shift] = pixel
            at += length
        else:
            out[at] = pixel = cache[s - 256 - 24]
            cache[(0x1E35A7BD * pixel & 0xFFFFFFFF) >> shift] = pixel
            at += 1
    return out


#: Bits of which the steps are worked out at once, and bits that a step may reach beyond.
CHUNK, REACH = 1 << 14, 128


def _values(prefix: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers by their prefix codes and the bits after these, and how many of these bits count."""
    extra = np.maximum(prefix - 2, 0) >> 1
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + (after & ((1 << extra) - 1))) + 1, extra


def _steps(bits: Bits, codes: list[Code], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each literal, copy or cached pixel of one group: the green symbol, the pixel, and for copies length and distance code."""
    green, red, blue, alpha, far = codes
    found: list[tuple] = []
    made, wide = 0, bool((green.symbols >= 256).any())
    while made < n:
        size = min(bits.size - bits.at, CHUNK)
        if size <= 0:
            raise ValueError("the stream ends early")
        first, shift = divmod(bits.at, 8)
        part = bits.data[first : first + (shift + size + REACH) // 8 + 2] + b"\0" * (REACH // 8 + 16)
        windows = np.ndarray(((shift + size + REACH) // 8 + 1,), "<u8", part, strides=(1,))
        ahead = (windows[:, None] >> _EIGHT).view(np.int64).reshape(-1)[shift : shift + size + REACH]  # 57 bits or more from each bit on
        k = ahead[:size] & ((1 << green.width) - 1)
        here = np.arange(size + REACH)
        symbol, after = green.symbols.take(k), here[:size] + green.lengths.take(k)
        at, known = [after], {}
        for code in (red, blue, alpha):  # where the next channel begins
            if code.width and id(code) not in known:
                known[id(code)] = code.lengths.take(ahead & ((1 << code.width) - 1))
            at.append(at[-1] + known[id(code)].take(at[-1]) if code.width else at[-1])
        then = here  # what lies beyond waits for the next chunk
        then[:size] = at[3]
        if wide:
            many = np.flatnonzero(symbol >= 256)
            then[many] = after[many]  # a cached pixel has no more
            many = many[symbol[many] < 256 + 24]
            to = after[many]
            to = to + _values(symbol[many].astype(np.int64) - 256, ahead[to])[1]
            k = ahead[to] & ((1 << far.width) - 1)
            to = to + far.lengths[k]
            then[many] = to + _values(far.symbols[k].astype(np.int64), ahead[to])[1]
        two = then.take(then)
        steps, place, path = memoryview(two.take(two)), 0, []  # four steps in one
        while place < size:
            path.append(place)
            place = steps[place]
        on = np.array(path)
        on = np.stack((on, then[on], two[on], then[two[on]]), axis=1).reshape(-1)
        on = on[on < size]
        found_symbol, count, distance = symbol[on].astype(np.int64), np.ones(len(on), np.int64), np.zeros(len(on), np.int64)
        if wide:
            copy = np.flatnonzero((found_symbol >= 256) & (found_symbol < 256 + 24))
            to = after[on[copy]]
            count[copy], extra = _values(found_symbol[copy] - 256, ahead[to])
            to = to + extra
            k = ahead[to] & ((1 << far.width) - 1)
            distance[copy] = _values(far.symbols[k].astype(np.int64), ahead[to + far.lengths[k]])[0]
        total = np.cumsum(count)
        last = int(np.searchsorted(total, n - made)) + 1
        if last < len(on) or (last == len(on) and total[-1] + made >= n):  # all pixels are there
            on, found_symbol, count, distance = on[:last], found_symbol[:last], count[:last], distance[:last]
            place = int(then[on[-1]])
        made += int(total[min(last, len(total)) - 1])
        bits.at += place
        pixel = found_symbol << 8
        for code, begin, to in zip((red, blue, alpha), at, (16, 0, 24), strict=False):
            pixel |= (code.symbols[ahead[begin[on]] & ((1 << code.width) - 1)].astype(np.int64) if code.width else np.int64(code.only)) << to
        found.append((found_symbol, pixel, count, distance))
    if bits.at > bits.size:
        raise ValueError("the stream ends early")
    if made > n:
        raise ValueError("a back-reference leaves the image")
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _one_group(bits: Bits, codes: list[Code], n: int, width: int, cache_bits: int) -> np.ndarray:
    if not any(c.width for c in codes[:4]) and codes[0].only < 256:
        return np.full(n, codes[3].only << 24 | codes[1].only << 16 | codes[0].only << 8 | codes[2].only, np.uint32)
    return _placed(*_steps(bits, codes, n), n, width, cache_bits)


@lru_cache(64)
def _near(width: int) -> np.ndarray:
    """Distances by distance code."""
    return np.array([0, *(max(1, x + y * width) for x, y in NEARBY)])


def _placed(symbol: np.ndarray, pixel: np.ndarray, count: np.ndarray, code: np.ndarray, n: int, width: int, cache_bits: int) -> np.ndarray:
    """The pixels from what ``_steps`` found."""
    if len(symbol) == n and symbol.max() < 256:  # a literal each
        return pixel.astype(np.uint32)
    copy = (symbol >= 256) & (symbol < 256 + 24)
    back = np.where(code > 120, code - 120, _near(width)[np.minimum(code, 120)])
    place = np.cumsum(count) - count
    if (back > place)[copy].any():
        raise ValueError("a back-reference leaves the image")
    out, literal = np.zeros(n, np.uint32), symbol < 256
    runs = list(zip(place[copy].tolist(), count[copy].tolist(), back[copy].tolist(), strict=True))
    out[place[literal]] = pixel[literal]
    if not cache_bits:
        for at, length, far in runs:
            out[at : at + length] = out[at - far : at - far + length] if far >= length else np.resize(out[at - far : at], length)
        return out
    # a cached pixel is that which had its slot last, a copied one is its source; each chain ends at a literal
    shift = 32 - cache_bits
    slot, source, held = np.zeros(n, np.int64), np.arange(n), place[symbol >= 256 + 24]
    slot[place[literal]] = ((pixel[literal] * 0x1E35A7BD) & 0xFFFFFFFF) >> shift
    slot[held] = symbol[symbol >= 256 + 24] - 256 - 24
    for at, length, far in runs:
        slot[at : at + length] = slot[at - far : at - far + length] if far >= length else np.resize(slot[at - far : at], length)
        source[at : at + length] -= far
    order = np.argsort(slot.astype(np.int16), kind="stable")  # by radix
    before, same = np.full(n, -1), slot[order[1:]] == slot[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    if (before[held] < 0).any():
        return _one_by_one(symbol, pixel, count, back, cache_bits)
    source[held] = before[held]
    while True:
        further = source[source]
        if (further == source).all():
            return out[source]
        source = further


def _one_by_one(symbol: np.ndarray, pixel: np.ndarray, count: np.ndarray, back: np.ndarray, cache_bits: int) -> np.ndarray:
    """The same in order, for images that read slots of the cache which nothing was put into (0)."""
    cache, made, shift = [0] * (1 << cache_bits), [], 32 - cache_bits
    for s, p, length, far in zip(symbol.tolist(), pixel.tolist(), count.tolist(), back.tolist(), strict=True):
        for _ in range(length if 256 <= s < 256 + 24 else 1):
            q = p if s < 256 else cache[s - 256 - 24] if s >= 256 + 24 else made[-far]
            cache[((0x1E35A7BD * q) & 0xFFFFFFFF) >> shift] = q
            made.append(q)
    return np.array(made, np.uint32)


def _split(pixels: np.ndarray) -> np.ndarray:
    """ARGB to an array of the four channels (b, g, r, a)."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)


def _floor_half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


#: Predictions that need only the row above: left of it, above, right of it.
ABOVE = {2: lambda c, u, r: u, 3: lambda c, u, r: r, 4: lambda c, u, r: c, 8: lambda c, u, r: _floor_half(c, u), 9: lambda c, u, r: _floor_half(u, r)}


def _unpredict(pixels: np.ndarray, modes: np.ndarray, block: int, width: int, height: int) -> np.ndarray:
    """Rows are taken at once where a prediction needs only the row above, or the left pixel alone (a running sum); others go pixel by pixel."""
    out = _split(pixels).astype(np.int64).reshape(height, width, 4)
    out[0, 0] += BLACK
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, up = out[y], out[y - 1]
        row[0] = (row[0] + up[0]) & 255
        if width == 1:
            continue
        mode = modes[y >> block]
        kinds = set(mode)
        wide = np.repeat(mode, 1 << block)[:width] if len(kinds) > 1 else None
        right = np.concatenate((up[1:], row[:1]))
        for kind in kinds & {0, 14, 15, *ABOVE}:
            guess = ABOVE[kind](up[:-1], up[1:], right[1:]) if kind in ABOVE else BLACK
            if wide is None:
                row[1:] = (row[1:] + guess) & 255
            else:
                here = np.flatnonzero(wide[1:] == kind)
                row[here + 1] = (row[here + 1] + (guess[here] if kind in ABOVE else guess)) & 255
        if kinds - {0, 14, 15, *ABOVE}:
            for k, kind in enumerate(mode):
                first, last = max(1, k << block), min(width, (k + 1) << block)
                if kind == 1:
                    row[first - 1 : last] = np.cumsum(row[first - 1 : last], axis=0) & 255
                elif kind not in ABOVE and 0 < kind < 14:
                    _by_pixel(row, up, right, kind, first, last)
    return out.astype(np.uint8).reshape(height * width, 4).view("<u4").reshape(-1)


BLACK = np.array([0, 0, 0, 255])


def _by_pixel(row: np.ndarray, up: np.ndarray, right: np.ndarray, kind: int, first: int, last: int) -> None:
    """Add the predictions that mix the left pixel with those above."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    left = row[first - 1].tolist()
    for x in range(first, last):
        top, corner = up[x].tolist(), up[x - 1].tolist()
        if kind == 5:
            p = half(half(left, right[x].tolist()), top)
        elif kind == 6:
            p = half(left, corner)
        elif kind == 7:
            p = half(left, top)
        elif kind == 10:
            p = half(half(left, corner), half(top, right[x].tolist()))
        elif kind == 11:
            to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
            to_up = sum(abs(t - c) for t, c in zip(left, corner, strict=True))
            p = left if to_left < to_up else top
        elif kind == 12:
            p = [clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
        else:
            p = [clamp(a + int((a - c) / 2)) for a, c in zip(half(left, top), corner, strict=True)]
        left = [(v + q) & 255 for v, q in zip(row[x].tolist(), p, strict=True)]
        row[x] = left


def _uncross(pixels: np.ndarray, elements: np.ndarray, block: int, width: int, height: int) -> np.ndarray:
    c = _split(pixels).reshape(height, width, 4).copy()
    e = _split(elements).reshape(-(-height >> block), -(-width >> block), 4).repeat(1 << block, 0).repeat(1 << block, 1)[:height, :width].view(np.int8).astype(np.int64)
    signed = lambda x: x.view(np.int8).astype(np.int64)
    green = signed(np.ascontiguousarray(c[..., 1]))
    red = (c[..., 2] + ((e[..., 0] * green) >> 5)).astype(np.uint8)
    blue = (c[..., 0] + ((e[..., 1] * green) >> 5) + ((e[..., 2] * signed(red)) >> 5)).astype(np.uint8)
    c[..., 2], c[..., 0] = red, blue
    return c.reshape(-1, 4).view("<u4").reshape(-1)


def _decoding(data: bytes, most_pixels: int) -> Iterator[tuple[Bits, int, int, bool]]:
    """``decode``, as a generator that asks for the pixels of each image that stands next (``_image``), the transforms' first."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, chunk = 12, None
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"VP8L":
            chunk = data[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    if chunk is None or chunk[:1] != b"\x2f":
        raise ValueError("no lossless image")
    bits = Bits(chunk)
    bits.at = 8
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if width * height > most_pixels:
        raise ValueError("more pixels than allowed")
    alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    full, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            block = bits.read(3) + 2
            undo.append((kind, width, block, (yield bits, -(-width >> block), -(-height >> block), False)))
        elif kind == 2:
            undo.append((kind, width, 0, None))
        else:
            n = bits.read(8) + 1
            palette = np.cumsum(_split((yield bits, n, 1, False)), axis=0, dtype=np.uint8)
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, width, packed, palette))
            width = -(-width >> packed)
    return _closed((yield bits, width, height, True), height, full, alpha, undo)


def _closed(pixels: np.ndarray, height: int, full: int, alpha: int, undo: list[tuple]) -> np.ndarray:
    """The samples of an image after its transforms are undone."""
    for kind, width, block, extra in reversed(undo):
        if kind == 0:
            pixels = _unpredict(pixels, ((extra >> 8) & 15).reshape(-1, -(-width >> block)).tolist(), block, width, height)
        elif kind == 1:
            pixels = _uncross(pixels, extra, block, width, height)
        elif kind == 2:
            c = _split(pixels).copy()
            c[:, 0] += c[:, 1]
            c[:, 2] += c[:, 1]
            pixels = c.view("<u4").reshape(-1)
        else:
            index = ((pixels >> 8) & 255).reshape(height, -1)
            if block:
                each = 8 >> block
                index = ((index[:, :, None] >> (np.arange(1 << block) * each)) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
            table = np.zeros((256, 4), np.uint8)
            table[: len(extra)] = extra
            pixels = table[index.reshape(-1)].view("<u4").reshape(-1)
    pixels = pixels.astype("<u4")
    swapped = pixels & 0xFF00FF00 | pixels >> 16 & 0xFF | (pixels & 0xFF) << 16  # to red, green, blue, alpha
    if not alpha:
        swapped |= 0xFF000000
    return swapped.view(np.uint8).reshape(height, full, 4)


def decode(data: bytes, most_pixels: int = 1 << 26) -> np.ndarray:
    """The pixels of a lossless WebP file: height x width x 4 (red, green, blue, alpha). A few bytes can name a very large image of one
    colour; beyond ``most_pixels`` that is an error."""
    steps = _decoding(data, most_pixels)
    asked = next(steps)
    while True:
        try:
            asked = steps.send(_image(*asked))
        except StopIteration as e:
            return e.value


# --- many files at once ------------------------------------------------------------------------------------------------

#: Lanes below which images go on one by one; files, and bytes of them, that are read side by side.
FEW_LANES, SIDE_BY_SIDE, SIDE_BYTES = 128, 6000, 12_000_000
#: By green symbol or distance prefix: the least number meant, and the bits that are added to it.
_EXTRAS = np.array([0] * 4 + [(k - 2) >> 1 for k in range(4, 40)])
_BASES = np.array([k + 1 for k in range(4)] + [((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(4, 40)])
_ONES = (1 << np.arange(64, dtype=np.int64)) - 1


class _Lanes:
    """Files side by side: a step is taken in all of them by the same few array operations."""

    def __init__(self, every: list[Bits]) -> None:
        self.every = every
        starts = np.cumsum([0, *(len(b.data) for b in every)])
        self.start = 8 * starts[:-1]
        joined = b"".join([*(b.data for b in every), b"\0" * 16])
        self.windows = np.ndarray((len(joined) - 8,), "<i8", joined, strides=(1,))
        self.last = len(joined) - 9

    def ahead(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each place on; those above are of no meaning."""
        return self.windows[np.minimum(at >> 3, self.last)] >> (at & 7)  # take would copy all windows

    def codes(self, lanes: list[int], alphabets: list[int]) -> list[Code]:
        """The codes that stand next in these lanes, as ``read_code`` would read them one by one."""
        found: dict[int, Code] = {}
        begun, many, tables, places = {}, [], [], {}
        for i, alphabet in zip(lanes, alphabets, strict=True):
            bits = self.every[i]
            begun[i] = bits.at
            if not bits.peek(1):
                bits.at += 1
                n = 4 + bits.read(4)
                value = bits.read(3 * n)
                symbols, sizes, width, _ = _steps_code(n, value)
                if 0 < width and not bits.read(1):
                    if (n, value) not in places:
                        places[n, value] = 128 * len(tables)
                        tables.append(np.pad(symbols | sizes << 8 | _EXTRA[symbols] << 16 | _LEAST[symbols] << 24, (0, 128 - len(symbols))))
                    many.append((i, alphabet, places[n, value], (1 << width) - 1))
                    continue
            bits.at = begun[i]
            found[i] = read_code(bits, alphabet)
        if not many:
            return [found[i] for i in lanes]
        lane, wanted, base, mask = np.array(many).T
        table, pos, row, at = np.concatenate(tables), self.start[lane] + np.array([self.every[i].at for i in lane.tolist()]), np.arange(len(lane)), np.zeros(len(lane), np.int64)
        lengths = np.zeros((len(lane), int(wanted.max())), np.uint8)
        ended, good = np.zeros(len(lane), np.int64), np.zeros(len(lane), bool)
        live_wanted, broken = wanted, np.zeros(len(lane), bool)
        while len(row):
            w = self.ahead(pos)
            e = table.take((w & mask) + base)
            symbol, n, extra = e & 255, (e >> 8) & 255, (e >> 16) & 255
            lengths[row, at] = np.where(symbol < 16, symbol, 0)
            broken[row[symbol == 16]] = True  # lengths that are repeated: one by one
            at = at + (e >> 24) + ((w >> n) & _ONES.take(extra))
            pos = pos + n + extra
            on = at < live_wanted
            if not on.all():
                off = ~on
                ended[row[off]], good[row[off]] = pos[off], at[off] == live_wanted[off]
                row, at, pos, mask, base, live_wanted = row[on], at[on], pos[on], mask[on], base[on], live_wanted[on]
        ended -= self.start[lane]
        good &= ~broken
        made = [code for k in range(0, len(lengths), 256) for code in _many_codes(lengths[k : k + 256])]
        for k, i in enumerate(lane.tolist()):
            bits = self.every[i]
            if good[k] and made[k] is not None and ended[k] <= bits.size:
                bits.at, found[i] = int(ended[k]), made[k]
            else:
                bits.at = begun[i]
                found[i] = read_code(bits, int(wanted[k]))
        return [found[i] for i in lanes]

    def images(self, lanes: list[int], asked: list[tuple[Bits, int, int, bool]]) -> Iterator[np.ndarray]:
        """The images that stand next in these lanes, as ``_image`` would read them one by one."""
        caches, sizes = {}, {}
        for i in lanes:
            bits, width, height, top = asked[i]
            begun, sizes[i] = bits.at, width * height
            cache_bits = bits.read(4) if bits.read(1) else 0
            if cache_bits > 11 or top and bits.read(1):  # an entropy image: one by one
                bits.at = begun
            else:
                caches[i] = cache_bits
        side = list(caches)
        codes = [self.codes(side, [256 + 24 + ((1 << c) if c else 0) for c in caches.values()])]
        begun = [self.every[i].at for i in side]
        codes.append(self.codes(side, [256] * len(side)))
        blue, apart = dict(zip(side, codes[1], strict=True)), []
        for i, start in zip(side, begun, strict=True):
            bits = self.every[i]
            n = bits.at - start
            if bits.at + n <= bits.size and bits.peek(n) == bits.peek(n, start):  # the same bits make the same code
                bits.at += n
            else:
                apart.append(i)
        blue |= dict(zip(apart, self.codes(apart, [256] * len(apart)), strict=True))
        codes.append([blue[i] for i in side])
        codes += [self.codes(side, [size] * len(side)) for size in (256, 40)]
        groups = dict(zip(side, map(list, zip(*codes, strict=True)), strict=True))
        fit = [i for i, (g, r, b, a, f) in groups.items() if g.width and g.width + r.width + b.width + a.width <= 57 and g.width + 10 + f.width + 18 <= 57]
        found, fit = self.pixels(fit, [groups[i] for i in fit], [sizes[i] for i in fit], [asked[i][1] for i in fit], [caches[i] for i in fit]), set(fit)
        for i in lanes:
            bits, width, height, top = asked[i]
            if i in fit:
                yield next(found)
            elif i in groups:
                yield _one_group(bits, groups[i], sizes[i], width, caches[i])
            else:
                yield _image(bits, width, height, top)

    def pixels(self, lanes: list[int], groups: list[list[Code]], counts: list[int], widths: list[int], caches: list[int]) -> Iterator[np.ndarray]:
        """As ``_one_group`` for each lane; the last few lanes, of the largest images, are left to it."""
        parts, places, upto = [], {}, 0
        for group in groups:
            for code in group:
                if id(code) not in places:
                    places[id(code)] = upto
                    parts.append(code.symbols.astype(np.uint16) | code.lengths.astype(np.uint16) << 12)  # small, as all tables are used at once
                    upto += len(code.symbols)
        table = np.concatenate(parts)
        green, red, blue, alpha, far = (np.array([places[id(g[k])] for g in groups]) for k in range(5))
        green_mask, red_mask, blue_mask, alpha_mask, far_mask = (np.array([(1 << g[k].width) - 1 for g in groups]) for k in range(5))
        clear = not alpha_mask.any()  # alpha has no bits
        if clear:
            alpha, alpha_mask = np.zeros((2, 0), np.int64)
        begun, size = np.array([self.every[i].at for i in lanes]), np.array([self.every[i].size for i in lanes])
        pos, left, last = self.start[lanes] + begun, np.array(counts), self.start[lanes] + size
        room = np.minimum(left, size - begun + 1)  # a step takes a bit at least
        first = np.cumsum(room) - room
        told, row, to = np.zeros(int(room.sum()), np.int64), np.arange(len(lanes)), first.copy()
        ends = [(0, 0, 0)] * len(lanes)

        def end(off: np.ndarray) -> None:
            for k, a, b, c in zip(row[off].tolist(), to[off].tolist(), pos[off].tolist(), left[off].tolist(), strict=True):
                ends[k] = a, b, c

        while len(row) >= FEW_LANES:
            w = self.windows[pos >> 3]
            w >>= pos & 7
            e = table.take((w & green_mask) + green)
            symbol, n = e & 0xFFF, (e >> 12).astype(np.int64)
            w >>= n
            e = table.take((w & red_mask) + red)
            used = (e >> 12).astype(np.int64)
            f = table.take(((w >> used) & blue_mask) + blue)
            used += f >> 12
            if not clear:
                a = table.take(((w >> used) & alpha_mask) + alpha)
                used += a >> 12
            used += n
            out = symbol * np.int64(1 << 40 | 1 << 8)
            out += (e & 0xFFF) * np.int64(1 << 16)
            out += f & 0xFFF
            if not clear:
                out += (a & 0xFFF) * np.int64(1 << 24)
            left -= 1
            other = (symbol >= 256).nonzero()[0]
            if len(other):
                s, w, n = symbol[other].astype(np.int64), w[other], n[other]
                used[other], out[other] = n, s << 40  # a cached pixel has no more
                copy = (s < 256 + 24).nonzero()[0]
                if len(copy):
                    if len(copy) < len(s):
                        other, s, w, n = other[copy], s[copy], w[copy], n[copy]
                    s = s - 256
                    extra = _EXTRAS.take(s)
                    length = _BASES.take(s) + (w & _ONES.take(extra))
                    w >>= extra
                    e = table.take((w & far_mask[other]) + far[other])
                    more, e = (e >> 12).astype(np.int64), e & 0xFFF
                    back = _EXTRAS.take(e)
                    out[other] |= length << 21 | _BASES.take(e) + ((w >> more) & _ONES.take(back))
                    used[other] = n + extra + more + back
                    left[other] -= length - 1
            told[to] = out
            to += 1
            pos += used
            on = (left > 0) & (pos <= last)
            if not on.all():
                end(~on)
                row, to, last, pos, left, green, red, blue, far, green_mask, red_mask, blue_mask, far_mask = (x[on] for x in (row, to, last, pos, left, green, red, blue, far, green_mask, red_mask, blue_mask, far_mask))
                if not clear:
                    alpha, alpha_mask = alpha[on], alpha_mask[on]
        end(np.ones(len(row), bool))
        done: list[int] = []

        def placed() -> Iterator[np.ndarray]:
            """The images of lanes that came to their ends."""
            if done:
                yield from _placed_many([told[first[k] : ends[k][0]] for k in done], [counts[k] for k in done], [widths[k] for k in done], [caches[k] for k in done])
                done.clear()

        pixels = 0
        for k, i in enumerate(lanes):
            bits, (upto, at, rest) = self.every[i], ends[k]
            bits.at = at - int(self.start[i])
            if bits.at > bits.size:
                raise ValueError("the stream ends early")
            if rest < 0:
                raise ValueError("a back-reference leaves the image")
            if clear and (only := groups[k][3].only):
                told[first[k] : upto] |= np.where(told[first[k] : upto] >> 40 < 256, only << 24, 0)
            if rest:
                yield from placed()
                four = (np.concatenate(x) for x in zip(_told(told[first[k] : upto]), _steps(bits, groups[k], rest), strict=True))
                yield _placed(*four, counts[k], widths[k], caches[k])
                continue
            if pixels + counts[k] > TOGETHER_PIXELS:
                yield from placed()
            pixels = pixels + counts[k] if done else counts[k]
            done.append(k)
        yield from placed()


def _told(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What lanes tell of steps, as ``_steps`` does: the green symbol; a literal's pixel, or a copy's length and distance code."""
    symbol = steps >> 40
    copy = (symbol >= 256) & (symbol < 256 + 24)
    return symbol, steps & 0xFFFFFFFF, np.where(copy, (steps >> 21) & 0x1FFF, 1), np.where(copy, steps & 0x1FFFFF, 0)


def _ends(source: np.ndarray, some: np.ndarray) -> None:
    """Follow the chains of ``source`` from some places to their ends."""
    while len(some):
        to = source[some]
        further = source[to]
        source[some] = further
        some = some[further != to]


def _placed_many(told: list[np.ndarray], sizes: list[int], widths: list[int], caches: list[int]) -> Iterator[np.ndarray]:
    """As ``_placed`` of what lanes tell, with many images as one array."""
    steps, n = np.concatenate(told), np.array(sizes)
    owner, begin = np.repeat(np.arange(len(told)), [len(x) for x in told]), np.cumsum(n) - n
    symbol = steps >> 40
    literal = symbol < 256
    out, copied = np.zeros(int(n.sum()), np.uint32), np.zeros(0, np.int64)
    if literal.all():
        out[:] = steps & 0xFFFFFFFF
    else:
        copy, held = ((symbol >= 256) & (symbol < 256 + 24)).nonzero()[0], (symbol >= 256 + 24).nonzero()[0]
        count = np.ones(len(steps), np.int64)
        count[copy] = length = (steps[copy] >> 21) & 0x1FFF
        place, code, of = np.cumsum(count) - count, steps[copy] & 0x1FFFFF, owner[copy]
        x, y = _NEARBY.take(np.minimum(code, 120), axis=1)
        back = np.where(code > 120, code - 120, np.maximum(1, x + y * np.array(widths)[of]))
        if (back > place[copy] - begin[of]).any():
            raise ValueError("a back-reference leaves the image")
        out[place[literal]] = steps[literal] & 0xFFFFFFFF
        source = np.arange(len(out))
        if len(copy):
            copied = np.repeat(place[copy] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            source[copied] -= np.repeat(back, length)
            _ends(source, copied)
        if len(held):  # a cached pixel is that which had its slot last
            bits = np.array(caches)
            most, slot = int(bits.max()), np.zeros(len(out), np.int64)
            slot[place[literal]] = (steps[literal] & 0xFFFFFFFF) * 0x1E35A7BD % (1 << 32) >> (32 - bits)[owner[literal]]
            slot[place[held]] = symbol[held] - 256 - 24
            slot[copied] = slot[source[copied]]
            slot += np.repeat(np.arange(len(told)) << most, n)
            order = np.argsort(slot.astype(np.uint16) if len(told) << most <= 1 << 16 else slot, kind="stable")  # by radix
            before, same = np.full(len(out), -1), slot[order[1:]] == slot[order[:-1]]
            before[order[1:][same]] = order[:-1][same]
            held = place[held]
            if (before[held] < 0).any():  # slots that nothing was put into
                for some, *rest in zip(told, sizes, widths, caches, strict=True):
                    yield _placed(*_told(some), *rest)
                return
            source[held] = before[held]
            copied = np.concatenate((held, copied))
            _ends(source, copied)
        out[copied] = out[source[copied]]
    yield from np.split(out, begin[1:])


#: Of distance codes 1 to 120: across and down.
_NEARBY = np.array([(0, 0), *NEARBY]).T


def _many_codes(lengths: np.ndarray) -> list[Code | None]:
    """The code of each row of lengths; None where ``Code`` is to tell what is wrong, or there are under two symbols."""
    which, symbol = np.nonzero(lengths)
    size = lengths[which, symbol].astype(np.int64)
    width = lengths.max(axis=1).astype(np.int64)
    order = np.argsort(which << 4 | size, kind="stable")
    which, symbol, size = which[order], symbol[order], size[order]
    shares = 1 << (width[which] - size)
    whole = np.bincount(which, shares, len(lengths)) == 1 << width
    whole &= np.bincount(which, minlength=len(lengths)) > 1
    kept = whole[which]
    which, symbol, size, shares = which[kept], symbol[kept], size[kept], shares[kept]
    total = np.where(whole, 1 << width, 0)
    begin = np.cumsum(total) - total
    of = np.repeat(np.arange(len(lengths)), total)
    place = begin[of] + (_TURNED.take(np.arange(len(of)) - begin[of]) >> (16 - width[of]))
    symbols, sizes = np.empty(len(of), np.int16), np.empty(len(of), np.uint8)
    symbols[place], sizes[place] = np.repeat(symbol, shares), np.repeat(size, shares)
    return [Code.known(w, symbols[b : b + t], sizes[b : b + t]) if t else None for w, b, t in zip(width.tolist(), begin.tolist(), total.tolist(), strict=True)]


def decode_many(files: list[bytes], most_pixels: int = 1 << 26) -> Iterator[np.ndarray]:
    """As ``decode`` of each file in turn, with codes and pixels of many read side by side."""
    some, size = [], 0
    for x in files:
        if len(some) == SIDE_BY_SIDE or some and size + len(x) > SIDE_BYTES:
            yield from _side_by_side(some, most_pixels)
            some, size = [], 0
        some.append(x)
        size += len(x)
    yield from _side_by_side(some, most_pixels)


def _side_by_side(files: list[bytes], most_pixels: int) -> Iterator[np.ndarray]:
    every = [_decoding(x, most_pixels) for x in files]
    asked = [next(steps) for steps in every]
    lanes = _Lanes([bits for bits, *_ in asked])
    while some := [i for i, (*_, top) in enumerate(asked) if not top]:  # images of the transforms
        for i, pixels in zip(some, lanes.images(some, asked), strict=True):
            asked[i] = every[i].send(pixels)
    for steps, pixels in zip(every, lanes.images(list(range(len(files))), asked), strict=True):
        try:
            steps.send(pixels)
        except StopIteration as e:
            yield e.value


# --- writer ------------------------------------------------------------------------------------------------------------

MOST_LENGTH = 11  # bits of a code; 15 are allowed, but the reader's tables grow with it
TOGETHER, TOGETHER_PIXELS = 128, 400_000  # images, and pixels of them, that are worked on as one array
CACHE_BITS = 7
#: Lengths of the code for code lengths: all are used but 16.
STEP_LENGTHS = np.array([5 if s in (1, 13, 14, 15) else 4 for s in range(16)] + [0, 4, 4])


def code_lengths(counts: np.ndarray, most: int = MOST_LENGTH) -> np.ndarray:
    """Huffman's lengths for symbols with counts; where one would be longer than ``most``, counts are evened out."""
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths = np.zeros(len(counts), np.int64)
        lengths[used if len(used) else [0]] = 1
        return lengths
    return _many_lengths(counts, np.array([len(counts)]), most)


def _many_lengths(flat: np.ndarray, sizes: np.ndarray, most: int = MOST_LENGTH) -> np.ndarray:
    """As ``code_lengths`` of each run of counts (``sizes`` tells their lengths), of two symbols or more: a step is taken in all of them."""
    used, of = np.flatnonzero(flat), np.repeat(np.arange(len(sizes)), sizes)
    n = np.bincount(of[used], minlength=len(sizes))
    rank = np.argsort(-n, kind="stable")  # those with most symbols first
    lane = np.empty_like(rank)
    lane[rank] = np.arange(len(rank))
    n, lane, lanes = n[rank], lane[of[used]], len(rank)
    order = np.argsort(lane << 32 | flat[used], kind="stable")
    used, lane = used[order], lane[order]
    place = (np.arange(len(used)) - (np.cumsum(n) - n)[lane]) * lanes + lane
    weights, inner = np.full((n[0] + 1) * lanes, 1 << 62), np.full(n[0] * lanes, 1 << 62)
    weights[place] = flat[used]
    above, above_inner = np.zeros(len(weights), np.int64), np.zeros(len(inner), np.int64)
    live = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="left").tolist()  # lanes with more symbols than that
    i, j = np.arange(lanes), np.arange(lanes)
    for k in range(n[0] - 1):  # the two least of the leaves, and of the nodes made before, which are in order too
        if live[k] < len(i):
            i, j = i[: live[k]], j[: live[k]]
        total = 0
        for _ in range(2):
            x, y = weights.take(i), inner.take(j)
            above[i], above_inner[j] = k, k  # the last to write it has taken it
            total = total + np.minimum(x, y)
            leaf = (x <= y) * lanes
            i += leaf
            j += lanes - leaf
        inner[k * lanes : k * lanes + len(i)] = total
    depth = np.zeros(len(inner), np.int64)
    for k in range(n[0] - 3, -1, -1):
        here = slice(k * lanes, k * lanes + live[k + 1])
        depth[here] = depth.take(above_inner[here] * lanes + np.arange(live[k + 1])) + 1
    found = depth.take(above[place] * lanes + lane) + 1
    lengths = np.zeros(len(flat), np.int64)
    lengths[used] = found
    long = np.zeros(len(sizes), bool)
    long[rank[lane[found > most]]] = True
    if long.any():
        again = long[of]
        lengths[again] = _many_lengths(np.where(flat > 0, (flat >> 1) | 1, 0)[again], sizes[long], most)
    return lengths


def _codes(lengths: np.ndarray, code: np.ndarray | None = None) -> np.ndarray:
    """The canonical codes as they stand in the stream, the first bit lowest; of many complete codes, where ``code`` numbers them."""
    used = np.flatnonzero(lengths > 0)
    size = lengths[used] if code is None else lengths[used] | code[used] << 4
    order = used[np.argsort(size, kind="stable")]
    shares = 1 << (16 - lengths[order])
    out = np.zeros(len(lengths), np.int64)
    out[order] = _TURNED[(np.cumsum(shares) - shares) & 0xFFFF]
    return out


STEP_CODES = _codes(STEP_LENGTHS)
#: What stands before the code lengths: an ordinary code, the lengths of all 19 steps, lengths for the whole alphabet.
_STEPS_HEAD = (15 << 1 | sum(int(STEP_LENGTHS[s]) << (5 + 3 * k) for k, s in enumerate(LENGTH_ORDER)), 1 + 4 + 57 + 1)


def _zeros(gap: int) -> tuple[int, int]:
    """Up to 138 lengths of zero: value and bits."""
    if gap < 3:
        return sum(int(STEP_CODES[0]) << (k * int(STEP_LENGTHS[0])) for k in range(gap)), gap * int(STEP_LENGTHS[0])
    s, least, extra = (17, 3, 3) if gap < 11 else (18, 11, 7)
    return int(STEP_CODES[s]) | (gap - least) << int(STEP_LENGTHS[s]), int(STEP_LENGTHS[s]) + extra


_ZEROS = np.array([_zeros(g) for g in range(139)], np.int64).T


@lru_cache(64)
def _near_codes(width: int) -> np.ndarray:
    """Distance codes by distance, as far as there are nearby pixels."""
    codes = np.arange(8 * width + 9) + 120
    for k, (x, y) in reversed(list(enumerate(NEARBY))):
        codes[max(1, x + y * width)] = k + 1
    return codes


def _joined(files: list[list[tuple[np.ndarray, np.ndarray]]]) -> list[bytes]:
    """The bytes of each file's fields (values and sizes in bits), the first bit lowest; each file begins at a whole word."""
    values, sizes = (np.concatenate([part[k] for parts in files for part in parts]).astype(kind, copy=False) for k, kind in ((0, np.uint64), (1, np.int64)))
    n = np.array([sum(len(part[1]) for part in parts) for parts in files])
    total = np.add.reduceat(sizes, np.cumsum(n) - n)
    words = (total + 127) >> 6  # and one for what reaches over
    start = np.cumsum(words) - words
    begin = np.cumsum(sizes) - sizes + np.repeat(64 * start - (np.cumsum(total) - total), n)
    word, shift = begin >> 6, (begin & 63).astype(np.uint64)
    out = np.zeros(int(words.sum()), np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[first]] = np.add.reduceat(values << shift, first)  # fields don't overlap, so sums join them
    over = np.flatnonzero((begin & 63) + sizes > 64)
    out[word[over] + 1] += values[over] >> (np.uint64(64) - shift[over])
    whole = out.tobytes()
    return [whole[8 * a : 8 * a + (b + 7 >> 3)] for a, b in zip(start.tolist(), total.tolist(), strict=True)]


def _made_codes(every: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For counts of symbols, each: the prefix code's codes and lengths, and the fields that write it (values and sizes)."""
    found: list = [None] * len(every)
    ordinary, asked = [], []
    for k, counts in enumerate(every):
        some = np.flatnonzero(counts).tolist()
        if len(some) < 3 and (not some or some[-1] < 256):
            some = some or [0]
            codes, sizes = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            if len(some) == 2:
                codes[some[1]], sizes[some] = 1, 1
            found[k] = codes, sizes, np.array([5 | (len(some) - 1) << 1, *some]), np.array([3, *[8] * len(some)])  # one or two symbols of 8 bits
            continue
        if len(some) == 1:
            counts = counts.copy()
            counts[0] += 1
        ordinary.append(k)
        asked.append(counts)
    if not ordinary:
        return found
    sizes = np.array([len(counts) for counts in asked])
    flat = np.insert(_many_lengths(np.concatenate(asked), sizes), np.cumsum(sizes), -1)  # an end stands after each code's lengths
    codes = _codes(flat, np.repeat(np.arange(len(ordinary)), sizes + 1))
    at = np.flatnonzero(flat)
    gap = at - 1
    gap[0], gap[1:] = at[0], gap[1:] - at[:-1]
    step, size = STEP_CODES[flat[at]], STEP_LENGTHS[flat[at]]
    step[flat[at] < 0], size[flat[at] < 0] = 0, 0
    more = np.maximum(gap - 1, 0) // 138  # more than one run of zeros
    last = np.cumsum(more + 1) - 1
    value, n = np.full(last[-1] + 1, _ZEROS[0][138]), np.full(last[-1] + 1, _ZEROS[1][138])
    gap -= 138 * more
    value[last], n[last] = _ZEROS[0][gap] | step << _ZEROS[1][gap], _ZEROS[1][gap] + size
    begin, upto = 0, 0
    for k, end in zip(ordinary, (last[flat[at] < 0] + 1).tolist(), strict=True):
        here = slice(upto, upto + len(every[k]))
        found[k] = codes[here], flat[here], np.append(_STEPS_HEAD[0], value[begin:end]), np.append(_STEPS_HEAD[1], n[begin:end])
        begin, upto = end, here.stop + 1
    return found


def _copies(px: np.ndarray, begin: np.ndarray, least: int = 3, most: int = 4096, far: int = (1 << 20) - 120) -> np.ndarray:
    """Place, length and distance of runs of pixels that stand before in their image (images begin at ``begin``): always the last place at
    which the same three pixels stood."""
    n, images = len(px) - least + 1, len(begin)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    key = px[1 : n + 1].astype(np.uint64)
    key <<= np.uint64(32)
    key |= px[:n]
    key = mix(key)
    key ^= px[2:]
    key *= np.uint64(0x9E3779B97F4A7C15)
    if images > 1:  # the image stands in the key's high bits
        high = np.uint64((images - 1).bit_length())
        key >>= high
        key |= np.repeat(np.arange(images, dtype=np.uint64) << (np.uint64(64) - high), np.diff(begin, append=len(px)))[:n]
    low = np.uint64((1 << n.bit_length()) - 1)  # and the place in the low bits, so a plain sort does
    key &= ~low
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & low).view(np.int64)
    key &= ~low
    again = np.flatnonzero(key[1:] == key[:-1])
    del key
    back = np.zeros(n + 1, np.int64)
    to = order[again + 1]
    back[to] = to - order[again]
    for k in range(1, least):  # too near the end of an image
        back[np.minimum(begin[1:] - k, n)] = 0
    at = np.flatnonzero(back)
    before = at - back[at]
    same = (px[at] == px[before]) & (px[at + 1] == px[before + 1]) & (px[at + 2] == px[before + 2])
    if images > 1 and not same.all():  # keys that meet by chance must not depend on what else is in the batch
        cuts = [*begin.tolist(), len(px)]
        return np.concatenate([_copies(px[a:b], begin[:1], least, most, far) + np.array([a, 0, 0]) for a, b in zip(cuts, cuts[1:], strict=False)])
    back[at[~same | (back[at] > far)]] = 0
    edges = np.flatnonzero(back[1:] != back[:-1]) + 1  # nothing stands before the first
    runs = np.flatnonzero(back[edges])
    out, reached = [], 0
    for first, end, distance in zip(edges[runs].tolist(), (edges[runs + 1] + least - 1).tolist() if len(runs) else (), back[edges[runs]].tolist(), strict=True):
        place = first if first > reached else reached
        if end - place >= least:
            out += [(k, min(most, end - k), distance) for k in range(place, end, most)] if end - place > most else [(place, end - place, distance)]
            reached = end
    return np.array(out, np.int64).reshape(-1, 3)


def _weights(counts: np.ndarray) -> np.ndarray:
    """n log2 n in 2**-20; sums of whole numbers don't depend on their order."""
    out = _WEIGHTS.take(counts, mode="clip")
    for k in np.flatnonzero(counts >= len(_WEIGHTS)):
        n = int(counts.flat[k])
        out.flat[k] = round(n * math.log2(n) * (1 << 20))
    return out


_WEIGHTS = np.array([0, *(round(n * math.log2(n) * (1 << 20)) for n in range(1, 1 << 13))])


def _entropy(*counts: np.ndarray) -> np.ndarray:
    """Bits (in 2**-20) that symbols with these counts take, by row."""
    return sum(_weights(c.sum(axis=1)) - _weights(c).sum(axis=1) for c in counts)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix code, extra bits and how many, of numbers from 1."""
    if len(values) and len(_PREFIXES[0]) and values.max() < len(_PREFIXES[0]):
        return tuple(x.take(values) for x in _PREFIXES)
    v = values - 1
    extra = np.maximum(np.frexp(v.astype(np.float64))[1] - 2, 0)
    extra = np.where(v < 4, 0, extra)
    return np.where(v < 4, v, 2 * extra + ((v >> extra) & 1) + np.where(v < 4, 0, 2)), v & ((1 << extra) - 1), extra


_PREFIXES = ((), (), ())
_PREFIXES = tuple(np.concatenate(([0], x)) for x in _prefixes(np.arange(1, 1 << 14)))


class _Image(NamedTuple):
    """Pixels (ARGB) to write; ``top``: not part of a transform; ``cache``: whether a colour cache is tried."""

    px: np.ndarray
    width: int
    top: bool = False
    cache: bool = False


def _written(images: list[_Image]) -> Iterator[list[np.ndarray]]:
    """The fields (values and sizes) that write each image: prefix codes for one group, back-references, and a colour cache where that saves bits.

    All images are worked on as one array. The codes are asked for (``_made_codes``), so that those of many arrays are made together.
    """
    found: list = [None] * len(images)
    for i, (px, _, top, _) in enumerate(images):
        if len(px) == 1:  # codes of one symbol
            value = sum((5 | (int(px[0]) >> 8 * k & 255) << 3) << 11 * j for j, k in enumerate((1, 2, 0, 3))) | 5 << 44
            found[i] = [(np.array([value << (1 + top)]), np.array([56 + top]))]
    some = [i for i, parts in enumerate(found) if parts is None]
    if not some:
        yield []
        return found
    m, sizes = len(some), np.array([len(images[i].px) for i in some])
    px, begin, owner = np.concatenate([images[i].px for i in some]), np.cumsum(sizes) - sizes, np.repeat(np.arange(m, dtype=np.int32), sizes)
    channels = _split(px)

    def keys(k: int, where: np.ndarray) -> np.ndarray:
        """A channel's values (0 to 3: blue, green, red, alpha), numbered by image."""
        return channels[where, k] + (owner[where] << 8)

    at, lengths, backs = _copies(px, begin).T
    free = np.ones(len(px), bool)
    free[np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())] = False

    def count(where: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(keys(k, where), minlength=m << 8).reshape(m, 256) for k in range(4)]

    plain, used, held = count(free), np.zeros(m, bool), np.zeros(len(px), bool)
    tried = np.array([images[i].cache for i in some]) & (sizes >= 256)
    if tried.any():
        slot = (px * np.uint32(0x1E35A7BD)) >> np.uint32(32 - CACHE_BITS)
        in_slot = (owner << CACHE_BITS | slot).astype(np.uint16 if m << CACHE_BITS <= 1 << 16 else np.int64)
        order = np.argsort(in_slot, kind="stable")  # by radix
        before, after = order[:-1], order[1:]
        held[after] = (px[after] == px[before]) & (in_slot[after] == in_slot[before])
        held &= free & tried[owner]
        rest, slots = count(free & ~held), np.bincount(in_slot[held], minlength=m << CACHE_BITS).reshape(m, -1)
        cached = _entropy(np.concatenate((rest[1], slots), axis=1), rest[0], rest[2], rest[3])
        used = tried & (104 * cached + (40_000 << 20) < 100 * _entropy(*plain)) & (slots.sum(axis=1) > 0)  # the cache's symbols have code lengths too
        held &= used[owner]
        plain = [np.where(used[:, None], x, y) for x, y in zip(rest, plain, strict=True)]
    symbol = channels[:, 1].astype(np.int64)
    if used.any():
        symbol[held] = 256 + 24 + slot[held]
    length, length_bits, length_extra = _prefixes(lengths)
    far = backs + 120
    for width in {images[some[k]].width for k in set(owner[at].tolist())}:
        near, here = _near_codes(width), np.array([images[i].width == width for i in some])[owner[at]] & (backs < 8 * width + 9)
        far[here] = near[backs[here]]
    distance, distance_bits, distance_extra = _prefixes(far)
    symbol[at] = 256 + length
    keep = free.copy()
    keep[at] = True
    alphabets = np.where(used, 256 + 24 + (1 << CACHE_BITS), 256 + 24)
    first = np.cumsum(alphabets) - alphabets
    kept = np.flatnonzero(keep)
    symbol = symbol[kept] + first[owner[kept]]
    greens, distance = np.bincount(symbol, minlength=alphabets.sum()), distance + 40 * owner[at]
    asked = zip(np.split(greens, first[1:]), plain[2] + plain[0], plain[3], np.bincount(distance, minlength=40 * m).reshape(m, 40), strict=True)
    made = yield [counts for x in asked for counts in x]
    codes = [[np.concatenate([x[k] for x in made[which::4]]) for k in (0, 1)] for which in range(4)]  # red and blue are alike, so one code does
    value, size = (x[symbol] for x in codes[0])
    literal = free[kept] & ~held[kept]
    whole = literal.all()
    for channel, (code, n) in zip((2, 0, 3), (codes[1], codes[1], codes[2]), strict=True):
        if n.any():
            k = keys(channel, kept)
            more, wider = code[k] << size, n[k]
            if not whole:
                more *= literal
                wider = wider * literal
            value |= more
            size += wider
    if len(at):
        to = np.searchsorted(kept, at)
        for v, n in ((length_bits, length_extra), (codes[3][0][distance], codes[3][1][distance]), (distance_bits, distance_extra)):
            value[to] |= v << size[to]
            size[to] += n
    cuts = np.searchsorted(kept, begin[1:])
    for k, (i, uses, values, wide) in enumerate(zip(some, used.tolist(), np.split(value, cuts), np.split(size, cuts), strict=True)):
        begun = np.array([1 | CACHE_BITS << 1 if uses else 0]), np.array([1 + 4 * uses + images[i].top])  # with the cache; and no entropy image
        found[i] = [begun, *(made[4 * k + j][2:] for j in (0, 1, 1, 2, 3)), (values, wide)]
    return found


class _Blocks:
    """Blocks of images of one width that stand one above another."""

    def __init__(self, heights: np.ndarray, width: int, block: int) -> None:
        self.side, down = 1 << block, -(-heights >> block)
        top, first = np.cumsum(heights) - heights, np.cumsum(down) - down
        self.cuts = first[1:]
        self.rows = np.repeat(top, down) + self.side * (np.arange(down.sum()) - np.repeat(first, down))
        self.columns = np.arange(0, width, self.side)
        self.of_row, self.top = np.repeat(np.arange(len(self.rows)), np.diff(self.rows, append=heights.sum())), top
        self.above = np.arange(heights.sum()) - 1
        self.above[top] += heights  # above the first row: the last
        self.of_column = np.arange(width) >> block

    def sums(self, x: np.ndarray, each: int = 1) -> np.ndarray:
        """Sums of rows of ``each`` values a pixel, by block."""
        across = x.sum(axis=1, dtype=np.int64)[:, None] if len(self.columns) == 1 else np.add.reduceat(x, each * self.columns, axis=1, dtype=np.int64)
        return np.add.reduceat(across, self.rows, axis=0)

    def wide(self, x: np.ndarray) -> np.ndarray:
        """Values by block as values by pixel."""
        return x[self.of_row][:, self.of_column]


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``_floor_half``, within bytes."""
    return (a & b) + ((a ^ b) >> 1)


def _predict(c: np.ndarray, blocks: _Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Modes by block and what is left of opaque samples (rows x width x 4); bytes wrap around."""
    up = c[blocks.above]
    left, corner, right = np.roll(c, 1, axis=1), np.roll(up, 1, axis=1), np.roll(up, -1, axis=1)
    right[:, -1] = c[:, 0]
    guesses = (BLACK.astype(np.uint8), left, up, right, corner, _half(corner, up), _half(up, right))
    names = np.array([0, 1, *ABOVE])
    away = np.stack([c - x for x in guesses])
    cost = np.minimum(away, -away).reshape(len(names), len(c), -1)
    best = np.stack([blocks.sums(x, 4) for x in cost]).argmin(axis=0)
    out = np.empty_like(c)
    for k, column in enumerate(blocks.columns.tolist()):
        here = slice(column, column + blocks.side)
        out[:, here] = away[best[blocks.of_row, k], np.arange(len(c)), here]
    top = blocks.top
    out[:, 0] = away[2, :, 0]
    out[top] = away[1, top]
    out[top, 0] = away[0, top, 0]
    return names[best], out


def _cross(c: np.ndarray, blocks: _Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers by block (least squares, in 32nds) and what is left of the samples."""
    blue, green, red = (c[..., k].view(np.int8).astype(np.int16) for k in (0, 1, 2))
    square = np.maximum(blocks.sums(green * green), 1)
    fit = lambda s: np.clip(np.rint(32 * s / square), -127, 127).astype(np.int16)
    to_red, to_blue = fit(blocks.sums(green * red)), fit(blocks.sums(green * blue))
    out = c.copy()
    out[..., 2] = (red - ((blocks.wide(to_red) * green) >> 5)).astype(np.uint8)
    out[..., 0] = (blue - ((blocks.wide(to_blue) * green) >> 5)).astype(np.uint8)
    return ((to_blue & 255) << 8 | (to_red & 255)).astype(np.uint32), out


def encode(rgb: np.ndarray, block: int = 6) -> bytes:
    """A lossless WebP file of height x width x 3 samples."""
    return encode_many([rgb], block)[0]


def encode_many(images: list[np.ndarray], block: int = 6) -> list[bytes]:
    """As ``encode`` of each image, with those of a group worked on as one array, and the prefix codes of all made together."""
    groups, pixels = [], 0
    for rgb in images:
        height, width, _ = rgb.shape
        if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE):
            raise ValueError("the image is too large")
        pixels += height * width
        if not groups or len(groups[-1]) == TOGETHER or pixels > TOGETHER_PIXELS:
            groups.append([])
            pixels = height * width
        groups[-1].append(rgb)
    waiting = [_encoding(group, block) for group in groups]
    asked = [next(steps) for steps in waiting]
    every = iter(_made_codes([counts for x in asked for counts in x]))
    return [x for steps, some in zip(waiting, asked, strict=True) for x in _last(steps, [next(every) for _ in some])]


def _last(steps: Iterator, answer: list) -> list[bytes]:
    """What a generator returns after an answer."""
    try:
        steps.send(answer)
    except StopIteration as e:
        return e.value
    raise RuntimeError("codes are asked for once")


def _encoding(images: list[np.ndarray], block: int) -> Iterator[list[np.ndarray]]:
    """``encode_many`` of a group, as a generator that asks for prefix codes."""
    kinds = [zlib.crc32(np.ascontiguousarray(rgb)) & 3 for rgb in images]
    opaque = np.uint32(0xFF000000)
    heads: list = [None] * len(images)  # fields before the first image, and that, if there is one
    mains: list = [None] * len(images)
    by_width: dict[int, list[int]] = {}
    for i, rgb in enumerate(images):
        by_width.setdefault(rgb.shape[1], []).append(i)
    for width, here in by_width.items():
        heights = np.array([images[i].shape[0] for i in here])
        c = np.full((heights.sum(), width, 4), 255, np.uint8)
        np.concatenate([images[i] for i in here], out=c[..., 2::-1])
        apart = dict(zip(here, np.split(c, np.cumsum(heights)[:-1]), strict=True))
        for i in here:
            px = apart[i].view("<u4").reshape(-1)
            colours = np.unique(px) if kinds[i] & 1 and len(set(px[:512].tolist())) <= 256 else ()
            if not 0 < len(colours) <= 256:
                continue
            packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            heads[i] = (0b111 | len(colours) - 1 << 3, 11), _Image(np.diff(_split(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)).view("<u4").reshape(-1), len(colours))
            index = np.searchsorted(colours, px).astype(np.uint32).reshape(-1, width)
            if packed:
                index = np.pad(index, ((0, 0), (0, -width % (1 << packed)))).reshape(len(index), -1, 1 << packed)
                index = (index << (np.arange(1 << packed, dtype=np.uint32) * np.uint32(8 >> packed))).sum(axis=2, dtype=np.uint32)
            mains[i] = _Image(opaque | index.reshape(-1) << np.uint32(8), index.shape[1], True, kinds[i] == 3)
        for kind in range(4):
            some = [i for i in here if kinds[i] == kind and not mains[i]]
            if not some:
                continue
            rest = np.concatenate([apart[i] for i in some])
            heights = np.array([images[i].shape[0] for i in some])
            if kind == 2:  # subtract green
                rest[..., 0] -= rest[..., 1]
                rest[..., 2] -= rest[..., 1]
            elif kind < 2:
                blocks = _Blocks(heights, width, block)
                fields, rest = (_cross if kind else _predict)(rest, blocks)
                fields = opaque | (fields if kind else fields << 8).astype(np.uint32)
            for k, (i, x) in enumerate(zip(some, np.split(rest, np.cumsum(heights)[:-1]), strict=True)):
                mains[i] = _Image(x.view("<u4").reshape(-1), width, True, kind in (0, 3))
                if kind == 2:
                    heads[i] = (0b101, 3), None
                elif kind == 3:
                    heads[i] = (0, 0), None
                elif not k:
                    for j, part in zip(some, np.split(fields, blocks.cuts), strict=True):
                        heads[j] = (1 | kind << 1 | block - 2 << 3, 6), _Image(part.reshape(-1), fields.shape[1])
    parts = yield from _written([x for (_, sub), main in zip(heads, mains, strict=True) for x in ((sub, main) if sub else (main,))])
    parts, files = iter(parts), []
    for rgb, ((value, n), sub) in zip(images, heads, strict=True):  # no alpha, version 0; the transform; after it, no more transforms
        fields = [(np.array([0x2F | rgb.shape[1] - 1 << 8 | rgb.shape[0] - 1 << 22 | value << 40]), np.array([40 + n]))]
        if sub:
            fields += next(parts)
        files.append([*fields, (_NONE, _ONE), *next(parts)])
    bodies = [body + b"\0" * (len(body) & 1) for body in _joined(files)]
    return [b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body for body in bodies]


_NONE, _ONE = np.array([0]), np.array([1])


def payload_of(text: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of 192: whole rows of 64 pixels."""
    return text + b" " * (max(192, -(-len(text) // 192) * 192) - len(text))


def image_of(payload: bytes) -> np.ndarray:
    """A payload as an image 64 pixels wide, or a multiple of that where it would be too high; spaces fill the last row."""
    wide = 64 * -(-len(payload) // (192 * MOST_SIDE))
    payload += b" " * (-len(payload) % (3 * wide))
    return np.frombuffer(payload, np.uint8).reshape(-1, wide, 3)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (long) and media (binary, lossless WebP) of ``docs`` (doc_id, text; others are ignored). Null counts as empty."""

    def of(batch: pa.RecordBatch):
        for i, j, data, offsets in text_pieces(batch.column("text"), most=4_000_000):
            texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(j - i)]
            cuts = [*range(0, len(texts), 4 * TOGETHER), len(texts)]
            media = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in encode_many([image_of(payload_of(t)) for t in texts[a:b]])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(arrow_batches(of), "doc_id long, n_bytes long, media binary")


PIXELS = "width int, height int, pixels binary"


def pixel_arrays(media: DataFrame) -> DataFrame:
    """Every column of ``media`` and, for its column media (binary), width, height, pixels (RGBA samples by row) and error.

    Null and broken media have null pixels and the reason in ``error``; columns with these names are replaced.
    """
    kept = [f for f in media.schema.fields if f.name not in ("width", "height", "pixels", "error")]

    def of(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            w = h = pixels = error = None
            try:
                image = decode(row.column("media")[0].as_py() or b"")
                h, w, pixels = image.shape[0], image.shape[1], image.tobytes()
            except (ValueError, IndexError, struct.error) as e:
                error = str(e) or type(e).__name__
            extra = [pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([pixels], pa.binary()), pa.array([error], pa.string())]
            yield pa.RecordBatch.from_arrays([*row.columns, *extra], names=[*(f.name for f in kept), "width", "height", "pixels", "error"])

    schema = media.select(*(f.name for f in kept)).schema
    for name, kind in (("width", IntegerType()), ("height", IntegerType()), ("pixels", BinaryType()), ("error", StringType())):
        schema = schema.add(name, kind)
    return media.select(*(f.name for f in kept)).mapInArrow(arrow_batches(of), schema)


REPORT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_report(media: DataFrame) -> DataFrame:
    """What the media of ``to_media`` hold, from their bytes alone but for n_bytes: payload, digests, and a feature string of the
    image's width, height, mean red, green and blue in thousandths and the mean step between neighbours in a row."""

    def of(batch: pa.RecordBatch):
        rows = []
        every = batch.column("media").to_pylist()
        for doc, n, stored, image in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), every, decode_many(every), strict=True):
            rgb = np.ascontiguousarray(image[..., :3])
            payload = rgb.tobytes()[: max(192, -(-n // 192) * 192)]
            means = [int(rgb[..., k].sum(dtype=np.int64)) * 1000 // (rgb.shape[0] * rgb.shape[1]) for k in range(3)]
            right, left = rgb[:, 1:], rgb[:, :-1]
            step = int((np.maximum(right, left) - np.minimum(right, left)).sum(dtype=np.int64)) * 1000 // (3 * rgb.shape[0] * (rgb.shape[1] - 1))
            feature = f"{rgb.shape[1]}x{rgb.shape[0]}:{means[0]}:{means[1]}:{means[2]}:{step}"
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        kinds = [pa.string() if "string" in x else pa.int64() for x in REPORT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in REPORT.split(", ")])

    return media.mapInArrow(arrow_batches(of), REPORT)
