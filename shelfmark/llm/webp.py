"""Lossless WebP: decoding to pixel arrays, and a writer for payloads of bytes.

`decode` reads any lossless stream: prefix codes (simple and normal), groups of
codes by an entropy image, back-references with the distance plane, colour
cache, and the predictor, cross-colour, subtract-green and palette transforms.
It goes pixel by pixel and is the reading of record.

`decode_many` reads thousands of streams in step: pixel i of all of them at once,
by table look-ups on arrays of bit positions, and then inverts the transforms on
arrays. It takes streams whose header (all bits before the pixels) is of one of the writer's
forms; others go to `decode`. Longer streams leave later, so a batch costs as many steps as its longest stream.

The writer stores four bytes as one pixel, 144 pixels a row, with a colour cache, and
back-references to the pixel before and the pixel above. A rule on the payload chooses the
form: a palette where at most 16 pixels are distinct; else the predictor, left or top, that leaves the
smallest residuals in sum, followed by the cross-colour transform with multipliers of least squares; and no
transform where the residuals aren't smaller than the bytes. Each form has fixed prefix codes. What is
written depends on the payload alone.

Defined results: a null text is an empty one and is stored as one row of bytes
255; payloads beyond 16384 rows become several images in a row; repeated rows
and equal texts give equal values; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm._text import documents, slices

WIDTH, ROWS = 144, 16384
UNIT = 4 * WIDTH
CACHE_BITS = 6
#: Text bytes that are written and then read in step.
TOGETHER = 24 << 20

#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE_BLACK = 0xFF000000
#: Offsets of the short distance codes: by distance, then by |x|, positive x first.
PLANE = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


# ---- bits and prefix codes


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        out = self.peek() & ((1 << n) - 1)
        self.at += n
        return out


class Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def write(self, x: int, n: int) -> None:
        self.value |= x << self.at
        self.at += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.at // 8), "little")


def codes(lengths: list[int]) -> list[int]:
    """Canonical codes, bit-reversed as the stream holds them."""
    out, code = [0] * len(lengths), 0
    for n in range(1, 16):
        for s, length in enumerate(lengths):
            if length == n:
                out[s] = int(f"{code:0{n}b}"[::-1], 2)
                code += 1
        code <<= 1
    return out


class Code:
    """A look-up table of symbol and length by the next bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.most = max(lengths, default=0) if len(used) > 1 else 0
        if len(used) > 1 and sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
            raise ValueError("a prefix code is not complete")
        self.symbols = np.full(1 << self.most, used[0] if used else 0, np.int32)
        self.sizes = np.zeros(1 << self.most, np.int64)
        if self.most:
            for s, c in zip(used, (c for c, n in zip(codes(lengths), lengths) if n)):
                self.symbols[c :: 1 << lengths[s]] = s
                self.sizes[c :: 1 << lengths[s]] = lengths[s]
        self.mask = (1 << self.most) - 1

    def read(self, bits: Reader) -> int:
        at = bits.peek() & self.mask
        bits.at += int(self.sizes[at])
        return int(self.symbols[at])


def read_code(bits: Reader, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    small = [0] * 19
    for i in range(bits.read(4) + 4):
        small[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(small)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
        else:
            again = (3, 3, 11)[s - 16] + bits.read((2, 3, 7)[s - 16])
            if at + again > alphabet:
                raise ValueError("code lengths run over")
            if s == 16:
                lengths[at : at + again] = [last] * again
            at += again
    return Code(lengths)


def write_code(out: Writer, lengths: list[int]) -> None:
    """As a normal code; runs of one length are written as repeats."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        out.write(1, 1)
        out.write(len(used) == 2, 1)
        out.write(1, 1)
        for s in used or [0]:
            out.write(s, 8)
        return
    ops: list[tuple[int, int, int]] = []
    at = 0
    while at < len(lengths):
        n = lengths[at]
        run = next((k for k in range(at, len(lengths)) if lengths[k] != n), len(lengths)) - at
        at += run
        if n:
            ops.append((n, 0, 0))
            run -= 1
        while run:
            if n and run >= 3:
                k = min(run, 6)
                ops.append((16, k - 3, 2))
            elif not n and run >= 3:
                k = min(run, 138)
                ops.append((17, k - 3, 3) if k < 11 else (18, k - 11, 7))
            else:
                k = 1
                ops.append((n, 0, 0))
            run -= k
    counts = [0] * 19
    for s, _, _ in ops:
        counts[s] += 1
    if sum(c > 0 for c in counts) == 1:
        counts[0 if not counts[0] else 1] += 1
    small = huffman(counts, 7)
    out.write(0, 1)
    out.write(19 - 4, 4)
    for s in LENGTH_ORDER:
        out.write(small[s], 3)
    out.write(0, 1)
    c = codes(small)
    for s, extra, n in ops:
        out.write(c[s], small[s])
        out.write(extra, n)


def huffman(counts: list[int], most: int = 15) -> list[int]:
    """Lengths of a complete code; rare symbols are raised until none is longer than `most`."""
    floor = 1
    while True:
        heap = [(max(c, floor), s, (s,)) for s, c in enumerate(counts) if c]
        lengths = [0] * len(counts)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
            return lengths
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(lengths, default=0) <= most:
            return lengths
        floor *= 2


def prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number of a length or distance from 1."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 2
    return 2 * n + 2 + ((value - 1) >> n & 1), (value - 1) & ((1 << n) - 1), n


def read_prefix(bits: Reader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


# ---- whole streams, pixel by pixel


def _pixels(bits: Reader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    block, groups, which = 0, 1, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        which = _pixels(bits, across, -(-height >> block), False) >> 8 & 0xFFFF
        groups = int(which.max()) + 1
    tables = [[read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    cache = [0] * (1 << cache_bits)
    out = [0] * (width * height)
    i, seen = 0, 0
    while i < len(out):
        green, red, blue, alpha, distance = tables[int(which[(i // width >> block) * across + (i % width >> block)]) if which is not None else 0]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[i] = a << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 280:
            length = read_prefix(bits, s - 256)
            d = read_prefix(bits, distance.read(bits))
            d = max(1, PLANE[d - 1][0] + PLANE[d - 1][1] * width) if d <= 120 else d - 120
            if d > i or i + length > len(out):
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out[i] = out[i - d]
                i += 1
        else:
            out[i] = cache[s - 280]
            i += 1
        if cache_bits:
            for p in out[seen:i]:
                cache[(HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            seen = i
    return np.array(out, np.uint32)


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _bytes(p: int) -> tuple[int, ...]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _joined(parts) -> int:
    a, r, g, b = (min(255, max(0, int(x))) for x in parts)
    return a << 24 | r << 16 | g << 8 | b


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The 14 predictors; `right` is the pixel above to the right, `corner` above to the left."""
    if mode == 11:
        near = sum(abs(t - c) for t, c in zip(_bytes(top), _bytes(corner))), sum(abs(x - c) for x, c in zip(_bytes(left), _bytes(corner)))
        return left if near[0] < near[1] else top
    if mode == 12:
        return _joined(x + t - c for x, t, c in zip(_bytes(left), _bytes(top), _bytes(corner)))
    if mode == 13:
        mean = _bytes(_average(left, top))
        return _joined(m + int((m - c) / 2) for m, c in zip(mean, _bytes(corner)))
    return (
        OPAQUE_BLACK, left, top, right, corner, _average(_average(left, right), top), _average(left, corner), _average(left, top),
        _average(corner, top), _average(top, right), _average(_average(left, corner), _average(top, right)), 0, 0, 0, OPAQUE_BLACK, OPAQUE_BLACK,
    )[mode]


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def _predict(pixels: list[int], i: int, width: int, modes: np.ndarray, block: int) -> int:
    y, x = divmod(i, width)
    if not y:
        return pixels[i - 1] if x else OPAQUE_BLACK
    if not x:
        return pixels[i - width]
    mode = int(modes[(y >> block) * -(-width >> block) + (x >> block)]) >> 8 & 15
    return predicted(mode, pixels[i - 1], pixels[i - width], pixels[i - width + 1], pixels[i - width - 1])


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t.astype(np.uint8).view(np.int8).astype(np.int32) * c.astype(np.uint8).view(np.int8).astype(np.int32) >> 5


def _spread(sub: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    across = -(-width >> block)
    y, x = np.divmod(np.arange(width * height), width)
    return sub[(y >> block) * across + (x >> block)]


def cross_colour(p: np.ndarray, sub: np.ndarray, width: int, height: int, block: int, sign: int = 1) -> np.ndarray:
    """Undo (sign 1) or apply (-1) the cross-colour transform."""
    t = _spread(sub, width, height, block)
    g, r, b = p >> 8 & 255, p >> 16 & 255, p & 255
    new = (r.astype(np.int32) + sign * _delta(t & 255, g)) & 255
    b = b.astype(np.int32) + sign * _delta(t >> 8 & 255, g) + sign * _delta(t >> 16 & 255, new if sign > 0 else r)
    return p & np.uint32(0xFF00FF00) | new.astype(np.uint32) << 16 | (b & 255).astype(np.uint32)


def subtract_green(p: np.ndarray, sign: int = 1) -> np.ndarray:
    g = p >> 8 & 255
    r, b = (p >> 16) + np.uint32(sign & 0xFFFFFFFF) * g & 255, p + np.uint32(sign & 0xFFFFFFFF) * g & 255
    return p & np.uint32(0xFF00FF00) | r << 16 | b


def decode_bits(data: bytes) -> tuple[np.ndarray, int, int]:
    """Pixels (ARGB), width and height of one VP8L payload."""
    bits = Reader(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (u[0] for u in undo):
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            undo.append((kind, inner, block, _pixels(bits, -(-inner >> block), -(-height >> block), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _pixels(bits, n, 1, False).tolist()
            for i in range(1, n):
                table[i] = _add(table[i], table[i - 1])
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, inner, pack, np.array(table + [0] * (256 - n), np.uint32)))
            inner = -(-inner >> pack)
        else:
            undo.append((kind, inner, 0, None))
    p = _pixels(bits, inner, height, True)
    for kind, wide, block, sub in reversed(undo):
        if kind == PREDICTOR:
            out = p.tolist()
            for i in range(len(out)):
                out[i] = _add(out[i], _predict(out, i, wide, sub, block))
            p = np.array(out, np.uint32)
        elif kind == CROSS_COLOUR:
            p = cross_colour(p, sub, wide, height, block)
        elif kind == SUBTRACT_GREEN:
            p = subtract_green(p)
        else:
            index = p >> 8 & 255
            if block:
                size = 8 >> block
                index = (index.reshape(height, -1, 1) >> (size * np.arange(1 << block)).astype(np.uint32) & ((1 << size) - 1)).reshape(height, -1)[:, :wide].reshape(-1)
            p = sub[index]
    return p, width, height


def chunks(media: bytes) -> Iterator[bytes]:
    """The VP8L payloads of one or more images in a row."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        yield media[at + 20 : at + 20 + int.from_bytes(media[at + 16 : at + 20], "little")]
        at += 8 + int.from_bytes(media[at + 4 : at + 8], "little")


def decode(media: bytes) -> np.ndarray:
    """An array of height, width and 4 (alpha, red, green, blue); several images in a row, of one width, come as one below the other."""
    images = [p.astype(">u4").view(np.uint8).reshape(height, width, 4) for p, width, height in map(decode_bits, chunks(media))]
    if len({i.shape[1] for i in images}) != 1:
        raise ValueError("no image, or images of several widths")
    return np.concatenate(images)


# ---- the writer of payloads, and reading in step


def _weights() -> list[int]:
    """Rough counts of bytes in text: a rule, not a table."""
    w = [1] * 256
    for group, n in ((range(65, 91), 4), (range(48, 58), 4), (range(0x80, 0xC0), 4), (b"\n.,", 24), (b"etaoinrsh", 120), (b"dlcumfgpbwvzkqjxy", 40), (b" ", 300), ([0xC3], 24), ([255], 16)):
        for c in group:
            w[c] = n
    return w


def _steps() -> list[int]:
    """Rough counts of differences of bytes in text: letters among themselves, and letters and spaces."""
    return [60 if not d else 45 - d if d <= 25 else 14 if 60 <= d <= 95 else 1 for d in (min(b, 256 - b) for b in range(256))]


#: Palettes have this many colours at most.
COLOURS = 16
_near = [1, 1] + [0] * 38
_only = lambda symbol: [int(s == symbol) for s in range(256)]


class Form:
    """What the writer may put before the pixels, and the codes of the pixels: green with lengths and cache, red, blue, alpha."""

    def __init__(self, green: list[int], others: tuple[list[int], list[int], list[int]]):
        self.lengths = (huffman(green + [8] * 12 + [1] * 12 + [1] * (1 << CACHE_BITS), 12), *others)
        self.tables = [Code(x) for x in self.lengths]
        single = lambda x: sum(n > 0 for n in x) == 1
        self.sizes = [np.zeros(len(x), np.int64) if single(x) else np.array(x, np.int64) for x in self.lengths]
        self.codes = [np.zeros(len(x), np.uint64) if single(x) else np.array(codes(x), np.uint64) for x in self.lengths]
        out = Writer()
        for x, n in ((0, 1), (1, 1), (CACHE_BITS, 4), (0, 1)):  # no more transforms, cache, one group
            out.write(x, n)
        for x in (*self.lengths, _near):
            write_code(out, x)
        self.tail, self.tail_bits = out.value, out.at


_text, _step = huffman(_weights(), 12), huffman(_steps(), 12)
PLAIN, RESIDUAL, INDEX = Form(_weights(), (_text, _text, _text)), Form(_steps(), (_step, _step, _step)), Form([16] * 256, (_only(0), _only(0), _only(255)))
_flat = Writer()
_flat.write(0, 1)  # no cache
for _x in ([8] * 256 + [0] * 24, [8] * 256, [8] * 256, [8] * 256, [1] + [0] * 39):
    write_code(_flat, _x)
_reversed = [int(f"{b:08b}"[::-1], 2) for b in range(256)]
#: Blocks of 512 by 512; every block of an image has one value, which its five codes name without any bit of pixels.
_BLOCK, _ELEMENT = 7, 1 + 2 + 3 + 1 + 5 * 11


def _element(kind: int, green: int, red: int, blue: int) -> int:
    """A transform whose sub-image is of one colour, `_ELEMENT` bits."""
    out = Writer()
    for x, n in ((1, 1), (kind, 2), (_BLOCK, 3), (0, 1)):
        out.write(x, n)
    for symbol in (green, red, blue, 255, 0):
        for x, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            out.write(x, n)
    return out.value


def _palette(table: np.ndarray) -> tuple[int, int]:
    """A palette transform: value and bits."""
    out = Writer()
    for x, n in ((1, 1), (PALETTE, 2), (len(table) - 1, 8), (_flat.value, _flat.at)):
        out.write(x, n)
    before = 0
    for colour in table.tolist():
        step = [(colour >> k & 255) - (before >> k & 255) & 255 for k in (8, 16, 0, 24)]
        for b in step:
            out.write(_reversed[b], 8)
        before = colour
    return out.value, out.at


def _packing(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1


def _bytes_of(p: np.ndarray) -> np.ndarray:
    return p.astype(">u4").view(np.uint8).reshape(-1, WIDTH, 4)


def _pixels_of(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b).reshape(-1).view(">u4").astype(np.uint32)


def _differences(b: np.ndarray, mode: int) -> np.ndarray:
    """What predictor 1 (left) or 2 (top) leaves of an image of bytes."""
    out = b.copy()
    if mode == 1:
        out[:, 1:] -= b[:, :-1]
        out[1:, 0] -= b[:-1, 0]
    else:
        out[1:] -= b[:-1]
        out[0, 1:] -= b[0, :-1]
    out[0, 0, 0] = int(out[0, 0, 0]) - 255 & 255  # the first pixel is predicted opaque black
    return out


def _sums(r: np.ndarray, mode: int) -> np.ndarray:
    """Undo `_differences`: sums along rows or columns."""
    r = r.copy()
    r[0, 0, 0] = int(r[0, 0, 0]) + 255 & 255
    if mode == 1:
        r[:, 0] = np.cumsum(r[:, 0], axis=0, dtype=np.uint8)
        return np.cumsum(r, axis=1, dtype=np.uint8)
    r[0] = np.cumsum(r[0], axis=0, dtype=np.uint8)
    return np.cumsum(r, axis=0, dtype=np.uint8)


def _small(b: np.ndarray) -> int:
    return int(np.minimum(b, -b).sum(dtype=np.int64))


def _multipliers(r: np.ndarray) -> tuple[int, int, int]:
    """green to red, green to blue, red to blue: least squares, each by itself, in 32nds."""
    red, green, blue = (r[..., k].view(np.int8).astype(np.int64) for k in (1, 2, 3))
    fit = lambda a, x: int(np.clip(np.rint(32 * (a * x).sum() / max(1, (a * a).sum())), -128, 127)) & 255
    g_r, g_b = fit(green, red), fit(green, blue)
    left = blue - (((g_b ^ 128) - 128) * green >> 5)
    return g_r, g_b, fit(red, left)


def _crossed(p: np.ndarray, by: tuple[int, int, int], sign: int) -> np.ndarray:
    """The cross-colour transform with one element for all pixels; sign 1 undoes it."""
    g, r, b = p >> 8 & 255, p >> 16 & 255, p & 255
    t = [np.uint32(x) for x in by]
    new = (r.astype(np.int32) + sign * _delta(t[0], g)) & 255
    b = b.astype(np.int32) + sign * _delta(t[1], g) + sign * _delta(t[2], new if sign > 0 else r)
    return p & np.uint32(0xFF00FF00) | new.astype(np.uint32) << 16 | (b & 255).astype(np.uint32)


def formed(payload: bytes) -> tuple[Form, int, int, int, np.ndarray]:
    """The form that the rule chooses: form, transform bits and their number, width of the coded image, and its pixels."""
    p = np.frombuffer(payload, ">u4").astype(np.uint32)
    table = np.unique(p[:4096])
    if len(table) <= COLOURS:
        table = np.unique(p)
    if len(table) <= COLOURS:
        pack = _packing(len(table))
        each, wide = 1 << pack, -(-WIDTH >> pack)
        index = np.searchsorted(table, p).reshape(-1, WIDTH)
        index = np.pad(index, ((0, 0), (0, wide * each - WIDTH))).reshape(-1, wide, each)
        packed = (index << ((8 >> pack) * np.arange(each))).sum(2).ravel().astype(np.uint32)
        return INDEX, *_palette(table), wide, packed << np.uint32(8) | np.uint32(OPAQUE_BLACK)
    b = _bytes_of(p)
    left = [(_small(r), mode, r) for mode, r in ((1, _differences(b, 1)), (2, _differences(b, 2)))]
    least, mode, r = min(left, key=lambda x: x[:2])
    if least >= _small(b):
        return PLAIN, 0, 0, WIDTH, p
    by = _multipliers(r)
    head = _element(PREDICTOR, mode, 0, 0) | _element(CROSS_COLOUR, by[1], by[2], by[0]) << _ELEMENT
    return RESIDUAL, head, 2 * _ELEMENT, WIDTH, _crossed(_pixels_of(r), by, -1)


def _form_of(stream: bytes) -> tuple[Form, int, int, tuple] | None:
    """Of a stream that the writer may have made: form, first bit of the pixels, width of the coded image, and what its transforms need."""
    bits = Reader(stream, 40)

    def tail(form: Form, at: int) -> bool:
        a, b = at >> 3, -(-(at + form.tail_bits) // 8)
        return len(stream) >= b and int.from_bytes(stream[a:b], "little") >> (at & 7) & ((1 << form.tail_bits) - 1) == form.tail

    if (int.from_bytes(stream[1:5], "little") & 0x3FFF) != WIDTH - 1 or len(stream) < 16:
        return None
    first = bits.peek()
    if not first & 1:
        return (PLAIN, 40 + PLAIN.tail_bits, WIDTH, ()) if tail(PLAIN, 40) else None
    if first >> 1 & 3 == PALETTE:
        n, at = (first >> 3 & 255) + 1, 40 + 11 + _flat.at
        a, b = 51 >> 3, -(-(at + 32 * n) // 8)
        raw = int.from_bytes(stream[a:b], "little") >> (51 & 7)
        if n > COLOURS or raw & ((1 << _flat.at) - 1) != _flat.value or not tail(INDEX, at + 32 * n):
            return None
        table, colour = [], [0, 0, 0, 0]
        raw >>= _flat.at
        for _ in range(n):
            for k in range(4):
                colour[k] = colour[k] + _reversed[raw & 255] & 255
                raw >>= 8
            g, r, b, a = colour
            table.append(a << 24 | r << 16 | g << 8 | b)
        return INDEX, at + 32 * n + INDEX.tail_bits, -(-WIDTH >> _packing(n)), (np.array(table, np.uint32),)
    both = int.from_bytes(stream[5 : 6 + 2 * _ELEMENT // 8], "little") & ((1 << 2 * _ELEMENT) - 1)
    symbol = lambda at, k: both >> (at + 7 + 11 * k + 3) & 255
    mode, by = symbol(0, 0), (symbol(_ELEMENT, 2), symbol(_ELEMENT, 0), symbol(_ELEMENT, 1))
    if mode not in (1, 2) or both != _element(PREDICTOR, mode, 0, 0) | _element(CROSS_COLOUR, by[1], by[2], by[0]) << _ELEMENT or not tail(RESIDUAL, 40 + 2 * _ELEMENT):
        return None
    return RESIDUAL, 40 + 2 * _ELEMENT + RESIDUAL.tail_bits, WIDTH, (mode, by)


def _undone(form: Form, p: np.ndarray, wide: int, need: tuple) -> np.ndarray:
    """Invert the transforms of one image."""
    if form is INDEX:
        pack = _packing(len(need[0]))
        size = 8 >> pack
        index = (p >> 8 & 255).reshape(-1, wide, 1) >> (size * np.arange(1 << pack)).astype(np.uint32) & ((1 << size) - 1)
        index = index.reshape(len(p) // wide, -1)[:, :WIDTH].ravel()
        return np.append(need[0], np.zeros(COLOURS, np.uint32))[index]
    if form is RESIDUAL:
        return _pixels_of(_sums(_bytes_of(_crossed(p, need[1], 1)), need[0]))
    return p


def _slots(p: np.ndarray) -> np.ndarray:
    return (p.astype(np.uint32) * np.uint32(HASH)) >> np.uint32(32 - CACHE_BITS)


def _runs(same: np.ndarray, free: np.ndarray, least: int = 4, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of `same & free` of at least `least`, cut at `most`."""
    edge = np.diff(np.concatenate(([0], (same & free).astype(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = b - a >= least
    a, b = a[long], b[long]
    n = -(-(b - a) // most)
    start = np.repeat(a, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * most
    return start, np.minimum(np.repeat(b, n) - start, most)


def write(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload, a positive multiple of 576 bytes of at most 16384 rows."""
    out: list[bytes] = [b""] * len(payloads)
    made = [formed(x) for x in payloads]
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (form, _, _, wide, _) in enumerate(made):
        groups.setdefault((id(form), wide), []).append(i)
    for at in groups.values():
        form, wide = made[at[0]][0], made[at[0]][3]
        heads = [(head | form.tail << n, n + form.tail_bits) for _, head, n, _, _ in (made[i] for i in at)]
        for i, x in zip(at, _coded(form, wide, [made[i][4] for i in at], heads, [len(payloads[i]) // UNIT for i in at])):
            out[i] = x
    return out


def _coded(form: Form, wide: int, images: list[np.ndarray], heads: list[tuple[int, int]], rows: list[int]) -> list[bytes]:
    """Files of images of one form and coded width."""
    p = np.concatenate(images)
    size = np.array([len(x) for x in images])
    begin = np.array([40 + n for _, n in heads], np.int64)
    first = np.cumsum(size) - size
    image = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(p)) - first[image]
    free = np.ones(len(p), bool)
    taken, length, code = [], [], []
    for back, symbol in ((1, 1), (wide, 0)):
        same = np.zeros(len(p), bool)
        same[back:] = (p[back:] == p[:-back]) & (place[back:] >= back)
        edge = place == 0  # a run ends with its image
        a, n = _runs(same & ~edge, free)
        taken.append(a)
        length.append(n)
        code.append(np.full(len(a), symbol))
        for s, k in zip(a.tolist(), n.tolist()):
            free[s : s + k] = False
    order = np.argsort(image * (1 << CACHE_BITS) + _slots(p), kind="stable")
    hit = np.zeros(len(p), bool)
    o = order
    hit[o[1:]] = (p[o[1:]] == p[o[:-1]]) & (image[o[1:]] == image[o[:-1]])
    value, bits = np.zeros(len(p), np.uint64), np.zeros(len(p), np.int64)
    parts = (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)
    for i, c in enumerate(parts):
        value |= form.codes[i][c] << bits.astype(np.uint64)
        bits += form.sizes[i][c]
    cached = 280 + _slots(p[hit]).astype(np.int64)
    value[hit], bits[hit] = form.codes[0][cached], form.sizes[0][cached]
    value[~free], bits[~free] = 0, 0
    for a, n, symbol in zip(np.concatenate(taken), np.concatenate(length).tolist(), np.concatenate(code).tolist()):
        s, extra, k = prefix(n)
        g = int(form.sizes[0][256 + s])
        value[a] = int(form.codes[0][256 + s]) | extra << g | symbol << (g + k)
        bits[a] = g + k + 1
    total = np.bincount(image, bits, len(size)).astype(np.int64) + begin
    words = -(-total // 64) + 1
    base = (np.cumsum(words) - words) * 64
    at = np.cumsum(bits) - bits
    at = at - at[first][image] + (base + begin)[image]
    out = np.zeros(int(words.sum()), np.uint64)
    keep = bits > 0
    at, value = at[keep], value[keep]
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    high = np.where(shift > 0, value >> (np.uint64(63) - np.minimum(shift, 63) + np.uint64(0)) >> np.uint64(1), 0)
    lead = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[lead]] |= np.bitwise_or.reduceat(value << shift, lead)
    out[word[lead] + 1] |= np.bitwise_or.reduceat(np.where(np.append(word[1:] != word[:-1], True), high, 0), lead)
    raw = out.tobytes()
    made = []
    for i, n in enumerate(rows):
        stream = raw[base[i] // 8 : base[i] // 8 + -(-int(total[i]) // 8)]
        head = 0x2F | (WIDTH - 1) << 8 | (n - 1) << 22 | 1 << 36 | heads[i][0] << 40
        k = int(begin[i]) // 8 + 1
        stream = (head | int.from_bytes(stream[:k], "little")).to_bytes(k, "little") + stream[k:]
        pad = len(stream) & 1
        made.append(b"RIFF" + (12 + len(stream) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * pad)
    return made


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The pixels of each VP8L payload as bytes, row by row, big-endian ARGB."""
    out: list[bytes] = [b""] * len(streams)
    groups: dict[int, list[tuple[int, Form, int, int, tuple]]] = {}
    for i, s in enumerate(streams):
        mine = _form_of(s)
        if mine is None:
            out[i] = decode_bits(s)[0].astype(">u4").tobytes()
        else:
            groups.setdefault(id(mine[0]), []).append((i, *mine))
    for rows in groups.values():
        form = rows[0][1]
        height = [(int.from_bytes(streams[i][1:5], "little") >> 14 & 0x3FFF) + 1 for i, *_ in rows]
        order = sorted(range(len(rows)), key=lambda k: -rows[k][3] * height[k])
        rows, height = [rows[k] for k in order], [height[k] for k in order]
        wide = np.array([r[3] for r in rows])
        read = _in_step(form, [streams[r[0]] for r in rows], np.array([r[2] for r in rows]), wide, wide * np.array(height))
        for (i, _, _, w, need), p in zip(rows, read, strict=True):
            out[i] = _undone(form, p, w, need).astype(">u4").tobytes()
    return out


def _in_step(form: Form, streams: list[bytes], begin: np.ndarray, wide: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The coded pixels of streams of one form, longest first."""
    green, others = form.tables[0], form.tables[1:]
    data = np.frombuffer(b"".join(streams) + b"\0" * 16, np.uint8)
    length = np.array([len(s) for s in streams])
    bit = (np.cumsum(length) - length) * 8 + begin
    end = np.cumsum(length) * 8
    base = np.cumsum(size) - size
    pixels = np.zeros(int(size.sum()), np.uint32)
    cache = np.zeros((len(streams), 1 << CACHE_BITS), np.uint32)
    left, back = np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
    live, eight, every = len(streams), np.arange(8), np.arange(len(streams))
    for i in range(int(size[0])):
        while size[live - 1] <= i:
            live -= 1
        p = np.zeros(live, np.uint32)
        ask = np.flatnonzero(left[:live] == 0)
        at = bit[ask]
        bits = np.ascontiguousarray(data[(at >> 3)[:, None] + eight]).view("<u8")[:, 0] >> (at & 7).astype(np.uint64)
        k = (bits & np.uint64(green.mask)).astype(np.int64)
        s, n = green.symbols[k], green.sizes[k]
        other = np.flatnonzero(s >= 256)
        q = s.astype(np.uint32) << np.uint32(8)
        used = n.copy()
        for shift, table in zip((16, 0, 24), others):
            k = (bits >> used.astype(np.uint64) & np.uint64(table.mask)).astype(np.int64)
            q |= table.symbols[k].astype(np.uint32) << np.uint32(shift)
            used += table.sizes[k]
        if len(other):
            so, row = s[other], ask[other]
            used[other] = n[other]
            from_cache = so >= 280
            c = np.flatnonzero(from_cache)
            q[other[c]] = cache[row[c], so[c] - 280]
            c = np.flatnonzero(~from_cache)
            if len(c):
                sym, o, r = so[c] - 256, other[c], row[c]
                more = np.where(sym < 4, 0, (sym - 2) >> 1)
                b = bits[o] >> n[o].astype(np.uint64)
                run = np.where(sym < 4, sym, ((2 + (sym & 1)) << more) + (b & ((np.uint64(1) << more.astype(np.uint64)) - np.uint64(1))).astype(np.int64)) + 1
                one = (b >> more.astype(np.uint64) & np.uint64(1)).astype(np.int64)
                left[r], back[r] = run, np.where(one == 1, 1, wide[r])
                used[o] = n[o] + more + 1
                if (back[r] > i).any() or (run + i > size[r]).any():
                    raise ValueError("a back-reference leaves the image")
        bit[ask] = at + used
        p[ask] = q
        copy = np.flatnonzero(left[:live] > 0)
        p[copy] = pixels[base[copy] + i - back[copy]]
        left[copy] -= 1
        pixels[base[:live] + i] = p
        cache[every[:live], _slots(p)] = p
    if (bit > end).any():
        raise ValueError("a stream ends early")
    return [pixels[a : a + n] for a, n in zip(base.tolist(), size.tolist())]


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def stored(df: DataFrame) -> DataFrame:
    """The contract of op7: the payload's and the stored form's sizes and digests, and a feature of the pixels read back."""
    kind = df.schema["doc_id"].dataType.simpleString()
    most = UNIT * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, most=TOGETHER):
            n, media = [], []
            for part in slices(iter([whole]), most=2 << 20):
                payloads = []
                for text in part.column("text").to_pylist():
                    payload = padded(text)
                    n.append(len((text or "").encode("utf-8", "surrogatepass")))
                    payloads.append([payload[i : i + most] for i in range(0, len(payload), most)])
                files = iter(write([x for p in payloads for x in p]))
                media += [b"".join(next(files) for _ in p) for p in payloads]
            streams = [list(chunks(m)) for m in media]
            read = iter(decode_many([s for x in streams for s in x]))
            back = [b"".join(next(read) for _ in x) for x in streams]
            columns = [
                whole.column("doc_id"),
                pa.array(n, pa.int64()),
                pa.array([len(b) for b in back], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                pa.array([zlib.crc32(b[-32:]) for b in back], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                pa.array([feature(b) for b in back], pa.string()),
            ]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return documents(df, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def feature(pixels: bytes) -> str:
    """Height and the mean of each channel over the image, in thousandths."""
    p = np.frombuffer(pixels, np.uint8).reshape(-1, 4)
    return ":".join(str(x) for x in (len(p) // WIDTH, *(p.sum(0, dtype=np.int64) * 1000 // len(p)).tolist()))
