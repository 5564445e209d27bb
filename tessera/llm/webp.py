"""Lossless WebP (VP8L): a full decoder, a small encoder, and their Spark operators.

Decoder: prefix codes (simple and normal), meta prefix codes, back-references, colour cache, and
the inverse predictor, cross-colour, subtract-green and colour-indexing transforms. Streams in
which one prefix code carries all (grey and palette images) are decoded with numpy: the code is
looked up at every bit position at once, and the chain of true positions is followed in strides.

Encoder: grey samples, one per pixel, under subtract-green, or with up to 16 values bundled under
colour indexing; back-references for runs and repeated lines. It depends on the payload alone.

Defined results: decode_images gives null pixels and a message for media that are null, truncated
or malformed; store_texts takes a null text as empty, stores one beyond 267 MB as several images, repeated rows each give the same values,
and an empty table an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.words import slices

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_MULTIPLIER = 0x1E35A7BD
SIGNATURE, MAX_SIDE = 0x2F, 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, COLOUR_INDEXING = range(4)
#: Short distance codes: pixel offsets (left, up) by distance from the pixel, then by |left|.
PLANE = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0),
    key=lambda at: (at[0] ** 2 + at[1] ** 2, abs(at[0]), -at[0]),
)

#: Payload bytes of a row; a payload is a multiple of it.
ROW = 192
WINDOW = 1 << 17
#: The largest palette whose indices share a pixel.
MOST_BUNDLED = 16
_REVERSED = {n: np.array([int(f"{i:0{n}b}"[::-1], 2) for i in range(1 << n)]) for n in range(1, 13)}


def reversed_bits(n: int) -> np.ndarray:
    if n not in _REVERSED:
        low = reversed_bits(n - 1)
        _REVERSED[n] = np.concatenate([low << 1, (low << 1) | 1])
    return _REVERSED[n]


class BadImage(ValueError):
    """The media are no lossless WebP image, or end too early."""


class Bits:
    """Reads a byte string's bits, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        p = self.at
        return int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise BadImage("the stream ends too early")
        return value


class PrefixCode:
    """symbol and length tables, indexed by the next `width` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.width, self.symbols, self.lengths = 0, np.array([used[0] if len(used) else 0], np.int32), np.zeros(1, np.uint8)
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[order].astype(np.int64)
        self.width = int(size[-1])
        spans = 1 << (self.width - size)
        if spans.sum() != 1 << self.width:
            raise BadImage("a prefix code is not complete")
        back = reversed_bits(self.width)
        self.symbols = np.repeat(order.astype(np.int32), spans)[back]
        self.lengths = np.repeat(size.astype(np.uint8), spans)[back]

    def lists(self) -> tuple[int, list, list]:
        return self.width, self.symbols.tolist(), self.lengths.tolist()


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise BadImage("a symbol is not in its alphabet")
        lengths[symbols] = 1
        return PrefixCode(lengths)
    of_lengths = np.zeros(19, np.uint8)
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    width, symbols, sizes = PrefixCode(of_lengths).lists()
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    ahead, took = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 32 + 2 * alphabet], "little") >> (bits.at & 7), 0
    mask, last, out = (1 << width) - 1, 8, []
    while len(out) < alphabet and left:
        left -= 1
        k = ahead & mask
        symbol, n = symbols[k], sizes[k]
        ahead >>= n
        took += n
        if symbol < 16:
            out.append(symbol)
            last = symbol or last
            continue
        value, n, least = ((last, 2, 3), (0, 3, 3), (0, 7, 11))[symbol - 16]
        out += [value] * (least + (ahead & ((1 << n) - 1)))
        ahead >>= n
        took += n
    bits.read(took)
    if len(out) > alphabet:
        raise BadImage("code lengths run past their alphabet")
    lengths[: len(out)] = out
    return PrefixCode(lengths)


def extra_of(symbol: int) -> tuple[int, int]:
    """Base and number of extra bits of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1, 0
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + 1, n


def distance_of(code: int, width: int) -> int:
    if code > len(PLANE):
        return code - len(PLANE)
    x, y = PLANE[code - 1]
    return max(1, x + y * width)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as width * height ARGB words."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("the colour cache is too large")
    groups_of, step = None, 0
    if main and bits.read(1):
        step = bits.read(3) + 2
        across = (width + (1 << step) - 1) >> step
        groups_of = read_pixels(bits, across, (height + (1 << step) - 1) >> step, False) >> 8 & 0xFFFF
    count = int(groups_of.max()) + 1 if groups_of is not None else 1
    cache_size = 1 << cache_bits if cache_bits else 0
    groups = [[read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(count)]
    if count == 1 and not cache_bits and not any(code.width for code in groups[0][1:4]):
        return read_one_code(bits, width, width * height, groups[0])
    return read_any(bits, width, width * height, groups, groups_of, step, cache_bits)


def read_any(bits: Bits, width: int, total: int, groups: list, groups_of: np.ndarray | None, step: int, cache_bits: int) -> np.ndarray:
    """Pixel by pixel: several prefix codes a pixel, meta prefix codes, colour cache."""
    tables = [[code.lists() for code in group] for group in groups]
    across = (width + (1 << step) - 1) >> step
    cache = [0] * (1 << cache_bits)
    out: list[int] = []
    cached = 0

    def symbol(code: tuple) -> int:
        n, symbols, sizes = code
        if not n:
            return symbols[0]
        k = bits.peek(n)
        bits.read(sizes[k])
        return symbols[k]

    def remember() -> None:
        nonlocal cached
        if cache_bits:
            for argb in out[cached:]:
                cache[(CACHE_MULTIPLIER * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = argb
        cached = len(out)

    while len(out) < total:
        x, y = len(out) % width, len(out) // width
        group = tables[int(groups_of[(y >> step) * across + (x >> step)]) if groups_of is not None else 0]
        green = symbol(group[0])
        if green < 256:
            red, blue, alpha = (symbol(code) for code in group[1:4])
            out.append(alpha << 24 | red << 16 | green << 8 | blue)
        elif green < 280:
            base, n = extra_of(green - 256)
            length = base + bits.read(n)
            base, n = extra_of(symbol(group[4]))
            distance = distance_of(base + bits.read(n), width)
            if distance > len(out):
                raise BadImage("a back-reference reaches before the image")
            for _ in range(min(length, total - len(out))):
                out.append(out[-distance])
        else:
            remember()
            if green - 280 >= len(cache):
                raise BadImage("a colour cache index is too large")
            out.append(cache[green - 280])
    return np.array(out, np.uint32)


_SYMBOLS = np.array([extra_of(s) for s in range(40)])


def read_one_code(bits: Bits, width: int, total: int, group: list) -> np.ndarray:
    """All pixels, where only the green code has more than one symbol."""
    green, distance = group[0], group[4]
    red, blue, alpha = (int(code.symbols[0]) for code in group[1:4])
    rest = np.uint32(alpha << 24 | red << 16 | blue)
    if not green.width:
        if green.symbols[0] >= 256:
            raise BadImage("the only symbol is a back-reference")
        return np.full(total, rest | np.uint32(green.symbols[0] << 8))
    raw = np.frombuffer(bits.data, np.uint8)
    copies_exist = bool((green.symbols >= 256).any())
    steps = np.where(green.symbols < 256, green.lengths, 0).astype(np.uint8)
    symbols, lengths, distances, made = [], [], [], 0
    while made < total:
        if bits.at >= bits.end:
            raise BadImage("the stream ends too early")
        first = bits.at >> 3
        part = raw[first : first + WINDOW // 8 + 24]
        part = np.concatenate([part, np.zeros(24, np.uint8)]).astype(np.uint64)
        n = (min(len(part) - 24, WINDOW // 8)) * 8
        words = part[: len(part) - 7].copy()
        for k in range(1, 8):
            words |= part[k : len(part) - 7 + k] << np.uint64(8 * k)
        ahead = ((words[: n >> 3].astype(np.uint32)[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.width) - 1)).ravel()
        nxt = np.arange(n + 64, dtype=np.int32)
        nxt[:n] += steps[ahead]
        if copies_exist:
            at = np.flatnonzero(nxt[:n] == np.arange(n, dtype=np.int32))
            kind = green.symbols[ahead[at]] - 256
            if (kind >= 24).any():
                raise BadImage("a cache index without a colour cache")
            look = lambda p: words[p >> 3] >> (p & 7).astype(np.uint64)
            q = at + green.lengths[ahead[at]]
            base, more = _SYMBOLS[kind].T
            length = base + (look(q).astype(np.int64) & ((1 << more) - 1))
            q = q + more
            k = look(q).astype(np.int64) & ((1 << distance.width) - 1)
            q = q + distance.lengths[k]
            base, more = _SYMBOLS[distance.symbols[k]].T
            far = base + (look(q).astype(np.int64) & ((1 << more) - 1))
            nxt[at] = q + more
        two = nxt[nxt]
        four = two[two]
        eight = four[four]
        chain, p, jump = [], bits.at & 7, eight.item
        while p < n:
            chain.append(p)
            p = jump(p)
        on = np.array(chain, np.int32)
        for level in (four, two, nxt):
            on = np.stack([on, level[on]], 1).ravel()
        on = on[on < n]
        got = green.symbols[ahead[on]]
        long = np.ones(len(on), np.int64)
        back = np.zeros(len(on), np.int64)
        if copies_exist:
            is_copy = got >= 256
            index = np.searchsorted(at, on[is_copy])
            long[is_copy], back[is_copy] = length[index], far[index]
        reach = made + np.cumsum(long)
        if reach[-1] >= total:
            enough = int(np.searchsorted(reach, total)) + 1
            got, long, back, ends = got[:enough], long[:enough], back[:enough], nxt[on[enough - 1]]
        else:
            ends = p
        symbols.append(got)
        lengths.append(long)
        distances.append(back)
        made = int(made + long.sum())
        bits.at = 8 * first + int(ends)
        if bits.at > bits.end:
            raise BadImage("the stream ends too early")
    got, long, back = (np.concatenate(x) for x in (symbols, lengths, distances))
    if not back.any():
        return got[:total].astype(np.uint32) << np.uint32(8) | rest
    starts = np.cumsum(long) - long
    out = np.zeros(max(made, total), np.uint8)
    literal = back == 0
    out[starts[literal]] = got[literal]
    for to, n, code in zip(starts[~literal].tolist(), long[~literal].tolist(), back[~literal].tolist()):
        d = distance_of(code, width)
        if d > to:
            raise BadImage("a back-reference reaches before the image")
        out[to : to + n] = out[to - d : to - d + n] if d >= n else np.resize(out[to - d : to], n)
    return out[:total].astype(np.uint32) << np.uint32(8) | rest


def _channels(argb: np.ndarray) -> np.ndarray:
    """(n, 4) bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(argb.astype("<u4")).view(np.uint8).reshape(*argb.shape, 4)


def _average(a: list, b: list) -> list:
    return [(x + y) >> 1 for x, y in zip(a, b)]


def _select(left: list, top: list, corner: list) -> list:
    to_left = sum(abs(t - c) for t, c in zip(top, corner))
    to_top = sum(abs(x - c) for x, c in zip(left, corner))
    return left if to_left < to_top else top


def _clamp(x: int) -> int:
    return min(255, max(0, x))


def _half(a: int, b: int) -> int:
    d = a - b
    return _clamp(a + (d // 2 if d >= 0 else -(-d // 2)))


BLACK = [0, 0, 0, 255]
#: Predictors by mode, of the left, top, top right and top left pixels.
MODES = [
    lambda left, top, right, corner: BLACK,
    lambda left, top, right, corner: left,
    lambda left, top, right, corner: top,
    lambda left, top, right, corner: right,
    lambda left, top, right, corner: corner,
    lambda left, top, right, corner: _average(_average(left, right), top),
    lambda left, top, right, corner: _average(left, corner),
    lambda left, top, right, corner: _average(left, top),
    lambda left, top, right, corner: _average(corner, top),
    lambda left, top, right, corner: _average(top, right),
    lambda left, top, right, corner: _average(_average(left, corner), _average(top, right)),
    lambda left, top, right, corner: _select(left, top, corner),
    lambda left, top, right, corner: [_clamp(x + t - c) for x, t, c in zip(left, top, corner)],
    lambda left, top, right, corner: [_half(a, c) for a, c in zip(_average(left, top), corner)],
]


def undo_predictor(argb: np.ndarray, width: int, height: int, modes: np.ndarray, step: int) -> np.ndarray:
    across = (width + (1 << step) - 1) >> step
    rest = _channels(argb).tolist()
    out: list = []
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if not y:
                guess = out[at - 1] if x else BLACK
            elif not x:
                guess = out[at - width]
            else:
                mode = int(modes[(y >> step) * across + (x >> step)]) >> 8 & 15
                if mode >= len(MODES):
                    guess = BLACK
                else:
                    guess = MODES[mode](out[at - 1], out[at - width], out[at - width + 1], out[at - width - 1])
            out.append([(r + g) & 255 for r, g in zip(rest[at], guess)])
    return np.array(out, np.uint8).reshape(-1, 4).copy().view("<u4").ravel()


def undo_cross_colour(argb: np.ndarray, width: int, height: int, elements: np.ndarray, step: int) -> np.ndarray:
    across = (width + (1 << step) - 1) >> step
    y, x = np.divmod(np.arange(width * height), width)
    element = _channels(elements[(y >> step) * across + (x >> step)]).view(np.int8).astype(np.int32)
    c = _channels(argb).copy()
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(c[:, 1])
    red = (c[:, 2] + (element[:, 0] * green >> 5)).astype(np.uint8)
    c[:, 0] = (c[:, 0] + (element[:, 1] * green >> 5) + (element[:, 2] * signed(red) >> 5)).astype(np.uint8)
    c[:, 2] = red
    return c.view("<u4").ravel()


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = _channels(argb).copy()
    c[:, 0] += c[:, 1]
    c[:, 2] += c[:, 1]
    return c.view("<u4").ravel()


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_indexing(argb: np.ndarray, width: int, height: int, colours: np.ndarray, bundle: int) -> np.ndarray:
    index = argb >> np.uint32(8) & np.uint32(255)
    if bundle:
        n = 8 >> bundle
        each = (index.reshape(height, -1)[:, :, None] >> (np.arange(1 << bundle, dtype=np.uint32) * np.uint32(n))) & np.uint32((1 << n) - 1)
        index = each.reshape(height, -1)[:, :width].ravel()
    all_colours = np.zeros(256, np.uint32)
    all_colours[: len(colours)] = colours
    return all_colours[index]


def decode(media: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and the ARGB words of a lossless WebP file."""
    if len(media) < 21 or media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise BadImage("no WebP file")
    at = 12
    while media[at : at + 4] != b"VP8L":
        at += 8 + (int.from_bytes(media[at + 4 : at + 8], "little") + 1 & ~1)
        if at + 8 > len(media):
            raise BadImage("no lossless image in the file")
    bits = Bits(media[at + 8 : at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")])
    if bits.read(8) != SIGNATURE:
        raise BadImage("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadImage("an unknown version")
    undo, seen, coded = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            step = bits.read(3) + 2
            data = read_pixels(bits, (coded + (1 << step) - 1) >> step, (height + (1 << step) - 1) >> step, False)
            f = undo_predictor if kind == PREDICTOR else undo_cross_colour
            undo.append(lambda a, f=f, w=coded, d=data, s=step: f(a, w, height, d, s))
        elif kind == SUBTRACT_GREEN:
            undo.append(undo_subtract_green)
        else:
            n = bits.read(8) + 1
            colours = np.cumsum(_channels(read_pixels(bits, n, 1, False)), 0, dtype=np.uint8).copy().view("<u4").ravel()
            bundle = bundle_bits(n)
            undo.append(lambda a, w=coded, c=colours, b=bundle: undo_indexing(a, w, height, c, b))
            coded = (coded + (1 << bundle) - 1) >> bundle
    argb = read_pixels(bits, coded, height, True)
    for f in reversed(undo):
        argb = f(argb)
    return width, height, argb


class BitWriter:
    """Collects bits, lowest first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Lengths of an optimal prefix code for at least two symbols, none above limit."""
    while True:
        heap = [(n, s, (s,)) for s, n in sorted(counts.items())]
        heapq.heapify(heap)
        depth = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= limit:
            return depth
        counts = {s: (n >> 2) + 1 for s, n in counts.items()}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, length)."""
    out, code, last = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (int(f"{code:0{last}b}"[::-1], 2), last)
        code += 1
    return out


def put_code(w: BitWriter, counts: dict[int, int], alphabet: int, limit: int = 12) -> dict[int, tuple[int, int]]:
    """Writes a prefix code for the symbols counted, and returns it."""
    symbols = sorted(counts) or [0]
    if len(symbols) <= 2 and symbols[-1] < 256:
        w.put(1 | (len(symbols) - 1) << 1 | 1 << 2 | symbols[0] << 3, 11)
        if len(symbols) == 1:
            return {symbols[0]: (0, 0)}
        w.put(symbols[1], 8)
        return {symbols[0]: (0, 1), symbols[1]: (1, 1)}
    lengths = code_lengths(counts, limit)
    items, at = [], 0
    for s in [*sorted(lengths), alphabet]:
        gap = s - at
        while gap >= 3:
            n = min(gap, 138)
            items.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
            gap -= n
        items += [(0, 0, 0)] * gap
        if s < alphabet:
            items.append((lengths[s], 0, 0))
        at = s + 1
    of_lengths = canonical(code_lengths(Counter(x[0] for x in items), 7))
    listed = [of_lengths[k][1] if k in of_lengths else 0 for k in CODE_LENGTH_ORDER]
    n = max(4, max(i for i, x in enumerate(listed) if x) + 1)
    w.put(0 | (n - 4) << 1, 5)
    for x in listed[:n]:
        w.put(x, 3)
    w.put(0, 1)
    for symbol, value, more in items:
        code, n = of_lengths[symbol]
        w.put(code | value << n, n + more)
    return canonical(lengths)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra value and number of extra bits of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    n = value.bit_length() - 2
    return 2 * (n + 1) + (value >> n & 1), value & ((1 << n) - 1), n


def find_copies(samples: np.ndarray, least: int = 24) -> list[tuple[int, int, int]]:
    """(position, length, distance) of runs of one sample and of repeated lines, in order."""
    change = np.flatnonzero(np.diff(samples)) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(samples)]])
    runs = np.flatnonzero(ends - starts > least)
    found = [(int(s) + 1, int(e - s) - 1, 1) for s, e in zip(starts[runs], ends[runs])]
    at, seen = 0, {}
    for line in samples.tobytes().split(b"\n"):
        if len(line) >= least:
            before = seen.get(line)
            if before is not None and at - before < 1 << 19:
                found.append((at, len(line), at - before))
            seen[line] = at
        at += len(line) + 1
    out, free = [], 0
    for at, n, d in sorted(found):
        if at >= free:
            out += [(at + k, min(4096, n - k), d) for k in range(0, n, 4096)]
            free = at + n
    return out


def pack_codes(values: np.ndarray, sizes: np.ndarray, head: BitWriter) -> bytes:
    """The head's bits, then each value in as many bits as its size (below 64)."""
    at = np.cumsum(sizes) - sizes + (head.n & 7)
    total = int(at[-1] + sizes[-1]) if len(at) else head.n & 7
    out = np.zeros(total // 64 + 2, np.uint64)
    if len(at):
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((at & 63) + sizes > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    whole = head.n & ~7
    body = bytearray(out.tobytes()[: (total + 7) // 8])
    body[0] |= head.value >> whole
    return (head.value & ((1 << whole) - 1)).to_bytes(whole // 8, "little") + bytes(body)


def put_palette(w: BitWriter, samples: np.ndarray, width: int, greys: np.ndarray) -> np.ndarray:
    """Writes the colour-indexing transform; returns the image of bundled indices."""
    w.put(1 | COLOUR_INDEXING << 1 | (len(greys) - 1) << 3, 11)
    steps = np.diff(greys, prepend=0).tolist()
    w.put(0, 1)
    codes = [put_code(w, Counter(steps), n) for n in (280, 256, 256)]
    opaque = put_code(w, {0: 1, 255: 1} if len(greys) > 1 else {255: 1}, 256)
    put_code(w, {}, 40)
    for k, s in enumerate(steps):
        for value, n in (*(code[s] for code in codes), opaque[0 if k else 255]):
            w.put(value, n)
    index = np.zeros(256, np.uint8)
    index[greys] = np.arange(len(greys))
    together = 1 << bundle_bits(len(greys))
    rows = np.zeros((len(samples) // width, -(-width // together) * together), np.uint8)
    rows[:, :width] = index[samples].reshape(-1, width)
    places = np.arange(together, dtype=np.uint8) * (8 // together)
    return np.bitwise_or.reduce(rows.reshape(len(rows), -1, together) << places, 2, dtype=np.uint8).ravel()


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """A lossless WebP file of len(samples) // width rows of grey samples."""
    height = len(samples) // width
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE or width * height != len(samples):
        raise ValueError("the sides don't fit the samples or the format")
    counts = np.bincount(samples, minlength=256)
    greys = np.flatnonzero(counts)
    w = BitWriter()
    w.put(SIGNATURE | (width - 1) << 8 | (height - 1) << 22, 40)
    if len(greys) > MOST_BUNDLED:
        w.put(1 | SUBTRACT_GREEN << 1, 3)
        coded, copies = samples, find_copies(samples)
        alpha = 255
    else:
        coded = put_palette(w, samples, width, greys)
        copies = [c for c in find_copies(coded) if c[2] == 1]
        counts = np.bincount(coded, minlength=256)
        alpha = 0
    w.put(0, 3)  # no further transform, no colour cache, no meta prefix codes
    if not copies:
        kept = coded
        used = np.flatnonzero(counts)
        code = put_code(w, dict(zip(used.tolist(), counts[used].tolist())), 280)
        by_copy = None
    else:
        keep = np.ones(len(coded), bool)
        for at, n, _ in copies:
            keep[at : at + n] = False
        where = np.array([c[0] for c in copies])
        length = [prefix_of(c[1]) for c in copies]
        far = [prefix_of(c[2] + len(PLANE)) for c in copies]
        counts = np.bincount(coded[keep], minlength=256)
        used = np.flatnonzero(counts)
        code = put_code(w, dict(zip(used.tolist(), counts[used].tolist())) | Counter(256 + x[0] for x in length), 280)
    for constant in (0, 0, alpha):  # red, blue, alpha
        put_code(w, {constant: 1}, 256)
    if not copies:
        put_code(w, {}, 40)
    else:
        far_code = put_code(w, Counter(x[0] for x in far), 40)
        by_copy = []
        for (s, v, n), (t, u, m) in zip(length, far):
            value, size = code[256 + s]
            for x, k in ((v, n), far_code[t], (u, m)):
                value |= x << size
                size += k
            by_copy.append((value, size))
        keep[where] = True
        kept = coded[keep]
    values, sizes = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (value, n) in code.items():
        if s < 256:
            values[s], sizes[s] = value, n
    values, sizes = values[kept], sizes[kept]
    if by_copy:
        place = (np.cumsum(keep) - 1)[where]
        values[place], sizes[place] = np.array([x[0] for x in by_copy], np.uint64), [x[1] for x in by_copy]
    chunk = pack_codes(values, sizes, w)
    size = len(chunk)
    chunk += b"\0" * (size & 1)
    return b"RIFF" + (12 + len(chunk)).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + chunk


#: Payload bytes that one image holds: whole rows side by side up to the format's sides.
MOST_BYTES = MAX_SIDE // ROW * ROW * MAX_SIDE


def store(payload: bytes, most: int = MOST_BYTES) -> bytes:
    """A payload (whole rows of ROW bytes) as an image; long payloads widen the rows, and beyond
    `most` bytes they become several files, one after the other."""
    if len(payload) > most:
        return b"".join(store(payload[at : at + most], most) for at in range(0, len(payload), most))
    rows = len(payload) // ROW
    wide = -(-rows // MAX_SIDE)
    samples = np.frombuffer(payload, np.uint8)
    if rows % wide:
        samples = np.concatenate([samples, np.full(ROW * (wide - rows % wide), 32, np.uint8)])
    return encode_grey(samples, ROW * wide)


def recall(media: bytes, payload_bytes: int, most: int = MOST_BYTES) -> tuple[bytes, list[tuple[int, int, np.ndarray]]]:
    """The payload read back, and of each image its sides and its grey samples."""
    parts, images, at = [], [], 0
    for begin in range(0, payload_bytes, most):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        width, height, argb = decode(media[at : at + size])
        samples = (argb >> np.uint32(8)).astype(np.uint8)
        parts.append(samples[: min(most, payload_bytes - begin)].tobytes())
        images.append((width, height, samples))
        at += size
    return b"".join(parts), images


def feature(width: int, height: int, samples: np.ndarray) -> str:
    """Sides, mean, and one bit for each cell of an 8 by 8 grid: is it lighter than the mean?"""
    rows = np.linspace(0, height, 9).astype(int)[:-1]
    columns = np.linspace(0, width, 9).astype(int)[:-1]
    sums = np.add.reduceat(np.add.reduceat(samples.reshape(height, width), columns, axis=1, dtype=np.int64), rows, axis=0)
    areas = np.outer(np.maximum(1, np.diff([*rows, height])), np.maximum(1, np.diff([*columns, width])))
    mean = int(samples.sum(dtype=np.int64)) / len(samples)
    return f"{width}x{height}:{mean:.4f}:{np.packbits(sums / areas > mean).tobytes().hex()}"


def decode_images(images: DataFrame, id_col: str = "image_id", media_col: str = "media") -> DataFrame:
    """id, width, height, pixels (bytes red, green, blue, alpha; row by row), error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                media = batch.column(1)[r].as_py()
                try:
                    width, height, argb = decode(media or b"")
                    row = [width, height, _channels(argb)[:, [2, 1, 0, 3]].tobytes(), None]
                except BadImage as error:
                    row = [None, None, None, str(error)]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), *(pa.array([v], k) for v, k in zip(row, kinds))], [id_col, "width", "height", "pixels", "error"])

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, width int, height int, pixels binary, error string")


def store_texts(docs: DataFrame, with_media: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a payload, stored as an image, read back and described.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    and with_media the image itself.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                n = max(1, -(-len(raw) // ROW)) * ROW
                media = store(raw.ljust(n))
                back, images = recall(media, n)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), "+".join(feature(*image) for image in images)) + (media,) * with_media)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    types = [kind, "long", "long", "string", "long", "long", "string", "string", "binary"]
    return docs.select(id_col, text_col).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"), with_media=False)


QUERIES = {"op1_webp": op1_webp}
ORACLES: dict[str, str] = {}
