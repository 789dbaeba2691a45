"""Lossless WebP files (VP8L) in numpy: a reader for the whole format and a writer.

Reader. For every bit of a stream the place where the next symbol would begin is computed
at once, from tables of the prefix codes; a walk along these places gives the symbols of an
image. Back-references and colour cache hits become pointers to earlier pixels, resolved by
doubling. Then palette, subtract-green, cross-colour and predictor transforms are inverted,
the predictor along a wavefront x + 2y of independent pixels.

Writer. Pixels are literals, colour cache hits or back-references. `write_strips` cuts long
data into small images, and each takes what makes it smallest: a static code, a static code
with a colour cache, a palette, or codes of its own after a predictor, subtract-green or
cross-colour transform. `read_strips` reads those with static codes side by side.
`write_image` takes transforms and a colour cache by choice.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

U64 = np.uint64
#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES, CACHE_FACTOR, MAX_COPY = 256, 24, 40, 0x1E35A7BD, 4096
#: Bits whose next places are computed at once.
BLOCK = 1 << 20
#: The writer's shortest back-reference, in pixels.
LEAST_COPY = 4
#: Long data is written as strips of so many pixels, each an image of this width.
STRIP, WIDTH = 1024, 64
#: Rounds after which finished images leave those that are read side by side.
LEAVE_ROUNDS = 16
#: Most colours of an image that gets a palette.
PALETTE = 16
#: Bits of the colour cache of strips, and the share of their pixels that hit it, by which the static code is made.
CACHE, HITS = 8, 0.35
#: Predictors that the writer tries, one for a whole strip, and the bits that codes of its own cost a strip at least.
TRIED, OWN_BITS = (1, 2, 4, 11, 12), 900
#: A transform is tried where it leaves less than this share of the bits that the colours take as they are.
WORTH = 0.95
#: Block bits of a strip's predictor or cross-colour element: one block.
ONE_BLOCK = 9


def near_offsets() -> np.ndarray:
    """(dx, dy) of the 120 short distance codes: neighbours above and before, by distance, then |dx|, right before left."""
    spots = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0]
    return np.array(sorted(spots, key=lambda s: (s[0] ** 2 + s[1] ** 2, abs(s[0]), -s[0])))


NEAR = near_offsets()


# ---- prefix codes


@lru_cache(maxsize=16)
def reversed_bits(width: int) -> np.ndarray:
    i, out = np.arange(1 << width), np.zeros(1 << width, np.int64)
    for k in range(width):
        out |= ((i >> k) & 1) << (width - 1 - k)
    return out


@dataclass
class Code:
    """A prefix code: the length of each symbol, and the reader's table over `width` bits."""

    lengths: np.ndarray
    width: int = 0
    symbols: np.ndarray = field(default=None)
    used: np.ndarray = field(default=None)

    def __post_init__(self):
        live = np.flatnonzero(self.lengths)
        if len(live) <= 1:
            self.symbols, self.used = np.array([live[0] if len(live) else 0], np.uint16), np.zeros(1, np.uint8)
            return
        self.width = int(self.lengths.max())
        order = live[np.argsort(self.lengths[live], kind="stable")]
        span = 1 << (self.width - self.lengths[order].astype(np.int64))
        if span.sum() != 1 << self.width:
            raise ValueError("a prefix code of the image is not complete")
        back = reversed_bits(self.width)
        self.symbols = np.repeat(order, span).astype(np.uint16)[back]
        self.used = np.repeat(self.lengths[order], span).astype(np.uint8)[back]

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """(bits, number of bits) of every symbol, as the writer needs them; a lone symbol takes none."""
        bits, sizes = np.zeros(len(self.lengths), U64), self.lengths.astype(np.int64)
        live = np.flatnonzero(self.lengths)
        if len(live) <= 1:
            return bits, np.zeros_like(sizes)
        order = live[np.argsort(self.lengths[live], kind="stable")]
        span = 1 << (self.width - self.lengths[order].astype(np.int64))
        bits[order] = reversed_bits(self.width)[np.cumsum(span) - span]
        return bits, sizes


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits; counts are flattened until it fits."""
    live = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(live) == 1:
        out[live] = 1
    weights = counts[live].astype(np.int64)
    while len(live) > 1:
        heap = [(w, k) for k, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        parent, top = [0] * (2 * len(live) - 1), len(live)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = top
            heapq.heappush(heap, (a[0] + b[0], top))
            top += 1
        depth = [0] * top
        for k in range(top - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        out[live] = depth[: len(live)]
        if out.max() <= limit:
            break
        weights = (weights + 1) // 2 + 1
    return out


# ---- reading


class Bits:
    """Single numbers from a stream, least significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + (n + 14 >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        got = self.peek(n)
        self.at += n
        return got

    def symbol(self, code: Code) -> int:
        at = self.peek(code.width)
        self.at += int(code.used[at])
        return int(code.symbols[at])


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.take(1):
        several, wide = bits.take(1), bits.take(1)
        lengths[bits.take(8 if wide else 1)] = 1
        if several:
            lengths[bits.take(8)] = 1
        return Code(lengths)
    first = np.zeros(19, np.int64)
    for k in range(4 + bits.take(4)):
        first[LENGTH_ORDER[k]] = bits.take(3)
    own = Code(first)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    at, last = 0, 8
    while at < size and left > 0:
        left -= 1
        s = bits.symbol(own)
        if s < 16:
            lengths[at] = s
            last, at = s or last, at + 1
        else:
            run = 3 + bits.take(2) if s == 16 else 3 + bits.take(3) if s == 17 else 11 + bits.take(7)
            lengths[at : at + run] = last if s == 16 else 0
            at += run
    return Code(lengths)


def read_codes(bits: Bits, cache: int) -> tuple[Code, ...]:
    """Green with copies and cache, red, blue, alpha, distance."""
    return tuple(read_code(bits, n) for n in (LITERALS + LENGTHS + (1 << cache if cache else 0), 256, 256, 256, DISTANCES))


def extra_bits(symbols: np.ndarray) -> np.ndarray:
    return np.maximum(0, (symbols - 2) >> 1)


def prefixed(symbols: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return np.where(symbols < 4, symbols, ((2 + (symbols & 1)) << extra_bits(symbols)) + extra) + 1


class Stream:
    """The bytes of streams, padded, for reading at many places at once."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(bytes(data) + bytes(16), np.uint8)

    def window(self, first: int, count: int) -> np.ndarray:
        """The 15 bits from each of `count` places on; `first` is a multiple of 8."""
        b = self.data[first >> 3 : (first + count + 7 >> 3) + 3].astype(np.uint32)
        if len(b) < (count + 7 >> 3) + 3:
            b = np.r_[b, np.zeros((count + 7 >> 3) + 3 - len(b), np.uint32)]
        three = b[:-2] | b[1:-1] << 8 | b[2:] << 16
        return ((three[:, None] >> np.arange(8, dtype=np.uint32)) & 0x7FFF).astype(np.uint16).ravel()

    def numbers(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of `sizes` bits, at most 24, at places `at`."""
        first = np.minimum(at >> 3, len(self.data) - 4)
        word = sum(self.data[first + k].astype(np.int64) << (8 * k) for k in range(4))
        return (word >> (at & 7)) & ((1 << sizes) - 1)

    def look(self, at: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
        bits = self.numbers(at, np.full(len(at), code.width, np.int64))
        return code.symbols[bits].astype(np.int64), code.used[bits].astype(np.int64)

    def copy_at(self, at: np.ndarray, green: np.ndarray, codes: tuple[Code, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, distance code and end of back-references whose length symbol ends at `at`."""
        kind = green - LITERALS
        size = extra_bits(kind)
        length = prefixed(kind, self.numbers(at, size))
        at = at + size
        far, used = self.look(at, codes[4])
        size = extra_bits(far)
        return length, prefixed(far, self.numbers(at + used, size)), at + used + size

    def next_places(self, first: int, count: int, codes: tuple[Code, ...]) -> np.ndarray:
        """For each of `count` places from `first` on, the distance to the end of the pixel or reference that begins there."""
        margin = 64
        w = self.window(first, count + margin)
        steps = [c.used[w & ((1 << c.width) - 1)] if c.width else None for c in codes[:4]]
        at = np.arange(count, dtype=np.int32)
        end = at
        for s in steps:
            if s is not None:
                end = end + s[end]
        green = codes[0].symbols[w[:count] & ((1 << codes[0].width) - 1)]
        odd = np.flatnonzero(green >= LITERALS)
        if len(odd):
            green = green[odd].astype(np.int64)
            place = first + odd + (steps[0][odd] if steps[0] is not None else 0)
            copy = green < LITERALS + LENGTHS
            done = place.copy()
            if copy.any():
                done[copy] = self.copy_at(place[copy], green[copy], codes)[2]
            end[odd] = done - first
        return end

    def walk(self, begin: np.ndarray, end: np.ndarray, most: np.ndarray, codes: tuple[Code, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the symbols of streams that lie one after the other, from `begin` to before `end` or `most` symbols; and the number of each."""
        places, counts = [], []
        base, limit, table = 0, 0, None
        for p, stop, left in zip(begin.tolist(), end.tolist(), most.tolist(), strict=True):
            counts.append(0)
            while left and (p < stop or not counts[-1]):
                if not base <= p < limit:
                    base = p & ~7
                    limit = base + min(BLOCK, max(64, int(end[-1]) - base))
                    table = memoryview(np.ascontiguousarray(self.next_places(base, limit - base, codes)))
                q, bound, found = p - base, min(limit, max(stop, p + 1)) - base, []
                put = found.append
                while q < bound and left:
                    put(q)
                    left -= 1
                    q = table[q]
                places.append(np.array(found, np.int64) + base)
                counts[-1] += len(found)
                p = q + base
        return np.concatenate(places), np.array(counts)

    def pixels(self, begin: np.ndarray, end: np.ndarray, width: np.ndarray, total: np.ndarray, codes: tuple[Code, ...], cache: int) -> tuple[np.ndarray, int]:
        """Pixels (blue, green, red, alpha from the low byte on) of images with the same codes, one after the other, and where the last ends."""
        at, counts = self.walk(begin, end, total, codes)
        owner = np.repeat(np.arange(len(counts)), counts)
        green, used = self.look(at, codes[0])
        place = at + used
        values = np.zeros(len(at), np.int64)
        plain = green < LITERALS
        spot = place[plain]
        parts = []
        for c in codes[1:4]:
            s, used = self.look(spot, c)
            spot = spot + used
            parts.append(s)
        values[plain] = parts[2] << 24 | parts[0] << 16 | green[plain] << 8 | parts[1]
        finish = place.copy()
        finish[plain] = spot
        span = np.ones(len(at), np.int64)
        back = np.zeros(len(at), np.int64)
        copy = (green >= LITERALS) & (green < LITERALS + LENGTHS)
        if copy.any():
            length, code, finish[copy] = self.copy_at(place[copy], green[copy], codes)
            near = NEAR[np.minimum(code, 120) - 1]
            span[copy] = length
            back[copy] = np.where(code > 120, code - 120, np.maximum(1, near[:, 0] + near[:, 1] * width[owner[copy]]))
        # the end of a stream is filled up with bits that may look like symbols
        before = np.cumsum(span) - span
        before -= before[np.cumsum(counts) - counts][owner]
        keep = before < total[owner]
        last = int(finish[np.flatnonzero(keep)[-1]])
        owner, green, values, span, back, before = (x[keep] for x in (owner, green, values, span, back, before))
        span = np.minimum(span, total[owner] - before)
        if not np.array_equal(np.bincount(owner, span, len(total)).astype(np.int64), total):
            raise ValueError("an image ends before its pixels do")
        hit = green >= LITERALS + LENGTHS
        if (back > before).any():
            raise ValueError("a back-reference points before its image")
        if not (back.any() or hit.any()):
            return values.astype(np.uint32), last
        return resolved(np.repeat(values, span), np.repeat(back, span), np.repeat(np.where(hit, green - LITERALS - LENGTHS, -1), span), np.repeat(owner, span), cache), last


def resolved(values: np.ndarray, back: np.ndarray, slot: np.ndarray, owner: np.ndarray, cache: int) -> np.ndarray:
    """Pixels of literals, copies (`back` pixels before) and cache hits (`slot`, else -1). A slot never used is 0."""
    source = np.arange(len(values)) - back
    source = doubled(source)
    if (slot >= 0).any():
        # a pixel's slot is known before its value is: that of the literal or hit which it copies
        key = np.where(slot >= 0, slot, cache_slots(values.astype(np.uint32), cache))[source] + (owner << 16)
        order = np.argsort(key, kind="stable")
        before = np.full(len(values), -1)
        same = key[order][1:] == key[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        hits = np.flatnonzero(slot >= 0)
        source[hits] = before[hits]
        values = np.r_[values, 0]
        source = doubled(np.r_[np.where(source < 0, len(source), source), len(source)])[:-1]
    return values[source].astype(np.uint32)


def doubled(source: np.ndarray) -> np.ndarray:
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return source
        source = further


def cache_slots(values: np.ndarray, cache: int) -> np.ndarray:
    return ((values * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache)).astype(np.int64)


def blocks(side: int, bits: int) -> int:
    return (side + (1 << bits) - 1) >> bits


class Reader:
    """One stream from its start: header, transforms, codes, pixels."""

    def __init__(self, data: bytes):
        self.bits, self.stream = Bits(data), Stream(data)
        if self.bits.take(8) != 0x2F:
            raise ValueError("no lossless image")
        self.width, self.height = self.bits.take(14) + 1, self.bits.take(14) + 1
        self.bits.take(4)

    def image(self, width: int, height: int, main: bool) -> np.ndarray:
        cache = self.bits.take(4) if self.bits.take(1) else 0
        groups = None
        if main and self.bits.take(1):
            block = self.bits.take(3) + 2
            groups = (self.image(blocks(width, block), blocks(height, block), False) >> 8 & 0xFFFF).astype(np.int64)
            sets = [read_codes(self.bits, cache) for _ in range(int(groups.max()) + 1)]
            return self.grouped(width, height, cache, groups, block, sets)
        codes = read_codes(self.bits, cache)
        one = lambda x: np.array([x])
        out, self.bits.at = self.stream.pixels(one(self.bits.at), one(len(self.bits.data) * 8), one(width), one(width * height), codes, cache)
        return out

    def grouped(self, width: int, height: int, cache: int, groups: np.ndarray, block: int, sets: list) -> np.ndarray:
        """Codes that change from block to block: symbol by symbol, as each symbol's place decides the next one's code."""
        total, across, at = width * height, blocks(width, block), 0
        values, back, slot = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, -1)
        bits = self.bits
        while at < total:
            codes = sets[groups[(at // width >> block) * across + (at % width >> block)]]
            green = bits.symbol(codes[0])
            if green < LITERALS:
                red, blue, alpha = (bits.symbol(c) for c in codes[1:4])
                values[at] = alpha << 24 | red << 16 | green << 8 | blue
                at += 1
            elif green < LITERALS + LENGTHS:
                length, code, end = self.stream.copy_at(np.array([bits.at]), np.array([green]), codes)
                bits.at, code = int(end[0]), int(code[0])
                dx, dy = NEAR[min(code, 120) - 1]
                back[at : at + int(length[0])] = code - 120 if code > 120 else max(1, dx + dy * width)
                at += int(length[0])
            else:
                slot[at] = green - LITERALS - LENGTHS
                at += 1
        return resolved(values, back, slot, np.zeros(total, np.int64), cache)

    def read(self) -> np.ndarray:
        width, undo = self.width, []
        while self.bits.take(1):
            kind = self.bits.take(2)
            if kind < 2:
                block = self.bits.take(3) + 2
                data = self.image(blocks(width, block), blocks(self.height, block), False)
                undo.append(((unpredicted, uncrossed)[kind], width, block, data))
            elif kind == 2:
                undo.append((ungreened, width, 0, None))
            else:
                n = self.bits.take(8) + 1
                table = np.cumsum(channels(self.image(n, 1, False)), axis=0)
                undo.append((unpaletted, width, 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0, packed(table & 255)))
                width = blocks(width, undo[-1][2])
        pixels = self.image(width, self.height, True)
        for step, wide, block, data in reversed(undo):
            pixels = step(pixels, wide, self.height, block, data)
        return pixels


def channels(pixels: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha of each pixel."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(-1, 4).astype(np.int32)


def packed(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.astype(np.uint8)).view("<u4").ravel()


# ---- transforms


def block_of(data: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    """The block's element for each pixel, rows by columns."""
    grid = data.reshape(blocks(height, block), blocks(width, block))
    return grid[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]


def ungreened(pixels, width, height, block, data):
    c = channels(pixels)
    c[:, [0, 2]] += c[:, [1]]
    return packed(c & 255)


def signed_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int8).astype(np.int32) * b.astype(np.int8).astype(np.int32)) >> 5


def uncrossed(pixels, width, height, block, data):
    c, m = channels(pixels), channels(block_of(data, width, height, block).ravel())
    c[:, 2] = (c[:, 2] + signed_product(m[:, 0], c[:, 1])) & 255
    c[:, 0] = (c[:, 0] + signed_product(m[:, 1], c[:, 1]) + signed_product(m[:, 2], c[:, 2])) & 255
    return packed(c)


def unpaletted(pixels, width, height, block, data):
    index = (pixels >> 8 & 255).astype(np.int64).reshape(height, -1)
    if block:
        each = 8 >> block
        index = ((index[:, :, None] >> (np.arange(1 << block) * each)) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(data)] = data
    return table[index.ravel()]


def predictions(mode: np.ndarray, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The prediction of each of many pixels (pixels x channels) from its neighbours."""
    half = lambda a, b: (a + b) >> 1
    black = np.zeros_like(left)
    black[:, 3] = 255
    to_left, to_top = (np.abs(x - corner).sum(axis=1, keepdims=True) for x in (top, left))  # distance of left + top - corner from left, from top
    mean = half(left, top)
    options = (
        black, left, top, right, corner, half(half(left, right), top), half(left, corner), mean, half(corner, top), half(top, right), half(half(left, corner), half(top, right)),
        np.where(to_left < to_top, left, top), np.clip(left + top - corner, 0, 255), np.clip(mean + np.where(mean >= corner, (mean - corner) // 2, -((corner - mean) // 2)), 0, 255), black, black,
    )
    return np.choose(np.broadcast_to(mode[:, None], left.shape), options)


def modes(width: int, height: int, block: int, data: np.ndarray) -> np.ndarray:
    """The predictor of each pixel: black for the first, left for the first row, top for the first column, else its block's."""
    mode = (block_of(data, width, height, block) >> 8 & 15).astype(np.int64)
    mode[:, 0], mode[0, :], mode[0, 0] = 2, 1, 0
    return mode


def neighbours(c: np.ndarray, y: np.ndarray, x: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Left, top, top-left and top-right; that of the last column is the first pixel of its own row."""
    flat = c.reshape(-1, 4)
    at = y * width + x
    return tuple(flat[np.maximum(0, at - d)] for d in (1, width, width + 1, width - 1))


def unpredicted(pixels, width, height, block, data):
    c, mode = channels(pixels).reshape(height, width, 4), modes(width, height, block, data)
    for t in range(width + 2 * height - 2):
        y = np.arange(max(0, (t - width + 2) // 2), min(height - 1, t // 2) + 1)
        x = t - 2 * y
        c[y, x] = (c[y, x] + predictions(mode[y, x], *neighbours(c, y, x, width))) & 255
    return packed(c.reshape(-1, 4))


def predicted(pixels, width, height, block, data):
    c, mode = channels(pixels).reshape(height, width, 4), modes(width, height, block, data)
    y, x = (v.ravel() for v in np.mgrid[:height, :width])
    return packed((c[y, x] - predictions(mode[y, x], *neighbours(c, y, x, width))) & 255)


def crossed(pixels, width, height, block, data):
    c, m = channels(pixels), channels(block_of(data, width, height, block).ravel())
    blue = c[:, 0] - signed_product(m[:, 1], c[:, 1]) - signed_product(m[:, 2], c[:, 2])
    c[:, 2] -= signed_product(m[:, 0], c[:, 1])
    c[:, 0] = blue
    return packed(c & 255)


def greened(pixels, width, height, block, data):
    c = channels(pixels)
    c[:, [0, 2]] -= c[:, [1]]
    return packed(c & 255)


# ---- writing


def spread(value: int, n: int) -> list[tuple[int, int]]:
    """A number of many bits as pieces of at most 32."""
    return [(value >> k & 0xFFFFFFFF, min(32, n - k)) for k in range(0, n, 32)]


def code_pieces(lengths: np.ndarray) -> list[tuple[int, int]]:
    """The description of a code as (number, bits) pieces."""
    live = np.flatnonzero(lengths)
    if len(live) == 0 or (len(live) == 1 and live[0] < 256) or (len(live) == 2 and live[1] < 256 and lengths[live].max() == 1):
        symbols = live.tolist() or [0]
        return [(1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols)]
    tokens, at = [], 0
    cuts = [*(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
    for end in cuts:
        value, run = int(lengths[at]), end - at
        at = end
        if value:
            tokens.append((value, 0, 0))
            run -= 1
        while run:
            if value and run >= 3:
                n = min(6, run)
                tokens.append((16, n - 3, 2))
            elif not value and run >= 11:
                n = min(138, run)
                tokens.append((18, n - 11, 7))
            elif not value and run >= 3:
                n = run
                tokens.append((17, n - 3, 3))
            else:
                n = 1
                tokens.append((value, 0, 0))
            run -= n
    first = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    bits, sizes = Code(first).codes()
    n = max(4, *(k + 1 for k, s in enumerate(LENGTH_ORDER) if first[s]))
    out = [(0, 1), (n - 4, 4), *((int(first[s]), 3) for s in LENGTH_ORDER[:n]), (0, 1)]
    for s, extra, wide in tokens:
        out += [(int(bits[s]), int(sizes[s])), (extra, wide)]
    return [p for p in out if p[1]]


class Codes:
    """The five codes of an image for the writer."""

    def __init__(self, lengths: list[np.ndarray]):
        made = [Code(x).codes() for x in lengths]
        self.bits, self.sizes = [b for b, _ in made], [s for _, s in made]
        self.pieces = [p for x in lengths for p in code_pieces(x)]


@lru_cache(maxsize=2)
def static_codes(cache: int = 0) -> Codes:
    """One code for all small images of text, with or without a colour cache: weights by the kind of byte, the same for each colour."""
    weight = np.ones(LITERALS + LENGTHS, np.int64)
    for chars, w in ((range(128, 256), 3), (range(33, 127), 4), (range(48, 58), 8), (range(97, 123), 30), (b".,\n", 16), (b"etaoinsrhld", 80), (b" ", 250)):
        weight[list(chars)] = w
    far = np.ones(DISTANCES, np.int64)
    green = weight
    if cache:
        each = weight.sum() * HITS / (1 - HITS) / (1 << cache)
        green = np.r_[weight * 16, np.full(1 << cache, round(each * 16))]
    return Codes([code_lengths(green), code_lengths(weight[:256]), code_lengths(weight[:256]), one_symbol(256, 255), code_lengths(far)])


def one_symbol(size: int, symbol: int) -> np.ndarray:
    return (np.arange(size) == symbol).astype(np.int64)


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra number and its bits of values from 1 on."""
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(float))[1] - 1
    symbol = np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1))
    size = extra_bits(symbol)
    return symbol, np.where(v < 4, 0, v & ((1 << size) - 1)), size


def repeats(pixels: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of back-references inside each image, left to right, without overlap."""
    n = len(pixels) - LEAST_COPY + 1
    none = np.zeros(0, np.int64)
    if n <= 1:
        return none, none, none
    wide = pixels.astype(U64)
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    within = np.arange(n) - begin[owner[:n]]
    bits = max(10, int(within.max()).bit_length())
    with np.errstate(over="ignore"):
        pair = wide[:-1] | wide[1:] << U64(32)
        mixed = (pair[:n] * U64(0x9E3779B97F4A7C15)) ^ (pair[2 : n + 2] * U64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> U64(29))) * U64(0xD6E8FEB86659FD93)
    # image, hash and place in one number: what an image's hashes are does not depend on the others
    key = np.sort(owner[:n].astype(U64) << U64(42) | mixed >> U64(22 + bits) << U64(bits) | within.astype(U64))
    order = begin[(key >> U64(42)).astype(np.int64)] + (key & U64((1 << bits) - 1)).astype(np.int64)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(key[:-1] >> U64(bits) == key[1:] >> U64(bits))
    a, b = a[near], b[near]
    good = (owner[b + LEAST_COPY - 1] == owner[a]) & (pair[a] == pair[b]) & (pair[a + 2] == pair[b + 2])
    back = np.zeros(n, np.int64)
    back[b[good]] = (b - a)[good]
    cut = np.flatnonzero(np.r_[True, (back[1:] != back[:-1]) | (owner[1:n] != owner[: n - 1])])
    ends = np.r_[cut[1:], n]
    live = back[cut] > 0
    starts, lengths, distances, free = [], [], [], 0
    for s, e, d in zip(cut[live].tolist(), ends[live].tolist(), back[cut[live]].tolist(), strict=True):
        s, e = max(s, free), e + LEAST_COPY - 1
        while e - s >= LEAST_COPY:
            take = min(MAX_COPY, e - s)
            starts.append(s)
            lengths.append(take)
            distances.append(d)
            s += take
            free = s
    return np.array(starts, np.int64), np.array(lengths, np.int64), np.array(distances, np.int64)


def symbols_of(pixels: np.ndarray, owner: np.ndarray, copies: bool = True) -> dict:
    """Which pixels are literals, and the back-references that stand for the others."""
    starts, lengths, distances = repeats(pixels, owner) if copies else (np.zeros(0, np.int64),) * 3
    covered = np.zeros(len(pixels) + 1, np.int64)
    covered[starts] += 1
    covered[starts + lengths] -= 1
    plain = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
    return {"plain": plain, "starts": starts, "length": prefix_of(lengths), "far": prefix_of(distances + 120)}


def written(pixels: np.ndarray, found: dict, codes: Codes, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first pixel, bits and number of bits of each symbol; `slots` names the cache slot of literals that hit, else -1."""
    at = found["plain"]
    c = [(pixels[at] >> s & 255).astype(np.int64) for s in (8, 16, 0, 24)]
    bits, sizes = codes.bits[0][c[0]], codes.sizes[0][c[0]]
    for k in range(1, 4):
        bits, sizes = bits | codes.bits[k][c[k]] << sizes.astype(U64), sizes + codes.sizes[k][c[k]]
    if slots is not None:
        hit = slots >= 0
        bits[hit], sizes[hit] = codes.bits[0][LITERALS + LENGTHS + slots[hit]], codes.sizes[0][LITERALS + LENGTHS + slots[hit]]
    if not len(found["starts"]):
        return at, bits, sizes
    more, wide = np.zeros(len(found["starts"]), U64), np.zeros(len(found["starts"]), np.int64)
    for (symbol, extra, size), k, first in ((found["length"], 0, LITERALS), (found["far"], 4, 0)):
        for value, n in ((codes.bits[k][symbol + first], codes.sizes[k][symbol + first]), (extra.astype(U64), size)):
            more, wide = more | value << wide.astype(U64), wide + n
    places = np.r_[at, found["starts"]]
    order = np.argsort(places, kind="stable")
    return places[order], np.r_[bits, more][order], np.r_[sizes, wide][order]


def joined_bits(bits: np.ndarray, sizes: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
    """Numbers of at most 57 bits put at their places of one stream of bytes."""
    words = np.zeros(total // 64 + 2, U64)
    word, shift = at >> 6, (at & 63).astype(U64)
    np.bitwise_or.at(words, word, bits << shift)
    over = np.flatnonzero((at & 63) + sizes > 64)
    np.bitwise_or.at(words, word[over] + 1, bits[over] >> (U64(64) - shift[over]))
    return words.view(np.uint8)


def boxed(stream: bytes) -> bytes:
    """The file around a stream."""
    body = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


def unboxed(file: bytes) -> bytes:
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while at + 8 <= len(file):
        size = int.from_bytes(file[at + 4 : at + 8], "little")
        if file[at : at + 4] == b"VP8L":
            return file[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def head_pieces(width: int, height: int) -> list[tuple[int, int]]:
    return [(0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 4)]


def own_codes(pixels: np.ndarray, found: dict, cache: int = 0, slots: np.ndarray | None = None) -> Codes:
    """Codes after the counts of one image's symbols."""
    at = found["plain"]
    green = (pixels[at] >> 8 & 255).astype(np.int64)
    literal = np.ones(len(at), bool)
    if slots is not None:
        literal = slots < 0
        green = np.where(literal, green, LITERALS + LENGTHS + slots)
    size = LITERALS + LENGTHS + (1 << cache if cache else 0)
    counts = [np.bincount(np.r_[green, LITERALS + found["length"][0]], minlength=size)]
    counts += [np.bincount((pixels[at][literal] >> s & 255).astype(np.int64), minlength=256) for s in (16, 0, 24)]
    counts.append(np.bincount(found["far"][0], minlength=DISTANCES))
    return Codes([code_lengths(c) for c in counts])


def image_pieces(pixels: np.ndarray, main: bool, cache: int = 0, copies: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """An image with codes of its own as arrays of (bits, number of bits)."""
    owner = np.zeros(len(pixels), np.int64)
    found = symbols_of(pixels, owner, copies)
    slots = hit_slots(pixels, owner, cache)[found["plain"]] if cache else None
    codes = own_codes(pixels, found, cache, slots)
    _, bits, sizes = written(pixels, found, codes, slots)
    head = [(1, 1), (cache, 4)] if cache else [(0, 1)]
    return [as_arrays(head + ([(0, 1)] if main else []) + codes.pieces), (bits, sizes)]


def hit_slots(pixels: np.ndarray, owner: np.ndarray, cache: int) -> np.ndarray:
    """The cache slot of each pixel whose image's last pixel in that slot is the same, else -1."""
    key = owner << cache | cache_slots(pixels.astype(np.uint32), cache)
    order = np.argsort(key, kind="stable")
    hit = np.full(len(pixels), -1)
    same = (key[order][1:] == key[order][:-1]) & (pixels[order][1:] == pixels[order][:-1])
    hit[order[1:][same]] = key[order[1:][same]] & ((1 << cache) - 1)
    return hit


def as_arrays(pieces: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p[0] for p in pieces], U64), np.array([p[1] for p in pieces], np.int64)


def write_image(pixels: np.ndarray, width: int, height: int, transforms: tuple = (), cache: int = 0, copies: bool = True) -> bytes:
    """A file with chosen transforms, in this order: ("green",), ("predict" or "cross", block bits, data) or ("palette",)."""
    parts, own_width = [as_arrays(head_pieces(width, height))], width
    for name, *more in transforms:
        if name == "green":
            parts.append(as_arrays([(1, 1), (2, 2)]))
            pixels = greened(pixels, width, height, 0, None)
        elif name == "palette":
            table, index = np.unique(pixels, return_inverse=True)
            n = len(table)
            block = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            parts += [as_arrays([(1, 1), (3, 2), (n - 1, 8)]), *image_pieces(packed(np.diff(channels(table), axis=0, prepend=0) & 255), False)]
            wide = blocks(width, block) << block
            grid = np.zeros((height, wide), np.int64)
            grid[:, :width] = index.reshape(height, width)
            grid = (grid.reshape(height, -1, 1 << block) << (np.arange(1 << block) * (8 >> block))).sum(axis=2)
            pixels, own_width = (grid.ravel() << 8 | 0xFF000000).astype(np.uint32), blocks(width, block)
        else:
            block, data = more
            parts += [as_arrays([(1, 1), (0 if name == "predict" else 1, 2), (block - 2, 3)]), *image_pieces(data, False)]
            pixels = (predicted if name == "predict" else crossed)(pixels, own_width, height, block, data)
    parts += [as_arrays([(0, 1)]), *image_pieces(pixels, True, cache, copies)]
    bits, sizes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    total = int(sizes.sum())
    return boxed(joined_bits(bits, sizes, np.cumsum(sizes) - sizes, total)[: (total + 7) // 8].tobytes())


def read_image(file: bytes) -> tuple[np.ndarray, int, int]:
    """Pixels (blue, green, red, alpha from the low byte on), width and height."""
    reader = Reader(unboxed(file))
    return reader.read(), reader.width, reader.height


# ---- many small images


def strips(payload: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels of payloads that lie one after the other (three bytes a pixel, red first, opaque), and the payload and size of each strip."""
    parts = np.full((len(payload) // 3, 4), 255, np.uint8)
    parts[:, 2::-1] = payload.reshape(-1, 3)
    n = sizes // 3
    count = -(-n // STRIP)
    owner = np.repeat(np.arange(len(n)), count)
    last = np.cumsum(count) - 1
    area = np.full(len(owner), STRIP)
    area[last] = n - (count - 1) * STRIP
    return parts.view("<u4").ravel(), owner, area


def write_strips(payload: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each payload (of a multiple of 192 bytes) its strips of WIDTH pixels, a file each, one after the other; they depend on this payload alone."""
    pixels, payload_of, area = strips(payload, sizes)
    first = np.cumsum(area) - area
    files: list[bytes] = [b""] * len(area)
    change = np.r_[True, pixels[1:] != pixels[:-1]]
    changes = np.add.reduceat(change.astype(np.int64), first)
    plain = np.ones(len(area), bool)
    for k in np.flatnonzero(changes <= PALETTE).tolist():
        part = pixels[first[k] : first[k] + area[k]]
        if len(np.unique(part)) <= PALETTE:
            files[k], plain[k] = write_image(part, WIDTH, int(area[k]) // WIDTH, (("palette",),)), False
    if plain.any():
        pixels, area = pixels[np.repeat(plain, area)], area[plain]
        owner = np.repeat(np.arange(len(area)), area)
        found = symbols_of(pixels, owner)
        place, bits, sizes = written(pixels, found, static_codes())
        _, bits_c, sizes_c = written(pixels, found, static_codes(CACHE), hit_slots(pixels, owner, CACHE)[found["plain"]])
        heads = [static_heads(c) for c in (0, CACHE)]
        head_size = np.array([int(h[1].sum()) for h in heads])
        bodies = [np.bincount(owner[place], x, len(area)).astype(np.int64) for x in (sizes, sizes_c)]
        cached = bodies[1] + head_size[1] < bodies[0] + head_size[0]
        body, head_size = np.where(cached, bodies[1], bodies[0]), head_size[cached.astype(int)]
        bits, sizes = np.where(cached[owner[place]], bits_c, bits), np.where(cached[owner[place]], sizes_c, sizes)
        length = (head_size + body + 7) // 8
        at = (np.cumsum(length) - length) * 8
        within = np.cumsum(sizes) - sizes - (np.cumsum(body) - body)[owner[place]]
        put = [(bits, sizes, (at + head_size)[owner[place]] + within)]
        for (rows, wide), mine in zip(heads, (~cached, cached), strict=True):
            put.append((rows[area[mine] // WIDTH - 1].ravel(), np.tile(wide, int(mine.sum())), (at[mine][:, None] + (np.cumsum(wide) - wide)[None, :]).ravel()))
        data = joined_bits(*(np.concatenate([x[k] for x in put]) for k in range(3)), int(length.sum()) * 8).tobytes()
        made = [boxed(data[a : a + n]) for a, n in zip((at // 8).tolist(), length.tolist(), strict=True)]
        for k, choices in transforms_worth(pixels, owner, area, length * 8):
            first_at = int(np.sum(area[:k]))
            part = pixels[first_at : first_at + area[k]]
            made[k] = min([made[k], *(write_image(part, WIDTH, int(area[k]) // WIDTH, c) for c in choices)], key=len)
        for k, file in zip(np.flatnonzero(plain).tolist(), made, strict=True):
            files[k] = file
    cuts = np.searchsorted(payload_of, np.arange(len(np.unique(payload_of)) + 1)).tolist()
    return [b"".join(files[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def spreads(parts: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Bits that the colours (red, green, blue by pixel) of each strip take at least, each coded by its own counts."""
    out = np.zeros(count)
    size = np.bincount(owner, minlength=count)
    at = owner * 256
    for k in range(3):
        n = np.bincount(at + parts[:, k], minlength=count * 256).reshape(count, 256)
        out += size * np.log2(np.maximum(size, 1)) - (n * np.log2(np.maximum(n, 1))).sum(axis=1)
    return out


def transforms_worth(pixels: np.ndarray, owner: np.ndarray, area: np.ndarray, bits: np.ndarray) -> list[tuple[int, list[tuple]]]:
    """Strips that a transform may make smaller than `bits`, each with the transforms to try.

    Differences from the pixel on the left, above, and above it on the left, and from green,
    tell which strips these are; the other predictors are tried on them as well.
    """
    parts = np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1]
    plain = spreads(parts, owner, len(area))
    changed = [parts - parts[:, [1]]] + [parts - np.r_[parts[:d], parts[:-d]] for d in (1, WIDTH, WIDTH + 1)]
    changed[0][:, 1] = parts[:, 1]
    least = np.min([spreads(x, owner, len(area)) for x in changed], axis=0)
    element = lambda value: np.array([value], np.uint32)
    out = []
    # codes of its own alone are no reason: such strips are not read side by side
    for k in np.flatnonzero((least + OWN_BITS < bits) & (least < WORTH * plain)).tolist():
        cross = ("cross", ONE_BLOCK, element(0xFF000000 | cross_element(pixels[owner == k])))
        tried = [("predict", ONE_BLOCK, element(0xFF000000 | mode << 8)) for mode in TRIED]
        out.append((k, [(("green",),), (cross,), *((t,) for t in tried), *((t, cross) for t in tried)]))
    return out


def cross_element(pixels: np.ndarray) -> int:
    """The multipliers of red and blue by green, in 32nds, that fit the pixels best by least squares; low byte green to red, then green to blue."""
    c = channels(pixels).astype(float)
    g = c[:, 1] @ c[:, 1]
    red, blue = (int(np.clip(round(32 * (c[:, k] @ c[:, 1]) / g), -128, 127)) if g else 0 for k in (2, 0))
    return red & 255 | (blue & 255) << 8


@lru_cache(maxsize=2)
def static_heads(cache: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The start of a strip's stream in pieces, for each height, and the bits of the pieces."""
    rows = []
    flags = [(0, 1), (1, 1), (cache, 4), (0, 1)] if cache else [(0, 3)]
    for height in range(1, STRIP // WIDTH + 1):
        value, n = 0, 0
        for v, k in [*head_pieces(WIDTH, height), *flags, *static_codes(cache).pieces]:
            value, n = value | v << n, n + k
        rows.append(as_arrays(spread(value, n)))
    return np.stack([r[0] for r in rows]), rows[0][1]


class Known:
    """Descriptions of codes met before: streams without transforms and groups whose first bits agree share them."""

    def __init__(self, most: int = 8):
        self.most, self.seen = most, {}

    def find(self, stream: bytes) -> tuple[int, tuple[Code, ...], int] | None:
        """Where the pixels begin, the codes, and the bits of the colour cache."""
        for number, (size, codes, cache) in self.seen.items():
            if Bits(stream, 40).peek(size) == number:
                return 40 + size, codes, cache
        bits = Bits(stream, 40)
        if len(self.seen) >= self.most or bits.take(1):
            return None
        cache = bits.take(4) if bits.take(1) else 0
        if bits.take(1):
            return None
        codes = read_codes(bits, cache)
        size = bits.at - 40
        self.seen[Bits(stream, 40).peek(size)] = (size, codes, cache)
        return bits.at, codes, cache


def read_strips(files: list[bytes], known: Known) -> list[bytes]:
    """The payload of each series of files; strips with the same codes are read side by side."""
    parts: list[list] = []
    together: dict[int, list] = {}
    for k, series in enumerate(files):
        at, own = 0, []
        while at < len(series):
            size = 8 + int.from_bytes(series[at + 4 : at + 8], "little")
            stream = unboxed(series[at : at + size])
            found = known.find(stream)
            if found is None:
                own.append(to_bytes(Reader(stream).read()))
            else:
                side = Bits(stream, 8)
                total = (side.take(14) + 1) * (side.take(14) + 1)
                together.setdefault(id(found[1]), []).append((k, len(own), stream, total, found))
                own.append(b"")
            at += size
        parts.append(own)
    for group in together.values():
        sizes = np.array([len(g[2]) for g in group]) * 8
        total = np.array([g[3] for g in group])
        pixels = side_by_side(b"".join(g[2] for g in group), np.cumsum(sizes) - sizes + group[0][4][0], total, *group[0][4][1:])
        data = to_bytes(pixels)
        for (k, j, *_), end, n in zip(group, np.cumsum(total).tolist(), total.tolist(), strict=True):
            parts[k][j] = data[(end - n) * 3 : end * 3]
    return [b"".join(p) for p in parts]


def side_by_side(data: bytes, begin: np.ndarray, total: np.ndarray, codes: tuple[Code, ...], cache: int = 0) -> np.ndarray:
    """Pixels of images with the same codes and the width WIDTH: a symbol of every image per round."""
    *tables, distance = [c.symbols.astype(np.int64) | c.used.astype(np.int64) << 16 for c in codes]
    *masks, last_mask = [(1 << c.width) - 1 for c in codes]
    stream = Stream(data + bytes(16 * LEAVE_ROUNDS))
    word = np.lib.stride_tricks.as_strided(stream.data, (len(stream.data) - 8, 8), (1, 1)).copy().view("<i8").ravel()
    first = np.cumsum(total) - total + np.arange(len(total))  # each image with a place for what follows its last pixel
    values, back = np.zeros(int(total.sum()) + len(total), np.int64), np.zeros(int(total.sum()) + len(total), np.int64)
    slot = np.full(len(values), -1) if cache else None
    at, done, goal, rounds = begin.copy(), first.copy(), first + total, 0
    while len(at):
        w = word[at >> 3] >> (at & 7)
        green = tables[0][w & masks[0]]
        used = green >> 16
        green &= 0xFFFF
        value, bits = green << 8, used
        own = used
        for k, shift in ((1, 16), (2, 0), (3, 24)):
            if masks[k]:
                if k == 3:  # a fourth symbol may lie beyond the word
                    w, used = word[at + bits >> 3] >> (at + bits & 7), 0
                w = w >> used
                s = tables[k][w & masks[k]]
                used = s >> 16
                bits = bits + used
                value |= (s & 0xFFFF) << shift
            else:
                value |= int(tables[k][0] & 0xFFFF) << shift
        place = np.minimum(done, goal)
        values[place] = value
        odd = np.flatnonzero(green >= LITERALS)
        step = 1
        if cache and len(odd):
            hits = odd[green[odd] >= LITERALS + LENGTHS]
            odd = odd[green[odd] < LITERALS + LENGTHS]
            values[place[hits]] = 0
            slot[place[hits]] = green[hits] - LITERALS - LENGTHS
            bits = bits.copy()
            bits[hits] = own[hits]
        if len(odd):
            step = np.ones(len(at), np.int64)
            begun = at[odd]
            w = word[begun >> 3] >> (begun & 7)
            used = tables[0][w & masks[0]] >> 16
            kind = green[odd] - LITERALS
            size = extra_bits(kind)
            w >>= used
            length = prefixed(kind, w & ((1 << size) - 1))
            w >>= size
            far = distance[w & last_mask]
            end = begun + used + size + (far >> 16)
            far &= 0xFFFF
            size = extra_bits(far)
            code = prefixed(far, (word[end >> 3] >> (end & 7)) & ((1 << size) - 1))
            end += size
            near = NEAR[np.minimum(code, 120) - 1]
            code = np.where(code > 120, code - 120, np.maximum(1, near[:, 0] + near[:, 1] * WIDTH))
            live = done[odd] < goal[odd]
            if (code[live] > (done[odd] - goal[odd])[live] + total[np.searchsorted(first, done[odd][live], "right") - 1]).any():
                raise ValueError("a back-reference points before its image")
            length = np.minimum(length, goal[odd] - place[odd])
            spots = np.repeat(place[odd] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
            back[spots] = np.repeat(code, length)
            step[odd] = np.maximum(length, 1)
            bits = bits.copy()
            bits[odd] = end - begun
        at, done, rounds = at + bits, done + step, rounds + 1
        if rounds % LEAVE_ROUNDS == 0:
            live = np.flatnonzero(done < goal)
            if len(live) < len(at):
                at, done, goal = at[live], done[live], goal[live]
    inside = np.ones(len(values), bool)
    inside[first + total] = False
    if cache:
        # what a place after an image holds is no pixel of it
        slot[first + total] = -1
        return resolved(values, back, slot, np.repeat(np.arange(len(total)), total + 1), cache)[inside]
    if back.any():
        values = values[doubled(np.arange(len(values)) - back)]
    return values[inside].astype(np.uint32)


def to_bytes(pixels: np.ndarray) -> bytes:
    """Three bytes a pixel, red first."""
    return np.ascontiguousarray(np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1]).tobytes()
