"""Media columns in lossless WebP: a decoder for whole VP8L streams and a writer for 8-bit samples.

The decoder reads prefix codes (simple and length-coded, with groups chosen by an entropy image),
back-references and the colour cache, and inverts the predictor, cross-colour, subtract-green and
palette transforms into ARGB pixel arrays. The images of a batch decode in lockstep: numpy makes one pixel of
each at a time, each with its own codes, cache and back-reference, so the cost of a step is shared.
Predictors are inverted along fronts of pixels that don't need each other, over all images at once.

`write_samples` stores four samples to a pixel, 16 pixels to a row, in images of at most PART bytes that
follow each other, so an image never grows with the text and a text of any length can be stored. Back-references
and the cache are used where pixels repeat. Text gains little from the transforms, so they are not left to the size
they save: a checksum of the bytes deals each image one of PROFILES, and the column holds every feature of the format.
The writer is numpy over all images of a batch: code lengths are rounded-up logarithms, shortened until the code is complete.

Defined cases: null text is the empty payload, padded to 64 zero bytes; equal texts have equal
stored bytes; a broken stream raises ValueError; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwright.session import table

ROW = 64
WIDTH = ROW // 4
PART = 8192
#: So many pixels are written, and read, at once.
WRITE_PIXELS, READ_PIXELS = 1 << 18, 1 << 21
LONGEST = 15
GREEN, CHANNEL, DISTANCE = 256 + 24, 256, 40
#: The alphabets of a group's five codes; the first grows by the cache.
SIZES = (GREEN, CHANNEL, CHANNEL, CHANNEL, DISTANCE)
#: Fixed values of the format: the order of code length codes, and the near distances (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULTIPLIER = 0x1E35A7BD
OPAQUE = 0xFF000000
PREDICTOR, CROSS, GREENS, PALETTE = range(4)
#: What a checksum deals an image: transforms, bits of the colour cache, and whether two groups of codes alternate by rows of
#: blocks. An image of more than 256 colours that is dealt a palette gets the fallback behind it.
PROFILES = (
    ((), 7, False), ((GREENS,), 7, False), ((PREDICTOR,), 5, False), ((CROSS,), 0, False),
    ((PALETTE,), 0, False), ((), 6, True), ((PREDICTOR, CROSS), 0, False), ((GREENS, PREDICTOR), 6, True),
)
FALLBACK = ((CROSS, GREENS), 7, False)
#: Blocks of all kinds have 1 << SHIFT pixels a side.
SHIFT = 4


def _reversals(bits: int) -> np.ndarray:
    x = np.arange(1 << bits)
    out = np.zeros_like(x)
    for b in range(bits):
        out |= ((x >> b) & 1) << (bits - 1 - b)
    return out


REVERSED = [_reversals(b) for b in range(LONGEST + 1)]


class Code:
    """A prefix code as one lookup table over the next `bits` bits: symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.table = 0, np.array([(int(used[0]) if len(used) else 0) << 4])
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[order]
        self.bits = int(n[-1])
        spans = 1 << (self.bits - n)
        if spans.sum() != 1 << self.bits:
            raise ValueError("the lengths are no complete prefix code")
        # Codes in canonical order tile the table read most significant bit first.
        self.table = np.repeat((order << 4 | n).astype(np.int32), spans)[REVERSED[self.bits]]

    def read(self, bits: "Bits") -> int:
        e = int(self.table[bits.peek(self.bits)])
        bits.at += e & 15
        return e >> 4


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at
        self.head = 0  # where it begins in a Pool

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return value


def read_code(bits: Bits, symbols: int) -> Code:
    lengths = np.zeros(symbols, np.int64)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    many = 4 + bits.read(4)
    packed, own = bits.read(3 * many), np.zeros(19, np.int64)
    own[list(LENGTH_ORDER[:many])] = [packed >> (3 * k) & 7 for k in range(many)]
    one = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    out, last = [], 8
    while len(out) < symbols and left:
        left -= 1
        s = one.read(bits)
        if s < 16:
            out.append(s)
            last = s or last
            continue
        n, least = ((2, 3), (3, 3), (7, 11))[s - 16]
        out += [last if s == 16 else 0] * (least + bits.read(n))
    if len(out) > symbols or bits.at > 8 * len(bits.data):
        raise ValueError("the lengths pass the alphabet or the stream")
    lengths[: len(out)] = out
    return Code(lengths)


def read_group(bits: Bits, cache: int) -> list[Code]:
    return [read_code(bits, n) for n in (GREEN + cache, CHANNEL, CHANNEL, CHANNEL, DISTANCE)]


def prefix_value(bits: Bits, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + bits.read(extra) + 1


def plane_distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def over(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def read_entropy_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """ARGB pixels of one entropy-coded image, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    chosen, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        chosen = (read_entropy_image(bits, over(width, shift), over(height, shift)) >> 8 & 0xFFFF).tolist()
    groups = [read_group(bits, 1 << cache_bits if cache_bits else 0) for _ in range(max(chosen) + 1 if chosen else 1)]
    return read_pixels(bits, width, height, groups, chosen, shift, cache_bits)


def read_pixels(bits: Bits, width: int, height: int, groups: list, chosen, shift: int, cache_bits: int) -> np.ndarray:
    total, out = width * height, []
    across = over(width, shift) if chosen else 0
    cache = [0] * (1 << cache_bits) if cache_bits else None
    cached = 0  # pixels that are in the cache so far
    group = groups[0]

    def fill():
        nonlocal cached
        for p in out[cached:]:
            cache[(p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        cached = len(out)

    while len(out) < total:
        if chosen:
            y, x = divmod(len(out), width)
            group = groups[chosen[(y >> shift) * across + (x >> shift)]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < GREEN:
            n = prefix_value(bits, s - 256)
            back = plane_distance(prefix_value(bits, group[4].read(bits)), width)
            if back > len(out) or len(out) + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out.append(out[-back])
        else:
            fill()
            out.append(cache[s - GREEN])
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def channels(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)  # blue, green, red, alpha


def guess(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What a predictor mode expects of pixels (n, 4) from their neighbours; right is the one above to the right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return (((left + right) >> 1) + top) >> 1
    if mode == 6:
        return (left + corner) >> 1
    if mode == 7:
        return (left + top) >> 1
    if mode == 8:
        return (corner + top) >> 1
    if mode == 9:
        return (top + right) >> 1
    if mode == 10:
        return (((left + corner) >> 1) + ((top + right) >> 1)) >> 1
    if mode == 11:
        to_left = np.abs(top - corner).sum(1)  # |left + top - corner - left|
        to_top = np.abs(left - corner).sum(1)
        return np.where((to_left < to_top)[:, None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = (left + top) >> 1
        off = mean - corner
        return np.clip(mean + ((off + (off < 0)) >> 1), 0, 255)
    return np.tile(np.array([0, 0, 0, 255], left.dtype), (len(left), 1))


def pixel_modes(modes: np.ndarray, width: int, height: int, shift: int) -> np.ndarray:
    """The mode of each pixel: the block's, but black for the first, left in the first row, top in the first column."""
    y, x = np.divmod(np.arange(width * height), width)
    out = (modes >> 8 & 15).astype(np.int8)[(y >> shift) * over(width, shift) + (x >> shift)]
    out[::width], out[:width], out[0] = 2, 1, 0
    return out


def invert_predictors(items: list[tuple[np.ndarray, np.ndarray, int, int, int]]) -> list[np.ndarray]:
    """Pixels of images (pixels, modes, width, height, shift) of one width. Pixels on a line x + 2 y need none of each other."""
    width, heights = items[0][2], np.array([i[3] for i in items])
    px = channels(np.concatenate([i[0].astype(np.uint32) for i in items])).astype(np.int32)
    mode = np.concatenate([pixel_modes(m, w, h, shift) for _, m, w, h, shift in items])
    heads = np.cumsum(heights) * width - heights * width
    ys = np.concatenate([np.arange(h) for h in heights])
    starts = np.repeat(heads, heights) + ys * width
    order = np.argsort(ys, kind="stable")
    ys, starts = ys[order], starts[order]
    upto = np.searchsorted(ys, np.arange(heights.max() + 1))
    for t in range(width + 2 * int(heights.max() - 1)):
        low, high = max(0, (t - width + 2) // 2), min(int(heights.max()) - 1, t // 2)
        rows = slice(upto[low], upto[high + 1])
        at = starts[rows] + t - 2 * ys[rows]
        m = mode[at]
        for k in np.unique(m).tolist():
            some = at[m == k]
            p = guess(k, *(px[np.maximum(some - back, 0)] for back in (1, width, width - 1, width + 1)))
            px[some] = (px[some] + p) & 255
    flat = np.ascontiguousarray(px.astype(np.uint8)).reshape(-1).view(np.uint32)
    return [flat[a : a + h * width] for a, h in zip(heads, heights)]


def invert_cross_colour(pixels: np.ndarray, element: np.ndarray, width: int, height: int, shift: int) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    e = channels(element)[(y >> shift) * over(width, shift) + (x >> shift)].view(np.int8).astype(np.int64)
    px = channels(pixels).copy()
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int64)
    green = signed(px[:, 1])
    red = px[:, 2] + (e[:, 0] * green >> 5)
    blue = px[:, 0] + (e[:, 1] * green >> 5) + (e[:, 2] * signed(red & 255) >> 5)
    px[:, 2], px[:, 0] = red & 255, blue & 255
    return px.reshape(-1).view(np.uint32)


def invert_subtract_green(pixels: np.ndarray) -> np.ndarray:
    px = channels(pixels).copy()
    px[:, 0] += px[:, 1]
    px[:, 2] += px[:, 1]
    return px.reshape(-1).view(np.uint32)


def invert_palette(pixels: np.ndarray, palette: np.ndarray, width: int, height: int, shift: int) -> np.ndarray:
    colours = np.zeros(256, np.uint32)
    colours[: len(palette)] = np.cumsum(channels(palette), axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)
    at = (pixels >> 8 & 255).reshape(height, -1)
    x = np.arange(width)
    per = 8 >> shift
    return colours[(at[:, x >> shift] >> ((x & ((1 << shift) - 1)) * per) & ((1 << per) - 1))].reshape(-1)


class Image:
    """A VP8L stream up to its pixel data: size, transforms and the place where pixels begin.

    Alone, it reads the transforms by itself; else they are read in lockstep with those of other images.
    """

    def __init__(self, data: bytes, alone: bool = True):
        if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
            raise ValueError("no WebP file")
        at, end = 12, 8 + struct.unpack("<I", data[4:8])[0]
        while at + 8 <= min(end, len(data)) and data[at : at + 4] != b"VP8L":
            at += 8 + (struct.unpack("<I", data[at + 4 : at + 8])[0] + 1 & ~1)
        if data[at : at + 4] != b"VP8L":
            raise ValueError("no lossless image")
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        self.bits = bits = Bits(data[at + 8 : at + 8 + size])
        if bits.read(8) != 0x2F:
            raise ValueError("no lossless signature")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        self.coded_width, self.transforms = self.width, []
        if alone:
            steps = self.sub_images()
            size = next(steps, None)
            while size:
                try:
                    size = steps.send(read_entropy_image(bits, *size))
                except StopIteration:
                    break

    def sub_images(self) -> Generator[tuple[int, int], np.ndarray, None]:
        """Reads the transforms; yields the width and height of each sub-image and is sent its pixels."""
        bits = self.bits
        while bits.read(1):
            kind, width = bits.read(2), self.coded_width
            if any(kind == t[0] for t in self.transforms):
                raise ValueError("a transform comes twice")
            if kind < 2:
                shift = bits.read(3) + 2
                self.transforms.append((kind, width, shift, (yield over(width, shift), over(self.height, shift))))
            elif kind == 2:
                self.transforms.append((kind, width, 0, None))
            else:
                n = bits.read(8) + 1
                palette = yield n, 1
                shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.transforms.append((kind, width, shift, palette))
                self.coded_width = over(width, shift)


def inverted(images: list[Image], pixels: list[np.ndarray]) -> list[np.ndarray]:
    """(height, width) pixels of each image: its transforms undone from the last to the first."""
    pixels = list(pixels)
    for depth in range(4, 0, -1):
        predicted: dict[int, list[int]] = {}
        for k, image in enumerate(images):
            if len(image.transforms) < depth:
                continue
            kind, width, shift, part = image.transforms[depth - 1]
            if kind == PREDICTOR:
                predicted.setdefault(width, []).append(k)
            elif kind == CROSS:
                pixels[k] = invert_cross_colour(pixels[k], part, width, image.height, shift)
            elif kind == GREENS:
                pixels[k] = invert_subtract_green(pixels[k])
            else:
                pixels[k] = invert_palette(pixels[k], part, width, image.height, shift)
        for width, some in predicted.items():
            done = invert_predictors([(pixels[k], images[k].transforms[depth - 1][3], width, images[k].height, images[k].transforms[depth - 1][2]) for k in some])
            for k, p in zip(some, done):
                pixels[k] = p
    return [p.reshape(i.height, i.width) for i, p in zip(images, pixels)]


def decode(data: bytes) -> np.ndarray:
    """(height, width) ARGB pixels of a lossless WebP file."""
    return decode_many([data])[0]


def decode_many(files: list[bytes], seen: Counter | None = None) -> list[np.ndarray]:
    """The pixels of each file, decoded in lockstep; seen counts the features that they use."""
    try:
        images = [Image(data, alone=False) for data in files]
        out: list[np.ndarray] = []
        for some in batches([i.width * i.height for i in images], READ_PIXELS):
            pool = Pool([i.bits for i in images[some]])
            read_transforms(pool, images[some])
            out += inverted(images[some], entropy_images(pool, [(i.bits, i.coded_width, i.height) for i in images[some]], True, seen))
    except (IndexError, struct.error, OverflowError) as e:
        raise ValueError("the stream is broken") from e
    if seen is not None:
        seen.update(kind for i in images for kind, *_ in i.transforms)
    return out


def batches(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of what is worked on at once: so many pixels, or one image of more."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total + n > most and k > start:
            yield slice(start, k)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


class Pool:
    """The streams of a batch as one array of words, for reads from many at once; places count bits from the first stream's begin."""

    def __init__(self, streams: list[Bits]):
        at = 0
        for b in streams:
            b.head = 8 * at
            at += len(b.data) + 8
        flat = np.frombuffer(b"".join(b.data + bytes(8) for b in streams), np.uint8).astype(np.uint32)
        self.words = flat[:-3] | flat[1:-2] << np.uint32(8) | flat[2:-1] << np.uint32(16) | flat[3:] << np.uint32(24)
        self.last = len(self.words) - 1

    def peek(self, at: np.ndarray) -> np.ndarray:
        """25 bits or more from each place."""
        return self.words[np.minimum(at >> 3, self.last)] >> (at & 7).astype(np.uint32)


def read_transforms(pool: Pool, images: list[Image]) -> None:
    """The transforms of all images; a round reads the next sub-image of each that has one left."""
    wanted = [(i, steps, size) for i in images if (size := next(steps := i.sub_images(), None))]
    while wanted:
        parts = entropy_images(pool, [(i.bits, *size) for i, _, size in wanted], False)
        more = []
        for (image, steps, _), part in zip(wanted, parts):
            try:
                more.append((image, steps, steps.send(part)))
            except StopIteration:
                pass
        wanted = more


def entropy_images(pool: Pool, wanted: list[tuple[Bits, int, int]], main: bool, seen: Counter | None = None) -> list[np.ndarray]:
    """ARGB pixels of the images (stream, width, height) that come next in different streams, which move on behind them."""
    cache_bits = np.array([b.read(4) if b.read(1) else 0 for b, _, _ in wanted])
    if (cache_bits > 11).any():
        raise ValueError("the colour cache is too large")
    shift = np.array([b.read(3) + 2 if main and b.read(1) else 0 for b, _, _ in wanted])
    grouped = np.flatnonzero(shift)
    groups, chosen = np.ones(len(wanted), np.int64), []
    if len(grouped):
        blocks = [(wanted[k][0], over(wanted[k][1], int(shift[k])), over(wanted[k][2], int(shift[k]))) for k in grouped]
        chosen = [(p >> 8 & 0xFFFF).astype(np.int64) for p in entropy_images(pool, blocks, False)]
        groups[grouped] = [int(c.max()) + 1 for c in chosen]
    bit = np.array([b.head + b.at for b, _, _ in wanted], np.int64)
    ends = np.array([b.head + 8 * len(b.data) for b, _, _ in wanted], np.int64)
    codes = read_codes(pool, bit, ends, groups, np.where(cache_bits > 0, 1 << cache_bits, 0))
    width, height = (np.array([w[k] for w in wanted]) for k in (1, 2))
    out = lockstep(pool, bit, codes, width, width * height, cache_bits, groups, dict(zip(grouped.tolist(), chosen)), shift, seen)
    if (bit > ends).any():
        raise ValueError("the stream ends early")
    for (b, _, _), at in zip(wanted, bit.tolist()):
        b.at = at - b.head
    return out


def code_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each row's prefix code, and the rows' lookup tables (symbol << 4 | length) one after the other."""
    row, symbol = np.nonzero(lengths)
    used = np.bincount(row, minlength=len(lengths))
    bits = np.where(used > 1, lengths.max(1), 0).astype(np.int64)
    n = np.where(used[row] > 1, lengths[row, symbol], 0).astype(np.int64)
    none = np.flatnonzero(used == 0)
    row, symbol, n = np.append(row, none), np.append(symbol, np.zeros_like(none)), np.append(n, np.zeros_like(none))
    order = np.argsort(row << 4 | n, kind="stable")
    row, symbol, n = row[order], symbol[order], n[order]
    spans, sizes = 1 << (bits[row] - n), 1 << bits
    if (np.bincount(row, spans, len(lengths)) != sizes).any():
        raise ValueError("the lengths are no complete prefix code")
    canonical = np.repeat((symbol << 4 | n).astype(np.int32), spans)
    # Codes in canonical order tile the table read most significant bit first.
    out = np.empty_like(canonical)
    head = np.cumsum(sizes) - sizes
    for b in np.unique(bits).tolist():
        some = head[bits == b][:, None]
        out[some + np.arange(1 << b)] = canonical[some + REVERSED[b]]
    return bits, out


#: What the lengths 16, 17 and 18 repeat: bits that say how often, and the least number.
REPEAT_BITS, REPEAT_LEAST = np.array([2, 3, 7]), np.array([3, 3, 11])


def read_lengths(pool: Pool, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Code lengths of the code that comes next at each place, over an alphabet of so many symbols; the places move behind it."""
    lengths = np.zeros((len(at), int(symbols.max())), np.int8)

    def take(some: np.ndarray, n) -> np.ndarray:
        value = pool.peek(at[some]).astype(np.int64) & ((1 << n) - 1)
        at[some] += n
        return value

    simple = take(np.arange(len(at)), 1) > 0
    some = np.flatnonzero(simple)
    two, wide = take(some, 1), take(some, 1)
    lengths[some, take(some, np.where(wide > 0, 8, 1))] = 1
    some = some[two > 0]
    lengths[some, take(some, 8)] = 1
    row = np.flatnonzero(~simple)
    if not len(row):
        return lengths
    many = 4 + take(row, 4)
    own = np.zeros((len(row), 19), np.int8)
    for k, s in enumerate(LENGTH_ORDER):
        some = np.flatnonzero(many > k)
        own[some, s] = take(row[some], 3)
    bits, table = code_tables(own)
    head, mask = np.cumsum(1 << bits) - (1 << bits), ((1 << bits) - 1).astype(np.uint32)
    left = symbols[row]
    some = np.flatnonzero(take(row, 1))
    left[some] = 2 + take(row[some], 2 + 2 * take(row[some], 3))
    # One length of each row at a time; rows that have all of theirs go.
    most, here = symbols[row], at[row]
    place, last = np.zeros(len(row), np.int64), np.full(len(row), 8)
    while len(row):
        entry = table[head + (pool.peek(here) & mask)]
        here += entry & 15
        v = entry >> 4
        plain = v < 16
        lengths[row, place] = np.where(plain, v, 0)
        some = np.flatnonzero(~plain)
        if len(some):
            kind = v[some] - 16
            n = REPEAT_BITS[kind]
            times = REPEAT_LEAST[kind] + (pool.peek(here[some]).astype(np.int64) & ((1 << n) - 1))
            here[some] += n
            if (place[some] + times > most[some]).any():
                raise ValueError("the lengths pass the alphabet")
            again = kind == 0
            for k in range(int(times[again].max(initial=0))):
                r = some[again & (times > k)]
                lengths[row[r], place[r] + k] = last[r]
            place[some] += times - 1
        place += 1
        left -= 1
        last = np.where(plain & (v > 0), v, last)
        going = (place < most) & (left > 0)
        if not going.all():
            done = ~going
            at[row[done]] = here[done]
            row, here, head, mask, most, place, last, left = (x[going] for x in (row, here, head, mask, most, place, last, left))
    return lengths


def read_codes(pool: Pool, bit: np.ndarray, ends: np.ndarray, groups: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of each lane's groups: where each has its table (groups, 5), masks, and the tables. bit moves behind them."""
    group_at = np.cumsum(groups) - groups
    base, mask = np.zeros((int(groups.sum()), 5), np.int64), np.zeros((int(groups.sum()), 5), np.uint32)
    tables, size = [], 0
    for k in range(int(groups.max())):
        some = np.flatnonzero(groups > k)
        g = group_at[some] + k
        for code, fixed in enumerate(SIZES):
            at = bit[some]
            bits, table = code_tables(read_lengths(pool, at, fixed + cached[some] if code == 0 else np.full(len(some), fixed)))
            bit[some] = at
            if (at > ends[some]).any():
                raise ValueError("the stream ends early")
            spans = 1 << bits
            base[g, code], mask[g, code] = size + np.cumsum(spans) - spans, spans - 1
            tables.append(table)
            size += len(table)
    return base, mask, np.concatenate(tables)


#: The distance of each near code as (x, y), from code 1 on.
NEAR_X, NEAR_Y = np.array([(0, 0), *NEAR]).T


def lockstep(pool: Pool, bits: np.ndarray, codes: tuple, width: np.ndarray, sizes: np.ndarray, cache_bits: np.ndarray, groups: np.ndarray,
             blocks: dict[int, np.ndarray], shift: np.ndarray, seen: Counter | None = None) -> list[np.ndarray]:
    """ARGB pixels of each lane. A step makes one pixel in every lane that has pixels left. bits moves behind the pixels."""
    base, mask, tables = codes
    order = np.argsort(-sizes, kind="stable")
    width, sizes, cache_bits, shift, bit, lanes = (x[order] for x in (width, sizes, cache_bits, shift, bits, np.cumsum(groups) - groups))
    peek, group_at = pool.peek, lanes
    grouped = np.flatnonzero(shift)
    chosen = [blocks[int(order[k])] for k in grouped]
    chosen_at = np.cumsum([0] + [len(c) for c in chosen])[:-1]
    chosen = np.concatenate(chosen or [np.zeros(0, np.int64)])
    g_shift = shift[grouped]
    g_across = (width[grouped] + (1 << g_shift) - 1) >> g_shift
    cache_at = np.cumsum(np.where(cache_bits > 0, 1 << cache_bits, 0)) - np.where(cache_bits > 0, 1 << cache_bits, 0)
    cache = np.zeros(int(np.where(cache_bits > 0, 1 << cache_bits, 0).sum()), np.uint32)
    cached = np.flatnonzero(cache_bits)
    first = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint32)
    left, back, group = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64), group_at.copy()

    def symbols(some: np.ndarray, code: int) -> np.ndarray:
        g = group[some]
        entry = tables[base[g, code] + (peek(bit[some]) & mask[g, code])]
        bit[some] += entry & 15
        return entry >> 4

    def values(some: np.ndarray, s: np.ndarray) -> np.ndarray:
        extra = np.maximum(s - 2, 0) >> 1
        more = (peek(bit[some]) & ((np.uint32(1) << extra.astype(np.uint32)) - np.uint32(1))).astype(np.int64)
        bit[some] += np.where(s < 4, 0, extra)
        return np.where(s < 4, s + 1, ((2 + (s & 1)) << extra) + more + 1)

    copies = hits = 0
    for p in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -p, "left"))  # sizes above p
        if len(grouped):
            some = grouped[: np.searchsorted(grouped, live)]
            y, x = np.divmod(p, width[some])
            n = len(some)
            group[some] = group_at[some] + chosen[chosen_at[:n] + (y >> g_shift[:n]) * g_across[:n] + (x >> g_shift[:n])]
        reading = np.flatnonzero(left[:live] == 0)
        s = symbols(reading, 0)
        literal = s < 256
        some = reading[literal]
        if len(some):
            green = s[literal]
            red, blue, alpha = (symbols(some, c).astype(np.uint32) for c in (1, 2, 3))
            out[first[some] + p] = alpha << np.uint32(24) | red << np.uint32(16) | green.astype(np.uint32) << np.uint32(8) | blue
        if len(some) < len(reading):
            known = s >= GREEN
            some = reading[known]
            if len(some):
                out[first[some] + p] = cache[cache_at[some] + s[known] - GREEN]
                hits += len(some)
            away = ~literal & ~known
            some = reading[away]
            if len(some):
                left[some] = values(some, s[away] - 256)
                code = values(some, symbols(some, 4))
                near = np.minimum(code, len(NEAR))
                back[some] = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, NEAR_X[near] + NEAR_Y[near] * width[some]))
                if (back[some] > p).any() or (left[some] + p > sizes[some]).any():
                    raise ValueError("a back-reference leaves the image")
                copies += len(some)
        some = np.flatnonzero(left[:live])
        if len(some):
            out[first[some] + p] = out[first[some] + p - back[some]]
            left[some] -= 1
        some = cached[: np.searchsorted(cached, live)]
        if len(some):
            made = out[first[some] + p]
            cache[cache_at[some] + (made * np.uint32(CACHE_MULTIPLIER) >> (32 - cache_bits[some]).astype(np.uint32))] = made
    bits[order] = bit
    if seen is not None:
        seen.update({"copies": copies, "hits": hits, "groups": len(grouped)})
    got = [out[a : a + n] for a, n in zip(first, sizes)]
    return [got[k] for k in np.argsort(order, kind="stable")]


def complete_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code for each row of counts, 0 for rows of one symbol or none; a row's sum is 1 << LONGEST at most.

    Rounded-up logarithms of the shares leave room; it is filled by shortening codes, the shorter ones first, while they fit.
    """
    lengths = np.zeros(counts.shape, np.int8)
    row, symbol = np.nonzero(counts)
    some = np.bincount(row, minlength=len(counts))[row] > 1
    row, symbol = row[some], symbol[some]
    if not len(row):
        return lengths
    c = counts[row, symbol].astype(float)
    total = np.bincount(row, c)
    if total.max() > 1 << LONGEST:
        raise ValueError("too many symbols for codes of so few bits")
    n = np.maximum(np.ceil(np.log2(total[row]) - np.log2(c) - 1e-9), 1).astype(np.int64)
    order = np.argsort(row << 4 | n, kind="stable")
    row, symbol, n = row[order], symbol[order], n[order]
    new = np.append(True, row[1:] != row[:-1])
    index, first = np.cumsum(new) - 1, np.flatnonzero(new)
    rank = np.arange(len(row)) - first[index]
    ranked = np.full((int(rank.max()) + 1, len(first)), 99)  # by rank and row: each row's lengths from the shortest on
    ranked[rank, index] = n
    room = (1 << LONGEST) - np.bincount(index, 1 << (LONGEST - n)).astype(np.int64)
    while (room > 0).any():
        for v in ranked[: int((ranked[:, room > 0] < 99).sum(0).max())]:
            gain = 1 << np.maximum(LONGEST - v, 0)
            fits = np.flatnonzero((v > 1) & (v < 99) & (gain <= room))
            v[fits] -= 1
            room[fits] -= gain[fits]
    lengths[row, symbol] = ranked[rank, index]
    return lengths


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of each row, bit-reversed as they are written."""
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol].astype(np.int64)
    order = np.argsort(row << 4 | n, kind="stable")
    row, symbol = row[order], symbol[order]
    spans = 1 << (LONGEST - n[order])
    before = np.cumsum(spans) - spans
    new = np.append(True, row[1:] != row[:-1])[: len(row)]
    out = np.zeros(lengths.shape, np.int16)
    out[row, symbol] = REVERSED[LONGEST][before - before[new][np.cumsum(new) - 1]]
    return out


class Tokens:
    """Numbers of up to 33 bits, each with its file and segment; segments follow each other in their order."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def put(self, file, segment, value, bits) -> None:
        file, segment, value, bits = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, np.int64)) for v in (file, segment, value, bits)))
        some = bits > 0
        self.parts.append((file[some] * 16 + segment[some], value[some], bits[some]))

    def streams(self, files: int) -> list[bytes]:
        key, value, bits = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        file, value, bits = key[order] >> 4, value[order], bits[order]
        ends = np.cumsum(bits)
        total = np.bincount(file, bits, files).astype(np.int64)
        size = (total + 7) // 8
        heads = np.cumsum(size) - size
        at = ends - bits - (np.cumsum(total) - total)[file] + 8 * heads[file]
        moved = value.astype(np.uint64) << (at & 31).astype(np.uint64)
        words = int(size.sum()) // 4 + 3
        packed = np.bincount(at >> 5, (moved & np.uint64(0xFFFFFFFF)).astype(float), words) + np.bincount((at >> 5) + 1, (moved >> np.uint64(32)).astype(float), words)
        raw = packed.astype(np.uint32).tobytes()
        return [raw[a : a + n] for a, n in zip(heads.tolist(), size.tolist())]


#: The writer's code for code lengths: four bits, five for these rare ones, none for repeats of a length.
RARE = (1, 13, 14, 15)
LENGTH_BITS = np.array([[0 if s == 16 else 5 if s in RARE else 4 for s in range(19)]])
LENGTH_WORDS = code_words(LENGTH_BITS)[0].astype(np.int64)
LENGTH_BITS = LENGTH_BITS[0]
LENGTHS_HEAD = sum(int(LENGTH_BITS[s]) << (3 * k) for k, s in enumerate(LENGTH_ORDER))


def put_codes(out: Tokens, file: np.ndarray, segment: np.ndarray, lengths: np.ndarray, only: np.ndarray) -> None:
    """A prefix code for each row, rows in the order they are written; only is the symbol of a row without lengths.

    A lone symbol of more than 8 bits (a copy or a cached colour, in a group without literals) has no simple code: it gets one length, and still no bits.
    """
    far = np.flatnonzero(~lengths.any(1) & (only > 255))
    if len(far):
        lengths = lengths.copy()
        lengths[far, only[far]] = 1
    used = lengths.any(1)
    # A segment's rows are written one after the other: their tokens are put in that order by row and place.
    single = np.flatnonzero(~used)
    wide = only[single] > 1
    parts = [(single, np.zeros(len(single), np.int64), 1 | wide << 2 | only[single] << 3, np.where(wide, 11, 4))]
    rows = np.flatnonzero(used)
    row, place = np.nonzero(lengths)
    gap = place - np.where(np.append(True, row[1:] != row[:-1]), -1, np.append(-1, place[:-1])) - 1
    full, rest = np.divmod(gap, 138)
    few = rest < 3
    many = np.where(few, rest, 1) + full + 1
    count = np.bincount(row, many, len(lengths)).astype(np.int64)[rows]
    half = (1 << 31) - 1
    head = 15 << 1 | LENGTHS_HEAD << 5  # length-coded, all 19 lengths
    for k, (value, bits) in enumerate(((head & half, 31), (head >> 31, 31), (1 | 4 << 1 | (count - 2) << 4, 14))):
        parts.append((rows, np.full(len(rows), k), value, bits))
    word, n = LENGTH_WORDS, LENGTH_BITS
    value, bits = np.zeros(len(gap), np.int64), np.zeros(len(gap), np.int64)
    for k in range(int(full.max(initial=0))):
        more = full > k
        value |= np.where(more, (word[18] | 127 << n[18]) << bits, 0)
        bits += np.where(more, n[18] + 7, 0)
    short, long = ~few & (rest < 11), rest >= 11
    tail = np.where(short, word[17] | rest - 3 << n[17], np.where(long, word[18] | rest - 11 << n[18], word[0] | word[0] << n[0] & np.where(rest == 2, -1, 0)))
    value |= np.where(rest > 0, tail, 0) << bits
    bits += np.where(short, n[17] + 3, np.where(long, n[18] + 7, rest * n[0]))
    parts.append((row, 3 + 2 * place, value, bits))
    v = lengths[row, place]
    parts.append((row, 4 + 2 * place, word[v], n[v]))
    row, place, value, bits = (np.concatenate([np.broadcast_to(np.asarray(p[k], np.int64), p[0].shape) for p in parts]) for k in range(4))
    order = np.lexsort((place, row))
    out.put(file[row[order]], segment[row[order]], value[order], bits[order])


def prefix_coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number for values from 1 on."""
    d = np.maximum(values - 1, 1)
    high = np.frexp(d.astype(float))[1].astype(np.int64) - 1
    low = np.maximum(high - 1, 0)
    small = values <= 4
    return np.where(small, values - 1, 2 * high + (d >> low & 1)), np.where(small, 0, d & ((1 << low) - 1)), np.where(small, 0, low)


def previous(key: np.ndarray) -> np.ndarray:
    """The last place before each with the same key, or -1."""
    out = np.full(len(key), -1)
    if not len(key):
        return out
    order = np.argsort(key, kind="stable")
    same = np.append(False, key[order][1:] == key[order][:-1])
    out[order[same]] = order[np.flatnonzero(same) - 1]
    return out


def copied(px: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of back-references: runs whose pairs of pixels last stood at one distance."""
    if len(px) < 2:
        return (np.zeros(0, np.int64),) * 3
    pair = px[:-1].astype(np.uint64) << np.uint64(32) | px[1:]
    key = (pair * np.uint64(0x9E3779B97F4A7C15) ^ image[:-1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
    key[image[1:] != image[:-1]] = np.arange(int((image[1:] != image[:-1]).sum()), dtype=np.uint64)
    before = previous(key)
    here = np.arange(len(pair))
    valid = (before >= 0) & (image[np.maximum(before, 0)] == image[:-1]) & (pair[np.maximum(before, 0)] == pair) & (image[1:] == image[:-1])
    distance = np.where(valid, here - before, 0)
    begins = valid & (np.append(0, distance[:-1]) != distance)
    ends = valid & (np.append(distance[1:], 0) != distance)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    start = start + np.append(False, end[:-1] == start[1:] - 1)  # the run before covers a pixel more
    length = end + 2 - start
    some = length >= 2
    return start[some], length[some], distance[start[some]] if some.any() else np.zeros(0, np.int64)


def put_entropy_images(out: Tokens, items: list[tuple[int, int, np.ndarray, int, int, bool, np.ndarray | None]]) -> None:
    """Images (file, segment, pixels, width, cache bits, references, group of each pixel): their codes and pixels."""
    sizes = np.array([len(i[2]) for i in items])
    image = np.repeat(np.arange(len(items)), sizes)
    px = np.concatenate([i[2] for i in items]).astype(np.uint32)
    file, segment, width = (np.array([i[k] for i in items]) for k in (0, 1, 3))
    cache_bits, refers = np.array([i[4] for i in items]), np.array([i[5] for i in items])
    groups = np.array([1 if i[6] is None else int(i[6].max()) + 1 for i in items])
    group_at = np.cumsum(groups) - groups
    group = np.repeat(group_at, sizes)
    ends = np.cumsum(sizes)
    for k, i in enumerate(items):
        if i[6] is not None:
            group[ends[k] - sizes[k] : ends[k]] += i[6]
    # What each pixel is: 0 literal, 1 from the cache, 2 the start of a copy, 3 within one.
    kind = np.zeros(len(px), np.int8)
    start, length, distance = copied(np.where(refers[image], px, np.arange(len(px)).astype(np.uint32)), image)
    inside = np.zeros(len(px) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, start + length, -1)
    kind[np.cumsum(inside)[:-1] > 0] = 3
    kind[start] = 2
    some = np.flatnonzero(cache_bits[image] > 0)
    slot = np.zeros(len(px), np.int64)
    slot[some] = px[some] * np.uint32(CACHE_MULTIPLIER) >> (32 - cache_bits[image[some]]).astype(np.uint32)
    before = previous(image[some] << 11 | slot[some])
    again = before >= 0
    hit = some[again][px[some[before[again]]] == px[some[again]]]
    kind[hit[kind[hit] == 0]] = 1
    literal, known = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    near = np.full(8 * int(width.max()) + 9, 0)
    coded = distance + len(NEAR)
    for w in np.unique(width).tolist():
        near[:] = 0
        for code in range(len(NEAR), 0, -1):
            near[max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * w)] = code
        mine = (width[image[start]] == w) & (distance < len(near))
        short = near[np.minimum(distance, len(near) - 1)]
        coded = np.where(mine & (short > 0), short, coded)
    size_s, size_x, size_n = prefix_coded(length)
    back_s, back_x, back_n = prefix_coded(coded)
    c = channels(px).astype(np.int64)
    columns = GREEN + (1 << int(cache_bits.max()) if cache_bits.max() else 0)
    wheres = (literal, literal, literal, literal, start, known, start)
    codes = (0, 1, 2, 3, 4, 0, 0)
    symbols = (c[literal, 1], c[literal, 2], c[literal, 0], c[literal, 3], back_s, GREEN + slot[known], 256 + size_s)
    at = np.concatenate([(group[w] * 5 + k) * columns + x for w, k, x in zip(wheres, codes, symbols)])
    counts = np.bincount(at, minlength=int(groups.sum()) * 5 * columns).reshape(-1, 5, columns)
    flat = counts.reshape(-1, columns)
    lengths = complete_lengths(flat)
    words = code_words(lengths)
    lengths3, words = lengths.reshape(counts.shape), words.reshape(counts.shape)
    owner = np.repeat(np.repeat(np.arange(len(items)), groups), 5)
    put_codes(out, file[owner], segment[owner], lengths, flat.argmax(1))
    word = lambda code, g, s: (words[g, code, s].astype(np.int64), lengths3[g, code, s].astype(np.int64))
    # Two tokens a pixel, each of two numbers.
    values, bits = np.zeros((len(px), 2), np.int64), np.zeros((len(px), 2), np.int64)

    def both(where: np.ndarray, token: int, a: tuple, b: tuple) -> None:
        values[where, token], bits[where, token] = a[0] | b[0] << a[1], a[1] + b[1]

    g = group[literal]
    both(literal, 0, word(0, g, c[literal, 1]), word(1, g, c[literal, 2]))
    both(literal, 1, word(2, g, c[literal, 0]), word(3, g, c[literal, 3]))
    both(known, 0, word(0, group[known], GREEN + slot[known]), (np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)))
    both(start, 0, word(0, group[start], 256 + size_s), (size_x, size_n))
    both(start, 1, word(4, group[start], back_s), (back_x, back_n))
    out.put(np.repeat(file[image], 2), np.repeat(segment[image], 2), values.reshape(-1), bits.reshape(-1))


def blocks_of(width: int, heights: np.ndarray) -> np.ndarray:
    """The block of each pixel of images that follow each other, numbered through."""
    n = over(width, SHIFT) * over(heights, SHIFT)
    y = np.concatenate([np.arange(h) for h in heights])
    rows = np.repeat(np.cumsum(n) - n, heights) + (y >> SHIFT) * over(width, SHIFT)
    return (rows[:, None] + (np.arange(width) >> SHIFT)).reshape(-1)


def forward_predictor(px: np.ndarray, width: int, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of images that follow each other and the mode of each block, of all modes the one that leaves the least."""
    c = channels(px).astype(np.int32)
    at, block = np.arange(len(px)), blocks_of(width, heights)
    near = [c[np.maximum(at - k, 0)] for k in (1, width, width - 1, width + 1)]
    tops = np.cumsum(heights * width) - heights * width
    inner = at % width > 0  # edges have modes of their own, and what stands before them is another image's
    inner[(tops[:, None] + np.arange(width)).reshape(-1)] = False
    costs = []
    for mode in range(14):
        off = (c - guess(mode, *near)) & 255
        costs.append(np.bincount(block, np.minimum(off, 256 - off).sum(1) * inner))
    modes = (np.array(costs).argmin(0) << 8 | OPAQUE).astype(np.uint32)
    many = over(width, SHIFT) * over(heights, SHIFT)
    mode = np.concatenate([pixel_modes(m, width, h, SHIFT) for m, h in zip(np.split(modes, np.cumsum(many)[:-1]), heights.tolist())])
    for k in np.unique(mode).tolist():
        some = np.flatnonzero(mode == k)
        c[some] -= guess(k, *(n[some] for n in near))
    return np.ascontiguousarray((c & 255).astype(np.uint8)).reshape(-1).view(np.uint32), modes


#: Elements (green to red, green to blue, red to blue) that the writer tries on each block.
CROSS_TRIED = ((0, 0, 0), (8, 8, 0), (-8, 4, 8), (4, -8, 16))


def forward_cross(px: np.ndarray, width: int, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels less what green and red foretell, and the element of each block, of CROSS_TRIED the one that leaves the least beside none."""
    c = channels(px).view(np.int8).astype(np.int32)
    block = blocks_of(width, heights)
    made = []
    for to_red, to_blue, red_to_blue in CROSS_TRIED:
        red = c[:, 2] - (to_red * c[:, 1] >> 5)
        blue = c[:, 0] - (to_blue * c[:, 1] >> 5) - (red_to_blue * c[:, 2] >> 5)
        made.append((red & 255, blue & 255))
    cost = np.array([np.bincount(block, np.minimum(r, 256 - r) + np.minimum(b, 256 - b)) for r, b in made[1:]])
    best = 1 + cost.argmin(0)
    elements = np.array([OPAQUE | (b & 255) << 16 | (a & 255) << 8 | r & 255 for r, a, b in CROSS_TRIED], np.uint32)[best]
    which, at = best[block], np.arange(len(px))
    red, blue = np.array([m[0] for m in made])[which, at], np.array([m[1] for m in made])[which, at]
    return (px & np.uint32(0xFF00FF00) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)), elements


def forward_greens(px: np.ndarray) -> np.ndarray:
    c = channels(px).copy()
    c[:, 0] -= c[:, 1]
    c[:, 2] -= c[:, 1]
    return c.reshape(-1).view(np.uint32)


def forward_palette(px: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Packed indices, the palette as differences, and the width they are packed to."""
    colours, index = np.unique(px, return_inverse=True)
    c = channels(colours)
    delta = (c - np.concatenate([np.zeros((1, 4), np.uint8), c[:-1]])).reshape(-1).view(np.uint32)
    n = len(colours)
    shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    across = over(width, shift)
    grid = np.zeros((len(px) // width, across << shift), np.int64)
    grid[:, :width] = index.reshape(-1, width)
    packed = (grid.reshape(-1, across, 1 << shift) << np.arange(1 << shift) * (8 >> shift)).sum(2)
    return (packed.reshape(-1) << 8 | OPAQUE).astype(np.uint32), delta, across


def riff(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def write_images(images: list[np.ndarray], width: int = WIDTH, profiles: list[int] | None = None) -> list[bytes]:
    """A lossless WebP file for each array of ARGB pixels, in the profile that its checksum deals it."""
    out, items, dealt = Tokens(), [], {}
    for f, px in enumerate(images):
        profile = PROFILES[zlib.crc32(px.tobytes()) % len(PROFILES) if profiles is None else profiles[f]]
        if profile[0] == (PALETTE,) and len(np.unique(px)) > 256:
            profile = FALLBACK
        dealt.setdefault(profile, []).append(f)
    for (transforms, cache, alternate), files in dealt.items():
        f = np.array(files)
        heights = np.array([len(images[k]) // width for k in files])
        out.put(f, 0, 0x2F | (width - 1) << 8, 22)
        out.put(f, 0, heights - 1 | 1 << 14, 18)  # alpha is used, version 0
        px, coded, segment = np.concatenate([images[k] for k in files]), np.full(len(files), width), 1
        pixels = None
        for kind in transforms:
            out.put(f, segment, 1 | kind << 1, 3)
            if kind == GREENS:
                px = forward_greens(px)
            elif kind == PALETTE:
                pixels, parts, coded = zip(*(forward_palette(images[k], width) for k in files))
                out.put(f, segment, np.array([len(p) - 1 for p in parts]), 8)
                out.put(f, segment, 0, 1)  # no cache
                items += [(k, segment + 1, p, len(p), 0, False, None) for k, p in zip(files, parts)]
            else:
                px, part = (forward_predictor if kind == PREDICTOR else forward_cross)(px, width, heights)
                out.put(f, segment, SHIFT - 2, 4)  # and no cache
                across = over(width, SHIFT)
                parts = np.split(part, np.cumsum(across * over(heights, SHIFT))[:-1])
                items += [(k, segment + 1, p, across, 0, False, None) for k, p in zip(files, parts)]
            segment += 2
        out.put(f, segment, 0, 1)  # no more transforms
        out.put(f, segment, 1 | cache << 1 if cache else 0, 5 if cache else 1)
        out.put(f, segment, alternate, 1)
        if alternate:
            out.put(f, segment, SHIFT - 2, 4)  # and no cache
        pixels = np.split(px, np.cumsum(heights * width)[:-1]) if pixels is None else pixels
        for k, p, h, w in zip(files, pixels, heights.tolist(), coded):
            group = None
            if alternate:
                group = np.repeat(np.arange(h) >> SHIFT & 1, int(w))
                blocks = np.repeat(np.arange(over(h, SHIFT)) & 1, over(int(w), SHIFT))
                items.append((k, segment + 1, (blocks << 8 | OPAQUE).astype(np.uint32), over(int(w), SHIFT), 0, False, None))
            items.append((k, segment + 2, p, int(w), cache, True, group))
    put_entropy_images(out, items)
    return [riff(s) for s in out.streams(len(images))]


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def pixels_of(samples: bytes) -> np.ndarray:
    """Four samples a pixel: blue, green, red and alpha."""
    return np.frombuffer(samples, "<u4")


def samples_of(pixels: np.ndarray) -> np.ndarray:
    return channels(pixels).reshape(-1)


def write_samples(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload: files of at most PART bytes of samples that follow each other."""
    parts = [pixels_of(p[k : k + PART]) for p in payloads for k in range(0, len(p), PART)]
    files = iter([f for some in batches([len(p) for p in parts], WRITE_PIXELS) for f in write_images(parts[some])])
    return [b"".join(next(files) for _ in range(0, len(p), PART)) for p in payloads]


def split_files(stored: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(stored):
        n = 8 + struct.unpack("<I", stored[at + 4 : at + 8])[0]
        out.append(stored[at : at + n])
        at += n
    return out


def read_samples(stored: list[bytes], seen: Counter | None = None) -> list[np.ndarray]:
    """The samples of each stored column value (files that follow each other)."""
    files = [split_files(s) for s in stored]
    pixels = iter(decode_many([f for fs in files for f in fs], seen))
    return [np.concatenate([samples_of(next(pixels)) for _ in fs]) for fs in files]


def feature(samples: np.ndarray) -> str:
    """Number of distinct samples, mean, variance, and the commonest sample, from the pixels read back."""
    counts = np.bincount(samples, minlength=256)
    mean = int(samples.sum(dtype=np.int64)) / len(samples)
    square = int((counts * np.arange(256) ** 2).sum()) / len(samples)
    return f"distinct={int((counts > 0).sum())};mean={mean:.4f};var={square - mean * mean:.4f};top={int(counts.argmax())}"


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read it back and describe what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, texts, size = [], [], [], 0

            def flush():
                nonlocal ids, texts, size
                payloads = [payload_of(t) for t in texts]
                stored = write_samples(payloads)
                for id_, t, media, got in zip(ids, texts, stored, read_samples(stored)):
                    raw = got.tobytes()
                    rows.append((id_, len((t or "").encode("utf-8", "surrogatepass")), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-ROW:]),
                                 len(media), hashlib.sha256(media).hexdigest(), feature(got)))
                ids, texts, size = [], [], 0

            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(id_)
                texts.append(text)
                size += len(text or "") // 4 + WIDTH
                if size >= READ_PIXELS:
                    flush()
            if ids:
                flush()
            kinds = [c.split() for c in MEDIA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if kind == "long" else pa.string()) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, MEDIA)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
