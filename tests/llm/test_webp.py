import base64
import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest
from conftest_llm import SMALL, documents

from docwright.llm import webp as W


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman lengths of at most W.LONGEST bits; counts are flattened until they fit."""
    lengths = np.zeros(len(counts), np.int64)
    counts = counts.copy()
    while True:
        used = np.flatnonzero(counts)
        heap = [(int(counts[s]), int(s), (int(s),)) for s in used]
        if len(heap) == 1:
            lengths[used] = 1
            return lengths
        heapq.heapify(heap)
        depth = dict.fromkeys(used.tolist(), 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            both = a[2] + b[2]
            for s in both:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), both))
        if max(depth.values()) <= W.LONGEST:
            for s, n in depth.items():
                lengths[s] = n
            return lengths
        counts[used] = (counts[used] + 1) // 2


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bit-reversed as they are written."""
    out = np.zeros(len(lengths), np.int64)
    code, last = 0, 0
    for s in sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)):
        n = int(lengths[s])
        code <<= n - last
        out[s] = W.REVERSED[n][code]
        code, last = code + 1, n
    return out


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.n
        self.n += n

    def code(self, lengths: np.ndarray) -> None:
        """A prefix code: simple for up to two small symbols, else with coded lengths."""
        used = np.flatnonzero(lengths).tolist() or [0]
        if len(used) <= 2 and used[-1] < 256:
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            self.put(used[0] > 1, 1)
            self.put(used[0], 8 if used[0] > 1 else 1)
            if len(used) == 2:
                self.put(used[1], 8)
            return
        runs, at, end = [], 0, len(lengths)
        values = lengths.tolist()
        while at < end:
            n = 1
            while at + n < end and values[at + n] == values[at]:
                n += 1
            v = values[at]
            at += n
            if v:
                runs.append((v, 0, 0))
                n -= 1
            while n > 0:
                if v == 0 and n >= 3:
                    take = min(n, 138)
                    runs.append((18, take - 11, 7) if take >= 11 else (17, take - 3, 3))
                elif v and n >= 3:
                    take = min(n, 6)
                    runs.append((16, take - 3, 2))
                else:
                    take = 1
                    runs.append((v, 0, 0))
                n -= take
        counts = np.bincount([r[0] for r in runs], minlength=19)
        own = code_lengths(counts)
        while own.max() > 7:  # code length codes have three bits
            counts[counts > 0] = (counts[counts > 0] + 1) // 2
            own = code_lengths(counts)
        if (own > 0).sum() == 1:
            own[0 if own[0] == 0 else 1] = 1  # a code of two keeps every reader in step
        words = code_words(own)
        self.put(0, 1)
        many = max(4, 1 + max(k for k, s in enumerate(W.LENGTH_ORDER) if own[s]))
        self.put(many - 4, 4)
        for s in W.LENGTH_ORDER[:many]:
            self.put(own[s], 3)
        self.put(0, 1)
        for s, extra, n in runs:
            self.put(words[s], int(own[s]))
            self.put(extra, n)

    def bits(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.n]


def split_value(v):
    if v <= 4:
        return v - 1, 0, 0
    d = v - 1
    high = d.bit_length() - 1
    return 2 * high + (d >> (high - 1) & 1), d & ((1 << (high - 1)) - 1), high - 1


def put_image(w, px, width, cache_bits=0, refs=False, main=False, groups=None, shift=0):
    """An entropy-coded image; groups: the group of each block."""
    tokens, cache, i = [], [None] * (1 << cache_bits), 0
    slot = lambda p: (p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(px):
        best = (0, 0)
        for d in (1, width, width + 1, 2 * width, 200) if refs else ():
            n = 0
            while d <= i and i + n < len(px) and n < 900 and px[i + n] == px[i + n - d]:
                n += 1
            best = max(best, (n, d))
        if best[0] >= 3:
            tokens.append((i, "copy", best))
            seen = px[i : i + best[0]]
            i += best[0]
        else:
            hit = cache_bits and cache[slot(px[i])] == px[i]
            tokens.append((i, "cache" if hit else "lit", slot(px[i]) if hit else px[i]))
            seen = px[i : i + 1]
            i += 1
        if cache_bits:
            for p in seen:
                cache[slot(p)] = p
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(1 if groups else 0, 1)
        if groups:
            w.put(shift - 2, 3)
            put_image(w, [g << 8 | 0xFF000000 for g in groups], W.over(width, shift))
    n_groups = max(groups) + 1 if groups else 1
    sizes = [256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    counts = [[np.zeros(s, np.int64) for s in sizes] for _ in range(n_groups)]
    coded = []
    for at, kind, v in tokens:
        g = groups[(at // width >> shift) * W.over(width, shift) + (at % width >> shift)] if groups else 0
        if kind == "lit":
            parts = [(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24, 0, 0)]
        elif kind == "cache":
            parts = [(0, 280 + v, 0, 0)]
        else:
            n, d = v
            near = {width: 1, 1: 2, width + 1: 3}.get(d, d + 120)
            s, e, b = split_value(n)
            s2, e2, b2 = split_value(near)
            parts = [(0, 256 + s, e, b), (4, s2, e2, b2)]
        for c, s, _, _ in parts:
            counts[g][c][s] += 1
        coded.append((g, parts))
    lengths = [[code_lengths(np.where(c.any(), c, np.eye(1, len(c), dtype=np.int64)[0])) for c in g] for g in counts]
    for g in lengths:
        for n in g:
            w.code(n)
    words = [[code_words(n) for n in g] for g in lengths]
    for g, parts in coded:
        for c, s, e, b in parts:
            if (lengths[g][c] > 0).sum() > 1:
                w.put(words[g][c][s], int(lengths[g][c][s]))
            w.put(e, b)


def predicted(mode, le, t, tr, tl):
    av = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    cl = lambda v: min(255, max(0, v))
    if mode == 11:
        p = [a + b - c for a, b, c in zip(le, t, tl)]
        return le if sum(abs(x - y) for x, y in zip(p, le)) < sum(abs(x - y) for x, y in zip(p, t)) else t
    if mode == 12:
        return [cl(a + b - c) for a, b, c in zip(le, t, tl)]
    if mode == 13:
        m = av(le, t)
        return [cl(a + (abs(a - c) // 2) * (1 if a > c else -1)) for a, c in zip(m, tl)]
    return [[0, 0, 0, 255], le, t, tr, tl, av(av(le, tr), t), av(le, tl), av(le, t), av(tl, t), av(t, tr), av(av(le, tl), av(t, tr))][mode]


def forward_predictor(px, modes, width, shift):
    c = [[p & 255, p >> 8 & 255, p >> 16 & 255, p >> 24] for p in px]
    out = []
    for i, p in enumerate(c):
        y, x = divmod(i, width)
        if i == 0:
            q = [0, 0, 0, 255]
        elif y == 0:
            q = c[i - 1]
        elif x == 0:
            q = c[i - width]
        else:
            q = predicted(modes[(y >> shift) * W.over(width, shift) + (x >> shift)], c[i - 1], c[i - width], c[i - width + 1], c[i - width - 1])
        r = [(a - b) & 255 for a, b in zip(p, q)]
        out.append(r[0] | r[1] << 8 | r[2] << 16 | r[3] << 24)
    return out


def forward_cross(px, e, width, shift):
    s8 = lambda v: v - 256 if v > 127 else v
    out = []
    for i, p in enumerate(px):
        y, x = divmod(i, width)
        m = e[(y >> shift) * W.over(width, shift) + (x >> shift)]
        b, g, r = p & 255, p >> 8 & 255, p >> 16 & 255
        r2 = r - (s8(m & 255) * s8(g) >> 5) & 255
        b2 = b - (s8(m >> 8 & 255) * s8(g) >> 5) - (s8(m >> 16 & 255) * s8(r) >> 5) & 255
        out.append(p & 0xFF00FF00 | r2 << 16 | b2)
    return out


def write(px, width, transforms=(), palette=None, **main):
    height, coded = len(px) // width, width
    w = BitWriter()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    r = random.Random(1)
    for t in transforms:
        w.put(1, 1)
        w.put({"predictor": 0, "cross": 1, "green": 2, "palette": 3}[t], 2)
        if t in ("predictor", "cross"):
            shift = 2 if t == "predictor" else 3
            n = W.over(coded, shift) * W.over(height, shift)
            w.put(shift - 2, 3)
            if t == "predictor":
                modes = [k % 14 for k in range(n)]
                put_image(w, [m << 8 | 0xFF000000 for m in modes], W.over(coded, shift))
                px = forward_predictor(px, modes, coded, shift)
            else:
                e = [r.randrange(1 << 24) | 0xFF000000 for _ in range(n)]
                put_image(w, e, W.over(coded, shift), cache_bits=2)
                px = forward_cross(px, e, coded, shift)
        elif t == "green":
            px = [p & 0xFF00FF00 | ((p >> 16) - (p >> 8) & 255) << 16 | ((p & 255) - (p >> 8 & 255) & 255) for p in px]
        else:
            colours = sorted(set(px))
            w.put(len(colours) - 1, 8)
            delta, last = [], [0] * 4
            for p in colours:
                c = [p >> k & 255 for k in (0, 8, 16, 24)]
                d = [(a - b) & 255 for a, b in zip(c, last)]
                delta.append(sum(v << k for v, k in zip(d, (0, 8, 16, 24))))
                last = c
            put_image(w, delta, len(colours))
            n = len(colours)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            at = {p: k for k, p in enumerate(colours)}
            new, packed = W.over(width, shift), []
            for y in range(height):
                for x in range(new):
                    v = sum(at[px[y * width + x * (1 << shift) + k]] << (k * (8 >> shift)) for k in range(1 << shift) if x * (1 << shift) + k < width)
                    packed.append(v << 8 | 0xFF000000)
            px, coded = packed, new
    w.put(0, 1)
    put_image(w, px, coded, main=True, **main)
    return W.riff(np.packbits(w.bits(), bitorder="little").tobytes())


def picture(width, height, colours=None, seed=0):
    r = random.Random(seed)
    base = [r.randrange(1 << 32) for _ in range(colours)] if colours else None
    px = []
    for i in range(width * height):
        if px and r.random() < 0.6:
            px.append(px[-min(len(px), r.choice([1, width, width + 1]))])
        else:
            px.append(r.choice(base) if base else r.randrange(1 << 32))
    return px


@pytest.mark.parametrize("transforms", [(), ("green",), ("predictor",), ("cross",), ("predictor", "cross", "green"), ("green", "cross", "predictor")])
@pytest.mark.parametrize("cache,refs,grouped", [(0, False, False), (5, False, False), (0, True, False), (4, True, True)])
def test_every_feature(transforms, cache, refs, grouped):
    width, height = 37, 23
    px = picture(width, height)
    groups = [k % 3 for k in range(W.over(width, 3) * W.over(height, 3))] if grouped else None
    data = write(px, width, transforms, cache_bits=cache, refs=refs, groups=groups, shift=3)
    assert W.decode(data).reshape(-1).tolist() == px
    assert W.decode_many([data])[0].reshape(-1).tolist() == px


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    px = picture(29, 17, colours)
    for more in ((), ("predictor",)):
        assert W.decode(write(px, 29, ("palette", *more), refs=True)).reshape(-1).tolist() == px


def test_lockstep_reads_back_references():
    px = [0xFF000000 | v << 8 for v in b"abcabcabcabcabcabc" * 9 + bytes(range(64)) * 2 + b"tail!!"]
    width = next(w for w in range(2, 99) if len(px) % w == 0)
    files = [write(px, width, refs=True), write(px, width), write(px, width, ("palette",), refs=True)]
    assert [x.reshape(-1).tolist() for x in W.decode_many(files)] == [px] * 3


def test_known_file_and_broken_streams():
    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert W.decode(data).shape == (1, 1)
    for bad in (b"", b"RIFF", data[:20], data.replace(b"VP8L", b"VP8 ")):
        with pytest.raises(ValueError):
            W.decode(bad)


def test_damaged_streams_are_errors_or_images():
    """Any damage gives ValueError or some image of the stated size, and never another error."""
    r = random.Random(3)
    for k, good in enumerate(W.write_images([np.arange(16 * 20, dtype=np.uint32) * 77 % 999] * 8, profiles=list(range(8)))):
        for _ in range(60):
            bad = bytearray(good)
            for _ in range(r.randint(1, 4)):
                bad[r.randrange(25, len(bad))] = r.randrange(256)
            bad = bytes(bad[: r.choice([len(bad), r.randrange(25, len(bad))])])
            try:
                assert W.decode(bad).ndim == 2
            except ValueError:
                pass


def test_round_trip_of_samples():
    r = np.random.default_rng(0)
    skewed = (r.exponential(3.0, 64 * 300).astype(np.uint8)).tobytes()
    fib = b"".join(bytes([k]) * n for k, n in enumerate([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584]))
    for payload in (bytes(64), b"a" * 64, b"ab" * 32, bytes(range(256)) * 4, skewed, W.payload_of(fib.decode("latin1")), W.payload_of("x" * 20000)):
        (stored,) = W.write_samples([payload])
        assert W.read_samples([stored])[0].tobytes() == payload
        assert b"".join(W.samples_of(W.decode(f)).tobytes() for f in W.split_files(stored)) == payload


@pytest.mark.parametrize("where", ["small", "odd"])
def test_query(spark, odd_dir, where):
    d = SMALL if where == "small" else odd_dir
    want = []
    for i, t, *_ in documents(d):
        p = W.payload_of(t)
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    got = W.op3_media(spark, d).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert len({r["media_sha256"] for r in got}) == len({r["payload_sha256"] for r in got})


def test_the_stored_texts_use_every_feature():
    seen = W.Counter()
    payloads = [W.payload_of(t) for _, t, *_ in documents(SMALL)]
    got = W.read_samples(W.write_samples(payloads), seen)
    assert [x.tobytes() for x in got] == payloads
    assert all(seen[k] > 0 for k in ("copies", "hits", "groups", W.PREDICTOR, W.CROSS, W.GREENS, W.PALETTE))


@pytest.mark.parametrize("profile", range(8))
def test_writer_and_both_readers(profile):
    """Images of odd sizes and contents in every profile, read in lockstep and pixel by pixel."""
    r = np.random.default_rng(profile)
    images = [r.integers(0, 2**32, 16 * h, dtype=np.uint32) for h in (1, 2, 15, 16, 17, 33, 128)]
    images += [r.integers(0, n, 16 * 40).astype(np.uint32) * np.uint32(0x01030507) for n in (1, 2, 3, 5, 17, 300)]
    images += [np.tile(np.arange(7, dtype=np.uint32), 16 * 30)[: 16 * 30], np.repeat(np.arange(64, dtype=np.uint32), 32)]
    files = W.write_images(images, profiles=[profile] * len(images))
    assert all((a == b.reshape(-1)).all() for a, b in zip(images, W.decode_many(files)))
    for a, f in zip(images, files):
        image = W.Image(f)
        (px,) = W.inverted([image], [W.read_entropy_image(image.bits, image.coded_width, image.height, main=True)])
        assert (px.reshape(-1) == a).all()


@pytest.mark.parametrize("cached", [False, True])
def test_a_group_of_one_copy_or_one_cached_colour(cached):
    """The second group's only green symbol is beyond 255, which a simple code can't hold."""
    rows = np.random.default_rng(3).integers(0, 2**32, 16 * 16, dtype=np.uint32)
    # Sixteen rows again are one copy; a last colour again is one of the cache, since no pair of pixels repeats.
    px, width = (np.append(rows[:16], rows[15]), 1) if cached else (np.append(rows, rows), 16)
    (file,) = W.write_images([px], width=width, profiles=[5])
    assert (W.decode(file).reshape(-1) == px).all()
    image = W.Image(file)
    assert (W.read_entropy_image(image.bits, image.coded_width, image.height, main=True) == px).all()


def test_code_lengths_are_complete():
    r = np.random.default_rng(5)
    counts = (r.exponential(1, (300, 408)) ** 6 * (r.random((300, 408)) < r.random((300, 1)))).astype(np.int64)
    counts = counts * 30000 // np.maximum(counts.sum(1, keepdims=True), 30000)
    counts[0] = counts[1] = 0
    counts[1, 7], counts[2, :] = 5, 1
    counts[3] = 0
    counts[3, :15] = 1 << np.arange(15)
    n = W.complete_lengths(counts)
    many = (counts > 0).sum(1) > 1
    assert ((n > 0) == (counts > 0))[many].all() and not n[~many].any() and n.max() <= 15
    assert (np.where(n > 0, 2.0 ** -n, 0).sum(1)[many] == 1).all()


def test_empty(spark, empty_dir):
    assert W.op3_media(spark, empty_dir).collect() == []
