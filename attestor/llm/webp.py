"""Lossless WebP (VP8L): a decoder for whole streams and an encoder, both over numpy pixel arrays.

Pixels are (height, width, 4) arrays of 8-bit samples in the order red, green, blue, alpha. ``decode`` reads prefix
codes (simple and normal), meta prefix groups, back-references with the two-dimensional distance map and the colour
cache, and inverts predictor, cross-colour, subtract-green and palette transforms. ``encode`` writes one image with any
of these tools. ``webp_tiles`` does both for many small images at once.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
LENGTH_CODES, DISTANCE_CODES = 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
OPAQUE = 0xFF000000


@lru_cache
def distance_map() -> list[tuple[int, int]]:
    """Neighbours by distance: the format's 120 short distance codes as (columns left, rows up)."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Reader:
    def __init__(self, data: bytes):
        self.data, self.pos = data + b"\0" * 8, 0

    def peek(self) -> int:
        at = self.pos >> 3
        return int.from_bytes(self.data[at : at + 8], "little") >> (self.pos & 7)

    def peek_at(self, pos: int, n: int) -> int:
        """``n`` bits from ``pos`` on, however many."""
        return int.from_bytes(self.data[pos >> 3 : (pos + n + 7) >> 3], "little") >> (pos & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.pos += n
        if self.pos > 8 * len(self.data):
            raise ValueError("the stream ends too early")
        return value


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def code(self, coded: tuple[int, int]) -> None:
        self.put(*coded)

    def to_bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


@lru_cache(maxsize=4096)
def reverse(value: int, n: int) -> int:
    return int(f"{value:0{n}b}"[::-1], 2) if n else 0


def canonical(lengths) -> dict[int, tuple[int, int]]:
    """symbol -> (bits as read, length); one used symbol takes no bits."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, last = {}, 0, 0
    for n, s in used:
        code <<= n - last
        out[s], last = (reverse(code, n), n), n
        code += 1
    return out


class Code:
    """A prefix code: symbols by (bits, length), for reading."""

    def __init__(self, lengths):
        self.lengths = lengths
        self.codes = canonical(lengths)
        self.only = next(iter(self.codes)) if len(self.codes) == 1 else None
        self.by_bits = {(b, n): s for s, (b, n) in self.codes.items()}
        self.sizes = sorted({n for _, n in self.codes.values()})

    def read(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        ahead = r.peek()
        for n in self.sizes:
            s = self.by_bits.get((ahead & ((1 << n) - 1), n))
            if s is not None:
                r.pos += n
                return s
        raise ValueError("no such prefix code")


def read_lengths(r: Reader, alphabet: int) -> list[int]:
    lengths = [0] * alphabet
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        lengths[r.read(8 if wide else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return lengths
    meta = [0] * 19
    for k in range(4 + r.read(4)):
        meta[CODE_LENGTH_ORDER[k]] = r.read(3)
    table = _meta_table(tuple(meta))
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    at, last, data, pos = 0, 8, r.data, r.pos
    while at < alphabet and left:
        left -= 1
        byte = pos >> 3
        ahead = int.from_bytes(data[byte : byte + 4], "little") >> (pos & 7)
        s, n = table[ahead & 127]
        pos += n
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        extra = 2 if s == 16 else 3 if s == 17 else 7
        n = (ahead >> n & (1 << extra) - 1) + (11 if s == 18 else 3)
        pos += extra
        if at + n > alphabet:
            raise ValueError("code lengths run over the alphabet")
        lengths[at : at + n] = [last if s == 16 else 0] * n
        at += n
    r.pos = pos
    if pos > 8 * len(data):
        raise ValueError("the stream ends too early")
    return lengths


@lru_cache(maxsize=1024)
def _meta_table(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """(symbol, bits) by the next seven bits."""
    out: list = [None] * 128
    for s, (bits, n) in canonical(lengths).items():
        for rest in range(0, 128, 1 << n):
            out[rest | bits] = (s, n)
    if None in out:
        raise ValueError("prefix code is not complete")
    return out


def huffman_lengths(counts, most: int) -> list[int]:
    """Code lengths of at most ``most`` bits by Huffman's method; counts are flattened until they fit."""
    used = [(c, s) for s, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    if len(used) < 2:
        for _, s in used:
            lengths[s] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(c, floor), s, None) for c, s in used]
        heapq.heapify(heap)
        number = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], number, (a, b)))
            number += 1
        stack = [(heap[0], 0)]
        while stack:
            (_, s, kids), depth = stack.pop()
            if kids:
                stack += [(kids[0], depth + 1), (kids[1], depth + 1)]
            else:
                lengths[s] = depth
        if max(lengths) <= most:
            return lengths
        floor = max(floor * 2, sum(c for c, _ in used) >> most)


def write_lengths(w: Writer, lengths: list[int]) -> None:
    """A normal code-length code with an explicit symbol count, or a simple code for one or two symbols under 256."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        wide = used[0] > 1
        w.put(int(wide), 1)
        w.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    tokens: list[tuple[int, int, int]] = []
    at, end = 0, used[-1] + 1
    while at < end:
        run = at
        while run < end and lengths[run] == lengths[at]:
            run += 1
        n = run - at
        if lengths[at] == 0 and n >= 3:
            n = min(n, 138)
            tokens.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
        elif at and lengths[at] == lengths[at - 1] and lengths[at] and n >= 3:
            n = min(n, 6)
            tokens.append((16, n - 3, 2))
        else:
            n = 1
            tokens.append((lengths[at], 0, 0))
        at += n
    counts = [0] * 19
    for t, _, _ in tokens:
        counts[t] += 1
    meta = huffman_lengths(counts, 7)
    codes = canonical(meta)
    w.put(0, 1)
    n = max(4, 19 - next(k for k in range(19) if meta[CODE_LENGTH_ORDER[18 - k]]))
    w.put(n - 4, 4)
    for k in range(n):
        w.put(meta[CODE_LENGTH_ORDER[k]], 3)
    w.put(1, 1)
    need = max(2, (len(tokens) - 2).bit_length())
    need += need % 2
    w.put((need - 2) // 2, 3)
    w.put(max(0, len(tokens) - 2), need)
    for t, extra, bits in tokens:
        w.code(codes[t])
        w.put(extra, bits)
    for _ in range(2 - len(tokens)):  # the count is 2 at least
        w.code(codes[tokens[-1][0]])


def prefix_value(code: int, r: Reader) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + r.read(extra) + 1


def to_prefix(value: int) -> tuple[int, int, int]:
    """(code, extra value, extra bits) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + 2 + ((v >> extra) & 1), v & ((1 << extra) - 1), extra


def _pixels(argb) -> np.ndarray:
    a = np.asarray(argb, np.uint32)
    return np.stack([a >> 16 & 255, a >> 8 & 255, a & 255, a >> 24], -1).astype(np.uint8)


def _argb(rgba: np.ndarray) -> np.ndarray:
    p = rgba.astype(np.uint32)
    return p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]


def read_image(r: Reader, width: int, height: int, top: bool) -> list[int]:
    """An entropy-coded image as ARGB integers; the top-level one may have meta prefix groups."""
    cache_bits = r.read(4) if r.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    group_bits, group_of, groups = 0, None, 1
    if top and r.read(1):
        group_bits = r.read(3) + 2
        across = (width + (1 << group_bits) - 1) >> group_bits
        group_of = [p >> 8 & 0xFFFF for p in read_image(r, across, (height + (1 << group_bits) - 1) >> group_bits, False)]
        groups = max(group_of) + 1
    sizes = (256 + LENGTH_CODES + len(cache), 256, 256, 256, DISTANCE_CODES)
    codes = [[Code(read_lengths(r, n)) for n in sizes] for _ in range(groups)]
    out: list[int] = []
    total, shift = width * height, 32 - cache_bits
    five = codes[0]
    while len(out) < total:
        if group_of is not None:
            y, x = divmod(len(out), width)
            five = codes[group_of[(y >> group_bits) * across + (x >> group_bits)]]
        s = five[0].read(r)
        if s < 256:
            red, blue, alpha = five[1].read(r), five[2].read(r), five[3].read(r)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 256 + LENGTH_CODES:
            length = prefix_value(s - 256, r)
            far = prefix_value(five[4].read(r), r)
            if far > 120:
                far -= 120
            else:
                dx, dy = distance_map()[far - 1]
                far = max(1, dx + dy * width)
            if far > len(out) or len(out) + length > total:
                raise ValueError("a back-reference leaves the image")
            new = []
            for _ in range(length):
                out.append(out[-far])
                if cache:
                    cache[(CACHE_MULTIPLIER * out[-1] & 0xFFFFFFFF) >> shift] = out[-1]
            continue
        else:
            new = [cache[s - 256 - LENGTH_CODES]]
        out += new
        if cache:
            cache[(CACHE_MULTIPLIER * new[0] & 0xFFFFFFFF) >> shift] = new[0]
    return out


def predicted(mode: int, left, top, top_right, top_left) -> np.ndarray:
    """The prediction of one pixel from its neighbours (arrays of four ints)."""

    def mean(a, b):
        return (a + b) >> 1

    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        a = mean(left, top)
        d = a - top_left
        return np.clip(a + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)
    return np.array([0, 0, 0, 255])


def _neighbours(flat, k, width):
    return flat[k - 1], flat[k - width], flat[k - width + 1], flat[k - width - 1]


def predict(rgba: np.ndarray, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Residuals of a picture, or the picture of residuals."""
    height, width = rgba.shape[:2]
    if not inverse and modes.min() == modes.max() and modes.flat[0] in (1, 2):
        full = rgba.astype(np.int64)
        guess = np.empty_like(full)
        guess[:, 1:], guess[1:, 0], guess[0, 0] = full[:, :-1], full[:-1, 0], (0, 0, 0, 255)
        if modes.flat[0] == 2:
            guess[1:] = full[:-1]
        return (full - guess & 255).astype(np.uint8)
    given = rgba.reshape(-1, 4).astype(np.int64)
    out = given.copy()
    full = out if inverse else given
    black = np.array([0, 0, 0, 255])
    for k in range(height * width):
        y, x = divmod(k, width)
        if k == 0:
            guess = black
        elif y == 0:
            guess = full[k - 1]
        elif x == 0:
            guess = full[k - width]
        else:
            guess = predicted(int(modes[y >> bits, x >> bits]), *_neighbours(full, k, width))
        out[k] = (given[k] + guess if inverse else given[k] - guess) & 255
    return out.reshape(height, width, 4).astype(np.uint8)


def unpredict(residuals: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """The picture of residuals. Where one mode looks only to the left or only up, residuals add up along that way."""
    if modes.min() != modes.max() or modes.flat[0] not in (1, 2):
        return predict(residuals, modes, bits, True)
    out = residuals.astype(np.int64)
    out[0, 0, 3] += 255
    if modes.flat[0] == 1:
        out[:, 0] = np.cumsum(out[:, 0], 0)
        out = np.cumsum(out, 1)
    else:
        out[0] = np.cumsum(out[0], 0)
        out = np.cumsum(out, 0)
    return (out & 255).astype(np.uint8)


def cross_colour(rgba: np.ndarray, elements: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    height, width = rgba.shape[:2]
    e = np.repeat(np.repeat(elements, 1 << bits, 0), 1 << bits, 1)[:height, :width].astype(np.int8).astype(np.int64)
    red_to_blue, green_to_blue, green_to_red = e[..., 0], e[..., 1], e[..., 2]
    signed = rgba.astype(np.int8).astype(np.int64)
    out = rgba.astype(np.int64)
    sign = 1 if inverse else -1
    red = out[..., 0] + sign * (green_to_red * signed[..., 1] >> 5) & 255
    true_red = (red if inverse else out[..., 0]).astype(np.uint8).astype(np.int8).astype(np.int64)
    out[..., 2] = out[..., 2] + sign * (green_to_blue * signed[..., 1] >> 5) + sign * (red_to_blue * true_red >> 5) & 255
    out[..., 0] = red
    return out.astype(np.uint8)


def read_head(r: Reader) -> tuple[int, int, int, list]:
    """(width, height, width as coded, transforms) of a stream, up to its main image. A transform is its kind, block or
    packing bits, data and the width before it."""
    if r.read(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    done, coded = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (x[0] for x in done):
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            across, down = (coded + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            done.append((kind, bits, _pixels(read_image(r, across, down, False)).reshape(down, across, 4), coded))
        elif kind == PALETTE:
            n = r.read(8) + 1
            table = np.cumsum(_pixels(read_image(r, n, 1, False)), 0, dtype=np.int64).astype(np.uint8)
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            done.append((kind, bits, table, coded))
            coded = (coded + (1 << bits) - 1) >> bits
        else:
            done.append((kind, 0, None, coded))
    return width, height, coded, done


def invert(rgba: np.ndarray, transforms: list) -> np.ndarray:
    """The picture before its transforms."""
    height = len(rgba)
    for kind, bits, data, before in reversed(transforms):
        if kind == PREDICTOR:
            rgba = unpredict(rgba, data[..., 1], bits)
        elif kind == CROSS_COLOUR:
            rgba = cross_colour(rgba, data, bits, True)
        elif kind == SUBTRACT_GREEN:
            rgba = rgba.copy()
            rgba[..., 0] += rgba[..., 1]
            rgba[..., 2] += rgba[..., 1]
        else:
            green = rgba[..., 1]
            if bits:
                each = 8 >> bits
                index = np.stack([green >> (k * each) & ((1 << each) - 1) for k in range(1 << bits)], -1).reshape(height, -1)[:, :before]
            else:
                index = green
            table = np.zeros((256, 4), np.uint8)
            table[: len(data)] = data
            rgba = table[index]
    return rgba


def decode(stream: bytes) -> np.ndarray:
    """The pixels of a VP8L stream."""
    r = Reader(stream)
    _, height, coded, transforms = read_head(r)
    return invert(_pixels(read_image(r, coded, height, True)).reshape(height, coded, 4), transforms)


def write_image(w: Writer, argb: list[int], width: int, cache_bits: int = 0, back_references: bool = False, group_bits: int | None = None) -> None:
    """Entropy-code an image. ``group_bits`` is None for an inner image, 0 for one group, else blocks of that size."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    height = len(argb) // width
    group_of, groups, across = [0], 1, 1
    if group_bits is not None:
        w.put(int(group_bits > 0), 1)
        if group_bits:
            across, down = (width + (1 << group_bits) - 1) >> group_bits, (height + (1 << group_bits) - 1) >> group_bits
            group_of = [k % 2 for k in range(across * down)]
            groups = max(group_of) + 1
            w.put(group_bits - 2, 3)
            write_image(w, [OPAQUE | g << 8 for g in group_of], across)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift, seen, k = 32 - cache_bits, {}, 0
    tokens: list[tuple[int, int, tuple]] = []  # group, symbol kind, values

    def group(k):
        y, x = divmod(k, width)
        return group_of[(y >> group_bits) * across + (x >> group_bits)] if group_bits else 0

    while k < len(argb):
        length = 0
        if back_references and k + 2 < len(argb):
            at = seen.get(tuple(argb[k : k + 3]))
            if at is not None:
                while k + length < len(argb) and length < 4096 and argb[at + length] == argb[k + length]:
                    length += 1
        g = group(k)
        if length >= 3:
            near = [max(1, dx + dy * width) for dx, dy in distance_map()]
            far = near.index(k - at) + 1 if k - at in near else k - at + 120
            tokens.append((g, 1, (*to_prefix(length), *to_prefix(far))))
        else:
            length = 1
            p = argb[k]
            slot = (CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift if cache else 0
            tokens.append((g, 2, (slot,)) if cache and cache[slot] == p else (g, 0, (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)))
        for j in range(k, k + length):
            if cache:
                cache[(CACHE_MULTIPLIER * argb[j] & 0xFFFFFFFF) >> shift] = argb[j]
            seen[tuple(argb[j : j + 3])] = j
        k += length
    counts = [[[0] * n for n in (256 + LENGTH_CODES + len(cache), 256, 256, 256, DISTANCE_CODES)] for _ in range(groups)]
    for g, kind, v in tokens:
        if kind == 0:
            for c, s in enumerate(v):
                counts[g][c][s] += 1
        elif kind == 1:
            counts[g][0][256 + v[0]] += 1
            counts[g][4][v[3]] += 1
        else:
            counts[g][0][256 + LENGTH_CODES + v[0]] += 1
    codes = []
    for five in counts:
        codes.append([])
        for c in five:
            lengths = huffman_lengths(c, 15)
            write_lengths(w, lengths)
            codes[-1].append(canonical(lengths))
    for g, kind, v in tokens:
        five = codes[g]
        if kind == 0:
            for c, s in enumerate(v):
                w.code(five[c][s])
        elif kind == 1:
            w.code(five[0][256 + v[0]])
            w.put(v[1], v[2])
            w.code(five[4][v[3]])
            w.put(v[4], v[5])
        else:
            w.code(five[0][256 + LENGTH_CODES + v[0]])


def header(w: Writer, width: int, height: int, alpha: bool) -> None:
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(alpha), 1)
    w.put(0, 3)


def write_transforms(w: Writer, rgba: np.ndarray, predictor: int | None = None, cross: tuple[int, int, int] | None = None, subtract_green: bool = False, palette: bool = False, block_bits: int = 3) -> np.ndarray:
    """Write the transforms of a picture and return it transformed. ``predictor`` is a mode, or -1 for another mode in
    each block; ``cross`` is red to blue, green to blue, green to red."""
    height, width = rgba.shape[:2]
    down, across = (height + (1 << block_bits) - 1) >> block_bits, (width + (1 << block_bits) - 1) >> block_bits
    if palette:
        colours, index = np.unique(_argb(rgba), return_inverse=True)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        index = index.reshape(height, width)
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(colours) - 1, 8)
        steps = np.diff(np.vstack([np.zeros((1, 4), np.int64), _pixels(colours).astype(np.int64)]), axis=0) & 255
        write_image(w, _argb(steps.astype(np.uint8)).tolist(), len(colours))
        n = len(colours)
        bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        packed = np.zeros((height, (width + (1 << bits) - 1) >> bits), np.int64)
        for x in range(width):
            packed[:, x >> bits] |= index[:, x] << ((x & ((1 << bits) - 1)) * (8 >> bits) if bits else 0)
        rgba = np.zeros((*packed.shape, 4), np.uint8)
        rgba[..., 1], rgba[..., 3] = packed, 255
        across = (packed.shape[1] + (1 << block_bits) - 1) >> block_bits
    if predictor is not None:
        modes = np.full((down, across), predictor) if predictor >= 0 else np.arange(down * across).reshape(down, across) % 14
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(block_bits - 2, 3)
        write_image(w, [OPAQUE | int(m) << 8 for m in modes.ravel()], across)
        rgba = predict(rgba, modes, block_bits, False)
    if cross is not None:
        elements = np.zeros((down, across, 4), np.uint8)
        elements[..., :3], elements[..., 3] = np.array(cross, np.int64).astype(np.uint8), 255
        w.put(1, 1)
        w.put(CROSS_COLOUR, 2)
        w.put(block_bits - 2, 3)
        write_image(w, _argb(elements).ravel().tolist(), across)
        rgba = cross_colour(rgba, elements, block_bits, False)
    if subtract_green:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        rgba = rgba.copy()
        rgba[..., 0] -= rgba[..., 1]
        rgba[..., 2] -= rgba[..., 1]
    w.put(0, 1)
    return rgba


def encode(rgba: np.ndarray, cache_bits: int = 0, back_references: bool = True, group_bits: int = 0, **transforms) -> bytes:
    """A VP8L stream with the given tools; ``transforms`` are those of ``write_transforms``."""
    w = Writer()
    header(w, rgba.shape[1], rgba.shape[0], bool((rgba[..., 3] != 255).any()))
    rgba = write_transforms(w, rgba, **transforms)
    write_image(w, _argb(rgba).ravel().tolist(), rgba.shape[1], cache_bits, back_references, group_bits)
    return w.to_bytes()


def riff(stream: bytes) -> bytes:
    """The stream as a WebP file."""
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def unriff(data: bytes) -> list[bytes]:
    """The VP8L streams of WebP files that follow one another."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        n = int.from_bytes(data[at + 16 : at + 20], "little")
        out.append(data[at + 20 : at + 20 + n])
        at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    return out
