"""Many small lossless WebP pictures at once.

``encode_tiles`` finds back-references and colour-cache hits of all pictures by sorting, chooses each picture's
transform and cache by the bits they are likely to take, and packs all codes together. ``decode_tiles`` decodes many
streams in step, one pixel of each stream at a time, with prefix-code tables, copies and caches by stream; streams with
meta prefix groups, long codes or an alpha channel go through ``webp.decode``. Work is done on groups of at most
``LANES`` streams or ``PIXELS`` pixels, so that memory does not follow the number of pictures given.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .webp import CACHE_MULTIPLIER, CODE_LENGTH_ORDER, DISTANCE_CODES, LENGTH_CODES, OPAQUE, Reader, Writer, canonical, decode, distance_map, header, invert, read_head, read_lengths, write_transforms

#: Longest code that is written, and that the decoder has tables for.
TABLE_BITS = 11
LANES = 1024
#: Pixels that are encoded at once, and the most that a picture may have.
PIXELS, MOST = 1 << 19, 1 << 12
#: The alpha code of opaque pictures: the one symbol 255.
OPAQUE_CODE = 0b11111111101
#: Share of pixels that a transform must make plain for its bits to be worked out.
SHARE = 0.25
CACHE_BITS = 8
#: Pictures of up to so many colours get a palette.
PALETTE_COLOURS = 16
#: Transforms whose likely bits are compared, by the arguments of ``write_transforms``; ``BLOCK`` covers a whole tile.
BLOCK = 6
TRANSFORMS = ({}, {"subtract_green": True}, {"cross": (32, 0, 0)}, {"predictor": 1}, {"predictor": 2})
#: Bits that a transform or a cache must save.
GAIN = 100

_RGBA = [2, 1, 0, 3]  # where the bytes of an ARGB integer are

_U = np.uint64
_GREEN = 256 + LENGTH_CODES


@lru_cache
def _far_codes(width: int, pixels: int) -> np.ndarray:
    """The distance code of each distance in pixels."""
    out = np.arange(pixels + 1) + 120
    for k, (dx, dy) in reversed(list(enumerate(distance_map()))):
        if (d := max(1, dx + dy * width)) <= pixels:
            out[d] = k + 1
    return out


@lru_cache
def _near(width: int) -> np.ndarray:
    return np.array([0, *(max(1, dx + dy * width) for dx, dy in distance_map())])


@lru_cache
def _reversal(bits: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for k in range(bits):
        out = np.concatenate([out, out + (1 << (bits - 1 - k))])
    return out


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, extra value, extra bits) of lengths or distances."""
    v = values - 1
    extra = np.where(v < 4, 0, np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 2)
    return np.where(v < 4, v, 2 * extra + 2 + (v >> extra & 1)), v & ((1 << extra) - 1), extra


_CODES = np.arange(DISTANCE_CODES)
_EXTRA = np.where(_CODES < 4, 0, (_CODES - 2) >> 1)
_BASE = np.where(_CODES < 4, _CODES + 1, ((2 + (_CODES & 1)) << _EXTRA) + 1)


def _bits(symbols: np.ndarray, which: np.ndarray, tiles: int, alphabet: int) -> np.ndarray:
    """The least bits of each tile's symbols, and some for each symbol's code length."""
    counts = np.bincount(which * alphabet + symbols, minlength=tiles * alphabet).reshape(tiles, alphabet)
    total = counts.sum(1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(1) + 4 * (counts > 0).sum(1)


def _likely(rgb: np.ndarray, which: np.ndarray, tiles: int) -> np.ndarray:
    return sum(_bits(rgb[:, c], which, tiles, 256) for c in range(3))


#: Bits of a place among the pixels of a group.
_PLACE = (PIXELS + MOST).bit_length()


def _previous(keys: np.ndarray) -> np.ndarray:
    """The last earlier place of an equal key, or -1. Keys have at most 64 - ``_PLACE`` bits; places sort with them."""
    packed = np.sort(keys.astype(np.uint64) << _U(_PLACE) | np.arange(len(keys), dtype=np.uint64))
    key, place = packed >> _U(_PLACE), (packed & _U((1 << _PLACE) - 1)).astype(np.int64)
    out = np.full(len(keys), -1)
    same = key[1:] == key[:-1]
    out[place[1:][same]] = place[:-1][same]
    return out


class _Tiles:
    """Pixels of several pictures, one after the other; colours are red << 16 | green << 8 | blue."""

    def __init__(self, pictures: list[np.ndarray]):
        self.sizes = np.array([p.shape[0] * p.shape[1] for p in pictures])
        self.ends = np.cumsum(self.sizes)
        self.which = np.repeat(np.arange(len(pictures)), self.sizes)
        self.rgb = np.concatenate([p.reshape(-1, p.shape[2])[:, :3] for p in pictures]).astype(np.int64)
        self.colour = self.rgb[:, 0] << 16 | self.rgb[:, 1] << 8 | self.rgb[:, 2]

    def copies(self) -> tuple[np.ndarray, np.ndarray]:
        """(length of the copy that starts at each pixel or 0, its distance); pixels inside a copy have length -1.

        Pixels whose colours and the next two occurred before at one distance form a run, which is one copy.
        """
        n, c = len(self.colour), self.colour.astype(np.uint64)
        length, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n < 4:
            return length, far
        three = c[:-2] | c[1:-1] << _U(24) | c[2:] << _U(48)
        last = _previous((three ^ self.which[:-2].astype(np.uint64) * _U(0x9E3779B97F4A7C15)) * _U(0xBF58476D1CE4E5B9) >> _U(_PLACE))
        k = np.flatnonzero(last >= 0)
        j = last[k]
        good = (self.which[j] == self.which[k + 2]) & (three[j] == three[k]) & (c[j + 2] == c[k + 2])
        far[k[good]] = (k - j)[good]
        edge = np.flatnonzero((far[1:] != far[:-1]) | (self.which[1:] != self.which[:-1])) + 1
        begin, end = np.r_[0, edge], np.r_[edge, n]
        runs = far[begin] > 0
        done = 0
        for a, b, d in zip(begin[runs].tolist(), end[runs].tolist(), far[begin[runs]].tolist(), strict=True):
            a, b = max(a, done), b + 2
            if b - a >= 3:
                length[a + 1 : b] = -1
                length[a], far[a], done = b - a, d, b
        return length, far

    def hits(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(whether the colour cache holds each pixel's colour, its slot)."""
        slot = (CACHE_MULTIPLIER * (self.colour | OPAQUE) & 0xFFFFFFFF) >> (32 - bits)
        last = _previous(self.which << bits | slot)
        return (last >= 0) & (self.colour[last] == self.colour), slot


def _chosen(t: _Tiles, width: int) -> list[dict]:
    """The transform of each tile: a palette for few colours, else what takes clearly fewer bits than none."""
    tiles = len(t.sizes)
    colours = np.sort(t.which << 24 | t.colour)
    kinds = np.bincount(colours[np.r_[True, colours[1:] != colours[:-1]]] >> 24, minlength=tiles)
    left = np.zeros_like(t.rgb)
    left[1:] = t.rgb[:-1]
    up = left.copy()
    up[width:] = t.rgb[:-width]
    starts = t.ends - t.sizes
    at = np.arange(len(t.rgb)) - np.repeat(starts, t.sizes)
    left[at % width == 0] = up[at % width == 0]
    up[at < width] = left[at < width]
    left[starts] = up[starts] = 0
    red, green, blue = t.rgb.T
    # A transform can only pay where it makes many samples equal: only such tiles are looked at closely.
    plain = [np.bincount(t.which, weights=x, minlength=tiles) for x in (red == green, blue == green, red == blue, t.colour == left[:, 0] << 16 | left[:, 1] << 8 | left[:, 2], t.colour == up[:, 0] << 16 | up[:, 1] << 8 | up[:, 2])]
    maybe = np.max(plain, 0) >= SHARE * t.sizes
    some = np.flatnonzero(maybe[t.which])
    which = t.which[some]
    red, green, blue, left, up = (x[some] for x in (red, green, blue, left, up))
    r, g, b, r_g, b_g, b_r = (_bits(x & 255, which, tiles, 256) for x in (red, green, blue, red - green, blue - green, blue - red))
    bits = np.stack([r + g + b, r_g + g + b_g, r + g + b_r + GAIN, *(_likely(np.stack([red, green, blue], 1) - x & 255, which, tiles) + GAIN for x in (left, up))])
    best = np.where(bits.min(0) + GAIN < bits[0], bits.argmin(0), 0)
    return [{"palette": True} if k <= PALETTE_COLOURS else TRANSFORMS[b] for k, b in zip(kinds.tolist(), best.tolist(), strict=True)]


def encode_tiles(images: list[bytes], width: int) -> list[bytes]:
    """Streams of RGB images of the given width (bytes in rows)."""
    out: list[bytes] = []
    group: list[bytes] = []
    pixels = 0
    for image in images:
        if len(image) > 3 * MOST:
            raise ValueError(f"a tile has over {MOST} pixels")
        group.append(image)
        pixels += len(image) // 3
        if pixels >= PIXELS:
            out += _encode(group, width)
            group, pixels = [], 0
    return out + (_encode(group, width) if group else [])


def _encode(images: list[bytes], width: int) -> list[bytes]:
    pictures = [np.frombuffer(im, np.uint8).reshape(-1, width, 3) for im in images]
    t = _Tiles(pictures)
    heads, changed, widths = [], False, []
    for k, transforms in enumerate(_chosen(t, width)):
        w = Writer()
        header(w, width, len(pictures[k]), False)
        if transforms:
            rgba = np.concatenate([pictures[k], np.full((*pictures[k].shape[:2], 1), 255, np.uint8)], 2)
            pictures[k] = write_transforms(w, rgba, block_bits=BLOCK, **transforms)
            changed = True
        else:
            w.put(0, 1)
        heads.append(w)
        widths.append(pictures[k].shape[1])
    if changed:
        t = _Tiles(pictures)
    length, far = t.copies()

    # Tokens: literals, copies and cache hits, where the cache saves bits.
    tiles, keep = len(pictures), length >= 0
    token = np.flatnonzero(keep)
    which, red, green, blue = t.which[token], *t.rgb[token].T
    copied = length[token] > 0
    hit, slot = t.hits(CACHE_BITS)
    hit, slot = hit[token] & ~copied, slot[token]
    plain, literal = ~copied, ~copied & ~hit
    without = sum(_bits(x[plain], which[plain], tiles, 256) for x in (red, green, blue))
    symbols = np.where(hit, 256 + slot, green)
    with_cache = _bits(symbols[plain], which[plain], tiles, 256 + (1 << CACHE_BITS)) + sum(_bits(x[literal], which[literal], tiles, 256) for x in (red, blue))
    cached = with_cache + GAIN < without
    hit &= cached[which]
    literal = ~copied & ~hit
    size_code, size_extra, size_bits = _prefix(length[token[copied]])
    far_code = np.empty(len(token), np.int64)
    most = int(t.sizes.max())
    for wide in set(widths):
        mine = copied & (np.array(widths) == wide)[which]
        far_code[mine] = _far_codes(wide, most)[far[token[mine]]]
    dist_code, dist_extra, dist_bits = _prefix(far_code[copied])
    green = np.where(hit, _GREEN + slot, green)
    green[copied] = 256 + size_code

    def counts(symbols, of, alphabet):
        return np.bincount(of * alphabet + symbols, minlength=tiles * alphabet).reshape(tiles, alphabet)

    alphabet = _GREEN + (1 << CACHE_BITS)
    # Red and blue share a code, as their letters do.
    histograms = counts(green, which, alphabet), counts(red[literal], which[literal], 256) + counts(blue[literal], which[literal], 256), counts(dist_code, which[copied], DISTANCE_CODES)
    for k, w in enumerate(heads):
        w.put(int(cached[k]), 1)
        if cached[k]:
            w.put(CACHE_BITS, 4)
        w.put(0, 1)  # no groups
    # The alphabet that is written: without a cache, its symbols are no part of it.
    sizes = np.where(cached, alphabet, _GREEN), np.full(tiles, 256), np.full(tiles, DISTANCE_CODES)
    tables, texts = zip(*(_codes(h, n) for h, n in zip(histograms, sizes, strict=True)), strict=True)
    alpha = np.arange(tiles), np.full(tiles, 11 << 16 | OPAQUE_CODE)

    # The fields of a token: its green code, then red and blue, or the copy's extra bits and distance.
    fields = np.zeros((len(token), 4), np.int32)
    fields[:, 0] = tables[0][which, green]
    fields[literal, 1], fields[literal, 2] = tables[1][which[literal], red[literal]], tables[1][which[literal], blue[literal]]
    fields[copied, 1], fields[copied, 2], fields[copied, 3] = size_bits << 16 | size_extra, tables[2][which[copied], dist_code], dist_bits << 16 | dist_extra
    owner, fields = (np.concatenate(x) for x in zip(texts[0], texts[1], texts[1], alpha, texts[2], (np.repeat(which, 4), fields.ravel()), strict=True))
    used = np.flatnonzero(fields >= 1 << 16)
    owner = owner[used].astype(np.uint16)
    order = np.argsort(owner, kind="stable")
    owner, fields = owner[order], fields[used[order]].astype(np.int64)
    n = fields >> 16
    bits_each = np.bincount(owner, weights=n, minlength=tiles).astype(np.int64)
    head_bits = np.array([w.n for w in heads])
    words = (head_bits + bits_each + 31) // 32 + 1
    first_word = np.cumsum(words) - words
    place = np.cumsum(n) - n + (first_word * 32 + head_bits - (np.cumsum(bits_each) - bits_each))[owner]
    # Codes do not overlap, and a word with its overhang has under 53 bits: sums of doubles are exact.
    sums = np.bincount(place >> 5, weights=((fields & 0xFFFF) << (place & 31)).astype(np.float64), minlength=int(words.sum())).astype(np.uint64)
    packed = (sums & _U(0xFFFFFFFF)).astype("<u4")
    packed[1:] |= (sums[:-1] >> _U(32)).astype("<u4")
    flat = packed.view(np.uint8)
    out = []
    for k, w in enumerate(heads):
        head = np.frombuffer(w.to_bytes(), np.uint8)
        at = int(first_word[k]) * 4
        flat[at : at + len(head)] |= head
        out.append(flat[at : at + (int(head_bits[k] + bits_each[k]) + 7) // 8].tobytes())
    return out


def _lengths(counts: np.ndarray) -> np.ndarray:
    """Code lengths of at most ``TABLE_BITS`` of each row's symbols: Shannon's, then the most frequent symbols are
    shortened as long as the code allows, until it is complete. A single symbol has length 1."""
    used = np.count_nonzero(counts, axis=1)
    most = max(1, int(used.max()))
    order = np.argsort(-counts, axis=1, kind="stable")[:, :most]
    c = np.take_along_axis(counts, order, 1)
    some = c > 0
    n = np.where(some, np.clip(np.ceil(np.log2(np.maximum(c.sum(1, keepdims=True), 1) / np.maximum(c, 1))), 1, TABLE_BITS), 0).astype(np.int64)
    whole = 1 << TABLE_BITS
    total = np.where(some, whole >> n, 0).sum(1)
    while (total > whole).any():
        for j in range(most - 1, -1, -1):
            longer = (total > whole) & some[:, j] & (n[:, j] < TABLE_BITS)
            n[longer, j] += 1
            total[longer] -= whole >> n[longer, j]
    while (open_rows := (total < whole) & (used > 1)).any():
        for j in range(most):
            unit = whole >> n[:, j]
            shorter = open_rows & some[:, j] & (total + unit <= whole)
            n[shorter, j] -= 1
            total[shorter] += unit[shorter]
    out = np.zeros_like(counts)
    np.put_along_axis(out, order, n, 1)
    return out


#: How code lengths are written: a fixed code of 3 bits for no code and for length 8, 4 bits for the others in use.
_META = {s: 3 if s in (0, 8) else 4 for s in (*range(12), 17, 18)}
_META_CODES = canonical([_META.get(s, 0) for s in range(19)])


def _meta_head() -> list[int]:
    w = Writer()
    w.put(0, 1)
    w.put(15 - 4, 4)
    for s in CODE_LENGTH_ORDER[:15]:
        w.put(_META.get(s, 0), 3)
    w.put(0, 1)  # lengths of the whole alphabet follow
    return [min(16, w.n - k) << 16 | w.value >> k & 0xFFFF for k in range(0, w.n, 16)]


_META_HEAD = np.array(_meta_head())
_META_FIELD = np.array([_META_CODES[s][1] << 16 | _META_CODES[s][0] if s in _META_CODES else 0 for s in range(19)])


def _codes(counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(code of each row's symbols as bits << 16 | code, (row, field) of the text of each row's code); ``sizes`` are the
    rows' alphabets."""
    rows, alphabet = counts.shape
    used = np.count_nonzero(counts, axis=1)
    last = np.where(used > 0, alphabet - 1 - (counts[:, ::-1] > 0).argmax(1), 0)
    lengths = _lengths(counts)
    # Canonical codes: the share of the code that shorter and lesser symbols take, most significant bit first.
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol]
    order = np.lexsort((symbol, n, row))
    row, symbol, n = row[order], symbol[order], n[order]
    units = (1 << TABLE_BITS) >> n
    before = np.cumsum(units) - units
    first = np.searchsorted(row, np.arange(rows))
    before -= np.append(before, 0)[np.minimum(first, len(before))][row]
    table = np.zeros((rows, alphabet), np.int64)
    table[row, symbol] = np.where(used[row] > 1, n << 16 | _reversal(TABLE_BITS)[before & ((1 << TABLE_BITS) - 1)], 0)

    simple = (used <= 1) & (last < 256)
    at = np.flatnonzero(simple)
    owners, places, fields = [at], [np.zeros(len(at), np.int64)], [11 << 16 | 0b101 | last[at] << 3]
    at = np.flatnonzero(~simple)
    if len(at):
        # Runs of equal lengths over the rows' alphabets; only runs of zeros are written as runs.
        flat = lengths[at]
        inside = np.arange(alphabet) < sizes[at, None]
        row, symbol = np.nonzero(inside)
        value = flat[row, symbol]
        edge = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
        size, value, row = np.diff(np.append(edge, len(value))), value[edge], row[edge]
        alone = (value > 0) | (size < 3)
        pieces = np.where(alone, size, (size + 137) // 138)
        run = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        # Pieces of a long run are of 138 but for the last two, so that none is under 3.
        rest = size[run] - 138 * nth
        piece = np.where(rest > 138, np.where(rest < 141, 135, 138), rest)
        after = (nth > 0) & (size[run] - 138 * (nth - 1) < 141) & (size[run] - 138 * (nth - 1) > 138)
        piece = np.where(after, size[run] - 138 * (nth - 1) - 135, piece)
        alone = alone[run]
        first_field = np.where(alone, _META_FIELD[np.where(alone, value[run], 0)], _META_FIELD[np.where(piece >= 11, 18, 17)])
        second = np.where(alone, 0, np.where(piece >= 11, 7 << 16 | piece - 11, 3 << 16 | piece - 3))
        owner = at[row[run]]
        owners += [np.repeat(at, len(_META_HEAD)), np.repeat(owner, 2)]
        places += [np.tile(np.arange(len(_META_HEAD)), len(at)), 100 + np.arange(2 * len(run))]
        fields += [np.tile(_META_HEAD, len(at)), np.stack([first_field, second], 1).ravel()]
    owner, place, field = np.concatenate(owners), np.concatenate(places), np.concatenate(fields)
    order = np.lexsort((place, owner))
    return table, (owner[order], field[order])


class _Lane:
    """A stream that can be decoded in step with others: its cache and transforms, read up to its prefix codes."""

    def __init__(self, number: int, stream: bytes):
        self.number, self.reader = number, Reader(stream)
        r = self.reader
        self.width, self.height, self.coded, self.transforms = read_head(r)
        self.pixels = self.coded * self.height
        self.cache_bits = r.read(4) if r.read(1) else 0
        self.ready = not r.read(1)  # else groups
        self.alphabet = _GREEN + (1 << self.cache_bits if self.cache_bits else 0)
        self.pos = r.pos

    def read_codes(self) -> np.ndarray | None:
        """The tables of the green, red, blue and distance codes; None where a code is too long or alpha is not plain."""
        r, tables = self.reader, []
        r.pos = self.pos
        for c, alphabet in enumerate((self.alphabet, 256, 256, 256, DISTANCE_CODES)):
            lengths = np.array(read_lengths(r, alphabet))
            if c == 3:
                if np.count_nonzero(lengths) != 1 or not lengths[255]:
                    return None
            elif lengths.max() > TABLE_BITS or not lengths.any():
                return None
            else:
                tables.append(_tables(lengths[None])[0])
        self.pos = r.pos
        return np.stack(tables)


def _tables(lengths: np.ndarray) -> np.ndarray:
    """Symbol and, above it, code length by the next bits, for each row of code lengths."""
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol]
    alone = np.bincount(row, minlength=len(lengths))[row] == 1  # takes no bits
    n = np.where(alone, 0, n)
    order = np.lexsort((symbol, n, row))
    row, symbol, n = row[order], symbol[order], n[order]
    share = (1 << TABLE_BITS) >> n
    if (np.bincount(row, weights=share, minlength=len(lengths)) != 1 << TABLE_BITS).any():
        raise ValueError("prefix code is not complete")
    entries = np.repeat((n << 16 | symbol).astype(np.int32), share).reshape(len(lengths), -1)
    return np.take(entries, _reversal(TABLE_BITS), axis=1)  # reversing bits twice changes nothing


_META_BITS = sum(int(f) >> 16 for f in _META_HEAD)
_META_VALUE = sum((int(f) & 0xFFFF) << 16 * k for k, f in enumerate(_META_HEAD))
_META_TABLE = np.zeros(16, np.int64)
for _s, (_b, _n) in _META_CODES.items():
    for _rest in range(0, 16, 1 << _n):
        _META_TABLE[_rest | _b] = _n << 8 | _s


def _read_lengths(windows: np.ndarray, pos: np.ndarray, alphabets: np.ndarray, only: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code lengths by lane, places after them, which lanes could be read) of the lanes ``only``: codes as ``_codes``
    writes them, normal ones by the fixed code of lengths or simple ones of one symbol, read in all lanes together."""
    seven = np.int64(7)
    lengths = np.zeros((len(pos), int(alphabets.max())), np.int64)
    pos = pos.copy()
    ahead = windows[pos >> 3] >> (pos & seven).view(np.uint64)
    normal = only & ((ahead & _U((1 << _META_BITS) - 1)) == _U(_META_VALUE))
    simple = only & ((ahead & _U(7)) == _U(0b101))
    at = np.flatnonzero(simple)
    symbol = (ahead[at] >> _U(3) & _U(255)).view(np.int64)
    if (symbol >= alphabets[at]).any():
        raise ValueError("a symbol is beyond its alphabet")
    lengths[at, symbol] = 1
    pos[at] += 11
    live = np.flatnonzero(normal)
    pos[live] += _META_BITS
    done = np.zeros(len(pos), np.int64)
    while len(live):
        p = pos[live]
        ahead = (windows[p >> 3] >> (p & seven).view(np.uint64)).view(np.int64)
        entry = _META_TABLE[ahead & 15]
        s, n = entry & 255, entry >> 8
        run = s >= 16
        extra = np.where(run, np.where(s == 17, 3, 7), 0)
        size = np.where(run, (ahead >> n & ((1 << extra) - 1)) + np.where(s == 17, 3, 11), 1)
        one = live[~run]
        lengths[one, done[one]] = s[~run]
        done[live] += size
        pos[live] += n + extra
        if (done[live] > alphabets[live]).any():
            raise ValueError("code lengths run over the alphabet")
        live = live[done[live] < alphabets[live]]
    return lengths, pos, normal | simple


def _read_codes(lanes: list[_Lane], windows: np.ndarray, starts: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tables of the four codes by lane, places of the pixels, which lanes can be decoded in step)."""
    count = len(lanes)
    begin = starts * 8 + np.array([x.pos for x in lanes])
    green, red_at, good = _read_lengths(windows, begin, np.array([x.alphabet for x in lanes]), np.ones(count, bool))
    red, blue_at, more = _read_lengths(windows, red_at, np.full(count, 256), good)
    good &= more
    size = blue_at - red_at
    for k in np.flatnonzero(good).tolist():  # blue's code must be written as red's
        a, b, n = int(red_at[k]), int(blue_at[k]), int(size[k])
        x, y = (int.from_bytes(data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7) & ((1 << n) - 1) for p in (a, b))
        good[k] = x == y
    alpha_at = np.where(good, blue_at + size, begin)
    good &= (windows[alpha_at >> 3] >> (alpha_at & np.int64(7)).view(np.uint64) & _U(0x7FF)) == _U(OPAQUE_CODE)
    distance, pos, more = _read_lengths(windows, np.where(good, alpha_at + 11, begin), np.full(count, DISTANCE_CODES), good)
    good &= more
    tables = np.zeros((count, 4, 1 << TABLE_BITS), np.int32)
    at = np.flatnonzero(good)
    if len(at):
        tables[at, 0], tables[at, 1], tables[at, 3] = _tables(green[at]), _tables(red[at]), _tables(distance[at])
        tables[at, 2] = tables[at, 1]
    for k in np.flatnonzero(~good).tolist():
        if (found := lanes[k].read_codes()) is not None:
            tables[k], pos[k], good[k] = found, starts[k] * 8 + lanes[k].pos, True
    return tables, pos, good


def decode_tiles(streams: list[bytes]) -> list[np.ndarray]:
    """The RGB samples (height, width, 3) of each stream."""
    out: list[np.ndarray | None] = [None] * len(streams)
    order = sorted(range(len(streams)), key=lambda k: -len(streams[k]))  # streams of like size keep step longest
    for at in range(0, len(order), LANES):
        lanes = []
        for k in order[at : at + LANES]:
            lane = _Lane(k, streams[k])
            if lane.ready:
                lanes.append(lane)
            else:
                out[k] = decode(streams[k])[..., :3]
        lanes.sort(key=lambda x: -x.pixels)
        if not lanes:
            continue
        try:
            for k, samples in _decoded(lanes, streams):
                out[k] = samples
        except IndexError:
            raise ValueError("a stream ends too early") from None
    return out


def _decoded(lanes: list[_Lane], streams: list[bytes]):
    """(number, RGB samples) of the lanes' streams."""
    data = b"".join(streams[x.number] + b"\0" * 16 for x in lanes)
    starts = np.cumsum([0, *(len(streams[x.number]) + 16 for x in lanes[:-1])])
    windows = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    tables, pos, good = _read_codes(lanes, windows, starts, data)
    for k in np.flatnonzero(~good).tolist():
        yield lanes[k].number, decode(streams[lanes[k].number])[..., :3]
    kept = np.flatnonzero(good)
    lanes = [lanes[k] for k in kept]
    if lanes:
        stop = starts[kept] * 8 + np.array([len(streams[x.number]) * 8 for x in lanes])
        for lane, found in zip(lanes, _in_step(lanes, windows, tables[kept].ravel(), pos[kept], stop), strict=True):
            rgba = found.astype("<u4").view(np.uint8).reshape(lane.height, lane.coded, 4)[..., _RGBA]
            yield lane.number, np.ascontiguousarray((invert(rgba, lane.transforms) if lane.transforms else rgba)[..., :3])


def _in_step(lanes: list[_Lane], windows: np.ndarray, table: np.ndarray, pos: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """ARGB pixels of each stream; lanes are in descending order of their pixels."""
    count, steps = len(lanes), lanes[0].pixels
    pixels = np.array([x.pixels for x in lanes])
    size = 1 << TABLE_BITS
    base = np.arange(count) * (4 * size)
    near = np.stack([_near(x.coded) for x in lanes])
    # A lane without a cache has one slot that nothing reads.
    cache_size = np.array([1 << x.cache_bits for x in lanes])
    cache_at = np.cumsum(cache_size) - cache_size
    cache = np.zeros(int(cache_size.sum()), np.int64)
    shift = np.array([32 - x.cache_bits for x in lanes])
    caching = bool((cache_size > 1).any())
    out = np.zeros((steps, count), np.int64)
    left, far = np.zeros(count, np.int64), np.zeros(count, np.int64)
    active = count - np.searchsorted(pixels[::-1], np.arange(steps), side="right")
    mask, seven = _U(size - 1), np.int64(7)
    for step in range(steps):
        n = int(active[step])
        p, b = pos[:n], base[:n]
        ahead = windows[p >> 3] >> (p & seven).view(np.uint64)
        entry = table[b + (ahead & mask).view(np.int64)].astype(np.int64)
        green, used = entry & 0xFFFF, entry >> 16
        special = np.flatnonzero((green >= 256) | (left[:n] > 0))
        after = ahead >> used.view(np.uint64)
        entry = table[b + ((after & mask).view(np.int64) + size)].astype(np.int64)
        total = entry >> 16
        after = after >> total.view(np.uint64)
        value = (entry & 0xFFFF) << 16 | green << 8 | OPAQUE
        entry = table[b + ((after & mask).view(np.int64) + 2 * size)].astype(np.int64)
        value |= entry & 0xFFFF
        total += entry >> 16
        total += used
        if len(special):
            going, symbol = left[special] > 0, green[special]
            fresh = special[~going & (symbol >= 256) & (symbol < _GREEN)]
            if len(fresh):
                more, code = ahead[fresh] >> used[fresh].view(np.uint64), green[fresh] - 256
                extra = _EXTRA[code]
                left[fresh] = _BASE[code] + (more.view(np.int64) & ((1 << extra) - 1))
                more = more >> extra.view(np.uint64)
                entry = table[base[fresh] + ((more & mask).view(np.int64) + 3 * size)].astype(np.int64)
                more = more >> (entry >> 16).view(np.uint64)
                code = entry & 0xFFFF
                beyond = _EXTRA[code]
                distance = _BASE[code] + (more.view(np.int64) & ((1 << beyond) - 1))
                distance = np.where(distance > 120, distance - 120, near[fresh, np.minimum(distance, 120)])
                far[fresh] = distance
                if (distance > step).any() or (step + left[fresh] > pixels[fresh]).any():
                    raise ValueError("a back-reference leaves the image")
                pos[fresh] += used[fresh] + extra + (entry >> 16) + beyond
            cached = special[~going & (symbol >= _GREEN)]
            if len(cached):
                value[cached] = cache[cache_at[cached] + green[cached] - _GREEN]
                total[cached] = used[cached]
            copying = special[left[special] > 0]
            if len(copying):
                value[copying] = out[step - far[copying], copying]
                left[copying] -= 1
                total[copying] = 0
        p += total
        out[step, :n] = value
        if caching:
            cache[cache_at[:n] + ((value * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift[:n])] = value
    if (pos > stop).any():
        raise ValueError("the stream ends too early")
    return [out[: x.pixels, k] for k, x in enumerate(lanes)]
