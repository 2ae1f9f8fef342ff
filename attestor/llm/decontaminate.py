"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping windows. If a window of m bytes occurs in a text with at most e edits, the two
share at least m + 1 - q(e + 1) q-grams, on diagonals no more than 2e apart. Shared q-grams are counted in overlapping
diagonal bands (each as wide as two steps of 2e + 1), bands under the bound are dropped, and the regions of the others
are verified by a banded alignment.

Texts are compared as UTF-8 with their case folded over Unicode and each run of ASCII white space and control bytes as
one space. Either can change the length of a text ("ß" and "SS" are both "ss"), so offsets of found places are mapped
back to those of the text (``char_offsets``). Equal windows, as of repeated items, are searched once. The q-gram index is
built on the driver from one chunk of the benchmark at a time; a chunk's size is bounded (``CHUNK_BYTES``), and a larger
benchmark takes more passes over the texts, each written before the next one's index is built.

Items under ``SHORT`` bytes leave no room for edits: an Aho-Corasick automaton finds them where they stand exactly and
as whole words.

Defined results: null and empty texts match nothing; null ids and texts of items match nothing, nor do items without
letters or digits; repeated rows are reported each on its own; an empty table on either side gives an empty table; only
the id and text columns are read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import Workspace, filter_rows, map_columns, text_rows

Q = 12
WINDOW, STRIDE, EDIT_RATE = 100, 50, 0.06
SHORT = 24
CHUNK_BYTES = 4_000_000
#: Shared q-grams, by window, that are counted at once.
COUNTED = 4_000_000
TABLE_BITS = 21

_U = np.uint64
_K1, _K2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_SPACES = bytes([*[32] * 33, *range(33, 256)])
_run, _letter = re.compile(rb"  +"), re.compile(rb"[0-9a-z\x80-\xff]")


def normal(text: str) -> bytes:
    """The bytes that are compared. Upper case first: letters whose capitals are equal ("ı" and "i") are equal too."""
    if not text.isascii():
        text = text.upper().casefold()
    return _run.sub(b" ", text.encode("utf-8", "surrogatepass").lower().translate(_SPACES))


def char_offsets(text: str, at: list[int]) -> list[int]:
    """The code points of ``text`` that end at or before each of the offsets ``at`` in ``normal(text)``."""
    if text.isascii() and len(normal(text)) == len(text):
        return list(at)
    parts = [normal(c) for c in text]  # the fold of a letter does not depend on its neighbours
    ends = np.cumsum([0 if c == before == b" " else len(c) for c, before in zip(parts, [b"", *parts])])
    return np.searchsorted(ends, at, side="right").tolist()


def budget(m: int) -> int:
    """Edits allowed in a window of m bytes: the rate, but never so many that the lemma's bound falls below 1."""
    return max(0, min(int(EDIT_RATE * m), (m - Q) // Q))


def windows(item: bytes) -> list[tuple[int, int]]:
    m = len(item)
    if m <= WINDOW:
        return [(0, m)]
    return [(s, s + WINDOW) for s in [*range(0, m - WINDOW, STRIDE), m - WINDOW]]


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the q bytes from each position on."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    low = np.ndarray((n,), "<u8", data, 0, (1,))
    high = np.ndarray((n,), "<u4", data, 8, (1,))
    out = low * _K1
    out ^= out >> _U(29)
    out += high * _K2
    out *= _K1
    return out


class Index:
    """Windows of some items and a posting list by q-gram."""

    def __init__(self, items: list[tuple[int, str]]):
        self.windows: list[bytes] = []
        self.items: list[list[tuple[int, int]]] = []  # by window: items that have it and the number of their windows
        self.short: dict[bytes, list[int]] = {}  # short items by their bytes
        number: dict[bytes, int] = {}
        hashes, owners, offsets = [], [], []
        for item_id, text in items:
            item = normal(text).strip()
            if len(item) < SHORT:
                if _letter.search(item):
                    self.short.setdefault(item, []).append(item_id)
                continue
            cut = {item[s:e] for s, e in windows(item)}
            for window in sorted(cut):
                k = number.setdefault(window, len(self.windows))
                if k == len(self.windows):
                    h = gram_hashes(window)
                    hashes.append(h)
                    owners.append(np.full(len(h), k, np.int32))
                    offsets.append(np.arange(len(h), dtype=np.int32))
                    self.windows.append(window)
                    self.items.append([])
                self.items[k].append((item_id, len(cut)))
        all_hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(all_hashes, kind="stable")
        sorted_hashes = all_hashes[order]
        self.owner, self.offset = (np.concatenate(x)[order] if hashes else np.empty(0, np.int32) for x in (owners, offsets))
        self.grams, self.first = np.unique(sorted_hashes, return_index=True)
        self.count = np.diff(np.append(self.first, len(sorted_hashes)))
        self.edits = np.array([budget(len(w)) for w in self.windows], np.int64)
        self.needed = np.array([max(1, len(w) + 1 - Q * (budget(len(w)) + 1)) for w in self.windows], np.int64)

    def table(self) -> np.ndarray:
        bits = np.zeros(1 << TABLE_BITS, np.uint8)
        bits[self.grams >> _U(64 - TABLE_BITS)] = 1
        return bits

    def automaton(self):
        """Finds the short items; None if there are none."""
        if not self.short:
            return None
        import ahocorasick

        found = ahocorasick.Automaton()
        for item in self.short:
            found.add_word(item.decode("latin-1"), item)
        found.make_automaton()
        return found


def whole_words(text: bytes, automaton):
    """(short item, start, end) of each place where one stands with no letter or digit of its own word around it."""
    for last, item in automaton.iter(text.decode("latin-1")):
        start, end = last + 1 - len(item), last + 1
        inside = _letter.match(item, 0) and start and _letter.match(text, start - 1)
        if not inside and not (_letter.match(item, len(item) - 1) and _letter.match(text, end)):
            yield item, start, end


def aligned(pattern: bytes, region: bytes, most: int, center: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``pattern`` in ``region`` within ``most`` edits, inside a band of
    diagonals around ``center`` (two steps and the edits on either side); the leftmost end of the best ones."""
    at = region.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    half = 2 * (2 * most + 1) + most
    n, far = len(region), most + 1
    lo_d, width = center - half, 2 * half + 1
    cols = np.arange(width)
    text = np.frombuffer(region, np.uint8)
    cost = np.where((lo_d + cols >= 0) & (lo_d + cols <= n), 0, far)  # row 0: the match may start anywhere
    start = lo_d + cols
    for i, c in enumerate(pattern):
        j = i + 1 + lo_d + cols  # end position in the region, by column
        valid = (j >= 1) & (j <= n)
        same = np.zeros(width, bool)
        same[valid] = text[j[valid] - 1] == c
        diagonal = np.where(valid, cost + ~same, far)
        up = np.append(cost[1:], far) + 1  # a pattern byte without a partner
        new = np.where(diagonal <= up, diagonal, up)
        new_start = np.where(diagonal <= up, start, np.append(start[1:], 0))
        for _ in range(most):  # region bytes without a partner, at most as many as edits
            left = np.append(far, new[:-1]) + 1
            better = (left < new) & (j >= 0) & (j <= n)
            if not better.any():
                break
            new_start = np.where(better, np.append(0, new_start[:-1]), new_start)
            new = np.where(better, left, new)
        new[(j < 0) | (j > n)] = far
        cost, start = np.minimum(new, far), new_start
        if cost.min() > most:
            return None
    k = int(cost.argmin())
    return (int(cost[k]), int(start[k]), len(pattern) + lo_d + k) if cost[k] <= most else None


def search(texts: list[bytes], index: Index, table: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(number of the text, window, edits, start, end) of each verified window, in byte offsets."""
    data = b"\0".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    hashes = gram_hashes(data)
    if not len(hashes) or not len(index.grams):
        return []
    at = np.flatnonzero(table[hashes >> _U(64 - TABLE_BITS)])
    found = hashes[at]
    k = np.minimum(np.searchsorted(index.grams, found), len(index.grams) - 1)
    true = index.grams[k] == found
    at, k = at[true], k[true]
    if not len(at):
        return []
    n = index.count[k]
    if len(texts) > 1 and n.sum() > COUNTED:
        half = len(texts) // 2
        return search(texts[:half], index, table) + [(t + half, *x) for t, *x in search(texts[half:], index, table)]
    posting = np.repeat(index.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
    window, offset, place = index.owner[posting].astype(np.int64), index.offset[posting].astype(np.int64), np.repeat(at, n)
    text = np.searchsorted(starts, place, side="right") - 1
    pair = text * len(index.windows) + window
    # Too few q-grams of a window in the whole text are too few in each band.
    ids, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
    enough = times[inverse] >= index.needed[window]
    window, offset, place, pair = window[enough], offset[enough], place[enough], pair[enough]
    if not len(pair):
        return []
    step = 2 * index.edits[window] + 1
    diagonal = place - offset
    band = diagonal // step
    pair, offset, band, step, window = (np.concatenate(x) for x in ((pair, pair), (offset, offset), (band, band - 1), (step, step), (window, window)))
    order = np.lexsort((offset, band, pair))
    pair, offset, band, step, window = pair[order], offset[order], band[order], step[order], window[order]
    new_band = np.r_[True, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])]
    new_gram = new_band | np.r_[True, offset[1:] != offset[:-1]]
    group = np.cumsum(new_band) - 1
    shared = np.bincount(group[new_gram])
    first = np.flatnonzero(new_band)
    out = {}
    for g in np.flatnonzero(shared >= index.needed[window[first]]):
        f = first[g]
        w, most, t = int(window[f]), int(index.edits[window[f]]), int(pair[f] // len(index.windows))
        pattern = index.windows[w]
        if out.get((t, w), (1,))[0] == 0:
            continue
        lo = max(0, int(band[f] * step[f] - starts[t]) - most)
        hi = min(int(sizes[t]), int((band[f] + 2) * step[f] - starts[t]) + len(pattern) + most)
        if got := aligned(pattern, texts[t][lo:hi], most, int((band[f] + 1) * step[f] - starts[t]) - lo):
            edits, s, e = got
            if (t, w) not in out or edits < out[t, w][0]:
                out[t, w] = (edits, lo + max(0, s), lo + e)
    return [(t, w, *x) for (t, w), x in sorted(out.items())]


def chunks(benchmark: DataFrame, id_col: str, text_col: str):
    """The items in lists of bounded size, read one after the other."""
    held, size = [], 0
    for r in text_rows(benchmark, id_col, text_col, null_as=None).where("doc_id is not null and text is not null").toLocalIterator():
        if held and size + len(r.text) > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append((r.doc_id, r.text))
        size += len(r.text)
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds, whole or in windows.

    doc_id, item_id, windows found, windows of the item, fewest and most edits of a found window, and the code points
    from the first found window's start to the last one's end.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, windows int, item_windows int, min_edits int, max_edits int, start_char long, end_char long"
    rows = text_rows(docs, id_col, text_col)

    def make(shipped):
        index = shipped.value
        table, automaton = index.table(), index.automaton()

        def fn(ids, texts):
            coded = [normal(t) for t in texts]
            by_item: dict = {}
            for t, w, edits, s, e in search(coded, index, table):
                for item_id, of in index.items[w]:
                    by_item.setdefault((t, item_id), {})[w] = (edits, s, e, of)
            if automaton is not None:
                for t, text in enumerate(coded):
                    for item, s, e in whole_words(text, automaton):
                        for item_id in index.short[item]:
                            by_item.setdefault((t, item_id), {}).setdefault(item, (0, s, e, 1))
            for (t, item_id), windows in sorted(by_item.items()):
                found = list(windows.values())
                chars = char_offsets(texts[t], [min(x[1] for x in found), max(x[2] for x in found)])
                yield ids[t], item_id, len(found), found[0][3], min(x[0] for x in found), max(x[0] for x in found), *chars

        return fn

    def one(items):
        shipped = spark.sparkContext.broadcast(Index(items))
        return map_columns(rows, lambda: make(shipped), schema, 256), shipped

    return _by_chunk(chunks(benchmark, item_id_col, item_text_col), one, lambda parts: _union(parts, spark, schema), Workspace(spark))


def _union(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _by_chunk(items, one, join, work: Workspace) -> DataFrame:
    """``join`` of the results of ``one`` (a table and its broadcast index). The result of one chunk stays a plan; of
    more, each is written before the next one's index is built."""
    parts, held = [], None
    for chunk in items:
        if held is not None:
            parts.append(work.keep(held[0]))
            held[1].destroy()
        held = one(chunk)
    if parts and held is not None:
        held = (work.keep(held[0]), None)
    return join([*parts, held[0]] if held else parts)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts hold no window of any benchmark item, with all their columns."""
    spark = docs.sparkSession
    rows = docs

    def make(shipped):
        index = shipped.value
        table, automaton = index.table(), index.automaton()

        def keep(texts):
            coded = [normal(x or "") for x in texts]
            found = {t for t, *_ in search(coded, index, table)}
            return [k not in found and (automaton is None or next(whole_words(x, automaton), None) is None) for k, x in enumerate(coded)]

        return keep

    work, shipped = Workspace(spark), None
    for items in chunks(benchmark, item_id_col, item_text_col):
        if shipped is not None:  # a further chunk: what the last one left is written first
            rows = work.keep(rows)
            shipped.destroy()
        shipped = spark.sparkContext.broadcast(Index(items))
        rows = filter_rows(rows, text_col, lambda shipped=shipped: make(shipped), 256)
    return rows
