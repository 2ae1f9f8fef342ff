"""Passages that repeat, by sparse suffix arrays.

A text is its sequence of words (separated by ASCII white space, A-Z in lower case). A suffix is retained only where
its first ``KEY`` words (its head) have the least hash among the word positions of some stretch of ``PASSAGE`` words,
so equal stretches retain the same place. Heads that one document alone has are dropped by an aggregation. The context
of a suffix is as many words to the right and to the left as its stretches reach; equal contexts (128-bit digests)
collapse, so that a repeated line or a common passage is one of them. The words of the contexts of a head meet in one
task and are put in order. Neighbours are compared word by word: the lengths they share to the right cut the order into
runs, and matches extend to the left by ordering the members of a run by the words before them, one more at a time. One
order alone would not do: the neighbour with the longest common right side need not share the left side.

A head of more than ``HOT`` contexts is held by no task: its stretches are matched by 128-bit digests in an aggregation
with map-side combine. Repeats inside a document are found while its text is read.

Equal texts collapse into one before, and each copy is one passage from end to end.

Defined results: one row for each row of the table; null texts and texts under ``PASSAGE`` words have no passages; a null
id has none either; rows of one id are one document, for which its text of least digest stands; a passage counts in
``n_spans`` if another document has it, in ``n_inner`` if its own document has it at two places (they may overlap); an
empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, arrow_schema, as_struct, broadcast_if_few, map_columns, release_memory, text_rows
from .minhash import mix, words_of

PASSAGE, KEY = 50, 16
BROADCAST_IDS = 1_000_000
#: Contexts of one head that are compared in one task; larger heads are matched by digests, in lists of about ``PART``.
HOT, PART = 512, 256
#: Contexts, in whole heads, whose words are compared at once.
CHUNK = 16_384
_SPACES = " \t\n\v\f\r"
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(text: str | None) -> np.ndarray:
    import xxhash

    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


@lru_cache(maxsize=64)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, _U(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def segment_hashes(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the words from each start up to each stop, by differences of a running polynomial."""
    size = 1 << len(hashes).bit_length()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * _powers(_BASE, size)[: len(hashes)], dtype=np.uint64)])
    return mix((sums[stops] - sums[starts]) * _powers(_INVERSE, size)[starts])


def stretch_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each position on."""
    at = np.arange(max(0, len(hashes) - size + 1))
    return segment_hashes(hashes, at, at + size)


def owners(hashes: np.ndarray, passage: int = PASSAGE, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """(the retained position that each stretch of ``passage`` words chooses, the hash of the key at each position)."""
    keys = stretch_hashes(hashes, key)
    if len(hashes) < passage:
        return np.empty(0, np.int64), keys
    view = np.lib.stride_tricks.sliding_window_view(keys, passage - key + 1)
    return view.argmin(1) + np.arange(len(view)), keys


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word in code points."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return chars[np.flatnonzero(edge == -1)], chars[np.flatnonzero(edge == 1)]


def word_table(rows: list[bytes], width: int, numbers: dict) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word of each row, -1 beyond its end; words a row). Equal words have equal numbers."""
    split = [r.split() for r in rows]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    table = np.full((len(rows), width), -1, np.int64)
    table[np.arange(width) < sizes[:, None]] = np.fromiter((numbers[w] for r in split for w in r), np.int64, int(sizes.sum()))
    return table, sizes


class Suffixes:
    """Suffixes in the order of their words: ``right`` begins with the suffix's own first word, ``left`` with the word
    before it. Stretches that start ``least`` to ``most`` words before the suffix retain it. ``low`` and ``high`` are the
    least and greatest documents that have the suffix with these words."""

    def __init__(self, right: list[bytes], left: list[bytes], least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray):
        numbers: dict = defaultdict()
        numbers.default_factory = numbers.__len__
        self.right, self.sizes = word_table(right, PASSAGE, numbers)
        self.left, _ = word_table(left, PASSAGE - KEY, numbers)
        self.least, self.most, self.low, self.high = least, most, low, high

    def common(self) -> np.ndarray:
        """Words that each suffix shares with its predecessor."""
        same = self.right[1:] == self.right[:-1]
        words = np.where(same.all(1), PASSAGE, same.argmin(1)) if len(same) else np.empty(0, np.int64)
        return np.concatenate([[0], np.minimum(words, np.minimum(self.sizes[1:], self.sizes[:-1]))])

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """By suffix: the stretches that two documents have, as bits by words to the left, and the least document that
        has one of them."""
        n = len(self.low)
        mask, first = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        common = self.common()
        before = np.zeros(n, np.int64)  # equal numbers: equal words to the left, as far as looked at
        base = int(max(self.left.max(initial=0), 0)) + 2
        for k in range(PASSAGE - KEY + 1):
            if k:
                before = np.unique(before * base + self.left[:, k - 1] + 1, return_inverse=True)[1]
            at = np.flatnonzero((self.least <= k) & (k <= self.most))
            if not len(at):
                continue
            match = np.cumsum(common < PASSAGE - k)[at] * (int(before.max()) + 1) + before[at]
            order = np.argsort(match, kind="stable")
            match, at = match[order], at[order]
            edge = np.flatnonzero(np.r_[True, match[1:] != match[:-1]])
            size = np.diff(np.append(edge, len(at)))
            low, high = np.minimum.reduceat(self.low[at], edge), np.maximum.reduceat(self.high[at], edge)
            shared = np.repeat(low < high, size)
            mask[at[shared]] |= 1 << k
            first[at[shared]] = np.minimum(first[at[shared]], np.repeat(low, size)[shared])
        return mask, first


_MATCHES = "c1 long, c2 long, mask long, first long"


def _matches(batches: Iterator[pa.RecordBatch], struct: T.StructType) -> Iterator[pa.RecordBatch]:
    """Shared stretches of contexts that come in the order of head and words; every head is whole."""
    schema = arrow_schema(struct)

    def compared(table: pa.Table) -> pa.RecordBatch:
        c = {c: table[c].to_numpy() for c in ("c1", "c2", "least", "most", "low", "high")}
        mask, first = Suffixes(table["right"].to_pylist(), table["left"].to_pylist(), c["least"], c["most"], c["low"], c["high"]).repeats()
        some = mask > 0
        return pa.RecordBatch.from_arrays([pa.array(x[some], type=f.type) for x, f in zip((c["c1"], c["c2"], mask, first), schema, strict=True)], schema=schema)

    held: list[pa.RecordBatch] = []
    size = 0
    for given in batches:
        held.append(given)
        size += given.num_rows
        if size < CHUNK:
            continue
        table = pa.Table.from_batches(held)
        keys = table["key"].to_numpy()
        if cut := int(np.searchsorted(keys, keys[-1], "left")):  # the last head may go on
            yield compared(table.slice(0, cut).combine_chunks())
            held, size = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if size:
        yield compared(pa.Table.from_batches(held).combine_chunks())
    release_memory()


def _words_of_contexts(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The words of contexts, looked up in one of the texts that have them (doc_id, digest, at)."""

    def make():
        def fn(ids, texts, digests, at):
            for i, text, digest, found in zip(ids, texts, digests, at, strict=True):
                if text_digest(text) == digest:  # else another text of the same id
                    words = words_of(text)
                    for x in found:
                        p, lo = x["place"], x["place"] - x["most"]
                        yield x["key"], b" ".join(words[p : p - x["least"] + PASSAGE]), b" ".join(words[lo:p][::-1]), x["least"], x["most"], x["low"], x["high"], x["c1"], x["c2"], x["n"]

        return fn

    return map_columns(texts.join(chosen.hint("merge"), "doc_id"), make, "key long, right binary, left binary, least int, most int, low long, high long, c1 long, c2 long, n long", 16)


def _hot_matches(contexts: DataFrame, work: Workspace) -> DataFrame:
    """Shared stretches of the contexts of heads that no task may hold."""

    def make():
        def fn(rights, lefts, leasts, mosts, lows, highs, c1s, c2s, ns):
            for right, left, least, most, low, high, c1, c2, n in zip(rights, lefts, leasts, mosts, lows, highs, c1s, c2s, ns, strict=True):
                words = left.split()[::-1] + right.split()
                for k in range(least, most + 1):
                    stretch = hashlib.blake2b(b" ".join(words[most - k : most - k + PASSAGE]), digest_size=16).digest()
                    yield stretch, c1 % -(-n // PART), c1, c2, low, high, k

        return fn

    given = contexts.select("right", "left", "least", "most", "low", "high", "c1", "c2", "n")
    stretches = work.keep(map_columns(given, make, "stretch binary, part long, c1 long, c2 long, low long, high long, k int"))
    equal = stretches.groupBy("stretch").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").select("stretch", "first")
    lists = stretches.groupBy("stretch", "part").agg(F.collect_list(F.struct("c1", "c2", "k")).alias("at"))
    found = lists.join(work.keep(equal), "stretch").select("first", F.explode("at").alias("s"))
    return found.groupBy("s.c1", "s.c2").agg(F.bit_or(F.expr("shiftleft(1L, s.k)")).alias("mask"), F.min("first").alias("first"))


def text_digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


def inner_repeats(hashes: np.ndarray) -> list[dict]:
    """Runs of stretches that the text has at two places, as word and words."""
    whole = stretch_hashes(hashes, PASSAGE)
    order = np.argsort(whole, kind="stable")
    alike = np.flatnonzero(whole[order[1:]] == whole[order[:-1]])
    hit = np.zeros(len(whole) + 2, np.int8)
    for a, b in zip(order[alike].tolist(), order[alike + 1].tolist(), strict=True):
        if (hashes[a : a + PASSAGE] == hashes[b : b + PASSAGE]).all():
            hit[a + 1] = hit[b + 1] = 1
    step = np.diff(hit)
    return [{"word": a, "words": b - a - 1 + PASSAGE} for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]


def merged(found) -> list[list[int]]:
    """Passages (word, words) as [first word, word after the last], those that overlap or adjoin in one."""
    spans: list[list[int]] = []
    for word, words in sorted((x["word"], x["words"]) for x in found):
        if spans and word <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], word + words)
        else:
            spans.append([word, word + words])
    return spans


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_spans, repeated_words, first_doc_id (least id that shares one of the passages), spans
    (``start:end`` in code points, comma-joined), and n_inner and inner_spans of repeats inside the document."""
    work = Workspace(docs.sparkSession)
    texts = text_rows(docs, id_col, text_col, null_as=None)

    def spelled(text, spans):
        starts, ends = word_bounds(text)
        return ",".join(f"{starts[a]}:{ends[b - 1]}" for a, b in spans)

    def retaining():
        def fn(ids, texts):
            for i, text in zip(ids, texts, strict=True):
                hashes = word_hashes(text)
                n = len(hashes)
                if n < PASSAGE or i is None:
                    yield i, n, None, None, None, None, None, None, None, None, None, 0, ""
                    continue
                owner, keys = owners(hashes)
                places, lo, count = np.unique(owner, return_index=True, return_counts=True)
                least, most = places - lo - count + 1, places - lo
                # Two hashes of the context's words; the second one also tells where in it the suffix lies.
                c1, c2 = (segment_hashes(hashes ^ _U(salt), lo, lo + count - 1 + PASSAGE) for salt in (1, 2))
                c2 = mix(c2 + (most * 64 + least).astype(np.uint64))
                inner = merged(inner_repeats(hashes))
                yield i, n, text_digest(text), len(text) - len(text.lstrip(_SPACES)), len(text.rstrip(_SPACES)), keys[places].view(np.int64), places.astype(np.int32), c1.view(np.int64), c2.view(np.int64), least.astype(np.int32), most.astype(np.int32), len(inner), spelled(text, inner) if inner else ""

        return fn

    sets = work.keep(map_columns(texts, retaining, "doc_id long, n_words long, digest binary, lo long, hi long, keys array<long>, places array<int>, c1 array<long>, c2 array<long>, least array<int>, most array<int>, n_inner long, inner_spans string"))
    rows, some_text = sets.drop("keys", "places", "c1", "c2", "least", "most"), texts.where("text is not null")
    long_texts = sets.where("digest is not null")
    if not sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        standing = long_texts.groupBy("doc_id").agg(F.min("digest").alias("digest"))
        long_texts = work.keep(long_texts.join(standing, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"]))
        rows = sets.select("doc_id", F.col("n_words").alias("own_words")).join(long_texts, "doc_id", "left").withColumn("n_words", F.coalesce("n_words", "own_words"))
        some_text = some_text.dropDuplicates(["doc_id", "text"])

    classes = work.keep(long_texts.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
    reps = long_texts.join(classes.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    columns = ("keys", "places", "c1", "c2", "least", "most")
    suffixes = reps.select("doc_id", F.explode(F.arrays_zip(*columns)).alias("s")).select("doc_id", F.col("s.keys").alias("key"), F.col("s.places").alias("place"), *[f"s.{c}" for c in columns[2:]])
    heads = suffixes.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key")
    shared = work.keep(heads)  # a plain table: adaptive execution can then split a hot head's suffixes
    suffixes = work.keep(suffixes.join(shared.hint("merge"), "key"))
    contexts = suffixes.groupBy("c1", "c2").agg(F.first("key").alias("key"), F.first("least").alias("least"), F.first("most").alias("most"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(F.struct("doc_id", "place")).alias("at"))
    contexts = work.keep(contexts.select("*", "at.doc_id", "at.place").drop("at"))
    several = work.keep(contexts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))

    def of(table: DataFrame) -> DataFrame:
        """The texts of the documents in ``table``: no other text is shuffled."""
        return some_text.join(broadcast_if_few(table.select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi")

    # Joins of tables that grow are merges at every size: what a small run shuffles tells what a large one will.
    # The one context of a head is shared as a whole; several ones are compared.
    whole = F.expr("shiftleft(1L, most + 1) - shiftleft(1L, least)")
    matches = contexts.join(several.select("key").hint("merge"), "key", "left_anti").select("c1", "c2", whole.alias("mask"), F.col("low").alias("first"))
    wanted = contexts.join(several.hint("merge"), "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "place", "least", "most", "low", "high", "c1", "c2", "n")).alias("at"))
    wanted = work.keep(wanted.join(long_texts.select("doc_id", "digest").hint("merge"), "doc_id").select("doc_id", "digest", "at"))
    words = _words_of_contexts(of(wanted), wanted)
    hot = not several.where(f"n > {HOT}").isEmpty()
    if hot:
        words = work.keep(words)
        matches = matches.unionByName(_hot_matches(words.where(f"n > {HOT}"), work))
        words = words.where(f"n <= {HOT}")
    struct = as_struct(_MATCHES)
    ordered = words.drop("n").repartition("key").sortWithinPartitions("key", "right")
    matches = work.keep(matches.unionByName(ordered.mapInArrow(lambda batches: _matches(batches, struct), struct)))
    placed = suffixes.select("doc_id", "place", "c1", "c2").join(matches.hint("merge"), ["c1", "c2"])
    by_rep = work.keep(placed.groupBy("doc_id").agg(F.min("first").alias("first"), F.collect_list(F.struct("place", "mask")).alias("found")))

    def placing():
        def fn(ids, texts, digests, firsts, found):
            for i, text, digest, first, x in zip(ids, texts, digests, firsts, found, strict=True):
                if text_digest(text) == digest:
                    spans = merged([{"word": y["place"] - k, "words": PASSAGE} for y in x for k in range(PASSAGE - KEY + 1) if y["mask"] >> k & 1])
                    yield i, first, len(spans), sum(b - a for a, b in spans), spelled(text, spans)

        return fn

    found = by_rep.join(long_texts.select("doc_id", "digest").hint("merge"), "doc_id")
    per_rep = map_columns(of(by_rep).join(found.hint("merge"), "doc_id").select("doc_id", "text", "digest", "first", "found"), placing, "rep long, first long, n long, words long, list string", 64)
    out = rows.join(classes.join(per_rep.hint("merge"), "rep", "left").hint("merge"), "digest", "left")
    copied = F.coalesce(F.col("rep") < F.col("last"), F.lit(False))
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copied, 1).otherwise(F.coalesce("n", none)).cast("long").alias("n_spans"),
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("words", none)).alias("repeated_words"),
        F.when(copied, F.least("rep", "first")).otherwise(F.col("first")).alias("first_doc_id"),
        F.when(copied, F.concat_ws(":", "lo", "hi")).otherwise(F.coalesce("list", F.lit(""))).alias("spans"),
        F.coalesce("n_inner", none).alias("n_inner"),
        F.coalesce("inner_spans", F.lit("")).alias("inner_spans"),
    )
