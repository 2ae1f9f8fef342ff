"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has 256 coordinates. In round i below 256 each shingle hashes to one coordinate and a value; in round 256 + j
each shingle hashes to coordinate j. A coordinate keeps the least (round, value) it has met, and rounds end once
every coordinate is filled; the last 256 rounds guarantee that. Coordinates of two sketches agree with the sets'
similarity as probability, with concentration as for independent minima, in near-linear time for any set size.

Equal sets collapse first (by digest, an aggregation with map-side combine). Representatives are banded; in each
bucket every member is paired with one leader: the member that shares most buckets over all, so that the centre of a
group of near copies leads it. Pairs are verified on full shingle sets of whole texts. Where the verified links leave
a bucket with several components, pairs between these components are verified too; the join that finds them drops pairs
whose finer sketches (2048 one-bit coordinates) are 4.75 standard deviations too far apart and repeats of a pair in
further buckets, so that no bucket is expanded into all of its pairs.

Defined results: null texts and texts without words have an empty set, link with nothing and are kept; a null id is
its own component (null) and is kept; rows of one id are one document, whose text is the least of theirs, and each of
them has its values; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_few, map_columns, text_rows
from .components import components

COORDINATES = 256
#: Chance that banding misses a pair exactly at the threshold.
MISS = 1e-5
#: Ids (8 bytes each) that may be broadcast to thin out the text side of the verification join.
BROADCAST_IDS = 1_000_000

#: Coordinates of the finer sketch that thins out the pairs between components, one bit each, and how many standard
#: deviations below the threshold a pair may look before it is dropped unverified.
FINE, FINE_DEVIATIONS = 2048, 4.75

#: Members of a bucket that are compared as one matrix side.
BLOCK = 128

_U = np.uint64
_C1, _C2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


_SEEDS = mix(np.arange(1, 2 * FINE + 1, dtype=np.uint64) * _GOLD)


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, words separated by ASCII white space: bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; the whole sequence is one if it is shorter."""
    import xxhash

    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    size = min(n, width)
    acc = np.full(n - size + 1, _U(size), np.uint64)
    for k in range(size):
        acc = mix(acc * _GOLD + hashed[k : n - size + 1 + k])
    return np.unique(acc)


def sketch(hashes: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """``size`` (a power of two) coordinates of a non-empty set, each a round and, below it, a value."""
    bits = size.bit_length() - 1
    value_bits = 63 - 2 * bits
    low, at_round, at_bin = _U((1 << value_bits) - 1), _U(value_bits), _U(64 - bits)
    out = np.zeros(size, np.uint64)
    empty = np.ones(size, bool)
    start, n = 0, len(hashes)
    while start < size and empty.any():
        rounds = min(size - start, max(1, 2 * size // n))
        x = mix(hashes[None, :] ^ _SEEDS[start : start + rounds, None])
        number = np.arange(start, start + rounds, dtype=np.uint64)[:, None] << at_round
        packed = np.sort(((x >> at_bin) << at_bin | number | (x & low)).ravel())
        bins = (packed >> at_bin).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        bins, packed = bins[first], packed[first]
        new = empty[bins]
        out[bins[new]] = packed[new] & _U((1 << (64 - bits)) - 1)
        empty[bins] = False
        start += rounds
    for j in np.flatnonzero(empty):
        out[j] = _U(size + j) << at_round | (mix(hashes ^ _SEEDS[size + j]) & low).min()
    return out


def fine_code(hashes: np.ndarray) -> np.ndarray:
    """One scrambled bit of each coordinate of the finer sketch, packed into 64-bit words."""
    return np.packbits((mix(sketch(hashes, FINE)) & _U(1)).astype(np.uint8)).view(np.int64)


def fine_distance(percent: int, bits: int = FINE) -> int:
    """Differing bits, of so many, up to which two codes may belong to a pair at the threshold."""
    differ = (1 - percent / 100) / 2
    return int(bits * differ + FINE_DEVIATIONS * (bits * differ * (1 - differ)) ** 0.5)


def rows_per_band(threshold: float) -> int:
    """The most rows a band may have for a pair at the threshold to be missed with a chance below MISS."""
    return max(r for r in range(1, 33) if (1 - threshold**r) ** (COORDINATES // r) <= MISS or r == 1)


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    bands = COORDINATES // rows
    part = coordinates[: bands * rows].reshape(bands, rows)
    acc = _SEEDS[:bands].copy()
    for k in range(rows):
        acc = mix(acc * _GOLD + part[:, k])
    return acc.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    rows = rows_per_band(percent / 100)

    def make():
        def fn(ids, texts):
            for i, text in zip(ids, texts, strict=True):
                s = shingle_set(text, width)
                if len(s) and i is not None:
                    yield i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(sketch(s), rows)
                else:
                    yield i, len(s), None, None

        return fn

    return map_columns(docs, make, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _codes(named: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    rows = rows_per_band(percent / 100)
    texts = docs.join(broadcast_if_few(named, BROADCAST_IDS), "doc_id", "left_semi")

    def make():
        def fn(ids, texts):
            for i, text in zip(ids, texts, strict=True):
                s = shingle_set(text, width)
                yield i, band_keys(sketch(s), rows).tobytes(), fine_code(s).tobytes()

        return fn

    return map_columns(texts, make, "doc_id long, bands binary, code binary", 64)


def _close_pairs(members: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """Pairs (a > b) of one bucket but two components whose codes are close, each in the first bucket it shares.

    Buckets are cut into blocks of about ``BLOCK`` members; each two blocks of a bucket are one row, made from the
    bucket's size and joined by bucket and block, and are compared as matrices: no task holds a large bucket, and no
    pair becomes a row before it has passed.
    """
    sizes = work.keep(members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")))
    number = F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int")
    blocks = members.join(sizes, "key").groupBy("key", number.alias("block")).agg(F.collect_list(F.struct("doc_id", "component", "bands", "code")).alias("m"))
    blocks = work.keep(blocks)
    two = sizes.select("key", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("b_block")).select("key", F.explode(F.sequence(F.lit(0), "b_block")).alias("a_block"), "b_block")
    left, right = (blocks.select("key", F.col("block").alias(f"{s}_block"), *[F.col(f"m.{c}").alias(f"{s}_{c}") for c in ("doc_id", "component", "bands", "code")]) for s in "ab")
    pairs = two.join(left, ["key", "a_block"]).join(right, ["key", "b_block"])
    pairs = pairs.select("key", *[f"a_{c}" for c in ("block", "doc_id", "component", "bands", "code")], *[f"b_{c}" for c in ("block", "doc_id", "component", "bands", "code")])

    def make():
        most = fine_distance(percent)

        def words(coded, kind="<u8"):  # bitwise_count would take the absolute value of signed numbers
            return np.frombuffer(b"".join(coded), kind).reshape(len(coded), -1)

        def fn(keys, a_blocks, a_ids, a_of, a_bands, a_codes, b_blocks, b_ids, b_of, b_bands, b_codes):
            for k, key in enumerate(keys):
                i, j = np.array(a_ids[k]), np.array(b_ids[k])
                x, y = words(a_codes[k]), words(b_codes[k])
                p, q = words(a_bands[k], "<i8"), words(b_bands[k], "<i8")
                for at in range(0, len(i), 128):
                    part = slice(at, at + 128)
                    differ = np.bitwise_count(x[part, None, :] ^ y[None, :, :]).sum(2, dtype=np.int32)
                    near = (differ <= most) & (np.array(a_of[k])[part, None] != np.array(b_of[k])[None, :])
                    if a_blocks[k] == b_blocks[k]:
                        near &= i[part, None] > j[None, :]
                    for u, v in zip(*np.nonzero(near), strict=True):
                        same = p[at + u] == q[v]
                        if p[at + u][same.argmax()] == key:
                            yield int(max(i[at + u], j[v])), int(min(i[at + u], j[v]))

        return fn

    return map_columns(pairs, make, "a long, b long", 8)


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, work: Workspace) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar. Only texts that a pair names are shuffled.

    Both joins read plain shuffles (``docs`` has a row an id), so adaptive execution can split a leader's many pairs.
    """
    ids = [pairs.select(F.col(c).alias("doc_id")).distinct() for c in ("a", "b")]
    named = broadcast_if_few(work.keep(ids[0].unionByName(ids[1]).distinct()), BROADCAST_IDS)
    texts = docs.join(named, "doc_id", "left_semi")

    def make():
        last: dict = {}

        def shingles(i, text):
            if i not in last:
                if len(last) > 8:
                    last.clear()
                last[i] = shingle_set(text, width)
            return last[i]

        def fn(a, b, a_text, b_text):
            for x, y, s, t in zip(a, b, a_text, b_text, strict=True):
                if similar(shingles(y, t), shingle_set(s, width), percent):
                    yield x, y

        return fn

    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    return map_columns(both.select("a", "b", "a_text", "b_text"), make, "a long, b long", 64)


def links(reps: DataFrame, docs: DataFrame, width: int, percent: int, work: Workspace) -> DataFrame:
    """(node, component) of the representatives (doc_id, bands) that have a verified link."""
    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = work.keep(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = work.keep(rows.join(shared, "key"))
    weight = rows.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    weighted = rows.join(weight, "doc_id")
    leaders = weighted.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("leader"))
    led = work.keep(rows.join(work.keep(leaders), "key"))
    first = work.keep(led.where("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct())
    edges = work.keep(_verified(first, docs, width, percent, work))
    labels = components(edges, work)

    # What the leaders leave open: buckets that still hold several components.
    named = led.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = work.keep(named)
    split = work.keep(named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"))
    # Both sides are plain tables: adaptive execution can split a hot bucket.
    open_rows = work.keep(named.where("n > 2 and doc_id <> leader").join(split, "key").select("key", "doc_id", "component"))

    codes = work.keep(_codes(work.keep(open_rows.select("doc_id").distinct()), docs, width, percent))
    close = _close_pairs(work.keep(open_rows.join(codes, "doc_id")), percent, work)
    more = work.keep(close.join(first, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        edges = work.keep(edges.unionByName(_verified(more, docs, width, percent, work)))
        labels = components(edges, work)
    return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest id reachable) and kept."""
    work = Workspace(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col, null_as=None)
    sets = work.keep(_sets(rows, width, percent))
    texts = rows.where("doc_id is not null and text is not null")
    repeated = not sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        one = work.keep(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")))
        texts = one.where("text is not null")
        sets = work.keep(_sets(one.unionByName(rows.where("doc_id is null")), width, percent))
    classes = work.keep(sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = sets.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").where("bands is not null").select("doc_id", "bands")
    labels = links(reps, texts, width, percent, work)
    classes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))
    if repeated:
        again = rows.where("doc_id is not null").select("doc_id").join(out, "doc_id")
        out = again.unionByName(out.where("doc_id is null"))
    return out


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all columns; rows without id or words all stay."""
    found = Workspace(docs.sparkSession).keep(near_duplicates(docs, width, percent, id_col, text_col))
    gone = broadcast_if_few(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), BROADCAST_IDS)
    out = docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    # Of the rows of one id the one of least text stays, as the others do not count above.
    first = F.struct(F.col(text_col).isNull().alias("none"), F.col(text_col).alias("text"), F.xxhash64(*docs.columns).alias("hash"))
    one = out.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min_by(F.struct(*docs.columns), first).alias("row"))
    return one.select("row.*").unionByName(out.where(F.col(id_col).isNull()))
