"""Byte-level BPE encoding and decoding through DuckDB queries inside each partition.

Encoding: each distinct piece of a partition is a run of token-position rows, at first one row a byte. A recursive
query joins neighbouring rows with the merge table, contracts each piece's leftmost pair of minimum rank, and goes on
until no piece has a pair left. Decoding: the ids of a batch of documents are rows that join the vocabulary, and an
ordered aggregation puts the bytes of each document together.

The merge table has each split of a vocabulary entry into two entries, so contraction order follows ranks alone, as
the tiktoken library does. A piece that is itself an entry is that token. Pieces over ``LONG_PIECE`` bytes would need
as many recursion steps as bytes, each over all of their rows; the same contraction runs on them with a heap.

Defined results: a null text counts as an empty one and has no ids; repeated rows are encoded each on its own; an
empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

from pyspark.sql import DataFrame

from .common import map_columns, text_rows

#: Bytes above which a piece is contracted with a heap.
LONG_PIECE = 1000
#: Bytes of new pieces in one recursive query.
QUERY_BYTES = 100_000
#: Pieces remembered in a task; beyond this the memory starts anew.
REMEMBERED = 400_000
#: Ids decoded by one query.
DECODE_IDS = 150_000
SLICE_ROWS = 256

# A position is counted over all pieces of a query, with a gap after each piece, so that stop = next pos holds only
# inside a piece. A pair is one integer: rank (20 bits), position (22), bytes of its left and right token (8 each).
_ENCODE = """
WITH RECURSIVE step(piece, pos, id, stop, live) AS (
    SELECT piece, pos, id, pos + 1, true FROM start
    UNION ALL
    SELECT piece, pos, id, stop, live FROM (
        WITH pair AS (
            SELECT s.piece, ((m.id::BIGINT * 4194304 + s.pos) * 256 + (s.stop - s.pos)) * 256 + (n.stop - n.pos) AS packed
            FROM step s JOIN step n ON n.pos = s.stop JOIN merges m ON m.ab = s.id * 1048576::BIGINT + n.id
            WHERE s.live AND n.live
        ), best AS (
            SELECT piece, packed // 274877906944 AS id, (packed // 65536) % 4194304 AS pos,
                   (packed // 65536) % 4194304 + (packed // 256) % 256 AS gone, packed % 256 AS right_bytes
            FROM (SELECT piece, min(packed) AS packed FROM pair GROUP BY piece)
        )
        SELECT s.piece, s.pos, CASE WHEN s.pos = b.pos THEN b.id::INTEGER ELSE s.id END AS id,
               CASE WHEN s.pos = b.pos THEN (b.gone + b.right_bytes)::INTEGER ELSE s.stop END AS stop, b.piece IS NOT NULL AS live
        FROM step s LEFT JOIN best b ON b.piece = s.piece
        WHERE s.live AND (b.piece IS NULL OR s.pos <> b.gone)
    )
)
SELECT piece, list(id ORDER BY pos) AS ids FROM step WHERE NOT live GROUP BY piece ORDER BY piece
"""

_DECODE = "SELECT doc, string_agg(v.text, '' ORDER BY t.pos) AS text FROM ids t JOIN vocabulary v ON v.id = t.id GROUP BY doc ORDER BY doc"


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]


def contract(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction for one long piece: a heap of (rank, position) over a linked list of tokens."""
    n = len(piece)
    if piece in ranks:
        return [ranks[piece]]
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by token start: its end, the start of the one before
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    live = bytearray(b"\1") * n
    while heap:
        rank, k, stop = heapq.heappop(heap)
        if not live[k] or end[k] >= n or end[end[k]] != stop:
            continue
        gone = end[k]
        live[gone], end[k] = 0, stop
        if stop < n:
            before[stop] = k
            if (r := ranks.get(piece[k : end[stop]])) is not None:
                heapq.heappush(heap, (r, k, end[stop]))
        if (b := before[k]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : end[k]]])
        k = end[k]
    return out


class Codec:
    """Vocabulary, merge table and piece memory of one task, with its DuckDB connection."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        if max(i for _, i in ranks) >= 1 << 20 or max(len(w) for w, _ in ranks) > 255:
            raise ValueError("the queries hold ids below 2**20 and entries of up to 255 bytes")
        self.ranks = dict(ranks)
        self.split = regex.compile(pattern).findall
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.known: dict[str, bytes] = {}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self.pa = pa
        triples = [(self.ranks[w[:k]], self.ranks[w[k:]], i) for w, i in ranks for k in range(1, len(w)) if w[:k] in self.ranks and w[k:] in self.ranks]
        words = pa.table({"id": pa.array([i for _, i in ranks], pa.int32()), "text": [w.decode("latin-1") for w, _ in ranks]})
        for name, table in (("merges", pa.table({"ab": pa.array([a << 20 | b for a, b, _ in triples], pa.int64()), "id": pa.array([i for _, _, i in triples], pa.int32())})), ("vocabulary", words)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _query(self, sql: str, name: str, table):
        self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _recurse(self, pieces: list[str]) -> None:
        import numpy as np

        coded = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.asarray(self.byte_ids, np.int32)[np.frombuffer(b"".join(coded), np.uint8)]
        got = self._query(_ENCODE, "start", self.pa.table({"piece": np.repeat(np.arange(len(coded), dtype=np.int32), sizes), "pos": (np.arange(len(ids)) + np.repeat(np.arange(len(coded)), sizes)).astype(np.int32), "id": ids}))
        flat = got["ids"].combine_chunks()
        offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy().astype("<u4")
        for k, piece in enumerate(pieces):
            self.known[piece] = values[offsets[k] : offsets[k + 1]].tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces not met before: entries directly, the others by recursion in bounded batches."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(pieces)
        batch: list[str] = []
        size = 0
        for p in sorted(new, key=len):
            coded = p.encode()
            if (rank := self.ranks.get(coded)) is not None:
                self.known[p] = rank.to_bytes(4, "little")
            elif len(coded) > LONG_PIECE:
                self.known[p] = array("I", contract(coded, self.ranks)).tobytes()
            else:
                batch.append(p)
                size += len(coded)
                if size >= QUERY_BYTES:
                    self._recurse(batch)
                    batch, size = [], 0
        if batch:
            self._recurse(batch)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.split(t) for t in texts]
        self.learn(set().union(*pieces))
        known = self.known.__getitem__
        return [b"".join(map(known, p)) for p in pieces]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each id sequence; documents over ``DECODE_IDS`` are decoded in runs of that many ids."""
        import numpy as np

        out: list[list[bytes]] = [[] for _ in ids]
        runs: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            nonlocal runs, size
            if runs:
                sizes = np.array([len(r) // 4 for _, r in runs])
                starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
                values = np.frombuffer(b"".join(r for _, r in runs), "<u4").astype(np.int32)
                got = self._query(_DECODE, "ids", self.pa.table({"doc": np.repeat(np.arange(len(runs), dtype=np.int32), sizes), "pos": (np.arange(len(values)) - starts).astype(np.int32), "id": values}))
                for (k, _), text in zip(runs, got["text"].to_pylist(), strict=True):
                    out[k].append(text.encode("latin-1"))
            runs, size = [], 0

        for k, coded in enumerate(ids):
            for at in range(0, len(coded), 4 * DECODE_IDS):
                run = coded[at : at + 4 * DECODE_IDS]
                runs.append((k, run))
                size += len(run) // 4
                if size >= DECODE_IDS:
                    flush()
        flush()
        return [b"".join(x) for x in out]


def bpe(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again: counts and digests, and the ids themselves if asked for.

    ``vocabulary`` is the path of a rank file read on the driver (its size is that of a vocabulary, not of the data)
    and shipped with the tasks. ``decoded_sha256`` is the digest of the bytes decoded from the ids.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_ranks(vocabulary))

    def make():
        import numpy as np

        codec = Codec(shipped.value, pattern)

        def fn(ids, texts):
            encoded = codec.encode(texts)
            for i, coded, decoded in zip(ids, encoded, codec.decode(encoded), strict=True):
                row = (i, len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(decoded).hexdigest())
                yield (*row, np.frombuffer(coded, "<u4").astype(np.int32)) if with_ids else row

        return fn

    return map_columns(text_rows(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, SLICE_ROWS)
