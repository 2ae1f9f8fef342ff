"""Texts as lossless WebP pictures, and the pictures' samples and features.

A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the samples of an RGB picture 64 pixels
wide (192 bytes a row), cut into tiles of at most 64 rows; the stored form is the tiles' WebP files one after the
other. A tile is written with back-references, and with the colour cache, palette, predictor, cross-colour or
subtract-green transform where they are likely to save bits; the decoder reads any lossless stream, many in step.

Defined results: a null text counts as an empty one, one row of spaces; repeated rows and equal texts give equal
values; texts longer than a tile give several; an empty table gives an empty table; only the id and text columns are
read. A stored form that is no lossless WebP raises an error.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, text_rows
from .webp import riff, unriff
from .webp_tiles import decode_tiles, encode_tiles

WIDTH, TILE_ROWS = 64, 64
ROW_BYTES = 3 * WIDTH
#: Rows and bytes of text that are coded together: many streams of like length keep step.
SLICE_ROWS, SLICE_BYTES = 4096, 16_000_000


def payload(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % ROW_BYTES if data else ROW_BYTES)


def feature(samples: np.ndarray) -> str:
    """Size, then sum, sum of squares and sum of absolute steps along rows of each channel, as integers."""
    a = samples.astype(np.int64)
    parts = [a.sum((0, 1)), (a * a).sum((0, 1)), np.abs(np.diff(a, axis=1)).sum((0, 1))]
    return f"{a.shape[1]}x{a.shape[0]};" + ";".join(",".join(map(str, p.tolist())) for p in parts)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text alone) and media (the stored WebP files) of each document."""

    def make():
        def fn(ids, texts):
            payloads = [payload(t) for t in texts]
            step = ROW_BYTES * TILE_ROWS
            tiles = [p[k : k + step] for p in payloads for k in range(0, len(p), step)]
            coded = iter(encode_tiles(tiles, WIDTH))
            for i, t, p in zip(ids, texts, payloads, strict=True):
                yield i, len(t.encode("utf-8", "surrogatepass")), b"".join(riff(next(coded)) for _ in range(0, len(p), step))

        return fn

    return map_columns(text_rows(docs, id_col, text_col), make, "doc_id long, n_bytes long, media binary", SLICE_ROWS, SLICE_BYTES)


def _decoded(media: list[bytes | None]):
    """The samples of each stored picture, its tiles one below the other."""
    streams = [unriff(m) if m else [] for m in media]
    tiles = iter(decode_tiles([s for x in streams for s in x]))
    for x in streams:
        rows = [next(tiles) for _ in x]
        yield np.concatenate(rows) if rows else np.zeros((0, WIDTH, 3), np.uint8)


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, width, height and samples (the pixel array as bytes, row by row, RGB) of each stored picture."""

    def make():
        def fn(ids, stored):
            for i, a in zip(ids, _decoded(stored), strict=True):
                yield i, a.shape[1], a.shape[0], a.tobytes()

        return fn

    return map_columns(media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")), make, "doc_id long, width int, height int, samples binary", SLICE_ROWS, SLICE_BYTES)


def media_digests(media: DataFrame) -> DataFrame:
    """Digests and features of pictures stored by ``encode_texts``, all from the samples read back."""

    def make():
        def fn(ids, sizes, stored):
            for i, n, m, a in zip(ids, sizes, stored, _decoded(stored), strict=True):
                data = a.tobytes()
                yield i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(a)

        return fn

    return map_columns(media.select("doc_id", "n_bytes", "media"), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", SLICE_ROWS, SLICE_BYTES)
