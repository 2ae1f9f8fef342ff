import hashlib
import zlib

import numpy as np
import pytest

from attestor.llm import media as P
from attestor.llm import webp as W
from attestor.llm import webp_tiles as B


def pictures():
    rng = np.random.default_rng(2)
    for t in range(24):
        h, w = rng.integers(1, 20), rng.integers(1, 24)
        im = rng.integers(0, [256, 4, 2][t % 3], (h, w, 4)).astype(np.uint8)
        if t % 2:
            im[..., 3] = 255
        yield t, im


def test_every_tool_round_trips():
    for t, im in pictures():
        tools = [{}, {"predictor": -1}, {"predictor": t % 14}, {"cross": (-3, 17, 100)}, {"subtract_green": True}, {"cache_bits": 1 + t % 11}, {"group_bits": 2}, {"back_references": False}, {"predictor": 11, "cross": (1, -90, 3), "subtract_green": True, "cache_bits": 6, "group_bits": 3}]
        if len(np.unique(im.reshape(-1, 4), axis=0)) <= 256:
            tools += [{"palette": True}, {"palette": True, "predictor": 2, "cache_bits": 3}]
        for kw in tools:
            stream = W.encode(im, **kw)
            assert (W.decode(stream) == im).all(), kw
            assert (B.decode_tiles([stream])[0] == im[..., :3]).all(), kw


def test_batches_equal_single_streams():
    rng = np.random.default_rng(4)
    images = [b" " * 192, b"ab" * 96, bytes(range(192)), bytes(range(256)) * 3, *(bytes(rng.choice(list(b"theaner .,"), 192 * int(n)).tolist()) for n in rng.integers(1, 64, 20))]
    streams = B.encode_tiles(images, 64)
    for stream, image, found in zip(streams, images, B.decode_tiles(streams), strict=True):
        assert found.tobytes() == image
        assert W.decode(stream)[..., :3].tobytes() == image


def test_distance_map():
    assert W.distance_map()[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)]
    assert len(set(W.distance_map())) == 120 and W.distance_map()[-1] == (8, 7)


def test_bad_streams():
    with pytest.raises(ValueError):
        W.decode(b"\x00" * 10)
    with pytest.raises(ValueError):
        P.unriff(b"RIFFxxxxJUNK")
    with pytest.raises(ValueError):
        W.decode(B.encode_tiles([b"abc" * 64], 64)[0][:8])


def test_frame(spark):
    long = "Größe " * 20_000
    rows = [(1, None, 5), (2, "", 5), (None, "a\x00b😀", 6), (3, long, 7), (3, long, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media long")
    stored = P.encode_texts(df)
    found = P.media_digests(stored).collect()
    assert len(found) == 5
    for r in found:
        data = {1: "", 2: "", None: "a\x00b😀", 3: long}[r.doc_id].encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len({(r.media_sha256, r.feature) for r in found}) == 3
    samples = {r.doc_id: r for r in P.decode_media(stored).collect()}
    assert (samples[None].width, samples[None].height) == (64, 1) and bytes(samples[3].samples).startswith(long.encode())
    assert P.media_digests(P.encode_texts(df.where("false"))).count() == 0


def test_query_streams_use_every_tool(spark):
    """The streams of the operator itself, by the tools that their texts call for."""
    rng = np.random.default_rng(8)
    letters = [chr(c) for c in range(33, 127)]
    texts = {
        "predictor": "".join(chr(33 + (k // 3 + k * k // 9000) % 94) for k in range(6000)),
        "cross": "".join(a + b + a for a, b in zip(rng.choice(letters, 1500), rng.choice(letters, 1500), strict=True)),
        "green": "".join(a * 3 for a in rng.choice(letters, 1500)),
        "palette": "".join(rng.choice(["abc", "dpe", "xyz", "m8k"], 1500)),
        "copies": "the same line again and again\n" * 100,
        "cache": "".join(rng.choice(["".join(rng.choice(letters, 3)) for _ in range(90)], 2000)),
    }
    stored = P.encode_texts(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string"))
    used: dict = {}
    for r in stored.collect():
        streams = W.unriff(bytes(r.media))
        found = B.decode_tiles(streams)
        assert b"".join(x.tobytes() for x in found) == P.payload(list(texts.values())[r.doc_id])
        assert all((W.decode(s)[..., :3] == x).all() for s, x in zip(streams, found, strict=True))
        for s in streams:
            lane = B._Lane(0, s)
            assert lane.ready
            tools = {t[0] for t in lane.transforms} | ({"cache"} if lane.cache_bits else set()) | ({"copies"} if len(set(lane.read_codes()[3] & 0xFFFF)) > 1 else set())
            used.setdefault(list(texts)[r.doc_id], set()).update(tools)
    assert W.PREDICTOR in used["predictor"] and W.CROSS_COLOUR in used["cross"] and W.SUBTRACT_GREEN in used["green"]
    assert W.PALETTE in used["palette"] and "cache" in used["cache"]
    assert any("copies" in tools for tools in used.values())


def test_prose_takes_fewer_bytes():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(2, 9)))) for _ in range(150)]
    text = " ".join(rng.choice(words, 6000))
    tiles = [P.payload(text)[k : k + 12288] for k in range(0, len(text), 12288)]
    plain = [W.encode(np.dstack([np.frombuffer(t, np.uint8).reshape(-1, 64, 3), np.full((len(t) // 192, 64), 255, np.uint8)]), back_references=False) for t in tiles]
    assert sum(map(len, B.encode_tiles(tiles, 64))) < 0.95 * sum(map(len, plain))


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    from attestor.llm.common import slices

    texts = ["a" * n for n in (5, 5, 50, 1, 1, 1, 1)] + [None]
    batch = pa.record_batch({"id": pa.array(range(8)), "text": pa.array(texts)})
    assert [p.column(1).to_pylist() for p in slices(batch, 3, 10)] == [texts[:2], texts[2:3], texts[3:6], texts[6:]]
    assert [p.num_rows for p in slices(batch, 3, None)] == [3, 3, 2] and list(slices(batch.slice(0, 0), 3, 10)) == []
