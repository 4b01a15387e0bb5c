import hashlib
import struct
import zlib

import numpy as np
import pytest

from tidemark.llm import media as M


def test_netpbm():
    x = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (M.decode(M.encode_netpbm(x)) == x).all() and (M.decode(M.encode_netpbm(x[:, :, :1])) == x[:, :, :1]).all()
    assert M.decode(b"P2 # c\n2 1 15\n0 15 # x\n").ravel().tolist() == [0, 255]
    assert M.decode(b"P1\n3 2\n101\n0 1 0").ravel().tolist() == [0, 255, 0, 255, 0, 255]
    assert M.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).ravel().tolist() == [0, 255, 0, 255, 0, 255]
    assert M.decode(b"P3\n1 1\n255\n1 2 3\n").ravel().tolist() == [1, 2, 3]
    for bad in (b"", b"P7", b"P5\n2 2\n65535\n", b"P5\n9 9\n255\nxx", b"BM"):
        with pytest.raises((ValueError, IndexError)):
            M.decode(bad)


def bmp(x: np.ndarray, bits: int, palette: bytes = b"", flip: bool = True) -> bytes:
    h, w = x.shape[:2]
    rows = [(r.tobytes()) + b"\0" * (-len(r.tobytes()) % 4) for r in (x[::-1] if flip else x)]
    head = struct.pack("<IiiHHIIiiII", 40, w if bits != 4 else w * 2, h if flip else -h, 1, bits, 0, 0, 0, 0, len(palette) // 4, 0)
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(palette)) + head + palette + b"".join(rows)


def test_bmp():
    x = np.arange(30, dtype=np.uint8).reshape(2, 5, 3)
    for flip in (True, False):
        assert (M.decode(bmp(x[:, :, ::-1].copy(), 24, flip=flip)) == x).all()
    colours = np.arange(12, dtype=np.uint8).reshape(3, 4)
    i = np.array([[0, 2, 1]], np.uint8)
    assert (M.decode(bmp(i, 8, colours.tobytes())) == colours[:, 2::-1][i]).all()
    assert (M.decode(bmp(np.array([[0x12]], np.uint8), 4, colours.tobytes())) == colours[:, 2::-1][[[1, 2]]]).all()


@pytest.mark.parametrize("shape", [(1, 64), (7, 5), (100, 64), (3, 200), (8, 9)])
def test_resize_is_the_mean_over_areas(shape):
    x = np.random.default_rng(1).integers(0, 256, (*shape, 2)).astype(np.uint8)
    fine = np.repeat(np.repeat(x.astype(float), 8, axis=0), 9, axis=1)
    want = fine.reshape(8, shape[0], 9, shape[1], 2).mean(axis=(1, 3))
    assert (abs(M.resize(x, 8, 9) - want) <= 0.51).all()


def test_digest(spark):
    texts = ["", None, "x" * 64, "é" * 33, "a\n" * 5000]
    rows = M.digest(spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)] + [(None, "", b"")], "doc_id long, text string, media binary")).collect()
    assert len(rows) == 6
    for r in rows:
        t = ((texts[r.doc_id] if r.doc_id is not None else "") or "").encode()
        p = t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
        assert r[1:5] == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) and len(r.feature) == 24
        stored = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
        assert r[5:7] == (len(stored), hashlib.sha256(stored).hexdigest())


def test_tiles(spark):
    x = np.arange(75, dtype=np.uint8).reshape(5, 5, 3)
    rows = {r.id: r for r in M.tiles(spark.createDataFrame([(1, M.encode_netpbm(x)), (2, b"junk"), (3, None)], "k long, m binary"), "m", "k", 4).collect()}
    assert (M.read_npy(bytes(rows[1].tile)) == M.resize(x, 4, 4)).all() and rows[1].height == 5
    assert rows[2].tile is None and rows[3].hash is None
