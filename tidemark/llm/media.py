"""Images in columns: Netpbm and BMP decoded to arrays, resized by area, written as NPY tiles, hashed.

Arrays are height x width x channels of 8 bits. A resized sample is the mean over the area of
the source that it covers, parts of samples by their share, from an integral image. The
difference hash compares neighbours of the 9 x 8 grey image.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 64
_SPACE = b" \t\n\r\x0b\x0c"


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with up to 8 bits a sample; others raise ValueError."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    at, head = 2, []
    while len(head) < (2 if kind in (b"P1", b"P4") else 3):
        while data[at : at + 1] and data[at : at + 1] in _SPACE:
            at += 1
        if data[at : at + 1] == b"#":
            end = data.find(b"\n", at)
            at = len(data) if end < 0 else end + 1
            continue
        end = at
        while end < len(data) and data[end] not in _SPACE and data[end : end + 1] != b"#":
            end += 1
        head.append(int(data[at:end]))
        at = end
    width, height, top = head[0], head[1], head[2] if len(head) > 2 else 1
    if not 0 < top < 256:
        raise ValueError("over 8 bits a sample")
    n = width * height * (3 if kind in (b"P3", b"P6") else 1)
    if kind in (b"P4", b"P5", b"P6"):
        at += 1
        if kind == b"P4":
            row = -(-width // 8)
            bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)[:, :width]
            return ((1 - bits) * 255).reshape(height, width, 1)
        x = np.frombuffer(data, np.uint8, n, at)
    else:
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        if kind == b"P1":
            x = np.frombuffer(body.translate(None, _SPACE), np.uint8)[:n] - 48
            return ((1 - x) * 255).astype(np.uint8).reshape(height, width, 1)
        x = np.array(body.split()[:n], np.int64)
    if len(x) < n:
        raise ValueError("too few samples")
    x = x if top == 255 else ((x.astype(np.int64) * 255 + top // 2) // top).astype(np.uint8)
    return x.astype(np.uint8, copy=False).reshape(height, width, -1)


def encode_netpbm(x: np.ndarray) -> bytes:
    """P5 of one channel, P6 of three."""
    return b"P%d\n%d %d\n255\n" % (5 if x.shape[2] == 1 else 6, x.shape[1], x.shape[0]) + np.ascontiguousarray(x).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4 or 8 bits with a palette, 24 or 32 bits; others raise ValueError."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    first, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (1, 4, 8, 24, 32) or packed not in (0, 3) or width <= 0 or not height:
        raise ValueError("a kind of BMP that isn't read")
    row = (width * bits + 31) // 32 * 4
    x = np.frombuffer(data, np.uint8, row * abs(height), first).reshape(abs(height), row)
    x = x[::-1] if height > 0 else x
    if bits >= 24:
        return x[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()
    if bits < 8:
        x = np.unpackbits(x, axis=1)
        x = x if bits == 1 else (x.reshape(abs(height), -1, 4) @ np.array([8, 4, 2, 1], np.uint8)).astype(np.uint8)
    n = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(-1, 4)[:, 2::-1]
    return palette[x[:, :width]]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(x: np.ndarray) -> np.ndarray:
    return x[:, :, :1] if x.shape[2] == 1 else np.rint(x @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)[:, :, None]


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over areas, rounded half up (what is below a half by rounding errors alone too), by an integral image."""
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1, x.shape[2]))
    total[1:, 1:] = x.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def at(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.arange(m + 1) * n / m
        lo = np.minimum(edge.astype(np.int64), n - 1)
        return lo, lo + 1, edge - lo

    a, b, s = at(x.shape[0], height)
    rows = total[a] * (1 - s)[:, None, None] + total[b] * s[:, None, None]
    a, b, s = at(x.shape[1], width)
    both = rows[:, a] * (1 - s)[None, :, None] + rows[:, b] * s[None, :, None]
    area = x.shape[0] * x.shape[1] / height / width
    return np.clip(np.floor(np.diff(np.diff(both, axis=0), axis=1) / area + 0.5 + 1e-9), 0, 255).astype(np.uint8)


def difference_hash(x: np.ndarray) -> str:
    """64 bits in hexadecimal: is a sample of the 8 rows of 9 brighter than the one left of it?"""
    small = resize(grey(x), 8, 9)[:, :, 0].astype(np.int64)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(x), allow_pickle=False)
    return out.getvalue()


def read_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def tiles(df: DataFrame, media: str, id_col: str, size: int = 64) -> DataFrame:
    """id, tile (size x size x channels as NPY), hash, height, width of every row. What can't be decoded, or is null or empty: nulls."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("id", "tile", "hash", "height", "width")}
            for i, data in zip(b["id"].to_pylist(), b["media"].to_pylist(), strict=True):
                try:
                    x = decode(data or b"")
                    row = (i, npy(resize(x, size, size)), difference_hash(x), x.shape[0], x.shape[1])
                except (ValueError, struct.error, IndexError):
                    row = (i, None, None, None, None)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            yield out

    return common.map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(media).cast("binary").alias("media")), run, "id long, tile binary, hash string, height int, width int")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each row's text in UTF-8, with bytes 0 behind it to a positive multiple of 64, as the samples of a grey P5 image 64 wide."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = common.text_bytes(b["text"])
            images = [np.frombuffer(t.ljust(max(1, -(-len(t) // WIDTH)) * WIDTH, b"\0"), np.uint8).reshape(-1, WIDTH, 1) for t in texts]
            yield {"doc_id": b["doc_id"], "n_bytes": [len(t) for t in texts], "media": [encode_netpbm(x) for x in images]}

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media binary")


def digest(docs: DataFrame) -> DataFrame:
    """Null text is empty: one row of 64 zeros. feature: the difference hash, then a crc32 of the 16 x 16 tile."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for d, n, data in zip(b["doc_id"].to_pylist(), b["n_bytes"].to_pylist(), b["media"].to_pylist(), strict=True):
                x = decode(data)
                payload = x.tobytes()
                feature = f"{difference_hash(x)}{zlib.crc32(npy(resize(x, 16, 16))):08x}"
                row = (d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            yield out

    return common.map_batches(store(docs), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


#: What is stored and read back, in DuckDB.
PAYLOADS = f"""with d as (select doc_id, encode(coalesce(text, '')) as t from documents), n as (select doc_id, t, octet_length(t) as n_bytes, greatest(1, ceil(octet_length(t) / {WIDTH}))::bigint * {WIDTH} as m from d),
p as (select doc_id, n_bytes, m, t || unhex(repeat('00', m - n_bytes)) as p, encode('P5' || chr(10) || '{WIDTH} ' || (m // {WIDTH}) || chr(10) || '255' || chr(10)) as head from n)
select doc_id, n_bytes, m as payload_bytes, sha256(p) as payload_sha256, octet_length(head || p) as media_bytes, sha256(head || p) as media_sha256 from p"""


def payload_rows(docs: DataFrame) -> DataFrame:
    return digest(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")
