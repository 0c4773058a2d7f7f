"""Small pictures as files: PNG out, NumPy panoramas and PNG in; mosaics."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SIGN = b"\x89PNG\r\n\x1a\n"


def png_bytes(rgb: np.ndarray) -> bytes:
    """An 8-bit PNG of (height, width, 3) values in [0, 1]."""
    a = np.clip(np.nan_to_num(rgb) * 255, 0, 255).astype(np.uint8)
    h, w, _ = a.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], 1)

    def block(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGN + block(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + block(b"IDAT", zlib.compress(rows.tobytes())) + block(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, 3) values in [0, 1] of an 8-bit RGB or RGBA PNG without interlacing; an error for others."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError("the CRC of a PNG block does not match")
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    w, h, depth, colour, _, _, lace = head
    if depth != 8 or colour not in (2, 6) or lace:
        raise ValueError("this kind of PNG is not read")
    c = 3 if colour == 2 else 4
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.int32)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1] if y else np.zeros(w * c, np.int32)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            for x in range(w * c):
                a, b, d = (out[y, x - c] if x >= c else 0), up[x], (up[x - c] if x >= c else 0)
                p = a + b - d
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                out[y, x] = (line[x] + {1: a, 3: (a + b) // 2, 4: near}[int(kind)]) & 255
    return out.reshape(h, w, c)[..., :3] / 255.0


def framebuffer(image: DataFrame, height: int, width: int) -> np.ndarray:
    """A picture (y, x, r, g, b) as an array; absent pixels are black. A picture is small; a larger one than its frame is an error."""
    rows = image.select("y", "x", "r", "g", "b").limit(height * width + 1).collect()
    if len(rows) > height * width:
        raise ValueError("more pixels than the frame has")
    out = np.zeros((height, width, 3))
    for r in rows:
        out[r.y, r.x] = r.r, r.g, r.b
    return out


def mosaic(pictures: Sequence[np.ndarray], gap: int = 4) -> np.ndarray:
    """Pictures of one height side by side on black."""
    space = np.zeros((pictures[0].shape[0], gap, 3))
    return np.concatenate([p for q in pictures for p in (q, space)][:-1], 1)


def read_pictures(spark: SparkSession, path: str, step: int = 1) -> DataFrame:
    """(file, y, x, r, g, b) of .npy panoramas and PNG photographs, one file a task; every ``step``-th row and column."""

    def run(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = np.load(io.BytesIO(data), allow_pickle=False).astype(float) if p.endswith(".npy") else png_pixels(data)
                a = (a[..., None].repeat(3, 2) if a.ndim == 2 else a)[::step, ::step]
                y, x = np.mgrid[: a.shape[0], : a.shape[1]]
                cols = [pa.array([p] * y.size), pa.array(y.ravel().astype(np.int32)), pa.array(x.ravel().astype(np.int32)), *[pa.array(a[..., i].ravel()) for i in range(3)]]
                yield pa.RecordBatch.from_arrays(cols, names=["file", "y", "x", "r", "g", "b"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, y int, x int, r double, g double, b double")
