"""Delta records and timelines of delta frames, as long rows (id, attr, val)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bits of the mask: name, struct code, count (fixed values of the format). Bit 9 holds k ids.
BITS = [("xyz", "f", 3), ("scale", "f", 3), ("quat", "f", 4), ("opacity", "f", 1), ("f_dc", "f", 3), ("f_rest", "f", 45), ("tier", "B", 1), ("germ", "f", 5), ("normal", "B", 4), ("neighbors", "I", None)]
HEAD, SEQ_HEAD, INDEX = struct.Struct("<8sB3xIII"), struct.Struct("<8sB3xIIIIii4x"), struct.Struct("<iH2xII")


def encode_delta(magic: bytes, base_crc: int, base_n: int, records: Iterable[tuple[int, dict[str, Sequence[float]]]]) -> bytes:
    """Bytes of a delta; every record has a mask of its own."""
    out, n = [], 0
    for i, attrs in records:
        mask = sum(1 << b for b, (name, _, _) in enumerate(BITS) if name in attrs)
        out.append(struct.pack("<IH", i, mask))
        for name, code, _ in BITS:
            if name in attrs:
                v = list(attrs[name])
                out.append(struct.pack(f"<{len(v)}{code}", *v))
        n += 1
    return HEAD.pack(magic, 1, base_crc, base_n, n) + b"".join(out)


def decode_delta(data: bytes, k: int = 4) -> tuple[int, int, list[tuple[int, str, list[float]]]]:
    """(base crc, base n, [(id, attr, values)])."""
    _, version, crc, n, count = HEAD.unpack_from(data)
    if version != 1:
        raise ValueError(f"delta version {version} is unknown")
    at, rows = HEAD.size, []
    for _ in range(count):
        i, mask = struct.unpack_from("<IH", data, at)
        at += 6
        for b, (name, code, size) in enumerate(BITS):
            if mask >> b & 1:
                s = struct.Struct(f"<{k if size is None else size}{code}")
                rows.append((i, name, [float(v) for v in s.unpack_from(data, at)]))
                at += s.size
    if at != len(data):
        raise ValueError("the delta's length does not match its records")
    return crc, n, rows


def encode_timeline(magic: bytes, base_crc: int, base_n: int, frames: Sequence[tuple[int, bytes]], fps_milli: int = 30000, compress: bool = True) -> bytes:
    """Bytes of a timeline; times must not fall."""
    times = [t for t, _ in frames]
    if any(b < a for a, b in zip(times, times[1:])):
        raise ValueError("times of frames must be monotone")
    at, index, body = SEQ_HEAD.size + INDEX.size * len(frames), [], []
    for t, d in frames:
        z = zlib.compress(d) if compress else d
        index.append(INDEX.pack(t, int(compress), at, len(z)))
        body.append(z)
        at += len(z)
    return SEQ_HEAD.pack(magic, 1, base_crc, base_n, len(frames), fps_milli, times[0] if times else 0, times[-1] if times else 0) + b"".join(index) + b"".join(body)


def decode_timeline(data: bytes) -> tuple[dict, list[tuple[int, int, bytes]]]:
    """(header, [(frame, time in ms, delta bytes)])."""
    _, version, crc, n, count, fps, t0, t1 = SEQ_HEAD.unpack_from(data)
    if version != 1:
        raise ValueError(f"timeline version {version} is unknown")
    frames = []
    for f in range(count):
        t, flags, at, size = INDEX.unpack_from(data, SEQ_HEAD.size + f * INDEX.size)
        d = data[at : at + size]
        frames.append((f, t, zlib.decompress(d) if flags & 1 else d))
    return {"base_crc": crc, "base_n": n, "fps_milli": fps, "time_start_ms": t0, "time_end_ms": t1}, frames


def read_timelines(spark: SparkSession, path: str, k: int = 4) -> DataFrame:
    """(file, frame, t_ms, id, attr, val): the patches of timeline files, one file a task."""

    def run(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(p, f, t, i, a, v) for f, t, d in decode_timeline(data)[1] for i, a, v in decode_delta(d, k)[2]]
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, kinds)], names=["file", "frame", "t_ms", "id", "attr", "val"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, frame int, t_ms int, id bigint, attr string, val array<double>")


def write_timelines(patches: DataFrame, path: str, delta_magic: bytes, magic: bytes, base_crc: int, base_n: int) -> DataFrame:
    """Writes a timeline of each ``file`` to a shared folder; (file, frames, bytes). An action on the result writes.

    ``patches``: (file, frame, t_ms, id, attr, val ARRAY<DOUBLE>), of one frame one value of
    an id and attribute. Frames come by their number and their times must not fall. A
    timeline is one file, so it is made in one task. A repeated attempt leaves the same file.
    """
    schema = pa.schema([("file", pa.string()), ("frames", pa.int32()), ("bytes", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        import os

        name = t.column("file")[0].as_py()
        frames: dict[int, tuple[int, dict]] = {}
        for f, ms, i, a, v in sorted(zip(*(t.column(c).to_pylist() for c in ("frame", "t_ms", "id", "attr", "val"))), key=lambda r: (r[0], r[2])):
            frames.setdefault(f, (ms, {}))[1].setdefault(i, {})[a] = [int(x) for x in v] if a in ("tier", "normal", "neighbors") else v
        data = encode_timeline(magic, base_crc, base_n, [(ms, encode_delta(delta_magic, base_crc, base_n, recs.items())) for _, (ms, recs) in sorted(frames.items())])
        os.makedirs(path, exist_ok=True)
        tmp = os.path.join(path, f".{name}.{os.getpid()}")
        with open(tmp, "wb") as out:
            out.write(data)
        os.replace(tmp, os.path.join(path, f"{name}.seq"))
        return pa.Table.from_arrays([pa.array([name]), pa.array([len(frames)], pa.int32()), pa.array([len(data)])], schema=schema)

    return patches.groupBy("file").applyInArrow(run, "file string, frames int, bytes bigint")


def side_chunk(payload: np.ndarray, aux: int = 0, version: int = 1) -> bytes:
    """A side table's chunk: version, aux, rows, payload, CRC."""
    body = struct.pack("<BBI", version, aux, len(payload)) + payload.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def read_side_chunk(data: bytes, dtype: str, width: int, version: int = 1) -> tuple[int, np.ndarray]:
    """(aux, rows); raises on another version, a wrong length or a wrong CRC."""
    v, aux, n = struct.unpack_from("<BBI", data)
    if v != version:
        raise ValueError(f"chunk version {v} is unknown")
    size = np.dtype(dtype).itemsize * width * n
    if len(data) != 10 + size:
        raise ValueError("the chunk's length does not match its rows")
    if struct.unpack_from("<I", data, 6 + size)[0] != zlib.crc32(data[: 6 + size]):
        raise ValueError("the chunk's CRC does not match")
    return aux, np.frombuffer(data, dtype, n * width, 6).reshape(n, width) if width > 1 else np.frombuffer(data, dtype, n, 6)
