"""Tiered chunk containers: 11 bytes of magic, u64 manifest length, JSON manifest, zlib chunks.

``splatpack`` reads one row a splat, in ranges of rows of each file; only the chunks behind
the asked columns are decompressed, as streams of which a range keeps its own rows, and
every one is checked against its CRC. What a file holds follows from the two digits that
end its magic: plain coefficients (25), quantised ones with codebooks (27, 28), those with
exact residuals by tier and group (28, an exact archive) or as one payload in a layout of
its own (29). Side tables of splats (normals, edges, materials, curvature, cusps, germs)
follow as trailers 31 and 40. ``chunk_table`` lists the manifests alone.
``write_containers`` writes one file a partition.
"""

from __future__ import annotations

import glob
import json
import os
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cloudloom.functions.quant import SH_C0, SH_Q8_STEP, U24

#: Chunks (fixed names of the format) and the columns each gives.
CHUNKS = {
    "tier_labels_u8": ["tier"],
    "xyz_u24_fixed": ["x", "y", "z"],
    "dc_rgb_opacity_u8": ["dc_r", "dc_g", "dc_b", "alpha"],
    "scale_f16": ["sx", "sy", "sz"],
    "quat_i16_norm4": ["qw", "qx", "qy", "qz"],
    "sh_rest_q8_global": ["sh_q8"],
}
#: The other dialect's coefficients.
PLAIN = {"sh_rest_f32": ["sh_rest"]}
#: Side tables (fixed names and numbers of the format): trailer, chunk number, numbers a row, type, and the columns each gives.
SIDES = {
    "normals_oct24_tangent8": (31, 0x12, 4, "u1", ["nx", "ny", "nz", "tangent"]),
    "edges_knn_u32": (31, 0x13, None, "<u4", ["neighbors"]),
    "material_u8x4": (31, 0x14, 4, "u1", ["hint", "confidence", "view_dep", "mip"]),
    "kappa_u8": (40, 0x15, 1, "u1", ["kappa"]),
    "cusp_u8": (40, 0x16, 1, "u1", ["cusp"]),
    "germ_f16x5": (40, 0x17, 5, "<f2", ["germ"]),
}
SCHEMA = "file string, id bigint, tier int, x float, y float, z float, dc_r float, dc_g float, dc_b float, alpha float, sx float, sy float, sz float, qw float, qx float, qy float, qz float, sh_q8 array<int>, sh_rest array<float>, nx float, ny float, nz float, tangent float, neighbors array<bigint>, hint int, confidence int, view_dep int, mip int, kappa float, cusp float, germ array<float>"


def read_manifest(path: str) -> tuple[bytes, dict, int]:
    """(magic, manifest, offset of the payload)."""
    with open(path, "rb") as f:
        head = f.read(19)
        if len(head) < 19:
            raise ValueError(f"{path}: too short for a container")
        n = struct.unpack("<Q", head[11:])[0]
        text = f.read(n)
        if len(text) < n:
            raise ValueError(f"{path}: the manifest is cut off")
        return head[:11], json.loads(text), 19 + n


def read_chunk(path: str, entry: dict, payload: int, check: bool = True) -> bytes:
    with open(path, "rb") as f:
        f.seek(payload + entry["offset"])
        raw = zlib.decompress(f.read(entry["compressed_bytes"]))
    crc = entry.get("crc32_raw", entry.get("crc32"))
    if check and crc is not None and zlib.crc32(raw) != crc:
        raise ValueError(f"{path}: CRC of chunk {entry['name']} does not match")
    return raw


def decode_chunk(name: str, raw: bytes, entry: dict) -> dict[str, np.ndarray]:
    if name == "tier_labels_u8":
        return {"tier": np.frombuffer(raw, np.uint8).astype(np.int32)}
    if name == "xyz_u24_fixed":
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3, 3).astype(np.float64)
        lo, hi = np.array(entry["bounds_min"]), np.array(entry["bounds_max"])
        v = (b[..., 0] + 256 * b[..., 1] + 65536 * b[..., 2]) / U24 * (hi - lo) + lo
        return {c: v[:, i].astype(np.float32) for i, c in enumerate("xyz")}
    if name == "dc_rgb_opacity_u8":
        v = np.frombuffer(raw, np.uint8).reshape(-1, 4) / 255.0
        return {**{f"dc_{c}": ((v[:, i] - 0.5) / SH_C0).astype(np.float32) for i, c in enumerate("rgb")}, "alpha": v[:, 3].astype(np.float32)}
    if name == "scale_f16":
        v = np.frombuffer(raw, "<f2").reshape(-1, 3).astype(np.float32)
        return {c: v[:, i] for i, c in enumerate(("sx", "sy", "sz"))}
    if name == "quat_i16_norm4":
        v = np.frombuffer(raw, "<i2").reshape(-1, 4).astype(np.float32) / np.float32(32767)
        return {c: v[:, i] for i, c in enumerate(("qw", "qx", "qy", "qz"))}
    if name == "sh_rest_f32":
        return {"sh_rest": np.frombuffer(raw, "<f4").reshape(-1, 45)}
    return {"sh_q8": np.frombuffer(raw, np.int8).reshape(-1, 45).astype(np.int32)}


def version_of(magic: bytes) -> int:
    """The two digits that end the magic; an error for another file."""
    digits = magic.rstrip(b"\0")[-2:]
    if not digits.isdigit() or int(digits) not in (25, 27, 28, 29):
        raise ValueError(f"{magic!r} is no container that can be read")
    return int(digits)


def read_rows(path: str, entry: dict, payload: int, width: int, start: int, end: int, check: bool = True) -> bytes:
    """Rows start to end (of ``width`` bytes each) of a chunk: it is decompressed as a stream, and only these are kept."""
    crc, at, out, left = 0, 0, [], entry["compressed_bytes"]
    lo, hi, z = start * width, end * width, zlib.decompressobj()
    with open(path, "rb") as f:
        f.seek(payload + entry["offset"])
        while left > 0 and (check or at < hi):
            block = f.read(min(left, 1 << 18))
            if not block:
                raise ValueError(f"{path}: chunk {entry['name']} is cut off")
            left -= len(block)
            raw = z.decompress(block)
            crc = zlib.crc32(raw, crc)
            if at < hi and at + len(raw) > lo:
                out.append(raw[max(lo - at, 0) : hi - at])
            at += len(raw)
        raw = z.flush()
        crc = zlib.crc32(raw, crc)
        if at < hi and at + len(raw) > lo:
            out.append(raw[max(lo - at, 0) : hi - at])
    want = entry.get("crc32_raw", entry.get("crc32"))
    if check and want is not None and crc != want:
        raise ValueError(f"{path}: CRC of chunk {entry['name']} does not match")
    return b"".join(out)


def rows_in(path: str, manifest: dict) -> int:
    for e in manifest["chunks"]:
        if e["name"] in ("xyz_u24_fixed", "tier_labels_u8") and e.get("shape"):
            return int(e["shape"][0])
    return int(manifest.get("source_splats", 0))


def trailers(path: str, magic: bytes, base: int) -> dict[str, bytes]:
    """The side chunks that follow a container's own bytes, by name; none gives an empty result."""
    from cloudloom.sources import timeline

    out: dict[str, bytes] = {}
    with open(path, "rb") as f:
        f.seek(base)
        data = f.read()
    at = 0
    stem = magic.rstrip(b"\0")[:-2]
    while data[at : at + len(stem)] == stem and len(data) >= at + 19:
        n = struct.unpack("<Q", data[at + 11 : at + 19])[0]
        m = json.loads(data[at + 19 : at + 19 + n])
        at += 19 + n
        end = at
        for c in m["chunks"]:
            lo = at + c["offset_in_trailer"]
            out[c["name"]] = data[lo : lo + c["size_bytes"]]
            end = max(end, lo + c["size_bytes"])
        at = end
    for name, raw in out.items():
        if name in SIDES and len(raw) >= 10:
            _, _, width, kind, _ = SIDES[name]
            timeline.read_side_chunk(raw, kind, width if width is not None else raw[1])  # version, length and CRC
    return out


def decode_side(name: str, raw: bytes) -> dict[str, np.ndarray]:
    """Columns of a side table."""
    from cloudloom.sources import timeline

    _, _, width, kind, cols = SIDES[name]
    aux, v = timeline.read_side_chunk(raw, kind, width if width is not None else raw[1])
    if name == "normals_oct24_tangent8":
        b = v.astype(np.int64)
        u, w = (b[:, 0] | (b[:, 1] & 15) << 8) / 4095.0 * 2 - 1, (b[:, 1] >> 4 | b[:, 2] << 4) / 4095.0 * 2 - 1
        z = 1 - np.abs(u) - np.abs(w)
        t = np.maximum(-z, 0)
        n = np.stack([u - np.where(u >= 0, t, -t), w - np.where(w >= 0, t, -t), z], 1)
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        return {**{c: n[:, i].astype(np.float32) for i, c in enumerate(("nx", "ny", "nz"))}, "tangent": (b[:, 3] / 256 * 2 * np.pi).astype(np.float32)}
    if name == "edges_knn_u32":
        return {"neighbors": v.reshape(len(v), -1).astype(np.int64)}
    if name == "material_u8x4":
        return {c: v[:, i].astype(np.int32) for i, c in enumerate(cols)}
    if name == "germ_f16x5":
        return {"germ": v.astype(np.float32)}
    return {cols[0]: (v.astype(np.float32) / 255 * (0.5 if name == "kappa_u8" else 1.0)).astype(np.float32)}


def encode_side(name: str, cols: dict[str, np.ndarray]) -> bytes:
    """The side chunk of columns as ``decode_side`` gives them."""
    from cloudloom.sources import timeline

    _, _, width, kind, names = SIDES[name]
    if name == "normals_oct24_tangent8":
        x, y, z = (cols[c].astype(float) for c in ("nx", "ny", "nz"))
        k = np.abs(x) + np.abs(y) + np.abs(z)
        u, w = x / k, y / k
        sgn = lambda a: np.where(a >= 0, 1.0, -1.0)
        u, w = np.where(z < 0, (1 - np.abs(w)) * sgn(u), u), np.where(z < 0, (1 - np.abs(u)) * sgn(w), w)
        a, b = (np.clip(np.rint((c + 1) / 2 * 4095), 0, 4095).astype(np.int64) for c in (u, w))
        t = np.minimum(np.floor(np.mod(cols["tangent"].astype(float), 2 * np.pi) / (2 * np.pi) * 256 + 1e-9), 255).astype(np.int64)
        v = np.stack([a & 255, (b & 15) << 4 | a >> 8, b >> 4, t], 1).astype(np.uint8)
    elif name == "edges_knn_u32":
        v = cols["neighbors"].astype("<u4")
        return timeline.side_chunk(v, aux=v.shape[1])
    elif name == "material_u8x4":
        v = np.stack([cols[c] for c in names], 1).astype(np.uint8)
    elif name == "germ_f16x5":
        v = cols["germ"].astype("<f2")
    else:
        v = np.clip(cols[names[0]].astype(float) / (0.5 if name == "kappa_u8" else 1.0) * 255, 0, 255).astype(np.uint8)
    return timeline.side_chunk(v)


def _replace(path: str, data: bytes) -> None:
    tmp = f"{path}.new"
    with open(tmp, "wb") as f:
        f.write(data)
    os.replace(tmp, path)


def base_size(path: str) -> int:
    """Bytes of a container without its trailers."""
    _, m, at = read_manifest(path)
    return at + max((c["offset"] + c["compressed_bytes"] for c in m["chunks"]), default=0)


def append_trailer(path: str, version: int, sides: dict[str, bytes]) -> None:
    """Puts side chunks behind a container as trailer 31 or 40; what is there stays byte by byte. A repeated version is an error."""
    magic, _, _ = read_manifest(path)
    with open(path, "rb") as f:
        data = f.read()
    tag = magic.rstrip(b"\0")[:-2] + str(version).encode() + b"\0"
    base = base_size(path)
    if tag in data[base:]:
        raise ValueError(f"{path} has a trailer {version} already")
    at, chunks = 0, []
    for name, raw in sides.items():
        if SIDES[name][0] != version:
            raise ValueError(f"{name} does not belong into trailer {version}")
        chunks.append({"chunk_id": SIDES[name][1], "name": name, "offset_in_trailer": at, "size_bytes": len(raw)})
        at += len(raw)
    text = json.dumps({"base_size_bytes": base, "chunks": chunks}).encode()
    _replace(path, data + tag + struct.pack("<Q", len(text)) + text + b"".join(sides.values()))


def restamp(path: str, column: str, values: np.ndarray) -> None:
    """Replaces one byte column of the material table in place: sizes stay, its CRC is made anew, all else is as it was."""
    magic, _, _ = read_manifest(path)
    name = "material_u8x4"
    old = trailers(path, magic, base_size(path)).get(name)
    if old is None:
        raise ValueError(f"{path} has no {name}")
    cols = decode_side(name, old)
    if len(values) != len(cols[column]):
        raise ValueError("another number of rows")
    with open(path, "rb") as f:
        data = f.read()
    _replace(path, data.replace(old, encode_side(name, {**cols, column: values})))


def archived_q8(path: str, magic: bytes, manifest: dict, payload: int, start: int, end: int, check: bool) -> np.ndarray | None:
    """(rows, 45) quantised coefficients of a file with codebooks, exact if it holds residuals; None without codebooks."""
    by = {e["name"]: e for e in manifest["chunks"]}
    if "sh_vq128_idx_u8" not in by or "sh_vq128_codebook_i8" not in by:
        return None
    idx = np.frombuffer(read_rows(path, by["sh_vq128_idx_u8"], payload, 3, start, end, check), np.uint8).reshape(-1, 3)
    book = np.frombuffer(read_chunk(path, by["sh_vq128_codebook_i8"], payload, check), np.int8).reshape(3, -1, 15)
    out = np.concatenate([book[g][idx[:, g]] for g in range(3)], 1).astype(np.int16)
    whole = [e for e in manifest["chunks"] if e["name"].endswith("residual_payload")]
    if whole:
        from cloudloom.sources import layouts

        meta = whole[0]["layout_meta"]
        with open(path, "rb") as f:
            f.seek(payload + whole[0]["offset"])
            raw = layouts.decompress(whole[0]["codec"], f.read(whole[0]["compressed_bytes"]))
        if check and zlib.crc32(raw) != whole[0]["crc32_raw"]:
            raise ValueError(f"{path}: CRC of chunk {whole[0]['name']} does not match")
        xyz = decode_chunk("xyz_u24_fixed", read_chunk(path, by["xyz_u24_fixed"], payload, check), by["xyz_u24_fixed"])
        tier = np.frombuffer(read_chunk(path, by["tier_labels_u8"], payload, check), np.uint8)
        return np.clip(out + layouts.decode(raw, meta, np.stack([xyz[c] for c in "xyz"], 1), tier)[start:end], -128, 127)
    parts = [e for e in manifest["chunks"] if e["name"].startswith("sh_exact_residual_t")]
    if parts:
        tier = np.frombuffer(read_chunk(path, by["tier_labels_u8"], payload, check), np.uint8)
        for e in parts:
            t, g = int(e["tier"]), int(e["group"])
            lo, hi = int((tier[:start] == t).sum()), int((tier[:end] == t).sum())  # a residual's row is its splat's rank within the tier
            kind = np.dtype(e["dtype"])
            r = np.frombuffer(read_rows(path, e, payload, 15 * kind.itemsize, lo, hi, check), kind).reshape(-1, 15)
            out[np.flatnonzero(tier[start:end] == t), 15 * g : 15 * g + 15] += r
    return np.clip(out, -128, 127)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


_WIDTH = {"tier_labels_u8": 1, "xyz_u24_fixed": 9, "dc_rgb_opacity_u8": 4, "scale_f16": 6, "quat_i16_norm4": 8, "sh_rest_q8_global": 45, "sh_rest_f32": 180}


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.schema = options, schema
        path = options.get("path", "")
        self.files = sorted(glob.glob(os.path.join(path, "*.pack")) if os.path.isdir(path) else glob.glob(path))

    def partitions(self):
        step = int(self.options.get("rowsperpartition", self.options.get("rowsPerPartition", 1 << 20)))
        out = []
        for p in self.files:
            n = rows_in(p, read_manifest(p)[1])
            out += [_Range(p, s, min(s + step, n)) for s in range(0, max(n, 1), step)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterable[pa.RecordBatch]:
        if not part.path:
            return
        magic, manifest, payload = read_manifest(part.path)
        version_of(magic)
        want = {f.name for f in self.schema.fields}
        check = self.options.get("check", "true").lower() != "false"
        start, end = part.start, part.end
        got: dict[str, np.ndarray] = {}
        for e in manifest["chunks"]:
            if e["name"] in _WIDTH and (want & set((CHUNKS | PLAIN)[e["name"]]) or (e["name"] == "sh_rest_q8_global" and "sh_rest" in want)):
                got |= decode_chunk(e["name"], read_rows(part.path, e, payload, _WIDTH[e["name"]], start, end, check), e)
        if want & {"sh_q8", "sh_rest"} and "sh_q8" not in got and (q := archived_q8(part.path, magic, manifest, payload, start, end, check)) is not None:
            got["sh_q8"] = q.astype(np.int32)
        if "sh_rest" in want and "sh_rest" not in got and "sh_q8" in got:
            got["sh_rest"] = got["sh_q8"].astype(np.float32) * np.float32(manifest.get("sh_step", SH_Q8_STEP))
        if any(want & set(side[4]) for side in SIDES.values()):
            for name, raw in trailers(part.path, magic, base_size(part.path)).items():
                if name in SIDES and want & set(SIDES[name][4]):
                    got |= {c: v[start:end] for c, v in decode_side(name, raw).items()}
        n = end - start
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        for s in range(0, n, 65536):
            m = min(65536, n - s)
            cols = []
            for f in schema:
                v = got.get(f.name)
                if f.name == "file":
                    cols.append(pa.array([os.path.basename(part.path)] * m))
                elif f.name == "id":
                    cols.append(pa.array(np.arange(start + s, start + s + m)))
                elif v is None:
                    cols.append(pa.nulls(m, f.type))
                else:
                    cols.append(pa.array(list(v[s : s + m]) if v.ndim > 1 else v[s : s + m], type=f.type))
            yield pa.RecordBatch.from_arrays(cols, schema=schema)


class SplatPack(DataSource):
    """spark.read.format("splatpack").schema(columns).load(path); a narrower schema reads fewer chunks."""

    @classmethod
    def name(cls) -> str:
        return "splatpack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, magic, chunk_name, dtype, shape, raw_bytes, compressed_bytes, byte_offset, crc32_raw) of containers."""

    def run(batches):
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                p = p.removeprefix("file:")
                magic, manifest, _ = read_manifest(p)
                rows += [(os.path.basename(p), magic.rstrip(b"\0").decode("latin1"), e["name"], e.get("dtype"), e.get("shape"), e.get("raw_bytes"), e["compressed_bytes"], e["offset"], e.get("crc32_raw", e.get("crc32"))) for e in manifest["chunks"]]
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "magic", "chunk_name", "dtype", "shape", "raw_bytes", "compressed_bytes", "byte_offset", "crc32_raw"), r)) for r in rows])

    files = spark.read.format("binaryFile").load(path).select("path")  # content is pruned
    return files.mapInArrow(run, "file string, magic string, chunk_name string, dtype string, shape array<bigint>, raw_bytes bigint, compressed_bytes bigint, byte_offset bigint, crc32_raw bigint")


def pack(magic: bytes, manifest: dict, chunks: list[tuple[dict, bytes]], level: int = 6, ready: list[tuple[dict, bytes]] = ()) -> bytes:
    """The bytes of a container; ``ready`` chunks are compressed already."""
    if len(magic) != 11:
        raise ValueError("the magic has 11 bytes")
    entries, body, at = [], [], 0
    for meta, raw in chunks:
        z = zlib.compress(raw, level)
        entries.append({**meta, "offset": at, "compressed_bytes": len(z), "raw_bytes": len(raw), "crc32_raw": zlib.crc32(raw)})
        body.append(z)
        at += len(z)
    for meta, z in ready:
        entries.append({**meta, "offset": at, "compressed_bytes": len(z)})
        body.append(z)
        at += len(z)
    text = json.dumps({**manifest, "chunks": entries}).encode()
    return magic + struct.pack("<Q", len(text)) + text + b"".join(body)


def encode_splats(t: pa.Table) -> list[tuple[dict, bytes]]:
    """Chunks of a table with the columns of SCHEMA (dc and alpha decoded, sh_q8 integer); bounds per file."""
    n = t.num_rows

    def mat(*cols: str) -> np.ndarray:
        return np.stack([t.column(c).to_numpy().astype(np.float64) for c in cols], 1)

    xyz = mat("x", "y", "z")
    lo, hi = (xyz.min(0), xyz.max(0)) if n else (np.zeros(3), np.zeros(3))
    span = np.where(hi - lo < 1e-6, np.inf, hi - lo)
    q = np.clip(np.rint((xyz - lo) / span * U24), 0, U24).astype(np.uint32)
    u24 = np.stack([q & 255, (q >> 8) & 255, q >> 16], 2).astype(np.uint8)
    dc = np.clip(np.rint((mat("dc_r", "dc_g", "dc_b") * SH_C0 + 0.5) * 255), 0, 255)
    alpha = np.clip(np.rint(mat("alpha") * 255), 0, 255)
    quat = mat("qw", "qx", "qy", "qz").astype(np.float32)
    quat /= np.maximum(np.sqrt((quat * quat).sum(1, keepdims=True)), np.float32(1e-20))
    quat = np.clip(np.rint(quat * np.float32(32767)), -32767, 32767) * np.where(quat[:, :1] < 0, -1, 1)
    sh = np.array(t.column("sh_q8").to_pylist(), dtype=np.int8).reshape(n, 45)
    raw = {
        "tier_labels_u8": (t.column("tier").to_numpy().astype(np.uint8), {}),
        "xyz_u24_fixed": (u24.reshape(n, 9), {"bounds_min": lo.tolist(), "bounds_max": hi.tolist()}),
        "dc_rgb_opacity_u8": (np.concatenate([dc, alpha], 1).astype(np.uint8), {}),
        "scale_f16": (mat("sx", "sy", "sz").astype("<f2"), {}),
        "quat_i16_norm4": (quat.astype("<i2"), {}),
        "sh_rest_q8_global": (sh, {"global_scale": SH_Q8_STEP}),
    }
    return [({"name": k, "dtype": str(a.dtype), "shape": list(a.shape), **extra}, a.tobytes()) for k, (a, extra) in raw.items()]


def codebook_chunks(q8: np.ndarray, book: np.ndarray) -> tuple[list[tuple[dict, bytes]], np.ndarray]:
    """(index and codebook chunks, residual): each 15 coefficients by their nearest codeword, ties by the smaller number."""
    idx, approx = np.zeros((len(q8), 3), np.uint8), np.zeros(q8.shape, np.int16)
    for g in range(3):
        part, codes = q8[:, 15 * g : 15 * g + 15].astype(np.float32), book[g].astype(np.float32)
        for s in range(0, len(part), 16_384):
            d = (codes * codes).sum(1)[None] - 2 * part[s : s + 16_384] @ codes.T
            idx[s : s + 16_384, g] = d.argmin(1)
        approx[:, 15 * g : 15 * g + 15] = book[g][idx[:, g]]
    chunks = [({"name": "sh_vq128_idx_u8", "dtype": "uint8", "shape": list(idx.shape)}, idx.tobytes()), ({"name": "sh_vq128_codebook_i8", "dtype": "int8", "shape": list(book.shape)}, book.astype(np.int8).tobytes())]
    return chunks, q8.astype(np.int16) - approx


def residual_chunks(residual: np.ndarray, tier: np.ndarray) -> list[tuple[dict, bytes]]:
    """Residuals by tier and group, in the order of rows; 16 bits if 8 don't hold them."""
    kind = "int8" if len(residual) == 0 or (residual.min() >= -128 and residual.max() <= 127) else "int16"
    out = []
    for t in sorted(set(tier.tolist())):
        for g in range(3):
            part = residual[tier == t, 15 * g : 15 * g + 15].astype(kind)
            out.append(({"name": f"sh_exact_residual_t{t}_g{g}_{kind}", "dtype": kind, "shape": list(part.shape), "tier": int(t), "group": g}, part.tobytes()))
    return out


def make_container(t: pa.Table, stem: bytes, kind: str = "plain", book: np.ndarray | None = None, layout: str = "morton_splat_major", codec: str = "zlib9") -> bytes:
    """The bytes of a container of a table as ``encode_splats`` takes it. ``stem``: the magic without its two digits.

    ``kind``: 'plain' (25), 'codebook' (27), 'render' (28), 'archive' (28, exact) or
    'payload' (29, exact; refused unless its layout gives the residuals back).
    """
    base = encode_splats(t)
    manifest = {"format": f"splats {kind}", "source_splats": t.num_rows}
    version = {"plain": 25, "codebook": 27, "render": 28, "archive": 28, "payload": 29}[kind]
    magic = stem + str(version).encode() + b"\0"
    if kind == "plain":
        return pack(magic, manifest, base)
    q8 = np.array(t.column("sh_q8").to_pylist(), dtype=np.int16).reshape(t.num_rows, 45)
    vq, residual = codebook_chunks(q8, book)
    chunks = [c for c in base if c[0]["name"] != "sh_rest_q8_global"] + vq
    tier = t.column("tier").to_numpy().astype(np.uint8)
    if kind == "archive":
        chunks += residual_chunks(residual, tier)
    if kind != "payload":
        return pack(magic, manifest | ({"format": "EXACT_ARCHIVE"} if kind == "archive" else {}), chunks)
    from cloudloom.sources import layouts

    meta, raw = next(c for c in base if c[0]["name"] == "xyz_u24_fixed")
    at = decode_chunk("xyz_u24_fixed", raw, meta)
    xyz = np.stack([at[c] for c in "xyz"], 1)
    raw, meta = layouts.encode(layout, residual, xyz, tier)
    if not np.array_equal(layouts.decode(raw, meta, xyz, tier), residual):
        raise ValueError(f"the layout {layout} does not give the residuals back")
    z = layouts.compress(codec, raw)
    return pack(magic, manifest | {"format": "EXACT_ARCHIVE"}, chunks, ready=[({"name": "exact_residual_payload", "codec": codec, "layout_meta": meta, "raw_bytes": len(raw), "crc32_raw": zlib.crc32(raw)}, z)])


def write_containers(df: DataFrame, path: str, magic: bytes, fmt: str, rows_per_file: int = 1 << 20, **kind) -> DataFrame:
    """Writes files of at most ``rows_per_file`` rows of each partition to a shared folder; (file, splats, bytes) of each. An action on the result writes.

    ``magic``: the 11 bytes of a plain container, or its stem if ``kind`` (see
    ``make_container``) is given.
    """

    def run(batches):
        from pyspark import TaskContext

        c = TaskContext.get()
        held, rows, no = [], 0, 0

        def flush():
            nonlocal held, rows, no
            t = pa.Table.from_batches(held)
            os.makedirs(path, exist_ok=True)
            name = f"part-{c.partitionId():05d}-{no:04d}.pack"
            data = make_container(t, magic.rstrip(b"\0"), **kind) if kind else pack(magic, {"format": fmt, "source_splats": t.num_rows}, encode_splats(t))
            tmp = os.path.join(path, f".{name}.{c.taskAttemptId()}")
            with open(tmp, "wb") as f:
                f.write(data)
            os.replace(tmp, os.path.join(path, name))  # a repeated attempt leaves the same file
            held, rows, no = [], 0, no + 1
            return pa.RecordBatch.from_pydict({"file": [name], "splats": [t.num_rows], "bytes": [len(data)]})

        for b in batches:
            while b.num_rows:
                part = b.slice(0, rows_per_file - rows)
                held.append(part)
                rows += part.num_rows
                b = b.slice(part.num_rows)
                if rows == rows_per_file:
                    yield flush()
        if rows:
            yield flush()

    return df.mapInArrow(run, "file string, splats bigint, bytes bigint")
