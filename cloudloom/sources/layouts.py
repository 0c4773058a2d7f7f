"""Layouts of residual tables as bytes, and byte codecs, each by name; ``register`` adds layouts of one's own.

A layout turns an (n, 45) array of small integers into bytes and a description, and back. It
may order rows by place or tier, which both sides know.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable

import numpy as np

try:
    import brotli
except ImportError:  # not on every machine
    brotli = None

Encoder = Callable[[np.ndarray, np.ndarray, np.ndarray], bytes]
Decoder = Callable[[bytes, int, np.dtype, np.ndarray, np.ndarray], np.ndarray]
LAYOUTS: dict[str, tuple[Encoder, Decoder]] = {}
CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "zlib6": (lambda b: zlib.compress(b, 6), zlib.decompress),
    "zlib9": (lambda b: zlib.compress(b, 9), zlib.decompress),
    "bz2": (lambda b: bz2.compress(b, 9), bz2.decompress),
    "lzma6": (lambda b: lzma.compress(b, preset=6), lzma.decompress),
}
if brotli is not None:
    CODECS |= {f"brotli{q}": (lambda b, q=q: brotli.compress(b, quality=q), brotli.decompress) for q in (5, 9)}


def compress(codec: str, raw: bytes) -> bytes:
    return CODECS[codec][0](raw)


def decompress(codec: str, data: bytes) -> bytes:
    return CODECS[codec][1](data)


def register(name: str, encoder: Encoder, decoder: Decoder) -> None:
    LAYOUTS[name] = (encoder, decoder)


def encode(name: str, residual: np.ndarray, xyz: np.ndarray, tier: np.ndarray) -> tuple[bytes, dict]:
    """(bytes, description) of residuals; an unknown name is an error that lists the known ones."""
    if name not in LAYOUTS:
        raise ValueError(f"unknown layout {name!r}; there are {sorted(LAYOUTS)}")
    small = not len(residual) or (residual.min() >= -128 and residual.max() <= 127)
    r = residual.astype("<i1" if small else "<i2")
    return LAYOUTS[name][0](r, xyz, tier), {"layout": name, "dtype": r.dtype.str, "rows": len(r)}


def decode(raw: bytes, meta: dict, xyz: np.ndarray, tier: np.ndarray) -> np.ndarray:
    """The residuals (n, 45) as 16-bit numbers."""
    return LAYOUTS[meta["layout"]][1](raw, meta["rows"], np.dtype(meta["dtype"]), xyz, tier).astype(np.int16)


def morton_order(xyz: np.ndarray) -> np.ndarray:
    """Rows along the Morton curve of ten bits an axis within their bounds; equal codes keep their order."""
    if not len(xyz):
        return np.zeros(0, np.int64)
    low = xyz.min(0)
    q = np.clip(np.floor((xyz - low) / np.maximum(xyz.max(0) - low, 1e-9) * 1023), 0, 1023).astype(np.int64)
    code = np.zeros(len(q), np.int64)
    for bit in range(10):
        for axis in range(3):
            code |= (q[:, axis] >> bit & 1) << (3 * bit + axis)
    return np.argsort(code, kind="stable")


def _ordered(raw: bytes, n: int, kind: np.dtype, order: np.ndarray) -> np.ndarray:
    out = np.empty((n, 45), kind)
    out[order] = np.frombuffer(raw, kind).reshape(n, 45)
    return out


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8))[:n]


def _zigzag(r: np.ndarray) -> np.ndarray:
    v = r.astype(np.int32)
    return (v << 1) ^ (v >> 31)


def _unzigzag(u: np.ndarray) -> np.ndarray:
    u = u.astype(np.int32)
    return (u >> 1) ^ -(u & 1)


_GROUPS = [slice(15 * g, 15 * g + 15) for g in range(3)]
_BANDS = [slice(15 * g + a, 15 * g + b) for g in range(3) for a, b in ((0, 3), (3, 8), (8, 15))]


def _split(parts: list[slice]) -> tuple[Encoder, Decoder]:
    def dec(raw, n, kind, xyz, tier):
        out, at = np.empty((n, 45), kind), 0
        for p in parts:
            size = n * (p.stop - p.start) * kind.itemsize
            out[:, p] = np.frombuffer(raw[at : at + size], kind).reshape(n, p.stop - p.start)
            at += size
        return out

    return lambda r, xyz, tier: b"".join(np.ascontiguousarray(r[:, p]).tobytes() for p in parts), dec


def _delta(r, xyz, tier):
    a = r[morton_order(xyz)].astype("<i2")
    return np.diff(a, axis=0, prepend=np.zeros((1, 45), a.dtype)).astype("<i2").tobytes()


def _undelta(raw, n, kind, xyz, tier):
    out = np.empty((n, 45), np.int16)
    out[morton_order(xyz)] = np.cumsum(np.frombuffer(raw, "<i2").reshape(n, 45), axis=0, dtype=np.int16)
    return out


def _tiers(xyz: np.ndarray, tier: np.ndarray) -> np.ndarray:
    o = morton_order(xyz)
    return o[np.argsort(tier[o], kind="stable")]


def _unmask(raw, n, kind, xyz, tier):
    at = (45 * n + 7) // 8
    out = np.zeros(45 * n, kind)
    out[_bits(raw[:at], 45 * n).astype(bool)] = np.frombuffer(raw[at:], kind)
    return out.reshape(n, 45)


def _signs(r, xyz, tier):
    return np.packbits((r < 0).ravel()).tobytes() + np.abs(r.astype(np.int16)).astype("<u1" if r.dtype.itemsize == 1 else "<u2").tobytes()


def _unsigns(raw, n, kind, xyz, tier):
    at = (45 * n + 7) // 8
    m = np.frombuffer(raw[at:], "<u1" if kind.itemsize == 1 else "<u2").astype(np.int32)
    return np.where(_bits(raw[:at], 45 * n), -m, m).reshape(n, 45)


def _planes(r, xyz, tier):
    z = _zigzag(r).ravel()
    return b"".join(np.packbits(z >> b & 1).tobytes() for b in range(8 * r.dtype.itemsize - 1, -1, -1))


def _unplanes(raw, n, kind, xyz, tier):
    size, z = (45 * n + 7) // 8, np.zeros(45 * n, np.int32)
    for i, b in enumerate(range(8 * kind.itemsize - 1, -1, -1)):
        z |= _bits(raw[size * i : size * i + size], 45 * n).astype(np.int32) << b
    return _unzigzag(z).reshape(n, 45)


register("splat_major_raw", lambda r, xyz, tier: r.tobytes(), lambda raw, n, kind, xyz, tier: np.frombuffer(raw, kind).reshape(n, 45))
register("coefficient_major_transpose", lambda r, xyz, tier: np.ascontiguousarray(r.T).tobytes(), lambda raw, n, kind, xyz, tier: np.frombuffer(raw, kind).reshape(45, n).T)
register("group_major_3x15", *_split(_GROUPS))
register("band_split_low_mid_high", *_split(_BANDS))
register("morton_splat_major", lambda r, xyz, tier: r[morton_order(xyz)].tobytes(), lambda raw, n, kind, xyz, tier: _ordered(raw, n, kind, morton_order(xyz)))
register("morton_delta_i16", _delta, _undelta)
register("tier_then_coefficient_major", lambda r, xyz, tier: np.ascontiguousarray(r[_tiers(xyz, tier)].T).tobytes(), lambda raw, n, kind, xyz, tier: _ordered(np.ascontiguousarray(np.frombuffer(raw, kind).reshape(45, n).T).tobytes(), n, kind, _tiers(xyz, tier)))
register("zigzag_splat_major_u16", lambda r, xyz, tier: _zigzag(r).astype("<u2").tobytes(), lambda raw, n, kind, xyz, tier: _unzigzag(np.frombuffer(raw, "<u2")).reshape(n, 45))
register("sign_magnitude_planes", _signs, _unsigns)
register("zero_mask_values", lambda r, xyz, tier: np.packbits((r != 0).ravel()).tobytes() + r.ravel()[r.ravel() != 0].tobytes(), _unmask)
register("bitplane_zigzag_u8", _planes, _unplanes)
