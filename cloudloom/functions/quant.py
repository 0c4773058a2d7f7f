"""Quantisers and packers as column expressions. Rounding is half to even unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Fixed values of the format.
SH_C0 = 0.28209479177387814
SH_Q8_STEP = 0.006946287755891094
U24 = 16777215
TWO_PI = 6.283185307179586


def clip(c: Column, low: float, high: float) -> Column:
    """c within [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(c, F.lit(high))))


def step(c: Column, mode: str = "round") -> Column:
    """The integer of a code: 'round' (half to even) or 'truncate', the two dialects of writers."""
    return F.rint(c) if mode == "round" else F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def u24_encode(c: Column, low: Column, high: Column, mode: str = "round") -> Column:
    """24-bit code of c between the bounds of its axis; a span below 1e-6 gives 0."""
    code = clip(step((c - low) / (high - low) * U24, mode), 0, U24)
    return F.when((high - low) < 1e-6, F.when(c.isNotNull(), 0.0)).otherwise(code).cast("int")


def u24_decode(q: Column, low: Column, high: Column) -> Column:
    return q / F.lit(float(U24)) * (high - low) + low


def dc_encode(f_dc: Column, mode: str = "round") -> Column:
    return clip(step((f_dc * SH_C0 + 0.5) * 255.0, mode), 0, 255).cast("int")


def dc_decode(q: Column) -> Column:
    return (q / 255.0 - 0.5) / SH_C0


def sigmoid(c: Column) -> Column:
    """Logistic function, its argument held within +-100."""
    return 1.0 / (1.0 + F.exp(-clip(c, -100.0, 100.0)))


def opacity_encode(logit: Column) -> Column:
    return clip(F.rint(sigmoid(logit) * 255.0), 0, 255).cast("int")


def quat_encode(q: Sequence[Column]) -> list[Column]:
    """Four 16-bit codes of a quaternion, normalised in single precision, real part not negative."""
    f = [c.cast("float") for c in q]
    norm = F.sqrt((f[0] * f[0] + f[1] * f[1] + f[2] * f[2] + f[3] * f[3]).cast("double")).cast("float")
    code = [clip(F.rint(((c / norm).cast("float") * F.lit(32767.0).cast("float")).cast("double")), -32767, 32767) for c in f]
    return [F.when(f[0] < 0, -c).otherwise(c).cast("int") for c in code]


def quat_decode(codes: Sequence[Column]) -> list[Column]:
    return [c / 32767.0 for c in codes]


def sh_q8_encode(sh: Column, scale: float = SH_Q8_STEP) -> Column:
    """Array of 8-bit codes of an array of coefficients."""
    return F.transform(sh, lambda v: clip(F.rint(v.cast("double") / scale), -128, 127).cast("int"))


def sh_q8_decode(q: Column, scale: float = SH_Q8_STEP) -> Column:
    return F.transform(q, lambda v: v * scale)


def half_round_trip():
    """A pandas UDF: value after storage as an IEEE half."""

    @F.pandas_udf("float")
    def through(c: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(c.to_numpy(np.float32, na_value=np.nan).astype(np.float16).astype(np.float32))

    return through


def oct_encode(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Octahedral coordinates in [-1, 1] of a direction; sign of 0 counts as +."""
    n = F.abs(x) + F.abs(y) + F.abs(z)
    u, v = x / n, y / n

    def sgn(c: Column) -> Column:
        return F.when(c >= 0, 1.0).otherwise(-1.0)

    return F.when(z < 0, (1 - F.abs(v)) * sgn(u)).otherwise(u), F.when(z < 0, (1 - F.abs(u)) * sgn(v)).otherwise(v)


def oct_decode(u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Unit direction of octahedral coordinates."""
    z = 1 - F.abs(u) - F.abs(v)
    t = F.greatest(-z, F.lit(0.0))
    x = u - F.when(u >= 0, t).otherwise(-t)
    y = v - F.when(v >= 0, t).otherwise(-t)
    n = F.sqrt(x * x + y * y + z * z)
    return x / n, y / n, z / n


def oct_code(c: Column) -> Column:
    """12-bit code of an octahedral coordinate."""
    return clip(F.rint((c + 1) / 2 * 4095.0), 0, 4095).cast("int")


def pack_12_12(qx: Column, qy: Column) -> Column:
    """Three bytes, little-endian, as one number."""
    return qx.bitwiseOR(F.shiftleft(qy, 12))


def unpack_12_12(p: Column) -> tuple[Column, Column]:
    return p.bitwiseAND(4095), F.shiftright(p, 12).bitwiseAND(4095)


def angle_byte(a: Column) -> Column:
    """Byte of a tangent angle; the 1e-9 keeps exact steps in their bin."""
    return F.least(F.floor(F.pmod(a, F.lit(TWO_PI)) / TWO_PI * 256.0 + 1e-9), F.lit(255)).cast("int")


def byte_angle(b: Column) -> Column:
    return b / 256.0 * TWO_PI


def kappa_q8(c: Column) -> Column:
    return F.floor(clip(c / 0.5 * 255.0, 0, 255)).cast("int")


def cusp_q8(c: Column) -> Column:
    return F.floor(clip(c * 255.0, 0, 255)).cast("int")


def mip_zoom_byte(sx: Column, sy: Column, sz: Column) -> Column:
    """Byte of the largest (linear) scale in eighths of an octave."""
    return clip(F.rint((F.log2(1024.0 * F.greatest(sx, sy, sz)) + 8.0) * 8.0), 0, 255).cast("int")


def mip_zoom_sigma(b: Column) -> Column:
    return F.pow(F.lit(2.0), b / 8.0 - 8.0) / 1024.0


def norm(a: Column) -> Column:
    """Euclidean norm of an array of numbers."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def view_dependence(dc: Column, rest: Column) -> Column:
    """Byte score of how much colour depends on the view."""
    return F.floor(clip(norm(rest) / (norm(dc) + 1e-3) / 4.0 * 255.0, 0, 255)).cast("int")


def zigzag(v: Column) -> Column:
    """16-bit signed -> unsigned with small magnitudes first."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 15)).bitwiseAND(0xFFFF)


def unzigzag(u: Column) -> Column:
    return F.shiftright(u, 1).bitwiseXOR(-(u.bitwiseAND(1)))


def u10(c: Column, low: Column, high: Column) -> Column:
    return F.floor((c - low) / F.greatest(high - low, F.lit(1e-9)) * 1023.0).cast("bigint")


def spread3(c: Column) -> Column:
    """A 10-bit number with two free bits after each bit (fixed masks of the code)."""
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(mask)
    return c


def morton3(x: Column, y: Column, z: Column) -> Column:
    """30-bit Morton code of three 10-bit numbers."""
    return spread3(x).bitwiseOR(F.shiftleft(spread3(y), 1)).bitwiseOR(F.shiftleft(spread3(z), 2))


def bit(c: Column, b: int) -> Column:
    return F.shiftright(c, b).bitwiseAND(1)


def packed(codec: str):
    """A pandas UDF: bytes through a codec (zlib6, zlib9, bz2, lzma6, and brotli where it is there)."""

    @F.pandas_udf("binary")
    def run(b: pd.Series) -> pd.Series:
        from cloudloom.sources import layouts

        return b.map(lambda v: None if v is None else layouts.compress(codec, bytes(v)))

    return run


def unpacked(codec: str):
    @F.pandas_udf("binary")
    def run(b: pd.Series) -> pd.Series:
        from cloudloom.sources import layouts

        return b.map(lambda v: None if v is None else layouts.decompress(codec, bytes(v)))

    return run
