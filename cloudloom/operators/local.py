"""Local surfaces of neighbourhoods: normals by moving least squares, germs. Vectorised over a batch of bounded lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def neighbourhoods(points: DataFrame, edges: DataFrame, group: str = "scene_id") -> DataFrame:
    """(id, near): the offsets of the neighbours of each point, flat, nearest first; lists of 3 * k numbers at most."""
    ends = points.select(group, "id", "x", "y", "z")
    e = edges.join(ends.select(group, F.col("id").alias("src"), *[F.col(c).alias(f"s_{c}") for c in "xyz"]), [group, "src"])
    e = e.join(ends.select(group, F.col("id").alias("dst"), *[F.col(c).alias(f"d_{c}") for c in "xyz"]), [group, "dst"])
    off = F.array(*[F.col(f"d_{c}") - F.col(f"s_{c}") for c in "xyz"])
    got = e.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", off.alias("o")))).alias("n"))
    return got.select("id", F.flatten(F.transform("n", lambda v: v["o"])).alias("near"))


def _padded(near: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(rows, k, 3) offsets and the mask of those that are there."""
    k = max((len(v) // 3 for v in near), default=1)
    out, there = np.zeros((len(near), k, 3)), np.zeros((len(near), k), bool)
    for i, v in enumerate(near):
        a = np.asarray(v, float).reshape(-1, 3)
        out[i, : len(a)], there[i, : len(a)] = a, True
    return out, there


def normals_of(off: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals (upwards) and tangent angles: plane through the neighbours, then a quadric over it (ridge 1e-9)."""
    w = there[..., None].astype(float)
    n = np.maximum(w.sum(1), 1)
    centred = (off - (off * w).sum(1, keepdims=True) / n[:, None]) * w
    _, vec = np.linalg.eigh(np.einsum("nki,nkj->nij", centred, centred) / n[:, :, None])
    up = np.array([0.0, 1.0, 0.0])
    n0 = vec[:, :, 0]
    n0 = np.where(n0 @ up < 0, -1.0, 1.0)[:, None] * n0
    ref = np.where(np.abs(n0[:, :1]) > 0.9, [0.0, 0.0, 1.0], [1.0, 0.0, 0.0])
    t1 = np.cross(n0, ref)
    t1 /= np.maximum(np.linalg.norm(t1, axis=1, keepdims=True), 1e-12)
    t2 = np.cross(n0, t1)
    u, v, h = (np.einsum("nki,ni->nk", off, a) for a in (t1, t2, n0))
    m = np.stack([np.ones_like(u), u, v, u * u, u * v, v * v], 2) * w
    c = np.linalg.solve(np.einsum("nki,nkj->nij", m, m) + 1e-9 * np.eye(6), np.einsum("nki,nk->ni", m, h * there)[..., None])[..., 0]
    out = -c[:, 1:2] * t1 - c[:, 2:3] * t2 + n0
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    out = np.where(out @ up < 0, -1.0, 1.0)[:, None] * out

    def flat(a: np.ndarray) -> np.ndarray:
        p = a - (a * out).sum(1, keepdims=True) * out
        return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)

    side = flat(np.where(np.abs(out[:, :1]) > 0.95, up, [1.0, 0.0, 0.0]))
    rise = flat(np.broadcast_to(up, out.shape))
    angle = np.arctan2((np.cross(side, rise) * out).sum(1), np.clip((side * rise).sum(1), -1, 1))
    return out, np.mod(angle, 2 * np.pi)


def mls_normals(near: DataFrame) -> DataFrame:
    """(id, nx, ny, nz, tangent) of (id, near)."""

    @F.pandas_udf("struct<nx:double,ny:double,nz:double,tangent:double>")
    def run(near: pd.Series) -> pd.DataFrame:
        n, a = normals_of(*_padded(near))
        return pd.DataFrame({"nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "tangent": a})

    return near.select("id", run("near").alias("r")).select("id", "r.*")


def germs_of(off: np.ndarray, there: np.ndarray, quat: np.ndarray, log_scale: np.ndarray) -> np.ndarray:
    """Five coefficients of each neighbourhood in its splat's frame, in units of its spread; ridge 1e-6; held within fixed bounds."""
    w, x, y, z = (quat / np.linalg.norm(quat, axis=1, keepdims=True)).T
    r = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], 1).reshape(-1, 3, 3)
    local = np.einsum("nji,nkj->nki", r, off) / np.maximum(np.exp(log_scale), 1e-9)[:, None]
    s, t, h = (local[..., i] for i in range(3))
    m = np.stack([s * s, t * t, s**3 - 3 * s * t * t, 3 * s * s * t - t**3, s**4 + t**4], 2) * there[..., None]
    theta = np.linalg.solve(np.einsum("nki,nkj->nij", m, m) + 1e-6 * np.eye(5), np.einsum("nki,nk->ni", m, h * there)[..., None])[..., 0]
    bound = np.array([25.0, 25.0, 50.0, 50.0, 100.0])
    return np.clip(theta, -bound, bound)


def germs(near: DataFrame) -> DataFrame:
    """(id, theta) of (id, near, qw, qx, qy, qz, sx, sy, sz)."""

    @F.pandas_udf("array<double>")
    def run(near: pd.Series, q: pd.DataFrame, s: pd.DataFrame) -> pd.Series:
        return pd.Series(list(germs_of(*_padded(near), q.to_numpy(float), s.to_numpy(float))))

    return near.select("id", run("near", F.struct("qw", "qx", "qy", "qz"), F.struct("sx", "sy", "sz")).alias("theta"))
