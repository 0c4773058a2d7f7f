"""Voxel grids: rays, trilinear samples, front-to-back marching, its adjoint, differences and blobs.

A grid is a table (i, j, k, v, r, g, b) of the cells that hold something; others are empty.
Samples meet cells by an equi-join on the eight corners, rays are the partitions of the march.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from cloudloom.functions.geometry import quaternion, ray_box, unit
from cloudloom.plans.durable import cut

RGB = ("r", "g", "b")


def camera_rays(spark: SparkSession, size: int, focal: float, eye: Sequence[float]) -> DataFrame:
    """(y, x, ox, oy, oz, dx, dy, dz) of a camera that looks along -z; a ray through each pixel."""
    p = spark.range(size * size).select(F.floor(F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    half = (size - 1) / 2
    d = unit([(F.col("x") - half) / focal, (half - F.col("y")) / focal, F.lit(-1.0)])
    return p.select("y", "x", *[F.lit(float(e)).alias(f"o{a}") for e, a in zip(eye, "xyz")], *[c.alias(f"d{a}") for c, a in zip(d, "xyz")])


def samples(rays: DataFrame, n: int, low: Sequence[float], high: Sequence[float], key: Sequence[str] = ("y", "x")) -> DataFrame:
    """(key..., s, dt, wx, wy, wz): n points a ray, at the middle of equal parts of its way through the box. Rays that miss have none."""
    t0, t1 = ray_box([F.col(f"o{a}") for a in "xyz"], [F.col(f"d{a}") for a in "xyz"], low, high)
    r = rays.withColumns({"t0": t0, "t1": t1}).where("t1 > t0").withColumn("dt", (F.col("t1") - F.col("t0")) / n)
    r = r.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = F.col("t0") + (F.col("s") + 0.5) * F.col("dt")
    return r.select(*key, "s", "dt", *[(F.col(f"o{a}") + t * F.col(f"d{a}")).alias(f"w{a}") for a in "xyz"])


def corners(points: DataFrame, res: int, low: Sequence[float], cell: float) -> DataFrame:
    """The points with their eight cells (i, j, k) and weights; points between the outermost centres only."""
    d = points
    for a, axis, o in zip("xyz", "ijk", low):
        d = d.withColumn(f"g{a}", (F.col(f"w{a}") - o) / cell - 0.5).withColumn(f"{axis}0", F.floor(f"g{a}").cast("bigint"))
    for axis in "ijk":
        d = d.where((F.col(f"{axis}0") >= 0) & (F.col(f"{axis}0") + 1 < res))
    eight = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    d = d.withColumn("e", F.explode(eight))
    w = F.lit(1.0)
    for a, axis, e in zip("xyz", "ijk", "abc"):
        f = F.col(f"g{a}") - F.col(f"{axis}0")
        w = w * F.when(F.col(f"e.{e}") == 1, f).otherwise(1 - f)
    return d.select(*points.columns, *[(F.col(f"{axis}0") + F.col(f"e.{e}")).alias(axis) for axis, e in zip("ijk", "abc")], w.alias("weight"))


def sampled(points: DataFrame, grid: DataFrame, res: int, low: Sequence[float], cell: float, key: Sequence[str] = ("y", "x")) -> DataFrame:
    """(key..., s, dt, v, r, g, b): trilinear values of the samples that meet a cell."""
    c = corners(points, res, low, cell).join(grid, ["i", "j", "k"])
    return c.groupBy(*key, "s", "dt").agg(*[F.sum(F.col("weight") * F.col(x)).alias(x) for x in ("v", *RGB)])


def march(values: DataFrame, key: Sequence[str] = ("y", "x"), stop: float = 1e-4) -> DataFrame:
    """Adds t (light left before the sample) and a (what it takes); samples behind less than ``stop`` are left out."""
    w = W.partitionBy(*key).orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    dense = values.where("v > 1e-7").withColumn("od", F.col("v") * F.col("dt"))
    return dense.withColumn("t", F.exp(-F.coalesce(F.sum("od").over(w), F.lit(0.0)))).where(F.col("t") >= stop).withColumn("a", 1 - F.exp(-F.col("od")))


def pixels(rays: DataFrame, marched: DataFrame, background: Sequence[float], key: Sequence[str] = ("y", "x")) -> DataFrame:
    """(key..., r, g, b): every ray's colour over the background."""
    p = marched.groupBy(*key).agg(F.exp(-F.sum("od")).alias("left"), *[F.sum(F.col("t") * F.col("a") * F.col(c)).alias(c) for c in RGB])
    j = rays.select(*key).join(p, list(key), "left")
    return j.select(*key, *[(F.coalesce(c, F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * b).alias(c) for c, b in zip(RGB, background)])


def density_gradient(points: DataFrame, marched: DataFrame, residual: DataFrame, background: Sequence[float], res: int, low: Sequence[float], cell: float, key: Sequence[str] = ("y", "x")) -> DataFrame:
    """(i, j, k, grad): the adjoint of the march. ``residual``: (key..., e_r, e_g, e_b), what each pixel has too much."""
    m = marched.join(residual, list(key))
    m = m.withColumn("ce", sum((F.col(c) * F.col(f"e_{c}") for c in "gb"), F.col("r") * F.col("e_r")))
    every, after = W.partitionBy(*key), W.partitionBy(*key).orderBy("s").rowsBetween(1, W.unboundedFollowing)
    left = F.exp(-F.sum("od").over(every)) * sum((b * F.col(f"e_{c}") for c, b in zip("gb", background[1:])), background[0] * F.col("e_r"))
    behind = F.coalesce(F.sum(F.col("t") * F.col("a") * F.col("ce")).over(after), F.lit(0.0)) + left
    g = m.withColumn("dv", F.col("dt") * (F.col("t") * (1 - F.col("a")) * F.col("ce") - behind)).select(*key, "s", "dv")
    c = corners(points, res, low, cell).join(g, [*key, "s"])
    return c.groupBy("i", "j", "k").agg(F.sum(F.col("weight") * F.col("dv")).alias("grad"))


def rms_step(grid: DataFrame, grad: DataFrame, state: DataFrame | None, rate: float = 5.0, decay: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(grid, state) after one step of RMSProp on v, held at 0 and above; cells without gradient stay. ``state``: (i, j, k, ms)."""
    g = grad if state is None else grad.join(state, ["i", "j", "k"], "full_outer")
    g = g.withColumn("ms", decay * (F.coalesce("ms", F.lit(0.0)) if state is not None else F.lit(0.0)) + (1 - decay) * F.coalesce("grad", F.lit(0.0)) * F.coalesce("grad", F.lit(0.0)))
    j = grid.join(g, ["i", "j", "k"], "left")
    step = F.coalesce(rate * F.col("grad") / (F.sqrt("ms") + 1e-6), F.lit(0.0))
    return j.select("i", "j", "k", F.greatest(F.lit(0.0), F.col("v") - step).alias("v"), *RGB), g.select("i", "j", "k", "ms")


def fit(rays: DataFrame, target: DataFrame, grid: DataFrame, rounds: int, n: int, res: int, low: Sequence[float], cell: float, background: Sequence[float], rate: float = 5.0) -> DataFrame:
    """The grid after so many rounds of forward, adjoint and step; each round is written to the checkpoint folder."""
    points = cut(samples(rays, n, low, [o + res * cell for o in low]))
    state = None
    for _ in range(rounds):
        m = cut(march(sampled(points, grid, res, low, cell)))
        image = pixels(rays, m, background)
        t = target.select("y", "x", *[F.col(c).alias(f"t_{c}") for c in RGB])
        residual = image.join(t, ["y", "x"]).select("y", "x", *[(F.col(c) - F.col(f"t_{c}")).alias(f"e_{c}") for c in RGB])
        grid, state = rms_step(grid, density_gradient(points, m, residual, background, res, low, cell), state, rate)
        grid, state = cut(grid), cut(state)
    return grid


def differences(grid: DataFrame, res: int, cell: float) -> DataFrame:
    """(i, j, k, v, gx, gy, gz, xx, yy, zz, xy, xz, yz): first and second central differences of the cells; 0 along an axis at its ends."""
    offs = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0) and abs(a) + abs(b) + abs(c) <= 2]
    ways = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "abc")], F.lit(m).alias("m")) for m, o in enumerate(offs)])
    near = grid.select("*", F.explode(ways).alias("w")).select(*[(F.col(x) - F.col(f"w.{n}")).alias(x) for x, n in zip("ijk", "abc")], "w.m", "v")
    at = near.groupBy("i", "j", "k").agg(*[F.sum(F.when(F.col("m") == m, F.col("v")).otherwise(0.0)).alias(f"m{m}") for m in range(len(offs))])
    d = grid.select("i", "j", "k", "v").join(at, ["i", "j", "k"], "left").na.fill(0.0)
    of = {o: F.col(f"m{m}") for m, o in enumerate(offs)}
    inner = {x: (F.col(x) >= 1) & (F.col(x) <= res - 2) for x in "ijk"}

    def at_(**k: int):
        return of[tuple(k.get(x, 0) for x in "ijk")]

    out = {}
    for x, n in zip("ijk", "xyz"):
        out[f"g{n}"] = F.when(inner[x], (at_(**{x: 1}) - at_(**{x: -1})) / (2 * cell)).otherwise(0.0)
        out[n + n] = F.when(inner[x], (at_(**{x: 1}) - 2 * F.col("v") + at_(**{x: -1})) / (cell * cell)).otherwise(0.0)
    for x, y, n in (("i", "j", "xy"), ("i", "k", "xz"), ("j", "k", "yz")):
        mixed = at_(**{x: 1, y: 1}) - at_(**{x: 1, y: -1}) - at_(**{x: -1, y: 1}) + at_(**{x: -1, y: -1})
        out[n] = F.when(inner[x] & inner[y], mixed / (4 * cell * cell)).otherwise(0.0)
    return d.select("i", "j", "k", "v", *[c.alias(n) for n, c in out.items()])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _aligned(g: pd.DataFrame, h: pd.DataFrame) -> pd.Series:
    """Rotation matrix, row by row, with columns normal, tangent, tangent: the eigenvector nearest the gradient, towards it, first."""
    m = h.to_numpy(float)[:, [0, 3, 4, 3, 1, 5, 4, 5, 2]].reshape(-1, 3, 3)
    _, vec = np.linalg.eigh(m)
    grad = g.to_numpy(float)
    size = np.linalg.norm(grad, axis=1, keepdims=True)
    way = np.where(size > 1e-8, grad / np.maximum(size, 1e-8), [0.0, 0.0, 1.0])
    cos = np.einsum("ni,nij->nj", way, vec)
    first = np.abs(cos).argmax(1)
    rest = np.array([[1, 2], [0, 2], [0, 1]])[first]
    row = np.arange(len(m))
    n = vec[row, :, first] * np.where(cos[row, first] < 0, -1.0, 1.0)[:, None]
    r = np.stack([n, vec[row, :, rest[:, 0]], vec[row, :, rest[:, 1]]], 2)
    r[:, :, 2] *= np.where(np.linalg.det(r) < 0, -1.0, 1.0)[:, None]
    return pd.Series(list(r.reshape(-1, 9)))


def grid_blobs(grid: DataFrame, low: Sequence[float], cell: float, threshold: float, most: int) -> DataFrame:
    """(i, j, k, x, y, z, log_scale, opacity, r, g, b): the ``most`` densest cells above a threshold as blobs (ties by i, j, k)."""
    top = grid.where(F.col("v") > threshold).orderBy(F.desc("v"), "i", "j", "k").limit(most)
    return top.select("i", "j", "k", *[(o + (F.col(i) + 0.5) * cell).alias(a) for o, i, a in zip(low, "ijk", "xyz")], F.lit(float(np.log(0.5 * cell))).alias("log_scale"), (1 - F.exp(-F.col("v") * (cell * 3**0.5))).alias("opacity"), *RGB)


def aligned_blobs(grid: DataFrame, res: int, low: Sequence[float], cell: float, threshold: float, most: int, flat: float = 0.4) -> DataFrame:
    """The same with a rotation that follows the grid's second differences, flattened along the normal."""
    b = grid_blobs(grid, low, cell, threshold, most).drop("log_scale")
    d = differences(grid, res, cell)
    m = b.join(d.drop("v"), ["i", "j", "k"]).withColumn("m", _aligned(F.struct("gx", "gy", "gz"), F.struct("xx", "yy", "zz", "xy", "xz", "yz")))
    q = quaternion([[F.col("m")[3 * r + c] for c in range(3)] for r in range(3)])
    scales = [float(np.log(0.5 * cell * s)) for s in (flat, 1.0, 1.0)]
    return m.select(*b.columns, *[c.alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"))], *[F.lit(s).alias(n) for s, n in zip(scales, ("sx", "sy", "sz"))])
