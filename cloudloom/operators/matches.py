"""Binary features between cameras, tracks, small camera graphs and two-view points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from cloudloom.plans.sizing import small_enough


def ratio_matches(features: DataFrame, ratio: float, ahead: int) -> DataFrame:
    """(c0, c1, k0, k1, d1, d2): each feature's nearest in each of the next ``ahead`` cameras, if nearer than ``ratio`` times the second (ties by smaller key).

    ``features``: (cam, kpt, bits BIGINT). An equi-join of cameras; the two best are found by
    one aggregation, so the pairs of a camera pair are neither sorted nor kept.
    """
    a = features.select(F.col("cam").alias("c0"), F.col("kpt").alias("k0"), F.col("bits").alias("b0")).withColumn("c1", F.explode(F.sequence(F.col("c0") + 1, F.col("c0") + ahead)))
    b = features.select(F.col("cam").alias("c1"), F.col("kpt").alias("k1"), F.col("bits").alias("b1"))
    p = a.join(b, "c1").select("c0", "c1", "k0", "k1", F.bit_count(F.col("b0").bitwiseXOR(F.col("b1"))).alias("d"))
    n = F.row_number().over(W.partitionBy("c0", "c1", "k0").orderBy("d", "k1"))
    two = p.withColumn("n", n).where("n <= 2").groupBy("c0", "c1", "k0").agg(F.max(F.when(F.col("n") == 1, F.col("k1"))).alias("k1"), F.max(F.when(F.col("n") == 1, F.col("d"))).alias("d1"), F.max(F.when(F.col("n") == 2, F.col("d"))).alias("d2"))
    return two.where(F.col("d1") < ratio * F.col("d2")).select("c0", "c1", "k0", "k1", "d1", "d2")


def tracked(matches: DataFrame, tracks: DataFrame) -> DataFrame:
    """(c1, k1, point): the known points of a camera's matches in the further camera; of several the nearest descriptor."""
    j = matches.join(tracks.select(F.col("cam").alias("c0"), F.col("kpt").alias("k0"), "point"), ["c0", "k0"])
    n = F.row_number().over(W.partitionBy("c1", "point").orderBy("d1", "k1", "k0"))
    return j.withColumn("n", n).where("n = 1").select("c1", "k1", "point")


def spanning_tree(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """(parent, child, w): the tree of greatest weights from the node with most edges; other components are left out.

    Cameras, not points: at most ``most`` edges (checked). Ties by smaller nodes.
    """
    if not small_enough(edges, most):
        raise ValueError("more edges than a graph of cameras has")
    near: dict[int, list[tuple[int, int]]] = {}
    for a, b, w in edges.select("a", "b", "w").collect():
        near.setdefault(a, []).append((w, b))
        near.setdefault(b, []).append((w, a))
    rows, seen = [], set()
    if near:
        seen.add(min(near, key=lambda v: (-len(near[v]), v)))
        while True:
            open_ = [(-w, p, c) for p in seen for w, c in near[p] if c not in seen]
            if not open_:
                break
            w, p, c = min(open_)
            rows.append((p, c, -w))
            seen.add(c)
    return edges.sparkSession.createDataFrame(rows, "parent bigint, child bigint, w bigint")


def projection(cam, focal: float, cx: float, cy: float) -> np.ndarray:
    """3 x 4 matrix of a row (ex, ey, ez, r00 .. r22)."""
    r = np.array([[cam[f"r{i}{j}"] for j in range(3)] for i in range(3)])
    e = np.array([cam.ex, cam.ey, cam.ez])
    return np.array([[focal, 0, cx], [0, focal, cy], [0, 0, 1]]) @ np.hstack([r, (-r @ e)[:, None]])


def triangulate(two: DataFrame, p0: np.ndarray, p1: np.ndarray, near: float = 0.05) -> DataFrame:
    """(id, x, y, z) of (id, u0, w0, u1, w1) by the linear method; points behind a camera (depth under ``near``) are left out."""

    @F.pandas_udf("struct<x:double,y:double,z:double,d0:double,d1:double>")
    def run(u0: pd.Series, w0: pd.Series, u1: pd.Series, w1: pd.Series) -> pd.DataFrame:
        rows = [u[:, None] * p[2] - p[k] for p, pair in ((p0, (u0, w0)), (p1, (u1, w1))) for k, u in enumerate(s.to_numpy(float) for s in pair)]
        x = np.linalg.svd(np.stack(rows, 1))[2][:, -1]
        x = x / x[:, 3:]
        return pd.DataFrame({"x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "d0": x @ p0[2], "d1": x @ p1[2]})

    m = two.select("id", run("u0", "w0", "u1", "w1").alias("m"))
    return m.select("id", "m.*").where((F.col("d0") > near) & (F.col("d1") > near)).select("id", "x", "y", "z")
