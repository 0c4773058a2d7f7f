"""Local surface fits of groups: moments as plain sums, small solves in one vectorised UDF."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cloudloom.functions.shading import germ_basis


def moments(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n, mean_*, c_*): means and the six covariances with divisor n - 1; one shuffle of partial sums."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    m = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in "xyz"], *[F.covar_samp(a, b).alias(f"c_{a}{b}") for a, b in pairs])
    return m


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def eigenvalues(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
    """Descending eigenvalues of symmetric 3x3 matrices; not finite entries count as 0."""
    a = np.nan_to_num(np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], 1).astype(float).reshape(-1, 3, 3))
    return pd.Series(list(np.linalg.eigvalsh(a)[:, ::-1]))


def normal_equations(df: DataFrame, by: Sequence[str], basis: Sequence[Column], target: Column) -> DataFrame:
    """(by..., n, m_ij, v_i, tt): the sums of M^T M, M^T b and b^2."""
    k = len(basis)
    named = df.select(*by, *[c.alias(f"b{i}") for i, c in enumerate(basis)], target.alias("t"))
    sums = [F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"m_{i}{j}") for i in range(k) for j in range(i, k)]
    return named.groupBy(*by).agg(F.count("*").alias("n"), *sums, *[F.sum(F.col(f"b{i}") * F.col("t")).alias(f"v_{i}") for i in range(k)], F.sum(F.col("t") * F.col("t")).alias("tt"))


def solve(eq: DataFrame, by: Sequence[str], k: int, ridge: float = 1e-6, least: int = 6) -> DataFrame:
    """(by..., n, theta, rmse) of ridge least squares; groups of fewer than ``least`` rows keep theta = 0."""
    names = [f"m_{i}{j}" for i in range(k) for j in range(i, k)] + [f"v_{i}" for i in range(k)]

    @F.pandas_udf("struct<theta:array<double>,rmse:double>")
    def run(n: pd.Series, tt: pd.Series, sums: pd.DataFrame) -> pd.DataFrame:
        s = sums.to_numpy(float)
        a = np.zeros((len(s), k, k))
        i, j = np.triu_indices(k)
        a[:, i, j] = a[:, j, i] = s[:, : len(i)]
        v = s[:, len(i) :]
        theta = np.linalg.solve(a + ridge * np.eye(k), v[..., None])[..., 0]
        theta[n.to_numpy() < least] = 0
        sse = tt.to_numpy(float) - 2 * (theta * v).sum(1) + np.einsum("ni,nij,nj->n", theta, a, theta)
        return pd.DataFrame({"theta": list(theta), "rmse": np.sqrt(np.maximum(sse, 0) / n.to_numpy())})

    return eq.select(*by, "n", run("n", "tt", F.struct(*names)).alias("r")).select(*by, "n", "r.theta", "r.rmse")


def germ_fit(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Germ of z over (x, y) per group, about the group's mean."""
    m = df.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in "xyz"])
    d = df.join(m, list(by)).select(*by, *[(F.col(c) - F.col(f"mean_{c}")).alias(c) for c in "xyz"])
    return solve(normal_equations(d, by, germ_basis(F.col("x"), F.col("y")), F.col("z")), by, 5)


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("values", "axes")]))
def _eigen(m: pd.DataFrame) -> pd.DataFrame:
    a = np.nan_to_num(m.to_numpy(float))[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    w, v = np.linalg.eigh(a)
    return pd.DataFrame({"values": list(w[:, ::-1]), "axes": list(v[:, :, ::-1].transpose(0, 2, 1).reshape(-1, 9))})


def frames(m: DataFrame) -> DataFrame:
    """Adds values and axes (three unit vectors, flat, by falling variance) to ``moments``; groups of fewer than three rows keep the coordinate axes."""
    e = m.withColumn("__e", _eigen(F.struct("c_xx", "c_xy", "c_xz", "c_yy", "c_yz", "c_zz")))
    few = F.col("n") < 3
    unit = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    return e.select(*m.columns, F.when(few, F.array(F.lit(0.0025), F.lit(0.0025), F.lit(0.0001))).otherwise(F.col("__e.values")).alias("values"), F.when(few, unit).otherwise(F.col("__e.axes")).alias("axes"))


def kmeans_labels(df: DataFrame, k: int, cols: Sequence[str] = ("x", "y", "z"), weight: str | None = None, rounds: int = 20, seed: int = 7) -> DataFrame:
    """Adds label (0 to k - 1): Lloyd's rounds on all executors from k-means|| seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=list(cols), outputCol="__v").transform(df)
    model = KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="__v", predictionCol="label", **({"weightCol": weight} if weight else {})).fit(v)
    return model.transform(v).drop("__v")


def blobs(points: DataFrame, k: int) -> DataFrame:
    """(label, n, mean_*, values, axes, theta, flat2, germ2): each cluster's frame, germ, and squared errors of plane and germ."""
    p = kmeans_labels(points.select("x", "y", "z"), k)
    f = frames(moments(p, ["label"])).select("label", "n", "mean_x", "mean_y", "mean_z", "values", "axes")
    rel = [F.col(c) - F.col(f"mean_{c}") for c in "xyz"]
    local = p.join(f, "label").select("label", *[sum((F.col("axes")[3 * i + j] * rel[j] for j in (1, 2)), F.col("axes")[3 * i] * rel[0]).alias(n) for i, n in enumerate("stu")])
    eq = normal_equations(local, ["label"], germ_basis(F.col("s"), F.col("t")), F.col("u"))
    fit = solve(eq, ["label"], 5).drop("n")
    return f.join(fit, "label").join(eq.select("label", F.col("tt").alias("flat2")), "label").withColumn("germ2", F.col("rmse") * F.col("rmse") * F.col("n"))


def blob_rmse(b: DataFrame) -> DataFrame:
    """(label, n, flat, germ): root mean squares of each blob, and of all (label null), weighted by points."""
    r = b.rollup("label").agg(F.sum("n").alias("n"), F.sum("flat2").alias("f"), F.sum("germ2").alias("g"))
    return r.select("label", "n", F.sqrt(F.col("f") / F.col("n")).alias("flat"), F.sqrt(F.col("g") / F.col("n")).alias("germ"))


def matching_budget(points: DataFrame, germs: int, most: int) -> tuple[int, float, float]:
    """(least doubling budget of flat blobs whose error is at most that of ``germs`` germ blobs or -1, that error, the target)."""
    total = lambda k: blob_rmse(blobs(points, k)).where("label IS NULL").first()
    target, budget, flat = total(germs).germ, 16, float("inf")
    while budget <= most:
        flat = total(budget).flat
        if flat <= target:
            return budget, flat, target
        budget *= 2
    return -1, flat, target


def blob_points(b: DataFrame, each: int = 64) -> DataFrame:
    """(label, i, x, y, z): points of each germ surface within two spreads, evenly placed."""
    from cloudloom.functions.shading import germ_value
    from cloudloom.operators.surfaces import pair

    p = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    u, v = pair(F.col("i").cast("double"))
    wide = [F.greatest(F.sqrt(F.greatest(F.col("values")[k], F.lit(1e-8))), F.lit(1e-3)) for k in (0, 1)]
    p = p.withColumns({"s": (4 * u - 2) * wide[0], "t": (4 * v - 2) * wide[1]})
    p = p.withColumn("h", germ_value([F.col("theta")[k] for k in range(5)], F.col("s"), F.col("t")))
    return p.select("label", "i", *[(F.col(f"mean_{c}") + F.col("axes")[j] * F.col("s") + F.col("axes")[3 + j] * F.col("t") + F.col("axes")[6 + j] * F.col("h")).alias(c) for j, c in enumerate("xyz")])


def codebook_error(q: DataFrame, k: int) -> DataFrame:
    """(g, codes, n, rmse): k-means codebooks of (id, q), one for each 15 coefficients, and the error they leave."""
    out = None
    for g in range(3):
        part = q.select("id", *[F.col("q")[15 * g + i].cast("double").alias(f"q{i}") for i in range(15)])
        lab = kmeans_labels(part, k, [f"q{i}" for i in range(15)])
        codes = lab.groupBy("label").agg(*[F.rint(F.avg(f"q{i}")).alias(f"m{i}") for i in range(15)])
        err = lab.join(codes, "label").agg(F.lit(g).alias("g"), F.countDistinct("label").alias("codes"), F.count("*").alias("n"), F.round(F.sqrt(F.avg(sum(((F.col(f"q{i}") - F.col(f"m{i}")) ** 2 for i in range(1, 15)), (F.col("q0") - F.col("m0")) ** 2) / 15)), 3).alias("rmse"))
        out = err if out is None else out.unionByName(err)
    return out
