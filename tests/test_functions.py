import math

import numpy as np
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G, quant as Q, shading as S
from cloudloom.operators import fits


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def lits(*v):
    return [F.lit(float(x)) for x in v]


def test_closest_point_minimises(spark):
    theta, sigma, u = (1.0, -2.0, 0.0, 0.0, 0.0), (1.0, 1.0, 0.5), (0.3, -0.2, 0.01)
    s, t = one(spark, *S.closest_on_germ(lits(*theta), lits(*sigma), lits(*u), rounds=12, lam=0.0))
    grid = np.linspace(-1, 1, 801)
    a, b = np.meshgrid(grid, grid, indexing="ij")
    cost = (u[0] - a) ** 2 + (u[1] - b) ** 2 + (u[2] - (a * a - 2 * b * b)) ** 2 / 0.25
    i = np.unravel_index(cost.argmin(), cost.shape)
    assert abs(s - a[i]) < 1e-2 and abs(t - b[i]) < 1e-2


def test_gradients_by_differences(spark):
    theta, s, t, e = lits(1, -1.5, 0.5, -0.3, 0.1), 0.4, -0.2, 1e-5
    v = lambda a, b: one(spark, S.germ_value(theta, F.lit(a), F.lit(b)))[0]
    gs, gt = one(spark, *S.germ_gradient(theta, F.lit(s), F.lit(t)))
    assert abs(gs - (v(s + e, t) - v(s - e, t)) / (2 * e)) < 1e-6 and abs(gt - (v(s, t + e) - v(s, t - e)) / (2 * e)) < 1e-6


def test_flat_germ_is_gaussian(spark):
    for m in (0.0, 0.25, 1.0, 4.0):
        a, b, c = one(spark, S.gaussian_density(F.lit(m)), S.germ_density(F.lit(m), F.lit(0.0)), S.curved_density(F.lit(m), F.lit(0.0), F.lit(0.0)))
        assert abs(a - math.exp(-m / 2)) < 1e-12 and abs(a - b) < 1e-12 and abs(a - c) < 1e-12


def test_normals_and_codes_round_trip(spark):
    rng = np.random.default_rng(42)
    n = rng.normal(size=(500, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    df = spark.createDataFrame(n.tolist(), "x double, y double, z double")
    u, v = Q.oct_encode(F.col("x"), F.col("y"), F.col("z"))
    p = df.select("*", Q.pack_12_12(Q.oct_code(u), Q.oct_code(v)).alias("p"))
    a, b = Q.unpack_12_12(F.col("p"))
    back = p.select("x", "y", "z", *[c.alias(f"b{i}") for i, c in enumerate(Q.oct_decode(a / 4095.0 * 2 - 1, b / 4095.0 * 2 - 1))]).toPandas().to_numpy()
    assert np.arccos(np.clip((back[:, :3] * back[:, 3:]).sum(1), -1, 1)).max() < 0.01
    z = spark.range(-200, 200).select(F.col("id").cast("int").alias("v")).withColumn("z", Q.zigzag(F.col("v")))
    assert z.where(Q.unzigzag(F.col("z")) != F.col("v")).count() == 0 and z.agg(F.max("z")).first()[0] == 399


def test_half_even_and_nulls(spark):
    assert one(spark, Q.u24_encode(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)), Q.u24_encode(F.lit(2.0), F.lit(0.0), F.lit(1.0)), Q.u24_encode(F.lit(0.3), F.lit(1.0), F.lit(1.0)), Q.step(F.lit(2.5)), Q.step(F.lit(-2.5), "truncate")) == (None, Q.U24, 0, 2.0, -2)


def test_rotation_and_contraction(spark):
    q = np.array([0.3, -0.5, 0.7, 0.2])
    q /= np.linalg.norm(q)
    back = one(spark, *G.quaternion(G.rotation(lits(*q))))
    assert abs(abs(np.dot(back, q)) - 1) < 1e-9
    for p in ((0.1, 0.2, 0.3), (3.0, -4.0, 12.0)):
        c = one(spark, *G.contract(lits(*p)))
        assert np.linalg.norm(c) < 2 and np.allclose(one(spark, *G.uncontract(lits(*c))), p)


def test_group_fits_match_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(g, *p) for g in range(3) for p in rng.normal(size=(40, 3)).tolist()] + [(9, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double")
    fit = {r.g: r for r in fits.germ_fit(df, ["g"]).collect()}
    assert list(fit[9].theta) == [0.0] * 5
    eig = {r.g: r.e for r in fits.moments(df, ["g"]).select("g", fits.eigenvalues("c_xx", "c_xy", "c_xz", "c_yy", "c_yz", "c_zz").alias("e")).collect()}
    for g in range(3):
        p = np.array([r[1:] for r in rows if r[0] == g])
        x, y, z = (p - p.mean(0)).T
        m = np.stack([x * x, y * y, x**3 - 3 * x * y * y, 3 * x * x * y - y**3, x**4 + y**4], 1)
        th = np.linalg.solve(m.T @ m + 1e-6 * np.eye(5), m.T @ z)
        assert np.allclose(fit[g].theta, th) and abs(fit[g].rmse - np.sqrt(((m @ th - z) ** 2).mean())) < 1e-9
        assert np.allclose(eig[g], np.linalg.eigvalsh(np.cov(p.T))[::-1])
