import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import shading as S
from cloudloom.operators import fits, raster, surfaces, volume as V

BG = (0.1, 0.2, 0.3)


def grid(spark, v):
    rows = [(i, j, k, float(v[i, j, k]), i / 4, j / 4, k / 4) for i in range(4) for j in range(4) for k in range(4)]
    return spark.createDataFrame(rows, "i bigint, j bigint, k bigint, v double, r double, g double, b double")


def test_gradient_is_that_of_the_error(spark):
    v = np.random.default_rng(1).random((4, 4, 4)) * 2
    rays = V.camera_rays(spark, 4, 4.0, (0.5, 0.5, 2.5)).cache()
    at = V.samples(rays, 6, (0, 0, 0), (1, 1, 1)).cache()

    def error(u):
        m = V.march(V.sampled(at, grid(spark, u), 4, (0, 0, 0), 0.25))
        e = V.pixels(rays, m, BG).select("y", "x", *[(F.col(c) - 0.4).alias(f"e_{c}") for c in "rgb"])
        return m, e, e.agg(F.sum(sum((F.col(f"e_{c}") ** 2 for c in "gb"), F.col("e_r") ** 2) / 2)).first()[0]

    m, e, base = error(v)
    got = {(r.i, r.j, r.k): r.grad for r in V.density_gradient(at, m, e, BG, 4, (0, 0, 0), 0.25).collect()}
    for cell in ((1, 1, 2), (2, 1, 1)):
        u = v.copy()
        u[cell] += 1e-5
        assert abs((error(u)[2] - base) / 1e-5 - got[cell]) < 1e-4 * max(1, abs(got[cell]))


def test_fit_lowers_the_error(spark):
    from cloudloom.queries import imaging as I

    r = {x.rounds: x.mse for x in I.voxel_fit(spark, "/root/testdata/sf0.001").collect()}
    assert r[2] < r[0]


def test_equal_pictures_are_similar(spark):
    a = spark.createDataFrame([(y, x, y / 9, x / 9, 0.5) for y in range(9) for x in range(9)], "y int, x int, r double, g double, b double")
    s = raster.ssim(a, a, 9, 9).collect()
    assert len(s) == 9 and all(abs(r.ssim - 1) < 1e-9 for r in s)


def test_scenes_by_name_and_of_ones_own(spark):
    with pytest.raises(ValueError, match="saddle"):
        surfaces.scene(spark, "none", 3)
    surfaces.register("line", lambda i: (i, F.lit(0.0), F.lit(1.0)))
    try:
        assert [tuple(r) for r in surfaces.scene(spark, "line", 2).collect()] == [(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 1.0)]
    finally:
        del surfaces.SCENES["line"]


def test_blobs_weigh_by_points_and_germs_fit_better(spark):
    b = fits.blobs(surfaces.scene(spark, "saddle", 1500), 8).cache()
    r = {x.label: x for x in fits.blob_rmse(b).collect()}
    parts = [x for k, x in r.items() if k is not None]
    assert abs(r[None].flat ** 2 * r[None].n - sum(x.flat**2 * x.n for x in parts)) < 1e-9
    assert r[None].germ < r[None].flat


def test_blurred_environment_is_sharp_without_roughness(spark):
    from cloudloom.operators import light

    env = S.Environment((0.3, -1.0, 0.2))
    d = spark.createDataFrame([(0.1, 0.8, 0.3, 0.0), (0.4, -0.5, 0.2, 0.9)], "x double, y double, z double, roughness double")
    e = light.with_environment(light.with_blurred(d, ("x", "y", "z"), "roughness", env, "b"), ("x", "y", "z"), env, "s").collect()
    assert all(abs(e[0][f"b_{c}"] - e[0][f"s_{c}"]) < 1e-6 for c in "rgb")
    assert all(0 <= e[1][f"b_{c}"] <= 10 for c in "rgb")
