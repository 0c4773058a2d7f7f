import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import buckets as B, local, ranks


def brute(x, k):
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    return {(i, int(j)) for i, row in enumerate(np.argsort(d2, 1, kind="stable")[:, : min(k, len(x) - 1)]) for j in row}


@pytest.mark.parametrize("cap", [64, 4096])
def test_exact_neighbours_without_a_radius(spark, cap):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, (900, 3))
    x[:300] = x[:300] * 1e-3 + 0.5  # a dense spot
    x[899] = [500.0, 0.0, 0.0]  # an outlier
    df = spark.createDataFrame([(0, i, *v) for i, v in enumerate(x.tolist())], "scene_id int, id int, x double, y double, z double")
    e = B.knn_edges(df, 4) if cap == 4096 else B.nearest(df.select(F.col("scene_id").alias("g"), "id", F.array("x", "y", "z").alias("x")), 3, 4, cap=cap).select(F.col("q").alias("src"), F.col("id").alias("dst"))
    assert {(r.src, r.dst) for r in e.collect()} == brute(x, 4)


def test_crowds_small_groups_and_defects(spark):
    rows = [("a", i, [1.0, 1.0, 1.0]) for i in range(200)] + [("b", 900, [0.0, 0.0, 0.0]), ("b", 901, [1.0, 0.0, 0.0]), ("c", 950, [0.0, 0.0, 0.0]), (None, 960, [0.0] * 3), ("b", None, [0.0] * 3), ("b", 970, None), ("b", 971, [0.0, float("nan"), 0.0])]
    df = spark.createDataFrame(rows, "g string, id bigint, x array<double>")
    got = {(r.q, r.id) for r in B.nearest(df, 3, 2, cap=32).collect()}
    want = {(i, j) for i in range(200) for j in [n for n in (0, 1, 2) if n != i][:2]} | {(900, 901), (901, 900)}
    assert got == want
    assert B.nearest(df.limit(0), 3, 2).count() == 0


def test_normals_of_a_noisy_sphere(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x += rng.normal(size=x.shape) * 1e-3
    df = spark.createDataFrame([(0, i, *v) for i, v in enumerate(x.tolist())], "scene_id int, id int, x double, y double, z double")
    n = {r.id: (r.nx, r.ny, r.nz) for r in local.mls_normals(local.neighbourhoods(df, B.knn_edges(df, 40))).collect()}
    cos = np.abs([np.dot(n[i], x[i] / np.linalg.norm(x[i])) for i in range(len(x))])
    assert np.percentile(np.arccos(np.clip(cos, -1, 1)), 95) < 0.03
    assert all(v[1] >= 0 for v in n.values())


def test_germs_find_a_known_surface():
    rng = np.random.default_rng(2)
    st = rng.uniform(-1, 1, (1, 16, 2))
    h = 0.3 * st[..., 0] ** 2 - 0.2 * st[..., 1] ** 2 + 0.1 * (st[..., 0] ** 3 - 3 * st[..., 0] * st[..., 1] ** 2)
    th = local.germs_of(np.concatenate([st, h[..., None]], 2), np.ones((1, 16), bool), np.array([[1.0, 0, 0, 0]]), np.zeros((1, 3)))
    assert np.allclose(th[0], [0.3, -0.2, 0.1, 0.0, 0.0], atol=1e-3)


def test_ranks_and_differences_of_a_hot_group(spark):
    rows = [("hot" if i % 10 else "cold", (i * 7919) % 1009, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v bigint, id bigint")
    order = [F.col("v"), F.col("id")]
    got = {r.id: r.n for r in ranks.rank_in(df, ["g"], order, "n").collect()}
    diff = {r.id: r.d for r in ranks.difference_in(df, ["g"], order, "v", "d").collect()}
    for g in ("hot", "cold"):
        mine = sorted((v, i) for h, v, i in rows if h == g)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
        assert [diff[i] for _, i in mine] == [None] + [b[0] - a[0] for a, b in zip(mine, mine[1:])]
