import numpy as np
import pytest

from cloudloom.llm import neighbours as N


def brute(rows):
    out = set()
    for g, i, x, k in rows:
        if x is None or not np.all(np.isfinite(x)):
            continue
        others = sorted((float(np.sum((np.array(x) - np.array(y)) ** 2)), j) for h, j, y, _ in rows if h == g and j != i and y is not None and np.all(np.isfinite(y)))
        out |= {(i, j) for _, j in others[:k]}
    return out


def run(spark, rows, cap):
    df = spark.createDataFrame(rows, "g int, id bigint, x array<double>, k int")
    return {(r.q, r.id) for r in N.nearest(df, 3, cap=cap).collect()}


@pytest.mark.parametrize("cap", [16, 1024])
def test_uneven_groups_ties_copies_and_outliers(spark, cap):
    rng = np.random.default_rng(3)
    rows = [(1, i, rng.normal(size=3).tolist(), 4) for i in range(150)]
    rows += [(1, 200 + i, (rng.normal(size=3) * 1e-3 + 5).tolist(), 4) for i in range(120)]  # a dense spot
    rows += [(2, 400 + i, [float(i % 4), float(i // 4 % 4), 0.0], 3) for i in range(32)]  # a lattice: ties, places held twice
    rows += [(3, 500 + i, [1.0, 2.0, 3.0], 2) for i in range(42)]  # one crowded place
    rows += [(3, 620, [1.5, 2.0, 3.0], 2), (4, 700, [0.0, 0.0, 0.0], 4), (5, 800, [0.0, 0.0, 0.0], 4), (5, 801, [9.0, 0.0, 0.0], 4)]
    rows += [(1, 900, [float("nan"), 0.0, 0.0], 4), (1, 901, None, 4), (1, 902, [float("inf"), 0.0, 0.0], 4)]
    assert run(spark, rows, cap) == brute(rows)


def test_empty(spark):
    assert run(spark, [], 16) == set()


def test_boxes_within_a_bucket(spark):
    x = np.random.default_rng(3).normal(size=(3000, 3))
    x[:1000] *= 0.01
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    best = np.argsort(d2, 1, kind="stable")[:, :4]
    df = spark.createDataFrame([(1, i, v.tolist(), 4) for i, v in enumerate(x)], "g int, id bigint, x array<double>, k int")
    for cap in (700, 4096):
        got = {(r.q, r.id) for r in N.nearest(df, 3, cap=cap).collect()}
        assert got == {(i, int(j)) for i in range(len(x)) for j in best[i]}


def test_probes_bound_the_visits_and_recall_grows_with_them(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in e]), np.array([r[1] for r in e], float)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    best = np.argsort(d2, 1, kind="stable")[:, :10]
    want = {(ids[i], ids[j]) for i in range(len(x)) if ids[i] % 20 == 0 for j in best[i]}
    df = spark.createDataFrame([(0, int(i), v.tolist()) for i, v in zip(ids, x)], "g int, id bigint, x array<double>")
    recall = []
    for probes in (0, 20, 120):
        got = {(r.q, r.id) for r in N.nearest(df, 64, 10, df["id"] % 20 == 0, tables=4, projections=6, cap=32, probes=probes).collect()}
        recall.append(len(got & want) / len(want))
    assert recall[0] < recall[1] < recall[2] and recall[2] >= 0.9
