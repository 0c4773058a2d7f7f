import numpy as np
from pyspark.sql import functions as F

from cloudloom.llm import mixing as M


def test_shares_repeats_and_order(spark):
    rng = np.random.default_rng(0)
    docs = [(i, "Big_A" if i % 3 else "big-a ", int(rng.integers(5, 50))) for i in range(900)] + [(1000 + i, "small", int(rng.integers(5, 50))) for i in range(60)] + [(2000, None, 5), (2001, "other", 9), (2002, "small", None), (2003, "small", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, n bigint")
    t = spark.createDataFrame([("big_a", 0.7, 1), ("small", 0.25, 4), ("gone", 0.05, 2)], "source string, target_share double, max_repeats int")
    drawn = M.draw(d, t, F.col("n")).cache()
    s = {r.source: r for r in M.shares(drawn, t).collect()}
    assert s["gone"].tokens == 0 and s["gone"].actual_share == 0
    assert abs(s["big_a"].actual_share - 0.7 / 0.95) < 0.01 and abs(s["small"].actual_share - 0.25 / 0.95) < 0.01
    assert s["small"].repeats <= 4 and s["big_a"].repeats == 1
    rows = drawn.collect()
    assert all(0 <= r.position <= 1 for r in rows)
    assert len({(r.doc_id, r["pass"]) for r in rows}) == len(rows)
    early = sum(r.tokens for r in rows if r.source == "small" and r.position < 0.5)
    late = sum(r.tokens for r in rows if r.source == "small" and r.position >= 0.5)
    assert late > early  # the scarce source comes late


def test_plan_fills_up_to_caps():
    plan = M.plan_tokens([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 100, "b": 1000}, total=600)
    assert plan == {"a": 100.0, "b": 500.0}
    assert M.plan_tokens([("a", 0.5, 1)], {}) == {}


def test_inverse_demand_is_the_inverse(spark):
    for knots in ([(0.0, 1.9), (1.0, 0.1)], [(0.0, 1.0)], [(0.2, 0.0), (0.5, 3.0), (0.9, 1.0)], [(0.0, 0.0), (0.4, 0.0), (0.6, 1.0)]):
        k = M.demand_knots(knots)
        t = np.linspace(0, 1, 2001)
        w = np.interp(t, [x[0] for x in k], [x[1] for x in k])
        c = np.append(0, np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t)))
        rows = spark.createDataFrame([(float(x), k) for x in (0.0, 0.1, 0.37, 0.5, 0.8, 0.999)], "u double, k array<struct<t:double,w:double,c:double>>")
        for r in rows.select("u", M.inverse_demand(F.col("u"), F.col("k")).alias("t")).collect():
            assert abs(np.interp(r.t, t, c) - r.u) < 1e-4


def test_given_schedule_sets_the_time(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(400)], "doc_id bigint, source string, n bigint")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    s = spark.createDataFrame([("A ", 0.0, 1.0), ("a", 0.5, 0.0), ("b", 0.5, 0.0), ("b", 1.0, 1.0)], "source string, t double, weight double")
    rows = M.draw(d, t, F.col("n"), schedule=s).collect()
    assert sum(r.source == "a" for r in rows) == sum(r.source == "b" for r in rows) == 200
    assert all(r.position <= 0.5 for r in rows if r.source == "a") and all(r.position >= 0.5 for r in rows if r.source == "b")


def test_shares_of_real_tokens(spark):
    from collections import Counter

    from cloudloom.llm import queries as Q

    got = {r.source: r for r in Q.p7_shares(spark, "/root/testdata/sf0.001").collect()}
    drawn = Counter()
    for r in Q.p7_mix(spark, "/root/testdata/sf0.001").collect():
        drawn[r.source] += r.tokens
    assert {s: r.tokens for s, r in got.items() if r.tokens} == dict(drawn)
    assert all(abs(r.actual_share - drawn[s] / sum(drawn.values())) < 1e-12 for s, r in got.items())


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, source string, n bigint")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert M.draw(d, t, F.col("n")).count() == 0
