import math

from pyspark.sql import functions as F

from cloudloom.operators.compare import Compared, compare_copies, crc32_bits

SCHEMA = "k bigint, g string, a double, v array<float>, at timestamp, field string"
NAN, INF = float("nan"), float("inf")


def run(spark, left, right, **kw):
    mk = lambda rows: spark.createDataFrame(rows, SCHEMA).withColumn("at", F.to_timestamp("at"))
    fields = [Compared("a", "float"), Compared("v", "floats"), Compared("field")]
    out = compare_copies(mk(left), mk(right), ["k", "g"], fields, version="at", **kw)
    return sorted((r.k if r.k is not None else -1, r.g, r.field, r.kind) for r in out.collect())


def row(k, a=1.0, v=(1.0,), at=1, g="x", f="same"):
    import datetime as dt

    return (k, g, a, None if v is None else list(v), dt.datetime(2024, 1, at), f)


def test_every_kind_of_difference(spark):
    left = [row(1), row(2, NAN), row(3, None), row(4, INF), row(5, 1.0), row(6, v=None), row(7, v=(1.0, 2.0)), row(8, v=(NAN,)), row(9, f=None), row(10), row(11, v=())]
    right = [row(1, 1.0 + 1e-7), row(2, NAN), row(3, NAN), row(4, 1.0), row(5, 1.1), row(6), row(7, v=(1.0,)), row(8, v=(NAN,)), row(9, f="x"), row(12), row(11, v=())]
    assert run(spark, left, right) == [(3, "x", "a", "differs"), (4, "x", "a", "differs"), (5, "x", "a", "differs"), (6, "x", "v", "differs"), (7, "x", "v", "differs"), (9, "x", "field", "differs"), (10, "x", "", "only_left"), (12, "x", "", "only_right")]


def test_versions_repeats_and_null_keys(spark):
    left = [row(1, 5.0, at=1), row(1, 6.0, at=2), row(1, 6.0, at=2), row(None, 1.0)]
    right = [row(1, 6.0, at=9), row(1, 7.0, at=3), row(None, 2.0)]
    assert run(spark, left, right) == [(-1, "x", "a", "differs")]


def test_hot_key_and_one_bucket(spark):
    left = [row(1, 1.0, at=1 + i % 28) for i in range(3000)] + [row(i) for i in range(2, 50)]
    assert run(spark, left, [row(i) for i in range(1, 49)], buckets=1) == [(49, "x", "", "only_left")]


def test_empty_sides(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [row(1)]) == [(1, "x", "", "only_right")]


def test_crc_notations(spark):
    t = spark.createDataFrame([("4294967295",), (" -1 ",), ("0xFFFFFFFF",), ("0Xffffffff",), ("junk",), (None,)], "c string")
    got = [r[0] for r in t.select(crc32_bits(F.col("c"))).collect()]
    assert got == [4294967295] * 4 + [None, None]
    assert math.isclose(got[0], 2**32 - 1)
