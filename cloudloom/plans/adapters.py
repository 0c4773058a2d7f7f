"""The given tables in the shape the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloudloom.plans.session import table


def valid_splats(spark: SparkSession, d: str) -> DataFrame:
    """The valid version of every splat, flat and in doubles; nulls and NaN stay."""
    s = table(spark, d, "splats")
    cols = ["scene_id", "x", "y", "z", "scales", "quats", "opacity", "sh_dc", "sh_rest", "tier"]
    v = s.groupBy("splat_id").agg(F.max_by(F.struct(*cols), "loaded_at").alias("v"))
    flat = [F.col("splat_id").alias("id"), F.col("v.scene_id").alias("scene_id"), *[F.col(f"v.{c}").cast("double").alias(c) for c in "xyz"]]
    flat += [F.col("v.scales")[i].cast("double").alias(n) for i, n in enumerate(("sx", "sy", "sz"))]
    flat += [F.col("v.quats")[i].cast("double").alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))]
    flat += [F.col("v.opacity").cast("double").alias("opacity")]
    flat += [F.col("v.sh_dc")[i].cast("double").alias(n) for i, n in enumerate(("dc_r", "dc_g", "dc_b"))]
    return v.select(*flat, F.col("v.sh_rest").alias("sh_rest"), F.col("v.tier").cast("int").alias("tier"))


def whole_splats(spark: SparkSession, d: str) -> DataFrame:
    """Valid splats with finite coordinates, opacity and tier: what a renderer takes."""
    s = valid_splats(spark, d)
    return s.where(finite("x") & finite("y") & finite("z") & F.col("opacity").isNotNull() & F.col("tier").isNotNull() & F.col("sh_rest").isNotNull())


def finite(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """A cloud of order lines: key columns, and three measures scaled to [0, 1] by global bounds."""
    raw = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), (F.col("l_discount") + F.col("l_tax")).alias("c"), "l_returnflag", "l_shipdate")
    bounds = raw.agg(*[f(c).alias(f"{c}_{n}") for c in "abc" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    p = raw.crossJoin(bounds)  # one row
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", *[((F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo"))).alias(n) for c, n in zip("abc", "xyz")])


#: The same views in SQL, for the twins of the queries.
SPLATS_SQL = """v AS (SELECT splat_id AS id, scene_id, x::DOUBLE x, y::DOUBLE y, z::DOUBLE z, scales[1]::DOUBLE sx, scales[2]::DOUBLE sy, scales[3]::DOUBLE sz,
 quats[1]::DOUBLE qw, quats[2]::DOUBLE qx, quats[3]::DOUBLE qy, quats[4]::DOUBLE qz, opacity::DOUBLE opacity, sh_dc[1]::DOUBLE dc_r, sh_dc[2]::DOUBLE dc_g, sh_dc[3]::DOUBLE dc_b, sh_rest, tier::INT tier
 FROM (SELECT *, row_number() OVER (PARTITION BY splat_id ORDER BY loaded_at DESC) rn FROM splats) WHERE rn = 1),
s AS (SELECT * FROM v WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND opacity IS NOT NULL AND tier IS NOT NULL AND sh_rest IS NOT NULL)"""

POINTS_SQL = """raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_shipdate, l_quantity a, l_extendedprice b, l_discount + l_tax c FROM lineitem),
bnd AS (SELECT min(a) a0, max(a) a1, min(b) b0, max(b) b1, min(c) c0, max(c) c1 FROM raw),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_shipdate, (a-a0)/(a1-a0) x, (b-b0)/(b1-b0) y, (c-c0)/(c1-c0) z FROM raw, bnd)"""
