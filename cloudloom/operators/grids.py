"""Voxels, cells and neighbourhoods on regular grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def voxel(cols: Sequence[str], size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("bigint").alias(f"v{c}") for c in cols]


def voxel_downsample(df: DataFrame, size: float, mean: Sequence[str] = ("x", "y", "z"), by: Sequence[str] = ()) -> DataFrame:
    """One row a voxel: count and means. The voxel is its exact integer key, so cells never merge."""
    keyed = df.select(*by, *voxel("xyz", size), *mean)
    return keyed.groupBy(*by, "vx", "vy", "vz").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in mean])


def cell_key(x: Column, y: Column, z: Column, grid: int = 32) -> Column:
    """Key of a point of the unit cube in a grid**3; the upper faces belong to the last cell."""
    i = [F.greatest(F.lit(0), F.least(F.floor(c * grid), F.lit(grid - 1))) for c in (x, y, z)]
    return (i[0] + grid * i[1] + grid * grid * i[2]).cast("bigint")


def edge_checks(edges: DataFrame, points: DataFrame, group: str = "scene_id") -> DataFrame:
    """One row: self edges, edges out of order, edges to no point of the group, edges in all."""
    w = W.partitionBy(group, "src").orderBy("rank")
    e = edges.withColumn("back", F.coalesce(F.col("d2") - F.lag("d2").over(w), F.lit(0.0)))
    e = e.join(points.select(group, F.col("id").alias("dst"), F.lit(True).alias("there")), [group, "dst"], "left")
    return e.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_edges"), F.count_if(F.col("back") < -1e-9).alias("unsorted"), F.count_if(F.col("there").isNull()).alias("out_of_range"), F.count("*").alias("edges"))


def with_ends(edges: DataFrame, points: DataFrame, cols: Sequence[str], group: str = "scene_id") -> DataFrame:
    """Edges with the columns of both ends, as s_ and d_."""
    s = points.select(group, F.col("id").alias("src"), *[F.col(c).alias(f"s_{c}") for c in cols])
    t = points.select(group, F.col("id").alias("dst"), *[F.col(c).alias(f"d_{c}") for c in cols])
    return edges.join(s, [group, "src"]).join(t, [group, "dst"])


def total_variation_gradient(grid: DataFrame, value: str = "v") -> DataFrame:
    """(i, j, k, tv): sum over the present six neighbours of value minus the neighbour's."""
    ways = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    out = grid.select("*", F.explode(ways).alias("w")).select((F.col("i") + F.col("w.a")).alias("i"), (F.col("j") + F.col("w.b")).alias("j"), (F.col("k") + F.col("w.c")).alias("k"), F.col(value).alias("nb"))
    return grid.join(out, ["i", "j", "k"]).groupBy("i", "j", "k").agg(F.sum(F.col(value) - F.col("nb")).alias("tv"))


def subdivide(cells: DataFrame, chosen: Column, factor: int = 2) -> DataFrame:
    """Leaves and children: chosen cells become factor**3 rows of the same values, the others stay (fx, fy, fz null)."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    fine = cells.where(chosen)
    for c in ("fx", "fy", "fz"):
        fine = fine.withColumn(c, F.explode(steps))
    coarse = cells.where(~F.coalesce(chosen, F.lit(False)))
    for c in ("fx", "fy", "fz"):
        coarse = coarse.withColumn(c, F.lit(None).cast("int"))
    return coarse.unionByName(fine)
