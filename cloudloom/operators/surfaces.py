"""Point surfaces made and sampled without randomness: golden-ratio sequences in place of seeded generators.

A coordinate of the i-th point is the fraction of i times a fixed irrational number, so the
points of every scene are the same on any number of executors, and SQL can make them too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fractions of the two-dimensional golden sequence (fixed numbers).
U, V = 0.7548776662466927, 0.5698402909980532


def pair(i: Column) -> tuple[Column, Column]:
    """Two numbers in [0, 1) of the i-th point, evenly spread."""
    u, v = i * U + 0.5, i * V + 0.5
    return u - F.floor(u), v - F.floor(v)


def _square(i: Column, height: Callable[[Column, Column], Column], tall: float = 1.0) -> tuple[Column, ...]:
    u, v = pair(i)
    s, t = 2 * u - 1, (2 * v - 1) * tall
    return s, t, height(s, t)


def _dome(i: Column) -> tuple[Column, ...]:
    u, v = pair(i)
    z = 0.05 + 0.95 * v
    r = F.sqrt(1 - z * z)
    return r * F.cos(2 * math.pi * u), r * F.sin(2 * math.pi * u), z


#: Stress scenes by name; ``register`` adds to them.
SCENES: dict[str, Callable[[Column], tuple[Column, ...]]] = {
    "plane": lambda i: _square(i, lambda s, t: F.lit(0.0)),
    "sphere": _dome,
    "saddle": lambda i: _square(i, lambda s, t: s * s - t * t),
    "fold": lambda i: _square(i, lambda s, t: s * (s * s - 3 * t * t) * 0.2, 0.8),
    "cusp": lambda i: _square(i, lambda s, t: s * (s * s - 3 * t * t) * 0.25),
    "thin_sheet": lambda i: _square(i, lambda s, t: F.lit(0.0))[:2] + (F.when(i % 2 == 0, 0.02).otherwise(-0.02),),
}


def register(name: str, scene: Callable[[Column], tuple[Column, ...]]) -> None:
    """A scene of one's own: the number of a point to its x, y and z."""
    SCENES[name] = scene


def scene(spark: SparkSession, name: str, n: int) -> DataFrame:
    """(id, x, y, z) of n points of a scene; an unknown name is an error that lists the known ones."""
    if name not in SCENES:
        raise ValueError(f"unknown scene {name!r}; there are {sorted(SCENES)}")
    x, y, z = SCENES[name](F.col("id").cast("double") if name != "thin_sheet" else F.col("id"))
    return spark.range(n).select("id", x.alias("x"), y.alias("y"), z.cast("double").alias("z"))


def golden_sphere(i: Column, n: int, centre=(0.0, 0.0, 0.0), radius: float = 1.0) -> tuple[Column, ...]:
    y = 1 - 2 * (i + 0.5) / n
    r, a = F.sqrt(1 - y * y), (i + 0.5) * (math.pi * (1 + math.sqrt(5)))
    return r * F.cos(a) * radius + centre[0], y * radius + centre[1], r * F.sin(a) * radius + centre[2]


def torus(i: Column, major: float, minor: float, centre=(0.0, 0.0, 0.0)) -> tuple[Column, ...]:
    u, v = pair(i)
    a, b = 2 * math.pi * u, 2 * math.pi * v
    return (major + minor * F.cos(b)) * F.cos(a) + centre[0], minor * F.sin(b) + centre[1], (major + minor * F.cos(b)) * F.sin(a) + centre[2]


def box(i: Column, size: tuple[float, float, float], centre=(0.0, 0.0, 0.0)) -> tuple[Column, ...]:
    """Faces by their area: the first number of a point picks its face and the place along it."""
    sx, sy, sz = size
    areas = [sy * sz, sy * sz, sx * sz, sx * sz, sx * sy, sx * sy]
    total, upto, (u, v) = sum(areas), 0.0, pair(i)
    x = y = z = F.lit(None).cast("double")
    for f, area in enumerate(areas):
        low, upto = upto / total, upto + area
        here = (u >= low) & (u < upto / total)
        p, q, sign = (u - low) / (area / total) - 0.5, v - 0.5, 0.5 if f % 2 == 0 else -0.5
        at = [(F.lit(sign * sx), p * sy, q * sz), (p * sx, F.lit(sign * sy), q * sz), (p * sx, q * sy, F.lit(sign * sz))][f // 2]
        x, y, z = (F.when(here, a).otherwise(o) for a, o in zip(at, (x, y, z)))
    return x + centre[0], y + centre[1], z + centre[2]


def floor(i: Column, sx: float, sz: float, centre=(0.0, 0.0, 0.0)) -> tuple[Column, ...]:
    u, v = pair(i)
    return (u - 0.5) * sx + centre[0], F.lit(float(centre[1])), (v - 0.5) * sz + centre[2]


def studio(spark: SparkSession, n: int = 200) -> DataFrame:
    """(part, id, x, y, z): a made scene of a ball, a box, a ring and a floor, n points each."""
    i = F.col("id").cast("double")
    parts: Mapping[str, tuple[Column, ...]] = {"ball": golden_sphere(i, n, (0.0, 0.5, 0.0), 0.5), "box": box(i, (0.6, 0.4, 0.8), (1.2, 0.2, 0.0)), "ring": torus(i, 0.4, 0.1, (-1.2, 0.1, 0.0)), "floor": floor(i, 4.0, 4.0)}
    out = None
    for name, p in parts.items():
        one = spark.range(n).select(F.lit(name).alias("part"), "id", *[c.alias(a) for c, a in zip(p, "xyz")])
        out = one if out is None else out.unionByName(one)
    return out


def residual_state(spark: SparkSession, n: int) -> DataFrame:
    """(id, x, y, z, tier, approx, residual, sh_q8): a made residual field, exact by construction."""
    i = F.col("id").cast("double")
    u, v = pair(i)
    p = spark.range(n).select("id", (4.4 * u - 2.2).alias("x"), (v - 0.5).alias("y"), (1.7 * (u * v) - 0.8).alias("z"))
    tier = F.when(F.abs("x") < 0.9, 0).when(F.abs("x") < 1.6, 1).otherwise(2).cast("int")
    hashed = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("int")
    p = p.withColumn("tier", tier)
    p = p.withColumn("approx", F.array(*[hashed(k, 121) - 60 for k in range(45)]))
    p = p.withColumn("residual", F.array(*[F.floor(F.pow(hashed(100 + k, 41) / 20.0 - 1, F.lit(3)) * 30).cast("int") + F.col("tier") - 1 for k in range(45)]))
    return p.withColumn("sh_q8", F.zip_with("approx", "residual", lambda a, b: a + b))


def orbit(spark: SparkSession, n: int, distance: float, height: float, look_at=(0.0, 0.0, 0.0)) -> DataFrame:
    """(cam, ex, ey, ez, r00 .. r22): cameras around a point; rows are right, down and ahead."""
    a = F.col("id") * (2 * math.pi / n)
    e = [F.sin(a) * distance + look_at[0], F.lit(float(height)), F.cos(a) * distance + look_at[2]]
    f = [look_at[i] - e[i] for i in range(3)]
    k = F.sqrt(f[0] * f[0] + f[1] * f[1] + f[2] * f[2])
    f = [c / k for c in f]
    w = F.sqrt(f[0] * f[0] + f[2] * f[2])
    r = [-f[2] / w, F.lit(0.0), f[0] / w]
    down = [f[1] * r[2] - f[2] * r[1], f[2] * r[0] - f[0] * r[2], f[0] * r[1] - f[1] * r[0]]
    rows = [r, down, f]
    return spark.range(n).select(F.col("id").cast("int").alias("cam"), *[c.alias(f"e{x}") for c, x in zip(e, "xyz")], *[rows[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)])


def sample_triangles(tri: DataFrame, total: int) -> DataFrame:
    """(file, face, t, n, x, y, z): about ``total`` points spread over triangles (corners a, b, c) by area.

    A triangle's points are those of the even grid over all areas that fall on it, so counts
    add up to ``total`` and need no generator. Areas are summed per file and face first.
    """
    from pyspark.sql import Window as W

    from cloudloom.functions.geometry import triangle_area

    area = triangle_area(*[[F.col(f"{c}{x}") for x in "xyz"] for c in "abc"])
    t = tri.withColumn("area", area)
    w = W.partitionBy("file")  # a mesh, not the table
    t = t.withColumn("upto", F.sum("area").over(w.orderBy("face", "t")) / F.sum("area").over(w)).withColumn("share", F.col("area") / F.sum("area").over(w))
    first, last = F.ceil((F.col("upto") - F.col("share")) * total - 1e-9), F.ceil(F.col("upto") * total - 1e-9) - 1
    t = t.where(first <= last).withColumn("n", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    u, v = pair(F.col("n").cast("double"))
    inside = u + v <= 1
    u, v = F.when(inside, u).otherwise(1 - u), F.when(inside, v).otherwise(1 - v)
    return t.select("file", "face", "t", "n", *[(F.col(f"a{x}") + u * (F.col(f"b{x}") - F.col(f"a{x}")) + v * (F.col(f"c{x}") - F.col(f"a{x}"))).alias(x) for x in "xyz"])
