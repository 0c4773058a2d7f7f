"""Tiles, ordered compositing and image measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cloudloom.functions.geometry import inverse_2x2
from cloudloom.functions.shading import curved_density, gaussian_density


def tiles(splats: DataFrame, size: int, tile: int = 16) -> DataFrame:
    """(ty, tx, ...): a row for every tile that a splat's box touches; a range join by enumeration."""

    def span(c: str) -> Column:
        low = F.greatest(F.lit(0), F.least(F.floor(F.col(c) - F.col("radius")), F.lit(size - 1)))
        high = F.greatest(F.lit(0), F.least(F.ceil(F.col(c) + F.col("radius")), F.lit(size - 1)))
        return F.sequence(F.floor(low / tile), F.floor(high / tile))

    seen = splats.where((F.col("px") + F.col("radius") >= 0) & (F.col("px") - F.col("radius") < size) & (F.col("py") + F.col("radius") >= 0) & (F.col("py") - F.col("radius") < size))
    return seen.withColumn("tx", F.explode(span("px"))).withColumn("ty", F.explode(span("py")))


def by_tier(m: Column) -> Column:
    """Density of a squared distance: Gaussian for tier 2, falling faster with curvature for the others."""
    return F.when(F.col("tier") == 2, gaussian_density(m)).otherwise(curved_density(m, F.col("dc_r"), F.col("dc_g")))


def fragments(splats: DataFrame, size: int, floor: float | None = None, density=gaussian_density) -> DataFrame:
    """(y, x, id, depth, a, r, g, b): what each splat gives to each pixel of its box.

    Shares under 1/255 are left out, or with ``floor`` densities under it. ``density`` maps
    the squared distance to the density and may read other columns.
    """

    def span(c: str) -> Column:
        low = F.greatest(F.lit(0), F.floor(F.col(c) - F.col("radius"))).cast("int")
        high = F.least(F.lit(size - 1), F.ceil(F.col(c) + F.col("radius"))).cast("int")
        return F.when(low <= high, F.sequence(low, high))

    ia, ib, ic = inverse_2x2(F.col("ca"), F.col("cb"), F.col("cc"))
    s = splats.withColumns({"ia": ia, "ib": ib, "ic": ic})
    s = s.withColumn("x", F.explode(span("px"))).withColumn("y", F.explode(span("py")))
    dx, dy = F.col("x") + 0.5 - F.col("px"), F.col("y") + 0.5 - F.col("py")
    m = F.col("ia") * dx * dx + 2 * F.col("ib") * dx * dy + F.col("ic") * dy * dy
    a = F.least(F.col("alpha") * density(m), F.lit(0.999))
    out = s.select("y", "x", "id", "depth", "alpha", a.alias("a"), "r", "g", "b")
    kept = F.col("a") >= 1 / 255 if floor is None else (F.col("a") >= floor * F.col("alpha")) & (F.col("a") > 0)
    return out.where(kept).drop("alpha")


def composite(frags: DataFrame, stop: float = 1e-4) -> DataFrame:
    """(y, x, r, g, b, alpha): front-to-back blending per pixel, ties of depth by id.

    The share of light that still passes is a running product, that is a window sum of
    logarithms; pixels are the partitions, so the work spreads by pixel. What lies behind
    less than ``stop`` is left out, an error of at most ``stop``.
    """
    w = W.partitionBy("y", "x").orderBy("depth", "id").rowsBetween(W.unboundedPreceding, -1)
    t = F.exp(F.coalesce(F.sum(F.log(1 - F.col("a"))).over(w), F.lit(0.0)))
    seen = frags.withColumn("t", t).where(F.col("t") >= stop)
    weight = F.col("t") * F.col("a")
    return seen.groupBy("y", "x").agg(*[F.sum(weight * F.col(c)).alias(c) for c in "rgb"], F.sum(weight).alias("alpha"))


def image_metrics(a: DataFrame, b: DataFrame, mask: Column | None = None) -> DataFrame:
    """One row: mse, mae, psnr (99 for equal images) of two images (y, x, r, g, b); absent pixels are black."""
    p = a.select("y", "x", *[F.col(c).alias(f"a_{c}") for c in "rgb"]).join(b.select("y", "x", *[F.col(c).alias(f"b_{c}") for c in "rgb"]), ["y", "x"], "full_outer").na.fill(0.0)
    if mask is not None:
        p = p.where(mask)
    d = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in "rgb"]
    m = p.agg(F.avg((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / 3).alias("mse"), F.avg((F.abs(d[0]) + F.abs(d[1]) + F.abs(d[2])) / 3).alias("mae"), F.count("*").alias("pixels"))
    return m.select("mse", "mae", F.when(F.col("mse") <= 1e-12, 99.0).otherwise(-10 * F.log10("mse")).alias("psnr"), "pixels")


def dots(points: DataFrame, height: int, width: int) -> DataFrame:
    """(y, x, r, g, b): colours of all points (y, x, r, g, b) of a pixel summed; divided by the largest sum if that is above 1."""
    inside = points.select(*[F.greatest(F.lit(0), F.least(F.col(c).cast("int"), F.lit(n - 1))).alias(c) for c, n in (("y", height), ("x", width))], *"rgb")
    s = inside.groupBy("y", "x").agg(*[F.sum(c).alias(c) for c in "rgb"])
    top = s.agg(F.greatest(F.lit(1.0), *[F.max(c) for c in "rgb"]).alias("top"))
    return s.crossJoin(top).select("y", "x", *[(F.col(c) / F.col("top")).alias(c) for c in "rgb"])  # one row


def nearest_wins(points: DataFrame, height: int, width: int, radius: int) -> DataFrame:
    """(y, x, id, r, g, b): square stamps of points (id, y, x, depth, r, g, b); the nearest takes the pixel, ties by smaller id."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    p = points.withColumn("oy", F.explode(span)).withColumn("ox", F.explode(span)).withColumns({"y": F.col("y") + F.col("oy"), "x": F.col("x") + F.col("ox")})
    p = p.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    best = F.min_by(F.struct("id", *"rgb"), F.struct("depth", "id")).alias("m")
    return p.groupBy("y", "x").agg(best).select("y", "x", "m.*")


def soft_dots(points: DataFrame, height: int, width: int, radius: int, strength: float = 0.55) -> DataFrame:
    """(y, x, r, g, b, alpha): discs drawn offset by offset; of each offset the nearest point takes a pixel, later offsets lie over earlier ones.

    ``points``: (id, y, x, depth, alpha, r, g, b). Colours are those of what covers the pixel.
    """
    offs = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for n, (dy, dx) in enumerate(offs)])
    p = points.withColumn("o", F.explode(each)).withColumns({"y": F.col("y") + F.col("o.dy"), "x": F.col("x") + F.col("o.dx"), "n": F.col("o.n")})
    p = p.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    one = p.groupBy("y", "x", "n").agg(F.min_by(F.struct("alpha", *"rgb"), F.struct("depth", "id")).alias("m"))
    one = one.select("y", "x", "n", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("m.alpha") * strength)).alias("a"), *[F.col(f"m.{c}").alias(c) for c in "rgb"])
    above = W.partitionBy("y", "x").orderBy("n").rowsBetween(1, W.unboundedFollowing)
    one = one.withColumn("t", F.coalesce(F.product(1 - F.col("a")).over(above), F.lit(1.0)))
    s = one.groupBy("y", "x").agg(F.sum(F.col("a") * F.col("t")).alias("alpha"), *[F.sum(F.col("a") * F.col("t") * F.col(c)).alias(c) for c in "rgb"])
    return s.select("y", "x", *[(F.col(c) / F.greatest("alpha", F.lit(1e-6))).alias(c) for c in "rgb"], "alpha")


def round_fragments(splats: DataFrame, height: int, width: int, sharp: float = 2.0) -> DataFrame:
    """(y, x, id, depth, a, r, g, b) of round splats (id, px, py, depth, radius, alpha, r, g, b); falloff exp(-sharp d^2 / radius^2)."""
    r = F.ceil("radius")

    def span(c: str, n: int) -> Column:
        at = F.col(c).cast("int")
        low, high = F.greatest(F.lit(0), at - r), F.least(F.lit(n - 1), at + r)
        return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))

    s = splats.withColumn("y", F.explode(span("py", height))).withColumn("x", F.explode(span("px", width)))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    a = F.least(F.col("alpha") * F.exp(-sharp * (dx * dx + dy * dy) / (F.col("radius") * F.col("radius") + 1e-6)), F.lit(0.999))
    return s.select("y", "x", "id", "depth", a.alias("a"), *"rgb")


def full_frame(image: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel of the frame; absent ones are black."""
    spark = image.sparkSession
    grid = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    return grid.join(image.select("y", "x", *"rgb"), ["y", "x"], "left").na.fill(0.0)


def ssim(a: DataFrame, b: DataFrame, height: int, width: int, window: int = 7, top: float = 1.0) -> DataFrame:
    """(y, x, ssim) of the pixels a whole window around fits: sample moments of luma in square windows, two running sums a moment."""
    grey = lambda p: 0.2126 * F.col(f"{p}r") + 0.7152 * F.col(f"{p}g") + 0.0722 * F.col(f"{p}b")
    j = full_frame(a, height, width).select("y", "x", grey("").alias("p")).join(full_frame(b, height, width).select("y", "x", grey("").alias("q")), ["y", "x"])
    m = j.select("y", "x", "p", "q", (F.col("p") * F.col("p")).alias("pp"), (F.col("q") * F.col("q")).alias("qq"), (F.col("p") * F.col("q")).alias("pq"))
    half, names, n = window // 2, ("p", "q", "pp", "qq", "pq"), window * window
    for line, along in (("y", "x"), ("x", "y")):
        w = W.partitionBy(line).orderBy(along).rowsBetween(-half, half)
        m = m.select("y", "x", *[F.sum(c).over(w).alias(c) for c in names])
    inside = (F.col("y") >= half) & (F.col("y") < height - half) & (F.col("x") >= half) & (F.col("x") < width - half)
    mp, mq = F.col("p") / n, F.col("q") / n
    k = n / (n - 1)
    vp, vq, c = (k * (F.col(s) / n - u) for s, u in (("pp", mp * mp), ("qq", mq * mq), ("pq", mp * mq)))
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    value = (2 * mp * mq + c1) * (2 * c + c2) / ((mp * mp + mq * mq + c1) * (vp + vq + c2))
    return m.where(inside).select("y", "x", value.alias("ssim"))


def undistorted(image: DataFrame, height: int, width: int, focal: float, k1: float, k2: float) -> DataFrame:
    """(y, x, v): an image (y, x, v) without its radial distortion; each pixel is a bilinear mean of the four around its source, outside counts 0."""
    spark = image.sparkSession
    cy, cx = (height - 1) / 2, (width - 1) / 2
    p = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    u, v = (F.col("x") - cx) / focal, (F.col("y") - cy) / focal
    r2 = u * u + v * v
    f = 1 + k1 * r2 + k2 * r2 * r2
    p = p.select("y", "x", (u * f * focal + cx).alias("sx"), (v * f * focal + cy).alias("sy"))
    four = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b in (0, 1) for a in (0, 1)])
    c = p.withColumn("e", F.explode(four))
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    w = F.when(F.col("e.a") == 1, fx).otherwise(1 - fx) * F.when(F.col("e.b") == 1, fy).otherwise(1 - fy)
    c = c.select("y", "x", (F.floor("sy") + F.col("e.b")).cast("int").alias("iy"), (F.floor("sx") + F.col("e.a")).cast("int").alias("ix"), w.alias("w"))
    j = c.join(image.select(F.col("y").alias("iy"), F.col("x").alias("ix"), "v"), ["iy", "ix"], "left")
    return j.groupBy("y", "x").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("v"))
