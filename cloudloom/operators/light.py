"""Environments and the composers that read them, column by column.

Each step makes columns of what the next uses more than once, behind a barrier, so that
expressions don't grow into one another.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cloudloom.functions import shading as S
from cloudloom.functions.geometry import dot, unit
from cloudloom.functions.quant import clip
from cloudloom.plans.barrier import settled

N, V, A, F0 = (("n0", "n1", "n2"), ("v0", "v1", "v2"), ("a_r", "a_g", "a_b"), ("f0_r", "f0_g", "f0_b"))


def _cols(names: Sequence[str]):
    return [F.col(n) for n in names]


def with_environment(df: DataFrame, direction: Sequence[str], env: S.Environment, out: str) -> DataFrame:
    """Adds {out}_r, {out}_g, {out}_b: the environment along a direction."""
    names = df.columns
    d = settled(df.select("*", *[c.alias(f"__d{i}") for i, c in enumerate(unit(_cols(direction), 1e-9))]))
    d = settled(d.select("*", *[c.alias(f"__{k}") for k, c in env.terms(_cols(("__d0", "__d1", "__d2"))).items()]))
    rgb = env.colours({k: F.col(f"__{k}") for k in ("up", "glow", "band", "chequer", "near")})
    return settled(d.select(*names, *[c.alias(f"{out}_{n}") for n, c in zip("rgb", rgb)]))


def with_blurred(df: DataFrame, direction: Sequence[str], rough: str, env: S.Environment, out: str, taps: int = 4) -> DataFrame:
    """The same over a cone of half-angle rough * 90 degrees, weighted by its cosine.

    The taps follow a golden-ratio sequence, so that they are the same on every run; below
    a roughness of 0.05 the centre alone counts.
    """
    names = df.columns
    d = settled(df.select("*", *[c.alias(f"__c{i}") for i, c in enumerate(unit(_cols(direction), 1e-9))]))
    x, y, z = _cols(("__c0", "__c1", "__c2"))
    steep = F.abs(y) < 0.99
    up = (F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0), F.lit(0.0))
    t = unit((up[1] * z - up[2] * y, up[2] * x - up[0] * z, up[0] * y - up[1] * x), 1e-9)
    d = settled(d.select("*", *[c.alias(f"__t{i}") for i, c in enumerate(t)]))
    t = _cols(("__t0", "__t1", "__t2"))
    b = (y * t[2] - z * t[1], z * t[0] - x * t[2], x * t[1] - y * t[0])
    d = with_environment(settled(d.select("*", *[c.alias(f"__b{i}") for i, c in enumerate(b)])), ("__c0", "__c1", "__c2"), env, "__e0")
    weights = [F.lit(1.0)]
    for k in range(1, taps):
        phi = 2 * math.pi * ((k * 0.6180339887498949) % 1)
        theta = clip(F.col(rough), 0.0, 1.0) * (math.pi / 2 * math.sqrt((k - 0.5) / (taps - 1)))
        way = [math.cos(phi) * F.sin(theta) * F.col(f"__t{i}") + math.sin(phi) * F.sin(theta) * F.col(f"__b{i}") + F.cos(theta) * F.col(f"__c{i}") for i in range(3)]
        d = settled(d.select("*", *[c.alias(f"__w{k}{i}") for i, c in enumerate(way)], F.cos(theta).alias(f"__k{k}")))
        d = with_environment(d, [f"__w{k}{i}" for i in range(3)], env, f"__e{k}")
        weights.append(F.col(f"__k{k}"))
    total = sum(weights[1:], weights[0])
    mean = [sum((w * F.col(f"__e{k}_{c}") for k, w in enumerate(weights)), F.lit(0.0)) / total for c in "rgb"]
    return settled(d.select(*names, *[F.when(F.col(rough) < 0.05, F.col(f"__e0_{c}")).otherwise(m).alias(f"{out}_{c}") for c, m in zip("rgb", mean)]))


def with_bar2(df: DataFrame, light: Sequence[float], sun_rgb: Sequence[float], env: S.Environment, out: str, shadow: str | None = "shadow", ao: str | None = "ao", cusp: str | None = None, pixels: str | None = None, strengths: Sequence[float] = (1.4, 0.55, 0.85, 0.55)) -> DataFrame:
    """Adds {out}_r, {out}_g, {out}_b: direct light and environment on splats with normal, view, albedo, f0, metallic and roughness.

    ``light`` points away from its source; ``strengths`` are those of light, ambient,
    reflection and glint. Diffuse terms are weighted by 1 - metallic.
    """
    names = df.columns
    sun, ambient, mirror, shine = strengths
    to = [F.lit(-c) for c in light]
    lit = F.col(shadow) if shadow else F.lit(1.0)
    d = df.select("*", F.greatest(F.lit(0.0), dot(_cols(N), to)).alias("__nl"), clip(F.greatest(F.lit(0.0), dot(_cols(N), _cols(V))), 0.0, 1.0).alias("__nv"))
    shine_on = bool(cusp and pixels and shine)
    d = settled(d.withColumn("__g", shine * S.cusp_glint(F.col("__nl"), F.col(cusp), F.col(pixels)) * lit if shine_on else F.lit(0.0)))
    if ambient:
        d = with_environment(d, N, env, "__around")
    if mirror:
        d = settled(d.select("*", *[c.alias(f"__r{i}") for i, c in enumerate(S.reflected(_cols(N), _cols(V)))]))
        d = with_blurred(d, ("__r0", "__r1", "__r2"), "roughness", env, "__back")
    open_ = 0.5 + 0.5 * F.col(ao) if ao else F.lit(0.85)
    rgb = []
    for c, a, f, s in zip("rgb", _cols(A), _cols(F0), sun_rgb):
        kd = 1 - F.col("metallic")
        d = settled(d.withColumn(f"__s_{c}", S.ggx(_cols(N), _cols(V), to, F.col("roughness"), f, F.col(cusp) if cusp else None)))
        v = sun * s * (kd * a + F.col(f"__s_{c}")) * F.col("__nl") * lit + F.col("__g") * s
        if ambient:
            v = v + ambient * F.col(f"__around_{c}") * (F.col(ao) if ao else 1.0) * kd * a
        if mirror:
            v = v + mirror * S.schlick(f, F.col("__nv")) * F.col(f"__back_{c}") * open_
        rgb.append(clip(v, 0.0, 1.0).alias(f"{out}_{c}"))
    return settled(d.select(*names, *rgb))


def with_three_lights(df: DataFrame, eye: Sequence[float], centre: Sequence[float], env: S.Environment, out: str, shadow: str = "shadow", ao: str = "ao") -> DataFrame:
    """Key light with environment, fill and rim without (weights, strengths and colours are fixed values); linear, to be graded."""
    names = df.columns
    way = S.three_directions(eye, centre)
    d = with_bar2(df, way["key"], (1.0, 0.96, 0.9), env, "__key", shadow, ao, strengths=(1.6, 0.55, 1.0, 0.0))
    d = with_bar2(d, way["fill"], (0.8, 0.9, 1.0), env, "__fill", None, ao, strengths=(0.6, 0.0, 0.0, 0.0))
    d = with_bar2(d, way["rim"], (1.0, 1.0, 1.0), env, "__rim", None, None, strengths=(1.0, 0.0, 0.0, 0.0))
    return d.select(*names, *[(F.col(f"__key_{c}") + 0.55 * F.col(f"__fill_{c}") + 0.40 * F.col(f"__rim_{c}")).alias(f"{out}_{c}") for c in "rgb"])
