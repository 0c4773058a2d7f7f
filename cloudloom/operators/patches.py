"""Sparse patches over a base table: later wins for each (id, attribute)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def compose(patches: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys..., attr, val): the latest value of each attribute; ties of order cannot be told apart and need a last column that is unique."""
    best = F.max(F.struct(*order, "val")).alias("m")
    return patches.groupBy(*keys, "attr").agg(best).select(*keys, "attr", "m.val")


def as_of(patches: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, t) -> DataFrame:
    """The composition of all patches up to and including time t; none leave the base as it is."""
    return compose(patches.where(F.col(time) <= t), keys, order)


def overlay(base: DataFrame, patch: DataFrame, keys: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """The base with the patch's values where it has any; rows the base lacks are not made."""
    wide = patch.groupBy(*keys).agg(*[F.max(F.when(F.col("attr") == a, F.col("val"))).alias(f"__{a}") for a in attrs])
    joined = base.join(wide, list(keys), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in attrs else F.col(c) for c in base.columns])


def diff_to_patch(old: DataFrame, new: DataFrame, keys: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """(keys..., attr, val): the patch that turns old into new for the rows both have."""
    j = old.select(*keys, *[F.col(a).alias(f"__{a}") for a in attrs]).join(new.select(*keys, *attrs), list(keys))
    cells = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("double").alias("val"), F.col(f"__{a}").eqNullSafe(F.col(a)).alias("same")) for a in attrs])
    return j.select(*keys, F.explode(cells).alias("c")).where(~F.col("c.same")).select(*keys, "c.attr", "c.val")


def backward_steps(frames: DataFrame, group: str, frame: str, time: str) -> DataFrame:
    """Frames whose time is before that of the frame before; equal times are allowed."""
    w = W.partitionBy(group).orderBy(frame)
    return frames.select(group, frame, time).distinct().withColumn("before", F.lag(time).over(w)).where(F.col(time) < F.col("before"))


def base_guard(claims: DataFrame, bases: DataFrame, key: str) -> DataFrame:
    """(key, have, claimed, fits): whether each timeline's claim of its base's size holds; a base that is not there has 0 rows.

    ``claims``: (key, claimed), ``bases``: (key, n). A patch is for the base it was made
    for; apply those that fit.
    """
    j = claims.join(bases, key, "left").na.fill(0, ["n"])
    return j.select(key, F.col("n").alias("have"), "claimed", F.col("n").eqNullSafe(F.col("claimed")).alias("fits"))
