"""Density control of a set of splats: accumulated signals, thresholds by step, pruning, splitting and cloning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def threshold(step: int, start: float = 2e-4) -> float:
    """The signal above which splats grow: halved at steps 1000, 5000 and 10,000 (fixed values)."""
    return start / 2 ** sum(step >= s for s in (1000, 5000, 10_000))


def due(step: int, every: int, first: int = 0, last: int | None = None) -> bool:
    """Whether something happens at a step: each ``every`` steps between first and last."""
    return step > 0 and step % every == 0 and step >= first and (last is None or step <= last)


def accumulated(state: DataFrame | None, signal: DataFrame) -> DataFrame:
    """(id, signal, seen): the state with a further round of signals (id, signal, seen); ids that either side lacks count 0 there."""
    rows = signal.select("id", "signal", "seen") if state is None else state.unionByName(signal.select("id", "signal", "seen"))
    return rows.groupBy("id").agg(F.sum("signal").alias("signal"), F.sum("seen").alias("seen"))


def controlled(splats: DataFrame, state: DataFrame, step: int, extent: float, large: float = 0.01) -> DataFrame:
    """(id, kind, part, opacity, size): the splats after one step.

    ``splats``: (id, alpha, size). Faint ones (alpha of 0.005 or less) and those wider than a
    tenth of ``extent`` go. Of the others with a mean signal above the step's threshold,
    those larger than ``large`` give way to two daughters of size / 1.6, smaller ones get a
    clone. Splats that no round has seen stay. At each 3000th step alphas fall to 0.01.
    """
    j = splats.where((F.col("alpha") > 0.005) & (F.col("size") < 0.1 * extent)).join(state, "id", "left")
    grows = F.coalesce(F.col("signal") / F.col("seen") > threshold(step), F.lit(False))
    alpha = F.least("alpha", F.lit(0.01)) if due(step, 3000) else F.col("alpha")
    ways = F.when(grows & (F.col("size") > large), F.array(*[F.struct(F.lit("split").alias("kind"), F.lit(k).alias("part")) for k in (0, 1)]))
    ways = ways.when(grows, F.array(F.struct(F.lit("kept").alias("kind"), F.lit(0).alias("part")), F.struct(F.lit("clone").alias("kind"), F.lit(1).alias("part"))))
    ways = ways.otherwise(F.array(F.struct(F.lit("kept").alias("kind"), F.lit(0).alias("part"))))
    out = j.select("id", alpha.alias("alpha"), "size", F.explode(ways).alias("w"))
    return out.select("id", "w.kind", "w.part", "alpha", F.when(F.col("w.kind") == "split", F.col("size") / 1.6).otherwise(F.col("size")).alias("size"))
