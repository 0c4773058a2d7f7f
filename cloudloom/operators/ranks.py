"""Ranks and running sums within groups that may hold a third of all rows.

A window over such a group is one sorted task. Here rows are put into ranges of (group, key)
first; totals of the ranges are summed, and only then each range on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cloudloom.plans.durable import cut
from cloudloom.plans.sizing import shuffle_partitions


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows in ranges of (group, order), with __part, the range; written out once, as both passes read it."""
    cols = [F.col(g) for g in group] + list(order)
    return cut(df.repartitionByRange(shuffle_partitions(df), *cols).withColumn("__part", F.spark_partition_id()))


def rank_in(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, offset: int = 0) -> DataFrame:
    """Adds ``name``: the rank (1 for the first, plus ``offset``) of each row in its group by ``order``, which must be total."""
    r = ranged(df, group, order)
    n = r.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    before = n.select(*group, "__part", (F.sum("__n").over(W.partitionBy(*group).orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a range
    w = W.partitionBy(*group, "__part").orderBy(*order)
    return r.join(before, [*group, "__part"]).withColumn(name, F.col("__before") + F.row_number().over(w) + offset).drop("__part", "__before")


def difference_in(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the value less that of the row before in the group; null for the first."""
    r = ranged(df, group, order)
    ends = r.groupBy(*group, "__part").agg(F.max_by(value, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__last"))
    before = ends.select(*group, "__part", F.lag("__last").over(W.partitionBy(*group).orderBy("__part")).alias("__carry"))  # a row a range
    w = W.partitionBy(*group, "__part").orderBy(*order)
    j = r.join(before, [*group, "__part"])
    return j.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(w), F.col("__carry"))).drop("__part", "__carry")
