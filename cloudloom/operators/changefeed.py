"""Rebuilding a table from a change feed, with equality deletes.

A feed is split into three append-only logs, each entry carrying the sequence of
its change: ``rows`` (an insert brings a row into being), ``cells`` (the
attributes a change sets) and ``deletes`` (a key; it hides every row and cell of
that key with a smaller sequence). An insert of a present row makes it anew, so it
also hides older cells. Readers anti-join rows against later delete keys and keep
the cells that are not older than the row. Nothing depends on arrival order, and
repeated deliveries are harmless.

Each log is reduced to the latest entry of a key before the shuffle (partial
aggregation), so a key that changes all the time costs one row a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

INSERT, UPDATE, DELETE = "i", "u", "d"


def op_code(op: Column) -> Column:
    """'i', 'u' or 'd' from any spelling (first letter after trimming); else null."""
    first = F.lower(F.substring(F.regexp_replace(op, r"^\s+", ""), 1, 1))
    return F.when(first.isin(INSERT, UPDATE, DELETE), first)


def split_feed(feed: DataFrame, keys: Sequence[str], order: Sequence[str], change: str, op: str, cells: Mapping[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, cells, deletes) of a feed.

    ``order`` are the columns that sequence changes of a key, ``change`` names the
    change and breaks ties; ``cells`` gives for each attribute the condition under
    which a change sets it. Changes with an unreadable op or a null in key, order or
    change cannot be placed and are left out (``unplaced`` counts them).
    """
    seq = F.struct(*[F.col(c) for c in order], F.col(change).alias("change"))
    placed = feed.select(*keys, op_code(F.col(op)).alias("op"), seq.alias("seq"), *[F.coalesce(c, F.lit(False)).alias(f"__{a}") for a, c in cells.items()])
    known = F.col("op").isNotNull()
    for c in [*keys, *[f"seq.{x}" for x in order], "seq.change"]:
        known &= F.col(c).isNotNull()
    placed = placed.where(known)
    rows = placed.where(F.col("op") == INSERT).select(*keys, "seq")
    deletes = placed.where(F.col("op") == DELETE).select(*keys, "seq")
    sets = placed.where(F.col("op") != DELETE).select(*keys, "seq", *[f"__{a}" for a in cells])
    return rows, sets, deletes


def unplaced(feed: DataFrame, keys: Sequence[str], order: Sequence[str], change: str, op: str) -> DataFrame:
    """One row: how many records of the feed cannot be placed, by reason."""
    missing = F.lit(False)
    for c in [*keys, *order, change]:
        missing |= F.col(c).isNull()
    return feed.agg(F.count_if(op_code(F.col(op)).isNull()).alias("bad_op"), F.count_if(missing).alias("missing_key_or_order"))


def compact(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest entry of each key: all that readers need of a log of rows or deletes."""
    return log.groupBy(*keys).agg(F.max("seq").alias("seq"))


def current_cells(rows: DataFrame, sets: DataFrame, deletes: DataFrame, keys: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """(keys..., attr, seq): for each row that exists, the change that set each attribute last.

    Empty logs give empty results; a delete without insert, and updates of absent
    rows, leave no trace.
    """
    d = compact(deletes, keys).select(*[F.col(k).alias(f"__d_{k}") for k in keys], F.col("seq").alias("__d_seq"))
    r = compact(rows, keys)
    same = (F.col("__d_seq") > F.col("seq"))
    for k in keys:
        same &= F.col(k) == F.col(f"__d_{k}")
    live = r.join(d, same, "left_anti").select(*keys, F.col("seq").alias("__born"))
    last = sets.groupBy(*keys).agg(*[F.max(F.when(F.col(f"__{a}"), F.col("seq"))).alias(f"__{a}") for a in attrs])
    kept = last.join(live, list(keys))
    pairs = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"__{a}").alias("seq")) for a in attrs])
    cells = kept.select(*keys, "__born", F.explode(pairs).alias("c")).select(*keys, "__born", "c.attr", "c.seq")
    return cells.where(F.col("seq").isNotNull() & (F.col("seq") >= F.col("__born"))).select(*keys, "attr", "seq")


def live_rows(rows: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., seq): the rows that exist, with the insert that made them."""
    d = compact(deletes, keys).select(*[F.col(k).alias(f"__d_{k}") for k in keys], F.col("seq").alias("__d_seq"))
    cond = F.col("__d_seq") > F.col("seq")
    for k in keys:
        cond &= F.col(k) == F.col(f"__d_{k}")
    return compact(rows, keys).join(d, cond, "left_anti")


class ChangeLog:
    """The three logs as append-only Parquet files under one folder.

    ``append`` may be called for every batch, in any order and more than once;
    a batch goes to its own sub-folder, so a repeated batch overwrites itself.
    """

    def __init__(self, spark, path: str, keys: Sequence[str], order: Sequence[str], change: str, op: str, cells: Mapping[str, Column]):
        self.spark, self.path, self.keys, self.order, self.change, self.op, self.cells = spark, path.rstrip("/"), list(keys), list(order), change, op, dict(cells)

    def append(self, feed: DataFrame, batch_id: int) -> None:
        parts = split_feed(feed, self.keys, self.order, self.change, self.op, self.cells)
        for name, part in zip(("rows", "sets", "deletes"), parts):
            part.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")

    def _log(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").drop("batch")

    def current(self) -> DataFrame:
        """Merge on read."""
        return current_cells(self._log("rows"), self._log("sets"), self._log("deletes"), self.keys, list(self.cells))
