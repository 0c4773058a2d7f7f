"""Exact nearest neighbours over a tree of buckets.

Vectors are put into buckets along given directions (the axes, or random ones), with widths
of their own group. A bucket of more than ``cap`` vectors is divided further, by the extent
of its contents, until it is small; small ones are put together in wider ones. A query
searches its home bucket; if its reach leaves that, the tree leads it to the other buckets
within reach, best bound first. So a dense spot or a group with a third of all rows
spreads over many tasks, and nothing is cut off by a radius. A crowd of equal vectors stays
with its k + 1 smallest ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cloudloom.plans.durable import cut

_STEP = 3  # levels that a query goes down at once
_FLAT = 2.0**-40  # extent, in widths of a bucket, below which it can't be divided


def _top(d2: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise k least (distance, id) of (n, m), m >= k; ids must ascend along each row."""
    if d2.shape[1] > 4 * k + 16:
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
        few = int((d2 <= kth).sum(1).max(initial=k))  # ties of the k-th distance stay
        part = np.sort(np.argpartition(d2, min(few, d2.shape[1]) - 1, axis=1)[:, :few], axis=1)
        d2, ids = np.take_along_axis(d2, part, 1), np.take_along_axis(ids, part, 1)
    order = np.argsort(d2, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(d2, order, 1), np.take_along_axis(ids, order, 1)


def _matrix(c, dim: int) -> np.ndarray:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _distances(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Squared distances (n, m), exact; of many dimensions only those of the k best by a matrix product, and their columns."""
    if x.shape[1] <= 8:
        d2 = np.zeros((len(x), len(y)))
        for j in range(x.shape[1]):
            d2 += np.square(x[:, j, None] - y[None, :, j])
        return d2, None
    rough = (y * y).sum(1)[None] - 2 * (x @ y.T)
    few = min(k + 9, len(y))  # one for the query itself, eight for what rounding may swap
    at = np.sort(np.argpartition(rough, few - 1, axis=1)[:, :few], axis=1)
    return np.square(x[:, None] - y[at]).sum(2), at


def _ranked(q: np.ndarray, x: np.ndarray, ks: np.ndarray, ids: np.ndarray, y: np.ndarray, limit: np.ndarray, cells: int = 1 << 20):
    """(rows of queries, d2, id, whether it is among the k); ``ids`` ascend. In blocks of ``cells`` distances.

    In few dimensions queries are put into boxes of up to 256, and each box is held against
    the vectors within the largest reach of its queries only.
    """

    def block(rows: np.ndarray, some: np.ndarray | None):
        yi, ii = (y, ids) if some is None else (y[some], ids[some])
        step = max(1, cells // max(len(ii), 1))
        for s in range(0, len(rows), step):
            r = rows[s : s + step]
            k = min(int(ks[r].max(initial=1)), len(ii))
            if not k:
                continue
            d2, at = _distances(x[r], yi, k)
            to = np.broadcast_to(ii, (len(r), len(ii))) if at is None else ii[at]
            d2[q[r, None] == to] = np.inf
            dk, ik = _top(d2, to, min(k, d2.shape[1]))
            yield r, dk, ik, np.isfinite(dk) & (np.arange(dk.shape[1])[None] < ks[r, None]) & (dk <= limit[r, None])

    if x.shape[1] > 8 or len(ids) <= 512 or len(q) <= 64:
        yield from block(np.arange(len(q)), None)
        return
    boxes, open_ = [], [np.arange(len(q))]
    while open_:
        r = open_.pop()
        span = np.ptp(x[r], axis=0)
        if len(r) <= 256 or not span.max() > 0:
            boxes.append(r)
            continue
        order = r[np.argsort(x[r, span.argmax()], kind="stable")]
        open_ += [order[: len(r) // 2], order[len(r) // 2 :]]
    for r in boxes:
        lo, hi = x[r].min(0), x[r].max(0)
        gap = np.maximum(0, np.maximum(lo - y, y - hi))
        away = (gap * gap).sum(1)
        k = int(ks[r].max(initial=1))
        reach = limit[r].max()
        if len(ids) > k:  # the nearest k + 1 vectors around the box bound its reach by their far corners
            near = np.argpartition(away, k)[: k + 1]
            near = np.concatenate([near, np.flatnonzero(away <= 0)[:512]])
            first = np.full(len(r), np.inf)
            for rows, dk, _, good in block(r, np.unique(near)):
                full = good.sum(1) >= ks[rows]
                first[np.isin(r, rows)] = np.where(full, np.where(good, dk, 0).max(1), np.inf)
            reach = min(reach, first.max())
        yield from block(r, np.flatnonzero(away <= reach * (1 + 1e-9) + 1e-300))


_HOME = "g int, cell bigint, q bigint, x array<double>, k int, ids array<bigint>, d2s array<double>"


def _home(dim: int, group: pa.DataType, factor: float):
    """One bucket: for each query its candidates; ``x`` stays with those whose reach leaves the bucket."""
    schema = pa.schema([("g", group), ("cell", pa.int64()), ("q", pa.int64()), ("x", pa.list_(pa.float64())), ("k", pa.int32()), ("ids", pa.list_(pa.int64())), ("d2s", pa.list_(pa.float64()))])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        asks = np.flatnonzero(t.column("asks").to_numpy())
        if not len(asks):
            return schema.empty_table()
        ids, y = t.column("id").to_numpy(), _matrix(t.column("x"), dim)
        q, ks, margin = ids[asks], t.column("k").to_numpy()[asks], t.column("margin").to_numpy()[asks]
        got, d2s, size = [], [], np.zeros(len(q), np.int64)
        reach = np.full(len(q), np.inf)
        order = []
        for r, dk, ik, good in _ranked(q, y[asks], ks, ids, y, np.full(len(q), np.inf)):
            size[r] = good.sum(1)
            full = size[r] >= ks[r]
            reach[r[full]] = dk[np.flatnonzero(full), ks[r[full]] - 1]
            order.append(r)
            got.append(ik[good])
            d2s.append(dk[good])
        o = np.concatenate(order) if order else np.zeros(0, np.int64)
        if len(o) < len(q):  # those without any other vector
            o = np.concatenate([o, np.setdiff1d(np.arange(len(q)), o)])
        asks, q, ks, margin, size, reach = asks[o], q[o], ks[o], margin[o], size[o], reach[o]
        offset = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
        out = np.sqrt(reach * factor) * (1 + 1e-9) + 1e-12 >= margin  # its reach leaves the bucket
        ends = np.append(0, np.cumsum(np.where(out, dim, 0))).astype(np.int32)
        xs = pa.ListArray.from_arrays(pa.array(ends), pa.array(y[asks][out].ravel()))
        lists = [pa.ListArray.from_arrays(offset, pa.array(np.concatenate([*v, np.zeros(0, kind)]))) for v, kind in ((got, np.int64), (d2s, np.float64))]
        n = len(q)
        return pa.Table.from_arrays([t.column("g").slice(0, 1).take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, t.column("cell")[0].as_py())), pa.array(q), xs, pa.array(ks.astype(np.int32)), *lists], schema=schema)

    return run


_FOUND = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("d2", pa.float64())])
_FOUND_SQL = "q bigint, id bigint, d2 double"


def _visit(dim: int):
    """Queries (q, x, k, limit2) that visit one bucket (id, x): (q, id, d2) of the k nearest within limit2."""

    def run(queries: pa.Table, places: pa.Table) -> pa.Table:
        if not queries.num_rows or not places.num_rows:
            return _FOUND.empty_table()
        places = places.sort_by("to_id")
        q, ks, limit = (queries.column(c).to_numpy() for c in ("q", "k", "limit2"))
        out = [(q[r][np.nonzero(good)[0]], ik[good], dk[good]) for r, dk, ik, good in _ranked(q, _matrix(queries.column("x"), dim), ks, places.column("to_id").to_numpy(), _matrix(places.column("to_x"), dim), limit)]
        if not out:
            return _FOUND.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_FOUND)

    return run


def _each(m: int, f) -> Column:
    return F.array(*[f(i) for i in range(m)])


def _total(m: int, f) -> Column:
    out = f(0)
    for i in range(1, m):
        out = out + f(i)
    return out


class Buckets:
    """Where each vector is, in one or more tables, and the tree of buckets above the leaves. ``dirs``: (tables, m, dim) directions; ``off``: (tables, m) parts of a width."""

    def __init__(self, rows: DataFrame, dirs: np.ndarray, off: np.ndarray, cap: int):
        tables, m, _ = dirs.shape
        self.dirs, self.off, self.m, self.tables, self.cap = dirs, off, m, tables, cap
        p = self._projected(rows).select("g", "t", "p")
        bounds = [f(F.col("p")[i]).alias(f"{n}{i}") for i in range(m) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        s = p.groupBy("t", "g").agg(F.count("*").alias("n"), *bounds)
        span = F.greatest(F.lit(0.0), *[F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(m)])
        # buckets of cap / 16 where the directions are filled evenly; small ones are put together below
        parts = F.greatest(F.lit(1.0), F.floor(F.pow(F.col("n") * 16.0 / cap, F.lit(1.0 / m))))
        s = s.withColumn("parts", parts).withColumn("w", F.when(span > 0, span / F.col("parts") * (1 + 1e-9)).otherwise(F.lit(1.0)))
        self.stats = cut(s.select("t", "g", "parts", "w", _each(m, lambda i: F.col(f"lo{i}")).alias("base")))
        widest = self.stats.agg(F.max("parts")).first()[0] or 1.0
        self.top = _STEP * int(np.ceil(np.log2(widest + 2) / _STEP))  # so many times twice as wide until one bucket holds a group

        coded = self.coded(rows).withColumn("cell", self.cell(F.lit(0)))
        base = level = cut(self._directory(coded, F.lit(None).cast("bigint")))
        self.splits: list[DataFrame] = []
        below = level.where(F.lit(False)).withColumn("leaf", F.lit(None).cast("bigint"))
        while True:
            # so fine that its contents, if they fill two directions evenly, make buckets of cap / 4
            finer = F.pow(F.col("n") * 4.0 / cap, F.lit(1.0 / (2 if m <= 3 else m)))
            hot = level.where((F.col("n") > cap) & ~F.col("flat")).select("t", "g", "cell", F.floor(F.log2(F.greatest(F.lit(2.0), finer) / F.col("extent"))).cast("int").alias("lev"))
            if hot.isEmpty():
                break
            self.splits.append(hot)
            coded = coded.join(hot, ["t", "g", "cell"]).withColumn("above", F.col("cell")).withColumn("cell", self.cell(F.col("lev"))).drop("lev")
            level = cut(self._directory(coded, F.col("above")))
            below = below.unionByName(level.withColumn("leaf", F.when((F.col("n") <= cap) | F.col("flat"), F.col("cell"))))
        # the wider buckets, each twice as wide as the one before; a leaf is the widest of at most cap vectors
        up = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.top))).alias("r"))

        def at(r: Column) -> Column:
            return F.xxhash64("t", (-r).cast("int"), *[F.floor(F.col("lo")[i] * F.pow(F.lit(2.0), -r)).cast("bigint") for i in range(m)])

        up = up.withColumn("node", at(F.col("r"))).withColumn("above", at(F.col("r") + 1)).withColumn("over", F.when(F.col("r") % _STEP == 0, at(F.col("r") + _STEP)))
        up = up.withColumn("held", F.sum("n").over(W.partitionBy("t", "g", "node")))
        small = (F.col("held") <= cap) | (F.col("flat") & (F.col("r") == 0))
        up = up.withColumn("widest", F.max(F.when(small, F.struct("r", "node"))).over(W.partitionBy("t", "g", "cell")))
        up = cut(up)
        self.homes = up.where("r = 0").select("t", "g", "cell", F.col("widest.r").alias("wide"), F.col("widest.node").alias("leaf"))
        wide = up.groupBy("t", "g", F.col("node").alias("cell"), "above", "over").agg(F.sum("n").alias("n"), F.bool_or(F.col("flat") & (F.col("r") == 0)).alias("flat"), F.first(F.when(small, F.col("widest.node")), True).alias("leaf"), *[f(F.col(c)[i]).alias(f"{c}{i}") for i in range(m) for f, c in ((F.min, "lo"), (F.max, "hi"))])
        wide = wide.select("t", "g", "cell", "above", "over", "n", *[_each(m, lambda i: F.col(f"{c}{i}")).alias(c) for c in ("lo", "hi")], "flat", "leaf")
        self.nodes = cut(wide.unionByName(below.drop("extent").withColumn("over", F.col("above"))))

    def _projected(self, rows: DataFrame) -> DataFrame:
        """A row for each table t, with the projections p and the offsets; vectors of many dimensions by one matrix product a batch."""
        dirs = self.dirs
        if dirs.shape[2] <= 8:
            ps = [_each(self.m, lambda i: _total(dirs.shape[2], lambda j: F.col("x")[j] * float(dirs[t][i][j]))) for t in range(self.tables)]
        else:
            flat = dirs.reshape(-1, dirs.shape[2]).T

            @F.pandas_udf("array<double>")
            def project(x: pd.Series) -> pd.Series:
                return pd.Series(list(np.stack(x.to_numpy()) @ flat)) if len(x) else pd.Series([], dtype=object)

            rows = rows.withColumn("ps", project("x"))
            ps = [F.slice("ps", 1 + t * self.m, self.m) for t in range(self.tables)]
        each = [F.struct(F.lit(t).alias("t"), p.alias("p"), F.array(*map(F.lit, map(float, self.off[t]))).alias("off")) for t, p in enumerate(ps)]
        return rows.select("*", F.inline(F.array(*each))).drop("ps")

    def coded(self, rows: DataFrame) -> DataFrame:
        """Adds t (a row for each table), the place u in widths and the width w."""
        p = self._projected(rows)
        u = _each(self.m, lambda i: (F.col("p")[i] - F.col("base")[i]) / F.col("w") + F.col("off")[i])
        return p.join(self.stats, ["t", "g"]).withColumn("u", u).drop("p", "off", "base", "parts")

    def cell(self, lev: Column) -> Column:
        return F.xxhash64("t", lev.cast("int"), *[F.floor(F.col("u")[i] * F.pow(F.lit(2.0), lev)).cast("bigint") for i in range(self.m)])

    def _directory(self, coded: DataFrame, above: Column) -> DataFrame:
        d = coded.withColumn("above", above).groupBy("t", "g", "cell", "above").agg(F.count("*").alias("n"), *[f(F.col("u")[i]).alias(f"{c}{i}") for i in range(self.m) for f, c in ((F.min, "lo"), (F.max, "hi"))])
        extent = F.greatest(F.lit(0.0), *[F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(self.m)])
        d = d.select("t", "g", "cell", "above", "n", *[_each(self.m, lambda i: F.col(f"{c}{i}")).alias(c) for c in ("lo", "hi")], extent.alias("extent"))
        return d.withColumn("flat", (F.col("extent") <= _FLAT) & (F.col("n") > self.cap))

    def placed(self, df: DataFrame) -> DataFrame:
        """Adds the leaf of each row of ``coded`` and how far its borders are at least (margin)."""
        d = df.withColumn("cell", self.cell(F.lit(0))).join(self.homes, ["t", "g", "cell"], "left")
        d = d.withColumn("at", -F.coalesce("wide", F.lit(0))).drop("wide")
        for hot in self.splits:
            d = d.join(hot, ["t", "g", "cell"], "left")
            d = d.withColumn("cell", F.when(F.col("lev").isNull(), F.col("cell")).otherwise(self.cell(F.col("lev")))).withColumn("at", F.coalesce("lev", "at")).drop("lev")
        scale = F.pow(F.lit(2.0), F.col("at"))
        part = [F.col("u")[i] * scale - F.floor(F.col("u")[i] * scale) for i in range(self.m)]
        border = [F.least(f, 1 - f) for f in part]
        margin = (F.least(*border) if self.m > 1 else border[0]) * F.col("w") / scale
        d = d.withColumn("margin", F.when(F.col("at") == -self.top, F.lit(float("inf"))).otherwise(margin))
        return d.withColumn("cell", F.coalesce("leaf", "cell")).drop("leaf")

    def reach(self, opened: DataFrame) -> DataFrame:
        """(t, g, q, cell, score): the leaves of every table within the reach of each query, but for its home.

        ``opened``: (g, q, x, k, reach2, home). A query without k candidates takes the far
        corner of the bucket above its home as reach. Queries start at buckets about as
        wide as their reach, and go down by what lies within it; a bucket of more than k
        vectors then bounds the reach by its far corner.
        """
        d = self.coded(opened)
        lost = d.where((F.col("reach2") == float("inf")) & (F.col("t") == 0))
        up = self.nodes.where("t = 0").select("g", F.col("cell").alias("home"), F.col("above").alias("cell")).join(self.nodes.where("t = 0").select("g", "cell", "lo", "hi"), ["g", "cell"]).drop("cell")
        far = lost.join(up, ["g", "home"]).select("g", "q", (self._far2() * (1 + 1e-9) + 1e-24).alias("far2"))
        d = d.join(far, ["g", "q"], "left").withColumn("reach2", F.least("reach2", F.coalesce("far2", F.lit(float("inf"))))).drop("far2")
        d = d.withColumn("ru", F.sqrt("reach2") * (1 + 1e-9) / F.col("w") + 1e-12)
        each = 0.5 if self.m <= 3 else 4.0
        d = d.withColumn("r", F.when(F.col("reach2") == float("inf"), F.lit(self.top)).otherwise(F.least(F.lit(self.top), F.greatest(F.lit(0), _STEP * F.ceil(F.log2(each * F.col("ru")) / _STEP)))).cast("int"))
        for i in range(self.m):
            ends = [F.when(F.col("r") == self.top, F.lit(0)).otherwise(F.floor((F.col("u")[i] + s * F.col("ru")) * F.pow(F.lit(2.0), -F.col("r")))).cast("bigint") for s in (-1, 1)]
            d = d.withColumn(f"h{i}", F.explode(F.sequence(*ends)))
        d = d.withColumn("cell", F.xxhash64("t", (-F.col("r")).cast("int"), *[f"h{i}" for i in range(self.m)]))
        keep = ["t", "g", "q", "k", "u", "w", "reach2", "home"]
        front = self._within(d.select(*keep, "cell").join(self.nodes, ["t", "g", "cell"]), False)
        leaves = front.where("leaf is not null")
        front = front.where("leaf is null")
        down = self.nodes.drop("above").withColumnRenamed("cell", "child").withColumnRenamed("over", "cell")
        while not front.isEmpty():
            front = self._within(front.select(*keep, "cell").join(down, ["t", "g", "cell"]).drop("cell").withColumnRenamed("child", "cell"), True)
            leaves = leaves.unionByName(front.where("leaf is not null"))
            front = front.where("leaf is null")
        leaves = leaves.where((F.col("t") != 0) | (F.col("leaf") != F.col("home")))
        return leaves.groupBy("t", "g", "q", F.col("leaf").alias("cell")).agg(F.min("score").alias("score"))

    def _far2(self) -> Column:
        """Squared distance to the far corner of a bucket's contents."""
        ends = [F.greatest(F.abs(F.col("lo")[i] - F.col("u")[i]), F.abs(F.col("u")[i] - F.col("hi")[i])) for i in range(self.m)]
        return _total(self.m, lambda i: ends[i] * ends[i]) * F.col("w") * F.col("w")

    def _within(self, d: DataFrame, bounds: bool) -> DataFrame:
        def outside(i: int) -> Column:
            v = F.greatest(F.lit(0.0), F.col("lo")[i] - F.col("u")[i], F.col("u")[i] - F.col("hi")[i])
            return v * v

        d = d.withColumn("score", _total(self.m, outside) * F.col("w") * F.col("w"))
        if bounds:
            corner = F.min(F.when(F.col("n") > F.col("k"), self._far2() * (1 + 1e-9) + 1e-24)).over(W.partitionBy("t", "g", "q"))
            d = d.withColumn("reach2", F.least("reach2", F.coalesce(corner, F.lit(float("inf")))))
        d = d.where(F.col("score") <= F.col("reach2") * (1 + 1e-9) + 1e-24)
        return cut(d.select("t", "g", "q", "k", "u", "w", "reach2", "home", "cell", "leaf", "score"))


def crowds(rows: DataFrame, tables: Buckets) -> tuple[DataFrame, DataFrame]:
    """(rows without the rest of each crowd, (g, q, id, d2) of the queries in crowds).

    A crowd is a place with more than k + 1 equal vectors in a bucket that can't be divided.
    """
    hot = tables.nodes.where("flat and t = 0").select("t", "g", "cell")
    dense = tables.placed(tables.coded(rows)).where("t = 0").join(hot, ["t", "g", "cell"], "left_semi").select("g", "id", "x", "k", "asks")
    dense = cut(dense)
    spot = W.partitionBy("g", "x").orderBy("id")
    held = cut(dense.withColumn("n", F.row_number().over(spot)).where(F.col("n") <= F.col("k") + 1))  # a group limit, before the shuffle
    crowd = held.where(F.col("n") == F.col("k") + 1).select("g", "x", "k").distinct()
    first = held.join(crowd.select("g", "x"), ["g", "x"], "left_semi").groupBy("g", "x").agg(F.array_sort(F.collect_list("id")).alias("m"))
    inside = dense.where("asks").drop("k").join(crowd, ["g", "x"]).join(first, ["g", "x"]).select("g", F.col("id").alias("q"), "k", "m")
    same = inside.select("g", "q", F.explode(F.slice(F.filter("m", lambda v: v != F.col("q")), F.lit(1), F.col("k"))).alias("id"), F.lit(0.0).alias("d2"))
    silent = held.join(crowd.select("g", "x", F.lit(False).alias("in_crowd")), ["g", "x"], "left").select("g", "id", "x", "k", F.coalesce("in_crowd", "asks").alias("asks"))
    others = dense.select("g", "id").withColumnRenamed("id", "gone")
    rest = rows.join(others, (rows["g"] == others["g"]) & (rows["id"] == F.col("gone")), "left_anti")
    return rest.unionByName(silent), same


def clean(vectors: DataFrame, dim: int, k: Column, queries: Column | None) -> DataFrame:
    """(g, id, x, k, asks) of the vectors with a group, an id and ``dim`` finite numbers."""
    x = F.col("x")
    fine = F.col("g").isNotNull() & F.col("id").isNotNull() & (F.size(x) == dim) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    k = k.cast("int")
    asks = (F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))) & F.coalesce(k > 0, F.lit(False))
    return cut(vectors.select("g", F.col("id").cast("bigint").alias("id"), x.cast("array<double>").alias("x"), F.coalesce(k, F.lit(0)).alias("k"), asks.alias("asks")).where(fine))


def home(rows: DataFrame, tree: Buckets, dim: int, factor: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((g, q, id, d2) of the queries whose reach stays at home, (g, q, x, k, limit2, home, d2s, ids) of the others)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["g"].dataType
    first = tree.placed(tree.coded(rows).where("t = 0")).select("g", "cell", "id", "x", "k", "asks", "margin")
    state = cut(first.groupBy("g", "cell").applyInArrow(_home(dim, to_arrow_type(kind), factor), _HOME.replace("g int", f"g {kind.simpleString()}")))
    closed = state.where(F.size("x") == 0).select("g", "q", zipped()).select("g", "q", "c.id", "c.d2")
    limit2 = F.when(F.size("d2s") >= F.col("k"), F.element_at("d2s", -1)).otherwise(F.lit(float("inf")))
    return closed, state.where(F.size("x") > 0).select("g", "q", "x", "k", limit2.alias("limit2"), F.col("cell").alias("home"), "d2s", "ids")


def zipped() -> Column:
    return F.explode(F.arrays_zip(F.col("d2s").alias("d2"), F.col("ids").alias("id"))).alias("c")


def visited(now: DataFrame, places: DataFrame, dim: int) -> DataFrame:
    """(q, id, d2): queries (g, cell, q, x, k, limit2) meet the vectors of the buckets they name. ``places``: (g, cell, to_id, to_x)."""
    there = places.join(now.select("g", "cell").distinct(), ["g", "cell"], "left_semi").select(F.col("g").alias("to_g"), F.col("cell").alias("to_cell"), "to_id", "to_x")
    return now.select("g", "cell", "q", "x", "k", "limit2").groupBy("g", "cell").cogroup(there.groupBy("to_g", "to_cell")).applyInArrow(_visit(dim), _FOUND_SQL)


def places(rows: DataFrame, tree: Buckets) -> DataFrame:
    return tree.placed(tree.coded(rows)).select("g", "cell", F.col("id").alias("to_id"), F.col("x").alias("to_x"))


def merged(found: DataFrame) -> DataFrame:
    """(q, g, k, cand): merged candidates, distinct, the k best first. ``found``: (g, q, k, d2, id)."""
    best = F.array_sort(F.collect_set(F.struct("d2", "id")))
    return found.groupBy("q").agg(F.first("g").alias("g"), F.first("k").alias("k"), best.alias("c")).select("q", "g", "k", F.slice("c", F.lit(1), F.col("k")).alias("cand"))


def planted(rows: DataFrame, dirs: np.ndarray, off: np.ndarray, cap: int) -> tuple[DataFrame, Buckets, DataFrame | None]:
    """(rows without the rest of each crowd, their buckets, answers of the queries in crowds or None)."""
    tree = Buckets(rows, dirs, off, cap)
    if tree.nodes.where("flat").isEmpty():
        return rows, tree, None
    rows, same = crowds(rows, tree)
    rows = cut(rows)
    return rows, Buckets(rows, dirs, off, cap), same


def nearest(vectors: DataFrame, dim: int, k: Column | int, queries: Column | None = None, cap: int = 4096) -> DataFrame:
    """(g, q, id, d2): the k nearest others of the same group, exact, ties by the smaller id.

    ``vectors``: (g, id BIGINT, x ARRAY<DOUBLE>), ids unique. Groups of fewer than k others
    give all of them. Vectors that are null, of another length or not finite are left out, as
    are null groups and ids. An empty table gives an empty result.
    """
    rows = clean(vectors, dim, k if isinstance(k, Column) else F.lit(k), queries)
    rows, tree, same = planted(rows, np.eye(dim)[None], np.zeros((1, dim)), cap)
    closed, opened = home(rows, tree, dim)
    leaves = tree.reach(opened.select("g", "q", "x", "k", F.col("limit2").alias("reach2"), "home"))
    now = cut(leaves.join(opened.select("g", "q", "x", "k", "limit2"), ["g", "q"]).select("g", "cell", "q", "x", "k", "limit2"))
    got = visited(now, places(rows, tree), dim).join(opened.select("g", "q", "k"), "q").select("g", "q", "k", "d2", "id")
    found = opened.select("g", "q", "k", zipped()).select("g", "q", "k", "c.d2", "c.id").unionByName(got)
    out = closed.unionByName(merged(found).select("g", "q", F.explode("cand").alias("c")).select("g", "q", "c.id", "c.d2"))
    return out if same is None else out.unionByName(same)


def knn_edges(points: DataFrame, k: int, group: str = "scene_id") -> DataFrame:
    """(group, src, dst, rank, d2): the k nearest others of every point (id, x, y, z), nearest first."""
    v = points.select(F.col(group).alias("g"), "id", F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("x"))
    n = nearest(v, 3, k)
    rank = F.row_number().over(W.partitionBy("g", "q").orderBy("d2", "id"))
    return n.select(F.col("g").alias(group), F.col("q").alias("src"), F.col("id").alias("dst"), rank.alias("rank"), "d2")
