"""The k most similar vectors of every vector, by multiprobe p-stable hashing.

Vectors are projected on Gaussian (2-stable) directions, made orthogonal, and hashed to
h_i = floor((a_i x + b_i) / w), in several tables. A query searches its own bucket of the
first table. What may lie nearer than its k-th candidate is in perturbed buckets, of any
table, its own buckets of the other tables among them. These are listed with a score, the
distance along the projections to the bucket's contents, and visited in the order of the
score, which is that of estimated success: in rounds, of which each shrinks the reach of a
query and drops the buckets beyond it. Candidates are merged and reranked by distance.

With as many projections as dimensions the score is a lower bound of the distance, and each
table alone is complete: a query then goes through the table in which it has fewest buckets
within reach, and the result is exact, ties by smaller id. With fewer projections the reach
is that of a neighbour's expected projection, ``slack`` times, over all tables, and
``probes`` bounds the visits of a query: recall grows with both.

Skew: buckets have widths of their own group. A bucket of more than ``cap`` vectors is
hashed finer, by the extent of its contents, until it is small, and small ones are put
together in wider ones; this tree leads queries without near neighbours down to the leaves,
best bound first. So a dense spot or a group with a third of all rows spreads over many
tasks. A crowd of equal vectors stays with its k + 1 smallest ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cloudloom.operators import buckets as B
from cloudloom.plans.durable import cut

_SEED = 20_240_607


def directions(dim: int, count: int, tables: int) -> np.ndarray:
    """(tables, count, dim) orthonormal Gaussian directions."""
    rng = np.random.default_rng(_SEED)
    out = np.empty((tables, count, dim))
    for t in range(tables):
        q, r = np.linalg.qr(rng.normal(size=(dim, count)))
        out[t] = (q * np.sign(np.diag(r))).T
    return out


def offsets(tables: int, count: int) -> np.ndarray:
    """The b_i as parts of a width."""
    return np.random.default_rng(_SEED + 1).random((tables, count))


def nearest(
    vectors: DataFrame,
    dim: int,
    k_default: int | None = None,
    queries: Column | None = None,
    tables: int = 2,
    projections: int = 3,
    cap: int = 4096,
    probes: int | None = None,
    slack: float = 2.0,
    batch: int = 8,
) -> DataFrame:
    """(g, q, id, d2): the k nearest vectors of the same group of each query, by (distance, id).

    ``vectors``: (g, id BIGINT, x ARRAY<DOUBLE>, and k unless ``k_default`` is given);
    ids are unique. ``queries`` is a condition that selects the queries; all rows by
    default. A group with fewer than k others gives all of them. Vectors that are null,
    of another length or not finite are left out, as are null groups and ids, and queries
    whose k is null or not positive. An empty table gives an empty result. Squared
    distances are doubles, ties go to the smaller id. ``batch``: buckets visited in the
    first round; each further round visits so many times more. ``probes``: most visits of a
    query beside its home; None visits all within reach (exact if projections = dim).
    """
    m = min(projections, dim)
    rows = B.clean(vectors, dim, F.lit(k_default) if k_default is not None else F.col("k"), queries)
    rows, tree, same = B.planted(rows, directions(dim, m, tables), offsets(tables, m), cap)
    factor = min(1.0, slack * m / dim) if m < dim else 1.0
    closed, opened = B.home(rows, tree, dim, factor)
    leaves = tree.reach(opened.select("g", "q", "x", "k", (F.col("limit2") * factor).alias("reach2"), "home"))
    by_q = W.partitionBy("g", "q")
    if m == dim and probes is None:  # one table is enough: that with the fewest buckets to visit
        fewest = F.array_sort(F.array(*[F.struct(F.count_if(F.col("t") == t).over(by_q).alias("n"), F.lit(t).alias("t")) for t in range(tables)]))[0]
        leaves = leaves.withColumn("of", fewest).where(F.col("t") == F.col("of.t"))
    leaves = leaves.withColumn("rank", F.row_number().over(by_q.orderBy("score", "t", "cell")))
    if probes is not None:
        leaves = leaves.where(F.col("rank") <= probes)
    todo = cut(leaves.join(opened.select("g", "q", "x", "k", "limit2"), ["g", "q"]).select("t", "g", "q", "x", "k", "limit2", "cell", "score", "rank"))
    everywhere = B.places(rows, tree)
    found = opened.select("g", "q", "k", B.zipped()).select("g", "q", "k", "c.d2", "c.id")
    most, done = batch, 0
    while not todo.isEmpty():
        got = B.visited(todo.where(F.col("rank") <= most), everywhere, dim)
        got = cut(got.join(opened.select("g", "q", "k"), "q").select("g", "q", "k", "d2", "id"))
        found = found.unionByName(got)
        done, most = most, most * batch
        later = todo.where(F.col("rank") > done)
        if later.isEmpty():
            break
        best = B.merged(found).select("q", F.when(F.size("cand") >= F.col("k"), F.element_at("cand", -1)["d2"]).otherwise(F.lit(float("inf"))).alias("now2"))
        later = later.join(best, "q", "left").withColumn("limit2", F.least("limit2", F.coalesce("now2", "limit2"))).drop("now2")
        todo = cut(later.where(F.col("score") <= F.col("limit2") * factor * (1 + 1e-9) + 1e-24))
    out = closed.unionByName(B.merged(found).select("g", "q", F.explode("cand").alias("c")).select("g", "q", "c.id", "c.d2"))
    return out if same is None else out.unionByName(same)


def pairs(found: DataFrame) -> DataFrame:
    """(lo, hi): distinct pairs of which at least one is among the nearest of the other."""
    return found.select(F.least("q", "id").alias("lo"), F.greatest("q", "id").alias("hi")).distinct()
