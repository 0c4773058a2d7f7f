"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], given as a table of
knots or made from the sources' sizes. Its integral is the source's cumulative token demand; inverting it at a document's cumulative token
count gives the document's position, and documents are range-sorted by position.

The cumulative counts come from a two-level prefix sum: documents fall into hash
buckets, bucket totals are summed first, and only then each bucket on its own, so a
source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cloudloom.plans.durable import cut
from cloudloom.plans.sizing import bucket_count, small_enough


def canonical_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "-", "_")


#: The split of text into pieces that the byte-level vocabulary was made with (fixed value of the format).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counter(path: str):
    """A column function: number of tokens of a byte-level vocabulary in tiktoken format."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoder(path)
        return pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="int64")

    return count


_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("given", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def plan_tokens(targets: Sequence[tuple[str, float, int]], have: Mapping[str, int], total: int | None = None) -> dict[str, float]:
    """Tokens to draw from each source.

    Shares count among the sources that have tokens. Without ``total`` it is the
    largest amount at which every such source still meets its share within
    ``max_repeats``. A larger ``total`` is filled up: a source at its cap gives all it
    has and the others share the rest by weight.
    """
    use = {s: (w, have[s] * r) for s, w, r in targets if have.get(s, 0) > 0 and w and w > 0 and r and r > 0}
    if not use:
        return {}
    weight = sum(w for w, _ in use.values())
    if total is None:
        t = min(cap * weight / w for w, cap in use.values())
        return {s: t * w / weight for s, (w, _) in use.items()}
    out, left, open_ = {}, float(total), dict(use)
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = [s for s, (w, cap) in open_.items() if left * w / weight >= cap]
        if not full:
            return out | {s: left * w / weight for s, (w, _) in open_.items()}
        for s in full:
            out[s] = float(open_.pop(s)[1])
        left = float(total) - sum(out.values())
    return out


def demand_knots(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float]]:
    """(t, weight, cumulative demand) of a piecewise linear weight schedule over [0, 1], scaled to a demand of 1.

    Before its first and after its last knot a schedule keeps their weights. Negative
    weights, times outside [0, 1] and a schedule without any weight are errors.
    """
    knots = sorted((float(t), float(w)) for t, w in schedule)
    if not knots or any(w < 0 or not 0 <= t <= 1 for t, w in knots):
        raise ValueError("a schedule needs times in [0, 1] and weights of at least 0")
    if knots[0][0] > 0:
        knots.insert(0, (0.0, knots[0][1]))
    if knots[-1][0] < 1:
        knots.append((1.0, knots[-1][1]))
    sums = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        sums.append(sums[-1] + (t1 - t0) * (w0 + w1) / 2)
    if sums[-1] <= 0:
        raise ValueError("a schedule needs some weight")
    return [(t, w / sums[-1], c / sums[-1]) for (t, w), c in zip(knots, sums)]


def inverse_demand(u: Column, knots: Column) -> Column:
    """The time at which the cumulative demand of a schedule (its ``demand_knots``) reaches u: the integral inverted, segment by segment."""
    a = F.element_at(F.filter(knots, lambda k: k["c"] <= u), -1)
    b = F.element_at(F.filter(knots, lambda k: k["c"] > u), 1)
    slope, over = (b["w"] - a["w"]) / (b["t"] - a["t"]), u - a["c"]
    root = F.sqrt(F.greatest(a["w"] * a["w"] + 2 * slope * over, F.lit(0.0)))
    return F.when(over <= 0, a["t"]).when(b.isNull(), F.lit(1.0)).otherwise(F.least(b["t"], a["t"] + 2 * over / (a["w"] + root)))


def curriculum(plan: Mapping[str, float], have: Mapping[str, int], warm: float) -> dict[str, list[tuple[float, float]]]:
    """A schedule for each source: weights run linearly from 1 - tilt to 1 + tilt.

    The tilt rises from -warm for the source with most tokens to +warm for the one with
    fewest, shifted so that the weights of all, times their shares, sum to 1 at any time:
    scarce sources come late.
    """
    share, order = sum(plan.values()) or 1.0, sorted(plan, key=lambda s: (-have[s], s))
    tilt = {s: warm * (2 * i / max(len(order) - 1, 1) - 1) for i, s in enumerate(order)}
    mean = sum(plan[s] / share * tilt[s] for s in order)
    tilt = {s: max(-1.0, min(1.0, t - mean)) for s, t in tilt.items()}
    return {s: [(0.0, 1 - t), (1.0, 1 + t)] for s, t in tilt.items()}


def draw(docs: DataFrame, targets: DataFrame, tokens: Column, total: int | None = None, warm: float = 0.5, max_sources: int = 10_000, source: str = "source", doc_id: str = "doc_id", schedule: DataFrame | None = None) -> DataFrame:
    """(position, source, doc_id, pass, tokens): the drawn documents along training time.

    Sources are matched by canonical name. ``schedule``: (source, t, weight), knots of a
    piecewise linear weight over training time t in [0, 1]; a source's weights are scaled to
    its target share, so that it meets it overall and comes when its weight is high. A source
    without knots, or all if none is given, follows ``curriculum`` with ``warm``. A document
    is drawn in pass p (0, 1, ..., below max_repeats) if its first token falls within the
    demand of its source. Documents without text have no tokens and are not drawn; null
    sources and sources without target are left out; a repeated row is a document of its own.
    ``targets`` and ``schedule`` must have at most ``max_sources`` rows (checked).
    """
    if not small_enough(targets, max_sources) or (schedule is not None and not small_enough(schedule, max_sources)):
        raise ValueError("more sources than max_sources")
    wanted = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").where(F.col("source").isNotNull())
    rows = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()
    ours = docs.where(canonical_source(F.col(source)).isin([r[0] for r in rows]))
    # tokens are counted once, here: a filter on them before the cut would count them anew
    counted = cut(ours.select(canonical_source(F.col(source)).alias("source"), F.col(doc_id).alias("doc_id"), tokens.cast("bigint").alias("tokens"))).where("tokens > 0")
    have = {r[0]: r[1] for r in counted.groupBy("source").agg(F.sum("tokens")).collect()}  # one row a target
    plan = plan_tokens([tuple(r) for r in rows], have, total)
    spark = docs.sparkSession
    times = curriculum(plan, have, warm)
    if schedule is not None:
        given: dict[str, list] = {}
        for r in schedule.select(canonical_source(F.col("source")).alias("source"), F.col("t").cast("double"), F.col("weight").cast("double")).where("source is not null and t is not null and weight is not null").collect():
            given.setdefault(r[0], []).append((r[1], r[2]))
        times |= {s: k for s, k in given.items() if s in times}
    schema = "source string, demand double, have bigint, passes int, knots array<struct<t:double,w:double,c:double>>"
    plans = spark.createDataFrame([(s, plan[s], have[s], math.ceil(plan[s] / have[s] - 1e-12), demand_knots(times[s])) for s in sorted(plan)], schema)

    n = bucket_count(counted)
    salted = counted.join(F.broadcast(plans), "source").withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(n)))  # plans: one row a target, checked above
    sums = salted.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = sums.select("source", "bucket", (F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    inner = W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = salted.join(before, ["source", "bucket"]).withColumn("start", F.col("before") + F.sum("tokens").over(inner) - F.col("tokens"))
    each = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    u = (F.col("pass") * F.col("have") + F.col("start")) / F.col("demand")
    drawn = each.withColumn("u", u).where(F.col("u") < 1.0)
    return drawn.select(inverse_demand(F.col("u"), F.col("knots")).alias("position"), "source", "doc_id", F.col("pass").cast("int").alias("pass"), "tokens")


def in_order(drawn: DataFrame) -> DataFrame:
    """Range-sorted by position, the order of training."""
    return drawn.orderBy("position", "source", "doc_id", "pass")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, drawn, tokens, actual_share, repeats) for every target, also undrawn ones."""
    t = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    s = drawn.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("drawn"), F.sum("tokens").alias("tokens"), (F.max("pass") + 1).alias("repeats"))
    s = s.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(W.partitionBy()))  # one row a source
    return t.join(s, "source", "left").na.fill(0, ["documents", "drawn", "tokens", "repeats"]).na.fill(0.0, ["actual_share"])
