"""Queries of the training-data problems 2, 5, 6, 7 and 8 and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloudloom.llm import clusters, langid, leakage, mixing, neighbours
from cloudloom.plans.durable import cut
from cloudloom.plans.session import table

#: Where the vocabulary files are.
TOKENIZERS = os.environ.get("CLOUDLOOM_TOKENIZERS", "/opt/tokenizers")


#: Neighbours where the timeline header names none (fixed value of the format).
K_NEIGHBORS = 4


def splat_points(spark: SparkSession, d: str) -> DataFrame:
    """(g, id, x, k) of the valid splats with their scene's number of neighbours."""
    s = table(spark, d, "splats").groupBy("splat_id").agg(F.max(F.struct("loaded_at", "scene_id", "x", "y", "z")).alias("v"))
    s = s.select(F.col("v.scene_id").alias("g"), F.col("splat_id").alias("id"), F.array(*[F.col(f"v.{c}").cast("double") for c in "xyz"]).alias("x"))
    k = table(spark, d, "phox_seq").groupBy(F.col("scene_id").alias("g")).agg(F.max("k_neighbors").alias("k"))
    return s.join(k, "g", "left").withColumn("k", F.coalesce("k", F.lit(K_NEIGHBORS)))


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.nearest(splat_points(spark, d), 3)
    return found.select(F.col("g").alias("scene_id"), F.col("q").alias("splat_id"), F.col("id").alias("neighbor_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    p = neighbours.pairs(neighbours.nearest(splat_points(spark, d), 3))
    return p.select(F.col("lo").alias("splat_lo"), F.col("hi").alias("splat_hi"))


#: Step of the quantised coefficients and their number (fixed values of the format), and the distance that makes rows similar.
Q8_STEP, SH_SIZE, SIMILAR = 0.00731, 45, 32.0


def q8_rows(spark: SparkSession, d: str) -> DataFrame:
    """(id, vec): the q8 coefficients of each residual row, from sh_q8, its parts or the valid splat."""
    state = table(spark, d, "residual_state").select(
        F.col("splat_id").alias("id"), F.coalesce(F.col("sh_q8").cast("array<smallint>"), F.zip_with("approx_q8", "residual", lambda a, b: (a + b).cast("smallint"))).alias("vec")
    )
    bare = state.where(F.col("vec").isNull()).select("id").distinct()
    splats = table(spark, d, "splats").select(F.col("splat_id").alias("id"), "sh_rest", "loaded_at").join(bare, "id", "left_semi")
    valid = splats.groupBy("id").agg(F.max_by("sh_rest", "loaded_at").alias("sh"))
    back = valid.select("id", F.transform("sh", lambda x: F.rint(x.cast("double") / Q8_STEP).cast("smallint")).alias("vec"))
    return state.where(F.col("vec").isNotNull()).unionByName(back.where(F.col("vec").isNotNull()))


def _p5(spark: SparkSession, d: str):
    rows = q8_rows(spark, d)
    return clusters.clusters(rows, SH_SIZE, SIMILAR), rows


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d)[0].select(F.col("cluster").alias("cluster_key"), F.col("id").alias("splat_id"))


def p5_typical(spark: SparkSession, d: str) -> DataFrame:
    members, rows = _p5(spark, d)
    return clusters.describe(cut(members), rows, SH_SIZE).select(F.col("cluster").alias("cluster_key"), F.col("size"), F.col("rank"), F.col("id").alias("splat_id"), "to_medoid")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("doc_id", "item_id")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    count = mixing.token_counter(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return mixing.in_order(mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"), count("text")))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    count = mixing.token_counter(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.draw(table(spark, d, "documents"), targets, count("text")), targets)


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.label_check(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.flagged(p8_segments(spark, d))


QUERIES = {"p2_found": p2_found, "p2_nearest": p2_nearest, "p5_found": p5_found, "p5_typical": p5_typical, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_segments": p8_segments}

_RUNS = r"""WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM eval_items),
ir AS (SELECT item_id, array_to_string(list_slice(w, i, i+11), ' ') r FROM iw, unnest(range(1, len(w)-10)) t(i)),
own AS (SELECT r, min(item_id) item_id FROM ir GROUP BY r HAVING count(DISTINCT item_id) = 1),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents),
dr AS (SELECT doc_id, array_to_string(list_slice(w, i, i+11), ' ') r FROM dw, unnest(range(1, len(w)-10)) t(i))
"""
_Q8 = """WITH v AS (SELECT splat_id, sh_rest FROM (SELECT *, row_number() OVER (PARTITION BY splat_id ORDER BY loaded_at DESC) rn FROM splats) WHERE rn = 1),
q AS (SELECT DISTINCT splat_id, coalesce(list_transform(r.sh_q8, lambda x: x::INT), CASE WHEN r.approx_q8 IS NOT NULL AND r.residual IS NOT NULL THEN list_transform(range(1, len(r.approx_q8)+1), lambda i: r.approx_q8[i]::INT + r.residual[i]::INT) END, list_transform(v.sh_rest, lambda x: round_even(x::DOUBLE / 0.00731, 0)::INT)) c
FROM residual_state r LEFT JOIN v USING (splat_id)),
f AS (SELECT splat_id, c::FLOAT[45] c FROM q WHERE c IS NOT NULL)
"""
_KNN = """WITH v AS (SELECT splat_id, scene_id, x::DOUBLE x, y::DOUBLE y, z::DOUBLE z FROM (SELECT *, row_number() OVER (PARTITION BY splat_id ORDER BY loaded_at DESC) rn FROM splats) WHERE rn = 1 AND isfinite(x) AND isfinite(y) AND isfinite(z)),
p AS (SELECT a.scene_id, a.splat_id q, b.splat_id id, row_number() OVER (PARTITION BY a.splat_id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.splat_id) rn, coalesce(s.k_neighbors, 4) k
FROM v a JOIN v b ON a.scene_id = b.scene_id AND a.splat_id <> b.splat_id LEFT JOIN phox_seq s ON s.scene_id = a.scene_id),
n AS (SELECT scene_id, q, id FROM p WHERE rn <= k)
"""
ORACLE = {"p2_found": _KNN + "SELECT DISTINCT least(q, id) AS splat_lo, greatest(q, id) AS splat_hi FROM n", "p2_nearest": _KNN + "SELECT scene_id, q AS splat_id, id AS neighbor_id FROM n", "p5_found": _Q8 + "SELECT min(b.splat_id) AS cluster_key, a.splat_id FROM f a JOIN f b ON array_distance(a.c, b.c) <= 32 GROUP BY a.splat_id HAVING count(DISTINCT b.splat_id) > 1", "p5_typical": _Q8 + """, k AS (SELECT min(b.splat_id) AS cluster_key, a.splat_id FROM f a JOIN f b ON array_distance(a.c, b.c) <= 32 GROUP BY a.splat_id HAVING count(DISTINCT b.splat_id) > 1),
n AS (SELECT k.cluster_key, k.splat_id, round(sqrt(list_sum(list_transform(range(1,46), lambda i: (a.c[i]::DOUBLE-m.c[i]::DOUBLE)*(a.c[i]::DOUBLE-m.c[i]::DOUBLE)))),6) AS to_medoid FROM k JOIN f a ON a.splat_id = k.splat_id JOIN f m ON m.splat_id = k.cluster_key),
r AS (SELECT *, count(*) OVER (PARTITION BY cluster_key) AS size, row_number() OVER (PARTITION BY cluster_key ORDER BY splat_id <> cluster_key, to_medoid, splat_id)::INT AS rank FROM n)
SELECT cluster_key, size, rank, splat_id, to_medoid FROM r WHERE rank <= 3""", "p6_leaks": _RUNS + """, ij AS (SELECT item_id, i j, array_to_string(list_slice(w, i, i+11), ' ') r FROM iw, unnest(range(1, len(w)-10)) t(i)),
di AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i+11), ' ') r FROM dw, unnest(range(1, len(w)-10)) t(i)),
m AS (SELECT di.doc_id, ij.item_id, i, i - j d, own.r IS NOT NULL o FROM di JOIN ij USING (r) LEFT JOIN own USING (r)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY i) g FROM m),
s AS (SELECT doc_id, item_id, count(*) + 11 n, min(i) - 1 p FROM g GROUP BY doc_id, item_id, d, g HAVING bool_or(o))
SELECT doc_id, item_id, max(n)::INT AS run_words, arg_min(p, (-n, p))::INT AS at_word FROM s GROUP BY doc_id, item_id""", "p6_found": _RUNS + "SELECT DISTINCT doc_id, item_id FROM dr JOIN own USING (r)"}
