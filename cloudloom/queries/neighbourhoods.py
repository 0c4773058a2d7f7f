"""Queries over the nearest neighbours of every splat, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloudloom.functions import quant as Q, shading as S
from cloudloom.operators import buckets, grids, local
from cloudloom.plans.adapters import SPLATS_SQL, whole_splats
from cloudloom.queries.projections import _cols, _r, query

QUERIES: dict = {}
ORACLE: dict = {}
query = query.into(QUERIES, ORACLE)
_S = f"WITH {SPLATS_SQL}\n"
K = 4


def _edge_sql(k: int) -> str:
    return _S + f""", e AS (SELECT a.scene_id, a.id src, b.id dst, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z) d2 FROM s a JOIN s b ON a.scene_id=b.scene_id AND a.id<>b.id),
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, src ORDER BY d2, dst) AS rank FROM e) WHERE rank <= {k})
"""


_EDGE = _edge_sql(K)


def edges(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return buckets.knn_edges(whole_splats(spark, d).select("scene_id", "id", "x", "y", "z"), k)


@query(_EDGE + "SELECT scene_id, src, dst, rank::INT AS rank, round(sqrt(d2),6) AS dist FROM edges")
def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("scene_id", "src", "dst", "rank", _r(F.sqrt("d2")).alias("dist"))


@query(_EDGE + ", w AS (SELECT *, d2 - lag(d2) OVER (PARTITION BY scene_id, src ORDER BY rank) back FROM edges) SELECT count(*) FILTER (w.src = w.dst) AS self_edges, count(*) FILTER (back < -1e-9) AS unsorted, count(*) FILTER (p.id IS NULL) AS out_of_range, count(*) AS edges FROM w LEFT JOIN s p ON p.scene_id = w.scene_id AND p.id = w.dst")
def validate_edges(spark: SparkSession, d: str) -> DataFrame:
    return grids.edge_checks(edges(spark, d), whole_splats(spark, d).select("scene_id", "id"))


_LIT = _EDGE + """, l AS (SELECT e.*, b.y-a.y t, e.d2-(b.y-a.y)*(b.y-a.y) off2, exp(2*greatest(b.sx,b.sy,b.sz)) s2, 1.0/(1.0+exp(-b.opacity)) alpha FROM edges e JOIN s a ON a.id=e.src JOIN s b ON b.id=e.dst)
"""


def _lit(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the distance along a light from above (t), the squared distance off it, and what the neighbour blocks."""
    s = whole_splats(spark, d).select("scene_id", "id", "y", F.exp(2 * F.greatest("sx", "sy", "sz")).alias("s2"), Q.sigmoid(F.col("opacity")).alias("alpha"))
    e = grids.with_ends(edges(spark, d), s, ["y", "s2", "alpha"]).withColumn("t", F.col("d_y") - F.col("s_y"))
    return e.withColumn("off2", F.col("d2") - F.col("t") * F.col("t"))


@query(_LIT + "SELECT src AS id, round(product(CASE WHEN t > 0 THEN 1-least(1.0,exp(-0.5*off2/s2)*alpha) ELSE 1.0 END),5) AS shadow, round(exp(-0.5*sum(CASE WHEN t > 0 THEN exp(-0.5*d2/0.0025)*alpha ELSE 0.0 END)),5) AS ao FROM l GROUP BY src")
def shadow_and_ao(spark: SparkSession, d: str) -> DataFrame:
    return occlusion(spark, d).select("id", _r(F.col("shadow"), 5).alias("shadow"), _r(F.col("ao"), 5).alias("ao"))


def occlusion(spark: SparkSession, d: str) -> DataFrame:
    up = F.col("t") > 0
    occ = F.least(F.lit(1.0), F.exp(-0.5 * F.col("off2") / F.col("d_s2")) * F.col("d_alpha"))
    shadow = F.product(F.when(up, 1 - occ).otherwise(1.0))
    ao = F.exp(-0.5 * F.sum(F.when(up, F.exp(-0.5 * F.col("d2") / 0.0025) * F.col("d_alpha")).otherwise(0.0)))
    return _lit(spark, d).groupBy(F.col("src").alias("id")).agg(shadow.alias("shadow"), ao.alias("ao"))


@query(_edge_sql(6) + "SELECT src AS id, round(greatest(0.5*avg(sqrt(d2)),0.001),6) AS sigma FROM edges GROUP BY src")
def seed_sigma(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d, 6).groupBy(F.col("src").alias("id")).agg(_r(F.greatest(0.5 * F.avg(F.sqrt("d2")), F.lit(0.001))).alias("sigma"))


def _dirs_sql() -> str:
    import math

    rows = []
    for i in range(12):
        y = 1 - 2 * (i + 0.5) / 12
        r, a = math.sqrt(1 - y * y), math.pi * (1 + math.sqrt(5)) * (i + 0.5)
        rows.append(f"({i}, [{', '.join(f'{v!r}::DOUBLE' for v in S._basis_at((math.cos(a) * r, math.sin(a) * r, y)))}])")
    return "b AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(i, basis))"


_SEQ = ", " + _dirs_sql() + """, u AS (SELECT s.id, b.i*3+c.c pos, greatest(0.0,least(1.0,[dc_r,dc_g,dc_b][c.c+1]*0.28209479177387814+0.5+list_sum(list_transform(range(1,16), lambda k: sh_rest[15*c.c+k]::DOUBLE*b.basis[k])))) v FROM s, b, range(3) c(c))
"""


@query(_EDGE + _SEQ + """, n AS (SELECT e.src id, u.pos, avg(u.v) v FROM edges e JOIN u ON u.id = e.dst GROUP BY ALL),
m AS (SELECT u.id, u.v - avg(u.v) OVER (PARTITION BY u.id) a, n.v - avg(n.v) OVER (PARTITION BY u.id) b FROM u JOIN n USING (id, pos))
SELECT id, round(0.5*(1-sum(a*b)/(greatest(sqrt(sum(a*a)),1e-9)*greatest(sqrt(sum(b*b)),1e-9))),4) AS score FROM m GROUP BY id""")
def photometric_score(spark: SparkSession, d: str) -> DataFrame:
    """0 where a splat's colours over 12 directions go with its neighbours', 1 where they go against them."""
    own = whole_splats(spark, d).select("scene_id", "id", S.sh_sequence(_cols("dc_r", "dc_g", "dc_b"), F.col("sh_rest")).alias("seq"))
    e = grids.with_ends(edges(spark, d), own, ["seq"])
    zero = F.array(*[F.lit(0.0)] * 36)
    both = e.groupBy("src").agg(F.first("s_seq").alias("a"), F.collect_list("d_seq").alias("near"))  # k lists at most
    mean = F.transform(F.aggregate("near", zero, lambda s, v: F.zip_with(s, v, lambda p, q: p + q)), lambda v: v / F.size("near"))
    both = both.select(F.col("src").alias("id"), "a", mean.alias("b"))

    def centred(c: str):
        m = F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / 36
        return F.transform(c, lambda v: v - m)

    both = both.select("id", centred("a").alias("a"), centred("b").alias("b"))

    def inner(p: str, q: str):
        return F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    low = F.lit(1e-9)
    return both.select("id", _r(0.5 * (1 - inner("a", "b") / (F.greatest(F.sqrt(inner("a", "a")), low) * F.greatest(F.sqrt(inner("b", "b")), low))), 4).alias("score"))


@query(_S + _SEQ + "SELECT id, pos::INT AS pos, round(v,4) AS v FROM u")
def sh_directions(spark: SparkSession, d: str) -> DataFrame:
    q = whole_splats(spark, d).select("id", F.posexplode(S.sh_sequence(_cols("dc_r", "dc_g", "dc_b"), F.col("sh_rest"))).alias("pos", "v"))
    return q.select("id", "pos", _r(F.col("v"), 4).alias("v"))


_MAT = _EDGE + """, nd AS (SELECT src id, avg(sqrt(d2)) nd FROM edges GROUP BY src),
m AS (SELECT s.id, s.scene_id, nd, abs(dc_r) kappa, 1/(1+exp(-opacity)) al, (dc_r+dc_g+dc_b)/3*0.28209479177387814+0.5 base, sqrt(dc_r*dc_r+dc_g*dc_g+dc_b*dc_b)+1e-3 sz,
 sqrt(list_sum(list_transform(sh_rest[1:9], lambda c: c::DOUBLE*c::DOUBLE))) b1, sqrt(list_sum(list_transform(sh_rest[25:45], lambda c: c::DOUBLE*c::DOUBLE))) b3, sqrt(list_sum(list_transform(sh_rest, lambda c: c::DOUBLE*c::DOUBLE))) re FROM s JOIN nd USING (id)),
p AS (SELECT scene_id, quantile_cont(nd, 0.9) far, quantile_cont(kappa, 0.25) flat FROM m GROUP BY scene_id),
vt AS (SELECT m.*, (nd > far)::INT + (kappa < flat)::INT + (al < 0.3)::INT votes, re/sz ratio FROM m JOIN p USING (scene_id))
"""


@query(_MAT + """SELECT id, CASE WHEN votes >= 2 THEN 6 WHEN base > 1.0 AND b3 > 0.3 THEN 5 WHEN b3/sz > 1.5 AND al > 0.7 THEN 3 WHEN ratio > 0.5 AND b1 > b3*1.5 THEN 2 WHEN ratio < 0.2 AND al > 0.5 THEN 1 ELSE 0 END AS hint,
CASE WHEN votes >= 2 THEN least(votes*80,255) WHEN base > 1.0 AND b3 > 0.3 THEN 200 WHEN b3/sz > 1.5 AND al > 0.7 THEN floor(least(b3*50,255)) WHEN ratio > 0.5 AND b1 > b3*1.5 THEN floor(least(ratio*80,255)) WHEN ratio < 0.2 AND al > 0.5 THEN greatest(255-floor(ratio*1000),0) ELSE 0 END::INT AS sure FROM vt""")
def material_classes(spark: SparkSession, d: str) -> DataFrame:
    m = materials(spark, d)
    return m.select("id", "hint", "sure")


def materials(spark: SparkSession, d: str) -> DataFrame:
    """Splats with their class; the stored curvature stands in |dc_r| as in curvature_q8."""
    near = edges(spark, d).groupBy(F.col("src").alias("id")).agg(F.avg(F.sqrt("d2")).alias("nd"))
    s = whole_splats(spark, d).join(near, "id").withColumns({"kappa": F.abs("dc_r"), "al": Q.sigmoid(F.col("opacity"))})
    p = s.groupBy("scene_id").agg(F.percentile("nd", 0.9).alias("far"), F.percentile("kappa", 0.25).alias("flat"))
    s = s.join(p, "scene_id")
    hint, sure = S.material_class(_cols("dc_r", "dc_g", "dc_b"), F.col("sh_rest"), *_cols("al", "kappa", "nd", "far", "flat"))
    return s.withColumns({"hint": hint, "sure": sure})


@query(_MAT + ", h AS (SELECT s.id, greatest(0.0,least(1.0,0.28209479177387814*dc_r+0.5)) a, CASE WHEN votes >= 2 THEN 6 WHEN base > 1.0 AND b3 > 0.3 THEN 5 WHEN b3/vt.sz > 1.5 AND al > 0.7 THEN 3 WHEN ratio > 0.5 AND b1 > b3*1.5 THEN 2 WHEN ratio < 0.2 AND al > 0.5 THEN 1 ELSE 0 END h, floor(least(ratio/4*255,255)) vd FROM vt JOIN s USING (id)) SELECT id, round(CASE h WHEN 1 THEN 0.95 WHEN 2 THEN 0.4 WHEN 3 THEN 0.05 WHEN 6 THEN 1.0 WHEN 0 THEN 0.9-0.7*vd/255.0 ELSE 0.6 END,5) AS rough, round(CASE h WHEN 2 THEN 0.04+0.3*(a-0.04) WHEN 3 THEN a WHEN 6 THEN 0.0 ELSE 0.04 END,5) AS f0 FROM h")
def class_lobes(spark: SparkSession, d: str) -> DataFrame:
    m = materials(spark, d).withColumn("vd", Q.view_dependence(F.array("dc_r", "dc_g", "dc_b"), F.col("sh_rest")))
    a = Q.clip(Q.SH_C0 * F.col("dc_r") + 0.5, 0.0, 1.0)
    return m.select("id", _r(S.class_roughness(F.col("hint"), F.col("vd")), 5).alias("rough"), _r(S.class_f0(F.col("hint"), a), 5).alias("f0"))


@query()
def mls_normals(spark: SparkSession, d: str) -> DataFrame:
    s = whole_splats(spark, d).select("scene_id", "id", "x", "y", "z")
    n = local.mls_normals(local.neighbourhoods(s, edges(spark, d, 24)))
    return n.select("id", *[_r(F.col(c), 4).alias(c) for c in ("nx", "ny", "nz", "tangent")])


@query()
def splat_germs(spark: SparkSession, d: str) -> DataFrame:
    s = whole_splats(spark, d).where("tier <> 2")
    all_points = whole_splats(spark, d).select("scene_id", "id", "x", "y", "z")
    g = local.germs(local.neighbourhoods(all_points, edges(spark, d, 16)).join(s.select("id", "qw", "qx", "qy", "qz", "sx", "sy", "sz"), "id"))
    return g.select("id", F.transform("theta", lambda t: F.round(t, 3)).alias("theta"))
