"""Queries over joins, aggregates, windows, sorts and sets, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cloudloom.functions import quant as Q, shading as S
from cloudloom.operators import grids, patches, ranks, raster
from cloudloom.plans.adapters import POINTS_SQL, SPLATS_SQL, points, valid_splats, whole_splats
from cloudloom.plans.session import table
from cloudloom.queries.projections import _MORTON, PROJECTED_SQL, VIEW, _cols, _r, projected, query, with_morton

QUERIES: dict = {}
ORACLE: dict = {}
query = query.into(QUERIES, ORACLE)
_S = f"WITH {SPLATS_SQL}\n"
_P = f"WITH {POINTS_SQL}\n"


# --- aggregates


@query(_S + "SELECT tier, count(*) AS n, round(avg(1.0/(1.0+exp(-opacity))),6) AS mean_alpha FROM s GROUP BY tier")
def tier_histogram(spark: SparkSession, d: str) -> DataFrame:
    return whole_splats(spark, d).groupBy("tier").agg(F.count("*").alias("n"), _r(F.avg(Q.sigmoid(F.col("opacity")))).alias("mean_alpha"))


@query(_S + ", c AS (SELECT scene_id, avg(x) mx, avg(y) my, avg(z) mz, " + ", ".join(f"min({c}) lo_{c}, max({c}) hi_{c}" for c in "xyz") + " FROM s GROUP BY scene_id) SELECT c.scene_id, any_value(lo_x) AS lo_x, any_value(hi_x) AS hi_x, round(any_value(mx),6) AS cx, round(max(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))),6) AS radius FROM s JOIN c USING (scene_id) GROUP BY c.scene_id")
def scene_bounds(spark: SparkSession, d: str) -> DataFrame:
    s = whole_splats(spark, d).select("scene_id", "x", "y", "z")
    c = s.groupBy("scene_id").agg(F.min("x").alias("lo_x"), F.max("x").alias("hi_x"), *[F.avg(c).alias(f"m{c}") for c in "xyz"])
    dx, dy, dz = (F.col(v) - F.col(f"m{v}") for v in "xyz")
    return s.join(c, "scene_id").groupBy("scene_id").agg(F.first("lo_x").alias("lo_x"), F.first("hi_x").alias("hi_x"), _r(F.first("mx")).alias("cx"), _r(F.max(F.sqrt(dx * dx + dy * dy + dz * dz))).alias("radius"))


@query(_P + "SELECT floor(x/0.125)::BIGINT AS vx, floor(y/0.125)::BIGINT AS vy, floor(z/0.125)::BIGINT AS vz, count(*) AS n, round(avg(x),6) AS x, round(avg(y),6) AS y, round(avg(z),6) AS z FROM p GROUP BY ALL")
def voxel_downsample(spark: SparkSession, d: str) -> DataFrame:
    v = grids.voxel_downsample(points(spark, d), 0.125)
    return v.select("vx", "vy", "vz", "n", *[_r(F.col(c)).alias(c) for c in "xyz"])


_CELL = ", c AS (SELECT *, (greatest(0,least(floor(x*32),31)) + 32*greatest(0,least(floor(y*32),31)) + 1024*greatest(0,least(floor(z*32),31)))::BIGINT AS cell FROM p)\n"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).withColumn("cell", grids.cell_key(*_cols("x", "y", "z")))


@query(_P + _CELL + "SELECT cell, count(*) AS n FROM c GROUP BY cell")
def cell_binning(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("cell").agg(F.count("*").alias("n"))


_CAND = _P + _CELL + """, g AS (SELECT cell, count(*) n, 0.04+avg(x)*0.08 r95, 0.03+avg(y)*0.12 c, 0.2+avg(z) o, 0.5+avg(x*y)*2 s, 0.02*avg(z)-0.002 imp FROM c GROUP BY cell),
k AS (SELECT *, CASE WHEN r95<0.047 AND c<0.055 AND o<0.25 AND imp>0.01 THEN 'smooth' WHEN r95<0.085 AND c<0.09 AND s<1.25 AND imp>0.006 THEN 'curved' WHEN r95<0.105 AND c<0.13 AND s<1.55 AND imp>0.0 THEN 'appearance' ELSE 'fallback' END class FROM g),
b AS (SELECT *, CASE class WHEN 'smooth' THEN 0.86 WHEN 'curved' THEN 0.91 WHEN 'appearance' THEN 0.96 ELSE 1.04 END * (5.9+34*r95+4.6*c+1.35*o+0.34*least(s,2.25)-7.5*greatest(imp,-0.02)) + 0.9 bps FROM k)
"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Cells with the statistics that the tier rules read, their class and predicted bytes a splat."""
    a = F.avg
    g = cells(spark, d).groupBy("cell").agg(F.count("*").alias("n"), (0.04 + a("x") * 0.08).alias("r95"), (0.03 + a("y") * 0.12).alias("c"), (0.2 + a("z")).alias("o"), (0.5 + a(F.col("x") * F.col("y")) * 2).alias("s"), (0.02 * a("z") - 0.002).alias("imp"))
    return with_cost(with_class(g))


def with_class(g: DataFrame) -> DataFrame:
    """Four context classes by thresholds on residual, colour, opacity and scale spread, and gain."""
    r, c, o, s, imp = _cols("r95", "c", "o", "s", "imp")
    rule = F.when((r < 0.047) & (c < 0.055) & (o < 0.25) & (imp > 0.01), "smooth").when((r < 0.085) & (c < 0.09) & (s < 1.25) & (imp > 0.006), "curved").when((r < 0.105) & (c < 0.13) & (s < 1.55) & (imp > 0.0), "appearance")
    return g.withColumn("class", rule.otherwise("fallback"))


def with_cost(g: DataFrame) -> DataFrame:
    factor = F.when(F.col("class") == "smooth", 0.86).when(F.col("class") == "curved", 0.91).when(F.col("class") == "appearance", 0.96).otherwise(1.04)
    base = 5.9 + 34 * F.col("r95") + 4.6 * F.col("c") + 1.35 * F.col("o") + 0.34 * F.least("s", F.lit(2.25)) - 7.5 * F.greatest("imp", F.lit(-0.02))
    return g.withColumn("bps", factor * base + 0.9)


@query(_CAND + "SELECT cell, n, class, round(bps,5) AS bps FROM b")
def context_class(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("cell", "n", "class", _r(F.col("bps"), 5).alias("bps"))


_GATE = "class <> 'fallback' AND NOT (r95 > 0.115 OR s > 1.85 OR c > 0.165) AND bps < 0.97*(19123179/763800.0)"


@query(_CAND + f", acc AS (SELECT DISTINCT cell FROM c WHERE l_returnflag = 'R' AND x > 0.97) SELECT cell, n, ({_GATE}) AS promoted FROM b ANTI JOIN acc USING (cell)")
def tier_promotion(spark: SparkSession, d: str) -> DataFrame:
    accepted = cells(spark, d).where("l_returnflag = 'R' AND x > 0.97").select("cell").distinct()
    return candidates(spark, d).join(accepted, "cell", "left_anti").select("cell", "n", F.expr(_GATE).alias("promoted"))


@query(_CAND + "SELECT coalesce(class, 'total') AS class, count(*) AS cells, sum(n)::BIGINT AS n, round(sum(n*bps),2) AS bytes FROM b GROUP BY ROLLUP (class)")
def rollup_by_class(spark: SparkSession, d: str) -> DataFrame:
    r = candidates(spark, d).rollup("class").agg(F.count("*").alias("cells"), F.sum("n").alias("n"), _r(F.sum(F.col("n") * F.col("bps")), 2).alias("bytes"))
    return r.withColumn("class", F.coalesce("class", F.lit("total")))


@query(_S + ", q AS (SELECT scene_id, quantile_cont(sqrt(x*x+y*y+z*z),0.8) p80, quantile_cont(opacity,0.5) p50 FROM s GROUP BY scene_id) SELECT s.id FROM s JOIN q USING (scene_id) WHERE sqrt(x*x+y*y+z*z) > p80 AND opacity < p50")
def percentile_halo(spark: SparkSession, d: str) -> DataFrame:
    s = whole_splats(spark, d).select("id", "scene_id", "opacity", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("r"))
    q = s.groupBy("scene_id").agg(F.percentile("r", 0.8).alias("p80"), F.percentile("opacity", 0.5).alias("p50"))
    return s.join(q, "scene_id").where("r > p80 AND opacity < p50").select("id")


@query(_S + ", w AS (SELECT *, 1.0/(1.0+exp(-opacity)) w FROM s) SELECT scene_id, tier, round(sum(w*x)/sum(w),6) AS mx, round(sum(w*(x*x))/sum(w)-(sum(w*x)/sum(w))*(sum(w*x)/sum(w)),5) AS vxx, round(sum(w*(x*y))/sum(w)-(sum(w*x)/sum(w))*(sum(w*y)/sum(w)),5) AS vxy, round(sqrt(avg(z*z)),6) AS rms_z FROM w GROUP BY ALL")
def weighted_moments(spark: SparkSession, d: str) -> DataFrame:
    w = whole_splats(spark, d).withColumn("w", Q.sigmoid(F.col("opacity")))

    def mean(c):
        return F.sum(F.col("w") * c) / F.sum("w")

    x, y, z = _cols("x", "y", "z")
    return w.groupBy("scene_id", "tier").agg(_r(mean(x)).alias("mx"), _r(mean(x * x) - mean(x) * mean(x), 5).alias("vxx"), _r(mean(x * y) - mean(x) * mean(y), 5).alias("vxy"), _r(F.sqrt(F.avg(z * z))).alias("rms_z"))


# --- codebook and residuals

_BOOK = ", u AS (SELECT id, tier, unnest(sh_rest)::DOUBLE v, unnest(range(45)) c FROM s), b AS (SELECT tier, c//15 g, c%15 k, round_even(avg(v)/0.00731,0)::INT code FROM u GROUP BY ALL)\n"


def coefficients(spark: SparkSession, d: str) -> DataFrame:
    u = whole_splats(spark, d).select("id", "tier", F.posexplode("sh_rest").alias("c", "v"))
    return u.select("id", "tier", F.floor(F.col("c") / 15).cast("bigint").alias("g"), (F.col("c") % 15).cast("bigint").alias("k"), F.col("v").cast("double").alias("v"))


def codebook(spark: SparkSession, d: str) -> DataFrame:
    return coefficients(spark, d).groupBy("tier", "g", "k").agg(F.rint(F.avg("v") / 0.00731).cast("int").alias("code"))


@query(_S + _BOOK + "SELECT u.id, u.c//15 AS g, u.c%15 AS k, b.code, (round_even(u.v/0.00731,0)::INT - b.code) AS r FROM u JOIN b ON b.tier = u.tier AND b.g = u.c//15 AND b.k = u.c%15")
def vq_residual(spark: SparkSession, d: str) -> DataFrame:
    j = coefficients(spark, d).join(codebook(spark, d), ["tier", "g", "k"])  # 135 codewords: Catalyst broadcasts by their size
    return j.select("id", "g", "k", "code", (F.rint(F.col("v") / 0.00731).cast("int") - F.col("code")).alias("r"))


_RES = _S + _BOOK + ", r AS (SELECT u.id, u.tier, u.c//15 g, round_even(u.v/0.00731,0)::INT - b.code r FROM u JOIN b ON b.tier = u.tier AND b.g = u.c//15 AND b.k = u.c%15)\n"


@query(_RES + "SELECT coalesce(tier,-1) AS tier, coalesce(g,-1) AS g, count(*) AS n, max(abs(r)) AS worst, sum((r=0)::INT)::BIGINT AS zeros, round(sqrt(avg(r*r)),6) AS rmse, sum((abs(r)<=8)::INT)::BIGINT AS within_8 FROM r GROUP BY GROUPING SETS ((g), (tier, g), ())")
def residual_stats(spark: SparkSession, d: str) -> DataFrame:
    r = coefficients(spark, d).join(codebook(spark, d), ["tier", "g", "k"]).select("tier", "g", (F.rint(F.col("v") / 0.00731).cast("int") - F.col("code")).alias("r"))
    sets = r.groupingSets([["g"], ["tier", "g"], []], "tier", "g")
    out = sets.agg(F.count("*").alias("n"), F.max(F.abs("r")).alias("worst"), F.count_if(F.col("r") == 0).alias("zeros"), _r(F.sqrt(F.avg(F.col("r") * F.col("r")))).alias("rmse"), F.count_if(F.abs("r") <= 8).alias("within_8"))
    return out.select(F.coalesce("tier", F.lit(-1)).alias("tier"), F.coalesce("g", F.lit(-1)).alias("g"), "n", "worst", "zeros", "rmse", "within_8")


@query(_S + ", a AS (SELECT id, tier, row_number() OVER (PARTITION BY scene_id, tier ORDER BY id) - 1 AS rk, scene_id FROM s), b AS (SELECT splat_id, scene_id, tier, row_number() OVER (PARTITION BY scene_id, tier ORDER BY splat_id) - 1 AS rk FROM (SELECT DISTINCT splat_id, scene_id, tier::INT tier FROM residual_state WHERE tier IS NOT NULL)) SELECT a.id, b.splat_id AS paired, a.rk FROM a JOIN b USING (scene_id, tier, rk)")
def residual_rank_join(spark: SparkSession, d: str) -> DataFrame:
    key = ["scene_id", "tier"]
    a = ranks.rank_in(whole_splats(spark, d).select(*key, "id"), key, [F.col("id")], "rk", -1)
    r = table(spark, d, "residual_state").where("tier IS NOT NULL").select("splat_id", "scene_id", F.col("tier").cast("int").alias("tier")).distinct()
    b = ranks.rank_in(r, key, [F.col("splat_id")], "rk", -1)
    return a.join(b, ["scene_id", "tier", "rk"]).select("id", F.col("splat_id").alias("paired"), F.col("rk").cast("bigint").alias("rk"))


@query("SELECT count(*) AS rows, sum((list_filter(range(1,46), lambda i: sh_q8[i]::INT <> approx_q8[i]::INT + residual[i]::INT) <> [])::INT)::BIGINT AS broken FROM residual_state WHERE sh_q8 IS NOT NULL AND approx_q8 IS NOT NULL AND residual IS NOT NULL")
def exact_archive_check(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "residual_state").where("sh_q8 IS NOT NULL AND approx_q8 IS NOT NULL AND residual IS NOT NULL")
    made = F.zip_with("approx_q8", "residual", lambda a, b: (a + b).cast("smallint"))
    return r.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(F.col("sh_q8") == made, F.lit(False))).alias("broken"))


_CENTRES = ", k AS (SELECT scene_id, tier AS centre, avg(x) cx, avg(y) cy, avg(z) cz FROM s GROUP BY ALL)"


@query(_S + _CENTRES + " SELECT s.id, arg_min(k.centre, ((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz), k.centre)) AS centre FROM s JOIN k USING (scene_id) GROUP BY s.id")
def nearest_centre(spark: SparkSession, d: str) -> DataFrame:
    s = whole_splats(spark, d).select("id", "scene_id", "tier", "x", "y", "z")
    k = s.groupBy("scene_id", F.col("tier").alias("centre")).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    centres = k.groupBy("scene_id").agg(F.collect_list(F.struct("centre", "cx", "cy", "cz")).alias("k"))  # three tiers at most
    best = F.array_min(F.transform("k", lambda c: F.struct(((F.col("x") - c["cx"]) * (F.col("x") - c["cx"]) + (F.col("y") - c["cy"]) * (F.col("y") - c["cy"]) + (F.col("z") - c["cz"]) * (F.col("z") - c["cz"])).alias("d2"), c["centre"].alias("centre"))))
    return s.join(centres, "scene_id").select("id", best["centre"].alias("centre"))


# --- raster

_FRAG = PROJECTED_SQL.rstrip() + """, vis AS (SELECT id, depth, px, py, radius, alpha, cc/dt ia, -cb/dt ib, ca/dt ic, greatest(0.0,least(1.0,dc_r)) r, greatest(0.0,least(1.0,dc_g)) g, greatest(0.0,least(1.0,dc_b)) b FROM (SELECT *, CASE WHEN abs(ca*cc-cb*cb)<1e-10 THEN 1e-10 ELSE ca*cc-cb*cb END dt FROM f) WHERE radius <= 4.0),
fx AS (SELECT *, unnest(range(greatest(0,floor(px-radius))::BIGINT, least(63,ceil(px+radius))::BIGINT+1)) x FROM vis),
fy AS (SELECT *, unnest(range(greatest(0,floor(py-radius))::BIGINT, least(63,ceil(py+radius))::BIGINT+1)) y FROM fx),
fr AS (SELECT *, least(alpha*exp(greatest(-0.5*(ia*(x+0.5-px)*(x+0.5-px)+2*ib*(x+0.5-px)*(y+0.5-py)+ic*(y+0.5-py)*(y+0.5-py)),-20.0)),0.999) a FROM fy),
tr AS (SELECT *, exp(coalesce(sum(ln(1-a)) OVER (PARTITION BY y, x ORDER BY depth, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0.0)) t FROM fr WHERE a >= 1/255.0::DOUBLE)
"""


def fragments(spark: SparkSession, d: str) -> DataFrame:
    p = projected(spark, d).where(F.col("radius") <= VIEW.size / 16)
    p = p.withColumns({c: Q.clip(F.col(f"dc_{c}"), 0.0, 1.0) for c in "rgb"})
    return raster.fragments(p.select("id", "depth", "px", "py", "radius", "alpha", "ca", "cb", "cc", "r", "g", "b"), VIEW.size)


@query(_FRAG + "SELECT y::INT AS y, x::INT AS x, round(sum(t*a*r),4) AS r, round(sum(t*a*g),4) AS g, round(sum(t*a*b),4) AS b, round(sum(t*a),4) AS alpha FROM tr WHERE t >= 1e-4 GROUP BY ALL")
def composite_pixels(spark: SparkSession, d: str) -> DataFrame:
    return raster.composite(fragments(spark, d)).select("y", "x", *[_r(F.col(c), 4).alias(c) for c in ("r", "g", "b", "alpha")])


@query(PROJECTED_SQL + ", v2 AS (SELECT * FROM f WHERE radius <= 4.0 AND px+radius >= 0 AND px-radius < 64 AND py+radius >= 0 AND py-radius < 64), tx AS (SELECT id, py, radius, unnest(range(floor(greatest(0,least(floor(px-radius),63))/16)::BIGINT, floor(greatest(0,least(ceil(px+radius),63))/16)::BIGINT+1)) tx FROM v2), ty AS (SELECT tx, unnest(range(floor(greatest(0,least(floor(py-radius),63))/16)::BIGINT, floor(greatest(0,least(ceil(py+radius),63))/16)::BIGINT+1)) ty FROM tx) SELECT tx, ty, count(*) AS n FROM ty GROUP BY ALL")
def tile_bins(spark: SparkSession, d: str) -> DataFrame:
    p = projected(spark, d).where(F.col("radius") <= VIEW.size / 16)
    return raster.tiles(p, VIEW.size).groupBy("tx", "ty").agg(F.count("*").alias("n"))


@query(PROJECTED_SQL + "SELECT id, scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY depth, id)::INT AS front, row_number() OVER (PARTITION BY scene_id ORDER BY depth DESC, id)::INT AS back FROM f")
def depth_rank(spark: SparkSession, d: str) -> DataFrame:
    p = ranks.rank_in(projected(spark, d).select("id", "scene_id", "depth"), ["scene_id"], [F.col("depth"), F.col("id")], "front")
    n = p.groupBy("scene_id").agg(F.count("*").alias("n"))
    # from the back: equal depths keep the order of ids, so their places within the run are turned
    runs = p.groupBy("scene_id", "depth").agg(F.min("front").alias("first"), F.max("front").alias("last"))
    j = p.join(n, "scene_id").join(runs, ["scene_id", "depth"])
    return j.select("id", "scene_id", F.col("front").cast("int").alias("front"), (F.col("n") - F.col("last") + 1 + F.col("front") - F.col("first")).cast("int").alias("back"))


@query(_FRAG + ", im AS (SELECT y, x, sum(t*a*r) r, sum(t*a*g) g, sum(t*a*b) b FROM tr WHERE t >= 1e-4 GROUP BY ALL), er AS (SELECT avg((power(r-floor(r*255)/255,2)+power(g-floor(g*255)/255,2)+power(b-floor(b*255)/255,2))/3) mse, avg((abs(r-floor(r*255)/255)+abs(g-floor(g*255)/255)+abs(b-floor(b*255)/255))/3) mae, count(*) pixels FROM im WHERE 0.2126*r+0.7152*g+0.0722*b > 0.02) SELECT round(mse,9) AS mse, round(mae,7) AS mae, round(-10*log10(mse),2) AS psnr, pixels FROM er")
def masked_image_metrics(spark: SparkSession, d: str) -> DataFrame:
    a = raster.composite(fragments(spark, d))
    b = a.select("y", "x", *[(F.floor(F.col(c) * 255) / 255).alias(c) for c in "rgb"])
    m = raster.image_metrics(a, b, S.luma(_cols("a_r", "a_g", "a_b")) > 0.02)
    return m.select(_r(F.col("mse"), 9).alias("mse"), _r(F.col("mae"), 7).alias("mae"), _r(F.col("psnr"), 2).alias("psnr"), "pixels")


# --- windows, sorts, samples


@query(_P + _MORTON + ", o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag f, morton, morton - lag(morton) OVER (PARTITION BY l_returnflag ORDER BY morton, l_orderkey, l_linenumber, l_partkey, l_suppkey) dl FROM m) SELECT f, count(*) AS n, sum(coalesce(dl, morton))::BIGINT AS back, max(coalesce(dl,0)) AS widest FROM o GROUP BY f")
def morton_delta(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("morton", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    m = with_morton(points(spark, d)).select("l_returnflag", "morton", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = ranks.difference_in(m, ["l_returnflag"], order, "morton", "dl")
    return o.groupBy(F.col("l_returnflag").alias("f")).agg(F.count("*").alias("n"), F.sum(F.coalesce("dl", "morton")).alias("back"), F.max(F.coalesce("dl", F.lit(0))).alias("widest"))


@query(_S + ", b AS (SELECT scene_id, least(255, greatest(0, floor((opacity+8)*16)))::INT bin, count(*) n FROM s GROUP BY ALL) SELECT scene_id, bin, n, sum(n) OVER (PARTITION BY scene_id ORDER BY bin)::BIGINT AS upto, round(sum(n) OVER (PARTITION BY scene_id ORDER BY bin)/sum(n) OVER (PARTITION BY scene_id),6) AS cdf FROM b")
def histogram_cdf(spark: SparkSession, d: str) -> DataFrame:
    b = whole_splats(spark, d).groupBy("scene_id", F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("opacity") + 8) * 16))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    w = W.partitionBy("scene_id")
    upto = F.sum("n").over(w.orderBy("bin"))
    return b.select("scene_id", "bin", "n", upto.alias("upto"), _r(upto / F.sum("n").over(w)).alias("cdf"))


@query(_S + "SELECT scene_id, id, rk::INT AS rk FROM (SELECT scene_id, id, row_number() OVER (PARTITION BY scene_id ORDER BY opacity DESC, id) rk FROM s) WHERE rk <= 10")
def top_opacity(spark: SparkSession, d: str) -> DataFrame:
    rk = F.row_number().over(W.partitionBy("scene_id").orderBy(F.desc("opacity"), "id"))
    return whole_splats(spark, d).withColumn("rk", rk).where("rk <= 10").select("scene_id", "id", "rk")


@query(_S + "SELECT scene_id, id FROM (SELECT scene_id, id, row_number() OVER (PARTITION BY scene_id ORDER BY ((id*2654435761) % 4294967296), id) rk FROM s) WHERE rk <= 20")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    rk = F.row_number().over(W.partitionBy("scene_id").orderBy((F.col("id") * 2654435761) % 4294967296, "id"))
    return whole_splats(spark, d).withColumn("rk", rk).where("rk <= 20").select("scene_id", "id")


_GRID = ", g AS (SELECT floor(x*7.999)::BIGINT i, floor(y*7.999)::BIGINT j, floor(z*7.999)::BIGINT k, count(*)/1000.0::DOUBLE v FROM p GROUP BY ALL)"


def density_grid(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy(*[F.floor(F.col(c) * 7.999).cast("bigint").alias(n) for c, n in zip("xyz", "ijk")]).agg((F.count("*") / 1000.0).alias("v"))


@query(_P + _GRID + " SELECT a.i, a.j, a.k, round(sum(a.v-b.v),6) AS tv FROM g a JOIN g b ON abs(a.i-b.i)+abs(a.j-b.j)+abs(a.k-b.k) = 1 GROUP BY ALL")
def tv_gradient(spark: SparkSession, d: str) -> DataFrame:
    return grids.total_variation_gradient(density_grid(spark, d)).select("i", "j", "k", _r(F.col("tv")).alias("tv"))


@query(_P + _GRID + " SELECT i, j, k, -1 AS fx, -1 AS fy, -1 AS fz, round(v,6) AS v FROM g WHERE v <= 0.1 UNION ALL SELECT i, j, k, a::INT, b::INT, c::INT, round(v,6) FROM g, range(2) ta(a), range(2) tb(b), range(2) tc(c) WHERE v > 0.1")
def octree_subdivide(spark: SparkSession, d: str) -> DataFrame:
    o = grids.subdivide(density_grid(spark, d), F.col("v") > 0.1)
    return o.select("i", "j", "k", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("fx", "fy", "fz")], _r(F.col("v")).alias("v"))


# --- patches on a timeline

_PATCH = "WITH pt AS (SELECT DISTINCT scene_id, phoxoid_id, 'opacity' attr, opacity::DOUBLE val, time_offset_ms, frame_no, rec_no FROM delta_feed WHERE dirty_mask & 8 <> 0 AND opacity IS NOT NULL UNION ALL SELECT DISTINCT scene_id, phoxoid_id, 'tier', tier::DOUBLE, time_offset_ms, frame_no, rec_no FROM delta_feed WHERE dirty_mask & 64 <> 0 AND tier IS NOT NULL)\n"
PATCH_KEYS, PATCH_ORDER = ["scene_id", "phoxoid_id"], ["time_offset_ms", "frame_no", "rec_no"]


def patch_rows(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "delta_feed")
    parts = [f.where((F.col("dirty_mask").bitwiseAND(m) != 0) & F.col(a).isNotNull()).select(*PATCH_KEYS, F.lit(a).alias("attr"), F.col(a).cast("double").alias("val"), *PATCH_ORDER) for a, m in (("opacity", 8), ("tier", 64))]
    return parts[0].unionByName(parts[1])


_LAST = "SELECT scene_id, phoxoid_id, attr, arg_max(val, time_offset_ms::HUGEINT*4611686018427387904+frame_no::HUGEINT*2147483648+rec_no) AS val FROM pt {w} GROUP BY ALL"


@query(_PATCH + _LAST.format(w=""))
def compose_patches(spark: SparkSession, d: str) -> DataFrame:
    return patches.compose(patch_rows(spark, d), PATCH_KEYS, PATCH_ORDER)


@query(_PATCH.rstrip() + ", l AS (" + _LAST.format(w="WHERE time_offset_ms <= 1000") + f"), {SPLATS_SQL} SELECT s.scene_id, s.id, round(coalesce((SELECT any_value(val) FROM l WHERE l.scene_id=s.scene_id AND l.phoxoid_id=s.id AND attr='opacity'), s.opacity),6) AS opacity, coalesce((SELECT any_value(val) FROM l WHERE l.scene_id=s.scene_id AND l.phoxoid_id=s.id AND attr='tier'), s.tier::DOUBLE) AS tier FROM s")
def state_at_time(spark: SparkSession, d: str) -> DataFrame:
    base = whole_splats(spark, d).select("scene_id", F.col("id").alias("phoxoid_id"), "opacity", F.col("tier").cast("double").alias("tier"))
    now = patches.as_of(patch_rows(spark, d), PATCH_KEYS, PATCH_ORDER, "time_offset_ms", 1000)
    return patches.overlay(base, now, PATCH_KEYS, ["opacity", "tier"]).select("scene_id", F.col("phoxoid_id").alias("id"), _r(F.col("opacity")).alias("opacity"), "tier")


@query("SELECT scene_id, frame_no, time_offset_ms, b AS before FROM (SELECT *, lag(time_offset_ms) OVER (PARTITION BY scene_id ORDER BY frame_no) b FROM (SELECT DISTINCT scene_id, frame_no, time_offset_ms FROM delta_feed)) WHERE time_offset_ms < b")
def backward_frames(spark: SparkSession, d: str) -> DataFrame:
    return patches.backward_steps(table(spark, d, "delta_feed"), "scene_id", "frame_no", "time_offset_ms")


_MIRROR = SPLATS_SQL.replace("FROM splats)", "FROM splats_mirror)").replace("v AS (", "v2 AS (", 1).split(",\ns AS")[0]


@query(_S + f", {_MIRROR}, o AS (SELECT v.id, v.tier a, v2.tier b, round(v.x,2) c, round(v2.x,2) e FROM v JOIN v2 USING (id)) SELECT id, 'tier' AS attr, coalesce(b::DOUBLE,-1.0) AS val FROM o WHERE a IS DISTINCT FROM b UNION ALL SELECT id, 'x', coalesce(e,-1.0) FROM o WHERE c IS DISTINCT FROM e")
def diff_to_patch(spark: SparkSession, d: str) -> DataFrame:
    old = valid_splats(spark, d).select("id", "tier", _r(F.col("x"), 2).alias("x"))
    m = table(spark, d, "splats_mirror").groupBy(F.col("splat_id").alias("id")).agg(F.max_by(F.struct("tier", "x"), "loaded_at").alias("v"))
    new = m.select("id", F.col("v.tier").cast("int").alias("tier"), _r(F.col("v.x").cast("double"), 2).alias("x"))
    p = patches.diff_to_patch(old, new, ["id"], ["tier", "x"])
    return p.select("id", "attr", F.coalesce("val", F.lit(-1.0)).alias("val"))


@query(_S + "SELECT id FROM s WHERE tier = 2 UNION SELECT id FROM s WHERE opacity < -3")
def floater_union(spark: SparkSession, d: str) -> DataFrame:
    s = whole_splats(spark, d)
    return s.where("tier = 2").select("id").union(s.where("opacity < -3").select("id")).distinct()


@query(_S + ", big AS (SELECT * FROM s WHERE greatest(sx,sy,sz) > -3) SELECT id, 0 AS part, round(x,6) AS x FROM s ANTI JOIN big USING (id) UNION ALL SELECT id, p::INT, round(x+(2*p-3)*exp(sx)*0.5,6) FROM big, range(1,3) t(p)")
def split_large(spark: SparkSession, d: str) -> DataFrame:
    s = whole_splats(spark, d).select("id", "x", "sx", F.greatest("sx", "sy", "sz").alias("m"))
    two = s.where("m > -3").withColumn("part", F.explode(F.array(F.lit(1), F.lit(2)))).select("id", "part", _r(F.col("x") + (2 * F.col("part") - 3) * F.exp("sx") * 0.5).alias("x"))
    return s.where("m <= -3").select("id", F.lit(0).alias("part"), _r(F.col("x")).alias("x")).unionByName(two)
