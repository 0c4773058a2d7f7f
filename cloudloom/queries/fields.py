"""Queries over made scenes, fits, filters, cameras and matches, with SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cloudloom.functions import geometry as G, quant as Q, shading as S
from cloudloom.operators import fits, patches, surfaces
from cloudloom.plans.adapters import POINTS_SQL, SPLATS_SQL, points, valid_splats, whole_splats
from cloudloom.plans.session import table
from cloudloom.queries.projections import _GERM, _germ, _cols, _n, _r, query

QUERIES: dict = {}
ORACLE: dict = {}
query = query.into(QUERIES, ORACLE)
_S = f"WITH {SPLATS_SQL}\n"
_P = f"WITH {POINTS_SQL}\n"
_UV = f"(i*{surfaces.U}::DOUBLE+0.5) - floor(i*{surfaces.U}::DOUBLE+0.5) u, (i*{surfaces.V}::DOUBLE+0.5) - floor(i*{surfaces.V}::DOUBLE+0.5) v"

# --- made scenes


@query(f"""WITH p AS (SELECT i, {_UV} FROM (SELECT i::DOUBLE i FROM range(500) t(i))), q AS (SELECT i, 2*u-1 s, 2*v-1 t, u, v FROM p)
SELECT scene, i::BIGINT AS id, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(z,6)+0.0 AS z FROM (
SELECT 'plane' scene, i, s x, t y, 0.0::DOUBLE z FROM q UNION ALL SELECT 'saddle', i, s, t, s*s-t*t FROM q
UNION ALL SELECT 'sphere', i, sqrt(1-(0.05+0.95*v)*(0.05+0.95*v))*cos(6.283185307179586*u), sqrt(1-(0.05+0.95*v)*(0.05+0.95*v))*sin(6.283185307179586*u), 0.05+0.95*v FROM q
UNION ALL SELECT 'fold', i, s, t*0.8, s*(s*s-3*(t*0.8)*(t*0.8))*0.2 FROM q UNION ALL SELECT 'cusp', i, s, t, s*(s*s-3*t*t)*0.25 FROM q
UNION ALL SELECT 'thin_sheet', i, s, t, CASE WHEN i::BIGINT % 2 = 0 THEN 0.02 ELSE -0.02 END FROM q)""")
def stress_scenes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("plane", "sphere", "saddle", "fold", "cusp", "thin_sheet"):
        one = surfaces.scene(spark, name, 500).select(F.lit(name).alias("scene"), "id", *[(_r(F.col(c)) + 0.0).alias(c) for c in "xyz"])
        out = one if out is None else out.unionByName(one)
    return out


_BOX = ", ".join(f"{v!r}" for v in (0.6, 0.4, 0.8))


@query(f"""WITH p AS (SELECT i, {_UV} FROM (SELECT i::DOUBLE i FROM range(200) t(i))),
g AS (SELECT i, 1-2*(i+0.5)/200 y, (i+0.5)*{math.pi * (1 + math.sqrt(5))!r}::DOUBLE a FROM p),
b AS (SELECT *, CASE WHEN u < 0.32/2.08 THEN 0 WHEN u < 0.64/2.08 THEN 1 WHEN u < 1.12/2.08 THEN 2 WHEN u < 1.6/2.08 THEN 3 WHEN u < 1.84/2.08 THEN 4 ELSE 5 END f FROM p),
c AS (SELECT *, (u - [0.0,0.32,0.64,1.12,1.6,1.84][f+1]/2.08)/([0.32,0.32,0.48,0.48,0.24,0.24][f+1]/2.08)-0.5 pp, v-0.5 qq, CASE WHEN f % 2 = 0 THEN 0.5 ELSE -0.5 END sg FROM b)
SELECT part, i::BIGINT AS id, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(z,6)+0.0 AS z FROM (
SELECT 'ball' part, i, sqrt(1-y*y)*cos(a)*0.5 x, y*0.5+0.5 y, sqrt(1-y*y)*sin(a)*0.5 z FROM g
UNION ALL SELECT 'ring', i, (0.4+0.1*cos(6.283185307179586*v))*cos(6.283185307179586*u)-1.2, 0.1*sin(6.283185307179586*v)+0.1, (0.4+0.1*cos(6.283185307179586*v))*sin(6.283185307179586*u) FROM p
UNION ALL SELECT 'floor', i, (u-0.5)*4.0, 0.0, (v-0.5)*4.0 FROM p
UNION ALL SELECT 'box', i, CASE f//2 WHEN 0 THEN sg*0.6 ELSE pp*0.6 END+1.2, CASE f//2 WHEN 0 THEN pp*0.4 WHEN 1 THEN sg*0.4 ELSE qq*0.4 END+0.2, CASE f//2 WHEN 2 THEN sg*0.8 ELSE qq*0.8 END FROM c)""")
def studio_scene(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.studio(spark).select("part", "id", *[(_r(F.col(c)) + 0.0).alias(c) for c in "xyz"])


@query()
def made_residuals(spark: SparkSession, d: str) -> DataFrame:
    s = surfaces.residual_state(spark, 2000)
    return s.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("sh_q8") != F.zip_with("approx", "residual", lambda a, b: a + b)).alias("broken"), F.min(F.array_min("residual")).alias("least"), F.max(F.array_max("residual")).alias("most"))


_ORBIT = """cm AS (SELECT k cam, sin(k*0.7853981633974483)*3.5 ex, 1.2::DOUBLE ey, cos(k*0.7853981633974483)*3.5 ez FROM range(8) t(k)),
cf AS (SELECT *, -ex/fl f0, -ey/fl f1, -ez/fl f2 FROM (SELECT *, sqrt(ex*ex+ey*ey+ez*ez) fl FROM cm)),
cw AS (SELECT *, -f2/sqrt(f0*f0+f2*f2) q0, f0/sqrt(f0*f0+f2*f2) q2 FROM cf),
cam AS (SELECT cam, ex, ey, ez, q0 r00, 0.0::DOUBLE r01, q2 r02, f1*q2 r10, f2*q0-f0*q2 r11, -f1*q0 r12, f0 r20, f1 r21, f2 r22 FROM cw)"""


@query(f"WITH {_ORBIT} SELECT cam::INT AS cam, round(ex,6) AS ex, round(ez,6) AS ez, " + ", ".join(f"round(r{i}{j},6)+0.0 AS r{i}{j}" for i in range(3) for j in range(3)) + " FROM cam")
def orbit_cameras(spark: SparkSession, d: str) -> DataFrame:
    c = surfaces.orbit(spark, 8, 3.5, 1.2)
    return c.select("cam", _r(F.col("ex")).alias("ex"), _r(F.col("ez")).alias("ez"), *[(_r(F.col(f"r{i}{j}")) + 0.0).alias(f"r{i}{j}") for i in range(3) for j in range(3)])


def seen(spark: SparkSession, d: str, n: int = 8) -> DataFrame:
    """Every camera's view of every whole splat: (cam, id, px, py, z) in a 64 x 48 picture; a row a camera, broadcast by its fixed size."""
    s = whole_splats(spark, d).select("id", "scene_id", "x", "y", "z", "dc_r", "dc_g", "dc_b", "opacity")
    c = surfaces.orbit(spark, n, 3.5, 1.2)
    j = s.crossJoin(F.broadcast(c))  # n cameras
    rel = [F.col(a) - F.col(f"e{a}") for a in "xyz"]
    v = [sum((F.col(f"r{i}{k}") * rel[k] for k in range(1, 3)), F.col(f"r{i}0") * rel[0]) for i in range(3)]
    j = j.select("cam", "id", "scene_id", "dc_r", "dc_g", "dc_b", "opacity", *[c.alias(f"c{i}") for i, c in enumerate(v)]).where("c2 > 0.05")
    return j.select("cam", "id", "scene_id", "dc_r", "dc_g", "dc_b", "opacity", (F.col("c0") / F.col("c2") * 60.0 + 32.0).alias("px"), (F.col("c1") / F.col("c2") * 60.0 + 24.0).alias("py"), F.col("c2").alias("z"))


_SEEN = f"{_S.rstrip()}, {_ORBIT}, cv AS (SELECT cam, id, scene_id, dc_r, dc_g, dc_b, opacity, " + ", ".join(f"r{i}0*(x-ex)+r{i}1*(y-ey)+r{i}2*(z-ez) c{i}" for i in range(3)) + " FROM s, cam),\nsn AS (SELECT *, c0/c2*60.0+32.0 px, c1/c2*60.0+24.0 py, c2 zz FROM cv WHERE c2 > 0.05)\n"


@query(_SEEN + "SELECT cam::INT AS cam, count(*) AS n, count(*) FILTER (px >= 0 AND px < 64 AND py >= 0 AND py < 48) AS inside, round(avg(zz),5) AS depth FROM sn GROUP BY cam")
def camera_views(spark: SparkSession, d: str) -> DataFrame:
    v = seen(spark, d)
    return v.groupBy("cam").agg(F.count("*").alias("n"), F.count_if((F.col("px") >= 0) & (F.col("px") < 64) & (F.col("py") >= 0) & (F.col("py") < 48)).alias("inside"), _r(F.avg("z"), 5).alias("depth"))


# --- fits


#: Spread along the principal axes of each group, by the roots of the cubic.
PCA_SQL = (
    _S + ", g AS (SELECT scene_id, tier, count(*) n, avg(x) mx, avg(y) my, avg(z) mz, covar_samp(x,x) a, covar_samp(x,y) b, covar_samp(x,z) c, covar_samp(y,y) d, covar_samp(y,z) e, covar_samp(z,z) f FROM s GROUP BY ALL HAVING count(*) >= 3), "
    "h AS (SELECT *, (a+d+f)/3 q FROM g), k AS (SELECT *, sqrt(((a-q)*(a-q)+(d-q)*(d-q)+(f-q)*(f-q)+2*(b*b+c*c+e*e))/6) p FROM h), "
    "l AS (SELECT *, greatest(-1.0,least(1.0,((a-q)*((d-q)*(f-q)-e*e)-b*(b*(f-q)-e*c)+c*(b*e-(d-q)*c))/(2*p*p*p))) r FROM k), m AS (SELECT *, q+2*p*cos(acos(r)/3) e0, q+2*p*cos(acos(r)/3+2.0943951023931953) e2 FROM l) "
    "SELECT scene_id, tier, n, i::INT AS axis, round(sqrt(greatest([e0, 3*q-e0-e2, e2][i+1],1e-8)),4) AS sigma FROM m, range(3) t(i)"
)


@query("SELECT scene_id, tier, true AS orthonormal, true AS eigen FROM (" + _S + " SELECT scene_id, tier FROM s GROUP BY ALL HAVING count(*) >= 3)")
def pca_axes(spark: SparkSession, d: str) -> DataFrame:
    """Axes of each group, checked: orthonormal, and C a = sigma^2 a along each."""
    m = fits.frames(fits.moments(whole_splats(spark, d), ["scene_id", "tier"])).where("n >= 3")
    c = [["c_xx", "c_xy", "c_xz"], ["c_xy", "c_yy", "c_yz"], ["c_xz", "c_yz", "c_zz"]]
    a = lambda i, k: F.col("axes")[3 * i + k]
    ortho = F.lit(True)
    for i in range(3):
        for j in range(i, 3):
            ortho &= F.abs(sum((a(i, k) * a(j, k) for k in range(1, 3)), a(i, 0) * a(j, 0)) - (1.0 if i == j else 0.0)) < 1e-9
    eigen = F.lit(True)
    for i in range(3):
        for r in range(3):
            got = sum((F.col(c[r][k]) * a(i, k) for k in range(1, 3)), F.col(c[r][0]) * a(i, 0))
            eigen &= F.abs(got - F.col("values")[i] * a(i, r)) < 1e-9 * F.greatest(F.lit(1.0), F.col("values")[0])
    return m.select("scene_id", "tier", ortho.alias("orthonormal"), eigen.alias("eigen"))


@query("SELECT scene_id, tier, true AS solved FROM (" + _S + " SELECT scene_id, tier FROM s GROUP BY ALL HAVING count(*) >= 12)")
def wide_fit(spark: SparkSession, d: str) -> DataFrame:
    """Nine-term fit of z over (x, y), checked by its normal equations: the residual is orthogonal to every term."""
    s = whole_splats(spark, d)
    eq = fits.normal_equations(s, ["scene_id", "tier"], S.wide_basis(F.col("x"), F.col("y")), F.col("z"))
    f = fits.solve(eq, ["scene_id", "tier"], 9).where("n >= 12").drop("n").join(eq, ["scene_id", "tier"])
    ok = F.lit(True)
    for i in range(9):
        left = F.col("theta")[i] * 1e-6
        for j in range(9):
            left = left + F.col(f"m_{min(i, j)}{max(i, j)}") * F.col("theta")[j]
        ok &= F.abs(left - F.col(f"v_{i}")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(F.col(f"v_{i}")), F.col(f"m_{i}{i}"))
    return f.select("scene_id", "tier", ok.alias("solved"))


@query(_S + _GERM + "SELECT id, round(1.0*0.1+s*k1+t*k2+s*s*ch+s*t*om+t*t*ze+(s*s*s-3*s*t*t)*0.2+(3*s*s*t-t*t*t)*0.3+(s*s*s*s+t*t*t*t)*0.4,4)+0.0 AS h FROM g")
def wide_surface(spark: SparkSession, d: str) -> DataFrame:
    th = [F.lit(0.1), *_cols("k1", "k2", "ch", "om", "ze"), F.lit(0.2), F.lit(0.3), F.lit(0.4)]
    return _germ(spark, d).select("id", (_r(G.dot(th, S.wide_basis(F.col("s"), F.col("t"))), 4) + 0.0).alias("h"))


@query(_S + ", p AS (SELECT scene_id, c, v FROM s UNPIVOT (v FOR c IN (x, y, z, opacity))) SELECT scene_id, c AS col, round(avg(v),5) AS mean, round(stddev_pop(v),5) AS std, round(min(v),5) AS low, round(max(v),5) AS high FROM p GROUP BY ALL")
def property_summary(spark: SparkSession, d: str) -> DataFrame:
    p = whole_splats(spark, d).select("scene_id", "x", "y", "z", "opacity").unpivot("scene_id", ["x", "y", "z", "opacity"], "col", "v")
    return p.groupBy("scene_id", "col").agg(_r(F.avg("v"), 5).alias("mean"), _r(F.stddev_pop("v"), 5).alias("std"), _r(F.min("v"), 5).alias("low"), _r(F.max("v"), 5).alias("high"))


@query()
def blob_fit(spark: SparkSession, d: str) -> DataFrame:
    """Flat and germ error of the points of the made saddle in 16 blobs, and over all."""
    return fits.blob_rmse(fits.blobs(surfaces.scene(spark, "saddle", 2000), 16)).select("label", "n", _r(F.col("flat"), 5).alias("flat"), _r(F.col("germ"), 5).alias("germ"))


@query()
def blob_budget(spark: SparkSession, d: str) -> DataFrame:
    """Least doubling budget of flat blobs that is as good as 16 germ blobs."""
    budget, flat, germ = fits.matching_budget(surfaces.scene(spark, "saddle", 2000), 16, 256)
    return spark.createDataFrame([(16, budget, round(flat, 5), round(germ, 5))], "germs int, flats int, flat double, germ double")


@query()
def blob_surface(spark: SparkSession, d: str) -> DataFrame:
    """64 points of each fitted germ surface."""
    return fits.blob_points(fits.blobs(surfaces.scene(spark, "saddle", 2000), 16)).select("label", "i", *[_r(F.col(c), 4).alias(c) for c in "xyz"])


@query()
def codebook_fit(spark: SparkSession, d: str) -> DataFrame:
    """Error of quantised coefficients by k-means codebooks, one for each third of the array."""
    s = whole_splats(spark, d).select("id", Q.sh_q8_encode(F.col("sh_rest"), 0.00731).alias("q"))
    return fits.codebook_error(s, 16)


# --- filters, lookups, sorts, sets


@query(_S + "SELECT id, CASE tier WHEN 2 THEN 'gauss' WHEN 1 THEN 'curved' ELSE 'germ' END AS route FROM s WHERE NOT (y BETWEEN -0.5 AND 0.5) AND 1.0/(1.0+exp(-opacity)) > 0.05 AND exp(greatest(sx,sy,sz)) < 0.5")
def routed(spark: SparkSession, d: str) -> DataFrame:
    """Band drop on y, pruning by opacity and size, and the way of each tier."""
    s = whole_splats(spark, d).where(~F.col("y").between(-0.5, 0.5) & (Q.sigmoid(F.col("opacity")) > 0.05) & (F.exp(F.greatest("sx", "sy", "sz")) < 0.5))
    return s.select("id", F.when(F.col("tier") == 2, "gauss").when(F.col("tier") == 1, "curved").otherwise("germ").alias("route"))


@query(f"WITH {_ORBIT}, c AS (SELECT avg(ex) x, avg(ey) y, avg(ez) z FROM cam), r AS (SELECT avg(sqrt((ex-x)*(ex-x)+(ey-y)*(ey-y)+(ez-z)*(ez-z))) r FROM cam, c), p AS (SELECT a.cam::INT a, b.cam::INT b, sqrt((a.ex-b.ex)*(a.ex-b.ex)+(a.ey-b.ey)*(a.ey-b.ey)+(a.ez-b.ez)*(a.ez-b.ez)) base FROM cam a JOIN cam b ON a.cam < b.cam) SELECT a, b, round(base,5) AS base FROM p, r WHERE base BETWEEN 0.1 AND 0.6*r*4 ORDER BY round(-abs(base-0.4*r),9) DESC, a, b LIMIT 8")
def stereo_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cameras gated by their distance, the best eight by score."""
    c = surfaces.orbit(spark, 8, 3.5, 1.2).select("cam", "ex", "ey", "ez")
    centre = c.agg(*[F.avg(f"e{a}").alias(f"m{a}") for a in "xyz"])
    r = c.crossJoin(centre).agg(F.avg(F.sqrt(sum(((F.col(f"e{a}") - F.col(f"m{a}")) * (F.col(f"e{a}") - F.col(f"m{a}")) for a in "yz"), (F.col("ex") - F.col("mx")) * (F.col("ex") - F.col("mx"))))).alias("r"))
    one, two = (c.select(*[F.col(k).alias(f"{k}{n}") for k in c.columns]) for n in "12")
    p = one.join(two, F.col("cam1") < F.col("cam2"))  # cameras, not points
    base = F.sqrt((F.col("ex1") - F.col("ex2")) ** 2 + (F.col("ey1") - F.col("ey2")) ** 2 + (F.col("ez1") - F.col("ez2")) ** 2)
    p = p.select(F.col("cam1").alias("a"), F.col("cam2").alias("b"), base.alias("base")).crossJoin(r)
    p = p.where(F.col("base").between(0.1, 1.0) | F.col("base").between(F.lit(0.1), F.col("r") * 2.4))
    return p.orderBy(F.desc(_r(-F.abs(F.col("base") - 0.4 * F.col("r")), 9)), "a", "b").limit(8).select("a", "b", _r(F.col("base"), 5).alias("base"))


@query("WITH m AS (SELECT * FROM (VALUES ('MED', 1.0), ('SMALL', 2.0), ('ECONOMY', 3.0), ('ECONOMY A', 4.0), ('STANDARD', 5.0)) t(prefix, k)), h AS (SELECT p_partkey, arg_max(k, length(prefix)) k FROM part JOIN m ON starts_with(upper(p_type), prefix) GROUP BY p_partkey) SELECT p_partkey, coalesce(k, 0.0)::DOUBLE AS k FROM part LEFT JOIN h USING (p_partkey)")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The value of the longest prefix that a model name starts with; 0 without any."""
    names = [("MED", 1.0), ("SMALL", 2.0), ("ECONOMY", 3.0), ("ECONOMY A", 4.0), ("STANDARD", 5.0)]
    best = F.lit(0.0)
    for prefix, k in sorted(names, key=lambda x: len(x[0])):
        best = F.when(F.upper("p_type").startswith(prefix), k).otherwise(best)
    return table(spark, d, "part").select("p_partkey", best.alias("k"))


@query(_S + ", b AS (SELECT scene_id, min(z) lo, max(z) hi FROM s GROUP BY scene_id) SELECT id, greatest(0,least(65535,floor((z-lo)/greatest(hi-lo,1e-9)*65535)))::INT AS code FROM s JOIN b USING (scene_id)")
def depth_codes(spark: SparkSession, d: str) -> DataFrame:
    """16-bit depth codes of a scene, the key of a counting sort."""
    s = whole_splats(spark, d).select("id", "scene_id", "z")
    b = s.groupBy("scene_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    code = F.floor((F.col("z") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * 65535)
    return s.join(b, "scene_id").select("id", F.greatest(F.lit(0), F.least(code, F.lit(65535))).cast("int").alias("code"))


@query(_S + ", r AS (SELECT id, scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY id)-1 i, count(*) OVER (PARTITION BY scene_id) n FROM s) SELECT id FROM r JOIN range(5) t(k) ON i = floor(k*(n-1)/4.0) GROUP BY id")
def evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    """Five rows a scene at even ranks."""
    w = W.partitionBy("scene_id")
    r = whole_splats(spark, d).select("id", (F.row_number().over(w.orderBy("id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    at = F.array(*[F.floor(F.lit(k) * (F.col("n") - 1) / 4.0) for k in range(5)])
    return r.where(F.array_contains(at, F.col("i").cast("bigint"))).select("id")


@query(_S + ", o AS (SELECT id, scene_id, tier, row_number() OVER (PARTITION BY scene_id ORDER BY tier, opacity DESC, id)-1 pos FROM s) SELECT id, pos::INT AS pos, coalesce(lag(id) OVER (PARTITION BY scene_id ORDER BY pos), -1) AS before FROM o")
def tier_order(spark: SparkSession, d: str) -> DataFrame:
    """Order by tier and opacity, and its inverse: the place of each id and the id before it."""
    w = W.partitionBy("scene_id").orderBy("tier", F.desc("opacity"), "id")
    return whole_splats(spark, d).select("id", (F.row_number().over(w) - 1).alias("pos"), F.coalesce(F.lag("id").over(w), F.lit(-1)).alias("before"))


@query(_S + ", big AS (SELECT * FROM s WHERE greatest(sx,sy,sz) > -3), small AS (SELECT * FROM s WHERE greatest(sx,sy,sz) <= -3 AND opacity > 0) SELECT id, 'kept' AS kind, round(sx,5) AS sx FROM s ANTI JOIN big USING (id) UNION ALL SELECT id, 'split', round(sx-ln(1.6),5) FROM big, range(2) UNION ALL SELECT id, 'clone', round(sx,5) FROM small")
def split_and_clone(spark: SparkSession, d: str) -> DataFrame:
    """Large splats give two daughters and go; small opaque ones get a clone."""
    s = whole_splats(spark, d).select("id", "sx", "opacity", F.greatest("sx", "sy", "sz").alias("m"))
    kept = s.where("m <= -3").select("id", F.lit("kept").alias("kind"), _r(F.col("sx"), 5).alias("sx"))
    two = s.where("m > -3").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("id", F.lit("split").alias("kind"), _r(F.col("sx") - F.log(F.lit(1.6)), 5).alias("sx"))
    return kept.unionByName(two).unionByName(s.where("m <= -3 AND opacity > 0").select("id", F.lit("clone").alias("kind"), _r(F.col("sx"), 5).alias("sx")))


@query(_S + ", n AS (SELECT id, x/l x, y/l y, z/l z FROM (SELECT *, sqrt(x*x+y*y+z*z) l FROM s) WHERE l > 1e-6), a AS (SELECT id, z, acos(greatest(-1.0,least(1.0,z)))/2 h, greatest(sqrt(y*y+x*x),1e-9) an, x, y FROM n) SELECT id, round(CASE WHEN abs(z-1)<1e-6 THEN 1.0 WHEN abs(z+1)<1e-6 THEN 0.0 ELSE cos(h) END,5) AS w, round(CASE WHEN abs(z-1)<1e-6 THEN 0.0 WHEN abs(z+1)<1e-6 THEN 1.0 ELSE -y/an*sin(h) END,5)+0.0 AS i, round(CASE WHEN abs(abs(z)-1)<1e-6 THEN 0.0 ELSE x/an*sin(h) END,5)+0.0 AS j FROM a")
def normal_quat(spark: SparkSession, d: str) -> DataFrame:
    s = whole_splats(spark, d).select("id", "x", "y", "z").where("sqrt(x*x+y*y+z*z) > 1e-6")
    n = s.select("id", *[c.alias(a) for c, a in zip(G.unit(_cols("x", "y", "z")), "xyz")])
    q = G.normal_quaternion(_cols("x", "y", "z"))
    return n.select("id", _r(q[0], 5).alias("w"), (_r(q[1], 5) + 0.0).alias("i"), (_r(q[2], 5) + 0.0).alias("j"))


@query(_S + ", b AS (SELECT scene_id, min(z) lo, max(z) hi FROM s GROUP BY scene_id), h AS (SELECT id, x, y, z, (z-lo)/(hi-lo+1e-9) h FROM s JOIN b USING (scene_id)) SELECT id, round(greatest(0.0,least(1.0,0.3+0.6*h)),5) AS r, round(greatest(0.0,least(1.0,0.5+0.3*(1-h))),5) AS g, round(greatest(0.0,least(1.0,0.6+0.4*h)),5) AS b, round(x-0.5*y,5)+0.0 AS u, round(-0.5*x-0.5*y-z,5)+0.0 AS v FROM h")
def height_and_iso(spark: SparkSession, d: str) -> DataFrame:
    """Colour by height and the isometric view."""
    s = whole_splats(spark, d).select("id", "scene_id", "x", "y", "z")
    j = s.join(s.groupBy("scene_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi")), "scene_id")
    u, v = G.orthographic(_cols("x", "y", "z"), "iso")
    return j.select("id", *[_r(c, 5).alias(n) for c, n in zip(S.height_colour(*_cols("z", "lo", "hi")), "rgb")], (_r(u, 5) + 0.0).alias("u"), (_r(v, 5) + 0.0).alias("v"))


@query(_S + _GERM + ", f AS (SELECT *, 1.5+abs(s) a, 0.3*s b, 1.0+abs(t) c, s*2 dx, t*2 dy FROM g), e AS (SELECT *, sqrt(greatest((a+c)*(a+c)-4*(a*c-b*b),0.0)) rt FROM f), l AS (SELECT *, 0.5*(a+c+rt) l1, 0.5*(a+c-rt) l2 FROM e), v AS (SELECT *, CASE WHEN abs(b)>1e-9 THEN l1-c WHEN a>=c THEN 1.0 ELSE 0.0 END vx, CASE WHEN abs(b)>1e-9 THEN b WHEN a>=c THEN 0.0 ELSE 1.0 END vy FROM l), w AS (SELECT *, (dx*vx+dy*vy)/(sqrt(vx*vx+vy*vy)+1e-12)/(sqrt(greatest(l1,1e-12))+1e-12) p, (dy*vx-dx*vy)/(sqrt(vx*vx+vy*vy)+1e-12)/(sqrt(greatest(l2,1e-12))+1e-12) q, greatest((c*dx*dx-2*b*dx*dy+a*dy*dy)/(a*c-b*b),0.0) m FROM v), x AS (SELECT *, k1*p*p+k2*q*q+ch*(p*p*p-3*p*q*q)+om*(3*p*p*q-q*q*q)+ze*(p*p*p*p+q*q*q*q) h FROM w) SELECT id, round(exp(-0.5*least(m+h*h,40.0)),5) AS density FROM x".replace(", v AS (SELECT *, CASE", ", vv AS (SELECT *, CASE").replace(" m FROM v)", " m FROM vv)"))
def eigenframe_density(spark: SparkSession, d: str) -> DataFrame:
    g = _germ(spark, d).select("id", "k1", "k2", "ch", "om", "ze", (1.5 + F.abs("s")).alias("a"), (0.3 * F.col("s")).alias("b"), (1.0 + F.abs("t")).alias("c"), (F.col("s") * 2).alias("dx"), (F.col("t") * 2).alias("dy"))
    return g.select("id", _r(S.eigenframe_density(*_cols("a", "b", "c", "dx", "dy"), _cols("k1", "k2", "ch", "om", "ze")), 5).alias("density"))


@query("SELECT event_id, round(CASE WHEN k % 3 = 0 AND k > 0 THEN k*64/36.0 ELSE 32/0.57735026918962584 END,5) AS focal FROM (SELECT event_id, (props->>'k')::INT k FROM events WHERE props->>'k' IS NOT NULL)")
def focal_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Focal length in pixels: from the 35 mm equivalent where the record has one (every third), else from a field of view of 60 degrees."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select("event_id", k.alias("k")).where("k IS NOT NULL")
    return e.select("event_id", _r(G.focal_pixels(F.when(F.col("k") % 3 == 0, F.col("k").cast("double")), 64, 60.0), 5).alias("focal"))


# --- photographs


def photos(spark: SparkSession, d: str) -> DataFrame:
    """(photo, px, v): order lines stand for pixels, their ship month for the photograph."""
    return table(spark, d, "lineitem").select(F.month("l_shipdate").alias("photo"), F.col("l_orderkey").alias("px"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), (F.col("l_quantity") / 51 * (1 + 0.02 * F.month("l_shipdate"))).alias("v"))


_PH = "WITH ph AS (SELECT month(l_shipdate) photo, l_orderkey px, l_linenumber line, l_partkey part, l_suppkey supp, l_quantity/51*(1+0.02*month(l_shipdate)) v FROM lineitem)"


@query(_PH + ", m AS (SELECT photo, avg(v) m FROM ph GROUP BY photo), g AS (SELECT avg(m) g FROM m) SELECT photo::INT AS photo, px, line, part, supp, round(least(1.0,greatest(0.0,v*g/greatest(m,1e-6))),5) AS by_mean, round(pow(least(1.0,greatest(v,1e-6)),ln(least(0.99,greatest(g,0.01)))/ln(least(0.99,greatest(m,0.01)))),5) AS by_gamma FROM ph JOIN m USING (photo), g")
def exposure(spark: SparkSession, d: str) -> DataFrame:
    """Photographs brought to a common brightness, by factor and by gamma."""
    p = photos(spark, d)
    m = p.groupBy("photo").agg(F.avg("v").alias("m"))
    j = p.join(m, "photo").crossJoin(m.agg(F.avg("m").alias("g")))  # one row
    hold = lambda c: F.least(F.lit(0.99), F.greatest(c, F.lit(0.01)))
    by_gamma = F.pow(F.least(F.lit(1.0), F.greatest("v", F.lit(1e-6))), F.log(hold(F.col("g"))) / F.log(hold(F.col("m"))))
    return j.select("photo", "px", "line", "part", "supp", _r(Q.clip(F.col("v") * F.col("g") / F.greatest("m", F.lit(1e-6)), 0.0, 1.0), 5).alias("by_mean"), _r(by_gamma, 5).alias("by_gamma"))


@query(_PH + ", b AS (SELECT photo, greatest(0,least(63,floor(v*64)))::INT bin, count(*) n FROM ph GROUP BY ALL), k AS (SELECT p.photo, t.bin FROM (SELECT DISTINCT photo FROM b) p, range(64) t(bin)), f AS (SELECT k.photo, k.bin, coalesce(n,0) n FROM k LEFT JOIN b USING (photo, bin)), c AS (SELECT photo, bin, sum(n) OVER (PARTITION BY photo ORDER BY bin)/sum(n) OVER (PARTITION BY photo) cdf FROM f) SELECT s.photo::INT AS photo, s.bin::INT AS bin, arg_min(r.bin, (round(abs(s.cdf-r.cdf),9), r.bin))::INT AS lut FROM c s JOIN c r ON r.photo = 1 GROUP BY ALL")
def histogram_match(spark: SparkSession, d: str) -> DataFrame:
    """For each bin of each photograph the bin of photograph 1 with the nearest cumulative share, the first of equals."""
    b = photos(spark, d).groupBy("photo", F.greatest(F.lit(0), F.least(F.lit(63), F.floor(F.col("v") * 64))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = b.select("photo").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(63))))
    f = every.join(b, ["photo", "bin"], "left").na.fill(0, ["n"])
    w = W.partitionBy("photo")
    c = f.select("photo", "bin", (F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)).alias("cdf"))
    ref = c.where("photo = 1").agg(F.array_sort(F.collect_list(F.struct("bin", "cdf"))).alias("ref"))  # 64 bins
    best = F.array_min(F.transform("ref", lambda r: F.struct(_r(F.abs(F.col("cdf") - r["cdf"]), 9).alias("gap"), r["bin"].alias("bin"))))
    return c.crossJoin(ref).select("photo", "bin", best["bin"].alias("lut"))


# --- timelines


@query("WITH g AS (SELECT scene_id, base_crc, base_n FROM phox_seq), b AS (SELECT scene_id, count(DISTINCT splat_id) n FROM splats GROUP BY scene_id) SELECT g.scene_id, coalesce(n, 0) AS have, base_n AS claimed, coalesce(n, 0) = base_n AS fits FROM g LEFT JOIN b USING (scene_id)")
def base_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether each timeline's claim of its base's size fits the base at hand."""
    claims = table(spark, d, "phox_seq").select("scene_id", F.col("base_n").alias("claimed"))
    base = table(spark, d, "splats").groupBy("scene_id").agg(F.countDistinct("splat_id").alias("n"))
    return patches.base_guard(claims, base, "scene_id")


@query("WITH f AS (SELECT scene_id, frame_no, phoxoid_id, arg_max(opacity, rec_no) opacity FROM (SELECT DISTINCT scene_id, frame_no, phoxoid_id, rec_no, opacity FROM delta_feed WHERE dirty_mask & 8 <> 0 AND opacity IS NOT NULL) GROUP BY ALL), m AS (SELECT scene_id, min(frame_no) frame_no FROM f GROUP BY scene_id) SELECT f.scene_id, f.frame_no, f.phoxoid_id, round(f.opacity::DOUBLE,6) AS opacity FROM f JOIN m USING (scene_id, frame_no)")
def single_frame(spark: SparkSession, d: str) -> DataFrame:
    """The changes of one frame alone: the first that sets opacities, of each scene."""
    f = table(spark, d, "delta_feed").where((F.col("dirty_mask").bitwiseAND(8) != 0) & F.col("opacity").isNotNull())
    first = f.groupBy("scene_id").agg(F.min("frame_no").alias("frame_no"))
    one = f.join(first, ["scene_id", "frame_no"]).select("scene_id", "frame_no", "phoxoid_id", F.lit("opacity").alias("attr"), F.col("opacity").cast("double").alias("val"), "rec_no")
    c = patches.compose(one, ["scene_id", "frame_no", "phoxoid_id"], ["rec_no"])
    return c.select("scene_id", "frame_no", "phoxoid_id", _r(F.col("val")).alias("opacity"))


@query("SELECT scene_id, arrived AS frame_no, t AS time_offset_ms, b AS before FROM (SELECT *, lag(t) OVER (PARTITION BY scene_id ORDER BY arrived) b FROM (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY arrived_at, change_id) arrived, time_offset_ms t FROM (SELECT DISTINCT scene_id, arrived_at, change_id, time_offset_ms FROM delta_feed))) WHERE t < b")
def late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The order guard on the order of arrival, which does go back."""
    f = table(spark, d, "delta_feed").select("scene_id", "arrived_at", "change_id", "time_offset_ms").distinct()
    n = F.row_number().over(W.partitionBy("scene_id").orderBy("arrived_at", "change_id")).cast("bigint")
    return patches.backward_steps(f.select("scene_id", n.alias("frame_no"), "time_offset_ms"), "scene_id", "frame_no", "time_offset_ms")
