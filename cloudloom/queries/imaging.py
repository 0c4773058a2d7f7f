"""Queries over voxel grids, pictures and matches, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cloudloom.functions import quant as Q
from cloudloom.functions.geometry import disparity_schedule
from cloudloom.operators import density, matches, raster, volume
from cloudloom.plans.adapters import POINTS_SQL, points, whole_splats
from cloudloom.plans.session import table
from cloudloom.queries.fields import _SEEN, seen
from cloudloom.queries.projections import PROJECTED_SQL, VIEW, _r, projected, query
from cloudloom.queries.relational import _FRAG, fragments

QUERIES: dict = {}
ORACLE: dict = {}
query = query.into(QUERIES, ORACLE)
_P = f"WITH {POINTS_SQL}\n"

# --- voxel grids

RES, CELL, LOW, EYE, BG = 8, 0.125, (0.0, 0.0, 0.0), (0.5, 0.5, 3.0), (0.07, 0.07, 0.07)
_GRID = ", g AS (SELECT least(7,floor(x*8))::BIGINT i, least(7,floor(y*8))::BIGINT j, least(7,floor(z*8))::BIGINT k, count(*)/(SELECT count(*)/64.0::DOUBLE FROM p) v FROM p GROUP BY ALL), gc AS (SELECT i, j, k, v, i/8.0::DOUBLE r, j/8.0::DOUBLE g, k/8.0::DOUBLE b FROM g)\n"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Density of the order points over 8 x 8 x 8 cells, relative to an even cloud, coloured by place."""
    p = points(spark, d)
    n = p.agg((F.count("*") / 64.0).alias("n"))
    c = p.groupBy(*[F.least(F.lit(7), F.floor(F.col(a) * 8)).cast("bigint").alias(i) for a, i in zip("xyz", "ijk")]).agg(F.count("*").alias("m"))
    return c.crossJoin(n).select("i", "j", "k", (F.col("m") / F.col("n")).alias("v"), *[(F.col(i) / 8.0).alias(o) for i, o in zip("ijk", "rgb")])  # one row


_RAYS = f""", px AS (SELECT y, x, (x-7.5)/20.0 a, (7.5-y)/20.0 b FROM range(16) t(y), range(16) u(x)),
ry AS (SELECT y, x, a/sqrt(a*a+b*b+1) dx, b/sqrt(a*a+b*b+1) dy, -1.0/sqrt(a*a+b*b+1) dz FROM px),
rb AS (SELECT *, CASE WHEN abs(dx)<1e-12 THEN 1e-12 ELSE dx END ex, CASE WHEN abs(dy)<1e-12 THEN 1e-12 ELSE dy END ey FROM ry),
rt AS (SELECT *, greatest(0.0,least(-0.5/ex,0.5/ex),least(-0.5/ey,0.5/ey),least(-3.0/dz,-2.0/dz)) t0, least(greatest(-0.5/ex,0.5/ex),greatest(-0.5/ey,0.5/ey),greatest(-3.0/dz,-2.0/dz)) t1 FROM rb),
sm AS (SELECT y, x, s, (t1-t0)/12 dt, 0.5+(t0+(s+0.5)*((t1-t0)/12))*dx wx, 0.5+(t0+(s+0.5)*((t1-t0)/12))*dy wy, 3.0+(t0+(s+0.5)*((t1-t0)/12))*dz wz FROM rt, range(12) v(s) WHERE t1 > t0),
sg AS (SELECT *, wx/0.125-0.5 gx, wy/0.125-0.5 gy, wz/0.125-0.5 gz FROM sm),
co AS (SELECT y, x, s, dt, floor(gx)::BIGINT+a i, floor(gy)::BIGINT+b j, floor(gz)::BIGINT+c k, (CASE a WHEN 1 THEN gx-floor(gx) ELSE 1-(gx-floor(gx)) END)*(CASE b WHEN 1 THEN gy-floor(gy) ELSE 1-(gy-floor(gy)) END)*(CASE c WHEN 1 THEN gz-floor(gz) ELSE 1-(gz-floor(gz)) END) w FROM sg, range(2) ta(a), range(2) tb(b), range(2) tc(c) WHERE floor(gx) >= 0 AND floor(gx) < 7 AND floor(gy) >= 0 AND floor(gy) < 7 AND floor(gz) >= 0 AND floor(gz) < 7),
sv AS (SELECT y, x, s, dt, sum(w*v) v, sum(w*r) r, sum(w*g) g, sum(w*b) b FROM co JOIN gc USING (i, j, k) GROUP BY ALL),
so AS (SELECT *, v*dt od, exp(-coalesce(sum(v*dt) OVER (PARTITION BY y, x ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0.0)) t FROM sv WHERE v > 1e-7),
sa AS (SELECT *, 1-exp(-od) a FROM so WHERE t >= 1e-4),
pc AS (SELECT y, x, exp(-sum(od)) lt, sum(t*a*r) r, sum(t*a*g) g, sum(t*a*b) b FROM sa GROUP BY ALL),
im AS (SELECT ry.y, ry.x, coalesce(r,0.0)+coalesce(lt,1.0)*0.07 r, coalesce(g,0.0)+coalesce(lt,1.0)*0.07 g, coalesce(b,0.0)+coalesce(lt,1.0)*0.07 b FROM ry LEFT JOIN pc USING (y, x))
"""


def _rays(spark: SparkSession):
    rays = volume.camera_rays(spark, 16, 20.0, EYE)
    return rays, volume.samples(rays, 12, LOW, (1.0, 1.0, 1.0))


@query(_P + _GRID + _RAYS + "SELECT y::INT AS y, x::INT AS x, s::INT AS s, round(sqrt(v),6) AS root_v, round(sqrt(g*v),6) AS root_gv FROM sv")
def trilinear_samples(spark: SparkSession, d: str) -> DataFrame:
    """Roots of the sampled values: rays through the middle meet round numbers, whose last digits engines round either way."""
    v = volume.sampled(_rays(spark)[1], grid(spark, d), RES, LOW, CELL)
    return v.select("y", "x", "s", _r(F.sqrt("v")).alias("root_v"), _r(F.sqrt(F.col("g") * F.col("v"))).alias("root_gv"))


@query(_P + _GRID + _RAYS + "SELECT y::INT AS y, x::INT AS x, round(r,5) AS r, round(g,5) AS g, round(b,5) AS b FROM im")
def march_pixels(spark: SparkSession, d: str) -> DataFrame:
    """One camera through the grid: rays, samples, marching and background."""
    rays, at = _rays(spark)
    p = volume.pixels(rays, volume.march(volume.sampled(at, grid(spark, d), RES, LOW, CELL)), BG)
    return p.select("y", "x", *[_r(F.col(c), 5).alias(c) for c in "rgb"])


_GRAD = """, er AS (SELECT y, x, r-0.5 e_r, g-0.5 e_g, b-0.5 e_b FROM im),
ge AS (SELECT sa.*, r*e_r+g*e_g+b*e_b ce, 0.07*(e_r+e_g+e_b) eb FROM sa JOIN er USING (y, x)),
gb AS (SELECT y, x, s, dt*(t*(1-a)*ce-(coalesce(sum(t*a*ce) OVER (PARTITION BY y, x ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),0.0)+exp(-sum(od) OVER (PARTITION BY y, x))*eb)) dv FROM ge),
gr AS (SELECT i, j, k, sum(w*dv) grad FROM co JOIN gb USING (y, x, s) GROUP BY ALL)
"""


def _gradient(spark: SparkSession, d: str):
    rays, at = _rays(spark)
    g = grid(spark, d)
    m = volume.march(volume.sampled(at, g, RES, LOW, CELL))
    residual = volume.pixels(rays, m, BG).select("y", "x", *[(F.col(c) - 0.5).alias(f"e_{c}") for c in "rgb"])
    return g, volume.density_gradient(at, m, residual, BG, RES, LOW, CELL)


@query(_P + _GRID + _RAYS + _GRAD + "SELECT i, j, k, round(grad,6)+0.0 AS grad FROM gr")
def voxel_gradient(spark: SparkSession, d: str) -> DataFrame:
    """The adjoint: what each cell's density does to the error against a grey picture."""
    return _gradient(spark, d)[1].select("i", "j", "k", (_r(F.col("grad")) + 0.0).alias("grad"))


@query(_P + _GRID + _RAYS + _GRAD + "SELECT i, j, k, round(greatest(0.0,v-coalesce(5.0*grad/(sqrt(0.05*grad*grad)+1e-6),0.0)),3) AS v FROM gc LEFT JOIN gr USING (i, j, k)")
def voxel_step(spark: SparkSession, d: str) -> DataFrame:
    """One step of the fit."""
    g, grad = _gradient(spark, d)
    return volume.rms_step(g, grad, None)[0].select("i", "j", "k", _r(F.col("v"), 3).alias("v"))


@query()
def voxel_fit(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of the fit to the picture of the grid itself, from half its density: the squared error before and after."""
    rays, at = _rays(spark)
    g = grid(spark, d)
    target = volume.pixels(rays, volume.march(volume.sampled(at, g, RES, LOW, CELL)), BG)
    start = g.withColumn("v", F.col("v") * 0.5)
    out = None
    for n in (0, 2):
        now = volume.fit(rays, target, start, n, 12, RES, LOW, CELL, BG, rate=0.02)
        image = volume.pixels(rays, volume.march(volume.sampled(at, now, RES, LOW, CELL)), BG)
        m = raster.image_metrics(image, target).select(F.lit(n).alias("rounds"), _r(F.col("mse"), 6).alias("mse"))
        out = m if out is None else out.unionByName(m)
    return out


def _at(a: int, b: int, c: int) -> str:
    return f"coalesce(max(n.v) FILTER (n.i-g.i={a} AND n.j-g.j={b} AND n.k-g.k={c}),0.0)"


@query(_P + _GRID + f""", h AS (SELECT g.i, g.j, g.k, g.v, {_at(1,0,0)} xp, {_at(-1,0,0)} xm, {_at(0,1,0)} yp, {_at(0,-1,0)} ym, {_at(1,1,0)} pp, {_at(1,-1,0)} pm, {_at(-1,1,0)} mp, {_at(-1,-1,0)} mm FROM g LEFT JOIN g n ON abs(n.i-g.i) <= 1 AND abs(n.j-g.j) <= 1 AND abs(n.k-g.k) <= 1 GROUP BY ALL)
SELECT i, j, k, round(CASE WHEN i BETWEEN 1 AND 6 THEN (xp-xm)*4.0 ELSE 0.0 END,4)+0.0 AS gx, round(CASE WHEN i BETWEEN 1 AND 6 THEN (xp-2*v+xm)*64.0 ELSE 0.0 END,3)+0.0 AS xx, round(CASE WHEN j BETWEEN 1 AND 6 THEN (yp-2*v+ym)*64.0 ELSE 0.0 END,3)+0.0 AS yy, round(CASE WHEN i BETWEEN 1 AND 6 AND j BETWEEN 1 AND 6 THEN (pp-pm-mp+mm)*16.0 ELSE 0.0 END,3)+0.0 AS xy FROM h""")
def grid_differences(spark: SparkSession, d: str) -> DataFrame:
    h = volume.differences(grid(spark, d), RES, CELL)
    return h.select("i", "j", "k", (_r(F.col("gx"), 4) + 0.0).alias("gx"), *[(_r(F.col(c), 3) + 0.0).alias(c) for c in ("xx", "yy", "xy")])


@query(_P + _GRID + "SELECT i, j, k, (i+0.5)*0.125 AS x, round(1-exp(-v*0.21650635094610965),5) AS opacity FROM gc WHERE v > 0.1 ORDER BY v DESC, i, j, k LIMIT 100")
def grid_blobs(spark: SparkSession, d: str) -> DataFrame:
    return volume.grid_blobs(grid(spark, d), LOW, CELL, 0.1, 100).select("i", "j", "k", "x", _r(F.col("opacity"), 5).alias("opacity"))


@query(_P + _GRID + ", t AS (SELECT * FROM gc WHERE v > 0.1 ORDER BY v DESC, i, j, k LIMIT 100) SELECT i, j, k, true AS unit FROM t")
def aligned_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Blobs turned along the grid's second differences; each rotation is a unit quaternion."""
    b = volume.aligned_blobs(grid(spark, d), RES, LOW, CELL, 0.1, 100)
    q = [F.col(c) for c in ("qw", "qx", "qy", "qz")]
    return b.select("i", "j", "k", (F.abs(sum((c * c for c in q[1:]), q[0] * q[0]) - 1) < 1e-9).alias("unit"))


@query("""WITH i AS (SELECT s, 0.1+(2.5-0.1)*((s+0.5)/38) t FROM range(38) r(s)), o AS (SELECT 38+s s, 1/greatest(1/2.5+(1/20.0-1/2.5)*((s+0.5)/26),1e-6) t FROM range(26) r(s)), a AS (SELECT * FROM i UNION ALL SELECT * FROM o),
n AS (SELECT s, t, lead(t) OVER (ORDER BY s)-t dt FROM a) SELECT s::INT AS s, round(t,6) AS t, round(coalesce(dt, lag(dt) OVER (ORDER BY s)),6) AS dt FROM n""")
def sample_spacing(spark: SparkSession, d: str) -> DataFrame:
    """64 distances of a ray, even up to 2.5 and even in 1 / t beyond, and the way to the next; the last has that of the one before."""
    w = W.orderBy("s")  # 64 rows by construction
    t = spark.range(64).select(F.col("id").cast("int").alias("s"), disparity_schedule(F.col("id"), 64, 0.1, 20.0).alias("t"))
    t = t.withColumn("dt", F.lead("t").over(w) - F.col("t"))
    return t.select("s", _r(F.col("t")).alias("t"), _r(F.coalesce("dt", F.lag("dt").over(w))).alias("dt"))


@query(_SEEN + ", c AS (SELECT avg(ex) x, avg(ey) y, avg(ez) z FROM cam) SELECT round(any_value(c.x),6)+0.0 AS cx, round(any_value(c.y),6) AS cy, round(median(sqrt((ex-x)*(ex-x)+(ey-y)*(ey-y)+(ez-z)*(ez-z))),6) AS scale FROM cam, c")
def grid_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Centre and scale of a contracted grid: the cameras' mean and their median distance from it."""
    from cloudloom.operators import surfaces

    c = surfaces.orbit(spark, 8, 3.5, 1.2)
    m = c.agg(*[F.avg(f"e{a}").alias(a) for a in "xyz"])
    dist = F.sqrt((F.col("ex") - F.col("x")) ** 2 + (F.col("ey") - F.col("y")) ** 2 + (F.col("ez") - F.col("z")) ** 2)
    return c.crossJoin(m).agg((_r(F.first("x")) + 0.0).alias("cx"), _r(F.first("y")).alias("cy"), _r(F.percentile(dist, 0.5)).alias("scale"))  # one row


# --- pictures

_CLIP = ", ".join(f"greatest(0.0,least(1.0,dc_{c})) {c}" for c in "rgb")


def _colours(df: DataFrame) -> DataFrame:
    return df.withColumns({c: Q.clip(F.col(f"dc_{c}"), 0.0, 1.0) for c in "rgb"})


@query(_SEEN + f", q AS (SELECT greatest(0,least(47,trunc(py)))::INT y, greatest(0,least(63,trunc(px)))::INT x, {_CLIP} FROM sn WHERE cam = 0), t AS (SELECT y, x, sum(r) r, sum(g) g, sum(b) b FROM q GROUP BY ALL), m AS (SELECT greatest(1.0,max(r),max(g),max(b)) m FROM t) SELECT y, x, round(r/m,5) AS r, round(g/m,5) AS g, round(b/m,5) AS b FROM t, m")
def dot_image(spark: SparkSession, d: str) -> DataFrame:
    v = _colours(seen(spark, d).where("cam = 0")).withColumnsRenamed({"py": "y", "px": "x"})
    return raster.dots(v, 48, 64).select("y", "x", *[_r(F.col(c), 5).alias(c) for c in "rgb"])


@query(_SEEN + ", q AS (SELECT cam, id, trunc(py)::INT+a y, trunc(px)::INT+b x, zz FROM sn, range(-1,2) ta(a), range(-1,2) tb(b) WHERE cam < 4 AND px BETWEEN -5 AND 70 AND py BETWEEN -5 AND 55) SELECT cam::INT AS cam, y, x, arg_min(id, (zz, id)) AS id FROM q WHERE y BETWEEN 0 AND 47 AND x BETWEEN 0 AND 63 GROUP BY ALL")
def nearest_stamps(spark: SparkSession, d: str) -> DataFrame:
    """The splat that is seen in each pixel of four cameras."""
    out = None
    v = _colours(seen(spark, d)).where("px BETWEEN -5 AND 70 AND py BETWEEN -5 AND 55").select("cam", "id", F.col("py").cast("int").alias("y"), F.col("px").cast("int").alias("x"), F.col("z").alias("depth"), *"rgb")
    for cam in range(4):
        one = raster.nearest_wins(v.where(F.col("cam") == cam), 48, 64, 1).select(F.lit(cam).alias("cam"), "y", "x", "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(_SEEN + f""", o AS (SELECT * FROM (VALUES (0,-1,0),(1,0,-1),(2,0,0),(3,0,1),(4,1,0)) t(n,dy,dx)),
q AS (SELECT n, id, round_even(py,0)::INT+dy y, round_even(px,0)::INT+dx x, zz, 1/(1+exp(-opacity)) al, {_CLIP} FROM sn, o WHERE cam = 0 AND px BETWEEN 0 AND 63 AND py BETWEEN 0 AND 47),
u AS (SELECT y, x, n, arg_min({{'al':al,'r':r,'g':g,'b':b}}, (zz, id)) m FROM q WHERE y BETWEEN 0 AND 47 AND x BETWEEN 0 AND 63 GROUP BY ALL),
a AS (SELECT y, x, n, m.al*0.55 a, m.r r, m.g g, m.b b FROM u),
t AS (SELECT *, coalesce(product(1-a) OVER (PARTITION BY y, x ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),1.0) t FROM a)
SELECT y, x, round(sum(a*t*r)/greatest(sum(a*t),1e-6),4) AS r, round(sum(a*t),4) AS alpha FROM t GROUP BY ALL""")
def soft_dot_image(spark: SparkSession, d: str) -> DataFrame:
    v = _colours(seen(spark, d).where("cam = 0 AND px BETWEEN 0 AND 63 AND py BETWEEN 0 AND 47"))
    v = v.select("id", F.rint("py").cast("int").alias("y"), F.rint("px").cast("int").alias("x"), F.col("z").alias("depth"), Q.sigmoid(F.col("opacity")).alias("alpha"), *"rgb")
    return raster.soft_dots(v, 48, 64, 1).select("y", "x", _r(F.col("r"), 4).alias("r"), _r(F.col("alpha"), 4).alias("alpha"))


@query(_SEEN + f""", q AS (SELECT id, px, py, zz, least(50.0,greatest(0.5,60.0*0.05/zz)) rd, 1/(1+exp(-opacity)) al, {_CLIP} FROM sn WHERE cam = 0 AND px BETWEEN -60 AND 124 AND py BETWEEN -60 AND 108),
fy AS (SELECT *, unnest(range(greatest(0,trunc(py)::INT-ceil(rd)::INT), least(47,trunc(py)::INT+ceil(rd)::INT)+1)) y FROM q), fx AS (SELECT *, unnest(range(greatest(0,trunc(px)::INT-ceil(rd)::INT), least(63,trunc(px)::INT+ceil(rd)::INT)+1)) x FROM fy),
fa AS (SELECT y, x, id, zz, least(al*exp(-2.0*((x-px)*(x-px)+(y-py)*(y-py))/(rd*rd+1e-6)),0.999) a, r FROM fx),
ft AS (SELECT *, exp(coalesce(sum(ln(1-a)) OVER (PARTITION BY y, x ORDER BY zz, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0.0)) t FROM fa)
SELECT y::INT AS y, x::INT AS x, round(sum(t*a*r),4) AS r, round(sum(t*a),4) AS alpha FROM ft WHERE t >= 1e-4 GROUP BY ALL""")
def round_splat_image(spark: SparkSession, d: str) -> DataFrame:
    """Round splats of one size, front to back."""
    v = _colours(seen(spark, d).where("cam = 0 AND px BETWEEN -60 AND 124 AND py BETWEEN -60 AND 108"))
    v = v.select("id", "px", "py", F.col("z").alias("depth"), F.least(F.lit(50.0), F.greatest(F.lit(0.5), 60.0 * 0.05 / F.col("z"))).alias("radius"), Q.sigmoid(F.col("opacity")).alias("alpha"), *"rgb")
    return raster.composite(raster.round_fragments(v, 48, 64)).select("y", "x", _r(F.col("r"), 4).alias("r"), _r(F.col("alpha"), 4).alias("alpha"))


_LOOSE = _FRAG.replace("FROM f) WHERE radius <= 4.0)", "FROM f) WHERE radius BETWEEN 1.0 AND 64.0 AND radius <= 4.0)").replace("FROM fr WHERE a >= 1/255.0::DOUBLE)", "FROM fr WHERE a >= 1e-4*alpha AND a > 0)")


@query(_LOOSE + "SELECT y::INT AS y, x::INT AS x, round(sum(t*a*r),4) AS r, round(sum(t*a),4) AS alpha FROM tr WHERE t >= 1e-4 GROUP BY ALL")
def loose_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The renderer without tiles: other cut-offs (densities under 1e-4 are left out, radii between 1 and 64)."""
    p = projected(spark, d).where((F.col("radius") <= VIEW.size / 16) & F.col("radius").between(1.0, 64.0))
    p = _colours(p)
    f = raster.fragments(p.select("id", "depth", "px", "py", "radius", "alpha", "ca", "cb", "cc", "r", "g", "b"), VIEW.size, floor=1e-4)
    return raster.composite(f).select("y", "x", _r(F.col("r"), 4).alias("r"), _r(F.col("alpha"), 4).alias("alpha"))


_TIER = _FRAG.replace("greatest(0.0,least(1.0,dc_b)) b FROM", "greatest(0.0,least(1.0,dc_b)) b, tier, abs(dc_r)+abs(dc_g) kk FROM").replace("least(alpha*exp(greatest(-0.5*(ia*(x+0.5-px)*(x+0.5-px)+2*ib*(x+0.5-px)*(y+0.5-py)+ic*(y+0.5-py)*(y+0.5-py)),-20.0)),0.999) a FROM fy)", "least(alpha*CASE WHEN tier = 2 THEN exp(greatest(-0.5*m,-20.0)) ELSE exp(-least(0.5*m*(1+0.5*kk*m),20.0)) END,0.999) a FROM (SELECT *, ia*(x+0.5-px)*(x+0.5-px)+2*ib*(x+0.5-px)*(y+0.5-py)+ic*(y+0.5-py)*(y+0.5-py) m FROM fy))")


@query(_TIER + "SELECT y::INT AS y, x::INT AS x, round(sum(t*a*r),4) AS r, round(sum(t*a),4) AS alpha FROM tr WHERE t >= 1e-4 GROUP BY ALL")
def tier_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Compositing with a density of its own for each tier: Gaussians for tier 2, curved ones for the others."""
    p = _colours(projected(spark, d).where(F.col("radius") <= VIEW.size / 16))
    f = raster.fragments(p.select("id", "depth", "px", "py", "radius", "alpha", "ca", "cb", "cc", "r", "g", "b", "tier", "dc_r", "dc_g"), VIEW.size, density=raster.by_tier)
    return raster.composite(f).select("y", "x", _r(F.col("r"), 4).alias("r"), _r(F.col("alpha"), 4).alias("alpha"))


_IM = _FRAG + ", im AS (SELECT y, x, sum(t*a*r) r, sum(t*a*g) g, sum(t*a*b) b FROM tr WHERE t >= 1e-4 GROUP BY ALL)"


def _both(spark: SparkSession, d: str):
    a = raster.composite(fragments(spark, d))
    return a, a.select("y", "x", *[(F.floor(F.col(c) * 15) / 15).alias(c) for c in "rgb"])


@query(_IM + """, fl AS (SELECT y, x FROM range(64) t(y), range(64) u(x)), z AS (SELECT fl.y, fl.x, coalesce(0.2126*r+0.7152*g+0.0722*b,0.0) p, coalesce(0.2126*floor(r*15)/15+0.7152*floor(g*15)/15+0.0722*floor(b*15)/15,0.0) q FROM fl LEFT JOIN im USING (y, x)),
w1 AS (SELECT y, x, sum(p) OVER w p, sum(q) OVER w q, sum(p*p) OVER w pp, sum(q*q) OVER w qq, sum(p*q) OVER w pq FROM z WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
w2 AS (SELECT y, x, sum(p) OVER w/49 p, sum(q) OVER w/49 q, sum(pp) OVER w/49 pp, sum(qq) OVER w/49 qq, sum(pq) OVER w/49 pq FROM w1 WINDOW w AS (PARTITION BY x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
sm AS (SELECT (2*p*q+0.0001)*(2*(49/48.0::DOUBLE)*(pq-p*q)+0.0009)/((p*p+q*q+0.0001)*((49/48.0::DOUBLE)*(pp-p*p)+(49/48.0::DOUBLE)*(qq-q*q)+0.0009)) v FROM w2 WHERE y BETWEEN 3 AND 60 AND x BETWEEN 3 AND 60),
er AS (SELECT avg((power(r-floor(r*15)/15,2)+power(g-floor(g*15)/15,2)+power(b-floor(b*15)/15,2))/3) mse, count(*) n FROM im)
SELECT round(avg(v),6) AS ssim, count(*) AS windows, round(any_value(er.mse),8) AS mse, any_value(er.n) AS pixels FROM sm, er""")
def image_ssim(spark: SparkSession, d: str) -> DataFrame:
    """Structural similarity and mean squared error of a picture and its coarse copy."""
    a, b = _both(spark, d)
    s = raster.ssim(a, b, 64, 64).agg(_r(F.avg("ssim")).alias("ssim"), F.count("*").alias("windows"))
    return s.crossJoin(raster.image_metrics(a, b).select(_r(F.col("mse"), 8).alias("mse"), "pixels"))  # one row each


@query(_IM + ", ee AS (SELECT (r+g+b)/3 > 0.02 m, (power(r-floor(r*15)/15,2)+power(g-floor(g*15)/15,2)+power(b-floor(b*15)/15,2))/3 s FROM im) SELECT m AS in_mask, round(avg(s),8) AS mse, count(*) AS pixels FROM ee GROUP BY m")
def mean_mask_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Errors inside and outside the other mask, of the mean of the channels."""
    a, b = _both(spark, d)
    mean = (F.col("a_r") + F.col("a_g") + F.col("a_b")) / 3
    out = None
    for inside in (True, False):
        m = raster.image_metrics(a, b, (mean > 0.02) == inside).select(F.lit(inside).alias("in_mask"), _r(F.col("mse"), 8).alias("mse"), "pixels").where("pixels > 0")
        out = m if out is None else out.unionByName(m)
    return out


_PIC = "pic AS (SELECT y, x, 0.5+0.5*sin(y*0.4+x*0.25) v FROM range(48) t(y), range(64) u(x))"


def picture(spark: SparkSession) -> DataFrame:
    p = spark.range(48 * 64).select(F.floor(F.col("id") / 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"))
    return p.withColumn("v", 0.5 + 0.5 * F.sin(F.col("y") * 0.4 + F.col("x") * 0.25))


@query(f"""WITH {_PIC}, p AS (SELECT y, x, (x-31.5)/60 u, (y-23.5)/60 w FROM pic), s AS (SELECT y, x, u*(1+0.1*(u*u+w*w)+0.01*(u*u+w*w)*(u*u+w*w))*60+31.5 sx, w*(1+0.1*(u*u+w*w)+0.01*(u*u+w*w)*(u*u+w*w))*60+23.5 sy FROM p),
c AS (SELECT y, x, floor(sy)::INT+b iy, floor(sx)::INT+a ix, (CASE a WHEN 1 THEN sx-floor(sx) ELSE 1-(sx-floor(sx)) END)*(CASE b WHEN 1 THEN sy-floor(sy) ELSE 1-(sy-floor(sy)) END) f FROM s, range(2) ta(a), range(2) tb(b))
SELECT c.y::INT AS y, c.x::INT AS x, round(sum(f*coalesce(v,0.0)),5) AS v FROM c LEFT JOIN pic ON pic.y = iy AND pic.x = ix GROUP BY ALL""")
def undistorted(spark: SparkSession, d: str) -> DataFrame:
    return raster.undistorted(picture(spark), 48, 64, 60.0, 0.1, 0.01).select("y", "x", _r(F.col("v"), 5).alias("v"))


@query(_SEEN.replace("WITH ", f"WITH {_PIC}, ", 1) + ", r AS (SELECT id, v-greatest(0.0,least(1.0,dc_r)) e FROM sn JOIN pic ON pic.y = trunc(py)::INT AND pic.x = trunc(px)::INT WHERE px >= 0 AND px < 64 AND py >= 0 AND py < 48) SELECT id, count(*) AS seen, round(sum(e),4) AS correction, round(sum(abs(e)),4) AS size FROM r GROUP BY id")
def blob_residuals(spark: SparkSession, d: str) -> DataFrame:
    """What all cameras' pictures say about each splat: its residual at the pixel it falls on, summed."""
    v = seen(spark, d).where("px >= 0 AND px < 64 AND py >= 0 AND py < 48").select("id", "dc_r", F.col("py").cast("int").alias("y"), F.col("px").cast("int").alias("x"))
    e = v.join(picture(spark), ["y", "x"]).withColumn("e", F.col("v") - Q.clip(F.col("dc_r"), 0.0, 1.0))
    return e.groupBy("id").agg(F.count("*").alias("seen"), _r(F.sum("e"), 4).alias("correction"), _r(F.sum(F.abs("e")), 4).alias("size"))


@query(_SEEN.replace("WITH ", f"WITH {_PIC}, ", 1) + """, r AS (SELECT id, v-greatest(0.0,least(1.0,dc_r)) e FROM sn JOIN pic ON pic.y = trunc(py)::INT AND pic.x = trunc(px)::INT WHERE px >= 0 AND px < 64 AND py >= 0 AND py < 48),
st AS (SELECT id, 2*sum(abs(e))/2000 sg, 2*count(*) n FROM r GROUP BY id),
m AS (SELECT s.id, least(1/(1+exp(-opacity)),0.01) al, exp(greatest(sx,sy,sz)) sz0, coalesce(sg/n > 0.00005, false) up FROM s LEFT JOIN st USING (id) WHERE 1/(1+exp(-opacity)) > 0.005 AND exp(greatest(sx,sy,sz)) < 0.3),
w AS (SELECT *, CASE WHEN up AND sz0 > 0.01 THEN ['split','split'] WHEN up THEN ['kept','clone'] ELSE ['kept'] END k FROM m)
SELECT id, k[p+1] AS kind, p::INT AS part, round(al,6) AS alpha, round(CASE WHEN k[p+1] = 'split' THEN sz0/1.6 ELSE sz0 END,6) AS size FROM w, range(2) t(p) WHERE p < len(k)""")
def density_step(spark: SparkSession, d: str) -> DataFrame:
    """Density control at step 6000 after two rounds of accumulated residuals."""
    v = seen(spark, d).where("px >= 0 AND px < 64 AND py >= 0 AND py < 48").select("id", "dc_r", F.col("py").cast("int").alias("y"), F.col("px").cast("int").alias("x"))
    e = v.join(picture(spark), ["y", "x"]).withColumn("e", F.abs(F.col("v") - Q.clip(F.col("dc_r"), 0.0, 1.0)))
    signal = e.groupBy("id").agg((F.sum("e") / 2000).alias("signal"), F.count("*").alias("seen"))
    state = density.accumulated(density.accumulated(None, signal), signal)
    s = whole_splats(spark, d).select("id", Q.sigmoid(F.col("opacity")).alias("alpha"), F.exp(F.greatest("sx", "sy", "sz")).alias("size"))
    return density.controlled(s, state, 6000, 3.0).select("id", "kind", "part", _r(F.col("alpha")).alias("alpha"), _r(F.col("size")).alias("size"))


# --- matches

_DESC = "f AS (SELECT label cam, vec_id kpt, list_sum(list_transform(range(62), lambda i: CASE WHEN embedding[i+1] > 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT bits FROM embeddings)"


def features(spark: SparkSession, d: str) -> DataFrame:
    """(cam, kpt, bits): signs of embeddings stand for binary descriptors."""
    bits = F.lit(0).cast("bigint")
    for i in range(62):
        bits = bits.bitwiseOR(F.when(F.col("embedding")[i] > 0, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return table(spark, d, "embeddings").select(F.col("label").alias("cam"), F.col("vec_id").alias("kpt"), bits.alias("bits"))


_MATCH = f"WITH {_DESC}, pr AS (SELECT a.cam c0, b.cam c1, a.kpt k0, b.kpt k1, bit_count(xor(a.bits, b.bits)) dist FROM f a JOIN f b ON a.cam < b.cam AND b.cam <= a.cam + 2), rk AS (SELECT *, row_number() OVER (PARTITION BY c0, c1, k0 ORDER BY dist, k1) n FROM pr), tw AS (SELECT c0, c1, k0, max(k1) FILTER (n=1) k1, max(dist) FILTER (n=1) d1, max(dist) FILTER (n=2) d2 FROM rk WHERE n <= 2 GROUP BY ALL), mt AS (SELECT * FROM tw WHERE d2 IS NOT NULL AND d1 < 0.95*d2)\n"


@query(_MATCH + "SELECT c0, c1, k0, k1, d1::INT AS d1, d2::INT AS d2 FROM mt")
def feature_matches(spark: SparkSession, d: str) -> DataFrame:
    """The nearest descriptor of each feature in the next two cameras, where it is clearly nearer than the second."""
    return matches.ratio_matches(features(spark, d), 0.95, 2)


@query(_MATCH + ", e AS (SELECT c0, c1, count(*) inliers FROM mt GROUP BY ALL), o AS (SELECT * FROM e WHERE c0 % 2 = 0 OR c1 % 2 = 0) SELECT c0, c1, inliers, inliers = max(inliers) OVER () AS best FROM o")
def verified_edges(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cameras of which one is placed, their matches, and which has most."""
    e = feature_matches(spark, d).groupBy("c0", "c1").agg(F.count("*").alias("inliers"))
    placed = e.where("c0 % 2 = 0 OR c1 % 2 = 0")
    return placed.crossJoin(placed.agg(F.max("inliers").alias("m"))).select("c0", "c1", "inliers", (F.col("inliers") == F.col("m")).alias("best"))  # one row


@query(_MATCH + ", tr AS (SELECT cam, kpt, kpt // 3 point FROM f WHERE kpt % 3 = 0), h AS (SELECT mt.c1, mt.k1, tr.point, row_number() OVER (PARTITION BY mt.c1, tr.point ORDER BY d1, k1, k0) n FROM mt JOIN tr ON tr.cam = mt.c0 AND tr.kpt = mt.k0) SELECT c1, k1, point FROM h WHERE n = 1")
def track_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Known points that matches bring to a further camera, each once."""
    tracks = features(spark, d).where("kpt % 3 = 0").select("cam", "kpt", F.floor(F.col("kpt") / 3).alias("point"))
    return matches.tracked(feature_matches(spark, d), tracks)


@query()
def spanning_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree of most matches over the cameras."""
    e = feature_matches(spark, d).groupBy("c0", "c1").agg(F.count("*").alias("w"))
    return matches.spanning_tree(e.select(F.col("c0").alias("a"), F.col("c1").alias("b"), "w"))


@query(_SEEN + ", a AS (SELECT id FROM sn WHERE cam = 0 INTERSECT SELECT id FROM sn WHERE cam = 1) SELECT id, true AS found FROM a")
def triangulated(spark: SparkSession, d: str) -> DataFrame:
    """Points from two views by the linear method, compared with where they are; both views have them in front."""
    from cloudloom.operators import surfaces

    v = seen(spark, d).where("cam < 2").select("cam", "id", "px", "py")
    two = v.where("cam = 0").select("id", F.col("px").alias("u0"), F.col("py").alias("w0")).join(v.where("cam = 1").select("id", F.col("px").alias("u1"), F.col("py").alias("w1")), "id")
    cams = {r.cam: r for r in surfaces.orbit(spark, 8, 3.5, 1.2).where("cam < 2").collect()}  # two rows
    p = matches.triangulate(two, *[matches.projection(cams[c], 60.0, 32.0, 24.0) for c in (0, 1)])
    at = p.join(whole_splats(spark, d).select("id", *[F.col(c).alias(f"t{c}") for c in "xyz"]), "id")
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"t{c}")) for c in "xyz"])
    return at.select("id", (far < 1e-5 * (1 + F.greatest(*[F.abs(f"t{c}") for c in "xyz"]))).alias("found"))
