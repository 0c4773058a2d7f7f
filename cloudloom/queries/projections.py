"""Queries over stateless column expressions, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloudloom.functions import geometry as G, quant as Q, shading as S
from cloudloom.plans.barrier import settled
from cloudloom.plans.adapters import POINTS_SQL, SPLATS_SQL, points, valid_splats, whole_splats

QUERIES: dict = {}
ORACLE: dict = {}
_S = f"WITH {SPLATS_SQL}\n"
_P = f"WITH {POINTS_SQL}\n"


class _Register:
    """Registers a query under its name, with its SQL twin if there is one."""

    def __init__(self, queries: dict, oracle: dict):
        self.queries, self.oracle = queries, oracle

    def into(self, queries: dict, oracle: dict) -> _Register:
        return _Register(queries, oracle)

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return add


query = _Register(QUERIES, ORACLE)


def _r(c, n: int = 6):
    return F.round(c, n)


def _cols(*names: str):
    return [F.col(n) for n in names]


@query(_P + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(x*16777215,0)::INT AS qx, round_even(y*16777215,0)::INT AS qy, round_even(z*16777215,0)::INT AS qz FROM p")
def xyz_u24(spark: SparkSession, d: str) -> DataFrame:
    one, zero = F.lit(1.0), F.lit(0.0)
    return points(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[Q.u24_encode(F.col(c), zero, one).alias(f"q{c}") for c in "xyz"])


@query(_P + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"round(abs(round_even({c}*16777215,0)::INT/16777215.0 - {c}), 9) AS e{c}" for c in "xyz") + " FROM p")
def xyz_u24_error(spark: SparkSession, d: str) -> DataFrame:
    one, zero = F.lit(1.0), F.lit(0.0)
    back = {c: Q.u24_decode(Q.u24_encode(F.col(c), zero, one), zero, one) for c in "xyz"}
    return points(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[_r(F.abs(back[c] - F.col(c)), 9).alias(f"e{c}") for c in "xyz"])


@query(_S + "SELECT id, " + ", ".join(f"greatest(0, least(255, round_even(({c}*0.28209479177387814+0.5)*255.0,0)))::INT AS q_{c}" for c in ("dc_r", "dc_g", "dc_b")) + ", coalesce(round_even(1.0/(1.0+exp(-opacity))*255.0,0)::INT, -1) AS q_opacity FROM v")
def colour_u8(spark: SparkSession, d: str) -> DataFrame:
    return valid_splats(spark, d).select("id", *[Q.dc_encode(F.col(c)).alias(f"q_{c}") for c in ("dc_r", "dc_g", "dc_b")], F.coalesce(Q.opacity_encode(F.col("opacity")), F.lit(-1)).alias("q_opacity"))


@query(_S + ", n AS (SELECT id, qw::FLOAT a, qx::FLOAT b, qy::FLOAT c, qz::FLOAT d, sqrt((qw::FLOAT*qw::FLOAT+qx::FLOAT*qx::FLOAT+qy::FLOAT*qy::FLOAT+qz::FLOAT*qz::FLOAT)::DOUBLE)::FLOAT m FROM v)"
       "SELECT id, " + ", ".join(f"(CASE WHEN a < 0 THEN -1 ELSE 1 END * greatest(-32767, least(32767, round_even(((({c}/m)::FLOAT)*32767.0::FLOAT)::DOUBLE,0))))::INT AS q{i}" for i, c in enumerate("abcd")) + " FROM n")
def quat_i16(spark: SparkSession, d: str) -> DataFrame:
    return valid_splats(spark, d).select("id", *[c.alias(f"q{i}") for i, c in enumerate(Q.quat_encode(_cols("qw", "qx", "qy", "qz")))])


@query(_S + ", u AS (SELECT id, unnest(sh_rest)::DOUBLE c, unnest(range(45)) coef FROM v WHERE sh_rest IS NOT NULL) SELECT id, coef::INT AS coef, greatest(-128, least(127, round_even(c/0.006946287755891094,0)))::INT AS q FROM u")
def sh_q8(spark: SparkSession, d: str) -> DataFrame:
    q = valid_splats(spark, d).select("id", F.posexplode(Q.sh_q8_encode(F.col("sh_rest"))).alias("coef", "q"))
    return q.select("id", F.col("coef").cast("int").alias("coef"), "q")


@query()
def scale_f16(spark: SparkSession, d: str) -> DataFrame:
    half = Q.half_round_trip()
    return valid_splats(spark, d).select("id", *[half(F.col(c).cast("float")).alias(c) for c in ("sx", "sy", "sz")])


_OCT = """, n AS (SELECT id, x/(abs(x)+abs(y)+abs(z)) u, y/(abs(x)+abs(y)+abs(z)) w, z FROM s WHERE x*x+y*y+z*z > 0),
o AS (SELECT id, CASE WHEN z < 0 THEN (1-abs(w))*(CASE WHEN u >= 0 THEN 1.0 ELSE -1.0 END) ELSE u END u, CASE WHEN z < 0 THEN (1-abs(u))*(CASE WHEN w >= 0 THEN 1.0 ELSE -1.0 END) ELSE w END w FROM n),
q AS (SELECT id, round_even((u+1)/2*4095.0,0)::INT qx, round_even((w+1)/2*4095.0,0)::INT qy FROM o)
"""


@query(_S + _OCT + "SELECT id, qx, qy, qx | (qy << 12) AS packed, (qx & 255) AS b0, (((qy & 15) << 4) | (qx >> 8)) AS b1, (qy >> 4) AS b2 FROM q")
def normal_oct_pack(spark: SparkSession, d: str) -> DataFrame:
    u, w = Q.oct_encode(*_cols("x", "y", "z"))
    s = whole_splats(spark, d).where("x*x+y*y+z*z > 0").select("id", Q.oct_code(u).alias("qx"), Q.oct_code(w).alias("qy")).withColumn("packed", Q.pack_12_12(F.col("qx"), F.col("qy")))
    byte = [F.shiftright("packed", 8 * i).bitwiseAND(255).alias(f"b{i}") for i in range(3)]
    return s.select("id", "qx", "qy", "packed", *byte)


@query(_S + _OCT + """, e AS (SELECT id, qx/4095.0*2-1 u, qy/4095.0*2-1 w FROM q), f AS (SELECT id, u, w, 1-abs(u)-abs(w) z FROM e),
g AS (SELECT id, u - CASE WHEN u >= 0 THEN greatest(-z,0.0) ELSE -greatest(-z,0.0) END x, w - CASE WHEN w >= 0 THEN greatest(-z,0.0) ELSE -greatest(-z,0.0) END y, z FROM f)
SELECT id, round(x/sqrt(x*x+y*y+z*z),6) AS nx, round(y/sqrt(x*x+y*y+z*z),6) AS ny, round(z/sqrt(x*x+y*y+z*z),6) AS nz FROM g""")
def normal_oct_unpack(spark: SparkSession, d: str) -> DataFrame:
    qx, qy = Q.unpack_12_12(F.col("packed"))
    n = Q.oct_decode(qx / 4095.0 * 2 - 1, qy / 4095.0 * 2 - 1)
    return normal_oct_pack(spark, d).select("id", *[_r(c).alias(a) for c, a in zip(n, ("nx", "ny", "nz"))])


@query(_S + ", a AS (SELECT id, atan2(qz, qw) a FROM s) SELECT id, least(floor((a - floor(a/6.283185307179586)*6.283185307179586)/6.283185307179586*256.0 + 1e-9), 255)::INT AS b FROM a")
def tangent_byte(spark: SparkSession, d: str) -> DataFrame:
    return whole_splats(spark, d).select("id", Q.angle_byte(F.atan2("qz", "qw")).alias("b"))


@query(_S + "SELECT id, floor(greatest(0, least(255, abs(dc_r)/0.5*255.0)))::INT AS kappa_q, floor(greatest(0, least(255, abs(dc_g)*255.0)))::INT AS cusp_q FROM v")
def curvature_q8(spark: SparkSession, d: str) -> DataFrame:
    return valid_splats(spark, d).select("id", Q.kappa_q8(F.abs("dc_r")).alias("kappa_q"), Q.cusp_q8(F.abs("dc_g")).alias("cusp_q"))


@query(_S + ", b AS (SELECT id, greatest(0, least(255, round_even((log2(1024.0*greatest(exp(sx),exp(sy),exp(sz)))+8.0)*8.0,0)))::INT AS b FROM v) SELECT id, b, round(pow(2.0, b/8.0-8.0)/1024.0, 9) AS sigma FROM b")
def mip_zoom(spark: SparkSession, d: str) -> DataFrame:
    b = valid_splats(spark, d).select("id", Q.mip_zoom_byte(F.exp("sx"), F.exp("sy"), F.exp("sz")).alias("b"))
    return b.select("id", "b", _r(Q.mip_zoom_sigma(F.col("b")), 9).alias("sigma"))


@query(_S + "SELECT id, floor(greatest(0, least(255, sqrt(list_sum(list_transform(sh_rest, lambda c: c::DOUBLE*c::DOUBLE)))/(sqrt(dc_r*dc_r+dc_g*dc_g+dc_b*dc_b)+1e-3)/4.0*255.0)))::INT AS score FROM s")
def view_dependence(spark: SparkSession, d: str) -> DataFrame:
    return whole_splats(spark, d).select("id", Q.view_dependence(F.array("dc_r", "dc_g", "dc_b"), F.col("sh_rest")).alias("score"))


@query("WITH u AS (SELECT DISTINCT splat_id, unnest(residual)::INT r, unnest(range(45)) coef FROM residual_state) SELECT splat_id, coef::INT AS coef, r, xor(r << 1, r >> 15) & 65535 AS z, r AS back FROM u WHERE r >= 0 UNION ALL SELECT splat_id, coef::INT, r, (-2*r-1) & 65535, r FROM u WHERE r < 0")
def residual_zigzag(spark: SparkSession, d: str) -> DataFrame:
    r = spark.read.parquet(f"{d}/residual_state.parquet").select("splat_id", F.posexplode("residual").alias("coef", "r")).distinct()
    z = r.select("splat_id", F.col("coef").cast("int").alias("coef"), F.col("r").cast("int").alias("r"))
    z = z.withColumn("z", Q.zigzag(F.col("r")))
    return z.withColumn("back", Q.unzigzag(F.col("z")))


_SPREAD = "(({c}) & 1) | ((({c}) & 2) << 2) | ((({c}) & 4) << 4) | ((({c}) & 8) << 6) | ((({c}) & 16) << 8) | ((({c}) & 32) << 10) | ((({c}) & 64) << 12) | ((({c}) & 128) << 14) | ((({c}) & 256) << 16) | ((({c}) & 512) << 18)"
_MORTON = ", u AS (SELECT *, floor(x*1023.0)::BIGINT ux, floor(y*1023.0)::BIGINT uy, floor(z*1023.0)::BIGINT uz FROM p), m AS (SELECT *, (" + _SPREAD.format(c="ux") + ") | ((" + _SPREAD.format(c="uy") + ") << 1) | ((" + _SPREAD.format(c="uz") + ") << 2) AS morton FROM u)"


def with_morton(p: DataFrame) -> DataFrame:
    zero, one = F.lit(0.0), F.lit(1.0)
    return p.withColumn("morton", Q.morton3(*[Q.u10(F.col(c), zero, one) for c in "xyz"]))


@query(_P + _MORTON + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, morton FROM m")
def morton_code(spark: SparkSession, d: str) -> DataFrame:
    return with_morton(points(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "morton")


@query("WITH u AS (SELECT DISTINCT splat_id, unnest(residual)::INT r, unnest(range(45)) coef FROM residual_state WHERE residual IS NOT NULL), z AS (SELECT coef, CASE WHEN r >= 0 THEN 2*r ELSE -2*r-1 END z FROM u), b AS (SELECT coef, z, unnest(range(8)) plane FROM z) SELECT plane::INT AS plane, sum((z >> plane) & 1)::BIGINT AS ones, count(*) AS n FROM b GROUP BY ALL")
def bitplanes(spark: SparkSession, d: str) -> DataFrame:
    z = residual_zigzag(spark, d).agg(F.count("*").alias("n"), *[F.sum(Q.bit(F.col("z"), b)).alias(f"b{b}") for b in range(8)])
    planes = F.array(*[F.struct(F.lit(b).alias("plane"), F.col(f"b{b}").cast("bigint").alias("ones")) for b in range(8)])
    return z.select("n", F.explode(planes).alias("p")).select("p.plane", "p.ones", "n")


@query("WITH u AS (SELECT DISTINCT splat_id, unnest(residual)::INT r, unnest(range(45)) coef FROM residual_state) SELECT coef::INT AS coef, sum((r < 0)::INT)::BIGINT AS negative, sum((r = 0)::INT)::BIGINT AS zero, sum(abs(r))::BIGINT AS magnitude, max(abs(r)) AS largest FROM u GROUP BY ALL")
def sign_magnitude(spark: SparkSession, d: str) -> DataFrame:
    r = residual_zigzag(spark, d)
    return r.groupBy("coef").agg(F.count_if(F.col("r") < 0).alias("negative"), F.count_if(F.col("r") == 0).alias("zero"), F.sum(F.abs("r")).cast("bigint").alias("magnitude"), F.max(F.abs("r")).alias("largest"))


_ROT = """, q AS (SELECT *, qw/n w, qx/n i, qy/n j, qz/n k FROM (SELECT *, sqrt(qw*qw+qx*qx+qy*qy+qz*qz) n FROM s)),
r AS (SELECT *, 1-2*(j*j+k*k) r00, 2*(i*j-k*w) r01, 2*(i*k+j*w) r02, 2*(i*j+k*w) r10, 1-2*(i*i+k*k) r11, 2*(j*k-i*w) r12, 2*(i*k-j*w) r20, 2*(j*k+i*w) r21, 1-2*(i*i+j*j) r22, exp(2*sx) v0, exp(2*sy) v1, exp(2*sz) v2 FROM q),
c AS (SELECT *, """ + ", ".join(f"r{a}0*v0*r{b}0+r{a}1*v1*r{b}1+r{a}2*v2*r{b}2 AS c{n}" for n, a, b in (("xx", 0, 0), ("xy", 0, 1), ("xz", 0, 2), ("yy", 1, 1), ("yz", 1, 2), ("zz", 2, 2))) + " FROM r)\n"


@query(_S + _ROT + "SELECT id, " + ", ".join(f"round(r{i}{j},6) AS r{i}{j}" for i in range(3) for j in range(3)) + " FROM r")
def quat_rotation(spark: SparkSession, d: str) -> DataFrame:
    r = G.rotation(_cols("qw", "qx", "qy", "qz"))
    return whole_splats(spark, d).select("id", *[_r(r[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)])


@query(_S + ", q AS (SELECT *, sqrt(qw*qw+qx*qx+qy*qy+qz*qz) n FROM s) SELECT id, round(abs(qw)/n, 5) AS w, round(abs(qx)/n, 5) AS x, round(abs(qy)/n, 5) AS y, round(abs(qz)/n, 5) AS z FROM q")
def rotation_quat(spark: SparkSession, d: str) -> DataFrame:
    s = whole_splats(spark, d)
    r = G.rotation(_cols("qw", "qx", "qy", "qz"))
    s = s.select("id", *[r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)])
    q = G.quaternion([[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)])
    return s.select("id", *[_r(F.abs(c), 5).alias(n) for c, n in zip(q, "wxyz")])  # a quaternion and its negative are one rotation


@query(_S + _ROT + "SELECT id, " + ", ".join(f"round(c{n}, 9) AS {n}" for n in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM c")
def covariance_3d(spark: SparkSession, d: str) -> DataFrame:
    cov = G.covariance(_cols("sx", "sy", "sz"), _cols("qw", "qx", "qy", "qz"))
    return whole_splats(spark, d).select("id", *[_r(c, 9).alias(n) for n, c in cov.items()])


#: A fixed view of all scenes together, so that Spark and SQL need no scalar job.
VIEW = G.Camera.orbit((0.0, 0.0, 0.0), 4.0, size=64)


def _n(v: float) -> str:
    return f"({v!r}::DOUBLE)"


_CAM = ", k AS (SELECT *, " + ", ".join("(x-" + _n(VIEW.eye[0]) + f")*{_n(a[0])}+(y-" + _n(VIEW.eye[1]) + f")*{_n(a[1])}+(z-" + _n(VIEW.eye[2]) + f")*{_n(a[2])} AS c{i}" for i, a in enumerate(VIEW.axes)) + " FROM c),\n"
_CAM += f"d AS (SELECT *, -c2 AS depth, {_n(VIEW.focal)}*c0/(-c2)+32.0 px, -{_n(VIEW.focal)}*c1/(-c2)+32.0 py FROM k WHERE -c2 > 0.01),\n"
_SYM = {(a, b): "c" + "".join(sorted("xyz"[a] + "xyz"[b])) for a in range(3) for b in range(3)}


def _m(a: int, b: int) -> str:
    return "+".join(f"{_n(VIEW.axes[a][i])}*{_n(VIEW.axes[b][j])}*{_SYM[i, j]}" for i in range(3) for j in range(3))


_CAM += "w AS (SELECT *, " + ", ".join(f"{_m(a, b)} AS m{a}{b}" for a in range(3) for b in range(a, 3)) + f", -{_n(VIEW.focal)}/c2 j0, {_n(VIEW.focal)}*c0/(c2*c2) j1, {_n(VIEW.focal)}/c2 j2, -{_n(VIEW.focal)}*c1/(c2*c2) j3 FROM d),\n"
_CAM += "e AS (SELECT *, j0*j0*m00+2*j0*j1*m02+j1*j1*m22+0.1 ca, j0*j2*m01+j0*j3*m02+j1*j2*m12+j1*j3*m22 cb, j2*j2*m11+2*j2*j3*m12+j3*j3*m22+0.1 cc FROM w),\n"
_CAM += "f AS (SELECT *, 3.0*sqrt(0.5*(ca+cc+sqrt(greatest((ca+cc)*(ca+cc)-4*(ca*cc-cb*cb),0.0)))) radius, 1.0/(1.0+exp(-greatest(-100.0,least(opacity,100.0)))) alpha FROM e)\n"
PROJECTED_SQL = f"WITH {SPLATS_SQL}\n" + _ROT.rstrip() + _CAM


def projected(spark: SparkSession, d: str, view: G.Camera = VIEW, near: float = 0.01) -> DataFrame:
    """Splats on the screen: centre, covariance, radius, depth and opacity; culled by depth before anything dear is computed."""
    s = whole_splats(spark, d)
    c = view.to_camera(_cols("x", "y", "z"))
    s = s.select("*", *[v.alias(f"c{i}") for i, v in enumerate(c)]).where(-F.col("c2") > near)
    px, py, depth = view.pixel(_cols("c0", "c1", "c2"))
    s = s.select("*", *[v.alias(f"s{n}") for n, v in G.covariance(_cols("sx", "sy", "sz"), _cols("qw", "qx", "qy", "qz")).items()])
    s = s.select("*", *[v.alias(f"m{n}") for n, v in view.view_covariance({n: F.col(f"s{n}") for n in ("xx", "xy", "xz", "yy", "yz", "zz")}).items()])
    a, b, cc = view.screen_covariance(_cols("c0", "c1", "c2"), {n: F.col(f"m{n}") for n in ("00", "01", "02", "11", "12", "22")})
    s = s.select("id", "scene_id", "x", "y", "z", "dc_r", "dc_g", "dc_b", "sh_rest", "tier", px.alias("px"), py.alias("py"), depth.alias("depth"), a.alias("ca"), b.alias("cb"), cc.alias("cc"), Q.sigmoid(F.col("opacity")).alias("alpha"))
    return settled(s.withColumn("radius", G.radius_3sigma(F.col("ca"), F.col("cb"), F.col("cc"))))


@query(PROJECTED_SQL + "SELECT id, round(px,4) AS px, round(py,4) AS py, round(depth,5) AS depth, round(ca,4) AS ca, round(cb,4) AS cb, round(cc,4) AS cc, round(radius,4) AS radius FROM f WHERE radius <= 4.0")
def ewa_project(spark: SparkSession, d: str) -> DataFrame:
    p = projected(spark, d).where(F.col("radius") <= VIEW.size / 16)
    return p.select("id", *[_r(F.col(c), 5 if c == "depth" else 4).alias(c) for c in ("px", "py", "depth", "ca", "cb", "cc", "radius")])


_DIR = f", dd AS (SELECT *, x-{_n(VIEW.eye[0])} ex, y-{_n(VIEW.eye[1])} ey, z-{_n(VIEW.eye[2])} ez FROM s), ds AS (SELECT *, ex/sqrt(ex*ex+ey*ey+ez*ez) a, ey/sqrt(ex*ex+ey*ey+ez*ez) b, ez/sqrt(ex*ex+ey*ey+ez*ez) c FROM dd)\n"
_SH = [
    "-0.4886025119029199*b", "0.4886025119029199*c", "-0.4886025119029199*a", "1.0925484305920792*a*b", "-1.0925484305920792*b*c", "0.31539156525252*(3*c*c-1)", "-1.0925484305920792*a*c", "0.5462742152960395*(a*a-b*b)",
    "-0.5900435899266435*b*(3*a*a-b*b)", "2.890611442640554*a*b*c", "-0.4570457994644658*b*(5*c*c-1)", "0.3731763325901154*c*(5*c*c-3)", "-0.4570457994644658*a*(5*c*c-1)", "1.445305721320277*c*(a*a-b*b)", "-0.5900435899266435*a*(a*a-3*b*b)",
]


def _sh_sql(ch: int, dc: str) -> str:
    return f"greatest(0.0, least(1.0, {dc}+" + "+".join(f"sh_rest[{15 * ch + i + 1}]::DOUBLE*({b.replace('0.', '0.', 1)})::DOUBLE" for i, b in enumerate(_SH)) + "))"


@query(_S + _DIR + "SELECT id, " + ", ".join(f"round({_sh_sql(i, f'dc_{n}')}, 4) AS {n}" for i, n in enumerate("rgb")) + " FROM ds")
def sh_colour(spark: SparkSession, d: str) -> DataFrame:
    direction = G.unit([F.col(c) - e for c, e in zip("xyz", VIEW.eye)])
    rgb = S.sh_colour(_cols("dc_r", "dc_g", "dc_b"), F.col("sh_rest"), direction)
    return whole_splats(spark, d).select("id", *[_r(c, 4).alias(n) for c, n in zip(rgb, "rgb")])


@query("WITH d AS (SELECT i, 1-2*(i+0.5::DOUBLE)/12 y, i*2.399963229728653 a FROM range(12) t(i)) SELECT i, round(sqrt(1-y*y)*cos(a),6) AS x, round(y,6) AS y, round(sqrt(1-y*y)*sin(a),6) AS z FROM d")
def fibonacci_sphere(spark: SparkSession, d: str) -> DataFrame:
    v = S.fibonacci_direction(F.col("id").cast("double"), 12)
    return spark.range(12).select(F.col("id").alias("i"), *[_r(c).alias(n) for c, n in zip(v, "xyz")])


_GERM = ", g AS (SELECT id, dc_r k1, dc_g k2, dc_b ch, sx/10 om, sy/10 ze, least(1.0,greatest(-1.0,x)) s, least(1.0,greatest(-1.0,y)) t FROM s)\n"


def _germ(spark: SparkSession, d: str):
    hold = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col(c)))
    return whole_splats(spark, d).select("id", F.col("dc_r").alias("k1"), F.col("dc_g").alias("k2"), F.col("dc_b").alias("ch"), (F.col("sx") / 10).alias("om"), (F.col("sy") / 10).alias("ze"), hold("x").alias("s"), hold("y").alias("t"))


@query(_S + _GERM + """SELECT id, round(k1*s*s+k2*t*t+ch*(s*s*s-3*s*t*t)+om*(3*s*s*t-t*t*t)+ze*(s*s*s*s+t*t*t*t),8)+0.0 AS h,
round(2*k1*s+ch*(3*s*s-3*t*t)+6*om*s*t+4*ze*s*s*s,8)+0.0 AS hs, round(2*k2*t-6*ch*s*t+om*(3*s*s-3*t*t)+4*ze*t*t*t,8)+0.0 AS ht,
round(2*k1+6*ch*s+6*om*t+12*ze*s*s,8)+0.0 AS hss, round(-6*ch*t+6*om*s,8)+0.0 AS hst, round(2*k2-6*ch*s-6*om*t+12*ze*t*t,8)+0.0 AS htt FROM g""")
def germ_surface(spark: SparkSession, d: str) -> DataFrame:
    th, s, t = _cols("k1", "k2", "ch", "om", "ze"), F.col("s"), F.col("t")
    out = [S.germ_value(th, s, t), *S.germ_gradient(th, s, t), *S.germ_hessian(th, s, t)]
    return _germ(spark, d).select("id", *[(_r(c, 8) + 0.0).alias(n) for c, n in zip(out, ("h", "hs", "ht", "hss", "hst", "htt"))])


@query()
def germ_closest(spark: SparkSession, d: str) -> DataFrame:
    g = _germ(spark, d)
    s, t = S.closest_on_germ(_cols("k1", "k2", "ch", "om", "ze"), [F.lit(1.0), F.lit(1.0), F.lit(0.5)], [F.col("s") * 0.3, F.col("t") * 0.3, F.lit(0.01)])
    return g.select("id", _r(s, 4).alias("s"), _r(t, 4).alias("t"))


@query(_S + _GERM + ", m AS (SELECT *, s*s+t*t m, k1*s*s+k2*t*t+ch*(s*s*s-3*s*t*t)+om*(3*s*s*t-t*t*t)+ze*(s*s*s*s+t*t*t*t) h FROM g) SELECT id, round(exp(greatest(-0.5*m,-20.0)),6) AS gauss, round(exp(-least(0.5*m*(1+0.5*(abs(k1)+abs(k2))*m),20.0)),6) AS curved, round(exp(-0.5*least(m+h*h,40.0)),6) AS germ FROM m")
def densities(spark: SparkSession, d: str) -> DataFrame:
    g = _germ(spark, d).withColumn("m", F.col("s") * F.col("s") + F.col("t") * F.col("t"))
    h = S.germ_value(_cols("k1", "k2", "ch", "om", "ze"), F.col("s"), F.col("t"))
    return g.select("id", _r(S.gaussian_density(F.col("m"))).alias("gauss"), _r(S.curved_density(F.col("m"), F.col("k1"), F.col("k2"))).alias("curved"), _r(S.germ_density(F.col("m"), h)).alias("germ"))


@query(PROJECTED_SQL + "SELECT id, round(ca+0.09,4) AS ca, round(cc+0.09,4) AS cc, round(alpha*sqrt(greatest(ca*cc-cb*cb,1e-12)/greatest((ca+0.09)*(cc+0.09)-cb*cb,1e-12)),5) AS alpha FROM f WHERE radius <= 4.0")
def mip_filter(spark: SparkSession, d: str) -> DataFrame:
    a, _, c, alpha = S.mip_filter(*_cols("ca", "cb", "cc", "alpha"), 0.3)
    return projected(spark, d).where("radius <= 4.0").select("id", _r(a, 4).alias("ca"), _r(c, 4).alias("cc"), _r(alpha, 5).alias("alpha"))


def _band(at: int, n: int) -> str:
    return "sqrt(" + "+".join(f"sh_rest[{15 * c + at + i + 1}]::DOUBLE*sh_rest[{15 * c + at + i + 1}]::DOUBLE" for c in range(3) for i in range(n)) + ")"


_PBR = ", b AS (SELECT *, " + ", ".join(f"greatest(0.0,least(1.0,0.28209479177387814*dc_{n}+0.5)) a_{n}" for n in "rgb") + f", {_band(0, 3)} b1, {_band(3, 5)} b2, {_band(8, 7)} b3 FROM s),\n"
_PBR += """m AS (SELECT *, b1+b2+b3 bands, sqrt(a_r*a_r+a_g*a_g+a_b*a_b) bright FROM b),
mm AS (SELECT *, bands/(bright+1e-3)*(0.4+1.6*b3/greatest(bands,1e-6)) m, greatest(0.05,least(20.0,b1/greatest(b3,1e-6))) ratio FROM m),
pb AS (SELECT *, CASE WHEN bands < 0.02*bright THEN 0.05 ELSE least(1/(1+exp(-(m-0.6)/0.25)),0.95) END metallic, CASE WHEN bands < 0.02*bright THEN 0.9 ELSE greatest(0.05,least(0.95,0.5+0.2*ln(ratio))) END roughness FROM mm)
"""


def _pbr(spark: SparkSession, d: str) -> DataFrame:
    s = whole_splats(spark, d)
    albedo = [Q.clip(Q.SH_C0 * F.col(f"dc_{n}") + 0.5, 0.0, 1.0) for n in "rgb"]
    b = dict(zip(("b1", "b2", "b3"), S.band_norms(F.col("sh_rest"))))
    s = s.select("id", "x", "y", "z", "qw", "qx", "qy", "qz", *[c.alias(f"a_{n}") for c, n in zip(albedo, "rgb")], *[c.alias(n) for n, c in b.items()])
    return s.select("*", *[c.alias(n) for n, c in S.pbr_split(_cols("a_r", "a_g", "a_b"), *_cols("b1", "b2", "b3")).items()])


@query(_S + _PBR + "SELECT id, round(metallic,5) AS metallic, round(roughness,5) AS roughness, " + ", ".join(f"round(greatest(0.04+metallic*(a_{n}-0.04),0.02),5) AS f0_{n}" for n in "rgb") + " FROM pb")
def pbr_decompose(spark: SparkSession, d: str) -> DataFrame:
    return _pbr(spark, d).select("id", *[_r(F.col(c), 5).alias(c) for c in ("metallic", "roughness", "f0_r", "f0_g", "f0_b")])


_GGX = """, nn AS (SELECT *, 2*(qx*qz+qy*qw)/q2 n0, 2*(qy*qz-qx*qw)/q2 n1, 1-2*(qx*qx+qy*qy)/q2 n2 FROM (SELECT *, qw*qw+qx*qx+qy*qy+qz*qz q2 FROM pb)),
h AS (SELECT *, greatest(0.0,n1) nl, greatest(0.0,n2) nv, 0.7071067811865475 e FROM nn),
hh AS (SELECT *, greatest(0.0,(n1+n2)/(1.4142135623730951+1e-6)) nh, 1/(1.4142135623730951+1e-6) vh, roughness*roughness a2, (roughness+1)*(roughness+1)/8 k, greatest(0.04+metallic*(a_r-0.04),0.02) f0 FROM h)
SELECT id, round(CASE WHEN nl > 0 AND nv > 0 THEN a2/(3.141592653589793*(nh*nh*(a2-1)+1)*(nh*nh*(a2-1)+1)+1e-6)*(f0+(1-f0)*pow(1-vh,5))*(nv/(nv*(1-k)+k+1e-6))*(nl/(nl*(1-k)+k+1e-6))/(4*nl*nv+1e-6) ELSE 0.0 END,4) AS spec FROM hh"""


@query(_S + _PBR + _GGX)
def ggx_specular(spark: SparkSession, d: str) -> DataFrame:
    p = _pbr(spark, d)
    r = G.rotation(_cols("qw", "qx", "qy", "qz"))
    one, zero = F.lit(1.0), F.lit(0.0)
    spec = S.ggx([r[0][2], r[1][2], r[2][2]], [zero, zero, one], [zero, one, zero], F.col("roughness"), F.col("f0_r"))
    return p.select("id", _r(spec, 4).alias("spec"))


@query(_S + "SELECT id, round(greatest(0.0,least(1.0,c*(2.51*c+0.03)/(c*(2.43*c+0.59)+0.14))),6) AS aces, round(CASE WHEN u <= 0.0031308 THEN 12.92*u ELSE 1.055*pow(u,1/2.4::DOUBLE)-0.055 END,6) AS srgb, round(0.2126*abs(dc_r)+0.7152*abs(dc_g)+0.0722*abs(dc_b),12) AS luma FROM (SELECT *, abs(dc_r) c, least(1.0,abs(dc_r)) u FROM v)")
def tone_map(spark: SparkSession, d: str) -> DataFrame:
    c = F.abs("dc_r")
    return valid_splats(spark, d).select("id", _r(S.aces(c)).alias("aces"), _r(S.to_srgb(c)).alias("srgb"), _r(S.luma([F.abs(f"dc_{n}") for n in "rgb"]), 12).alias("luma"))


@query(_S + ", r AS (SELECT *, sqrt(x*x+y*y+z*z) r FROM s), k AS (SELECT *, CASE WHEN r > 1 THEN (2-1/r)/r ELSE 1.0 END k FROM r) SELECT id, round(x*k,6) AS cx, round(y*k,6) AS cy, round(z*k,6) AS cz, 0.0::DOUBLE AS back FROM k")
def contract_points(spark: SparkSession, d: str) -> DataFrame:
    s = whole_splats(spark, d)
    c = G.contract(_cols("x", "y", "z"))
    s = s.select("id", "x", "y", "z", *[v.alias(n) for v, n in zip(c, ("cx", "cy", "cz"))])
    b = G.uncontract(_cols("cx", "cy", "cz"))
    worst = F.greatest(*[F.abs(v - F.col(n)) for v, n in zip(b, "xyz")])
    return s.select("id", *[_r(F.col(n)).alias(n) for n in ("cx", "cy", "cz")], F.abs(_r(worst, 6)).alias("back"))


@query(_S + """, d AS (SELECT id, x/6 a, y/6 b, -1.0 c FROM s), e AS (SELECT id, CASE WHEN abs(a)<1e-12 THEN 1e-12 ELSE a END a, CASE WHEN abs(b)<1e-12 THEN 1e-12 ELSE b END b, c FROM d),
t AS (SELECT id, greatest(0.0,least(-1/a,1/a),least(-1/b,1/b),least((-1-3)/c,(1-3)/c)) t0, least(greatest(-1/a,1/a),greatest(-1/b,1/b),greatest((-1-3)/c,(1-3)/c)) t1 FROM e)
SELECT id, round(t0,5) AS t0, round(t1,5) AS t1, t0 <= t1 AS hit FROM t""")
def ray_box(spark: SparkSession, d: str) -> DataFrame:
    t0, t1 = G.ray_box([F.lit(0.0), F.lit(0.0), F.lit(3.0)], [F.col("x") / 6, F.col("y") / 6, F.lit(-1.0)], (-1.0,) * 3, (1.0,) * 3)
    return whole_splats(spark, d).select("id", _r(t0, 5).alias("t0"), _r(t1, 5).alias("t1"), (t0 <= t1).alias("hit"))


@query("WITH t AS (SELECT i, 1.0::DOUBLE/((1-(i+0.5::DOUBLE)/64)/0.1+((i+0.5::DOUBLE)/64)/20.0) t FROM range(64) r(i)), n AS (SELECT i, t, lead(t) OVER (ORDER BY i) - t dt FROM t) SELECT i, round(t,6) AS t, round(coalesce(dt, lag(dt) OVER (ORDER BY i)),6) AS dt FROM n")
def disparity_samples(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.orderBy("i")  # 64 rows by construction
    t = spark.range(64).select(F.col("id").alias("i"), G.disparity_t(F.col("id").cast("double"), 64, 0.1, 20.0).alias("t"))
    t = t.withColumn("dt", F.lead("t").over(w) - F.col("t"))
    return t.select("i", _r(F.col("t")).alias("t"), _r(F.coalesce("dt", F.lag("dt").over(w))).alias("dt"))


@query("WITH p AS (SELECT u.i, u.low, u.mx, b.v FROM (VALUES (0, 0.0, 1.0)) u(i, low, mx), (VALUES (0.25), (0.5)) b(v)) SELECT v::DOUBLE AS angle, round(cos(v),6) AS r00, round(-sin(v),6) AS r01, round(v,6) AS back FROM p")
def rotvec_round_trip(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([(0.25,), (0.5,)], "angle double")
    r = G.rotvec_matrix([F.lit(0.0), F.lit(0.0), F.col("angle")])
    return v.select("angle", _r(r[0][0]).alias("r00"), _r(r[0][1]).alias("r01"), _r(G.matrix_angle(r)).alias("back"))
