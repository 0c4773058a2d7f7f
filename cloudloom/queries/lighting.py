"""Queries over lights, environments and grading, with SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloudloom.functions import geometry as G, quant as Q, shading as S
from cloudloom.operators import light
from cloudloom.plans.barrier import settled
from cloudloom.plans.adapters import SPLATS_SQL, valid_splats, whole_splats
from cloudloom.queries.projections import _PBR, VIEW, _cols, _n, _pbr, _r, query
from cloudloom.queries.neighbourhoods import _LIT, occlusion

QUERIES: dict = {}
ORACLE: dict = {}
query = query.into(QUERIES, ORACLE)
_S = f"WITH {SPLATS_SQL}\n"

#: A fixed sun for all queries: where its light goes, and its colour.
SUN = tuple(c / math.sqrt(0.3**2 + 1.0 + 0.2**2) for c in (0.3, -1.0, 0.2))
SUN_RGB = (1.2, 1.1, 0.9)
ENV = S.Environment(SUN)

_LN = """, nn AS (SELECT *, 2*(qx*qz+qy*qw)/q2 n0, 2*(qy*qz-qx*qw)/q2 n1, 1-2*(qx*qx+qy*qy)/q2 n2 FROM (SELECT *, qw*qw+qx*qx+qy*qy+qz*qz q2 FROM pb)),
""" + f"""vd AS (SELECT *, ({_n(VIEW.eye[0])}-x)/vl v0, ({_n(VIEW.eye[1])}-y)/vl v1, ({_n(VIEW.eye[2])}-z)/vl v2, greatest(0.0,-(n0*{_n(SUN[0])}+n1*{_n(SUN[1])}+n2*{_n(SUN[2])})) nl FROM (SELECT *, sqrt(({_n(VIEW.eye[0])}-x)*({_n(VIEW.eye[0])}-x)+({_n(VIEW.eye[1])}-y)*({_n(VIEW.eye[1])}-y)+({_n(VIEW.eye[2])}-z)*({_n(VIEW.eye[2])}-z))+1e-9 vl FROM nn)),
nv AS (SELECT *, greatest(0.0,n0*v0+n1*v1+n2*v2) nv, 1/(1+exp(-opacity)) ao FROM vd)
"""
_NORMAL = _S + _PBR + _LN


def _env_sql(src: str, out: str, d: tuple[str, str, str], env: S.Environment = ENV) -> str:
    """A CTE ``out`` of ``src`` with the environment's er, eg, eb along d."""
    x, y, z = d
    sun = env.sun
    t = f""", {out}1 AS (SELECT *, ({x})/dn_ dx_, ({y})/dn_ dy_, ({z})/dn_ dz_ FROM (SELECT *, sqrt(({x})*({x})+({y})*({y})+({z})*({z}))+1e-9 dn_ FROM {src})),
{out}2 AS (SELECT *, greatest(-1.0,least(1.0,dy_)) up_, greatest(-1.0,least(1.0,-(dx_*{_n(sun[0])}+dy_*{_n(sun[1])}+dz_*{_n(sun[2])}))) cs_, CASE WHEN dy_ < 0 THEN -1.0/dy_ END dw_ FROM {out}1),
{out}3 AS (SELECT *, pow(greatest(cs_,0.0),{env.sharp})*0.45+CASE WHEN cs_ > {env.disc} THEN 4.0 ELSE 0.0 END gl_, 0.5*(1-abs(up_)/{env.haze}) bd_, (floor(dx_*dw_*1.7)+floor(dz_*dw_*1.7)) - 2*floor((floor(dx_*dw_*1.7)+floor(dz_*dw_*1.7))/2) ch_, exp(-0.08*dw_*sqrt(dx_*dx_+dy_*dy_+dz_*dz_)) nr_ FROM {out}2)
"""
    chans = []
    for c, s, tz, h, a, b in zip("rgb", env.sun_rgb, env.zenith, env.horizon, env.dark, env.light):
        sky = f"(CASE WHEN up_ > 0 THEN sqrt(greatest(up_,0.0))*{tz}+greatest(0.0,1-up_)*{h}+gl_*{s} ELSE 0.0 END)"
        chans.append(f"CASE WHEN up_ < -1e-3 THEN ({a}*(1-ch_)+{b}*ch_)*nr_+{h}*(1-nr_) WHEN abs(up_) < {env.haze} THEN {sky}*(1-bd_)+{h}*1.15*bd_ ELSE {sky} END e{c}")
    return t + f", {out} AS (SELECT * EXCLUDE (dn_, dx_, dy_, dz_, up_, cs_, dw_, gl_, bd_, ch_, nr_), {', '.join(chans)} FROM {out}3)\n"


def surface(spark: SparkSession, d: str) -> DataFrame:
    """Splats with normal, view direction, albedo and material terms."""
    p = _pbr(spark, d)
    extra = whole_splats(spark, d).select("id", "opacity", "dc_r", "dc_g", "dc_b", "sh_rest")
    p = p.join(extra, "id")
    r = G.rotation(_cols("qw", "qx", "qy", "qz"))
    v = G.unit([e - F.col(c) for e, c in zip(VIEW.eye, "xyz")], 1e-9)
    return settled(p.select("*", *[r[i][2].alias(f"n{i}") for i in range(3)], *[c.alias(f"v{i}") for i, c in enumerate(v)], Q.sigmoid(F.col("opacity")).alias("ao"), F.lit(0.8).alias("shadow")))


def _rgb(df: DataFrame, out: str) -> DataFrame:
    return df.select("id", *[_r(F.col(f"{out}_{c}"), 4).alias(c) for c in "rgb"])


_N3, _V3, _A3, _F3 = ("n0", "n1", "n2"), ("v0", "v1", "v2"), ("a_r", "a_g", "a_b"), ("f0_r", "f0_g", "f0_b")


@query(_NORMAL + "SELECT id, round(2*k*n0-v0,5)+0.0 AS r0, round(f0+(1-f0)*pow(1-least(nv,1.0),5),5) AS fresnel FROM (SELECT *, (n0*v0+n1*v1+n2*v2) k, greatest(0.04+metallic*(a_r-0.04),0.02) f0 FROM nv)")
def reflection(spark: SparkSession, d: str) -> DataFrame:
    s = surface(spark, d)
    r = S.reflect(_cols(*_V3), _cols(*_N3))
    nv = F.greatest(F.lit(0.0), G.dot(_cols(*_N3), _cols(*_V3)))
    return s.select("id", (_r(r[0], 5) + 0.0).alias("r0"), _r(S.schlick(F.col("f0_r"), Q.clip(nv, 0.0, 1.0)), 5).alias("fresnel"))


_SKY = ", ".join(f"round(0.65*((w0*{z}+w1*{h}+w2*{g})/(w0+w1+w2+1e-6)+pow(tw,8)*0.35*{s}),4) AS {c}" for c, z, h, g, s in zip("rgb", (0.55, 0.70, 0.95), (0.85, 0.88, 0.95), (0.35, 0.30, 0.25), (1.20, 1.05, 0.85)))


@query(_NORMAL + f"SELECT id, {_SKY} FROM (SELECT *, greatest(0.0,least(1.0,n1)) w0, greatest(0.0,least(1.0,1-abs(greatest(-1.0,least(1.0,n1))))) w1, greatest(0.0,least(1.0,-n1)) w2, least(1.0,nl) tw FROM nv)")
def sky_ambient(spark: SparkSession, d: str) -> DataFrame:
    return surface(spark, d).select("id", *[_r(c, 4).alias(n) for n, c in zip("rgb", S.sky_ambient(_cols(*_N3), SUN))])


@query(_NORMAL + "SELECT id, round(pow(least(1.0,abs(dc_g)),1.5)*exp(-(4.0/(3.0+1.0))*(1-least(1.0,nl))*(1-least(1.0,nl))),5) AS glint FROM nv")
def cusp_glint(spark: SparkSession, d: str) -> DataFrame:
    s = surface(spark, d)
    nl = F.greatest(F.lit(0.0), -G.dot(_cols(*_N3), [F.lit(c) for c in SUN]))
    return s.select("id", _r(S.cusp_glint(nl, F.abs("dc_g"), F.lit(3.0)), 5).alias("glint"))


@query(_LIT + ", l2 AS (SELECT src AS id, product(CASE WHEN t > 0 THEN 1-least(1.0,exp(-0.5*off2/s2)*alpha) ELSE 1.0 END) shadow, exp(-0.5*sum(CASE WHEN t > 0 THEN exp(-0.5*d2/0.0025)*alpha ELSE 0.0 END)) ao2 FROM l GROUP BY src)\n" + _PBR + _LN + "SELECT id, " + ", ".join(f"round(greatest(0.0,least(1.0,{s}*a_{c}*nl*shadow+{m}*a_{c}*ao2)),4) AS {c}" for c, s, m in zip("rgb", SUN_RGB, (0.3, 0.32, 0.35))) + " FROM nv JOIN l2 USING (id)")
def lambert_light(spark: SparkSession, d: str) -> DataFrame:
    """Sun with the shadows of neighbours and ambient with their occlusion."""
    s = surface(spark, d).drop("ao", "shadow").join(occlusion(spark, d), "id")
    out = S.lambert_light(_cols(*_A3), _cols(*_N3), SUN, F.col("shadow"), F.col("ao"), (0.3, 0.32, 0.35), SUN_RGB)
    return s.select("id", *[_r(c, 4).alias(n) for n, c in zip("rgb", out)])


def _ggx_sql(a: str, f0: str, lights: tuple[str, str, str]) -> str:
    """Specular term of normals n, views v and a light direction, as one expression over the columns nh_, vh_, nl_, nv."""
    k = f"(({a}+1)*({a}+1)/8)"
    return f"(CASE WHEN nl_ > 0 AND nv > 0 THEN {a}*{a}/(3.141592653589793*(nh_*nh_*({a}*{a}-1)+1)*(nh_*nh_*({a}*{a}-1)+1)+1e-6)*({f0}+(1-{f0})*pow(1-vh_,5))*(nv/(nv*(1-{k})+{k}+1e-6))*(nl_/(nl_*(1-{k})+{k}+1e-6))/(4*nl_*nv+1e-6) ELSE 0.0 END)"


def _half_sql(src: str, out: str, to: tuple[float, float, float]) -> str:
    l0, l1, l2 = (_n(c) for c in to)
    return f""", {out}a AS (SELECT *, (v0+{l0})/hl_ h0, (v1+{l1})/hl_ h1, (v2+{l2})/hl_ h2 FROM (SELECT *, sqrt((v0+{l0})*(v0+{l0})+(v1+{l1})*(v1+{l1})+(v2+{l2})*(v2+{l2}))+1e-6 hl_ FROM {src})),
{out} AS (SELECT * EXCLUDE (hl_, h0, h1, h2), greatest(0.0,n0*{l0}+n1*{l1}+n2*{l2}) nl_, greatest(0.0,n0*h0+n1*h1+n2*h2) nh_, greatest(0.0,v0*h0+v1*h1+v2*h2) vh_ FROM {out}a)
"""


_TO = tuple(-c for c in SUN)
_B1 = ", ".join(
    f"round(greatest(0.0,least(1.0,{s}*a_{c}*nl*0.8+0.65*((w0*{z}+w1*{h}+w2*{g})/(w0+w1+w2+1e-6)+pow(tw,8)*0.35*{w})*a_{c}*ao+1.2*" + _ggx_sql("ra", "CASE hint WHEN 2 THEN 0.04+0.3*(a_" + c + "-0.04) WHEN 3 THEN greatest(0.0,least(1.0,a_" + c + ")) ELSE 0.04 END", _TO) + f"*{s}*nl*0.8+0.6*gl*{s}*0.8)),4) AS {c}"
    for c, s, z, h, g, w in zip("rgb", SUN_RGB, (0.55, 0.70, 0.95), (0.85, 0.88, 0.95), (0.35, 0.30, 0.25), (1.20, 1.05, 0.85))
)


@query(
    _NORMAL
    + _half_sql("nv", "hf", _TO)
    + ", b1 AS (SELECT *, greatest(0.02,least(1.0,CASE hint WHEN 0 THEN 0.9-0.7*64/255.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.4 WHEN 3 THEN 0.05 ELSE 0.6 END+0.2*cu)) ra, pow(cu,1.5)*exp(-(4.0/(3.0+1.0))*(1-least(1.0,nl))*(1-least(1.0,nl))) gl, greatest(0.0,least(1.0,n1)) w0, greatest(0.0,least(1.0,1-abs(greatest(-1.0,least(1.0,n1))))) w1, greatest(0.0,least(1.0,-n1)) w2, least(1.0,nl) tw FROM (SELECT *, (id % 4) hint, least(1.0,abs(dc_g)) cu FROM hf)) SELECT id, "
    + _B1
    + " FROM b1"
)
def bar1_light(spark: SparkSession, d: str) -> DataFrame:
    """Material classes 0 to 3 in turn, a constant shadow of 0.8, opacity as occlusion."""
    s = surface(spark, d).withColumns({"hint": (F.col("id") % 4).cast("int"), "cusp": F.least(F.lit(1.0), F.abs("dc_g"))})
    out = S.bar1_light(_cols(*_A3), _cols(*_N3), _cols(*_V3), SUN, SUN_RGB, F.lit(0.8), F.col("ao"), F.col("hint"), F.lit(64), F.col("cusp"), F.lit(3.0))
    return s.select("id", *[_r(c, 4).alias(n) for n, c in zip("rgb", out)])


@query(_NORMAL + _env_sql("nv", "ev", _N3) + "SELECT id, round(er,4) AS r, round(eg,4) AS g, round(eb,4) AS b FROM ev")
def environment_sample(spark: SparkSession, d: str) -> DataFrame:
    return _rgb(light.with_environment(surface(spark, d), _N3, ENV, "e"), "e")


@query(_NORMAL + _env_sql("nv", "ev", _N3, S.Environment.studio(SUN)) + "SELECT id, round(er,4) AS r, round(eg,4) AS g, round(eb,4) AS b FROM ev")
def studio_sample(spark: SparkSession, d: str) -> DataFrame:
    return _rgb(light.with_environment(surface(spark, d), _N3, S.Environment.studio(SUN), "e"), "e")


@query()
def environment_blurred(spark: SparkSession, d: str) -> DataFrame:
    return _rgb(light.with_blurred(surface(spark, d), _N3, "roughness", ENV, "e"), "e")


def _direct(strength: float, weight: str, rgb: tuple, ao: str) -> list[str]:
    return [f"{strength}*{s}*((1-metallic)*a_{c}+" + _ggx_sql("roughness", f"greatest(0.04+metallic*(a_{c}-0.04),0.02)", _TO) + f")*nl_*{weight}" for c, s in zip("rgb", rgb)]


@query(_NORMAL + _half_sql("nv", "hf", _TO) + _env_sql("hf", "ev", _N3) + "SELECT id, " + ", ".join(f"round(greatest(0.0,least(1.0,{x}+0.55*e{c}*ao*(1-metallic)*a_{c})),4) AS {c}" for c, x in zip("rgb", _direct(1.4, "0.8", SUN_RGB, "ao"))) + " FROM ev")
def bar2_direct(spark: SparkSession, d: str) -> DataFrame:
    """Direct sun and diffuse environment of the full composer."""
    return _rgb(light.with_bar2(surface(spark, d), SUN, SUN_RGB, ENV, "o", strengths=(1.4, 0.55, 0.0, 0.0)), "o")


@query()
def bar2_light(spark: SparkSession, d: str) -> DataFrame:
    """The full composer with reflections and glint."""
    s = surface(spark, d).withColumns({"cusp": F.least(F.lit(1.0), F.abs("dc_g")), "pixels": F.lit(3.0)})
    return _rgb(light.with_bar2(s, SUN, SUN_RGB, ENV, "o", cusp="cusp", pixels="pixels"), "o")


@query()
def three_lights(spark: SparkSession, d: str) -> DataFrame:
    return _rgb(light.with_three_lights(surface(spark, d), VIEW.eye, (0.0, 0.0, 0.0), S.Environment.studio(SUN), "o"), "o")


_GRADE = [f"((pow(greatest(c_{c}+{lift},1e-9),1/{gm}::DOUBLE)*{gn}-0.5)*1.05+0.5)" for c, lift, gm, gn in zip("rgb", (0.005, 0.005, 0.012), (1.0, 1.0, 0.98), (1.02, 1.0, 0.97))]
_GREY = f"(0.2126*{_GRADE[0]}+0.7152*{_GRADE[1]}+0.0722*{_GRADE[2]})"


@query(_S + ", c AS (SELECT id, " + ", ".join(f"greatest(0.0,least(1.0,abs(dc_{c}))) c_{c}" for c in "rgb") + " FROM v) SELECT id, " + ", ".join(f"round({_GREY}+({g}-{_GREY})*1.1,5) AS {c}" for c, g in zip("rgb", _GRADE)) + ", round(1-0.2*pow(greatest(0.0,least(1.0,((id%64-31.5)/31.5)*((id%64-31.5)/31.5)+((floor(id/64)%64-31.5)/31.5)*((floor(id/64)%64-31.5)/31.5))),1.6),5) AS corner FROM c")
def graded(spark: SparkSession, d: str) -> DataFrame:
    """Colours graded, and the vignette of the pixel that an id stands for in a 64 x 64 picture."""
    s = valid_splats(spark, d).select("id", *[Q.clip(F.abs(f"dc_{c}"), 0.0, 1.0).alias(f"c_{c}") for c in "rgb"])
    corner = S.vignette(F.floor(F.col("id") / 64) % 64, F.col("id") % 64, 64, 64)
    return s.select("id", *[_r(c, 5).alias(n) for n, c in zip("rgb", S.colour_grade(_cols("c_r", "c_g", "c_b")))], _r(corner, 5).alias("corner"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', " + ", ".join(f"round({v!r}::DOUBLE,6)" for v in w) + ")" for k, w in S.three_directions((4.0, 3.0, 10.0), (0.0, 0.5, 0.0)).items()) + ") t(light, x, y, z)")
def light_directions(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, *w) for k, w in S.three_directions((4.0, 3.0, 10.0), (0.0, 0.5, 0.0)).items()]
    return spark.createDataFrame(rows, "light string, x double, y double, z double").select("light", *[_r(F.col(c)).alias(c) for c in "xyz"])


_PANO = "pano AS (SELECT a.v, b.u, round(0.5+0.5*sin(a.v*0.7+b.u*0.3),6) lum FROM range(32) a(v), range(64) b(u))"


def panorama(spark: SparkSession) -> DataFrame:
    """A made panorama (v, u, lum) of 32 x 64 pixels."""
    p = spark.range(32 * 64).select(F.floor(F.col("id") / 64).cast("int").alias("v"), (F.col("id") % 64).cast("int").alias("u"))
    return p.withColumn("lum", _r(0.5 + 0.5 * F.sin(F.col("v") * 0.7 + F.col("u") * 0.3)))


@query(_NORMAL.replace("WITH ", f"WITH {_PANO}, ", 1) + ", px AS (SELECT id, greatest(0,least(31,floor((1-(asin(greatest(-1.0,least(1.0,n1/(ln+1e-9))))/3.141592653589793+0.5))*32)))::INT v, greatest(0,least(63,floor((atan2(n0/(ln+1e-9),-n2/(ln+1e-9))/6.283185307179586+0.5)*64)))::INT u FROM (SELECT *, sqrt(n0*n0+n1*n1+n2*n2) ln FROM nv)) SELECT id, px.v, px.u, lum FROM px JOIN pano ON pano.v = px.v AND pano.u = px.u")
def panorama_lookup(spark: SparkSession, d: str) -> DataFrame:
    v, u = S.equirect_pixel(_cols(*_N3), 32, 64)
    return surface(spark, d).select("id", v.alias("v"), u.alias("u")).join(panorama(spark), ["v", "u"]).select("id", "v", "u", "lum")
