"""Queries over fits, files, meshes and streams."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cloudloom.functions import geometry as G, quant as Q
from cloudloom.operators import changefeed, fits
from cloudloom.plans.adapters import SPLATS_SQL, whole_splats
from cloudloom.plans.durable import checkpoint_dir
from cloudloom.plans.session import table
from cloudloom.queries import training
from cloudloom.queries.fields import PCA_SQL
from cloudloom.sources import container, mesh
from cloudloom.streaming import changes

_S = f"WITH {SPLATS_SQL}\n"


def group_moments(spark: SparkSession, d: str) -> DataFrame:
    m = fits.moments(whole_splats(spark, d), ["scene_id", "tier"])
    return m.select("scene_id", "tier", "n", *[F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "mean_z")], *[(F.round(F.coalesce(c, F.lit(0.0)), 4) + 0.0).alias(c) for c in ("c_xx", "c_xy", "c_zz")])


def pca_spread(spark: SparkSession, d: str) -> DataFrame:
    m = fits.moments(whole_splats(spark, d), ["scene_id", "tier"]).where("n >= 3")
    e = fits.eigenvalues("c_xx", "c_xy", "c_xz", "c_yy", "c_yz", "c_zz")
    return m.select("scene_id", "tier", "n", F.posexplode(F.transform(e, lambda v: F.round(F.sqrt(F.greatest(v, F.lit(1e-8))), 4))).alias("axis", "sigma"))


def germ_fit(spark: SparkSession, d: str) -> DataFrame:
    f = fits.germ_fit(whole_splats(spark, d), ["scene_id", "tier"])
    return f.select("scene_id", "tier", "n", F.round("rmse", 5).alias("rmse"), F.transform("theta", lambda t: F.round(t, 4)).alias("theta"))


def container_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Largest error of each attribute after packing and unpacking every partition's rows."""
    s = whole_splats(spark, d).select("tier", "x", "y", "z", "dc_r", "dc_g", "dc_b", Q.sigmoid(F.col("opacity")).alias("alpha"), "sx", "sy", "sz", "qw", "qx", "qy", "qz", Q.sh_q8_encode(F.col("sh_rest"), 0.00731).alias("sh_q8"))

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            got: dict = {}
            for meta, raw in container.encode_splats(t):
                got |= container.decode_chunk(meta["name"], raw, meta)
            sh = np.array(t.column("sh_q8").to_pylist())
            rows = {c: float(np.abs(got[c] - t.column(c).to_numpy()).max()) for c in ("tier", "x", "y", "z", "alpha", "sx", "sy", "sz")}
            rows["sh_q8"] = float(np.abs(got["sh_q8"] - sh).max())
            yield pa.RecordBatch.from_pydict({"attr": list(rows), "worst": list(rows.values())})

    return s.mapInArrow(run, "attr string, worst double").groupBy("attr").agg(F.max("worst").alias("worst"))


_OBJ = ["v 0 0 0", "v 1 0 0", "v 1 1 0", "v 0 1 0", "v 0 0 2", "usemtl red", "f 1 2 3 4", "usemtl chrome", "f 1/1 2/2 -1"]


def mesh_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Fan triangles of a small mesh with their areas: n-gons, slashes and negative indices."""
    src = spark.createDataFrame([("m", i, t) for i, t in enumerate(_OBJ)], "file string, no int, line string")
    t, v = mesh.triangles(mesh.faces(src)), mesh.vertices(src)
    for c in "abc":
        t = t.join(v.select("file", F.col("v").alias(c), *[F.col(x).alias(f"{c}{x}") for x in "xyz"]), ["file", c])
    area = G.triangle_area(*[[F.col(f"{c}{x}") for x in "xyz"] for c in "abc"])
    return t.select("face", "t", "a", "b", "c", "material", F.round(area, 6).alias("area"))


def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """The change feed as a stream of files into a log, then merged on read; equals p4_found."""
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    cells = {a: F.col("dirty_mask").bitwiseAND(1 << b) != 0 for a, b in training.FEED_BITS.items()}
    log = changefeed.ChangeLog(spark, f"{at}/log", training.FEED_KEYS, training.FEED_ORDER, "change_id", "op", cells)
    changes.follow(changes.stream_table(spark, d, "delta_feed"), log, f"{at}/progress")
    return log.current().select(*training.FEED_KEYS, "attr", F.col("seq.change").alias("change_id"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = changes.windowed(table(spark, d, "events"), "ts", "1 hour", None, "event_type", "value")
    return w.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return changes.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")


QUERIES = {f.__name__: f for f in (group_moments, pca_spread, germ_fit, container_round_trip, mesh_triangles, stream_changes, event_windows, event_sessions)}
ORACLE = {
    "pca_spread": PCA_SQL,
    "group_moments": _S + "SELECT scene_id, tier, count(*) AS n, " + ", ".join(f"round(avg({c}),6) AS mean_{c}" for c in "xyz") + ", " + ", ".join(f"round(coalesce(covar_samp({a},{b}),0.0),4)+0.0 AS c_{a}{b}" for a, b in ("xx", "xy", "zz")) + " FROM s GROUP BY ALL",
    "mesh_triangles": "SELECT * FROM (VALUES (1,1,1,2,3,'red',0.5::DOUBLE),(1,2,1,3,4,'red',0.5),(2,1,1,2,5,'chrome',1.0)) t(face,t,a,b,c,material,area)",
    "stream_changes": training.ORACLE["p4_found"],
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY ALL",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k",
}
