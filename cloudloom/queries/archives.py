"""Queries over containers written and read again, layouts, codecs and meshes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cloudloom.functions import quant as Q
from cloudloom.operators import surfaces
from cloudloom.plans.adapters import SPLATS_SQL, whole_splats
from cloudloom.plans.durable import checkpoint_dir
from cloudloom.plans.session import table
from cloudloom.plans.sizing import bucket_count
from cloudloom.queries.projections import _r, query
from cloudloom.queries.relational import _LAST, _PATCH, patch_rows
from cloudloom.sources import container, layouts, mesh, timeline

QUERIES: dict = {}
ORACLE: dict = {}
query = query.into(QUERIES, ORACLE)
_S = f"WITH {SPLATS_SQL}\n"
STEM = b"SPLATPAK"


def packable(spark: SparkSession, d: str) -> DataFrame:
    """Splats with the columns a container takes, in ranges of ids."""
    s = whole_splats(spark, d).select("id", "tier", "x", "y", "z", "dc_r", "dc_g", "dc_b", Q.sigmoid(F.col("opacity")).alias("alpha"), "sx", "sy", "sz", "qw", "qx", "qy", "qz", Q.sh_q8_encode(F.col("sh_rest"), 0.00731).alias("sh_q8"))
    return s.repartitionByRange(4, "id").sortWithinPartitions("id")


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).removeprefix('file://').removeprefix('file:')}/pack-{uuid.uuid4().hex}"


def book() -> np.ndarray:
    """A fixed codebook of 3 x 128 codewords."""
    i = np.arange(3 * 128 * 15).reshape(3, 128, 15)
    return np.rint(40 * np.sin(i * 0.7) * np.cos(i * 0.013)).astype(np.int8)


def _archive(spark: SparkSession, d: str, kind: str, **more) -> DataFrame:
    mesh.register(spark)
    at = _folder(spark)
    container.write_containers(packable(spark, d), at, STEM, "", kind=kind, book=book(), **more).agg(F.sum("splats")).collect()  # writes
    return spark.read.format("splatpack").option("rowsPerPartition", 1000).load(at)


_Q8 = _S + ", u AS (SELECT tier, unnest(sh_rest)::DOUBLE c, unnest(range(45)) k FROM s), q AS (SELECT tier, k, greatest(-128, least(127, round_even(c/0.00731,0)))::BIGINT q FROM u)\nSELECT tier, count(*)//45 AS n, sum(q)::BIGINT AS total, sum(q*(k+1))::BIGINT AS weighted, sum(q*q)::BIGINT AS squares FROM q GROUP BY tier"


def _sums(df: DataFrame) -> DataFrame:
    u = df.select("tier", F.posexplode("sh_q8").alias("k", "q")).withColumn("q", F.col("q").cast("bigint"))
    return u.groupBy("tier").agg(F.floor(F.count("*") / 45).alias("n"), F.sum("q").alias("total"), F.sum(F.col("q") * (F.col("k") + 1)).alias("weighted"), F.sum(F.col("q") * F.col("q")).alias("squares"))


@query(_Q8)
def archive_exact(spark: SparkSession, d: str) -> DataFrame:
    """Codebooks with residuals by tier and group, written, read in ranges of rows, and exact."""
    return _sums(_archive(spark, d, "archive"))


@query(_Q8)
def archive_payload(spark: SparkSession, d: str) -> DataFrame:
    """Codebooks with one residual payload in a layout of its own, exact."""
    return _sums(_archive(spark, d, "payload"))


@query(_Q8)
def container_plain(spark: SparkSession, d: str) -> DataFrame:
    return _sums(_archive(spark, d, "plain"))


@query()
def render_error(spark: SparkSession, d: str) -> DataFrame:
    """What codebooks alone lose: root mean square by tier, as rows and their sums are those of the exact archive."""
    a = _archive(spark, d, "render").select("file", "id", "tier", F.col("sh_q8").alias("a"))
    b = _archive(spark, d, "archive").select("file", "id", F.col("sh_q8").alias("b"))
    e = F.aggregate(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)), F.lit(0), lambda s, v: s + v)
    return a.join(b, ["file", "id"]).groupBy("tier").agg(F.count("*").alias("n"), _r(F.sqrt(F.avg(e) / 45), 4).alias("rmse"))


@query(_S + "SELECT tier AS hint, count(*) AS n, 0::BIGINT AS wrong, sum(2*tier+1)::BIGINT AS mips FROM s GROUP BY tier")
def side_tables(spark: SparkSession, d: str) -> DataFrame:
    """Materials put behind containers as a trailer, one column stamped anew in place, and read as columns of the splats."""
    mesh.register(spark)
    at = _folder(spark)
    rows = packable(spark, d)
    container.write_containers(rows, at, STEM, "", kind="plain").agg(F.sum("splats")).collect()  # writes
    ids = spark.read.format("splatpack").schema("file string, id bigint, tier int").load(at)

    def stamp(batches):
        import glob

        for b in batches:
            for no in b.column(0).to_pylist():
                for p in sorted(glob.glob(f"{at}/part-{no:05d}-*.pack")):
                    _, m, payload = container.read_manifest(p)
                    tier = container.decode_chunk("tier_labels_u8", container.read_chunk(p, m["chunks"][0], payload), m["chunks"][0])["tier"]
                    zero = np.zeros(len(tier), np.uint8)
                    container.append_trailer(p, 31, {"material_u8x4": container.encode_side("material_u8x4", {"hint": tier, "confidence": zero, "view_dep": zero, "mip": zero})})
                    container.restamp(p, "mip", tier * 2 + 1)
                yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32())], names=["no"])

    spark.range(0, 4, 1, 4).select(F.col("id").cast("int").alias("no")).mapInArrow(stamp, "no int").collect()  # four files
    back = spark.read.format("splatpack").schema("file string, id bigint, tier int, hint int, mip int").load(at)
    j = back.join(ids.select("file", "id"), ["file", "id"])
    return j.groupBy("hint").agg(F.count("*").alias("n"), F.count_if(F.col("tier") != F.col("hint")).alias("wrong"), F.sum("mip").alias("mips"))


@query()
def layout_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of every layout with two codecs over blocks of residuals, and whether each gives them back; the smallest first."""
    r = table(spark, d, "residual_state").where("residual IS NOT NULL AND tier IS NOT NULL").select("splat_id", F.col("tier").cast("int").alias("tier"), F.col("residual").cast("array<int>").alias("r")).dropDuplicates(["splat_id"])
    s = whole_splats(spark, d).select(F.col("id").alias("splat_id"), "x", "y", "z")
    return sweep(r.join(s, "splat_id"))


def sweep(rows: DataFrame, codecs=("zlib6", "zlib9")) -> DataFrame:
    """``rows``: (splat_id, tier, r, x, y, z). Blocks are hash buckets of a bounded size, so no group goes into one task."""
    n = bucket_count(rows, target=16 << 20)
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("splat_id"), F.lit(n)).cast("int"))
    schema = pa.schema([("layout", pa.string()), ("codec", pa.string()), ("raw", pa.int64()), ("bytes", pa.int64()), ("exact", pa.bool_())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("splat_id")
        r = np.array(t.column("r").to_pylist(), dtype=np.int16).reshape(-1, 45)
        xyz, tier = np.stack([t.column(c).to_numpy() for c in "xyz"], 1), t.column("tier").to_numpy()
        out = []
        for name in layouts.LAYOUTS:
            raw, meta = layouts.encode(name, r, xyz, tier)
            exact = bool(np.array_equal(layouts.decode(raw, meta, xyz, tier), r))
            for c in codecs:
                z = layouts.compress(c, raw)
                out.append((name, c, len(raw), len(z), exact and layouts.decompress(c, z) == raw))
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    each = blocks.groupBy("block").applyInArrow(run, "layout string, codec string, raw bigint, bytes bigint, exact boolean")
    return each.groupBy("layout", "codec").agg(F.sum("raw").alias("raw"), F.sum("bytes").alias("bytes"), F.bool_and("exact").alias("exact")).orderBy("bytes", "layout", "codec")


@query()
def variant_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Residual bytes as one stream, by group, by tier and group, and as mask and values; which is smallest."""
    r = table(spark, d, "residual_state").where("residual IS NOT NULL AND tier IS NOT NULL").select("splat_id", F.col("tier").cast("int").alias("tier"), F.col("residual").cast("array<int>").alias("r")).dropDuplicates(["splat_id"])
    n = bucket_count(r, target=16 << 20)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("splat_id")
        a, tier = np.array(t.column("r").to_pylist(), dtype="<i2").reshape(-1, 45), t.column("tier").to_numpy()
        size = lambda parts: sum(len(layouts.compress("zlib6", np.ascontiguousarray(p).tobytes())) for p in parts)
        groups = [a[:, 15 * g : 15 * g + 15] for g in range(3)]
        sizes = {"global_full": size([a]), "per_group": size(groups), "per_tier_group": size([p[tier == k] for k in np.unique(tier) for p in groups]), "sparse_mask_values": sum(len(layouts.compress("zlib6", np.packbits((p != 0).ravel()).tobytes() + p[p != 0].tobytes())) for p in groups)}
        return pa.table({"variant": list(sizes), "bytes": list(sizes.values())})

    b = r.withColumn("block", F.pmod(F.xxhash64("splat_id"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(run, "variant string, bytes bigint")
    s = b.groupBy("variant").agg(F.sum("bytes").alias("bytes"))
    return s.crossJoin(s.agg(F.min("bytes").alias("least"))).select("variant", "bytes", (F.col("bytes") == F.col("least")).alias("best"))  # one row


@query("SELECT splat_id, true AS same FROM (SELECT DISTINCT splat_id FROM residual_state WHERE residual IS NOT NULL)")
def codec_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Residuals as bytes through every codec as columns, their CRC before and after."""
    r = table(spark, d, "residual_state").where("residual IS NOT NULL").select("splat_id", F.encode(F.array_join(F.col("residual").cast("array<string>"), ","), "utf-8").alias("b")).dropDuplicates(["splat_id"])
    same = F.lit(True)
    for c in ("zlib6", "zlib9", "bz2", "lzma6"):
        same &= F.crc32(Q.unpacked(c)(Q.packed(c)(F.col("b")))) == F.crc32("b")
    return r.select("splat_id", same.alias("same"))


_TRI = ["v 0 0 0", "v 3 0 0", "v 3 1 0", "v 0 1 0", "v 0 0 2", "usemtl red", "f 1 2 3 4", "usemtl chrome", "f 1 4 5"]
_MTL = ["newmtl red", "Kd 0.9 0.3 0.3", "Ke 0.1 0 0", "illum 2", "newmtl chrome", "Kd 0.8 0.8 0.8", "Pm 1", "Pr 0.05"]


@query("WITH t AS (SELECT * FROM (VALUES (1,1,'red',1.5::DOUBLE),(1,2,'red',1.5),(2,1,'chrome',1.0)) t(face,t,material,area)), u AS (SELECT *, sum(area) OVER (ORDER BY face, t) upto FROM t), c AS (SELECT face, t, material, ceil(upto/4.0*400-1e-9)-ceil((upto-area)/4.0*400-1e-9) n FROM u) SELECT c.face, c.t, c.n::BIGINT AS n, m.kd, m.metallic FROM c JOIN (VALUES ('red', 0.5::DOUBLE, 0.0::DOUBLE), ('chrome', 0.8, 1.0)) m(material, kd, metallic) USING (material)")
def mesh_samples(spark: SparkSession, d: str) -> DataFrame:
    """400 points over a small mesh by area, with the material of each face."""
    src = spark.createDataFrame([("m", i, t) for i, t in enumerate(_TRI)], "file string, no int, line string")
    mtl = spark.createDataFrame([("m", i, t) for i, t in enumerate(_MTL)], "file string, no int, line string")
    t, v = mesh.triangles(mesh.faces(src)), mesh.vertices(src)
    for c in "abc":
        t = t.join(v.select("file", F.col("v").alias(c), *[F.col(x).alias(f"{c}{x}") for x in "xyz"]), ["file", c])
    n = surfaces.sample_triangles(t, 400).groupBy("file", "face", "t").agg(F.count("*").alias("n"))
    look = mesh.materials(mtl).select("file", "material", _r(F.col("kd"), 6).alias("kd"), "metallic")
    return n.join(t.select("file", "face", "t", "material"), ["file", "face", "t"]).join(look, ["file", "material"]).select("face", "t", "n", "kd", "metallic")


@query(_PATCH + _LAST.format(w=""))
def timeline_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The feed's opacities and tiers written as a timeline for each scene, read again and composed."""
    p = patch_rows(spark, d)
    last = p.groupBy("scene_id", "time_offset_ms", "frame_no", "phoxoid_id", "attr").agg(F.max_by("val", "rec_no").alias("val"))
    frames = last.select("scene_id", "time_offset_ms", "frame_no").distinct()
    frames = frames.withColumn("frame", F.row_number().over(W.partitionBy("scene_id").orderBy("time_offset_ms", "frame_no")))  # a row a frame
    rows = last.join(frames, ["scene_id", "time_offset_ms", "frame_no"]).select(F.col("scene_id").cast("string").alias("file"), "frame", F.col("time_offset_ms").alias("t_ms"), F.col("phoxoid_id").alias("id"), "attr", F.array("val").alias("val"))
    at = _folder(spark)
    timeline.write_timelines(rows, at, b"DELTA\0\0\0", b"TIMELINE", 7, 50).agg(F.sum("bytes")).collect()  # writes
    back = timeline.read_timelines(spark, at)
    scene = F.regexp_extract("file", r"([0-9]+)\.seq$", 1).cast("int")
    return back.groupBy(scene.alias("scene_id"), F.col("id").alias("phoxoid_id"), "attr").agg(F.max_by(F.col("val")[0], "frame").alias("val"))
