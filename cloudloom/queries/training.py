"""Queries of the general training-data problems 1, 3 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloudloom.operators import changefeed, compare, drift
from cloudloom.plans.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    fields = [compare.Compared(c, "float") for c in "xyz"] + [compare.Compared("sh_rest", "floats")]
    splats = compare.compare_copies(table(spark, d, "splats"), table(spark, d, "splats_mirror"), ["splat_id"], fields, version="loaded_at")
    chunks = compare.compare_copies(
        table(spark, d, "chunk_report"),
        table(spark, d, "chunk_report_mirror"),
        ["container_id", "chunk_name"],
        [compare.Compared("crc32_raw", "exact", compare.crc32_bits(F.col("crc32_raw")), compare.crc32_bits(F.col("crc32_raw"))), compare.Compared("raw_bytes")],
        version="written_at",
    )
    return splats.select(F.lit("splats").alias("tbl"), F.col("splat_id").alias("rec_id"), F.lit("").alias("chunk_name"), "field", "kind").unionByName(
        chunks.select(F.lit("chunk_report").alias("tbl"), F.col("container_id").alias("rec_id"), "chunk_name", "field", "kind")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.migrations(drift.profile(table(spark, d, "sweep_records")))


def p3_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return drift.fingerprints(drift.profile(table(spark, d, "sweep_records")))


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "sweep_records")
    prof = drift.profile(records)
    out = drift.unify(records, drift.routes(prof, drift.migrations(prof)), ["series", "run_no", "rec_no"])
    each = out.select("series", "run_no", "rec_no", F.explode("values").alias("field", "value"), "numbers", "flags", "casts")
    was_cast = F.exists("casts", lambda c: c.startswith(F.concat("field", F.lit(": "))))
    return each.select("series", "run_no", "rec_no", "field", "value", F.element_at("numbers", F.col("field")).alias("number"), F.element_at("flags", F.col("field")).alias("flag"), was_cast.alias("was_cast")).distinct()


FEED_KEYS = ["scene_id", "phoxoid_id"]
FEED_ORDER = ["time_offset_ms", "frame_no", "rec_no"]
#: Bits of the dirty mask that have a column in the feed (fixed values of the format).
FEED_BITS = {"xyz": 0, "opacity": 3, "f_dc": 4, "tier": 6, "neighbors": 9}


def feed_logs(feed: DataFrame):
    cells = {a: F.col("dirty_mask").bitwiseAND(1 << b) != 0 for a, b in FEED_BITS.items()}
    return changefeed.split_feed(feed, FEED_KEYS, FEED_ORDER, "change_id", "op", cells)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows, sets, deletes = feed_logs(table(spark, d, "delta_feed"))
    return changefeed.current_cells(rows, sets, deletes, FEED_KEYS, list(FEED_BITS)).select(*FEED_KEYS, "attr", F.col("seq.change").alias("change_id"))


def p4_live_rows(spark: SparkSession, d: str) -> DataFrame:
    rows, _, deletes = feed_logs(table(spark, d, "delta_feed"))
    return changefeed.live_rows(rows, deletes, FEED_KEYS).select(*FEED_KEYS, F.col("seq.change").alias("change_id"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_fingerprints": p3_fingerprints, "p3_unified": p3_unified, "p4_found": p4_found, "p4_live_rows": p4_live_rows}

_FLOAT = "NOT (({a} IS NULL AND {b} IS NULL) OR ({a} IS NOT NULL AND {b} IS NOT NULL AND (({a}::VARCHAR = 'nan' AND {b}::VARCHAR = 'nan') OR ({a}::VARCHAR <> 'nan' AND {b}::VARCHAR <> 'nan' AND ({a} = {b} OR (isfinite({a}) AND isfinite({b}) AND abs({a}-{b}) <= 1e-5*greatest(1.0,abs({a}),abs({b}))))))))"


def _p1_sql() -> str:
    valid = "SELECT splat_id, x::DOUBLE x, y::DOUBLE y, z::DOUBLE z, sh_rest FROM (SELECT *, row_number() OVER (PARTITION BY splat_id ORDER BY loaded_at DESC NULLS LAST) rn FROM {t}) WHERE rn = 1"
    bits = """(CASE WHEN lower(trim({c})) LIKE '0x%' THEN try_cast(trim({c}) AS BIGINT) ELSE try_cast(trim({c}) AS BIGINT) END) & 4294967295"""
    chunk = "SELECT container_id, chunk_name, raw_bytes, " + bits.format(c="crc32_raw::VARCHAR") + " crc FROM (SELECT *, row_number() OVER (PARTITION BY container_id, chunk_name ORDER BY written_at DESC NULLS LAST) rn FROM {t}) WHERE rn = 1"
    floats = " UNION ALL ".join(f"SELECT 'splats', splat_id, '', '{c}', 'differs' FROM pair WHERE " + _FLOAT.format(a=f"l_{c}", b=f"r_{c}") for c in "xyz")
    elem = _FLOAT.format(a="e.a", b="e.b")
    return f"""
WITH l AS ({valid.format(t='splats')}), r AS ({valid.format(t='splats_mirror')}),
cl AS ({chunk.format(t='chunk_report')}), cr AS ({chunk.format(t='chunk_report_mirror')}),
pair AS (SELECT l.splat_id, l.x l_x, l.y l_y, l.z l_z, l.sh_rest sa, r.x r_x, r.y r_y, r.z r_z, r.sh_rest sb FROM l JOIN r USING (splat_id)),
el AS (SELECT splat_id, unnest(list_transform(range(1, len(sa)+1), lambda i: {{'a': sa[i]::DOUBLE, 'b': sb[i]::DOUBLE}})) e FROM pair WHERE len(sa) = len(sb))
SELECT 'splats' AS tbl, splat_id AS rec_id, '' AS chunk_name, '' AS field, 'only_left' AS kind FROM l ANTI JOIN r USING (splat_id)
UNION ALL SELECT 'splats', splat_id, '', '', 'only_right' FROM r ANTI JOIN l USING (splat_id)
UNION ALL {floats}
UNION ALL SELECT 'splats', splat_id, '', 'sh_rest', 'differs' FROM pair WHERE (sa IS NULL) <> (sb IS NULL) OR len(sa) <> len(sb)
UNION ALL SELECT DISTINCT 'splats', splat_id, '', 'sh_rest', 'differs' FROM el WHERE {elem}
UNION ALL SELECT 'chunk_report', container_id, chunk_name, '', 'only_left' FROM cl ANTI JOIN cr USING (container_id, chunk_name)
UNION ALL SELECT 'chunk_report', container_id, chunk_name, '', 'only_right' FROM cr ANTI JOIN cl USING (container_id, chunk_name)
UNION ALL SELECT 'chunk_report', container_id, chunk_name, 'crc32_raw', 'differs' FROM cl JOIN cr USING (container_id, chunk_name) WHERE cl.crc IS DISTINCT FROM cr.crc
UNION ALL SELECT 'chunk_report', container_id, chunk_name, 'raw_bytes', 'differs' FROM cl JOIN cr USING (container_id, chunk_name) WHERE cl.raw_bytes IS DISTINCT FROM cr.raw_bytes"""


_FEED = """WITH f AS (SELECT DISTINCT scene_id, phoxoid_id, change_id, lower(substr(trim(op),1,1)) o, dirty_mask m, time_offset_ms::HUGEINT * 4611686018427387904 + frame_no::HUGEINT * 2147483648 + rec_no::HUGEINT AS s FROM delta_feed),
born AS (SELECT scene_id, phoxoid_id, max(s) FILTER (o = 'i') b, max(s) FILTER (o = 'd') x FROM f GROUP BY ALL),
live AS (SELECT scene_id, phoxoid_id, b FROM born WHERE b IS NOT NULL AND (x IS NULL OR b > x))
"""


def _p4_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT scene_id, phoxoid_id, '{a}' AS attr, change_id, s FROM alive WHERE m & {1 << b} <> 0" for a, b in FEED_BITS.items())
    return (
        _FEED
        + f""", alive AS (SELECT f.* FROM f JOIN live USING (scene_id, phoxoid_id) WHERE f.o IN ('i','u') AND f.s >= live.b), c AS ({parts})
SELECT scene_id, phoxoid_id, attr, arg_max(change_id, s) AS change_id FROM c GROUP BY ALL"""
    )


ORACLE = {
    "p1_found": _p1_sql(),
    "p4_found": _p4_sql(),
    "p4_live_rows": _FEED + "SELECT l.scene_id, l.phoxoid_id, f.change_id FROM live l JOIN f ON f.scene_id = l.scene_id AND f.phoxoid_id = l.phoxoid_id AND f.s = l.b",
}
