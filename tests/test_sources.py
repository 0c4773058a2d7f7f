import numpy as np
import pyarrow as pa
import pytest

from cloudloom.sources import container, mesh, ply, timeline

MAGIC = b"SPLATPACK25"


def splats(spark, n=300):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q)
        rows.append((i, int(i % 3), *rng.normal(size=3).tolist(), *(rng.normal(size=3) * 0.5).tolist(), float(rng.random()), *rng.uniform(-6, -2, 3).tolist(), *q.tolist(), rng.integers(-128, 128, 45).tolist()))
    return spark.createDataFrame(rows, "src bigint, tier int, x double, y double, z double, dc_r double, dc_g double, dc_b double, alpha double, sx double, sy double, sz double, qw double, qx double, qy double, qz double, sh_q8 array<int>")


def test_container_round_trip_and_pruning(spark, tmp_path):
    mesh.register(spark)
    df = splats(spark).coalesce(1).sortWithinPartitions("src").cache()
    n = container.write_containers(df, str(tmp_path), MAGIC, "test").collect()
    assert sum(r.splats for r in n) == 300
    back = {r.id: r for r in spark.read.format("splatpack").load(str(tmp_path)).collect()}
    for r in df.collect():
        b = back[r.src]
        assert b.tier == r.tier and b.sh_q8 == r.sh_q8 and abs(b.x - r.x) < 1e-5 and abs(b.sx - r.sx) < 4e-3 and abs(b.alpha - r.alpha) < 0.003
        assert abs(abs(b.qw * r.qw + b.qx * r.qx + b.qy * r.qy + b.qz * r.qz) - 1) < 1e-3
    few = spark.read.format("splatpack").schema("id bigint, tier int").load(str(tmp_path))
    assert few.groupBy("tier").count().count() == 3
    t = container.chunk_table(spark, f"{tmp_path}/*.pack").collect()
    assert {r.chunk_name for r in t} == set(container.CHUNKS)


def test_container_corruption(tmp_path):
    data = bytearray(container.pack(MAGIC, {"format": "t"}, [({"name": "tier_labels_u8"}, b"abc")]))
    p = tmp_path / "a.pack"
    p.write_bytes(data.replace(b'"crc32_raw": ', b'"crc32_raw": 1', 1).replace(bytes(data[11:19]), (int.from_bytes(data[11:19], "little") + 1).to_bytes(8, "little"), 1))
    _, m, at = container.read_manifest(str(p))
    with pytest.raises(ValueError, match="CRC"):
        container.read_chunk(str(p), m["chunks"][0], at)
    p.write_bytes(data[:25])
    with pytest.raises(ValueError, match="cut off"):
        container.read_manifest(str(p))


@pytest.mark.parametrize("kind", ["little", "big", "ascii"])
def test_ply(spark, tmp_path, kind):
    mesh.register(spark)
    xyz = np.array([[1, 2, 3], [4, 5, 6], [np.nan, 0, 0]], np.float32)
    if kind == "little":
        ply.write_ply(pa.table({c: xyz[:, i] for i, c in enumerate("xyz")} | {"red": np.array([1, 2, 255], np.uint8)}), str(tmp_path / "a.ply"))
    else:
        head = f"ply\nformat {'ascii' if kind == 'ascii' else 'binary_big_endian'} 1.0\ncomment c\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 0\nproperty list uchar int v\nend_header\n"
        rows = np.array([(*v, r) for v, r in zip(xyz, (1, 2, 255))], [("x", ">f4"), ("y", ">f4"), ("z", ">f4"), ("r", "u1")])
        body = rows.tobytes() if kind == "big" else "".join(f"{a} {b} {c} {r}\n" for (a, b, c), r in zip(xyz, (1, 2, 255))).encode()
        (tmp_path / "a.ply").write_bytes(head.encode() + body)
    df = spark.read.format("ply").option("finite", "true").load(str(tmp_path))
    assert [(r.id, r.x, r.z, r.red) for r in df.orderBy("id").collect()] == [(0, 1.0, 3.0, 1), (1, 4.0, 6.0, 2)]


def test_timeline(spark, tmp_path):
    d1 = timeline.encode_delta(b"DELTA\0\0\0", 7, 50, [(10, {"opacity": [0.5]}), (20, {"opacity": [0.25], "tier": [2], "neighbors": [1, 2, 3, 4]})])
    d2 = timeline.encode_delta(b"DELTA\0\0\0", 7, 50, [(20, {"opacity": [1.0]})])
    (tmp_path / "a.seq").write_bytes(timeline.encode_timeline(b"TIMELINE", 7, 50, [(-40, d1), (0, d2)]))
    rows = timeline.read_timelines(spark, str(tmp_path)).collect()
    assert {(r.frame, r.t_ms, r.id, r.attr, tuple(r.val)) for r in rows} == {(0, -40, 10, "opacity", (0.5,)), (0, -40, 20, "opacity", (0.25,)), (0, -40, 20, "tier", (2.0,)), (0, -40, 20, "neighbors", (1.0, 2.0, 3.0, 4.0)), (1, 0, 20, "opacity", (1.0,))}
    with pytest.raises(ValueError, match="monotone"):
        timeline.encode_timeline(b"TIMELINE", 7, 50, [(5, d1), (4, d2)])
    with pytest.raises(ValueError):
        timeline.decode_delta(d1[:-1] + b"", 3)


def test_side_chunk():
    a = np.arange(20, dtype="<u4").reshape(5, 4)
    data = timeline.side_chunk(a, aux=4)
    aux, back = timeline.read_side_chunk(data, "<u4", 4)
    assert aux == 4 and (back == a).all()
    with pytest.raises(ValueError, match="CRC"):
        timeline.read_side_chunk(data[:10] + b"\xff" + data[11:], "<u4", 4)
    with pytest.raises(ValueError, match="version"):
        timeline.read_side_chunk(b"\x09" + data[1:], "<u4", 4)


def test_obj_and_mtl(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nusemtl red\nf 1 2 3 4\nf -3/1 -2/2 -1/3\n")
    (tmp_path / "m.mtl").write_text("newmtl red\nKd 0.9 0.3 0.3\nNs 98\nTr 0.25\nnewmtl chrome\nPr 0.05\nPm 1\n")
    f = mesh.faces(mesh.lines(spark, str(tmp_path / "m.obj")))
    assert sorted((r.face, r.t, r.a, r.b, r.c) for r in mesh.triangles(f).collect()) == [(1, 1, 1, 2, 3), (1, 2, 1, 3, 4), (2, 1, 2, 3, 4)]
    m = {r.material: r for r in mesh.materials(mesh.lines(spark, str(tmp_path / "m.mtl"))).collect()}
    assert abs(m["red"].kd - 0.5) < 1e-9 and abs(m["red"].roughness - 0.1414) < 1e-3 and m["red"].alpha == 0.75 and m["chrome"].metallic == 1
