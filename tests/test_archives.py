import numpy as np
import pytest

from cloudloom.queries import archives as A
from cloudloom.sources import cells, container as C, layouts as L, mesh, pictures as P

from test_sources import splats


def table(spark, n=300):
    return splats(spark, n).drop("src").toArrow()


@pytest.mark.parametrize("kind,exact", [("plain", True), ("codebook", False), ("render", False), ("archive", True), ("payload", True)])
def test_every_kind_is_read_in_ranges(spark, tmp_path, kind, exact):
    mesh.register(spark)
    t = table(spark)
    (tmp_path / "a.pack").write_bytes(C.make_container(t, b"SPLATPAK", kind, A.book()))
    df = spark.read.format("splatpack").option("rowsPerPartition", 70).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 5
    rows = df.select("id", "tier", "x", "sh_q8", "sh_rest", "nx").orderBy("id").collect()
    want = t.column("sh_q8").to_pylist()
    assert [r.id for r in rows] == list(range(300)) and all(r.nx is None for r in rows)
    assert ([r.sh_q8 for r in rows] == want) == exact
    assert [r.tier for r in rows] == t.column("tier").to_pylist()
    assert np.allclose(rows[7].sh_rest, np.array(rows[7].sh_q8) * 0.006946287755891094, atol=1e-6)


def test_damage_and_foreign_files(spark, tmp_path):
    mesh.register(spark)
    data = bytearray(C.make_container(table(spark), b"SPLATPAK", "archive", A.book()))
    p = tmp_path / "a.pack"
    data[-40] ^= 255
    p.write_bytes(data)
    with pytest.raises(Exception, match="CRC|decompress|Error -3"):
        spark.read.format("splatpack").schema("sh_q8 array<int>").load(str(tmp_path)).collect()
    with pytest.raises(ValueError, match="no container"):
        C.version_of(b"SPLATPAK31\0")


def test_trailers_keep_the_rest_and_columns_are_stamped_in_place(spark, tmp_path):
    mesh.register(spark)
    t, rng = table(spark), np.random.default_rng(3)
    p = str(tmp_path / "a.pack")
    base = C.make_container(t, b"SPLATPAK", "archive", A.book())
    open(p, "wb").write(base)
    n = rng.normal(size=(300, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    edges = rng.integers(0, 300, (300, 4))
    mat = {c: rng.integers(0, 256, 300) for c in ("hint", "confidence", "view_dep", "mip")}
    C.append_trailer(p, 31, {"normals_oct24_tangent8": C.encode_side("normals_oct24_tangent8", {"nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "tangent": np.linspace(0, 6, 300)}), "edges_knn_u32": C.encode_side("edges_knn_u32", {"neighbors": edges}), "material_u8x4": C.encode_side("material_u8x4", mat)})
    germ = rng.normal(size=(300, 5)) * 0.1
    C.append_trailer(p, 40, {"kappa_u8": C.encode_side("kappa_u8", {"kappa": np.full(300, 0.25)}), "cusp_u8": C.encode_side("cusp_u8", {"cusp": np.full(300, 0.5)}), "germ_f16x5": C.encode_side("germ_f16x5", {"germ": germ})})
    size = len(open(p, "rb").read())
    C.restamp(p, "mip", np.arange(300) % 256)
    now = open(p, "rb").read()
    assert now.startswith(base) and len(now) == size
    with pytest.raises(ValueError, match="already"):
        C.append_trailer(p, 40, {})
    rows = spark.read.format("splatpack").option("rowsPerPartition", 128).load(str(tmp_path)).orderBy("id").collect()
    assert [r.neighbors for r in rows] == edges.tolist() and [r.hint for r in rows] == mat["hint"].tolist() and [r.mip for r in rows] == [i % 256 for i in range(300)]
    assert min(np.dot((r.nx, r.ny, r.nz), n[r.id]) for r in rows) > 0.9999
    assert abs(rows[5].kappa - 0.25) < 0.003 and abs(rows[5].cusp - 0.5) < 0.005 and np.abs(np.array([r.germ for r in rows]) - germ).max() < 1e-3


@pytest.mark.parametrize("top", [60, 255])
@pytest.mark.parametrize("name", list(L.LAYOUTS))
def test_layouts_give_residuals_back(name, top):
    rng = np.random.default_rng(29)
    r = np.clip(np.rint(rng.laplace(0, 3 if top == 60 else 60, (500, 45))), -top, top).astype(np.int16)
    xyz, tier = rng.normal(size=(500, 3)), rng.integers(0, 3, 500)
    raw, meta = L.encode(name, r, xyz, tier)
    assert np.array_equal(L.decode(raw, meta, xyz, tier), r)
    for c in L.CODECS:
        assert L.decompress(c, L.compress(c, raw)) == raw
    raw, meta = L.encode(name, r[:0], xyz[:0], tier[:0])
    assert L.decode(raw, meta, xyz[:0], tier[:0]).shape == (0, 45)


def test_pictures(spark, tmp_path):
    a = np.random.default_rng(0).random((5, 7, 3))
    (tmp_path / "a.png").write_bytes(P.png_bytes(a))
    np.save(tmp_path / "b.npy", a)
    back = P.png_pixels((tmp_path / "a.png").read_bytes())
    assert np.abs(back - a).max() < 1 / 255
    df = P.read_pictures(spark, f"{tmp_path}/*")
    assert df.count() == 70 and abs(df.where("file LIKE '%npy' AND y = 2 AND x = 3").first().g - a[2, 3, 1]) < 1e-12
    assert P.mosaic([a, a]).shape == (5, 18, 3)
    with pytest.raises(ValueError, match="CRC"):
        P.png_pixels(P.png_bytes(a)[:40] + b"\xff" + P.png_bytes(a)[41:])


def test_cells_from_uneven_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("grid,cell_key,count,color_std\n32,1,5,0.5\n32,1,9,0.1\n16,2,1,1\nx,3,1,1\n32,4,many,0.25\n")
    (tmp_path / "b.csv").write_text("grid,cell_key,count,color_std\n32,1,7,0.7\n32,5, 3 ,\n")
    got = {r.cell_key: r for r in cells.read_cells(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "4", "5"} and got["1"]["count"] == 5.0 and got["4"]["count"] is None and got["5"]["count"] == 3.0 and got["5"].eig2 is None
