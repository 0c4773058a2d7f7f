from pyspark.sql import functions as F

from cloudloom.functions import shading as S
from cloudloom.operators import fits, light, matches, surfaces
from cloudloom.queries import archives as A, imaging as I

DATA = "/root/testdata/sf0.001"


def test_spanning_tree_of_greatest_weights(spark):
    e = spark.createDataFrame([(0, 1, 5), (1, 2, 9), (0, 2, 7), (2, 3, 1), (1, 3, 4), (8, 9, 99)], "a bigint, b bigint, w bigint")
    got = {(r.parent, r.child, r.w) for r in matches.spanning_tree(e).collect()}
    assert got == {(1, 2, 9), (2, 0, 7), (1, 3, 4)}
    assert matches.spanning_tree(e.limit(0)).count() == 0
    tree = I.spanning_tree(spark, DATA).collect()
    assert len({r.child for r in tree}) == len(tree)


def test_made_residuals_are_exact(spark):
    r = surfaces.residual_state(spark, 500)
    assert r.where(F.col("sh_q8") != F.zip_with("approx", "residual", lambda a, b: a + b)).count() == 0
    assert {x.tier for x in r.select("tier").distinct().collect()} == {0, 1, 2}


def test_more_codewords_lose_less(spark):
    rows = [(i, [((i * 7 + k * 13) % 41) - 20 for k in range(45)]) for i in range(400)]
    q = spark.createDataFrame(rows, "id int, q array<int>")
    few, many = ({r.g: r.rmse for r in fits.codebook_error(q, k).collect()} for k in (2, 16))
    assert all(many[g] < few[g] for g in range(3))


def test_flat_blobs_need_a_larger_budget(spark):
    budget, flat, germ = fits.matching_budget(surfaces.scene(spark, "saddle", 1500), 16, 256)
    assert budget > 16 and flat <= germ
    b = fits.blobs(surfaces.scene(spark, "saddle", 1500), 8)
    p = fits.blob_points(b, 16)
    assert p.count() == 16 * b.count() and p.where("abs(z - (x*x - y*y)) > 0.5").count() < 0.1 * p.count()


def test_archives_lose_nothing_and_renders_do(spark):
    assert all(r.rmse > 0 for r in A.render_error(spark, DATA).collect())
    sizes = A.variant_sizes(spark, DATA).collect()
    assert [r.bytes for r in sizes if r.best] == [min(r.bytes for r in sizes)]
    sweep = A.layout_sweep(spark, DATA).collect()
    assert all(r.exact for r in sweep) and [r.bytes for r in sweep] == sorted(r.bytes for r in sweep)


def test_composers_add_up(spark):
    row = (0.0, 1.0, 0.0, 0.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.04, 0.04, 0.04, 0.2, 0.6, 1.0, 1.0)
    names = [*light.N, *light.V, *light.A, *light.F0, "metallic", "roughness", "shadow", "ao"]
    d = spark.createDataFrame([row], ", ".join(f"{n} double" for n in names))
    env = S.Environment((0.0, -1.0, 0.0))

    def lit(*strengths):
        return light.with_bar2(d, (0.0, -1.0, 0.0), (0.5, 0.5, 0.5), env, "o", strengths=strengths).first()

    parts = [lit(0.3, 0.0, 0.0, 0.0), lit(0.0, 0.2, 0.0, 0.0), lit(0.0, 0.0, 0.2, 0.0)]
    whole = lit(0.3, 0.2, 0.2, 0.0)
    for c in "rgb":
        assert all(p[f"o_{c}"] > 0 for p in parts) and abs(sum(p[f"o_{c}"] for p in parts) - whole[f"o_{c}"]) < 1e-9
    three = light.with_three_lights(d, (0.0, 5.0, 5.0), (0.0, 0.0, 0.0), env, "t").first()
    assert all(three[f"t_{c}"] > 0 for c in "rgb")
