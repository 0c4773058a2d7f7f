"""OBJ meshes and MTL materials as tables, from text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, line): numbered by one task a file, since meaning depends on what stands before."""
    t = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return t.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("no", "line")).select("file", "no", F.trim("line").alias("line"))


def vertices(src: DataFrame) -> DataFrame:
    """(file, v, x, y, z): vertices numbered from 1."""
    p = F.split("line", r"\s+")
    v = src.where(F.col("line").startswith("v "))
    return v.select("file", F.row_number().over(W.partitionBy("file").orderBy("no")).alias("v"), *[p[i + 1].try_cast("double").alias(c) for i, c in enumerate("xyz")])


def faces(src: DataFrame) -> DataFrame:
    """(file, face, corners ARRAY<INT>, material): n-gons; negative indices count back from the latest vertex."""
    w = W.partitionBy("file").orderBy("no")
    is_mat = F.when(F.col("line").startswith("usemtl "), F.trim(F.expr("substring(line, 8)")))
    t = src.withColumn("material", F.last(is_mat, ignorenulls=True).over(w)).withColumn("seen", F.count_if(F.col("line").startswith("v ")).over(w))
    f = t.where(F.col("line").startswith("f "))
    corner = F.transform(F.filter(F.slice(F.split("line", r"\s+"), F.lit(2), F.size(F.split("line", r"\s+"))), lambda c: c != ""), lambda c: F.split(c, "/")[0].try_cast("int"))
    f = f.withColumn("corners", F.transform(corner, lambda c: F.when(c < 0, F.col("seen").cast("int") + c + 1).otherwise(c)))
    return f.select("file", F.row_number().over(w).alias("face"), "corners", "material")


def triangles(f: DataFrame) -> DataFrame:
    """(file, face, t, a, b, c, material): fans; an n-gon gives n - 2."""
    c = F.col("corners")
    fan: Column = F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda i: F.struct(i.alias("t"), c[0].alias("a"), F.get(c, i).alias("b"), F.get(c, i + 1).alias("c")))
    return f.where(F.size(c) >= 3).select("file", "face", "material", F.inline(fan))


def materials(src: DataFrame) -> DataFrame:
    """(file, material, kd, ks, roughness, metallic, alpha, kd_rgb, ks_rgb, ke_rgb, illum): kd and ks are grey means; null where a file names none."""
    w = W.partitionBy("file").orderBy("no")
    name = F.when(F.col("line").startswith("newmtl "), F.trim(F.expr("substring(line, 8)")))
    t = src.withColumn("material", F.last(name, ignorenulls=True).over(w)).where(F.col("material").isNotNull())
    p = F.split("line", r"\s+")

    def grey(key: str) -> Column:
        return F.max(F.when(p[0] == key, (p[1].try_cast("double") + F.coalesce(F.get(p, F.lit(2)), p[1]).try_cast("double") + F.coalesce(F.get(p, F.lit(3)), p[1]).try_cast("double")) / 3))

    def rgb(key: str) -> Column:
        return F.max(F.when(p[0] == key, F.array(p[1].try_cast("double"), F.coalesce(F.get(p, F.lit(2)), p[1]).try_cast("double"), F.coalesce(F.get(p, F.lit(3)), p[1]).try_cast("double")))).alias(f"{key.lower()}_rgb")

    one = lambda key: F.max(F.when(p[0] == key, F.get(p, F.lit(1)).try_cast("double")))
    return t.groupBy("file", "material").agg(grey("Kd").alias("kd"), grey("Ks").alias("ks"), F.coalesce(one("Pr"), F.sqrt(2 / (one("Ns") + 2))).alias("roughness"), F.coalesce(one("Pm"), F.lit(0.0)).alias("metallic"), F.coalesce(one("d"), 1 - one("Tr"), F.lit(1.0)).alias("alpha"), rgb("Kd"), rgb("Ks"), rgb("Ke"), one("illum").cast("int").alias("illum"))


def register(spark: SparkSession) -> None:
    """Makes "splatpack" and "ply" known to spark.read."""
    from cloudloom.sources.container import SplatPack
    from cloudloom.sources.ply import Ply

    spark.dataSource.register(SplatPack)
    spark.dataSource.register(Ply)
