"""Candidate cells from CSV files of uneven quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Numbers of a cell (fixed names of the format).
NUMBERS = ("count", "phox_norm_r95", "phox_norm_diag", "color_std", "opacity_std", "scale_std", "improvement", "eig2", "center_x", "center_y", "center_z")


def read_cells(spark: SparkSession, path: str, grid: int = 32) -> DataFrame:
    """(cell_key, file, numbers...): cells of one grid; what is no number is null, absent columns too.

    Of a key that comes more than once the first row of the first file counts.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path).withColumns({"__file": F.input_file_name(), "__no": F.monotonically_increasing_id()})
    cols = [(F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)") if c in raw.columns else F.lit(None).cast("double")).alias(c) for c in NUMBERS]
    some = raw.where(F.expr("try_cast(grid AS INT)") == grid).where(F.col("cell_key").isNotNull())
    first = F.row_number().over(W.partitionBy("cell_key").orderBy("__file", "__no"))
    return some.select("cell_key", F.col("__file").alias("file"), *cols, first.alias("__n")).where("__n = 1").drop("__n")
