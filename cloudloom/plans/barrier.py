"""Keeping a dear expression from being copied into the filters above it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def settled(df: DataFrame) -> DataFrame:
    """The same rows and columns, evaluated here once.

    Catalyst copies the definition of a column into every filter it pushes below a
    projection; chained matrix products grow exponentially that way. A filter on the
    output of a generator stays above it, and an inline of one struct is generated code.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
