"""How many buckets, and whether a side may be broadcast: from sizes, not habit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

MB = 1 << 20


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate (file sizes carried through the plan); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # a number or its Java object, by version


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def bucket_count(*frames: DataFrame, target: int = 8 * MB, swell: float = 3.0, least: int = 0) -> int:
    """Hash buckets such that one bucket of all ``frames`` holds about ``target`` bytes.

    Estimates of file scans are compressed bytes, hence ``swell``. At least two
    buckets stand for each shuffle partition, so no partition waits for one bucket.
    The estimate is capped at 2**24 buckets (Catalyst may answer "unknown" with 2**63).
    """
    total = sum(planned_bytes(f) for f in frames)
    wanted = math.ceil(min(total, 1 << 50) * swell / target) if total < 1 << 60 else 0
    return int(min(1 << 24, max(wanted, 2 * shuffle_partitions(frames[0]), least, 1)))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than rows + 1 of them."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows
