import os

from cloudloom.plans import sizing


def test_buckets_follow_the_size_of_the_files(spark):
    path = "/root/testdata/sf0.1/splats.parquet"
    df = spark.read.parquet(path)
    size = os.path.getsize(path) if os.path.isfile(path) else sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    assert 0.5 * size < sizing.planned_bytes(df) < 2 * size
    small, large = sizing.bucket_count(df, target=1 << 20), sizing.bucket_count(df, target=1 << 14)
    assert large > 8 * small and sizing.bucket_count(df, df, target=1 << 14) > 1.9 * large - 2


def test_unknown_sizes_fall_back_on_partitions(spark):
    df = spark.range(3)
    assert sizing.bucket_count(df) == 2 * sizing.shuffle_partitions(df)
    assert sizing.small_enough(df, 3) and not sizing.small_enough(df, 2)
