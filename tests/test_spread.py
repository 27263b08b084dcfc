"""Scans whose rows lie in few tasks."""

from pyspark.sql import functions as F

from faultline.session import MOST_ROWS, spread


def rows_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]


def test_a_row_group_under_many_splits_is_dealt_out(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(40_000).selectExpr("id", "sha2(string(id), 256) as text").coalesce(1).write.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() > cores and len(rows_by_task(scan)) == 1
        dealt = spread(scan)
        assert max(rows_by_task(dealt)) <= 2 * 40_000 / cores
        assert dealt.exceptAll(scan).count() == 0 and dealt.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_even_and_empty_scans_stay(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    path = str(tmp_path / "many.parquet")
    spark.range(0, 8_000, 1, 4 * cores).write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 20))
    try:
        scan = spark.read.parquet(path)
        assert spread(scan) is scan
        assert spread(scan.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_even_scans_of_many_rows_a_task_are_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    path = str(tmp_path / "narrow.parquet")
    rows = (MOST_ROWS + 20_000) * 2 * cores
    spark.range(0, rows, 1, 2 * cores).write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 20))
    try:
        scan = spark.read.parquet(path)
        assert 2 * cores * max(rows_by_task(scan)) <= 1.1 * rows
        dealt = rows_by_task(spread(scan))
        assert max(dealt) <= MOST_ROWS / 2 and sum(dealt) == rows
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
