"""Profiles merged from daily sketches."""

from pyspark.sql import functions as F

from gatewise.operators import daily


def _rows(spark, rows):
    made = spark.createDataFrame(rows, "user_id bigint, ip string, ts string, rtt double, is_attack_ip boolean, is_ato boolean")
    return made.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_days_are_merged_replaced_and_pruned(spark, tmp_path):
    path = str(tmp_path / "days")
    one = [(u, f"10.0.0.{u % 9}", f"2024-01-01 {u % 24:02}:00:00", float(u), u % 10 == 0, False) for u in range(500)]
    two = [(u, None, "2024-01-02 01:00:00", None, None, True) for u in range(400, 700)]
    daily.add_days(_rows(spark, one[:100]), path)  # an unfinished day, replaced below
    daily.add_days(_rows(spark, one), path)
    daily.add_days(_rows(spark, [*two, (1, "x", None, 3.0, False, False)]), path)
    whole = daily.merged_profile(spark, path).first()
    assert (whole.total_rows, whole.attack_rows, whole.ato_rows) == (801, 50, 300)
    assert abs(whole.unique_users - 700) <= 21 and abs(whole.unique_ips - 10) <= 1 and abs(whole.median_rtt - 250) <= 15
    second = daily.merged_profile(spark, path, "2024-01-02", "2024-01-05")
    row = second.first()
    assert (row.total_rows, row.ato_rows, row.unique_ips, row.median_rtt) == (300, 300, 0, None)
    plan = second._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_nothing(spark, tmp_path):
    path = str(tmp_path / "days")
    daily.add_days(_rows(spark, [(1, "x", "2024-01-01 00:00:00", 1.0, False, False)]), path)
    row = daily.merged_profile(spark, path, "2025-01-01").first()
    assert (row.total_rows, row.unique_users, row.min_ts, row.median_rtt) == (0, 0, None, None)
