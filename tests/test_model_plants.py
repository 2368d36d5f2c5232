"""Planted anomalies lie outside the data, however many logins its users have."""

from gatewise.plans import queries


def test_plants_lie_outside_of_busy_tables(spark):
    least = {"rapid_login_rate": 400, "login_frequency_today": 4000}
    busy = spark.createDataFrame([(3, 90_000), (900, 5)], "rapid_login_rate bigint, login_frequency_today bigint")
    assert queries._far_outside(busy, least) == {"rapid_login_rate": 9000, "login_frequency_today": 900_000}
    assert queries._far_outside(busy.where("false"), least) == least
