from pyspark.sql import functions as F

from parlance.functions import calendar as C


def _tags(spark, freq, today):
    t = spark.createDataFrame([(today,)], "d string").select(F.to_date("d").alias("today"))
    return [(r["tag"], r["dates_amount"]) for r in C.tag_calendar(freq, t).orderBy("tag").collect()]


def test_daily(spark):
    assert [t for t, _ in _tags(spark, "daily", "2021-02-02")] == ["2021-01-29", "2021-01-30", "2021-01-31", "2021-02-01"]


def test_weekly(spark):
    assert _tags(spark, "weekly", "2021-02-16") == [("2021-02-01 - 2021-02-07", 7), ("2021-02-08 - 2021-02-14", 7)]


def test_monthly(spark):
    assert _tags(spark, "monthly", "2021-04-10") == [("2021-02", 28), ("2021-03", 31)]


def test_before_epoch_is_empty(spark):
    assert _tags(spark, "daily", "2021-01-01") == []
