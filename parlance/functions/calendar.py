"""H16/H17 tag calendar: complete days, complete Monday weeks and complete months.

"Today" is data, not the wall clock: by default it is the day after the
newest post, derived by Spark from the posts themselves, so the calendar
grows with the corpus and is reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First day considered per frequency (fixed values).
EPOCHS = {"daily": "2021-01-29", "weekly": "2021-02-01", "monthly": "2021-02-01"}
VALID_FREQUENCIES = ("daily", "weekly", "monthly")


def check_frequency(frequency: str) -> str:
    if frequency not in VALID_FREQUENCIES:
        raise ValueError(f"frequency must be one of {VALID_FREQUENCIES}, got {frequency!r}")
    return frequency


def _empty_dates() -> Column:
    return F.array().cast("array<date>")


def tag_starts(frequency: str, today: Column) -> Column:
    """Array of the first dates of every complete tag before ``today``."""
    epoch = F.to_date(F.lit(EPOCHS[check_frequency(frequency)]))
    if frequency == "daily":
        last = F.date_sub(today, 1)
        return F.when(last >= epoch, F.sequence(epoch, last, F.expr("INTERVAL 1 DAY"))).otherwise(_empty_dates())
    if frequency == "weekly":
        monday = F.date_sub(today, F.weekday(today))
        last = F.date_sub(monday, 7)
        return F.when(last >= epoch, F.sequence(epoch, last, F.expr("INTERVAL 7 DAYS"))).otherwise(_empty_dates())
    last = F.add_months(F.trunc(today, "month"), -1)
    return F.when(last >= epoch, F.sequence(epoch, last, F.expr("INTERVAL 1 MONTH"))).otherwise(_empty_dates())


def tag_calendar(frequency: str, today_df: DataFrame) -> DataFrame:
    """``today_df`` has one column ``today`` (DATE).  Returns
    (frequency, tag, first_date, last_date, dates ARRAY<DATE>, dates_amount)."""
    starts = today_df.select(F.explode(tag_starts(frequency, F.col("today"))).alias("first_date"))
    first = F.col("first_date")
    if frequency == "daily":
        last = first
        tag = F.date_format(first, "yyyy-MM-dd")
    elif frequency == "weekly":
        last = F.date_add(first, 6)
        tag = F.concat(F.date_format(first, "yyyy-MM-dd"), F.lit(" - "), F.date_format(last, "yyyy-MM-dd"))
    else:
        last = F.last_day(first)
        tag = F.date_format(first, "yyyy-MM")
    dates = F.sequence(first, last, F.expr("INTERVAL 1 DAY"))
    return starts.select(F.lit(frequency).alias("frequency"), tag.alias("tag"), first.alias("first_date"),
                         last.alias("last_date"), dates.alias("dates"), F.size(dates).alias("dates_amount"))


def today_after_newest(posts: DataFrame, ts_col: str = "created_at") -> DataFrame:
    """One-row frame: the day after the newest post (all its days are then complete)."""
    return posts.agg(F.date_add(F.max(F.to_date(ts_col)), 1).alias("today"))


def tag_dates(calendar: DataFrame) -> DataFrame:
    """(frequency, tag, date) — one row per day of a tag."""
    return calendar.select("frequency", "tag", F.explode("dates").alias("date"))


def tag_calendar_sql(frequency: str, today_sql: str) -> str:
    """DuckDB twin; ``today_sql`` is a query giving one DATE."""
    today_sql = f"({today_sql})"
    epoch = f"DATE '{EPOCHS[check_frequency(frequency)]}'"
    if frequency == "daily":
        starts = f"generate_series({epoch}, ({today_sql}) - INTERVAL 1 DAY, INTERVAL 1 DAY)"
        last, tag = "first_date", "strftime(first_date, '%Y-%m-%d')"
    elif frequency == "weekly":
        monday = f"(({today_sql}) - CAST(isodow({today_sql}) - 1 AS INTEGER))"
        starts = f"generate_series({epoch}, {monday} - INTERVAL 7 DAY, INTERVAL 7 DAY)"
        last = "CAST(first_date + INTERVAL 6 DAY AS DATE)"
        tag = f"strftime(first_date, '%Y-%m-%d') || ' - ' || strftime({last}, '%Y-%m-%d')"
    else:
        starts = f"generate_series({epoch}, date_trunc('month', {today_sql}) - INTERVAL 1 MONTH, INTERVAL 1 MONTH)"
        last, tag = "last_day(first_date)", "strftime(first_date, '%Y-%m')"
    return f"""SELECT '{frequency}' AS frequency, {tag} AS tag, first_date, {last} AS last_date,
  CAST(date_diff('day', first_date, {last}) + 1 AS BIGINT) AS dates_amount
FROM (SELECT CAST(unnest({starts}) AS DATE) AS first_date)"""
