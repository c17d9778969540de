"""Time intelligence over a dense daily series.

The facts are summed per day first. What follows works on the calendar, 366 rows per year
whatever the facts hold, so windows in date order and joins on shifted dates stay small.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import month_start, quarter_start, year_start
from ..functions.ratios import relative_change

STARTS = {"year": year_start, "quarter": quarter_start, "month": month_start}
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def dense_daily(facts, calendar, day, value, name="value"):
    """One row per calendar day with the day's sum; NULL on days without facts. Facts without a
    calendar day follow under a blank date, apart from the dated ones in what is summed up."""
    daily = facts.groupBy(F.col(day).alias("_day")).agg(F.sum(value).alias(name))
    return (
        calendar.join(daily, F.col("Date") == F.col("_day"), "full")
        .select("Date", name)
    )


def to_date(series, period, value="value", day="Date", name="to_date"):
    """Cumulative sum from the start of the year, quarter or month up to each day."""
    window = (
        Window.partitionBy(STARTS[period](F.col(day)))
        .orderBy(day)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return series.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0.0)))


def _so_far(day):
    return (
        Window.partitionBy(F.col(day).isNull())
        .orderBy(day)
        .rowsBetween(Window.unboundedPreceding, 0)
    )


def running_total(series, value="value", day="Date", name="running_total"):
    """Sum of all days up to each day, across years."""
    window = _so_far(day)
    return series.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0.0)))


def by_period(facts, period, day, value, name="value"):
    return facts.groupBy(STARTS[period](F.col(day)).alias(period)).agg(F.sum(value).alias(name))


def with_previous(periods, period, months, value="value", name="previous"):
    """Attach the value of the period ``months`` earlier. An equi-join on the shifted start, as
    the row before need not be the period before."""
    earlier = periods.select(
        F.add_months(period, months).alias(period), F.col(value).alias(name)
    )
    return periods.join(earlier, period, "left")


def change(current, previous):
    return relative_change(F.col(current), F.col(previous))


def moving_average_months(series, months=3, value="value", day="Date", name="moving_average"):
    """Mean of the daily values in (day - months, day]; days without facts do not count.

    The difference of two cumulative sums, so each day needs one equi-join partner instead of
    a range of rows.
    """
    so_far = _so_far(day)
    cumulative = series.select(
        day,
        value,
        F.coalesce(F.sum(value).over(so_far), F.lit(0.0)).alias("_sum"),
        F.count(value).over(so_far).alias("_count"),
    )
    before = cumulative.select(
        F.col(day).alias("_before"),
        F.col("_sum").alias("_sum_before"),
        F.col("_count").alias("_count_before"),
    )
    return cumulative.join(
        before, F.add_months(F.col(day), -months) == F.col("_before"), "left"
    ).select(
        day,
        value,
        F.try_divide(
            F.col("_sum") - F.coalesce("_sum_before", F.lit(0.0)),
            F.col("_count") - F.coalesce("_count_before", F.lit(0)),
        ).alias(name),
    )
