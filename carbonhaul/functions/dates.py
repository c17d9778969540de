"""Calendar expressions."""

from pyspark.sql import functions as F


def month_start(day):
    return F.trunc(day, "month")


def quarter_start(day):
    return F.trunc(day, "quarter")


def year_start(day):
    return F.trunc(day, "year")


def months_crossed(first, last):
    """Month boundaries between two moments (Jan 31 to Feb 1 counts one)."""
    return (F.year(last) * 12 + F.month(last)) - (F.year(first) * 12 + F.month(first))


def days_crossed(first, last):
    """Day boundaries between two moments."""
    return F.date_diff(F.to_date(last), F.to_date(first))


def calendar(spark, first, last):
    """One row per day of a fixed calendar: 366 rows per year, whatever the facts hold."""
    return _days(
        spark.range(1).select(
            F.lit(first).cast("date").alias("first"), F.lit(last).cast("date").alias("last")
        )
    )


def calendar_of(facts, day, first, last):
    """The calendar from ``first`` to ``last``, and the whole other years in which facts have a day.

    Years without facts beyond it are left out, so a stray year adds 366 rows.
    """
    fixed = calendar_years(facts.sparkSession, first, last)
    found = facts.where(F.col(day).isNotNull()).select(F.year(day).alias("year")).distinct()
    return _days(
        fixed.unionByName(found).distinct().select(
            F.make_date("year", F.lit(1), F.lit(1)).alias("first"),
            F.make_date("year", F.lit(12), F.lit(31)).alias("last"),
        )
    )


def calendar_years(spark, first, last):
    """The years of a fixed calendar of whole years."""
    return spark.range(int(first[:4]), int(last[:4]) + 1).select(F.col("id").cast("int").alias("year"))


def _days(ends):
    days = ends.select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("Date")
    )
    return days.select(
        "Date",
        F.year("Date").cast("bigint").alias("Year"),
        F.concat(F.lit("Q"), F.quarter("Date").cast("string")).alias("Quarter"),
        F.month("Date").cast("bigint").alias("Month"),
        F.date_format("Date", "MMMM").alias("MonthName"),
        F.dayofweek("Date").cast("bigint").alias("DayOfWeek"),
    )
