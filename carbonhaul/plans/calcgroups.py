"""Calculation items: rewrites of a measure that has been evaluated per group."""

from pyspark.sql import functions as F

from ..functions.ratios import divide
from ..operators import ordering
from ..session import materialized

BUDGET_FACTOR = 1.1  # the budget lies ten percent above the actual value
LOW_BAND = 0.8


def variance(df, measure):
    """Actual, budget, variance and variance in percent of the budget."""
    actual = F.col(measure)
    budget = actual * BUDGET_FACTOR
    return df.select(
        *[c for c in df.columns if c != measure],
        actual.alias("actual"),
        budget.alias("budget"),
        (actual - budget).alias("variance"),
        divide(actual - budget, budget).alias("variance_pct"),
    )


def per_unit(df, measure):
    """The measure per vehicle, 100 km, trip, day and month; ``df`` carries the unit columns."""
    value = F.col(measure)
    return df.select(
        *[c for c in df.columns if c not in UNITS],
        divide(value, F.col("fleet_size")).alias("per_vehicle"),
        divide(value, F.col("total_distance_km") / 100).alias("per_100km"),
        divide(value, F.col("total_trips")).alias("per_trip"),
        divide(value, F.col("days_in_data")).alias("per_day"),
        divide(value, F.col("months_in_data")).alias("per_month"),
    )


UNITS = ("fleet_size", "total_distance_km", "total_trips", "days_in_data", "months_in_data")


def bands(df, measure, threshold):
    """Green, yellow and red columns; blank outside the band. ``threshold`` is an argument."""
    value, high = F.col(measure), F.lit(threshold)
    low = high * LOW_BAND
    return df.select(
        "*",
        F.when(value >= high, value).alias("green"),
        F.when((value >= low) & (value < high), value).alias("yellow"),
        F.when(value < low, value).alias("red"),
    )


def rank(df, measure, name="rank"):
    """Competition rank, largest first."""
    return ordering.rank(df, measure, name=name)


def share_of_total(df, measure, name="share"):
    """Each group's part of the total, which is summed from the groups and enters as a scalar."""
    total = df.agg(F.sum(measure)).scalar()
    return df.select("*", divide(F.col(measure), total).alias(name))


def over_groups(df, measure):
    """Sum, mean, extremes, exact median and population deviation over the groups' values."""
    df = materialized(df)
    middle = ordering.median(df, measure).scalar()
    return df.agg(
        F.sum(measure).alias("sum"),
        F.avg(measure).alias("average"),
        F.min(measure).alias("minimum"),
        F.max(measure).alias("maximum"),
        F.stddev_pop(measure).alias("std_dev"),
    ).select("*", middle.alias("median"))


def scenario_columns(df, measure, ids=("A", "B", "C"), by=()):
    """One column per scenario plus the greatest and least of them."""
    pivoted = df.groupBy(*by).agg(
        *[F.sum(F.when(F.col("ScenarioID") == i, F.col(measure))).alias(f"scenario_{i.lower()}")
          for i in ids]
    )
    columns = [f"scenario_{i.lower()}" for i in ids]
    return pivoted.select(
        "*",
        F.greatest(*columns).alias("best_scenario"),
        F.least(*columns).alias("worst_scenario"),
    )
