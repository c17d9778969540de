"""The allowance price curve and the prices selected from it."""

import math

from pyspark.sql import functions as F

from ..constants import DEFAULT_ETS_EUR_PER_T, DEFAULT_FUEL_EUR_PER_L
from ..functions.dates import month_start

# Fixed values of the curve: start, trend per month, seasonal amplitude, source limits in months
CURVE_START = "2025-01-01"
TREND_EUR_PER_MONTH = 0.5
SEASONAL_EUR = 5.0
MARKET_MONTHS = 12
FORECAST_MONTHS = 36
SEASONAL_FUEL_SHARE = 0.1


def price_curve_from_quotes(quotes):
    """Monthly settlement: trend + season + the deviation of the month's last quote.

    The last quote is found per day and then per month. Both maxima are over plain numbers, so
    they run as hash aggregates with partial results before the shuffle (a maximum over a struct
    would sort its input), and a month with very many quotes is no hot spot.
    """
    daily = quotes.groupBy("PriceMonth", "quote_date").agg(
        F.max_by("deviation", "quote_id").alias("deviation")
    )
    settled = daily.groupBy("PriceMonth").agg(
        F.max_by("deviation", F.unix_date("quote_date")).alias("deviation")
    )
    position = F.floor(F.months_between("PriceMonth", F.lit(CURVE_START).cast("date")))
    season = SEASONAL_EUR * F.sin(2 * math.pi * F.month("PriceMonth") / 12)
    return settled.select(
        "PriceMonth",
        F.round(
            DEFAULT_ETS_EUR_PER_T + TREND_EUR_PER_MONTH * position + season + F.col("deviation"),
            2,
        ).alias("EUR_per_t"),
        F.when(position < MARKET_MONTHS, "MARKET")
        .when(position < FORECAST_MONTHS, "FORECAST")
        .otherwise("SCENARIO")
        .alias("PriceSource"),
    )


def with_month_price(facts, curve, day, default=DEFAULT_ETS_EUR_PER_T, name="EUR_per_t"):
    """Attach the price of the fact's month, the default where the curve has none.

    The prices are grouped to one row per calendar month, so the broadcast side has twelve rows a
    year by construction and cannot multiply the facts.
    """
    prices = curve.groupBy(month_start(F.col("PriceMonth")).alias("_month")).agg(
        F.max("EUR_per_t").alias("_price")
    )
    return (
        facts.join(F.broadcast(prices), month_start(F.col(day)) == F.col("_month"), "left")
        .withColumn(name, F.coalesce("_price", F.lit(default)))
        .drop("_month", "_price")
    )


def selected_price(prices, default=DEFAULT_ETS_EUR_PER_T):
    """Aggregate: the price if the selection holds exactly one distinct value, else the default."""
    return F.when(
        F.count_distinct(prices) == 1, F.max(prices)
    ).otherwise(F.lit(default))


def mean_price(price="EUR_per_t"):
    """Aggregate: the mean as an exact decimal sum over the count, so that the result does not
    depend on the order in which partial sums arrive."""
    return F.try_divide(F.sum(F.col(price).cast("decimal(20,10)")).cast("double"), F.count(price))


def average_price(curve, default=DEFAULT_ETS_EUR_PER_T):
    """One row: the mean price of the curve, the default for an empty curve."""
    return curve.agg(F.coalesce(mean_price(), F.lit(default)).alias("avg_price"))


def volatility(curve):
    """Population standard deviation over mean."""
    return curve.agg(
        F.try_divide(F.stddev_pop("EUR_per_t"), F.avg("EUR_per_t")).alias("volatility")
    )


def seasonal_invoices(monthly):
    """One invoice per vehicle month: the litres at a fuel price that follows the season."""
    season = 1 + SEASONAL_FUEL_SHARE * F.sin(2 * math.pi * F.month("InvoiceMonth") / 12)
    return monthly.select(
        "VIN",
        "InvoiceMonth",
        F.col("litres").alias("Litres"),
        (F.col("litres") * DEFAULT_FUEL_EUR_PER_L * season).alias("EUR_Amount"),
    )
