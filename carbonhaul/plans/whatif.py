"""What-if parameters: every value of a slider applied to a frame of totals."""

from pyspark.sql import functions as F

# Fixed values of the sliders: first, last, step
ETS_PRICE = (50, 150, 1)
ETS_PRICE_CHART = (50, 150, 10)
FUEL_PRICE_CENTS = (100, 200, 5)
FLEET_SIZE = (20, 100, 5)
EFFICIENCY = (20, 35, 1)
DEFAULT_SCENARIO = "B"


def with_parameter(totals, limits, name):
    """Repeat each (already aggregated) row once per slider position, numbered from 1."""
    first, last, step = limits
    return totals.select(
        "*",
        F.posexplode(F.sequence(F.lit(first), F.lit(last), F.lit(step))).alias("_at", name),
    ).withColumn("parameter_order", F.col("_at") + 1).drop("_at")


def price_label(value):
    return F.format_string("€%d/t", value)


def fuel_price_label(cents):
    return F.concat(F.lit("€"), F.format_number(cents / 100, 2), F.lit("/L"))


def fleet_size_label(value):
    return F.format_string("%d vehicles", value)


def efficiency_label(value):
    return F.format_string("%d L/100km", value)


def selected_scenario(selection):
    """The chosen scenario, the default when nothing is chosen."""
    return F.coalesce(selection, F.lit(DEFAULT_SCENARIO))
