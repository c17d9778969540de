"""Fleet, emission and cost measures.

A measure is a projection over additive parts. Any number of measures is evaluated with one
``groupBy().agg()`` of the parts they share, under an explicit filter context and for any
grouping, so nothing but column expressions reaches Spark.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    DEFAULT_ETS_EUR_PER_T,
    EFFICIENCY_TARGET,
    INDUSTRY_BENCHMARK,
    POSSIBLE_TRIPS_PER_DAY,
)
from ..functions import display
from ..functions.dates import days_crossed, months_crossed
from ..functions.ratios import co2_kg, co2_t, divide

TRIP_PARTS: dict[str, Callable[[], Column]] = {
    "trips": lambda: F.count(F.lit(1)),
    "vehicles": lambda: F.count_distinct("VIN"),
    "km": lambda: F.sum("Distance_km"),
    "litres": lambda: F.sum("Fuel_l"),
    "seconds": lambda: F.sum(
        F.expr("timestampdiff(SECOND, StartTimeUTC, EndTimeUTC)")
    ),
    "first_start": lambda: F.min("StartTimeUTC"),
    "last_start": lambda: F.max("StartTimeUTC"),
}


@dataclass(frozen=True)
class Measure:
    """``expr`` receives the price column and may use the named parts as columns."""

    parts: tuple
    expr: Callable[[Column], Column]


def _days():
    return days_crossed(F.col("first_start"), F.col("last_start"))


def _efficiency():
    return divide(F.col("litres"), F.col("km") / 100)


def _compliance():
    actual = _efficiency()
    return F.when(actual <= EFFICIENCY_TARGET, 1.0).otherwise(EFFICIENCY_TARGET / actual)


def _annual_co2():
    return divide(co2_t(F.col("litres")), _days()) * 365


SPAN = ("first_start", "last_start")

MEASURES: dict[str, Measure] = {
    "total_trips": Measure(("trips",), lambda p: F.col("trips")),
    "fleet_size": Measure(("vehicles",), lambda p: F.col("vehicles")),
    "total_distance_km": Measure(("km",), lambda p: F.col("km")),
    "avg_distance_per_trip": Measure(
        ("km", "trips"), lambda p: divide(F.col("km"), F.col("trips"))
    ),
    "total_fuel_l": Measure(("litres",), lambda p: F.col("litres")),
    "efficiency_l_100km": Measure(("litres", "km"), lambda p: _efficiency()),
    "avg_trip_hours": Measure(
        ("seconds", "trips"), lambda p: F.try_divide("seconds", "trips") / 3600
    ),
    "co2_kg": Measure(("litres",), lambda p: co2_kg(F.col("litres"))),
    "co2_t": Measure(("litres",), lambda p: co2_t(F.col("litres"))),
    "co2_per_km_g": Measure(
        ("litres", "km"), lambda p: divide(co2_kg(F.col("litres")) * 1000, F.col("km"))
    ),
    "ets_cost_eur": Measure(("litres",), lambda p: co2_t(F.col("litres")) * p),
    "ets_cost_per_km": Measure(
        ("litres", "km"), lambda p: divide(co2_t(F.col("litres")) * p, F.col("km"))
    ),
    "annual_co2_t": Measure(("litres", *SPAN), lambda p: _annual_co2()),
    "annual_ets_cost_eur": Measure(("litres", *SPAN), lambda p: _annual_co2() * p),
    "fleet_utilization": Measure(
        ("trips", "vehicles", *SPAN),
        lambda p: divide(
            F.col("trips"), F.col("vehicles") * _days() * POSSIBLE_TRIPS_PER_DAY
        ),
    ),
    "trips_per_vehicle_day": Measure(
        ("trips", "vehicles", *SPAN),
        lambda p: divide(F.col("trips"), F.col("vehicles") * _days()),
    ),
    "compliance_rate": Measure(("litres", "km"), lambda p: _compliance()),
    "vs_industry_benchmark": Measure(
        ("litres", "km"),
        lambda p: (INDUSTRY_BENCHMARK - _efficiency()) / INDUSTRY_BENCHMARK,
    ),
    "compliance_risk_score": Measure(
        ("litres", "km"), lambda p: display.compliance_risk(_compliance())
    ),
    "compliance_status": Measure(
        ("litres", "km"), lambda p: display.compliance_status(_compliance())
    ),
    "days_in_data": Measure(SPAN, lambda p: _days()),
    "months_in_data": Measure(
        SPAN, lambda p: months_crossed(F.col("first_start"), F.col("last_start"))
    ),
}


@dataclass(frozen=True)
class FilterContext:
    """The selections in force. Conditions on one fact reach the other through the vehicles."""

    trips: Column | None = None
    invoices: Column | None = None
    first_day: str | None = None
    last_day: str | None = None

    def on_trips(self, trips: DataFrame, invoices: DataFrame | None = None) -> DataFrame:
        out = trips
        if self.first_day is not None:
            out = out.where(F.col("TripDate") >= F.lit(self.first_day).cast("date"))
        if self.last_day is not None:
            out = out.where(F.col("TripDate") <= F.lit(self.last_day).cast("date"))
        if self.trips is not None:
            out = out.where(self.trips)
        if self.invoices is not None:
            if invoices is None:
                raise ValueError("the context filters invoices, which were not given")
            out = with_partner_vehicle(out, invoices.where(self.invoices))
        return out

    def on_invoices(self, invoices: DataFrame, trips: DataFrame | None = None) -> DataFrame:
        out = invoices if self.invoices is None else invoices.where(self.invoices)
        if self.trips is not None or self.first_day is not None or self.last_day is not None:
            if trips is None:
                raise ValueError("the context filters trips, which were not given")
            own = FilterContext(self.trips, None, self.first_day, self.last_day)
            out = with_partner_vehicle(out, own.on_trips(trips))
        return out


def with_partner_vehicle(df, other):
    """Rows whose vehicle occurs in ``other``.

    The many-to-many relationship between the facts is a semi join, never a row-multiplying
    join. The vehicles of the other side are made distinct before the shuffle.
    """
    return df.join(other.select("VIN").distinct(), "VIN", "left_semi")


def evaluate(trips, names, by=(), price=DEFAULT_ETS_EUR_PER_T, keep_parts=False):
    """One row per group with the named measures.

    ``by`` holds column names or aliased columns; ``price`` is a number or a column of the group.
    """
    by = list(by)
    parts = list(dict.fromkeys(p for n in names for p in MEASURES[n].parts))
    grouped = trips.groupBy(*by).agg(*[TRIP_PARTS[p]().alias(p) for p in parts])
    groups = [c for c in grouped.columns if c not in parts]
    price = price if isinstance(price, Column) else F.lit(price)
    kept = parts if keep_parts else []
    return grouped.select(
        *groups, *kept, *[MEASURES[n].expr(price).alias(n) for n in names]
    )


def fuel_cost(invoices, by=()):
    """Invoice totals and the mean price per litre."""
    grouped = invoices.groupBy(*by).agg(
        F.sum("EUR_Amount").alias("fuel_cost_eur"), F.sum("Litres").alias("invoiced_litres")
    )
    return grouped.withColumn(
        "avg_fuel_price_eur_l", divide(F.col("fuel_cost_eur"), F.col("invoiced_litres"))
    )


def fuel_cost_per_km(trips, invoices, by):
    """Two facts, each aggregated to the group before they meet."""
    km = trips.groupBy(*by).agg(F.sum("Distance_km").alias("total_distance_km"))
    joined = km.join(fuel_cost(invoices, by), list(by), "full_outer")
    return joined.withColumn(
        "fuel_cost_per_km", divide(F.col("fuel_cost_eur"), F.col("total_distance_km"))
    )


def co2_by_month_of_year(trips):
    """Month 1 to 12; the years are merged."""
    return trips.groupBy(F.month("StartTimeUTC").alias("month_no")).agg(
        co2_t(F.sum("Fuel_l")).alias("co2_t")
    )


def vehicle_month(trips):
    """Vehicle and calendar month totals, the grain at which the facts may be joined."""
    return trips.groupBy("VIN", F.trunc("TripDate", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum("Distance_km").alias("km"),
        F.sum("Fuel_l").alias("litres"),
    )


def fleet_size_approx(trips, by=(), rsd=0.02):
    return trips.groupBy(*by).agg(
        F.approx_count_distinct("VIN", rsd).alias("fleet_size_approx")
    )


def fleet_size_check(trips, rsd=0.02):
    """The exact fleet size, and whether the sketch lies within three of its deviations."""
    # a sketch of the distinct values is that of all rows
    both = trips.select("VIN").distinct().agg(
        F.count("VIN").alias("fleet_size"),
        F.approx_count_distinct("VIN", rsd).alias("fleet_size_approx"),
    )
    near = F.abs(F.col("fleet_size_approx") - F.col("fleet_size")) <= 3 * rsd * F.col("fleet_size")
    return both.select("fleet_size", near.alias("sketch_is_near"))
