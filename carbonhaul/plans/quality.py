"""Checks over loaded tables."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions.ratios import co2_kg, divide
from .pricing import mean_price


def trip_range(trips):
    return trips.agg(
        F.min("StartTimeUTC").alias("min_date"),
        F.max("EndTimeUTC").alias("max_date"),
        F.count_distinct("VIN").alias("unique_vehicles"),
    )


def fuel_totals(invoices):
    """The distinct counts run over vehicle-month pairs, the grain of the table, so that the
    two-way expansion of a double distinct does not multiply the invoice rows."""
    pairs = invoices.groupBy("VIN", "InvoiceMonth").agg(
        F.sum("Litres").alias("litres"), F.sum("EUR_Amount").alias("eur")
    )
    return pairs.agg(
        F.count_distinct("VIN").alias("vehicles_with_fuel_data"),
        F.count_distinct("InvoiceMonth").alias("months_with_data"),
        F.sum("litres").alias("total_litres"),
        F.sum("eur").alias("total_eur"),
    )


def price_range(curve):
    return curve.agg(
        F.count(F.lit(1)).alias("months"),
        F.min("PriceMonth").alias("first_month"),
        F.max("PriceMonth").alias("last_month"),
        mean_price().alias("avg_price"),
        F.min("EUR_per_t").alias("min_price"),
        F.max("EUR_per_t").alias("max_price"),
    )


def missing_dates(trips):
    return trips.agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_if(F.col("TripDate").isNull()).alias("null_trip_dates"),
    )


def co2_accuracy(trips, tolerance=1e-9):
    """Emissions summed per trip against emissions of the summed fuel."""
    both = trips.agg(
        F.sum(co2_kg(F.col("Fuel_l"))).alias("by_trip_kg"),
        co2_kg(F.sum("Fuel_l")).alias("by_total_kg"),
    )
    gap = F.abs(F.col("by_trip_kg") - F.col("by_total_kg"))
    return both.withColumn("accurate", gap <= tolerance * F.abs(F.col("by_total_kg")))


def orphans(left, right, keys, labels):
    """Distinct keys that one side alone has: (missing_in, keys), from one aggregation over both.

    ``labels`` name the side that a key of the left, and of the right, is missing in. NULL equals nothing.
    """
    sides = left.select(*keys, F.lit(0).alias("_side")).unionByName(
        right.select(*keys, F.lit(1).alias("_side"))
    )
    found = sides.groupBy(*keys).agg(F.min("_side").alias("_low"), F.max("_side").alias("_high"))
    unlike = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    alone = (F.col("_low") == F.col("_high")) | unlike
    missing = F.array_compact(F.array(
        F.when(alone & (F.col("_low") == 0), labels[0]), F.when(alone & (F.col("_high") == 1), labels[1])
    ))
    return found.select(F.explode(missing).alias("missing_in"), *keys)


def fuel_reconciliation(consumed, invoiced, tolerance=0.05):
    """Consumed against invoiced litres per vehicle and month; both sides aggregated first."""
    bought = invoiced.groupBy("VIN", "InvoiceMonth").agg(F.sum("Litres").alias("invoiced_l"))
    joined = consumed.select(
        "VIN", "InvoiceMonth", F.col("litres").alias("consumed_l")
    ).join(bought, ["VIN", "InvoiceMonth"], "full_outer")
    gap = F.col("invoiced_l") - F.col("consumed_l")
    return joined.select(
        "VIN",
        "InvoiceMonth",
        "consumed_l",
        "invoiced_l",
        divide(gap, F.col("consumed_l")).alias("deviation"),
        F.when(F.col("consumed_l").isNull(), "NO_TRIPS")
        .when(F.col("invoiced_l").isNull(), "NO_INVOICE")
        .when(F.abs(gap) <= tolerance * F.col("consumed_l"), "MATCH")
        .otherwise("MISMATCH")
        .alias("status"),
    )
