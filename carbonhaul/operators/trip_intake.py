"""From message text fields to trip rows: typed columns, rules, rejects, projection."""

from pyspark.sql import functions as F

from ..schemas import MESSAGE_NUMBERS, MESSAGE_TEXT, MESSAGE_TIMES
from .constraints import REASONS, pinned, reasons

REQUIRED = ("vin", "tripId", "startTime", "endTime", "totalDistance", "fuelConsumed")


def number(text):
    """Lenient: text that is no number becomes NULL."""
    return text.try_cast("double")


def iso_time(text):
    """Lenient ISO-8601 time; a full date is needed, ``Z`` and offsets are understood."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def typed(messages):
    """Numbers and times parsed; ``missing`` lists the absent required fields."""
    missing = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    )
    unread = [
        F.col(c).isNotNull() & iso_time(F.col(c)).isNull() for c in ("startTime", "endTime")
    ]
    extra = [c for c in ("raw", "malformed") if c in messages.columns]
    return messages.select(
        *extra,
        missing.alias("missing"),
        (unread[0] | unread[1]).alias("unread_time"),
        *MESSAGE_TEXT,
        *[number(F.col(c)).alias(c) for c in MESSAGE_NUMBERS],
        *[iso_time(F.col(c)).alias(c) for c in MESSAGE_TIMES],
    )


def with_reasons(messages):
    """Attach the names of the violated rules, empty for an acceptable message.

    A distance or fuel that is no number breaks the same rule as one that is not positive. A
    time that cannot be read is rejected too, because the table requires it.
    """
    absent = F.col("missing")
    intact = ~F.col("malformed")
    rules = {"malformed_json": intact}
    for field in REQUIRED:
        rules[f"missing_{field}"] = ~intact | ~F.array_contains(absent, field)
    rules["unreadable_time"] = ~F.col("unread_time")
    for field, name in (("totalDistance", "distance"), ("fuelConsumed", "fuel")):
        rules[f"{name}_not_positive"] = (
            ~intact | F.array_contains(absent, field)
            | F.coalesce(F.col(field) > 0, F.lit(False))
        )
    rules["start_not_before_end"] = F.coalesce(F.col("startTime") < F.col("endTime"), F.lit(True))
    return pinned(pinned(messages).withColumn(REASONS, reasons(rules)))


def trip_rows(messages, processed_time, *more):
    """Trip table columns plus the lineage of the message, and ``more`` columns."""
    return messages.select(
        F.col("tripId").alias("TripID"),
        F.col("vin").alias("VIN"),
        F.col("startTime").alias("StartTimeUTC"),
        F.col("endTime").alias("EndTimeUTC"),
        F.col("totalDistance").alias("Distance_km"),
        F.col("fuelConsumed").alias("Fuel_l"),
        F.col("startLatitude").alias("StartLat"),
        F.col("startLongitude").alias("StartLon"),
        F.col("endLatitude").alias("EndLat"),
        F.col("endLongitude").alias("EndLon"),
        F.to_date("startTime").alias("TripDate"),
        processed_time.alias("ProcessedTime"),
        F.lit("TELEMATICS_KAFKA").alias("DataSource"),
        F.col("messageId").alias("MessageId"),
        F.col("driverId").alias("DriverId"),
        F.col("routeId").alias("RouteId"),
        F.col("engineHours").alias("EngineHours"),
        F.col("idleTime").alias("IdleTime"),
        F.col("maxSpeed").alias("MaxSpeed"),
        F.col("avgSpeed").alias("AvgSpeed"),
        *more,
    )
