"""Row-wise telemetry transformations. No state, so batch and stream plans are the same."""

from pyspark.sql import functions as F

from ..constants import DEFAULT_ETS_EUR_PER_T
from ..functions.geo import great_circle_km, valid_position
from ..functions.ratios import co2_kg, litres_per_100km

# Alert and maintenance limits
ALERT_L_100KM = 30
WARNING_L_100KM = 32
CRITICAL_L_100KM = 35


def clean(messages):
    """Complete trips with efficiency, emission, cost and speed."""
    km, litres = F.col("distance_km"), F.col("fuel_l")
    seconds = F.expr("timestampdiff(SECOND, startTimeUTC, endTimeUTC)")
    return messages.where(
        "vin IS NOT NULL AND tripId IS NOT NULL AND startTimeUTC IS NOT NULL "
        "AND endTimeUTC IS NOT NULL AND distance_km > 0 AND fuel_l > 0"
    ).select(
        "messageId", "vin", "tripId", "startTimeUTC", "endTimeUTC", "distance_km", "fuel_l",
        "engineHours", "idleTime", "maxSpeed", "avgSpeed", "driverId", "routeId",
        "startLatitude", "startLongitude", "endLatitude", "endLongitude",
        litres_per_100km(litres, km).alias("fuel_efficiency_l_100km"),
        co2_kg(litres).alias("co2_kg"),
        (co2_kg(litres) * DEFAULT_ETS_EUR_PER_T / 1000).alias("ets_cost_eur"),
        F.try_divide(km, seconds / 3600).alias("avg_speed_calculated"),
        "processedTime",
    )


def efficiency_alerts(trips):
    efficiency = F.col("fuel_efficiency_l_100km")
    return trips.where(efficiency > ALERT_L_100KM).select(
        "vin", "tripId", "fuel_efficiency_l_100km", "distance_km", "fuel_l", "startTimeUTC",
        "endTimeUTC",
        F.lit("HIGH_FUEL_CONSUMPTION").alias("alert_type"),
        F.when(efficiency > CRITICAL_L_100KM, "CRITICAL")
        .when(efficiency > WARNING_L_100KM, "WARNING")
        .otherwise("INFO").alias("severity"),
        F.col("processedTime").alias("alert_timestamp"),
    )


def route_analysis(trips):
    """Great-circle distance and how much longer the trip was; NULL for a round trip."""
    ends = [F.col(c) for c in
            ("startLatitude", "startLongitude", "endLatitude", "endLongitude")]
    return (
        trips.where(valid_position(*ends[:2]) & valid_position(*ends[2:]))
        .withColumn("straight_line_distance_km", great_circle_km(*ends))
        .select(
            "vin", "tripId", "startLatitude", "startLongitude", "endLatitude", "endLongitude",
            "distance_km", "fuel_efficiency_l_100km", "startTimeUTC", "endTimeUTC", "routeId",
            "straight_line_distance_km",
            F.try_divide("distance_km", "straight_line_distance_km").alias(
                "route_efficiency_ratio"
            ),
            "processedTime",
        )
    )


def maintenance_indicators(trips):
    efficiency, speed = F.col("fuel_efficiency_l_100km"), F.col("maxSpeed")
    idle = F.try_divide("idleTime", "engineHours") * 100
    return trips.where((efficiency > 30) | (idle > 20) | (speed > 85)).select(
        "vin", "tripId", "fuel_efficiency_l_100km", "engineHours", "idleTime", "maxSpeed",
        "distance_km", "startTimeUTC",
        F.when(efficiency > 35, "ENGINE_CHECK_REQUIRED")
        .when(idle > 25, "EXCESSIVE_IDLING")
        .when(speed > 90, "SPEED_VIOLATION")
        .otherwise("NORMAL").alias("maintenance_flag"),
        F.when((efficiency > 40) | (speed > 100), "HIGH")
        .when((efficiency > 35) | (idle > 30), "MEDIUM")
        .otherwise("LOW").alias("severity"),
        "processedTime",
    )
