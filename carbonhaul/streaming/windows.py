"""Tumbling-window statistics over cleaned trips, for batches and streams.

Windows are on the processing-event time, dates on the trip's start, and both are group keys: a
trip posted late gets its own row. Statistics that count distinct vehicles aggregate per vehicle
(``_sums``) and then add up (``_totals``), so no group ever gathers a set of vehicles. A stream
either serves the sums in update mode and adds up what is stored, or chains the two aggregations,
which Spark runs in append mode only.
"""

from pyspark.sql import functions as F

from ..constants import DEFAULT_ETS_EUR_PER_T, DEFAULT_FUEL_EUR_PER_L
from ..functions.ratios import co2_kg

DAY = "yyyy-MM-dd"
MONTH = "yyyy-MM"

PARTS = {
    "n": F.count,
    "km": F.sum, "litres": F.sum, "efficiency": F.sum, "max_speed": F.sum, "avg_speed": F.sum,
    "engine": F.sum, "idle": F.sum, "last_update": F.max,
    # means skip messages whose reading was unusable
    "n_max_speed": F.count, "n_avg_speed": F.count, "n_engine": F.count,
}
SOURCES = {
    "n": "vin", "km": "distance_km", "litres": "fuel_l",
    "efficiency": "fuel_efficiency_l_100km", "max_speed": "maxSpeed", "avg_speed": "avgSpeed",
    "engine": "engineHours", "idle": "idleTime", "last_update": "processedTime",
    "n_max_speed": "maxSpeed", "n_avg_speed": "avgSpeed", "n_engine": "engineHours",
}


def with_lateness(trips, lateness):
    """Declare how late a trip may arrive; needed on streams, harmless on batches."""
    return trips.withWatermark("processedTime", lateness) if lateness else trips


def start_date(pattern):
    return F.date_format("startTimeUTC", pattern)


def _sums(trips, size, keys):
    window = F.window("processedTime", size).alias("window")
    return trips.groupBy(window, *keys).agg(
        *[f(SOURCES[p]).alias(p) for p, f in PARTS.items()]
    )


def _again(size):
    """The window of a first aggregation as a key of the second, for chains on streams."""
    return F.window(F.window_time("window"), size).alias("window")


def _fold(per_vehicle, window, names):
    """Sums per (window, names, vehicle) added up per (window, names), with the vehicle count."""
    fold = {**{p: F.sum for p in PARTS}, "last_update": F.max}
    return per_vehicle.groupBy(window, *names).agg(
        F.count(F.lit(1)).alias("vehicles"),
        *[f(p).alias(p) for p, f in fold.items()],
    )


def _mean(part, count="n"):
    return F.try_divide(part, count)


def _co2():
    return co2_kg(F.col("litres"))


def _ets():
    return co2_kg(F.col("litres")) * DEFAULT_ETS_EUR_PER_T / 1000


def vehicle_daily_stats(trips, lateness=None):
    rows = _sums(
        with_lateness(trips, lateness), "1 day",
        [F.col("vin"), start_date(DAY).alias("date_str")],
    )
    return rows.select(
        F.col("window.start").alias("window_start"),
        "vin",
        "date_str",
        F.col("n").alias("trip_count"),
        F.col("km").alias("total_distance_km"),
        F.col("litres").alias("total_fuel_l"),
        _mean("efficiency").alias("avg_fuel_efficiency"),
        _co2().alias("total_co2_kg"),
        _ets().alias("total_ets_cost_eur"),
        _mean("max_speed", "n_max_speed").alias("avg_max_speed"),
        F.col("engine").alias("total_engine_hours"),
        F.col("idle").alias("total_idle_time"),
        "last_update",
    )


def fleet_hourly_sums(trips, lateness=None):
    return _sums(with_lateness(trips, lateness), "1 hour", [F.col("vin")])


def fleet_hourly_totals(per_vehicle, window="window"):
    return _fold(per_vehicle, window, []).select(
        F.lit("FLEET_TOTAL").alias("fleet_id"),
        F.date_format("window.start", "yyyy-MM-dd HH:00:00").alias("hour_timestamp"),
        F.col("vehicles").alias("active_vehicles"),
        F.col("n").alias("total_trips"),
        F.col("km").alias("total_distance_km"),
        F.col("litres").alias("total_fuel_l"),
        _mean("efficiency").alias("avg_fuel_efficiency"),
        _co2().alias("total_co2_kg"),
        _ets().alias("total_ets_cost_eur"),
        _mean("avg_speed", "n_avg_speed").alias("fleet_avg_speed"),
        F.col("engine").alias("total_engine_hours"),
        F.col("idle").alias("total_idle_time"),
    )


def fleet_hourly_stats(trips, lateness=None):
    return fleet_hourly_totals(fleet_hourly_sums(trips, lateness), _again("1 hour"))


def ets_cost_sums(trips, lateness=None):
    return _sums(
        with_lateness(trips, lateness), "1 day",
        [start_date(DAY).alias("date_str"), F.col("vin")],
    )


def ets_cost_totals(per_vehicle, window="window"):
    return _fold(per_vehicle, window, ["date_str"]).select(
        F.col("window.start").alias("window_start"),
        "date_str",
        F.substring("date_str", 1, 7).alias("month_str"),
        F.col("vehicles").alias("active_vehicles"),
        F.col("n").alias("total_trips"),
        _co2().alias("daily_co2_kg"),
        _ets().alias("daily_ets_cost_eur"),
        F.try_divide(_ets(), F.col("n")).alias("avg_ets_cost_per_trip"),
        "last_update",
    )


def ets_cost_daily(trips, lateness=None):
    return ets_cost_totals(ets_cost_sums(trips, lateness), _again("1 day"))


def driver_daily_sums(trips, lateness=None):
    return _sums(
        with_lateness(trips.where("driverId IS NOT NULL"), lateness), "1 day",
        [F.col("driverId"), start_date(DAY).alias("date_str"), F.col("vin")],
    )


def driver_daily_totals(per_vehicle, window="window"):
    return _fold(per_vehicle, window, ["driverId", "date_str"]).select(
        F.col("window.start").alias("window_start"),
        "driverId",
        "date_str",
        F.col("n").alias("trips_count"),
        F.col("vehicles").alias("vehicles_driven"),
        F.col("km").alias("total_distance_km"),
        F.col("litres").alias("total_fuel_l"),
        _mean("efficiency").alias("avg_fuel_efficiency"),
        _mean("max_speed", "n_max_speed").alias("avg_max_speed"),
        _mean("avg_speed", "n_avg_speed").alias("avg_driving_speed"),
        F.col("idle").alias("total_idle_time"),
        (F.try_divide("idle", "engine") * 100).alias("idle_time_percentage"),
        "last_update",
    )


def driver_daily_performance(trips, lateness=None):
    return driver_daily_totals(driver_daily_sums(trips, lateness), _again("1 day"))


def scenario_analysis_feed(trips, lateness=None):
    rows = _sums(
        with_lateness(trips, lateness), "30 days",
        [F.col("vin"), start_date(MONTH).alias("analysis_month")],
    )
    return rows.select(
        F.col("window.start").alias("window_start"),
        "vin",
        "analysis_month",
        _mean("efficiency").alias("monthly_avg_efficiency"),
        F.col("km").alias("monthly_distance_km"),
        F.col("litres").alias("monthly_fuel_l"),
        _co2().alias("monthly_co2_kg"),
        _ets().alias("monthly_ets_cost_eur"),
        F.col("n").alias("monthly_trips"),
        _mean("engine", "n_engine").alias("avg_engine_hours"),
        (F.col("n") / 30).alias("avg_trips_per_day"),
        (F.col("km") / 30).alias("avg_km_per_day"),
        _mean("engine").alias("avg_engine_hours_per_trip"),
        F.try_divide(_ets(), F.col("km")).alias("ets_cost_per_km"),
        F.try_divide(F.col("litres") * DEFAULT_FUEL_EUR_PER_L, F.col("km")).alias(
            "fuel_cost_per_km"
        ),
        "last_update",
    )


def stream_lag(trips, as_of, horizon="1 hour"):
    """Messages of the last hour before ``as_of`` and the seconds since the latest."""
    recent = F.col("processedTime") > as_of - F.expr(f"interval {horizon}")
    return trips.where(recent & (F.col("processedTime") <= as_of)).groupBy(
        F.lit("telematics_clean").alias("stream_name")
    ).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.max("processedTime").alias("latest_processed_time"),
    ).withColumn(
        "lag_seconds",
        as_of.cast("double") - F.col("latest_processed_time").cast("double"),
    )


def stream_lag_hourly(trips):
    """What :func:`stream_lag` reports at the end of every hour."""
    return trips.groupBy(F.window("processedTime", "1 hour").alias("window")).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.max("processedTime").alias("latest_processed_time"),
    ).select(
        F.col("window.end").alias("as_of"),
        "message_count",
        "latest_processed_time",
        (F.col("window.end").cast("double") - F.col("latest_processed_time").cast("double"))
        .alias("lag_seconds"),
    )


def stream_quality(messages, by=()):
    """Counts of implausible messages and their share."""
    efficiency = F.col("fuel_efficiency_l_100km")
    counted = messages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(efficiency > 50).alias("invalid_efficiency_count"),
        F.count_if(F.col("distance_km") <= 0).alias("invalid_distance_count"),
        F.count_if(F.col("fuel_l") <= 0).alias("invalid_fuel_count"),
    )
    return counted.withColumn(
        "invalid_efficiency_percentage",
        F.try_divide(F.col("invalid_efficiency_count") * 100.0, F.col("total_messages")),
    )


def without_duplicates(messages, lateness, key="messageId"):
    """First copy per message within the allowed lateness; state is dropped behind it."""
    return messages.withWatermark("processedTime", lateness).dropDuplicatesWithinWatermark([key])
