"""The derived outputs of the cleaned trip stream.

One query reads the messages: it writes the cleaned trips and the outputs that follow from single rows.
The windowed outputs are queries over the cleaned trips, so messages are parsed once for all.
"""

from dataclasses import dataclass

from . import jobs, serving, telemetry, windows

DEFAULT_LATENESS = "24 hours"


@dataclass(frozen=True)
class Output:
    """``build`` takes the cleaned trips (and the lateness, for windowed outputs).

    Outputs with ``keys`` are served in update mode, the newest row per key; the others are
    appended. Where windows count vehicles, ``build`` gives the sums per vehicle, ``totals`` adds
    them up and ``start`` is the column with the start of the window.
    """

    build: object
    windowed: bool = False
    keys: tuple = ()
    totals: object = None
    start: str = "window_start"


OUTPUTS = {
    "telematics_clean": Output(lambda trips: trips),
    "fuel_efficiency_alerts": Output(telemetry.efficiency_alerts),
    "route_analysis": Output(telemetry.route_analysis),
    "maintenance_indicators": Output(telemetry.maintenance_indicators),
    "vehicle_daily_stats": Output(
        windows.vehicle_daily_stats, True, ("window_start", "vin", "date_str")
    ),
    "scenario_analysis_feed": Output(
        windows.scenario_analysis_feed, True, ("window_start", "vin", "analysis_month")
    ),
    "fleet_hourly_stats": Output(
        windows.fleet_hourly_sums, True, ("vin",), windows.fleet_hourly_totals, "hour_timestamp"
    ),
    "ets_cost_daily": Output(
        windows.ets_cost_sums, True, ("date_str", "vin"), windows.ets_cost_totals
    ),
    "driver_daily_performance": Output(
        windows.driver_daily_sums, True, ("driverId", "date_str", "vin"),
        windows.driver_daily_totals,
    ),
}


CLEAN = "telematics_clean"


def start_rows(messages, root, checkpoint, interval=None):
    """Start the query that writes the cleaned trips and all outputs without windows."""
    others = {n: o.build for n, o in OUTPUTS.items() if not o.windowed and n != CLEAN}
    return jobs.fan_out(telemetry.clean(messages), root, CLEAN, others, checkpoint, interval)


def clean_stream(messages, root):
    """The cleaned trips below ``root`` as a stream."""
    spark = messages.sparkSession
    fields = telemetry.clean(messages).schema
    # the folder has to be there before its first batch
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{CLEAN}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return spark.readStream.schema(fields).parquet(f"{root}/{CLEAN}").select(*fields.names)


def start_windows(name, trips, path, checkpoint, lateness=DEFAULT_LATENESS, interval=None):
    """Start one windowed output over a stream of cleaned trips."""
    output = OUTPUTS[name]
    frame = output.build(trips, lateness)
    if output.totals:
        return jobs.serve_totals(
            frame, output.totals, path, list(output.keys), output.start, checkpoint, interval
        )
    return jobs.serve(frame, path, list(output.keys), checkpoint, interval)


def start_all(messages, root, checkpoints, lateness=DEFAULT_LATENESS, interval=None, names=None):
    """Start every output (or the windowed ones in ``names``); returns {name: query}.

    Each query keeps its own progress, so one can fail or restart alone. Without an interval what is there
    is cleaned first, and then read by the windows.
    """
    queries = {CLEAN: start_rows(messages, root, f"{checkpoints}/{CLEAN}", interval)}
    if interval is None:
        jobs.finish(queries[CLEAN])
    trips = clean_stream(messages, root)
    for name, output in OUTPUTS.items():
        if output.windowed and (names is None or name in names):
            queries[name] = start_windows(
                name, trips, f"{root}/{name}", f"{checkpoints}/{name}", lateness, interval
            )
    return queries


def read(spark, name, path):
    """What an output has written so far."""
    if OUTPUTS[name].windowed:
        return serving.read(spark, path).drop("window_date")
    return spark.read.parquet(path).drop("batch_id")
