"""Streams: equality with batches over several batches, replay, lateness, incremental files."""

import datetime as dt
import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from carbonhaul.session import scratch_path
from carbonhaul.sources import invoice_files, messages
from carbonhaul.sources import testdata as src
from carbonhaul.sources.tables import TableStore
from carbonhaul.streaming import jobs, outputs, serving, telemetry, windows


def several_files(spark, sf, n=4):
    """The events in event-time order, spread over files a stream reads one by one."""
    path = scratch_path(spark, "events")
    events = src.table(spark, sf, "events")
    events.repartitionByRange(n, "ts").write.parquet(path)
    return path, (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    )


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


def rounded(df):
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def test_update_mode_equals_batch(spark, sf):
    _, stream = several_files(spark, sf)
    path = scratch_path(spark, "daily")
    # files may arrive in any order, hence a lateness longer than the data
    job = jobs.finish(
        jobs.serve(
            windows.vehicle_daily_stats(
                telemetry.clean(src.parsed_messages(stream)), "40 days"
            ),
            path, ["window_start", "vin", "date_str"], scratch_path(spark, "progress"),
        )
    )
    assert sum(1 for p in job.recentProgress if p["numInputRows"]) > 1
    expected = windows.vehicle_daily_stats(telemetry.clean(src.telematics(spark, sf)))
    got = serving.read(spark, path).drop("window_date")
    assert rows(rounded(got)) == rows(rounded(expected))


def test_append_mode_emits_closed_windows(spark, sf):
    stream = src.event_stream(spark, sf)
    path = scratch_path(spark, "hourly")
    jobs.finish(
        jobs.archive(
            windows.fleet_hourly_stats(
                telemetry.clean(src.parsed_messages(stream)), "24 hours"
            ),
            path, scratch_path(spark, "progress"),
        )
    )
    expected = windows.fleet_hourly_stats(telemetry.clean(src.telematics(spark, sf)))
    got = rows(rounded(spark.read.parquet(path)))
    assert 0 < len(got) < expected.count()
    assert set(got) <= set(rows(rounded(expected)))


def test_windows_that_count_vehicles_are_served_while_open(spark, sf):
    _, stream = several_files(spark, sf)
    trips = telemetry.clean(src.telematics(spark, sf))
    for name in ("fleet_hourly_stats", "ets_cost_daily", "driver_daily_performance"):
        path = scratch_path(spark, name)
        # with a lateness longer than the data no window ever closes
        job = jobs.finish(
            outputs.start_windows(
                name, telemetry.clean(src.parsed_messages(stream)), path,
                scratch_path(spark, "progress"), "40 days",
            )
        )
        assert sum(1 for p in job.recentProgress if p["numInputRows"]) > 1
        expected = getattr(windows, name)(trips)
        assert rows(rounded(outputs.read(spark, name, path))) == rows(rounded(expected)), name


def test_totals_follow_later_messages_and_survive_a_repeated_batch(spark, tmp_path):
    folder, path = str(tmp_path / "in"), scratch_path(spark, "hourly")

    def trips(*given):
        base = telemetry.clean(src.telematics(spark, "/root/testdata/sf0.001")).limit(1)
        moments = spark.createDataFrame(
            [(v, dt.datetime(2025, 1, 1, hour, minute)) for v, hour, minute in given],
            "vin string, processedTime timestamp",
        )
        return base.drop("vin", "processedTime").crossJoin(moments)

    def run(progress):
        schema = spark.read.parquet(folder).schema
        jobs.finish(
            jobs.serve_totals(
                windows.fleet_hourly_sums(
                    spark.readStream.schema(schema).parquet(folder), "24 hours"
                ),
                windows.fleet_hourly_totals, path, ["vin"], "hour_timestamp", progress,
            )
        )
        return sorted(
            (r["hour_timestamp"][11:13], r["active_vehicles"], r["total_trips"])
            for r in serving.read(spark, path).collect()
        )

    progress = scratch_path(spark, "progress")
    trips(("a", 9, 0), ("a", 9, 5), ("b", 10, 0)).coalesce(1).write.mode("append").parquet(folder)
    assert run(progress) == [("09", 1, 2), ("10", 1, 1)]
    trips(("b", 9, 59), ("a", 9, 59)).coalesce(1).write.mode("append").parquet(folder)
    assert run(progress) == [("09", 2, 4), ("10", 1, 1)]
    # all again, as after a failure before the progress was recorded
    assert run(scratch_path(spark, "progress")) == [("09", 2, 4), ("10", 1, 1)]


def cut_off(monkeypatch, at, nth):
    """Let the ``nth`` call of a step of publication fail: ``before`` or ``after`` it took effect."""
    step, when = at
    whole, calls = getattr(serving.ServedDays, step), []

    def broken(self, *args):
        calls.append(step)
        if len(calls) == nth and when == "before":
            raise RuntimeError("cut off")
        whole(self, *args)
        if len(calls) == nth:
            raise RuntimeError("cut off")

    monkeypatch.setattr(serving.ServedDays, step, broken)


@pytest.mark.parametrize("at", [("_swap", "before"), ("_swap", "after"), ("_clean", "after")])
@pytest.mark.parametrize("name", ["vehicle_daily_stats", "fleet_hourly_stats"])
def test_a_batch_that_was_cut_off_loses_nothing(spark, sf, monkeypatch, name, at):
    _, stream = several_files(spark, sf, 3)
    path, progress = scratch_path(spark, name), scratch_path(spark, "progress")

    def run():
        trips = telemetry.clean(src.parsed_messages(stream))
        jobs.finish(outputs.start_windows(name, trips, path, progress, "40 days"))

    with monkeypatch.context() as patched:
        cut_off(patched, at, 2)
        with pytest.raises(StreamingQueryException):
            run()
    # readers have the days of whole batches
    seen = rows(rounded(outputs.read(spark, name, path)))
    served = serving.ServedDays(spark, path)
    assert len(served.pointers()) == (1 if at[1] == "before" else 2) and seen
    if at[1] == "before":
        # the folder of the second batch is there, and no pointer names it
        assert len(served._names("versions")) == 2 and len(set(served.days().values())) == 1
    run()
    expected = getattr(windows, name)(telemetry.clean(src.telematics(spark, sf)))
    assert rows(rounded(outputs.read(spark, name, path))) == rows(rounded(expected))
    # folders that nobody can read any more are gone
    named = {v for n in served.pointers()[-2:] for v in served.days(n).values()}
    assert set(served._names("versions")) == named and len(served.pointers()) <= 2


def test_a_version_that_was_half_written_is_never_read(spark, tmp_path):
    path = str(tmp_path / "table")
    served = serving.ServedDays(spark, path)
    first = spark.sql("SELECT 1 AS n, DATE'2025-01-01' AS window_date UNION ALL SELECT 2, DATE'2025-01-02'")
    served.publish(["2025-01-01", "2025-01-02"], lambda f: serving.write_days(first, f"{f}/rows"))

    def half(folder):
        serving.write_days(first.where("n = 1").withColumn("n", F.lit(9)), f"{folder}/rows")
        raise RuntimeError("cut off")

    with pytest.raises(RuntimeError):
        served.publish(["2025-01-01", "2025-01-02"], half)
    assert rows(serving.read(spark, path)) == rows(first)
    changed = first.where("n = 1").withColumn("n", F.lit(3))
    served.publish(["2025-01-01"], lambda f: serving.write_days(changed, f"{f}/rows"))
    assert sorted(r["n"] for r in serving.read(spark, path).collect()) == [2, 3]
    assert served.read("rows", first.schema, ["2025-03-01"]) is None
    # a reader of the pointer before finds its folders
    assert {served.days(n)["2025-01-01"] for n in served.pointers()} <= set(served._names("versions"))


def test_a_second_writer_is_noticed(spark, tmp_path, monkeypatch):
    served = serving.ServedDays(spark, str(tmp_path / "table"))
    served._swap({"2025-01-01": "a"})
    monkeypatch.setattr(served, "pointers", lambda: [])
    with pytest.raises(RuntimeError, match="somebody else"):
        served._swap({"2025-01-01": "b"})


def write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
        out.write("\n".join(lines) + "\n")


def message(number, start="2025-01-01T06:00:00Z", litres=30.0, sent="2025-01-01T09:00:00Z"):
    return json.dumps(
        {"messageId": f"m{number}", "vin": "V", "tripId": f"t{number}", "startTime": start,
         "endTime": "2025-01-09T08:00:00Z", "totalDistance": 100, "fuelConsumed": litres,
         "timestamp": sent}
    )


def test_message_job_upserts_and_quarantines(spark, tmp_path):
    folder = str(tmp_path / "in")
    store = TableStore(spark, scratch_path(spark, "trips"))
    rejects, progress = scratch_path(spark, "rejects"), scratch_path(spark, "progress")

    def run():
        jobs.finish(
            jobs.ingest_messages(
                messages.json_lines_stream(spark, folder), store, rejects, progress
            )
        )
        return sorted((r["TripID"], r["Fuel_l"]) for r in store.read("TripFacts").collect())

    write_lines(folder, "1.json", [message(1), message(2), '{"cut', message(3, litres=-1.0)])
    assert run() == [("t1", 30.0), ("t2", 30.0)]
    # nothing new: nothing changes
    assert run() == [("t1", 30.0), ("t2", 30.0)]
    # a correction on another day, twice in one batch: the later one counts
    write_lines(folder, "2.json", [
        message(2, "2025-01-02T06:00:00Z", 31.0, "2025-01-02T10:00:00Z"),
        message(2, "2025-01-02T06:00:00Z", 32.0, "2025-01-02T11:00:00Z"),
    ])
    assert run() == [("t1", 30.0), ("t2", 32.0)]
    refused = spark.read.json(rejects)
    assert sorted(r["reject_reasons"] for r in refused.collect()) == [
        "fuel_not_positive", "malformed_json"
    ]


def test_replayed_invoice_batch_changes_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    write_lines(str(folder), "a.csv", [
        "VIN,InvoiceDate,Litres,EUR_Amount,InvoiceNumber", "V1,2025-01-05,10,15,i1",
        "V2,2025-01-06,0,15,i2",
    ])
    write_lines(str(folder), "b.csv", [
        "VIN,InvoiceDate,Litres,EUR_Amount,InvoiceNumber", "V3,2025-01-05,-10,15,i3",
    ])
    store = TableStore(spark, scratch_path(spark, "invoices"))
    rejects = scratch_path(spark, "rejects")
    for _ in range(2):
        files = invoice_files.list_files(spark, str(folder))
        jobs.load_invoice_files(spark, files, store, rejects, 0)
        kept = store.read("FuelInvoices").collect()
        assert [(r["VIN"], r["InvoiceMonth"]) for r in kept] == [("V1", dt.date(2025, 1, 1))]
        assert spark.read.json(rejects).count() == 2


def test_file_job_sees_each_file_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    store = TableStore(spark, scratch_path(spark, "invoices"))
    rejects, progress = scratch_path(spark, "rejects"), scratch_path(spark, "progress")
    for i in range(3):
        write_lines(folder, f"{i}.csv", [
            "Vehicle;Invoice Date;Liters;Cost;Invoice Number", f"V{i};2025-0{i + 1}-05;10;15;i{i}",
        ])

    def run():
        query = jobs.finish(
            jobs.ingest_invoice_files(spark, folder, store, rejects, progress, max_files=2)
        )
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    assert run() == [2, 1]
    assert run() == []
    write_lines(folder, "9.csv", ["VIN,InvoiceDate,Litres,EUR_Amount", "V9,2025-09-05,1,2"])
    assert run() == [1]
    assert store.read("FuelInvoices").count() == 4


def test_late_rows_and_duplicates(spark, tmp_path):
    schema = "messageId string, processedTime timestamp"
    folder = str(tmp_path / "in")
    path, progress = scratch_path(spark, "out"), scratch_path(spark, "progress")

    def run(*batch):
        spark.createDataFrame(
            [(m, dt.datetime(2025, 1, day)) for m, day in batch], schema
        ).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        jobs.finish(
            jobs.archive(windows.without_duplicates(stream, "24 hours"), path, progress)
        )
        return sorted(r["messageId"] for r in spark.read.parquet(path).collect())

    assert run(("a", 1), ("a", 1), ("b", 10)) == ["a", "b"]
    # b again is a duplicate, c is inside the lateness, d lies behind it
    assert run(("b", 10), ("c", 10), ("d", 2)) == ["a", "b", "c"]


def test_lag_and_quality_at_a_moment(spark):
    base = dt.datetime(2025, 1, 1, 12)
    df = spark.createDataFrame(
        [(base - dt.timedelta(minutes=m), km, 10.0, 60.0 if m == 5 else 30.0)
         for m, km in ((5, 1.0), (30, 0.0), (90, 1.0))],
        "processedTime timestamp, distance_km double, fuel_l double, "
        "fuel_efficiency_l_100km double",
    )
    row = windows.stream_lag(df, F.lit(base).cast("timestamp")).first()
    assert (row["message_count"], row["lag_seconds"]) == (2, 300.0)
    quality = windows.stream_quality(df).first()
    assert (quality["total_messages"], quality["invalid_efficiency_count"],
            quality["invalid_distance_count"]) == (3, 1, 1)


def test_sources_without_their_connector_fail_clearly(spark):
    try:
        messages.kafka_stream(spark, "localhost:9092", "trips")
    except Exception as error:
        assert "kafka" in str(error).lower()


def test_all_outputs_from_one_parse(spark, sf):
    parsed = src.parsed_messages(src.event_stream(spark, sf))
    root, progress = scratch_path(spark, "outputs"), scratch_path(spark, "progress")
    queries = outputs.start_all(parsed, root, progress)
    for query in queries.values():
        jobs.finish(query)
    events = src.table(spark, sf, "events").count()
    read = {}
    for name, query in queries.items():
        for report in query.recentProgress:
            for source in report["sources"]:
                read.setdefault(source["description"], {}).setdefault(name, 0)
                read[source["description"]][name] += source["numInputRows"]
    raw = {n: k for d, n_ in read.items() if outputs.CLEAN not in d for n, k in n_.items()}
    assert raw == {outputs.CLEAN: events}
    # the other queries read the cleaned trips
    assert set(queries) - {outputs.CLEAN} == {n for d, n_ in read.items() if outputs.CLEAN in d for n in n_}
    trips = telemetry.clean(src.telematics(spark, sf))
    assert rows(outputs.read(spark, outputs.CLEAN, f"{root}/{outputs.CLEAN}")) == rows(trips)
    for name, output in outputs.OUTPUTS.items():
        assert not outputs.read(spark, name, f"{root}/{name}").isEmpty(), name
        if not output.windowed and name != outputs.CLEAN:
            assert rows(outputs.read(spark, name, f"{root}/{name}")) == rows(output.build(trips))


@pytest.mark.parametrize("call", [1, 2, 4])
def test_a_fan_out_that_was_cut_off_repeats_nothing(spark, sf, monkeypatch, call):
    parsed = src.parsed_messages(src.event_stream(spark, sf))
    root, progress = scratch_path(spark, "outputs"), scratch_path(spark, "progress")
    whole, calls = jobs._swap_in, []

    def broken(*args):
        calls.append(args)
        if len(calls) == call:
            raise RuntimeError("cut off")
        whole(*args)

    with monkeypatch.context() as patched:
        patched.setattr(jobs, "_swap_in", broken)
        with pytest.raises(StreamingQueryException):
            jobs.finish(outputs.start_rows(parsed, root, progress))
    jobs.finish(outputs.start_rows(parsed, root, progress))
    # and once more from the start, as when the progress was lost
    jobs.finish(outputs.start_rows(parsed, root, scratch_path(spark, "progress")))
    trips = telemetry.clean(src.telematics(spark, sf))
    for name, output in outputs.OUTPUTS.items():
        if not output.windowed:
            assert rows(outputs.read(spark, name, f"{root}/{name}")) == rows(output.build(trips)), name
