"""Filter context, geography and what the plans look like."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from carbonhaul.queries.catalog import QUERIES as CATALOG
from carbonhaul.functions.dates import days_crossed, months_crossed
from carbonhaul.functions.geo import great_circle_km, planar_km
from carbonhaul.plans import calcgroups, measures, pricing, timeintel, whatif
from carbonhaul.sources import testdata as src
from carbonhaul.streaming.outputs import OUTPUTS


def test_context_filters_both_ways(spark, sf):
    trips, invoices = src.trips(spark, sf), src.invoices(spark, sf)
    some = invoices.select("VIN").first()[0]
    context = measures.FilterContext(invoices=F.col("VIN") == some)
    assert [r[0] for r in context.on_trips(trips, invoices).select("VIN").distinct().collect()] == [
        some
    ]
    with pytest.raises(ValueError):
        context.on_trips(trips)
    nothing = measures.FilterContext(first_day="2050-01-01")
    assert nothing.on_invoices(invoices, trips).count() == 0


def test_measures_of_an_empty_selection(spark, sf):
    row = measures.evaluate(
        src.trips(spark, sf).where("false"), ["total_trips", "efficiency_l_100km", "co2_per_km_g"]
    ).first()
    assert tuple(row) == (0, 0.0, 0.0)


def test_boundaries(spark):
    df = spark.sql("SELECT TIMESTAMP'2025-01-31 23:59:00' a, TIMESTAMP'2025-02-01 00:01:00' b")
    row = df.select(days_crossed(F.col("a"), F.col("b")), months_crossed(F.col("a"), F.col("b")))
    assert tuple(row.first()) == (1, 1)


def test_distances(spark):
    points = spark.createDataFrame(
        [(52.3676, 4.9041, 48.8566, 2.3522), (40.0, 3.0, 40.0, 3.0)],
        "a double, b double, c double, d double",
    )
    ends = [F.col(c) for c in "abcd"]
    got = points.select(great_circle_km(*ends), planar_km(*ends)).collect()
    assert got[0][0] == pytest.approx(430, abs=2)
    assert got[0][1] == pytest.approx(111.32 * math.hypot(3.511, 2.5519), rel=1e-9)
    assert tuple(got[1]) == (0.0, 0.0)


def test_selected_price(spark):
    df = spark.createDataFrame([("a", 90.0), ("a", 90.0), ("b", 90.0), ("b", 91.0)],
                               "g string, p double")
    got = df.groupBy("g").agg(pricing.selected_price(F.col("p")).alias("p"))
    assert {tuple(r) for r in got.collect()} == {("a", 90.0), ("b", 85.0)}


def test_previous_skips_gaps(spark):
    df = spark.sql("SELECT DATE'2025-01-01' month, 1.0D value UNION ALL SELECT DATE'2025-03-01', 2.0D")
    got = {r["month"].month: r["previous"] for r in
           timeintel.with_previous(df, "month", 1).collect()}
    assert got == {1: None, 3: None}


def test_bands_and_slider(spark):
    df = spark.createDataFrame([(10.0,), (8.5,), (1.0,)], "v double")
    rows = calcgroups.bands(df, "v", 10.0).orderBy(F.col("v").desc()).collect()
    assert [(r["green"], r["yellow"], r["red"]) for r in rows] == [
        (10.0, None, None), (None, 8.5, None), (None, None, 1.0)
    ]
    slider = whatif.with_parameter(df.limit(1), whatif.ETS_PRICE, "p")
    assert slider.count() == 101
    assert slider.where("p = 85").first()["parameter_order"] == 36


SCANS = {
    # query -> columns its fact scan may read
    "co2_footprint": {"l_suppkey", "l_quantity", "l_linenumber", "l_partkey"},
    "daily_trips": {"l_shipdate", "l_partkey"},
    "fuel_efficiency_alerts": {"event_id", "ts", "user_id", "value", "props"},
}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_scans_read_needed_columns(spark, sf, explain, name):
    text = explain(entry.queries()[name](spark, sf))
    schema = text[text.index("ReadSchema: struct<"):].split("struct<", 1)[1].split(">", 1)[0]
    assert {c.split(":")[0] for c in schema.split(",")} <= SCANS[name]


EAGER = {  # these run jobs (files, streams, checkpoints) before they return a frame
    "src_csv_scan", "copy_into_defaults", "src_table_scan", "sink_partitioned", "layout_cluster",
    "table_counts", "src_file_discovery", "csv_header_aliases", "fuel_metadata",
    "stream_file_ingest", "stream_json_source", "stream_dedup",
} | {n for n in entry.queries() if n.startswith("stream_") and n[7:] in OUTPUTS}


@pytest.mark.parametrize("name", sorted(set(CATALOG) - EAGER))
def test_no_cross_joins_or_python_in_plans(spark, sf, explain, name):
    text = explain(entry.queries()[name](spark, sf))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython",
                     "MapInPandas", "FlatMapGroups"):
        assert operator not in text


def test_trips_of_any_year_or_none(spark, sf, tmp_path):
    folder = str(tmp_path)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    day = lines.schema["l_shipdate"].dataType
    one = lines.where("l_shipdate IS NOT NULL").limit(1)
    moved = [one.withColumn("l_shipdate", F.lit(d).cast(day)) for d in
             ("1994-06-01", "2003-06-01", None)]
    for extra in moved:
        lines = lines.unionByName(extra)
    lines.write.parquet(f"{folder}/lineitem.parquet")

    def run(name):
        return CATALOG[name].run(spark, folder).collect()

    trips = lines.count()
    per_year = {}
    for r in run("join_trips_date"):
        per_year[r["Year"]] = per_year.get(r["Year"], 0) + r["trips"]
    assert sum(per_year.values()) == trips
    assert (per_year[2023], per_year[2032], per_year[None]) == (1, 1, 1)
    assert sum(r["trips"] for r in run("dim_date")) == trips
    litres = src.trips(spark, folder).groupBy(F.col("TripDate").isNull().alias("blank")).agg(
        F.sum("Fuel_l").alias("litres"))
    litres = {r["blank"]: r["litres"] for r in litres.collect()}
    running = {r["Date"]: r["running_co2_t"] for r in run("running_co2")}
    assert running[max(d for d in running if d)] == pytest.approx(litres[False] * 2.68 / 1000)
    assert running[None] == pytest.approx(litres[True] * 2.68 / 1000)
    for name, value in (("ytd_co2", "ytd_co2_t"), ("mtd_ets_cost", "mtd_ets_cost_eur"),
                        ("running_ets", "running_ets_eur"), ("moving_avg_3m", "moving_avg_co2_t")):
        rows = {r["Date"]: r[value] for r in run(name)}
        assert rows[None] and rows[dt.date(2023, 6, 1)] and rows[dt.date(2032, 6, 1)], name
