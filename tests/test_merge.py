"""Upserts against a dictionary model, and the table store."""

import datetime as dt
from dataclasses import replace

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carbonhaul.operators.merge import latest_per_key, merge
from carbonhaul.schemas import FUEL_INVOICES
from carbonhaul.session import scratch_path
from carbonhaul.sources import tables
from carbonhaul.sources.tables import TableStore, trips_between

SCHEMA = "k string, j int, ts int, v int"
ROW = st.tuples(
    st.sampled_from(["a", "b", None]), st.integers(0, 2), st.integers(0, 3), st.integers(0, 9)
)


def model(target, source):
    """Rows by key; the greatest source row wins, NULL keys are always inserted."""
    keyed, loose = {}, []
    for row in source:
        if row[0] is None:
            loose.append(row)
        else:
            best = keyed.get(row[:2])
            keyed[row[:2]] = row if best is None else max(best, row, key=lambda r: (r[2], r[3]))
    kept = [r for r in target if r[0] is None or r[:2] not in keyed]
    return sorted(kept + loose + list(keyed.values()), key=str)


@settings(max_examples=20, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, max_size=6), st.lists(ROW, max_size=8))
def test_merge_equals_model(spark, target, source):
    got = merge(
        spark.createDataFrame(target, SCHEMA), spark.createDataFrame(source, SCHEMA),
        ["k", "j"], ["ts"],
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == model(target, source)


def test_hot_key_is_partially_aggregated(spark, explain):
    """A key with very many copies is reduced before the shuffle."""
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("ts"),
    )
    latest = latest_per_key(rows, ["k"], ["ts"])
    assert latest.where("k = 'hot'").first()["ts"] == 29999
    assert latest.count() == 10001
    assert explain(latest).count("Aggregate") >= 2


def trip(number, day, litres=10.0, hour=6):
    start = dt.datetime(2025, 1, day, hour)
    return (number, "V1", start, start + dt.timedelta(hours=2), 100.0, litres)


TRIP_SCHEMA = (
    "TripID string, VIN string, StartTimeUTC timestamp, EndTimeUTC timestamp, "
    "Distance_km double, Fuel_l double"
)


def content(store):
    return sorted(
        (r["TripID"], r["TripDate"].day, r["Fuel_l"]) for r in store.read("TripFacts").collect()
    )


def test_store_upsert_moves_and_replays(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    assert not store.exists("TripFacts")
    first = spark.createDataFrame([trip("a", 1), trip("b", 1), trip("c", 2)], TRIP_SCHEMA)
    assert store.upsert(first, "TripFacts") == 3
    # b changes in place, c moves to another day and leaves an empty one, d is new
    second = spark.createDataFrame(
        [trip("b", 1, 11.0), trip("c", 3, 12.0), trip("d", 3)], TRIP_SCHEMA
    )
    store.upsert(second, "TripFacts")
    expected = [("a", 1, 10.0), ("b", 1, 11.0), ("c", 3, 12.0), ("d", 3, 10.0)]
    assert content(store) == expected
    store.upsert(second, "TripFacts")
    assert content(store) == expected


def test_store_keeps_rows_without_partition_value(spark):
    fields = [T.StructField(f.name, f.dataType, f.nullable or f.name == "InvoiceMonth")
              for f in FUEL_INVOICES.schema]
    undated_table = replace(FUEL_INVOICES, schema=T.StructType(fields))
    store = TableStore(spark, scratch_path(spark, "store"), {FUEL_INVOICES.name: undated_table})

    def undated(vin, litres):
        return spark.createDataFrame(
            [(vin, None, litres, 9.0, f"INV-{vin}")],
            "VIN string, InvoiceMonth date, Litres double, EUR_Amount double, InvoiceNumber string",
        )

    store.upsert(undated("V1", 1.0), "FuelInvoices")
    store.upsert(undated("V3", 3.0), "FuelInvoices")
    assert sorted(r["VIN"] for r in store.read("FuelInvoices").collect()) == ["V1", "V3"]


def test_years_beyond_the_horizon_stay(spark):
    from carbonhaul.queries.scenario import with_horizon

    found = spark.createDataFrame([(2022, 1.0), (2025, 2.0), (2035, 3.0)], "year long, fleet_size double")
    rows = {r["year"]: r["fleet_size"] for r in with_horizon(spark, found).collect()}
    assert set(rows) == {2022, 2035, *range(2023, 2033)}
    assert (rows[2022], rows[2025], rows[2030], rows[2035]) == (1.0, 2.0, None, 3.0)


def test_store_rewrites_touched_days_only(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    store.upsert(
        spark.createDataFrame([trip(f"t{d}", d) for d in range(1, 6)], TRIP_SCHEMA), "TripFacts"
    )

    def files():
        found = store.read("TripFacts").select("TripDate", F.input_file_name().alias("f"))
        return {r["TripDate"].day: r["f"] for r in found.collect()}

    before = files()
    store.upsert(spark.createDataFrame([trip("t2", 2, 20.0)], TRIP_SCHEMA), "TripFacts")
    after = files()
    assert {d for d in before if before[d] != after[d]} == {2}


def test_unpartitioned_table_and_defaults(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    for price in (80.0, 90.0):
        month = spark.createDataFrame([(dt.date(2025, 1, 1), price)],
                                      "PriceMonth date, EUR_per_t double")
        store.upsert(month, "ETSPriceCurve")
    row = store.read("ETSPriceCurve").collect()
    assert [(r["EUR_per_t"], r["PriceSource"], r["Volatility"]) for r in row] == [
        (90.0, "MARKET", 0.15)
    ]


def test_optimize_orders_files_by_vehicle(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    start = dt.datetime(2025, 1, 1, 6)
    rows = [
        (f"t{i}", f"V{i * 7 % 20:02d}", start, start + dt.timedelta(hours=1), 1.0, 1.0)
        for i in range(200)
    ]
    store.overwrite(spark.createDataFrame(rows, TRIP_SCHEMA).repartition(5), "TripFacts")
    before = content(store)
    store.optimize("TripFacts", 4)
    assert content(store) == before
    spans = store.read("TripFacts").groupBy(F.input_file_name().alias("f")).agg(
        F.min("VIN").alias("lo"), F.max("VIN").alias("hi")
    ).orderBy("lo").collect()
    assert len(spans) > 1
    assert all(a["hi"] <= b["lo"] for a, b in zip(spans, spans[1:]))


def test_admit_splits_by_rules(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    bad = list(trip("x", 1))
    bad[3] = bad[2]
    rows = spark.createDataFrame(
        [trip("a", 1), tuple(bad), trip("y", 1, -1.0), (None,) + trip("z", 1)[1:]], TRIP_SCHEMA
    )
    accepted, refused = store.admit(rows, "TripFacts")
    assert [r["TripID"] for r in accepted.collect()] == ["a"]
    assert {(r["TripID"], tuple(r["reject_reasons"])) for r in refused.collect()} == {
        ("x", ("chk_trip_duration",)),
        ("y", ("chk_positive_fuel",)),
        (None, ("not_null_TripID",)),
    }


def test_counts_statistics_and_pruning(spark, explain):
    store = TableStore(spark, scratch_path(spark, "store"))
    rows = spark.createDataFrame([trip(f"t{d}", d) for d in range(1, 6)], TRIP_SCHEMA)
    assert store.overwrite(rows, "TripFacts") == 5
    assert store.append(spark.createDataFrame([trip("n", 9)], TRIP_SCHEMA), "TripFacts") == 1
    assert {tuple(r) for r in store.row_counts(["TripFacts"]).collect()} == {("TripFacts", 6)}
    store.analyze("TripFacts")
    try:
        detail = spark.sql("DESCRIBE EXTENDED TripFacts").collect()
        assert any(r[0] == "Statistics" and "6 rows" in r[1] for r in detail)
    finally:
        spark.sql("DROP TABLE TripFacts")
    window = trips_between(store.read("TripFacts"), "2025-01-02 00:00:00", "2025-01-04 00:00:00")
    assert window.count() == 2
    text = explain(window)
    filters = text[text.index("PartitionFilters"):]
    assert "TripDate" in filters[: filters.index("PushedFilters")]


def test_store_refuses_rows_that_break_its_rules(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    good = spark.createDataFrame([trip("a", 1)], TRIP_SCHEMA)
    bad = spark.createDataFrame([trip("a", 1, -5.0), trip("b", 2, -5.0)], TRIP_SCHEMA)
    assert store.refused("TripFacts") is None
    store.overwrite(good, "TripFacts")
    for write in (store.append, store.upsert, store.upsert):
        write(bad, "TripFacts")
    assert content(store) == [("a", 1, 10.0)]
    refused = store.refused("TripFacts").collect()
    assert sorted((r["TripID"], r["reject_reasons"]) for r in refused) == [
        ("a", ["chk_positive_fuel"]), ("b", ["chk_positive_fuel"])
    ]


def test_store_refuses_a_second_row_of_a_primary_key(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    schema = "PriceMonth date, EUR_per_t double"
    months = [dt.date(2025, m, 1) for m in (1, 2, 3)]
    rows = [(months[0], 80.0), (months[1], 81.0), (months[1], 82.0)]
    assert store.overwrite(spark.createDataFrame(rows, schema), "ETSPriceCurve") == 1
    more = [(months[0], 90.0), (months[2], 91.0), (months[2], 92.0), (months[1], 83.0)]
    assert store.append(spark.createDataFrame(more, schema), "ETSPriceCurve") == 1
    kept = store.read("ETSPriceCurve").collect()
    assert {(r["PriceMonth"], r["EUR_per_t"]) for r in kept} == {(months[0], 80.0), (months[1], 83.0)}
    refused = store.refused("ETSPriceCurve").collect()
    assert len(refused) == 5 and {r["reject_reasons"][0] for r in refused} == {"primary_key"}


def test_cut_off_publication_is_completed(spark, monkeypatch):
    store = TableStore(spark, scratch_path(spark, "store"))
    store.upsert(spark.createDataFrame([trip("a", 1), trip("b", 1)], TRIP_SCHEMA), "TripFacts")
    batch = spark.createDataFrame([trip("b", 1, 11.0), trip("c", 2)], TRIP_SCHEMA)

    def cut(self, name):
        # the partitions are deleted, the new files not yet in place
        system, folder = tables._folder(spark, f"{self.path(name)}/TripDate=2025-01-01")
        system.delete(folder, True)
        raise RuntimeError("cut off")

    with monkeypatch.context() as patch:
        patch.setattr(TableStore, "_publish", cut)
        try:
            store.upsert(batch, "TripFacts")
        except RuntimeError:
            pass
    assert content(store) == []
    for _ in range(2):
        store.upsert(batch, "TripFacts")
        assert content(store) == [("a", 1, 10.0), ("b", 1, 11.0), ("c", 2, 10.0)]


def test_incomplete_staging_is_forgotten(spark):
    store = TableStore(spark, scratch_path(spark, "store"))
    store.upsert(spark.createDataFrame([trip("a", 1)], TRIP_SCHEMA), "TripFacts")
    spark.createDataFrame([trip("x", 1)], TRIP_SCHEMA).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(store._staging("TripFacts"))
    store.upsert(spark.createDataFrame([trip("b", 1)], TRIP_SCHEMA), "TripFacts")
    assert content(store) == [("a", 1, 10.0), ("b", 1, 10.0)]


def test_new_keys_are_added_beside_what_is_stored(spark):
    store = TableStore(spark, scratch_path(spark, "store"))

    def files():
        found = store.read("TripFacts").select("TripDate", F.input_file_name().alias("f"))
        return {(r["TripDate"].day, r["f"]) for r in found.collect()}

    def batch(*trips):
        return spark.createDataFrame(list(trips), TRIP_SCHEMA)

    store.upsert(batch(trip("a", 1), trip("b", 2), trip("c", 3)), "TripFacts")
    before = files()
    # only new keys, also on days that have rows: no stored file is written again
    new = batch(trip("d", 1), trip("e", 2), trip("f", 4))
    assert store.upsert(new, "TripFacts") == 3
    after = files()
    assert before < after and {day for day, _ in after - before} == {1, 2, 4}
    store.upsert(new, "TripFacts")
    expected = [("a", 1, 10.0), ("b", 2, 10.0), ("c", 3, 10.0), ("d", 1, 10.0), ("e", 2, 10.0), ("f", 4, 10.0)]
    assert content(store) == expected
    # a changes day and c its litres; day 2 gets a new row and keeps its files
    second, before = batch(trip("a", 5), trip("c", 3, 30.0), trip("g", 2), trip("h", 5)), files()
    store.upsert(second, "TripFacts")
    day_2 = {f for f in before if f[0] == 2}
    assert day_2 < {f for f in files() if f[0] == 2}
    expected = sorted(
        [*expected[1:2], *expected[3:], ("a", 5, 10.0), ("c", 3, 30.0), ("g", 2, 10.0), ("h", 5, 10.0)]
    )
    for _ in range(2):
        assert content(store) == expected
        store.upsert(second, "TripFacts")


def test_new_rows_follow_a_cut_off_publication(spark, monkeypatch):
    store = TableStore(spark, scratch_path(spark, "store"))
    store.upsert(spark.createDataFrame([trip("a", 1), trip("b", 1)], TRIP_SCHEMA), "TripFacts")
    batch = spark.createDataFrame([trip("b", 1, 11.0), trip("c", 2)], TRIP_SCHEMA)
    write = TableStore._write

    def cut(self, df, name, mode):
        if mode == "append":
            raise RuntimeError("cut off")
        return write(self, df, name, mode)

    with monkeypatch.context() as patch:
        patch.setattr(TableStore, "_write", cut)
        try:
            store.upsert(batch, "TripFacts")
        except RuntimeError:
            pass
    assert content(store) == [("a", 1, 10.0), ("b", 1, 11.0)]
    for _ in range(2):
        store.upsert(batch, "TripFacts")
        assert content(store) == [("a", 1, 10.0), ("b", 1, 11.0), ("c", 2, 10.0)]
