"""Message parsing, invoice files, header rules."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from carbonhaul.operators import invoice_intake, trip_intake
from carbonhaul.operators.constraints import split
from carbonhaul.schemas import FUEL_INVOICES_FROM_FILES, TRIP_FACTS_FROM_MESSAGES
from carbonhaul.sources import invoice_files, messages
from carbonhaul.sources.tables import TableStore
from carbonhaul.streaming import jobs

GOOD = (
    '{"messageId":"m","vin":"V","tripId":"t","startTime":"2025-01-01T06:00:00Z",'
    '"endTime":"2025-01-01T08:00:00+00:00","totalDistance":%s,"fuelConsumed":30.5,"maxSpeed":"x"}'
)


def check(spark, *lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return trip_intake.with_reasons(trip_intake.typed(messages.parse(df)))


@pytest.mark.parametrize(
    "line, reasons",
    [
        (GOOD % "100", []),
        (GOOD % '" 1e2 "', []),
        (GOOD % '"n/a"', ["distance_not_positive"]),
        (GOOD % "0", ["distance_not_positive"]),
        (GOOD % "null", ["missing_totalDistance"]),
        ((GOOD % "100")[:50], ["malformed_json"]),
        ("[1, 2]", ["malformed_json"]),
        ('"text"', ["malformed_json"]),
        ("", ["malformed_json"]),
        ((GOOD % "100").replace("2025-01-01T06:00:00Z", "06:00"), ["unreadable_time"]),
        ((GOOD % "100").replace("T06", "T08"), ["start_not_before_end"]),
    ],
)
def test_reasons(spark, line, reasons):
    assert check(spark, line).first()["reject_reasons"] == reasons


def test_bad_number_costs_the_field_only(spark):
    accepted, rejected = split(check(spark, GOOD % "100"))
    row = trip_intake.trip_rows(accepted, F.current_timestamp()).first()
    assert row["MaxSpeed"] is None and row["Distance_km"] == 100.0
    assert row["TripDate"] == dt.date(2025, 1, 1)
    assert rejected.count() == 0


def test_parser_runs_once_per_line(spark, explain):
    accepted, _ = split(check(spark, GOOD % "100"))
    assert explain(trip_intake.trip_rows(accepted, F.current_timestamp())).count("from_json") == 1


def columns_of(spark, *headers):
    """{column: header} for each list of headers."""
    df = spark.createDataFrame([(list(h),) for h in headers], "names array<string>")
    at = invoice_files.canonical(F.col("names"))
    rows = df.select("names", *[p.alias(c) for c, p in at.items()]).collect()
    return [{c: r["names"][r[c] - 1] for c in at if r[c]} for r in rows]


def test_header_rules(spark):
    first, own, date = columns_of(
        spark,
        "vehicle_id;invoice_date;liters;amount_eur;invoice_number;vendor;fuel_type;station".split(";"),
        # a column's own name wins over a word inside another header
        ["eur_per_litre", "Total litres", ' "Litres" ', "VIN"],
        ["InvoiceMonth", "note"],
    )
    assert list(first) == ["VIN", "InvoiceDate", "Litres", "EUR_Amount", "InvoiceNumber", "SupplierName",
                           "FuelType", "Location"]
    assert own == {"Litres": ' "Litres" ', "VIN": "VIN"} and date == {"InvoiceDate": "InvoiceMonth"}


def test_header_order_does_not_matter(spark):
    meaning = {
        "VIN": "Vehicle", "InvoiceDate": "Invoice Month", "Litres": "Volume", "EUR_Amount": "Cost",
        "InvoiceNumber": "Invoice Number", "SupplierName": "Provider", "FuelType": "Fuel Type",
        "Location": "Site",
    }
    rng = random.Random(1)
    orders = [rng.sample(sorted(meaning.values()), 8) for _ in range(200)]
    assert columns_of(spark, *orders) == [meaning] * 200


def test_one_scan_without_python_finds_the_headers(spark, tmp_path, explain):
    write(tmp_path, "bom.csv", "\ufeffVIN;Litres\r\nV1;5\r\n\r\nVIN;Litres\r\nV2;6,5\r\n")
    write(tmp_path, "blank.csv", "\n \nLitres,VIN,more\n7,\"V3, really\",x,y,z\n8\n")
    write(tmp_path, "endless.csv", "x" * 1000)
    write(tmp_path, "none.csv", "")
    rows = invoice_files.read_files(spark, str(tmp_path))
    plan = explain(rows)
    assert "Python" not in plan and "MapInPandas" not in plan and plan.count("Scan text") == 1
    got = sorted((r["VIN"] or "", r["Litres"], r["columns_present"]) for r in rows.collect())
    # "endless" is a header without rows
    assert got == [("", "8", ["VIN", "Litres"]), ("V1", "5", ["VIN", "Litres"]),
                   ("V2", "6,5", ["VIN", "Litres"]), ("V3, really", "7", ["VIN", "Litres"])]


def test_an_endless_line_is_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(invoice_files, "LONGEST_LINE", 1 << 16)
    write(tmp_path, "a.csv", "VIN,Litres\nV1,5\n" + "x" * (1 << 20) + "\nV2,6\n")
    write(tmp_path, "b.csv", "y" * (1 << 20))
    rows = invoice_files.read_files(spark, str(tmp_path)).collect()
    assert sorted(r["VIN"] for r in rows) == ["V1", "V2"]


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)


def test_files_of_three_layouts(spark, tmp_path):
    write(tmp_path, "a.csv", "VIN,InvoiceDate,Litres,EUR_Amount\nV1,2025-02-03,10,15\n")
    write(tmp_path, "deep/b.txt",
          "vehicle_id;invoice_date;liters;amount_eur;vendor\nV2;2025-03-04;20;;Acme, Ltd\n")
    write(tmp_path, "deep/c.tsv", "Vehicle\tInvoice Month\tVolume\tCost\nV3\t2025-04-01\t-1\t5\n")
    write(tmp_path, "d.json", "{}")
    files = invoice_files.list_files(spark, str(tmp_path))
    assert files.count() == 3
    raw = invoice_files.read_files(spark, str(tmp_path))
    rows = invoice_intake.transform(raw, F.current_timestamp()).orderBy("VIN").collect()
    assert [(r["VIN"], r["InvoiceMonth"], r["Litres"], r["EUR_Amount"], r["EUR_per_Litre"])
            for r in rows] == [
        ("V1", dt.date(2025, 2, 1), 10.0, 15.0, 1.5),
        ("V2", dt.date(2025, 3, 1), 20.0, 0.0, 0.0),
        ("V3", dt.date(2025, 4, 1), 0.0, 5.0, 0.0),
    ]
    assert rows[1]["SupplierName"] == "Acme, Ltd" and rows[1]["FuelType"] == "DIESEL"
    assert rows[2]["SourceFile"].endswith("deep/c.tsv")


def test_report_findings(spark):
    df = spark.createDataFrame(
        [("V1", -1.0, 5.0, "i1"), ("V2", 2.0, 5.0, "i1"), (None, 3.0, 5.0, None)],
        "VIN string, Litres double, EUR_Amount double, InvoiceNumber string",
    )
    row = invoice_intake.validation_report(df).first()
    assert row["errors"] == [
        "Column VIN has 33.3% null values",
        "Found 1 records with negative litres",
        "Found 1 duplicate invoice numbers",
    ]
    assert not row["is_valid"]
    empty = invoice_intake.validation_report(df.where("false")).first()
    assert empty["errors"] == ["Dataset is empty"]
    short = invoice_intake.validation_report(df.select("VIN", "Litres").where("Litres > 2.5"))
    assert "Missing required columns: ['EUR_Amount']" in short.first()["errors"]


def test_missing_date_column_takes_today(spark):
    df = spark.createDataFrame([("V",)], "VIN string")
    row = invoice_intake.with_month(df, today="2025-05-17").first()
    assert (row["InvoiceDate"], row["InvoiceMonth"]) == (dt.date(2025, 5, 17), dt.date(2025, 5, 1))


DROPS = {
    "full.csv": "VIN,InvoiceDate,Litres,EUR_Amount,InvoiceNumber,SupplierName,FuelType\n"
                "V1,2025-02-03,10,15,i1,Acme,HVO\nV2,2025-02-04,11,16,i2,,\n",
    "no_supplier.csv": "VIN,InvoiceDate,Litres,EUR_Amount,InvoiceNumber\nV3,2025-02-05,12,17,i3\n",
    "no date.csv": "VIN,Litres,EUR_Amount,InvoiceNumber\nV4,13,18,i4\n",
    "no_vin.csv": "InvoiceDate,Litres,EUR_Amount,InvoiceNumber\n2025-02-06,14,19,i5\n",
    "header_only.csv": "VIN,InvoiceDate,Litres,EUR_Amount\n",
    "again.csv": "VIN,InvoiceDate,Litres,EUR_Amount,InvoiceNumber,SupplierName\n"
                 "V1,2025-02-03,20,25,i1,Later\n",
}


@pytest.mark.parametrize("max_files", [1, 2, 100])
def test_files_give_one_result_in_any_batches(spark, tmp_path, max_files):
    for i, (name, text) in enumerate(reversed(DROPS.items())):
        write(tmp_path / "in", name, text)
        # the later file comes first where files are read one by one
        os.utime(tmp_path / "in" / name, (1_700_000_000 - 60 * i, 1_700_000_000 - 60 * i))
    os.utime(tmp_path / "in" / "again.csv", (1_700_009_000, 1_700_009_000))
    spec = FUEL_INVOICES_FROM_FILES
    store = TableStore(spark, str(tmp_path / "store"), {spec.name: spec})
    rejects = str(tmp_path / "rejects")
    jobs.finish(jobs.ingest_invoice_files(
        spark, str(tmp_path / "in"), store, rejects, str(tmp_path / "progress"), max_files
    ))
    rows = store.read(spec.name).orderBy("VIN").collect()
    today = rows[3]["InvoiceDate"]
    assert abs((today - dt.datetime.now(dt.timezone.utc).date()).days) <= 1
    assert [(r["VIN"], r["InvoiceDate"], r["Litres"], r["SupplierName"], r["FuelType"])
            for r in rows] == [
        ("V1", dt.date(2025, 2, 3), 20.0, "Later", "DIESEL"),
        ("V2", dt.date(2025, 2, 4), 11.0, None, None),
        ("V3", dt.date(2025, 2, 5), 12.0, "UNKNOWN", "DIESEL"),
        ("V4", today, 13.0, "UNKNOWN", "DIESEL"),
    ]
    refused = spark.read.json(rejects).select("raw", "reject_reasons").collect()
    assert {(r["reject_reasons"], "header_only" in r["raw"]) for r in refused} == {
        ("Missing required columns: ['VIN']", False), ("Dataset is empty", True),
    }


@pytest.mark.parametrize("batches", [[[0, 1, 2, 3]], [[3], [2], [1], [0]], [[1, 3], [0, 2]]])
def test_messages_give_one_result_in_any_batches(spark, tmp_path, batches):
    def message(trip, minute, fuel, identity):
        return GOOD.replace('"t"', f'"{trip}"').replace('"m"', f'"{identity}"').replace(
            "30.5", str(fuel)).replace('"maxSpeed"', f'"timestamp":"2025-01-01T09:{minute}:00Z","maxSpeed"'
        ) % "100"

    lines = [message("a", "01", 1, "m1"), message("a", "03", 3, "m2"),
             message("a", "02", 2, "m3"), message("a", "03", 4, "m2")]
    spec = TRIP_FACTS_FROM_MESSAGES
    store = TableStore(spark, str(tmp_path / "store"), {spec.name: spec})
    for i, batch in enumerate(batches):
        write(tmp_path / "in", f"{i}.txt", "".join(lines[n] + "\n" for n in batch))
        jobs.finish(jobs.ingest_messages(
            messages.json_lines_stream(spark, str(tmp_path / "in")), store,
            str(tmp_path / "rejects"), str(tmp_path / "progress"),
        ))
    assert [(r["TripID"], r["Fuel_l"]) for r in store.read(spec.name).collect()] == [("a", 4.0)]
