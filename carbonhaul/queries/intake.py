"""Sources, validation, upserts and table maintenance."""

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import planar_km
from ..functions.ratios import unit_price
from ..operators import invoice_intake, trip_intake
from ..operators.constraints import (
    REASONS,
    check_violations,
    conform,
    key_violations,
    split,
    union_all,
)
from ..operators.merge import merge
from ..schemas import (
    FUEL_INVOICES,
    FUEL_INVOICES_FROM_FILES,
    MESSAGE_NUMBERS,
    PRICE_CURVE,
    SCENARIO_RUN,
    TRIP_FACTS,
    TRIP_FACTS_FROM_MESSAGES,
)
from ..session import scratch_path
from ..sources import invoice_files, messages
from ..sources import testdata as src
from ..sources.tables import TableStore, cluster
from ..streaming import jobs
from .registry import query
from .scenario import yearly_scenarios

# ---- trip-end messages -----------------------------------------------------------------------

# every tenth message is delivered twice; 'error' messages are cut off for every third number
MESSAGES_SQL = """(SELECT *, event_type = 'error' AND event_id % 3 = 0 AS cut,
   event_id % 101 = 0 AS no_start, event_id % 97 = 0 AND event_id % 101 <> 0 AS bad_start,
   event_id % 89 = 0 AS bad_km, event_id % 83 = 0 AS bad_speed
 FROM telematics, range(2) c(copy) WHERE copy = 0 OR event_id % 10 = 0)"""

REASONS_SQL = """concat_ws(',',
   CASE WHEN cut THEN 'malformed_json' END,
   CASE WHEN NOT cut AND vin IS NULL THEN 'missing_vin' END,
   CASE WHEN NOT cut AND no_start THEN 'missing_startTime' END,
   CASE WHEN NOT cut AND bad_start THEN 'unreadable_time' END,
   CASE WHEN NOT cut AND (bad_km OR distance_km <= 0) THEN 'distance_not_positive' END,
   CASE WHEN NOT cut AND fuel_l <= 0 THEN 'fuel_not_positive' END)"""


def checked_messages(spark, sf):
    return trip_intake.with_reasons(
        trip_intake.typed(messages.parse(src.messages(spark, sf)))
    )


@query(
    "json_corrupt_split",
    f"""SELECT cut AS malformed, count(*) AS messages, count(DISTINCT CASE WHEN NOT cut THEN tripId END) AS trips,
               sum(CASE WHEN cut THEN 40 ELSE 0 END)::BIGINT AS malformed_chars
        FROM {MESSAGES_SQL} GROUP BY ALL""",
)
def json_corrupt_split(spark, sf):
    """Malformed lines are set apart; the batch goes on."""
    parsed = messages.parse(src.messages(spark, sf))
    return parsed.groupBy("malformed").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_distinct("tripId").alias("trips"),
        F.sum(F.when(F.col("malformed"), F.length("raw")).otherwise(0)).alias("malformed_chars"),
    )


@query(
    "trip_required_fields",
    f"""SELECT messageId, concat_ws(',', CASE WHEN vin IS NULL THEN 'vin' END,
               CASE WHEN no_start THEN 'startTime' END) AS missing_fields
        FROM {MESSAGES_SQL} WHERE NOT cut AND (vin IS NULL OR no_start)""",
)
def trip_required_fields(spark, sf):
    parsed = trip_intake.typed(messages.parse(src.messages(spark, sf)))
    return parsed.where(~F.col("malformed") & (F.size("missing") > 0)).select(
        "messageId", F.concat_ws(",", "missing").alias("missing_fields")
    )


@query(
    "trip_try_cast",
    f"""SELECT messageId, startLatitude, startLongitude, endLatitude, endLongitude,
               CASE WHEN NOT bad_km THEN distance_km END AS totalDistance, fuel_l AS fuelConsumed,
               engineHours, idleTime, CASE WHEN NOT bad_speed THEN maxSpeed END AS maxSpeed, avgSpeed
        FROM {MESSAGES_SQL} WHERE NOT cut""",
)
def trip_try_cast(spark, sf):
    parsed = trip_intake.typed(messages.parse(src.messages(spark, sf)))
    return parsed.where(~F.col("malformed")).select("messageId", *MESSAGE_NUMBERS)


@query(
    "trip_parse_ts",
    f"""SELECT messageId, CASE WHEN NOT no_start AND NOT bad_start THEN startTimeUTC END AS startTime,
               endTimeUTC AS endTime, date_trunc('millisecond', processedTime) AS message_time
        FROM {MESSAGES_SQL} WHERE NOT cut""",
)
def trip_parse_ts(spark, sf):
    parsed = trip_intake.typed(messages.parse(src.messages(spark, sf)))
    return parsed.where(~F.col("malformed")).select(
        "messageId", "startTime", "endTime", F.col("timestamp").alias("message_time")
    )


@query(
    "trip_business_rules",
    f"""SELECT tripId, count(*) AS copies, max(distance_km) AS distance_km, max(fuel_l) AS fuel_l
        FROM {MESSAGES_SQL} WHERE NOT cut AND vin IS NOT NULL AND NOT no_start AND NOT bad_start
         AND NOT bad_km AND distance_km > 0 AND fuel_l > 0 AND startTimeUTC < endTimeUTC
        GROUP BY tripId""",
)
def trip_business_rules(spark, sf):
    accepted, _ = split(checked_messages(spark, sf))
    return accepted.groupBy("tripId").agg(
        F.count(F.lit(1)).alias("copies"),
        F.max("totalDistance").alias("distance_km"),
        F.max("fuelConsumed").alias("fuel_l"),
    )


@query(
    "trip_quarantine",
    f"""SELECT * FROM (SELECT CASE WHEN NOT cut THEN messageId END AS messageId, {REASONS_SQL} AS reject_reasons
        FROM {MESSAGES_SQL}) WHERE reject_reasons <> ''""",
)
def trip_quarantine(spark, sf):
    """Rejected messages with every violated rule."""
    _, rejected = split(checked_messages(spark, sf))
    return rejected.select("messageId", F.concat_ws(",", REASONS).alias(REASONS))


TRIP_ROWS_SQL = f"""SELECT tripId AS TripID, vin AS VIN, startTimeUTC AS StartTimeUTC, endTimeUTC AS EndTimeUTC,
     distance_km AS Distance_km, fuel_l AS Fuel_l, startLatitude AS StartLat, startLongitude AS StartLon,
     endLatitude AS EndLat, endLongitude AS EndLon, CAST(startTimeUTC AS DATE) AS TripDate,
     date_trunc('millisecond', processedTime) AS ProcessedTime, 'TELEMATICS_KAFKA' AS DataSource,
     messageId AS MessageId, driverId AS DriverId, routeId AS RouteId, engineHours AS EngineHours,
     idleTime AS IdleTime, CASE WHEN NOT bad_speed THEN maxSpeed END AS MaxSpeed, avgSpeed AS AvgSpeed
   FROM {MESSAGES_SQL} WHERE {REASONS_SQL} = ''"""


@query("trip_project", TRIP_ROWS_SQL)
def trip_project(spark, sf):
    """Accepted messages as trip rows with lineage."""
    accepted, _ = split(checked_messages(spark, sf))
    return trip_intake.trip_rows(accepted, F.col("timestamp"))


@query(
    "stream_json_source",
    f"SELECT DISTINCT * EXCLUDE (ProcessedTime) FROM ({TRIP_ROWS_SQL})",
)
def stream_json_source(spark, sf):
    """The whole job: message stream, validation, upsert by trip number, table scan."""
    spec = TRIP_FACTS_FROM_MESSAGES
    store = TableStore(spark, scratch_path(spark, "trips"), {spec.name: spec})
    lines = src.message_text(src.event_stream(spark, sf))
    jobs.finish(
        jobs.ingest_messages(
            lines, store, scratch_path(spark, "rejects"), scratch_path(spark, "progress")
        )
    )
    return store.read(spec.name).drop("ProcessedTime", "MessageTime")


# ---- invoices --------------------------------------------------------------------------------


def delivered(spark, sf):
    """Invoices as delivered, columns in the order of a drop."""
    return src.raw_invoices(spark, sf)


@query(
    "fuel_validation_report",
    """SELECT *, concat_ws('; ',
          CASE WHEN null_VIN / rows * 100 > 10 THEN concat('Column VIN has ', format('{:,.1f}', null_VIN / rows * 100), '% null values') END,
          CASE WHEN null_Litres / rows * 100 > 10 THEN concat('Column Litres has ', format('{:,.1f}', null_Litres / rows * 100), '% null values') END,
          CASE WHEN null_EUR_Amount / rows * 100 > 10 THEN concat('Column EUR_Amount has ', format('{:,.1f}', null_EUR_Amount / rows * 100), '% null values') END,
          CASE WHEN negative_Litres > 0 THEN concat('Found ', negative_Litres, ' records with negative litres') END,
          CASE WHEN negative_EUR_Amount > 0 THEN concat('Found ', negative_EUR_Amount, ' records with negative amounts') END,
          CASE WHEN duplicates > 0 THEN concat('Found ', duplicates, ' duplicate invoice numbers') END) AS errors,
        null_VIN / rows * 100 <= 10 AND null_Litres / rows * 100 <= 10 AND null_EUR_Amount / rows * 100 <= 10
          AND negative_Litres = 0 AND negative_EUR_Amount = 0 AND duplicates = 0 AS is_valid
       FROM (SELECT SourceDrop, count(*) AS rows, count(*) FILTER (VIN IS NULL) AS null_VIN,
          count(*) FILTER (Litres IS NULL) AS null_Litres,
          count(*) FILTER (EUR_Amount IS NULL) AS null_EUR_Amount,
          count(*) FILTER (Litres < 0) AS negative_Litres,
          count(*) FILTER (EUR_Amount < 0) AS negative_EUR_Amount,
          count(InvoiceNumber) - count(DISTINCT InvoiceNumber) AS duplicates
        FROM raw_invoices GROUP BY ALL)""",
)
def fuel_validation_report(spark, sf):
    """Findings per drop from one aggregation."""
    report = invoice_intake.validation_report(delivered(spark, sf), by=["SourceDrop"])
    return report.withColumn("errors", F.concat_ws("; ", "errors"))


@query(
    "fuel_defaults",
    """SELECT InvoiceNumber, VIN, Litres, EUR_Amount, 'UNKNOWN' AS SupplierName, 'DIESEL' AS FuelType,
              'UNKNOWN' AS Location FROM raw_invoices""",
)
def fuel_defaults(spark, sf):
    """A drop without supplier, fuel type and location."""
    drop = delivered(spark, sf).select("InvoiceNumber", "VIN", "Litres", "EUR_Amount")
    return invoice_intake.with_defaults(drop)


@query(
    "fuel_invoice_month",
    """SELECT InvoiceNumber, VIN, CAST(InvoiceDate AS DATE) AS InvoiceDate,
              CAST(date_trunc('month', CAST(InvoiceDate AS DATE)) AS DATE) AS InvoiceMonth FROM raw_invoices""",
)
def fuel_invoice_month(spark, sf):
    return invoice_intake.with_month(delivered(spark, sf)).select(
        "InvoiceNumber", "VIN", "InvoiceDate", "InvoiceMonth"
    )


@query(
    "fuel_clean_numeric",
    """SELECT InvoiceNumber, VIN, CASE WHEN Litres > 0 THEN Litres ELSE 0 END AS Litres,
              CASE WHEN EUR_Amount > 0 THEN EUR_Amount ELSE 0 END AS EUR_Amount FROM raw_invoices""",
)
def fuel_clean_numeric(spark, sf):
    return delivered(spark, sf).select(
        "InvoiceNumber",
        "VIN",
        *[invoice_intake.clean_number(F.col(c)).alias(c) for c in invoice_intake.NUMBERS],
    )


@query(
    "fuel_unit_price",
    """SELECT InvoiceNumber, VIN, CASE WHEN Litres > 0 THEN EUR_Amount / Litres ELSE 0 END AS EUR_per_Litre
       FROM (SELECT InvoiceNumber, VIN, CASE WHEN Litres > 0 THEN Litres ELSE 0 END AS Litres,
              CASE WHEN EUR_Amount > 0 THEN EUR_Amount ELSE 0 END AS EUR_Amount FROM raw_invoices)""",
)
def fuel_unit_price(spark, sf):
    clean = fuel_clean_numeric(spark, sf)
    return clean.select(
        "InvoiceNumber", "VIN",
        unit_price(F.col("EUR_Amount"), F.col("Litres")).alias("EUR_per_Litre"),
    )


# Three layouts of a drop: folder, delimiter, headers
LAYOUTS = (
    ("comma", ",", ("VIN", "InvoiceDate", "Litres", "EUR_Amount", "InvoiceNumber",
                    "SupplierName")),
    ("semicolon", ";", ("vehicle_id", "invoice_date", "liters", "amount_eur", "invoice_number",
                        "vendor")),
    ("tab", "\t", ("Vehicle", "Invoice Month", "Volume", "Cost", "Invoice Number",
                   "Provider")),
)
DROP_COLUMNS = LAYOUTS[0][2]


def write_drops(spark, sf):
    """Write every delivered drop (a bounded number of vehicles) as one file, in one of three
    layouts, in one pass; returns the folder."""
    folder = scratch_path(spark, "drop")
    number = F.col("SourceDrop") % 3
    by_layout = lambda values: F.element_at(
        F.array(*map(F.lit, values)), number.cast("int") + 1
    )
    separator = by_layout([x[1] for x in LAYOUTS])
    fields = F.transform(
        F.array(*[F.col(c).cast("string") for c in DROP_COLUMNS]), lambda x: F.coalesce(x, F.lit(""))
    )
    header = by_layout([x[1].join(x[2]) for x in LAYOUTS])
    line = F.call_function("array_join", fields, separator)
    first = F.row_number().over(Window.partitionBy("SourceDrop").orderBy("VIN", "InvoiceDate")) == 1
    rows = delivered(spark, sf).select("SourceDrop", *DROP_COLUMNS, first.alias("first"))
    both = F.when(F.col("first"), F.array(header, line)).otherwise(F.array(line))
    (
        rows.select(
            by_layout([x[0] for x in LAYOUTS]).alias("layout"), "SourceDrop", "first",
            F.posexplode(both).alias("place", "value"),
        )
        .sortWithinPartitions("layout", "SourceDrop", F.desc("first"), "place")
        .select("layout", "SourceDrop", "value")
        .write.partitionBy("layout", "SourceDrop").text(folder)
    )
    return folder


def file_drop(path):
    return F.regexp_extract(path, r"SourceDrop=(\d+)", 1).cast("bigint").alias("SourceDrop")


def file_layout(path):
    return F.regexp_extract(path, r"layout=(\w+)/", 1).alias("layout")


LAYOUT_SQL = """CASE SourceDrop % 3 WHEN 0 THEN 'comma' WHEN 1 THEN 'semicolon' ELSE 'tab' END AS layout"""


@query(
    "src_file_discovery",
    f"""SELECT DISTINCT {LAYOUT_SQL}, SourceDrop, CAST(1 AS BIGINT) AS files, true AS has_bytes FROM raw_invoices""",
)
def src_file_discovery(spark, sf):
    """Files found below a folder; contents are not read."""
    found = invoice_files.list_files(spark, write_drops(spark, sf))
    return found.groupBy(file_layout("path"), file_drop("path")).agg(
        F.count(F.lit(1)).alias("files"), (F.sum("length") > 0).alias("has_bytes")
    )


@query(
    "csv_header_aliases",
    f"""SELECT {LAYOUT_SQL}, SourceDrop, VIN, InvoiceDate, Litres, EUR_Amount, InvoiceNumber, SupplierName
        FROM raw_invoices""",
)
def csv_header_aliases(spark, sf):
    """Files with three delimiters and three sets of headers as one frame."""
    rows = invoice_files.read_files(spark, write_drops(spark, sf))
    return rows.select(
        file_layout("SourceFile"),
        file_drop("SourceFile"),
        "VIN",
        "InvoiceDate",
        *[F.col(c).try_cast("double").alias(c) for c in invoice_intake.NUMBERS],
        "InvoiceNumber",
        "SupplierName",
    )


@query(
    "fuel_metadata",
    f"""SELECT {LAYOUT_SQL}, SourceDrop, VIN, CAST(InvoiceDate AS DATE) AS InvoiceDate,
          CAST(date_trunc('month', CAST(InvoiceDate AS DATE)) AS DATE) AS InvoiceMonth,
          CASE WHEN Litres > 0 THEN Litres ELSE 0 END AS Litres,
          CASE WHEN EUR_Amount > 0 THEN EUR_Amount ELSE 0 END AS EUR_Amount,
          CASE WHEN Litres > 0 THEN CASE WHEN EUR_Amount > 0 THEN EUR_Amount ELSE 0 END / Litres ELSE 0 END AS EUR_per_Litre,
          InvoiceNumber, SupplierName, 'DIESEL' AS FuelType, 'UNKNOWN' AS Location,
          'CSV_IMPORT' AS DataSource, true AS has_time
        FROM raw_invoices""",
)
def fuel_metadata(spark, sf):
    """The full invoice row with source file, source name and processing time."""
    rows = invoice_intake.transform(
        invoice_files.read_files(spark, write_drops(spark, sf)), F.current_timestamp()
    )
    return rows.select(
        file_layout("SourceFile"),
        file_drop("SourceFile"),
        "VIN", "InvoiceDate", "InvoiceMonth", "Litres", "EUR_Amount", "EUR_per_Litre",
        "InvoiceNumber", "SupplierName", "FuelType", "Location", "DataSource",
        F.col("ProcessedTime").isNotNull().alias("has_time"),
    )


# files of kinds 1 to 3 have findings and are refused as a whole
@query(
    "stream_file_ingest",
    """SELECT VIN, CAST(date_trunc('month', CAST(InvoiceDate AS DATE)) AS DATE) AS InvoiceMonth, Litres,
              EUR_Amount, EUR_Amount / Litres AS EUR_per_Litre, InvoiceNumber, SupplierName,
              CAST(InvoiceDate AS DATE) AS InvoiceDate, 'DIESEL' AS FuelType, 'UNKNOWN' AS Location,
              'CSV_IMPORT' AS DataSource
       FROM raw_invoices r WHERE VIN IS NOT NULL AND Litres > 0 AND EUR_Amount > 0
        AND SourceDrop IN (SELECT SourceDrop FROM raw_invoices GROUP BY SourceDrop
          HAVING count(*) FILTER (Litres < 0) = 0
             AND count(*) FILTER (EUR_Amount IS NULL) * 10 <= count(*)
             AND count(*) FILTER (VIN IS NULL) * 10 <= count(*)
             AND count(InvoiceNumber) = count(DISTINCT InvoiceNumber))""",
)
def stream_file_ingest(spark, sf):
    """The whole job: new files are listed once, checked per file and upserted."""
    folder = write_drops(spark, sf)
    spec = FUEL_INVOICES_FROM_FILES
    store = TableStore(spark, scratch_path(spark, "invoices"), {spec.name: spec})
    jobs.finish(
        jobs.ingest_invoice_files(
            spark, folder, store, scratch_path(spark, "rejects"), scratch_path(spark, "progress")
        )
    )
    return store.read(spec.name).drop("CreatedDate", "ProcessedTime", "SourceFile", "FileTime")


@query(
    "src_csv_scan",
    """SELECT TripID, VIN, date_trunc('second', StartTimeUTC) AS StartTimeUTC, EndTimeUTC, Distance_km, Fuel_l FROM trips""",
)
def src_csv_scan(spark, sf):
    """Trips written as CSV and scanned with a declared schema and formats."""
    path = scratch_path(spark, "csv")
    columns = ["TripID", "VIN", "StartTimeUTC", "EndTimeUTC", "Distance_km", "Fuel_l"]
    rows = src.trips(spark, sf).select(*columns)
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c in columns[2:4]})
    rows.write.option("header", "true").option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss"
    ).csv(path)
    return invoice_files.read_table_csv(spark, path, rows.schema)


@query(
    "copy_into_defaults",
    """SELECT PriceMonth, EUR_per_t, PriceSource, CAST(0.15 AS DOUBLE) AS Volatility, true AS has_time
       FROM price_curve""",
)
def copy_into_defaults(spark, sf):
    """A load that names three of five columns; the others take their defaults. Loading the
    folder again finds no new files."""
    path, progress = scratch_path(spark, "csv"), scratch_path(spark, "progress")
    curve = src.price_curve(spark, sf)
    curve.write.option("header", "true").csv(path)
    store = TableStore(spark, scratch_path(spark, "prices"))
    for _ in range(2):
        jobs.finish(
            jobs.copy_into(spark, path, curve.schema, store, PRICE_CURVE.name, progress)
        )
    return store.read(PRICE_CURVE.name).select(
        "PriceMonth", "EUR_per_t", "PriceSource", "Volatility",
        F.col("LastUpdated").isNotNull().alias("has_time"),
    )


# ---- tables ----------------------------------------------------------------------------------

TRIP_COLUMNS_SQL = """TripID, VIN, StartTimeUTC, EndTimeUTC, Distance_km, Fuel_l, StartLat, StartLon, EndLat, EndLon, TripDate"""


def stored_trips(spark, sf):
    """Trips in a stored table. It is left unpartitioned here: the few rows per day of the test
    data would make thousands of tiny files."""
    spec = replace(TRIP_FACTS, partition_by=())
    store = TableStore(spark, scratch_path(spark, "trips"), {spec.name: spec})
    store.overwrite(src.trips(spark, sf), spec.name)
    return store


@query("src_table_scan", f"SELECT {TRIP_COLUMNS_SQL} FROM trips")
def src_table_scan(spark, sf):
    """Write the trip table and scan it."""
    return stored_trips(spark, sf).read(TRIP_FACTS.name)


@query(
    "sink_partitioned",
    """SELECT InvoiceMonth, count(*) AS invoices, sum(Litres) AS litres, sum(EUR_Amount) AS eur
       FROM invoices GROUP BY ALL""",
)
def sink_partitioned(spark, sf):
    """Invoices in one partition per month, summed from the stored table."""
    store = TableStore(spark, scratch_path(spark, "invoices"))
    store.overwrite(src.invoices(spark, sf), FUEL_INVOICES.name)
    return store.read(FUEL_INVOICES.name).groupBy("InvoiceMonth").agg(
        F.count(F.lit(1)).alias("invoices"),
        F.sum("Litres").alias("litres"),
        F.sum("EUR_Amount").alias("eur"),
    )


@query(
    "merge_upsert_trips",
    """SELECT TripID, VIN, StartTimeUTC, Distance_km, Fuel_l FROM (
         SELECT concat('T', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS TripID,
                concat('WDBM', lpad(CAST(l_suppkey AS VARCHAR), 13, '0')) AS VIN,
                l_shipdate + INTERVAL '29' YEAR AS StartTimeUTC, l_quantity * 25 AS Distance_km,
                l_quantity * (20 + 3 * l_linenumber + l_partkey % 3) / 4 AS Fuel_l,
                row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                  ORDER BY l_linestatus DESC, l_shipdate + INTERVAL '29' YEAR DESC,
                           l_suppkey DESC, l_quantity DESC,
                           l_quantity * (20 + 3 * l_linenumber + l_partkey % 3) DESC) AS rn
         FROM lineitem) WHERE rn = 1""",
)
def merge_upsert_trips(spark, sf):
    """An earlier load of trips upserted with a later one; the later load wins."""
    existing, incoming = src.trip_loads(spark, sf)
    keys, order = ["TripID"], ["StartTimeUTC"]
    base = merge(incoming.limit(0), existing, keys, order)
    return merge(base, incoming, keys, order)


@query(
    "merge_upsert_invoices",
    """WITH corrections AS (SELECT VIN, InvoiceMonth, Litres + 64 AS Litres, EUR_Amount + 64 AS EUR_Amount,
              CASE WHEN month(InvoiceMonth) = 12 THEN NULL ELSE InvoiceNumber END AS InvoiceNumber, SupplierName
         FROM invoices WHERE SupplierName LIKE '%Fleet%')
       SELECT * FROM corrections
       UNION ALL
       SELECT VIN, InvoiceMonth, Litres, EUR_Amount, InvoiceNumber, SupplierName FROM invoices i
       WHERE NOT EXISTS (SELECT 1 FROM corrections c WHERE c.VIN = i.VIN AND c.InvoiceMonth = i.InvoiceMonth
                          AND c.InvoiceNumber = i.InvoiceNumber)""",
)
def merge_upsert_invoices(spark, sf):
    """Corrections replace invoices; a correction without a number matches nothing."""
    existing = src.invoices(spark, sf)
    corrections = existing.where(F.col("SupplierName").contains("Fleet")).select(
        "VIN",
        "InvoiceMonth",
        (F.col("Litres") + 64).alias("Litres"),
        (F.col("EUR_Amount") + 64).alias("EUR_Amount"),
        F.when(F.month("InvoiceMonth") != 12, F.col("InvoiceNumber")).alias("InvoiceNumber"),
        "SupplierName",
    )
    keys = ["VIN", "InvoiceNumber", "InvoiceMonth"]
    return merge(existing, corrections, keys, ["Litres"])


@query(
    "ddl_generated_cols",
    """SELECT VIN, InvoiceMonth, Litres, EUR_Amount, EUR_Amount / Litres AS EUR_per_Litre, InvoiceNumber,
              SupplierName, true AS has_time FROM invoices""",
)
def ddl_generated_cols(spark, sf):
    """Rows in table form: generated price per litre, default creation time."""
    rows = conform(src.invoices(spark, sf), FUEL_INVOICES)
    return rows.withColumn("has_time", F.col("CreatedDate").isNotNull()).drop("CreatedDate")


@query(
    "check_constraints",
    """SELECT 'TripFacts' AS table_name, 'chk_trip_duration' AS constraint_name, count(*) FILTER (NOT EndTimeUTC > StartTimeUTC) AS violations FROM trips
       UNION ALL SELECT 'TripFacts', 'chk_positive_distance', count(*) FILTER (NOT Distance_km > 0) FROM trips
       UNION ALL SELECT 'TripFacts', 'chk_positive_fuel', count(*) FILTER (NOT Fuel_l > 0) FROM trips
       UNION ALL SELECT 'FuelInvoices', 'chk_positive_litres', count(*) FILTER (Litres IS NULL OR NOT Litres > 0) FROM raw_invoices
       UNION ALL SELECT 'FuelInvoices', 'chk_positive_amount', count(*) FILTER (EUR_Amount IS NULL OR NOT EUR_Amount > 0) FROM raw_invoices
       UNION ALL SELECT 'ETSPriceCurve', 'chk_positive_price', count(*) FILTER (NOT EUR_per_t > 0) FROM price_curve
       UNION ALL SELECT 'ScenarioRun', 'chk_positive_timeHorizon', count(*) FILTER (NOT TimeHorizon_months > 0) FROM scenario_run
       UNION ALL SELECT 'ScenarioRun', 'chk_positive_vehicles', count(*) FILTER (NOT VehiclesReplaced >= 0) FROM scenario_run""",
)
def check_constraints(spark, sf):
    """Refused rows per declared check, one pass per table."""
    return union_all(
        [
            check_violations(src.trips(spark, sf), TRIP_FACTS),
            check_violations(src.raw_invoices(spark, sf), FUEL_INVOICES),
            check_violations(src.price_curve(spark, sf), PRICE_CURVE),
            check_violations(yearly_scenarios(spark, sf), SCENARIO_RUN),
        ]
    )


@query(
    "store_refused_rows",
    """SELECT reject_reasons, count(*) AS rows FROM (SELECT concat_ws(',',
              CASE WHEN VIN IS NULL THEN 'not_null_VIN' END, CASE WHEN Litres IS NULL THEN 'not_null_Litres' END,
              CASE WHEN EUR_Amount IS NULL THEN 'not_null_EUR_Amount' END,
              CASE WHEN Litres IS NULL OR NOT Litres > 0 THEN 'chk_positive_litres' END,
              CASE WHEN EUR_Amount IS NULL OR NOT EUR_Amount > 0 THEN 'chk_positive_amount' END) AS reject_reasons
            FROM raw_invoices) GROUP BY ALL""",
)
def store_refused_rows(spark, sf):
    """Invoices as delivered, written to a table: its rows, and the refused ones by reason."""
    store = TableStore(spark, scratch_path(spark, "invoices"))
    rows = src.raw_invoices(spark, sf).withColumn(
        "InvoiceMonth", F.trunc(F.to_date("InvoiceDate"), "month")
    )
    store.overwrite(rows, FUEL_INVOICES.name)
    found = store.read(FUEL_INVOICES.name).select(F.lit("").alias(REASONS))
    refused = store.refused(FUEL_INVOICES.name)
    if refused is not None:
        found = found.unionByName(refused.select(F.concat_ws(",", REASONS).alias(REASONS)))
    return found.groupBy(REASONS).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "store_not_null",
    """SELECT reject_reasons, CAST(count(*) AS BIGINT) AS rows FROM (
         SELECT concat_ws(',', CASE WHEN l_partkey % 11 = 0 THEN 'not_null_VIN' END,
           CASE WHEN l_suppkey % 13 = 0 THEN 'not_null_StartTimeUTC' END,
           CASE WHEN l_suppkey % 13 = 0 THEN 'chk_trip_duration' END) AS reject_reasons FROM (
           SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS copy FROM lineitem)
         WHERE copy = 1) GROUP BY ALL""",
)
def store_not_null(spark, sf):
    """Trips without vehicle or start, upserted: what the table keeps, and what it refused and why."""
    spec = replace(TRIP_FACTS, partition_by=())
    store = TableStore(spark, scratch_path(spark, "trips"), {spec.name: spec})
    part, supplier = (F.split("TripID", "-")[i].cast("bigint") for i in (2, 3))
    rows = src.trips(spark, sf)
    rows = rows.withColumns({
        "VIN": F.when(part % 11 != 0, F.col("VIN")),
        **{c: F.col(c).cast("timestamp") for c in ("EndTimeUTC",)},
        "StartTimeUTC": F.when(supplier % 13 != 0, F.col("StartTimeUTC").cast("timestamp")),
    })
    store.upsert(rows, spec.name)
    found = store.read(spec.name).select(F.lit("").alias(REASONS))
    refused = store.refused(spec.name)
    if refused is not None:
        found = found.unionByName(refused.select(F.concat_ws(",", REASONS).alias(REASONS)))
    return found.groupBy(REASONS).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "pk_violations",
    """SELECT concat('T', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS TripID, count(*) AS copies
       FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def pk_violations(spark, sf):
    """Trip numbers held by more than one row of the two loads."""
    existing, incoming = src.trip_loads(spark, sf)
    return key_violations(existing.unionByName(incoming), ["TripID"])


@query(
    "pk_violations_price_month",
    """SELECT PriceMonth, count(*) AS copies FROM (
         SELECT PriceMonth FROM price_curve UNION ALL
         SELECT PriceMonth FROM price_curve WHERE month(PriceMonth) % 4 = 1)
       GROUP BY PriceMonth HAVING count(*) > 1""",
)
def pk_violations_price_month(spark, sf):
    """Months quoted by more than one row, after a second delivery of every fourth month."""
    curve = src.price_curve(spark, sf).select(*PRICE_CURVE.primary_key)
    second = curve.where(F.month("PriceMonth") % 4 == 1)
    return key_violations(curve.unionByName(second), list(PRICE_CURVE.primary_key))


@query(
    "layout_cluster",
    """SELECT VIN, count(*) AS trips, min(StartTimeUTC) AS first_start, max(StartTimeUTC) AS last_start,
              sum(Fuel_l) AS fuel_l FROM trips GROUP BY VIN""",
)
def layout_cluster(spark, sf):
    """Trips rewritten in (vehicle, start) order, then read per vehicle."""
    path = scratch_path(spark, "clustered")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trips = src.trips(spark, sf).select("VIN", "StartTimeUTC", "Fuel_l")
    cluster(trips, TRIP_FACTS.cluster_by, files).write.parquet(path)
    return spark.read.parquet(path).groupBy("VIN").agg(
        F.count(F.lit(1)).alias("trips"),
        F.min("StartTimeUTC").alias("first_start"),
        F.max("StartTimeUTC").alias("last_start"),
        F.sum("Fuel_l").alias("fuel_l"),
    )


@query(
    "table_counts",
    "SELECT 'FuelInvoices' AS table_name, count(*) AS written, count(*) AS stored FROM invoices",
)
def table_counts(spark, sf):
    """Rows counted while writing, next to the stored table's count."""
    store = TableStore(spark, scratch_path(spark, "invoices"))
    written = store.overwrite(src.invoices(spark, sf), FUEL_INVOICES.name)
    return store.read(FUEL_INVOICES.name).agg(F.count(F.lit(1)).alias("stored")).select(
        F.lit(FUEL_INVOICES.name).alias("table_name"),
        F.lit(written).cast("bigint").alias("written"),
        "stored",
    )


@query(
    "dq_row_counts",
    """SELECT 'TripFacts' AS TableName, count(*) AS RowCount FROM trips
       UNION ALL SELECT 'FuelInvoices', count(*) FROM invoices
       UNION ALL SELECT 'ETSPriceCurve', count(*) FROM price_curve
       UNION ALL SELECT 'ScenarioRun', count(*) FROM scenario_run""",
)
def dq_row_counts(spark, sf):
    tables = {
        "TripFacts": src.trips(spark, sf),
        "FuelInvoices": src.invoices(spark, sf),
        "ETSPriceCurve": src.price_curve(spark, sf),
        "ScenarioRun": yearly_scenarios(spark, sf),
    }
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("RowCount")).select(
                F.lit(name).alias("TableName"), "RowCount"
            )
            for name, df in tables.items()
        ]
    )


@query(
    "planar_distance",
    """SELECT TripID, sqrt(pow(StartLat - EndLat, 2) + pow(StartLon - EndLon, 2)) * 111.32 AS planar_km,
              Distance_km FROM trips""",
    doubles="planar_km",
)
def planar_distance(spark, sf):
    ends = [F.col(c) for c in ("StartLat", "StartLon", "EndLat", "EndLon")]
    return src.trips(spark, sf).select(
        "TripID", planar_km(*ends).alias("planar_km"), "Distance_km"
    )
