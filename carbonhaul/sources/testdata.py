"""The fleet tables as views over the given star schema.

Every line item is a trip of the vehicle named by its supplier, every event is a trip-end
message, invoices follow from the trips and each order is a quote on the allowance market.
Quantities are multiples of a power of two, so sums do not depend on their order.
"""

from pyspark.sql import functions as F

from ..constants import CITIES, SUPPLIERS
from ..plans.pricing import price_curve_from_quotes


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _city(index, field):
    """Coordinate of a city by position: a literal array, no join."""
    return F.element_at(F.array(*[F.lit(c[field]) for c in CITIES]), index + 1)


def trips(spark, sf_dir):
    """TripFacts plus engine hours, top speed and the supplier number."""
    hours = "make_interval(0,0,0,0,CAST(5 + l_partkey % 16 AS INT),0,0)"
    driving = "make_interval(0,0,0,0,0,0,CAST(l_quantity * (1150 + 20 * l_linenumber) AS DECIMAL(18,6)))"
    start = f"(l_shipdate + INTERVAL '29' YEAR + {hours})"
    first, last = F.expr("CAST(l_suppkey % 14 AS INT)"), F.expr("CAST(l_partkey % 14 AS INT)")
    return table(spark, sf_dir, "lineitem").select(
        F.expr(
            "concat('T', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', "
            "CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', "
            "CAST(CAST(l_shipdate AS DATE) AS STRING))"
        ).alias("TripID"),
        F.expr("concat('WDBM', lpad(CAST(l_suppkey AS STRING), 13, '0'))").alias("VIN"),
        F.expr(start).alias("StartTimeUTC"),
        F.expr(f"{start} + {driving}").alias("EndTimeUTC"),
        F.expr("l_quantity * 25").alias("Distance_km"),
        F.expr(
            "l_quantity * (CASE WHEN l_partkey % 97 = 0 THEN 52 "
            "ELSE 20 + 3 * l_linenumber + l_partkey % 3 END) / 4"
        ).alias("Fuel_l"),
        _city(first, 1).alias("StartLat"),
        _city(first, 2).alias("StartLon"),
        _city(last, 1).alias("EndLat"),
        _city(last, 2).alias("EndLon"),
        F.expr(f"CAST({start} AS DATE)").alias("TripDate"),
        F.expr("CAST(l_quantity * (1150 + 20 * l_linenumber) / 3600 AS DOUBLE)").alias(
            "EngineHours"
        ),
        F.expr("CAST(75 + l_suppkey % 10 + 3 * l_linenumber AS DOUBLE)").alias("MaxSpeed"),
    )


def trip_loads(spark, sf_dir):
    """Trips under the repeating number (order, line), split into an earlier and a later load by
    the line status: (existing rows, incoming rows)."""
    numbered = table(spark, sf_dir, "lineitem").select(
        F.expr("concat('T', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))").alias(
            "TripID"
        ),
        F.expr("concat('WDBM', lpad(CAST(l_suppkey AS STRING), 13, '0'))").alias("VIN"),
        F.expr("CAST(l_shipdate + INTERVAL '29' YEAR AS TIMESTAMP_NTZ)").alias("StartTimeUTC"),
        F.expr("l_quantity * 25").alias("Distance_km"),
        F.expr("l_quantity * (20 + 3 * l_linenumber + l_partkey % 3) / 4").alias("Fuel_l"),
        F.col("l_linestatus").alias("status"),
    )
    return (
        numbered.where("status = 'F'").drop("status"),
        numbered.where("status = 'O'").drop("status"),
    )


def telematics(spark, sf_dir):
    """Parsed trip-end messages; ``processedTime`` is the event time."""
    return parsed_messages(table(spark, sf_dir, "events"))


def parsed_messages(events):
    minutes = "make_interval(0,0,0,0,0,CAST(15 * (1 + event_id % 16) AS INT),0)"
    start, end = F.expr("CAST(event_id % 14 AS INT)"), F.expr("CAST(k % 14 AS INT)")
    return with_k(events).select(
        F.expr("concat('M', CAST(event_id AS STRING))").alias("messageId"),
        F.expr(
            "CASE WHEN event_id % 211 = 0 THEN NULL "
            "ELSE concat('WDBN', lpad(CAST(user_id AS STRING), 13, '0')) END"
        ).alias("vin"),
        F.expr("concat('T', CAST(event_id AS STRING))").alias("tripId"),
        F.expr(f"CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ) - {minutes}").alias(
            "startTimeUTC"
        ),
        F.expr("CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ)").alias("endTimeUTC"),
        F.col("ts").cast("timestamp").alias("processedTime"),
        F.expr("CAST(floor(value * 4) AS DOUBLE) / 4").alias("distance_km"),
        F.expr("CAST(floor(value * 4) AS DOUBLE) / 4 * k / 128").alias("fuel_l"),
        F.expr("(1 + event_id % 16) * CAST(0.25 AS DOUBLE)").alias("engineHours"),
        F.expr("(1 + event_id % 16) * CAST(0.25 AS DOUBLE) * (event_id % 7) / 16").alias(
            "idleTime"
        ),
        F.expr("CAST(70 + event_id % 37 AS DOUBLE)").alias("maxSpeed"),
        F.expr("CAST(50 + event_id % 31 AS DOUBLE)").alias("avgSpeed"),
        F.expr(
            "CASE WHEN event_id % 50 = 0 THEN NULL "
            "ELSE concat('D', CAST(user_id % 40 AS STRING)) END"
        ).alias("driverId"),
        F.concat(
            F.lit("R"), start.cast("string"), F.lit("-"), end.cast("string")
        ).alias("routeId"),
        _city(start, 1).alias("startLatitude"),
        _city(start, 2).alias("startLongitude"),
        _city(end, 1).alias("endLatitude"),
        _city(end, 2).alias("endLongitude"),
    )


def messages(spark, sf_dir):
    """The same messages as JSON text with the defects a feed has: cut-off text, wrong numbers,
    wrong or missing times, and every tenth message sent twice."""
    return message_text(table(spark, sf_dir, "events"))


def event_stream(spark, sf_dir):
    """The events as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )


def with_k(events):
    """The number inside ``props``, extracted once."""
    return events.withColumn("k", F.expr("CAST(get_json_object(props, '$.k') AS INT)"))


def message_text(events):
    minutes = "make_interval(0,0,0,0,0,CAST(15 * (1 + event_id % 16) AS INT),0)"
    iso = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss.SSS\") || 'Z'"
    end = "CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ)"
    start, stop = F.expr("CAST(event_id % 14 AS INT)"), F.expr("CAST(k % 14 AS INT)")
    distance = "CAST(floor(value * 4) AS DOUBLE) / 4"
    fields = [
        F.expr("concat('M', CAST(event_id AS STRING))").alias("messageId"),
        F.expr("concat('V', CAST(user_id AS STRING))").alias("vehicleId"),
        F.expr(
            "CASE WHEN event_id % 211 = 0 THEN NULL "
            "ELSE concat('WDBN', lpad(CAST(user_id AS STRING), 13, '0')) END"
        ).alias("vin"),
        F.expr("concat('T', CAST(event_id AS STRING))").alias("tripId"),
        F.expr(
            f"CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'not a time' "
            f"ELSE {iso.format(f'{end} - {minutes}')} END"
        ).alias("startTime"),
        F.expr(iso.format(end)).alias("endTime"),
        F.expr(iso.format("ts")).alias("timestamp"),
        _city(start, 1).alias("startLatitude"),
        _city(start, 2).alias("startLongitude"),
        _city(stop, 1).alias("endLatitude"),
        _city(stop, 2).alias("endLongitude"),
        F.expr(
            f"CASE WHEN event_id % 89 = 0 THEN 'n/a' ELSE CAST({distance} AS STRING) END"
        ).alias("totalDistance"),
        F.expr(f"{distance} * k / 128").alias("fuelConsumed"),
        F.expr("(1 + event_id % 16) * CAST(0.25 AS DOUBLE)").alias("engineHours"),
        F.expr("(1 + event_id % 16) * CAST(0.25 AS DOUBLE) * (event_id % 7) / 16").alias(
            "idleTime"
        ),
        F.expr(
            "CASE WHEN event_id % 83 = 0 THEN 'fast' "
            "ELSE CAST(CAST(70 + event_id % 37 AS DOUBLE) AS STRING) END"
        ).alias("maxSpeed"),
        F.expr("CAST(50 + event_id % 31 AS DOUBLE)").alias("avgSpeed"),
        F.expr(
            "CASE WHEN event_id % 50 = 0 THEN NULL "
            "ELSE concat('D', CAST(user_id % 40 AS STRING)) END"
        ).alias("driverId"),
        F.concat(
            F.lit("R"), start.cast("string"), F.lit("-"), stop.cast("string")
        ).alias("routeId"),
    ]
    copies = F.when(F.expr("event_id % 10 = 0"), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    rows = with_k(events).select(
        *fields,
        F.expr("event_type = 'error' AND event_id % 3 = 0").alias("cut"),
        F.explode(copies).alias("copy"),
    )
    names = [c for c in rows.columns if c not in ("cut", "copy")]
    return rows.select("cut", F.to_json(F.struct(*names)).alias("text")).select(
        F.expr("substring(text, 1, CASE WHEN cut THEN 40 ELSE length(text) END)").alias("value")
    )


def vehicle_month_litres(trips_df):
    return trips_df.groupBy("VIN", F.trunc("TripDate", "month").alias("InvoiceMonth")).agg(
        F.sum("Fuel_l").alias("litres")
    )


def invoices(spark, sf_dir):
    """FuelInvoices: one per vehicle and month, 1.6 % below the consumption."""
    month = F.col("InvoiceMonth")
    number = F.substring("VIN", 5, 13).cast("bigint")
    supplier = F.element_at(F.array(*[F.lit(s) for s in SUPPLIERS]), (number % 5 + 1).cast("int"))
    return vehicle_month_litres(trips(spark, sf_dir)).select(
        "VIN",
        "InvoiceMonth",
        (F.col("litres") * 63 / 64).alias("Litres"),
        (F.col("litres") * 63 / 64 * (184 + F.month(month)) / 128).alias("EUR_Amount"),
        F.concat(
            F.lit("INV-"), F.col("VIN"), F.lit("-"), F.date_format(month, "yyyyMM")
        ).alias("InvoiceNumber"),
        supplier.alias("SupplierName"),
    )


def raw_invoices(spark, sf_dir):
    """Invoices as delivered, twenty vehicles per drop. Depending on the drop some rows lack the
    vehicle or the amount, have negative litres or repeat the number of the year's first invoice."""
    month = F.col("InvoiceMonth")
    number = F.substring("VIN", 5, 13).cast("bigint")
    drop = F.floor(number / 20)
    mark = (number + F.month(month) + F.year(month)) % 41
    kind = drop % 5
    january = F.concat(
        F.lit("INV-"), F.col("VIN"), F.lit("-"), F.year(month).cast("string"), F.lit("01")
    )
    return invoices(spark, sf_dir).select(
        drop.alias("SourceDrop"),
        F.when((kind == 0) & (mark == 0), F.lit(None).cast("string")).otherwise(
            F.col("VIN")
        ).alias("VIN"),
        F.date_format(F.date_add(month, 14), "yyyy-MM-dd").alias("InvoiceDate"),
        F.when((kind == 1) & (mark == 1), -F.col("Litres")).otherwise(F.col("Litres")).alias(
            "Litres"
        ),
        F.when((kind == 2) & (mark % 5 == 2), F.lit(None).cast("double"))
        .when((kind == 4) & (mark == 2), F.lit(None).cast("double"))
        .otherwise(F.col("EUR_Amount")).alias("EUR_Amount"),
        F.when((kind == 3) & (mark == 3), january).otherwise(F.col("InvoiceNumber")).alias(
            "InvoiceNumber"
        ),
        "SupplierName",
    )


def quotes(spark, sf_dir):
    """Allowance quotes, one per order, for delivery a year later. ``deviation`` is the distance
    from the trend in euro, between -8 and 8."""
    return table(spark, sf_dir, "orders").select(
        F.expr("CAST(o_orderdate AS DATE)").alias("quote_date"),
        F.col("o_orderkey").alias("quote_id"),
        F.expr("add_months(CAST(date_trunc('month', o_orderdate) AS DATE), 360)").alias(
            "PriceMonth"
        ),
        F.expr("(o_orderkey * 7919 % 1601 - 800) / CAST(100 AS DOUBLE)").alias("deviation"),
    )


def price_curve(spark, sf_dir):
    """ETSPriceCurve: one row per month of delivery."""
    return price_curve_from_quotes(quotes(spark, sf_dir))


def vehicle_ages(vin):
    """Age in years of a vehicle, 3 to 12, from its number."""
    return (3 + F.substring(vin, 5, 13).cast("bigint") % 10).cast("double")
