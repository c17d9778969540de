"""Table and message layouts.

A :class:`TableSpec` carries what a table definition declares besides its columns: generated
columns, defaults, checks, keys and partitioning. ``operators.constraints`` applies it.
"""

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    generated: dict = field(default_factory=dict)  # column -> SQL expression
    defaults: dict = field(default_factory=dict)  # column -> SQL expression
    checks: dict = field(default_factory=dict)  # constraint -> SQL predicate
    primary_key: tuple = ()
    merge_keys: tuple = ()
    order_by: tuple = ()  # of rows with equal merge keys the greatest counts, stored or new
    partition_by: tuple = ()
    cluster_by: tuple = ()

    @property
    def required(self):
        return [f.name for f in self.schema if not f.nullable]


TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(),
    "bigint": T.LongType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
}


def struct(columns):
    """``name type [NOT NULL], ...`` as a schema; needs no running session."""
    fields = []
    for column in columns.split(","):
        name, kind, *rest = column.split()
        fields.append(T.StructField(name, TYPES[kind], not rest))
    return T.StructType(fields)


TRIP_FACTS = TableSpec(
    name="TripFacts",
    schema=struct(
        "TripID string NOT NULL, VIN string NOT NULL, "
        "StartTimeUTC timestamp NOT NULL, EndTimeUTC timestamp NOT NULL, "
        "Distance_km double NOT NULL, Fuel_l double NOT NULL, "
        "StartLat double, StartLon double, EndLat double, EndLon double, TripDate date"
    ),
    generated={"TripDate": "CAST(StartTimeUTC AS DATE)"},
    checks={
        "chk_trip_duration": "EndTimeUTC > StartTimeUTC",
        "chk_positive_distance": "Distance_km > 0",
        "chk_positive_fuel": "Fuel_l > 0",
    },
    merge_keys=("TripID",),
    partition_by=("TripDate",),
    cluster_by=("VIN", "StartTimeUTC"),
)

FUEL_INVOICES = TableSpec(
    name="FuelInvoices",
    schema=struct(
        "VIN string NOT NULL, InvoiceMonth date NOT NULL, Litres double NOT NULL, "
        "EUR_Amount double NOT NULL, EUR_per_Litre double, InvoiceNumber string, "
        "SupplierName string, CreatedDate timestamp"
    ),
    generated={"EUR_per_Litre": "try_divide(EUR_Amount, Litres)"},
    defaults={"CreatedDate": "current_timestamp()"},
    checks={
        "chk_positive_litres": "Litres > 0",
        "chk_positive_amount": "EUR_Amount > 0",
    },
    merge_keys=("VIN", "InvoiceNumber", "InvoiceMonth"),
    partition_by=("InvoiceMonth",),
    cluster_by=("VIN", "InvoiceMonth"),
)

PRICE_CURVE = TableSpec(
    name="ETSPriceCurve",
    schema=struct(
        "PriceMonth date NOT NULL, EUR_per_t double NOT NULL, PriceSource string, "
        "Volatility double, LastUpdated timestamp"
    ),
    defaults={
        "PriceSource": "'MARKET'",
        "Volatility": "CAST(0.15 AS DOUBLE)",
        "LastUpdated": "current_timestamp()",
    },
    checks={"chk_positive_price": "EUR_per_t > 0"},
    primary_key=("PriceMonth",),
    merge_keys=("PriceMonth",),
    cluster_by=("PriceMonth",),
)

SCENARIO_RUN = TableSpec(
    name="ScenarioRun",
    schema=struct(
        "ScenarioID string NOT NULL, ScenarioName string NOT NULL, "
        "TimeHorizon_months int NOT NULL, VehiclesReplaced int NOT NULL, "
        "CapEx_EUR double NOT NULL, OpEx_EUR double NOT NULL, CO2_Reduction_t double NOT NULL, "
        "ETS_Savings_EUR double NOT NULL, NPV_EUR double NOT NULL, ROI_Percent double NOT NULL, "
        "Payback_Years double NOT NULL, CreatedDate timestamp"
    ),
    defaults={"CreatedDate": "current_timestamp()"},
    checks={
        "chk_positive_timeHorizon": "TimeHorizon_months > 0",
        "chk_positive_vehicles": "VehiclesReplaced >= 0",
    },
    merge_keys=("ScenarioID",),
)

OPTIMIZATION_RESULTS = TableSpec(
    name="OptimizationResults",
    schema=struct(
        "ScenarioID string NOT NULL, ScenarioName string NOT NULL, TimeHorizon_months int NOT NULL, "
        "VehiclesReplaced bigint NOT NULL, CapEx_EUR double NOT NULL, OpEx_EUR double NOT NULL, "
        "CO2_Reduction_t double NOT NULL, ETS_Savings_EUR double NOT NULL, NPV_EUR double NOT NULL, "
        "ROI_Percent double, Payback_Years double, OptimizationMethod string NOT NULL"
    ),
    checks={"chk_replaced": "VehiclesReplaced >= 0"},
    merge_keys=("ScenarioID",),
)

# The tables as the ingest jobs may keep them: declared columns plus those of the feed
TRIP_FACTS_FROM_MESSAGES = replace(
    TRIP_FACTS,
    schema=T.StructType(
        TRIP_FACTS.schema.fields
        + struct(
            "ProcessedTime timestamp, DataSource string, MessageId string, DriverId string, "
            "RouteId string, EngineHours double, IdleTime double, MaxSpeed double, "
            "AvgSpeed double, MessageTime timestamp"
        ).fields
    ),
    order_by=("MessageTime", "MessageId"),
)
FUEL_INVOICES_FROM_FILES = replace(
    FUEL_INVOICES,
    schema=T.StructType(
        FUEL_INVOICES.schema.fields
        + struct(
            "InvoiceDate date, FuelType string, Location string, ProcessedTime timestamp, "
            "DataSource string, SourceFile string, FileTime timestamp"
        ).fields
    ),
    merge_keys=("VIN", "InvoiceNumber", "InvoiceDate"),
    order_by=("FileTime", "SourceFile"),
)

#: when a row was written says nothing about which of two rows is the newer one
WRITE_TIMES = ("ProcessedTime", "CreatedDate", "LastUpdated")

TABLES = {
    s.name: s
    for s in (TRIP_FACTS, FUEL_INVOICES, PRICE_CURVE, SCENARIO_RUN, OPTIMIZATION_RESULTS)
}

# Trip-end message: text fields, then numbers, then the times (ISO-8601 text)
MESSAGE_TEXT = ("messageId", "vehicleId", "vin", "tripId", "driverId", "routeId")
MESSAGE_NUMBERS = (
    "startLatitude", "startLongitude", "endLatitude", "endLongitude", "totalDistance",
    "fuelConsumed", "engineHours", "idleTime", "maxSpeed", "avgSpeed",
)
MESSAGE_TIMES = ("startTime", "endTime", "timestamp")

# Every field is read as text, so that one bad number costs the field and not the message.
MESSAGE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in MESSAGE_TEXT + MESSAGE_NUMBERS + MESSAGE_TIMES]
    + [T.StructField("_corrupt", T.StringType())]
)

INVOICE_DROP_COLUMNS = (
    "VIN", "InvoiceDate", "Litres", "EUR_Amount", "InvoiceNumber", "SupplierName", "FuelType",
    "Location",
)
