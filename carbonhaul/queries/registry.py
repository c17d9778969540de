"""Registration of queries and the common table expressions of their SQL counterparts."""

import re
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CITIES, SUPPLIERS
from ..session import prepare


@dataclass(frozen=True)
class Query:
    name: str
    run: object
    sql: str | None
    doubles: tuple
    decimals: int


QUERIES: dict[str, Query] = {}


def query(name, sql=None, doubles="", decimals=6):
    """Register ``fn(spark, sf_dir) -> DataFrame``.

    ``doubles`` names double columns whose last bits depend on the order of a sum or on the math
    library: both sides round them. All others are compared bit by bit.
    """

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, tuple(doubles.split()), decimals)
        return fn

    return register


def spark_callable(entry):
    def run(spark, sf_dir):
        df = entry.run(prepare(spark), sf_dir)
        columns = []
        for f in df.schema:
            c = F.col(f"`{f.name}`")
            if f.name in entry.doubles:
                c = F.round(c, entry.decimals) + F.lit(0.0)
            elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
                c = c.cast("bigint")
            elif isinstance(f.dataType, T.TimestampType):
                c = c.cast("timestamp_ntz")
            columns.append(c.alias(f.name))
        return df.select(*columns)

    run.__name__ = entry.name
    run.__doc__ = entry.run.__doc__
    return run


def oracle_text(entry):
    body = entry.sql.strip()
    if entry.doubles:
        rounded = ", ".join(
            f'CAST(round(CAST("{c}" AS DOUBLE), {entry.decimals}) AS DOUBLE) + CAST(0 AS DOUBLE) AS "{c}"'
            for c in entry.doubles
        )
        outer = f"SELECT * REPLACE ({rounded}) FROM _result"
    else:
        outer = "SELECT * FROM _result"
    ctes = _needed(body)
    parts = [f"{name} AS ({FIXTURES[name].strip()})" for name in ctes]
    parts.append(f"_result AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n" + outer


def _needed(text):
    """Fixture CTEs used by ``text``, in dependency order (that of FIXTURES)."""
    wanted = set()

    def visit(sql):
        for name in FIXTURES:
            if name not in wanted and re.search(rf"\b{name}\b", sql):
                wanted.add(name)
                visit(FIXTURES[name])

    visit(text)
    return [n for n in FIXTURES if n in wanted]


def _literal_list(values):
    return "[" + ", ".join(str(v) for v in values) + "]"


# the mean price, independent of the order of summation
MEAN_PRICE = "CAST(sum(CAST(EUR_per_t AS DECIMAL(20, 10))) AS DOUBLE) / count(EUR_per_t)"

LATS = _literal_list(f"CAST({c[1]} AS DOUBLE)" for c in CITIES)
LONS = _literal_list(f"CAST({c[2]} AS DOUBLE)" for c in CITIES)
SUPPLIER_LIST = _literal_list(f"'{s}'" for s in SUPPLIERS)

FIXTURES = {
    "trips": f"""
SELECT *, CAST(StartTimeUTC AS DATE) AS TripDate FROM (
SELECT concat('T', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-',
              CAST(l_partkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR), '-',
              CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS TripID,
       concat('WDBM', lpad(CAST(l_suppkey AS VARCHAR), 13, '0')) AS VIN,
       l_shipdate + INTERVAL '29' YEAR + to_hours(CAST(5 + l_partkey % 16 AS INT)) AS StartTimeUTC,
       l_shipdate + INTERVAL '29' YEAR + to_hours(CAST(5 + l_partkey % 16 AS INT))
         + to_seconds(CAST(l_quantity * (1150 + 20 * l_linenumber) AS BIGINT)) AS EndTimeUTC,
       l_quantity * 25 AS Distance_km,
       l_quantity * (CASE WHEN l_partkey % 97 = 0 THEN 52
                     ELSE 20 + 3 * l_linenumber + l_partkey % 3 END) / 4 AS Fuel_l,
       ({LATS})[l_suppkey % 14 + 1] AS StartLat, ({LONS})[l_suppkey % 14 + 1] AS StartLon,
       ({LATS})[l_partkey % 14 + 1] AS EndLat, ({LONS})[l_partkey % 14 + 1] AS EndLon
FROM lineitem)""",
    "telematics": f"""
SELECT concat('M', CAST(event_id AS VARCHAR)) AS messageId,
       CASE WHEN event_id % 211 = 0 THEN NULL
            ELSE concat('WDBN', lpad(CAST(user_id AS VARCHAR), 13, '0')) END AS vin,
       concat('T', CAST(event_id AS VARCHAR)) AS tripId,
       date_trunc('second', ts) - to_minutes(CAST(15 * (1 + event_id % 16) AS INT)) AS startTimeUTC,
       date_trunc('second', ts) AS endTimeUTC, ts AS processedTime,
       floor(value * 4) / 4 AS distance_km, floor(value * 4) / 4 * k / 128 AS fuel_l,
       (1 + event_id % 16) * CAST(0.25 AS DOUBLE) AS engineHours,
       (1 + event_id % 16) * CAST(0.25 AS DOUBLE) * (event_id % 7) / 16 AS idleTime,
       CAST(70 + event_id % 37 AS DOUBLE) AS maxSpeed,
       CAST(50 + event_id % 31 AS DOUBLE) AS avgSpeed,
       CASE WHEN event_id % 50 = 0 THEN NULL
            ELSE concat('D', CAST(user_id % 40 AS VARCHAR)) END AS driverId,
       concat('R', CAST(event_id % 14 AS VARCHAR), '-', CAST(k % 14 AS VARCHAR)) AS routeId,
       ({LATS})[event_id % 14 + 1] AS startLatitude, ({LONS})[event_id % 14 + 1] AS startLongitude,
       ({LATS})[k % 14 + 1] AS endLatitude, ({LONS})[k % 14 + 1] AS endLongitude,
       event_id, event_type
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e""",
    "clean": """
SELECT messageId, vin, tripId, startTimeUTC, endTimeUTC, distance_km, fuel_l, engineHours, idleTime,
       maxSpeed, avgSpeed, driverId, routeId, startLatitude, startLongitude, endLatitude,
       endLongitude, fuel_l / distance_km * 100 AS fuel_efficiency_l_100km,
       fuel_l * CAST(2.68 AS DOUBLE) AS co2_kg,
       fuel_l * CAST(2.68 AS DOUBLE) * 85 / 1000 AS ets_cost_eur,
       distance_km / ((epoch(endTimeUTC) - epoch(startTimeUTC)) / 3600) AS avg_speed_calculated,
       processedTime
FROM telematics
WHERE vin IS NOT NULL AND tripId IS NOT NULL AND startTimeUTC IS NOT NULL
  AND endTimeUTC IS NOT NULL AND distance_km > 0 AND fuel_l > 0""",
    "vehicle_month": """
SELECT VIN, CAST(date_trunc('month', TripDate) AS DATE) AS InvoiceMonth, sum(Fuel_l) AS litres
FROM trips GROUP BY ALL""",
    "invoices": f"""
SELECT VIN, InvoiceMonth, litres * 63 / 64 AS Litres,
       litres * 63 / 64 * (184 + month(InvoiceMonth)) / 128 AS EUR_Amount,
       concat('INV-', VIN, '-', strftime(InvoiceMonth, '%Y%m')) AS InvoiceNumber,
       ({SUPPLIER_LIST})[CAST(substr(VIN, 5, 13) AS BIGINT) % 5 + 1] AS SupplierName
FROM vehicle_month""",
    "raw_invoices": """
SELECT n // 20 AS SourceDrop,
       CASE WHEN kind = 0 AND mark = 0 THEN NULL ELSE VIN END AS VIN,
       strftime(InvoiceMonth + INTERVAL 14 DAY, '%Y-%m-%d') AS InvoiceDate,
       CASE WHEN kind = 1 AND mark = 1 THEN -Litres ELSE Litres END AS Litres,
       CASE WHEN kind = 2 AND mark % 5 = 2 OR kind = 4 AND mark = 2 THEN NULL ELSE EUR_Amount END AS EUR_Amount,
       CASE WHEN kind = 3 AND mark = 3 THEN concat('INV-', VIN, '-', strftime(InvoiceMonth, '%Y'), '01')
            ELSE InvoiceNumber END AS InvoiceNumber, SupplierName
FROM (SELECT *, (n + month(InvoiceMonth) + year(InvoiceMonth)) % 41 AS mark, n // 20 % 5 AS kind
      FROM (SELECT *, CAST(substr(VIN, 5, 13) AS BIGINT) AS n FROM invoices))""",
    "price_curve": """
SELECT PriceMonth,
       round(85 + CAST(0.5 AS DOUBLE) * m + 5 * sin(2 * pi() * month(PriceMonth) / 12) + deviation, 2)
         AS EUR_per_t,
       CASE WHEN m < 12 THEN 'MARKET' WHEN m < 36 THEN 'FORECAST' ELSE 'SCENARIO' END AS PriceSource
FROM (SELECT *, datediff('month', DATE '2025-01-01', PriceMonth) AS m
      FROM (SELECT CAST(date_trunc('month', o_orderdate) + INTERVAL 360 MONTH AS DATE) AS PriceMonth,
                   (o_orderkey * 7919 % 1601 - 800) / CAST(100 AS DOUBLE) AS deviation,
                   row_number() OVER (PARTITION BY date_trunc('month', o_orderdate)
                                      ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
            FROM orders) WHERE rn = 1)""",
    "calendar": """
SELECT CAST(d AS DATE) AS "Date", year(d) AS "Year", concat('Q', CAST(quarter(d) AS VARCHAR)) AS "Quarter",
       month(d) AS "Month", monthname(d) AS "MonthName", dayofweek(d) + 1 AS "DayOfWeek"
FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2030-12-31', INTERVAL 1 DAY) t(d)""",
    "daily": """
SELECT "Date", "Year", "Quarter", "Month", coalesce(litres, 0) AS litres, litres AS litres_or_blank
FROM calendar LEFT JOIN (SELECT TripDate, sum(Fuel_l) AS litres FROM trips GROUP BY ALL) t
  ON TripDate = "Date" """,
    "baseline_year": """
SELECT CAST(year(TripDate) AS BIGINT) AS "year", CAST(count(DISTINCT VIN) AS DOUBLE) AS fleet_size,
       sum(Distance_km) AS distance_km, sum(Fuel_l) AS fuel_l, sum(Fuel_l) * 2.68 / 1000 AS co2_t,
       sum(Distance_km) / count(DISTINCT VIN) AS km_per_vehicle,
       sum(Fuel_l) / count(DISTINCT VIN) AS fuel_per_vehicle,
       sum(Fuel_l) / sum(Distance_km) * 100 AS efficiency_l_100km
FROM trips GROUP BY 1""",
    "all_years": """
SELECT y AS "year", coalesce(fleet_size, 40) AS fleet_size, coalesce(distance_km, 800000) AS distance_km,
       coalesce(fuel_l, 240000) AS fuel_l, coalesce(co2_t, 643.2) AS co2_t,
       coalesce(km_per_vehicle, 20000) AS km_per_vehicle,
       coalesce(fuel_per_vehicle, 6000) AS fuel_per_vehicle,
       coalesce(efficiency_l_100km, 30) AS efficiency_l_100km
FROM (SELECT unnest(generate_series(2023, 2032)) AS y UNION SELECT "year" FROM baseline_year)
LEFT JOIN baseline_year b ON b."year" = y""",
    "scenario_run": """
SELECT "year", ScenarioID, ScenarioName, CAST(60 AS BIGINT) AS TimeHorizon_months,
       CAST(n AS BIGINT) AS VehiclesReplaced, CAST(n1 AS BIGINT) AS ElectricVehicles,
       CAST(n - n1 AS BIGINT) AS HybridVehicles, capex AS CapEx_EUR, upkeep * 5 AS OpEx_EUR,
       co2 * 5 AS CO2_Reduction_t, co2 * 85 * 5 AS ETS_Savings_EUR, fuel * 5 AS FuelSavings_EUR,
       saved * 5 AS TotalSavings_EUR,
       saved * (1/1.08 + 1/pow(1.08, 2) + 1/pow(1.08, 3) + 1/pow(1.08, 4) + 1/pow(1.08, 5)) - capex AS NPV_EUR,
       (saved * (1/1.08 + 1/pow(1.08, 2) + 1/pow(1.08, 3) + 1/pow(1.08, 4) + 1/pow(1.08, 5)) - capex)
         / capex * 100 AS ROI_Percent,
       CASE WHEN saved > 0 THEN capex / saved ELSE 999 END AS Payback_Years, risk AS Risk_Level,
       effort AS Implementation_Complexity
FROM (SELECT *, fuel + upkeep + co2 * 85 AS saved FROM (
  SELECT *, n1 * unit1 + (n - n1) * unit2 + infrastructure AS capex,
         n1 * (fuel_per_vehicle * cut1 * 1.45) + (n - n1) * (fuel_per_vehicle * cut2 * 1.45) AS fuel,
         n1 * keep1 + (n - n1) * keep2 AS upkeep,
         n1 * (fuel_per_vehicle * 2.68 / 1000 * cut1)
           + (n - n1) * (fuel_per_vehicle * 2.68 / 1000 * cut2) AS co2
  FROM (SELECT *, floor(n * CAST(part1 AS DOUBLE)) AS n1 FROM (
    SELECT *, least(cap, floor(fleet_size * CAST(share AS DOUBLE))) AS n
    FROM all_years, (VALUES
     ('A', 'Conservative Replacement', 10, 0.25, 50000, 1.0, 180000, 0.85, 2500, 0, 0.0, 0, 'LOW', 'SIMPLE'),
     ('B', 'Aggressive Electrification', 25, 0.62, 120000, 1.0, 160000, 0.88, 3000, 0, 0.0, 0, 'HIGH', 'COMPLEX'),
     ('C', 'Hybrid Approach', 15, 0.37, 75000, 0.6, 170000, 0.85, 2750, 140000, 0.35, 1500, 'MEDIUM', 'MODERATE'))
     v(ScenarioID, ScenarioName, cap, share, infrastructure, part1, unit1, cut1, keep1, unit2, cut2, keep2,
       risk, effort)))))""",
}
