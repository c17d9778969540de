"""Joins, measures and load checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import CALENDAR_FIRST, CALENDAR_LAST
from ..functions import display
from ..functions.dates import calendar_of, month_start, quarter_start
from ..functions.ratios import co2_t
from ..operators import ordering
from ..plans import measures as M
from ..plans import pricing, quality
from ..sources import testdata as src
from .registry import MEAN_PRICE, query


def dates(facts, day):
    """The date dimension, with the years the facts need."""
    return calendar_of(facts, day, CALENDAR_FIRST, CALENDAR_LAST)


# ---- joins and filter propagation ------------------------------------------------------------


@query(
    "join_trips_date",
    """SELECT "Year", "Quarter", "MonthName", "DayOfWeek", count(*) AS trips, sum(Distance_km) AS km
       FROM trips JOIN calendar ON TripDate = "Date" GROUP BY ALL""",
)
def join_trips_date(spark, sf):
    """Trips meet the date dimension after a partial sum per day; those without a date are
    counted under a blank one."""
    trips = src.trips(spark, sf)
    daily = trips.groupBy("TripDate").agg(
        F.count(F.lit(1)).alias("trips"), F.sum("Distance_km").alias("km")
    )
    return (
        daily.join(dates(trips, "TripDate"), F.col("TripDate") == F.col("Date"), "left")
        .groupBy("Year", "Quarter", "MonthName", "DayOfWeek")
        .agg(F.sum("trips").alias("trips"), F.sum("km").alias("km"))
    )


@query(
    "join_price_date",
    """SELECT year(PriceMonth) AS "Year", concat('Q', CAST(quarter(PriceMonth) AS VARCHAR)) AS "Quarter",
              monthname(PriceMonth) AS "MonthName", PriceMonth, EUR_per_t, PriceSource FROM price_curve""",
)
def join_price_date(spark, sf):
    """Every price month with its calendar columns, months beyond the fixed calendar too."""
    prices = src.price_curve(spark, sf)
    return prices.join(dates(prices, "PriceMonth"), F.col("PriceMonth") == F.col("Date")).select(
        "Year", "Quarter", "MonthName", "PriceMonth", "EUR_per_t", "PriceSource"
    )


@query(
    "semi_trips_with_invoices",
    """SELECT VIN, count(*) AS total_trips, sum(Distance_km) AS total_distance_km,
              sum(Fuel_l) * 2.68 / 1000 AS co2_t
       FROM trips WHERE VIN IN (SELECT VIN FROM invoices WHERE Litres > 4000) GROUP BY VIN""",
)
def semi_trips_with_invoices(spark, sf):
    """Trip measures of vehicles with an invoice above 4000 litres."""
    context = M.FilterContext(invoices=F.col("Litres") > 4000)
    trips = context.on_trips(src.trips(spark, sf), src.invoices(spark, sf))
    return M.evaluate(trips, ["total_trips", "total_distance_km", "co2_t"], by=["VIN"])


@query(
    "semi_invoices_with_trips",
    """SELECT VIN, sum(EUR_Amount) AS fuel_cost_eur, sum(Litres) AS invoiced_litres,
              sum(EUR_Amount) / sum(Litres) AS avg_fuel_price_eur_l
       FROM invoices WHERE VIN IN (SELECT VIN FROM trips
            WHERE TripDate BETWEEN DATE '2027-03-01' AND DATE '2027-03-07') GROUP BY VIN""",
)
def semi_invoices_with_trips(spark, sf):
    """Invoice totals of vehicles on the road in one week."""
    context = M.FilterContext(first_day="2027-03-01", last_day="2027-03-07")
    invoices = context.on_invoices(src.invoices(spark, sf), src.trips(spark, sf))
    return M.fuel_cost(invoices, ["VIN"])


@query(
    "ets_cost_by_price_month",
    """SELECT *, rank() OVER (PARTITION BY month ORDER BY ets_cost_eur DESC) AS cost_rank FROM (
       SELECT VIN, InvoiceMonth AS month, litres * 2.68 / 1000 AS co2_t,
              coalesce(EUR_per_t, 85) AS EUR_per_t,
              litres * 2.68 / 1000 * coalesce(EUR_per_t, 85) AS ets_cost_eur
       FROM vehicle_month LEFT JOIN price_curve ON InvoiceMonth = PriceMonth)""",
)
def ets_cost_by_price_month(spark, sf):
    """Emission cost per vehicle and month at the month's price, ranked within the month."""
    monthly = M.vehicle_month(src.trips(spark, sf)).select(
        "VIN", "month", co2_t(F.col("litres")).alias("co2_t")
    )
    priced = pricing.with_month_price(monthly, src.price_curve(spark, sf), "month")
    cost = priced.withColumn("ets_cost_eur", F.col("co2_t") * F.col("EUR_per_t"))
    return ordering.rank(cost, "ets_cost_eur", by=["month"], name="cost_rank")


@query(
    "compliance_table",
    """SELECT strftime(PriceMonth, '%Y-%m') AS month, EUR_per_t, co2 AS co2_t, EUR_per_t * co2 AS ets_cost_eur,
              format('€{:,.2f}', EUR_per_t) AS price_text, format('{:,.1f} t', co2) AS co2_text,
              format('€{:,.0f}', EUR_per_t * co2) AS cost_text
       FROM price_curve, (SELECT sum(Fuel_l) * 2.68 / 1000 AS co2 FROM trips)""",
)
def compliance_table(spark, sf):
    """Cost of the whole emission at every month's price; the total enters as a scalar."""
    total = M.evaluate(src.trips(spark, sf), ["co2_t"]).scalar()
    cost = F.col("EUR_per_t") * F.col("co2_t")
    return (
        src.price_curve(spark, sf).withColumn("co2_t", total)
        .select(
            display.month_text("PriceMonth").alias("month"),
            "EUR_per_t",
            "co2_t",
            cost.alias("ets_cost_eur"),
            display.euro_text(F.col("EUR_per_t"), 2).alias("price_text"),
            display.tonnes_text(F.col("co2_t")).alias("co2_text"),
            display.euro_text(cost).alias("cost_text"),
        )
    )


@query(
    "dq_orphan_vins",
    """WITH valid AS (SELECT DISTINCT VIN, CAST(date_trunc('month', CAST(InvoiceDate AS DATE)) AS DATE) AS InvoiceMonth
                      FROM raw_invoices WHERE VIN IS NOT NULL AND Litres > 0 AND EUR_Amount > 0)
       SELECT 'invoices' AS missing_in, VIN, InvoiceMonth FROM vehicle_month v
       WHERE NOT EXISTS (SELECT 1 FROM valid w WHERE w.VIN = v.VIN AND w.InvoiceMonth = v.InvoiceMonth)
       UNION ALL
       SELECT 'trips', VIN, InvoiceMonth FROM valid v
       WHERE NOT EXISTS (SELECT 1 FROM vehicle_month w WHERE w.VIN = v.VIN AND w.InvoiceMonth = v.InvoiceMonth)""",
)
def dq_orphan_vins(spark, sf):
    """Vehicle months present in one fact only, both ways."""
    trips = src.trips(spark, sf).select(
        "VIN", month_start("TripDate").alias("InvoiceMonth")
    )
    valid = (
        src.raw_invoices(spark, sf)
        .where("VIN IS NOT NULL AND Litres > 0 AND EUR_Amount > 0")
        .select("VIN", month_start(F.to_date("InvoiceDate")).alias("InvoiceMonth"))
    )
    keys = ["VIN", "InvoiceMonth"]
    return quality.orphans(trips, valid, keys, ("invoices", "trips"))


@query(
    "dq_fuel_reconciliation",
    """SELECT coalesce(v.VIN, i.VIN) AS VIN, coalesce(v.InvoiceMonth, i.InvoiceMonth) AS InvoiceMonth,
              litres AS consumed_l, invoiced_l,
              coalesce((invoiced_l - litres) / litres, 0) AS deviation,
              CASE WHEN litres IS NULL THEN 'NO_TRIPS' WHEN invoiced_l IS NULL THEN 'NO_INVOICE'
                   WHEN abs(invoiced_l - litres) <= 0.05 * litres THEN 'MATCH' ELSE 'MISMATCH' END AS status
       FROM vehicle_month v FULL JOIN (
            SELECT VIN, CAST(date_trunc('month', CAST(InvoiceDate AS DATE)) AS DATE) AS InvoiceMonth,
                   sum(Litres) AS invoiced_l FROM raw_invoices GROUP BY ALL) i
       ON v.VIN = i.VIN AND v.InvoiceMonth = i.InvoiceMonth""",
)
def dq_fuel_reconciliation(spark, sf):
    raw = src.raw_invoices(spark, sf).select(
        "VIN", month_start(F.to_date("InvoiceDate")).alias("InvoiceMonth"), "Litres"
    )
    return quality.fuel_reconciliation(
        src.vehicle_month_litres(src.trips(spark, sf)), raw
    )


# ---- fleet, emission and cost measures -------------------------------------------------------

OVERVIEW = [
    "total_trips", "fleet_size", "total_distance_km", "avg_distance_per_trip", "total_fuel_l",
    "efficiency_l_100km", "avg_trip_hours",
]
OVERVIEW_SQL = """count(*) AS total_trips, count(DISTINCT VIN) AS fleet_size,
 sum(Distance_km) AS total_distance_km, sum(Distance_km) / count(*) AS avg_distance_per_trip,
 sum(Fuel_l) AS total_fuel_l, sum(Fuel_l) / (sum(Distance_km) / 100) AS efficiency_l_100km,
 CAST(sum(CAST(epoch(EndTimeUTC) - epoch(StartTimeUTC) AS BIGINT)) AS DOUBLE) / count(*) / 3600 AS avg_trip_hours"""


@query("fleet_overview", f"SELECT {OVERVIEW_SQL} FROM trips")
def fleet_overview(spark, sf):
    return M.evaluate(src.trips(spark, sf), OVERVIEW)


@query(
    "fleet_overview_by_month",
    f"SELECT CAST(date_trunc('month', TripDate) AS DATE) AS month, {OVERVIEW_SQL} FROM trips GROUP BY 1",
)
def fleet_overview_by_month(spark, sf):
    """The same measures under a grouping."""
    return M.evaluate(src.trips(spark, sf), OVERVIEW, by=[month_start("TripDate").alias("month")])


@query(
    "fleet_size_approx",
    "SELECT count(DISTINCT VIN) AS fleet_size, true AS sketch_is_near FROM trips",
)
def fleet_size_approx(spark, sf):
    """Distinct vehicles, and whether their sketch (2 % relative deviation) comes near them."""
    return M.fleet_size_check(src.trips(spark, sf))


@query(
    "co2_footprint",
    """SELECT VIN, sum(Fuel_l) * 2.68 AS co2_kg, sum(Fuel_l) * 2.68 / 1000 AS co2_t,
              sum(Fuel_l) * 2.68 * 1000 / sum(Distance_km) AS co2_per_km_g FROM trips GROUP BY VIN""",
)
def co2_footprint(spark, sf):
    return M.evaluate(src.trips(spark, sf), ["co2_kg", "co2_t", "co2_per_km_g"], by=["VIN"])


@query(
    "monthly_co2",
    """SELECT month(StartTimeUTC) AS month_no, sum(Fuel_l) * 2.68 / 1000 AS co2_t
       FROM trips GROUP BY ALL""",
)
def monthly_co2(spark, sf):
    return M.co2_by_month_of_year(src.trips(spark, sf))


@query(
    "param_current_price",
    """SELECT CAST(date_trunc('quarter', PriceMonth) AS DATE) AS quarter, PriceSource,
              CASE WHEN count(DISTINCT EUR_per_t) = 1 THEN max(EUR_per_t) ELSE 85 END AS current_price
       FROM price_curve GROUP BY ALL""",
)
def param_current_price(spark, sf):
    """The price a selection of one quarter and source yields."""
    return src.price_curve(spark, sf).groupBy(
        quarter_start("PriceMonth").alias("quarter"), "PriceSource"
    ).agg(pricing.selected_price(F.col("EUR_per_t")).alias("current_price"))


@query(
    "ets_cost",
    """SELECT VIN, sum(Fuel_l) * 2.68 / 1000 AS co2_t, sum(Fuel_l) * 2.68 / 1000 * 85 AS ets_cost_eur,
              sum(Fuel_l) * 2.68 / 1000 * 85 / sum(Distance_km) AS ets_cost_per_km FROM trips GROUP BY VIN""",
)
def ets_cost(spark, sf):
    return M.evaluate(
        src.trips(spark, sf), ["co2_t", "ets_cost_eur", "ets_cost_per_km"], by=["VIN"]
    )


@query(
    "monthly_ets_cost",
    """SELECT month(StartTimeUTC) AS month_no, sum(Fuel_l) * 2.68 / 1000 AS co2_t,
              sum(Fuel_l) * 2.68 / 1000 * 85 AS ets_cost_eur FROM trips GROUP BY ALL""",
)
def monthly_ets_cost(spark, sf):
    return M.co2_by_month_of_year(src.trips(spark, sf)).withColumn(
        "ets_cost_eur", F.col("co2_t") * 85
    )


ANNUAL_SQL = """sum(Fuel_l) * 2.68 / 1000 / datediff('day', min(StartTimeUTC), max(StartTimeUTC)) * 365"""


@query(
    "annual_ets_projection",
    f"""SELECT VIN, datediff('day', min(StartTimeUTC), max(StartTimeUTC)) AS days_in_data,
              {ANNUAL_SQL} AS annual_co2_t, {ANNUAL_SQL} * 85 AS annual_ets_cost_eur
       FROM trips GROUP BY VIN""",
)
def annual_ets_projection(spark, sf):
    return M.evaluate(
        src.trips(spark, sf), ["days_in_data", "annual_co2_t", "annual_ets_cost_eur"], by=["VIN"]
    )


@query(
    "fuel_cost",
    """SELECT SupplierName, sum(EUR_Amount) AS fuel_cost_eur, sum(Litres) AS invoiced_litres,
              sum(EUR_Amount) / sum(Litres) AS avg_fuel_price_eur_l FROM invoices GROUP BY ALL""",
)
def fuel_cost(spark, sf):
    return M.fuel_cost(src.invoices(spark, sf), ["SupplierName"])


@query(
    "monthly_fuel_cost",
    """SELECT month(InvoiceMonth) AS month_no, sum(EUR_Amount) AS fuel_cost_eur
       FROM invoices GROUP BY ALL""",
)
def monthly_fuel_cost(spark, sf):
    return src.invoices(spark, sf).groupBy(F.month("InvoiceMonth").alias("month_no")).agg(
        F.sum("EUR_Amount").alias("fuel_cost_eur")
    )


@query(
    "fuel_cost_per_km",
    """SELECT VIN, km AS total_distance_km, eur AS fuel_cost_eur, l AS invoiced_litres,
              eur / l AS avg_fuel_price_eur_l, eur / km AS fuel_cost_per_km
       FROM (SELECT VIN, sum(Distance_km) AS km FROM trips GROUP BY VIN)
       FULL JOIN (SELECT VIN, sum(EUR_Amount) AS eur, sum(Litres) AS l FROM invoices GROUP BY VIN)
       USING (VIN)""",
)
def fuel_cost_per_km(spark, sf):
    return M.fuel_cost_per_km(src.trips(spark, sf), src.invoices(spark, sf), ["VIN"])


KPI_SQL = """SELECT {by} total_trips / (fleet_size * days * 30) AS fleet_utilization,
   total_trips / (fleet_size * days) AS trips_per_vehicle_day,
   CASE WHEN eff <= 28 THEN 1 ELSE 28 / eff END AS compliance_rate,
   (30 - eff) / 30 AS vs_industry_benchmark
 FROM (SELECT {by} CAST(count(*) AS DOUBLE) AS total_trips, count(DISTINCT VIN) AS fleet_size,
       datediff('day', min(StartTimeUTC), max(StartTimeUTC)) AS days,
       sum(Fuel_l) / (sum(Distance_km) / 100) AS eff FROM {source} GROUP BY ALL)"""


@query(
    "fleet_kpis",
    KPI_SQL.format(
        by='"year",', source='(SELECT *, year(TripDate) AS "year" FROM trips) y'
    ),
    doubles="compliance_rate vs_industry_benchmark",
)
def fleet_kpis(spark, sf):
    return M.evaluate(
        src.trips(spark, sf),
        ["fleet_utilization", "trips_per_vehicle_day", "compliance_rate",
         "vs_industry_benchmark"],
        by=[F.year("TripDate").alias("year")],
    )


@query(
    "compliance_risk",
    """SELECT VIN, rate AS compliance_rate,
              CAST(CASE WHEN rate >= 0.95 THEN 1 WHEN rate >= 0.9 THEN 2 WHEN rate >= 0.85 THEN 3 ELSE 4 END
                AS BIGINT) AS compliance_risk_score,
              CASE WHEN rate >= 0.95 THEN '✅ Compliant' WHEN rate >= 0.9 THEN '⚠️ At Risk'
                   ELSE '❌ Non-Compliant' END AS compliance_status
       FROM (SELECT VIN, CASE WHEN eff <= 28 THEN CAST(1 AS DOUBLE) ELSE CAST(28 AS DOUBLE) / eff END AS rate
             FROM (SELECT VIN, sum(Fuel_l) / (sum(Distance_km) / 100) AS eff FROM trips GROUP BY VIN))""",
    doubles="compliance_rate",
)
def compliance_risk(spark, sf):
    return M.evaluate(
        src.trips(spark, sf),
        ["compliance_rate", "compliance_risk_score", "compliance_status"],
        by=["VIN"],
    )


FORECAST_FROM = "2026-07-01"


@query(
    "ets_cost_forecast",
    f"""SELECT VIN, {ANNUAL_SQL} * (SELECT {MEAN_PRICE} FROM price_curve
                 WHERE PriceMonth >= DATE '{FORECAST_FROM}') AS ets_cost_forecast_eur
       FROM trips GROUP BY VIN""",
)
def ets_cost_forecast(spark, sf):
    """Annual emission at the mean price from a given day on."""
    future = src.price_curve(spark, sf).where(
        F.col("PriceMonth") >= F.lit(FORECAST_FROM).cast("date")
    )
    annual = M.evaluate(src.trips(spark, sf), ["annual_co2_t"], by=["VIN"])
    price = future.agg(pricing.mean_price()).scalar()
    return annual.select("VIN", (F.col("annual_co2_t") * price).alias("ets_cost_forecast_eur"))


@query(
    "price_volatility",
    """SELECT PriceSource, stddev_pop(EUR_per_t) / avg(EUR_per_t) AS volatility
       FROM price_curve GROUP BY ALL
       UNION ALL SELECT 'ALL', stddev_pop(EUR_per_t) / avg(EUR_per_t) FROM price_curve""",
    doubles="volatility",
)
def price_volatility(spark, sf):
    curve = src.price_curve(spark, sf)
    by_source = curve.groupBy("PriceSource").agg(
        F.try_divide(F.stddev_pop("EUR_per_t"), F.avg("EUR_per_t")).alias("volatility")
    )
    return by_source.unionByName(
        pricing.volatility(curve).select(F.lit("ALL").alias("PriceSource"), "volatility")
    )


@query(
    "vehicle_summary_top10",
    """SELECT VIN, count(*) AS total_trips, round(sum(Distance_km), 2) AS total_distance_km,
              round(sum(Fuel_l), 2) AS total_fuel_l,
              round(sum(Fuel_l) / sum(Distance_km) * 100, 2) AS efficiency_l_100km
       FROM trips GROUP BY VIN ORDER BY VIN LIMIT 10""",
)
def vehicle_summary_top10(spark, sf):
    """The report's table: the first ten vehicles by number."""
    per_vehicle = src.trips(spark, sf).groupBy("VIN").agg(
        F.count("TripID").alias("total_trips"),
        F.sum("Distance_km").alias("km"),
        F.sum("Fuel_l").alias("l"),
    )
    return per_vehicle.orderBy("VIN").limit(10).select(
        "VIN",
        "total_trips",
        F.round("km", 2).alias("total_distance_km"),
        F.round("l", 2).alias("total_fuel_l"),
        F.round(F.try_divide("l", "km") * 100, 2).alias("efficiency_l_100km"),
    )


@query("daily_trips", "SELECT TripDate, count(*) AS trips FROM trips GROUP BY ALL")
def daily_trips(spark, sf):
    return src.trips(spark, sf).groupBy("TripDate").agg(F.count(F.lit(1)).alias("trips"))


@query(
    "monthly_ets_breakdown",
    """SELECT strftime(InvoiceMonth, '%Y-%m') AS month, sum(litres) AS fuel_l,
              sum(litres) * 2.68 / 1000 AS co2_t, sum(litres) * 2.68 / 1000 * 85 AS ets_cost_eur
       FROM vehicle_month GROUP BY ALL""",
)
def monthly_ets_breakdown(spark, sf):
    return M.evaluate(
        src.trips(spark, sf),
        ["total_fuel_l", "co2_t", "ets_cost_eur"],
        by=[display.month_text("TripDate").alias("month")],
    ).withColumnRenamed("total_fuel_l", "fuel_l")


@query("vehicle_month_fuel", "SELECT VIN, InvoiceMonth AS month, litres FROM vehicle_month")
def vehicle_month_fuel(spark, sf):
    return M.vehicle_month(src.trips(spark, sf)).select("VIN", "month", "litres")


@query(
    "vehicle_stats",
    """SELECT VIN, sum(Distance_km) AS distance_km, sum(Fuel_l) AS fuel_l, count(TripID) AS trips
       FROM trips GROUP BY VIN""",
)
def vehicle_stats(spark, sf):
    from ..plans.replacement import vehicle_stats as stats

    return stats(src.trips(spark, sf)).select("VIN", "distance_km", "fuel_l", "trips")


@query(
    "map_sample",
    """WITH s AS (SELECT * FROM trips ORDER BY md5(concat('map-1', TripID)), TripID LIMIT 500)
       SELECT TripID, VIN, StartLat, StartLon, Distance_km,
              (SELECT avg(StartLat) FROM s) AS center_lat, (SELECT avg(StartLon) FROM s) AS center_lon
       FROM s""",
    doubles="center_lat center_lon",
)
def map_sample(spark, sf):
    """At most 500 trips in the order of a seeded hash, with the centre of the map."""
    sample = (
        src.trips(spark, sf)
        .orderBy(F.md5(F.concat(F.lit("map-1"), F.col("TripID")).cast("binary")), "TripID")
        .limit(500)
        .select("TripID", "VIN", "StartLat", "StartLon", "Distance_km")
    )
    whole = Window.partitionBy()  # the 500 sampled rows
    return sample.select(
        "*",
        F.avg("StartLat").over(whole).alias("center_lat"),
        F.avg("StartLon").over(whole).alias("center_lon"),
    )


@query(
    "eua_purchase_schedule",
    """SELECT month, l * 2.68 / 1000 AS co2_t, EUR_per_t, l * 2.68 / 1000 * EUR_per_t AS purchase_eur,
              sum(l) OVER (ORDER BY month) * 2.68 / 1000 AS cumulative_t,
              sum(l * round(EUR_per_t * 100)) OVER (ORDER BY month) * 2.68 / 1000 / 100 AS cumulative_eur
       FROM (SELECT InvoiceMonth AS month, sum(litres) AS l, coalesce(any_value(EUR_per_t), 85) AS EUR_per_t
             FROM vehicle_month LEFT JOIN price_curve ON InvoiceMonth = PriceMonth GROUP BY InvoiceMonth)""",
)
def eua_purchase_schedule(spark, sf):
    """Allowances to buy per month, with running totals over the months (one row each).

    The running cost adds litres x cents, which is exact, and is scaled afterwards.
    """
    monthly = M.evaluate(
        src.trips(spark, sf), ["total_fuel_l", "co2_t"], by=[month_start("TripDate").alias("month")]
    )
    priced = pricing.with_month_price(monthly, src.price_curve(spark, sf), "month")
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.round(F.col("EUR_per_t") * 100)
    return priced.select(
        "month",
        "co2_t",
        "EUR_per_t",
        (F.col("co2_t") * F.col("EUR_per_t")).alias("purchase_eur"),
        co2_t(F.sum("total_fuel_l").over(so_far)).alias("cumulative_t"),
        (co2_t(F.sum(F.col("total_fuel_l") * cents).over(so_far)) / 100).alias("cumulative_eur"),
    )


# ---- load checks -----------------------------------------------------------------------------


@query(
    "dq_trip_range",
    """SELECT min(StartTimeUTC) AS min_date, max(EndTimeUTC) AS max_date,
              count(DISTINCT VIN) AS unique_vehicles FROM trips""",
)
def dq_trip_range(spark, sf):
    return quality.trip_range(src.trips(spark, sf))


@query(
    "dq_fuel_totals",
    """SELECT count(DISTINCT VIN) AS vehicles_with_fuel_data,
              count(DISTINCT InvoiceMonth) AS months_with_data, sum(Litres) AS total_litres,
              sum(EUR_Amount) AS total_eur FROM invoices""",
)
def dq_fuel_totals(spark, sf):
    return quality.fuel_totals(src.invoices(spark, sf))


@query(
    "dq_price_range",
    f"""SELECT count(*) AS months, min(PriceMonth) AS first_month, max(PriceMonth) AS last_month,
              {MEAN_PRICE} AS avg_price, min(EUR_per_t) AS min_price, max(EUR_per_t) AS max_price
       FROM price_curve""",
)
def dq_price_range(spark, sf):
    return quality.price_range(src.price_curve(spark, sf))


@query(
    "dq_null_dates",
    "SELECT count(*) AS trips, count(*) FILTER (TripDate IS NULL) AS null_trip_dates FROM trips",
)
def dq_null_dates(spark, sf):
    return quality.missing_dates(src.trips(spark, sf))


@query(
    "dq_co2_accuracy",
    """SELECT sum(Fuel_l * 2.68) AS by_trip_kg, sum(Fuel_l) * 2.68 AS by_total_kg,
              abs(sum(Fuel_l * 2.68) - sum(Fuel_l) * 2.68) <= 1e-9 * abs(sum(Fuel_l) * 2.68) AS accurate
       FROM trips""",
    doubles="by_trip_kg by_total_kg",
    decimals=3,
)
def dq_co2_accuracy(spark, sf):
    return quality.co2_accuracy(src.trips(spark, sf))



