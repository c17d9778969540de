"""Time intelligence, what-if parameters and calculation groups."""

from pyspark.sql import functions as F

from ..functions import display
from ..functions.dates import month_start
from ..functions.ratios import co2_t, divide
from ..plans import calcgroups as C
from ..plans import measures as M
from ..plans import pricing, scenarios
from ..plans import timeintel as T
from ..plans import whatif as W
from ..sources import testdata as src
from .fleet import dates
from .registry import query
from .scenario import yearly_scenarios


def daily_litres(spark, sf):
    trips = src.trips(spark, sf)
    return T.dense_daily(trips, dates(trips, "TripDate"), "TripDate", "Fuel_l", "litres")


def monthly_co2(spark, sf, period="month"):
    litres = T.by_period(src.trips(spark, sf), period, "TripDate", "Fuel_l", "litres")
    return litres.select(period, co2_t(F.col("litres")).alias("co2_t"))


# ---- time intelligence -----------------------------------------------------------------------


@query(
    "dim_date",
    """SELECT c.*, coalesce(n, 0) AS trips FROM calendar c
       LEFT JOIN (SELECT TripDate, count(*) AS n FROM trips GROUP BY ALL) t ON TripDate = "Date" """,
)
def dim_date(spark, sf):
    """The date dimension with the trips of each day; a blank date has the trips without one."""
    trips = src.trips(spark, sf)
    daily = trips.groupBy("TripDate").agg(F.count(F.lit(1)).alias("n"))
    calendar = dates(trips, "TripDate")
    return calendar.join(daily, F.col("TripDate") == F.col("Date"), "full").select(
        *calendar.columns, F.coalesce("n", F.lit(0)).alias("trips")
    )


@query(
    "ytd_co2",
    """SELECT "Date", sum(litres) OVER (PARTITION BY "Year" ORDER BY "Date") * 2.68 / 1000 AS ytd_co2_t FROM daily""",
)
def ytd_co2(spark, sf):
    series = T.to_date(daily_litres(spark, sf), "year", "litres")
    return series.select("Date", co2_t(F.col("to_date")).alias("ytd_co2_t"))


@query(
    "mtd_ets_cost",
    """SELECT "Date", sum(litres) OVER (PARTITION BY "Year", "Month" ORDER BY "Date") * 2.68 / 1000 * 85
                AS mtd_ets_cost_eur FROM daily""",
)
def mtd_ets_cost(spark, sf):
    series = T.to_date(daily_litres(spark, sf), "month", "litres")
    return series.select("Date", (co2_t(F.col("to_date")) * 85).alias("mtd_ets_cost_eur"))


@query(
    "qtd_fuel_cost",
    """SELECT month, eur AS fuel_cost_eur,
              sum(eur) OVER (PARTITION BY date_trunc('quarter', month) ORDER BY month) AS qtd_fuel_cost_eur
       FROM (SELECT InvoiceMonth AS month, sum(EUR_Amount) AS eur FROM invoices GROUP BY ALL)""",
)
def qtd_fuel_cost(spark, sf):
    monthly = T.by_period(
        src.invoices(spark, sf), "month", "InvoiceMonth", "EUR_Amount", "fuel_cost_eur"
    )
    return T.to_date(monthly, "quarter", "fuel_cost_eur", day="month", name="qtd_fuel_cost_eur")


PREVIOUS_SQL = """WITH p AS (SELECT CAST(date_trunc('{period}', TripDate) AS DATE) AS {period},
          sum(Fuel_l) * 2.68 / 1000 AS co2_t FROM trips GROUP BY ALL)
   SELECT a.{period}, a.co2_t, b.co2_t AS previous_co2_t FROM p a
   LEFT JOIN p b ON b.{period} = CAST(a.{period} - INTERVAL {months} MONTH AS DATE)"""


def previous(spark, sf, period):
    return T.with_previous(
        monthly_co2(spark, sf, period), period, T.MONTHS[period], "co2_t", "previous_co2_t"
    )


@query("prev_month", PREVIOUS_SQL.format(period="month", months=1))
def prev_month(spark, sf):
    return previous(spark, sf, "month")


@query("prev_quarter", PREVIOUS_SQL.format(period="quarter", months=3))
def prev_quarter(spark, sf):
    return previous(spark, sf, "quarter")


@query("prev_year", PREVIOUS_SQL.format(period="year", months=12))
def prev_year(spark, sf):
    return previous(spark, sf, "year")


CHANGE_SQL = """WITH p AS (SELECT CAST(date_trunc('month', TripDate) AS DATE) AS month,
          sum(Fuel_l) * 2.68 / 1000{price} AS v FROM trips GROUP BY ALL)
   SELECT a.month, a.v AS {name}, coalesce((a.v - b.v) / nullif(b.v, 0), 0) AS change FROM p a
   LEFT JOIN p b ON b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE)"""


@query("co2_vs_prev", CHANGE_SQL.format(price="", name="co2_t"))
def co2_vs_prev(spark, sf):
    return previous(spark, sf, "month").select(
        "month", "co2_t", T.change("co2_t", "previous_co2_t").alias("change")
    )


@query("ets_vs_prev", CHANGE_SQL.format(price=" * 85", name="ets_cost_eur"))
def ets_vs_prev(spark, sf):
    cost = monthly_co2(spark, sf).select("month", (F.col("co2_t") * 85).alias("ets_cost_eur"))
    both = T.with_previous(cost, "month", 1, "ets_cost_eur")
    return both.select("month", "ets_cost_eur", T.change("ets_cost_eur", "previous").alias("change"))


@query(
    "running_co2",
    """SELECT "Date", sum(litres) OVER (ORDER BY "Date") * 2.68 / 1000 AS running_co2_t FROM daily""",
)
def running_co2(spark, sf):
    series = T.running_total(daily_litres(spark, sf), "litres")
    return series.select("Date", co2_t(F.col("running_total")).alias("running_co2_t"))


@query(
    "running_ets",
    """SELECT "Date", sum(litres) OVER (ORDER BY "Date") * 2.68 / 1000 * 85 AS running_ets_eur FROM daily""",
)
def running_ets(spark, sf):
    series = T.running_total(daily_litres(spark, sf), "litres")
    return series.select("Date", (co2_t(F.col("running_total")) * 85).alias("running_ets_eur"))


@query(
    "moving_avg_3m",
    """SELECT a."Date", (SELECT avg(litres_or_blank) FROM daily b
              WHERE b."Date" <= a."Date" AND b."Date" > CAST(a."Date" - INTERVAL 3 MONTH AS DATE))
              * 2.68 / 1000 AS moving_avg_co2_t FROM daily a""",
)
def moving_avg_3m(spark, sf):
    """Mean daily emission of the three months up to each day."""
    series = T.moving_average_months(daily_litres(spark, sf), 3, "litres")
    return series.select("Date", co2_t(F.col("moving_average")).alias("moving_avg_co2_t"))


@query(
    "rank_vin",
    """SELECT VIN, co2_t, rank() OVER (ORDER BY co2_t DESC) AS rank
       FROM (SELECT VIN, sum(Fuel_l) * 2.68 / 1000 AS co2_t FROM trips GROUP BY VIN)""",
)
def rank_vin(spark, sf):
    return C.rank(M.evaluate(src.trips(spark, sf), ["co2_t"], by=["VIN"]), "co2_t")


@query(
    "pct_of_total",
    """SELECT VIN, total_fuel_l, total_fuel_l / sum(total_fuel_l) OVER () AS share
       FROM (SELECT VIN, sum(Fuel_l) AS total_fuel_l FROM trips GROUP BY VIN)""",
)
def pct_of_total(spark, sf):
    return C.share_of_total(
        M.evaluate(src.trips(spark, sf), ["total_fuel_l"], by=["VIN"]), "total_fuel_l"
    )


# ---- what-if parameters ----------------------------------------------------------------------


@query(
    "price_sensitivity",
    """SELECT CAST(p AS BIGINT) AS ets_price, co2 * p AS total_cost_eur
       FROM (SELECT sum(Fuel_l) * 2.68 / 1000 AS co2 FROM trips), range(50, 151, 10) t(p)""",
)
def price_sensitivity(spark, sf):
    total = M.evaluate(src.trips(spark, sf), ["co2_t"])
    return W.with_parameter(total, W.ETS_PRICE_CHART, "ets_price").select(
        "ets_price", (F.col("co2_t") * F.col("ets_price")).alias("total_cost_eur")
    )


@query(
    "price_parameter_series",
    """SELECT CAST(p AS BIGINT) AS ets_price, concat('€', CAST(p AS VARCHAR), '/t') AS label,
              CAST(p - 49 AS BIGINT) AS parameter_order, co2 * p AS ets_cost_eur
       FROM (SELECT sum(Fuel_l) * 2.68 / 1000 AS co2 FROM trips), range(50, 151) t(p)""",
)
def price_parameter_series(spark, sf):
    """The allowance-price slider, each position with the fleet's cost."""
    total = M.evaluate(src.trips(spark, sf), ["co2_t"])
    return W.with_parameter(total, W.ETS_PRICE, "ets_price").select(
        "ets_price",
        W.price_label(F.col("ets_price")).alias("label"),
        "parameter_order",
        (F.col("co2_t") * F.col("ets_price")).alias("ets_cost_eur"),
    )


@query(
    "fuel_price_parameter",
    """SELECT p / CAST(100 AS DOUBLE) AS fuel_price, format('€{:,.2f}/L', p / CAST(100 AS DOUBLE)) AS label,
              CAST((p - 100) / 5 + 1 AS BIGINT) AS parameter_order,
              l * (p / CAST(100 AS DOUBLE)) AS fuel_cost_eur
       FROM (SELECT sum(Litres) AS l FROM invoices), range(100, 201, 5) t(p)""",
)
def fuel_price_parameter(spark, sf):
    """The fuel-price slider applied to the invoiced litres."""
    litres = src.invoices(spark, sf).agg(F.sum("Litres").alias("l"))
    rows = W.with_parameter(litres, W.FUEL_PRICE_CENTS, "cents")
    price = F.col("cents") / 100
    return rows.select(
        price.alias("fuel_price"),
        W.fuel_price_label(F.col("cents")).alias("label"),
        "parameter_order",
        (F.col("l") * price).alias("fuel_cost_eur"),
    )


@query(
    "fleet_size_parameter",
    """SELECT CAST(p AS BIGINT) AS fleet_size, concat(CAST(p AS VARCHAR), ' vehicles') AS label,
              CAST((p - 20) / 5 + 1 AS BIGINT) AS parameter_order, per_vehicle * p AS co2_t
       FROM (SELECT sum(Fuel_l) * 2.68 / 1000 / count(DISTINCT VIN) AS per_vehicle FROM trips),
            range(20, 101, 5) t(p)""",
)
def fleet_size_parameter(spark, sf):
    """The fleet-size slider applied to the emission per vehicle."""
    fleet = M.evaluate(src.trips(spark, sf), ["co2_t", "fleet_size"]).select(
        divide(F.col("co2_t"), F.col("fleet_size")).alias("per_vehicle")
    )
    return W.with_parameter(fleet, W.FLEET_SIZE, "fleet_size").select(
        "fleet_size",
        W.fleet_size_label(F.col("fleet_size")).alias("label"),
        "parameter_order",
        (F.col("per_vehicle") * F.col("fleet_size")).alias("co2_t"),
    )


@query(
    "efficiency_parameter",
    """SELECT CAST(p AS BIGINT) AS efficiency_target, concat(CAST(p AS VARCHAR), ' L/100km') AS label,
              CAST(p - 19 AS BIGINT) AS parameter_order, km / 100 * p AS litres_at_target,
              litres - km / 100 * p AS litres_saved
       FROM (SELECT sum(Fuel_l) AS litres, sum(Distance_km) AS km FROM trips), range(20, 36) t(p)""",
)
def efficiency_parameter(spark, sf):
    """The efficiency-target slider applied to the distance driven."""
    fleet = M.evaluate(src.trips(spark, sf), ["total_fuel_l", "total_distance_km"])
    at_target = F.col("total_distance_km") / 100 * F.col("efficiency_target")
    return W.with_parameter(fleet, W.EFFICIENCY, "efficiency_target").select(
        "efficiency_target",
        W.efficiency_label(F.col("efficiency_target")).alias("label"),
        "parameter_order",
        at_target.alias("litres_at_target"),
        (F.col("total_fuel_l") - at_target).alias("litres_saved"),
    )


@query(
    "scenario_parameter",
    """SELECT "year", concat('Scenario ', ScenarioID) AS scenario_parameter, ScenarioID AS field,
              CAST(ascii(ScenarioID) - 64 AS BIGINT) AS parameter_order,
              ScenarioID = 'B' AS is_default, NPV_EUR FROM scenario_run""",
    doubles="NPV_EUR",
)
def scenario_parameter(spark, sf):
    """The scenario selector with each year's net value; B is chosen when nothing is."""
    default = W.selected_scenario(F.lit(None).cast("string"))
    return yearly_scenarios(spark, sf).select(
        "year",
        F.concat(F.lit("Scenario "), F.col("ScenarioID")).alias("scenario_parameter"),
        F.col("ScenarioID").alias("field"),
        (F.ascii("ScenarioID") - 64).alias("parameter_order"),
        (F.col("ScenarioID") == default).alias("is_default"),
        "NPV_EUR",
    )


@query(
    "parameter_validation",
    """SELECT InvoiceMonth AS month, coalesce(EUR_per_t, 85) AS ets_price, eur / l AS fuel_price,
              CASE WHEN coalesce(EUR_per_t, 85) BETWEEN 50 AND 150 AND eur / l BETWEEN 1 AND 2
                   THEN '✅ Valid' ELSE '❌ Invalid Parameters' END AS status
       FROM (SELECT InvoiceMonth, sum(EUR_Amount) AS eur, sum(Litres) AS l FROM invoices GROUP BY ALL)
       LEFT JOIN price_curve ON PriceMonth = InvoiceMonth""",
)
def parameter_validation(spark, sf):
    """Whether each month's allowance and fuel price lies within the sliders."""
    monthly = M.fuel_cost(src.invoices(spark, sf), ["InvoiceMonth"])
    priced = pricing.with_month_price(
        monthly, src.price_curve(spark, sf), "InvoiceMonth", name="ets_price"
    )
    return priced.select(
        F.col("InvoiceMonth").alias("month"),
        "ets_price",
        F.col("avg_fuel_price_eur_l").alias("fuel_price"),
        display.parameter_status(F.col("ets_price"), F.col("avg_fuel_price_eur_l")).alias(
            "status"
        ),
    )


# ---- calculation groups ----------------------------------------------------------------------


@query(
    "scenario_columns",
    """SELECT "year", sum(NPV_EUR) FILTER (ScenarioID = 'A') AS scenario_a,
              sum(NPV_EUR) FILTER (ScenarioID = 'B') AS scenario_b,
              sum(NPV_EUR) FILTER (ScenarioID = 'C') AS scenario_c FROM scenario_run GROUP BY "year" """,
    doubles="scenario_a scenario_b scenario_c",
)
def scenario_columns(spark, sf):
    table = C.scenario_columns(yearly_scenarios(spark, sf), "NPV_EUR", by=["year"])
    return table.drop("best_scenario", "worst_scenario")


@query(
    "scenario_best_worst",
    """SELECT "year", max(CO2_Reduction_t) AS best_scenario, min(CO2_Reduction_t) AS worst_scenario
       FROM scenario_run GROUP BY "year" """,
)
def scenario_best_worst(spark, sf):
    table = C.scenario_columns(yearly_scenarios(spark, sf), "CO2_Reduction_t", by=["year"])
    return table.select("year", "best_scenario", "worst_scenario")


@query(
    "variance_analysis",
    """SELECT VIN, v AS actual, v * 1.1 AS budget, v - v * 1.1 AS variance,
              (v - v * 1.1) / (v * 1.1) AS variance_pct
       FROM (SELECT VIN, sum(Fuel_l) * 2.68 / 1000 * 85 AS v FROM trips GROUP BY VIN)""",
    doubles="variance_pct",
)
def variance_analysis(spark, sf):
    return C.variance(
        M.evaluate(src.trips(spark, sf), ["ets_cost_eur"], by=["VIN"]), "ets_cost_eur"
    )


@query(
    "efficiency_metrics",
    """SELECT "year", c AS ets_cost_eur, c / fleet AS per_vehicle, c / (km / 100) AS per_100km,
              c / n AS per_trip, c / days AS per_day, c / months AS per_month
       FROM (SELECT CAST(year(TripDate) AS BIGINT) AS "year", sum(Fuel_l) * 2.68 / 1000 * 85 AS c,
                    count(DISTINCT VIN) AS fleet, sum(Distance_km) AS km, count(*) AS n,
                    datediff('day', min(StartTimeUTC), max(StartTimeUTC)) AS days,
                    datediff('month', min(StartTimeUTC), max(StartTimeUTC)) AS months
             FROM trips GROUP BY 1)""",
)
def efficiency_metrics(spark, sf):
    rows = M.evaluate(
        src.trips(spark, sf),
        ["ets_cost_eur", *C.UNITS],
        by=[F.year("TripDate").alias("year")],
    )
    return C.per_unit(rows, "ets_cost_eur")


@query(
    "threshold_bands",
    """SELECT VIN, v AS compliance_rate, CASE WHEN v >= 0.8 THEN v END AS green,
              CASE WHEN v >= CAST(0.8 AS DOUBLE) * CAST(0.8 AS DOUBLE) AND v < 0.8 THEN v END AS yellow,
              CASE WHEN v < CAST(0.8 AS DOUBLE) * CAST(0.8 AS DOUBLE) THEN v END AS red
       FROM (SELECT VIN, CASE WHEN eff <= 28 THEN CAST(1 AS DOUBLE) ELSE CAST(28 AS DOUBLE) / eff END AS v
             FROM (SELECT VIN, sum(Fuel_l) / (sum(Distance_km) / 100) AS eff FROM trips GROUP BY VIN))""",
)
def threshold_bands(spark, sf):
    rates = M.evaluate(src.trips(spark, sf), ["compliance_rate"], by=["VIN"])
    return C.bands(rates, "compliance_rate", 0.8)


@query(
    "per_vehicle_stats",
    """SELECT sum(v) AS sum, avg(v) AS average, min(v) AS minimum, max(v) AS maximum,
              median(v) AS median, stddev_pop(v) AS std_dev
       FROM (SELECT VIN, sum(Fuel_l) AS v FROM trips GROUP BY VIN)""",
    doubles="std_dev",
)
def per_vehicle_stats(spark, sf):
    """Aggregates over the vehicles' fuel; the median is exact and distributed."""
    return C.over_groups(
        M.evaluate(src.trips(spark, sf), ["total_fuel_l"], by=["VIN"]), "total_fuel_l"
    )


@query(
    "scenario_measures",
    """SELECT "year", CapEx_EUR, OpEx_EUR, CO2_Reduction_t, ETS_Savings_EUR, NPV_EUR, VehiclesReplaced,
              ROI_Percent, Payback_Years FROM scenario_run WHERE ScenarioID = 'B'""",
    doubles="NPV_EUR ROI_Percent",
)
def scenario_measures(spark, sf):
    """The measures of the selected scenario per year."""
    return scenarios.selected(yearly_scenarios(spark, sf), W.DEFAULT_SCENARIO, by=["year"])


@query(
    "display_strings",
    """SELECT strftime(month, '%Y-%m') AS month, format('{:,.1f} t', l * 2.68 / 1000) AS co2_display,
              format('€{:,.0f}', l * 2.68 / 1000 * 85) AS ets_cost_display,
              format('{:,.1f} L/100km', l / (km / 100)) AS efficiency_display
       FROM (SELECT date_trunc('month', TripDate) AS month, sum(Fuel_l) AS l, sum(Distance_km) AS km
             FROM trips GROUP BY ALL)""",
)
def display_strings(spark, sf):
    rows = M.evaluate(
        src.trips(spark, sf),
        ["co2_t", "ets_cost_eur", "efficiency_l_100km"],
        by=[month_start("TripDate").alias("month")],
    )
    return rows.select(
        display.month_text("month").alias("month"),
        display.tonnes_text(F.col("co2_t")).alias("co2_display"),
        display.euro_text(F.col("ets_cost_eur")).alias("ets_cost_display"),
        display.efficiency_text(F.col("efficiency_l_100km")).alias("efficiency_display"),
    )


@query(
    "roi_color",
    """SELECT "year", ScenarioID, ROI_Percent, format('{:,.1f}%', ROI_Percent) AS roi_display,
              format('{:,.1f} years', Payback_Years) AS payback_display,
              CASE WHEN ROI_Percent >= 20 THEN '#00B050' WHEN ROI_Percent >= 10 THEN '#FFC000'
                   WHEN ROI_Percent >= 0 THEN '#FF6600' ELSE '#FF0000' END AS color FROM scenario_run""",
    doubles="ROI_Percent",
)
def roi_color(spark, sf):
    return yearly_scenarios(spark, sf).select(
        "year",
        "ScenarioID",
        "ROI_Percent",
        display.percent_text(F.col("ROI_Percent")).alias("roi_display"),
        display.years_text(F.col("Payback_Years")).alias("payback_display"),
        display.roi_color(F.col("ROI_Percent")).alias("color"),
    )
