"""Scenario finance and replacement planning."""

from pyspark.sql import functions as F

from ..functions.finance import level_cash_flows, npv, payback_years, roi_percent
from ..functions.ratios import co2_t
from ..operators.merge import merge
from ..plans import measures as M
from ..plans import pricing, scenarios
from ..sources import testdata as src
from .registry import MEAN_PRICE, query

#: years that are planned in any case; those of the trips are added
HORIZON = (2023, 2032)


def yearly_baseline(spark, sf):
    """Fleet figures per calendar year, the default fleet in years without trips."""
    found = scenarios.baseline(
        src.trips(spark, sf), by=[F.year("TripDate").cast("bigint").alias("year")]
    )
    # one row per year on either side
    return scenarios.or_default(with_horizon(spark, found))


def with_horizon(spark, found):
    """The rows of ``found`` per year, and a row without figures for each other planned year."""
    planned = spark.range(HORIZON[0], HORIZON[1] + 1).select(F.col("id").alias("year"))
    return planned.join(found, "year", "full_outer")


def yearly_scenarios(spark, sf):
    return scenarios.evaluate(yearly_baseline(spark, sf), by=["year"])


SCENARIO_DOUBLES = "NPV_EUR ROI_Percent"


@query(
    "fleet_baseline",
    """SELECT CAST(count(DISTINCT VIN) AS DOUBLE) AS fleet_size, sum(Distance_km) AS distance_km,
              sum(Fuel_l) AS fuel_l, sum(Fuel_l) * 2.68 / 1000 AS co2_t,
              sum(Distance_km) / count(DISTINCT VIN) AS km_per_vehicle,
              sum(Fuel_l) / count(DISTINCT VIN) AS fuel_per_vehicle,
              sum(Fuel_l) / sum(Distance_km) * 100 AS efficiency_l_100km FROM trips""",
)
def fleet_baseline(spark, sf):
    return scenarios.baseline(src.trips(spark, sf))


@query(
    "scenarios_from_baseline",
    'SELECT * FROM scenario_run WHERE "year" IN (SELECT "year" FROM baseline_year)',
    doubles=SCENARIO_DOUBLES,
)
def scenarios_from_baseline(spark, sf):
    """Scenarios A, B and C for each year's fleet."""
    fleet = scenarios.baseline(
        src.trips(spark, sf), by=[F.year("TripDate").cast("bigint").alias("year")]
    )
    return scenarios.evaluate(fleet, by=["year"])


@query(
    "scenarios_default_baseline", "SELECT * FROM scenario_run", doubles=SCENARIO_DOUBLES
)
def scenarios_default_baseline(spark, sf):
    """Scenarios per calendar year, with the default fleet where a year has no trips."""
    return yearly_scenarios(spark, sf)


@query(
    "scenarios_simple",
    """SELECT PriceMonth, EUR_per_t, ScenarioID, ScenarioName, CAST(60 AS BIGINT) AS TimeHorizon_months,
              CAST(n AS BIGINT) AS VehiclesReplaced, CAST(capex AS DOUBLE) AS CapEx_EUR, opex * 5 AS OpEx_EUR, co2 * 5 AS CO2_Reduction_t,
              co2 * EUR_per_t * 5 AS ETS_Savings_EUR, round(value, 2) AS NPV_EUR,
              round(value / capex * 100, 1) AS ROI_Percent,
              round(capex / (opex + co2 * EUR_per_t), 1) AS Payback_Years
       FROM (SELECT *, (opex + co2 * EUR_per_t) * (1/1.08 + 1/pow(1.08, 2) + 1/pow(1.08, 3)
                        + 1/pow(1.08, 4) + 1/pow(1.08, 5)) - capex AS value
             FROM (SELECT *, n * unit AS capex, n * 15000 * CAST(oc AS DOUBLE) AS opex,
                          n * 21 * CAST(cc AS DOUBLE) AS co2
                   FROM price_curve, (VALUES
                    ('A', 'Conservative Replacement', 10, 180000, 0.15, 0.85),
                    ('B', 'Aggressive Electrification', 25, 160000, 0.22, 0.88),
                    ('C', 'Hybrid Approach', 15, 140000, 0.18, 0.75))
                    v(ScenarioID, ScenarioName, n, unit, oc, cc)))""",
    doubles="OpEx_EUR CO2_Reduction_t ETS_Savings_EUR NPV_EUR ROI_Percent Payback_Years",
)
def scenarios_simple(spark, sf):
    """The sample model at every month's price."""
    curve = src.price_curve(spark, sf).select("PriceMonth", "EUR_per_t")
    return scenarios.simple(curve, F.col("EUR_per_t"))


@query(
    "scenario_cash_flow",
    """SELECT s."year" AS base_year, ScenarioID, CAST(y AS BIGINT) AS "year",
              (OpEx_EUR + ETS_Savings_EUR) / 5 * y - CapEx_EUR AS cumulative_eur
       FROM scenario_run s, range(1, 6) t(y)""",
)
def scenario_cash_flow(spark, sf):
    rows = yearly_scenarios(spark, sf).withColumnRenamed("year", "base_year")
    return scenarios.cash_flow(rows, by=["base_year"])


@query(
    "scenario_comparison",
    """SELECT "year", ScenarioName AS scenario, VehiclesReplaced AS vehicles,
              CapEx_EUR AS investment_eur, NPV_EUR AS net_value_eur, ROI_Percent AS roi_percent,
              Payback_Years AS payback_years FROM scenario_run""",
    doubles="net_value_eur roi_percent",
)
def scenario_comparison(spark, sf):
    return yearly_scenarios(spark, sf).select(
        "year",
        F.col("ScenarioName").alias("scenario"),
        F.col("VehiclesReplaced").alias("vehicles"),
        F.col("CapEx_EUR").alias("investment_eur"),
        F.col("NPV_EUR").alias("net_value_eur"),
        F.col("ROI_Percent").alias("roi_percent"),
        F.col("Payback_Years").alias("payback_years"),
    )


@query(
    "max_savings_potential",
    """SELECT b."year", least(best, annual * 0.8) AS max_savings_eur
       FROM (SELECT "year", max(ETS_Savings_EUR) AS best FROM scenario_run GROUP BY ALL) s
       JOIN (SELECT CAST(year(TripDate) AS BIGINT) AS "year", sum(Fuel_l) * 2.68 / 1000
               / datediff('day', min(StartTimeUTC), max(StartTimeUTC)) * 365 * 85 AS annual
             FROM trips GROUP BY 1) b ON b."year" = s."year" """,
)
def max_savings_potential(spark, sf):
    """The best scenario's saving, at most 80 % of the projected annual cost."""
    best = yearly_scenarios(spark, sf).groupBy("year").agg(
        F.max("ETS_Savings_EUR").alias("best")
    )
    annual = M.evaluate(
        src.trips(spark, sf),
        ["annual_ets_cost_eur"],
        by=[F.year("TripDate").cast("bigint").alias("year")],
    )
    return annual.join(best, "year").select(
        "year",
        F.least(F.col("best"), F.col("annual_ets_cost_eur") * 0.8).alias("max_savings_eur"),
    )


@query(
    "merge_upsert_scenarios",
    """SELECT ScenarioID, "year", NPV_EUR, CapEx_EUR FROM scenario_run s
       WHERE "year" = (SELECT max("year") FROM baseline_year)""",
    doubles="NPV_EUR",
)
def merge_upsert_scenarios(spark, sf):
    """One row per scenario: each year's run replaces the one before."""
    runs = scenarios_from_baseline(spark, sf).select(
        "ScenarioID", "year", "NPV_EUR", "CapEx_EUR"
    )
    middle = runs.agg(F.floor(F.avg("year"))).first()[0]
    first = runs.where(F.col("year") <= middle)
    later = runs.where(F.col("year") > middle)
    return merge(merge(first.limit(0), first, ["ScenarioID"], ["year"]), later,
                 ["ScenarioID"], ["year"])


def vehicle_year_cost(spark, sf):
    """Fuel and emission cost per vehicle and year."""
    return src.trips(spark, sf).groupBy(
        "VIN", F.year("TripDate").alias("year")
    ).agg(
        (F.sum("Fuel_l") * 1.45 + co2_t(F.sum("Fuel_l")) * 85).alias("cost")
    )


@query(
    "npv_cashflows",
    """SELECT VIN, count(*) AS years,
              sum((litres * 1.45 + litres * 2.68 / 1000 * 85) / pow(1.08, rn - 1)) AS npv_eur
       FROM (SELECT *, row_number() OVER (PARTITION BY VIN ORDER BY y) AS rn FROM (
             SELECT VIN, year(TripDate) AS y, sum(Fuel_l) AS litres FROM trips GROUP BY ALL))
       GROUP BY VIN""",
    doubles="npv_eur",
)
def npv_cashflows(spark, sf):
    """Present value of each vehicle's yearly running cost; a list holds one entry per year."""
    flows = vehicle_year_cost(spark, sf).groupBy("VIN").agg(
        F.sort_array(F.collect_list(F.struct("year", "cost"))).alias("flows")
    )
    return flows.select(
        "VIN",
        F.size("flows").alias("years"),
        npv(F.transform("flows", lambda f: f["cost"])).alias("npv_eur"),
    )


SAVING_SQL = """(SELECT VIN, sum(Fuel_l) * 0.85 * 1.45 + 2500 + sum(Fuel_l) * 2.68 / 1000 * 0.85 * 85 AS saved
                 FROM trips GROUP BY VIN)"""


def electric_saving(spark, sf):
    """Yearly saving of replacing a vehicle by an electric one (conservative scenario)."""
    litres = F.col("fuel_l")
    return src.trips(spark, sf).groupBy("VIN").agg(F.sum("Fuel_l").alias("fuel_l")).select(
        "VIN",
        (litres * 0.85 * 1.45 + 2500 + co2_t(litres) * 0.85 * 85).alias("saved"),
    )


@query(
    "payback_period",
    f"SELECT VIN, CASE WHEN saved > 0 THEN 180000 / saved ELSE 999 END AS payback_years FROM {SAVING_SQL}",
    doubles="payback_years",
)
def payback_period(spark, sf):
    return electric_saving(spark, sf).select(
        "VIN", payback_years(F.lit(180000.0), F.col("saved")).alias("payback_years")
    )


@query(
    "roi_percent",
    f"""SELECT VIN, (saved * (1/1.08 + 1/pow(1.08, 2) + 1/pow(1.08, 3) + 1/pow(1.08, 4) + 1/pow(1.08, 5))
               - 180000) / 180000 * 100 AS roi_percent FROM {SAVING_SQL}""",
    doubles="roi_percent",
)
def roi_percent_by_vehicle(spark, sf):
    value = npv(level_cash_flows(F.lit(180000.0), F.col("saved"), 5))
    return electric_saving(spark, sf).select(
        "VIN", roi_percent(value, F.lit(180000.0)).alias("roi_percent")
    )


@query("price_curve_build", "SELECT PriceMonth, EUR_per_t, PriceSource FROM price_curve")
def price_curve_build(spark, sf):
    """The curve: trend, season and the month's last quote."""
    return src.price_curve(spark, sf)


@query(
    "avg_price_or_default",
    f"""SELECT y AS "year", coalesce({MEAN_PRICE}, 85) AS avg_price
       FROM (SELECT unnest(generate_series(2023, 2032)) AS y UNION SELECT year(PriceMonth) FROM price_curve)
       LEFT JOIN price_curve ON year(PriceMonth) = y GROUP BY ALL""",
)
def avg_price_or_default(spark, sf):
    """Mean price of each year of the horizon, the default outside the curve."""
    found = src.price_curve(spark, sf).groupBy(
        F.year("PriceMonth").cast("bigint").alias("year")
    ).agg(pricing.mean_price().alias("p"))
    return with_horizon(spark, found).select(
        "year", F.coalesce("p", F.lit(85.0)).alias("avg_price")
    )


@query(
    "invoices_build",
    """SELECT VIN, InvoiceMonth, litres AS Litres,
              litres * 1.45 * (1 + 0.1 * sin(2 * pi() * month(InvoiceMonth) / 12)) AS EUR_Amount
       FROM vehicle_month""",
    doubles="EUR_Amount",
)
def invoices_build(spark, sf):
    """Invoices with the seasonal fuel price."""
    monthly = src.vehicle_month_litres(src.trips(spark, sf))
    return pricing.seasonal_invoices(monthly)

