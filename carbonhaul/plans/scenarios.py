"""Electrification scenarios and their finance."""

from pyspark.sql import functions as F

from ..constants import (
    DEFAULT_ETS_EUR_PER_T,
    DEFAULT_FUEL_EUR_PER_L,
    HORIZON_MONTHS,
    HORIZON_YEARS,
)
from ..functions.finance import level_cash_flows, npv, payback_years, roi_percent
from ..functions.ratios import co2_t, divide

# The three scenarios. Every vehicle class holds (share of the replaced vehicles,
# unit cost, part of the fuel saved, maintenance saved per year); the last class takes the rest.
SCENARIOS = (
    dict(
        ScenarioID="A", ScenarioName="Conservative Replacement", cap=10, share=0.25,
        infrastructure=50000, classes=((1.0, 180000, 0.85, 2500),),
        Risk_Level="LOW", Implementation_Complexity="SIMPLE",
    ),
    dict(
        ScenarioID="B", ScenarioName="Aggressive Electrification", cap=25, share=0.62,
        infrastructure=120000, classes=((1.0, 160000, 0.88, 3000),),
        Risk_Level="HIGH", Implementation_Complexity="COMPLEX",
    ),
    dict(
        ScenarioID="C", ScenarioName="Hybrid Approach", cap=15, share=0.37,
        infrastructure=75000, classes=((0.6, 170000, 0.85, 2750), (0.4, 140000, 0.35, 1500)),
        Risk_Level="MEDIUM", Implementation_Complexity="MODERATE",
    ),
)

# The sample model (vehicles, unit cost, running cost and emission reduction)
SIMPLE_SCENARIOS = (
    dict(ScenarioID="A", ScenarioName="Conservative Replacement", vehicles=10, unit=180000,
         opex_cut=0.15, co2_cut=0.85),
    dict(ScenarioID="B", ScenarioName="Aggressive Electrification", vehicles=25, unit=160000,
         opex_cut=0.22, co2_cut=0.88),
    dict(ScenarioID="C", ScenarioName="Hybrid Approach", vehicles=15, unit=140000,
         opex_cut=0.18, co2_cut=0.75),
)
SIMPLE_OPEX_EUR = 15000
SIMPLE_CO2_T = 21

# The fleet assumed where there are no trips
DEFAULT_BASELINE = dict(
    fleet_size=40.0, distance_km=800000.0, fuel_l=240000.0, co2_t=643.2,
    km_per_vehicle=20000.0, fuel_per_vehicle=6000.0, efficiency_l_100km=30.0,
)


def baseline(trips, by=()):
    """Fleet totals and per-vehicle means; the sums count as one year's figures.

    An empty selection yields the default fleet. (Without a grouping an aggregate always has a
    row; with one, join the wanted groups and use :func:`or_default`.)
    """
    km, litres, vehicles = F.col("distance_km"), F.col("fuel_l"), F.col("fleet_size")
    sums = trips.groupBy(*by).agg(
        F.count_distinct("VIN").cast("double").alias("fleet_size"),
        F.coalesce(F.sum("Distance_km"), F.lit(0.0)).alias("distance_km"),
        F.coalesce(F.sum("Fuel_l"), F.lit(0.0)).alias("fuel_l"),
    )
    derived = sums.select(
        "*",
        co2_t(litres).alias("co2_t"),
        divide(km, vehicles).alias("km_per_vehicle"),
        divide(litres, vehicles).alias("fuel_per_vehicle"),
        F.when(km > 0, litres / km * 100).otherwise(30.0).alias("efficiency_l_100km"),
    )
    return derived if by else or_default(derived)


def or_default(df):
    """Replace the figures of rows without a fleet by the default fleet's."""
    missing = F.coalesce(F.col("fleet_size"), F.lit(0.0)) == 0
    return df.select(
        *[c for c in df.columns if c not in DEFAULT_BASELINE],
        *[F.when(missing, value).otherwise(F.col(c)).alias(c)
          for c, value in DEFAULT_BASELINE.items()],
    )


def _settings(rows):
    """Scenario settings as a literal array of structs; adds no join."""
    return F.array(
        *[F.struct(*[_literal(v).alias(k) for k, v in row.items()]) for row in rows]
    )


def _literal(value):
    if isinstance(value, tuple):
        return F.array(
            *[F.struct(*[F.lit(float(x)).alias(n)
                         for n, x in zip(("part", "unit", "fuel", "upkeep"), c)])
              for c in value]
        )
    return F.lit(float(value)) if isinstance(value, (int, float)) else F.lit(value)


def evaluate(fleet, by=()):
    """The three scenarios for every row of ``fleet`` (see :func:`baseline`).

    Vehicle numbers truncate; the classes of a scenario share them in order, the last one
    takes what is left.
    """
    by = list(by)
    rows = fleet.select(*by, "fleet_size", "fuel_per_vehicle",
                        F.explode(_settings(SCENARIOS)).alias("s"))
    replaced = F.least(F.col("s.cap"), F.floor(F.col("fleet_size") * F.col("s.share")))
    rows = rows.select("*", replaced.alias("n"))
    first = F.floor(F.col("n") * F.col("s.classes")[0]["part"])
    rows = rows.withColumn("n_first", first)

    def over_classes(per_vehicle):
        """Sum over the classes of vehicles x figure per vehicle."""
        return F.aggregate(
            F.transform(
                "s.classes",
                lambda c, i: F.when(i == 0, F.col("n_first"))
                .otherwise(F.col("n") - F.col("n_first")) * per_vehicle(c),
            ),
            F.lit(0.0),
            lambda total, x: total + x,
        )

    fuel = F.col("fuel_per_vehicle")
    rows = rows.select(
        "*",
        (over_classes(lambda c: c["unit"]) + F.col("s.infrastructure")).alias("capex"),
        over_classes(lambda c: fuel * c["fuel"] * DEFAULT_FUEL_EUR_PER_L).alias("fuel_saved"),
        over_classes(lambda c: c["upkeep"]).alias("upkeep_saved"),
        over_classes(lambda c: co2_t(fuel) * c["fuel"]).alias("co2_saved"),
    )
    rows = rows.withColumn("ets_saved", F.col("co2_saved") * DEFAULT_ETS_EUR_PER_T)
    rows = rows.withColumn(
        "saved", F.col("fuel_saved") + F.col("upkeep_saved") + F.col("ets_saved")
    )
    rows = rows.withColumn(
        "npv", npv(level_cash_flows(F.col("capex"), F.col("saved"), HORIZON_YEARS))
    )
    years = HORIZON_YEARS
    return rows.select(
        *by,
        F.col("s.ScenarioID").alias("ScenarioID"),
        F.col("s.ScenarioName").alias("ScenarioName"),
        F.lit(HORIZON_MONTHS).alias("TimeHorizon_months"),
        F.col("n").cast("int").alias("VehiclesReplaced"),
        F.col("n_first").cast("int").alias("ElectricVehicles"),
        (F.col("n") - F.col("n_first")).cast("int").alias("HybridVehicles"),
        F.col("capex").alias("CapEx_EUR"),
        (F.col("upkeep_saved") * years).alias("OpEx_EUR"),
        (F.col("co2_saved") * years).alias("CO2_Reduction_t"),
        (F.col("ets_saved") * years).alias("ETS_Savings_EUR"),
        (F.col("fuel_saved") * years).alias("FuelSavings_EUR"),
        (F.col("saved") * years).alias("TotalSavings_EUR"),
        F.col("npv").alias("NPV_EUR"),
        roi_percent(F.col("npv"), F.col("capex")).alias("ROI_Percent"),
        payback_years(F.col("capex"), F.col("saved")).alias("Payback_Years"),
        F.col("s.Risk_Level").alias("Risk_Level"),
        F.col("s.Implementation_Complexity").alias("Implementation_Complexity"),
    )


def simple(prices, price):
    """The sample model for every row of ``prices``; ``price`` is its allowance price column."""
    years = HORIZON_YEARS
    rows = prices.select("*", F.explode(_settings(SIMPLE_SCENARIOS)).alias("s"))
    n = F.col("s.vehicles")
    rows = rows.select(
        "*",
        (n * F.col("s.unit")).alias("capex"),
        (n * SIMPLE_OPEX_EUR * F.col("s.opex_cut")).alias("opex"),
        (n * SIMPLE_CO2_T * F.col("s.co2_cut")).alias("co2"),
    )
    rows = rows.withColumn("ets", F.col("co2") * price)
    rows = rows.withColumn("saved", F.col("opex") + F.col("ets"))
    rows = rows.withColumn("npv", npv(level_cash_flows(F.col("capex"), F.col("saved"), years)))
    return rows.select(
        *prices.columns,
        F.col("s.ScenarioID").alias("ScenarioID"),
        F.col("s.ScenarioName").alias("ScenarioName"),
        F.lit(HORIZON_MONTHS).alias("TimeHorizon_months"),
        n.cast("int").alias("VehiclesReplaced"),
        F.col("capex").alias("CapEx_EUR"),
        (F.col("opex") * years).alias("OpEx_EUR"),
        (F.col("co2") * years).alias("CO2_Reduction_t"),
        (F.col("ets") * years).alias("ETS_Savings_EUR"),
        F.round("npv", 2).alias("NPV_EUR"),
        F.round(roi_percent(F.col("npv"), F.col("capex")), 1).alias("ROI_Percent"),
        F.round(payback_years(F.col("capex"), F.col("saved")), 1).alias("Payback_Years"),
    )


def selected(scenarios, scenario_id, by=()):
    """The measures of one scenario: amounts are summed, ROI and payback averaged."""
    chosen = scenarios.where(F.col("ScenarioID") == scenario_id)
    amounts = (
        "CapEx_EUR", "OpEx_EUR", "CO2_Reduction_t", "ETS_Savings_EUR", "NPV_EUR",
        "VehiclesReplaced",
    )
    return chosen.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in amounts],
        F.avg("ROI_Percent").alias("ROI_Percent"),
        F.avg("Payback_Years").alias("Payback_Years"),
    )


def cash_flow(scenarios, by=()):
    """Cumulative cash after each of five years."""
    yearly = (F.col("OpEx_EUR") + F.col("ETS_Savings_EUR")) / HORIZON_YEARS
    return scenarios.select(
        *by,
        "ScenarioID",
        "CapEx_EUR",
        yearly.alias("_yearly"),
        F.explode(F.sequence(F.lit(1), F.lit(HORIZON_YEARS))).alias("year"),
    ).select(
        *by,
        "ScenarioID",
        "year",
        (F.col("_yearly") * F.col("year") - F.col("CapEx_EUR")).alias("cumulative_eur"),
    )

