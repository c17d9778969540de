"""Published figures of the scenario models, and finance against plain arithmetic."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carbonhaul.functions.finance import level_cash_flows, npv, payback_years, roi_percent
from carbonhaul.plans import scenarios
from carbonhaul.schemas import TRIP_FACTS

SLOW = settings(
    max_examples=15, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)


def test_simple_model_golden(spark):
    price = spark.createDataFrame([(85.0,)], "p double")
    rows = {r["ScenarioID"]: r for r in scenarios.simple(price, F.col("p")).collect()}
    found = {
        k: (r["VehiclesReplaced"], r["CapEx_EUR"], r["OpEx_EUR"], r["CO2_Reduction_t"],
            r["ETS_Savings_EUR"], r["NPV_EUR"], r["ROI_Percent"], r["Payback_Years"])
        for k, r in rows.items()
    }
    expected = {
        "A": (10, 1800000, 112500, 892.5, 75862.5, -1649584.63, -91.6, 47.8),
        "B": (25, 4000000, 412500, 2310, 196350, -3513807.70, -87.8, 32.8),
        "C": (15, 2100000, 202500, 1181.25, 100406.25, -1858116.64, -88.5, 34.7),
    }
    for k, row in expected.items():
        assert found[k] == pytest.approx(row, abs=1e-6)


def test_default_fleet_golden(spark):
    empty = spark.createDataFrame([], TRIP_FACTS.schema)
    fleet = scenarios.baseline(empty)
    assert fleet.first()["fleet_size"] == 40.0
    rows = {r["ScenarioID"]: r for r in scenarios.evaluate(fleet).collect()}
    expected = {
        "A": (10, 1850000, -1408534.84, -76.137, 16.7318),
        "B": (24, 3960000, -2823631.54, -71.3038, 13.9137),
        "C": (14, 2275000, -1793501.05, -78.8352, 18.8649),
    }
    for k, (n, capex, value, roi, payback) in expected.items():
        r = rows[k]
        assert (r["VehiclesReplaced"], r["CapEx_EUR"]) == (n, capex)
        assert r["NPV_EUR"] == pytest.approx(value, abs=0.01)
        assert r["ROI_Percent"] == pytest.approx(roi, abs=1e-3)
        assert r["Payback_Years"] == pytest.approx(payback, abs=1e-4)
    assert (rows["C"]["ElectricVehicles"], rows["C"]["HybridVehicles"]) == (8, 6)


def test_annuity(spark):
    value = spark.range(1).select(npv(level_cash_flows(F.lit(0.0), F.lit(1.0), 5)))
    assert value.first()[0] == pytest.approx(3.992710037078085, rel=1e-14)


@SLOW
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=8))
def test_npv_is_the_discounted_sum(spark, flows):
    got = spark.createDataFrame([(flows,)], "f array<double>").select(npv(F.col("f"))).first()[0]
    assert got == pytest.approx(sum(f / 1.08**t for t, f in enumerate(flows)), abs=1e-6)


def test_edges(spark):
    row = spark.range(1).select(
        payback_years(F.lit(100.0), F.lit(0.0)),
        payback_years(F.lit(100.0), F.lit(50.0)),
        roi_percent(F.lit(10.0), F.lit(0.0)),
        roi_percent(F.lit(10.0), F.lit(40.0)),
    ).first()
    assert tuple(row) == (999.0, 2.0, 0.0, 25.0)
