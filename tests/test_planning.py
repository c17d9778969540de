"""Replacement planning on a small fleet against plain arithmetic."""

import itertools

import pytest
from pyspark.sql import functions as F

from carbonhaul.plans import lagrangian as L
from carbonhaul.plans import replacement as R
from carbonhaul.session import scratch_path
from carbonhaul.sources.tables import TableStore

PRICE = 100.0


def fleet(spark, n=60):
    return spark.range(n).select(
        F.format_string("V%03d", "id").alias("VIN"),
        (F.lit(100000.0) + F.col("id") * 10000).alias("distance_km"),
        (F.lit(30000.0) + F.col("id") * 3000).alias("fuel_l"),
        (3 + F.col("id") % 10).cast("double").alias("age"),
        F.lit(PRICE).alias("price"),
    )


def weight(month):
    return 1.08 ** -(month // 12)


def new_month(km, option):
    return km / 12 * (option["fuel_cost_per_km"] + option["co2_emissions_per_km"] / 1000 * PRICE)


def test_cost_matrix_and_best_option(spark):
    vehicles = fleet(spark, 3)
    rows = {(r["VIN"], r["option"], r["month"]): r["total"]
            for r in R.cost_matrix(vehicles).collect()}
    assert len(rows) == 3 * 3 * 60
    for i in range(3):
        km = 100000 + 10000 * i
        for option in R.OPTIONS:
            for month in (0, 11, 12, 59):
                want = (option["acquisition_cost"] + new_month(km, option)) * weight(month)
                assert rows[f"V{i:03d}", option["type"], month] == pytest.approx(want)
    best = {r["VIN"]: (r["option"], r["month"], r["total"]) for r in
            R.best_option(vehicles).collect()}
    for vin, (option, month, total) in best.items():
        own = {k[1:]: v for k, v in rows.items() if k[0] == vin}
        assert total == pytest.approx(min(own.values()))
        assert own[option, month] == pytest.approx(total)


def test_running_cost_to_the_end(spark):
    row = R.cost_matrix(fleet(spark, 1), charge_after=True).where(
        "month = 13 AND option = 'HYBRID_TRUCK'"
    ).first()
    option = R.OPTIONS[1]
    running = new_month(100000, option) * sum(weight(m) for m in range(13, 60))
    assert row["total"] == pytest.approx(option["acquisition_cost"] * weight(13) + running)


def test_schedules_and_rules(spark):
    vehicles = fleet(spark)
    heuristic = R.heuristic_schedule(vehicles).collect()
    assert [r["ReplacementMonth"] for r in heuristic] == [6 * i for i in range(10)]
    assert [r["Year"] for r in heuristic] == [6 * i // 12 + 1 for i in range(10)]
    assert [r["VIN"] for r in heuristic[:6]] == [f"V{9 + 10 * i:03d}" for i in range(6)]

    greedy = R.greedy_schedule(vehicles)
    rows = greedy.collect()
    used = {r["ReplacementType"] for r in rows}
    spent = sum(r["Cost"] for r in rows) + sum(
        o["infrastructure_cost"] for o in R.OPTIONS if o["type"] in used
    )
    assert spent <= R.BUDGET_EUR
    found = {r["rule"]: r["violations"] for r in R.violations(greedy, vehicles).collect()}
    assert set(found.values()) == {0}


def test_broken_schedule_is_reported(spark):
    vehicles = fleet(spark)
    bad = vehicles.limit(0).select("VIN").unionByName(
        spark.createDataFrame([(f"V{i:03d}",) for i in range(40)] + [("V001",)], "VIN string")
    ).select(
        "VIN",
        F.lit(30).cast("bigint").alias("ReplacementMonth"),
        F.lit("ELECTRIC_TRUCK").alias("ReplacementType"),
        F.lit(180000.0).alias("Cost"),
    )
    found = {r["rule"]: r["violations"] for r in R.violations(bad, vehicles).collect()}
    assert found == {
        "max_one_replacement": 1, "capacity_per_month": 1, "budget": 1,
        # ages 10, 11 and 12: three of every ten vehicles, none in time
        "force_replacement": 18, "availability": 0, "min_fleet": 0,
    }


def test_objective(spark):
    vehicles = fleet(spark, 2)
    schedule = spark.createDataFrame(
        [("V000", 14, "ELECTRIC_TRUCK", 180000.0)],
        "VIN string, ReplacementMonth bigint, ReplacementType string, Cost double",
    )
    got = R.objective(schedule, vehicles).first()
    electric = R.OPTIONS[0]

    def keep(i, last):
        km, litres = 100000 + 10000 * i, 30000 + 3000 * i
        month = km / 12 * 0.25 + litres / 12 * 2.68 / 1000 * PRICE
        return month * sum(weight(m) for m in range(last + 1))

    want = (
        180000 * weight(14) + 50000 + keep(0, 13) + keep(1, 59)
        + new_month(100000, electric) * weight(14)
    )
    assert got["total"] == pytest.approx(want)


def equal_fleet(spark, n, age=11.0, km=100000.0):
    return spark.range(n).select(
        F.format_string("V%03d", "id").alias("VIN"), F.lit(km).alias("distance_km"),
        F.lit(km * 0.3).alias("fuel_l"), F.lit(age).alias("age"), F.lit(PRICE).alias("price"),
    )


def breaches(schedule, vehicles):
    return {r["rule"]: r["violations"] for r in R.violations(schedule, vehicles).collect()}


def test_all_vehicles_due_by_age_are_served_where_that_is_possible(spark):
    # 45 vehicles: the cheapest truck pays for all, any other does not
    vehicles = equal_fleet(spark, 45)
    schedule, found = L.plan(vehicles)
    assert set(breaches(schedule, vehicles).values()) == {0}
    row = L.status(schedule, vehicles, found).first()
    assert (row["status"], row["forced"], row["forced_missed"], row["replaced"]) == ("FEASIBLE", 45, 0, 45)
    value = R.objective(schedule, vehicles).first()["total"]
    assert row["lower_bound"] <= value < R.objective(R.greedy_schedule(vehicles), vehicles).first()["total"]


def test_what_no_schedule_can_serve_is_counted(spark):
    vehicles = equal_fleet(spark, 60)
    schedule, found = L.plan(vehicles)
    row = L.status(schedule, vehicles, found).first()
    assert (row["status"], row["forced_missed"], row["forced_unavoidable"]) == ("INFEASIBLE", 10, 10)
    assert breaches(schedule, vehicles) == {
        "max_one_replacement": 0, "capacity_per_month": 0, "budget": 0, "force_replacement": 10,
        "availability": 0, "min_fleet": 0,
    }


def test_equal_vehicles_at_the_margin_use_the_budget(spark):
    vehicles = equal_fleet(spark, 200, age=3.0, km=2000000.0)
    schedule, found = L.plan(vehicles)
    spent = schedule.agg(F.sum("Cost")).first()[0]
    assert R.BUDGET_EUR - 180000 < spent <= R.BUDGET_EUR
    assert set(breaches(schedule, vehicles).values()) == {0}


def test_prices_against_all_schedules_of_a_small_fleet(spark):
    """Every assignment of keep, option and month for three vehicles and a small budget."""
    vehicles = fleet(spark, 3).withColumn("age", F.lit(3.0))
    limits = L.Limits(budget=300000.0, per_month=1)
    rows = {r["VIN"]: r for r in L.candidates(vehicles, limits).collect()}
    weights, kept = L.WEIGHTS, [sum(L.WEIGHTS[: max(m, 1)]) for m in range(60)]

    def choices(i):
        km, litres = 100000 + 10000 * i, 30000 + 3000 * i
        month = km / 12 * 0.25 + litres / 12 * 2.68 / 1000 * PRICE
        assert rows[f"V{i:03d}"]["keep"] == pytest.approx(month * sum(weights), abs=1e-3)
        yield month * sum(weights), 0, None, None
        for k, o in enumerate(R.OPTIONS):
            for m in (0, 1, 2, 12, 13, 24, 59):
                cost = (o["acquisition_cost"] + new_month(km, o)) * weights[m] + month * kept[m]
                yield cost, o["acquisition_cost"], k, m

    best = min(
        sum(c[0] for c in plan) + sum(R.OPTIONS[k]["infrastructure_cost"] for k in {c[2] for c in plan} - {None})
        for plan in itertools.product(*(list(choices(i)) for i in range(3)))
        if sum(c[1] for c in plan)
        + sum(R.OPTIONS[k]["infrastructure_cost"] for k in {c[2] for c in plan} - {None}) <= 300000
        and len({c[3] for c in plan if c[3] is not None}) == sum(c[3] is not None for c in plan)
    )
    schedule, found = L.plan(vehicles, limits)
    value = R.objective(schedule, vehicles).first()["total"]
    assert found.lower_bound <= best + 1e-6 and best - 1e-6 <= value <= best * 1.02
    assert schedule.groupBy("ReplacementMonth").count().where("count > 1").isEmpty()


def test_months_are_filled_before_the_deadline(spark):
    picked = spark.createDataFrame(
        [(f"F{i}", True, float(i), 2, 23, 1.0, 0.0) for i in range(12)]
        + [(f"N{i}", False, float(i), 2, 22, 1.0, 0.0) for i in range(7)],
        "VIN string, forced boolean, month_cost double, option int, desired int, Cost double, value double",
    )
    rows = L.with_months(picked).collect()
    months = {}
    for r in rows:
        months.setdefault(r["ReplacementMonth"], []).append(r["VIN"])
        assert r["VIN"][0] == "N" or r["ReplacementMonth"] < 24
    assert len(rows) == 19 and max(map(len, months.values())) <= 5


def test_retired_vehicles_shrink_the_fleet(spark):
    vehicles = fleet(spark, 20)
    schedule = spark.createDataFrame(
        [(f"V{i:03d}", 7, None, 0.0) for i in range(3)] + [("V010", 0, "HYBRID_TRUCK", 140000.0)],
        "VIN string, ReplacementMonth bigint, ReplacementType string, Cost double",
    )
    active = {r["month"]: r["active"] for r in R.active_fleet(schedule, vehicles).collect()}
    # the successor comes in the first month, in which the old vehicle still runs
    assert [active[m] for m in (0, 1, 6, 7, 59)] == [21, 20, 20, 17, 17]
    assert breaches(schedule, vehicles)["min_fleet"] == 53


def test_planning_job_writes_its_result(spark):
    store = TableStore(spark, scratch_path(spark, "planning"))
    price = spark.createDataFrame([(PRICE,)], "price double")
    _, status = L.save_results(store, equal_fleet(spark, 45), price)
    row = store.read("OptimizationResults").first()
    assert (row["OptimizationMethod"], row["VehiclesReplaced"], row["CapEx_EUR"]) == ("LAGRANGIAN", 45, 5400000.0)
    assert status.first()["status"] == "FEASIBLE"
    # a fleet that cannot be served: the heuristic takes its place
    L.save_results(store, equal_fleet(spark, 60), price)
    rows = store.read("OptimizationResults").collect()
    assert [(r["OptimizationMethod"], r["VehiclesReplaced"]) for r in rows] == [("HEURISTIC", 10)]
