"""Fleet replacement planning: cost terms, schedules, their rules and their value.

The cost model is linear in the choices (vehicle, option, month), so every term is a column
expression. Options and months are short literal arrays; expanding them needs no join, and choosing
among them needs no shuffle.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import (
    CO2_KG_PER_LITRE,
    DISCOUNT_RATE,
    HORIZON_MONTHS,
    HORIZON_YEARS,
)
from ..functions.finance import (
    discount_factor,
    level_cash_flows,
    npv,
    payback_years,
    roi_percent,
)

# Replacement options
OPTIONS = (
    dict(type="ELECTRIC_TRUCK", acquisition_cost=180000, annual_maintenance_cost=8000,
         fuel_cost_per_km=0.12, co2_emissions_per_km=0.05, max_range_km=300,
         charging_time_hours=1.5, infrastructure_cost=50000, availability_start_month=0),
    dict(type="HYBRID_TRUCK", acquisition_cost=140000, annual_maintenance_cost=9000,
         fuel_cost_per_km=0.18, co2_emissions_per_km=0.4, max_range_km=800,
         charging_time_hours=0, infrastructure_cost=15000, availability_start_month=0),
    dict(type="DIESEL_TRUCK_NEW", acquisition_cost=120000, annual_maintenance_cost=12000,
         fuel_cost_per_km=0.25, co2_emissions_per_km=0.67, max_range_km=1000,
         charging_time_hours=0, infrastructure_cost=0, availability_start_month=0),
)

# Limits of a schedule and running cost of the vehicles in use
BUDGET_EUR = 6000000
PER_MONTH = 5
FORCED_AGE = 10
FORCED_MONTHS = 24
MIN_FLEET_SHARE = 0.9
KEEP_EUR_PER_KM = 0.25
OLDEST = 10
MONTHS_APART = 6
SAVED_T_PER_YEAR = 18
SAVED_FUEL_EUR_PER_YEAR = 7500


def vehicle_stats(trips):
    """Totals per vehicle; the planning model reads them as yearly figures."""
    return trips.groupBy("VIN").agg(
        F.sum("Distance_km").alias("distance_km"),
        F.sum("Fuel_l").alias("fuel_l"),
        F.count("TripID").alias("trips"),
    )


def fleet(trips, age, price):
    """Vehicles with totals, age (a column expression) and the model's allowance price, a
    one-row frame that enters as a scalar."""
    return vehicle_stats(trips).select(
        "VIN", "distance_km", "fuel_l", age.alias("age"), price.scalar().alias("price")
    )


def options():
    """The options as an array of structs."""
    return F.array(
        *[
            F.struct(*[
                F.lit(v if isinstance(v, str) else float(v)).alias(k) for k, v in row.items()
            ])
            for row in OPTIONS
        ]
    )


def months():
    return F.sequence(F.lit(0), F.lit(HORIZON_MONTHS - 1))


def factor(month, rate=DISCOUNT_RATE):
    """Discount factor of a month's year."""
    return discount_factor(F.floor(month / 12), rate)


def remaining(month, rate=DISCOUNT_RATE):
    """Sum of the discount factors from a month to the end of the horizon."""
    weights, total = [], 0.0
    for m in reversed(range(HORIZON_MONTHS)):
        total += (1 + rate) ** -(m // 12)
        weights.append(total)
    return F.element_at(F.array(*[F.lit(w) for w in reversed(weights)]), (month + 1).cast("int"))


def year_of(month):
    return (F.floor(month / 12) + 1).cast("bigint")


def _new_month(option):
    """Undiscounted fuel and allowance cost of one month with a new vehicle."""
    km = F.col("distance_km") / 12
    return (
        km * option["fuel_cost_per_km"],
        km * option["co2_emissions_per_km"] / 1000 * F.col("price"),
    )


def _keep_month():
    """Undiscounted fuel and allowance cost of one month with the present vehicle."""
    return (
        F.col("distance_km") / 12 * KEEP_EUR_PER_KM,
        F.col("fuel_l") / 12 * CO2_KG_PER_LITRE / 1000 * F.col("price"),
    )


def cost_matrix(vehicles, charge_after=False):
    """Discounted cost of every (vehicle, option, month) choice.

    The new vehicle's running cost is charged for its first month, or with ``charge_after`` for
    every month to the end of the horizon.
    """
    rows = vehicles.select(
        "*", F.explode(options()).alias("o")
    ).select("*", F.explode(months()).alias("month"))
    option, weight = F.col("o"), factor(F.col("month"))
    running = remaining(F.col("month")) if charge_after else weight
    fuel, ets = _new_month(option)
    return rows.select(
        "VIN",
        option["type"].alias("option"),
        "month",
        (option["acquisition_cost"] * weight).alias("capex"),
        (fuel * running).alias("fuel_cost"),
        (ets * running).alias("ets_cost"),
    ).withColumn("total", F.col("capex") + F.col("fuel_cost") + F.col("ets_cost"))


def keep_cost(vehicles):
    """Discounted cost of keeping each vehicle in each month."""
    fuel, ets = _keep_month()
    rows = vehicles.select("*", F.explode(months()).alias("month"))
    return rows.select(
        "VIN", "month", ((fuel + ets) * factor(F.col("month"))).alias("keep_cost")
    )


def best_option(vehicles):
    """The cheapest choice per vehicle; ties go to the earlier month. Computed inside the row."""

    def price_of(option, month):
        fuel, ets = _new_month(option)
        return F.struct(
            ((option["acquisition_cost"] + fuel + ets) * factor(month)).alias("total"),
            month.alias("month"),
            option["type"].alias("option"),
        )

    choices = F.flatten(
        F.transform(options(), lambda o: F.transform(months(), lambda m: price_of(o, m)))
    )
    return vehicles.select("VIN", F.array_min(choices).alias("b")).select(
        "VIN", F.col("b.option").alias("option"), F.col("b.month").alias("month"),
        F.col("b.total").alias("total"),
    )


def heuristic_schedule(vehicles, count=OLDEST):
    """The oldest vehicles, electric, half a year apart. ``count`` rows reach the window."""
    electric = OPTIONS[0]
    oldest = vehicles.orderBy(F.col("age").desc(), "VIN").limit(count)
    position = F.row_number().over(Window.orderBy(F.col("age").desc(), "VIN"))
    month = (position - 1) * MONTHS_APART
    return oldest.select(
        "VIN",
        month.cast("bigint").alias("ReplacementMonth"),
        F.lit(electric["type"]).alias("ReplacementType"),
        F.lit(float(electric["acquisition_cost"])).alias("Cost"),
    ).withColumn("Year", year_of(F.col("ReplacementMonth")))


def greedy_schedule(vehicles, budget=BUDGET_EUR):
    """A feasible schedule in place of a solver's optimum.

    Each vehicle takes the option that is cheapest over the horizon. Vehicles due by age come
    first, then those that save most; five per month, while the budget lasts. The budget
    pays for no more than budget / cheapest option vehicles, so that many rows reach the windows.
    """
    weights = sum((1 + DISCOUNT_RATE) ** -(m // 12) for m in range(HORIZON_MONTHS))

    def over_horizon(option):
        fuel, ets = _new_month(option)
        return F.struct(
            (option["acquisition_cost"] + (fuel + ets) * weights).alias("total"),
            option["type"].alias("type"),
            option["acquisition_cost"].alias("cost"),
            option["infrastructure_cost"].alias("infrastructure"),
        )

    fuel, ets = _keep_month()
    valued = vehicles.select(
        "VIN",
        (F.col("age") >= FORCED_AGE).alias("forced"),
        F.array_min(F.transform(options(), over_horizon)).alias("best"),
        ((fuel + ets) * weights).alias("keep"),
    ).withColumn("saving", F.col("keep") - F.col("best.total"))
    order = [F.col("forced").desc(), F.col("saving").desc(), F.col("VIN")]
    affordable = int(budget // min(o["acquisition_cost"] for o in OPTIONS))
    chosen = (
        valued.where(F.col("forced") | (F.col("saving") > 0)).orderBy(*order).limit(affordable)
    )
    by_rank = Window.orderBy(*order)
    first_use = F.row_number().over(Window.partitionBy("best.type").orderBy(*order)) == 1
    spent = F.sum("outlay").over(by_rank.rowsBetween(Window.unboundedPreceding, 0))
    ranked = (
        chosen.withColumn(
            "outlay",
            F.col("best.cost") + F.when(first_use, F.col("best.infrastructure")).otherwise(0.0),
        )
        .withColumn("spent", spent)
        .withColumn("position", F.row_number().over(by_rank))
    )
    return ranked.where(F.col("spent") <= budget).select(
        "VIN",
        F.floor((F.col("position") - 1) / PER_MONTH).alias("ReplacementMonth"),
        F.col("best.type").alias("ReplacementType"),
        F.col("best.cost").alias("Cost"),
    ).withColumn("Year", year_of(F.col("ReplacementMonth")))


def with_option(schedule):
    """Attach the option's figures by its name, from the literal array."""
    matching = F.filter(options(), lambda o: o["type"] == F.col("ReplacementType"))
    return schedule.select("*", F.get(matching, F.lit(0)).alias("o"))


def active_fleet(schedule, vehicles):
    """Vehicles in service in every month of the horizon.

    A successor arrives in its month. The old vehicle leaves then, though not before the second month; of
    several entries of a vehicle the first one counts. An entry without ReplacementType retires the
    vehicle without a successor. Arrivals and departures are +1 and -1 by month, added up over the months.
    """
    month = F.greatest(F.col("ReplacementMonth"), F.lit(0))
    arrivals = schedule.where("ReplacementType IS NOT NULL").select(
        month.alias("month"), F.lit(1).alias("change")
    )
    departures = schedule.groupBy("VIN").agg(F.min("ReplacementMonth").alias("first")).select(
        F.greatest("first", F.lit(1)).alias("month"), F.lit(-1).alias("change")
    )
    changes = arrivals.unionByName(departures).groupBy("month").agg(F.sum("change").alias("change"))
    size = vehicles.agg(F.count(F.lit(1)).alias("fleet"))
    every = size.select("fleet", F.explode(months()).alias("month"))
    upto = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(changes, "month", "left").select(
        F.col("month").cast("bigint").alias("month"), "fleet",
        (F.col("fleet") + F.sum(F.coalesce("change", F.lit(0))).over(upto)).alias("active"),
    )


def violations(schedule, vehicles, budget=BUDGET_EUR):
    """One row per rule with the number of breaches; zero everywhere means feasible. The smallest
    fleet is counted by month, infrastructure once for every option that is used."""
    rows = with_option(schedule)
    repeated = schedule.groupBy("VIN").count().where("count > 1")
    crowded = schedule.where("ReplacementType IS NOT NULL").groupBy("ReplacementMonth").count().where(
        F.col("count") > PER_MONTH
    )
    per_option = rows.where("ReplacementType IS NOT NULL").groupBy("ReplacementType").agg(
        F.sum("Cost").alias("cost"), F.first("o.infrastructure_cost").alias("infrastructure")
    )
    overspent = per_option.agg(
        (F.sum(F.col("cost") + F.col("infrastructure")) > budget).alias("over")
    ).where("over")
    timely = schedule.where(F.col("ReplacementMonth") < FORCED_MONTHS).select("VIN")
    overdue = vehicles.where(F.col("age") >= FORCED_AGE).join(timely, "VIN", "left_anti")
    early = rows.where(F.col("ReplacementMonth") < F.col("o.availability_start_month"))
    small = active_fleet(schedule, vehicles).where(
        F.col("active") < F.floor(F.col("fleet") * MIN_FLEET_SHARE)
    )
    rules = {
        "max_one_replacement": repeated,
        "capacity_per_month": crowded,
        "budget": overspent,
        "force_replacement": overdue,
        "availability": early,
        "min_fleet": small,
    }
    out = None
    for name, found in rules.items():
        row = found.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("rule"), "violations"
        )
        out = row if out is None else out.unionByName(row)
    return out


def objective(schedule, vehicles):
    """Present value of a schedule: purchases, infrastructure, running and allowance cost.

    A vehicle runs until the month before its replacement (always in month 0); the successor's
    running cost is charged for its first month.
    """
    rows = with_option(schedule)
    joined = vehicles.join(rows.select("VIN", "ReplacementMonth", "o"), "VIN", "left")
    month = F.col("ReplacementMonth")
    last = F.when(month.isNull(), HORIZON_MONTHS - 1).otherwise(F.greatest(month - 1, F.lit(0)))
    kept = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")),
        F.lit(0.0),
        lambda total, m: total + factor(m),
    )
    fuel, ets = _keep_month()
    new_fuel, new_ets = _new_month(F.col("o"))
    weight = factor(month)
    totals = joined.select(
        (F.col("o.acquisition_cost") * weight).alias("capex"),
        (fuel * kept).alias("keep_fuel"),
        (ets * kept).alias("keep_ets"),
        (new_fuel * weight).alias("new_fuel"),
        (new_ets * weight).alias("new_ets"),
    ).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
          for c in ("capex", "keep_fuel", "keep_ets", "new_fuel", "new_ets")]
    )
    built = rows.groupBy("ReplacementType").agg(
        F.first("o.infrastructure_cost").alias("cost")
    ).agg(F.coalesce(F.sum("cost"), F.lit(0.0)))
    return totals.select(
        "capex",
        built.scalar().alias("infrastructure"),
        (F.col("keep_fuel") + F.col("new_fuel")).alias("operating"),
        (F.col("keep_ets") + F.col("new_ets")).alias("ets"),
    ).withColumn(
        "total",
        F.col("capex") + F.col("infrastructure") + F.col("operating") + F.col("ets"),
    )


def summary(schedule, price, method):
    """A schedule as a scenario row, with flat savings per vehicle and year."""
    years = HORIZON_YEARS
    found = schedule.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("Cost"), F.lit(0.0)).alias("capex")
    ).select("*", price.scalar().alias("price"))
    found = found.select(
        "*",
        (F.col("n") * SAVED_T_PER_YEAR).cast("double").alias("co2"),
        (F.col("n") * SAVED_FUEL_EUR_PER_YEAR).cast("double").alias("fuel"),
    ).withColumn("ets", F.col("co2") * F.col("price"))
    found = found.withColumn("saved", F.col("ets") + F.col("fuel"))
    found = found.withColumn("npv", npv(level_cash_flows(F.col("capex"), F.col("saved"), years)))
    return found.select(
        F.lit("OPTIMIZED").alias("ScenarioID"),
        F.lit("Optimization Result").alias("ScenarioName"),
        F.lit(HORIZON_MONTHS).alias("TimeHorizon_months"),
        F.col("n").alias("VehiclesReplaced"),
        F.col("capex").alias("CapEx_EUR"),
        (F.col("fuel") * years).alias("OpEx_EUR"),
        (F.col("co2") * years).alias("CO2_Reduction_t"),
        (F.col("ets") * years).alias("ETS_Savings_EUR"),
        F.col("npv").alias("NPV_EUR"),
        roi_percent(F.col("npv"), F.col("capex")).alias("ROI_Percent"),
        payback_years(F.col("capex"), F.col("saved")).alias("Payback_Years"),
        F.lit(method).alias("OptimizationMethod"),
    )
