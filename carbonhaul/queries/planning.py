"""Fleet replacement planning."""

from pyspark.sql import functions as F

from ..plans import lagrangian as L
from ..plans import pricing
from ..plans import replacement as R
from ..session import materialized, scratch_path
from ..sources import testdata as src
from ..sources.tables import TableStore
from .registry import MEAN_PRICE, query


def vehicles(spark, sf):
    price = pricing.average_price(src.price_curve(spark, sf))
    return R.fleet(src.trips(spark, sf), src.vehicle_ages(F.col("VIN")), price)


FLEET = f"""fleet AS (SELECT VIN, sum(Distance_km) AS km, sum(Fuel_l) AS l, count(*) AS trips,
     3 + CAST(substr(VIN, 5, 13) AS BIGINT) % 10 AS age, (SELECT {MEAN_PRICE} FROM price_curve) AS price
   FROM trips GROUP BY VIN),
 options AS (SELECT * FROM (VALUES ('ELECTRIC_TRUCK', 180000, 0.12, 0.05, 50000),
     ('HYBRID_TRUCK', 140000, 0.18, 0.4, 15000), ('DIESEL_TRUCK_NEW', 120000, 0.25, 0.67, 0))
     v(option, cost, per_km, co2_km, infra)),
 months AS (SELECT m AS month, pow(1.08, -(m // 12)) AS f FROM range(60) t(m)),
 matrix AS (SELECT VIN, option, month, cost * f AS capex, km / 12 * per_km * f AS fuel_cost,
     km / 12 * co2_km / 1000 * price * f AS ets_cost,
     cost * f + km / 12 * per_km * f + km / 12 * co2_km / 1000 * price * f AS total
   FROM fleet, options, months),
 heuristic AS (SELECT VIN, 6 * (rn - 1) AS ReplacementMonth, 'ELECTRIC_TRUCK' AS ReplacementType,
     CAST(180000 AS DOUBLE) AS "Cost", 6 * (rn - 1) // 12 + 1 AS "Year"
   FROM (SELECT VIN, row_number() OVER (ORDER BY age DESC, VIN) AS rn FROM fleet) WHERE rn <= 10),
 horizon AS (SELECT sum(f) AS w FROM months),
 valued AS (SELECT VIN, age >= 10 AS forced, km / 12 * 0.25 * w + l / 12 * 2.68 / 1000 * price * w AS keep,
     cost + (km / 12 * per_km + km / 12 * co2_km / 1000 * price) * w AS total, option, cost, infra,
     row_number() OVER (PARTITION BY VIN ORDER BY cost + (km / 12 * per_km + km / 12 * co2_km / 1000 * price) * w, option) AS pick
   FROM fleet, options, horizon),
 ranked AS (SELECT *, row_number() OVER (ORDER BY forced DESC, saving DESC, VIN) AS rn FROM (
     SELECT VIN, forced, keep - total AS saving, option, cost, infra FROM valued WHERE pick = 1)
   WHERE forced OR saving > 0),
 spent AS (SELECT *, sum(cost + CASE WHEN seen = 1 THEN infra ELSE 0 END) OVER (ORDER BY rn) AS total FROM (
     SELECT *, row_number() OVER (PARTITION BY option ORDER BY rn) AS seen FROM ranked WHERE rn <= 50)),
 greedy AS (SELECT VIN, (rn - 1) // 5 AS ReplacementMonth, option AS ReplacementType,
     CAST(cost AS DOUBLE) AS "Cost", (rn - 1) // 5 // 12 + 1 AS "Year" FROM spent WHERE total <= 6000000)"""


def careless(vehicles):
    """A plan made by hand that breaks every rule: each fifth vehicle is sold in the fifth month without a
    successor, the oldest tenth is replaced too late, and the first vehicle twice, once before the start."""
    number = F.substring("VIN", 5, 13).cast("bigint")
    sold = vehicles.where(number % 5 == 0).select(
        "VIN", F.lit(4).cast("bigint").alias("ReplacementMonth"),
        F.lit(None).cast("string").alias("ReplacementType"), F.lit(0.0).alias("Cost"),
    )
    late = vehicles.where((number % 5 != 0) & (F.col("age") >= R.FORCED_AGE)).select(
        "VIN", F.lit(30).cast("bigint").alias("ReplacementMonth"),
        F.lit("ELECTRIC_TRUCK").alias("ReplacementType"), F.lit(900000.0).alias("Cost"),
    )
    again = vehicles.where(number == 1).select(
        "VIN", F.explode(F.array(F.lit(-1).cast("bigint"), F.lit(30).cast("bigint"))).alias("ReplacementMonth"),
        F.lit("HYBRID_TRUCK").alias("ReplacementType"), F.lit(5900000.0).alias("Cost"),
    )
    rows = sold.unionByName(late).unionByName(again)
    return rows.withColumn("Year", R.year_of(F.greatest("ReplacementMonth", F.lit(0))))


def both_schedules(spark, sf, careless_too=False):
    """The fleet and its schedules, each computed once for the several checks on it."""
    fleet = materialized(vehicles(spark, sf))
    found = {
        "greedy": materialized(R.greedy_schedule(fleet)),
        "heuristic": materialized(R.heuristic_schedule(fleet)),
    }
    if careless_too:
        found["careless"] = materialized(careless(fleet))
    return fleet, found


def union(frames):
    out = None
    for name, df in frames.items():
        df = df.select(F.lit(name).alias("schedule"), "*")
        out = df if out is None else out.unionByName(df)
    return out


@query(
    "discount_factors",
    f"""WITH {FLEET}
    SELECT month, month // 12 + 1 AS "year", f AS discount_factor, (SELECT sum(km) FROM fleet) / 12 * 0.25 * f AS fleet_fuel_cost
    FROM months""",
    doubles="discount_factor fleet_fuel_cost",
)
def discount_factors(spark, sf):
    """Factor of every month, with the fleet's discounted monthly fuel cost."""
    total = src.trips(spark, sf).agg(F.sum("Distance_km").alias("km"))
    rows = total.select("km", F.explode(R.months()).alias("month"))
    weight = R.factor(F.col("month"))
    return rows.select(
        "month",
        R.year_of(F.col("month")).alias("year"),
        weight.alias("discount_factor"),
        (F.col("km") / 12 * R.KEEP_EUR_PER_KM * weight).alias("fleet_fuel_cost"),
    )


@query(
    "replacement_cost_matrix",
    f"WITH {FLEET} SELECT * FROM matrix",
    doubles="capex fuel_cost ets_cost total",
    decimals=4,
)
def replacement_cost_matrix(spark, sf):
    return R.cost_matrix(vehicles(spark, sf))


@query(
    "keep_cost_monthly",
    f"""WITH {FLEET} SELECT VIN, month, (km / 12 * 0.25 + l / 12 * 2.68 / 1000 * price) * f AS keep_cost
        FROM fleet, months""",
    doubles="keep_cost",
    decimals=4,
)
def keep_cost_monthly(spark, sf):
    return R.keep_cost(vehicles(spark, sf))


@query(
    "best_option_per_vehicle",
    f"""WITH {FLEET} SELECT VIN, option, month, total FROM (SELECT *, row_number() OVER (
          PARTITION BY VIN ORDER BY round(total, 4), month, option) AS rn FROM matrix) WHERE rn = 1""",
    doubles="total",
    decimals=4,
)
def best_option_per_vehicle(spark, sf):
    return R.best_option(vehicles(spark, sf))


@query("heuristic_schedule", f"WITH {FLEET} SELECT * FROM heuristic")
def heuristic_schedule(spark, sf):
    return R.heuristic_schedule(vehicles(spark, sf))


@query("greedy_schedule", f"WITH {FLEET} SELECT * FROM greedy")
def greedy_schedule(spark, sf):
    return R.greedy_schedule(vehicles(spark, sf))


CARELESS = """careless AS (SELECT VIN, CAST(4 AS BIGINT) AS ReplacementMonth, NULL AS ReplacementType, CAST(0 AS DOUBLE) AS "Cost"
   FROM fleet WHERE CAST(substr(VIN, 5, 13) AS BIGINT) % 5 = 0
   UNION ALL SELECT VIN, 30, 'ELECTRIC_TRUCK', 900000 FROM fleet WHERE CAST(substr(VIN, 5, 13) AS BIGINT) % 5 <> 0 AND age >= 10
   UNION ALL SELECT VIN, unnest([-1, 30]), 'HYBRID_TRUCK', 5900000 FROM fleet WHERE CAST(substr(VIN, 5, 13) AS BIGINT) = 1),
 starts AS (SELECT option, CAST(0 AS BIGINT) AS first_month FROM options)"""

VIOLATIONS_SQL = """SELECT '{s}' AS schedule, 'max_one_replacement' AS rule, (SELECT count(*) FROM (SELECT VIN FROM {s} GROUP BY VIN HAVING count(*) > 1)) AS violations
  UNION ALL SELECT '{s}', 'capacity_per_month', (SELECT count(*) FROM (SELECT 1 FROM {s} WHERE ReplacementType IS NOT NULL GROUP BY ReplacementMonth HAVING count(*) > 5))
  UNION ALL SELECT '{s}', 'budget', CAST((SELECT sum("Cost") FROM {s}) + (SELECT sum(infra) FROM options WHERE option IN (SELECT ReplacementType FROM {s} WHERE ReplacementType IS NOT NULL)) > 6000000 AS BIGINT)
  UNION ALL SELECT '{s}', 'force_replacement', (SELECT count(*) FROM fleet WHERE age >= 10 AND VIN NOT IN (SELECT VIN FROM {s} WHERE ReplacementMonth < 24))
  UNION ALL SELECT '{s}', 'availability', (SELECT count(*) FROM {s} JOIN starts ON option = ReplacementType WHERE ReplacementMonth < first_month)
  UNION ALL SELECT '{s}', 'min_fleet', (SELECT count(*) FROM months m WHERE
      (SELECT count(*) FROM fleet)
      - (SELECT count(DISTINCT VIN) FROM {s} WHERE ReplacementMonth <= m.month AND m.month > 0)
      + (SELECT count(*) FROM {s} WHERE ReplacementType IS NOT NULL AND ReplacementMonth <= m.month)
      < (SELECT floor(count(*) * 0.9) FROM fleet))"""


@query(
    "schedule_violations",
    f"WITH {FLEET}, {CARELESS} " + " UNION ALL ".join(
        VIOLATIONS_SQL.format(s=s) for s in ("heuristic", "greedy", "careless")
    ),
)
def schedule_violations(spark, sf):
    fleet, schedules = both_schedules(spark, sf, careless_too=True)
    return union({n: R.violations(s, fleet) for n, s in schedules.items()})


@query(
    "active_fleet_by_month",
    f"WITH {FLEET}, {CARELESS} " + " UNION ALL ".join(
        f"""SELECT '{s}' AS schedule, month, (SELECT count(*) FROM fleet) AS fleet,
          (SELECT count(*) FROM fleet)
          - (SELECT count(DISTINCT VIN) FROM {s} WHERE ReplacementMonth <= m.month AND m.month > 0)
          + (SELECT count(*) FROM {s} WHERE ReplacementType IS NOT NULL AND ReplacementMonth <= m.month) AS active
        FROM months m""" for s in ("heuristic", "greedy", "careless")
    ),
)
def active_fleet_by_month(spark, sf):
    """Vehicles in service in every month under each schedule."""
    fleet, schedules = both_schedules(spark, sf, careless_too=True)
    return union({n: R.active_fleet(s, fleet) for n, s in schedules.items()})


def _lagrangian_sql():
    """The price search in three rounds of forty sections, additions at the margin, and months."""
    names, costs, infra = zip(*((o["type"], o["acquisition_cost"], o["infrastructure_cost"]) for o in R.OPTIONS))
    n = range(len(names))
    subsets = ", ".join(f"({k}, {', '.join(str(i in s).lower() for i in n)})" for k, s in enumerate(L.SUBSETS))
    own = ", ".join(
        f"CASE WHEN a{i} THEN {{'p': t{i} + price * {costs[i]}, 'i': {i}}} END" for i in n
    )
    choice = f"list_min([CASE WHEN NOT forced THEN {{'p': keep, 'i': -1}} END, {own}]).i"

    def by_option(index, values):
        return f"([{', '.join(f'CAST({v} AS DOUBLE)' for v in values)}])[{index} + 1]"

    ctes = [f"""running AS (SELECT month, f, coalesce(sum(f) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS old,
     sum(f) OVER () AS whole FROM months),
 choices AS (SELECT VIN, age >= 10 AS forced, list_position({list(names)}, option) - 1 AS oi, month,
     km / 12 * 0.25 + l / 12 * 2.68 / 1000 * price AS month_cost, whole,
     round((cost + km / 12 * per_km + km / 12 * co2_km / 1000 * price) * f
       + (km / 12 * 0.25 + l / 12 * 2.68 / 1000 * price) * old, 4) AS total
   FROM fleet, options, running WHERE age < 10 OR month < 24),
 bests AS (SELECT VIN, forced, month_cost, whole, oi, min({{'t': total, 'm': month}}) AS b FROM choices GROUP BY ALL),
 wide AS (SELECT VIN, forced, month_cost, round(month_cost * whole, 4) AS keep,
     {', '.join(f"max(b.t) FILTER (oi = {i}) AS t{i}, max(b.m) FILTER (oi = {i}) AS m{i}" for i in n)}
   FROM bests GROUP BY VIN, forced, month_cost, whole),
 subsets AS (SELECT * FROM (VALUES {subsets}) v(s, {', '.join(f'a{i}' for i in n)})),
 range_0 AS (SELECT s, CAST(0 AS DOUBLE) AS low, (SELECT max(greatest(keep, {', '.join(f't{i}' for i in n)})
     - least({', '.join(f't{i}' for i in n)})) FROM wide) / 20000 + 1 AS high FROM subsets)"""]
    for k in range(L.ROUNDS):
        ctes.append(f"""tried_{k} AS (SELECT s, section, low + (high - low) * section / {L.SECTIONS} AS price, {', '.join(f'a{i}' for i in n)}
   FROM range_{k} JOIN subsets USING (s), range({L.SECTIONS + 1}) t(section)),
 sums_{k} AS (SELECT s, section, price, sum(CASE WHEN i < 0 THEN keep ELSE ([{', '.join(f't{i}' for i in n)}])[i + 1] END) AS cost,
     sum(CASE WHEN i < 0 THEN 0 ELSE {by_option('i', costs)} END) AS spent,
     {' + '.join(f'max(CASE WHEN i = {i} THEN {infra[i]} ELSE 0 END)' for i in n)} AS built, count(*) FILTER (i >= 0) AS slots
   FROM (SELECT *, {choice} AS i FROM wide, tried_{k}) GROUP BY s, section, price),
 fits_{k} AS (SELECT s, min(section) AS section FROM sums_{k} WHERE spent + built <= 6000000 AND slots <= 300 GROUP BY s),
 range_{k + 1} AS (SELECT f.s, lo.price AS low, hi.price AS high, lo.built AS building FROM fits_{k} f
   JOIN sums_{k} hi ON hi.s = f.s AND hi.section = f.section
   JOIN sums_{k} lo ON lo.s = f.s AND lo.section = greatest(f.section - 1, 0))""")
    ctes.append(f"""bounds AS (SELECT s, max(cost + price * (spent - 6000000)) AS bound FROM (
     {' UNION ALL '.join(f'SELECT * FROM sums_{k}' for k in range(L.ROUNDS))}) GROUP BY s),
 found AS (SELECT r.s, r.low, r.high FROM range_{L.ROUNDS} r JOIN bounds b USING (s)
   WHERE (SELECT count(*) FROM wide WHERE forced) <= 120 ORDER BY round(bound + building, 2), s LIMIT 1),
 at_price AS (SELECT *, {choice.replace('price', 'high')} AS i FROM wide, found JOIN subsets USING (s)),
 picked AS (SELECT VIN, forced, month_cost, i, ([{', '.join(f'm{i}' for i in n)}])[i + 1] AS desired, {by_option('i', costs)} AS c
   FROM at_price WHERE i >= 0),
 spare AS (SELECT 6000000 - coalesce(sum(c), 0) - {' - '.join(f'coalesce(max(CASE WHEN i = {i} THEN {infra[i]} END), 0)' for i in n)} AS money,
     50 - count(*) AS more, {', '.join(f"coalesce(bool_or(i = {i}), false){' OR true' if not infra[i] else ''} AS u{i}" for i in n)} FROM picked),
 open AS (SELECT money - CASE WHEN NOT ({' OR '.join(f'(a{i} AND u{i})' for i in n)}) THEN {' + '.join(f'CASE WHEN a{i} THEN {infra[i]} ELSE 0 END' for i in n)} ELSE 0 END AS money, more,
     {', '.join(f"a{i} AND (u{i} OR NOT ({' OR '.join(f'(a{j} AND u{j})' for j in n)})) AS o{i}" for i in n)}
   FROM spare, found JOIN subsets USING (s) WHERE low <> high),
 extra AS (SELECT *, row_number() OVER (ORDER BY value DESC, VIN) AS rn, sum(c) OVER (ORDER BY value DESC, VIN) AS paid FROM (
     SELECT VIN, forced, month_cost, j, ([{', '.join(f'm{i}' for i in n)}])[j + 1] AS desired, {by_option('j', costs)} AS c,
       (keep - ([{', '.join(f't{i}' for i in n)}])[j + 1]) / {by_option('j', costs)} AS value, money, more
     FROM (SELECT *, {choice.replace('price', 'low')
                      .replace('WHEN a', 'WHEN o')} AS j FROM at_price, open) WHERE i < 0 AND j >= 0)),
 unserved AS (SELECT VIN, forced, month_cost, {len(names) - 1} AS i, m{len(names) - 1} AS desired, {by_option(len(names) - 1, costs)} AS c,
     row_number() OVER (ORDER BY (keep - t{len(names) - 1}) / {costs[-1]} DESC, VIN) AS rn
   FROM wide WHERE forced AND NOT EXISTS (SELECT 1 FROM found)),
 taken AS (SELECT VIN, forced, month_cost, i, desired, c FROM picked
   UNION ALL SELECT VIN, forced, month_cost, j, desired, c FROM extra WHERE rn <= more AND paid <= money
   UNION ALL SELECT VIN, forced, month_cost, i, desired, c FROM unserved WHERE rn <= 50),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY forced ORDER BY desired, month_cost DESC, VIN) - 1 AS r FROM taken),
 due AS (SELECT *, least(r + max(desired * 5 - r) OVER (ORDER BY r), 120 - count(*) OVER () + r) AS slot FROM ordered WHERE forced),
 free AS (SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS k FROM range(300) t(slot) WHERE slot NOT IN (SELECT slot FROM due)),
 others AS (SELECT *, r + max(first - r) OVER (ORDER BY r) AS k FROM (
     SELECT *, (SELECT count(*) FROM free WHERE slot < desired * 5) AS first FROM ordered WHERE NOT forced)),
 lagrangian AS (SELECT VIN, slot // 5 AS ReplacementMonth, ({list(names)})[i + 1] AS ReplacementType, c AS "Cost", slot // 60 + 1 AS "Year"
   FROM (SELECT VIN, i, c, slot FROM due UNION ALL SELECT VIN, i, c, slot FROM others JOIN free USING (k)))""")
    return ",\n ".join(ctes)


LAGRANGIAN = _lagrangian_sql()


@query("lagrangian_schedule", f"WITH {FLEET}, {LAGRANGIAN} SELECT * FROM lagrangian")
def lagrangian_schedule(spark, sf):
    """A schedule by a price on the budget, vehicles due by age first."""
    return L.plan(vehicles(spark, sf))[0]


OBJECTIVE_SQL = """SELECT '{s}' AS schedule, capex, infrastructure, operating, ets,
    capex + infrastructure + operating + ets AS total FROM (
  SELECT sum(coalesce(o.cost * pow(1.08, -(ReplacementMonth // 12)), 0)) AS capex,
    (SELECT coalesce(sum(infra), 0) FROM options WHERE option IN (SELECT ReplacementType FROM {s})) AS infrastructure,
    sum(km / 12 * 0.25 * kept + coalesce(km / 12 * per_km * pow(1.08, -(ReplacementMonth // 12)), 0)) AS operating,
    sum(l / 12 * 2.68 / 1000 * price * kept
        + coalesce(km / 12 * co2_km / 1000 * price * pow(1.08, -(ReplacementMonth // 12)), 0)) AS ets
  FROM (SELECT *, (SELECT sum(f) FROM months WHERE month = 0 OR month < coalesce(ReplacementMonth, 60)) AS kept
        FROM fleet LEFT JOIN {s} USING (VIN)) x
  LEFT JOIN options o ON o.option = x.ReplacementType)"""


@query(
    "schedule_objective",
    f"WITH {FLEET} {OBJECTIVE_SQL.format(s='heuristic')} UNION ALL {OBJECTIVE_SQL.format(s='greedy')}",
    doubles="capex infrastructure operating ets total",
    decimals=2,
)
def schedule_objective(spark, sf):
    fleet, schedules = both_schedules(spark, sf)
    return union({n: R.objective(s, fleet) for n, s in schedules.items()})


@query(
    "lagrangian_status",
    f"""WITH {FLEET}, {LAGRANGIAN} SELECT
      CASE WHEN EXISTS (SELECT 1 FROM found) THEN 'FEASIBLE' ELSE 'INFEASIBLE' END AS status,
      (SELECT count(*) FROM wide WHERE forced) AS forced,
      (SELECT count(*) FROM wide WHERE forced AND VIN NOT IN (SELECT VIN FROM lagrangian WHERE ReplacementMonth < 24)) AS forced_missed,
      (SELECT greatest(count(*) - 50, 0) FROM wide WHERE forced) AS forced_unavoidable,
      (SELECT count(*) FROM lagrangian) AS replaced, (SELECT coalesce(sum("Cost"), 0) FROM lagrangian) AS spent,
      (SELECT high FROM found) AS budget_price,
      (SELECT CASE WHEN EXISTS (SELECT 1 FROM found) THEN min(bound) END FROM bounds) AS lower_bound""",
    doubles="spent budget_price lower_bound",
    decimals=2,
)
def lagrangian_status(spark, sf):
    """Whether a schedule keeps all rules, what it misses and must miss, and how cheap one could be."""
    fleet = materialized(vehicles(spark, sf))
    schedule, found = L.plan(fleet)
    return L.status(materialized(schedule), fleet, found)


SUMMARY_SQL = """SELECT '{s}' AS schedule, 'OPTIMIZED' AS ScenarioID, 'Optimization Result' AS ScenarioName,
    CAST(60 AS BIGINT) AS TimeHorizon_months, n AS VehiclesReplaced, capex AS CapEx_EUR, n * 7500 * 5 AS OpEx_EUR,
    n * 18 * 5 AS CO2_Reduction_t, n * 18 * p * 5 AS ETS_Savings_EUR, value AS NPV_EUR,
    value / capex * 100 AS ROI_Percent, capex / (n * 18 * p + n * 7500) AS Payback_Years,
    '{m}' AS OptimizationMethod
  FROM (SELECT *, (n * 18 * p + n * 7500) * (1/1.08 + 1/pow(1.08, 2) + 1/pow(1.08, 3) + 1/pow(1.08, 4)
          + 1/pow(1.08, 5)) - capex AS value
        FROM (SELECT count(*) AS n, sum("Cost") AS capex, (SELECT {mean} FROM price_curve) AS p FROM {s}))"""


@query(
    "schedule_summary",
    f"WITH {FLEET} {SUMMARY_SQL.format(s='heuristic', m='HEURISTIC', mean=MEAN_PRICE)} UNION ALL "
    f"{SUMMARY_SQL.format(s='greedy', m='GREEDY', mean=MEAN_PRICE)}",
    doubles="CapEx_EUR OpEx_EUR CO2_Reduction_t ETS_Savings_EUR NPV_EUR ROI_Percent Payback_Years",
)
def schedule_summary(spark, sf):
    _, schedules = both_schedules(spark, sf)
    price = pricing.average_price(src.price_curve(spark, sf))
    return union({n: R.summary(s, price, n.upper()) for n, s in schedules.items()})


@query(
    "optimization_results",
    f"""WITH {FLEET}, {LAGRANGIAN},
    counts AS (SELECT 'LAGRANGIAN' AS OptimizationMethod, count(*) AS n, sum("Cost") AS capex FROM lagrangian
      WHERE EXISTS (SELECT 1 FROM found)
      UNION ALL SELECT 'HEURISTIC', count(*), sum("Cost") FROM heuristic WHERE NOT EXISTS (SELECT 1 FROM found)),
    yearly AS (SELECT *, n * 18 * (SELECT {MEAN_PRICE} FROM price_curve) AS ets, n * CAST(7500 AS DOUBLE) AS fuel FROM counts WHERE n > 0),
    worth AS (SELECT *, (ets + fuel) * (SELECT sum(pow(1.08, -y)) FROM range(1, 6) t(y)) - capex AS value FROM yearly)
    SELECT 'OPTIMIZED' AS ScenarioID, 'Optimization Result' AS ScenarioName, CAST(60 AS BIGINT) AS TimeHorizon_months,
      n AS VehiclesReplaced, capex AS CapEx_EUR, fuel * 5 AS OpEx_EUR, CAST(n * 18 * 5 AS DOUBLE) AS CO2_Reduction_t,
      ets * 5 AS ETS_Savings_EUR, value AS NPV_EUR, value / capex * 100 AS ROI_Percent,
      capex / (ets + fuel) AS Payback_Years, OptimizationMethod FROM worth""",
    doubles="CapEx_EUR OpEx_EUR CO2_Reduction_t ETS_Savings_EUR NPV_EUR ROI_Percent Payback_Years",
    decimals=4,
)
def optimization_results(spark, sf):
    """The planning job writes its result table; read back from there."""
    store = TableStore(spark, scratch_path(spark, "planning"))
    price = pricing.average_price(src.price_curve(spark, sf))
    L.save_results(store, vehicles(spark, sf), price)
    return store.read("OptimizationResults")
