"""A replacement schedule by prices on the scarce things: budget, and slots of the workshop.

At given prices every vehicle decides alone, inside its row: keep, or the option that is cheapest with
the price of its purchase added. Only sums come back: what is spent, how many slots are used. The price
is found by sections: some forty prices at a time are tried in one pass over the fleet, and the interval
in which the limits begin to hold is divided again. All sets of permitted options are searched in the
same passes, since infrastructure is paid once for an option that is used at all.

What the relaxation leaves open is repaired at the margin: vehicles that the next lower price would have
added, best value first, while the budget lasts; months by pushing what does not fit to the next free slot, those
with a deadline first. As the budget pays for a fixed number of vehicles, these last steps handle
that many rows, whatever the fleet's size.

Vehicles due by age are never left out while any schedule holds them all: they have no choice to keep, and at a high
price take the option with the cheapest purchase. Where even that is too dear, or their number exceeds the
slots before the deadline, no schedule exists; as many as possible are served then, those that save
most first, and the status says how many cannot be.
"""

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import DISCOUNT_RATE, HORIZON_MONTHS
from ..schemas import OPTIMIZATION_RESULTS
from ..session import materialized
from . import replacement as R

#: prices tried in one pass, and passes
SECTIONS, ROUNDS = 40, 3
SUBSETS = tuple(
    s for n in range(1, len(R.OPTIONS) + 1) for s in combinations(range(len(R.OPTIONS)), n)
)
WEIGHTS = [(1 + DISCOUNT_RATE) ** -(m // 12) for m in range(HORIZON_MONTHS)]


@dataclass(frozen=True)
class Limits:
    budget: float = R.BUDGET_EUR
    per_month: int = R.PER_MONTH
    forced_age: float = R.FORCED_AGE
    forced_months: int = R.FORCED_MONTHS

    @property
    def affordable(self):
        """No schedule replaces more vehicles than this."""
        return int(self.budget // min(o["acquisition_cost"] for o in R.OPTIONS))


def candidates(vehicles, limits=Limits()):
    """Per vehicle the cost of keeping it, and per option the least cost and its month."""
    kept, until = [], 0.0
    for month in range(HORIZON_MONTHS):
        # the old vehicle runs until the month before, and always in the first
        kept.append(WEIGHTS[0] if month < 2 else until)
        until += WEIGHTS[month]
    weights, running = (F.array(*map(F.lit, x)) for x in (WEIGHTS, kept))
    forced = F.col("age") >= limits.forced_age
    fuel, ets = R._keep_month()

    def best(option):
        new_fuel, new_ets = R._new_month({k: F.lit(float(v)) for k, v in option.items() if k != "type"})
        first = int(option["availability_start_month"])
        months = F.when(
            forced, F.sequence(F.lit(first), F.lit(limits.forced_months - 1))
        ).otherwise(F.sequence(F.lit(first), F.lit(HORIZON_MONTHS - 1)))

        def price_of(month):
            weight, old = (F.element_at(x, month + 1) for x in (weights, running))
            total = (option["acquisition_cost"] + new_fuel + new_ets) * weight + F.col("month_cost") * old
            return F.struct(F.round(total, 4).alias("total"), month.alias("month"))

        return F.array_min(F.transform(months, price_of))

    rows = vehicles.select("*", (fuel + ets).alias("month_cost"))
    return rows.select(
        "VIN", forced.alias("forced"), "month_cost",
        F.round(F.col("month_cost") * until, 4).alias("keep"),
        F.array(*[best(o) for o in R.OPTIONS]).alias("best"),
    )


def _choice(permitted, price):
    """The option taken at a price: its index, or -1 for keeping the vehicle.

    ``permitted`` has one column or boolean an option.
    """
    own = [
        F.when(
            allowed, F.struct((F.col("best")[i]["total"] + price * o["acquisition_cost"]).alias("priced"),
                              F.lit(i).alias("index"))
        )
        for i, (o, allowed) in enumerate(zip(R.OPTIONS, permitted))
    ]
    keep = F.when(
        ~F.col("forced"), F.struct(F.col("keep").alias("priced"), F.lit(-1).alias("index"))
    )
    return F.array_min(F.array(keep, *own))["index"]


def _permitted(subset):
    return [F.lit(i in subset) for i in range(len(R.OPTIONS))]


def _by_option(index, values):
    """A literal of the chosen option; 0 for keeping."""
    return F.coalesce(F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + 1), F.lit(0.0))


def _price_at(low, high, section):
    return low + (high - low) * section / SECTIONS


def demand(rows, ranges):
    """What is spent and used at the prices of ``ranges`` {subset: (low, high)}: one row a subset and
    section."""
    number = F.col("t") % (SECTIONS + 1)
    at = F.floor(F.col("t") / (SECTIONS + 1)).cast("int") + 1
    own = list(ranges)
    subset = F.element_at(F.array(*map(F.lit, own)), at)
    low, high = (F.element_at(F.array(*[F.lit(ranges[s][k]) for s in own]), at) for k in (0, 1))
    permitted = [
        F.element_at(F.array(*[F.lit(i in SUBSETS[s]) for s in own]), at) for i in range(len(R.OPTIONS))
    ]
    every = F.sequence(F.lit(0), F.lit(len(own) * (SECTIONS + 1) - 1))
    tried = rows.select("forced", "keep", "best", F.explode(every).alias("t")).select(
        "forced", "keep", "best", subset.alias("subset"), number.alias("section"),
        _price_at(low, high, number).alias("price"),
        *[p.alias(f"permitted_{i}") for i, p in enumerate(permitted)],
    )
    permitted = [F.col(f"permitted_{i}") for i in range(len(R.OPTIONS))]
    index = F.col("index")
    chosen = tried.select(
        "keep", "best", "subset", "section", _choice(permitted, F.col("price")).alias("index")
    ).select(
        "subset", "section", "index",
        F.when(index < 0, F.col("keep")).otherwise(
            F.element_at("best", F.greatest(index, F.lit(0)) + 1)["total"]
        ).alias("cost"),
        F.when(index >= 0, _by_option(index, [o["acquisition_cost"] for o in R.OPTIONS]))
        .otherwise(0.0).alias("spent"),
    )
    used = [F.max((F.col("index") == i).cast("int")).alias(f"used_{i}") for i in range(len(R.OPTIONS))]
    totals = chosen.groupBy("subset", "section").agg(
        F.sum("cost").alias("cost"), F.sum("spent").alias("spent"),
        F.count_if(F.col("index") >= 0).alias("slots"), *used,
    )
    built = sum(
        F.col(f"used_{i}") * float(o["infrastructure_cost"]) for i, o in enumerate(R.OPTIONS)
    )
    return totals.withColumn("infrastructure", built)


@dataclass(frozen=True)
class Prices:
    """What the search found: permitted options, the price at which the limits hold, and the next lower
    one at which they do not; ``None`` for both where no schedule serves all vehicles due by age."""

    subset: tuple
    price: float | None
    lower: float | None
    forced: int
    lower_bound: float | None


def search(rows, limits=Limits()):
    """Prices for ``rows`` of :func:`candidates`; sums of a few hundred rows reach the driver."""
    top = F.greatest(*[
        (F.greatest(F.col("keep"), *[F.col("best")[i]["total"] for i in range(len(R.OPTIONS))])
         - F.col("best")[i]["total"]) for i in range(len(R.OPTIONS))
    ])
    forced, highest = rows.agg(F.count_if("forced"), F.max(top)).first()
    if highest is None:
        return Prices(SUBSETS[-1], 0.0, 0.0, 0, 0.0)
    costs = sorted(o["acquisition_cost"] for o in R.OPTIONS)
    gap = min([costs[0], *[b - a for a, b in zip(costs, costs[1:]) if b > a]])
    ceiling = highest / gap + 1.0
    open_ranges = {s: (0.0, ceiling) for s in range(len(SUBSETS))}
    held, bounds, slots = {}, {}, limits.per_month * HORIZON_MONTHS
    for _ in range(ROUNDS):
        prices = {
            s: [_price_at(low, high, i) for i in range(SECTIONS + 1)]
            for s, (low, high) in open_ranges.items()
        }
        sums = {(r["subset"], r["section"]): r for r in demand(rows, open_ranges).collect()}
        for s, own in prices.items():
            fits = None
            for i, price in enumerate(own):
                found = sums[s, i]
                over = found["spent"] + found["infrastructure"] - limits.budget
                # weak duality: no schedule with these options costs less
                bound = found["cost"] + price * (found["spent"] - limits.budget)
                bounds[s] = max(bounds.get(s, bound), bound)
                if fits is None and over <= 0 and found["slots"] <= slots:
                    fits = i
                    # with what stands to be built once the vehicles at the margin are added
                    built = sums[s, max(i - 1, 0)]["infrastructure"]
                    held[s] = (price, own[max(i - 1, 0)], built)
            if fits is None:
                open_ranges.pop(s)
            else:
                open_ranges[s] = (own[max(fits - 1, 0)], own[fits])
        if not open_ranges:
            break
    if not held or forced > limits.per_month * limits.forced_months:
        return Prices(SUBSETS[-1], None, None, forced, None)
    best = min(held, key=lambda s: (round(bounds[s] + held[s][2], 2), s))
    price, lower, _ = held[best]
    return Prices(SUBSETS[best], price, lower, forced, min(bounds.values()))


def _picked(rows, index):
    """VIN, forced, urgency, desired month, option and its purchase."""
    best = F.element_at("best", index + 1)
    return rows.select(
        "VIN", "forced", "month_cost", index.alias("option"), best["month"].alias("desired"),
        _by_option(index, [o["acquisition_cost"] for o in R.OPTIONS]).alias("Cost"),
        ((F.col("keep") - best["total"]) / _by_option(
            index, [o["acquisition_cost"] for o in R.OPTIONS])).alias("value"),
    )


def chosen(rows, found, limits=Limits()):
    """The vehicles to replace with their options: at most as many as the budget pays for."""
    if found.price is None:
        # no schedule serves all: the option that serves most, those that save most
        room = [int((limits.budget - o["infrastructure_cost"]) // o["acquisition_cost"]) for o in R.OPTIONS]
        most = max(range(len(room)), key=lambda i: (room[i], -i))
        count = max(0, min(room[most], limits.per_month * limits.forced_months))
        due = _picked(rows.where("forced"), F.lit(most))
        return due.orderBy(F.col("value").desc(), "VIN").limit(count)
    at_price = _choice(_permitted(found.subset), F.lit(float(found.price)))
    taken = _picked(rows.select("*", at_price.alias("i")).where("i >= 0"), F.col("i"))
    taken = materialized(taken)
    summary = taken.agg(
        F.coalesce(F.sum("Cost"), F.lit(0.0)), F.count(F.lit(1)), F.collect_set("option")
    ).first()
    used = sorted(summary[2])
    built = sum(float(R.OPTIONS[i]["infrastructure_cost"]) for i in used)
    left = limits.budget - summary[0] - built
    more = min(limits.affordable, limits.per_month * HORIZON_MONTHS) - summary[1]
    # additions need no further infrastructure, unless there is nothing to add to
    open_options = tuple(
        i for i in found.subset if i in used or not R.OPTIONS[i]["infrastructure_cost"]
    )
    if not open_options:
        open_options = found.subset
        left -= sum(float(R.OPTIONS[i]["infrastructure_cost"]) for i in open_options)
    if left <= 0 or more <= 0 or found.lower == found.price:
        return taken
    lower = _choice(_permitted(open_options), F.lit(float(found.lower)))
    extra = _picked(
        rows.select("*", at_price.alias("i"), lower.alias("j")).where("i < 0 AND j >= 0"), F.col("j")
    ).orderBy(F.col("value").desc(), "VIN").limit(more)
    order = Window.orderBy(F.col("value").desc(), "VIN")
    paid = F.sum("Cost").over(order.rowsBetween(Window.unboundedPreceding, 0))
    added = extra.withColumn("paid", paid).where(F.col("paid") <= left).drop("paid")
    return taken.unionByName(added)


def with_months(picked, limits=Limits()):
    """Months from desired months: at most so many a month, what does not fit goes to the next free
    slot, those due by age before their deadline. Rows are as many as the budget pays for."""
    size, order = limits.per_month, Window.orderBy("desired", F.col("month_cost").desc(), "VIN")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rank = F.row_number().over(order) - 1
    due = picked.where("forced").withColumn("i", rank)
    total = due.agg(F.count(F.lit(1)).alias("n"))
    pushed = F.col("i") + F.max(F.col("desired") * size - F.col("i")).over(upto)
    latest = size * limits.forced_months - total.scalar() + F.col("i")
    due = materialized(due.withColumn("slot", F.least(pushed, latest)))
    # the slots that are left, at most months times slots
    taken = due.agg(F.collect_list("slot").alias("s")).scalar()
    free = F.array_except(
        F.sequence(F.lit(0), F.lit(size * HORIZON_MONTHS - 1)), taken.cast("array<int>")
    )
    others = picked.where("NOT forced").withColumn("i", rank).withColumn("free", free)
    others = others.withColumn(
        "k", F.size(F.filter("free", lambda s: s < F.col("desired") * size))
    ).withColumn("q", F.col("i") + F.max(F.col("k") - F.col("i")).over(upto))
    others = others.where(F.col("q") < F.size("free")).withColumn(
        "slot", F.element_at("free", (F.col("q") + 1).cast("int"))
    )
    columns = ["VIN", "option", "Cost", F.col("slot").cast("long").alias("slot")]
    return due.select(*columns).unionByName(others.select(*columns)).select(
        "VIN",
        F.floor(F.col("slot") / size).cast("bigint").alias("ReplacementMonth"),
        F.element_at(F.array(*[F.lit(o["type"]) for o in R.OPTIONS]), F.col("option") + 1)
        .alias("ReplacementType"),
        "Cost",
    ).withColumn("Year", R.year_of(F.col("ReplacementMonth")))


def plan(vehicles, limits=Limits()):
    """(schedule, prices) for a fleet."""
    rows = materialized(candidates(vehicles, limits))
    found = search(rows, limits)
    return with_months(chosen(rows, found, limits), limits), found


def status(schedule, vehicles, found, limits=Limits()):
    """One row: whether a schedule that keeps all rules exists, forced vehicles and those missed, how many
    any schedule must miss, what is spent, and the bound below which no schedule's cost can lie."""
    room = max(
        int((limits.budget - o["infrastructure_cost"]) // o["acquisition_cost"]) for o in R.OPTIONS
    )
    room = max(0, min(room, limits.per_month * limits.forced_months))
    timely = schedule.where(F.col("ReplacementMonth") < limits.forced_months).select("VIN")
    due = vehicles.where(F.col("age") >= limits.forced_age)
    missed = due.join(timely, "VIN", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return schedule.agg(
        F.count(F.lit(1)).alias("replaced"), F.coalesce(F.sum("Cost"), F.lit(0.0)).alias("spent")
    ).select(
        F.lit("FEASIBLE" if found.price is not None else "INFEASIBLE").alias("status"),
        F.lit(found.forced).cast("bigint").alias("forced"),
        missed.scalar().alias("forced_missed"),
        F.lit(max(0, found.forced - room)).cast("bigint").alias("forced_unavoidable"),
        "replaced", "spent",
        F.lit(found.price).cast("double").alias("budget_price"),
        F.lit(found.lower_bound).cast("double").alias("lower_bound"),
    )


def save_results(store, vehicles, price, limits=Limits()):
    """The planning job: plan, summarise, and replace the stored result.

    Where no schedule keeps all rules, the heuristic one is summarised, and the method says so. Returns the
    schedule that counts and its status.
    """
    vehicles = materialized(vehicles)
    schedule, found = plan(vehicles, limits)
    method = "LAGRANGIAN"
    if found.price is None:
        schedule, method = R.heuristic_schedule(vehicles), "HEURISTIC"
    schedule = materialized(schedule)
    store.overwrite(R.summary(schedule, price, method), OPTIMIZATION_RESULTS.name)
    return schedule, status(schedule, vehicles, found, limits)
