"""Investment arithmetic on columns."""

from pyspark.sql import functions as F

from ..constants import DISCOUNT_RATE, NEVER_PAYS_BACK


def discount_factor(year, rate=DISCOUNT_RATE):
    return F.pow(F.lit(1 + rate), -year)


def npv(cash_flows, rate=DISCOUNT_RATE):
    """Net present value of an array whose first element falls due today."""
    return F.aggregate(
        F.transform(cash_flows, lambda flow, year: flow * discount_factor(year, rate)),
        F.lit(0.0),
        lambda total, flow: total + flow,
    )


def level_cash_flows(investment, annual_saving, years):
    """[-investment, saving, saving, ...] over ``years`` years."""
    return F.concat(
        F.array(-investment.cast("double")),
        F.array_repeat(annual_saving.cast("double"), years),
    )


def payback_years(investment, annual_saving):
    return F.when(annual_saving > 0, investment / annual_saving).otherwise(NEVER_PAYS_BACK)


def roi_percent(net_value, investment):
    return F.when(investment > 0, net_value / investment * 100).otherwise(0.0)
