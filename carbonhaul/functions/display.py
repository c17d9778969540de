"""Text for report cards. Patterns and colours are fixed values of the report."""

from pyspark.sql import functions as F


def tonnes_text(value):
    return F.concat(F.format_number(value, 1), F.lit(" t"))


def euro_text(value, decimals=0):
    return F.concat(F.lit("€"), F.format_number(value, decimals))


def efficiency_text(value):
    return F.concat(F.format_number(value, 1), F.lit(" L/100km"))


def percent_text(value):
    """The value is already in percent."""
    return F.concat(F.format_number(value, 1), F.lit("%"))


def years_text(value):
    return F.concat(F.format_number(value, 1), F.lit(" years"))


def month_text(day):
    return F.date_format(day, "yyyy-MM")


def roi_color(roi):
    return (
        F.when(roi >= 20, "#00B050")
        .when(roi >= 10, "#FFC000")
        .when(roi >= 0, "#FF6600")
        .otherwise("#FF0000")
    )


def compliance_risk(rate):
    """1 low, 2 medium, 3 high, 4 very high."""
    return F.when(rate >= 0.95, 1).when(rate >= 0.90, 2).when(rate >= 0.85, 3).otherwise(4)


def compliance_status(rate):
    return (
        F.when(rate >= 0.95, "✅ Compliant")
        .when(rate >= 0.90, "⚠️ At Risk")
        .otherwise("❌ Non-Compliant")
    )


def parameter_status(ets_price, fuel_price):
    """Whether both selected prices lie inside the slider ranges."""
    valid = ets_price.between(50, 150) & fuel_price.between(1.00, 2.00)
    return F.when(valid, "✅ Valid").otherwise("❌ Invalid Parameters")
