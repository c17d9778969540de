"""Safe ratios and the emission expressions built on them."""

from pyspark.sql import functions as F

from ..constants import CO2_KG_PER_LITRE


def divide(numerator, denominator, otherwise=0.0):
    """``numerator / denominator`` with a replacement for a zero or missing denominator."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(otherwise))


def litres_per_100km(litres, km):
    return F.try_divide(litres, km) * 100


def co2_kg(litres):
    return litres * CO2_KG_PER_LITRE


def co2_t(litres):
    return litres * CO2_KG_PER_LITRE / 1000


def relative_change(current, previous):
    """(current - previous) / previous, 0 where there is nothing to compare with."""
    return divide(current - previous, previous)


def unit_price(amount, litres):
    """Price per litre, 0 where no litres were delivered."""
    return F.when(litres > 0, F.try_divide(amount, litres)).otherwise(0.0)
