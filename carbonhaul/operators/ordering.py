"""Ranks and exact quantiles over groups of any size.

A window without (or with a coarse) partition sorts a whole group in one task. Here equal values
collapse to a count first, the distinct values are range partitioned, and every range is ranked on
its own; the totals of the ranges before it arrive through a small join.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialized


def positions(df, value, by=(), descending=False):
    """Distinct values with ``n`` (rows holding the value) and ``before`` (rows ordered ahead).

    NULL values take no position.
    """
    by = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n")
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range numbers must be the same in the two uses below.
    ranged = materialized(
        counted.repartitionByRange(ranges, *by, order).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    # at most one row per range and group boundary
    totals = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *by, "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = ranged.withColumn("_ahead", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return _join(placed, offsets, by, ["_range"], "inner").select(
        *by, value, "n", (F.col("_ahead") + F.col("_offset")).alias("before")
    )


def _join(left, right, by, on, how):
    """Equi-join on group columns, where NULL is a group too, and on others, where it is not."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in (*by, *on) else F.col(c)
                           for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    same += [F.col(c) == F.col(f"_r_{c}") for c in on]
    return left.join(other, reduce(lambda a, b: a & b, same), how).drop(
        *[f"_r_{c}" for c in (*by, *on)]
    )


def rank(df, value, by=(), descending=True, name="rank"):
    """Competition rank (ties share a rank, the next one skips) of every row; NULL values keep
    their rows and get no rank.

    ``df`` is expected to be an aggregate; it is computed once and kept.
    """
    by = list(by)
    df = materialized(df)
    ranked = positions(df, value, by, descending).select(
        *by, value, (F.col("before") + 1).alias(name)
    )
    return _join(df, ranked, by, [value], "left").select(*df.columns, name)


def median(df, value):
    """Exact median as a one-row frame: the mean of the one or two middle values."""
    placed = positions(df, value)
    total = placed.agg(F.sum("n").alias("total"))
    size = total.scalar()
    low = F.floor((size - 1) / 2)
    high = F.floor(size / 2)

    def at(place):
        return F.max(
            F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")),
                   F.col(value))
        )

    return (
        placed.select("*", low.alias("_low"), high.alias("_high"))
        .agg(((at(F.col("_low")) + at(F.col("_high"))) / 2).alias("median"))
    )
