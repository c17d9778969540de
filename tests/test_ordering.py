"""Distributed ranks and medians against pandas, with a value held by a third of the rows."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carbonhaul.operators import ordering


def skewed(spark, n=3000):
    return spark.range(n).select(
        "id",
        (F.col("id") % 4).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(
            (F.col("id") * 7919 % 1009).cast("double")
        ).alias("v"),
    )


def test_rank_within_groups(spark):
    df = skewed(spark)
    got = ordering.rank(df, "v", by=["g"]).toPandas().sort_values("id")
    want = df.toPandas().sort_values("id")
    want["rank"] = want.groupby("g")["v"].rank(method="min", ascending=False).astype(int)
    assert got["rank"].tolist() == want["rank"].tolist()


def test_rank_uses_no_unpartitioned_window(spark, explain):
    text = explain(ordering.rank(skewed(spark), "v"))
    # the only single-partition window runs over one row per range
    assert text.count("SinglePartition") <= 1
    assert "Python" not in text


def test_null_groups_are_ranked_and_null_values_kept(spark):
    df = spark.createDataFrame(
        [(None, 5.0), (None, 7.0), ("a", None), ("a", 1.0)], "g string, v double"
    )
    got = {(r["g"], r["v"]): r["rank"] for r in ordering.rank(df, "v", by=["g"]).collect()}
    assert got == {(None, 5.0): 2, (None, 7.0): 1, ("a", None): None, ("a", 1.0): 1}


@settings(max_examples=10, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5).map(float), min_size=1, max_size=30))
def test_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert ordering.median(df, "v").first()[0] == pytest.approx(pd.Series(values).median())
