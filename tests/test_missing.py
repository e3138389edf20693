"""NaN stands for a missing value, as NULL does."""

import pytest
from pyspark.sql import functions as F

from tillspark.operators import checks, profile
from tillspark.operators.ordered import running_totals


@pytest.fixture(scope="module")
def holed(spark):
    rows = [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (float("nan"), 1.0), (4.0, None)]
    return spark.createDataFrame(rows, "x double, y double")


def test_quantiles_and_correlation_leave_nan_out(holed):
    x = holed.where("y IS NOT NULL")
    row = profile.describe(x, ["x"]).first()
    assert row["p50"] == 2.0 and row["p75"] == 2.5
    r = {(c["a"], c["b"]): c["r"] for c in profile.correlations(holed, ["x", "y"]).collect()}
    assert r[("x", "y")] == pytest.approx(1.0)


def test_repeated_country_name_is_a_violation(spark):
    names = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "country_id int, country string")
    found = checks.constraint_violations({"dim_country": names}).where("violations > 0").collect()
    assert [(r["constraint"], r["violations"]) for r in found] == [("country unique", 1)]


def test_small_tables_pass_through_buckets_too(spark):
    frame = spark.range(50).select((F.col("id") * 7 % 50).alias("id"))
    got = running_totals(frame, [F.col("id")], {"upto": F.col("id")}).collect()
    assert {r["id"]: r["upto"] for r in got} == {i: i * (i + 1) // 2 for i in range(50)}
    assert running_totals(frame.where("false"), [F.col("id")], {"n": F.lit(1)}).count() == 0
