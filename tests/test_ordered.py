import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillspark.operators.ordered import (
    exact_quantiles,
    row_numbers,
    running_totals,
    scratch,
    tile,
    value_ranks,
)

SMALL = 60  # rows per bucket which forces the bucketed path


@pytest.fixture(scope="module")
def frame(spark):
    """A third of all rows share the value 7.0 and the key 'hot'."""
    rng = random.Random(3)
    rows = [
        (i, "hot" if i % 3 else f"k{rng.randrange(5)}", 7.0 if i % 3 == 0 else round(rng.gauss(0, 5), 2))
        for i in range(2000)
    ]
    return spark.createDataFrame(rows, "id bigint, key string, v double").cache()


@pytest.mark.parametrize("by", [[], ["key"]])
def test_running_totals_equal_a_plain_window(frame, by):
    got = running_totals(
        frame,
        [-F.col("v").cast("decimal(18,2)"), F.col("id")],
        {"at": F.lit(1).cast("bigint"), "run": F.col("v").cast("decimal(18,2)")},
        by,
        SMALL,
    )
    w = W.partitionBy(*by).orderBy(F.desc("v"), "id").rowsBetween(W.unboundedPreceding, 0)
    want = frame.select(
        "id",
        F.count(F.lit(1)).over(w).alias("at"),
        F.sum(F.col("v").cast("decimal(18,2)")).over(w).alias("run"),
    )
    assert sorted(got.select("id", "at", "run").collect()) == sorted(want.collect())
    assert got.columns == [*frame.columns, "at", "run"]


def test_bucketed_plan_sorts_inside_buckets(frame):
    """Rows are exchanged by bucket; only the bucket totals meet in one task."""
    got = row_numbers(frame, [F.col("v"), F.col("id")], rows_per_bucket=SMALL)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_b" in plan
    assert plan.count("Exchange SinglePartition") == 1


@pytest.mark.parametrize("rows,tiles", [(10, 4), (12, 4), (3, 4), (2000, 7)])
def test_tile_equals_ntile(spark, rows, tiles):
    df = spark.range(rows).select((F.col("id") + 1).alias("i"), F.lit(rows).cast("bigint").alias("n"))
    got = df.select("i", tile(F.col("i"), F.col("n"), tiles).alias("t"))
    want = df.select("i", F.ntile(tiles).over(W.orderBy("i")).alias("t"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_average_ranks(frame):
    pdf = frame.toPandas()
    pdf["r"] = pdf["v"].rank()
    want = pdf.groupby("v")["r"].first().to_dict()
    got = {r["v"]: r["average_rank"] for r in value_ranks(frame, "v", rows_per_bucket=SMALL).collect()}
    assert got == want


@pytest.mark.parametrize("size", [SMALL, 1_000_000])
def test_quantiles_equal_numpy(frame, size):
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    pdf = frame.toPandas()
    with scratch():
        got = exact_quantiles(frame, ["v", "id"], probs, ["key"], size).toPandas()
    for (key, column), part in got.groupby(["key", "column"]):
        want = np.quantile(pdf.loc[pdf["key"] == key, column], probs)
        assert part.sort_values("probability")["value"].to_numpy() == pytest.approx(want)


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (4.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).first()["value"] == 2.0
    assert exact_quantiles(df.where("x IS NULL"), ["x"], [0.5]).count() == 0


def test_scratch_releases(frame, spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with scratch():
        exact_quantiles(frame, ["v"], [0.5]).collect()
        assert spark.sparkContext._jsc.getPersistentRDDs().size() > before
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


