import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.data import as_dict, daily_frame
from tillspark.functions.tails import incomplete_beta
from tillspark.operators import checks, eda, outliers, profile, resampling, stats
from tillspark.operators.ordered import exact_quantiles

RNG = np.random.default_rng(11)
A = np.round(RNG.gamma(2, 50, 60), 1)
B = np.concatenate([np.round(RNG.gamma(2, 60, 45), 1), A[:20]])  # ties across the groups


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(f"c{i}", float(v), i < len(A), i % 9) for i, v in enumerate([*A, *B])]
    return spark.createDataFrame(
        rows, "customer_id string, average_order double, inside boolean, orders int"
    ).cache()


def test_incomplete_beta_closed_forms():
    assert incomplete_beta(1, 1, 0.3) == pytest.approx(0.3)
    assert incomplete_beta(2, 1, 0.3) == pytest.approx(0.09)
    assert incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)
    # one degree of freedom is the Cauchy distribution
    assert incomplete_beta(0.5, 0.5, 1 / (1 + 0.25)) == pytest.approx(1 - 2 * math.atan(0.5) / math.pi)


def test_welch_against_numpy(groups):
    got = as_dict(stats.welch(groups, "average_order"))
    va, vb = A.var(ddof=1) / len(A), B.var(ddof=1) / len(B)
    assert got["statistic"] == pytest.approx((A.mean() - B.mean()) / math.sqrt(va + vb))
    assert got["degrees"] == pytest.approx(
        (va + vb) ** 2 / (va**2 / (len(A) - 1) + vb**2 / (len(B) - 1))
    )
    assert 0 < got["p_value"] < 1


def test_mann_whitney_against_all_pairs(groups):
    got = as_dict(stats.mann_whitney(groups, "average_order", rows_per_bucket=20))
    u = sum((x > y) + 0.5 * (x == y) for x in A for y in B)
    assert got["statistic"] == pytest.approx(u)
    values, counts = np.unique([*A, *B], return_counts=True)
    n, ties = len(A) + len(B), (counts**3 - counts).sum()
    sd = math.sqrt(len(A) * len(B) / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, len(A) * len(B) - u) - len(A) * len(B) / 2 - 0.5) / sd
    assert got["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert got["rank_biserial"] == pytest.approx(2 * u / len(A) / len(B) - 1)


def test_holm(spark):
    p = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "i int, p_value double")
    got = [r["holm_p"] for r in stats.holm(p).orderBy("i").collect()]
    assert got == pytest.approx([0.03, 0.06, 0.06])


def test_bootstrap_interval_properties(groups):
    one, two = (
        as_dict(resampling.bootstrap_difference(df, "average_order", F.col("inside"), 400))
        for df in (groups, groups.repartition(5))
    )
    assert one["low"] == pytest.approx(two["low"]) and one["high"] == pytest.approx(two["high"])
    center = A.mean() - B.mean()
    spread = math.sqrt(A.var() / len(A) + B.var() / len(B))
    assert one["low"] < center < one["high"]
    assert (one["high"] - one["low"]) / (2 * 1.96 * spread) == pytest.approx(1, abs=0.2)


def _hash(x):
    x &= resampling.WORD
    for _ in range(2):
        x = ((x >> 16 ^ x) * resampling.MULTIPLIER) & resampling.WORD
    return x >> 16 ^ x


def _stream(seed, *parts):
    h = _hash(seed)
    for part in parts:
        h = _hash(h + part)
    return h, _hash(h + 1) | 1


def _plain_sum(values, g, rep, seed, bits, chunk):
    """One repetition in plain Python: blocks are counted, then drawn from."""
    values, n, quota, total = sorted(values), len(values), {}, 0.0
    for i in range(n):
        base, step = _stream(seed, g, rep, i // chunk)
        u = _hash(base + (i % chunk + 1) * step)
        b = ((u << 31) + (_hash(u + base) >> 1)) % n >> bits
        quota[b] = quota.get(b, 0) + 1
    for b, m in quota.items():
        base, step = _stream(seed + 1, g, rep, b)
        part = values[b << bits : b + 1 << bits]
        total += sum(part[_hash(base + i * step) * len(part) >> 32] for i in range(1, m + 1))
    return total


def test_draws_equal_plain_python_over_many_blocks(groups, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_BITS", 4)
    monkeypatch.setattr(resampling, "DRAWS_PER_STREAM", 10)
    got = resampling.resampled_sums(groups, "average_order", F.col("inside"), 20, 7, 15).collect()
    assert len(got) == 40
    for r in got:
        values = A if r["g"] else B
        assert r["n"] == len(values)
        want = _plain_sum(values.tolist(), r["g"], r["rep"], 7, 4, 10)
        assert r["total"] == pytest.approx(want)


def test_draws_are_even_and_independent(spark):
    df = resampling.draw(resampling.stream(spark.range(40_000), 42, "id"), "u", "id")
    u = F.col("u") / F.lit(2.0**32)
    mean, var, lag = df.agg(F.avg(u), F.var_pop(u), F.corr(u, F.col("id").cast("double"))).first()
    assert mean == pytest.approx(0.5, abs=0.01) and var == pytest.approx(1 / 12, abs=0.003)
    assert abs(lag) < 0.02


def test_bootstrap_of_missing_values_and_copies(spark):
    schema = "average_order double, inside boolean"
    rows = [(5.0, True)] * 5000 + [(None, True), (float("nan"), False), (9.0, None)]
    copies = spark.createDataFrame(rows + [(2.0, False)] * 40, schema)
    got = as_dict(resampling.bootstrap_difference(copies, "average_order", F.col("inside"), 30))
    assert got == {"low": 3.0, "high": 3.0, "repetitions": 30}
    for part in (copies.where("inside"), copies.where("false")):
        lone = as_dict(resampling.bootstrap_difference(part, "average_order", F.col("inside"), 30))
        assert lone == {"low": None, "high": None, "repetitions": 0}


def test_block_bootstrap(spark):
    daily = daily_frame(spark, 60)
    got = as_dict(resampling.block_bootstrap_mean(daily, 200, 7))
    assert got["repetitions"] == 200 and got["low"] < 129.5 < got["high"]
    flat = daily.withColumn("gross_sales", F.lit(5.0))
    same = as_dict(resampling.block_bootstrap_mean(flat, 20, 7))
    assert same["low"] == same["high"] == 5
    with pytest.raises(checks.CheckFailed):
        resampling.block_bootstrap_mean(daily.limit(3), 10, 7)


def test_small_groups_are_refused(spark):
    few = spark.createDataFrame([("a", 1, "X"), ("b", 1, "Y")], "customer_id string, countries int, country string")
    with pytest.raises(checks.CheckFailed):
        stats.require_group_sizes(few, "X")


def test_spearman_against_ranks(groups):
    pdf = groups.toPandas()
    want = np.corrcoef(pdf["orders"].rank(), pdf["average_order"].rank())[0, 1]
    rows = eda.spearman(groups, ["orders", "average_order"], rows_per_bucket=30).collect()
    got = {(r["a"], r["b"]): r["r"] for r in rows}
    assert got["orders", "average_order"] == pytest.approx(want)
    assert got["orders", "orders"] == 1.0 and len(got) == 4


def test_autocorrelation_of_a_line_is_one(spark):
    rows = eda.autocorrelation(daily_frame(spark, 60)).collect()
    assert [r["r"] for r in rows] == pytest.approx([1.0] * 4)


def test_outlier_flags_are_off_without_spread(spark):
    df = spark.createDataFrame([(i, 3.0) for i in range(20)] + [(20, None)], "id int, x double")
    flags = outliers.outlier_flags(df, ["x"], outliers.limits(df, ["x"]))
    rows = {r["method"]: r["rows"] for r in outliers.outlier_summary(flags, ["x"]).collect()}
    assert rows == {"iqr": 0, "zscore": 0, "mad": 0, "percentile": 0, "nonfinite": 1}


def test_outlier_limits_per_group(spark):
    rows = [("a", float(i)) for i in range(10)] + [("b", 100.0 + i) for i in range(10)] + [("b", 9000.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    flags = outliers.outlier_flags(df, ["x"], outliers.limits(df, ["x"], ["k"]), ["k"])
    assert [r["x"] for r in flags.where("x_iqr").collect()] == [9000.0]


def test_all_missing_column_profile(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    found = {r["column"]: r for r in profile.missing_summary(df).collect()}
    assert found["x"]["missing_pct"] == 100 and found["x"]["unique_count"] == 0
    assert exact_quantiles(df, ["x"], [0.5]).count() == 0


def test_moments_match_the_corrected_formulas(spark):
    x = np.array([1.0, 2, 4, 8, 16, 31])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = profile.moments(df, ["x"]).first()
    n, d = len(x), x - x.mean()
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    assert got["skewness"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    g2 = (d**4).mean() / (d**2).mean() ** 2 - 3
    assert got["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def test_top_categories_count_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "t string")
    rows = profile.top_categories(profile.value_counts(df), ["t"], 2).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in rows] == [("a", 2), (None, 1)]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("line_id"))
    picks = [
        {r[0] for r in profile.hashed_sample(d, "line_id", 20).collect()}
        for d in (df, df.repartition(7))
    ]
    assert picks[0] == picks[1] and len(picks[0]) == 20
