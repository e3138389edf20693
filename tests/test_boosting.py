import numpy as np
import pytest
from pyspark.sql import functions as F

from tillspark.operators import boosting


def _brute(x, y, trees, rate, leaves, l2, least, limits):
    """Leaf-wise boosting written plainly: masks, every threshold of every feature tried."""
    told = np.full(len(y), y.mean())
    for _ in range(trees):
        g = told - y
        parts = [np.ones(len(y), bool)]
        options = [None]

        def best(rows):
            if rows.sum() < 2 * least:
                return None
            whole, found = g[rows].sum() ** 2 / (rows.sum() + l2), None
            for f in range(x.shape[1]):
                gone = rows & np.isnan(x[:, f])
                for missing_left in (False, True) if gone.any() else (False,):
                    for t in [*limits[f], *([np.inf] if gone.any() and not missing_left else [])]:
                        left = rows & ((x[:, f] <= t) | (gone if missing_left else False))
                        right = rows & ~left
                        if left.sum() < least or right.sum() < least:
                            continue
                        gain = (
                            g[left].sum() ** 2 / (left.sum() + l2)
                            + g[right].sum() ** 2 / (right.sum() + l2)
                            - whole
                        )
                        if gain > 1e-9 and (found is None or gain > found[0] * (1 + 1e-10)):
                            found = gain, left, right
            return found

        options = [best(parts[0])]
        while len(parts) < leaves and any(options):
            i = max((i for i, o in enumerate(options) if o), key=lambda i: options[i][0])
            _, left, right = options.pop(i)
            parts.pop(i)
            parts += [left, right]
            options += [best(left), best(right)]
        for rows in parts:
            told[rows] -= rate * g[rows].sum() / (rows.sum() + l2)
    return told


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4)).round(1)
    x[:, 3] = rng.integers(0, 3, 500)
    y = 5 * np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 3] + rng.normal(size=500)
    x[rng.random(500) < 0.2, 2] = np.nan
    y[np.isnan(x[:, 2])] += 4
    return x, y


def _frame(spark, x, y, fits):
    rows = [(k, [float(v) for v in a], float(b)) for k in fits for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "fit int, x array<double>, y double").repartition(4)


@pytest.mark.parametrize("short", [0, 50_000])
def test_fits_equal_brute_force(spark, sample, monkeypatch, short):
    monkeypatch.setattr(boosting, "SHORT_ROWS", short)
    monkeypatch.setattr(boosting, "TREES_KEPT", 3)
    monkeypatch.setattr(boosting, "ROWS_PER_PIECE", 130)
    x, y = sample
    settings = {
        0: {"trees": 8, "rate": 0.1, "leaves": 15, "l2": 10.0},
        1: {"trees": 5, "rate": 0.3, "leaves": 7, "l2": 1.0, "least_rows": 5},
    }
    models = boosting.fit_many(_frame(spark, x, y, settings), settings)
    columns = ["a", "b", "c", "d"]
    rows = spark.createDataFrame(
        [(i, *[None if np.isnan(v) else float(v) for v in a]) for i, a in enumerate(x)],
        "id int, a double, b double, c double, d double",
    )
    for k, s in settings.items():
        full = {**boosting.DEFAULTS, **s}
        limits = [
            [(a + b) / 2 for a, b in zip(u, u[1:], strict=False)]
            for u in ([float(v) for v in np.unique(c[~np.isnan(c)])] for c in x.T)
        ]
        want = _brute(x, y, full["trees"], full["rate"], full["leaves"], full["l2"], full["least_rows"], limits)
        told = rows.select("id", F.array(*columns).alias("_x")).selectExpr("id", f"{models[k].sql()} AS p")
        got = np.array([r["p"] for r in told.orderBy("id").collect()])
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert max(sum(v < 0 for v in t.left) for t in models[k].trees) <= full["leaves"]
        assert len(models[k].trees) == full["trees"]


def test_constant_target_few_rows_and_missing_fits(spark):
    x, y = np.zeros((5, 2)), np.full(5, 3.0)
    model = boosting.fit_many(_frame(spark, x, y, [0]), {0: {"trees": 2}})[0]
    assert model.base == 3.0 and all(len(t.left) == 1 for t in model.trees)
    with pytest.raises(ValueError):
        boosting.fit_many(_frame(spark, x, y, [0]), {1: {"trees": 2}})


def test_many_values_are_binned_by_quantiles(spark):
    rng = np.random.default_rng(1)
    x = rng.random((3000, 1))
    y = (x[:, 0] > 0.5) * 10.0
    model = boosting.fit_many(_frame(spark, x, y, [0]), {0: {"trees": 40, "rate": 0.5, "leaves": 3}}, bins=32)[0]
    assert len(model.limits[0]) <= 31
    told = spark.createDataFrame([([0.1],), ([0.9],)], "_x array<double>").selectExpr(f"{model.sql()} AS p")
    low, high = (r["p"] for r in told.collect())
    assert low < 1 and high > 9
