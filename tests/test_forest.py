import numpy as np
import pytest
from pyspark.sql import functions as F

from tillspark.operators import forest


def _brute(x, y, rows, times, settings, depth=0):
    """One tree grown plainly, depth first; returns a predictor."""
    w, least = times, settings["least_rows"]
    mean = np.average(y[rows], weights=w)
    whole = (w * y[rows]).sum() ** 2 / w.sum()
    best = None
    if not settings["depth"] or depth < settings["depth"]:
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for a, b in zip(values, values[1:], strict=False):
                left = x[rows, f] <= a
                if left.sum() < least or (~left).sum() < least:
                    continue
                gain = sum((w[m] * y[rows[m]]).sum() ** 2 / w[m].sum() for m in (left, ~left)) - whole
                if gain > max(1e-12 * max(1.0, whole), best[0] * (1 + 1e-12) if best else 0):
                    best = gain, f, a + (b - a) / 2
    if best is None:
        return lambda v: mean
    _, f, t = best
    left = x[rows, f] <= t
    a = _brute(x, y, rows[left], w[left], settings, depth + 1)
    b = _brute(x, y, rows[~left], w[~left], settings, depth + 1)
    return lambda v: a(v) if v[f] <= t else b(v)


def _frame(spark, x, y, fits):
    rows = [(k, [float(v) for v in a], float(b)) for k in fits for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "fit int, x array<double>, y double").repartition(3)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(160, 3)).round(1)
    return x, np.where(x[:, 0] > 0.3, 4.0, x[:, 1]) + rng.normal(size=160)


def test_trees_equal_brute_force(spark, sample, monkeypatch):
    monkeypatch.setattr(forest, "TREES_PER_TASK", 3)
    x, y = sample
    settings = {0: {"trees": 7, "least_rows": 3}, 1: {"trees": 4, "least_rows": 1, "depth": 4}}
    models = forest.fit_many(_frame(spark, x, y, settings), settings, seed=5)
    order = np.lexsort((y, *x.T[::-1]))
    sx, sy = x[order], y[order]
    points = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "id int, _x array<double>")
    for k, s in settings.items():
        full = {**forest.DEFAULTS, **s}
        want = np.zeros(len(x))
        for t in range(full["trees"]):
            times = np.bincount(np.random.default_rng([5, t]).integers(len(y), size=len(y)), minlength=len(y))
            rows = np.flatnonzero(times)
            told = _brute(sx, sy, rows, times[rows].astype(float), full)
            want += [told(v) for v in x]
        got = [r["p"] for r in points.selectExpr("id", f"{models[k].sql()} AS p").orderBy("id").collect()]
        assert got == pytest.approx(want / full["trees"], rel=1e-9)


def test_some_features_reruns_and_edges(spark, sample):
    x, y = sample
    frame = _frame(spark, x, y, [0])
    a, b = (forest.fit_many(f, {0: {"trees": 5, "features": 0.7}}) for f in (frame, frame.repartition(7)))
    assert a == b and a[0].trees != forest.fit_many(frame, {0: {"trees": 5}})[0].trees
    flat = forest.fit_many(frame.withColumn("y", F.lit(2.0)), {0: {"trees": 3}})[0]
    assert all(t[2] == [-1] and t[4] == [2.0] for t in flat.trees)
    with pytest.raises(ValueError):
        forest.fit_many(frame.where("false"), {0: {}})
