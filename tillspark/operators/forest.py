"""Random forests of short training blocks: trees are dealt over tasks, each grows some level by level.

A block of daily rows is short whatever the size of the sales lines behind it, so a task can hold
one: every task gets a block and a few tree numbers, draws the bootstrap sample of each tree from its
number, and grows its trees together. Splits are exact: of all midpoints between neighbouring values
of a node the one which lowers the squared error most. Depth is unlimited unless stated. Blocks of
more than `MOST_ROWS` rows are refused; those are for Spark's own forest, which shuffles histograms.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.operators.boosting import walk_sql

#: Settings of a fit; `features` is the share of features which a split looks at, depth 0 is unlimited.
DEFAULTS = {"trees": 180, "least_rows": 3, "depth": 0, "features": 1.0}
#: Rows of a block which one task holds, and trees grown by a task.
MOST_ROWS, TREES_PER_TASK = 50_000, 10


@dataclass(frozen=True)
class Forest:
    """Trees as parallel lists (feature, threshold, left, right, value); left is -1 in a leaf."""

    trees: list[tuple[list, list, list, list, list]]

    def sql(self) -> str:
        """The mean of the trees as Spark SQL over the array `_x`; a missing element goes right."""
        return f"({walk_sql(self.trees, 0.0)}) / {len(self.trees)}D"


def grow(x: np.ndarray, y: np.ndarray, numbers: Sequence[int], settings: dict, seed: int) -> list[tuple]:
    """Trees of the given numbers on bootstrap samples of the rows."""
    n, d = x.shape
    rank = np.empty((n, d), np.int64)
    for f in range(d):
        rank[:, f] = np.unique(x[:, f], return_inverse=True)[1]
    rngs = [np.random.default_rng([seed, t]) for t in numbers]
    drawn = [np.bincount(r.integers(n, size=n), minlength=n) for r in rngs]
    row = np.concatenate([np.flatnonzero(c) for c in drawn])
    times = np.concatenate([c[c > 0] for c in drawn]).astype(np.float64)
    tree = np.repeat(np.arange(len(numbers)), [(c > 0).sum() for c in drawn])
    trees = [([0], [0.0], [-1], [-1], [0.0]) for _ in numbers]
    node, weighted = tree.copy(), times * y[row]
    names = [(t, 0) for t in range(len(numbers))]  # of the open nodes: tree and place in it
    depth, least = 0, settings["least_rows"]
    looked = max(1, int(settings["features"] * d))
    while len(row):
        held = np.bincount(node, minlength=len(names))
        mass = np.bincount(node, times, len(names))
        total = np.bincount(node, weighted, len(names))
        for (t, at), v in zip(names, (total / mass).tolist(), strict=True):
            trees[t][4][at] = v
        if settings["depth"] and depth >= settings["depth"]:
            break
        best = np.full(len(names), 1e-12 * np.maximum(1.0, total * total / mass))
        feature, threshold = np.full(len(names), -1), np.zeros(len(names))
        admitted = None
        if looked < d:
            admitted = np.zeros((len(names), d), bool)
            for i, (t, _) in enumerate(names):
                admitted[i, rngs[t].permutation(d)[:looked]] = True
        starts = np.concatenate(([0], np.cumsum(held)[:-1]))
        for f in range(d):
            order = np.argsort(node * n + rank[row, f])
            own, r = node[order], rank[row[order], f]
            w, s = np.cumsum(times[order]), np.cumsum(weighted[order])
            base_w, base_s = w[starts] - times[order[starts]], s[starts] - weighted[order[starts]]
            w, s = w - base_w[own], s - base_s[own]
            place = np.arange(len(order)) - starts[own] + 1
            fits = (place >= least) & (held[own] - place >= least)
            fits[:-1] &= (own[1:] == own[:-1]) & (r[1:] != r[:-1])
            fits[-1] = False
            if admitted is not None:
                fits &= admitted[own, f]
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            o = own[at]
            gain = s[at] ** 2 / w[at] + (total[o] - s[at]) ** 2 / (mass[o] - w[at]) - total[o] ** 2 / mass[o]
            firsts = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
            top = np.maximum.reduceat(gain, firsts)
            # The first place of the greatest gain within its node.
            hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(firsts, len(o)))))
            hit = hit[np.unique(o[hit], return_index=True)[1]]
            better = gain[hit] > best[o[hit]] * (1 + 1e-12)
            hit = hit[better]
            which = o[hit]
            best[which], feature[which] = gain[hit], f
            low, high = x[row[order[at[hit]]], f], x[row[order[at[hit] + 1]], f]
            threshold[which] = low + (high - low) / 2
        opened, child = [], np.full((len(names), 2), -1)
        for i in np.flatnonzero(feature >= 0).tolist():
            t, at = names[i]
            of = trees[t]
            for side in (0, 1):
                child[i, side] = len(opened)
                opened.append((t, len(of[0])))
                for values, start in zip(of, (0, 0.0, -1, -1, 0.0), strict=True):
                    values.append(start)
            of[0][at], of[1][at] = int(feature[i]), float(threshold[i])
            of[2][at], of[3][at] = len(of[0]) - 2, len(of[0]) - 1
        go = feature[node] >= 0
        row, times, weighted, node = row[go], times[go], weighted[go], node[go]
        if len(row):
            right = x[row, feature[node]] > threshold[node]
            node = child[node, right.astype(int)]
        names = opened
        depth += 1
    return trees


def fit_many(rows: DataFrame, settings: dict[int, dict], seed: int = 42) -> dict[int, Forest]:
    """Fit one forest for each key of `settings` on the rows (fit int, x array<double>, y double) of it.

    All trees of all fits are dealt over tasks of TREES_PER_TASK trees. Rows without `y` are left out;
    elements of `x` must not be missing. Fits without rows, or with more than MOST_ROWS, raise ValueError.
    A tree depends on the rows in the order of (x, y), its number and the seed only.
    """
    wanted = {k: {**DEFAULTS, **v} for k, v in settings.items()}
    rows = rows.where("y IS NOT NULL").select("fit", "x", F.col("y").cast("double").alias("y"))
    sizes = {r["fit"]: r["count"] for r in rows.groupBy("fit").count().collect()}
    for k in wanted:
        if not 0 < sizes.get(k, 0) <= MOST_ROWS:
            raise ValueError(f"fit {k} has {sizes.get(k, 0)} rows; 1 to {MOST_ROWS} can be fitted")
    tasks = [
        (k, first)
        for k, s in sorted(wanted.items(), key=lambda i: -sizes[i[0]])
        for first in range(0, s["trees"], TREES_PER_TASK)
    ]
    listed = rows.sparkSession.createDataFrame(
        [(i, k, first) for i, (k, first) in enumerate(tasks)], "task int, fit int, first int"
    )

    def planted(block: pd.DataFrame) -> pd.DataFrame:
        fit, first = int(block["fit"].iloc[0]), int(block["first"].iloc[0])
        x = np.stack(block["x"].to_list()).astype(np.float64)
        y = block["y"].to_numpy(np.float64)
        order = np.lexsort((y, *x.T[::-1]))
        s = wanted[fit]
        numbers = range(first, min(first + TREES_PER_TASK, s["trees"]))
        trees = grow(x[order], y[order], numbers, s, seed)
        return pd.DataFrame(
            {
                "fit": fit,
                "tree": list(numbers),
                **{c: [t[i] for t in trees] for i, c in enumerate("ftlrv")},
            }
        )

    grown = (
        rows.join(F.broadcast(listed), "fit")  # one row for each task
        .repartition(len(tasks), "task")
        .groupBy("task")
        .applyInPandas(
            planted, "fit int, tree int, f array<int>, t array<double>, l array<int>, r array<int>, v array<double>"
        )
        .collect()  # the forests themselves
    )
    out: dict[int, Forest] = {}
    for k in wanted:
        own = sorted((r for r in grown if r["fit"] == k), key=lambda r: r["tree"])
        out[k] = Forest([(r["f"], r["t"], r["l"], r["r"], r["v"]) for r in own])
    return out
