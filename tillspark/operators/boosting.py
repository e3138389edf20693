"""Gradient boosting with leaf-wise trees over binned features; many fits advance together.

Every round of growth is one aggregate over all fits: partitions of rows add up gradient sums and
row counts per (fit, node, feature, bin), and the driver, which sees nothing else, picks splits from
these histograms. A tree grows best first: the leaf of largest gain is split next, until there are
enough leaves. So that a round settles more than one split, histograms are also asked for the
children of leaves whose turn may come; the order of splits is not changed by that.

Loss is half the squared error, so a row's second derivative is one. A split's gain is
G_l^2 / (n_l + l2) + G_r^2 / (n_r + l2) - G^2 / (n + l2), a leaf's value -rate * G / (n + l2).
Missing values have a bin of their own, sent to the better side. A short block, such as the days of a
series, is one piece: its rounds need no other task, so each such fit is one task. Predictions so far are kept with
the rows and brought forward every few trees; all of it can be recomputed from the input rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Settings of a fit.
DEFAULTS = {"trees": 150, "rate": 0.1, "leaves": 15, "l2": 10.0, "least_rows": 20}
BINS = 255
#: Rows of one piece of the input, and trees after which predictions are brought forward.
ROWS_PER_PIECE, TREES_KEPT = 100_000, 10
#: Rows up to which a fit is one piece in one task, which then takes all rounds by itself.
SHORT_ROWS = 50_000


@dataclass
class Tree:
    """Nodes as lists; `left` is -1 in a leaf. Rows go left if their bin is at most `bin`."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for values, start in ((self.feature, 0), (self.bin, 0), (self.missing_left, False)):
            values.append(start)
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(0.0)
        return len(self.left) - 1

    def plain(self) -> tuple:
        return tuple(
            np.array(v) for v in (self.feature, self.bin, self.missing_left, self.left, self.right, self.value)
        )


@dataclass(frozen=True)
class Boosted:
    """A fitted sum of trees; `limits` are the thresholds of each feature's bins."""

    base: float
    trees: list[Tree]
    limits: list[list[float]]

    def sql(self) -> str:
        """The prediction as Spark SQL over the array `_x` of the features."""
        trees, missing = [], []
        for t in self.trees:
            edges = [self.limits[f] for f in t.feature]
            # A split after the last bin parts known from missing values.
            at = [e[b] if b < len(e) else float("inf") for e, b in zip(edges, t.bin, strict=True)]
            trees.append((t.feature, at, t.left, t.right, t.value))
            missing.append([int(m) for m in t.missing_left])
        return walk_sql(trees, self.base, missing)


def walk_sql(
    trees: Sequence[tuple[list, list, list, list, list]],
    base: float,
    missing_left: Sequence[list[int]] | None = None,
) -> str:
    """`base` plus the sum of trees (feature, threshold, left, right, value) as SQL over the array `_x`.

    A row goes left if its feature is at most the threshold; missing ones where `missing_left` says,
    else right. A left of -1 marks a leaf.
    """
    told = [
        {
            "f": list(f), "t": ["Infinity" if v == float("inf") else v for v in t], "l": list(left), "r": list(right),
            "v": list(v), "m": missing_left[i] if missing_left else [],
        }
        for i, (f, t, left, right, v) in enumerate(trees)
    ]
    kind = "array<struct<f:array<int>,t:array<double>,l:array<int>,r:array<int>,v:array<double>,m:array<int>>>"
    deepest = max((_depth(left, right) for _, _, left, right, _ in trees), default=0)
    side = "IF(_t.m[_n] = 1, _t.l[_n], _t.r[_n])" if missing_left else "_t.r[_n]"
    step = (
        f"CASE WHEN _t.l[_n] < 0 THEN _n "
        f"WHEN _x[_t.f[_n]] IS NULL OR isnan(_x[_t.f[_n]]) THEN {side} "
        f"WHEN _x[_t.f[_n]] <= _t.t[_n] THEN _t.l[_n] ELSE _t.r[_n] END"
    )
    walk = f"aggregate(sequence(1, {max(1, deepest)}), 0, (_n, _i) -> {step})"
    text = json.dumps(told, separators=(",", ":"))
    return (
        f"aggregate(from_json('{text}', '{kind}'), CAST('{base!r}' AS DOUBLE), (_s, _t) -> _s + _t.v[{walk}])"
    )


def _depth(left: Sequence[int], right: Sequence[int]) -> int:
    depth = [0] * len(left)
    for i, a in enumerate(left):
        if a >= 0:
            depth[a] = depth[right[i]] = depth[i] + 1
    return max(depth, default=0)


def _limits(rows: DataFrame, bins: int) -> dict[int, list[list[float]]]:
    """Thresholds of every fit and feature: midpoints of its values if these are few, else quantiles."""
    values = rows.select("fit", F.posexplode("x").alias("feature", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    few = (
        values.groupBy("fit", "feature", "v")
        .agg(F.count("*").alias("n"))
        .groupBy("fit", "feature")
        .agg(F.count("*").alias("held"))
    )
    shares = [i / bins for i in range(1, bins)]
    many = values.groupBy("fit", "feature").agg(F.percentile_approx("v", shares, 10_000).alias("q"))
    sized = few.join(many, ["fit", "feature"]).collect()  # one row per fit and feature
    narrow = few.where(F.col("held") <= bins).select("fit", "feature")
    each = (
        values.join(narrow, ["fit", "feature"], "left_semi")
        .groupBy("fit", "feature")
        .agg(F.sort_array(F.collect_set("v")).alias("values"))  # at most `bins` each
        .collect()
    )
    held = {(r["fit"], r["feature"]): r["values"] for r in each}
    out: dict[int, dict[int, list[float]]] = {}
    for r in sized:
        known = held.get((r["fit"], r["feature"]))
        if known is not None:
            limits = [a + (b - a) / 2 for a, b in zip(known, known[1:], strict=False)]
        else:
            limits = sorted(set(r["q"]))
        out.setdefault(r["fit"], {})[r["feature"]] = limits
    return out


def _leaf_of(tree: tuple, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
    feature, at_bin, missing_left, left, right, _ = tree
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        inner = left[node] >= 0
        if not inner.any():
            return node
        f = feature[node]
        b = bins[rows, f]
        goes_left = np.where(b == missing[f], missing_left[node], b <= at_bin[node])
        node = np.where(inner, np.where(goes_left, left[node], right[node]), node)


def _pieces(limits: dict[int, list[list[float]]]):
    """Arrow batches to rows (fit, n, bins, y): one for each fit in a batch."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fit, part in batch.groupby("fit"):
                x = np.stack([np.array(v, np.float64) for v in part["x"]])
                bins = np.empty(x.shape, np.uint16)
                for f, edges in enumerate(limits[fit]):
                    known = ~np.isnan(x[:, f])
                    bins[:, f] = np.where(known, np.searchsorted(edges, x[:, f], side="left"), len(edges) + 1)
                y = part["y"].to_numpy(np.float64)
                yield pd.DataFrame(
                    {"fit": [fit], "n": [len(y)], "bins": [bins.tobytes()], "y": [y.tobytes()]}
                )

    return cut


class _Growing:
    """The tree of one fit which grows now; histograms are (features x bins, 2): gradients, rows."""

    def __init__(self, settings: dict, widths: np.ndarray):
        self.settings, self.widths = settings, widths
        self.first = np.concatenate(([0], np.cumsum(widths)))
        self.trees: list[Tree] = []
        self.begin()

    def begin(self) -> None:
        self.tree = Tree()
        self.held: dict[int, np.ndarray] = {}
        self.split: dict[int, tuple | None] = {}
        self.parent: dict[int, tuple[int, int]] = {}  # child: (parent, sibling)
        self.leaves = [self.tree.add()]
        self.made: dict[int, tuple[int, int]] = {}
        self.grown = False

    def best_split(self, held: np.ndarray) -> tuple | None:
        """(gain, feature, bin, missing goes left) of the first best split, or None."""
        l2, least = self.settings["l2"], self.settings["least_rows"]
        best = None
        g_all, n_all = held[: self.widths[0]].sum(axis=0)
        if n_all < 2 * least:
            return None
        whole = g_all * g_all / (n_all + l2)
        for f in range(len(self.widths)):
            part = held[self.first[f] : self.first[f + 1]]
            gone, known = part[-1], np.cumsum(part[:-1], axis=0)
            for missing_left in (False, True) if gone[1] > 0 else (False,):
                left = known + gone if missing_left else known
                if not missing_left and gone[1] == 0:
                    left = left[:-1]
                g, n = left[:, 0], left[:, 1]
                rest = n_all - n
                allowed = (n >= least) & (rest >= least)
                if not allowed.any():
                    continue
                gain = np.where(
                    allowed, g * g / (n + l2) + (g_all - g) ** 2 / (np.maximum(rest, 0) + l2) - whole, -np.inf
                )
                at = int(gain.argmax())
                # Sums come in any order of partitions: gains equal up to rounding count as equal.
                if gain[at] > 1e-12 * max(1.0, abs(whole)) and (best is None or gain[at] > best[0] * (1 + 1e-10)):
                    best = float(gain[at]), f, at, missing_left
        return best

    def _children(self, node: int) -> tuple[int, int]:
        if node not in self.made:
            _, f, at, missing_left = self.split[node]
            tree = self.tree
            a, b = tree.add(), tree.add()
            tree.feature[node], tree.bin[node], tree.missing_left[node] = f, at, missing_left
            tree.left[node], tree.right[node] = a, b
            self.made[node] = a, b
            self.parent[a], self.parent[b] = (node, b), (node, a)
        return self.made[node]

    def wanted(self) -> list[int]:
        """Split leaves as far as is known; nodes whose histograms are needed next, none at the end."""
        most = self.settings["leaves"]
        while len(self.leaves) < most and all(n in self.split for n in self.leaves):
            able = [n for n in self.leaves if self.split[n]]
            if not able:
                break
            node = max(able, key=lambda n: (self.split[n][0], -n))
            self.leaves.remove(node)
            self.leaves += self._children(node)
        ask = [n for n in self.leaves if n not in self.split]
        if len(self.leaves) >= most or not ask:
            self.grown = True
            return []
        able = sorted((n for n in self.leaves if self.split.get(n)), key=lambda n: -self.split[n][0])
        for node in able[: most - len(self.leaves)]:
            ask += [c for c in self._children(node) if c not in self.split]
        # Of two siblings one is counted, the other is what their parent has besides.
        return [n for n in ask if n not in self.parent or n < self.parent[n][1]]

    def learn(self, nodes: list[int], counted: np.ndarray) -> None:
        for node, held in zip(nodes, counted, strict=True):
            pair = [(node, held)]
            if node in self.parent:
                up, other = self.parent[node]
                pair.append((other, self.held[up] - held))
            for n, h in pair:
                self.held[n], self.split[n] = h, self.best_split(h)

    def finish(self) -> Tree:
        """The grown tree: leaves get their values, nodes which were only looked at go."""
        grown, out, place = set(self.leaves), Tree(), {}
        stack = [(0, out.add())]
        l2, rate = self.settings["l2"], self.settings["rate"]
        while stack:
            node, at = stack.pop()
            place[node] = at
            if node in grown:
                held = self._sums(node)
                out.value[at] = float(-rate * held[0] / (held[1] + l2))
                continue
            old = self.tree
            out.feature[at], out.bin[at], out.missing_left[at] = old.feature[node], old.bin[node], bool(old.missing_left[node])
            out.left[at], out.right[at] = out.add(), out.add()
            stack += [(old.left[node], out.left[at]), (old.right[node], out.right[at])]
        self.trees.append(out)
        self.begin()
        return out

    def _sums(self, node: int) -> np.ndarray:
        if node in self.held:
            return self.held[node][: self.widths[0]].sum(axis=0)
        # A leaf made by the last split has no histogram of its own: its parent's split tells its sums.
        up, _ = self.parent[node]
        _, f, at, missing_left = self.split[up]
        part = self.held[up][self.first[f] : self.first[f + 1]]
        left = part[: at + 1].sum(axis=0) + (part[-1] if missing_left else 0)
        return left if node == self.tree.left[up] else part.sum(axis=0) - left


def fit_many(rows: DataFrame, settings: dict[int, dict], bins: int = BINS) -> dict[int, Boosted]:
    """Fit one model for each key of `settings` on the rows (fit int, x array<double>, y double) of it.

    Missing elements of `x` may be null or NaN; rows without `y` are left out. Fits may differ in rows, number of
    features and settings, and advance in the same jobs. A fit without rows raises ValueError.
    """
    wanted = {k: {**DEFAULTS, **v} for k, v in settings.items()}
    rows = rows.where("y IS NOT NULL").select("fit", "x", F.col("y").cast("double").alias("y"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    state = None
    try:
        sizes = {
            r["fit"]: r
            for r in rows.groupBy("fit").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.max(F.size("x")).alias("d")).collect()
        }
        if wanted.keys() - sizes.keys():
            raise ValueError(f"no rows for the fits {sorted(wanted.keys() - sizes.keys())}")
        found = _limits(rows, bins)
        limits = {k: [found.get(k, {}).get(f, []) for f in range(sizes[k]["d"])] for k in wanted}
        widths = {k: np.array([len(v) + 2 for v in of]) for k, of in limits.items()}
        base = {k: float(sizes[k]["mean"]) for k in wanted}
        missing = {k: w - 1 for k, w in widths.items()}
        short = {k for k in wanted if sizes[k]["n"] <= SHORT_ROWS}
        finished: dict[int, Boosted] = _short_fits(rows, wanted, short, limits, widths, base)
        wanted = {k: s for k, s in wanted.items() if k not in short}
        if not wanted:
            return finished
        pieces = max(1, max(-(-sizes[k]["n"] // ROWS_PER_PIECE) for k in wanted))
        cut = (
            rows.where(F.col("fit").isin(list(wanted)))
            .repartition(len(wanted) * pieces, "fit", F.pmod(F.xxhash64("x", "y"), F.lit(pieces)))
            .mapInPandas(_pieces(limits), "fit int, n long, bins binary, y binary")
        )
        d = {k: len(v) for k, v in limits.items()}

        def opened(row) -> tuple:
            bin_ = np.frombuffer(row["bins"], np.uint16).reshape(row["n"], d[row["fit"]])
            y = np.frombuffer(row["y"], np.float64)
            return row["fit"], bin_, y, np.full(len(y), base[row["fit"]])

        state = cut.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
        growing = {k: _Growing(wanted[k], widths[k]) for k in wanted}
        recent: dict[int, list[tuple]] = {k: [] for k in wanted}
        parts = state.getNumPartitions()
        while growing:
            asked = {k: g.wanted() for k, g in growing.items() if not g.grown}
            asked = {k: nodes for k, nodes in asked.items() if nodes}
            if asked:
                trees = {k: growing[k].tree.plain() for k in asked}
                count = _counter(asked, trees, {k: recent[k] for k in asked}, widths, missing)
                sums = state.mapPartitions(count).treeReduce(_added, 1 if parts <= 64 else 2)
                for k, nodes in asked.items():
                    growing[k].learn(nodes, sums[k])
                continue
            for k, g in growing.items():  # all have grown their tree
                recent[k].append(g.finish().plain())
            if max(len(v) for v in recent.values()) >= TREES_KEPT:
                ahead = state.map(_forward(recent, missing)).persist(StorageLevel.MEMORY_AND_DISK)
                ahead.count()
                state.unpersist()
                state, recent = ahead, {k: [] for k in wanted}
            done = {k: g for k, g in growing.items() if len(g.trees) >= wanted[k]["trees"]}
            finished.update({k: Boosted(base[k], g.trees, limits[k]) for k, g in done.items()})
            growing = {k: g for k, g in growing.items() if k not in done}
        return finished
    finally:
        rows.unpersist()
        if state is not None:
            state.unpersist()


def _short_fits(
    rows: DataFrame, wanted: dict, short: set[int], limits: dict, widths: dict, base: dict
) -> dict[int, Boosted]:
    """Fits of one piece each, side by side in tasks of their own."""
    if not short:
        return {}
    cut, missing = _pieces(limits), {k: w - 1 for k, w in widths.items()}

    def grown(block: pd.DataFrame) -> pd.DataFrame:
        fit = int(block["fit"].iloc[0])
        # In one order, so that a retried task adds up alike.
        x = np.stack([np.array(v, np.float64) for v in block["x"]])
        block = block.iloc[np.lexsort((block["y"].to_numpy(np.float64), *np.nan_to_num(x, nan=np.inf).T[::-1]))]
        [piece] = [p.iloc[0] for p in cut(iter([block]))]
        bins = np.frombuffer(piece["bins"], np.uint16).reshape(len(block), -1)
        y = np.frombuffer(piece["y"], np.float64)
        told, growing = np.full(len(y), base[fit]), _Growing(wanted[fit], widths[fit])
        while len(growing.trees) < wanted[fit]["trees"]:
            nodes = growing.wanted()
            if nodes:
                count = _counter({fit: nodes}, {fit: growing.tree.plain()}, {fit: []}, widths, missing)
                growing.learn(nodes, next(count(iter([(fit, bins, y, told)])))[fit])
            else:
                told = _with_trees(fit, bins, told, [growing.finish().plain()], missing)
        trees = growing.trees
        return pd.DataFrame(
            {
                "fit": fit,
                "tree": range(len(trees)),
                **{c: [getattr(t, c) for t in trees] for c in TREE_COLUMNS},
            }
        )

    kinds = dict(zip(TREE_COLUMNS, ("int", "int", "boolean", "int", "int", "double"), strict=True))
    found = (
        rows.where(F.col("fit").isin(list(short)))
        .repartition(len(short), "fit")
        .groupBy("fit")
        .applyInPandas(grown, "fit int, tree int, " + ", ".join(f"`{c}` array<{k}>" for c, k in kinds.items()))
        .collect()  # the models themselves
    )
    out = {}
    for k in short:
        own = sorted((r for r in found if r["fit"] == k), key=lambda r: r["tree"])
        out[k] = Boosted(base[k], [Tree(*[list(r[c]) for c in TREE_COLUMNS]) for r in own], limits[k])
    return out


TREE_COLUMNS = ("feature", "bin", "missing_left", "left", "right", "value")


def _with_trees(fit: int, bins: np.ndarray, told: np.ndarray, trees: list[tuple], missing: dict) -> np.ndarray:
    for tree in trees:
        told = told + tree[5][_leaf_of(tree, bins, missing[fit])]
    return told


def _forward(recent: dict[int, list[tuple]], missing: dict[int, np.ndarray]):
    def step(piece: tuple) -> tuple:
        fit, bins, y, told = piece
        return fit, bins, y, _with_trees(fit, bins, told, recent[fit], missing)

    return step


def _counter(asked: dict, trees: dict, recent: dict, widths: dict, missing: dict):
    """Partition to {fit: (nodes, features x bins, 2)}: gradient sums and rows."""

    def count(pieces: Iterator[tuple]) -> Iterator[dict]:
        out: dict[int, np.ndarray] = {}
        for fit, bins, y, told in pieces:
            if fit not in asked:
                continue
            gradient = _with_trees(fit, bins, told, recent[fit], missing) - y
            slot = np.full(len(trees[fit][3]), -1)
            width = int(widths[fit].sum())
            leaf = _leaf_of(trees[fit], bins, missing[fit])
            nodes = asked[fit]
            slot[nodes] = np.arange(len(nodes))
            at = slot[leaf]
            inside = at >= 0
            offset = np.cumsum(widths[fit]) - widths[fit]
            place = (at[inside, None] * width + offset + bins[inside]).ravel()
            weight = np.repeat(gradient[inside], bins.shape[1])
            size = len(nodes) * width
            sums = np.stack(
                (np.bincount(place, weight, size), np.bincount(place, minlength=size)), axis=1
            ).reshape(len(nodes), width, 2)
            out[fit] = out[fit] + sums if fit in out else sums
        yield out

    return count


def _added(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}
