"""Mixing sources to target weights by entropy balancing.

Among all document rates which give every source its target of tokens (and keep given token-weighted
means), the one closest to "take everything once" in relative entropy is an exponential tilt
rate(d) = exp(lambda(source of d) + mu . z(d)). Its multipliers minimise a convex dual, whose
Newton steps are computed by aggregation: sources stay rows of a table, and only the few means
(a k x k system, their Schur complement) pass through the driver. Rates are then rounded into
copies by systematic sampling over documents ordered by size, and what is left is repaired with a
few documents of every size class.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.scratch import keep
from tillspark.operators import ordered

#: Parts into which the documents of a source are dealt for joins on the source.
SALTS = 32


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Add `target` to a written table (source, source_size) with one row per source.

    Sources by code point, null last, take `weights` in turn and share the sum of all sizes. No
    target exceeds `most` times its source's size; what exceeds it is shared again by weight.
    """
    order = [F.col("source").isNull().cast("int"), F.coalesce("source", F.lit(""))]
    ranked = ordered.row_numbers(sizes, order, "_place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    place = ((F.col("_place") - 1) % len(weights)).cast("int")
    weighed = keep(ranked.withColumn("_w", F.get(turn, place)).drop("_place"), "targets")
    limit = F.col("source_size") * F.lit(float(most))
    level, above = 0.0, -1
    while True:
        capped = F.col("_w") * F.lit(level) > limit
        total, at_limit, free, now = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(capped, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("_w"))), F.lit(0.0)),
            F.count_if(capped),
        ).first()
        if now == above:
            break
        above = now
        level = (total - at_limit) / free if free else level
    return weighed.withColumn("target", F.least(F.col("_w") * F.lit(level), limit)).drop("_w")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _with_source(docs: DataFrame, by_source: DataFrame, *columns: str) -> DataFrame:
    """`docs` (id, source, size) with columns of its source; a hot source is dealt over salts."""
    right = _salted(by_source.select(F.col("source").alias("_source"), *columns))
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")
    match = docs["source"].eqNullSafe(right["_source"]) & (salt == right["_salt"])
    return docs.join(right, match, "left").drop("_source", "_salt")


def balance(
    docs: DataFrame,
    targets: DataFrame,
    means: dict[str, float] | None = None,
    tolerance: float = 1e-9,
    steps: int = 60,
) -> tuple[DataFrame, dict[str, float]]:
    """Newton iterations; returns (source, source_size, target, lam) and the multipliers of `means`.

    `docs` has source, size and the numeric columns named in `means`, whose token-weighted means
    over the mix are to be the given values. Documents of equal source and values are folded first.
    Sources without size keep lam 0. A damped step halves until the dual objective falls.
    """
    names = list(means or {})
    k = len(names)
    cells = keep(
        docs.where("size > 0")
        .groupBy("source", *names)
        .agg(F.sum("size").cast("double").alias("_mass")),
        "cells",
    )
    now = targets.withColumn("lam", F.lit(0.0))
    mu = np.zeros(k)
    total = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    # Deviations from the wanted means make their constraint totals zero.
    z = [F.col(n) - F.lit(float(means[n])) for n in names]

    def objective(table: DataFrame, at: np.ndarray) -> tuple[float, DataFrame]:
        tilt = sum((c * F.lit(float(m)) for c, m in zip(z, at, strict=True)), F.lit(0.0))
        right = table.select(F.col("source").alias("_s"), "lam")
        joined = cells.join(right, cells["source"].eqNullSafe(right["_s"])).drop("_s")
        taken = joined.withColumn("_q", F.col("_mass") * F.exp(F.col("lam") + tilt))
        sums = taken.groupBy("source").agg(
            F.sum("_q").alias("_h"),
            *[F.sum(F.col("_q") * z[i]).alias(f"_b{i}") for i in range(k)],
            *[
                F.sum(F.col("_q") * z[i] * z[j]).alias(f"_g{i}_{j}")
                for i in range(k)
                for j in range(i, k)
            ],
        )
        sums = sums.withColumnRenamed("source", "_s")
        state = keep(
            table.join(sums, table["source"].eqNullSafe(sums["_s"]), "left").drop("_s"), "newton"
        )
        value = state.agg(
            F.sum(F.coalesce("_h", F.lit(0.0)) - F.col("lam") * F.col("target"))
        ).first()[0]
        return value or 0.0, state

    value, state = objective(now, mu)
    for _ in range(steps):
        gap = F.col("_h") - F.col("target")
        row = state.where("_h > 0").agg(
            F.coalesce(F.max(F.abs(gap) / F.col("target")), F.lit(0.0)).alias("worst"),
            *[F.sum(f"_b{i}").alias(f"s{i}") for i in range(k)],
            *[F.sum(F.col(f"_b{i}") * gap / F.col("_h")).alias(f"r{i}") for i in range(k)],
            *[
                F.sum(F.col(f"_g{i}_{j}") - F.col(f"_b{i}") * F.col(f"_b{j}") / F.col("_h")).alias(
                    f"c{i}_{j}"
                )
                for i in range(k)
                for j in range(i, k)
            ],
        ).first()
        off = max((abs(row[f"s{i}"] or 0.0) / (total or 1.0) for i in range(k)), default=0.0)
        if max(row["worst"], off) <= tolerance:
            break
        step_mu = np.zeros(k)
        if k:
            curve = np.array(
                [[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]
            )
            slope = np.array([(row[f"s{i}"] or 0.0) - (row[f"r{i}"] or 0.0) for i in range(k)])
            step_mu = -np.linalg.lstsq(curve, slope, rcond=None)[0]
        drift = sum((F.col(f"_b{i}") * float(step_mu[i]) for i in range(k)), F.lit(0.0))
        move = F.coalesce(F.when(F.col("_h") > 0, -(gap + drift) / F.col("_h")), F.lit(0.0))
        base = state.select("source", "source_size", "target", "lam", move.alias("_move"))
        scale = 1.0
        while True:
            tried = base.withColumn("lam", F.col("lam") + F.col("_move") * scale).drop("_move")
            new_value, new_state = objective(tried, mu + scale * step_mu)
            if new_value <= value + 1e-9 * abs(value) or scale < 1e-6:
                break
            scale /= 2
        value, state, mu = new_value, new_state, mu + scale * step_mu
    return (
        state.select("source", "source_size", "target", "lam"),
        {n: float(m) for n, m in zip(names, mu, strict=True)},
    )


def _size_class(size: Column) -> Column:
    return F.floor(4 * F.log2(size)).cast("int")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    most: float = 3.0,
    means: dict[str, float] | None = None,
) -> DataFrame:
    """Copies of every row of `docs` (doc_id, source, size and the columns of `means`).

    Adds source_size, target, rate and copies (0 to `most`). A source takes its target up to the
    smallest documents it has; sizes of null count as 0 and documents of size 0 get the copies
    which their place gives, which are no tokens. Null is a source like any other. Repeated rows
    count each by itself; an empty table stays empty. The result depends on the rows only.
    """
    named = list(means or {})
    rows = keep(
        docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *named),
        "sizes",
    )
    by_source = keep(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes"
    )
    lams, mu = balance(rows, source_targets(by_source, weights, most), means)
    lams = keep(lams, "multipliers")
    tilt = sum(
        ((F.col(n) - float(means[n])) * mu[n] for n in named), F.lit(0.0)
    )
    joined = _with_source(rows, lams, "source_size", "target", "lam")
    rated = keep(
        joined.withColumn("rate", F.least(F.exp(F.col("lam") + tilt), F.lit(float(most)))).drop(
            "lam", *named
        ),
        "rates",
    )
    # Running sum of the rates over documents by falling size; crossing an integer takes a copy.
    order = [-F.col("size"), F.xxhash64("doc_id", "size"), F.col("doc_id")]
    placed = ordered.running_totals(
        rated,
        order,
        {"_sum": F.col("rate").cast("decimal(28,12)"), "_place": F.lit(1).cast("long")},
        by=["source"],
    )
    half = F.lit(0.5).cast("decimal(28,12)")
    below = F.floor(F.col("_sum") - F.col("rate").cast("decimal(28,12)") + half)
    copies = F.least(F.floor(F.col("_sum") + half) - below, F.lit(int(most))).cast("long")
    rounded = keep(placed.withColumn("copies", copies).drop("_sum"), "rounded")
    fixes = _repairs(rounded, int(most))
    fix = fixes.select(
        F.col("source").alias("_s"), F.col("place").alias("_p"), F.col("change").alias("_change")
    )
    match = rounded["source"].eqNullSafe(fix["_s"]) & (rounded["_place"] == fix["_p"])
    return (
        rounded.join(fix, match, "left")
        .withColumn("copies", F.col("copies") + F.coalesce("_change", F.lit(0)))
        .drop("_s", "_p", "_place", "_change")
    )


def _repairs(rounded: DataFrame, most: int) -> DataFrame:
    """(source, place, change): one copy more or less of documents which close a source's gap.

    Of every size class of a source one document is a candidate; from large to small, each that
    fits into what is left of the gap is taken. Classes are a quarter octave wide, so there are at
    most 4 x 64 candidates of a source.
    """
    gaps = rounded.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")
    )
    free = rounded.where("size > 0")
    pick = F.struct(F.xxhash64("doc_id", "size", "_place"), "size", "_place")
    ladder = (
        free.groupBy("source", _size_class(F.col("size")).alias("class"))
        .agg(
            F.min(F.when(F.col("copies") < most, pick)).alias("more"),
            F.min(F.when(F.col("copies") > 0, pick)).alias("less"),
        )
        .groupBy("source")
        .agg(F.sort_array(F.collect_list(F.struct("class", "more", "less")), False).alias("steps"))
    )
    right = gaps.withColumnRenamed("source", "_s")
    both = ladder.join(right, ladder["source"].eqNullSafe(right["_s"])).drop("_s")
    rising = F.col("gap") > 0

    def step(acc: Column, s: Column) -> Column:
        doc = F.when(rising, s["more"]).otherwise(s["less"])
        fits = doc.isNotNull() & (doc["size"] <= acc["left"])
        return F.struct(
            F.when(fits, acc["left"] - doc["size"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["taken"], F.array(doc["_place"])))
            .otherwise(acc["taken"])
            .alias("taken"),
        )

    start = F.struct(
        F.abs("gap").cast("double").alias("left"), F.array().cast("array<bigint>").alias("taken")
    )
    taken = F.aggregate("steps", start, step, lambda acc: acc["taken"])
    return both.select(
        "source", F.explode(taken).alias("place"), F.when(rising, 1).otherwise(-1).alias("change")
    )
