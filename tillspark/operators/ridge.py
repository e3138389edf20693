"""Ridge regression from sums of products: one pass serves every fold and every penalty.

All columns that preprocessing can make are linear in a fixed row vector: a constant, each number with
zero where it is missing, a flag for that, and one flag for each calendar value. Sums of products of
this vector are added up natively per part of the calendar; a training fold is the sum of its parts.
Imputation, scaling, dropped columns and the intercept are then linear algebra on matrices whose
size is that of the feature list. Medians are the one statistic beside the sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.functions.columns import known
from tillspark.operators.ordered import ROWS_PER_BUCKET, exact_quantiles, scratch
from tillspark.schema import CATEGORICAL, NUMERIC


@dataclass(frozen=True)
class RowVector:
    """The fixed vector: `scale` brings numbers to a common size, `values` are the calendar values."""

    scale: dict[str, tuple[float, float]]
    values: dict[str, list[int]]

    @staticmethod
    def of(rows: DataFrame) -> RowVector:
        told = rows.agg(
            *[F.struct(F.avg(known(F.col(c))), F.stddev_pop(known(F.col(c)))).alias(c) for c in NUMERIC],
            *[F.sort_array(F.collect_set(F.col(c).cast("int"))).alias(c) for c in CATEGORICAL],
        ).first()
        scale = {c: (float(told[c][0] or 0.0), float(told[c][1] or 0.0) or 1.0) for c in NUMERIC}
        return RowVector(scale, {c: list(told[c]) for c in CATEGORICAL})

    def column(self) -> Column:
        cells = [F.lit(1.0)]
        for c in NUMERIC:
            middle, size = self.scale[c]
            cells.append(F.coalesce((known(F.col(c)) - F.lit(middle)) / F.lit(size), F.lit(0.0)))
        cells += [known(F.col(c)).isNull().cast("double") for c in NUMERIC]
        for c, values in self.values.items():
            cells += [F.coalesce((F.col(c).cast("int") == v).cast("double"), F.lit(0.0)) for v in values]
        return F.array(*cells)

    def __len__(self) -> int:
        return 1 + 2 * len(NUMERIC) + sum(map(len, self.values.values()))


def sums_of_products(rows: DataFrame, vector: Column, target: Column, by: Sequence[str]) -> DataFrame:
    """(by..., n, products): sums of all products of two elements of (vector, target), row by row.

    Partial sums are added on the map side, so a key of any size costs one vector per task. Rows
    without target are left out.
    """
    whole = F.array(F.concat(vector, F.array(target.cast("double"))))
    # The vector is bound to a name, so that it is computed once and not for each of its elements.
    outer = F.transform(
        whole, lambda v: F.flatten(F.transform(v, lambda p: F.transform(v, lambda q: p * q)))
    )[0]
    present = rows.where(target.isNotNull()).select(*by, array_to_vector(outer).alias("_outer"))
    return present.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("_outer")).alias("products")
    )


def design_of(vector: RowVector, sums: np.ndarray, medians: dict[str, float | None]) -> np.ndarray:
    """Rows of the design (columns x vector): imputed, scaled, without columns of no variance.

    `sums` are the sums of products over the training rows.
    """
    n, size, many = sums[0, 0], len(vector), len(NUMERIC)
    out = []

    def scaled(row: np.ndarray) -> np.ndarray:
        mean = row @ sums[:size, 0] / n
        moved = row.copy()
        moved[0] -= mean
        variance = moved @ sums[:size, :size] @ moved / n
        return moved / np.sqrt(variance) if variance > 1e-20 else moved * 0

    for i, c in enumerate(NUMERIC):
        middle, width = vector.scale[c]
        gaps = sums[0, 1 + many + i]
        row = np.zeros(size)
        row[1 + i] = 1.0
        median = medians.get(c)
        # Without any value in training, zero stands in, which is a constant column.
        row[1 + many + i] = ((median if median is not None else 0.0) - middle) / width
        done = scaled(row)
        if gaps < n and done.any():
            out.append(done)
        if 0 < gaps < n:
            flag = np.zeros(size)
            flag[1 + many + i] = 1.0
            out.append(scaled(flag))
    at = 1 + 2 * many
    for values in vector.values.values():
        held = [k for k in range(at, at + len(values)) if sums[0, k] > 0]
        if len(held) > 1:
            out += [np.eye(size)[k] for k in held]
        at += len(values)
    return np.array(out).reshape(-1, size)


def solve(design: np.ndarray, sums: np.ndarray, alphas: Sequence[float]) -> list[np.ndarray]:
    """Coefficients over the row vector for every penalty; the intercept is not penalised."""
    size = design.shape[1]
    n, total = sums[0, 0], sums[0, size]
    first = design @ sums[:size, 0]
    inner = design @ sums[:size, :size] @ design.T - np.outer(first, first) / n
    cross = design @ sums[:size, size] - first * total / n
    out = []
    for alpha in alphas:
        w = np.linalg.solve(inner + alpha * np.eye(len(design)), cross) if len(design) else np.zeros(0)
        told = w @ design if len(design) else np.zeros(size)
        told[0] += (total - w @ first) / n
        out.append(told)
    return out


def predicted(vector: Column, coefficients: Column) -> Column:
    """The clipped prediction of a row from its vector."""
    dot = F.aggregate(F.zip_with(vector, coefficients, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), dot)


def fold_errors(
    numbered: DataFrame,
    train_ends: Sequence[int],
    last: int,
    alphas: Sequence[float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> list[list[float]]:
    """MAE of every penalty on every expanding fold: result[alpha][fold].

    Fold i trains on `day_number` up to train_ends[i] and is tested on the days after it up to the
    next end, the last one up to `last`.
    """
    spark, k = numbered.sparkSession, len(train_ends)
    day = F.col("day_number")
    part = sum(((day > e).cast("int") for e in train_ends), F.lit(0))
    rows = numbered.where(day <= last).withColumn("part", part)
    vector = RowVector.of(rows)
    size = len(vector) + 1
    parts = {
        r["part"]: r["products"].toArray().reshape(size, size)
        for r in sums_of_products(rows, vector.column(), F.col("target"), ["part"]).collect()
    }
    nested = rows.withColumn("fold", F.explode(F.sequence(F.col("part"), F.lit(k)))).where(F.col("fold") < k)
    with scratch():
        found = exact_quantiles(nested, NUMERIC, [0.5], ["fold"], rows_per_bucket).collect()
    medians = {(r["fold"], r["column"]): r["value"] for r in found}
    told, sums = [], np.zeros((size, size))
    for fold in range(k):
        sums = sums + parts.get(fold, 0)
        design = design_of(vector, sums, {c: medians.get((fold, c)) for c in NUMERIC})
        for trial, w in enumerate(solve(design, sums, alphas)):
            told.append((fold + 1, trial, [float(v) for v in w]))
    # One row of coefficients for each trial and fold.
    models = F.broadcast(spark.createDataFrame(told, "part int, trial int, w array<double>"))
    error = F.abs(F.col("target") - predicted(F.col("_v"), F.col("w")))
    scored = rows.withColumn("_v", vector.column()).join(models, "part")
    errors = {
        (r["trial"], r["part"] - 1): r["e"]
        for r in scored.groupBy("trial", "part").agg(F.avg(error).alias("e")).collect()
    }
    return [[errors[trial, fold] for fold in range(k)] for trial in range(len(alphas))]
