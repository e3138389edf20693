"""Outlier flags: interquartile range, z-score, MAD, 1/99 percentiles, non-finite values.

Limits are computed over the whole column, or per group when `by` is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.functions.columns import count_if, is_nonfinite, number
from tillspark.operators.ordered import ROWS_PER_BUCKET, count_values, counted_quantiles, keep, wide_quantiles

# Rule parameters.
IQR_FACTOR = 1.5
Z_LIMIT = 3
MAD_SCALE = 0.6745
MAD_LIMIT = 3.5
METHODS = ["iqr", "zscore", "mad", "percentile", "nonfinite"]


def limits(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Quartiles, 1/99 percentiles, median, MAD, mean and sd as one struct per column and key."""
    by = list(by)
    values = df.select(*by, *[number(F.col(c)).alias(c) for c in columns])
    names = {0.01: "p01", 0.25: "q1", 0.5: "median", 0.75: "q3", 0.99: "p99"}
    counted = keep(count_values(values, columns, by))
    marks = wide_quantiles(
        counted_quantiles(counted, list(names), by, rows_per_bucket), names, by
    )
    spread = (
        values.groupBy(*by)
        .agg(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")
                    )
                    for c in columns
                ]
            ).alias("s")
        )
        .select(*by, F.inline("s"))
    )
    both = keep(marks.join(spread, [*by, "column"]))  # one row per column and key
    # Deviations come from the counted values; the lines are not read again.
    median = both.select(
        *[F.col(c).alias(f"_r_{c}") for c in [*by, "column"]], F.col("median").alias("_median")
    )
    same = F.lit(True)
    for c in [*by, "column"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    deviations = (
        counted.join(median, same)
        .groupBy(*by, "column", F.abs(F.col("_v") - F.col("_median")).alias("_v"))
        .agg(F.sum("n").alias("n"))
    )
    mads = wide_quantiles(
        counted_quantiles(deviations, [0.5], by, rows_per_bucket), {0.5: "mad"}, by
    )
    stats = ["q1", "q3", "p01", "p99", "median", "mad", "mean", "sd"]
    return _wide(both.join(mads, [*by, "column"]), columns, stats, by)


def _wide(
    long: DataFrame, columns: Sequence[str], stats: Sequence[str], by: Sequence[str]
) -> DataFrame:
    struct = [F.max(F.when(F.col("column") == c, F.struct(*stats))).alias(c) for c in columns]
    return long.groupBy(*by).agg(*struct)


def attach(df: DataFrame, wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Put the limits next to every row as `_limits`: a scalar subquery, or a join per key."""
    columns = [c for c in wide.columns if c not in by]
    packed = wide.select(*by, F.struct(*columns).alias("_limits"))
    if not by:
        return df.withColumn("_limits", packed.scalar())
    renamed = packed.select(*[F.col(c).alias(f"_k_{c}") for c in by], "_limits")
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(renamed, match, "left").drop(*[f"_k_{c}" for c in by])


def flag_columns(column: str) -> dict[str, Column]:
    """The five flags of a column, given `_limits`; never NULL."""
    x = number(F.col(column))
    s = F.col(f"_limits.{column}")
    reach = (s["q3"] - s["q1"]) * IQR_FACTOR
    rules = {
        "iqr": (x < s["q1"] - reach) | (x > s["q3"] + reach),
        "zscore": (s["sd"] > 0) & (F.abs(x - s["mean"]) > s["sd"] * Z_LIMIT),
        "mad": (s["mad"] > 0)
        & (F.try_divide(F.abs(x - s["median"]) * MAD_SCALE, s["mad"]) > MAD_LIMIT),
        "percentile": (x < s["p01"]) | (x > s["p99"]),
        "nonfinite": is_nonfinite(x),
    }
    return {m: F.coalesce(c, F.lit(False)) for m, c in rules.items()}


def outlier_flags(
    df: DataFrame, columns: Sequence[str], wide: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Every row with `<column>_<method>` flags."""
    return (
        attach(df, wide, by)
        .withColumns(
            {f"{c}_{m}": f for c in columns for m, f in flag_columns(c).items()}
        )
        .drop("_limits")
    )


def outlier_summary(flags: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Flagged rows and their fraction per column and method, in one pass."""
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(m).alias("method"),
            count_if(F.col(f"{c}_{m}")).alias("rows"),
            (count_if(F.col(f"{c}_{m}")) / F.count(F.lit(1))).alias("fraction"),
        )
        for c in columns
        for m in METHODS
    ]
    return flags.agg(F.array(*cells).alias("s")).select(F.inline("s"))


def line_flags(flags: DataFrame, columns: Sequence[str], key: str = "line_id") -> DataFrame:
    """Per line: the IQR flags and the negative and zero price rules."""
    price = number(F.col("Price"))
    return flags.select(
        key,
        *[F.col(f"{c}_iqr") for c in columns],
        F.coalesce(price < 0, F.lit(False)).alias("negative_price"),
        F.coalesce(price == 0, F.lit(False)).alias("zero_price"),
    )


def iqr_rate_by(flags: DataFrame, column: str, key: str) -> DataFrame:
    """Rows and IQR rate of a column per key value."""
    return flags.groupBy(key).agg(
        F.count(F.lit(1)).alias("size"), F.avg(F.col(f"{column}_iqr").cast("int")).alias("mean")
    )
