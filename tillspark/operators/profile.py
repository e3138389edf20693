"""Column profiles, missingness and duplicate reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tillspark.functions.columns import count_if, known, sample_kurtosis, sample_skewness
from tillspark.operators.ordered import ROWS_PER_BUCKET, exact_quantiles, keep, wide_quantiles
from tillspark.operators.repeats import repeated_rows, split


def _absent(df: DataFrame, c: str) -> Column:
    name = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return name.isNull() | F.isnan(name)
    return name.isNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per distinct value of every column as (column, value, n); NULL is one value.

    One shuffle serves all columns, and repeated values are combined before it. Distinct
    counts, missing counts and leading categories are all read off this frame.
    """
    pairs = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(~_absent(df, c), F.col(f"`{c}`").cast("string")).alias("value"),
        )
        for c in (columns or df.columns)
    ]
    return (
        df.select(F.explode(F.array(*pairs)).alias("p"))
        .groupBy("p.column", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def missing_summary(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Missing count and percentage, exact distinct count and type of every column.

    With `counts` (see `value_counts`) all of it is read off them. Without, only columns whose values
    recur are counted that way; see `_mostly_single`.
    """
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    found = []
    if counts is None:
        recur, found = _mostly_single(df)
        counts = value_counts(df, recur) if recur else None
    if counts is not None:
        lost = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
        found.append(
            counts.groupBy("column").agg(
                lost.alias("missing_count"),
                (lost * 100 / F.sum("n")).alias("missing_pct"),
                F.count("value").alias("unique_count"),
            )
        )
    return reduce(DataFrame.unionAll, found).withColumn("dtype", types[F.col("column")])


def _mostly_single(df: DataFrame) -> tuple[list[str], list[DataFrame]]:
    """Columns whose values recur, and the summaries of all others, one row each.

    The others hold mostly values which are there once: their hashes are moved, not their values. The
    estimate of distinct values only decides how they are counted, which is always exact.
    """
    values = {c: F.when(~_absent(df, c), F.col(f"`{c}`").cast("string")) for c in df.columns}
    # one row of counts
    seen = df.agg(
        F.count(F.lit(1)),
        *[F.count(v) for v in values.values()],
        *[F.approx_count_distinct(F.when(~_absent(df, c), F.col(f"`{c}`"))) for c in values],
    ).first()
    rows, known, about = seen[0], seen[1 : len(values) + 1], seen[len(values) + 1 :]
    recur, found = [], []
    for (c, value), n, distinct in zip(values.items(), known, about, strict=True):
        if distinct <= 0.5 * rows:
            recur.append(c)
            continue
        once, rest = split(df.select(value.alias("value")).where("value IS NOT NULL"), ["value"])
        if rest is None:  # every value is there once
            counted = df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("unique_count"))
        else:
            several = rest.groupBy("value").agg(F.count(F.lit(1)).alias("_n")).select("value")
            each = several if once is None else once.unionAll(several)
            counted = each.agg(F.count(F.lit(1)).alias("unique_count"))
        lost = F.lit(rows - n).cast("bigint")
        found.append(
            counted.select(
                F.lit(c).alias("column"),
                lost.alias("missing_count"),
                (lost * 100 / F.lit(rows)).alias("missing_pct"),
                "unique_count",
            )
        )
    return recur, found


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std, min, max, skewness and kurtosis per column, in one pass."""
    stats = []
    for c in columns:
        v = F.when(~_absent(df, c), F.col(f"`{c}`").cast("double"))
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                sample_skewness(v).alias("skewness"),
                sample_kurtosis(v).alias("kurtosis"),
            )
        )
    return df.groupBy(*by).agg(F.array(*stats).alias("s")).select(*by, F.inline("s"))


def describe(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    percentiles: Sequence[float] = (0.25, 0.5, 0.75),
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Moments plus exact percentiles (columns p1, p25, ...) per column and key."""
    columns = list(columns or numeric_columns(df))
    names = {p: f"p{p * 100:g}".replace(".", "_") for p in percentiles}
    quantiles = wide_quantiles(
        exact_quantiles(df, columns, percentiles, by, rows_per_bucket), names, by
    )
    return moments(df, columns, by).join(quantiles, [*by, "column"], "left")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix as (a, b, r); pairs with a NULL or NaN are left out, as in pairwise deletion."""
    cells = []
    for a, b in combinations_with_replacement(columns, 2):
        r = F.corr(known(F.col(f"`{a}`")), known(F.col(f"`{b}`")))
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
    upper = df.agg(F.array(*cells).alias("m")).select(F.inline("m"))
    return upper.unionByName(
        upper.where(F.col("a") != F.col("b")).select(
            F.col("b").alias("a"), F.col("a").alias("b"), "r"
        )
    )


def constant_columns(summary: DataFrame) -> DataFrame:
    """Columns with at most one distinct value."""
    return summary.where(F.col("unique_count") <= 1).select("column")


def high_cardinality(summary: DataFrame, rows: Column) -> DataFrame:
    """Columns with more distinct values than half of the rows."""
    return summary.withColumn("_rows", rows).where(
        F.col("unique_count") > 0.5 * F.col("_rows")
    ).select("column")


def date_coverage(df: DataFrame) -> DataFrame:
    """First and last moment of every date or timestamp column, as text."""
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    columns = [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(F.col(f"`{c}`")).cast("string").alias("first"),
            F.max(F.col(f"`{c}`")).cast("string").alias("last"),
        )
        for c in columns
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def top_categories(counts: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent values of every text column, NULL included, ties by value.

    Values are preselected inside hashed groups, so the final ranking of a column sees at most
    k values of each group rather than all distinct values.
    """
    wanted = counts.where(F.col("column").isin(*columns)).withColumn(
        "_g", F.pmod(F.xxhash64("value"), F.lit(256))
    )
    order = [F.desc("n"), F.asc_nulls_first("value")]
    part = F.row_number().over(W.partitionBy("column", "_g").orderBy(*order))
    best = wanted.withColumn("_r", part).where(F.col("_r") <= k)
    rank = F.row_number().over(W.partitionBy("column").orderBy(*order))
    return (
        best.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("column", "rank", "value", "n")
    )


def profile(df: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> dict[str, DataFrame]:
    """All profile tables of a frame, by name."""
    counts = keep(value_counts(df))
    summary = missing_summary(df, counts)
    numbers = numeric_columns(df)
    rows = df.agg(F.count(F.lit(1))).scalar()
    return {
        "shape": df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")),
        "missing": summary,
        "numeric": describe(df, numbers, (0.01, 0.25, 0.5, 0.75, 0.99), (), rows_per_bucket),
        "correlations": correlations(df, numbers),
        "constant_columns": constant_columns(summary),
        "high_cardinality": high_cardinality(summary, rows),
        "date_coverage": date_coverage(df),
        "top_categories": top_categories(counts, text_columns(df)),
    }


def compare_missing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missingness of two frames, tagged `before` and `after`."""
    return (
        missing_summary(before)
        .withColumn("state", F.lit("before"))
        .unionByName(missing_summary(after).withColumn("state", F.lit("after")))
    )


def missing_rate_by(df: DataFrame, column: str, key: Column) -> DataFrame:
    """Rows and missing rate of a column per key value; a NULL key is a group of its own."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("size"), F.avg(_absent(df, column).cast("int")).alias("mean")
    )


def joint_missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of all rows (%) in which both columns are missing, as (a, b, pct)."""
    cells = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            (count_if(_absent(df, a) & _absent(df, b)) * 100 / F.count(F.lit(1))).alias("pct"),
        )
        for a in columns
        for b in columns
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by the hash of their key: the same rows under any partitioning.

    For display only; totals always use all rows.
    """
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def duplicate_summary(
    df: DataFrame, business: Sequence[str], invoice: str = "Invoice", key: str = "line_id"
) -> DataFrame:
    """Rows, business repeats beyond the first, repeated invoice rows, repeated line keys.

    An invoice usually has several rows; of lines and their keys only the repeated ones are moved.
    """

    def surplus(keys: Sequence[str], rows: DataFrame) -> Column:
        groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()

    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        surplus(business, repeated_rows(df, business)).alias("exact_business_row_repeats"),
        surplus([invoice], df).alias("repeated_invoice_rows"),
        surplus([key], repeated_rows(df, [key])).alias("duplicate_line_ids"),
    )


def near_repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows which share the given keys with another row."""
    groups = repeated_rows(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    shared = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return groups.agg(shared.alias("near_repeat_rows"))


def repeat_examples(
    df: DataFrame, business: Sequence[str], order: Sequence[str], n: int = 200
) -> DataFrame:
    """The first n rows, in source order, which have an exact business repeat."""
    from tillspark.operators.cleaning import mark_repeats

    return (
        mark_repeats(df, list(business), "_again")
        .where("_again")
        .drop("_again")
        .orderBy(*order)
        .limit(n)
    )
