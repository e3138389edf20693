"""Exploratory tables and the data behind the charts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillspark.functions.columns import count_if, flag, money, ratio, sample_skewness, total
from tillspark.operators.ordered import (
    ROWS_PER_BUCKET,
    exact_quantiles,
    value_ranks,
    wide_quantiles,
)
from tillspark.operators.profile import hashed_sample
from tillspark.schema import UNKNOWN

INVOICE_MEASURES = ["gross_sales", "sale_lines", "sale_units"]


def invoices_with_country(invoices: DataFrame, countries: DataFrame) -> DataFrame:
    return invoices.join(countries, "country_id")


def positive_invoices(invoices: DataFrame, countries: DataFrame) -> DataFrame:
    """Invoice groups with positive sales, with country and log10 value."""
    return (
        invoices_with_country(invoices, countries)
        .where(F.col("gross_sales") > 0)
        .withColumn("log_sales", F.log10("gross_sales"))
    )


def customer_summary(invoices: DataFrame, countries: DataFrame) -> DataFrame:
    """One row per known customer over invoice groups with positive sales.

    Country keys are dense in name order, so the least key is the least name; names are looked
    up once per customer.
    """
    positive = invoices.where((F.col("customer_id") != UNKNOWN) & (F.col("gross_sales") > 0))
    n, value = F.count(F.lit(1)), F.sum(money("gross_sales")).cast("double")
    return (
        positive.groupBy("customer_id")
        .agg(
            n.alias("orders"),
            (value / n).alias("average_order"),
            value.alias("gross_sales"),
            F.count_distinct("country_id").alias("countries"),
            F.min("country_id").alias("country_id"),
            F.max(flag(F.col("cancellation_value") > 0)).alias("ever_cancelled"),
        )
        .join(countries, "country_id")
        .select(
            "customer_id",
            "orders",
            "average_order",
            "gross_sales",
            "countries",
            "country",
            "ever_cancelled",
        )
    )


def segment_stats(
    positive: DataFrame, key: str = "country", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Size, mean, median, std and skewness of invoice values per segment."""
    median = wide_quantiles(
        exact_quantiles(positive, ["gross_sales"], [0.5], [key], rows_per_bucket),
        {0.5: "median"},
        [key],
    ).drop("column")
    n = F.count(F.lit(1))
    return (
        positive.groupBy(key)
        .agg(
            n.alias("size"),
            (total("gross_sales") / n).alias("mean"),
            F.stddev_samp("gross_sales").alias("std"),
            sample_skewness("gross_sales").alias("skew"),
        )
        .join(median, key)
    )


def seasonality(daily: DataFrame) -> DataFrame:
    """Mean daily sales and number of days per month of year and weekday."""
    n = F.count(F.lit(1))
    return daily.groupBy(
        F.month("date").alias("month_number"), F.weekday("date").alias("weekday")
    ).agg((total("gross_sales") / n).alias("mean"), n.alias("size"))


def spearman(
    df: DataFrame, columns: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Spearman matrix as (a, b, r), average ranks for ties; rows with a NULL are left out.

    Ranks are computed per distinct value, and pairs of values are counted before they meet
    their ranks, so neither a global sort nor a hot value lands in one task.
    """
    whole = df.dropna(subset=list(columns)).select(*columns)
    ranks = {
        c: value_ranks(whole, c, rows_per_bucket=rows_per_bucket).select(c, "average_rank")
        for c in columns
    }
    upper = None
    for a, b in combinations(columns, 2):
        pairs = (
            whole.groupBy(a, b)
            .agg(F.count(F.lit(1)).cast("double").alias("n"))
            .join(ranks[a].withColumnRenamed("average_rank", "x"), a)
            .join(ranks[b].withColumnRenamed("average_rank", "y"), b)
        )
        cell = pairs.agg(weighted_corr(F.col("x"), F.col("y"), F.col("n")).alias("r")).select(
            F.lit(a).alias("a"), F.lit(b).alias("b"), "r"
        )
        upper = cell if upper is None else upper.unionByName(cell)
    mirrored = upper.unionByName(upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    diagonal = whole.limit(1).select(
        F.explode(F.array(*[F.lit(c) for c in columns])).alias("a")
    ).select("a", F.col("a").alias("b"), F.lit(1.0).alias("r"))
    return mirrored.unionByName(diagonal)


def weighted_corr(x: Column, y: Column, n: Column) -> Column:
    """Pearson correlation of ranks with counts; (half-)integer sums are taken exactly.

    Twice an average rank is a whole number, so decimals carry the sums without rounding.
    """
    exact = lambda c: (c * 2).cast("decimal(18,0)")
    w = n.cast("decimal(18,0)")
    rows = F.sum(w).cast("double")
    mx, my = F.sum(exact(x) * w).cast("double") / rows, F.sum(exact(y) * w).cast("double") / rows
    sxy = F.sum(x * y * 4 * n) / rows - mx * my
    sxx = F.sum(x * x * 4 * n) / rows - mx * mx
    syy = F.sum(y * y * 4 * n) / rows - my * my
    return ratio(sxy, F.sqrt(sxx * syy))


def autocorrelation(
    daily: DataFrame, lags: Sequence[int] = (1, 7, 14, 28), by: Sequence[str] = ()
) -> DataFrame:
    """Correlation of the daily series with itself k days earlier, as (by..., lag, r).

    The window holds one row per calendar day (and key).
    """
    w = W.partitionBy(*by).orderBy("date")
    shifted = daily.select(
        *by, "gross_sales", *[F.lag("gross_sales", k).over(w).alias(f"l{k}") for k in lags]
    )
    cells = [
        F.struct(F.lit(k).alias("lag"), F.corr("gross_sales", f"l{k}").alias("r")) for k in lags
    ]
    return shifted.groupBy(*by).agg(F.array(*cells).alias("c")).select(*by, F.inline("c"))


def daily_summary(daily: DataFrame) -> DataFrame:
    """Mean, least and greatest daily sales and the number of days without sales."""
    n = F.count(F.lit(1))
    return daily.agg(
        (total("gross_sales") / n).alias("mean_daily_gross_sales"),
        count_if(F.col("gross_sales") == 0).alias("zero_sales_days"),
        F.min("gross_sales").alias("least_day"),
        F.max("gross_sales").alias("greatest_day"),
    )


def month_completeness(monthly: DataFrame) -> DataFrame:
    """Number of months and of months which the source covers only in part."""
    return monthly.agg(
        F.count(F.lit(1)).alias("months"),
        count_if(F.col("complete_month") == 0).alias("incomplete_months"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between the extremes as (bin, low, high, n); the last bin is closed.

    Empty bins are kept.
    """
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.floor(ratio(F.col(column) - F.col("_e.lo"), F.col("_e.hi") - F.col("_e.lo")) * bins)
    counted = (
        df.where(F.col(column).isNotNull())
        .withColumn("_e", ends.select(F.struct("lo", "hi")).scalar())
        .groupBy(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    frame = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counted, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def frequent_keys(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent key values, ties by name."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), key)
        .limit(k)
        .select(key)
    )


def box_stats(
    df: DataFrame, column: str, key: str, k: int = 6, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers of a column for the k most frequent keys."""
    kept = df.join(frequent_keys(df, key, k), key, "left_semi").select(key, column)
    marks = wide_quantiles(
        exact_quantiles(kept, [column], [0.25, 0.5, 0.75], [key], rows_per_bucket),
        {0.25: "q1", 0.5: "median", 0.75: "q3"},
        [key],
    ).drop("column")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    v = F.col(column)
    return (
        kept.join(marks, key)
        .groupBy(key, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
            F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"),
        )
    )


def with_invoice_key(positive: DataFrame) -> DataFrame:
    """Text key of an invoice group, for seeded display samples."""
    return positive.withColumn("group_key", F.concat_ws("|", "invoice_id", "customer_id", "country_id"))


def sampled_quartiles(
    positive: DataFrame, n: int = 5000, k: int = 4, seed: int = 42
) -> DataFrame:
    """Quartiles of log value in the k most frequent countries, within a seeded display sample."""
    sample = hashed_sample(with_invoice_key(positive), "group_key", n, seed)
    kept = sample.join(frequent_keys(positive, "country", k), "country", "left_semi")
    at = F.percentile("log_sales", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        kept.groupBy("country")
        .agg(F.count(F.lit(1)).alias("n"), at.alias("p"))
        .select(
            "country",
            "n",
            F.col("p")[0].alias("q1"),
            F.col("p")[1].alias("median"),
            F.col("p")[2].alias("q3"),
        )
    )


def sampled_pairs(positive: DataFrame, n: int = 600, seed: int = 42) -> DataFrame:
    """log1p of the three measures for a seeded display sample of invoice groups."""
    sample = hashed_sample(with_invoice_key(positive), "group_key", n, seed)
    return sample.select("group_key", *[F.log1p(c).alias(f"log1p_{c}") for c in INVOICE_MEASURES])


def cohort_matrix(cohorts: DataFrame) -> DataFrame:
    """Retention by cohort and months since first purchase; unobserved cells stay NULL.

    One column for every offset from 0 to the greatest one found.
    """
    last = cohorts.agg(F.max("months_since_first")).first()[0]
    return (
        cohorts.groupBy("cohort")
        .pivot("months_since_first", list(range((-1 if last is None else last) + 1)))
        .agg(F.first("observed_retention"))
    )


def leading_share(contributions: DataFrame, k: int = 20) -> DataFrame:
    """Joint share of the k leading products."""
    top = contributions.orderBy(F.desc("gross_sales"), "product_id").limit(k)
    return top.agg(F.sum("sales_share").alias("leading_share"), F.count(F.lit(1)).alias("products"))


def market_mix(lines: DataFrame, k: int = 4) -> DataFrame:
    """Monthly share (%) of the k leading countries and of all others together."""
    per = lines.groupBy("month", "country").agg(F.sum(money("gross_sales")).alias("v"))
    leaders = (
        per.groupBy("country")
        .agg(F.sum("v").alias("v"))
        .orderBy(F.desc("v"), "country")
        .limit(k)
        .select("country", F.col("country").alias("market"))
    )
    mixed = (
        per.join(leaders, "country", "left")
        .groupBy("month", F.coalesce("market", F.lit("Other countries")).alias("market"))
        .agg(F.sum("v").alias("v"))
    )
    whole = F.sum("v").over(W.partitionBy("month")).cast("double")
    return mixed.select(
        "month", "market", ratio(F.col("v").cast("double") * 100, whole).alias("share_pct")
    )


def interval_table(center: Column, low: Column, high: Column, df: DataFrame) -> DataFrame:
    """Centre and both ends of an interval, with the distances an error bar needs."""
    zero = F.lit(0.0)
    return df.select(
        center.alias("center"),
        low.alias("low"),
        high.alias("high"),
        F.greatest(zero, center - low).alias("below"),
        F.greatest(zero, high - center).alias("above"),
    )
