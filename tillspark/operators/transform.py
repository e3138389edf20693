"""Line measures and the contiguous daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillspark.functions.columns import MONEY, ratio, total


def derive_lines(standard: DataFrame) -> DataFrame:
    """Calendar parts and signed, gross and cancellation values of every accepted line."""
    moment, net = F.col("invoice_date"), F.col("net_value")
    return (
        standard.withColumn("net_value", F.col("quantity") * F.col("unit_price"))
        .withColumn(
            "is_sale",
            (F.col("quantity") > 0) & (F.col("unit_price") > 0) & ~F.col("is_cancellation"),
        )
        .withColumns(
            {
                "date": F.to_date(moment),
                "month": F.date_format(moment, "yyyy-MM"),
                "weekday": F.weekday(moment),
                "hour": F.hour(moment),
                "gross_sales": F.when(F.col("is_sale"), net).otherwise(0.0),
                "cancellation_value": F.when(
                    F.col("is_cancellation") & (net < 0), -net
                ).otherwise(0.0),
            }
        )
    )


def calendar(
    days: DataFrame, by: Sequence[str] = (), column: str = "date", first_day=None, last_day=None
) -> DataFrame:
    """Every day between the first and the last observed day, per key if keys are given."""
    low = F.min(column) if first_day is None else F.lit(first_day)
    high = F.max(column) if last_day is None else F.lit(last_day)
    bounds = days.groupBy(*by).agg(low.alias("_low"), high.alias("_high"))
    return bounds.where(F.col("_low").isNotNull()).select(
        *by, F.explode(F.sequence("_low", "_high", F.expr("interval 1 day"))).alias(column)
    )


def daily_series(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Zero-filled daily totals with trailing mean, cumulative sales and growth.

    The windows are per key and hold one row per calendar day, whatever the number of lines.
    """
    by = list(by)
    sale_invoice = F.when(F.col("is_sale").cast("boolean"), F.col("invoice_id"))
    totals = lines.groupBy(*by, "date").agg(
        total("gross_sales").alias("gross_sales"),
        total("net_value").alias("net_value"),
        total("cancellation_value").alias("cancellation_value"),
        F.count(F.lit(1)).alias("observed_lines"),
        F.count_distinct(sale_invoice).alias("orders"),
    )
    measures = [c for c in totals.columns if c not in (*by, "date")]
    full = calendar(lines.select(*by, "date"), by).join(totals, [*by, "date"], "left")
    full = full.na.fill(0, measures)
    ordered = W.partitionBy(*by).orderBy("date")
    week = ordered.rowsBetween(-6, W.currentRow)
    exact = F.col("gross_sales").cast(MONEY)
    previous = F.lag("gross_sales").over(ordered)
    return full.withColumns(
        {
            "has_records": F.col("observed_lines") > 0,
            "rolling_7_sales": F.sum(exact).over(week).cast("double")
            / F.count(F.lit(1)).over(week),
            "cumulative_sales": F.sum(exact)
            .over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
            .cast("double"),
            "daily_growth": ratio(F.col("gross_sales"), previous) - 1,
        }
    )


def country_names(dim_country: DataFrame) -> list[str]:
    """All names, in order; as many as a matrix has columns."""
    return [r["country"] for r in dim_country.select("country").orderBy("country").collect()]


def monthly_country_wide(lines: DataFrame, countries: Sequence[str]) -> DataFrame:
    """Month by country matrix of gross sales, 0 where nothing was sold.

    The caller names the countries, so the number of columns is theirs to bound.
    """
    return (
        lines.groupBy("month")
        .pivot("country", list(countries))
        .agg(total("gross_sales"))
        .na.fill(0.0)
    )


def monthly_country_long(wide: DataFrame) -> DataFrame:
    """Back to one row per month and country; zero cells stay."""
    return wide.unpivot("month", [c for c in wide.columns if c != "month"], "country", "gross_sales")
